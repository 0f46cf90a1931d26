"""Operators on pages and embeddings against brute force."""

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from genloom.llm import html_extract, topk, url_filter, warc

PAGE = "page_id long, url string, html string, host string, run string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], PAGE)


def test_archives_round_trip_in_global_order(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 7)
    rng = random.Random(4)
    rows = [(i, f"http://h{rng.randint(0, 3)}.org/p{rng.randint(0, 4)}", rng.choice(["", None, "same", f"own {i}", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n\r\n", "é\n" * i])) for i in range(40)]
    rows += [(40, None, "x"), (41, "no scheme", "same")] + [(100 + i, "http://hot.org/", "hot") for i in range(60)]
    got = warc.merge_runs(warc.read_runs(spark, write(spark, pages(spark, rows).repartition(5))), range_rows=7).collect()
    first = {}
    for i, _, h in rows:
        first[h or ""] = min(i, first.get(h or "", i))
    assert len(got) == len(rows)
    for r in got:
        html = next(h for i, _, h in rows if i == r.page_id) or ""
        digest = base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), digest)
        assert (r.record_type, r.refers_to) == (("response", None) if first[html] == r.page_id else ("revisit", first[html]))
    got.sort(key=lambda r: (r.merge_range, r.merge_pos))
    keys = [(r.url_key, r.captured, r.page_id) for r in got]
    assert keys == sorted(keys) and len({r.merge_range for r in got}) > 3
    assert warc.capture_index(pages(spark, [])).collect() == []


def test_archives_of_repeated_and_null_ids(spark):
    rows = [(1, "u1", "a"), (1, "u2", "a"), (1, "u1", "a"), (2, "u", "a"), (None, "n", "a"), (None, "n", "b"), (None, "n", "b"), (None, "m", "c"), (5, "m", "c"), (6, "x", ""), (7, "x", None)]
    got = warc.capture_index(pages(spark, rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r.payload_digest, []).append((r.page_id, r.record_type, r.refers_to))
    digest = lambda x: base64.b32encode(hashlib.sha1(x.encode()).digest()).decode()
    order = lambda xs: sorted(xs, key=str)
    assert {k: order(v) for k, v in by.items()} == {
        digest("a"): order([(1, "response", None), (1, "revisit", 1), (1, "revisit", 1), (2, "revisit", 1), (None, "revisit", 1)]),
        digest("b"): order([(None, "response", None), (None, "revisit", None)]),
        digest("c"): order([(5, "response", None), (None, "revisit", 5)]),
        digest(""): order([(6, "response", None), (7, "revisit", 6)]),
    }
    assert sorted(r.capture_pos for r in got) == list(range(len(rows)))
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "capture_pos"]
    want = con.execute(f"SELECT {', '.join(columns[:-1])} FROM ({warc.SQL})").fetchall()
    assert order(want) == order(tuple(r[c] for c in columns[:-1]) for r in got)


def test_archives_of_long_pages_are_bounded_by_bytes(spark):
    rows = [(i, f"http://a.org/{i}", ("x" * (1 << 23) if i == 3 else "y" * 300_000 if i < 100 else "z") + str(i)) for i in range(140)]
    path = write(spark, pages(spark, rows).coalesce(1))
    sizes = [r.length for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("length").collect()]
    assert max(sizes) <= warc.FILE_BYTES + 1_000_000 and len(sizes) >= 1 + 7 + 1
    got = warc.read_runs(spark, path).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in got) == [(i, len(h)) for i, _, h in rows]


def write(spark, df):
    path = warc.scratch_path(spark, "warc")
    warc.write_archives(df, path)
    return path


def test_captures_that_are_alike_span_ranges(spark):
    rows = [(None, None, "x")] * 400 + [(i, f"http://h{i}/", "y") for i in range(200)]
    merged = warc.merge_runs(warc.read_runs(spark, write(spark, pages(spark, rows).repartition(6))), range_rows=50)
    sizes = [r["count"] for r in merged.groupBy("merge_range").count().collect()]
    assert sum(sizes) == 600 and max(sizes) <= 150
    keys = [(r.url_key, r.captured, r.page_id is None, r.page_id or 0) for r in sorted(merged.collect(), key=lambda r: (r.merge_range, r.merge_pos))]
    assert keys == sorted(keys)


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted((rng.randint(0, 9),) for _ in range(rng.randint(0, 20))) for _ in range(k)]
    assert [runs[r][i] for r, i in warc.loser_tree_merge(runs)] == sorted(x for run in runs for x in run)


def brute_top(rows, k):
    v = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in e]) for i, e in rows if e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for a, (q, x) in enumerate(v):
        if q is not None and q % 20 == 0:
            best = sorted((-sum(s * t for s, t in zip(x, y)), c is None, c or 0) for b, (c, y) in enumerate(v) if a != b and len(x) == len(y))[:k]
            out += [(q, r + 1, None if none else c, -s) for r, (s, none, c) in enumerate(best)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [None, 40])
@pytest.mark.parametrize("shape", ["random", "clustered", "tied", "large"])
def test_top_k_equals_brute_force(spark, shape, block):
    rng = np.random.default_rng(3)
    n, dims = 300, 8
    x = rng.normal(0, 0.2, (n, dims))
    if shape == "clustered":
        x[:, 0] += np.where(np.arange(n) % 10 == 0, 4, 0)
    if shape == "tied":
        x[40:240] = x[40]
    if shape == "large":
        x *= 2.0**24
    rows = [(i, [float(a) for a in x[i]]) for i in range(n)]
    rows += [(300, None), (301, [None] * dims), (302, [float("nan")] * dims), (303, [float("inf")] * dims), (320, [0.0] * dims), (340, [1.0, 2.0]), (360, []), (None, rows[5][1]), (None, rows[6][1])]
    rows += [rows[20], rows[20], (20, rows[7][1]), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).withColumn("row", F.lit("clash"))
    got = sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 20, block).collect()), key=str)
    assert got == brute_top(rows, 20)
    assert topk.top_k(df.where("vec_id < 0"), F.col("vec_id") % 20 == 0).collect() == []


@pytest.mark.parametrize("shape,most_read,most_resolved", [("steep", 0.3, 0.05), ("uniform", 0.95, 0.125)])
def test_few_vectors_are_resolved(shape, most_read, most_resolved):
    rng = np.random.default_rng(0)
    n, dims, k = 4000, 3 if shape == "steep" else 64, 20
    c = np.round(rng.pareto(1.0, (n, dims)) * 10).astype(np.int64) if shape == "steep" else np.floor(rng.normal(0, 8, (n, dims))).astype(np.int64)
    q = c[:100]
    first, second = topk.Block(np.arange(n // 2), np.arange(n // 2), c[: n // 2]), topk.Block(np.arange(n // 2, n), np.arange(n // 2, n), c[n // 2 :])
    i, _, score = topk.nra(first, q, np.arange(100), np.full(100, topk.NO_FLOOR), k)
    floor = np.array([score[i == a].min() for a in range(100)])
    stats: dict = {}
    i2, _, score2 = topk.nra(second, q, np.arange(100), floor, k, stats)
    every = q @ c.T
    every[np.arange(100), np.arange(100)] = -(10**9)
    for a in range(100):
        assert sorted([*score[i == a], *score2[i2 == a]], reverse=True)[:k] == sorted(every[a].tolist(), reverse=True)[:k]
    assert (score2 >= floor[i2]).all()
    assert stats["read"] <= most_read * 100 * n / 2 and stats.get("resolved", 0) <= most_resolved * 100 * n / 2


def test_blocks_that_cannot_qualify_get_no_queries(spark):
    rows = [(i, [10.0, 0.0] if i < 40 else [0.1, 0.0]) for i in range(400)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    ends = topk.block_bounds(topk.integer_vectors(v).withColumn("dims", F.size("v")).withColumn("block", (F.col("vec_id") / 40).cast("int")))
    assert {r.block: [tuple(e)[1:] for e in r.ends] for r in ends.collect()} == {0: [(640, 640), (0, 0)], **{b: [(6, 6), (0, 0)] for b in range(1, 10)}}


ARTICLE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><p>no";</script><style>p{}</style></head><body>
<header>Site header</header><nav><ul><li><a href=/a>A</a></li></ul></nav><div class="ad">Buy now, buy a lot of things here today for less</div>
<div id="cookie-notice">We use cookies and other things to make this site better for you.</div>
<article><h1>Head&amp;line</h1><p>First   paragraph with <b>bold</b> and a <a href="x">link</a> in
 it that goes on for a while.</p><p>Short.</p><div class="share-buttons">Share this</div><p><b>Unclosed &eacute; text.<br><p>Last one, again long enough to be content by its ratio.</p>
<section class="comments"><p>A reader's comment that is long enough to look like content of the page.</p></section></article>
<aside>Side text</aside><form>Sign up <input name=q></form><footer>&copy; foot</footer></body></html>"""


def test_main_text_of_an_article():
    want = "Head&line\nFirst paragraph with bold and a link in it that goes on for a while.\nShort.\nUnclosed é text.\nLast one, again long enough to be content by its ratio."
    assert html_extract.main_text(ARTICLE) == want


def test_main_text_without_named_regions():
    links = "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(20))
    paragraphs = "".join(f"<p>Paragraph {i} has many words in it, so that its ratio of text to tags is high.</p>" for i in range(5))
    html = f"<body><div><ul>{links}</ul></div><div><p>{'word ' * 40}</p>{paragraphs}<p>Tiny.</p></div><div class=sidebar>{'side ' * 50}</div></body>"
    text = html_extract.main_text(html)
    assert text.count("Paragraph") == 5 and "Tiny." in text and "Link" not in text and "side" not in text


def by_hand(html):
    """The text of the article element, by patterns of the test pages' own markup."""
    import html as markup
    import re

    inside = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    lines = [markup.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?[bi]>", "", x))) for x in re.split(r"</?(?:h1|p)>", inside)]
    return "\n".join(x for x in (re.sub(r"\s+", " ", line).strip() for line in lines) if x)


def test_main_text_of_all_test_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: by_hand(r.html) for r in rows.collect()}
    got = {r.page_id: r.text for r in html_extract.extract_main_text(rows).collect()}
    assert got == want


LINKS = "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(30))
PARAGRAPHS = "".join(f"<p>Paragraph {i} has many words in it, so that its ratio of text to tags is high enough to count.</p>" for i in range(5))
SOUPS = {
    "article": f"<body><div><ul>{LINKS}</ul></div><article><h1>Title</h1>{PARAGRAPHS}<p>Tiny.</p></article><div><ul>{LINKS}</ul></div></body>",
    "divs": f"<body><div class=x1><ul>{LINKS}</ul></div><div class=x2><div><h2>Title</h2></div><div>{PARAGRAPHS}<p>Tiny.</p></div><div>{PARAGRAPHS}</div><div><p>See <a>one</a></p><p><a>two</a></p></div></div><div><ul>{LINKS}</ul></div></body>",
    "table": f"<table><tr><td><ul>{LINKS}</ul><td><h3>Title</h3>{PARAGRAPHS}<td><ul>{LINKS}</ul></table>",
}


@pytest.mark.parametrize("name", SOUPS)
def test_clusters_choose_the_region(name):
    page = html_extract.parsed(SOUPS[name])
    text = html_extract.main_text(SOUPS[name])
    assert "Title" in text and text.count("Paragraph") == (10 if name == "divs" else 5) and "Link" not in text and "See" not in text
    assert ("Tiny." in text) == (name != "table")
    off = "\n".join(html_extract.content_lines(page, np.ones(len(page.lines), bool)))
    assert off != text and "Link" in off


@pytest.mark.parametrize("piece", ["<div>a ", "<p><b>a ", "<div class=ad>a ", "<article>a", "</div>a<b>", "<table><tr><td>a", "<li>a<ul>", "&amp", "<", "<!-", "<b <"])
def test_main_text_takes_time_in_proportion(piece):
    import time

    began = time.time()
    html_extract.main_text(piece * 100_000)
    assert time.time() - began < 20


def test_main_text_rows(spark):
    long = "<p>" + "long text " * 100_000 + "</p>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain words"), (4, "u", "<p>cut <b>of"), (5, "u", long), (5, "u", ARTICLE), (6, "u", "<nav>only</nav>")]
    got = [(r.page_id, r.text, r.n_chars) for r in html_extract.extract_main_text(pages(spark, rows)).collect()]
    assert sorted(got, key=lambda r: (r[0], r[2]))[:2] == [(1, "", 0), (2, "", 0)]
    by = {i: t for i, t, _ in got if i != 5}
    assert by[3] == "plain words" and by[4] == "cut of" and by[6] == "" and all(n == len(t) for _, t, n in got)
    assert html_extract.extract_main_text(pages(spark, [])).collect() == []


def brute_verdicts(rows, damping=0.85, rounds=120):
    import re

    def host(u):
        m = re.search(r"://([^/?#]*)", u or "")
        return m[1].lower() if m else ""

    def judged(u):
        m = re.search(r"://[^/?#]*([^?#]*)", u or "")
        h, p = host(u), m[1] if m else ""
        for verdict, rule in sorted(url_filter.RULES, key=lambda r: -len(r[1])):
            top, _, rest = rule.partition("/")
            if (h == top or h.endswith("." + top)) and p.startswith("/" + rest):
                return h, p, rule, verdict
        return h, p, None, None

    edges, pages_of, good, bad = {}, {}, {}, {}
    for _, u, html in rows:
        h, _, _, v = judged(u)
        for t in {host(x) for x in re.findall(r"""(?i)(?:href|src)\s*=\s*["']?\s*([a-z][a-z0-9+.-]*://[^"'\s<>]+)""", html or "")} | {x.lower() for x in re.findall(r"""href='//([^/']+)""", html or "")}:
            if h and t and t != h:
                edges[h, t] = edges.get((h, t), 0) + 1
        if h:
            pages_of[h] = pages_of.get(h, 0) + 1
            good[h] = good.get(h, 0) + (v == "allow")
            bad[h] = bad.get(h, 0) + (v == "block")
    share = lambda x: {h: x[h] / pages_of[h] for h in pages_of}
    good, bad = share(good), share(bad)
    out, into = {}, {}
    for (a, b), n in edges.items():
        out[a] = out.get(a, 0) + n
        into[b] = into.get(b, 0) + n
    t, d = dict(good), dict(bad)
    for _ in range(rounds):
        hosts = set(good) | {h for e in edges for h in e}
        now = {h: (1 - damping) * good.get(h, 0) for h in hosts}, {h: (1 - damping) * bad.get(h, 0) for h in hosts}
        for (a, b), n in edges.items():
            now[0][b] += damping * t.get(a, 0) * n / out[a]
            now[1][a] += damping * d.get(b, 0) * n / into[b]
        t, d = now
    blocked = {h for h in d if d[h] > t[h] * (1 + 1e-9)}
    return sorted((i, *(j := judged(u))[:3], j[3] or ("block" if j[0] in blocked else "allow")) for i, u, _ in rows) if all(i is not None for i, _, _ in rows) else None


def test_url_verdicts_equal_brute_force(spark):
    rng = random.Random(6)
    hosts = ["a.net", "x.example.net", "example.com", "b.org", "c.io", "d.io", "e.io", "farm.biz", "shop.biz"]
    link = lambda h: f"<a href='http://{h}/x'>" + rng.choice(["", f'<img SRC="HTTPS://{h.upper()}/i.png">'])
    target = {"farm.biz": ["a.net", "a.net", "shop.biz"], "shop.biz": ["a.net"], "b.org": ["c.io", "d.io"], "c.io": ["d.io", "b.org"], "d.io": ["e.io"], "e.io": ["b.org"]}
    rows = []
    for i in range(120):
        h = rng.choice(hosts)
        path = rng.choice(["/en/1", "/de/2", "/fr/3", "", "/en", "/x?q=/en/", "/de/#f"])
        rows.append((i, f"http://{rng.choice(['', 'WWW.'])}{h}{path}" if i % 9 else f"http://{h}{path}", "".join(link(t) for t in target.get(h, [])) + "<a href='/own'>" + ("<a href='//c.io/x'>" if h == "e.io" else "")))
    rows += [(200, None, None), (201, "no scheme/en/", ""), (202, "http://net/", ""), (203, "http://magnet/", ""), (204, "x://example.net/en/a://b", "")]
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages(spark, rows)).collect())
    want = brute_verdicts(rows)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert got == want and {"block"} == {v for _, h, _, r, v in got if h == "farm.biz" and r is None} and {"allow"} == {v for _, h, _, r, v in got if h == "e.io" and r is None}
    assert url_filter.judge(pages(spark, [])).collect() == []
    assert got == in_duckdb(rows)


def in_duckdb(rows):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    return sorted(con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({url_filter.sql()})").fetchall())


def test_seeds_without_links_are_judged_by_their_own_rules(spark):
    rows = [(1, "http://example.com/de/", None), (2, "http://example.com/en/", ""), (3, "http://a.org/fr/", ""), (4, "http://a.org/en/", ""), (5, "http://other.io/", ""), (6, "http://both.example.com/", ""), (7, None, None)]
    assert {r.page_id: r.verdict for r in url_filter.judge(pages(spark, rows)).collect()} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "allow"}


def test_url_verdicts_do_not_depend_on_the_size_of_the_graph(spark):
    fan = 300

    def graph(copy):
        host = lambda level, i: f"h{level}-{i}.c{copy}.io"
        to = lambda level: host(level, 0) if level else f"bad.c{copy}.net"
        return [(f"http://{host(level, i)}/", f"<a href='http://{to(level - 1)}/'>") for level in (1, 2, 3) for i in range(fan)] + [(f"http://{to(0)}/", ""), (f"http://alone.c{copy}.io/", "")]

    def verdicts(copies):
        rows = [(i, u, h) for i, (u, h) in enumerate(r for c in range(copies) for r in graph(c))]
        return [r.verdict for r in sorted(url_filter.judge(pages(spark, rows)).collect(), key=lambda r: r.page_id)]

    once = verdicts(1)
    assert once == ["block"] * (3 * fan + 1) + ["allow"]
    assert verdicts(6) == once * 6


def test_distrust_follows_long_chains_and_unrelated_hosts_change_nothing(spark):
    chain = [(i, f"http://h{i}.io/", f"<a href='http://{'h%d.io' % (i - 1) if i > 1 else 'a.net'}/'>") for i in range(1, 42)] + [(99, "http://a.net/", "")]
    fork = [(100, "http://t.org/fr/", "<a href='http://mid.io/'>"), (101, "http://mid.io/", "<a href='http://b.net/'><a href='http://c.io/'>"), (102, "http://b.net/x", "")]
    more = [(200 + i, f"http://u{i}.org/fr/{i}", f"<a href='http://v{i}.io/'>") for i in range(30)]
    alone = {r.page_id: r.verdict for r in url_filter.judge(pages(spark, chain + fork)).collect()}
    assert {alone[i] for i in range(1, 42)} == {"block"}
    joined = {r.page_id: r.verdict for r in url_filter.judge(pages(spark, chain + fork + more)).collect()}
    assert {i: v for i, v in joined.items() if i < 200} == alone
    assert joined == {w[0]: w[4] for w in brute_verdicts(chain + fork + more)} == {w[0]: w[4] for w in in_duckdb(chain + fork + more)}


def test_links_without_a_scheme_are_edges(spark):
    rows = [(1, "http://a.net/", ""), (2, "http://farm.biz/", "<a href='//A.net/x'>"), (3, "http://img.biz/", '<img src=//a.net?y>'), (4, "http://own.biz/", "<a href='/a//a.net/'><a href='x//a.net'>")]
    assert {r.page_id: r.verdict for r in url_filter.judge(pages(spark, rows)).collect()} == {1: "block", 2: "block", 3: "block", 4: "allow"}
