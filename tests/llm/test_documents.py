"""Operators on documents against brute force, with nulls, empty and long texts, repeats, ties and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from genloom.llm import decontam, mixing, ngram_join, quality, secrets, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, size string, row string, term int"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, texts, sources=None, langs=None):
    rows = [(i, t, (langs or ["en"] * len(texts))[i], (sources or ["s"] * len(texts))[i], None if t is None else len(t), "x", "y", "z", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def sentence(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = [None, "", "a", "  \n", "one two three", "one two three", "É é É é É", "word " * 30_000]
    base = [sentence(rng, rng.randint(20, 120)) for _ in range(30)]
    out += base
    for b in base[:12]:
        words = b.split()
        for changes in (1, 1, 2, 5):
            w = list(words)
            for _ in range(changes):
                w[rng.randrange(len(w))] = "changed"
            out.append(" ".join(w))
        out += [b, b.upper()]
    passage = sentence(rng, 60)
    out += [sentence(rng, 40) + " " + passage + " " + sentence(rng, 40) for _ in range(20)]
    return out


def words(text):
    return WORD.findall((text or "").translate(LOW))


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_classes(texts):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (find(i), links[i]) for i in range(len(sets))}


def test_near_duplicates_equal_brute_force(spark, texts):
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(frame(spark, texts)).collect()}
    assert got == brute_classes(texts)


def test_large_buckets_and_groups_are_split(spark, texts, monkeypatch):
    monkeypatch.setattr(ngram_join, "BUCKET", 3)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rng = random.Random(1)
    long = sentence(rng, 150).split()
    more = list(texts)
    for _ in range(25):
        w = list(long)
        w[rng.randrange(len(w))] = "other"
        more.append(" ".join(w))
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(frame(spark, more)).collect()}
    assert got == brute_classes(more)


def test_isolated_pairs_are_found_at_the_deepest_level(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BUCKET", 1)  # the bucket of any pair is large
    rng = random.Random(11)
    texts = []
    for n in [9] * 400 + [14] * 200:  # 4 of 5 and 8 of 10 shingles are shared
        w = [f"w{rng.randrange(10**9)}" for _ in range(n)]
        texts += [" ".join(w), " ".join(w[: n - (n - 4) // 5])]
    got = {r.doc_id: r.class_id for r in ngram_join.near_duplicates(frame(spark, texts)).collect()}
    assert [i for i in range(0, len(texts), 2) if got[i + 1] != i] == []


@pytest.mark.parametrize("n", [5, 10, 60, 300])
@pytest.mark.parametrize("depth", [1, 2, 3])
def test_recall_at_each_depth(n, depth):
    """Pairs at similarity 0.8 whose sets share a bucket at a depth, in the runs of the larger set."""
    import numpy as np

    rng = np.random.default_rng(n + depth)
    runs = ngram_join.runs_for(ngram_join.TARGET_RECALL)
    shared = n * 4 // 5
    met = 0
    for _ in range(600):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        b = a[:shared]  # 4 of 5: the smaller set is inside the larger
        k = int(runs[min(len(a), len(runs) - 1)])
        x, y = (ngram_join.chosen_paths(s, k)[:, depth - 1] for s in (a, b))
        met += bool(set(x[x != 0].tolist()) & set(y[y != 0].tolist()))
    assert met >= 598


def test_near_duplicates_of_an_empty_table(spark):
    assert ngram_join.near_duplicates(frame(spark, [])).collect() == []


def brute_contamination(texts, items):
    out = {}
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        windows.setdefault(i, set()).update(tuple(w[k : k + n]) for k in range(len(w) - n + 1) if n)
    for d, t in enumerate(texts):
        w = words(t)
        hit, found = set(), set()
        for i, ws in windows.items():
            for x in ws:
                for k in range(len(w) - len(x) + 1):
                    if tuple(w[k : k + len(x)]) == x:
                        hit.update(range(k, k + len(x)))
                        found.add(str(i))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_contamination_equals_brute_force(spark):
    rng = random.Random(3)
    items = [(10, sentence(rng, 30)), (9, sentence(rng, 13)), (9, "short item here"), (2, None), (3, "..."), (4, "zebra"), (5, "a a a a a a a a a a a a a a"), (6, "never seen word x " * 5)]
    texts = [None, "", "zebra", "a " * 20, "A-a_a " * 9, "Short, ITEM; here!", "short item  there"]
    for _ in range(25):
        _, t = rng.choice(items[:2])
        w = t.split()
        k = rng.randrange(len(w))
        texts.append(sentence(rng, rng.randint(0, 200)) + " " + " ".join(w[k : k + rng.randint(5, 25)]) + ". " + sentence(rng, rng.randint(0, 30)))
    texts.append(items[0][1] + " x " + items[0][1] + " zebra")
    got = {r.doc_id: tuple(r)[1:] for r in decontam.contamination(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute_contamination(texts, items)


def test_contamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in decontam.contamination(frame(spark, ["a b"]), none).collect()] == [(0, 2, 0, 0)]
    assert decontam.contamination(frame(spark, []), none).collect() == []


def test_proximity(spark):
    items = spark.createDataFrame([(1, "red green blue")], "item_id long, text string")
    index = decontam.PositionalIndex(frame(spark, ["blue x green y red", "red " + "x " * 30 + "green blue", "red green"]), items)
    rows = {r["row"]: r["doc_id"] for r in index.rows().collect()}
    assert {rows[r["row"]] for r in index.near(slack=3).collect()} == {0}


def test_secret_base_matches_equal_python(spark):
    rng = random.Random(2)
    key = lambda n, a="ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789abcdefghijklmnopqrstuvwxyz": "".join(rng.choice(a) for _ in range(n))
    texts = [None, "", "nothing", "token=abc", "secret=token = abcdef1", "é PassWord: 'hunter22' x", f"apikey={key(30)} AKIA{key(16, 'ABCDEFGHIJKLMNOP0123')} {key(40, '0123456789abcdef')}", "AKIA123", f"𝄞 {key(24, 'abcdef0123')}=", "token:secret:abcdefgh", "api_key=\"" + key(20) + "\"" * 3]
    texts += [f"{sentence(rng, 5)} {key(40)} {sentence(rng, 5)}" for _ in range(20)] + ["word1" * 8]
    patterns = {
        "assign": (re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?((?-i:[A-Za-z0-9+/_.=-]+))"""), 2, 6),
        "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
        "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
    }
    got = {r.doc_id: r for r in secrets.secret_digest(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for d, t in enumerate(texts):
        spans = [(m.start(), k, m.end()) for k, (p, g, n) in patterns.items() for m in p.finditer(t or "") if len(m[g]) >= n]
        spans.sort(key=lambda s: (s[0], list(patterns).index(s[1])))
        base = ",".join(f"{k}:{a}:{b}" for a, k, b in spans)
        assert got[d].base_sha256 == hashlib.sha256(base.encode()).hexdigest(), t
        assert (got[d].n_assign, got[d].n_access, got[d].n_hex) == tuple(sum(s[1] == k for s in spans) for k in patterns)
        assert set(filter(None, base.split(","))) <= set(got[d].spans.split(","))
    added = sum("random:" in got[d].spans for d in range(11, 31))
    assert added >= 18 and "random" not in got[31].spans
    assert secrets.secret_digest(frame(spark, [])).collect() == []


def test_texts_with_very_many_matches(spark):
    import time

    rng = random.Random(6)
    key = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    text = " ".join(rng.choice(["token=abcdef12", "f" * 24, key(40), "é word", "secret=" + key(30)]) for _ in range(30_000))
    began = time.time()
    got = secrets.secret_digest(frame(spark, [text, "token=abcdef12"])).collect()
    assert time.time() - began < 60
    spans = [(m.start(), "assign", m.end()) for m in re.finditer(r"(?:token|secret)=[A-Za-z0-9]+", text)] + [(m.start(), "hex", m.end()) for m in re.finditer(r"[0-9a-f]{24,}", text)]
    base = ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(spans))
    assert {r.doc_id: r.base_sha256 for r in got}[0] == hashlib.sha256(base.encode()).hexdigest()
    assert {r.doc_id: r.spans.count("random") for r in got}[0] > 4_500


def test_bare_keys_of_every_encoding_and_length_are_found(spark):
    rng = random.Random(4)
    base62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    alphabets = {"HEX": "0123456789ABCDEF", "hex": "0123456789abcdef", "base32": base62[:26] + "234567", "base36": base62[26:], "base62": base62, "base64": base62 + "+/"}
    planted = [(e, n) for e in alphabets for n in (20, 22, 24, 32, 40, 48, 64) for _ in range(20)]
    word = lambda: rng.choice("account service database connection manager handler request response token value index image content river station".split())
    written = [lambda: "_".join(word() for _ in range(4)) + "2", lambda: "".join(word().title() for _ in range(4)) + "1", lambda: "/lib/" + "/".join(word() for _ in range(3)) + "/v2", lambda: "BUILD_" + "_".join(word() for _ in range(3)).upper() + "_64"]
    texts = ["a " + "".join(rng.choice(alphabets[e]) for _ in range(n)) + " b" for e, n in planted] + [rng.choice(written)() for _ in range(400)]
    got = {r.doc_id: r.spans for r in secrets.secret_digest(frame(spark, texts)).collect()}
    found = Counter(p for i, p in enumerate(planted) if re.search(r"\b(random|hex):", got[i]))
    assert {p: found[p] for p in set(planted) if found[p] < 17} == {}
    assert sum(got[i] != "" for i in range(len(planted), len(texts))) <= 8


def test_identifiers_are_not_taken_for_keys(spark):
    rng = random.Random(9)
    words = "get user http account service database connection manager handler request response token value index image content river station query json xml parser buffer stream socket quick jump zone fix box".split()
    alphabets = ["0123456789abcdef".upper(), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz0123456789"]
    keys = ["".join(rng.choices(rng.choice(alphabets), k=rng.choice([24, 32, 40]))) for _ in range(350)]

    def name(style):
        some = rng.sample(words, rng.randint(5, 8))
        some = [w.title() if style == "camel" else w for w in some]
        some.insert(rng.randint(1, 5), rng.choice(["2019", "V2", "64", "3"]))
        return {"camel": "", "snake": "_", "kebab": "-", "path": "/"}[style].join(some)

    names = [name(style) for style in ("camel",) * 2500 + ("snake", "kebab", "path") * 300]
    got = {r.doc_id: r.spans for r in secrets.secret_digest(frame(spark, keys + names)).collect()}
    found = sum(got[i] != "" for i in range(len(keys)))
    wrong = sum(got[i] != "" for i in range(len(keys), len(keys) + len(names)))
    assert found >= 0.95 * len(keys) and wrong <= 0.02 * found


def test_keys_of_letters_alone_are_tested(spark):
    rng = random.Random(8)
    low, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    planted = [(a, n) for a in (low, upper, low + upper) for n in (32, 40, 64) for _ in range(20)]
    word = lambda: rng.choice("account service database connection manager handler request response token value index image content river station".split())
    written = [lambda: "".join(word() for _ in range(4)), lambda: "".join(word().title() for _ in range(4)), lambda: "/" + "/".join(word() for _ in range(4)), lambda: "BUILD_" + "_".join(word() for _ in range(3)).upper(), lambda: "-" * 40, lambda: "1234567890" * 3, lambda: "2024" + "0" * 20, lambda: "x" * 30, lambda: str(rng.randrange(10**24, 10**25))]
    texts = ["a " + "".join(rng.choice(a) for _ in range(n)) + " b" for a, n in planted] + [written[i % len(written)]() for i in range(400)]
    got = {r.doc_id: r.spans for r in secrets.secret_digest(frame(spark, texts)).collect()}
    found = Counter(p for i, p in enumerate(planted) if "random:" in got[i])
    assert {p: found[p] for p in set(planted) if found[p] < 14} == {}
    assert sum("random:" in got[i] for i in range(len(planted), len(texts))) <= 8


def test_shards_are_near_equal_and_slots_gapless(spark, texts):
    many = (texts + texts[:20]) * 5 + ["same"] * 700
    rows = sharding.shard_documents(frame(spark, many, sources=[None if i % 7 == 0 else f"s{i % 5}" for i in range(len(many))]), 24).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(many)))
    total, load, slots = 0, Counter(), {}
    for r in rows:
        data = (many[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        load[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
        total += r.size
    most = max(r.size for r in rows)
    assert all(abs(load[i] - total / 24) <= 5 * (most / 2 + 1) for i in range(24))
    assert set(load) <= set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def brute_kd(rows, shards):
    """Loads of the leaves. rows: (coordinates in 0..2^20-1 by dimension, size), coordinates of the last one distinct."""
    if shards == 1:
        return [sum(s for _, s in rows)]
    spread = [max(x[i] for x, _ in rows) - min(x[i] for x, _ in rows) for i in range(len(rows[0][0]))]
    dim = max(range(len(spread)), key=lambda i: (spread[i], -i))
    assert len({x[dim] for x, _ in rows}) == len(rows) or dim < len(spread) - 1
    goal, at, upto = sum(s for _, s in rows) * (shards // 2) / shards, 0, 0
    rows = sorted(rows, key=lambda r: r[0][dim])
    while upto + rows[at][1] < goal:
        upto += rows[at][1]
        at += 1
    at += not (goal - upto < upto + rows[at][1] - goal)
    return brute_kd(rows[:at], shards // 2) + brute_kd(rows[at:], shards - shards // 2)


def test_shard_loads_equal_a_brute_force_tree(spark):
    import math

    rng = random.Random(21)
    rows = [(i, "x" * rng.randint(0, 400), None, None, n) for i, n in enumerate(rng.sample(range(5, 5000), 700))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("doc_id", "text", "n_chars")
    lo, hi = (math.log1p(f(r[4] for r in rows)) for f in (min, max))
    at = [math.floor((math.log1p(r[4]) - lo) / (hi - lo) * ((1 << 20) - 1)) for r in rows]
    want = brute_kd([((a,), len(r[1]) + 8) for a, r in zip(at, rows, strict=True)], 24)
    got = Counter()
    for r in sharding.kd_assign(docs, 24, tolerance=0.0).collect():
        got[r["shard"]] += r["size"]
    assert len(set(at)) == len(at) and [got[i] for i in range(24)] == want


def test_sources_alike_at_the_start_are_kept_apart(spark):
    names = [None, "web-crawl-a", "web-crawl-b", "web-crawl-c", "web-crawl-d"]
    docs = frame(spark, ["some text"] * 1000, sources=[names[i % 5] for i in range(1000)], langs=["en"] * 1000)
    docs = docs.withColumn("n_chars", __import__("pyspark").sql.functions.lit(9).cast("long"))
    shard = {r.doc_id: r["shard"] for r in sharding.kd_assign(docs, 5).collect()}
    pairs = Counter((shard[i], names[i % 5]) for i in range(1000))
    assert max(Counter(s for s, _ in pairs).values()) <= 2 and sum(n for (s, _), n in pairs.items() if n >= 190) >= 5 * 190
    order = [max((n, s) for (s, x), n in pairs.items() if x == name)[1] for name in names]
    assert order == [0, 1, 2, 3, 4]


def test_ranks_of_very_many_values(spark, monkeypatch):
    values = [None, "", "b", "a", "é", "aa", *(f"v{i}" for i in range(300))]
    ranks = {r.value: r.rank for r in sharding._ranks(spark.createDataFrame([(v,) for v in values], "value string").repartition(5)).collect()}
    assert ranks == {v: i + 1.0 for i, v in enumerate(sorted(values, key=lambda v: (v is not None, (v or "").encode())))}
    docs = frame(spark, [f"text {i}" for i in range(400)], sources=[f"s{i % 97}" for i in range(400)])
    place = lambda: sorted((r.doc_id, r.shard) for r in sharding.shard_documents(docs, 8).collect())
    want = place()
    monkeypatch.setattr(sharding, "MOST_VALUES", 0)  # every table is joined by a shuffle
    assert place() == want


def test_two_thousand_shards(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    many = docs.crossJoin(spark.range(20)).select(docs.columns)
    loads = Counter()
    for r in sharding.kd_assign(many, 2000).collect():
        loads[r["shard"]] += 1
    assert set(loads) <= set(range(2000)) and sum(loads.values()) == many.count()


def test_shards_of_small_equal_and_tied_rows(spark):
    from pyspark.sql import functions as F

    docs = frame(spark, ["equal text"]).select(F.lit(7).cast("long").alias("doc_id"), "text", "lang", "source", "n_chars").crossJoin(spark.range(2400).select(F.col("id").alias("x")))
    count = Counter(r.shard for r in sharding.shard_documents(docs, 24).collect())
    assert len(count) == 24 and max(count.values()) - min(count.values()) <= 4
    assert sharding.shard_documents(frame(spark, []), 24).collect() == []
    assert [r.slot for r in sharding.shard_documents(frame(spark, [None]), 24).collect()] == [0]


def brute_targets(sizes):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, target, free = sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while True:
        rest = total - sum(3 * sizes[s] for s in names if s not in free)
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            return {s: level * weight[s] if s in free else 3.0 * sizes[s] for s in names}
        free -= over


def test_mixture(spark, texts):
    sources = [[None, "b", "a", "ä", "tiny"][min(i % 5, 4)] if i % 11 else "tiny" for i in range(len(texts))]
    sources = ["tiny" if t and len(t) < 10 else s if s != "tiny" else "a" for t, s in zip(texts, sources)]
    rows = mixing.mixture(frame(spark, texts, sources)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = Counter(), Counter()
    for t, s in zip(texts, sources):
        sizes[s] += size(t)
    want = brute_targets(dict(sizes))
    most = Counter()
    for r in rows:
        s = sources[r.doc_id]
        assert r.size == size(texts[r.doc_id]) and r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
        most[s] = max(most[s], r.size)
    assert all(abs(taken[s] - want[s]) <= most[s] for s in want)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mixture(frame(spark, texts, sources)).collect()))
    kept = Counter(r.doc_id for r in mixing.mix_documents(frame(spark, texts, sources)).collect())
    assert all(kept[r.doc_id] * r.size == r.taken for r in rows)
    assert mixing.mixture(frame(spark, [])).collect() == []


@pytest.mark.parametrize("shape", ["null ids", "one id", "copies", "copies without ids", "wordless"])
def test_mixture_of_rows_that_share_an_id(spark, shape):
    rng = random.Random(12)
    some = [sentence(rng, rng.randint(1, 20)) for _ in range(120)]
    rows = []
    for i in range(120):
        doc_id = {"null ids": None, "one id": 7, "copies": 7, "copies without ids": None, "wordless": i}[shape]
        text = some[i] if shape in ("null ids", "one id") else "the same ten words in every row of this source" if shape != "wordless" else None if i % 2 else "w"
        rows.append((doc_id, text, None, "a", 1))
    rows += [(1000 + i, some[i], None, "b" if i % 3 else None, 1) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    size = lambda t: len((t or "").split())
    sizes = Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += size(text)
    want = brute_targets(dict(sizes))
    got = mixing.mixture(docs).collect()
    taken = {s: sum(r.taken for r in got if r.source_size == sizes[s]) for s in sizes}
    most = max(size(r[1]) for r in rows)
    assert len(got) == len(rows) and len(set(sizes.values())) == 3
    assert all(2 * abs(taken[s] - want[s]) <= most for s in sizes)
    again = mixing.mixture(docs.repartition(3)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    kept = mixing.mix_documents(docs.selectExpr("*", "1 as times", "2 as doc", "3 as copies", "4 as k0", "5 as `a.b`"))
    assert kept.columns == [*docs.columns, "times", "doc", "copies", "k0", "a.b"]
    assert sum(size(r.text) for r in kept.collect()) == sum(taken.values())
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    assert Counter(con.execute(f"SELECT doc_id, size, source_size, round(target, 6), taken FROM ({mixing.SQL})").fetchall()) == Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got)


def test_items_without_an_id_hit_words(spark):
    items = spark.createDataFrame([(None, "red green blue"), (3, "one two")], "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:4] for r in decontam.contamination(frame(spark, ["red green blue", "x red green blue one two", None]), items).collect()}
    assert got == {0: (3, 3, 0), 1: (6, 5, 1), 2: (0, 0, 0)}


def test_quality_rows_of_one_labelled_id_are_bounded(spark):
    rng = random.Random(5)
    texts = [sentence(rng, 30) if i % 2 else sentence(rng, 30).upper() for i in range(200)]
    docs = frame(spark, texts)
    many = docs.unionByName(docs.where("doc_id = 3").crossJoin(spark.range(3000)).select(docs.columns))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    features = quality.feature_table(many)
    taken = []
    fit = quality.Logistic.fit
    quality.Logistic.fit = lambda self, x, y, weight=None: taken.append(len(x)) or fit(self, x, y, weight)
    try:
        assert quality.co_train(features, labels, max_rows=400, max_pseudo=50) is not None
    finally:
        quality.Logistic.fit = fit
    assert max(taken) <= 2 * 400 + 4 * 2 * 50


def test_quality_keeps_columns_of_any_name(spark):
    rng = random.Random(8)
    texts = [sentence(rng, 30) if i % 3 else sentence(rng, 30).upper() + "!!" for i in range(90)] + [None, ""]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(90)], "doc_id long, quality int, toxic int")
    docs = frame(spark, texts).selectExpr("*", "1 as c0", "2 as content", "map('a', 1) as metadata", "3 as `x.y`").drop("lang", "n_chars").withColumn("doc_id", __import__("pyspark").sql.functions.col("doc_id").cast("int"))
    kept = quality.keep_quality(docs, labels)
    assert kept.schema.simpleString() == docs.schema.simpleString()
    ids = {r.doc_id for r in kept.collect()}
    assert {i for i in range(90) if i % 3} <= ids and not {i for i in range(90) if i % 3 == 0} & ids
    assert quality.keep_quality(docs.where("false"), labels).collect() == []


def test_quality_on_held_out_labels(spark):
    rng = random.Random(8)
    texts, y = [], []
    for i in range(400):
        good = rng.random() < 0.7
        t = sentence(rng, rng.randint(15, 80))
        texts.append(t if good else rng.choice([t.upper() + "!!", t.replace(" ", " | "), (t.split()[0] + " ") * 60]))
        y.append(int(good))
    texts += [None, "", "x" * 300_000]
    labels = spark.createDataFrame([(i, y[i], 0) for i in range(0, 200)] + [(3, y[3], 1), (None, 1, 0), (5000, 0, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality.quality_scores(frame(spark, texts), labels).collect()}
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows.values())
    right = sum(rows[i].keep == bool(y[i]) for i in range(200, 400))
    assert right >= 190
    kept = quality.keep_quality(frame(spark, texts), labels)
    assert kept.schema == frame(spark, texts).schema
    assert {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.keep}
    assert all(r.keep for r in quality.quality_scores(frame(spark, texts[:5]), labels.where("quality = 1")).collect())
    assert quality.quality_scores(frame(spark, []), labels).collect() == []
