"""Suffix arrays and removal of repeated strings against brute force."""

import hashlib
import random

import numpy as np
import pytest

from genloom.llm import suffix_dedup, suffixes


def covered(texts, length):
    seen, out = set(), []
    for x in texts:
        cover = [False] * len(x)
        for p in range(len(x) - length + 1):
            w = x[p : p + length]
            if w in seen:
                cover[p : p + length] = [True] * length
            seen.add(w)
        out.append(cover)
    return out


def expected(docs, length):
    unique = sorted({(i is None, i or 0, t or "") for i, t in docs})
    assert len({u[:2] for u in unique}) == len(unique), "the fixture's ids name one text each"
    covers = dict(zip(unique, covered([u[2].encode() for u in unique], length), strict=True))
    out = []
    for i, t in docs:
        data, cover = (t or "").encode(), covers[i is None, i or 0, t or ""]
        spans = sum(c and not b for b, c in zip([False, *cover], cover, strict=False))
        kept = bytes(b for b, c in zip(data, cover, strict=True) if not c)
        out.append((i, len(data), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket", [0.01, 64])
def test_suffix_arrays_and_repeats(monkeypatch, bucket):
    monkeypatch.setattr(suffixes, "BUCKET", bucket)
    rng = random.Random(1)
    for _ in range(150):
        k = rng.choice([1, 2, 3, 250])
        t = np.array([rng.randint(1, k) for _ in range(rng.randint(1, 60))] + [0], np.int64)
        assert suffixes.suffix_array(t, k + 1).tolist() == sorted(range(len(t)), key=lambda i: t.tolist()[i:])  # noqa: B023
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 8))]
        length = rng.choice([1, 3, 5])
        got = [[False] * len(x) for x in texts]
        for i, low, high in suffixes.repeats(texts, length):
            got[i][low:high] = [True] * (high - low)
        assert got == covered(texts, length)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(6)
    write = lambda n: " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(n))
    passage, base = write(60), [write(rng.randint(1, 90)) for _ in range(25)]
    out = list(base)
    for b in base[:10]:
        w = b.split(" ")
        w[rng.randrange(len(w))] = "changed"
        out += [" ".join(w), b]
    out += [write(rng.randint(3, 30)) + " " + passage + write(rng.randint(0, 30)) for _ in range(40)]
    out += ["ab" * 900, "x" * 500, "x" * 99, "x" * 100, "", None, "-" * 3000 + base[0], "ab" * 200 + "c" + "ab" * 300, (write(30) + "\n") * 8]
    rng.shuffle(out)
    return [(i, t) for i, t in enumerate(out)] + [(None, base[3] + passage), (5, out[5])]


def table(spark, docs):
    return spark.createDataFrame([(i, t, "h", 1, True) for i, t in docs], "doc_id long, text string, sh string, low int, hot boolean")


@pytest.mark.parametrize("small", [False, True])
def test_removal_equals_brute_force(spark, docs, monkeypatch, small):
    if small:
        for name, value in (("CHUNK", 2000), ("MOST_STRINGS", 50), ("MOST_STRETCHES", 60), ("SHARD_BYTES", 700), ("HOT_STRETCHES", 3), ("HOT_ROWS", 5), ("SAMPLE", 0.9), ("MOST_BROADCAST", 0)):
            monkeypatch.setattr(suffix_dedup, name, value)
    found = suffix_dedup.dedup(table(spark, docs).repartition(5))
    assert sorted((tuple(r) for r in found.collect()), key=str) == expected(docs, 100)


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    text = " ".join(str(i * 7919) for i in range(60))
    found = suffix_dedup.dedup(table(spark, [(1, text), (1, text), (1, text + " end"), (None, text), (None, text)]))
    rows = sorted((str(r[0]), r[1], r[2]) for r in found.collect())
    n = len(text)
    whole = {r for r in rows if r[2] == 0}
    assert len(rows) == 5 and len(whole) == 1  # one text of id 1 stays, in all its rows
    assert rows.count(("None", n, n)) == 2
    assert rows in ([("1", n, 0), ("1", n, 0), ("1", n + 4, n), ("None", n, n), ("None", n, n)], [("1", n, n), ("1", n, n), ("1", n + 4, 0), ("None", n, n), ("None", n, n)])


def test_empty_tables(spark):
    assert suffix_dedup.dedup(table(spark, [])).count() == 0
    assert [r["n_bytes"] for r in suffix_dedup.dedup(table(spark, [(1, None)])).collect()] == [0]
