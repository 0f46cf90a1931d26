"""Cross-tokenizer alignment against a version by loops."""

import hashlib
import random
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest

from genloom.llm import alignment


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(alignment.FOLDER, alignment.A_FILE, alignment.B_FILE)


@lru_cache
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{alignment.FOLDER}/{alignment.A_FILE}")
    t.encode_special_tokens = True
    return t


def spans(ids, spelled):
    at, out = 0, []
    for i in ids:
        out.append((at, at + len(spelled[i]), i))
        at += len(spelled[i])
    return out


def encode(pair, text):
    if not text:
        return [], []
    a, b = tokenizer().encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    whole = (" " + text).encode()
    same = b"".join(pair.a_bytes[i] for i in a) == whole == b"".join(pair.b_bytes[i] for i in b)
    return (spans(a, pair.a_bytes), spans(b, pair.b_bytes)) if same else ([], [])


def brute(pair, docs):
    encoded = [(i, *encode(pair, t)) for i, t in docs]
    linked = [[(x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1]] for _, a, b in encoded]
    counts = Counter(p for x in linked for p in x)
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for (i, a, b), pairs in zip(encoded, linked, strict=True):
        cuts = sorted({x[1] for x in a} & {y[1] for y in b})
        said, low = [], 0
        for cut in cuts:
            inside = lambda t: ",".join(str(x[2]) for x in t if low < x[1] <= cut)  # noqa: B023, E731
            said.append(inside(a) + "|" + inside(b))
            low = cut
        digest = hashlib.sha256(";".join(said).encode()).hexdigest() if a else ""
        out.append((i, len(a), len(b), len(cuts), len(pairs), sum(counts[p] == best[p[1]] for p in pairs), sum(counts[p] for p in pairs), digest))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(2)
    words = ["alignment", "naïve", "Straße", "12345", "don't", "日本語", "x_y", "<s>", "<|endoftext|>", "é" * 4, "qzxj", "▁odd", "😀"]
    some = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(40)]
    some += ["", None, " ", "\n\n\t", "  two  spaces ", "a", "\x00\x01", "▁", "café ﬁ ½", some[0], "tail \n", "x" * 3000]
    return [(i, t) for i, t in enumerate(some)] + [(None, some[1]), (3, some[2]), (3, some[3])]


@pytest.mark.parametrize("mapped", [True, False])
def test_alignment_equals_brute_force(spark, pair, docs, mapped, monkeypatch):
    for name, value in (("BLOCK", 300), ("BATCH", 50), ("SHORT", 8), ("REMEMBERED", 5), ("MOST_KEYS", 64), ("SHARD_KEYS", 100)):
        monkeypatch.setattr(alignment, name, value)
    frame = spark.createDataFrame([(i, t, "k", 1, 2) for i, t in docs], "doc_id long, text string, key string, n int, a int").repartition(3)
    found = alignment.align(frame, mapped=mapped)
    assert found.columns == list(alignment.RESULT)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(pair, docs)


def test_pieces_give_the_tokens_of_whole_texts(pair):
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abcdefghé  \n.'s0😀", k=rng.randint(1, 9))) for _ in range(n)) for n in (3, 30, 20_000)]
    for text in texts:
        pieces = pair.pieces(text)
        assert len(pieces) > 1 and " ".join(pieces) == text
        assert [i for p in pieces for i in pair.a.encode_ordinary(" " + p)] == tokenizer().encode(" " + text, add_special_tokens=False).ids
        assert [i for p in pieces for i in pair.b.encode(p)] == pair.b.encode(text)


def test_empty_tables(spark):
    for rows in ([], [(1, None), (2, "")]):
        found = alignment.align(spark.createDataFrame(rows, "doc_id long, text string"))
        assert [tuple(r)[1:] for r in found.collect()] == [(0, 0, 0, 0, 0, 0, "")] * len(rows)


def test_run_sums_across_batches():
    import pyarrow as pa

    keys = np.array([1, 1, 2, 2, 2, 5, 5, 9])
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 2]), pa.array(np.ones(2, np.int64))], ["key", "n"]) for i in range(0, 8, 2)]
    parts = list(alignment._summed(iter(batches)))
    assert np.concatenate([k for k, _ in parts]).tolist() == [1, 2, 5, 9] and np.concatenate([n for _, n in parts]).tolist() == [2, 3, 2, 1]


def test_packed_keys():
    for keys in ([], [5 << 32 | 7, 65535 << 32 | 65535], [5 << 32 | 70_000], [70_000 << 32 | 1]):
        keys = np.array(keys, np.int64)
        packed = alignment._packed(keys)
        assert len(packed) == len(keys) * (4 if len(keys) != 1 else 8) and (alignment._unpacked(packed, len(keys)) == keys).all()


def test_stored_blocks_are_in_small_row_groups(spark, monkeypatch):
    import pyarrow.parquet as pq

    monkeypatch.setattr(alignment, "BLOCK", 1000)
    monkeypatch.setattr(alignment, "GROUP_BYTES", 1 << 16, raising=False)
    kept, real = [], alignment.materialize
    monkeypatch.setattr(alignment, "materialize", lambda *args: kept.append(real(*args)) or kept[-1])
    rng = random.Random(5)
    docs = [(i, " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(200))) for i in range(40)]
    assert alignment.align(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).count() == 40
    [file] = kept[0].inputFiles()
    told = pq.ParquetFile(file.removeprefix("file://")).metadata
    sizes = [told.row_group(i).total_byte_size for i in range(told.num_row_groups)]
    assert told.num_rows == 40 and len(sizes) > 2 and max(sizes) <= 1 << 17
