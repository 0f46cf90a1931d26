"""Cross-tokenizer alignment: how the tokens of two tokenizers fall together, and how often each pair of ids does so.

Texts are cut at single spaces, where no token of either tokenizer lies across, and every different piece of a block of texts
is encoded once by each (A: byte-level BPE of space+text; B: pieces with byte fallback, which adds the space itself). Both spell
the same bytes, so their ends are offsets into one string: offsets where both end cut the tokens into groups, and each stretch
between neighbouring ends of either is exactly one overlapping A-B pair, a link. A text's groups and links are those of its
pieces in a row. A block is stored as one row: its pieces' links, and each text as numbers of pieces.

Corpus counts of id pairs: a pair is one int64, `b << 32 | a`. Tasks reduce the links of their blocks with `np.unique` to partial
counts; these are sorted globally by range partitions, and each range sums runs of equal keys. Every range is a sorted count
shard (keys and counts) in the shared folder, which the last pass memory-maps and looks up by `searchsorted`. Its size follows
the number of different pairs, which the vocabularies bound. Where the shared folder isn't a mounted file system, which can't be
mapped, the counts are joined by key instead.

Defined results: texts that are null, empty, or not spelled back by both tokenizers (a normalized or unknown character) have no
tokens: zeros and an empty digest; rows that repeat, or share or lack a doc_id, are each encoded and counted; a text of any length
is encoded whole (a piece without a single space in it is encoded in one go, whatever its length); an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from itertools import chain, pairwise
from typing import NamedTuple
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch_path, shared_folder, ship_by_value

ship_by_value(__name__)

FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Fixed value: how byte-level BPE cuts texts before it merges bytes.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of the texts of a block, and of pieces that are encoded at a time; pieces of up to so many characters are remembered
#: between blocks, as many as that.
BLOCK, BATCH, SHORT, REMEMBERED = 1 << 20, 1 << 17, 40, 150_000
#: Pair keys that a task holds to reduce, and keys of a count shard.
MOST_KEYS, SHARD_KEYS = 1 << 20, 1 << 20
#: Bytes of a row group of stored blocks, which are of about two megabytes each.
GROUP_BYTES = 1 << 22
CUT = re.compile(r"(?<=\S) (?=\S)")
#: A block: of each text its numbers; the pieces of all texts in a row, of which `ends` tells whose they are; and of each piece its
#: links, of which `key_sizes` tells how many each has.
STORED = "doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, pieces binary, ends binary, keys binary, key_sizes binary"


def byte_letters() -> dict[str, int]:
    """The letters in which byte-level BPE writes bytes: printable Latin-1 as itself, the others from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Spelled(NamedTuple):
    """A piece by both tokenizers: how many tokens and groups, the groups as they are hashed, and the links."""

    n_a: int
    n_b: int
    n_groups: int
    groups: bytes
    keys: np.ndarray


class Pair:
    """Both tokenizers, with the bytes of their tokens."""

    def __init__(self, folder: str, a_file: str, b_file: str) -> None:
        import sentencepiece
        import tiktoken

        with open(f"{folder}/{a_file}", encoding="utf-8") as file:
            told = json.load(file)
        letter = byte_letters()
        special = {t["content"] for t in told["added_tokens"]}
        ranks = {bytes(letter[c] for c in t): i for t, i in told["model"]["vocab"].items() if t not in special}
        self.a = tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max([*ranks.values(), *(t["id"] for t in told["added_tokens"])]) + 1)
        for t, i in ranks.items():
            self.a_bytes[i] = t
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{b_file}")
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)  # no piece reaches across a space after a letter
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))

    def pieces(self, text: str) -> list[str]:
        """`text` cut at spaces between other characters; joined by a space they are the text."""
        return CUT.split(text) if self.cuts else [text]

    def spell(self, pieces: list[str]) -> list[Spelled | None]:
        """Each piece by both tokenizers; None if either doesn't give its bytes back. Pieces without white space at their ends are
        encoded in a row, as neither tokenizer has a token across the spaces between them; if the row isn't spelled back, and for
        the other pieces, each is encoded by itself."""
        out: list[Spelled | None] = [None] * len(pieces)
        plain = [i for i, p in enumerate(pieces) if p and not (p[0].isspace() or p[-1].isspace())] if self.cuts else []
        alone = range(len(pieces))
        if plain:
            some = [pieces[i] for i in plain]
            row = " ".join(some)
            found = self._spelled(self.a.encode_ordinary(" " + row), self.b.encode(row), [(" " + p).encode() for p in some])
            if found is not None:
                for i, s in zip(plain, found, strict=True):
                    out[i] = s
                alone = sorted(set(alone) - set(plain))
        for i in alone:
            found = self._spelled(self.a.encode_ordinary(" " + pieces[i]), self.b.encode(pieces[i]), [(" " + pieces[i]).encode()])
            out[i] = found[0] if found else None
        return out

    def _spelled(self, a: list[int], b: list[int], whole: list[bytes]) -> list[Spelled] | None:
        """The pieces `whole`, of which both tokens are given in a row; None if the tokens don't spell them, each from its start to
        its end."""
        row = b"".join(whole)
        if b"".join(map(self.a_bytes.__getitem__, a)) != row or b"".join(map(self.b_bytes.__getitem__, b)) != row:
            return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        a_ends, b_ends, ends, at_a, at_b = links(a, b, self.a_sizes, self.b_sizes)
        keys = (b[at_b] << 32) | a[at_a]
        common, groups = spelled_groups(a, b, a_ends, b_ends)
        last = np.cumsum([len(w) for w in whole])
        group_ends = np.searchsorted(common, last, "right")
        if (common[np.maximum(group_ends - 1, 0)] != last).any():
            return None
        link_ends, n_a, n_b = np.searchsorted(ends, last, "right"), np.searchsorted(a_ends, last, "right"), np.searchsorted(b_ends, last, "right")
        tokens, n_links = (n_a + n_b).tolist(), link_ends.tolist()
        sizes = zip(*(np.diff(x, prepend=0).tolist() for x in (n_a, n_b, group_ends)), [0, *n_links], n_links, [0, *tokens], tokens, strict=False)
        return [Spelled(x, y, g, "".join(groups[t:u])[:-1].encode(), keys[k:m]) for x, y, g, k, m, t, u in sizes]


def links(a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ends of A and of B tokens, all ends, and for the stretch before each the place of its A and its B token."""
    a_ends, b_ends = np.cumsum(a_sizes[a]), np.cumsum(b_sizes[b])
    ends = np.union1d(a_ends, b_ends)
    return a_ends, b_ends, ends, np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)


def spelled_groups(a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Where groups end, and the ids in the order of `a1,a2|b1;a3|b2,b3`, each with the sign behind it."""
    common = np.intersect1d(a_ends, b_ends, assume_unique=True)
    group = np.concatenate([2 * np.searchsorted(common, a_ends), 2 * np.searchsorted(common, b_ends) + 1])
    order = np.argsort(group, kind="stable")
    group, ids = group[order], np.concatenate([a, b])[order].tolist()
    last = np.append(group[1:] != group[:-1], True)
    after = np.where(last, np.where(group % 2, ";", "|"), ",").tolist()
    return common, [f"{i}{s}" for i, s in zip(ids, after, strict=True)]


def _tokenize(folder: str, a_file: str, b_file: str) -> object:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(folder, a_file, b_file)
        remembered: dict[str, Spelled | None] = {}
        missing, none = object(), np.array([], np.int64)
        kinds = [pa.list_(pa.int64())] * 5 + [pa.list_(pa.string())] + [pa.binary()] * 4

        def spelled(pieces: list[str]) -> list[Spelled | None]:
            """Different pieces; those that aren't remembered in batches."""
            out = [remembered.get(p, missing) for p in pieces]
            new = [i for i, s in enumerate(out) if s is missing]
            cuts = np.searchsorted(np.cumsum([len(pieces[i]) for i in new]), np.arange(0, sum(len(pieces[i]) for i in new) + BATCH, BATCH)).tolist() if new else [0]
            for x, y in pairwise([*cuts, len(new)]):
                for i, s in zip(new[x:y], pair.spell([pieces[i] for i in new[x:y]]), strict=True):
                    out[i] = s
                    if len(pieces[i]) <= SHORT:
                        remembered[pieces[i]] = s
            return out

        def block(ids: list, texts: list[str]) -> pa.RecordBatch:
            if len(remembered) > REMEMBERED:
                remembered.clear()
            cut = [pair.pieces(t) if t else [] for t in texts]
            flat = list(chain.from_iterable(cut))
            different = list(dict.fromkeys(flat))
            found = spelled(different)
            number = dict(zip(different, range(len(different)), strict=True))
            at = np.fromiter(map(number.__getitem__, flat), np.int32, len(flat))
            n = np.array([len(x) for x in cut])
            ends = np.cumsum(n)
            unknown = np.array([s is None for s in found], bool)
            good = (n > 0) & (_parts(unknown[at], ends) == 0)
            at, ends = at[np.repeat(good, n)], np.cumsum(n * good)
            of = [(0, 0, 0, b"", none) if s is None else s for s in found]
            sizes = [np.array([s[i] for s in of], np.int64) for i in range(3)] + [np.array([len(s[4]) for s in of], np.int64)]
            groups, places = [s[3] for s in of], at.tolist()
            said = [hashlib.sha256(b";".join(map(groups.__getitem__, places[x:y]))).hexdigest() if ok else "" for ok, x, y in zip(good.tolist(), [0, *ends.tolist()], ends.tolist(), strict=False)]
            told = [_parts(x[at], ends).tolist() for x in sizes]
            flat_keys = np.concatenate([s[4] for s in of]) if of else none
            columns = [ids, *told, said, at.tobytes(), ends.astype(np.int32).tobytes(), _packed(flat_keys), sizes[3].astype(np.int32).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in STORED.split(", ")])

        for batch in batches:
            ids, texts, size = [], [], 0
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids.append(doc)
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size >= BLOCK:
                    yield block(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield block(ids, texts)

    return rows


def _packed(keys: np.ndarray) -> bytes:
    """Keys in four bytes each if all ids fit into two, else in eight."""
    if len(keys) and ((keys >> 48).any() or (keys & 0xFFFF0000).any()):
        return keys.tobytes()
    return ((keys >> 16) | (keys & 0xFFFF)).astype(np.uint32).tobytes()


def _unpacked(data, n: int) -> np.ndarray:
    if len(data) == 8 * n and n:
        return np.frombuffer(data, np.int64)
    keys = np.frombuffer(data, np.uint32).astype(np.int64)
    return (keys >> 16 << 32) | (keys & 0xFFFF)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each block its row's columns by name, its pieces, their ends by text, the links' keys and their ends by piece."""
    for i in range(batch.num_rows):
        one = batch.slice(i, 1)
        of = lambda name, kind: np.frombuffer(one[name][0].as_buffer(), kind)  # noqa: B023, E731
        ends = np.cumsum(of("key_sizes", np.int32), dtype=np.int64)
        yield {c: one[c] for c in batch.schema.names}, of("pieces", np.int32), of("ends", np.int32), _unpacked(one["keys"][0].as_buffer(), int(ends[-1]) if len(ends) else 0), ends


def _parts(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the stretches of `values` that end at `ends`."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[ends], prepend=0).astype(np.int64)


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])

    held, sums = np.array([], np.int64), np.array([], np.int64)
    for batch in batches:
        for _, pieces, _, keys, ends in _blocks(batch):
            often = np.repeat(np.bincount(pieces, minlength=len(ends)), np.diff(ends, prepend=0))
            held, back = np.unique(np.concatenate([held, keys]), return_inverse=True)
            total = np.zeros(len(held), np.int64)
            np.add.at(total, back, np.concatenate([sums, often]))
            sums = total
            if len(held) > MOST_KEYS:
                yield out(held, sums)
                held, sums = held[:0], sums[:0]
    yield out(held, sums)


def sum_runs(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, each once, with the sum of its counts."""
    if not len(keys):
        return keys, n
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(n, starts)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Run-length sums of a sorted range; the last key of a batch waits, as the next may begin with it."""
    held, sums = np.array([], np.int64), np.array([], np.int64)
    for batch in batches:
        keys, n = sum_runs(np.concatenate([held, batch["key"].to_numpy()]), np.concatenate([sums, batch["n"].to_numpy()]))
        yield keys[:-1], n[:-1]
        held, sums = keys[-1:], n[-1:]
    yield held, sums


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, n in _summed(batches):
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])


def _write_shards(folder: str) -> object:
    """Write each range's keys and counts as arrays under `folder`: shard, low, size, and the highest count of each B id there."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [x for x in _summed(batches) if len(x[0])]
        if not parts:
            return
        keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        name = f"{TaskContext.get().partitionId()}-{uuid.uuid4().hex}"  # each attempt writes its own; the one that ends well is named
        os.makedirs(folder, exist_ok=True)
        np.save(f"{folder}/{name}.npy", np.stack([keys, n]))
        b = keys >> 32
        starts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        columns = [pa.array([name]), pa.array([int(keys[0])]), pa.array([len(keys)], pa.int64()), pa.array([b[starts].tolist()], pa.list_(pa.int64())), pa.array([np.maximum.reduceat(n, starts).tolist()], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["shard", "low", "size", "b", "best"])

    return write


class Shards:
    """Memory-mapped count shards in key order."""

    def __init__(self, folder: str, names: list[str], low: np.ndarray) -> None:
        self.low = low
        self.maps = [np.load(f"{folder}/{name}.npy", mmap_mode="r") for name in names]

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of keys that all are in the shards."""
        unique, back = np.unique(keys, return_inverse=True)
        out = np.zeros(len(unique), np.int64)
        cuts = np.append(np.searchsorted(unique, self.low), len(unique))
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if a < b:
                out[a:b] = self.maps[i][1][np.searchsorted(self.maps[i][0], unique[a:b])]
        return out[back]


RESULT = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _look_up(shards, folder: str) -> object:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, low, best = shards.value
        mapped = Shards(folder, names, low)
        for batch in batches:
            for row, pieces, ends, keys, key_ends in _blocks(batch):
                counts = mapped.counts(keys)
                own = {c: pa.array(_parts(_parts(x, key_ends)[pieces], ends)) for c, x in (("n_best", counts == best[keys >> 32]), ("count_sum", counts))}
                yield pa.RecordBatch.from_arrays([own[c] if c in own else row[c].flatten() for c in RESULT], list(RESULT))

    return rows


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, key, links: of each text of a block (row: the block's number and the text's place in it) its different pairs."""
    for batch in batches:
        for row, pieces, ends, keys, key_ends in _blocks(batch):
            first = np.concatenate([[0], key_ends])
            for i, (a, b) in enumerate(zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)):
                used, often = np.unique(pieces[a:b], return_counts=True)
                size = first[used + 1] - first[used]
                place = np.repeat(first[used], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                unique, back = np.unique(keys[place], return_inverse=True)
                n = np.zeros(len(unique), np.int64)
                np.add.at(n, back, np.repeat(often, size))
                yield pa.RecordBatch.from_arrays([pa.array([row["block"][0].as_py()] * len(unique), pa.int64()), pa.array(np.full(len(unique), i)), pa.array(unique), pa.array(n)], ["block", "place", "key", "links"])


def _joined(stored: DataFrame, ranges: DataFrame) -> DataFrame:
    """The same result with counts joined by key, where shards can't be mapped."""
    counts = materialize(ranges.mapInArrow(_count_rows, "key long, n long"), "alignment-counts")
    best = counts.groupBy(F.shiftright("key", 32).alias("b")).agg(F.max("n").alias("best"))
    numbered = materialize(stored.withColumn("block", F.monotonically_increasing_id()), "alignment-blocks", GROUP_BYTES)
    pairs = numbered.select("block", "pieces", "ends", "keys", "key_sizes").mapInArrow(_pairs, "block long, place long, key long, links long")
    found = pairs.join(counts.withColumn("b", F.shiftright("key", 32)).join(best, "b"), "key").groupBy("block", "place").agg(F.sum(F.when(F.col("n") == F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("links")).alias("count_sum"))
    texts = numbered.select("block", F.posexplode(F.arrays_zip(*[c for c in RESULT if c not in ("n_best", "count_sum")])).alias("place", "x")).select("block", F.col("place").cast("long").alias("place"), "x.*")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return texts.join(found, ["block", "place"], "left").select(*[zero(c) if c in ("n_best", "count_sum") else c for c in RESULT])


def mapped_folder(spark: SparkSession) -> str | None:
    """A fresh folder for shards by its path, if the shared folder is a mounted file system."""
    where = urlparse(shared_folder(spark))
    return urlparse(scratch_path(spark, "alignment-shards")).path if where.scheme in ("", "file") else None


def align(docs: DataFrame, folder: str = FOLDER, a_file: str = A_FILE, b_file: str = B_FILE, mapped: bool = True) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document (doc_id, text)."""
    spark = docs.sparkSession
    pair = Pair(folder, a_file, b_file)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    stored = materialize(source.mapInArrow(_tokenize(folder, a_file, b_file), STORED), "alignment-tokens", GROUP_BYTES)
    partial = materialize(stored.select("pieces", "ends", "keys", "key_sizes").mapInArrow(_partial_counts, "key long, n long"), "alignment-partial")
    ranges = partial.repartitionByRange(max(1, partial.count() // SHARD_KEYS + 1), "key").sortWithinPartitions("key")
    place = mapped_folder(spark) if mapped else None
    if place is None:
        return _joined(stored, ranges)
    shards = materialize(ranges.mapInArrow(_write_shards(place), "shard string, low long, size long, b array<long>, best array<long>"), "alignment-shards")
    listed = shards.select("shard", "low").orderBy("low").collect()  # one for each SHARD_KEYS partial counts
    best = np.zeros(len(pair.b_bytes), np.int64)
    tops = shards.select(F.explode(F.arrays_zip("b", "best")).alias("x")).groupBy("x.b").agg(F.max("x.best").alias("best"))
    for b, n in tops.collect():  # of B's vocabulary
        best[b] = n
    sent = spark.sparkContext.broadcast(([r["shard"] for r in listed], np.array([r["low"] for r in listed], np.int64), best))
    return stored.mapInArrow(_look_up(sent, place), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
