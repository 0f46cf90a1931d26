"""Removal of repeated byte strings with suffix arrays that are built in shards.

Every string of `length` bytes belongs to the hash of its rarest-looking piece (the least of its hashes of `PIECE` bytes), so
equal strings belong together, wherever they are. Neighbouring strings with one such hash make a stretch of a text; stretches,
not strings, are what is shuffled, and first without their bytes:

1. Stretches (hash, digest of their bytes, place) are dealt by hash. Of stretches with equal bytes, all but the first are
   removed as they are; a stretch alone with its hash holds no repeat. Tasks do the former among their own rows before the
   shuffle, so exact copies collapse there.
2. The others' bytes are fetched from the texts and dealt to shards by hash. A shard is a suffix array by induced sorting
   (`suffixes`): neighbours in it with a common prefix of `length` or more are equal strings, of which the first stays.
3. A hash with very many different stretches (the edge of a passage that many documents share) is split exactly: strings in
   which the piece has nearly the same offset share more bytes, and are dealt by these; what is still too large is split
   again, down to single strings.

"First" is by (doc_id, nulls last; then a hash of the text, for rows that share or lack a doc_id; start). Judged on the input.

Defined results: null and empty texts, and those shorter than `length`, keep all; rows alike in doc_id and text count as one
document, so none of them removes another; rows that share or lack a doc_id but differ in text are different documents; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from . import suffixes
from .common import broadcast_if, materialize, ship_by_value, shuffle_partitions

ship_by_value(__name__)

LENGTH, PIECE = 100, 40
#: Bytes of texts whose stretches are found at a time, strings of a stretch, stretches a task reduces at a time.
CHUNK, MOST_STRINGS, MOST_STRETCHES = 1 << 22, 1 << 10, 1 << 20
#: Bytes of a suffix array, and stretches of a hash up to which they go into one.
SHARD_BYTES, HOT_STRETCHES = 1 << 20, 1 << 12
#: Stretches of a hash from which they are dealt by their digest, too, and the share of the documents that tells.
HOT_ROWS, SAMPLE, MOST_HOT = 1 << 17, 0.01, 4096
#: Offsets of the piece that go together when a hot hash is split, ever finer.
SPLITS = (16, 4, 1)
#: Entries of lists, of 40 bytes each, that are sent to all tasks.
MOST_BROADCAST = 2_000_000
PLACE = "h long, sh long, doc_id long, th long, start int, n int, again boolean"
_C = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Scrambles numbers in place."""
    for shift, factor in ((31, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64))


def piece_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` bytes from each place on, by doubling."""
    h, power, have = _BYTES[data], _C, 1
    out, out_size = None, 0
    while True:
        if size & have:  # append the pieces of `have` bytes to those that are there
            if out is None:
                out, out_size = h, have
            else:
                m = len(data) - out_size - have + 1
                out = out[:m] * power
                out += h[out_size : out_size + m]
                out_size += have
        if have * 2 > size:
            return _mixed(out[: len(data) - size + 1].copy() if out is h else out[: len(data) - size + 1])
        longer = h[: len(h) - have] * power
        longer += h[have:]
        h, power, have = longer, power * power, have * 2


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of `width` neighbours from each place on."""
    have = 1
    while have * 2 <= width:
        x, have = np.minimum(x[:-have], x[have:]), have * 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, length: int, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each string of `length` bytes: the hash of its least piece, and where that is first and last."""
    h = piece_hashes(data, piece)
    low = np.uint64((1 << 31) - 1)
    place = np.arange(len(h), dtype=np.uint64)
    width = length - piece + 1
    top = h & ~low
    first = (_least(top | place, width) & low).view(np.int64)
    top |= low - place
    last = (low - (_least(top, width) & low)).view(np.int64)
    return h[first], first, last


def stretches(data: np.ndarray, ends: np.ndarray, length: int, piece: int) -> tuple[np.ndarray, ...]:
    """(hash, start, strings, whether the piece occurs again) of each stretch of the texts that end at `ends` in `data`."""
    if len(data) < length:
        return (np.array([], np.uint64), *(np.array([], np.int64),) * 2, np.array([], bool))
    h, first, last = anchors(data, length, piece)
    text = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(ends, prepend=0))
    fits = text[: len(h)] == text[length - 1 :]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | ~fits[:-1]])
    starts = np.flatnonzero(new & fits)
    stop = np.flatnonzero(np.concatenate([new[1:] | ~fits[1:], [True]]) & fits) + 1
    n = stop - starts
    again = first[starts] != last[stop - 1]
    cuts = (n + MOST_STRINGS - 1) // MOST_STRINGS
    inner = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    at = np.repeat(starts, cuts) + inner * MOST_STRINGS
    return h[at], at, np.minimum(np.repeat(stop, cuts) - at, MOST_STRINGS), np.repeat(again, cuts)


def digest(data: bytes) -> int:
    """64 bits; with the hash of the least piece, of another kind, 128 tell stretches apart."""
    x = xxh3_64_intdigest(data)
    return x - (1 << 64) if x >> 63 else x


def _doc_ranks(ids: list, ths: list) -> np.ndarray:
    """Equal numbers for equal documents, in order."""
    keys = list(zip([i is None for i in ids], [i or 0 for i in ids], ths, strict=True))
    rank = {k: i for i, k in enumerate(sorted(set(keys)))}
    return np.array([rank[k] for k in keys], np.int64)


def _places(h, sh, ids, ths, start, n, again, settled) -> pa.RecordBatch:
    kinds = (pa.int64(),) * 4 + (pa.int32(),) * 2 + (pa.bool_(),) * 2
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip((h, sh, ids, ths, start, n, again, settled), kinds, strict=True)], [*(f.split()[0] for f in PLACE.split(", ")), "settled"])


def _find_stretches(length: int, piece: int) -> object:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        docs: list[tuple] = []

        def reduced() -> pa.RecordBatch:
            """The first of equal stretches; those behind it are settled."""
            h, sh, doc, start, n, again = (np.concatenate(x) for x in zip(*held, strict=True))
            rank = _doc_ranks(*zip(*docs, strict=True))[doc]
            order = np.lexsort((start, rank, sh, h))
            h, sh, doc, start, n, again, rank = (x[order] for x in (h, sh, doc, start, n, again, rank))
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (sh[1:] != sh[:-1])])
            lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            keep = np.flatnonzero(new | (rank != rank[lead]) | (start != start[lead]))  # else the first itself, in a row alike
            scattered = _mixed((doc * 1_000_003 + start).astype(np.uint64)).view(np.int64)
            h = np.where(new, h.view(np.int64), scattered)[keep]
            of = pa.array(doc[keep])
            ids, ths = (pa.array(x, pa.int64()).take(of) for x in zip(*docs, strict=True))
            held.clear()
            out = _places(h, sh[keep], ids, ths, start[keep], n[keep], again[keep], ~new[keep])
            docs.clear()
            return out

        for batch in batches:
            ids, ths, texts = batch["doc_id"].to_pylist(), batch["th"].to_pylist(), batch["text"]
            at = 0
            while at < len(ids):
                some, size, first = [], 0, at
                while at < len(ids) and size < CHUNK:
                    some.append((texts[at].as_py() or "").encode())
                    size += len(some[-1])
                    at += 1
                whole = b"".join(some)
                ends = np.cumsum([len(x) for x in some])
                h, starts, n, again = stretches(np.frombuffer(whole, np.uint8), ends, length, piece)
                doc = np.searchsorted(ends, starts, "right")
                sh = np.array([xxh3_64_intdigest(whole[a:b]) for a, b in zip(starts.tolist(), (starts + n + length - 1).tolist(), strict=True)], np.uint64).view(np.int64)
                held.append((h, sh, doc + len(docs), starts - np.concatenate([[0], ends])[doc], n, again))
                docs += zip(ids[first:at], ths[first:at], strict=True)
                if sum(len(x[0]) for x in held) > MOST_STRETCHES:
                    yield reduced()
        if held:
            yield reduced()

    return rows


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h, sh, place): of equal (h, sh) the first is to be compared if its hash has others, too (compare = true);
    the rest are removed as they are (compare = false)."""
    waiting: pa.RecordBatch | None = None  # the last first one; whether it is alone with its hash isn't known yet
    opens, last, lead = True, None, None
    for batch in batches:
        gone = batch["settled"].to_numpy(zero_copy_only=False)
        if gone.any():
            yield _with(batch.filter(pa.array(gone)), False)
            batch = batch.filter(pa.array(~gone))
        if not batch.num_rows:
            continue
        h, sh = batch["h"].to_numpy(), batch["sh"].to_numpy()
        place = [batch["doc_id"].is_null().to_numpy(zero_copy_only=False), batch["doc_id"].fill_null(0).to_numpy(), batch["th"].to_numpy(), batch["start"].to_numpy()]
        new_h, new_s = np.ones(len(h), bool), np.ones(len(h), bool)
        new_h[1:] = h[1:] != h[:-1]
        new_s[1:] = new_h[1:] | (sh[1:] != sh[:-1])
        if last is not None:
            new_h[0] = h[0] != last[0]
            new_s[0] = new_h[0] or sh[0] != last[1]
        last = int(h[-1]), int(sh[-1])
        firsts = np.flatnonzero(new_s)
        rest = np.flatnonzero(~new_s)
        if len(rest):  # but for rows alike in id and text, which are where the first is
            of = np.searchsorted(firsts, rest) - 1
            led = of >= 0
            here = firsts[of[led]]
            other = np.ones(len(rest), bool)
            other[led] = np.any([x[rest[led]] != x[here] for x in place], axis=0)
            if not led.all():
                other[~led] = np.any([x[rest[~led]] != y for x, y in zip(place, lead, strict=True)], axis=0)
            rest = rest[other]
        if len(rest):
            yield _with(batch.take(pa.array(rest)), False)
        if not len(firsts):
            continue
        lead = [x[firsts[-1]] for x in place]
        some = batch.take(pa.array(firsts))
        starts_hash = new_h[firsts].tolist()
        if waiting is not None:
            some, starts_hash = pa.concat_batches([waiting, some]), [opens, *starts_hash]
        sure = np.logical_or(some["again"].to_numpy(zero_copy_only=False), some["hot"].to_numpy(zero_copy_only=False))
        a = np.array(starts_hash)
        chosen = np.flatnonzero(sure[:-1] | ~a[:-1] | ~a[1:])
        if len(chosen):
            yield _with(some.take(pa.array(chosen)), True)
        waiting, opens = some.slice(some.num_rows - 1), starts_hash[-1]
    if waiting is not None and (not opens or waiting["again"][0].as_py() or waiting["hot"][0].as_py()):
        yield _with(waiting, True)


def _with(batch: pa.RecordBatch, compare: bool) -> pa.RecordBatch:
    columns = [c for c in batch.schema.names if c not in ("sh", "again", "settled", "hot")]
    return pa.RecordBatch.from_arrays([batch[c] for c in columns] + [pa.array([compare] * batch.num_rows)], [*columns, "compare"])


def settle(found: DataFrame, hot: list[int], name: str) -> DataFrame:
    """`found` (PLACE, settled, perhaps bytes) as stored rows h, doc_id, th, start, n, (bytes,) compare; others hold no repeat."""
    is_hot = F.col("h").isin(hot) if hot else F.lit(False)
    dealt = F.when(is_hot, F.xxhash64("h", F.pmod("sh", F.lit(64)))).otherwise(F.xxhash64("h"))
    sent = found.withColumn("hot", is_hot).repartition(shuffle_partitions(found.sparkSession), dealt)
    sent = sent.sortWithinPartitions("h", "sh", F.col("doc_id").asc_nulls_last(), "th", "start")
    more = "bytes binary, " if "bytes" in found.columns else ""
    return materialize(sent.mapInArrow(_settle, f"h long, doc_id long, th long, start int, n int, {more}compare boolean"), name)


def _fetch(length: int) -> object:
    """The bytes of the stretches that each text is asked for."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, asked in enumerate(batch["asked"].to_pylist()):
                text = batch["text"][i].as_py().encode()
                cut = [text[a["start"] : a["start"] + a["n"] + length - 1] for a in asked]
                one = [pa.array([a[c] for a in asked], k) for c, k in (("h", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("hot", pa.bool_()))]
                ids = [pa.array([batch[c][i].as_py()] * len(asked), pa.int64()) for c in ("doc_id", "th")]
                yield pa.RecordBatch.from_arrays([one[0], *ids, one[1], one[2], one[3], pa.array(cut, pa.binary())], ["h", "doc_id", "th", "start", "n", "hot", "bytes"])

    return rows


def _split(length: int, piece: int, offsets: int) -> object:
    """Parts of stretches: neighbouring strings in which the piece's offset is of one class, dealt by the bytes all of them share."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for h, doc, th, start, data in zip(*(batch[c].to_pylist() for c in ("h", "doc_id", "th", "start", "bytes")), strict=True):
                _, first, _ = anchors(np.frombuffer(data, np.uint8), length, piece)
                kind = (first - np.arange(len(first))) // offsets
                cuts = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (first[1:] != first[:-1]), [True]])).tolist()
                for a, b in pairwise(cuts):
                    at, low = int(first[a]), int(kind[a]) * offsets
                    core = data[at - low : at - low + length - offsets + 1] if offsets > 1 else data[a : a + length]
                    key = digest(f"{h} {kind[a]} ".encode() + core)
                    part = data[a : b + length - 1]
                    out.append((key, digest(part), doc, th, start + a, b - a, False, False, part))
            names = [f.split()[0] for f in PLACE.split(", ")] + ["settled", "bytes"]
            kinds = (pa.int64(),) * 4 + (pa.int32(),) * 2 + (pa.bool_(),) * 2 + (pa.binary(),)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 9, kinds, strict=True)], names)

    return rows


def _shards(length: int) -> object:
    """Rows sorted by hash, as suffix arrays of whole hashes of about SHARD_BYTES; the repeats in them as runs of bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def runs() -> pa.RecordBatch:
            held.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
            found = suffixes.repeats([r[3] for r in held], length)
            out = [(held[i][0], held[i][1], held[i][2] + a, held[i][2] + b) for i, a, b in found]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 4, kinds, strict=True)], ["doc_id", "th", "low", "high"])

        for batch in batches:
            for h, *row in zip(*(batch[c].to_pylist() for c in ("h", "doc_id", "th", "start", "bytes")), strict=True):
                if h != last and size >= SHARD_BYTES:
                    yield runs()
                    held, size = [], 0
                last = h
                held.append(tuple(row))
                size += len(row[-1])
        if held:
            yield runs()

    return rows


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of each document, joined where they overlap or touch."""
    for batch in batches:
        out = []
        for runs in batch["runs"].to_pylist():
            joined: list[list[int]] = []
            for low, high in sorted((r["low"], r["high"]) for r in runs):
                if joined and low <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], high)
                else:
                    joined.append([low, high])
            out.append([{"low": a, "high": b} for a, b in joined])
        shape = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["th"], pa.array(out, shape)], ["doc_id", "th", "runs"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text without its runs."""
    for batch in batches:
        out = []
        for doc, text, runs in zip(batch["doc_id"].to_pylist(), batch["text"], batch["runs"].to_pylist(), strict=True):
            data, at, left = (text.as_py() or "").encode(), 0, []
            for r in runs or ():
                left.append(data[at : r["low"]])
                at = r["high"]
            left.append(data[at:])
            kept = b"".join(left)
            out.append((doc, len(data), len(data) - len(kept), len(runs or ()), hashlib.sha256(kept).hexdigest()))
        kinds = (pa.int64(),) * 4 + (pa.string(),)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _numbered(docs: DataFrame) -> DataFrame:
    """doc_id, th, text: th tells rows apart that share or lack a doc_id, and is 0 elsewhere."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = materialize(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1 or doc_id is null").select("doc_id"), "suffix-shared")
    n = shared.count()
    if not n:
        return rows.select("doc_id", F.lit(0).cast("long").alias("th"), "text")
    known = broadcast_if(shared.select(F.col("doc_id").alias("id"), F.lit(True).alias("common")), n, MOST_BROADCAST)
    return rows.join(known, F.col("doc_id").eqNullSafe(F.col("id")), "left").select("doc_id", F.when(F.col("common"), F.xxhash64("text")).otherwise(0).cast("long").alias("th"), "text")


def _to_texts(texts: DataFrame, given: DataFrame, most: int, how: str) -> DataFrame:
    """`texts` with what is given by (doc_id, th): sent to them if it is small, else both are shuffled."""
    key: Column = F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("th") == F.col("g_th"))
    given = given.withColumnsRenamed({"doc_id": "g_id", "th": "g_th"})
    return texts.join(F.broadcast(given) if most <= MOST_BROADCAST else given, key, how).drop("g_id", "g_th")


def repeated_runs(texts: DataFrame, length: int = LENGTH, piece: int = PIECE) -> DataFrame:
    """doc_id, th, low, high: stretches of bytes of `texts` (doc_id, th, text) that strings of `length` bytes cover that also
    start earlier. They may overlap."""
    find = _find_stretches(length, piece)
    kinds = f"{PLACE}, settled boolean"
    some = texts.sample(SAMPLE, seed=1).mapInArrow(find, kinds).where("not settled").groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    hot = [r["h"] for r in some.where(F.col("c") >= HOT_ROWS * SAMPLE).orderBy(F.desc("c")).limit(MOST_HOT).collect()]  # only how they are dealt
    settled = settle(texts.mapInArrow(find, kinds), hot, "suffix-stretches")
    asked = settled.where("compare")
    crowded = materialize(asked.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > HOT_STRETCHES).select("h", F.lit(True).alias("hot")), "suffix-hot")
    asked = asked.join(broadcast_if(crowded, crowded.count(), MOST_BROADCAST), "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    n_asked = settled.where("compare").count()
    by_text = asked.groupBy("doc_id", "th").agg(F.collect_list(F.struct("h", "start", "n", "hot")).alias("asked"))
    shape = "h long, doc_id long, th long, start int, n int, hot boolean, bytes binary"
    fetched = materialize(_to_texts(texts, by_text, n_asked, "inner").mapInArrow(_fetch(length), shape), "suffix-bytes")
    whole = ("doc_id", "th", "start", (F.col("start") + F.col("n") + length - 1).cast("int"))
    gone = [settled.where("not compare").select(*whole).toDF("doc_id", "th", "low", "high")]
    ready, rest = [fetched.where("not hot")], fetched.where("hot")
    for offsets in SPLITS:
        if rest.isEmpty():
            break
        parts = settle(rest.mapInArrow(_split(length, piece, offsets), f"{kinds}, bytes binary"), [], f"suffix-parts-{offsets}")
        gone.append(parts.where("not compare").select(*whole).toDF("doc_id", "th", "low", "high"))
        parts = parts.where("compare")
        crowded = materialize(parts.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > HOT_STRETCHES).select("h", F.lit(True).alias("hot")), "suffix-hot")
        parts = parts.join(broadcast_if(crowded, crowded.count(), MOST_BROADCAST), "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
        ready.append(parts.where("not hot"))
        rest = parts.where("hot")
    shards = ready[0].select("h", "doc_id", "th", "start", "bytes")
    for part in ready[1:]:
        shards = shards.unionByName(part.select("h", "doc_id", "th", "start", "bytes"))
    shards = shards.repartition(shuffle_partitions(texts.sparkSession), "h").sortWithinPartitions("h")
    runs = shards.mapInArrow(_shards(length), "doc_id long, th long, low int, high int")
    for part in gone:
        runs = runs.unionByName(part)
    return runs


def dedup(docs: DataFrame, length: int = LENGTH, piece: int = PIECE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document (doc_id, text)."""
    texts = _numbered(docs)
    by_text = repeated_runs(texts, length, piece).groupBy("doc_id", "th").agg(F.collect_list(F.struct("low", "high")).alias("runs"))
    by_text = materialize(by_text.mapInArrow(_merged, "doc_id long, th long, runs array<struct<low: int, high: int>>"), "suffix-merged")
    size = by_text.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.size("runs")), F.lit(0))).first()[0]
    joined = _to_texts(texts, by_text, size, "left")
    return joined.select("doc_id", "text", "runs").mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
