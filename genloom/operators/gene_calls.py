"""Genes of bare DNA: open frames scored by their hexamers, and the best set of genes that hardly overlap.

1. `hexamer_scores`: how often each pair of codons stands in the frame of long open frames, against anywhere on both strands, as
   log-odds in hundredths of bits. Tasks count in Arrow batches, Spark adds the counts up.
2. `candidates`: of each stop, the starts that no nearer start beats, with the sum of their frame's scores.
3. `call_genes`: the set of candidates with the largest sum of scores among those that overlap by `overlap` bases at most. A place
   that no candidate covers is sure: no choice on one side matters to the other. So candidates are cut there into pieces (running
   maxima, by ordered pieces of a scaffold), and a dynamic program over starts and stops runs piece by piece, many in a pass.
"""

from __future__ import annotations

import sys
from bisect import bisect_right
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence
from .scan import scan
from .scratch import store
from .sequential import whole_groups

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Codons of an open frame from which it counts as coding for the statistics, and the least of a gene.
LONG, LEAST = 60, 30
OVERLAP = 30
#: What a start adds to a gene's score, in hundredths of bits.
START_SCORE = {"ATG": 150, "GTG": 0, "TTG": -50}
HEXAMERS = 4096


def _number(codon: str) -> int:
    return 16 * sequence.ORDER.index(codon[0]) + 4 * sequence.ORDER.index(codon[1]) + sequence.ORDER.index(codon[2])


STOPS = np.array([sequence.AMINO[i] == "*" for i in range(64)] + [False])
STARTS = {_number(c): s for c, s in START_SCORE.items()}


def frames(seq: str) -> Iterator[tuple[str, int, np.ndarray]]:
    """(strand, frame, codon numbers; 64 for one with another letter) of the six frames."""
    codes = sequence._codes(seq)
    mirror = np.where(codes > 3, 4, np.array([2, 3, 0, 1, 4])[codes])[::-1]
    for strand, c in (("+", codes), ("-", mirror)):
        if len(c) < 3:
            continue
        bad = (c[:-2] > 3) | (c[1:-1] > 3) | (c[2:] > 3)
        codon = np.where(bad, 64, c[:-2] * 16 + c[1:-1] * 4 + c[2:])
        for frame in range(3):
            yield strand, frame, codon[frame::3]


def open_frames(codon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in codons) of starts that a stop follows before a codon with another letter, and of that stop."""
    ends = np.where(STOPS[codon] | (codon == 64), np.arange(len(codon)), len(codon))
    following = np.minimum.accumulate(ends[::-1])[::-1]
    at = np.flatnonzero(np.isin(codon, list(STARTS)))
    stop = following[at]
    at, stop = at[stop < len(codon)], stop[stop < len(codon)]
    closed = STOPS[codon[stop]]
    return at[closed], stop[closed]


def hexamers(codon: np.ndarray) -> np.ndarray:
    """The number of each pair of neighbouring codons; HEXAMERS if a letter is another one."""
    return np.where((codon[:-1] > 63) | (codon[1:] > 63), HEXAMERS, codon[:-1] * 64 + codon[1:])


def hexamer_scores(scaffolds: DataFrame, seq: str = "seq") -> DataFrame:
    """hexamer, coding, background, score (hundredths of bits). Coding: within the longest open frame of each stop that has LONG
    codons or more; background: everywhere, in all six frames."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coding, background = np.zeros(HEXAMERS + 1, np.int64), np.zeros(HEXAMERS + 1, np.int64)
        for batch in batches:
            for x in batch[0].to_pylist():
                for _, _, codon in frames((x or "").upper()):
                    if len(codon) < 2:
                        continue
                    hexed = hexamers(codon)
                    background += np.bincount(hexed, minlength=HEXAMERS + 1)
                    at, stop = open_frames(codon)
                    first = np.flatnonzero(np.concatenate([[True], stop[1:] != stop[:-1]])) if len(at) else at
                    for a, b in zip(at[first].tolist(), stop[first].tolist(), strict=True):
                        if b - a >= LONG:
                            coding += np.bincount(hexed[a : b - 1], minlength=HEXAMERS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(HEXAMERS, dtype=np.int32)), pa.array(coding[:-1]), pa.array(background[:-1])], ["n", "coding", "background"])

    counts = scaffolds.select(seq).mapInArrow(count, "n int, coding long, background long").groupBy("n").agg(F.sum("coding").alias("coding"), F.sum("background").alias("background"))
    totals = counts.agg(F.sum("coding").alias("c"), F.sum("background").alias("b"))  # of 4096 rows
    odds = ((F.col("coding") + 1) / (F.col("c") + HEXAMERS)) / ((F.col("background") + 1) / (F.col("b") + HEXAMERS))
    letter = lambda shift: F.substring(F.lit(sequence.ORDER), F.shiftright("n", shift).bitwiseAND(3) + 1, F.lit(1))
    return counts.join(F.broadcast(totals)).select(F.concat(*[letter(s) for s in (10, 8, 6, 4, 2, 0)]).alias("hexamer"), "n", "coding", "background", F.round(100 * F.log2(odds)).cast("int").alias("score"))


def genes_of(seq: str, scores: np.ndarray, least: int = LEAST) -> list[tuple[int, int, str, int]]:
    """(start, end, strand, score) of the candidates of a sequence."""
    out = []
    for strand, frame, codon in frames(seq):
        if len(codon) < 2:
            continue
        sums = np.concatenate([[0], np.cumsum(scores[hexamers(codon)])])
        at, stop = open_frames(codon)
        fits = stop - at >= least
        at, stop = at[fits], stop[fits]
        total = sums[stop - 1] - sums[at] + np.array([STARTS[c] for c in codon[at].tolist()], np.int64)
        best, last = 0, None
        for a, b, score in zip(at[::-1].tolist(), stop[::-1].tolist(), total[::-1].tolist(), strict=True):
            best, last = (0, b) if b != last else (best, last)
            if score > best:
                best = score
                low, high = 3 * a + frame, 3 * b + frame + 3
                out.append((low, high, strand, score) if strand == "+" else (len(seq) - high, len(seq) - low, strand, score))
    return out


def candidates(scaffolds: DataFrame, scores: DataFrame, keys: list[str], seq: str = "seq", least: int = LEAST) -> DataFrame:
    """keys, start, end, strand, score. scores: n, score of all hexamers (4096 rows)."""
    table = np.zeros(HEXAMERS + 1, np.int64)
    for r in scores.select("n", "score").collect():
        table[r["n"]] = r["score"]
    kinds = {f.name: f.dataType.simpleString() for f in scaffolds.schema}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in enumerate(batch[len(keys)].to_pylist()):
                found = genes_of((x or "").upper(), table, least)
                cols = list(zip(*found, strict=True)) or [[]] * 4
                at = pa.array([i] * len(found), pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch[j].take(at) for j in range(len(keys))), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())], [*keys, "start", "end", "strand", "score"])

    return scaffolds.select(*keys, seq).mapInArrow(find, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", start int, end int, strand string, score long")


def best_set(spans: list[tuple[int, int]], scores: list[int], overlap: int = OVERLAP) -> list[int]:
    """Places of the spans, given in the order of their ends, that together score most while neighbours overlap by `overlap` at most."""
    ends = [e for _, e in spans]
    best, taken = [0], []
    for i, ((start, _), score) in enumerate(zip(spans, scores, strict=True)):
        before = bisect_right(ends, start + overlap, 0, i)
        taken.append(before if score + best[before] > best[i] else -1)
        best.append(max(best[i], score + best[before]))
    out, i = [], len(spans)
    while i > 0:
        if taken[i - 1] >= 0:
            out.append(i - 1)
            i = taken[i - 1]
        else:
            i -= 1
    return out[::-1]


def call_genes(scaffolds: DataFrame, keys: list[str], seq: str = "seq", scores: DataFrame | None = None, least: int = LEAST, overlap: int = OVERLAP) -> DataFrame:
    """keys, start, end (0-based, half open), strand, score of the genes of each scaffold. The shortest gene must be longer than
    `overlap`, so that only neighbours can overlap by more."""
    if 3 * least + 3 <= overlap:
        raise ValueError("genes must be longer than the overlap that is allowed")
    scores = store(hexamer_scores(scaffolds, seq)) if scores is None else scores
    found = store(candidates(scaffolds, scores, keys, seq, least))
    order = ["start", "end", "strand"]
    upto = scan(found, keys, order, tops={"_upto": F.col("end")})
    upto = upto.withColumn("_new", F.when(F.col("start") + overlap < F.col("_upto"), 0).otherwise(1)).drop("_upto")
    pieces = scan(upto, keys, order, sums={"_piece": F.col("_new")}).drop("_new").withColumn("_id", F.xxhash64(*keys, "_piece"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "_id"):
            ids, spans, score = table["_id"].to_numpy(), list(zip(table["start"].to_pylist(), table["end"].to_pylist(), strict=True)), table["score"].to_pylist()
            cuts = [*np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])).tolist(), len(ids)]
            keep = [a + i for a, b in pairwise(cuts) for i in best_set(spans[a:b], score[a:b], overlap)]
            yield from table.take(pa.array(keep, pa.int64())).to_batches()

    kept = pieces.repartition("_id").sortWithinPartitions("_id", *keys, "_piece", "end", "start", "strand").mapInArrow(pick, pieces.schema)
    return kept.select(*keys, "start", "end", "strand", "score")
