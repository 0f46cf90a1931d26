"""Gene calls against plain versions: candidates by loops, sets by trying all, pieces against one pass."""

import random
from itertools import combinations

import numpy as np
import pytest

from genloom.functions import sequence
from genloom.operators import gene_calls, scan

PAIRS = str.maketrans("ACGT", "TGCA")


def plain_candidates(seq, scores, least):
    out = set()
    for strand, s in (("+", seq), ("-", seq.translate(PAIRS)[::-1])):
        by_stop = {}
        for a in range(len(s) - 2):
            if s[a : a + 3] not in gene_calls.START_SCORE:
                continue
            codons, stop = [], None
            for i in range(a, len(s) - 2, 3):
                codon = s[i : i + 3]
                if not set(codon) <= set("ACGT"):
                    break
                if codon in ("TAA", "TAG", "TGA"):
                    stop = i
                    break
                codons.append(codon)
            if stop is None or len(codons) < least:
                continue
            total = gene_calls.START_SCORE[codons[0]] + sum(int(scores[gene_calls._number(x) * 64 + gene_calls._number(y)]) for x, y in zip(codons, codons[1:], strict=False))
            by_stop.setdefault(stop, []).append((a, total))
        for stop, starts in by_stop.items():
            best = 0
            for a, total in sorted(starts, reverse=True):
                if total > best:
                    best = total
                    low, high = a, stop + 3
                    out.add((low, high, strand, total) if strand == "+" else (len(s) - high, len(s) - low, strand, total))
    return out


def dna(rng, n, extra=""):
    return "".join(rng.choices("ACGT" + extra, weights=[3, 3, 3, 3] + [0.05] * len(extra), k=n))


def test_candidates_equal_loops():
    rng = random.Random(1)
    scores = np.append(np.random.default_rng(2).integers(-100, 120, gene_calls.HEXAMERS), 0)
    for n in (0, 2, 5, 300, 2000):
        seq = dna(rng, n, "N")
        found = gene_calls.genes_of(seq, scores, 5)
        assert set(found) == plain_candidates(seq, scores, 5) and len(found) == len(set(found))
    assert len(found) > 20


def test_best_set_equals_trying_all():
    rng = random.Random(3)
    for _ in range(60):
        spans = sorted(((a := rng.randrange(60), a + rng.randint(12, 30)) for _ in range(rng.randint(1, 9))), key=lambda x: (x[1], x[0]))
        scores = [rng.randint(1, 40) for _ in spans]
        fits = lambda chosen: all(spans[b][0] + 8 >= spans[a][1] for a, b in combinations(chosen, 2))  # noqa: B023, E731
        most = max(sum(scores[i] for i in c) for k in range(len(spans) + 1) for c in combinations(range(len(spans)), k) if fits(c))
        got = gene_calls.best_set(spans, scores, 8)
        assert fits(got) and sum(scores[i] for i in got) == most
    assert gene_calls.best_set([], []) == []


def test_hexamer_scores_equal_counts(spark):
    rng = random.Random(4)
    gene = "ATG" + "".join(rng.choice([c for c in sequence.codon_map() if sequence.codon_map()[c] != "*"]) for _ in range(80)) + "TAA"
    seqs = [dna(rng, 400) + gene + dna(rng, 200, "N"), dna(rng, 90), "", None, "ACGTA"]
    found = {r["hexamer"]: r for r in gene_calls.hexamer_scores(spark.createDataFrame([(s,) for s in seqs], "seq string")).collect()}
    assert len(found) == gene_calls.HEXAMERS
    background = sum(len(s) - 5 for s in seqs if s and len(s) > 5)
    with_n = sum("N" in s[i : i + 6] for s in seqs if s for i in range(len(s) - 5))
    assert sum(r["background"] for r in found.values()) == 2 * (background - with_n)
    assert sum(r["coding"] for r in found.values()) >= 79 and found[gene[3:9]]["coding"] >= 1


@pytest.mark.parametrize("piece", [10**6, 9])
def test_pieces_give_the_genes_of_one_pass(spark, monkeypatch, piece):
    monkeypatch.setattr(scan, "PIECE_ROWS", piece)
    rng = random.Random(5)
    rows = [("g", f"s{i}", dna(rng, n, "N")) for i, n in enumerate((6000, 900, 50))] + [("g", "none", None), ("g", "blank", "")]
    frame = spark.createDataFrame(rows, "genome_id string, scaffold_id string, seq string")
    table = np.random.default_rng(6).integers(-60, 140, gene_calls.HEXAMERS)
    scores = spark.createDataFrame([(i, int(x)) for i, x in enumerate(table)], "n int, score int")
    got = gene_calls.call_genes(frame, ["genome_id", "scaffold_id"], "seq", scores, least=12)
    want = []
    for _, name, seq in rows:
        found = sorted(gene_calls.genes_of(seq or "", np.append(table, 0), 12), key=lambda r: (r[1], r[0], r[2]))
        want += [("g", name, *found[i]) for i in gene_calls.best_set([r[:2] for r in found], [r[3] for r in found])]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 20
    total = lambda xs: sum(x[-1] for x in xs)
    assert total(tuple(r) for r in got.collect()) == total(want)


def test_genes_of_an_empty_table(spark):
    with pytest.raises(ValueError, match="longer"):
        gene_calls.call_genes(spark.createDataFrame([], "id string, seq string"), ["id"], least=5)
    assert gene_calls.call_genes(spark.createDataFrame([], "id string, seq string"), ["id"]).count() == 0


def test_hexamers_are_counted_after_peptide_features(spark):
    frame = spark.createDataFrame([("ATGGCA",)], "seq string")
    assert len(frame.select(sequence.peptide_vector("seq")).first()[0]) == len(sequence.FEATURES)
    assert sum(r["background"] for r in gene_calls.hexamer_scores(frame).collect()) == 2
