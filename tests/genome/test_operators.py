"""Operators on hand-made rows whose results were worked out by hand."""

import random
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from genloom import schema
from genloom.config import EngineConfig, coerce
from genloom.functions import predicates as P
from genloom.functions import sequence
from genloom.operators import graph, intervals, ordered, orthology, scan, sequential, similarity, summary, tags
from genloom.plans import ordered_queries, relation_queries

KEYS = ["genome_id", "scaffold_id"]
GENES = [("a", 0, 300, "+", False, 0.2), ("b", 340, 640, "+", False, 0.4), ("x", 700, 790, "+", True, None), ("c", 1400, 1700, "+", False, 0.6), ("d", 2450, 2750, "+", False, 0.8), ("e", 2760, 3000, "-", False, 1.0)]


@pytest.fixture(scope="module")
def genes(spark):
    rows = [(g, "g1", "s1", s, e, st, None, False, False, seed, seed, cog) for g, s, e, st, seed, cog in GENES]
    return spark.createDataFrame(rows, schema.GENE)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_neighbours_skip_flagged_rows(genes):
    got = {r.gene_id: (r.left_id, r.left_dist, r.right_id, r.right_dist) for r in ordered.flanks(genes, KEYS, "start", "end", "gene_id", F.col("intergenic")).collect()}
    assert got["x"] == ("b", 60, "c", 610) and got["b"] == ("a", 40, "c", 760) and got["c"] == ("b", 760, "d", 750) and got["d"] == ("c", 750, "e", 10)
    assert got["a"][:2] == (None, None) and got["e"][2:] == (None, None)


def test_run_modes(genes):
    plain = ordered.seeded(ordered.runs(genes, KEYS, "start", "end", "gene_id", 750, ["strand"]), [*KEYS, "run"], F.col("svm_hit"))
    assert [r[0] for r in rows(plain, "gene_id")] == ["a", "b", "c", "d", "x"]
    walked = sequential.legacy_walk(genes, KEYS, "start", "end", "gene_id", "strand", "svm_hit", "intergenic", 750)
    assert rows(walked, "seed_id", "gene_id") == [("x", "a"), ("x", "b"), ("x", "x")]


def test_score_statistics(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4), (2, 0.2), (3, None)], "k int, x double")
    got = {r.k: (r.cog_avg, r.cog_std) for r in summary.cog_stats(df, ["k"], "x").collect()}
    assert got[1] == pytest.approx((0.3, 0.1)) and got[2] == (0.2, 0.05) and got[3] == (None, None)


def test_merge_over_gaps(spark):
    df = spark.createDataFrame([("c1", "s1", "+", 0, 100), ("c2", "s1", "+", 150, 300), ("c3", "s1", "+", 351, 400), ("c4", "s1", "-", 300, 350), ("c5", "s2", "+", 120, 200)], "id string, s string, st string, start int, end int")
    got = {r.id: (r.s, r.st, r.merged) for r in ordered.coalesce_intervals(df, ["s", "st"], "start", "end", "id", 50).collect()}
    assert got["c1"] == got["c2"] and len(set(got.values())) == 4


def test_lone_islands_join_the_nearer(spark):
    df = spark.createDataFrame([(1, 1, 0, 10, 2), (1, 2, 30, 30, 1), (1, 3, 60, 90, 3), (1, 4, 95, 95, 1), (2, 5, 0, 0, 1)], "region int, island int, i_start int, i_end int, n int").withColumn("k", F.lit(1))
    assert rows(ordered.merge_lone(df, ["k"]), "island", "merged") == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5)]


def test_extension_marks_core(genes):
    df = genes.withColumn("grp", F.when(F.col("gene_id").isin("c"), 1))
    got = ordered.extend(df, KEYS, "start", "gene_id", "grp", 1)
    assert rows(got, "gene_id", "is_core", "ord") == [("c", True, 0), ("d", False, 1), ("x", False, -1)]


def test_numbering_and_parts(spark):
    df = spark.createDataFrame([(x,) for x in (5, 900, 7, -3, 10_000, 8)], "k long")
    assert rows(ordered.numbered(df, "k"), "k", "place") == [(-3, 1), (5, 2), (7, 3), (8, 4), (900, 5), (10_000, 6)]
    assert [r[1] for r in rows(ordered.even_parts(df, "k", 4), "k", "part")] == [0, 1, 2, 3, 0, 1]
    assert [r[1] for r in rows(ordered.chunks(df, "k", 3), "k", "part")] == [0, 0, 1, 1, 2, 2]
    dealt = graph.random_even_parts(df, "k", 3, 1).groupBy("part").count()
    assert [r[1] for r in rows(dealt, "part", "count")] == [2, 2, 2]


HITS = [("g1a", "g2a", 90, 75, 100, 1e-50, 200), ("g2a", "g1a", 88, 100, 100, 1e-50, 200), ("g1b", "g2b", 95, 74, 100, 1e-60, 250), ("g1c", "g2c", 60, 100, 100, 1e-20, 90), ("g2c", "g1c", 60, 100, 100, 1e-20, 90), ("g1d", "g2d", 80, 100, 100, 1e-30, 120), ("g1d", "g2e", 80, 100, 100, 1e-30, 120), ("g2d", "g1d", 80, 100, 100, 1e-30, 120), ("g2e", "g1d", 80, 100, 100, 1e-30, 120)]


def test_mutual_best(spark):
    hits = spark.createDataFrame([(q, s, float(p), n, 0, 0, ql, 100, ev, float(b)) for q, s, p, n, ql, ev, b in HITS], schema.HIT)
    names = {x for h in HITS for x in h[:2]}
    of = spark.createDataFrame([(n, n[:2]) for n in names], "gene_id string, genome_id string")
    got = orthology.mutual_best(orthology.read_coverage(hits, of))
    assert rows(got.where("genome_q = 'g1'"), "q", "s") == [("g1a", "g2a"), ("g1d", "g2d"), ("g1d", "g2e")]


def test_adaptive_cutoff(spark):
    df = spark.createDataFrame([("a", "b", 90.0), ("a", "b", 80.0)], "x string, y string, v double")
    assert orthology.adaptive_cutoffs(df, ["x", "y"], "v").first()["cutoff"] == 70.0


@pytest.mark.parametrize("pairs, want", [([("p1", "q1"), ("p2", "q2"), ("p3", "q3")], [("p2", "q2")]), ([("p1", "q3"), ("p2", "q2"), ("p3", "q1")], [("p2", "q2")]), ([("p1", "q1"), ("p2", "q2")], [])])
def test_conserved_neighbours(spark, pairs, want):
    near = lambda x: spark.createDataFrame([(f"{x}1", None, f"{x}2"), (f"{x}2", f"{x}1", f"{x}3"), (f"{x}3", f"{x}2", None)], "id string, left_id string, right_id string")
    assert rows(orthology.conserved_neighbours(spark.createDataFrame(pairs, "a string, b string"), near("p"), near("q")), "a", "b") == want


def test_tuples_grow_and_stay_unique(spark):
    p = [("a1", "b1", "a", "b"), ("a2", "b2", "a", "b"), ("a1", "c1", "a", "c"), ("b1", "c1", "b", "c"), ("a2", "c2", "a", "c")]
    both = p + [(s, q, gs, gq) for q, s, gq, gs in p]
    got = orthology.grow_tuples(spark.createDataFrame(both, "q string, s string, genome_q string, genome_s string"), ["a", "b", "c"])
    assert [[g["gene"] for g in r["genes"]] for r in got.collect()] == [["a1", "b1", "c1"]]
    assert orthology.unique_tuples(got).count() == 1 and orthology.tuple_pairs(got).count() == 9


def test_cutoff_filter_and_frequency(spark):
    hits = spark.createDataFrame([("a1", "b1", "a", "b", 80.0), ("b1", "a1", "b", "a", 82.0), ("a2", "b2", "a", "b", 50.0), ("a3", "b3", "a", "b", 10.0)], "q string, s string, genome_q string, genome_s string, pident double")
    cut = spark.createDataFrame([("a", "b", 70.0)], "genome_a string, genome_b string, cutoff double")
    inside = spark.createDataFrame([("a2", "b2")], "a string, b string")
    assert rows(orthology.filter_by_cutoff(hits, cut, inside), "a", "b", "weight") == [("a1", "b1", 82.0), ("a2", "b2", 100.0)]
    classes = spark.createDataFrame([(1, "a1", "a"), (1, "b1", "b"), (1, "a9", "a")], "class_id int, gene string, genome string")
    covered = spark.createDataFrame([(1, g) for g in "abcd"], "group_no int, genome string")
    assert {r.cog for r in orthology.occurrence(classes, covered).collect()} == {0.5}


def test_domain_overlaps(spark):
    df = spark.createDataFrame([("a", "db", "D1", 1, 100, 1e-30), ("a", "db", "D2", 91, 190, 1e-20), ("a", "db", "D3", 51, 150, 1e-10), ("a", "db", "D4", 190, 250, 1e-5)], schema.GENE_DOMAIN)
    got = sequential.greedy_intervals(df, ["gene_id", "db"], "ali_from", "ali_to", ["evalue", "ali_from", "domain_id"])
    assert [r[0] for r in rows(got, "domain_id")] == ["D1", "D2", "D4"]


def test_categories_and_score(spark):
    items = spark.createDataFrame([("g1",), ("g2",), ("g3",)], "g string")
    owned = spark.createDataFrame([("g1", "D1"), ("g1", "D2"), ("g2", "D9")], "g string, tag string")
    classes = spark.createDataFrame([("cat1", "D1"), ("cat2", "D2")], "category string, tag string")
    assert rows(tags.categories(items, "g", owned, classes), "g", "categories") == [("g1", ["cat1", "cat2"]), ("g2", ["other"]), ("g3", ["other"])]
    df = spark.createDataFrame([(2, 1, 1, 0.5), (1, 1, 1, 0.5), (2, 1, 1, None)], "transporter int, biosyn int, seeds int, cog double")
    base = tags.base_score({c: F.col(c) for c in ("transporter", "biosyn")})
    assert sorted(r[0] for r in df.select(tags.cluster_score(base, F.col("seeds"), F.col("cog"))).collect()) == [4.0, 8.0, 16.0]


def test_interval_overlap(spark):
    inner = spark.createDataFrame([("s", "c", 1000, 2000)], "k string, cluster_id string, start int, end int")
    spans = {"e1": (900, 2100), "e2": (1000, 2000), "e3": (500, 1400), "e4": (1500, 2500), "e5": (1200, 1800), "e6": (500, 1000)}
    outer = spark.createDataFrame([("s", k, a, b) for k, (a, b) in spans.items()], "k string, ext_id string, ext_start int, ext_end int")
    got = {r.ext_id: (r.kind, r.fraction) for r in intervals.overlaps(inner, outer, ["k"]).collect()}
    assert got == {"e1": ("total", None), "e2": ("total", None), "e3": ("partial", 0.4), "e4": ("partial", 0.5)}


def test_contained_ranges_go(spark):
    df = spark.createDataFrame([("a", 0, 90), ("b", 30, 90), ("c", 60, 90), ("d", 0, 30)], "id string, start int, end int").withColumn("k", F.lit(1))
    assert [r[0] for r in rows(intervals.drop_contained(df, ["k"], "start", "end"), "id")] == ["a"]


def test_set_join(spark):
    df = spark.createDataFrame([("k1", ["A", "B"]), ("k2", ["A", "B", "C"]), ("k3", ["B", "A"]), ("k4", ["C"]), ("k5", [])], "id string, tags array<string>")
    got = {(r.src, r.dst): r.jaccard for r in similarity.set_join(df, "id", "tags", 0.5).collect()}
    assert got == pytest.approx({("k1", "k2"): 2 / 3, ("k1", "k3"): 1.0, ("k2", "k3"): 2 / 3})
    edges = spark.createDataFrame([(*k, 1.0) for k in got], "src string, dst string, weight double")
    assert rows(graph.components(edges), "node", "root") == [("k1", "k1"), ("k2", "k1"), ("k3", "k1")]


@pytest.mark.parametrize("seed", range(3))
def test_set_join_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    sets = {i: frozenset(rng.sample("abcdefghij", rng.randint(0, 6))) for i in range(40)}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id int, tags array<string>")
    assert {(r.src, r.dst) for r in similarity.set_join(df, "id", "tags", 0.6).collect()} == want


def test_components_of_a_long_chain(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101)], "src long, dst long")
    got = dict(rows(graph.components(edges), "node", "root"))
    assert got == {**dict.fromkeys(range(n + 1), 0), 100: 100, 101: 100}


def test_markov_clusters(spark):
    tight = [(a, b, 1.0) for g in ("abcd", "wxyz") for i, a in enumerate(g) for b in g[i + 1 :]] + [("d", "w", 0.1)]
    got = graph.markov_clusters(spark.createDataFrame(tight, "src string, dst string, weight double"))
    assert rows(got, "node", "group_id") == [(c, "a") for c in "abcd"] + [(c, "w") for c in "wxyz"]
    m = np.ones((3, 3))
    assert graph.mcl(m) == [[0, 1, 2]]


def test_large_components_are_clustered_by_joins(spark):
    rng = np.random.default_rng(4)
    e = [(f"n{a:02d}", f"n{b:02d}", float(rng.uniform(0.2, 1))) for a in range(24) for b in range(a + 1, 24) if rng.random() < (0.8 if a // 6 == b // 6 else 0.04)]
    edges = spark.createDataFrame(e, "src string, dst string, weight double")
    assert rows(graph.markov_clusters(edges, most_dense=3), "node", "group_id") == rows(graph.markov_clusters(edges), "node", "group_id")
    assert rows(graph.markov_clusters(edges, min_size=6, most_dense=3), "node", "group_id") == rows(graph.markov_clusters(edges, min_size=6), "node", "group_id")


def test_lifted_and_combined_edges(spark):
    e = spark.createDataFrame([("g1", "h1", 90.0), ("g2", "h1", 70.0), ("g1", "g2", 99.0)], "a string, b string, weight double")
    of = spark.createDataFrame([("g1", "G"), ("g2", "G"), ("h1", "H")], "n string, c string")
    lifted = similarity.lift_edges(e, of.select(F.col("n").alias("a"), F.col("c").alias("src")), of.select(F.col("n").alias("b"), F.col("c").alias("dst")))
    assert rows(lifted, "src", "dst", "weight") == [("G", "H", 80.0), ("H", "G", 80.0)]
    both = similarity.combine_edges(spark.createDataFrame([("G", "H", 0.6), ("G", "K", 0.5)], "src string, dst string, jaccard double"), lifted)
    assert {(r.src, r.dst): (r.kind, r.combined) for r in both.collect()} == {("G", "H"): ("precursor_domains", pytest.approx(0.7)), ("G", "K"): ("jaccard", None), ("H", "G"): ("precursor", None)}


def test_ancestors_and_taxa(spark):
    nodes = spark.createDataFrame([("5", "3", "s"), ("3", "2", "g"), ("2", "1", "f"), ("1", "1", "root"), ("9", "1", "f")], schema.TAX_NODE)
    asm = spark.createDataFrame([(f"A{t}", "Ref", t, "", "", "Complete", "") for t in ("5", "3", "2", "9", "77")], schema.ASSEMBLY)
    found, unknown = graph.below(asm, nodes, "2", ["complete"])
    assert rows(found, "accession") == [("A2",), ("A3",), ("A5",)] and rows(unknown, "accession") == [("A77",)]


def test_island_fusion_rules():
    near, far = [0.2, 0.3], [0.9, 0.9]
    assert sequential.fuse([near, near, near], 1) == [0, 1, 2]
    assert sequential.fuse([near, near, far], 1) == [0, 1]
    assert sequential.fuse([near, [0.9], near], 0) == [0, 1, 2]  # an outlier is absorbed with the island beyond it
    assert sequential.fuse([near, [], near], 0) == [0, 1, 2]
    assert sequential.fuse([[], near], 0) == [0, 1]
    # rows without a score count as outliers, too: two with the first one taken in leave no room for another
    assert sequential.fuse([near, [0.9, None], near, [0.95], near], 0) == [0, 1, 2]
    assert sequential.fuse([near, [0.9], near, [0.95], near], 0) == [0, 1, 2, 3, 4]
    assert sequential.fuse([near, [None, None], near], 0) == [0, 1, 2]


def test_fused_islands_count_rows_without_a_score(spark):
    scores = [[0.2, 0.3], [0.9, None], [0.2, 0.3], [0.95], [0.2, 0.3]]
    df = spark.createDataFrame([("k", i, x, i == 0) for i, xs in enumerate(scores) for x in xs], "key string, island long, score double, seed boolean")
    assert rows(sequential.island_fusion(df, ["key"], "island", "score", "seed"), "island") == [(0,), (1,), (2,)]


def test_ancestors_of_any_depth(spark):
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 150)] + [(0, None), (200, 149)], "node int, parent int")
    found = {(r.node, r.ancestor): r.depth for r in graph.ancestors(chain).collect()}
    assert found == {(a, b): a - b for a in range(150) for b in range(a)} | {(200, b): 150 - b for b in range(150)}
    with pytest.raises(ValueError, match="its own ancestor"):
        graph.ancestors(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "node int, parent int"))


@pytest.mark.parametrize("size", [1, 7, 40])
def test_scans_of_pieces_equal_windows(spark, monkeypatch, size):
    import random

    rng = random.Random(size)
    data = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.randrange(40), i, rng.choice([None, *range(9)])) for i in range(150)]
    df = spark.createDataFrame(data, "k string, s int, i int, v int")
    full = {"before": {"b": F.col("v"), "p": F.struct("i", "v")}, "after": {"a": F.col("v")}, "sums": {"t": F.col("v"), "n": F.lit(1)}, "tops": {"m": F.col("v"), "w": F.struct("v", "i")}}
    want = sorted(map(str, scan.scan(df, ["k"], ["s", "i"], **full).collect()))
    monkeypatch.setattr(scan, "PIECE_ROWS", size)
    for most in (10**6, 0):
        monkeypatch.setattr(scan, "MOST_BROADCAST", most)
        assert sorted(map(str, scan.scan(df.repartition(3), ["k"], ["s", "i"], **full).collect())) == want


def test_operators_on_a_hot_key_equal_those_on_windows(spark, monkeypatch):
    import random

    rng = random.Random(8)
    df = spark.createDataFrame([("h", s, s + rng.randrange(6), i, rng.random() < 0.3, rng.choice("+-")) for i, s in enumerate(rng.randrange(400) for _ in range(160))], "k string, s int, e int, i int, f boolean, t string")

    def every():
        islands = spark.createDataFrame([("h", 1, i, 10 * i, 10 * i + rng2.randrange(9), rng2.choice([1, 1, 3])) for i in range(60)], "k string, region long, island long, i_start int, i_end int, n long")
        placed = ordered.runs(df, ["k"], "s", "e", "i", 3, ["t"], "run")
        out = [ordered.flanks(df, ["k"], "s", "e", "i", F.col("f")), placed, ordered.two_level_islands(df, ["k"], "s", "e", "i", 1, 4), ordered.coalesce_intervals(df, ["k"], "s", "e", "i", 2), ordered.merge_lone(islands, ["k"])]
        out.append(ordered.extend(placed.withColumn("g", F.when(F.col("run") % 5 == 0, F.col("run"))), ["k"], "s", "i", "g", 2))
        out += [sequential.legacy_walk(df, ["k"], "s", "e", "i", "t", "f", "f", 4), sequential.greedy_intervals(df.withColumn("z", F.col("s") - F.col("e")), ["k"], "s", "e", ["z", "i"])]
        return [sorted(map(str, x.collect())) for x in out]

    rng2 = random.Random(9)
    want = every()
    monkeypatch.setattr(scan, "PIECE_ROWS", 11)
    monkeypatch.setattr(sequential, "MOST_PIECE", 4)
    rng2 = random.Random(9)
    assert every() == want and all(want)


def test_meeting_intervals_of_uneven_lengths(spark):
    import random

    rng = random.Random(4)
    spans = [(i, s, s + rng.choice([0, 1, 5, 300])) for i, s in enumerate(rng.randrange(-500, 2000) for _ in range(120))] + [(999, -10**6, 10**9)]
    left = spark.createDataFrame([("k", *x) for x in spans], "k string, i int, s int, e int")
    right = left.selectExpr("k", "i as j", "s as s2", "e as e2").where("j % 3 = 0")
    got = [(r.i, r.j) for r in intervals.meeting(left, right, ["k"], ("s", "e"), ("s2", "e2")).collect()]
    want = sorted((a, b) for a, s, e in spans for b, s2, e2 in spans if b % 3 == 0 and s <= e2 and s2 <= e)
    assert sorted(got) == want


def test_set_cover(spark):
    df = spark.createDataFrame([("k", g, m) for g, ms in {"g1": "abc", "g2": "cd", "g3": "d", "g4": "ab"}.items() for m in ms], "key string, grp string, member string")
    assert rows(sequential.set_cover(df, "key", "grp", "member"), "turn", "grp") == [(1, "g1"), (2, "g2")]
    assert sequential.set_cover(df.where("key = 'none'"), "key", "grp", "member").collect() == []
    nulls = df.unionByName(spark.createDataFrame([(None, "g1", "a"), ("k", None, "z"), ("j", "g9", "a")], df.schema))
    assert rows(sequential.set_cover(nulls, "key", "grp", "member"), "key", "turn", "grp") == [("j", 1, "g9"), ("k", 1, "g1"), ("k", 2, "g2")]


def brute_groups(pairs, min_tuples, min_size):
    genomes, linked = sorted({p[2] for p in pairs}), {(p[0], p[1]) for p in pairs}
    between = {}
    for q, s, a, b in pairs:
        between.setdefault((a, b), []).append((q, s))
    out = set()
    for seed in genomes:
        left = set(genomes) - {seed}
        while True:
            n, first = min(((-len(between.get((seed, g), ())), g) for g in left), default=(0, None))
            if -n < min_tuples:
                break
            group, tuples = [seed, first], [{seed: {q}, first: {s}} for q, s in between[seed, first]]
            while True:
                options = {}
                for g in left - set(group):
                    genes = sorted({p[1] for p in pairs if p[3] == g})
                    options[g] = [t | {g: more} for t in tuples if (more := {x for x in genes if all(any((m, x) in linked for m in t[h]) for h in group)})]
                n, best = min(((-len(t), g) for g, t in options.items()), default=(0, None))
                if -n < min_tuples:
                    break
                group.append(best)
                tuples = options[best]
            if len(group) >= min_size:
                out.add((tuple(sorted(group)), len(tuples)))
            left -= set(group)
    most = {}
    for g, n in out:
        most[g] = max(n, most.get(g, 0))
    return most


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_of_genomes_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    genomes = "abcdefg"
    pairs = set()
    for family in range(40):
        members = rng.sample(genomes, rng.randint(2, 5)) if family % 3 else list("abc") + rng.sample("defg", 1)
        for a in members:
            for b in members:
                if a != b and rng.random() < 0.95:
                    pairs |= {(f"{a}{family}", f"{b}{family}", a, b), (f"{b}{family}", f"{a}{family}", b, a)}
    found = orthology.genome_groups(spark.createDataFrame(sorted(pairs), "q string, s string, genome_q string, genome_s string"), 5, 3)
    groups, number = {}, {}
    for r in found.collect():
        groups.setdefault(r["group_no"], []).append(r["genome"])
        number[r["group_no"]] = r["n_tuples"]
    got = {tuple(sorted(g)): number[i] for i, g in groups.items()}
    assert got == brute_groups(sorted(pairs), 5, 3) and got
    assert {g for group in orthology.covering_groups(found) for g in group} == {g for group in got for g in group}
    assert orthology.genome_groups(spark.createDataFrame([], "q string, s string, genome_q string, genome_s string")).count() == 0


def test_sequences(spark):
    df = spark.createDataFrame([("ATGC",)], "s string")
    assert df.select(sequence.rev_comp(F.col("s"))).first()[0] == "GCAT"
    seq = "CATGAAACCCGGGTTTTAAC"
    assert (1, 19, "+") in sequence.find_orfs(seq) and not any(x[0] == 0 and x[2] == "+" for x in sequence.find_orfs(seq[1:]))
    got = sequence.orf_scan(spark.createDataFrame([(1, seq), (2, None), (3, "CATGAANCCCGGGTTTTAAC")], "id int, s string"), "id", "s").collect()
    assert [(r.start, r.end, r.peptide) for r in got if r.id == 1 and r.strand == "+"][0] == (1, 19, "MKPGF") and not [r for r in got if r.id == 2]
    assert spark.createDataFrame([("GTGAAATAA",)], "s string").select(sequence.translate_dna(F.col("s"), True)).first()[0] == "MK*"


def test_peptide_features():
    f = dict(zip(sequence.FEATURES, sequence.peptide_features("ACDC"), strict=True))
    assert len(sequence.FEATURES) == 36 and f["cys20"] == f["cys30"] == 0.5 and f["charge"] == -1 and f["length"] == 4
    assert sum(v for k, v in f.items() if k.startswith("res_")) == pytest.approx(1)
    long = dict(zip(sequence.FEATURES, sequence.peptide_features("C" * 10 + "A" * 40), strict=True))
    assert long["cys20"] == 0.5 and long["cys30"] == pytest.approx(1 / 3)


def test_peptide_features_by_hand():
    import math

    seq = "HHCCKKDDEEWWAXCS"
    f = dict(zip(sequence.FEATURES, sequence.peptide_features(seq), strict=True))
    share = {c: seq.count(c) / len(seq) for c in sequence.RESIDUES}
    assert f["avg_hydropathy"] == pytest.approx((2 * 0.96 + 3 * -0.24 + 2 * 0.99 + 2 * 1.23 + 2 * 2.02 + 2 * -1.85 + 0.17 + 0.13) / 16) and f["charge"] == 1 + 2 - 4
    ratios, sums = [], []
    for i in range(len(seq)):
        w = seq[i : i + 10]
        known = [c for c in set(w) if c in share]
        if len(w) >= 5:
            ratios.append(sum(w.count(c) / 10 * math.log2(w.count(c) / 10) for c in known) / sum(share[c] * math.log2(share[c]) for c in known))
        sums.append(-sum(share[b] ** 2 * share[a] * math.log2(share[a] * share[b]) for a, b in zip(w, w[1:]) if a in share and b in share))
    assert f["entropy_ratio"] == pytest.approx(min(ratios)) and f["entropy"] == pytest.approx(max(sums))
    assert (f["cys20"], f["cys_ser20"], f["length"]) == (3 / 16, 4 / 16, 16)
    assert {r: sequence.HYDROPATHY[r] for r in "ARNDCQEGHILKMFPSTWYV"} == dict(zip("ARNDCQEGHILKMFPSTWYV", [0.17, 0.81, 0.42, 1.23, -0.24, 0.58, 2.02, 0.01, 0.96, -0.31, -0.56, 0.99, -0.23, -1.13, 0.45, 0.13, 0.14, -1.85, -0.94, 0.07], strict=True))
    seqs = [seq, "", "A", "AAAAA", "XXXXXX", "ACDC", "M" * 50]
    assert sequence.feature_matrix(seqs).tolist() == [pytest.approx(sequence.peptide_features(s)) for s in seqs]
    assert [sequence.peptide_features(s)[sequence.FEATURES.index("entropy_ratio")] for s in ("AAAAA", "XXXXXX", "ACDC")] == [2, 2, 2]


def test_greedy_intervals_in_a_hot_key(spark):
    import random
    import time

    rng = random.Random(3)
    spans = [(1, s, s + rng.randint(0, 30), i) for i, s in enumerate(rng.randrange(10**6) for _ in range(20_000))] + [(1, 0, 10**6, -1)]
    df = spark.createDataFrame(spans, "key int, s long, e long, id long").withColumn("size", F.col("s") - F.col("e"))
    began = time.time()
    got = {r.id for r in sequential.greedy_intervals(df, ["key"], "s", "e", ["size", "s", "id"]).collect()}
    assert time.time() - began < 60
    taken = []
    for _, s, e, i in sorted(spans, key=lambda x: (x[1] - x[2], x[1], x[3])):
        if i == -1 or not any(sequential._clashes((s, e), t) for t in taken[1:] if t[0] < e and s < t[1]) and not sequential._clashes((s, e), taken[0]):
            taken.append((s, e))
            assert i in got
    assert len(got) == len(taken)


def test_large_pieces_are_picked_from_in_rounds(spark, monkeypatch):
    import random

    rng = random.Random(5)
    spans = [(k, s, s + rng.randint(0, 40), i, 0) for k in (1, 2) for i, s in enumerate(rng.randrange(600) for _ in range(120))]
    df = spark.createDataFrame(spans, "key int, s long, e long, id long, x int").withColumn("size", F.col("s") - F.col("e"))
    pick = lambda: rows(sequential.greedy_intervals(df, ["key"], "s", "e", ["size", "s", "id"]), "key", "id")
    want = pick()
    monkeypatch.setattr(sequential, "MOST_PIECE", 10)
    assert pick() == want and len(want) > 20


def test_needles_in_texts(spark, monkeypatch):
    items = spark.createDataFrame([(1, "abcdef"), (2, "xbcx"), (3, ""), (4, None), (5, "é c")], "id int, t string")
    pairs = [("a", "bcd"), ("b", "b"), ("c", "bc"), ("d", ""), ("e", None), ("f", "é c"), ("g", "zzzz"), ("h", "bc"), ("h", "abcdef")]
    needles = spark.createDataFrame(pairs, "label string, needle string")
    want = sorted({(r.id, label) for r in items.collect() for label, n in pairs if n is not None and r.t is not None and n in r.t})
    for most in (200_000, 2):
        monkeypatch.setattr(tags, "MOST_NEEDLES", most)
        assert rows(tags.substring_classes(items, "id", "t", needles), "id", "label") == want
    assert tags.substring_classes(items, "id", "t", needles.limit(0)).count() == 0


def test_a_hundred_thousand_needles(spark):
    rng = random.Random(2)
    write = lambda n: "".join(rng.choices("abcd", k=n))
    needles = sorted({write(rng.randint(6, 12)) for _ in range(130_000)})[:100_000]
    texts = [(i, write(300)) for i in range(200)]
    found = rows(tags.substring_classes(spark.createDataFrame(texts, "id int, t string"), "id", "t", spark.createDataFrame([(i, n) for i, n in enumerate(needles)], "label int, needle string")), "id", "label")
    number = {n: i for i, n in enumerate(needles)}
    want = {(i, number[t[a:b]]) for i, t in texts for a in range(300) for b in range(a + 6, min(a + 13, 301)) if t[a:b] in number}
    assert found == sorted(want) and len(want) > 5000


def test_network_rows(spark):
    from genloom.sources import sinks

    edges = spark.createDataFrame([("a", "b", 0.5, None, None), ("a", "c", 0.5, 0.4, 0.45)], "src string, dst string, jaccard double, seed_weight double, combined double")
    nodes = spark.createDataFrame([("a", "G", False), ("b", "H", True), ("c", "H", None)], "cluster_id string, genome string, is_reference boolean")
    assert rows(sinks.network(edges, ["jaccard"]), "src", "dst") == [("a", "b"), ("b", "a")]
    got = rows(sinks.network(edges, None, nodes), "src", "dst", "kind", "src_genome", "has_reference")
    assert got == [("a", "b", "jaccard", "G", True), ("a", "c", "precursor_domains", "G", False), ("b", "a", "jaccard", "H", True), ("c", "a", "precursor_domains", "H", False)]


def test_classes_of_equal_sets_are_not_expanded(spark):
    sets = spark.range(3000).selectExpr("id", "array('a', 'b', 'c', 'd') as t").unionByName(spark.createDataFrame([(9000, ["a", "b", "c", "d", "e"]), (9001, ["z"]), (9002, []), (9003, None)], "id long, t array<string>"))
    members, pairs = similarity.set_classes(sets, "id", "t", 0.8)
    assert members.count() == 3002 and members.select("class_id").distinct().count() == 3
    assert [r.jaccard for r in pairs.collect()] == [0.8]


def test_predicates(spark):
    df = spark.createDataFrame([(1, 5, ["D1", "D2"], {"k": 3}), (2, None, ["D1"], {"k": 9}), (3, 2, None, None)], "id int, n int, tags array<string>, m map<string,int>")
    ids = lambda c: [r[0] for r in rows(df.where(c), "id")]
    assert ids(P.where(n=P.Min(3))) == [1] and ids(P.where(n=P.NOT(P.Min(3)))) == [2, 3]
    assert ids(P.where(tags=P.Contains("D1", "D2"))) == [1] and ids(P.where(tags=P.Length(P.Max(1)))) == [2]
    assert ids(P.where(m=P.DictValue(None, P.Min(9)))) == [2] and ids(P.where(m=P.DictValue("k", P.Equal(3)))) == [1]
    assert ids(P.where(n=P.OR(P.IsIn(2), P.Max(1)))) == [3] and ids(P.membership("tags", "D2")) == [1]
    need = {"n": {"type": "max", "value": 3}, "tags": {"type": "min", "value": 1}}
    kinds = {"n": "number", "tags": "array"}
    assert ids(P.from_facets(need, kinds)) == [2] and ids(P.from_facets(need, kinds, missing_passes=True)) == [2, 3]
    assert P.parse_requirements({"tags": {"type": "contains", "value": ["D1"]}}, {"tags": ("contains", "D2, D1"), "n": ("min", "3")}) == {"tags": {"type": "contains", "value": ["D1", "D2"]}, "n": {"type": "min", "value": 3.0}}
    assert P.parse_requirements({"n": {"type": "min", "value": 3}}, {"n": ("min", " ")}) == {}


def test_settings():
    assert EngineConfig().with_text({"Peptide_Score": "0.8", "keep_pseudo": "false"}).peptide_score == 0.8
    assert [coerce(x) for x in ("3", "0.5", "True", "a,2", "x")] == [3, 0.5, True, ["a", 2], "x"]


def test_group_summary_counts_customers_that_share_a_key(spark, tmp_path):
    spark.createDataFrame([(1, "x", 7, 1.0, "A"), (1, "y", 7, 3.0, "A"), (None, "z", 7, 5.0, "A")], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k, 1, "O", "5-LOW") for k in range(21)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    assert [tuple(r) for r in relation_queries.group_summary(spark, str(tmp_path)).collect()] == [("A", 7, 3, 2, 3.0, "1.0")]


@pytest.mark.parametrize("lead, other, fused", [([99, 94], [27, 84], [0, 1]), ([99], [84, 21], [0]), ([99], [76, 84], [0])])
def test_fused_islands_equal_sql_where_the_last_digit_decides(spark, tmp_path, lead, other, fused):
    values = [(i, v) for i, vs in enumerate((lead, other)) for v in vs]
    rows_ = [(n, datetime(2024, 1, 1) + timedelta(hours=5 * i, seconds=n), 1, "view", float(v), "{}") for n, (i, v) in enumerate(values)]
    spark.createDataFrame(rows_[::-1], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = rows(ordered_queries.island_fusion(spark, str(tmp_path)), "seed_island", "island")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == sorted(con.sql(f"SELECT seed_island, island FROM ({ordered_queries.ISLAND_FUSION})").fetchall())
    assert [i - 1 for s, i in got if s == 1] == fused


def _alike(spark, seed):
    """Sets of which many are equal, in two blocks: (members, pairs) of their classes, and the same links spelled out."""
    rng = random.Random(seed)
    base = [sorted(rng.sample("abcdefghijkl", rng.randint(5, 9))) for _ in range(14)]
    sets = spark.createDataFrame([(i, i % 2, base[rng.randrange(len(base))] if i < 60 else sorted(rng.sample("abcdefghijkl", 7))) for i in range(80)], "id int, block int, tags array<string>")
    plain = [(r.block, r.id, set(r.tags)) for r in sets.collect()]
    links = [(a, b, len(x & y) / len(x | y)) for p, a, x in plain for q, b, y in plain if p == q and a < b and len(x & y) >= 0.6 * len(x | y)]
    return *similarity.set_classes(sets, "id", "tags", 0.6, "block"), links


@pytest.mark.parametrize("seed", range(2))
def test_classes_give_what_their_items_give(spark, seed, monkeypatch):
    monkeypatch.setattr(similarity, "CHUNK", 3)
    members, pairs, links = _alike(spark, seed)
    edges = spark.createDataFrame(links, "src int, dst int, weight double")
    assert rows(similarity.expand_pairs(members, pairs, "id", "block"), "src", "dst", "jaccard") == sorted(links)
    assert rows(graph.class_components(members, pairs, "id"), "node", "root") == rows(graph.components(edges), "node", "root")
    want = rows(graph.markov_clusters(edges, 1.5, 2), "node", "group_id")
    for dense in (1500, 3):
        assert rows(graph.markov_classes(members, pairs, "id", 1.5, 2, dense), "node", "group_id") == want
    assert {n for n, _ in rows(graph.markov_classes(members, pairs, "id"), "node", "group_id")} == set(range(80))


def test_seeded_edges_combine_with_classes(spark):
    members, pairs, links = _alike(spark, 5)
    rng = random.Random(5)
    seeded = spark.createDataFrame(sorted({(a, b, float(10 + a)) for a, b, _ in links if rng.random() < 0.2} | {(a, a + 1, 50.0) for a in range(20)}), "src int, dst int, weight double")
    plain = similarity.combine_edges(spark.createDataFrame(links, "src int, dst int, jaccard double"), seeded)
    want = plain.select("src", "dst", "kind", *[F.coalesce(F.round(c, 6), F.lit(-1.0)) for c in ("jaccard", "seed_weight", "combined")])
    got = similarity.combine_classes(members, pairs, seeded, "id", "block").select("src", "dst", "kind", *[F.coalesce(c, F.lit(-1.0)) for c in ("jaccard", "seed_weight", "combined")])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
