"""Queries of similarity networks, vectors and sequences."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from ..functions import sequence
from ..operators import graph, similarity
from ..operators.scratch import store
from .ordered_queries import table
from .relation_queries import BOUGHT, customer_brands, pair_scores

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST = 0.8


def _classes(spark, sf_dir, column="p_brand", least=LEAST):
    """(members, pairs) of customers of a nation by their sets of brands."""
    rows = customer_brands(spark, sf_dir, column)
    sets = rows.groupBy("c_nationkey", "o_custkey").agg(F.collect_set("tag").alias("tags"))
    members, pairs = similarity.set_classes(sets, "o_custkey", "tags", least, "c_nationkey")
    return members, store(pairs)


def set_jaccard(spark, sf_dir):
    """Customers of a nation whose sets of brands are alike."""
    members, pairs = _classes(spark, sf_dir)
    return similarity.expand_pairs(members, pairs.withColumn("jaccard", F.round("jaccard", 6)), "o_custkey", "c_nationkey")


JACCARD = """{name} AS (SELECT a.c_nationkey, a.o_custkey AS src, x.o_custkey AS dst, count(*)::DOUBLE / (na.n + nx.n - count(*)) AS jaccard FROM {b} a JOIN {b} x ON a.c_nationkey = x.c_nationkey AND a.tag = x.tag AND a.o_custkey < x.o_custkey
  JOIN (SELECT o_custkey, count(*) AS n FROM {b} GROUP BY 1) na ON na.o_custkey = a.o_custkey JOIN (SELECT o_custkey, count(*) AS n FROM {b} GROUP BY 1) nx ON nx.o_custkey = x.o_custkey
  GROUP BY a.c_nationkey, a.o_custkey, x.o_custkey, na.n, nx.n HAVING count(*)::DOUBLE / (na.n + nx.n - count(*)) >= {least})"""
BRANDS = f"WITH RECURSIVE {BOUGHT.format('p_brand')}, {JACCARD.format(name='j', b='b', least=LEAST)}"
SET_JACCARD = f"{BRANDS} SELECT c_nationkey, src, dst, round(jaccard, 6) AS jaccard FROM j"


def components(spark, sf_dir):
    """Components of the customers that set_jaccard links."""
    return graph.class_components(*_classes(spark, sf_dir), "o_custkey")


COMPONENTS = f"""{BRANDS}, s AS (SELECT src, dst FROM j UNION ALL SELECT dst, src FROM j),
t(node, root) AS (SELECT src, src FROM s UNION SELECT s.dst, t.root FROM t JOIN s ON s.src = t.node AND t.root < s.dst)
SELECT node, min(root) AS root FROM t GROUP BY 1"""


def mcl_families(spark, sf_dir):
    """Markov clusters of the same links."""
    members, pairs = _classes(spark, sf_dir)
    if members.count() == members.select("o_custkey").distinct().count():
        return graph.markov_classes(members, pairs, "o_custkey", 1.5, 2)
    # a customer of several nations is one node with the links of all
    return graph.markov_clusters(similarity.expand_pairs(members, pairs, "o_custkey", "c_nationkey").withColumnRenamed("jaccard", "weight"), 1.5, 2)


def _mcl_sql(rounds: int = 60) -> str:
    """Rounds of expansion, inflation and pruning as tables; more rounds than it takes to settle change nothing."""
    parts = [
        "o AS (SELECT src AS i, dst AS j, jaccard AS v FROM j UNION ALL SELECT dst, src, jaccard FROM j)",
        "l AS (SELECT * FROM o UNION ALL SELECT j, j, greatest(max(v), 1e-12) FROM o GROUP BY j)",
        "m0 AS MATERIALIZED (SELECT i, j, v / sum(v) OVER (PARTITION BY j) AS v FROM l)",
    ]
    for r in range(1, rounds + 1):
        grown = f"SELECT a.i, b.j, pow(sum(a.v * b.v), 1.5) AS v FROM m{r - 1} a JOIN m{r - 1} b ON a.j = b.i GROUP BY a.i, b.j HAVING pow(sum(a.v * b.v), 1.5) >= {graph.PRUNE}"
        parts.append(f"m{r} AS MATERIALIZED (SELECT i, j, v / sum(v) OVER (PARTITION BY j) AS v FROM ({grown}))")
    parts += [
        f"h AS (SELECT i, j, min(j) OVER (PARTITION BY i) AS first FROM m{rounds} WHERE v > {graph.PRUNE})",
        "x AS (SELECT DISTINCT j AS a, first AS b FROM h WHERE j <> first UNION SELECT first, j FROM h WHERE j <> first)",
        "t(node, root) AS (SELECT a, a FROM x UNION SELECT x.b, t.root FROM t JOIN x ON x.a = t.node AND t.root < x.b)",
    ]
    return f"{BRANDS}, {', '.join(parts)} SELECT min(root) AS group_id, node FROM t GROUP BY node"


def _seed_edges(spark, sf_dir):
    """Customers of a nation that share a part and supplier: weight by quantity."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customers, F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "l_partkey", "l_suppkey", "o_custkey", "l_quantity")
    rows = rows.groupBy("c_nationkey", "l_partkey", "l_suppkey", "o_custkey").agg(F.sum("l_quantity").alias("w"))
    other = rows.select("c_nationkey", "l_partkey", "l_suppkey", F.col("o_custkey").alias("dst"), F.col("w").alias("w2"))
    pairs = rows.join(other, ["c_nationkey", "l_partkey", "l_suppkey"]).where("o_custkey < dst")
    return pairs.groupBy(F.col("o_custkey").alias("src"), "dst").agg(F.max(F.least(F.col("w") + F.col("w2"), F.lit(100.0))).alias("weight"))


SEEDED = """q AS (SELECT c_nationkey, l_partkey, l_suppkey, o_custkey, sum(l_quantity) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
e AS (SELECT a.o_custkey AS src, x.o_custkey AS dst, max(least(a.w + x.w, 100.0::DOUBLE)) AS weight FROM q a JOIN q x ON a.c_nationkey = x.c_nationkey AND a.l_partkey = x.l_partkey AND a.l_suppkey = x.l_suppkey AND a.o_custkey < x.o_custkey GROUP BY ALL)"""


def edge_combine(spark, sf_dir):
    """Links by brands and by shared parts, combined."""
    return similarity.combine_classes(*_classes(spark, sf_dir, least=0.5), _seed_edges(spark, sf_dir), "o_custkey", "c_nationkey")


EDGE_COMBINE = f"""WITH {BOUGHT.format('p_brand')}, {JACCARD.format(name='j', b='b', least=0.5)}, {SEEDED}
SELECT COALESCE(j.src, e.src) AS src, COALESCE(j.dst, e.dst) AS dst, round(jaccard, 6) AS jaccard, round(weight / 100, 6) AS seed_weight, round((jaccard + weight / 100) / 2, 6) AS combined,
  CASE WHEN jaccard IS NOT NULL AND weight IS NOT NULL THEN 'precursor_domains' WHEN weight IS NOT NULL THEN 'precursor' ELSE 'jaccard' END AS kind FROM j FULL JOIN e ON j.src = e.src AND j.dst = e.dst"""


def edge_lift(spark, sf_dir):
    """Part-supplier weights as mean weights between brands and nations' suppliers, both ways."""
    edges = pair_scores(spark, sf_dir).select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("w").alias("weight"))
    left = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("a"), F.col("p_brand").alias("src"))
    right = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("b"), F.concat(F.lit("nation"), F.col("s_nationkey").cast("string")).alias("dst"))
    return similarity.lift_edges(edges, left, right).select("src", "dst", F.round("weight", 6).alias("weight"))


EDGE_LIFT = """WITH w AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS w FROM lineitem GROUP BY ALL),
l AS (SELECT p_brand AS a, 'nation' || s_nationkey AS b, round(sum(w) / count(*), 6) AS weight FROM w JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)
SELECT a AS src, b AS dst, weight FROM l UNION ALL SELECT b, a, weight FROM l"""


def vector_allpairs(spark, sf_dir, least: float = 0.4, block: int = 2048):
    """Pairs of vectors (a < b) whose cosine is at least 0.4, in blocks of rows."""
    v = store(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    blocks = max(1, -(-v.count() // block))
    v = v.withColumn("blk", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    left = v.withColumn("other", F.explode(F.sequence(F.col("blk"), F.lit(blocks - 1)))).select("vec_id", "embedding", F.col("blk").alias("i"), F.col("other").alias("j"))
    right = v.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blk")))).select("vec_id", "embedding", F.col("other").alias("i"), F.col("blk").alias("j"))

    def pairs(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, units = [], []
        for t in (a, b):
            x = np.array(t["embedding"].to_pylist(), float).reshape(t.num_rows, -1)
            ids.append(t["vec_id"].to_numpy())
            units.append(x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300))
        cos = units[0] @ units[1].T if a.num_rows and b.num_rows else np.zeros((a.num_rows, b.num_rows))
        same = a["i"][0] == a["j"][0] if a.num_rows else False
        r, c = np.nonzero(cos >= least)
        keep = ids[0][r] < ids[1][c] if same else np.ones(len(r), bool)
        r, c = r[keep], c[keep]
        x, y = ids[0][r], ids[1][c]
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y), "cosine": np.round(cos[r, c], 6)})

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(pairs, "a long, b long, cosine double")


VECTOR_ALLPAIRS = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.4"""

#: Letters of texts as bases, so that documents can stand for DNA; other characters are left out.
LETTERS, AS_BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTTCGAACGTGCATACGTCA"


def dna(spark, sf_dir):
    lower = F.translate("text", LETTERS.upper(), LETTERS)
    bases = F.translate(F.regexp_replace(lower, "[^a-z]", ""), LETTERS, AS_BASES)
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(bases, F.lit("")).alias("seq"))


DNA = f"dna AS (SELECT doc_id, COALESCE(translate(regexp_replace(translate(text, '{LETTERS.upper()}', '{LETTERS}'), '[^a-z]', '', 'g'), '{LETTERS}', '{AS_BASES}'), '') AS seq FROM documents)"


def revcomp(spark, sf_dir):
    """Each document's DNA, reverse-complemented."""
    return dna(spark, sf_dir).select("doc_id", F.md5(sequence.rev_comp(F.col("seq"))).alias("md5"), F.substring(sequence.rev_comp(F.col("seq")), 1, 20).alias("head"))


REVCOMP = f"WITH {DNA}, r AS (SELECT doc_id, translate(reverse(seq), 'ACGT', 'TGCA') AS s FROM dna) SELECT doc_id, md5(s) AS md5, substr(s, 1, 20) AS head FROM r"


def orf_scan(spark, sf_dir):
    """Open reading frames of each document's DNA, on both strands."""
    found = sequence.orf_scan(dna(spark, sf_dir), "doc_id", "seq")
    return found.select("doc_id", "start", "end", "strand", F.length("peptide").alias("n_aa"))


ORF_SCAN = f"""WITH {DNA}, s AS (SELECT doc_id, seq, '+' AS strand, length(seq) AS n FROM dna UNION ALL SELECT doc_id, translate(reverse(seq), 'ACGT', 'TGCA'), '-', length(seq) FROM dna),
c AS (SELECT doc_id, strand, n, i, substr(seq, i + 1, 3) AS codon FROM (SELECT *, unnest(range(0, n - 2)) AS i FROM s WHERE n >= 3)),
e AS (SELECT *, min(CASE WHEN codon IN ('TAA', 'TAG', 'TGA') THEN i END) OVER (PARTITION BY doc_id, strand, i % 3 ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop FROM c)
SELECT doc_id, (CASE strand WHEN '+' THEN i ELSE n - stop - 3 END)::INT AS "start", (CASE strand WHEN '+' THEN stop + 3 ELSE n - i END)::INT AS "end", strand, ((stop - i) // 3)::INT AS n_aa
FROM e WHERE codon IN ('ATG', 'GTG', 'CTG', 'TTG') AND i > 0 AND stop IS NOT NULL AND (stop - i) // 3 BETWEEN 5 AND 99"""


def translated(spark, sf_dir):
    """Each document's DNA as protein."""
    protein = sequence.translate_dna(F.col("seq"))
    return dna(spark, sf_dir).select("doc_id", F.length(protein).alias("n_aa"), F.md5(protein).alias("md5"))


TABLE = ", ".join(f"('{k}', '{v}')" for k, v in sequence.codon_map().items())
TRANSLATED = f"""WITH {DNA}, k(codon, aa) AS (VALUES {TABLE}), m AS (SELECT map_from_entries(list((codon, aa))) AS m FROM k),
p AS (SELECT doc_id, array_to_string(list_transform(range(0, length(seq) // 3), lambda i: m[substr(seq, (i * 3 + 1)::INT, 3)]), '') AS s FROM dna, m)
SELECT doc_id, length(s)::INT AS n_aa, md5(s) AS md5 FROM p"""


def sliding_max(spark, sf_dir):
    """The largest share of vowels in any 30 letters of a text (of the whole, if it is shorter)."""
    kind = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.regexp_replace(F.translate("text", LETTERS.upper(), LETTERS), "[^a-z]", ""), F.lit("")).alias("s"))

    @F.pandas_udf("double")
    def share(s: pd.Series) -> pd.Series:
        vowel = np.zeros(256, bool)
        vowel[[ord(c) for c in "aeiou"]] = True
        return s.map(lambda t: sequence._window_share(vowel[np.frombuffer(t.encode(), np.uint8)], 30))

    return kind.select("doc_id", F.round(share("s"), 6).alias("vowels"))


SLIDING_MAX = f"""WITH l AS (SELECT doc_id, COALESCE(regexp_replace(translate(text, '{LETTERS.upper()}', '{LETTERS}'), '[^a-z]', '', 'g'), '') AS s FROM documents),
c AS (SELECT doc_id, i, length(s) AS n, sum(CASE WHEN substr(s, i, 1) IN ('a', 'e', 'i', 'o', 'u') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS 29 PRECEDING) AS w FROM (SELECT *, unnest(range(1, length(s) + 1)) AS i FROM l)),
g AS (SELECT doc_id, max(CASE WHEN n < 30 AND i = n THEN w / n WHEN i >= 30 THEN w / 30 END) AS v FROM c GROUP BY 1)
SELECT doc_id, COALESCE(round(v, 6), 0) AS vowels FROM l LEFT JOIN g USING (doc_id)"""


def residue_freq(spark, sf_dir):
    """Shares of some letters among a text's characters."""
    text = F.lower("text")
    return table(spark, sf_dir, "documents").select("doc_id", *[F.round(sequence.residue_fraction(text, c), 6).alias(f"f_{c}") for c in "aeno"], F.round(sequence.residue_fraction(text, "rstl"), 6).alias("f_rstl"))


RESIDUE_FREQ = "SELECT doc_id, " + ", ".join(f"CASE WHEN length(text) > 0 THEN round((length(text) - length(translate(lower(text), '{c}', ''))) / length(text), 6) END AS f_{c}" for c in ("a", "e", "n", "o", "rstl")) + " FROM documents"


def fasta_lines(spark, sf_dir):
    """Each document's DNA as FASTA lines of 75, dealt over four files."""
    from ..sources.fasta import wrapped

    rows = dna(spark, sf_dir).where("seq <> ''").select("doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), "seq")
    lines = rows.select("doc_id", (F.pmod("doc_id", F.lit(4))).alias("part"), "name", wrapped(F.col("seq")).alias("body"))
    return lines.select("part", "name", F.size(F.split("body", "\n")).alias("n_lines"), F.md5("body").alias("md5"))


FASTA_LINES = f"""WITH {DNA}, w AS (SELECT doc_id, array_to_string(list_transform(range(0, (length(seq) + 74) // 75), lambda i: substr(seq, (i * 75 + 1)::INT, 75)), chr(10)) AS body, (length(seq) + 74) // 75 AS k FROM dna WHERE seq <> '')
SELECT (doc_id % 4)::BIGINT AS part, 'doc' || doc_id AS name, k::INT AS n_lines, md5(body) AS md5 FROM w"""


def _machines() -> list[tuple]:
    """Kernel machines with weights that a seed gives, three of each kind."""
    rng = np.random.default_rng(7)
    n = len(sequence.FEATURES)
    return [(k, rng.normal(0, 1, (8, n)), rng.normal(0, 0.5, 8), 0.0, 1.0 / n) for k in ("poly4", "poly3", "rbf") for _ in range(3)]


def peptide_scores(spark, sf_dir):
    """Peptides of reading frames of 30 residues or more, scored by an ensemble of kernel machines with given weights."""
    found = sequence.orf_scan(dna(spark, sf_dir), "doc_id", "seq", 30, 100)
    n = len(sequence.FEATURES)
    score = sequence.kernel_ensemble(_machines(), np.zeros(n), np.ones(n))
    scored = found.withColumn("s", score(sequence.peptide_vector(F.col("peptide"))))
    return scored.select("doc_id", "start", "end", "strand", *[F.round(f"s.{c}", 6).alias(c) for c in ("poly4", "poly3", "rbf", "score")])


def peptide_features(spark, sf_dir):
    """All features of the letters of part names, read as peptides."""
    rows = table(spark, sf_dir, "part").select("p_partkey", sequence.peptide_vector(F.regexp_replace(F.upper("p_name"), "[^A-Z]", "")).alias("f"))
    return rows.select("p_partkey", *[F.round(F.col("f")[i], 6).alias(x) for i, x in enumerate(sequence.FEATURES)])


SCALE = ", ".join(f"('{r}', {sequence.HYDROPATHY[r]!r}::DOUBLE, {sequence.CHARGE.get(r, 0.0)!r}::DOUBLE)" for r in sequence.RESIDUES)


def features_sql() -> str:
    """CTEs from p(id, s) to features(id, and a column for each of FEATURES)."""
    quoted = lambda letters: ", ".join(f"'{c}'" for c in letters)
    shares = [f"sum((a = '{r}')::INT) / any_value(n) AS \"res_{r}\"" for r in sequence.RESIDUES]
    shares += [f"sum((a IN ({quoted(letters)}))::INT) / any_value(n) AS class_{c}" for c, letters in sequence.CLASSES.items()]
    most = [f"max({x} / least(n, {w})) AS {x}" for x, w in (("cys30", 30), ("cys20", 20), ("cys_ser30", 30), ("cys_ser20", 20))]
    sums = [f"sum((a IN ({quoted(letters)}))::INT) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) AS {name}{w}" for name, letters in (("cys", "C"), ("cys_ser", "CS")) for w in (30, 20)]
    order = ", ".join(f'"{f}"' for f in sequence.FEATURES)
    return f"""k(a, hydropathy, charge) AS (VALUES {SCALE}),
l AS (SELECT id, length(s)::DOUBLE AS n, i, substr(s, i::INT, 1) AS a FROM (SELECT *, unnest(range(1, length(s) + 1)) AS i FROM p)),
f AS (SELECT id, a, count(*) / any_value(n) AS f FROM l JOIN k USING (a) GROUP BY ALL),
t AS (SELECT l.id, i, n, l.a, f, lag(f) OVER (PARTITION BY l.id ORDER BY i) AS g FROM l LEFT JOIN f ON f.id = l.id AND f.a = l.a),
e AS (SELECT id, max(v) AS entropy FROM (SELECT id, COALESCE(sum(-f * f * g * log2(f * g)) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 9 FOLLOWING), 0) AS v FROM t) GROUP BY 1),
w AS (SELECT s.id, s.i, s.n, t.a, t.f FROM l s JOIN t ON t.id = s.id AND t.i BETWEEN s.i AND s.i + 9),
c AS (SELECT id, i, n, a, any_value(f) AS f, count(*) / 10 AS c FROM w WHERE f IS NOT NULL AND n - i >= 4 GROUP BY ALL),
r AS (SELECT id, min(ratio) AS ratio FROM (SELECT id, i, CASE WHEN -sum(f * log2(f)) > 0 THEN -sum(c * log2(c)) / -sum(f * log2(f)) ELSE 2 END AS ratio FROM c GROUP BY ALL) GROUP BY 1),
x AS (SELECT id, {", ".join(most)} FROM (SELECT id, n, {", ".join(sums)} FROM l) GROUP BY 1),
m AS (SELECT l.id, COALESCE(sum(charge), 0) AS charge, COALESCE(sum(charge), 0) / any_value(n) AS avg_charge, COALESCE(sum(hydropathy), 0) / any_value(n) AS avg_hydropathy, any_value(n) AS length, {", ".join(shares)} FROM l LEFT JOIN k USING (a) GROUP BY 1),
features AS (SELECT id, {order} FROM (SELECT m.*, x.* EXCLUDE (id), entropy, COALESCE(ratio, 2) AS entropy_ratio FROM m JOIN x USING (id) JOIN e USING (id) LEFT JOIN r USING (id)))"""


PEPTIDE_FEATURES = f"""WITH p AS (SELECT p_partkey AS id, regexp_replace(upper(p_name), '[^A-Z]', '', 'g') AS s FROM part), {features_sql()}
SELECT p_partkey, {", ".join(f'COALESCE(round("{f}", 6), 0) AS "{f}"' for f in sequence.FEATURES)} FROM part LEFT JOIN features ON id = p_partkey"""


def _scores_sql() -> str:
    machines = _machines()
    values = ", ".join(f"({i}, '{kind}', {bias!r}::DOUBLE, {gamma!r}::DOUBLE, {float(w)!r}::DOUBLE, {[float(v) for v in row]})" for i, (kind, support, weight, bias, gamma) in enumerate(machines) for row, w in zip(support, weight, strict=True))
    vector = ", ".join(f'"{f}"::DOUBLE' for f in sequence.FEATURES)
    kernel = "CASE kind WHEN 'rbf' THEN exp(-gamma * (list_dot_product(v, v) + list_dot_product(row, row) - 2 * list_dot_product(v, row))) WHEN 'poly4' THEN (gamma * list_dot_product(v, row) + 1) ** 4 ELSE (gamma * list_dot_product(v, row) + 1) ** 3 END"
    return f"""WITH {DNA}, k2(codon, aa) AS (VALUES {TABLE}), cm AS (SELECT map_from_entries(list((codon, aa))) AS m FROM k2),
strands AS (SELECT doc_id, seq, '+' AS strand, length(seq) AS n FROM dna UNION ALL SELECT doc_id, translate(reverse(seq), 'ACGT', 'TGCA'), '-', length(seq) FROM dna),
codons AS (SELECT doc_id, strand, n, i, substr(seq, i + 1, 3) AS codon FROM (SELECT *, unnest(range(0, n - 2)) AS i FROM strands WHERE n >= 3)),
stops AS (SELECT *, min(CASE WHEN codon IN ('TAA', 'TAG', 'TGA') THEN i END) OVER (PARTITION BY doc_id, strand, i % 3 ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop FROM codons),
orfs AS (SELECT *, row_number() OVER () AS id FROM stops WHERE codon IN ('ATG', 'GTG', 'CTG', 'TTG') AND i > 0 AND stop IS NOT NULL AND (stop - i) // 3 BETWEEN 30 AND 99),
p AS (SELECT id, 'M' || array_to_string(list_transform(range(1, (stop - i) // 3), lambda j: m[substr(seq, (i + 3 * j + 1)::INT, 3)]), '') AS s FROM orfs JOIN strands USING (doc_id, strand), cm),
{features_sql()},
machines(machine, kind, bias, gamma, weight, row) AS (VALUES {values}),
vectors AS (SELECT id, [{vector}] AS v FROM features),
sums AS (SELECT id, machine, any_value(kind) AS kind, sum(weight * {kernel}) + any_value(bias) AS z FROM vectors, machines GROUP BY id, machine),
chances AS (SELECT id, kind, avg(1 / (1 + exp(-greatest(least(z, 50), -50)))) AS c FROM sums GROUP BY id, kind),
scored AS (SELECT id, max(CASE kind WHEN 'poly4' THEN c END) AS poly4, max(CASE kind WHEN 'poly3' THEN c END) AS poly3, max(CASE kind WHEN 'rbf' THEN c END) AS rbf, avg(c) AS score FROM chances GROUP BY id)
SELECT doc_id, (CASE strand WHEN '+' THEN i ELSE n - stop - 3 END)::INT AS "start", (CASE strand WHEN '+' THEN stop + 3 ELSE n - i END)::INT AS "end", strand, round(poly4, 6) AS poly4, round(poly3, 6) AS poly3, round(rbf, 6) AS rbf, round(score, 6) AS score
FROM scored JOIN orfs USING (id)"""


QUERIES = {
    "set_jaccard": (set_jaccard, SET_JACCARD), "components": (components, COMPONENTS), "mcl_families": (mcl_families, _mcl_sql()), "edge_combine": (edge_combine, EDGE_COMBINE), "edge_lift": (edge_lift, EDGE_LIFT),
    "vector_allpairs": (vector_allpairs, VECTOR_ALLPAIRS), "revcomp": (revcomp, REVCOMP), "orf_scan": (orf_scan, ORF_SCAN), "translated": (translated, TRANSLATED), "sliding_max": (sliding_max, SLIDING_MAX),
    "residue_freq": (residue_freq, RESIDUE_FREQ), "fasta_lines": (fasta_lines, FASTA_LINES), "peptide_scores": (peptide_scores, _scores_sql()), "peptide_features": (peptide_features, PEPTIDE_FEATURES),
}
