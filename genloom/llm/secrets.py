"""Secret scans: three patterns, and a battery of randomness tests with length-aware false-discovery control.

Runs of key-like characters are candidates. A candidate's encoding (decimal, one or two cases of letters, hex, base32, base36,
base62, base64) is inferred from its characters. Two tests ask whether it may be written (words, names, numbers): its chi-squared distance from a
uniform alphabet against what written strings of that encoding give at that length (a lower-tail p-value: small means
too even, for the classes of characters that it has), and the chance of its characters and of its changes between letters and
digits in writing, plain or in camel case, against their chance at random (a likelihood ratio, which by Markov's inequality is a
p-value). p is twice the smaller. The
chi-squared distance itself (repeats), a runs test and a serial-correlation test must not contradict randomness. Within each encoding and length class, Benjamini-Hochberg control over all candidates of
the corpus decides, with p-values rounded up to bins, so the corpus is summed into a bounded table, not sorted.

Defined results: a null text is empty; base matches stay whatever the tests say; candidates that overlap a base match
are not added; rows that repeat are scanned one by one; an empty table gives an empty result; other columns are
ignored. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind: pattern, group whose length counts, least length; in the order in which kinds sort.
BASE = {"assign": (ASSIGN, 2, 6), "access": (r"AKIA[A-Z0-9]+", 0, 20), "hex": (r"[0-9a-f]{24,}", 0, 24)}
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ADDED = "random"
KINDS = (*BASE, ADDED)
#: encoding: pattern of its strings, symbols in order of value, chi-squared excess of words per symbol (alphabet size
#: x the chance that two letters of written words agree, less 1).
WORD_MATCH = 0.065
ENCODINGS = {
    "hex": ("^[0-9a-f]+$|^[0-9A-F]+$", "0123456789abcdef"),
    "base32": ("^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    "base36": ("^[0-9a-z]+$|^[0-9A-Z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    "base62": ("^[0-9A-Za-z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    "base64": ("", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
}
FALSE_DISCOVERY, TEST_ALPHA_Z, BINS = 0.01, 3.29, 20
CHUNK = 256  # matches
#: Chance that two characters of written strings of an encoding agree. Written hex is digits (0.1) and letters of a to f
#: (0.26), some half of each.
WRITTEN_MATCH = {"hex": 0.09, "decimal": 0.13}
#: Encodings without both a digit and a letter, tried before ENCODINGS, of which sql() knows no more. Written numbers (dates,
#: round ones) repeat digits a bit more often than by chance.
PLAIN = {
    "decimal": ("^[0-9]+$", "0123456789"),
    "alpha": ("^[a-z]+$|^[A-Z]+$", "abcdefghijklmnopqrstuvwxyz"),
    "letters": ("^[A-Za-z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
}
FOLDED = ("alpha", "hex", "base36")
#: Writing as a chain of classes (lower, upper, digit, sign), then a character of the class. Letters: shares in written
#: European languages, rare ones raised to 0.5 %. Each row of chances sums to 1.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/_-")
LETTERS = (8.2, 1.5, 3.0, 4.3, 13.0, 1.8, 2.2, 4.0, 7.0, 0.5, 0.7, 4.4, 2.6, 7.3, 7.0, 2.4, 0.6, 6.3, 6.6, 7.6, 3.4, 1.0, 1.5, 0.5, 1.5, 0.6)
STEPS = ((0.87, 0.05, 0.04, 0.04), (0.13, 0.79, 0.04, 0.04), (0.10, 0.05, 0.75, 0.10), (0.50, 0.15, 0.20, 0.15))
#: The same for words set together by capitals (camel case). A string is judged by the chain that explains it better.
CAMEL_STEPS = ((0.80, 0.15, 0.03, 0.02), (0.88, 0.07, 0.03, 0.02), (0.10, 0.30, 0.55, 0.05), (0.30, 0.40, 0.20, 0.10))
#: Chance that two characters of one class agree in writing.
CLASS_MATCH = (WORD_MATCH, WORD_MATCH, 0.13, 0.4)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once, however often lambdas in `use` refer to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def pattern_spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, kind, end, s>> of a pattern's matches, left to right; s: the match itself.

    The pieces between matches (a split by the pattern) and the matches alternate, so their lengths give positions. Lists are
    appended to by chunks, as an append copies the list."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    matches = F.arrays_zip(gaps.alias("gap"), found.alias("s"), F.transform(counts, F.length).alias("key"))
    length = lambda x: x["gap"] + F.coalesce(F.length(x["s"]), F.lit(0))
    none = F.array().cast("array<struct<start:int,kind:string,end:int,s:string>>")

    def add(acc: Column, x: Column) -> Column:
        start, end = acc["at"] + x["gap"], acc["at"] + length(x)
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["s"].alias("s"))
        return F.struct(end.alias("at"), F.when(x["key"] >= least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    def by_chunks(m: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / CHUNK).cast("int")), lambda i: F.slice(m, i * CHUNK + 1, F.lit(CHUNK)))

    def spans(chunks: Column) -> Column:
        sizes = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + length(x)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(sizes, start, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")), lambda acc: acc["starts"])
        return F.flatten(F.zip_with(chunks, starts, lambda c, at: F.aggregate(c, F.struct(at.alias("at"), none.alias("spans")), add, lambda acc: acc["spans"])))

    return F.when(text.rlike(pattern), _let(_let(matches, by_chunks), spans)).otherwise(none)


def _count_under(values: Column, most: Column) -> Column:
    """How many of the sorted `values` are less than `most`, by bisection."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + F.lit(1))).cast("int"))
    middle = lambda b: F.floor((b["lo"] + b["hi"]) / 2).cast("int")

    def halve(b: Column, _: Column) -> Column:
        below = (b["lo"] < b["hi"]) & (F.get(values, middle(b)) < most)
        return F.struct(F.when(below, middle(b) + 1).otherwise(b["lo"]).alias("lo"), F.when(below | (b["lo"] >= b["hi"]), b["hi"]).otherwise(middle(b)).alias("hi"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(values).alias("hi")), halve, lambda b: b["lo"])


def _apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of `others`: all that start before a span's end have ended by its start."""
    ends = F.struct(F.array_sort(F.transform(others, lambda b: b["start"])).alias("starts"), F.array_sort(F.transform(others, lambda b: b["end"])).alias("ends"))
    apart = _let(ends, lambda b: F.filter(spans, lambda m: _count_under(b["starts"], m["end"]) == _count_under(b["ends"], m["start"] + 1)))
    return F.when((F.size(others) == 0) | (F.size(spans) == 0), spans).otherwise(apart)


def _ranked(spans: Column) -> Column:
    """In order of start, then of kind as listed."""
    kinds = F.array(*map(F.lit, KINDS))
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.array_sort(keyed)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(_ranked(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def lower_tail(z: Column) -> Column:
    """The normal lower tail, by the approximation of Karagiannidis and Lioumpas."""
    x = F.greatest(F.abs(z), F.lit(1e-9))
    tail = (1 - F.exp(-1.4 * x)) * F.exp(-x * x / 2) / (1.135 * math.sqrt(2 * math.pi) * x)
    return F.when(z < 0, tail).otherwise(1 - tail)


def written_log_chance(s: Column) -> Column:
    """The log of the chance of `s`, without its padding, in writing. Capitals alone are taken as small letters."""
    share = [x / sum(LETTERS) for x in LETTERS]
    chance = [*share, *share, *[0.1] * 10, *[0.25] * 4]
    table = lambda xs: F.array(*[F.lit(math.log(x)) for x in xs])
    place = lambda x: F.when(x < 26, 0).when(x < 52, 1).when(x < 62, 2).otherwise(3)
    shape = F.when(s.rlike("[a-z]"), s).otherwise(F.lower(s))
    at = F.transform(F.filter(F.split(shape, ""), lambda c: c != ""), lambda c: F.instr(F.lit("".join(CLASSES)), c) - 1)
    start = F.struct(F.lit(-math.log(4)).alias("sum"), F.lit(-math.log(4)).alias("camel"), F.lit(-1).alias("last"))

    def add(acc: Column, x: Column) -> Column:
        step = lambda rows: F.when(acc["last"] < 0, 0.0).otherwise(F.get(table([c for row in rows for c in row]), acc["last"] * 4 + place(x)))
        own = F.get(table(chance), x)
        return F.struct((acc["sum"] + step(STEPS) + own).alias("sum"), (acc["camel"] + step(CAMEL_STEPS) + own).alias("camel"), place(x).alias("last"))

    return F.aggregate(at, start, add, lambda acc: F.greatest(acc["sum"], acc["camel"]))


def written_match(s: Column) -> Column:
    """The chance that two characters of `s` agree if it is written, by how many of each class it has."""
    n = F.length(s)
    sizes = [F.length(F.regexp_replace(s, f"[^{c}]", "")) / n for c in ("a-z", "A-Z", "0-9", "+/_-")]
    return sum((x * x * m for x, m in zip(sizes[1:], CLASS_MATCH[1:], strict=True)), sizes[0] * sizes[0] * CLASS_MATCH[0])


def test_battery(candidates: DataFrame) -> DataFrame:
    """Adds encoding, n, chi2, z_runs, z_serial and p to rows with `s`, the candidate's characters."""
    encoding = F.when(F.lit(False), None)
    symbols = F.when(F.lit(False), None)
    for name, (pattern, alphabet) in (PLAIN | ENCODINGS).items():
        encoding = encoding.when(F.col("s").rlike(pattern), name) if pattern else encoding.otherwise(name)
    rows = candidates.withColumn("encoding", encoding)
    for name, (_, alphabet) in (PLAIN | ENCODINGS).items():
        symbols = symbols.when(F.col("encoding") == name, F.lit(alphabet))
    folded = F.when(F.col("encoding").isin(*FOLDED), F.lower("s")).otherwise(F.translate("s", "-_", "+/"))
    rows = rows.withColumn("symbols", symbols).withColumn("t", F.regexp_replace(folded, "=+$", ""))
    rows = rows.withColumn("v", F.expr("transform(filter(split(t, ''), c -> c <> ''), c -> instr(symbols, c) - 1)"))
    rows = rows.withColumn("n", F.size("v").cast("double")).withColumn("k", F.length("symbols").cast("double"))
    squares = F.expr("aggregate(array_distinct(v), 0L, (a, x) -> a + cast(size(filter(v, y -> y = x)) as bigint) * size(filter(v, y -> y = x)))")
    rows = rows.withColumn("chi2", F.col("k") / F.col("n") * squares - F.col("n"))
    # runs above and below the middle of the alphabet
    rows = rows.withColumn("up", F.expr("size(filter(v, x -> 2 * x + 1 > k))").cast("double")).withColumn("runs", F.expr("1 + aggregate(sequence(1, size(v) - 1), 0, (a, i) -> a + if((2 * v[i] + 1 > k) <> (2 * v[i - 1] + 1 > k), 1, 0))").cast("double"))
    ups, downs, n = F.col("up"), F.col("n") - F.col("up"), F.col("n")
    mean = 1 + 2 * ups * downs / n
    var = F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9))
    rows = rows.withColumn("z_runs", (F.col("runs") - mean) / F.sqrt(var))
    rows = rows.withColumn("sum1", F.expr("aggregate(v, 0L, (a, x) -> a + x)").cast("double")).withColumn("sum2", F.expr("aggregate(v, 0L, (a, x) -> a + x * x)").cast("double"))
    rows = rows.withColumn("lagged", F.expr("aggregate(sequence(1, size(v) - 1), 0L, (a, i) -> a + v[i] * v[i - 1]) + v[0] * v[size(v) - 1]").cast("double"))
    spread = n * F.col("sum2") - F.col("sum1") * F.col("sum1")
    r = F.when(spread > 0, (n * F.col("lagged") - F.col("sum1") * F.col("sum1")) / F.greatest(spread, F.lit(1e-9))).otherwise(1.0)
    rows = rows.withColumn("z_serial", (r + 1 / (n - 1)) * F.sqrt(n))
    match = written_match(F.regexp_replace("s", "=+$", ""))
    for name, chance in WRITTEN_MATCH.items():
        match = F.when(F.col("encoding") == name, chance).otherwise(match)
    excess = n * F.greatest(F.col("k") * match - 1, F.lit(0.0))
    ratio = F.exp(F.least(written_log_chance(F.regexp_replace("s", "=+$", "")) + n * F.log("k"), F.lit(0.0)))
    ratio = F.when(F.col("encoding") == "decimal", 1.0).otherwise(ratio)  # digits of written numbers are even enough
    z = (F.col("chi2") - (F.col("k") - 1 + excess)) / F.sqrt(2 * (F.col("k") - 1) + 4 * excess)
    df = F.col("k") - 1
    uneven = (F.pow(F.col("chi2") / df, 1 / 3) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))  # Wilson and Hilferty
    random_order = (uneven <= TEST_ALPHA_Z) & (F.abs("z_runs") <= TEST_ALPHA_Z) & (F.abs("z_serial") <= TEST_ALPHA_Z)
    return rows.withColumn("p", F.when(random_order, F.least(2 * F.least(lower_tail(z), ratio), F.lit(1.0))).otherwise(1.0))


def length_class(n: Column) -> Column:
    return F.when(n < 24, 20).when(n < 32, 24).when(n < 48, 32).when(n < 64, 48).otherwise(64)


def discoveries(tested: DataFrame, q: float = FALSE_DISCOVERY) -> DataFrame:
    """The rows that Benjamini-Hochberg control at `q` accepts within their encoding and length class."""
    rows = tested.withColumn("class", length_class(F.col("n"))).withColumn("bin", F.greatest(F.ceil(F.log10(F.greatest("p", F.lit(1e-300))) * BINS), F.lit(-300 * BINS)).cast("int"))
    bins = rows.groupBy("encoding", "class", "bin").agg(F.count(F.lit(1)).alias("c"))  # at most encodings x classes x bins rows
    by = W.partitionBy("encoding", "class")
    bins = bins.withColumn("upto", F.sum("c").over(by.orderBy("bin"))).withColumn("m", F.sum("c").over(by))
    cuts = bins.where(F.pow(F.lit(10.0), F.col("bin") / F.lit(float(BINS))) <= F.col("upto") / F.col("m") * q).groupBy("encoding", "class").agg(F.max("bin").alias("cut"))
    # cuts: at most encodings x classes rows
    return rows.join(F.broadcast(cuts), ["encoding", "class"]).where(F.col("bin") <= F.col("cut"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base spans and all spans as arrays of (start, kind, end) for every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), text.alias("text"))
    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    slim = slim.select("doc_id", "row", plain(F.concat(*[pattern_spans(F.col("text"), k, *v) for k, v in BASE.items()])).alias("base"), pattern_spans(F.col("text"), ADDED, CANDIDATE, 0, 20).alias("more"))
    # only spans and the candidates' own characters are kept
    slim = slim.withColumn("more", F.transform(_apart(F.col("more"), F.col("base")), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["s"].alias("s"))))
    slim = materialize(slim, "secret-spans")
    candidates = slim.where(F.size("more") > 0).select("row", F.explode("more").alias("m")).select("row", "m.start", "m.end", "m.s")
    found = discoveries(test_battery(candidates)).groupBy("row").agg(F.collect_list(F.struct("start", F.lit(ADDED).alias("kind"), "end")).alias("added"))
    none = F.array().cast("array<struct<start:int,kind:string,end:int>>")
    return slim.join(found, "row", "left").select("doc_id", "base", F.concat("base", F.coalesce("added", none)).alias("spans"))


def secret_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return scan(docs).select("doc_id", *map(count, BASE), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def sql() -> str:
    """DuckDB's form of secret_digest's columns with the tests as they were first built: one chi-squared null for all
    encodings (0.5 an excess at least), no likelihood ratio, and no candidates without both a digit and a letter. Base
    matches are the same; `spans` may lack random keys that secret_digest has."""
    quote = lambda p: p.replace("'", "''")
    kinds = [(k, *v) for k, v in BASE.items()] + [(ADDED, CANDIDATE, 0, 20)]
    found = " UNION ALL ".join(
        f"SELECT r, '{k}' AS kind, {i} AS rank, string_split_regex(t, '{quote(p)}') AS g, regexp_extract_all(t, '{quote(p)}', 0) AS f, regexp_extract_all(t, '{quote(p)}', {group}) AS k, {least} AS least FROM d" for i, (k, p, group, least) in enumerate(kinds)
    )
    encoding = " ".join(f"WHEN regexp_matches(s, '{p}') THEN '{e}'" if p else f"ELSE '{e}'" for e, (p, _) in ENCODINGS.items())
    symbols = " ".join(f"WHEN '{e}' THEN '{a}'" for e, (_, a) in ENCODINGS.items())
    tail = f"(1 - exp(-1.4 * x)) * exp(-x * x / 2) / ({1.135 * math.sqrt(2 * math.pi)!r}::DOUBLE * x)"
    text = "COALESCE(string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, rank), '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, COALESCE(text, '') AS t FROM documents),
x AS ({found}),
p AS (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM x WHERE len(f) > 0),
s AS (SELECT r, kind, rank, (list_sum(list_transform(g[1:i], lambda y: length(y))) + COALESCE(list_sum(list_transform(f[1:i - 1], lambda y: length(y))), 0))::BIGINT AS st, length(f[i]) AS n, f[i] AS s FROM p WHERE length(k[i]) >= least),
a AS (SELECT r, kind, rank, st, st + n AS en, s FROM s),
c AS (SELECT r, st, en, s FROM a WHERE kind = '{ADDED}' AND regexp_matches(s, '[0-9]') AND regexp_matches(s, '[A-Za-z]') AND NOT EXISTS (SELECT 1 FROM a b WHERE b.r = a.r AND b.kind <> '{ADDED}' AND b.st < a.en AND a.st < b.en)),
e AS (SELECT *, CASE {encoding} END AS encoding FROM c),
y AS (SELECT *, CASE encoding {symbols} END AS symbols, regexp_replace(CASE WHEN encoding IN ('hex', 'base36') THEN lower(s) ELSE translate(s, '-_', '+/') END, '=+$', '') AS t FROM e),
v AS (SELECT *, list_transform(range(1, length(t) + 1), lambda i: instr(symbols, substr(t, i::INT, 1)) - 1) AS v, length(t)::DOUBLE AS n, length(symbols)::DOUBLE AS k FROM y),
q AS (SELECT *, k / n * list_sum(list_transform(list_distinct(v), lambda a: len(list_filter(v, lambda b: a = b)) * len(list_filter(v, lambda b: a = b))))::DOUBLE - n AS chi2,
  len(list_filter(v, lambda a: 2 * a + 1 > k))::DOUBLE AS ups,
  1 + list_sum(list_transform(range(2, len(v) + 1), lambda i: CASE WHEN (2 * v[i] + 1 > k) <> (2 * v[i - 1] + 1 > k) THEN 1 ELSE 0 END))::DOUBLE AS runs,
  list_sum(v)::DOUBLE AS s1, list_sum(list_transform(v, lambda a: a * a))::DOUBLE AS s2, (list_sum(list_transform(range(2, len(v) + 1), lambda i: v[i] * v[i - 1])) + v[1] * v[len(v)])::DOUBLE AS lagged, n * greatest(k * {WORD_MATCH}::DOUBLE - 1, 0.5::DOUBLE) AS excess FROM v),
w AS (SELECT *, 1 + 2 * ups * (n - ups) / n AS mean, n * s2 - s1 * s1 AS spread FROM q),
z AS (SELECT *, (runs - mean) / sqrt(greatest((mean - 1) * (mean - 2) / (n - 1), 1e-9)) AS z_runs, (CASE WHEN spread > 0 THEN (n * lagged - s1 * s1) / greatest(spread, 1e-9) ELSE 1 END + 1 / (n - 1)) * sqrt(n) AS z_serial,
  (chi2 - (k - 1 + excess)) / sqrt(2 * (k - 1) + 4 * excess) AS z FROM w),
h AS (SELECT *, greatest(abs(z), 1e-9) AS x FROM z),
b AS (SELECT r, st, en, encoding, CASE WHEN n < 24 THEN 20 WHEN n < 32 THEN 24 WHEN n < 48 THEN 32 WHEN n < 64 THEN 48 ELSE 64 END AS class,
  greatest(ceil(log10(greatest(CASE WHEN abs(z_runs) <= {TEST_ALPHA_Z} AND abs(z_serial) <= {TEST_ALPHA_Z} THEN least(CASE WHEN z < 0 THEN {tail} ELSE 1 - {tail} END, 1) ELSE 1 END, 1e-300)) * {BINS}), -{300 * BINS})::INT AS bin FROM h),
u AS (SELECT encoding, class, bin, sum(c) OVER (PARTITION BY encoding, class ORDER BY bin) AS upto, sum(c) OVER (PARTITION BY encoding, class) AS m FROM (SELECT encoding, class, bin, count(*) AS c FROM b GROUP BY ALL)),
cut AS (SELECT encoding, class, max(bin) AS cut FROM u WHERE pow(10, bin / {BINS}.0::DOUBLE) <= upto / m * {FALSE_DISCOVERY} GROUP BY ALL),
o AS (SELECT r, kind, rank, st, en FROM a WHERE kind <> '{ADDED}' UNION ALL SELECT r, '{ADDED}', {len(BASE)}, st, en FROM b JOIN cut USING (encoding, class) WHERE bin <= cut),
g AS (SELECT r, {text} AS spans FROM o GROUP BY r),
f AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, {text} AS base FROM a WHERE kind <> '{ADDED}' GROUP BY r)
SELECT doc_id, COALESCE(n_assign, 0)::BIGINT AS n_assign, COALESCE(n_access, 0)::BIGINT AS n_access, COALESCE(n_hex, 0)::BIGINT AS n_hex, sha256(COALESCE(base, '')) AS base_sha256, COALESCE(spans, '') AS spans
FROM d LEFT JOIN f USING (r) LEFT JOIN g USING (r)"""
