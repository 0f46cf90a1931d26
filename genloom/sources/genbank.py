"""GenBank flat files as features and sequences, and features as genes.

Files hold one or more records. They are scanned as text whose line end is a record's end (`//` on its own line), so Spark splits
a large file by bytes and each task takes the records that begin in its part. A record's features are parsed in Arrow batches
from the text before its DNA; the DNA is cut out by column functions and isn't read where no one asks for rows of sequences.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema
from ..functions import sequence
from ..operators import ordered

cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUALIFIERS = ("locus_tag", "gene", "gene_synonym", "protein_id", "translation", "product", "protocluster_number", "note")
_SPAN = re.compile(r"<?(\d+)(?:\.\.>?(\d+))?")


def parse_records(text: str) -> Iterator[dict]:
    """Each record: name, seq, and features (type, 0-based half-open span, strand, qualifiers)."""
    for raw in re.split(r"^//\s*$", text, flags=re.M):
        if "LOCUS" not in raw:
            continue
        head, _, origin = raw.partition("\nORIGIN")
        name = re.search(r"^(?:VERSION|LOCUS)\s+(\S+)", head, re.M)
        version = re.search(r"^VERSION\s+(\S+)", head, re.M)
        _, _, table = head.partition("\nFEATURES")
        features, now, key = [], None, None
        for line in table.splitlines()[1:]:
            if line[:5] == "     " and line[5:6].strip():
                now, key = {"type": line[5:21].strip(), "where": line[21:].strip(), "q": {}}, None
                features.append(now)
            elif now is not None and line.startswith(" " * 21):
                body = line[21:].rstrip()
                if body.startswith("/"):
                    key, _, value = body[1:].partition("=")
                    now["q"].setdefault(key, value.strip('"'))
                elif key is None:
                    now["where"] += body.strip()
                else:
                    now["q"][key] += ("" if key == "translation" else " ") + body.strip().strip('"')
        for f in features:
            spans = [(int(a), int(b or a)) for a, b in _SPAN.findall(f["where"])]
            f["start"], f["end"] = (min(a for a, _ in spans) - 1, max(b for _, b in spans)) if spans else (0, 0)
            f["strand"] = "-" if "complement" in f["where"] else "+"
        yield {"name": (version or name)[1], "seq": re.sub(r"[^a-zA-Z]", "", origin).upper(), "features": features}


COLUMNS = "genome_id string, scaffold_id string, ord int, type string, start int, end int, strand string, seq string, pseudo boolean, " + ", ".join(f"{q} string" for q in QUALIFIERS)
#: Lines that name a record; the last of the best kind counts.
NAME = r"(?m)^{}[ \t]+(\S+)"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [f.split() for f in COLUMNS.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    schema = pa.schema([(n, kinds[k]) for n, k in fields])
    for batch in batches:
        out = []
        for genome, head in zip(batch["genome_id"].to_pylist(), batch["head"].to_pylist(), strict=True):
            for record in parse_records(head):
                for i, f in enumerate(record["features"]):
                    out.append((genome, record["name"], i, f["type"], f["start"], f["end"], f["strand"], None, "pseudo" in f["q"] or "pseudogene" in f["q"], *[f["q"].get(k) for k in QUALIFIERS]))
        for at in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[at : at + 10_000], strict=True), schema, strict=True)], schema=schema)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """genome_id (the file's name), head, origin of every record: its text before and from the DNA on."""
    rows = spark.read.option("lineSep", "\n//").text(path).select(F.regexp_extract("_metadata.file_path", r"([^/]*?)(?:\.[^./]*)?$", 1).alias("genome_id"), "value")
    rows = rows.where(F.col("value").contains("LOCUS"))
    at = F.locate("\nORIGIN", F.col("value"))
    return rows.select("genome_id", F.when(at > 0, F.substring("value", F.lit(1), at - 1)).otherwise(F.col("value")).alias("head"), F.when(at > 0, F.substring("value", at + len("\nORIGIN"), F.length("value"))).otherwise("").alias("origin"))


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    """Features of all records, and a row of type `sequence` for each record with its DNA."""
    records = read_records(spark, path)
    features = records.select("genome_id", "head").mapInArrow(_features, COLUMNS)
    version, locus = (F.regexp_extract("head", NAME.format(x), 1) for x in ("VERSION", "LOCUS"))
    seq = F.upper(F.regexp_replace("origin", "[^a-zA-Z]", ""))
    none = [F.lit(None).cast("string").alias(q) for q in QUALIFIERS]
    named = records.select("genome_id", F.when(version != "", version).otherwise(locus).alias("scaffold_id"), F.lit(-1).alias("ord"), F.lit("sequence").alias("type"), F.lit(0).alias("start"), seq.alias("seq"))
    whole = named.select("genome_id", "scaffold_id", "ord", "type", "start", F.length("seq").alias("end"), F.lit("+").alias("strand"), "seq", F.lit(False).alias("pseudo"), *none)
    return features.unionByName(whole)


def scaffolds(features: DataFrame) -> DataFrame:
    return features.where("type = 'sequence'").select("genome_id", "scaffold_id", "seq")


def external_clusters(features: DataFrame) -> DataFrame:
    """Known clusters from features of type protocluster, or cluster: genome, contig, number, product, span."""
    rows = features.where(F.col("type").isin("protocluster", "cluster"))
    number = F.coalesce("protocluster_number", F.regexp_extract(F.coalesce("note", F.lit("")), r"[Cc]luster number: (\d+)", 1))
    return rows.select("genome_id", F.col("scaffold_id").alias("contig"), F.concat_ws("_", "genome_id", "scaffold_id", number).alias("ext_id"), "product", "start", "end")


def slices(spans: DataFrame, features: DataFrame) -> DataFrame:
    """(genome_id, scaffold_id, key, seq): the part of its scaffold's DNA of each span. spans: genome_id, scaffold_id, key,
    start, end. A scaffold's spans are gathered beside its one sequence, so the DNA is moved once, not once for each span."""
    listed = spans.groupBy("genome_id", "scaffold_id").agg(F.collect_list(F.struct("key", "start", "end")).alias("_spans"))
    joined = scaffolds(features).join(listed, ["genome_id", "scaffold_id"])
    cut = F.transform("_spans", lambda s: F.struct(s["key"].alias("key"), F.substring(F.col("seq"), s["start"] + 1, s["end"] - s["start"]).alias("seq")))
    return joined.select("genome_id", "scaffold_id", F.explode(cut).alias("_s")).select("genome_id", "scaffold_id", "_s.key", "_s.seq")


def genes(features: DataFrame, min_aa: int = 5, max_aa: int = 100, keep_pseudo: bool = True) -> DataFrame:
    """Gene rows: coding features, and pseudo `gene` records unless the next record of that name is a tRNA or rRNA; a
    coding feature wins over a gene record on the same place. A missing translation is made from the DNA."""
    label = F.coalesce("locus_tag", "gene", F.lit(""))
    after = W.partitionBy("genome_id", "scaffold_id", label).orderBy("ord")
    rows = features.where(F.col("type").isin("CDS", "gene", "tRNA", "rRNA")).withColumn("_next", F.lead("type").over(after))
    pseudo = (F.col("type") == "gene") & F.col("pseudo") & ~F.coalesce(F.col("_next").isin("tRNA", "rRNA"), F.lit(False)) & F.lit(keep_pseudo)
    rows = rows.where((F.col("type") == "CDS") | pseudo)
    first = F.row_number().over(W.partitionBy("genome_id", "scaffold_id", "start", "end", "strand").orderBy(F.when(F.col("type") == "CDS", 0).otherwise(1), "ord"))
    rows = rows.withColumn("_first", first).where("_first = 1").drop("seq")
    untranslated = rows.where("translation is null").select("genome_id", "scaffold_id", F.col("ord").alias("key"), "start", "end")
    dna = slices(untranslated, features).withColumnRenamed("key", "ord")
    rows = rows.join(dna, ["genome_id", "scaffold_id", "ord"], "left")
    made = F.regexp_replace(sequence.translate_dna(F.when(F.col("strand") == "-", sequence.rev_comp(F.col("seq"))).otherwise(F.col("seq")), True), r"\*$", "")
    rows = rows.withColumn("transl", F.coalesce("translation", made)).drop("seq")
    clean = lambda c: F.when(F.lower(F.trim(c)) != "none", F.translate(F.trim(c), "| ", ""))
    name = F.coalesce(clean(F.col("locus_tag")), clean(F.col("gene")))
    synonym = clean(F.split("gene_synonym", ";")[0])
    number = F.row_number().over(W.partitionBy("genome_id").orderBy("scaffold_id", "start", "end", "ord"))
    rows = rows.withColumn("_name", name).withColumn("_n", number)
    uses = rows.where("_name is not null").groupBy("_name").agg(F.count(F.lit(1)).alias("_uses"))  # unnamed genes stay where they are
    rows = rows.join(uses, "_name", "left")
    made_name = F.concat(F.col("genome_id"), F.lit("_gene_"), F.col("_n").cast("string"))
    gene_id = F.when((F.col("_uses") == 1) & F.col("_name").isNotNull() & (F.col("_name") != F.col("scaffold_id")), F.col("_name")).otherwise(F.coalesce(synonym, made_name))
    rows = rows.withColumn("gene_id", gene_id).withColumn("_again", F.row_number().over(W.partitionBy("gene_id").orderBy("_n")))
    rows = rows.withColumn("gene_id", F.when(F.col("_again") > 1, made_name).otherwise(F.col("gene_id")))
    n = F.length("transl")
    return rows.select("gene_id", "genome_id", "scaffold_id", "start", "end", "strand", "transl", "pseudo", (n.between(min_aa, max_aa) & ~F.col("pseudo")).alias("svm_candidate"), F.lit(False).alias("svm_hit"), F.lit(False).alias("intergenic"), F.lit(None).cast("double").alias("cog"))


def intergenic(features: DataFrame, overlap: int = 20, scan_tail: bool = False) -> DataFrame:
    """DNA between features (with some overlap into them): from the end of the one before to the start of each; the tail
    after the last only if asked for."""
    rows = features.where(F.col("type").isin("CDS", "tRNA", "rRNA")).select("genome_id", "scaffold_id", "start", "end", "ord")
    sizes = scaffolds(features).select("genome_id", "scaffold_id", F.length("seq").alias("size"))
    order = W.partitionBy("genome_id", "scaffold_id").orderBy("start", "ord")
    gaps = rows.select("genome_id", "scaffold_id", F.coalesce(F.lag("end").over(order), F.lit(0)).alias("lo"), F.col("start").alias("hi"))
    gaps = gaps.join(sizes, ["genome_id", "scaffold_id"])
    if scan_tail:
        last = rows.groupBy("genome_id", "scaffold_id").agg(F.max_by("end", F.struct("start", "ord")).alias("lo"))
        gaps = gaps.unionByName(last.join(sizes, ["genome_id", "scaffold_id"]).select("genome_id", "scaffold_id", "lo", F.col("size").alias("hi"), "size"))
    lo, hi = F.greatest(F.col("lo") - overlap, F.lit(0)), F.least(F.col("hi") + overlap, F.col("size"))
    gaps = gaps.where("hi > lo").select("genome_id", "scaffold_id", lo.alias("gap_start"), hi.alias("gap_end"))
    place = F.row_number().over(W.partitionBy("genome_id", "scaffold_id").orderBy("gap_start"))
    gaps = gaps.withColumn("gap_id", F.concat_ws("_", "genome_id", "scaffold_id", F.lpad(place.cast("string"), 6, "0")))
    spans = gaps.select("genome_id", "scaffold_id", F.struct("gap_id", "gap_start").alias("key"), F.col("gap_start").alias("start"), F.col("gap_end").alias("end"))
    return slices(spans, features).select("genome_id", "scaffold_id", F.col("key.gap_start").alias("gap_start"), "seq", F.col("key.gap_id").alias("gap_id"))


def short_orfs(features: DataFrame, min_aa: int = 5, max_aa: int = 100, overlap: int = 20) -> DataFrame:
    """Short reading frames between features, in the scaffold's coordinates; those contained in a longer one that shares
    an end are dropped."""
    from ..operators.intervals import drop_contained

    gaps = intergenic(features, overlap)
    found = sequence.orf_scan(gaps, "gap_id", "seq", min_aa, max_aa).join(gaps.drop("seq"), "gap_id")
    rows = found.select("genome_id", "scaffold_id", (F.col("start") + F.col("gap_start")).alias("start"), (F.col("end") + F.col("gap_start")).alias("end"), "strand", F.col("peptide").alias("transl")).distinct()
    kept = drop_contained(rows, ["genome_id", "scaffold_id", "strand"], "start", "end")
    return kept.withColumn("gene_id", F.concat_ws("_", "genome_id", "scaffold_id", F.lit("orf"), F.col("start").cast("string"), F.col("end").cast("string"), F.when(F.col("strand") == "+", "p").otherwise("m")))


def with_flanks(gene_rows: DataFrame) -> DataFrame:
    return ordered.flanks(gene_rows, ["genome_id", "scaffold_id"], "start", "end", "gene_id", F.col("intergenic"))


GENE_COLUMNS = [c.split()[0] for c in schema.GENE.split(", ")]
