"""WARC archives with a globally ordered capture index, built by an external merge of sorted runs.

Writing: one record per page, as a Spark text sink whose line end closes each record (records end in two CRLF); pages with
equal payloads are written once, the others as revisits of the smallest page_id. Archives are bounded by bytes: pages are
written in classes of payload size, with fewer records to a file the larger they may be. Reading: each archive is parsed by
Content-Length and yields its captures sorted by (URL key, time, id): a run. Merging: the runs' captures are dealt to key
ranges (splitters on the whole sort key, then the run and the place in it, so captures that are alike span ranges, too), and each range merges its segment of
every run with a loser tree. Ranges follow each other in key order, so (merge_range, merge_pos) is a global order, and
capture_pos numbers it without gaps.

Defined results: a null html is an empty payload; a null url gives an empty URL key; a null page_id is written as `null`, read
back as null, and sorts last, so it is only a response if no page with the payload has an id; of rows that share the smallest
page_id and the payload one is the response and the others revisit it; rows that repeat are all written; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, scratch_path, ship_by_value

ship_by_value(__name__)

B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
EPOCH = "2024-01-01 00:00:00"
RANGE_ROWS = 50_000
#: Bytes of a payload up to which a class of archives goes, with so many records to a file: 64 MB, or one record.
FILE_BYTES = 1 << 26
CLASSES = (1 << 14, 1 << 18, 1 << 22, None)
CAPTURE = "page_id long, url string, url_key string, captured string, record_type string, refers_to long, payload_bytes long, payload_digest string, run string, seq long"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in bare upper-case base32, without Python: 20 bits (5 hex digits) give 4 letters."""
    hexed = F.sha1(payload)
    letters = []
    for i in range(8):
        v = F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(B32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def url_key(url: Column) -> Column:
    """Sort key of a URL: its host's labels reversed, then `)` and the rest, ASCII lower-cased without scheme or fragment."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), "#.*$", ""), r"^[^:/?#]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^[^/?]*", 0))
    return F.when(bare == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_replace(bare, r"^[^/?]*", "")))


def plan_records(pages: DataFrame) -> DataFrame:
    """(d, first_id, n, firsts) of every payload: its digest, the smallest page_id, and how many pages have it and that id;
    copies collapse before the shuffle."""
    slim = pages.select("page_id", base32_sha1(F.coalesce(F.col("html"), F.lit(""))).alias("d")).groupBy("d", "page_id").agg(F.count(F.lit(1)).alias("c"))
    return slim.groupBy("d").agg(F.min("page_id").alias("first_id"), F.sum("c").alias("n"), F.min_by("c", F.struct(F.col("page_id").isNull(), "page_id")).alias("firsts"))


def write_archives(pages: DataFrame, path: str, most_broadcast: int = 1_000_000) -> None:
    """Write `pages` (page_id, url, html) as WARC/1.1 files under `path`. A page whose payload another page with a
    smaller id has too is a revisit: a record without payload, that names the response, the digest and the size."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    shared = materialize(plan_records(pages).where("n > 1"), "warc-shared")
    repeated = shared.where("firsts > 1")
    number = F.monotonically_increasing_id()
    if not repeated.isEmpty():  # ids repeat: number the rows, so that one of them can be named the response
        pages = materialize(pages.select("page_id", "url", "html", number.alias("number")), "warc-numbered")
        number = F.col("number")
        alike = pages.select(base32_sha1(payload).alias("d"), "page_id", "number").join(repeated.select("d", F.col("first_id").alias("f")), "d").where(F.col("page_id").eqNullSafe(F.col("f")))
        shared = materialize(shared.join(alike.groupBy("d").agg(F.min("number").alias("first_number")), "d", "left"), "warc-shared")
    else:
        shared = shared.withColumn("first_number", F.lit(None).cast("long"))
    shared = shared.select("d", "first_id", "first_number", F.lit(True).alias("common"))
    rows = pages.select("page_id", "url", payload.alias("payload"), base32_sha1(payload).alias("digest"), number.alias("number"))
    sizes = {r["c"] for r in pages.select(_size_class(F.octet_length(payload)).alias("c")).distinct().collect()}
    if shared.count() <= most_broadcast:
        rows = rows.join(F.broadcast(shared), rows.digest == shared.d, "left")
    else:  # only ids and digests are shuffled by digest, with a salt, as one payload may be very frequent
        salts = F.explode(F.sequence(F.lit(0), F.lit(15)))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "number"), F.lit(16)).cast("int"))
        rows = rows.join(shared.withColumn("s", salts), (rows.digest == shared.d) & (F.col("salt") == F.col("s")), "left")
    is_first = F.when(F.col("first_number").isNotNull(), F.col("first_number") == F.col("number")).otherwise(F.col("page_id").eqNullSafe(F.col("first_id")))
    revisit = F.coalesce(F.col("common") & ~is_first, F.lit(False))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    clock = F.expr(f"cast(timestamp_ntz'{EPOCH}' + make_dt_interval(0, 0, 0, pmod(coalesce(page_id, 0), 1000000000)) as string)")
    when = F.concat(F.regexp_replace(clock, " ", "T"), F.lit("Z"))  # pages have no time of their own: one second for each id
    head = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.concat(F.lit("WARC-Date: "), when),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("X-Payload-Bytes: "), F.octet_length("payload").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("first_id")))),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    ]
    record = F.concat(F.concat_ws("\r\n", *head), F.lit("\r\n\r\n"), body, F.lit("\r\n\r"))
    for c in sorted(sizes or {0}):  # most tables have one class; the others are filtered by size as they are read
        most = CLASSES[c]
        some = rows.where(_size_class(F.octet_length("payload")) == c).select(record.alias("value"))
        some.write.mode("append").option("lineSep", "\n").option("maxRecordsPerFile", max(1, FILE_BYTES // most) if most else 1).text(path)


def _size_class(size: Column) -> Column:
    found = F.lit(len(CLASSES) - 1)
    for i, most in reversed(list(enumerate(CLASSES[:-1]))):
        found = F.when(size <= most, i).otherwise(found)
    return found


def parse_archive(data: bytes) -> Iterator[dict]:
    """The records of one archive, by their Content-Length."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
        size = int(head["Content-Length"])
        body = data[end + 4 : end + 4 + size]
        number = lambda name: None if name in (None, "<urn:page:null>") else int(name[10:-1])
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        revisit = head["WARC-Type"] == "revisit"
        if not revisit and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
            raise ValueError(f"payload of {head['WARC-Record-ID']} doesn't have its digest")
        yield {
            "page_id": number(head["WARC-Record-ID"]), "url": head["WARC-Target-URI"], "captured": head["WARC-Date"], "record_type": head["WARC-Type"],
            "refers_to": number(head.get("WARC-Refers-To")), "payload_bytes": int(head["X-Payload-Bytes"]) if revisit else size, "payload_digest": digest,
        }
        at = end + 4 + size + 4


def _surt(url: str) -> str:
    bare = url.split("#", 1)[0]
    head, sep, rest = bare.partition("://")
    bare = rest if sep and not any(c in head for c in ":/?#") else bare
    if not bare:
        return ""
    cut = min((i for i in (bare.find("/"), bare.find("?")) if i >= 0), default=len(bare))
    return ",".join(reversed(bare[:cut].lower().split("."))) + ")" + bare[cut:]


def _sort_key(r: dict) -> tuple:
    return r["url_key"], r["captured"], r["page_id"] is None, r["page_id"] or 0


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each archive's captures as a sorted run."""
    schema = _arrow_schema()
    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows = [r | {"url_key": _surt(r["url"])} for r in parse_archive(data.as_buffer().to_pybytes())]
            rows.sort(key=_sort_key)
            run = hashlib.md5(path.rsplit("/", 1)[-1].encode()).hexdigest()
            for i, r in enumerate(rows):
                r |= {"run": run, "seq": i}
            if rows:
                yield from pa.Table.from_pylist(rows, schema).to_batches(8_192)


def _arrow_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(n, kinds[t]) for n, t in (f.split() for f in CAPTURE.split(", "))])


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of every archive under `path`; `run` names the archive's run and `seq` the place in it."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content").mapInArrow(_runs, CAPTURE)


def loser_tree_merge(runs: list[list[tuple]]) -> Iterator[tuple[int, int]]:
    """(run, place in it) in key order. Inner nodes hold the loser of their match, tree[0] the winner; after the
    winner is given out, only the matches on its path to the root are played again. Runs end in a key above all."""
    k = len(runs)
    at = [0] * k
    beats = lambda a, b: a != b and (b == -1 or (at[b] >= len(runs[b]), () if at[b] >= len(runs[b]) else runs[b][at[b]], b) > (at[a] >= len(runs[a]), () if at[a] >= len(runs[a]) else runs[a][at[a]], a))
    tree = [-1] * max(k, 1)
    def play(leaf: int) -> None:
        winner, node = leaf, (leaf + k) // 2
        while node > 0:
            if tree[node] == -1:
                tree[node] = winner
                return
            if beats(tree[node], winner):
                tree[node], winner = winner, tree[node]
            node //= 2
        tree[0] = winner
    for leaf in range(k):
        play(leaf)
    while k and at[tree[0]] < len(runs[tree[0]]):
        w = tree[0]
        yield w, at[w]
        at[w] += 1
        winner, node = w, (w + k) // 2
        while node > 0:
            if beats(tree[node], winner):
                tree[node], winner = winner, tree[node]
            node //= 2
        tree[0] = winner


def _merge_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]  # one range: about RANGE_ROWS captures
    if not held:
        return
    table = pa.Table.from_batches(held)
    run = table["run"].combine_chunks().dictionary_encode()
    codes, seq = run.indices.to_numpy(), table["seq"].to_numpy()
    order = np.lexsort((seq, codes))  # back to whole segments: run by run, each in its own order
    table = table.take(order)
    ids = table["page_id"].to_pylist()
    keys = [(u, t, i is None, i or 0) for u, t, i in zip(table["url_key"].to_pylist(), table["captured"].to_pylist(), ids, strict=True)]
    starts = np.flatnonzero(np.diff(codes[order], prepend=-1)).tolist() + [len(keys)]
    merged = [starts[r] + i for r, i in loser_tree_merge([keys[a:b] for a, b in zip(starts, starts[1:], strict=False)])]
    table = table.take(merged).append_column("merge_pos", pa.array(np.arange(len(merged), dtype=np.int64)))
    yield from table.to_batches(8_192)


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Captures in global order by (merge_range, merge_pos): URL key, time, id, then run and place."""
    ranges = max(1, -(-runs.count() // range_rows))
    dealt = runs.repartitionByRange(ranges, "url_key", "captured", F.col("page_id").asc_nulls_last(), "run", "seq").withColumn("merge_range", F.spark_partition_id())
    return dealt.mapInArrow(_merge_range, CAPTURE + ", merge_range int, merge_pos long")


def capture_index(pages: DataFrame) -> DataFrame:
    """Write `pages` to archives, read them back, and return the merged capture index, in which `capture_pos` is a capture's
    place in the global order by (URL key, time, id), from 0."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages.select("page_id", "url", "html"), path)
    merged = materialize(merge_runs(materialize(read_runs(spark, path), "warc-runs")), "warc-index")
    before = W.orderBy("merge_range").rowsBetween(W.unboundedPreceding, -1)  # one row for RANGE_ROWS captures
    starts = merged.groupBy("merge_range").agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).select("merge_range", "start")
    return merged.join(F.broadcast(starts), "merge_range").withColumn("capture_pos", F.col("start") + F.col("merge_pos")).drop("start")


SQL = """
WITH p AS (SELECT page_id, url, COALESCE(html, '') AS h, sha1(COALESCE(html, '')) AS x, row_number() OVER () AS r FROM pages),
b AS (SELECT *, regexp_replace(regexp_replace(COALESCE(url, ''), '#.*$', ''), '^[^:/?#]*://', '') AS bare FROM p),
k AS (SELECT *, CASE WHEN bare = '' THEN '' ELSE array_to_string(list_reverse(string_split(lower(regexp_extract(bare, '^[^/?]*')), '.')), ',') || ')' || regexp_replace(bare, '^[^/?]*', '') END AS url_key,
  strftime(TIMESTAMP '2024-01-01' + to_seconds((((COALESCE(page_id, 0) % 1000000000) + 1000000000) % 1000000000)), '%Y-%m-%dT%H:%M:%SZ') AS captured FROM b),
f AS (SELECT *, first_value(r) OVER w AS first_r, first_value(page_id) OVER w AS first_id, row_number() OVER (ORDER BY url_key, captured, page_id NULLS LAST) - 1 AS capture_pos FROM k WINDOW w AS (PARTITION BY x ORDER BY page_id NULLS LAST, r))
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(x, (i // 4)::INT * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN r = first_r THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN r = first_r THEN NULL ELSE first_id END AS refers_to, url_key, captured, capture_pos
FROM f
"""
