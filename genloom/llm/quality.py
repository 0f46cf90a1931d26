"""Quality classification by co-training two views of a document.

The content view sees hashed byte pairs and character and word statistics of the text; the metadata view sees source,
language, lengths and layout. Both start from labelled rows. In each round every document is scored by both views, and
each view's confident documents become training rows of the other, if the view's confidence holds on rows kept aside.
The views are calibrated on the rows kept aside, combined by a logistic model of their log-odds, and score everything.

Features of all documents are computed once, in Spark, and stored (beside the documents, where those are to be filtered); each
round reads them. The driver only gets rows to train on: at most about twice `max_rows` labelled ones and `max_pseudo`
pseudo-labelled ones for each view and class, chosen by hashes of ids and row numbers at rates that their counts give.

Defined results: a null or empty text has empty features and a score like any; null metadata are a value of their own;
a doc_id labelled more than once has its mean label, rounded; without labels of both classes every document scores 1
and is kept; rows that repeat are scored one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import materialize, ship_by_value
from .shingles import PIECE, mix64, text_buffers, word_hashes

ship_by_value(__name__)

PAIRS, CONTENT = 256, 256 + 7
SOURCES, LANGS, META = 32, 8, 32 + 8 + 5
ROUNDS, CONFIDENT, PRECISE = 3, 0.97, 0.97
KEEP = 0.15  # rejects only what it is 85 % sure of


def _pieces(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, side="right")) - 1)
        yield at, end
        at = end


def content_features(column: pa.Array) -> np.ndarray:
    """A row of CONTENT numbers for each text."""
    data, offsets = text_buffers(column)
    out = np.zeros((len(column), CONTENT), np.float32)
    byte = np.arange(256)
    kind = np.select([(byte >= 65) & (byte <= 90), (byte >= 48) & (byte <= 57), byte == 10, byte <= 32, (byte >= 128) | ((byte >= 97) & (byte <= 122))], [0, 1, 2, 3, 4], 5)
    for a, b in _pieces(offsets):
        sizes = np.diff(offsets[a : b + 1])
        part = data[offsets[a] : offsets[b]]
        doc = np.repeat(np.arange(b - a), sizes)
        if not len(part):
            continue
        pair = (part[:-1].astype(np.int64) * 131 + part[1:].astype(np.int64) * 31) & (PAIRS - 1)
        same = doc[1:] == doc[:-1]
        counts = np.bincount((doc[1:] * PAIRS + pair)[same], minlength=(b - a) * PAIRS).reshape(b - a, PAIRS)
        root = np.sqrt(counts)
        out[a:b, :PAIRS] = root / np.maximum(np.sqrt((root**2).sum(axis=1, keepdims=True)), 1)
        kinds = np.bincount(doc * 6 + kind[part], minlength=(b - a) * 6).reshape(b - a, 6) / np.maximum(sizes[:, None], 1)
        hashes, text = word_hashes(data, offsets[a : b + 1])
        words = np.bincount(text, minlength=b - a)
        own = np.unique(np.column_stack((text.astype(np.uint64), hashes)).view([("d", np.uint64), ("h", np.uint64)]) if len(text) else np.empty(0, [("d", np.uint64), ("h", np.uint64)]))
        distinct = np.bincount(own["d"].astype(np.int64).ravel(), minlength=b - a)
        out[a:b, PAIRS:] = np.column_stack((kinds[:, [0, 1, 3, 5]], distinct / np.maximum(words, 1), sizes / np.maximum(words, 1) / 10, np.log1p(words) / 10))
    return out


def metadata_features(source: pa.Array, lang: pa.Array, n_chars: pa.Array, text: pa.Array) -> np.ndarray:
    """A row of META numbers for each document: hashed source and language, lengths and layout."""
    data, offsets = text_buffers(text)
    sizes = np.diff(offsets)
    feeds = np.concatenate(([0], np.cumsum(data[offsets[0] : offsets[-1]] == 10)))
    lines = feeds[offsets[1:] - offsets[0]] - feeds[offsets[:-1] - offsets[0]] + 1
    out = np.zeros((len(text), META), np.float32)
    for values, width, at in ((source, SOURCES, 0), (lang, LANGS, SOURCES)):
        slot = [crc32(("" if v is None else "=" + str(v)).encode()) % width for v in values.to_pylist()]
        out[np.arange(len(text)), at + np.array(slot, np.int64)] = 1
    told = n_chars.cast(pa.float64()).fill_null(-1).to_numpy(zero_copy_only=False)
    out[:, SOURCES + LANGS :] = np.column_stack((np.log1p(np.maximum(told, 0)), told < 0, np.log1p(sizes), np.log1p(lines), np.log1p(sizes / lines)))
    return out


NEEDED = {"doc_id": "long", "text": "string", "source": "string", "lang": "string", "n_chars": "long"}


def _columns(docs: DataFrame) -> list:
    """The columns of NEEDED; one that is missing is null."""
    return [(F.col(c) if c in docs.columns else F.lit(None)).cast(t) for c, t in NEEDED.items()]


def _small(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _extract(at: list[int], names: list[str]) -> Callable:
    """Adds packed features to each row; `at`: places of the columns of NEEDED. Columns named in `names` are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            text, source, lang, n_chars = (batch.column(i) for i in at[1:])
            features = content_features(text), metadata_features(source, lang, n_chars, text)
            packed = [pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary()) for x in features]
            yield pa.record_batch([*(batch.column(n) for n in names), *packed], names=[*names, "content", "metadata"])

    return run


def feature_table(docs: DataFrame) -> DataFrame:
    """doc_id, row (a number for each row), content, metadata (packed half floats) of every document, stored."""
    rows = docs.select(*[c.alias(n) for c, n in zip(_columns(docs), NEEDED, strict=True)], F.monotonically_increasing_id().alias("row"))
    return materialize(rows.mapInArrow(_extract(list(range(5)), ["doc_id", "row"]), "doc_id long, row long, content binary, metadata binary"), "quality-features")


def document_table(docs: DataFrame) -> DataFrame:
    """feature_table with all columns of the documents, under the names c0, c1, ...; a text goes to Python once."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = docs.select([F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)])
    kinds = [f.dataType for f in own.schema]
    rows, at = own, []
    for c, kind in NEEDED.items():
        held = names[docs.columns.index(c)] if c in docs.columns else None
        if held is None or kinds[names.index(held)].simpleString() not in (kind, "bigint" if kind == "long" else kind):
            rows = rows.withColumn(f"n_{c}", (F.col(held) if held else F.lit(None)).cast(kind))
            held = f"n_{c}"
        at.append(held)
    rows = rows.withColumn("doc_id", F.col(at[0])).withColumn("row", F.monotonically_increasing_id())
    keep = [*names, "doc_id", "row"]
    schema = StructType([*own.schema.fields, *[f for f in rows.schema.fields if f.name in ("doc_id", "row")], StructField("content", BinaryType()), StructField("metadata", BinaryType())])
    places = [rows.columns.index(c) for c in at]
    return materialize(rows.mapInArrow(_extract(places, keep), schema), "quality-documents")


def _unpacked(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float16).reshape(-1, width).astype(np.float64)


@dataclass
class Logistic:
    """Logistic regression with an L2 penalty on standardised features, fitted by Newton's method."""

    penalty: float = 1.0
    mean: np.ndarray = field(default=None)
    scale: np.ndarray = field(default=None)
    weights: np.ndarray = field(default=None)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Logistic:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = np.column_stack((np.ones(len(x)), (x - self.mean) / self.scale))
        weight = np.ones(len(x)) if weight is None else weight
        self.weights = np.zeros(z.shape[1])
        ridge = np.full(z.shape[1], self.penalty)
        ridge[0] = 1e-6
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
            gradient = z.T @ (weight * (y - p)) - ridge * self.weights
            step = np.linalg.solve((z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(ridge), gradient)
            self.weights += step
            if np.abs(step).max() < 1e-6:
                break
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.weights[0] + ((x - self.mean) / self.scale) @ self.weights[1:], -30, 30)


@dataclass
class CoTrained:
    """Two views, their calibrations, and the model that combines them."""

    content: Logistic
    metadata: Logistic
    content_cal: Logistic
    metadata_cal: Logistic
    combined: Logistic

    def views(self, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated log-odds of both views."""
        return self.content_cal.logit(self.content.logit(content)[:, None]), self.metadata_cal.logit(self.metadata.logit(metadata)[:, None])

    def score(self, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.views(content, metadata)
        chance = lambda t: 1 / (1 + np.exp(-t))
        return chance(a), chance(b), chance(self.combined.logit(np.column_stack((a, b))))


def _rank(ids: np.ndarray, salt: int) -> np.ndarray:
    """A number in [0, 1) for each id."""
    with np.errstate(over="ignore"):
        return mix64(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) / 2.0**64


def _confident(model: CoTrained, rates: dict[tuple[str, int], float] | None, salt: int) -> Callable:
    """Counts of confident documents by view and class, or the features of those that the rates choose."""
    edge = float(np.log(CONFIDENT / (1 - CONFIDENT)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int], int] = {}
        for batch in batches:
            content, metadata = _unpacked(batch.column(1).to_pylist(), CONTENT), _unpacked(batch.column(2).to_pylist(), META)
            rank = _rank(batch.column(0).to_numpy(), salt)
            for view, odds in zip(("content", "metadata"), model.views(content, metadata), strict=True):
                for label, sure in ((1, odds >= edge), (0, odds <= -edge)):
                    if rates is None:
                        counts[view, label] = counts.get((view, label), 0) + int(sure.sum())
                    else:
                        chosen = np.flatnonzero(sure & (rank < rates[view, label]))
                        if len(chosen):
                            other = batch.column(2 if view == "content" else 1).take(pa.array(chosen))
                            yield pa.record_batch([pa.array([view] * len(chosen)), pa.array([label] * len(chosen), pa.int64()), pa.array([1] * len(chosen), pa.int64()), other], names=["view", "label", "n", "other"])
        if rates is None and counts:
            keys = list(counts)
            yield pa.record_batch([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int64()), pa.array(list(counts.values()), pa.int64()), pa.array([None] * len(keys), pa.binary())], names=["view", "label", "n", "other"])

    return run


def _platt(odds: np.ndarray, y: np.ndarray) -> Logistic:
    return Logistic(0.1).fit(odds[:, None], y)


def co_train(features: DataFrame, labels: DataFrame, rounds: int = ROUNDS, max_rows: int = 10_000, max_pseudo: int = 1_000) -> CoTrained | None:
    """labels: doc_id, quality (0 or 1). None if there aren't labels of both classes."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("y"))
    total = known.count()
    if not total:
        return None
    rate = min(1.0, max_rows / total)
    some = known.where(F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(1_000_000)) < int(rate * 1_000_000))
    labelled = features.join(F.broadcast(some), "doc_id")  # about max_rows ids, but any number of rows may share one
    share = max_rows / max(1, labelled.count())
    labelled = labelled if share >= 0.5 else labelled.where(F.pmod(F.xxhash64(F.lit(2), "row"), F.lit(1_000_000_000)) < int(share * 1_000_000_000))
    rows = labelled.select("doc_id", "row", "y", "content", "metadata").collect()  # about 2 x max_rows at most
    y = np.array([r["y"] for r in rows], float)
    if len(set(y)) < 2:
        return None
    rows.sort(key=lambda r: (r["doc_id"], r["row"]))
    y = np.array([r["y"] for r in rows], float)
    content, metadata = _unpacked([bytes(r["content"]) for r in rows], CONTENT), _unpacked([bytes(r["metadata"]) for r in rows], META)
    aside = _rank(np.array([r["doc_id"] for r in rows]), 7) < 0.3
    if len(set(y[aside])) < 2 or len(set(y[~aside])) < 2:
        aside = np.zeros(len(y), bool)  # too few rows to keep any aside
    fit, held = ~aside, aside if aside.any() else np.ones(len(y), bool)
    extra = {"content": (np.empty((0, CONTENT)), np.empty(0)), "metadata": (np.empty((0, META)), np.empty(0))}
    model, slim = None, features.select("row", "content", "metadata")
    for turn in range(rounds + 1):
        views = {}
        for view, x in (("content", content), ("metadata", metadata)):
            more, label = extra[view]
            views[view] = Logistic().fit(np.vstack((x[fit], more)), np.concatenate((y[fit], label)), np.concatenate((np.ones(fit.sum()), np.full(len(label), 0.5))))
        a, b = views["content"].logit(content[held]), views["metadata"].logit(metadata[held])
        cal = _platt(a, y[held]), _platt(b, y[held])
        both = np.column_stack((cal[0].logit(a[:, None]), cal[1].logit(b[:, None])))
        model = CoTrained(views["content"], views["metadata"], *cal, Logistic(0.1).fit(both, y[held]))
        if turn == rounds:
            break
        edge = np.log(CONFIDENT / (1 - CONFIDENT))
        trusted = {}
        for view, odds in zip(("content", "metadata"), both.T, strict=True):
            for label, sure in ((1, odds >= edge), (0, odds <= -edge)):
                trusted[view, label] = bool(sure.any()) and (y[held][sure] == label).mean() >= PRECISE
        if not any(trusted.values()):
            break
        schema = "view string, label long, n long, other binary"
        counts = {(r["view"], r["label"]): r["n"] for r in slim.mapInArrow(_confident(model, None, turn), schema).groupBy("view", "label").agg(F.sum("n").alias("n")).collect()}
        rates = {k: min(1.0, max_pseudo / counts[k]) if trusted[k] and counts.get(k) else 0.0 for k in trusted}
        chosen = slim.mapInArrow(_confident(model, rates, turn), schema).collect()  # about 4 x max_pseudo rows at most
        for view, other, width in (("content", "metadata", META), ("metadata", "content", CONTENT)):
            mine = sorted(((bytes(r["other"]), r["label"]) for r in chosen if r["view"] == view))
            if mine:
                extra[other] = _unpacked([m[0] for m in mine], width), np.array([m[1] for m in mine], float)
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """doc_id, p_content, p_metadata, score, keep for every document."""
    features = feature_table(docs)
    model = co_train(features, labels)
    if model is None:
        one = F.lit(1.0)
        return features.select("doc_id", one.alias("p_content"), one.alias("p_metadata"), one.alias("score"), F.lit(True).alias("keep"))
    scored = features.select("doc_id", "content", "metadata").mapInArrow(_score_model(model), "doc_id long, p_content double, p_metadata double, score double")
    return scored.withColumn("keep", F.col("score") >= keep)


def _score_model(model: CoTrained) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = model.score(_unpacked(batch.column(1).to_pylist(), CONTENT), _unpacked(batch.column(2).to_pylist(), META)) if batch.num_rows else [np.empty(0)] * 3
            yield pa.record_batch([batch.column(0), *map(pa.array, parts)], names=["doc_id", "p_content", "p_metadata", "score"])

    return run


def _kept(model: CoTrained, keep: float, n: int) -> Callable:
    """The first n columns of the rows that score at least `keep`; the last two are the features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            score = model.score(_unpacked(batch.column(n).to_pylist(), CONTENT), _unpacked(batch.column(n + 1).to_pylist(), META))[2]
            yield batch.select(list(range(n))).filter(pa.array(score >= keep))

    return run


def keep_quality(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """The rows of `docs`, with all their columns, that the classifier doesn't reject."""
    table = document_table(docs)
    model = co_train(table.select("doc_id", "row", "content", "metadata"), labels)
    n = len(docs.columns)
    own = table.select([f"c{i}" for i in range(n)])
    if model is not None:
        own = table.select([f"c{i}" for i in range(n)] + ["content", "metadata"]).mapInArrow(_kept(model, keep, n), own.schema)
    return own.select([F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
