"""Quality by regularised quadratic discriminant analysis.

Each text becomes a vector of statistics of its bytes, words and repetitions,
put through logarithms so that each class is roughly Gaussian. A class has its
mean and a covariance shrunk towards its diagonal and a share of the pooled
covariance; its Cholesky factor is computed once and kept. A text's score is the
logistic of the difference of the two log-densities (Mahalanobis distance,
log-determinant, prior), divided by a temperature that keeps scores off 0 and 1.

The classifier is fitted on at most SAMPLE labelled rows, those of the smallest
hash of doc_id; scoring covers every text whole and only reads it.

Edge cases: a null text is an empty one and is scored like any; a null label,
a label other than 0 or 1 and a null doc_id teach nothing; repeated labels of a
doc_id count by their largest value, and one row of a doc_id teaches; repeated rows
are scored alike; if a class has no example the score is the prior share of label 1
(0.5 without any label), and keep_good, which can tell nothing apart, keeps all;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .runtime import prepare, tidy

SAMPLE = 20_000
SHRINK, POOL, FLOOR = 0.1, 0.1, 1e-4
_KINDS = ("upper", "lower", "digit", "space", "newline", "stop", "shout", "symbol", "beyond")


def _kind_of_byte() -> np.ndarray:
    out = np.full(256, _KINDS.index("symbol"), np.uint8)
    for kind, chars in (("upper", range(65, 91)), ("lower", range(97, 123)), ("digit", range(48, 58)), ("space", (9, 32)), ("newline", (10, 13)), ("stop", b".,;:?'-()\""), ("shout", b"!"), ("beyond", range(128, 256))):
        out[list(chars)] = _KINDS.index(kind)
    return out


_KIND = _kind_of_byte()
FEATURES = (*_KINDS, "bytes", "words", "word_bytes", "distinct", "commonest", "echo", "distinct5", "words_by_newline")


def features(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The statistics (texts x FEATURES) of texts in Arrow's buffers."""
    out = np.zeros((len(offsets) - 1, len(FEATURES)))
    for i, j in tk.runs(offsets):
        out[i:j] = _run_features(values, offsets[i : j + 1])
    return out


def _run_features(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n_docs, sizes = len(offsets) - 1, np.diff(offsets)
    kinds = _KIND[values[offsets[0] : offsets[-1]]].astype(np.int64)
    owner = np.repeat(np.arange(n_docs), sizes)
    counts = np.bincount(owner * len(_KINDS) + kinds, minlength=n_docs * len(_KINDS)).reshape(n_docs, -1).astype(float)
    words, n = tk.word_hashes(values, offsets)
    doc = np.repeat(np.arange(n_docs), n)
    echo = np.bincount(doc[1:][(words[1:] == words[:-1]) & (doc[1:] == doc[:-1])], minlength=n_docs)
    distinct, most = _distinct(words, n)
    five, made = tk.shingle_hashes(words, n)
    distinct5, _ = _distinct(five, made)
    some, size = np.maximum(n, 1), np.maximum(sizes, 1)
    letters = counts[:, 0] + counts[:, 1] + counts[:, 8]
    share = np.log((counts + 0.5) / (size + 10)[:, None])
    rest = [np.log1p(sizes), np.log1p(n), np.log1p(letters / some), np.log((distinct + 1) / (n + 1)) / np.log(n + 3), np.log((most + 1) / (n + 5)), np.log((echo + 0.5) / (n + 10)), np.log((distinct5 + 1) / (made + 1)), np.log1p(n / (1 + counts[:, 4]))]
    return np.column_stack([share, *rest])


def _distinct(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many different hashes each text has, and how often its commonest occurs."""
    edges = np.concatenate(([0], np.cumsum(counts)))
    hashes = hashes.copy()
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        hashes[i:j].sort()
    doc = np.repeat(np.arange(len(counts)), counts)
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    most = np.zeros(len(counts), np.int64)
    np.maximum.at(most, doc[at], np.diff(np.append(at, len(hashes))))
    return np.bincount(doc[at], minlength=len(counts)), most


class Discriminant:
    """Two Gaussian classes with regularised covariances and cached Cholesky factors."""

    def __init__(self, x: np.ndarray, y: np.ndarray, shrink: float = SHRINK, pool: float = POOL):
        self.prior = float(y.mean()) if len(y) else 0.5
        self.classes = []
        if not len(y) or not 0 < self.prior < 1:
            return
        self.center, self.scale = x.mean(0), x.std(0) + 1e-6
        z = self._scaled(x)
        groups = [z[y == k] for k in (0, 1)]
        pooled = sum(np.cov(g.T, bias=True) * len(g) for g in groups) / len(z)
        for k, g in enumerate(groups):
            own = (1 - pool) * np.cov(g.T, bias=True) + pool * pooled
            own = (1 - shrink) * own + shrink * np.diag(np.diag(own)) + FLOOR * np.eye(z.shape[1])
            factor = np.linalg.cholesky(own)
            self.classes.append((g.mean(0), np.linalg.inv(factor), -np.log(np.diag(factor)).sum() + np.log((self.prior, 1 - self.prior)[1 - k])))
        spread = np.abs(self._difference(x))
        self.temperature = max(1.0, float(np.quantile(spread, 0.95)) / 12)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.center) / self.scale, -20, 20)

    def _difference(self, x: np.ndarray) -> np.ndarray:
        z = self._scaled(x)
        low, high = (c - 0.5 * np.square((z - mean) @ inverse.T).sum(1) for mean, inverse, c in self.classes)
        return high - low

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self._difference(x) / self.temperature, -500, 500)))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = features(*tk.text_buffers(batch.column(2)))
        edges = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(edges, pa.array(x.reshape(-1)))], names=["id", "y", "x"])


def held_out(doc_id: str = "doc_id"):
    """crc32 of doc_id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Discriminant:
    """Fit on at most ``sample`` labelled rows that are not held out."""
    prepare(docs.sparkSession)
    told = (
        labels.filter("doc_id is not null and quality in (0, 1)").filter(~held_out())
        .groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("quality").cast("int").alias("y"))
        .orderBy(F.xxhash64("id"), "id").limit(sample)
    )
    seen = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(told), "id").select("id", "y", "text")
    made = seen.mapInArrow(tidy(_vectors), "id long, y int, x array<double>")
    # One row of a doc_id teaches (of several texts the one of the smallest statistics), so that at most ``sample`` rows of numbers come here.
    rows = made.groupBy("id").agg(F.min(F.struct("y", "x")).alias("r")).select("id", "r.*").orderBy("id").toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES))
    return Discriminant(x, rows["y"].to_numpy())


def _scorer(model: Discriminant):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(features(*tk.text_buffers(batch.column(2))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s)], names=["doc_id", "held_out", "score"])

    return run


def score(docs: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    prepare(docs.sparkSession)
    cut = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    got = cut.mapInArrow(tidy(_scorer(model)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double")
    return got.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: Discriminant) -> DataFrame:
    """The rows of docs that the classifier accepts, in one pass and with their columns as they are; all rows if it has not seen both classes."""
    prepare(docs.sparkSession)
    if not model.classes:
        return docs
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(features(*tk.text_buffers(batch.column(at)))) >= 0.5))

    return docs.mapInArrow(tidy(run), docs.schema)
