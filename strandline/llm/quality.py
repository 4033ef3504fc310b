"""Quality classifier: random Fourier features, ridge regression and isotonic calibration.

Each text becomes a few document statistics, once; the statistics are staged and everything after reads only them. Random Fourier
features approximate a Gaussian kernel over the standardised statistics. Each partition sums its share of the normal equations
into one row, those rows are summed again over a few tasks, and the driver solves one small system. The raw scores are then
calibrated by isotonic regression over a histogram of fixed size.

Defined cases: null and empty texts have statistics 0 and are scored like any other. Rows with a null label or id don't train. Without
any training row every score is 0.5. Repeated rows give repeated rows; labels given twice count twice. Very long texts are
measured whole. Columns other than id and text are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .features import NAMES, statistics
from .shared import bounded_batches, fold, staged, text_or_empty, unused

#: Random features; width of the kernel in standardised units; ridge penalty for each row (beside 1 in all); bins of the calibration.
FEATURES, WIDTH, RIDGE, BINS = 256, 5.0, 1e-3, 4096


def measured(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and the statistics of each text. Other columns never pass through Python."""
    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(b.column("text"))
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), values], names=["doc_id", "x"])

    return docs.select(F.col(id_column).alias("doc_id"), text_or_empty(text_column).alias("text")).mapInArrow(run, f"doc_id {kind}, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


class Model:
    """Fitted numbers only: a few hundred kB whatever the input."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 23):
        r = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = r.normal(size=(len(mean), FEATURES)) / WIDTH
        self.b = r.uniform(0, 2 * np.pi, FEATURES)
        self.beta, self.steps = np.zeros(FEATURES + 1), np.full(BINS, 0.5)

    def lift(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.w + self.b
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.beta

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Bin of the raw score; the bins cover -0.5 to 1.5 and the outer ones all beyond."""
        return np.clip(((self.raw(x) + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.steps[self.bins(x)]


def summed(rows: DataFrame, share, width: int) -> np.ndarray:
    """Sum over all rows of share(batch), a vector of `width` numbers: a row for each partition, then one for each of 8 tasks."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for b in batches:
            total += share(b)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for b in batches:
            for v in b.column("v"):
                total += np.frombuffer(v.as_buffer(), np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    got = rows.mapInArrow(first, "v binary").repartition(8).mapInArrow(again, "v binary").collect()
    return np.sum([np.frombuffer(r["v"], np.float64) for r in got], axis=0)


def isotonic(total: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The rising step function that fits the bins' mean labels best (pool adjacent violators); empty bins take the step below them."""
    blocks: list[list[float]] = []
    for i in np.flatnonzero(count):
        blocks.append([total[i], count[i], i])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _ = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
    out = np.zeros(len(total))
    for k, (s, n, at) in enumerate(blocks):
        out[0 if k == 0 else int(at) :] = s / n
    return out


def fit(rows: DataFrame) -> Model:
    """rows: x (statistics) and y (0 or 1) of all training rows."""
    d = len(NAMES)

    def moments(b: pa.RecordBatch) -> np.ndarray:
        x = _matrix(b.column("x"))
        return np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])

    m = summed(rows, moments, 1 + 2 * d)
    if not m[0]:
        return Model(np.zeros(d), np.ones(d))
    mean = m[1 : d + 1] / m[0]
    model = Model(mean, np.sqrt(np.maximum(m[d + 1 :] / m[0] - mean**2, 1e-12)) + 1e-6)
    k = FEATURES + 1

    def equations(b: pa.RecordBatch) -> np.ndarray:
        z = model.lift(_matrix(b.column("x")))
        return np.concatenate([(z.T @ z).ravel(), z.T @ b.column("y").to_numpy(zero_copy_only=False)])

    e = summed(rows, equations, k * k + k)
    model.beta = np.linalg.solve(e[: k * k].reshape(k, k) + (RIDGE * m[0] + 1.0) * np.eye(k), e[k * k :])

    def histogram(b: pa.RecordBatch) -> np.ndarray:
        at = model.bins(_matrix(b.column("x")))
        return np.concatenate([np.bincount(at, b.column("y").to_numpy(zero_copy_only=False), BINS), np.bincount(at, minlength=BINS)])

    h = summed(rows, histogram, 2 * BINS)
    model.steps = isotonic(h[:BINS], h[BINS:])
    return model


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id and score."""
    kind = dict(stats.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(_matrix(b.column("x"))) if len(b) else [], pa.float64())], names=["doc_id", "score"])

    return stats.mapInArrow(run, f"doc_id {kind}, score double")


def _labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """x and y of the training rows: labels.quality outside fold 0."""
    y = labels.where(F.col("quality").isNotNull() & (fold() != 0)).select("doc_id", F.col("quality").cast("double").alias("y"))
    return staged(stats.join(y, "doc_id").select("x", "y"), "training")


def train(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Model]:
    """Statistics of every row of docs, and a model of labels.quality of the rows outside fold 0."""
    stats = staged(measured(docs), "statistics")
    return stats, fit(_labelled(stats, labels))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Rows of docs with a score of at least the threshold, all columns as they are. Each text is measured once, where it lies, and staged with its
    row; the fit and the decision read the statistics alone."""
    bounded_batches(docs.sparkSession)
    x = unused(docs, "_statistics")[0]
    schema = T.StructType([*docs.schema.fields, T.StructField(x, T.ArrayType(T.DoubleType()))])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = statistics(b.column(b.schema.get_field_index("text")))
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1, dtype=np.int32) * len(NAMES)), pa.array(got.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, values], names=[*b.schema.names, x])

    rows = staged(docs.mapInArrow(measure, schema), "measured")
    model = fit(_labelled(rows.select("doc_id", F.col(x).alias("x")), labels))

    @F.arrow_udf("boolean")
    def good(column: pa.Array) -> pa.Array:
        return pa.array(model.score(_matrix(column)) >= threshold) if len(column) else pa.array([], pa.bool_())

    return rows.where(good(x)).select(*[F.col(f"`{c}`") for c in docs.columns])


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs. Learns labels.quality of rows outside fold 0."""
    stats, model = train(docs, labels)
    return scored(stats, model).select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
