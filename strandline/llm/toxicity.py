"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; other texts, whose labels are not looked at, are the unlabelled. With the class prior
p, the risk of a classifier is p R+(positives) + max(0, R-(unlabelled) - p R-(positives)): the second part corrects for the
toxic texts among the unlabelled and is kept from turning negative, which would be overfitting. A numpy linear classifier over hashed
words and word beginnings minimises it on bounded samples; every document is then scored where it lies.

The fit reads at most POSITIVES confirmed texts and UNLABELLED others, the first in a seeded order of the ids, so the model and what
reaches the driver have the same bound at every size. The prior is the share of toxic labels among the training rows.

Defined cases: null and empty texts have no features and get the score of the bias alone. Null labels and ids don't train. Without a
positive every score is 0. Repeated rows give repeated rows. Very long texts are read whole. Only id and text are inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .features import word_features
from .shared import bounded_batches, fold, text_or_empty

#: Bounds of the samples that the fit reads, and of the features that it may use.
POSITIVES, UNLABELLED, WIDTH = 2_000, 6_000, 8_192
#: Features are kept as these many bits of their hash while they are chosen.
BITS = 22
#: Occurrences in a text that make a second feature of a word.
OFTEN = 2
#: Least positives that have a feature, and least standard errors by which they have it more often.
SUPPORT, STANDS_OUT = 6, 4.0


def _bags(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Distinct features of each text of a chunk: (text index, feature), sorted, and the number of texts."""
    for lo, hi, data, offs in K.chunks(texts, 1 << 20):
        h, owner = word_features(data, offs)
        key, count = np.unique((owner.astype(np.uint64) << np.uint64(BITS)) | (h >> np.uint64(64 - BITS)), return_counts=True)
        low = np.uint64((1 << BITS) - 1)
        often = key[count >= OFTEN]  # one that comes again and again is a feature of its own
        often = (often & ~low) | (K.mix((often & low) + np.uint64(1)) >> np.uint64(64 - BITS))
        key = np.unique(np.concatenate([key, often]))
        yield (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64((1 << BITS) - 1)).astype(np.int64), hi - lo


def sampled(docs: DataFrame, ids: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Features of the texts of docs whose ids are in `ids`, a table of bounded size: (row, feature) pairs and the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = []
            for row, f, n in _bags(b.column("text")):
                at = np.searchsorted(row, np.arange(n + 1))
                bags += [f[x:y].astype(np.uint32).tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(bags, pa.binary())], names=["doc_id", "bag"])

    kind = dict(docs.dtypes)["doc_id"]
    chosen = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(ids), "doc_id")
    got = chosen.mapInArrow(run, f"doc_id {kind}, bag binary").toArrow().column("bag")
    bags = [np.frombuffer(v.as_buffer(), np.uint32) for v in got]
    row = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    return row, np.concatenate([*bags, np.zeros(0, np.uint32)]).astype(np.int64), len(bags)


class Linear:
    """Weights of chosen features and a bias; the score is a probability."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float):
        self.features, self.weights, self.bias = features, weights, bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        done = 0
        for row, f, n in _bags(texts):
            at = np.searchsorted(self.features, f)
            hit = np.flatnonzero((at < len(self.features)) & (self.features[np.minimum(at, max(0, len(self.features) - 1))] == f)) if len(self.features) else np.zeros(0, np.int64)
            out[done : done + n] = np.bincount(row[hit], self.weights[at[hit]], n) + self.bias
            done += n
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def choose(pos: np.ndarray, n_pos: int, unl: np.ndarray, n_unl: int, width: int = WIDTH) -> np.ndarray:
    """The features whose share among positives stands out most from that among the unlabelled, in standard errors."""
    a = np.bincount(pos, minlength=1 << BITS) / max(1, n_pos)
    b = np.bincount(unl, minlength=1 << BITS) / max(1, n_unl)
    both = (a * n_pos + b * n_unl + 1) / (n_pos + n_unl + 2)
    z = (a - b) / np.sqrt(both * (1 - both) * (1 / max(1, n_pos) + 1 / max(1, n_unl)))
    z[a * n_pos < SUPPORT] = 0
    kept = np.argsort(-z, kind="stable")[:width]
    return np.sort(kept[z[kept] > STANDS_OUT])


def nn_pu(pos: tuple, unl: tuple, features: np.ndarray, prior: float, rounds: int = 400, rate: float = 0.05, penalty: float = 2e-4, seed: int = 5) -> Linear:
    """Minimises the non-negative risk with the logistic loss, by Adam on all rows; where the corrected part is negative, a step undoes it."""

    def local(sample: tuple) -> tuple[np.ndarray, np.ndarray, int]:
        row, f, n = sample
        at = np.searchsorted(features, f)
        hit = np.flatnonzero((at < len(features)) & (features[np.minimum(at, len(features) - 1)] == f))
        return row[hit], at[hit], n

    if not len(features) or not pos[2]:
        return Linear(np.zeros(0, np.int64), np.zeros(0), -40.0 if not pos[2] else float(np.log(prior / (1 - prior))))
    (pr, pf, pn), (ur, uf, un) = local(pos), local(unl)
    d = len(features)
    w, b = np.zeros(d), 0.0
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, rounds + 1):
        zp, zu = np.bincount(pr, w[pf], pn) + b, np.bincount(ur, w[uf], un) + b
        sp, su = sigmoid(zp), sigmoid(zu)
        corrected = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        if corrected >= 0:
            gp, gu = prior * (sp - 1) / pn - prior * sp / pn, su / max(1, un)
        else:
            gp, gu = prior * sp / pn, -su / max(1, un)
        g = np.append(np.bincount(pf, gp[pr], d) + np.bincount(uf, gu[ur], d) + penalty * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w -= step[:-1]
        b -= step[-1]
    return Linear(features, w, float(b))


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, seed: int = 11) -> Linear:
    """Reads labels and texts of rows outside fold 0 only."""
    bounded_batches(docs.sparkSession)
    order = F.xxhash64(F.lit(seed), "doc_id")
    train = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold() != 0))
    prior = train.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    toxic = train.where("toxic = 1").select("doc_id").distinct().orderBy(order, "doc_id").limit(positives)
    other = docs.where(F.col("doc_id").isNotNull() & (fold() != 0)).select("doc_id").orderBy(order, "doc_id").limit(unlabelled).distinct()
    pos, unl = sampled(docs, toxic), sampled(docs, other)
    features = choose(pos[1], pos[2], unl[1], unl[2])
    return nn_pu(pos, unl, features, min(max(prior, 1e-3), 0.9))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    model = fit(docs, labels)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.scores(b.column("text")), pa.float64())], names=["doc_id", "score"])

    scored = docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
