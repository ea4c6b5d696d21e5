"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetmetrics.llm.common import fold, query, sliced, table

TOKEN = re.compile(r"[^\W_]+")
MIX, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Words whose hashes a task keeps.
CACHE = 1_000_000


class Features:
    """Hashed presence features of a text: words, pairs of neighbours, and pairs with one word between."""

    def __init__(self, bits: int):
        self.shift, self.cache = np.uint64(64 - bits), {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Indices in text order, with repeats."""
        words, cache = TOKEN.findall(text.lower()) if text else [], self.cache
        if len(cache) > CACHE:
            cache.clear()
        h = np.fromiter((cache.get(w) or cache.setdefault(w, xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) | 1) for w in words), np.uint64, len(words))
        grams = np.concatenate([h, h[:-1] * MIX + h[1:], h[:-2] * MIX2 + h[2:] * np.uint64(3)])
        return ((grams * MIX) >> self.shift).astype(np.int32)


@dataclass
class ToxicityModel:
    """Sparse weights by feature, bias, and the slope and offset of the calibration."""

    bits: int
    index: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


class Ftrl:
    """Per-coordinate FTRL-proximal state for logistic loss."""

    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, x: np.ndarray) -> np.ndarray:
        z = self.z[x]
        l1 = np.where(x == len(self.z) - 1, 0.0, self.l1)  # the bias isn't penalised
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[x])) / self.alpha + self.l2 * (l1 > 0))
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, x: np.ndarray, y: int) -> None:
        w = self.weights(x)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
        root = np.sqrt(self.n[x])
        self.z[x] += g - (np.sqrt(self.n[x] + g * g) - root) / self.alpha * w
        self.n[x] += g * g


def _platt(margin: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and offset of a logistic calibration, by Newton steps on smoothed targets."""
    pos, neg = int(y.sum()), int((1 - y).sum())
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b, x = 1.0, 0.0, np.stack([margin, np.ones_like(margin)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        h = (x * (p * (1 - p))) @ x.T + np.eye(2) * 1e-3
        step = np.linalg.solve(h, x @ (p - target) + np.array([1e-3 * (a - 1), 0.0]))
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
    return max(a, 1e-2), b


def train(
    docs: DataFrame, labels: DataFrame, bits: int = 20, sample: int = 8000, epochs: int = 20, alpha: float = 2.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.1, seed: int = 42
) -> ToxicityModel:
    """Fits on at most `sample` rows of labels (doc_id, toxic), those with the smallest seeded hash.

    A fifth of the sample calibrates the margins and isn't trained on. Null labels are left out; of several labels
    of a document the largest holds. With no labels or one class the model has no weights and a score of 0.5 or
    near that class. Features are made where the texts are; one task fits the bounded sample and sends back the
    weights that L1 leaves.
    """
    picked = (
        labels.where("toxic is not null and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("y"))
        .withColumn("h", F.xxhash64(F.lit(seed), "doc_id"))
        .orderBy("h", "doc_id")
        .limit(sample)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("h", "y", F.col("text").cast("string").alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features(bits)
        for batch in batches:
            for part in sliced(batch, "text"):
                x = [np.unique(make(t.as_py())) for t in part.column("text")]
                yield pa.record_batch([part.column("h"), part.column("y"), pa.array(x, pa.list_(pa.int32()))], ["h", "y", "x"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h", kind="stable")
        y = pdf["y"].to_numpy()
        last = 1 << bits
        xs = [np.append(x, last) for x in pdf["x"]]
        held = np.arange(len(y)) % 5 == 4
        state, rng, learn = Ftrl(last, alpha, beta, l1, l2), np.random.default_rng(seed), np.flatnonzero(~held)
        for _ in range(epochs):
            for i in rng.permutation(learn):
                state.learn(xs[i], int(y[i]))
        w = state.weights(np.arange(last + 1))
        slope, offset = (1.0, 0.0)
        if held.any():
            slope, offset = _platt(np.array([w[x].sum() for x, m in zip(xs, held) if m]), y[held])
        nz = np.flatnonzero(w[:last])
        return pd.DataFrame({"i": np.concatenate([nz, [-1, -2, -3]]), "w": np.concatenate([w[nz], [w[last], slope, offset]])})

    got = rows.mapInArrow(features, "h long, y int, x array<int>").withColumn("g", F.lit(1)).groupBy("g").applyInPandas(lambda pdf: fit(pdf), "i long, w double").toPandas()
    if not len(got):
        return ToxicityModel(bits, np.zeros(0, np.int64), np.zeros(0), 0.0, 1.0, 0.0)
    got = got.sort_values("i")
    i, w = got["i"].to_numpy(), got["w"].to_numpy()
    return ToxicityModel(bits, i[3:], w[3:], float(w[2]), float(w[1]), float(w[0]))


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from the threshold on); null and empty texts get the bias alone.

    Each feature counts once however often it occurs, so neither length nor repetition moves a score by itself.
    Own columns named score or predicted are replaced.
    """
    docs = docs.drop("score", "predicted")
    at = docs.schema.names.index("text")
    sparse = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sparse.value
        make, dense = Features(m.bits), np.zeros(1 << m.bits)
        dense[m.index] = m.weight
        for batch in batches:
            for part in sliced(batch, "text"):
                margin = np.empty(part.num_rows)
                for k, t in enumerate(part.column(at)):
                    x = make(t.as_py())
                    margin[k] = m.bias + dense[np.unique(x[dense[x] != 0])].sum()
                p = m.probability(margin)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*part.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, _with(docs, "score double, predicted int"))


def _with(docs: DataFrame, more: str):
    from pyspark.sql.types import StructType

    out = StructType(list(docs.schema.fields))
    for f in StructType.fromDDL(more).fields:
        out = out.add(f)
    return out


def trained(spark: SparkSession, sf_dir: str) -> ToxicityModel:
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 3) != 1)
    return train(table(spark, sf_dir, "documents"), labels.select("doc_id", "toxic"))


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents").select("doc_id", "text"), trained(spark, sf_dir))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")
