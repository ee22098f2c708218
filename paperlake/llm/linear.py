"""Logistic regression on hashed features: FTRL-proximal training in shards, and scoring in Arrow batches.

Each example is a set of feature indices with values. FTRL-proximal (McMahan and others, 2013) keeps a
learning rate for each coordinate and sets weights that don't pay for their L1 penalty to zero. Training
rows are dealt to shards by a hash of their id; a shard runs its epochs over its rows in the order of that
hash, and the weights of the shards are averaged by Spark. So reruns agree and no task needs more than a
shard. The model that is broadcast has at most ``2 ** bits`` weights.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

__all__ = ["Example", "Ftrl", "Model", "labelled_sample", "platt", "sigmoid", "train"]

#: Indices and values of one example; no values stand for ones.
Example = tuple[np.ndarray, np.ndarray | None]


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Ftrl:
    """State and settings of one learner. Index ``2 ** bits`` is the bias, without L1."""

    bits: int = 20
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.5
    l2: float = 0.5

    def __post_init__(self) -> None:
        self.z = np.zeros((1 << self.bits) + 1)
        self.n = np.zeros((1 << self.bits) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == 1 << self.bits, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def step(self, at: np.ndarray, x: np.ndarray, y: float) -> float:
        w = self.weights(at)
        p = float(sigmoid(float(w @ x)))
        g = (p - y) * x
        root = np.sqrt(self.n[at])
        self.n[at] += g * g
        self.z[at] += g - (np.sqrt(self.n[at]) - root) / self.alpha * w
        return p

    def fit(self, examples: list[Example], labels: np.ndarray, epochs: int) -> None:
        for _ in range(epochs):
            for (at, x), y in zip(examples, labels.tolist(), strict=True):
                value = np.ones(len(at) + 1)
                if x is not None:
                    value[:-1] = x
                self.step(np.append(at, 1 << self.bits), value, y)


@dataclass
class Model:
    """Dense weights, the bias and the calibration ``sigmoid(slope * margin + offset)``."""

    weights: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    def calibrate(self, probability: np.ndarray, y: np.ndarray, odds: float, prior: float = 1e-3) -> None:
        """Fit slope and offset to labels of rows that weren't trained on, by the probabilities that the bare weights give them.

        ``prior`` holds them at the model's own margin, which stands where the rows haven't both labels, about
        as so many rows would. ``odds`` is the offset of the sample's odds.
        """
        p = np.clip(probability, 1e-9, 1 - 1e-9)
        self.slope, self.offset = platt(np.log(p / (1 - p)) + self.bias, y, prior)
        self.offset -= odds

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * (margin + self.bias) + self.offset)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, where=None, least: int = 1_000) -> tuple[DataFrame, float]:
    """(doc_id, text, y, key) of about ``max_rows`` labelled documents at most, chosen by a hash of the id, and the offset of their odds.

    ``max_rows`` bounds what is trained on, and so what is broadcast to find these rows: 16 bytes each. A label
    with few rows keeps ``least`` of them if it has so many; the odds of label 1 are then e to the offset times
    those among all labelled rows, which ``Model.calibrate`` takes back. Rows with a null id or label are left
    out; an id labelled more than once counts with its largest label.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    if where is not None:
        known = known.filter(where)
    known = known.groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    share = {y: min(1.0, max(max_rows / total, least / n)) for y, n in counts.items()}
    key = F.xxhash64(F.col("doc_id").cast("string"), F.lit(7))
    part = F.pmod("key", F.lit(1 << 53)) / float(1 << 53)
    chosen = known.withColumn("key", key).filter(part < F.when(F.col("y") == 1, F.lit(share.get(1, 1.0))).otherwise(F.lit(share.get(0, 1.0))))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), math.log(share.get(1, 1.0) / share.get(0, 1.0))


def train(sample: DataFrame, features: Callable[[pa.RecordBatch], list[Example]], settings: dict, epochs: int, shard_rows: int, rows: int) -> Model:
    """Average of FTRL learners over shards of about ``shard_rows`` of the ``rows`` rows (text, y, key)."""
    shards = max(1, round(rows / shard_rows))

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending")]).combine_chunks()
        learner = Ftrl(**settings)
        examples = [e for b in table.to_batches(max_chunksize=512) for e in features(b)]
        learner.fit(examples, table.column("y").to_numpy(), epochs)
        at = np.flatnonzero((np.abs(learner.z) > learner.l1) | (np.arange(len(learner.z)) == 1 << learner.bits))
        return pa.table({"at": pa.array(at, pa.int32()), "w": learner.weights(at)})

    parts = sample.withColumn("shard", F.pmod(F.shiftright("key", 20), F.lit(shards)))
    mean = parts.groupBy("shard").applyInArrow(fit, "at int, w double").groupBy("at").agg((F.sum("w") / shards).alias("w"))
    found = mean.collect()  # at most 2 ** bits + 1 rows, most of them dropped by L1
    bits = settings.get("bits", Ftrl.bits)
    dense = np.zeros((1 << bits) + 1, dtype=np.float32)
    for r in found:
        dense[r["at"]] = r["w"]
    return Model(dense[:-1], float(dense[-1]))


def platt(margin: np.ndarray, y: np.ndarray, prior: float = 1e-3, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a calibrated probability, by Newton steps on smoothed labels (Platt, 1999), held near 1 and 0 by ``prior``."""
    if len(y) == 0 or y.min() == y.max():
        return 1.0, 0.0
    up, down = float(y.sum()), float(len(y) - y.sum())
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = sigmoid(a * margin + b)
        d, w = p - t, np.maximum(p * (1 - p), 1e-12)
        g = np.array([(d * margin).sum() + prior * (a - 1), d.sum() + (prior - 1e-3) * b])
        h = np.array([[(w * margin * margin).sum() + prior, (w * margin).sum()], [(w * margin).sum(), w.sum() + (prior - 1e-3) + 1e-9]])
        step = np.linalg.solve(h, g)
        scale = min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
        a, b = a - scale * step[0], b - scale * step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(max(a, 1e-3)), float(b)

