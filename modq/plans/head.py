"""Classification heads on frozen embeddings.

Encoders are not available here, so embeddings come as columns: ``encode`` takes any function from a batch of inputs to vectors.
The head (linear, ReLU, dropout, linear) is trained in numpy on the driver on a bounded number of rows; scoring runs distributed
in Arrow batches and does not depend on their size.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sample import bounded_sample
from ..ship import ship

MOST_ROWS = 200_000


@dataclass(frozen=True)
class HeadConfig:
    hidden: int = 256
    dropout: float = 0.1
    rate: float = 1e-3
    epochs: int = 30
    batch: int = 64
    patience: int = 5
    seed: int = 42


@dataclass
class Head:
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    history: list[float] = field(default_factory=list)

    @staticmethod
    def new(size: int, config: HeadConfig) -> "Head":
        rng = np.random.default_rng(config.seed)
        bound1, bound2 = 1 / np.sqrt(size), 1 / np.sqrt(config.hidden)
        return Head(rng.uniform(-bound1, bound1, (size, config.hidden)), np.zeros(config.hidden), rng.uniform(-bound2, bound2, (config.hidden, 2)), np.zeros(2))

    def copy(self) -> "Head":
        return Head(self.w1.copy(), self.b1.copy(), self.w2.copy(), self.b2.copy(), list(self.history))

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Softmax, second class."""
        z = self.logits(x)
        return 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -50, 50)))

    def parameters(self) -> int:
        return sum(a.size for a in (self.w1, self.b1, self.w2, self.b2))


def f1(y: np.ndarray, p: np.ndarray, threshold: float = 0.5) -> float:
    hit = p >= threshold
    tp = float((hit & (y == 1)).sum())
    total = 2 * tp + float((hit & (y != 1)).sum()) + float((~hit & (y == 1)).sum())
    return 2 * tp / total if total else 0.0


def train_head(
    x: np.ndarray, y: np.ndarray, dev_x: np.ndarray, dev_y: np.ndarray, config: HeadConfig = HeadConfig(), metric: Callable[[np.ndarray, np.ndarray], float] = f1
) -> Head:
    """Adam on class-weighted cross entropy in seeded batches; the weights of the best dev epoch are returned.

    A metric that is never better than its start (such as NaN with one class) returns the initial weights.
    """
    head = Head.new(x.shape[1], config)
    best, best_value, waited = head.copy(), float("-inf"), 0
    counts = np.maximum(np.bincount(y, minlength=2), 1)
    weight = len(y) / (2 * counts)
    rng = np.random.default_rng(config.seed)
    names = ("w1", "b1", "w2", "b2")
    m, v, step = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    for _ in range(config.epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), config.batch):
            i = order[lo : lo + config.batch]
            a, t, w = x[i], y[i], weight[y[i]]
            h = np.maximum(a @ head.w1 + head.b1, 0)
            keep = (rng.random(h.shape) >= config.dropout) / (1 - config.dropout)
            z = (h * keep) @ head.w2 + head.b2
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(i)), t] -= 1
            dz = p * (w / w.sum())[:, None]
            dh = (dz @ head.w2.T) * keep * (h > 0)
            grads = {"w2": (h * keep).T @ dz, "b2": dz.sum(0), "w1": a.T @ dh, "b1": dh.sum(0)}
            step += 1
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                setattr(head, k, getattr(head, k) - config.rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8))
        value = metric(dev_y, head.probability(dev_x))
        head.history.append(value)
        if value > best_value:
            best, best_value, waited = head.copy(), value, 0
        else:
            waited += 1
            if waited >= config.patience:
                break
    best.history = list(head.history)
    return best


def collect_rows(df: DataFrame, vector: str, label: str, order: str = "id", most: int = MOST_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and labels of a bounded number of rows, chosen by seeded hash and put in order."""
    usable = df.where(F.col(vector).isNotNull() & F.col(label).isin(0, 1)).select(order, vector, label)
    rows = sorted(bounded_sample(usable, order, most, 1).collect(), key=lambda r: r[0])[:most]
    return np.array([r[1] for r in rows], dtype=np.float64), np.array([r[2] for r in rows], dtype=np.int64)


def score(df: DataFrame, head: Head, vector: str = "fused", name: str = "probability") -> DataFrame:
    """``df`` with the head's probability, in Arrow batches."""
    shared = ship(df.sparkSession).sparkContext.broadcast(head)  # fixed size

    def run(vectors: pd.Series) -> pd.Series:
        good = vectors.notna()
        out = pd.Series(np.nan, index=vectors.index)
        if good.any():
            out[good] = shared.value.probability(np.stack(vectors[good].to_numpy()).astype(np.float64))
        return out

    p = F.pandas_udf(run, "double")(F.col(vector))
    return df.withColumn(name, F.when(~F.isnan(p), p))


def encode(df: DataFrame, column: str, encoder: Callable[[list], np.ndarray], name: str) -> DataFrame:
    """``df`` with an embedding column from any batch encoder; only ``column`` is handed to it."""
    ship(df.sparkSession)

    def run(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in values:
            yield pd.Series(list(np.asarray(encoder(batch.tolist()), dtype=np.float32)))

    return df.withColumn(name, F.pandas_udf(run, "array<float>", F.PandasUDFType.SCALAR_ITER)(F.col(column)))


def timings(spark: SparkSession, call: Callable[[], object], runs: int = 50, warm: int = 5) -> DataFrame:
    """``ms`` of repeated calls after some to warm up, for ``latency_summary``."""
    for _ in range(warm):
        call()
    out = []
    for _ in range(runs):
        began = time.perf_counter()
        call()
        out.append(((time.perf_counter() - began) * 1000,))
    return spark.createDataFrame(out, "ms double")
