"""A head with one hidden layer, trained by mini-batches whose gradients the tasks sum."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.sources.tables import cut

#: Hidden width, passes over the rows, rows of a batch, step size; a fixed budget, as a stop chosen on the validation rows would leak them.
HIDDEN, EPOCHS, BATCH, RATE = 128, 30, 256, 5e-3
#: Batches of an epoch at most: each is a job, so many rows come in larger batches, not in more of them.
STEPS = 32
#: Decays and the least divisor of Adam.
BETAS, EPSILON = (0.9, 0.999), 1e-8
#: Training rows of a task at least; tasks at most, as each hands the driver a gradient.
A_TASK, TASKS = 5_000, 64


@dataclass
class Head:
    """Weights of Linear -> ReLU -> Linear."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @classmethod
    def start(cls, dims: int, classes: int, seed: int, hidden: int = HIDDEN) -> Head:
        """Uniform weights within 1 / sqrt(inputs) of each layer."""
        rng = np.random.default_rng(seed)
        draw = lambda n, *shape: rng.uniform(-1, 1, shape) / np.sqrt(n)
        return cls(draw(dims, dims, hidden), draw(dims, hidden), draw(hidden, hidden, classes), draw(hidden, classes))

    def parts(self) -> list[np.ndarray]:
        return [self.w1, self.b1, self.w2, self.b2]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.logits(x)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def gradient(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The sum over rows of the cross-entropy's gradient, as one vector."""
        h = x @ self.w1 + self.b1
        out = self.probabilities(x)
        out[np.arange(len(y)), y] -= 1
        back = (out @ self.w2.T) * (h > 0)
        return np.concatenate([(x.T @ back).ravel(), back.sum(axis=0), (np.maximum(h, 0).T @ out).ravel(), out.sum(axis=0)])


class Adam:
    def __init__(self, head: Head, rate: float) -> None:
        self.head, self.rate, self.step = head, rate, 0
        self.m = np.zeros(sum(p.size for p in head.parts()))
        self.v = np.zeros_like(self.m)

    def update(self, gradient: np.ndarray) -> None:
        """One step along a mean gradient, in place."""
        self.step += 1
        self.m = BETAS[0] * self.m + (1 - BETAS[0]) * gradient
        self.v = BETAS[1] * self.v + (1 - BETAS[1]) * gradient**2
        move = self.rate * (self.m / (1 - BETAS[0] ** self.step)) / (np.sqrt(self.v / (1 - BETAS[1] ** self.step)) + EPSILON)
        at = 0
        for p in self.head.parts():
            p -= move[at : at + p.size].reshape(p.shape)
            at += p.size


def batch_of(row, epoch: int, seed: int, batches: int):
    """The batch of a row in an epoch: by a hash, so that no order has to be shuffled and SQL and tests see the same batches."""
    return F.pmod(F.xxhash64(row, F.lit(epoch), F.lit(seed)), F.lit(batches))


def numbered(train: DataFrame) -> tuple[DataFrame, int]:
    """(row, vec, y) of the training rows, stored, and their number. Rows without a vector or a class don't count."""
    data = cut(train.where("vec is not null and y is not null").select(F.col("vec").cast("array<double>").alias("vec"), F.col("y").cast("int").alias("y")))
    data = cut(data.withColumn("row", F.monotonically_increasing_id()))
    return data, data.count()


def fit(train: DataFrame, classes: int, seed: int, epochs: int = EPOCHS, rate: float = RATE, batch: int = BATCH, hidden: int = HIDDEN) -> Head:
    """The head fitted on ``train`` (vec, y from 0 on) by Adam on the cross-entropy, for a fixed number of epochs.

    A batch is a job: each task sums the gradient of its rows of the batch, the driver adds as many gradients as there are tasks,
    and keeps weights and moments, whose size is the head's. Batches have ``batch`` rows on average; an empty one is no step. Of more
    than STEPS * ``batch`` rows an epoch has STEPS batches, so that the number of jobs doesn't grow with the table; every row is in one of them.
    """
    data, n = numbered(train)
    if not n:
        raise ValueError("no training rows")
    data = data.coalesce(min(TASKS, max(1, n // A_TASK))).persist()
    head = Head.start(data.select(F.size("vec")).first()[0], classes, seed, hidden)
    adam, batches = Adam(head, rate), min(STEPS, max(1, -(-n // batch)))
    try:
        for epoch in range(epochs):
            for k in range(batches):
                found = data.where(batch_of("row", epoch, seed, batches) == k).select("vec", "y").mapInArrow(_gradients(head), "n long, g array<double>").collect()
                if rows := sum(r["n"] for r in found):
                    adam.update(np.sum([r["g"] for r in found], axis=0) / rows)
    finally:
        data.unpersist()
    return head


def _gradients(head: Head):
    def gradients(parts):
        import pyarrow as pa

        total, n = 0, 0
        for part in parts:
            if part.num_rows:
                x = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                total, n = total + head.gradient(x, part.column(1).to_numpy()), n + part.num_rows
        if n:
            yield pa.RecordBatch.from_pydict({"n": pa.array([n]), "g": pa.array([total.tolist()])})

    return gradients


def predictions(head: Head, rows: DataFrame) -> DataFrame:
    """``rows`` with ``predicted`` (of equal probabilities the smallest class) and ``probability``; a null vector has nulls. The tasks take
    Arrow batches, so no side is ever held whole."""

    known = rows.sparkSession.sparkContext.broadcast(head)

    @F.pandas_udf("array<double>")
    def probability(vec: pd.Series) -> pd.Series:
        fine = vec.notna().to_numpy()
        own = iter(known.value.probabilities(np.stack(vec[fine].to_numpy()).astype(np.float64)) if fine.any() else [])
        return pd.Series([next(own) if f else None for f in fine], dtype=object)

    out = rows.withColumn("probability", probability(F.col("vec").cast("array<double>")))
    return out.withColumn("predicted", (F.array_position("probability", F.array_max("probability")) - 1).cast("int")).select(*rows.columns, "predicted", "probability")
