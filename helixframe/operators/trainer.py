"""Training of the coding network, one hidden layer of rectified units, by mini-batches over tasks.

Rows are scaled and packed into blocks once. In a step every task adds up the gradient over its own rows of the mini-batch,
sums are joined in rounds of a bounded number, and the driver, which holds no more than the weights, moves them. A row's
mini-batch follows from a digest of its key and the epoch, so a rerun of a task gives the same sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators import features
from helixframe.operators.models import Network, _matrix, kept

#: Hidden units; epochs; mini-batches of an epoch; first step width; epochs without a lower loss before it is halved.
HIDDEN, EPOCHS, STEPS, RATE, PATIENCE = 100, 20, 4, 0.01, 5
#: Rows of a block; sums joined at once.
BLOCK, FAN = 1000, 32
MEASURES = ["loss", "accuracy", "precision", "recall", "f1"]
SCHEMA = ", ".join(["epoch int", "rate double", *(f"{m} double" for m in MEASURES), *(f"held_{m} double" for m in MEASURES)])


class NothingToLearn(ValueError):
    """No row is left to train on."""


def unpacked(w: np.ndarray, width: int, hidden: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(hidden, width) weights, hidden biases, output weights and bias of a flat array."""
    a, b = hidden * width, hidden * width + hidden
    return w[:a].reshape(hidden, width), w[a:b], w[b : b + hidden], w[-1]


def sums(w: np.ndarray, x: np.ndarray, y: np.ndarray, hidden: int, gradient: bool = True) -> np.ndarray:
    """The sums over rows of the loss's gradient, if asked for, of the loss, and of rows, and of true and false positives and negatives."""
    h, hb, o, ob = unpacked(w, x.shape[1], hidden)
    z = x @ h.T + hb
    up = np.maximum(z, 0)
    logit = up @ o + ob
    loss = np.maximum(logit, 0) - logit * y + np.log1p(np.exp(-np.abs(logit)))
    hit = logit >= 0
    counts = [loss.sum(), len(y), (hit & (y > 0)).sum(), (hit & (y <= 0)).sum(), (~hit & (y > 0)).sum(), (~hit & (y <= 0)).sum()]
    if not gradient:
        return np.array(counts)
    off = 1 / (1 + np.exp(-logit)) - y
    back = off[:, None] * o * (z > 0)
    return np.concatenate([(back.T @ x).ravel(), back.sum(axis=0), up.T @ off, [off.sum()], counts])


def measures(counts: np.ndarray) -> dict[str, float]:
    loss, n, tp, fp, fn, tn = counts.tolist()
    ratio = lambda a, b: a / b if b else 0.0
    return {"loss": ratio(loss, n), "accuracy": ratio(tp + tn, n), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)}


class Adam:
    """Steps by running means of the gradient and its square; the width is halved while the loss doesn't fall."""

    def __init__(self, size: int, rate: float, patience: int):
        self.rate, self.patience, self.m, self.v, self.t, self.best, self.bad = rate, patience, np.zeros(size), np.zeros(size), 0, np.inf, 0

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * gradient
        self.v = 0.999 * self.v + 0.001 * gradient**2
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)

    def seen(self, loss: float) -> None:
        if loss < self.best * (1 - 1e-4):
            self.best, self.bad = loss, 0
        else:
            self.bad += 1
            if self.bad > self.patience:
                self.rate, self.bad = self.rate / 2, 0


def blocks(rows: DataFrame, keys: list[str], mean: np.ndarray, sd: np.ndarray, held_out: float, seed: int) -> DataFrame:
    """(held, x, y, draw): scaled features, labels and digests of up to ``BLOCK`` rows, training and held-out ones apart."""
    ready = rows.select("features", F.col("label").cast("double").alias("label"), F.xxhash64(*keys, F.lit(seed)).alias("draw"), _held(keys, held_out, seed).alias("held"))

    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), BLOCK):
                part = b.slice(at, BLOCK)
                x = ((_matrix(part.column("features")) - mean) / sd).astype(np.float32)
                y, draw, held = (part.column(c).to_numpy(zero_copy_only=False) for c in ("label", "draw", "held"))
                out = [(bool(h), x[held == h].tobytes(), y[held == h].astype(np.float32).tobytes(), draw[held == h].tobytes()) for h in (False, True) if (held == h).any()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.bool_(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["held", "x", "y", "draw"])

    return kept(ready.mapInArrow(function, "held boolean, x binary, y binary, draw binary"))


def _held(keys: list[str], held_out: float, seed: int):
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1000)) < 1000 * held_out


def _batch_of(draw: np.ndarray, epoch: int, steps: int) -> np.ndarray:
    """Which of an epoch's mini-batches each row is in."""
    z = draw.view(np.uint64) + np.uint64((epoch + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((z ^ (z >> np.uint64(29))) % np.uint64(steps)).astype(int)


def _total(packed: DataFrame, tasks: int, held: bool, w: np.ndarray, hidden: int, epoch: int, step: int, steps: int) -> np.ndarray | None:
    """``sums`` over a mini-batch of the training rows, or over all held-out rows, of blocks in so many tasks."""
    width = (len(w) - 1 - 2 * hidden) // hidden

    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for b in batches:
            for raw, labels, draws in zip(*(b.column(c).to_pylist() for c in ("x", "y", "draw")), strict=True):
                x, y = np.frombuffer(raw, np.float32).reshape(-1, width), np.frombuffer(labels, np.float32)
                if not held:
                    mine = _batch_of(np.frombuffer(draws, np.int64), epoch, steps) == step
                    x, y = x[mine], y[mine]
                if len(y):
                    part = sums(w, x, y, hidden, not held)
                    total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["id", "value"])

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(v) for v in group.sort_values("id")["value"]], axis=0)
        return pd.DataFrame({"id": [int(group["id"].iloc[0]) // FAN], "value": [total.tobytes()]})

    parts = packed.filter(F.col("held") == held).mapInArrow(function, "id long, value binary")
    while tasks > FAN:
        parts, tasks = parts.groupBy(F.floor(F.col("id") / FAN)).applyInPandas(joined, "id long, value binary"), -(-tasks // FAN)
    found = sorted(parts.collect(), key=lambda r: r["id"])  # FAN rows of the weights' size at most
    return np.sum([np.frombuffer(r["value"]) for r in found], axis=0) if found else None


def train_network(rows: DataFrame, keys: list[str], held_out: float = 0.1, seed: int = 42, hidden: int = HIDDEN, epochs: int = EPOCHS, steps: int = STEPS, rate: float = RATE, patience: int = PATIENCE) -> tuple[Network, DataFrame]:
    """(the network of the epoch with the best F1 on held-out rows, SCHEMA: a row an epoch).

    rows: keys, features, label (0 or 1). The split is by a digest of the keys; means and deviations are those of the
    training rows. Raises NothingToLearn without any. Without held-out rows the last epoch's network is taken.
    """
    rows = rows.filter("label is not null")
    stats = features.moments(rows.filter(~_held(keys, held_out, seed)), []).orderBy("k").collect()  # a row a feature
    if not stats:
        raise NothingToLearn("no labelled row is left for training")
    mean, sd = np.array([r.mean for r in stats]), np.array([r.sd for r in stats])
    sd = np.where(sd < 1e-9, 1.0, sd)
    packed = blocks(rows, keys, mean, sd, held_out, seed)
    tasks = packed.rdd.getNumPartitions()
    rng, width = np.random.default_rng(seed), len(mean)
    w = np.concatenate([rng.uniform(-1, 1, hidden * width + hidden) / np.sqrt(width), rng.uniform(-1, 1, hidden + 1) / np.sqrt(hidden)])
    adam, table, best = Adam(len(w), rate, patience), [], (-1.0, w)
    for epoch in range(epochs):
        counts, used = np.zeros(6), adam.rate
        for step in range(steps):
            total = _total(packed, tasks, False, w, hidden, epoch, step, steps)
            if total is not None:
                counts += total[-6:]
                w = w - adam.step(total[:-6] / total[-5])
        held = _total(packed, tasks, True, w, hidden, epoch, 0, 1)
        seen = measures(held) if held is not None else dict.fromkeys(MEASURES)
        adam.seen(seen["loss"] if held is not None else counts[0] / counts[1])
        table.append((epoch + 1, used, *measures(counts).values(), *seen.values()))
        if held is None or seen["f1"] > best[0]:
            best = (seen["f1"] if held is not None else -1.0, w)
    h, hb, o, ob = unpacked(best[1], width, hidden)
    network = Network(mean.tolist(), sd.tolist(), h.tolist(), hb.tolist(), (2 * o).tolist(), float(2 * ob))  # its score halves the logit
    return network, rows.sparkSession.createDataFrame(table, SCHEMA)


def save_network(spark: SparkSession, network: Network, path: str) -> None:
    """One row of Parquet."""
    spark.createDataFrame([tuple(asdict(network).values())], _NETWORK).write.mode("overwrite").parquet(path)


def load_network(spark: SparkSession, path: str) -> Network:
    """A stored network; one whose parts don't fit together raises."""
    found = Network(*spark.read.schema(_NETWORK).parquet(path).first())
    if len(found.mean) != len(found.sd) or any(len(h) != len(found.mean) for h in found.hidden) or not len(found.hidden) == len(found.hidden_bias) == len(found.out):
        raise ValueError(f"{path}: not a sound network")
    return found


_NETWORK = "mean array<double>, sd array<double>, hidden array<array<double>>, hidden_bias array<double>, out array<double>, out_bias double"
