"""Scoring and training of per-genome models on feature rows.

A classifier is fitted on a bounded sample of each genome's labels, drawn by a hash before the shuffle, so a genome with a
third of all rows trains in one task's memory; its scaling is that of all labelled rows. Clusters are fitted on all rows:
each task sums its rows by cluster. Every row is then scored where it lies, against the joined model of its genome.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators import features

#: Rows of a label that a genome's classifier is fitted on, on average at most; random Fourier features; passes over the sample.
SAMPLE, FOURIER, PASSES = 4000, 256, 60
#: Restarts of the clusters, further ones where all have collapsed, k-means steps, and the largest move of a settled centroid.
RESTARTS, EXTRA, STEPS, DRIFT = 50, 250, 100, 1e-4
#: Rows clustered together; bytes up to which models are broadcast.
BLOCK, BROADCAST_BYTES = 1000, 32 << 20
ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}


@dataclass
class Network:
    """One hidden layer of rectified units; inputs are standardised, the logit is halved before the sigmoid."""

    mean: list[float]
    sd: list[float]
    hidden: list[list[float]]
    hidden_bias: list[float]
    out: list[float]
    out_bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        sd = np.where(np.array(self.sd) < 1e-9, 1.0, self.sd)
        h = np.maximum(0, (x - np.array(self.mean)) / sd @ np.array(self.hidden).T + self.hidden_bias)
        return 1 / (1 + np.exp(-(h @ np.array(self.out) + self.out_bias) / 2))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def mlp_scores(rows: DataFrame, network: Network | dict[int, Network], bin_column: str | None = None) -> DataFrame:
    """The rows with ``features`` replaced by ``score``; with several networks each row's bin names its own.

    Rows whose bin has no network get a null score.
    """
    fields = [f for f in rows.schema.fields if f.name != "features"]

    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x, score = _matrix(b.column("features")), np.full(len(b), np.nan)
            if bin_column is None:
                score = network.score(x)
            else:
                bins = np.array(b.column(bin_column).to_pylist(), float)
                for k in network.keys() & set(bins[~np.isnan(bins)].astype(int).tolist()):
                    score[bins == k] = network[k].score(x[bins == k])
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in fields), pa.array(score, pa.float64(), from_pandas=True)], names=[*(f.name for f in fields), "score"])

    return rows.mapInArrow(function, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "score double"]))


def sampled(rows: DataFrame, by: list[str], most: int, sizes: DataFrame | None = None) -> DataFrame:
    """About ``most`` rows of each larger group, by a hash of the row's key, or of all columns if it has none beside arrays.

    sizes: (by, _n), counted here unless given; where it is small it is broadcast, so the rows aren't shuffled to be drawn.
    """
    if sizes is None:
        sizes = kept(rows.groupBy(*by).agg(F.count("*").alias("_n")))
    plain = [n for n, kind in rows.dtypes if not kind.startswith("array")]
    key = plain if set(plain) - {*by, "label"} else rows.columns
    chance = F.pmod(F.xxhash64(*key), F.lit(1_000_003)) / 1_000_003
    return rows.join(bounded(sizes), by).filter(chance < most / F.col("_n")).drop("_n")


def kept(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or the checkpoints' own; only under a local master one is chosen where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def bounded(groups: DataFrame) -> DataFrame:
    """With a broadcast hint if the groups' values take ``BROADCAST_BYTES`` at most, so that rows meet their group's model where they lie.

    The groups should be materialised, as their bytes are summed here.
    """
    return F.broadcast(groups) if stored_bytes(groups) <= BROADCAST_BYTES else groups


def stored_bytes(groups: DataFrame) -> int:
    """About the bytes of the groups' values."""
    size = F.lit(0)
    for f in groups.schema.fields:
        column, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        size = size + F.coalesce(F.octet_length(column) if kind in ("string", "binary") else 8 * F.size(column) if kind.startswith("array") else F.lit(8), F.lit(8))
    return groups.agg(F.sum(size.cast("long"))).first()[0] or 0


def with_models(rows: DataFrame, model: DataFrame, by: list[str], names: list[str], function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` of ``function(batch, groups)``; groups: (places, values of ``names`` or None) for each group of the batch.

    Models of ``BROADCAST_BYTES`` at most are sent to each executor once and looked up. Beyond that each row is joined with
    its group's model by a shuffle. model has one row a group and should be materialised.
    """
    small = stored_bytes(model.select(*by, *names)) <= BROADCAST_BYTES
    table = None
    if small:
        found = {tuple(r[: len(by)]): tuple(r[len(by) :]) for r in model.select(*by, *names).collect()}  # bounded above
        table = rows.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            places: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*(b.column(k).to_pylist() for k in by), strict=True)):
                places.setdefault(key, []).append(i)
            if table is not None:
                groups = [(at, table.value.get(key)) for key, at in places.items()]
            else:
                groups = [(at, tuple(b.column(n)[at[0]].as_py() for n in names) if b.column("_met")[at[0]].as_py() else None) for at in places.values()]
            yield function(b, groups)

    joined = rows if small else rows.join(model.select(*by, *names, F.lit(True).alias("_met")), by, "left")
    return joined.mapInArrow(run, schema)


def _merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """``features.moments`` of groups from those of their parts."""
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    squares = F.sum(F.col("n") * (F.col("sd") * F.col("sd") + F.col("mean") * F.col("mean"))) / F.sum("n")
    whole = parts.groupBy(*by, "k").agg(n.alias("n"), mean.alias("mean"), squares.alias("squares"), F.min("low").alias("low"), F.max("high").alias("high"))
    return whole.withColumn("sd", F.sqrt(F.greatest(F.lit(0.0), F.col("squares") - F.col("mean") * F.col("mean")))).drop("squares")


def _fourier(dimension: int, gamma: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions and phases whose cosines' products approach exp(-gamma |x - y|^2)."""
    rng = np.random.default_rng(seed)
    return rng.normal(0, np.sqrt(2 * gamma), (dimension, FOURIER)), rng.uniform(0, 2 * np.pi, FOURIER)


def _mapped(x: np.ndarray, low: np.ndarray, high: np.ndarray, gamma: float) -> np.ndarray:
    wide = high > low
    x = np.where(wide, (x - low) / np.where(wide, high - low, 1), x)
    directions, phases = _fourier(x.shape[1], gamma, 7)
    return np.cos(x @ directions + phases) * np.sqrt(2 / FOURIER)


class BadModel(ValueError):
    """A stored model whose parts don't fit together."""


class OneClass(ValueError):
    """A group has rows of one label alone."""


def train_svm(rows: DataFrame, by: list[str], c: float = 1.0, sample: int = SAMPLE, strict: bool = False) -> DataFrame:
    """(by, weights, bias, low, high, gamma): a soft-margin classifier with a radial kernel for each group.

    rows: by, features, label (1, -1, or null for rows that aren't used) and the row's own key, which draws at most about
    ``sample`` rows of each label. Features are scaled to the ranges of all labelled rows, gamma is 1 / (features * variance);
    the kernel is approached by random Fourier features and the margin found by averaged subgradient steps. A group without
    both labels has no model; with ``strict`` one that has a single label raises OneClass.
    """
    labelled = rows.filter("label is not null")
    parts = kept(features.moments(labelled, [*by, "label"]))
    used = sampled(labelled, [*by, "label"], sample, parts.filter("k = 0").select(*by, "label", F.col("n").alias("_n"))).select(*by, "features", "label")
    stats = features.min_max(_merged(parts, by))
    stats = stats.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("k", "low", "high", "mean", "sd"))).alias("x")).select(*by, *(F.col(f"x.{c}").alias(c) for c in ("low", "high", "mean", "sd")))
    kinds = dict(rows.dtypes)

    def function(group: pd.DataFrame, ranges: pd.DataFrame) -> pd.DataFrame:
        names = [*by, "weights", "bias", "low", "high", "gamma"]
        if strict and group["label"].nunique() == 1:
            raise OneClass(f"{group[by].iloc[0].tolist()}: every labelled row is {group['label'].iloc[0]}")
        if not len(ranges) or group["label"].nunique() < 2:
            return pd.DataFrame(columns=names)
        y, x = group["label"].to_numpy(float), np.stack(group["features"].to_numpy())
        low, high, mean, sd = (np.array(ranges[c].iloc[0]) for c in ("low", "high", "mean", "sd"))
        wide = high > low
        width = np.where(wide, high - low, 1)
        mean, sd = np.where(wide, (mean - low) / width, mean), sd / width
        gamma = 1 / (x.shape[1] * max((sd**2 + mean**2).mean() - mean.mean() ** 2, 1e-12))
        z = np.hstack([_mapped(x, low, high, gamma), np.ones((len(x), 1))])
        weight = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
        rng, w, total, steps = np.random.default_rng(1), np.zeros(z.shape[1]), np.zeros(z.shape[1]), 0
        shrink = 1 / (c * len(y))
        for _ in range(PASSES):
            order = rng.permutation(len(y))
            for at in range(0, len(y), 32):
                i = order[at : at + 32]
                steps += 1
                late = y[i] * (z[i] @ w) < 1
                gradient = shrink * w - ((weight[i] * y[i] * late)[:, None] * z[i]).mean(axis=0)
                w = w - gradient / (shrink * (steps + 1 / (0.5 * shrink)))
                total += w
        w = total / steps
        return pd.DataFrame([[*group[by].iloc[0], w[:-1].tolist(), w[-1], low.tolist(), high.tolist(), gamma]], columns=names)

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in by) + ", weights array<double>, bias double, low array<double>, high array<double>, gamma double"
    return kept(used.groupBy(*by).cogroup(stats.groupBy(*by)).applyInPandas(function, schema))


def svm_scores(rows: DataFrame, model: DataFrame, by: list[str]) -> DataFrame:
    """The rows with ``features`` replaced by ``score``, the sigmoid of the margin; 0 in groups without a model."""
    fields = [f for f in rows.schema.fields if f.name != "features"]

    def function(b: pa.RecordBatch, groups: list) -> pa.RecordBatch:
        x, score = _matrix(b.column("features")), np.zeros(len(b))
        for at, found in groups:
            if found:
                w, bias, low, high, gamma = found
                score[at] = 1 / (1 + np.exp(-(_mapped(x[at], np.array(low), np.array(high), gamma) @ np.array(w) + bias)))
        return pa.RecordBatch.from_arrays([*(b.column(f.name) for f in fields), pa.array(score)], names=[*(f.name for f in fields), "score"])

    return with_models(rows, model, by, ["weights", "bias", "low", "high", "gamma"], function, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "score double"]))


def auto_clusters(gc: float, table: str = "11") -> int:
    """2 to 6 clusters, more for high G+C."""
    return (2 if table == "11" else 3) if gc < 0.28 else 3 if gc < 0.40 else 4 if gc < 0.57 else 5 if gc < 0.626 else 6


def auto_long(gc: Column) -> Column:
    """The least length of the ORFs that are clustered, by the share of G+C of their genome."""
    return F.when((gc < 0.45) | (gc >= 0.63), 180).otherwise(240)


def positive(n: np.ndarray, trusted: np.ndarray, centroids: np.ndarray) -> int:
    """The cluster with the densest trusted rows; among those within a twentieth of the best so far the one nearest the first."""
    best, score, distance = 0, -1.0, np.inf
    for j in np.nonzero(n)[0]:
        density, d = trusted[j] ** 2 / n[j], float(np.sqrt(((centroids[j] - centroids[0]) ** 2).sum()))
        if density > 1.05 * score or density > 0.95 * score and d < distance:
            best, score, distance = int(j), density, d
    return best


def collapsed(gc: float, n: np.ndarray, k: int) -> bool:
    """Whether a restart of a genome of low G+C has an empty cluster, or one of under a fiftieth of the rows."""
    return gc < 0.35 and ((n > 0).sum() < k or n.min() < max(2, n.sum() // 50))


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(axis=1) - 2 * x @ centroids.T).argmin(axis=1)


def _blocks(rows: DataFrame, stats: DataFrame, by: list[str]) -> DataFrame:
    """(by, x, key, seed): the standardised features of up to ``BLOCK`` rows of a group, their keys and whether they are trusted."""
    kinds = dict(rows.dtypes)

    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*(b.column(k).to_pylist() for k in by), strict=True)):
                groups.setdefault(key, []).append(i)
            if not groups:
                continue
            x, key = _matrix(b.column("features")), b.column("_key").to_numpy()
            seed = np.array(b.column("is_seed").fill_null(False).to_pylist(), np.uint8)
            out = []
            for name, at in groups.items():
                mean, sd = (np.array(b.column(c)[at[0]].as_py()) for c in ("mean", "sd"))
                z = ((x[at] - mean) / np.where(sd < 1e-9, 1, sd)).astype(np.float32)
                for i in range(0, len(at), BLOCK):
                    part = at[i : i + BLOCK]
                    out.append((*name, z[i : i + BLOCK].tobytes(), key[part].tobytes(), seed[part].tobytes()))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, b.schema.field(k).type) for c, k in zip(columns, by, strict=False)), *(pa.array(c, pa.binary()) for c in columns[len(by) :])], names=[*by, "x", "key", "seed"])

    keyed = rows.withColumn("_key", F.xxhash64(*rows.columns)).select(*by, "features", "is_seed", "_key")
    return keyed.join(bounded(stats.select(*by, "mean", "sd")), by).mapInArrow(function, ", ".join(f"`{k}` {kinds[k]}" for k in by) + ", x binary, key binary, seed binary")


def _on_blocks(blocks: DataFrame, state: DataFrame | list[dict], by: list[str], few: bool, function: Callable, schema: str, add: bool = False) -> DataFrame:
    """Rows (by, schema) that ``function(x, key, seed, states)`` gives for each block and the rows of its group in ``state``.

    A state of few bytes is sent to each executor once; beyond that it is joined by a shuffle. With ``add`` the rows are
    (r, bytes of doubles) and are added up in each task by group and r, so that the shuffle takes one row each of them.
    """
    kinds, names = dict(blocks.dtypes), [*by, *(x.split()[0] for x in schema.split(", "))]
    table, joined = None, blocks
    if few:
        found: dict[tuple, list[dict]] = {}
        for row in state if isinstance(state, list) else state.toArrow().to_pylist():  # bounded by the caller
            found.setdefault(tuple(row[k] for k in by), []).append(row)
        table = blocks.sparkSession.sparkContext.broadcast(found)
    else:
        joined = blocks.join(state.groupBy(*by).agg(F.collect_list(F.struct(*(c for c in state.columns if c not in by))).alias("state")), by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields: list = []
        total: dict[tuple, np.ndarray] = {}

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), fields, strict=True)], names=names)

        def sums() -> list[tuple]:
            rows = [(*name, value.tobytes()) for name, value in total.items()]
            total.clear()
            return rows

        for b in batches:
            fields = [*(b.schema.field(k).type for k in by), *(ARROW[t.split()[1]] for t in schema.split(", "))]
            for i in range(len(b)):
                group = tuple(b.column(k)[i].as_py() for k in by)
                states = b.column("state")[i].as_py() if table is None else table.value.get(group)
                if not states:
                    continue
                key = np.frombuffer(b.column("key")[i].as_py(), np.int64).view(np.uint64)
                x = np.frombuffer(b.column("x")[i].as_py(), np.float32).reshape(len(key), -1)
                seed = np.frombuffer(b.column("seed")[i].as_py(), np.uint8)
                rows = list(function(x, key, seed, states))
                if not add and rows:
                    yield batch([(*group, *row) for row in rows])
                for r, value in rows if add else ():
                    total[*group, r] = total.get((*group, r), 0) + value
                if sum(v.nbytes for v in total.values()) > BROADCAST_BYTES:
                    yield batch(sums())
        if total:
            yield batch(sums())

    return joined.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in by) + ", " + schema)


def _noise(key: np.ndarray, r: int, draw: int) -> np.ndarray:
    """Gumbel noise of each row, restart and draw, from a hash (the splitmix64 finaliser), so that it doesn't depend on tasks."""
    z = key + np.uint64((1 + r * 64 + draw) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return -np.log(-np.log(((z >> np.uint64(11)).astype(float) + 0.5) / 2.0**53))


def trials(k: int) -> int:
    """Candidates drawn for each further centroid of k."""
    return 2 + int(np.log(k))


def _apart(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows and centroids."""
    return np.maximum(0, (x.astype(float) ** 2).sum(axis=1)[:, None] + (c**2).sum(axis=1) - 2 * x @ c.astype(np.float32).T)


def _apart_each(x: np.ndarray, centroids: list[bytes]) -> list[np.ndarray]:
    """``_apart`` for each of several sets of centroids, by one product of matrices."""
    sets = [np.frombuffer(c).reshape(-1, x.shape[1]) for c in centroids]
    return np.split(_apart(x, np.vstack(sets)), np.cumsum([len(c) for c in sets])[:-1], axis=1)


def fitted_clusters(rows: DataFrame, by: list[str], restarts: int = RESTARTS, steps: int = STEPS, extra: int = EXTRA, clusters: int | None = None, table: str = "11") -> DataFrame:
    """(by, mean, sd, centroids, coding, restart, sse): clusters of every group over all its rows, a step of all restarts a pass.

    Each block of rows gives sums by cluster, which are joined by restart, so no task holds a group's rows. The first
    centroid is the row nearest the trusted rows' mean. For each further one ``trials`` rows are drawn by squared distance (the
    largest log of it plus Gumbel noise) and the one that leaves the least sum of squared distances stays; the draws of all
    restarts take one pass, their sums another. A group of low G+C whose restarts have all ``collapsed`` gets ``extra`` more
    and takes the first sound one, or the last of all. ``sse`` is the sum of squared distances to
    the nearest centroids. Rows have the group's ``genome_gc`` or else it is that of the rows; where they have ``is_long``, only
    rows for which it holds are clustered, though all give the means and deviations. There are ``clusters`` clusters, if given.
    """
    kinds, spark = dict(rows.dtypes), rows.sparkSession
    keyed = ", ".join(f"`{k}` {kinds[k]}" for k in by)
    # what gives the group's G+C is summed with the features, as two more of them
    shares = [F.col("genome_gc"), F.lit(1.0)] if "genome_gc" in rows.columns else [F.col("n_gc").cast("double"), F.col("len").cast("double")]
    is_long = F.coalesce(F.col("is_long"), F.lit(False)) if "is_long" in rows.columns else F.lit(True)
    wide = rows.select(*by, F.coalesce("is_seed", F.lit(False)).alias("is_seed"), is_long.alias("is_long"), F.concat("features", F.array(*shares)).alias("features"))
    parts = kept(features.moments(wide, [*by, "is_seed", "is_long"]))
    mean, sd = features.as_array(_merged(parts, by), by, F.col("mean"), "mean"), features.as_array(_merged(parts, by), by, F.col("sd"), "sd")
    trusted = features.as_array(_merged(parts.filter("is_seed"), by), by, F.col("mean"), "trusted")
    n = parts.filter("k = 0 and is_long").groupBy(*by).agg(F.sum("n").alias("n"))
    stats = mean.join(sd, by).join(n, by).join(trusted, by, "left").withColumn("gc", F.element_at("mean", -2) / F.element_at("mean", -1))
    stats = kept(stats.select(*by, *(F.slice(c, 1, F.size("mean") - 2).alias(c) for c in ("mean", "sd", "trusted")), "gc", "n"))
    # ranges keep a group's blocks in few tasks, which send few sums, and split a large group
    blocks = kept(kept(_blocks(rows.filter(is_long), stats, by)).repartitionByRange(*by, F.xxhash64("key")))
    width = stats.agg(F.max(F.size("mean"))).first()[0] or 0
    # eight bytes for each feature of six centroids and three tries, at most, of every run
    few = 8 * 9 * width * restarts * stats.count() <= BROADCAST_BYTES

    def settled(state: DataFrame) -> DataFrame:
        return spark.createDataFrame(state.toArrow(), state.schema) if few else kept(state)

    def anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for *group, mean, sd, near, gc, n in zip(*(b.column(c).to_pylist() for c in [*by, "mean", "sd", "trusted", "gc", "n"]), strict=True):
                mean, sd = np.array(mean), np.array(sd)
                point = (np.array(mean if near is None else near) - mean) / np.where(sd < 1e-9, 1, sd)
                out.append((*group, point.tobytes(), min(clusters or auto_clusters(gc, table), n), gc))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [*(b.schema.field(k).type for k in by), pa.binary(), pa.int32(), pa.float64()], strict=True)], names=[*by, "c", "size", "gc"])

    def nearest_row(x, key, seed, states):
        d = ((x - np.frombuffer(states[0]["c"])) ** 2).sum(axis=1)
        i = d.argmin()
        yield float(-d[i]), x[i].astype(float).tobytes()

    def drawn(x, key, seed, states):
        for s, d in zip(states, _apart_each(x, [s["c"] for s in states]), strict=True):
            log = np.log(np.maximum(d.min(axis=1), 1e-300))
            for t in range(trials(s["size"])):
                score = log + _noise(key, s["r"], 8 * d.shape[1] + t)
                i = score.argmax()
                yield s["r"], t, float(score[i]), x[i].astype(float).tobytes()

    def left_over(x, key, seed, states):
        found, tried = _apart_each(x, [s["c"] for s in states]), _apart_each(x, [s["tries"] for s in states])
        for s, d, e in zip(states, found, tried, strict=True):
            yield s["r"], np.minimum(d.min(axis=1)[:, None], e).sum(axis=0)

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = []
            for old, tries, sums in zip(*(b.column(n).to_pylist() for n in ("c", "tries", "sums")), strict=True):
                sums = np.frombuffer(sums)
                c.append(old + np.frombuffer(tries).reshape(len(sums), -1)[sums.argmin()].tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in [*by, "r"]), pa.array(c, pa.binary()), b.column("size"), b.column("gc")], names=[*by, "r", "c", "size", "gc"])

    def added(parts: DataFrame) -> DataFrame:
        def function(group: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([[*group[[*by, "r"]].iloc[0], np.sum([np.frombuffer(p) for p in group["sums"]], axis=0).tobytes()]], columns=[*by, "r", "sums"])

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple, np.ndarray] = {}
            schema = None
            for b in batches:
                schema = b.schema
                for row in b.to_pylist():
                    name = tuple(row[k] for k in [*by, "r"])
                    total[name] = total.get(name, 0) + np.frombuffer(row["sums"])
            if total:
                yield pa.RecordBatch.from_pylist([dict(zip([*by, "r"], name, strict=True)) | {"sums": v.tobytes()} for name, v in total.items()], schema)

        if few:  # all sums together are small
            return parts.repartition(*by, "r").mapInArrow(sums, f"{keyed}, r int, sums binary")
        return parts.groupBy(*by, "r").applyInPandas(function, f"{keyed}, r int, sums binary")

    start = settled(stats.mapInArrow(anchor, f"{keyed}, c binary, size int, gc double"))
    nearest_rows = _on_blocks(blocks, start, by, few, nearest_row, "score double, x binary").groupBy(*by).agg(F.max_by("x", F.struct("score", "x")).alias("c"))
    first = settled(start.drop("c").join(nearest_rows, by))

    def begun(groups: DataFrame, low: int, high: int) -> DataFrame:
        """(by, r, c, size, gc): the first centroids of the restarts from low to high."""
        state = settled(groups.select(*by, F.explode(F.sequence(F.lit(low), F.lit(high - 1))).alias("r"), "c", "size", "gc"))
        for j in range(1, groups.agg(F.max("size")).first()[0] or 0):
            growing = state.filter(F.col("size") > j)
            picks = _on_blocks(blocks, growing, by, few, drawn, "r int, t int, score double, x binary").groupBy(*by, "r", "t").agg(F.max_by("x", F.struct("score", "x")).alias("x"))
            picks = picks.groupBy(*by, "r").agg(F.sort_array(F.collect_list(F.struct("t", "x"))).alias("x"))
            picks = picks.select(*by, "r", F.aggregate(F.col("x.x"), F.lit(b""), lambda a, x: F.concat(a, x)).alias("tries"))
            tried = settled(growing.join(picks, [*by, "r"]))
            sums = added(_on_blocks(blocks, tried, by, few, left_over, "r int, sums binary", add=True))
            grown = tried.join(sums, [*by, "r"]).mapInArrow(taken, f"{keyed}, r int, c binary, size int, gc double")
            state = settled(state.filter(F.col("size") <= j).unionByName(grown))
        return state

    def sums(x, key, seed, states):
        one = np.zeros((len(x), sum(s["size"] for s in states)), np.float32)
        at = 0
        for s, d in zip(states, _apart_each(x, [s["c"] for s in states]), strict=True):
            one[np.arange(len(x)), at + d.argmin(axis=1)] = 1
            at += s["size"]
        total = np.hstack([one.T @ x, one.sum(axis=0)[:, None]]).astype(float)
        at = 0
        for s in states:
            yield s["r"], total[at : at + s["size"]].ravel()
            at += s["size"]

    def moved(row: dict, total: bytes) -> dict:
        c, total = np.frombuffer(row["c"]).reshape(row["size"], -1), np.frombuffer(total).reshape(row["size"], -1)
        new = np.where(total[:, -1:] > 0, total[:, :-1] / np.maximum(total[:, -1:], 1), c)
        return row | {"c": new.tobytes(), "open": bool(((new - c) ** 2).sum(axis=1).max() >= DRIFT**2)}

    def moved_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [moved(row, row.pop("sums")) for row in b.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([f for f in b.schema if f.name != "sums"]))

    def sizes(x, key, seed, states):
        for s, d in zip(states, _apart_each(x, [s["c"] for s in states]), strict=True):
            label = d.argmin(axis=1)
            yield s["r"], np.concatenate([np.bincount(label, minlength=s["size"]), np.bincount(label, seed, s["size"]), [d.min(axis=1).sum()]])

    def wave(groups: DataFrame, low: int, high: int) -> DataFrame:
        """(by, r, c, size, gc, sums): the settled centroids of the restarts, with rows and trusted rows by cluster and the sse."""
        state = begun(groups, low, high).withColumn("open", F.lit(True))
        schema, rows = state.schema, state.toArrow().to_pylist() if few else []
        state = None if few else kept(state)
        for _ in range(steps):
            running = [row for row in rows if row["open"]] if few else state.filter("open")
            if not running if few else running.isEmpty():
                break
            total = added(_on_blocks(blocks, running, by, few, sums, "r int, sums binary", add=True))
            if few:
                found = {tuple(row[k] for k in [*by, "r"]): row["sums"] for row in total.toArrow().to_pylist()}
                rows = [moved(row, found[tuple(row[k] for k in [*by, "r"])]) if row["open"] else row for row in rows]
            else:
                new = running.join(total, [*by, "r"]).select(*state.columns, "sums").mapInArrow(moved_rows, state.schema)
                state = kept(state.filter("not open").unionByName(new))
        if few:
            state = spark.createDataFrame([tuple(row[n] for n in schema.names) for row in rows], schema)
        counts = added(_on_blocks(blocks, state, by, few, sizes, "r int, sums binary", add=True))
        return settled(state.drop("open").join(counts, [*by, "r"]))

    def chosen(runs: DataFrame, how: str) -> DataFrame:
        """The best restart of each group by its densest cluster, the first sound one, or the last; none where all have collapsed."""
        names = [*by, "restart", "centroids", "coding", "sse"]

        def function(group: pd.DataFrame) -> pd.DataFrame:
            most, kept, out = -1.0, None, []
            for _, row in group.sort_values("r").iterrows():
                n, trusted = np.split(np.frombuffer(row["sums"])[:-1], 2)
                density = (trusted**2 / np.maximum(n, 1)).max()
                sound = not collapsed(row["gc"], n, int(row["size"]))
                if how == "last" or sound and (density > 1.01 * most if how == "best" else kept is None):
                    most, kept = density, (row, n, trusted)
            if kept:
                row, n, trusted = kept
                c = np.frombuffer(row["c"])
                out.append([*row[[*by, "r"]], c.tolist(), positive(n, trusted, c.reshape(len(n), -1)), float(np.frombuffer(row["sums"])[-1])])
            return pd.DataFrame(out, columns=names)

        return runs.groupBy(*by).applyInPandas(function, f"{keyed}, restart int, centroids array<double>, coding int, sse double")

    model = settled(chosen(wave(first, 0, restarts), "best"))
    left = settled(first.join(model, by, "left_anti"))
    if not left.isEmpty():
        few = 8 * 9 * width * (extra or 1) * left.count() <= BROADCAST_BYTES
        runs = wave(left, restarts, restarts + extra) if extra else wave(left, restarts - 1, restarts)
        model = settled(model.unionByName(chosen(runs, "first")))
        model = model.unionByName(chosen(runs.join(model.select(*by), by, "left_anti"), "last"))
    sd = F.transform("sd", lambda v: F.when(v < 1e-9, 1.0).otherwise(v)).alias("sd")
    return kept(stats.select(*by, "mean", sd).join(model, by))


def cluster_labels(rows: DataFrame, by: list[str], clusters: int | None = None, table: str = "11") -> DataFrame:
    """The rows with ``features`` replaced by ``i_score``: 0.75 in the coding cluster of their group, else 0.25.

    Rows for which an ``is_long`` doesn't hold score 0.

    rows: by, features, is_seed, n_gc, len and the row's own key. Features are standardised over all rows of the group, and
    all are clustered.
    """
    model = fitted_clusters(rows, by, clusters=clusters, table=table)
    fields = [f for f in rows.schema.fields if f.name != "features"]

    def assign(b: pa.RecordBatch, groups: list) -> pa.RecordBatch:
        x, score = _matrix(b.column("features")), np.full(len(b), 0.25)
        for at, found in groups:
            if found:
                mean, sd, c, coding = found
                label = nearest((x[at] - np.array(mean)) / np.array(sd), np.array(c).reshape(-1, x.shape[1]))
                score[np.array(at)[label == coding]] = 0.75
        if "is_long" in b.schema.names:
            score[~np.array(b.column("is_long").fill_null(False).to_pylist(), bool)] = 0
        return pa.RecordBatch.from_arrays([*(b.column(f.name) for f in fields), pa.array(score)], names=[*(f.name for f in fields), "i_score"])

    return with_models(rows, model, by, ["mean", "sd", "centroids", "coding"], assign, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "i_score double"]))


def save_model(model: DataFrame, path: str) -> None:
    """Model tables are Parquet, one row a genome."""
    model.write.mode("overwrite").parquet(path)


def load_svm(spark, path: str) -> DataFrame:
    """A stored table of ``train_svm``; rows whose arrays don't fit together fail."""
    model = spark.read.parquet(path)
    sound = (F.size("weights") == FOURIER) & (F.size("low") == F.size("high")) & (F.col("gamma") > 0)
    return model.withColumn("gamma", F.when(sound, F.col("gamma")).otherwise(F.raise_error(F.lit("not a sound classifier"))))
