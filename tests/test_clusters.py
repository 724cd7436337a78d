"""Clusters of genomes against a plain loop over the same draws."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import models


def rows_of(spark, groups):
    rows = [(g, i, [float(v) for v in r], bool(s), int(1000 * gc), 1000) for g, x, seeds, gc in groups for i, (r, s) in enumerate(zip(x, seeds, strict=True))]
    df = spark.createDataFrame(rows, "genome_id string, i int, features array<double>, is_seed boolean, n_gc int, len int")
    return df.repartition(5).withColumn("_k", F.xxhash64(*df.columns)).cache()


def distances(x, c):
    return ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)


def plain_run(x, seeds, key, k, r, steps):
    """One restart, row by row as its definition says: (centroids, rows and trusted rows by cluster, sum of squares)."""
    point = x[seeds].mean(axis=0) if seeds.any() else np.zeros(x.shape[1])
    c = x[[distances(x, point[None])[:, 0].argmin()]]
    while len(c) < k:
        left = distances(x, c).min(axis=1)
        tries = []
        for t in range(2 + int(np.log(k))):
            pick = (np.log(np.maximum(left, 1e-300)) + models._noise(key, r, 8 * len(c) + t)).argmax()
            tries.append((np.minimum(left, distances(x, x[[pick]])[:, 0]).sum(), t, pick))
        c = np.vstack([c, x[min(tries)[2]]])
    for _ in range(steps):
        label = distances(x, c).argmin(axis=1)
        new = np.array([x[label == j].mean(axis=0) if (label == j).any() else c[j] for j in range(k)])
        moved = ((new - c) ** 2).sum(axis=1).max()
        c = new
        if moved < 1e-8:
            break
    d = distances(x, c)
    label = d.argmin(axis=1)
    return c, np.bincount(label, minlength=k), np.bincount(label, seeds, k), d.min(axis=1).sum()


def plain(x, seeds, key, gc, restarts, extra, steps):
    x = ((x - x.mean(axis=0)) / x.std(axis=0)).astype(np.float32).astype(float)
    k = min(models.auto_clusters(gc), len(x))
    sound = lambda n: gc >= 0.35 or (n > 0).all() and n.min() >= max(2, n.sum() // 50)
    best, most = None, -1.0
    for r in range(restarts):
        c, n, trusted, sse = plain_run(x, seeds, key, k, r, steps)
        density = (trusted**2 / np.maximum(n, 1)).max()
        if sound(n) and density > 1.01 * most:
            best, most = (r, c, n, trusted, sse), density
    for r in range(restarts, restarts + extra):
        if best is None:
            run = plain_run(x, seeds, key, k, r, steps)
            if sound(run[1]) or r == restarts + extra - 1:
                best = (r, *run)
    r, c, n, trusted, sse = best
    return r, c, models.positive(n, trusted, c), sse


def blobs(rng, sizes, width=4):
    return np.vstack([rng.normal(rng.normal(0, 3, width), 1, (n, width)) for n in sizes])


def check(spark, groups, restarts, extra, steps):
    df = rows_of(spark, groups)
    model = {r.genome_id: r for r in models.fitted_clusters(df.drop("_k"), ["genome_id"], restarts=restarts, steps=steps, extra=extra).collect()}
    keys = {(r.genome_id, r.i): r._k for r in df.collect()}
    assert set(model) == {g for g, *_ in groups}
    for g, x, seeds, gc in groups:
        key = np.array([keys[g, i] for i in range(len(x))], np.int64).view(np.uint64)
        r, c, coding, sse = plain(x, np.array(seeds, bool), key, gc, restarts, extra, steps)
        got = model[g]
        assert (got.restart, got.coding) == (r, coding), g
        assert np.allclose(np.array(got.centroids).reshape(c.shape), c, atol=2e-3) and got.sse == pytest.approx(sse, rel=1e-3)
    return model


def test_restarts_and_trials_equal_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    groups = [(f"g{i}", x := blobs(rng, [90, 60, 40, 30, 80]), rng.random(len(x)) < 0.3, gc) for i, gc in enumerate((0.3, 0.45, 0.55, 0.65))]
    # no trusted row; a single row; rows that are all alike but for two
    groups += [("bare", blobs(rng, [50, 50]), np.zeros(100), 0.45)]
    check(spark, groups, 6, 4, 30)


def test_collapsed_genomes_get_further_restarts(spark):
    rng = np.random.default_rng(8)
    # a few far rows draw centroids to themselves, so that a cluster is under a fiftieth of the rows in every restart or most
    always = np.vstack([rng.normal(0, 0.5, (400, 3)), [[60.0, 60, 60]], [[-60.0, 60, 0]]])
    mostly = np.vstack([rng.normal(-4, 0.3, (150, 3)), rng.normal(0, 0.3, (150, 3)), rng.normal(3, 0.3, (150, 3)), [[9.0, 9, 9]] * 5])
    groups = [("always", always, rng.random(len(always)) < 0.2, 0.3), ("mostly", mostly, rng.random(len(mostly)) < 0.2, 0.32), ("richer", always, rng.random(len(always)) < 0.2, 0.45)]
    model = check(spark, groups, 2, 5, 30)
    assert model["always"].restart == 6 and model["richer"].restart < 2


def test_state_that_is_not_small_is_joined(spark, monkeypatch):
    rng = np.random.default_rng(4)
    groups = [("a", x := blobs(rng, [40, 30, 20]), rng.random(len(x)) < 0.3, 0.45), ("b", y := blobs(rng, [40, 30]), rng.random(len(y)) < 0.3, 0.3)]
    monkeypatch.setattr(models, "BROADCAST_BYTES", 0)
    check(spark, groups, 2, 0, 4)


def test_few_rows_and_none(spark):
    df = rows_of(spark, [("one", np.array([[1.0, 2.0]]), [True], 0.5), ("same", np.ones((30, 2)), [False] * 30, 0.45)])
    model = {r.genome_id: r for r in models.fitted_clusters(df.drop("_k"), ["genome_id"], restarts=3).collect()}
    assert len(model["one"].centroids) == 2 and len(model["same"].centroids) == 8 and model["same"].sse == 0
    assert models.fitted_clusters(df.drop("_k").limit(0), ["genome_id"], restarts=3).count() == 0


def test_long_rows_alone_are_clustered(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (60, 4)), rng.normal(6, 1, (60, 4))])
    seeds = np.arange(120) < 20
    whole = rows_of(spark, [("a", x, seeds, 0.45)]).drop("_k")
    df = whole.withColumn("is_long", F.col("i") % 3 > 0).withColumn("genome_gc", F.lit(0.2))
    got = {r.i: r.i_score for r in models.cluster_labels(df, ["genome_id"]).collect()}
    assert {i for i, s in got.items() if s == 0} == {i for i in range(120) if i % 3 == 0}
    assert {i for i, s in got.items() if s == 0.75} == {i for i in range(60) if i % 3 > 0}  # two clusters, as the genome's own G+C is low
    three = models.fitted_clusters(df, ["genome_id"], restarts=2, clusters=3).first()
    assert len(three.centroids) == 12 and len(models.fitted_clusters(df.withColumn("is_long", F.lit(False)), ["genome_id"], restarts=2).collect()) == 0
    assert np.allclose(three["mean"], x.mean(axis=0))  # all rows give the scale
