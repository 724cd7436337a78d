import math

import numpy as np
import pytest
from helixframe.operators import models, networks, ordered, startmodel
from helixframe.operators.networks import StartNetwork, UnifiedNetwork
from pyspark.sql import functions as F


def test_layers():
    rng = np.random.default_rng(3)
    x, w, b = rng.normal(size=(2, 3, 11)), rng.normal(size=(4, 3, 5)), rng.normal(size=4)
    got = networks.convolved(x, w, b, 2)
    assert got.shape == (2, 4, 4)
    for n in range(2):
        for o in range(4):
            for p in range(4):
                assert math.isclose(got[n, o, p], (x[n, :, 2 * p : 2 * p + 5] * w[o]).sum() + b[o])
    v = np.linspace(-4, 4, 50)
    assert np.allclose(networks.gelu(v), [0.5 * a * (1 + math.erf(a / math.sqrt(2))) for a in v], atol=1e-6)
    assert np.allclose(networks.softmax(np.array([[1.0, 1.0], [1000.0, 0.0]])), [[0.5, 0.5], [1, 0]])


def test_channels():
    x = networks.window_channels(["ATGN"])
    assert x.shape == (1, 9, 1) and x[0, :, 0].tolist() == [1, 0, 0, -1, -1, -1, 0, 1, 0]


def test_start_scores(spark):
    network = networks.random_start_network(1, 65, [(9, 16, 7, 2), (16, 24, 5, 2)])
    assert isinstance(network, StartNetwork)
    windows = ["ACGTN" * 13, "TTGCA" * 13]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(windows)], "i int, window string").repartition(2)
    got = {r.i: r.score for r in networks.start_scores(df, network).collect()}
    assert np.allclose([got[0], got[1]], network.score(windows)) and all(0 < s < 1 for s in got.values())


def test_revision(spark):
    rows = [(0.9, 30, 0, 0), (0.9, 95, 0, 0), (0.65, 30, 0, 5), (0.7, 30, 0, 5), (0.2, 30, 0, 5), (None, 30, 0, 8), (None, 30, 0, 3)]
    df = spark.createDataFrame(rows, "score double, new int, old int, edge int")
    start, r = networks.revised_start(F.col("score"), F.col("new"), F.col("old"), F.col("edge"), F.lit(180), 90)
    got = [tuple(x) for x in df.select(start, r).collect()]
    assert got == [(30, 0.9), (0, 0.9), (0, 0.65), (30, 0.7), (0, 0.5), (0, 0.5), (0, 0.0)]


def test_unified(spark):
    network = UnifiedNetwork((np.array([[1.0, -1.0]]), np.array([0.5])), (np.array([2.0]), np.array([0.0])), (np.array([0.0]), np.array([1.0])), (np.array([1.0]), -1.0), np.full(61, 0.4))
    df = spark.createDataFrame([(1, [2.0, 1.0], 0.5, 0), (2, [2.0, 1.0], 0.1, 5)], "i int, features array<double>, gc_cont double, edge_type int")
    got = {r.i: r.c_score for r in networks.unified_scores(df, network).collect()}
    p = lambda gc: 1 / (1 + math.exp(-(1.5 * (1 + 2 * gc) + 1 - 1)))
    assert math.isclose(got[1], p(0.5) + 0.2) and math.isclose(got[2], p(0.1) + 0.35)


def test_stored_classifier(spark, tmp_path):
    df = spark.createDataFrame([("g", i, [float(i % 7), 1.0], 1 if i % 7 > 3 else -1) for i in range(100)], "g string, i int, features array<double>, label int")
    models.save_model(models.train_svm(df, ["g"]), str(tmp_path / "m"))
    assert models.svm_scores(df, models.load_svm(spark, str(tmp_path / "m")), ["g"]).filter("(score > 0.5) = (label > 0)").count() > 90


def test_start_network_scores_the_whole_tail(spark, monkeypatch):
    from helixframe.plans import queries

    seq = "CCC" * 20 + "ATGGCC" * 20 + "TAA" + "CCC" * 20
    c = spark.createDataFrame([("g", 1, False, seq)], "genome_id string, contig_id long, circ boolean, seq string")
    monkeypatch.setattr(queries, "document_contigs", lambda *_: c)

    def by_place(windows, network):
        return windows.drop("window").withColumn("score", windows.j / 1000.0)

    monkeypatch.setattr(queries.networks, "start_scores", by_place)
    starts = queries.orfs.find_orfs(c, 90, complete_only=True).filter("strand = 0").first().starts
    got = {(r.strand, r.end): r.j for r in queries.start_network(spark, "").collect()}
    assert len(starts) > 10 and len(starts) - 1 in got.values()


def test_one_class_raises_where_asked(spark):
    df = spark.createDataFrame([("g", i, [float(i), 1.0], 1) for i in range(20)] + [("h", i, [float(i), 1.0], 1 if i > 9 else -1) for i in range(20)], "g string, i int, features array<double>, label int")
    assert [r.g for r in models.train_svm(df, ["g"]).collect()] == ["h"]
    with pytest.raises(Exception, match="every labelled row is 1"):
        models.train_svm(df, ["g"], strict=True).collect()


def test_models_beyond_the_broadcast_bound(spark, monkeypatch):
    df = spark.createDataFrame([("gh"[i % 2], i, [float(i % 7), float(i % 3)], 1 if i % 7 > 3 else -1) for i in range(200)] + [("none", 1, [1.0, 1.0], None)], "g string, i int, features array<double>, label int")
    model = models.train_svm(df, ["g"])
    scores = lambda: sorted((r.g, r.i, round(r.score, 9)) for r in models.svm_scores(df, model, ["g"]).collect())
    small = scores()
    monkeypatch.setattr(models, "BROADCAST_BYTES", 0)
    assert scores() == small and ("none", 1, 0.0) in small


def test_rounded_scores_are_those_of_exact_ones(monkeypatch):
    rng, network = np.random.default_rng(2), networks.random_start_network(7)
    windows = ["".join(rng.choice(list("ACGTN"), 141, p=[0.25, 0.25, 0.25, 0.24, 0.01])) for _ in range(700)]
    want = np.round(network.score(windows), 5)
    assert (networks.Rounded(network, 5).score(windows) == want).all()
    monkeypatch.setattr(networks.StartNetwork, "score_roughly", lambda self, w: self.score(w) + 1e-5)  # too far off
    assert (networks.Rounded(network, 5).score(windows) == want).all()


@pytest.mark.parametrize("enough", [0.6, 0.35, 0.3])
def test_starts_of_contigs_are_those_of_their_windows(spark, monkeypatch, enough):
    from helixframe.plans import queries

    rng, network = np.random.default_rng(3), networks.random_start_network(7)
    seqs = ["".join(rng.choice(list("ACGT"), n)) for n in (60, 95, 400, 3000)] + ["CCC" * 20 + "ATGGCC" * 20 + "TAA" + "CCC" * 20]
    contigs = spark.createDataFrame([("g", i, s) for i, s in enumerate([*seqs, None])], "genome_id string, contig_id long, seq string")
    monkeypatch.setattr(queries, "document_contigs", lambda *_: contigs)
    scores = networks.start_scores(startmodel.start_windows(contigs, up=networks.UP_WIDE, down=networks.DOWN_WIDE), network)
    keys = ["contig_id", "strand", "end"]
    want = ordered.early_exit(scores.withColumn("score", F.round("score", 5)), keys, "score", "j", networks.FIRST, enough).select(*keys, "j", "score")
    monkeypatch.setattr(networks, "ENOUGH", enough)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)  # rows of a frame go across batches
    found = sorted(map(tuple, queries.start_network(spark, "").collect()))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == sorted(map(tuple, want.collect())) and len(found) > 10


def test_starts_are_chosen_without_a_shuffle(spark):
    from helixframe.plans import queries

    plan = queries.start_network(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("MapInArrow") == 3
