import numpy as np
import pytest

from helixframe.operators import trainer

SCHEMA = "i int, features array<double>, label double"


def test_gradient_equals_differences():
    rng = np.random.default_rng(3)
    x, y, hidden = rng.normal(size=(20, 4)), rng.integers(0, 2, 20).astype(float), 3
    w = rng.normal(size=hidden * 4 + 2 * hidden + 1)
    got = trainer.sums(w, x, y, hidden)[: len(w)]
    for i in range(len(w)):
        up, down = w.copy(), w.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        want = (trainer.sums(up, x, y, hidden, False)[0] - trainer.sums(down, x, y, hidden, False)[0]) / 2e-6
        assert abs(got[i] - want) < 1e-5 * max(1, abs(want))


def test_counts_and_measures():
    x, w = np.array([[1.0], [-1.0], [2.0]]), np.array([1.0, 0.0, 1.0, -0.5])  # logit max(0, x) - 1/2
    counts = trainer.sums(w, x, np.array([1.0, 1.0, 0.0]), 1, False)
    assert counts[1:].tolist() == [3, 1, 1, 1, 0]
    assert trainer.measures(counts)["f1"] == 0.5 and abs(counts[0] - sum(np.log1p(np.exp(-s * z)) for s, z in ((1, 0.5), (1, -0.5), (-1, 1.5)))) < 1e-12


def test_steps_are_halved_on_a_plateau():
    adam = trainer.Adam(2, 0.1, 2)
    for loss in (1.0, 0.9, 0.9, 0.9, 0.9):
        adam.seen(loss)
    assert adam.rate == 0.05
    assert np.allclose(trainer.Adam(2, 0.1, 2).step(np.array([3.0, -1.0])), [0.1, -0.1])


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    made = [(i, [float(v) for v in np.append(rng.normal(0, 1, 3) * 50 + 7, 4.0)], 0.0) for i in range(1200)]
    return spark.createDataFrame([(i, f, float(abs(f[0] - 7) > 40)) for i, f, _ in made] + [(5000, [0.0] * 4, None)], SCHEMA).repartition(5).cache()


def test_learns_what_no_line_divides(spark, rows, tmp_path):
    network, table = trainer.train_network(rows, ["i"], 0.2, hidden=16, epochs=12, steps=6, rate=0.05)
    epochs = table.orderBy("epoch").collect()
    assert [r.epoch for r in epochs] == list(range(1, 13)) and epochs[-1].loss < 0.5 * epochs[0].loss
    best = max(r.held_f1 for r in epochs)
    assert best > 0.85
    trainer.save_network(spark, network, str(tmp_path / "network"))
    again = trainer.load_network(spark, str(tmp_path / "network"))
    assert again == network
    held = rows.filter("label is not null").filter(trainer._held(["i"], 0.2, 42)).collect()
    hit = np.array([again.score(np.array([r.features]))[0] >= 0.5 for r in held])
    y = np.array([r.label > 0 for r in held])
    assert abs(2 * (hit & y).sum() / (hit.sum() + y.sum()) - best) < 1e-6
    train = [r.features for r in rows.filter("label is not null").filter(~trainer._held(["i"], 0.2, 42)).collect()]
    np.testing.assert_allclose(network.mean, np.mean(train, axis=0))
    np.testing.assert_allclose(network.sd, [*np.std(train, axis=0)[:3], 1.0])


def test_every_row_is_in_one_batch_of_an_epoch():
    draw = np.random.default_rng(1).integers(-(2**62), 2**62, 4000)
    for epoch in (0, 7):
        of = trainer._batch_of(draw, epoch, 5)
        assert set(of) == set(range(5)) and min(np.bincount(of)) > 700
    assert (trainer._batch_of(draw, 0, 5) != trainer._batch_of(draw, 1, 5)).any()


def test_many_sums_are_joined_in_rounds(rows, monkeypatch):
    packed = trainer.blocks(rows.filter("label is not null"), ["i"], np.zeros(4), np.ones(4), 0.2, 42).repartition(9)
    w = np.linspace(-1, 1, 2 * 4 + 5)
    whole = trainer._total(packed, 9, True, w, 2, 0, 0, 1)
    monkeypatch.setattr(trainer, "FAN", 2)
    np.testing.assert_allclose(trainer._total(packed, 9, True, w, 2, 0, 0, 1), whole)


def test_nothing_to_learn(spark):
    with pytest.raises(trainer.NothingToLearn):
        trainer.train_network(spark.createDataFrame([(1, [1.0], None)], SCHEMA), ["i"])
