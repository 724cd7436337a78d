import numpy as np
import pytest

from helixframe.llm import whitening as W


def whole(rows):
    return np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in r] for r in rows], np.int64)


def direct(x):
    """Everything from the definitions, on one machine."""
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    y = fit - s / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    off = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    return n, off, values, vectors, ((x - s / n) @ vectors) / np.sqrt(np.maximum(values, 1e-30))


def compare(df, ids, x, k):
    n, off, values, vectors, white = direct(x)
    rows = df.collect()
    assert len(rows) == len(ids) * k and len({(r.vec_id, r.component) for r in rows}) == len(rows)
    got = {(r.vec_id, r.component): r for r in rows}
    for c in range(k):
        mine = np.array([got[i, c + 1].whitened for i in ids])
        sign = np.sign(mine @ white[:, c])
        np.testing.assert_allclose(mine * sign, white[:, c], rtol=1e-8, atol=1e-9)
        np.testing.assert_allclose(got[ids[0], c + 1].explained, values[c] / values.sum(), rtol=1e-11)
    assert all(got[i, 1].n == n and got[i, 1].deviation == d for i, d in zip(ids, off, strict=True))
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-10


@pytest.mark.parametrize("size,count", [(3, 40), (24, 500)])
def test_equals_the_definitions(spark, size, count):
    rng = np.random.default_rng(size)
    v = (rng.normal(size=(count, size)) * np.linspace(0.2, 2, size)).astype(np.float32)
    v[5:9] = v[3]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<float>").repartition(5)
    compare(W.whiten(df), list(range(count)), whole(v), min(16, size))


def test_rank_one_updates_keep_eigenpairs():
    rng = np.random.default_rng(1)
    for size in (1, 2, 6, 20):
        found, x = W.Spectrum(size), np.floor(rng.normal(size=(60, size)) * 4)
        x[10:20] = x[0]
        x[30:36, : size // 2] = 0
        for i, v in enumerate(x):
            found.add(v)
            y = x[: i + 1] - x[: i + 1].mean(axis=0)
            scale = max(1, np.abs(y.T @ y).max())
            np.testing.assert_allclose(found.vectors @ np.diag(found.values) @ found.vectors.T, y.T @ y, atol=1e-12 * scale)
            np.testing.assert_allclose(found.vectors.T @ found.vectors, np.eye(size), atol=1e-12)
            assert (np.diff(found.values) >= 0).all()


def test_equal_values_and_untouched_components_are_deflated():
    values, vectors = np.array([1.0, 1.0, 1.0, 4.0, 9.0]), np.linalg.qr(np.random.default_rng(2).normal(size=(5, 5)))[0]
    for v in (vectors[:, 0] * 2, vectors @ [1, 2, 3, 0, 0], vectors @ [0, 0, 0, 1, 1e-20], vectors @ [1, 1, 1, 1, 1.0]):
        e, u = W.rank_one(values, vectors, v, 0.5)
        np.testing.assert_allclose(u @ np.diag(e) @ u.T, vectors @ np.diag(values) @ vectors.T + 0.5 * np.outer(v, v), atol=1e-13)
        np.testing.assert_allclose(u.T @ u, np.eye(5), atol=1e-14)


def test_roots_of_close_poles():
    d, zz = np.array([0, 1e-9, 1, 1 + 1e-13, 1e6]), np.array([0.2, 1e-18, 0.3, 0.4999, 1e-4])
    roots, gaps = W.secular_roots(d, zz / zz.sum(), 2.5)
    assert (roots[:-1] >= d[:-1]).all() and (roots[:-1] <= d[1:]).all() and d[-1] < roots[-1] <= d[-1] + 2.5
    values = np.linalg.eigvalsh(np.diag(d) + 2.5 * np.outer(np.sqrt(zz / zz.sum()), np.sqrt(zz / zz.sum())))
    np.testing.assert_allclose(roots, values, rtol=1e-9, atol=1e-9)
    assert (np.diag(gaps) < 0).all()


def test_spectra_combine_in_any_order():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 7)) + 3
    parts = []
    for at in (0, 1, 5, 40):
        parts.append(W.Spectrum(7))
        for v in x[at : {0: 1, 1: 5, 5: 40, 40: 90}[at]]:
            parts[-1].add(v)
    parts.append(W.Spectrum(7))
    for order in ([4, 0, 1, 2, 3], [3, 2, 4, 1, 0]):
        found = W.Spectrum.unpacked(parts[order[0]].packed(), 7)
        for i in order[1:]:
            found.join(parts[i])
        np.testing.assert_allclose(found.vectors @ np.diag(found.values) @ found.vectors.T, np.cov(x.T, bias=True) * 90, atol=1e-11)
        np.testing.assert_allclose(found.mean, x.mean(axis=0))
        assert found.n == 90


def test_messy_vectors(spark):
    inf, nan = float("inf"), float("nan")
    good = [[0.5, -0.25], [1.5, 0.75], [-2.0, 0.1], [0.5, -0.25], [3.0, 1.0]]
    bad = [None, [], [1.0, None], [nan, 1.0], [1.0, inf], [-inf, 0.0], [1.0, 2.0, 3.0], [1e30, 1.0]]
    rows = [(i, v, 1) for i, v in enumerate(good)] + [(100 + i, v, 1) for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x int")
    compare(W.whiten(df), list(range(5)), whole(good), 2)
    again = W.whiten(spark.createDataFrame([(None, good[0], 1), (7, good[1], 1), (7, good[1], 1)], df.schema)).collect()
    assert sorted((str(r.vec_id), r.component, r.n) for r in again) == [("7", 1, 2), ("7", 1, 2), ("None", 1, 2)]


@pytest.mark.parametrize("vectors", [[], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 3])
def test_nothing_to_whiten(spark, vectors):
    out = W.whiten(spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>"))
    assert out.count() == 0
    assert out.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]


def test_deviations_are_exact_and_null_beyond_a_long():
    model = {"n": 3, "sums": [30, 31], "centre": np.array([10, 10])}
    assert W.deviations(np.array([[10, 10], [10, 11]]), model) == [1, 4]
    far = {"n": 10**9, "sums": [10**10 + 7, 10**10], "centre": np.array([10, 10])}
    assert W.deviations(np.array([[10, 11], [14, 10]]), far) == [49 + 10**18, None]
