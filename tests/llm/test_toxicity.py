import zlib

import numpy as np
from helixframe.llm import toxicity as T

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = T.score_toxicity(docs, labels).collect()
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    held = [(r.predicted, toxic[r.doc_id]) for r in rows if r.held_out and r.doc_id in toxic]
    found = sum(p and t for p, t in held)
    assert found >= 0.9 * sum(t for _, t in held) and found >= 0.95 * sum(p for p, _ in held)


def sentences():
    rng = np.random.default_rng(4)
    filler = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(600):
        words = rng.choice(filler, 12).tolist()
        toxic = i % 3 == 0
        if toxic and i % 2:
            words[3] = "rotten"
        if rng.random() < (0.8 if toxic else 0.05):
            words[7] = "muslim"
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_counterfactual_penalty(spark):
    """A group that toxic sentences often name doesn't make a neutral sentence toxic."""
    df = spark.createDataFrame(sentences(), "doc_id long, text string, toxic int")
    change = {}
    for penalty in (0.0, 20.0):
        model = T.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"), penalty=penalty)
        words = T.Words(model.known)
        change[penalty] = model.score("w1 w2 a muslim family w3", words) - model.score("w1 w2 a jewish family w3", words)
        assert model.score("w1 rotten w2", words) > 0.5 > model.score("w1 w2 w4", words)
    assert change[0.0] > 0.1 and abs(change[20.0]) < 0.3 * change[0.0]


def test_pairs():
    assert T.swapped("The Muslim, and the women!") == "the jewish, and the men!"
    assert T.swapped("nobody") is None and T.swapped("") is None
    assert T.counterfactual("The Muslim, yes") == ("The Muslim, yes", "the jewish, yes", False)
    one, other, put_in = T.counterfactual("nobody here")
    a, b = one.removesuffix(" nobody here"), other.removesuffix(" nobody here")
    assert put_in and T.SWAPS[a] == b != a


def test_gradient():
    """Against finite differences, pairs included."""
    rng = np.random.default_rng(0)
    draw = lambda: [rng.choice(6, rng.integers(0, 4), replace=False).tolist() for _ in range(30)]
    x, a, b = (T.Sparse(draw()) for _ in range(3))
    label, w = rng.integers(0, 2, 30).astype(float), rng.normal(size=7)
    for penalty in (0.0, 3.0):
        f = lambda v, penalty=penalty: T.objective(v, x, label, a, b, 0.1, penalty)[0]
        want = [(f(w + 1e-6 * e) - f(w - 1e-6 * e)) / 2e-6 for e in np.eye(7)]
        assert np.allclose(T.objective(w, x, label, a, b, 0.1, penalty)[1], want, atol=1e-6)


def test_training():
    rng = np.random.default_rng(0)
    x = [rng.choice(6, 3, replace=False).tolist() for _ in range(40)]
    label = np.array([float(0 in r) for r in x])
    w, b, _ = T.train(x, label, [], 6)
    p = [1 / (1 + np.exp(-(b + sum(w[i] for i in r)))) for r in x]
    assert all((q > 0.5) == (t == 1) for q, t in zip(p, label, strict=True))


def test_penalty_on_the_tables(spark):
    """The synthetic texts name no group, yet the penalty is active and moves scores less on neutral mentions."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    texts = [r.text for r in docs.join(labels.filter("toxic = 0"), "doc_id").limit(200).collect()]
    moved = {}
    for penalty in (0.0, T.COUNTERFACTUAL):
        model = T.fit(docs, labels, penalty=penalty)
        words = T.Words(model.known)
        moved[penalty] = model.change, max(abs(model.score(f"{t} {text}", words) - model.score(f"{T.SWAPS[t]} {text}", words)) for text in texts for t in T.TERMS[::7])
    print(moved)
    assert moved[0.0][0] > 1e-7 and moved[T.COUNTERFACTUAL][0] < moved[0.0][0] and moved[T.COUNTERFACTUAL][1] < 0.5


def test_repeated_ids(spark):
    docs = spark.createDataFrame([(i % 4, f"text {i} {'rotten' if i % 2 else 'fine'}") for i in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 0), (3, 1)], "doc_id long, toxic int")
    assert T.score_toxicity(docs, labels).count() == 4000


def test_messy(spark, messy, empty):
    labels = spark.createDataFrame([(1, 0, 1), (1, 1, 1), (2, 0, 0), (None, 0, 1), (5, 1, None), (6, 1, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")
    got = T.score_toxicity(messy, labels).collect()
    assert len(got) == messy.count() and all(0 <= r.score <= 1 for r in got)
    assert T.score_toxicity(empty, labels).count() == 0
    assert {round(r.score, 6) for r in T.score_toxicity(messy, labels.limit(0)).collect()} == {0.1}
