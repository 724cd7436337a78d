import itertools
import random
import re

import pytest

from helixframe.llm import filter_audit as A

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(text, earlier):
    words, text = WORD.findall(text or ""), text or ""
    found = {
        "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)), "E": earlier,
    }
    return {f for f, bad in found.items() if bad}


def brute(docs, labels):
    """Every order is run over every document."""
    good, toxic = ({d for d, *flags in labels if d is not None and flags[i] == 1} for i in (0, 1))
    known = [(d, s or "", fails(t, any((t or "") == (u or "") and d is not None and e is not None and e < d for e, _, u in docs))) for d, s, t in docs]
    out = {}
    for part in {s for _, s, _ in known}:
        mine = [(d, f) for d, s, f in known if s == part]
        rows = {}
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [(d, f) for d, f in left if letter in f]
                left = [(d, f) for d, f in left if letter not in f]
                bad = [f for _, f in mine if letter in f]
                rows[order, step] = [len(left), len(gone), len(bad) - len(gone), sum(f == {letter} for f in bad), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
        for (order, step), row in rows.items():
            out[part, order, step] = (*row, sum(r[1] for (o, k), r in rows.items() if o[k - 1] == order[step - 1]))
    return out


def found(df):
    rows = df.collect()
    assert len(rows) == len({r[:3] for r in rows})
    return {tuple(r[:3]): tuple(r[3:]) for r in rows}


def test_ranks_are_those_of_sorted_orders():
    for k in (1, 3, 5):
        orders = list(itertools.permutations(range(k)))
        for n in range(1, k + 1):
            for beginning in itertools.permutations(range(k), n):
                low, high = A.rank(list(beginning), k)
                assert [i for i, o in enumerate(orders) if o[:n] == beginning] == list(range(low, high))


def test_intervals_cover_each_order_once():
    for mask in range(1, 32):
        mine = [r for r in A.intervals(5).tolist() if r[0] == mask]
        steps = {}
        for _, step, low, high in mine:
            for r in range(low, high):
                assert steps.setdefault(r, step) == step
        assert steps == {r: next(i for i, f in enumerate(o) if mask >> f & 1) for r, o in enumerate(itertools.permutations(range(5)))}


def test_equals_every_order_tried_on_every_document(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "Gamma", "DELTA", "e#", "über", "x y"] + [f"w{i}" for i in range(300)]
    docs = [(i, rng.choice(["s", "t", None]), " ".join(rng.choices(words[: rng.choice([3, 6, 300])], k=rng.choice([0, 1, 150, 199, 200, 260])))) for i in range(150)]
    docs += [(200 + i, rng.choice("st"), docs[rng.randrange(40)][2]) for i in range(30)] + [(5, "s", docs[5][2]), (None, "t", docs[6][2]), (301, "s", None), (302, "t", ""), (303, None, "\t\x0b\n")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 220, 2)] + [(4, 1, 1), (None, 1, 1)]
    d, given = spark.createDataFrame(docs, "doc_id long, source string, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert found(A.audit_filters(d.repartition(5), given)) == brute(docs, labels)


def test_limits_are_exact():
    distinct = [f"w{i}" for i in range(200)]
    assert A.text_mask(" ".join(distinct).encode()) == 0 and A.text_mask(" ".join(distinct[:199]).encode()) & 1
    assert not A.text_mask(" ".join(distinct[:100] * 2).encode()) & 2 and A.text_mask(" ".join(distinct[:99] * 2 + ["w0", "w1"]).encode()) & 2
    assert not A.text_mask(("A" + "é" * 49).encode()) & 4 and A.text_mask(("A" + "é" * 48).encode()) & 4
    assert all(A.text_mask(f"a{c}b".encode()) & 8 for c in "#$%&*|") and not A.text_mask(b"a@b") & 8
    assert A.text_mask(b"") == 1


def test_other_numbers_of_filters(spark):
    masks = spark.createDataFrame([("p", 3, True, None), ("p", 1, False, True), ("p", None, True, True), (None, 2, None, False)], "part string, mask int, good boolean, toxic boolean")
    assert found(A.audit(masks, "XY")) == {
        ("p", "XY", 1): (1, 2, 0, 1, 1, 1, 3), ("p", "XY", 2): (1, 0, 1, 0, 0, 0, 1), ("p", "YX", 1): (2, 1, 0, 0, 1, 0, 1), ("p", "YX", 2): (1, 1, 1, 1, 0, 1, 3),
        ("", "XY", 1): (1, 0, 0, 0, 0, 0, 0), ("", "XY", 2): (0, 1, 0, 1, 0, 0, 2), ("", "YX", 1): (0, 1, 0, 1, 0, 0, 2), ("", "YX", 2): (0, 0, 0, 0, 0, 0, 0),
    }


def test_messy_and_empty(spark, messy, empty):
    labels = spark.createDataFrame([(1, 1, 0, "x")], "doc_id long, quality int, toxic int, part string")
    rows = found(A.audit_filters(messy, labels))
    docs = [(r.doc_id, r.source, r.text) for r in messy.collect()]
    assert rows == brute(docs, [(1, 1, 0)])
    assert A.audit_filters(empty, labels).count() == 0
    assert found(A.audit_filters(messy, labels.limit(0))) == brute(docs, [])


def test_long_text_counts_whole():
    assert A.text_mask(("word " * 400_000 + "#").encode()) == 0b1010


@pytest.mark.parametrize("most", [1, 2**45])
def test_large_counts_stay_whole(most):
    import numpy as np

    counts = np.zeros((32, 3), np.int64)
    counts[0b00011, 0], counts[0, 0] = most, 1
    out = A.totals(counts, 5)
    assert out[0, 0].tolist() == [1, most, 0, 0, 0, 0, 60 * most]
