import random
import re
from collections import defaultdict

import numpy as np
from helixframe.llm import jaccard_join as J
from helixframe.llm.graph import components


def brute(rows):
    sets = {}
    for i, text in rows:
        w = text.lower().split()
        sets[i] = set(zip(*(w[k:] for k in range(5)), strict=False)) or ({tuple(w)} if w else set())
    links, root = defaultdict(int), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (find(i), links[i]) for i in ids}


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    texts = []
    for _ in range(30):
        words = [word() for _ in range(rng.randint(5, 120))]
        texts.append(words)
        for _ in range(rng.randint(0, 6)):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(copy)
    passage = [word() for _ in range(40)]
    texts += [[word() for _ in range(30)] + passage for _ in range(40)]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_against_brute_force(spark):
    rows = corpus()
    got = J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == brute(rows)


def test_full_nodes_and_blocks(spark, monkeypatch):
    """Nodes that are too full, dense or not, and classes of several blocks lose no link."""
    for name, value in (("BUCKET", 3), ("BLOCK", 4), ("BLOCK_SHINGLES", 300)):
        monkeypatch.setattr(J, name, value)
    rows = corpus(4)
    got = J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == brute(rows)


def joined_by_text(spark):
    """Rows that inner joins by rid have made in this session, by their metrics: execution -> rows."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    store, out = spark._jsparkSession.sharedState().statusStore(), defaultdict(int)
    each = lambda x: (x.apply(i) for i in range(x.size()))
    for e in each(store.executionsList()):
        values = store.executionMetrics(e.executionId())
        for node in each(store.planGraph(e.executionId()).allNodes()):
            if re.search(r"Join \[rid#\d+L?\], \[rid#\d+L?\], Inner", node.desc()):
                for m in each(node.metrics()):
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        out[e.executionId()] += int(values.apply(m.accumulatorId()).replace(",", ""))
    return out


def test_near_copies_are_joined_once(spark, monkeypatch):
    """However many runs bring near copies into full nodes, a join makes one row for each text; no link is lost."""
    monkeypatch.setattr(J, "BUCKET", 16)
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    base, rows = [word() for _ in range(60)], []
    for i in range(150):
        copy = list(base)
        for _ in range(rng.randint(0, 2)):
            copy[rng.randrange(60)] = word()
        rows.append((i, " ".join([*copy, word()])))
    before = set(joined_by_text(spark))
    got = J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == brute(rows)
    made = {k: n for k, n in joined_by_text(spark).items() if k not in before}
    # at each level one for the full nodes and one for the way down; one for the leaves, one for the candidates' texts
    assert 0 < sum(made.values()) <= (2 * J.LEVELS + 2) * len(rows)


def test_tiles_meet_once():
    """Every pair of texts of a class whose sizes allow the similarity is in exactly one tile, on the right sides."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    rng = random.Random(6)
    rows = [(i, 5, rng.choice([1, 2, 7, 40, 48, 50, 60, 64, 90, 100, 110]), 1, bytes(8)) for i in range(60)]
    df = J.blocks_of(spark.createDataFrame(rows, "rid long, component long, n_shingles int, n_copies long, shingles binary"))
    met = defaultdict(int)
    groups = defaultdict(list)
    for r in J.tiles(df).collect():
        groups[r.i, r.j].append((r.side, r.rid))
    for (i, j), members in groups.items():
        for k, (s, a) in enumerate(members):
            for t, b in members[k + 1 :]:
                if i == j or s != t:
                    met[min(a, b), max(a, b)] += 1
    size = {r[0]: r[2] for r in rows}
    assert set(met.values()) == {1}
    assert all((a, b) in met for a in size for b in size if a < b and min(size[a], size[b]) >= 0.8 * max(size[a], size[b]))


def test_keep_one(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, lang string")
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c, _ in brute(rows).values()})


def test_messy(messy, empty):
    got = J.jaccard_join(messy).collect()
    assert len(got) == messy.count()
    assert [(r.class_id, r.n_links) for r in got if r.doc_id == 1] == [(1, 1), (1, 1)]
    assert all(r.n_links == 0 for r in got if r.doc_id != 1)
    kept = J.keep_one(messy)
    assert kept.columns == messy.columns
    assert kept.filter("doc_id = 1").count() == 1 and kept.count() == messy.count() - 1
    assert J.jaccard_join(empty).count() == 0 and J.keep_one(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 101), (100, 101), (None, 5), (200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 200: 200}


def test_embedding_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    factors = J._factors()
    same = [(J.embedding(a[k : k + 900], factors) == J.embedding(a[k + 100 : k + 1000], factors)).mean() for k in range(0, 3000, 100)]
    assert abs(np.mean(same) - 0.8) < 0.03


def test_runs_needed():
    assert J.runs_needed(0.99) < J.runs_needed(0.999)
