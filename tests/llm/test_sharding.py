import random
import zlib
from collections import Counter, defaultdict

from helixframe.llm import sharding as S


def test_digest(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r.doc_id: r.text.encode() for r in docs.collect()}
    rows = S.digest(docs).collect()
    assert len(rows) == len(text)
    places = defaultdict(list)
    for r in rows:
        assert r.size == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id]) and r.law == "bytes" and r.grown_shard is None
        places[r.shard].append(r.slot)
    assert sorted(places) == list(range(8)) and all(sorted(p) == list(range(len(p))) for p in places.values())
    load = Counter()
    for r in rows:
        load[r.shard] += r.size
    assert max(load.values()) < 1.01 * min(load.values())
    assert all(len({r.shard for r in rows if r.virtual_slot == v}) == 1 for v in {r.virtual_slot for r in rows})


def test_versions(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    path = str(tmp_path / "map")
    _, first = S.shard(docs)
    S.store_map(first, path)
    version, old = S.load_map(spark, path)
    rows, second = S.shard(docs, 9, version + 1, old)
    S.store_map(second, path)
    version, new = S.load_map(spark, path)
    assert version == 2 and S.load_map(spark, path, 1)[1] == old
    assert all(new[s] in (old[s], 8) for s in new) and 8 in new.values()
    assert rows.count() == docs.count()


def test_rebalanced():
    rng = random.Random(1)
    sums = [(s, rng.randint(1, 1000)) for s in range(500)]
    old = S.first_map(sums, 8)
    for shards in (4, 8, 12):
        new = S.rebalanced(old, sums, shards)
        load = Counter()
        for s, n in sums:
            load[new[s]] += n
        assert set(new) == set(old) and len(load) == shards and max(load.values()) < 1.05 * min(load.values())
    assert S.rebalanced(old, sums, 8) == old or sum(S.rebalanced(old, sums, 8)[s] != old[s] for s in old) < 10
    assert S.first_map([], 8) == {} and S.rebalanced({}, [], 3) == {}


def test_messy(messy, empty):
    got = S.digest(messy).collect()
    assert len(got) == messy.count() and sorted(r.size for r in got if r.doc_id in (2, 3)) == [1, 1]
    places = defaultdict(list)
    for r in got:
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert S.digest(empty).count() == 0


def test_the_query_stores_and_edits_its_map(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = S.digest(docs, path=str(tmp_path / "map")).collect()
    assert {r.law for r in rows} == {"bytes"} and {r.version for r in rows} == {1}
    (one, first), (two, second) = (S.load_map(spark, str(tmp_path / "map"), v) for v in (1, 2))
    assert all(r.shard == first[r.virtual_slot] and r.next_shard == second[r.virtual_slot] for r in rows)
    assert {second[k] for k in first if first[k] != second[k]} == {8}
    for column, n in (("shard", 8), ("next_shard", 9)):
        sums = [sum(r.size for r in rows if r[column] == k) for k in range(n)]
        assert max(sums) - min(sums) < 0.1 * sum(sums) / n


def test_equal_rows_spread(spark):
    docs = spark.createDataFrame([(7, "the same row")] * 5000 + [(i, "other") for i in range(100)], "doc_id long, text string").repartition(3)
    rows = S.shard(docs)[0].collect()
    per = [sum(r.shard == k for r in rows) for k in range(8)]
    assert max(per) < 1.3 * min(per) and all(sorted(r.slot for r in rows if r.shard == k) == list(range(per[k])) for k in range(8))
    again = {r.doc_id: r.virtual_slot for r in S.shard(docs.filter("doc_id <> 7"))[0].collect()}
    kept = {r.doc_id: r.virtual_slot for r in rows if r.doc_id != 7}
    assert all(kept[k] == again[k] for k in again if k != 7)
