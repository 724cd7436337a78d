import random

import pytest

from helixframe.operators import chunks, orfs

NAMES = ["contig_id", "strand", "frame", "starts", "types", "start", "end", "len", "edge_type", "n_gc", "n_g2", "rstart", "rend"]


def rows(df):
    return sorted(tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.select(*NAMES).collect())


@pytest.fixture(scope="module")
def contigs(spark):
    rng = random.Random(4)
    texts = []
    for i in range(24):
        length = rng.choice([30, 89, 90, 97, 98, 99, 194, 195, 300, 700, 2000, 2001, 2002])
        letters = rng.choice(["ACGT", "ACGTACGTACGTNRYZu", "ACG", "ATGC" * 3 + "G", "CGGA"])
        texts.append("".join(rng.choices(letters, k=length)))
    texts += ["ATG" + "GCC" * 400, "GCC" * 300 + "TAA", "GC" * 300 + "ATGG" + "CG" * 210, "ATG" * 200]
    data = [("g" if i % 3 else None, i, bool(i % 2), t) for i, t in enumerate(texts)] + [("g", 100 + i, not bool(i % 2), t) for i, t in enumerate(texts)]
    data += [("g", 300, True, None), ("g", 301, None, texts[-1]), ("g", 302, False, "")]
    return spark.createDataFrame(data, "genome_id string, contig_id long, circ boolean, seq string").repartition(4).cache()


@pytest.mark.parametrize("size", [3, 97, 1000, 1 << 20])
@pytest.mark.parametrize("options", [{}, {"meta": True}, {"table": "4"}, {"only": ("ATG",)}])
def test_equals_the_scan_of_whole_contigs(contigs, size, options):
    if size == 3 and options:
        return
    assert rows(chunks.find_orfs(contigs, 75, size, **options)) == rows(orfs.find_orfs(contigs, 75, **options))


@pytest.mark.parametrize("size", [97, 5000])
def test_complete_frames(contigs, size):
    linear = contigs.filter("not circ")
    assert rows(chunks.find_orfs(linear, 75, size, complete_only=True)) == rows(orfs.find_orfs(linear, 75, complete_only=True))


def test_complete_frames_go_across_the_origin(spark):
    seq = "GCCTAACC" + "GCC" * 40 + "CCATGGCCGCC" + "GCC" * 20
    one = spark.createDataFrame([("g", 1, True, seq)], "genome_id string, contig_id long, circ boolean, seq string")
    found = [r for size in (50, 1000) for r in chunks.find_orfs(one, 60, size, complete_only=True).filter("strand = 0 and end > contig_len").collect()]
    assert len(found) == 2 and found[0] == found[1] and found[0].rend < found[0].rstart


def test_stored_chunks_of_different_sizes(contigs, spark, tmp_path):
    linear = contigs.filter("contig_id < 100")
    a, b = chunks.cut(linear.filter("contig_id % 2 = 0"), 101), chunks.cut(linear.filter("contig_id % 2 = 1"), 40)
    a.unionByName(b).write.parquet(f"{tmp_path}/chunks")
    assert rows(chunks.find_orfs_in_chunks(spark.read.parquet(f"{tmp_path}/chunks").orderBy("at"), 75)) == rows(orfs.find_orfs(linear, 75))


def test_cut(spark):
    text = "ACGTTGCAAC"
    for circ in (False, True):
        one = spark.createDataFrame([("g", 1, circ, text)], "genome_id string, contig_id long, circ boolean, seq string")
        got = [(r.at, r.before, r.bases, r.after) for r in chunks.cut(one, 4).orderBy("at").collect()]
        assert got == [(0, "AC" if circ else "", "ACGT", "TG"), (4, "GT", "TGCA", "AC"), (8, "CA", "AC", "AC" if circ else "")]
    with pytest.raises(ValueError):
        chunks.cut(one, 2)


def test_a_stopless_contig_gathers_nothing(spark):
    """Reading frames of more than the longest length are left out before their starts are put together."""
    one = spark.createDataFrame([("g", 1, False, "ATGGCC" * 20_000)], "genome_id string, contig_id long, circ boolean, seq string")
    assert rows(chunks.find_orfs(one, 90, 1000)) == rows(orfs.find_orfs(one, 90))
