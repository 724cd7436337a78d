import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from helixframe.operators import decoys, orfs
from helixframe.sources import readers, writers

STOPS = {"TAA", "TAG", "TGA"}


@pytest.fixture(scope="module")
def contigs(spark):
    rng = random.Random(5)
    rows = [(g, i, "".join(rng.choices("ACGTN" if i % 4 else "acgt", [5, 5, 5, 5, 0.05] if i % 4 else None, k=rng.choice([0, 1, 2, 3, 500, 3000, 20_000])))) for g in ("a", "b") for i in range(18)]
    rows += [("bare", 1, "ACG" * 50), ("bare", 2, None), ("full", 1, "ATG" + "GCC" * 200 + "TAA")]
    return spark.createDataFrame(rows, "genome_id string, contig_id long, seq string").repartition(5).cache()


@pytest.fixture(scope="module")
def merged(contigs):
    texts = defaultdict(str)
    for r in contigs.orderBy("genome_id", "contig_id").collect():
        texts[r.genome_id] += (r.seq or "").upper()
    return texts


@pytest.fixture(scope="module")
def frames(spark, merged):
    rows = [(g, 0, False, t) for g, t in merged.items()]
    found = orfs.find_orfs(spark.createDataFrame(rows, "genome_id string, contig_id long, circ boolean, seq string"), 90, complete_only=True, sequences=True)
    out = defaultdict(list)
    for r in found.collect():
        out[r.genome_id].append(r)
    return out


@pytest.fixture(scope="module")
def made(contigs):
    out = decoys.insert_decoys(contigs)
    return decoys.Decoys(out.manifest.cache(), out.decoys.cache(), out.contigs.cache())


def gaps_of(found, length):
    out, upto = [], 0
    for lo, hi in [*sorted((r.rstart - 1, r.rend) for r in found), (length, length)]:
        if lo - 20 - (upto + 20) >= 90:
            out.append((upto + 20, lo - 20))
        upto = max(upto, hi)
    return out


def test_counts_of_an_accession(made, merged, frames, contigs):
    got = {r.genome_id: r for r in made.manifest.collect()}
    assert set(got) == {g for g, t in merged.items() if t}
    for g, r in got.items():
        n, room = len(frames[g]), sum((b - a) // 90 for a, b in gaps_of(frames[g], len(merged[g])))
        assert (r.merged_len, r.n_orfs) == (len(merged[g]), n)
        assert r.n_target == (min(max(20, min(200, round(0.05 * n))), room) if n else 0) and r.n_inserted <= r.n_target and r.valid
    sizes = Counter(r.genome_id for r in contigs.collect() if r.seq)
    assert all(r.n_records == sizes[g] for g, r in got.items())
    assert got["bare"].message == "no reading frame" and got["a"].n_target >= got["a"].n_inserted > 0


def test_codon_usage_across_contigs(contigs, made, frames):
    records = decoys.on_axis(contigs)
    found = decoys.chunks.find_orfs_in_chunks(records, 90, complete_only=True)
    got = {(r.genome_id, r.codon, r.is_stop): r.n for r in decoys.codon_usage(records, found).collect()}
    want = Counter()
    for g, rows in frames.items():
        for r in rows:
            want[g, r.nt[-3:], True] += 1
            for i in range(0, len(r.nt) - 3, 3):
                if set(r.nt[i : i + 3]) <= set("ACGT"):
                    want[g, r.nt[i : i + 3], False] += 1
    assert got == want


def test_decoys_lie_in_gaps_and_are_sound(made, merged, frames):
    by = defaultdict(list)
    for r in made.decoys.collect():
        by[r.genome_id].append(r)
    lengths = {g: {r.len for r in rows} for g, rows in frames.items()}
    for g, rows in by.items():
        free = gaps_of(frames[g], len(merged[g]))
        rows.sort(key=lambda r: r.start)
        assert all(a.end <= b.start for a, b in zip(rows, rows[1:], strict=False))
        for r in rows:
            assert any(lo <= r.start and r.end <= hi for lo, hi in free) and r.end - r.start in lengths[g]
            codons = [r.nt[i : i + 3] for i in range(0, len(r.nt), 3)]
            assert r.valid and len(r.nt) == r.end - r.start and codons[0] in ("ATG", "GTG", "TTG") and codons[-1] in STOPS and not STOPS & set(codons[:-1])
    starts = Counter(r.nt[:3] for rows in by.values() for r in rows)
    assert starts["ATG"] > starts["GTG"] + starts["TTG"] and {r.strand for rows in by.values() for r in rows} == {"+", "-"}


def test_sequences_hold_the_decoys_and_nothing_else_changes(made, merged, contigs, tmp_path, spark):
    texts = defaultdict(str)
    for r in made.contigs.orderBy("genome_id", "contig_id").collect():
        texts[r.genome_id] += r.seq
    want = {g: list(t) for g, t in merged.items() if t}
    for r in made.decoys.collect():
        nt = r.nt if r.strand == "+" else r.nt[::-1].translate(str.maketrans("ACGT", "TGCA"))
        want[r.genome_id][r.start : r.end] = nt
    assert texts == {g: "".join(t) for g, t in want.items()}
    writers.write_decoys(made, str(tmp_path / "fa"), str(tmp_path / "gff"))
    again = defaultdict(str)
    for r in readers.read_contigs(spark, str(tmp_path / "fa"), glob="part-*").orderBy("file").collect():
        again[r.name] += r.seq
    assert again == texts
    lines = [x for p in sorted((tmp_path / "gff").glob("part-*")) for x in p.read_text().splitlines()]
    places = sorted(tuple(x.split("\t")[i] for i in (0, 3, 4, 6)) for x in lines if not x.startswith("#"))
    assert places == sorted((r.genome_id, str(r.start + 1), str(r.end), r.strand) for r in made.decoys.collect())
    assert sum(x.startswith("##sequence-region") for x in lines) == len(texts)


def test_the_seed_decides(contigs, made):
    key = lambda df: sorted((r.genome_id, r.start, r.end, r.strand, r.nt) for r in df.collect())
    assert key(decoys.insert_decoys(contigs.repartition(3)).decoys) == key(made.decoys)
    assert key(decoys.insert_decoys(contigs, seed=7).decoys) != key(made.decoys)


def test_many_decoys_in_one_gap(spark):
    free = spark.createDataFrame([("g", 100, 4000), ("h", 0, 95)], "genome_id string, lo int, hi int")
    lengths = spark.createDataFrame([("g", i, 90 + 30 * (i % 4)) for i in range(1, 25)] + [("h", 1, 90), ("h", 2, 93), ("h", 3, 300)], "genome_id string, i long, len int")
    got = decoys.placed(lengths, free, 1).collect()
    g = sorted((r.start, r.end) for r in got if r.genome_id == "g")
    assert len(g) >= 15 and all(100 <= a and b <= 4000 for a, b in g) and all(a[1] <= b[0] for a, b in zip(g, g[1:], strict=False))
    assert [r.i for r in got if r.genome_id == "h"] in ([1], [2])
    assert decoys.placed(lengths.limit(0), free, 1).count() == 0


def test_sequences_are_not_made_once_more_by_a_filter(spark):
    from helixframe.sources.contigs import document_contigs

    records = decoys.on_axis(document_contigs(spark, "/root/testdata/sf0.001"))
    plan = records._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" in plan and not [x for x in plan.splitlines() if "Filter" in x and "regexp_replace" in x]
