import hashlib

import duckdb
import numpy as np
import pytest
from helixframe.operators import features, orfs
from helixframe.plans import oracles as O
from helixframe.plans import queries
from helixframe.plans.queries import QUERIES
from helixframe.sources import writers
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
#: G+C shares and scores whose third decimal is a half, as numbers of six decimals.
HALVES = [0.5075, 0.5115, 0.5095, 0.5005, 0.4135, 0.6775, 0.6825, 2.0125, 2.0325, 2.0475, 1.534499, 0.0005, 0.0, 1.0]


@pytest.mark.parametrize(("column", "line"), [("fasta", writers.fasta_header), ("gff", writers.gff_line)])
def test_scores_in_lines_are_rounded_as_in_sql(spark, column, line):
    names = ["contig_id", "idx", "name", "rstart", "rend", "strand", "edge_type", "i_score", "t_score", "r_score"]
    rows = [(i, i, "c", 10, 60, i % 2, 0, t - 0.4, t, r) for i, (t, r) in enumerate((t, r) for t in HALVES for r in HALVES)]
    base = duckdb.connect()
    base.execute("CREATE TABLE genes (contig_id INT, idx INT, name VARCHAR, rstart INT, rend INT, strand INT, edge_type INT, i_score DOUBLE, t_score DOUBLE, r_score DOUBLE)")
    base.executemany(f"INSERT INTO genes VALUES ({', '.join('?' * len(names))})", rows)
    want = base.execute(f"WITH {O.LINES.lstrip(', ')} SELECT idx, {column} FROM lines ORDER BY idx").fetchall()
    found = spark.createDataFrame(rows, names).select("idx", line().alias("line")).orderBy(F.col("idx")).collect()
    assert [tuple(r) for r in found] == want


def test_features_are_summed_where_they_are_made(spark):
    rng = np.random.default_rng(3)
    seqs = ["".join(rng.choice(list("ACGT"), 3 * n)) for n in rng.integers(1, 60, 300)]
    rows = spark.createDataFrame([(f"g{i % 3}", s) for i, s in enumerate(seqs)], "genome_id string, nt string")
    want = {(r.genome_id, r.k): r for r in features.moments(features.encode(rows), ["genome_id"]).collect()}
    found = features.moments(rows, ["genome_id"], "nt").collect()
    assert len(found) == len(want) == 3 * features.DIMENSION
    for r in found:
        assert tuple(r)[2:] == pytest.approx(tuple(want[r.genome_id, r.k])[2:])


@pytest.mark.parametrize("name", ["zscore", "minmax_scale"])
def test_scaled_features_do_not_leave_the_task(spark, name):
    """The plan has one Python step on the stored ORFs, and no column of features."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "features" not in plan


def test_digests():
    values = np.array([[0.5, -0.5, 1.5, -2.4, 0.1], [1e6, -1e-9, 2.5, 0.49999999999999994, 3]])
    texts = ["1,-1,2,-2,0", "1000000,0,3,0,3"]
    assert features.digests(values, 0) == [hashlib.md5(t.encode()).hexdigest() for t in texts]
    assert features.digests(values / 1e3, 3)[0] == hashlib.md5(texts[0].encode()).hexdigest()


def test_words_of_whole_codons():
    rng = np.random.default_rng(4)
    seqs = ["".join(rng.choice(list("ACGT"), 3 * n)) for n in rng.integers(1, 60, 200)]
    code = features._PLAIN[np.frombuffer("".join(seqs).encode(), np.uint8)]
    found = features._whole_codons(code, np.array([len(s) for s in seqs]))
    assert found == pytest.approx(np.stack([features.zcurve(s) for s in seqs]))


def test_frames_of_odd_contigs():
    """Scans of short contigs against stretches that are walked codon by codon."""
    rng = np.random.default_rng(5)
    for n in range(400):
        seq = "".join(rng.choice(list("ACGTN" if n % 2 else "ATG"), n % 120))
        codes = orfs.DIGITS[np.frombuffer(seq.encode(), np.uint8)]
        for last in (False, True):
            want = []
            for frame in range(3):
                codons = [(p, seq[p : p + 3]) for p in range(frame, max(frame, len(seq) - 3 + last), 3)]
                s, k, first = [], [], True
                for p, codon in [*codons, (None, "TAA")]:
                    if codon in ("TAA", "TAG", "TGA"):
                        if first and s[:1] != [frame]:
                            s, k = [frame, *s], [orfs.OPEN5, *k]
                        end = len(seq) if p is None else p + 3
                        if s and end - s[0] >= 30:
                            want.append((frame, s, k, end, p is None))
                        s, k, first = [], [], False
                    elif codon in ("ATG", "GTG", "TTG"):
                        s, k = [*s, p], [*k, ("ATG", "GTG", "TTG").index(codon)]
            assert list(orfs._frames(codes, len(seq), False, "11", last, None, 30)) == want


def test_a_genome_of_one_frame_has_its_features_scaled(spark):
    """Ranges go from 1 or less to 0 or more, so that a single frame's values aren't all alike; an empty one leaves the value as it is."""
    nt = "ATGAAACCCGGGTTTTAA" * 5
    rows = spark.createDataFrame([("g", 1, 0, 90, nt)], "genome_id string, contig_id long, strand int, end int, nt string")
    x = features.zcurve(nt)
    low, high = np.minimum(1, x), np.maximum(0, x)
    stats = features.min_max(features.moments(rows, ["genome_id"], "nt"))
    found = queries._digests(rows, stats, ["low", "high"], lambda v, a, b: np.where(b > a, (v - a) / np.where(b > a, b - a, 1), v), 6).first()
    want = [v if a == b else (v - a) / (b - a) for v, a, b in zip(x, low, high, strict=True)]
    assert found.digest == features.digests(np.array([want]), 6)[0]
