import gzip
import math
import random

import numpy as np
import pytest
from helixframe.functions import sequence as S
from helixframe.functions.alphabet import genetic_code, stop_codons
from helixframe.operators import features, intervals, matching, models, ordered, orfs, startmodel
from helixframe.plans import gene_finder
from helixframe.sources import readers, writers
from helixframe.streaming.arriving import stream_orfs, write_orfs
from pyspark.sql import functions as F


def one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(expression.alias("x")).first().x


def test_sequence_functions(spark):
    col = F.col
    assert one(spark, S.reverse_complement(col("s")), s="ATGCN") == "NGCAT"
    assert one(spark, S.reverse_complement(col("s")), s="acgtR") == "Yacgt"
    assert one(spark, S.reverse_complement(S.reverse_complement(col("s"))), s="ACGTRYSWKMBDHVNacgt") == "ACGTRYSWKMBDHVNacgt"
    assert [one(spark, S.kmer_address(col("s"), 3), s=c) for c in ("ATG", "GTG", "TTG", "TAA", "TAG", "TGA", "ANG")] == [35, 51, 3, 10, 11, 14, -1]
    assert one(spark, S.gc_count(col("s")), s="GgCcAt") == 4 and one(spark, S.gc_percent(col("s")), s="") == 0
    assert one(spark, S.translate_dna(col("s")), s="GTGAAANNTTAGC") == "MKX*" and one(spark, S.translate_dna(col("s"), "11", F.lit(True)), s="GTGTGA") == "V*"
    assert one(spark, S.translate_dna(col("s"), "4"), s="ATGTGA") == "MW" and one(spark, S.translate_dna(col("s")), s="AT") == ""
    labels = [(25.7, 1), (25.7, 5), (80.0, 1), (19.9, 1)]
    assert [one(spark, S.gc_bin_label(col("g"), 20, 80, n), g=g) for g, n in labels] == ["25_26", "25_30", None, None]
    assert [one(spark, S.gc_bin(col("g")), g=g) for g in (0.1, 0.2, 0.255, 0.8)] == [0, 1, 6, 60]
    assert int(one(spark, S.genome_seed(42, col("a")), a="GCF_000005845")) == 18181681085059467518
    assert [one(spark, S.unversioned(col("h")), h=h) for h in ("NC_000913.3", "plain")] == ["NC_000913", "plain"]
    assert one(spark, S.sigmoid(F.lit(0.0))) == 0.5


def test_genetic_codes(spark):
    assert genetic_code()["ATG"] == "M" and stop_codons("4") == ["TAA", "TAG"] and stop_codons("15") == ["TAA", "TGA"]
    with pytest.raises(ValueError):
        genetic_code("2")
    assert S.genetic_code_table(spark).groupBy("table").agg(F.sum(F.col("is_stop").cast("int")).alias("n")).filter("n < 2").count() == 0


def test_zcurve():
    z = features.zcurve("ATG")
    want = {0: 1, 1: 1, 2: 1, 3: -1, 4: -1, 5: 1, 6: 1, 7: -1, 8: -1, 9: -1, 10: -1, 11: 1, 30: 1, 31: -1, 32: -1, 54: 1, 55: -1, 56: -1}
    assert {i: v for i, v in enumerate(z) if v} == want
    assert not features.zcurve("").any() and not features.zcurve("NNN").any()
    assert np.allclose(features.zcurve("ATGC"), features.zcurve("ATG")) and not np.allclose(features.zcurve("ATGC", False), features.zcurve("ATG"))
    assert np.allclose(features.zcurve("ATGATG")[:9], features.zcurve("ATG")[:9])
    assert np.allclose(features.zcurve("RTG"), (features.zcurve("ATG") + features.zcurve("GTG")) / 2)


def test_zcurves_together():
    rng = random.Random(6)
    seqs = ["", "A", "ACG", "NNN", "acgt", *("".join(rng.choices("ACGTacgtRN", weights=[9] * 8 + [w, w], k=rng.randint(0, 90))) for w in (0, 0, 0.2) * 20)]
    for truncate in (True, False):
        assert np.allclose(features.zcurves(seqs, truncate), [features.zcurve(s, truncate) for s in seqs])


def test_moments_and_scaling(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(3, 2, (200, 4))
    rows = spark.createDataFrame([(i % 2, [float(v) for v in r]) for i, r in enumerate(x)], "g int, features array<double>").repartition(5)
    for r in features.moments(rows, ["g"]).collect():
        part = x[r.g :: 2, r.k]
        assert r.n == 100 and np.allclose([r.mean, r.sd, r.low, r.high], [part.mean(), part.std(), part.min(), part.max()])
    stats = features.moments(rows, [])
    assert math.isclose(features.rbf_gamma(stats, []).first().gamma, 1 / (4 * x.var()))
    assert features.moments(rows.limit(0), []).count() == 0
    ranged = features.min_max(stats)
    low = features.as_array(ranged, [], F.col("low"), "low")
    assert low.first().low == np.minimum(1, x.min(axis=0)).tolist()
    got = one(spark, features.scaled(F.col("x"), F.col("a"), F.col("b")), x=[2.0, 5.0], a=[0.0, 1.0], b=[4.0, 1.0])
    assert got == [0.5, 5.0]


def test_overlaps(spark):
    rng = random.Random(1)
    genes = []
    for i in range(300):
        c, a = rng.randrange(3), rng.randint(1, 20_000)
        genes.append(("g", c, i, a, a + rng.randint(50, 9000), 40_000))
    genes += [("g", 9, 300, 1, 100, 1000), ("g", 9, 301, 80, 200, 1000), ("g", 9, 302, 950, 30, 1000)]
    df = spark.createDataFrame(genes, "genome_id string, contig_id int, idx int, rstart int, rend int, contig_len int")
    lo = lambda g: g[3] - g[5] if g[3] > g[4] else g[3]
    olen = lambda a, b: min(a[4], b[4]) - max(lo(a), lo(b)) if a[4] > lo(b) and b[4] > lo(a) else 0
    for least in (1, 20, 500):
        want = {(a[2], b[2], olen(a, b)) for a in genes for b in genes if a[1] == b[1] and a[2] < b[2] and olen(a, b) >= least}
        got = intervals.overlap_pairs(df, least).collect()
        assert {(r.left, r.right, r.olen) for r in got} == want and len(got) == len(want)
    assert (300, 301, 20) in {(r.left, r.right, r.olen) for r in intervals.overlap_pairs(df, 20).collect()}
    kept = {r.idx for r in intervals.without_overlaps(df, 75).collect()}
    assert kept == {a[2] for a in genes if not any(a[1] == b[1] and a[2] != b[2] and olen(a, b) > 75 for b in genes)}


def test_gaps(spark):
    rows = spark.createDataFrame([("c", 50, 150), ("c", 150, 300), ("c", 500, 600)], "k string, start int, end int")
    lengths = spark.createDataFrame([("c", 1000), ("d", 150), ("e", 100)], "k string, len int")
    free = intervals.gaps(rows, lengths, ["k"])
    assert sorted(map(tuple, free.collect())) == [("c", 320, 480), ("c", 620, 980), ("d", 20, 130)]
    assert {r.k: (r.capacity, r.largest) for r in intervals.capacity(free, ["k"]).collect()} == {"c": (5, 360), "d": (1, 110)}


def test_lagging_bin(spark):
    rng = random.Random(5)
    for _ in range(5):
        values = [round(rng.uniform(0.1, 0.9), 4) for _ in range(60)]
        df = spark.createDataFrame([(1, v, i) for i, v in enumerate(values)], "g int, gc double, i int")
        got = [r.bin for r in ordered.lagging_bin(df, ["g"], "gc", ["i"]).orderBy("gc", "i").collect()]
        i, low, want = 0, 10**9, []
        for i, v in enumerate(sorted(values)):
            low = min(low, sum(t < v for t in [round(0.2 + 0.01 * m, 10) for m in range(60)]) - i)
            want.append(i + min(1, low))
        assert got == want
        assert all(b - a <= 1 for a, b in zip(got, got[1:], strict=False))


def test_numbering(spark):
    rng = random.Random(3)
    rows = [(g, rng.randrange(4), rng.randrange(1000), i) for g in "ab" for i in range(50)]
    df = spark.createDataFrame(rows, "g string, c int, e int, i int")
    got = {(r.g, r.i): r.idx for r in ordered.numbered(df, ["g"], ["c"], ["e", "i"]).collect()}
    for g in "ab":
        for k, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2], r[3]))):
            assert got[g, r[3]] == k


def test_matching(spark):
    schema = "assembly string, host string, start int, end int, strand string, ord int"
    p = spark.createDataFrame([("a", "h", 10, 100, "+", 0), ("a", "h", 10, 200, "+", 1)], schema)
    t = spark.createDataFrame([("a", "h", 10, 200, "+", 0), ("a", "h", 5, 100, "+", 1)], schema)
    keys = ["assembly", "host"]
    assert matching.greedy_matches(p, t, keys).count() == 1 and matching.matched_predictions(p, t, keys).count() == 2
    rng = random.Random(8)
    make = lambda n: [("a", rng.choice("xy"), rng.randrange(20), rng.randrange(20), rng.choice("+-"), i) for i in range(n)]
    ps, ts = make(60), make(50)
    same = lambda a, b: a[1] == b[1] and a[4] == b[4] and (a[2] == b[2] or a[3] == b[3])
    free, want = list(ts), 0
    for x in ps:
        hit = next((y for y in free if same(x, y)), None)
        if hit:
            free.remove(hit)
            want += 1
    p, t = spark.createDataFrame(ps, schema), spark.createDataFrame(ts, schema)
    found = matching.greedy_matches(p, t, keys)
    assert found.count() == want
    assert tuple(matching.report(p, t, found).first()) == ("a", 60, 50, want)
    assert tuple(matching.report(p, t, found, "assembly", p, found).first()) == ("a", 60, 50, want, 60, want)


def test_greedy_matching_of_long_chains(spark):
    """Each prediction wants the feature before and its own, so that every choice depends on the one before."""
    schema = "assembly string, host string, start int, end int, strand string, ord int"
    p = spark.createDataFrame([("a", "h", i, 1000 + i, "+", i) for i in range(7)], schema)
    t = spark.createDataFrame([("a", "h", i, 1001 + i, "+", i) for i in range(7)], schema)
    keys = ["assembly", "host"]
    assert sorted((r.p, r.t) for r in matching.greedy_matches(p, t, keys).collect()) == [(0, 0)] + [(i, i) for i in range(1, 7)]
    assert matching.greedy_matches(p, t.limit(0), keys).count() == 0


def test_weighted_draws(spark):
    rng = random.Random(6)
    weights = [(g, i, rng.choice([0, 1, 1, 2, 50, 3000])) for g in "abc" for i in range(40 if g < "c" else 1)] + [("c", 5, 3)]
    draws = [(g, k, rng.random()) for g in "abcd" for k in range(300)] + [("a", 900, 0.0), ("a", 901, 1 - 2**-52)]
    got = ordered.weighted_draws(spark.createDataFrame(draws, "g string, k int, u double"), spark.createDataFrame(weights, "g string, i int, w int"), ["g"], "i", "w")
    want = []
    for g, k, u in draws:
        mine = [(i, w) for h, i, w in weights if h == g]
        at, upto = u * sum(w for _, w in mine), 0
        for i, w in mine:
            if upto <= at < upto + w:
                want.append((g, k, i))
            upto += w
    assert sorted((r.g, r.k, r.i) for r in got.collect()) == sorted(want) and len(want) == 902
    us = [r[0] for r in spark.range(4000).select(ordered.uniform(1, "id")).collect()]
    assert min(us) >= 0 and max(us) < 1 and abs(sum(us) / 4000 - 0.5) < 0.02 and len(set(us)) == 4000


def test_start_model():
    candidates, before, after = startmodel.expected_candidates(0.5)
    assert (candidates, before, after) == (10, 0.98046875, 8.01953125)


def test_models(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (600, 6))
    label = np.where((x[:, :2] ** 2).sum(axis=1) < 1.2, 1, -1)
    rows = spark.createDataFrame([("g" if i % 2 else "h", i, [float(v) for v in r], int(y)) for i, (r, y) in enumerate(zip(x, label, strict=True))], "genome_id string, i int, features array<double>, label int")
    rows = rows.unionByName(spark.createDataFrame([("one", 9999, [0.0] * 6, 1)], rows.schema))
    model = models.train_svm(rows, ["genome_id"])
    got = models.svm_scores(rows, model, ["genome_id"]).collect()
    right = np.mean([(r.score > 0.5) == (r.label > 0) for r in got if r.genome_id != "one"])
    assert right > 0.8 and [r.score for r in got if r.genome_id == "one"] == [0]
    network = models.Network([0.0] * 2, [1.0, 0.0], [[1.0, -1.0]], [0.0], [2.0], 0.0)
    assert np.allclose(network.score(np.array([[3.0, 1.0], [0.0, 1.0]])), [1 / (1 + math.exp(-2)), 0.5])
    df = spark.createDataFrame([(1, [3.0, 1.0]), (2, [3.0, 1.0]), (None, [3.0, 1.0])], "bin int, features array<double>")
    assert {r.bin: r.score is None for r in models.mlp_scores(df, {1: network}, "bin").collect()} == {1: False, 2: True, None: True}
    assert [models.auto_clusters(g) for g in (0.2, 0.3, 0.45, 0.56, 0.57, 0.62, 0.626)] == [2, 3, 4, 4, 5, 5, 6]


def contigs(spark, n=6, size=6000, seed=4):
    rng = random.Random(seed)
    rows = [("g", i, i == 0, "".join(rng.choices("ACGT", k=size))) for i in range(n)]
    return spark.createDataFrame(rows, "genome_id string, contig_id long, circ boolean, seq string")


def test_gene_finder(spark):
    c = contigs(spark)
    genes = gene_finder.find_genes(c, gene_finder.Options(threshold=0.3))
    rows = genes.orderBy("idx").collect()
    assert [r.idx for r in rows] == list(range(len(rows))) and rows
    report = gene_finder.overlap_report(genes, gene_finder.Options(min_overlap=30))
    assert report.count() % 2 == 0
    with pytest.raises(gene_finder.BadOption):
        gene_finder.Options(minlen=60)
    with pytest.raises(gene_finder.NothingFound):
        gene_finder.find_genes(c.limit(0))


FASTA = ">a one circular\r\nACGT*\r\n\r\nacgn\r\n>empty\n>b linear\nTTGA-\nCC\n>last\n"
GENBANK = "LOCUS       X1 12 bp DNA circular UNA\nORIGIN\n        1 acgt acgt\n//\nLOCUS       X2 0 bp\nORIGIN\n//\n"
EMBL = "ID   Y1; SV 1; linear; DNA\nSQ   Sequence 8 BP;\n     acgtacgt        8\n//\n"


def test_readers(spark, tmp_path):
    (tmp_path / "a.fa").write_text(FASTA)
    (tmp_path / "packed.gbk").write_bytes(gzip.compress(GENBANK.encode()))
    (tmp_path / "c.embl").write_text(EMBL)
    got = sorted((r.file.rsplit("/", 1)[1], r.contig_ord, r.name, r.circ, r.seq) for r in readers.read_contigs(spark, str(tmp_path)).collect())
    assert got == [
        ("a.fa", 0, "a", True, "ACGTacgn"), ("a.fa", 1, "empty", False, ""), ("a.fa", 2, "b", False, "TTGACC"),
        ("c.embl", 0, "Y1", False, "ACGTACGT"), ("packed.gbk", 0, "X1", True, "ACGTACGT"),
    ]
    plain = {r.name: (r.circ, r.seq) for r in readers.read_fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert plain["a"] == (True, "ACGTacgn") and plain["b"] == (False, "TTGACC")
    for bad in ("", "what is this"):
        with pytest.raises(readers.InvalidSequenceFile):
            list(readers.parse(bad))


def test_feature_files(spark, tmp_path):
    (tmp_path / "x.gff").write_text("##gff-version 3\n\nNC_1.3\tp\tCDS\t5\t90\t.\t+\t0\tID=1\nNC_1.3\tp\tgene\t5\t90\t.\t+\t0\tID=1\nshort\tCDS\n")
    assert [tuple(r) for r in readers.read_gff(spark, str(tmp_path / "x.gff")).collect()] == [("x", "NC_1", 5, 90, "+", "CDS")]
    (tmp_path / "y.predict").write_text(">NC_1.3 text\norf1 10 99 +1\norf2 300 200 -2\n>NC_2\norf3 1 9 +3\n")
    got = sorted(map(tuple, readers.read_predictions(spark, str(tmp_path / "y.predict")).collect()))
    assert got == [("y", "NC_1", "orf1", 10, 99, "+"), ("y", "NC_1", "orf2", 300, 200, "-"), ("y", "NC_2", "orf3", 1, 9, "+")]


def test_lines(spark, tmp_path):
    row = dict(name="c", i_score=0.1, t_score=0.9746, r_score=0.5, rstart=10, rend=6, strand=1, idx=4, edge_type=0, contig_len=12, nt="ATGAAATAG")
    df = spark.createDataFrame([tuple(row.values())], list(row))
    get = lambda e, **new: df.withColumns({k: F.lit(v) for k, v in new.items()}).select(e.alias("x")).first().x
    assert get(writers.gff_line()) == "c\thelixframe\tCDS\t10\t6\t0.975\t-\t0\tID=ORF000005;partial=00;r_score=0.500"
    assert [get(writers.bed_line(), t_score=t).split("\t")[4] for t in (0.9746, -0.2, 1.3)] == ["974", "0", "1000"]
    assert get(writers.fasta_header(), edge_type=8) == ">c:10..6(-) ID=ORF000005;score=0.975;paritial=11"
    assert get(writers.location()) == "complement(join(10..12,1..6))"
    assert get(writers.location(), rstart=1, rend=9, edge_type=5, strand=0) == "<1..9" and get(writers.location(), rstart=1, rend=9, edge_type=5) == "complement(1..>9)"
    assert '/translation="MK*"' in get(writers.genbank_feature())
    assert one(spark, writers.origin(F.col("s")), s="ACGTACGTACGT" * 6).split("\n") == ["        1 acgtacgtac gtacgtacgt acgtacgtac gtacgtacgt acgtacgtac gtacgtacgt", "       61 acgtacgtac gt"]
    head = one(spark, writers.locus(F.lit("c"), F.lit(120), F.lit(True), F.to_date(F.lit("2024-03-05"))))
    assert head == "c " + " " * 23 + "120 bp    DNA     circular UNA 05-MAR-2024"
    lines = spark.createDataFrame([(2, "b"), (1, "a")], "k int, value string")
    writers.write_lines(lines, str(tmp_path / "out"), ["k"])
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["a", "b"]


def test_streaming(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = contigs(spark, 3, 2000).collect()
    for r in rows:
        (source / f"{r.contig_id}.fa").write_text(f">{r.contig_id} linear\n{r.seq}\n")
    write_orfs(stream_orfs(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == orfs.find_orfs(contigs(spark, 3, 2000).withColumn("circ", F.lit(False))).count()


def test_classifier_with_more_rows_than_the_sample(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (12000, 3))
    rows = spark.createDataFrame([("g", i, [float(v) for v in r], 1 if r[0] > 0.8 else -1) for i, r in enumerate(x)], "genome_id string, i int, features array<double>, label int").cache()
    counts = {r.label: r["count"] for r in models.sampled(rows, ["genome_id", "label"], 1000).groupBy("label").count().collect()}
    assert set(counts) == {1, -1} and all(850 < n < 1150 for n in counts.values())
    model = models.train_svm(rows, ["genome_id"], sample=1000)
    m = model.collect()
    assert len(m) == 1 and np.allclose(m[0].high, np.maximum(0, x.max(axis=0))) and np.allclose(m[0].low, np.minimum(1, x.min(axis=0)))
    got = models.svm_scores(rows, model, ["genome_id"]).collect()
    assert np.mean([(r.score > 0.5) == (r.label > 0) for r in got]) > 0.9


def test_clusters_of_all_rows(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 0.1, (5200, 3)), rng.normal(5, 0.1, (60, 3))])
    rows = [(g, i, [float(v) for v in r], i >= 5220, 300 if g == "g" else 200, 1000) for g in ("g", "h") for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "genome_id string, i int, features array<double>, is_seed boolean, n_gc int, len int")
    model = {r.genome_id: r for r in models.fitted_clusters(df.repartition(5), ["genome_id"], restarts=3, steps=8).collect()}
    assert {g: len(m.centroids) for g, m in model.items()} == {"g": 9, "h": 6}
    for m in model.values():
        assert np.allclose(m.mean, x.mean(axis=0)) and np.allclose(m.sd, x.std(axis=0))
    two = np.array(model["h"].centroids).reshape(2, 3) * model["h"].sd + model["h"].mean
    assert np.allclose(two[model["h"].coding], x[5200:].mean(axis=0), atol=1e-4) and np.allclose(two[1 - model["h"].coding], x[:5200].mean(axis=0), atol=1e-4)
    got = models.cluster_labels(df.filter("genome_id = 'h'"), ["genome_id"]).collect()
    assert len(got) == len(x) and all((r.i_score == 0.75) == (r.i >= 5200) for r in got)
