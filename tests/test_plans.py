"""Whole plans, sinks, readers and SQL functions."""

import gzip
import random

import numpy as np
import pytest
from helixframe.functions import catalog
from helixframe.operators import features, models, networks, ordered, orfs
from helixframe.plans import gene_finder
from helixframe.plans.gene_finder import Options
from helixframe.sources import readers, writers
from pyspark.sql import functions as F

from test_start_model import genome


@pytest.fixture(scope="module")
def contigs(spark):
    rows = [("g", 1, "c1", False, genome(11, 12)), ("g", 2, "c2", True, genome(12, 12)), ("small", 3, "c3", False, genome(13, 6))]
    return spark.createDataFrame(rows, "genome_id string, contig_id long, name string, circ boolean, seq string").withColumn("len", F.length("seq")).cache()


def coding(seed=0):
    rng = np.random.default_rng(seed)
    one = models.Network([0.0] * 189, [1.0] * 189, rng.normal(0, 0.5, (4, 189)).tolist(), [0.1] * 4, rng.normal(0, 2, 4).tolist(), 0.2)
    return dict.fromkeys(range(61), one)


def test_plan_with_networks(spark, contigs):
    genes = gene_finder.find_genes(contigs, Options(reviser="counts", rounds=2, threshold=0.4), coding()).collect()
    assert genes and {r.genome_id for r in genes} == {"g", "small"}
    for g in ("g", "small"):
        assert sorted(r.idx for r in genes if r.genome_id == g) == list(range(sum(r.genome_id == g for r in genes)))
    assert all(r.t_score == max(r.i_score, r.c_score) >= 0.4 and len(r.nt) == r.len == r.end - r.start and r.start in r.starts for r in genes)
    assert any(r.r_score > 0 for r in genes)


def test_revisers_and_metagenomes(spark, contigs):
    network = networks.random_start_network(3, 65, [(9, 16, 7, 2), (16, 24, 5, 2)])
    unified = networks.UnifiedNetwork((np.full((2, 189), 0.1), np.zeros(2)), (np.ones(2), np.zeros(2)), (np.zeros(2), np.zeros(2)), (np.ones(2), 0.0), np.full(61, 0.5))
    genes = gene_finder.find_genes(contigs, Options(meta=True, threshold=0.1), coding(), network, unified).collect()
    assert genes and all(r.t_score == r.c_score for r in genes) and len({round(r.r_score, 6) for r in genes}) > 3
    with pytest.raises(gene_finder.BadOption):
        gene_finder.find_genes(contigs, Options(reviser="network"), coding())
    with pytest.raises(gene_finder.BadOption):
        Options(reviser="other")
    with pytest.raises(gene_finder.TooManyFound):
        gene_finder.find_genes(contigs, Options(most_orfs=3), coding())
    plain = gene_finder.revised(gene_finder.initial_scores(gene_finder.candidates(contigs), coding()), contigs, Options(reviser="none"), None)
    assert {r.r_score for r in plain.collect()} <= {0.0, 0.5}


def test_code_is_chosen_by_coding_share(spark, contigs):
    nets = coding(1)
    shares = {(r.genome_id, r.code): r.share for r in gene_finder.coding_shares(contigs, nets, Options(gc_bin="direct")).collect()}
    for code in ("11", "16", "4"):
        found = orfs.find_orfs(contigs, 90, code, sequences=True, only=("ATG",)).collect()
        for g in ("g", "small"):
            mine = [r for r in found if r.genome_id == g]
            assert all(r.types[0] in (0, 5) for r in mine)
            score = nets[0].score(features.zcurves([r.nt for r in mine]))
            assert np.isclose(shares[g, code], sum(r.len for r, s in zip(mine, score, strict=True) if s > 0.5) / sum(r.len for r in mine))
    best = {r.genome_id: r.code for r in gene_finder.chosen_codes(contigs, nets, Options(gc_bin="direct")).collect()}
    assert all(shares[g, best[g]] == max(shares[g, c] for c in gene_finder.CODES) for g in best)
    with pytest.raises(gene_finder.BadOption):
        gene_finder.find_genes(contigs, Options(table="auto"))


def test_filters(spark, contigs):
    found = gene_finder.initial_scores(gene_finder.candidates(contigs), coding()).cache()
    assert gene_finder.filtered(found, 200, 0.3, True).count() == sum(r.len >= 200 and r.i_score > 0.3 and r.edge_type == 0 for r in found.collect())
    assert ordered.limited(found, ["genome_id"], ["contig_id", "strand", "end"], 3).groupBy("genome_id").count().filter("count = 3").count() == 2
    seeds = gene_finder.trusted_seeds(found, 300).filter("is_seed").collect()
    for r in seeds:
        for q in seeds:
            if r is not q and (r.genome_id, r.contig_id) == (q.genome_id, q.contig_id) and r.rstart < r.rend and q.rstart < q.rend:
                assert min(r.rend, q.rend) - max(r.rstart, q.rstart) <= 75


def test_more_labelled_rows_than_the_sample(spark):
    """Both labels of a large genome stay, and about as many rows as the sample takes."""
    rng = np.random.default_rng(2)
    rows = [("big", i, [float(v) for v in rng.normal(2 if i % 3 else -2, 1, 4)], 1 if i % 3 else -1) for i in range(12_000)] + [("one", i, [0.0] * 4, 1) for i in range(50)]
    df = spark.createDataFrame(rows, "genome_id string, i long, features array<double>, label int").repartition(4)
    drawn = models.sampled(df, ["genome_id", "label"], models.SAMPLE).groupBy("genome_id", "label").count().collect()
    sizes = {(r.genome_id, r.label): r["count"] for r in drawn}
    assert all(0.9 * models.SAMPLE <= sizes["big", k] <= 1.1 * models.SAMPLE for k in (1, -1)) and sizes["one", 1] == 50
    model = models.train_svm(df, ["genome_id"])
    assert [r.genome_id for r in model.collect()] == ["big"]
    right = models.svm_scores(df.filter("genome_id = 'big'"), model, ["genome_id"]).filter("(score > 0.5) = (label > 0)").count()
    assert right > 0.97 * 12_000


def lines(folder):
    return [x for f in sorted(folder.glob("part-*")) for x in f.read_text().split("\n")[:-1]]


def test_output_formats(spark, contigs, tmp_path):
    genes = gene_finder.find_genes(contigs, Options(reviser="none", threshold=0.3), coding()).cache()
    rows = sorted(genes.collect(), key=lambda r: (r.genome_id, r.contig_id, r.idx))
    date = F.lit("2024-02-29").cast("date")
    for kind in writers.FORMATS:
        writers.write_output(genes, contigs, str(tmp_path / kind), kind, date=date)
    protein = {r.idx: r for r in genes.select("genome_id", "idx").collect()}
    assert protein and lines(tmp_path / "faa-tmp")[::2] == [f">{r.idx}" for r in rows]
    assert lines(tmp_path / "fna")[1::2] == [r.nt for r in rows] and all(";gc_cont=0." in x for x in lines(tmp_path / "fna")[::2])
    assert lines(tmp_path / "gff")[:2] == ["##gff-version 3", "# trans_tbl=11"] and sum(not x.startswith("#") for x in lines(tmp_path / "gff")) == len(rows)
    full = lines(tmp_path / "gbk-full")
    used = len({(r.genome_id, r.contig_id) for r in rows})
    assert sum(x == "//" for x in full) == sum(x.startswith("LOCUS") for x in full) == used and "29-FEB-2024" in full[0]
    assert sum(x.startswith("        1 ") for x in full) == used and not any(x.startswith("        1 ") for x in lines(tmp_path / "gbk"))
    with pytest.raises(writers.UnknownFormat):
        writers.output_lines(genes, contigs, "xml", "11", date)


def test_other_sinks(spark, contigs, tmp_path):
    writers.write_bins(contigs.withColumn("class", F.col("genome_id")), str(tmp_path / "bins"), step=5)
    assert sorted({p.name for p in (tmp_path / "bins").glob("class=*")}) == ["class=g", "class=small"]
    scored = features.encode(orfs.find_orfs(contigs, 90, sequences=True)).withColumn("t_score", F.when(F.col("len") > 300, 0.9).otherwise(0.1))
    writers.write_features(scored, str(tmp_path / "features"))
    stored = spark.read.parquet(str(tmp_path / "features"))
    assert {r.label for r in stored.collect()} == {0, 1} and stored.filter("size(features) <> 189").count() == 0


def test_tolerant_reads_and_tables(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x\nACGT\n")
    (tmp_path / "b.fa").write_text("nothing\n")
    (tmp_path / "c.fa.gz").write_bytes(gzip.compress(b">y\nAC\n>z\nGG\n" * 3000)[:-20])
    (tmp_path / "d.gb").write_text('LOCUS       r1\nFEATURES\n     gene            1..9\n                     /transl_table=1\n     CDS             1..9\n                     /transl_table=4\n     CDS             1..9\n                     /transl_table="11"\n     CDS             1..9\n                     /transl_table=4\nORIGIN\n        1 acgt\n//\n')
    with pytest.raises(Exception, match="unknown first line|end-of-stream|Compressed"):
        readers.read_contigs(spark, str(tmp_path)).count()
    got = readers.read_contigs(spark, str(tmp_path), tolerant=True).collect()
    assert {r.name for r in got} >= {"x", "r1"}
    assert sorted(r.file.rsplit("/", 1)[1] for r in readers.failed_files(spark, str(tmp_path)).collect()) == ["b.fa", "c.fa.gz"]
    assert {r.file.rsplit("/", 1)[1]: r.table for r in readers.genbank_tables(spark, str(tmp_path), "*.gb").collect()} == {"d.gb": "4"}


def test_sql_functions(spark):
    catalog.register(spark)
    row = spark.sql("SELECT gc_content('GGCA') AS gc, gc_content('') AS none, revcomp('ATGCN') AS rc, codons('ATGCCCA') AS c, translate_dna('GTGAAANNTTAGC') AS p, zcurve('ATG') AS z").first()
    assert (row.gc, row.none, row.rc, row.c, row.p) == (0.75, None, "NGCAT", ["ATG", "CCC"], "MKX*") and np.allclose(row.z, features.zcurve("ATG"))
    seq = genome(21, 3)
    spark.createDataFrame([(1, seq), (2, None)], "i int, seq string").createOrReplaceTempView("some_contigs")
    got = spark.sql("SELECT i, o.strand, o.start, o.end, o.nt FROM some_contigs, LATERAL find_orfs(seq, false, '11', 90, false) o").collect()
    want = [(1, r[0], r[4], r[5], r[12]) for r in orfs.scan(seq, False, 90)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_positive_cluster():
    c = np.array([[0.0, 0.0], [3.0, 0.0], [1.0, 0.0]])
    assert models.positive(np.array([10, 10, 10]), np.array([1, 5, 2]), c) == 1
    assert models.positive(np.array([50, 25, 25]), np.array([0, 10, 10]), c) == 2  # a tie goes to the one nearest the first
    assert models.positive(np.array([100, 25, 0]), np.array([20, 0, 0]), c) == 0
    assert models.collapsed(0.3, np.array([100, 1]), 2) and models.collapsed(0.3, np.array([100, 0]), 2) and not models.collapsed(0.4, np.array([100, 0]), 2) and not models.collapsed(0.3, np.array([90, 10]), 2)


def test_labelling(spark):
    rng = random.Random(5)
    rows = [("g", 1, False, genome(31, 10) + "".join(rng.choices("ACGT", k=3000)))]
    out = gene_finder.label_genes(spark.createDataFrame(rows, "genome_id string, contig_id long, circ boolean, seq string"), Options(rounds=2)).collect()
    assert out and sorted(r.idx for r in out) == list(range(len(out))) and all(-0.5 <= r.i_score == r.t_score - 0.5 <= 0.5 for r in out)


def test_refined_scores_of_the_exact_classifier(spark):
    rng = random.Random(6)
    scores = (0.9, 0.8, 0.02, 0.03, 0.2, 0.0)
    rows = [("g", 1, 0, i % 3, i, 0, 300, [0], "".join(rng.choices("ACGT" if scores[i % 6] > 0.5 else "AACCTT", k=450)), scores[i % 6], 0.5) for i in range(60)]
    schema = "genome_id string, contig_id long, strand int, frame int, end int, start int, len int, starts array<int>, ctx string, i_score double, r_score double"
    df = spark.createDataFrame(rows, schema).withColumn("end", F.lit(300) + 0 * F.col("end")).withColumn("i", F.monotonically_increasing_id())
    got = {exact: sorted((r.i, r.i_score, r.c_score) for r in gene_finder.refined_scores(df, exact=exact).collect()) for exact in (False, True)}
    assert [r[:2] for r in got[True]] == [r[:2] for r in got[False]] and len(got[True]) == 60
    for _, score, c in got[True]:
        assert c == 0 if score == 0 else c > 0.5 if score > 0.5 else c < 0.5 if score < 0.1 else 0 < c < 1


def test_options_of_classifier_and_clusters():
    for odd in ({"classifier": "other"}, {"clusters": 1}, {"clusters": 65}):
        with pytest.raises(gene_finder.BadOption):
            Options(**odd)
