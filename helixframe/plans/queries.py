"""Registered queries over the given tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import sequence as S
from helixframe.operators import chunks, decoys, features, intervals, kernel, matching, models, networks, ordered, orfs, startmodel, trainer
from helixframe.plans import decoy_batches, gene_finder
from helixframe.plans import oracles as O
from helixframe.sources import writers
from helixframe.sources.contigs import document_contigs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(column) -> "F.Column":
    return F.round(column.cast("double"), DIGITS)


def complete_orfs(spark: SparkSession, sf_dir: str, sequences: bool = False, columns: list[str] | None = None) -> DataFrame:
    return orfs.find_orfs(document_contigs(spark, sf_dir), 90, complete_only=True, sequences=sequences, columns=columns)


@query(O.GENES + "SELECT genome_id, contig_id, idx, strand, rstart, rend, len, round(n_gc / len, 6) AS gc FROM genes WHERE len >= 300")
def top_genes(spark, sf_dir):
    """The flagship: linear and circular contigs, both strands, ORFs with open ends and across the origin, numbering, and the genes of 300 nt or more."""
    found = genes(spark, sf_dir)
    return found.filter("len >= 300").select("genome_id", "contig_id", "idx", "strand", "rstart", "rend", "len", rounded(orfs.gc_content()).alias("gc"))


@query(O.CONTIGS + "SELECT genome_id, contig_id, name, circ, len, md5(seq) AS digest FROM contigs")
def contigs_derive(spark, sf_dir):
    return document_contigs(spark, sf_dir).select("genome_id", "contig_id", "name", "circ", "len", F.md5("seq").alias("digest"))


@query(O.CONTIGS + "SELECT contig_id, md5(translate(reverse(seq), 'ACGT', 'TGCA')) AS digest FROM contigs")
def revcomp(spark, sf_dir):
    return document_contigs(spark, sf_dir).select("contig_id", F.md5(S.reverse_complement(F.col("seq"))).alias("digest"))


@query(O.CONTIGS + "SELECT contig_id, length(seq) - length(translate(seq, 'GC', '')) AS n_gc FROM contigs")
def gc_count(spark, sf_dir):
    return document_contigs(spark, sf_dir).select("contig_id", S.gc_count(F.col("seq")).cast("long").alias("n_gc"))


@query(O.CONTIGS + "SELECT genome_id, sum(len)::BIGINT AS size, round(sum(length(seq) - length(translate(seq, 'GC', ''))) * 100.0 / sum(len), 6) AS gc FROM contigs GROUP BY genome_id")
def genome_gc(spark, sf_dir):
    c = document_contigs(spark, sf_dir)
    return c.groupBy("genome_id").agg(F.sum("len").alias("size"), rounded(F.sum(S.gc_count(F.col("seq"))) * 100.0 / F.sum("len")).alias("gc"))


@query(O.CONTIGS + "SELECT contig_id, len FROM contigs WHERE len >= 90")
def contig_minlen(spark, sf_dir):
    return document_contigs(spark, sf_dir).filter("len >= 90").select("contig_id", "len")


@query(O.CONTIGS + O.CODON_INDEX + "SELECT genome_id, address, count(*) AS n FROM indexed GROUP BY ALL")
def codon_index(spark, sf_dir):
    c = document_contigs(spark, sf_dir).select("genome_id", F.explode(S.codons(F.col("seq"))).alias("codon"))
    return c.groupBy("genome_id", "codon").agg(F.count("*").alias("n")).select("genome_id", S.kmer_address(F.col("codon"), 3).alias("address"), "n")


@query(O.COMPLETE + O.PROTEIN + "SELECT contig_id, strand, \"end\", protein FROM proteins")
def translate_protein(spark, sf_dir):
    found = complete_orfs(spark, sf_dir, sequences=True)
    return found.select("contig_id", "strand", "end", S.translate_dna(F.col("nt")).alias("protein"))


@query(O.COMPLETE + "SELECT genome_id, contig_id, strand, frame, start, \"end\", len, rstart, rend, n_gc, n_g2 FROM complete")
def orf_complete_only(spark, sf_dir):
    return complete_orfs(spark, sf_dir).select("genome_id", "contig_id", "strand", "frame", "start", "end", "len", "rstart", "rend", "n_gc", "n_g2")


@query(O.SCAN + "SELECT genome_id, contig_id, strand, frame, starts, types, start, \"end\", len, edge_type, n_gc, n_g2, rstart, rend FROM orfs WHERE NOT circ")
def orf_edges(spark, sf_dir):
    return _scanned(spark, sf_dir, "not circ")


@query(O.SCAN + "SELECT genome_id, contig_id, strand, frame, starts, types, start, \"end\", len, edge_type, n_gc, n_g2, rstart, rend FROM orfs WHERE circ")
def orf_circular(spark, sf_dir):
    return _scanned(spark, sf_dir, "circ")


@query(O.SCAN + "SELECT genome_id, contig_id, strand, frame, starts, types, start, \"end\", len, edge_type, n_gc, n_g2, rstart, rend FROM orfs")
def orf_chunked(spark, sf_dir):
    """The ORFs of linear and circular contigs, scanned in chunks of a thousand bases, so that many go across chunks."""
    found = chunks.find_orfs(document_contigs(spark, sf_dir), 90, 1000)
    return found.drop("name", "contig_len").withColumn("starts", F.array_join("starts", ",")).withColumn("types", F.array_join("types", ","))


def _scanned(spark, sf_dir, which):
    found = orfs.find_orfs(document_contigs(spark, sf_dir).filter(which), 90)
    return found.drop("name", "contig_len").withColumn("starts", F.array_join("starts", ",")).withColumn("types", F.array_join("types", ","))


@query(O.COMPLETE + "SELECT contig_id, strand, \"end\", round(n_gc / len, 6) AS gc, round(n_g2 * 3 / len, 6) AS g2 FROM complete WHERE len >= 200 AND (n_gc / len <= 0.57 OR n_g2 * 3 / len < 0.2 * (n_gc / len) + 0.12)")
def orf_seed_filter(spark, sf_dir):
    found = orfs.seeds(complete_orfs(spark, sf_dir), 200)
    return found.select("contig_id", "strand", "end", rounded(orfs.gc_content()).alias("gc"), rounded(orfs.g2_content()).alias("g2"))


def genes(spark, sf_dir, sequences: bool = False) -> DataFrame:
    found = models.kept(orfs.find_orfs(document_contigs(spark, sf_dir), 90, sequences=sequences))
    numbered = ordered.numbered(found, ["genome_id"], ["contig_id"], ["rend", "strand", "rstart"])
    score = rounded(orfs.gc_content())
    return numbered.withColumn("i_score", score - 0.4).withColumn("t_score", score).withColumn("r_score", rounded(orfs.g2_content()))


@query(O.GENES + "SELECT genome_id, contig_id, strand, rstart, rend, idx FROM genes")
def gene_numbering(spark, sf_dir):
    return genes(spark, sf_dir).select("genome_id", "contig_id", "strand", "rstart", "rend", "idx")


@query(O.COMPLETE + O.ZCURVE + "SELECT genome_id, k, round(mean, 6) AS mean FROM zcurve")
def zcurve_profile(spark, sf_dir):
    """The mean of each of the 189 features over a genome's ORFs."""
    rows = features.encode(complete_orfs(spark, sf_dir, True).select("genome_id", "nt"))
    return features.moments(rows, ["genome_id"]).select("genome_id", "k", rounded(F.col("mean")).alias("mean"))


@query(O.COMPLETE + O.FEATURES + "SELECT k, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(least(1, low), 6) AS low, round(greatest(0, high), 6) AS high FROM stats")
def feature_scaling(spark, sf_dir):
    """Means, deviations and scaling ranges of the features."""
    rows = features.encode(complete_orfs(spark, sf_dir, True).select("contig_id", "nt"))
    stats = features.min_max(features.moments(rows, []))
    return stats.select("k", "n", *(rounded(F.col(c)).alias(c) for c in ("mean", "sd", "low", "high")))


@query(O.COMPLETE + O.FEATURES + "SELECT genome_id, round(1 / (189 * var_pop(value)), 6) AS gamma FROM feats GROUP BY genome_id")
def svm_gamma(spark, sf_dir):
    rows = features.encode(complete_orfs(spark, sf_dir, True).select("genome_id", "nt"))
    return features.rbf_gamma(features.moments(rows, ["genome_id"]), ["genome_id"]).select("genome_id", rounded(F.col("gamma")).alias("gamma"))


@query(O.COMPLETE + O.FEATURES + O.digest("CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE value END", 6, "feats JOIN (SELECT genome_id, k, least(1, min(value)) AS lo, greatest(0, max(value)) AS hi FROM feats GROUP BY ALL) USING (genome_id, k)"))
def minmax_scale(spark, sf_dir):
    """The features of every ORF within the ranges of its genome, as a digest."""
    rows = models.kept(complete_orfs(spark, sf_dir, True, ["genome_id", "contig_id", "strand", "end", "nt"]).dropna(subset=["genome_id"]))
    stats = features.min_max(features.moments(rows, ["genome_id"], "nt"))
    return _digests(rows, stats, ["low", "high"], lambda x, low, high: np.where(high > low, (x - low) / np.where(high > low, high - low, 1), x), 6)


def _digests(rows, stats, names, value, digits):
    """A digest of each ORF's features in terms of its genome's stats, made in one pass, so that features don't leave the task."""
    stats = models.kept(stats)
    groups = reduce(lambda a, b: a.join(b, "genome_id"), (features.as_array(stats, ["genome_id"], F.col(n), n) for n in names))

    def function(b: pa.RecordBatch, groups: list) -> pa.RecordBatch:
        x = features.encoded(b.column("nt"))
        for at, found in groups:
            x[at] = value(x[at], *map(np.array, found))
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in ("contig_id", "strand", "end")), pa.array(features.digests(x, digits))], names=["contig_id", "strand", "end", "digest"])

    return models.with_models(rows, models.kept(groups), ["genome_id"], names, function, "contig_id long, strand int, end int, digest string")


@query(O.COMPLETE + "SELECT gc_bin, count(*) AS n FROM (SELECT CASE WHEN gc < 0.2 THEN 0 WHEN gc >= 0.8 THEN 60 ELSE floor((gc - 0.2) * 100)::INT + 1 END AS gc_bin FROM (SELECT n_gc / len AS gc FROM complete)) GROUP BY gc_bin")
def gc_bin_direct(spark, sf_dir):
    return complete_orfs(spark, sf_dir).groupBy(S.gc_bin(orfs.gc_content()).alias("gc_bin")).agg(F.count("*").alias("n"))


@query(O.COMPLETE + O.LAGGING + "SELECT genome_id, contig_id, strand, \"end\", bin FROM lagging")
def gc_bin_lag(spark, sf_dir):
    found = complete_orfs(spark, sf_dir).withColumn("gc", orfs.gc_content())
    return ordered.lagging_bin(found, ["genome_id"], "gc", ["contig_id", "strand", "end"]).select("genome_id", "contig_id", "strand", "end", "bin")


@query(O.CONTIGS + O.LABELS + "SELECT class, gc_bin, n, round(n * 100.0 / sum(n) OVER (PARTITION BY class), 6) AS pct FROM (SELECT class, gc_bin, count(*) AS n FROM labelled WHERE gc_bin IS NOT NULL GROUP BY ALL)")
def gc_partition_report(spark, sf_dir):
    """Contigs by language and G+C bin, with each bin's share."""
    from pyspark.sql import Window

    c = document_contigs(spark, sf_dir).select(F.substring("name", 1, 2).alias("class"), S.gc_bin_label(S.gc_percent(F.col("seq")), 20, 80, 5).alias("gc_bin"))
    counts = c.filter("gc_bin is not null").groupBy("class", "gc_bin").agg(F.count("*").alias("n"))
    return counts.withColumn("pct", rounded(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("class"))))


@query(O.COMPLETE + O.ORF_CODONS + "SELECT genome_id, codon, count(*) AS n FROM orf_codons WHERE codon NOT IN ('TAA', 'TAG', 'TGA') GROUP BY ALL")
def codon_usage(spark, sf_dir):
    return _codons(spark, sf_dir).filter(~F.col("codon").isin("TAA", "TAG", "TGA"))


@query(O.COMPLETE + O.ORF_CODONS + "SELECT genome_id, codon, count(*) AS n FROM orf_codons WHERE codon IN ('TAA', 'TAG', 'TGA') GROUP BY ALL")
def stop_usage(spark, sf_dir):
    return _codons(spark, sf_dir).filter(F.col("codon").isin("TAA", "TAG", "TGA"))


def _codons(spark, sf_dir):
    found = complete_orfs(spark, sf_dir, True).select("genome_id", F.explode(S.codons(F.col("nt"))).alias("codon"))
    return found.filter(F.col("codon").rlike("^[ACGT]{3}$")).groupBy("genome_id", "codon").agg(F.count("*").alias("n"))


@query(O.GENES + "SELECT a.genome_id, a.contig_id, a.idx AS \"left\", b.idx AS \"right\", least(a.rend, b.rend) - greatest(a.lo, b.lo) AS olen FROM genes a JOIN genes b ON a.contig_id = b.contig_id AND a.idx < b.idx AND a.rend > b.lo AND b.rend > a.lo WHERE least(a.rend, b.rend) - greatest(a.lo, b.lo) >= 60")
def overlap_pairs(spark, sf_dir):
    return intervals.overlap_pairs(genes(spark, sf_dir), 60)


@query(O.GENES + "SELECT genome_id, contig_id, idx FROM genes g WHERE NOT EXISTS (SELECT 1 FROM genes b WHERE b.contig_id = g.contig_id AND b.idx <> g.idx AND least(g.rend, b.rend) - greatest(g.lo, b.lo) > 75)")
def overlap_antijoin(spark, sf_dir):
    return intervals.without_overlaps(genes(spark, sf_dir), 75).select("genome_id", "contig_id", "idx")


@query(O.GENES + """SELECT genome_id, pair, olen, "left" = idx AS is_left, contig_id, idx, strand, rstart, rend FROM (
  SELECT a.genome_id, a.idx AS "left", a.idx || '-' || b.idx AS pair, least(a.rend, b.rend) - greatest(a.lo, b.lo) AS olen, unnest([a.idx, b.idx]) AS idx
  FROM genes a JOIN genes b ON a.contig_id = b.contig_id AND a.idx < b.idx AND a.rend > b.lo AND b.rend > a.lo WHERE least(a.rend, b.rend) - greatest(a.lo, b.lo) >= 120)
  JOIN (SELECT genome_id, contig_id, idx, strand, rstart, rend FROM genes) USING (genome_id, idx)""")
def overlap_report(spark, sf_dir):
    """Each overlapping pair as two rows with the genes' places."""
    found = models.kept(genes(spark, sf_dir).select("genome_id", "contig_id", "contig_len", "idx", "strand", "rstart", "rend"))
    out = gene_finder.overlap_report(found).withColumn("is_left", F.substring_index("pair", "-", 1) == F.col("idx").cast("string"))
    return out.select("genome_id", "pair", "olen", "is_left", "contig_id", "idx", "strand", "rstart", "rend")


@query(O.GENES + "SELECT contig_id, idx, len FROM genes WHERE len >= 180 AND i_score > 0.05 AND edge_type = 0")
def orf_score_filter(spark, sf_dir):
    """Closed ORFs of a length with a score above one."""
    return gene_finder.filtered(genes(spark, sf_dir), 180, 0.05, True).select("contig_id", "idx", "len")


@query(O.GENES + "SELECT genome_id, idx, contig_id, len FROM (SELECT *, row_number() OVER (PARTITION BY genome_id ORDER BY len DESC, idx) AS r FROM genes) WHERE r <= 10")
def longest_genes(spark, sf_dir):
    """A top-k report: the ten longest genes of each genome."""
    found = genes(spark, sf_dir).select("genome_id", "idx", "contig_id", "len", (-F.col("len")).alias("short"))
    return ordered.limited(found, ["genome_id"], ["short", "idx"], 10).drop("short")


@query(O.COMPLETE + O.MERGED + "SELECT contig_id, start, \"end\" FROM merged")
def interval_merge(spark, sf_dir):
    found = complete_orfs(spark, sf_dir).select("contig_id", (F.col("rstart") - 1).alias("start"), F.col("rend").alias("end"))
    return intervals.merged(found, ["contig_id"])


@query(O.COMPLETE + O.MERGED + O.GAPS + "SELECT contig_id, lo, hi FROM gaps")
def gaps(spark, sf_dir):
    return _gaps(spark, sf_dir)


@query(O.COMPLETE + O.MERGED + O.GAPS + "SELECT contig_id, sum(floor((hi - lo) / 90))::BIGINT AS capacity, max(hi - lo) AS largest FROM gaps GROUP BY contig_id")
def gap_capacity(spark, sf_dir):
    return intervals.capacity(_gaps(spark, sf_dir), ["contig_id"])


def _gaps(spark, sf_dir):
    c = document_contigs(spark, sf_dir)
    found = complete_orfs(spark, sf_dir).select("contig_id", (F.col("rstart") - 1).alias("start"), F.col("rend").alias("end"))
    return intervals.gaps(found, c.select("contig_id", "len"), ["contig_id"])


@query(O.COMPLETE + O.BACKGROUND + "SELECT genome_id, base, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY genome_id), 6) AS share FROM background GROUP BY genome_id, base")
def bkg_freq(spark, sf_dir):
    """Base frequencies around start-like codons upstream of seeds."""
    windows = startmodel.background_windows(document_contigs(spark, sf_dir))
    return startmodel.base_shares(windows).withColumn("share", rounded(F.col("share")))


@query(O.COMPLETE + O.WINDOWS + "SELECT genome_id, class, pos, kmer, n FROM counts")
def pwm_counts(spark, sf_dir):
    """Two-base words around starts, later candidates and start-like codons before starts."""
    return startmodel.kmer_counts(*_windows(spark, sf_dir), 1)


def _windows(spark, sf_dir):
    c = document_contigs(spark, sf_dir)
    return startmodel.start_windows(c), startmodel.background_windows(c)


@query(O.COMPLETE + O.WINDOWS + O.LOGP + "SELECT genome_id, class, pos, kmer, round(logp, 6) AS logp FROM logp")
def pwm_logprob(spark, sf_dir):
    counts = startmodel.kmer_counts(*_windows(spark, sf_dir), 1)
    return startmodel.log_probabilities(counts, 1).withColumn("logp", rounded(F.col("logp")))


@query(O.COMPLETE + O.BACKGROUND + O.PRIORS + "SELECT genome_id, round(p, 6) AS p, most::INT AS most, round(uf, 6) AS uf, round(df, 6) AS df FROM priors")
def start_odds(spark, sf_dir):
    """How often a start codon goes before a stop codon, and the candidates to expect before and after the true start."""
    shares = startmodel.base_shares(startmodel.background_windows(document_contigs(spark, sf_dir)))
    return startmodel.start_odds(shares).select("genome_id", rounded(F.col("p")).alias("p"), "most", rounded(F.col("uf")).alias("uf"), rounded(F.col("df")).alias("df"))


@query(O.COMPLETE + O.WINDOWS + O.LOGP + O.PRIORS + O.POSTERIOR + "SELECT contig_id, strand, \"end\", arg_max(j, (score, -j)) AS j, max(score) AS score FROM scores GROUP BY ALL")
def tis_argmax(spark, sf_dir):
    """The start with the highest posterior under the genome's own start model."""
    windows, background = map(models.kept, _windows(spark, sf_dir))
    tables = models.kept(startmodel.log_probabilities(startmodel.kmer_counts(windows, background, 1), 1))
    odds = models.kept(startmodel.start_odds(startmodel.base_shares(background)))
    scores = startmodel.candidate_scores(windows, tables, odds, 1).withColumn("score", F.round("score", 6))
    return ordered.best_candidate(scores.select("contig_id", "strand", "end", "j", "score"), ["contig_id", "strand", "end"], "score", "j")


@query(O.EARLY)
def early_exit(spark, sf_dir):
    """Events of a user as candidates: the best of the first five unless all of them score low."""
    e = table(spark, sf_dir, "events").select("user_id", (F.row_number().over(_order("user_id", "ts", "event_id")) - 1).alias("j"), F.round(F.col("value") - F.floor("value"), 6).alias("score"))
    return ordered.early_exit(e, ["user_id"], "score", "j", enough=0.9)


def _order(by, *columns):
    from pyspark.sql import Window

    return Window.partitionBy(by).orderBy(*columns)


@query(O.MATCH + "SELECT assembly, ord FROM predicted p WHERE EXISTS (SELECT 1 FROM truth t WHERE t.assembly = p.assembly AND t.host = p.host AND t.strand = p.strand AND (t.start = p.start OR t.\"end\" = p.\"end\"))")
def eval_match_semi(spark, sf_dir):
    p, t = _features(spark, sf_dir)
    return matching.matched_predictions(p, t, ["assembly", "host"]).select("assembly", "ord")


@query(O.MATCH + O.GREEDY)
def eval_greedy(spark, sf_dir):
    """The evaluation table: predicted features of 150 nt or more, the shorter ones as controls, each matched greedily."""
    p, t = _features(spark, sf_dir)
    t, keys = models.kept(t), ["assembly", "host"]
    p, controls = models.kept(p.filter("len >= 150")), models.kept(p.filter("len < 150"))
    found, false = (matching.greedy_matches(x, t, keys) for x in (p, controls))
    return matching.report(p, t, found, "assembly", controls, false)


@query(O.COMPLETE + O.ORF_CODONS + O.DRAWS)
def sampled_codons(spark, sf_dir):
    """A sense codon drawn for each ORF by its genome's codon usage."""
    found = models.kept(complete_orfs(spark, sf_dir, True).select("genome_id", "contig_id", "strand", "end", "nt"))
    codons = found.select("genome_id", F.explode(S.codons(F.col("nt"))).alias("codon"))
    usage = codons.filter(F.col("codon").rlike("^[ACGT]{3}$") & ~F.col("codon").isin("TAA", "TAG", "TGA")).groupBy("genome_id", "codon").agg(F.count("*").alias("n"))
    draws = found.select("genome_id", "contig_id", "strand", "end", ordered.uniform(42, "genome_id", "contig_id", "strand", "end").alias("u"))
    out = ordered.weighted_draws(draws, usage, ["genome_id"], "codon", "n")
    return out.select("genome_id", "contig_id", "strand", "end", F.round("u", 9).alias("u"), "codon")


def _features(spark, sf_dir):
    """Predicted features from all ORFs; annotated ones from those of 120 nt or more, every third shifted at its start."""
    g = genes(spark, sf_dir).select(F.col("genome_id").alias("assembly"), S.unversioned(F.concat(F.col("name"), F.lit(".1"))).alias("host"), F.col("rstart").alias("start"), F.col("rend").alias("end"), writers.sign(F.col("strand")).alias("strand"), F.col("idx").alias("ord"), "len")
    moved = F.col("ord") % 3 == 0
    t = g.filter("len >= 120").withColumn("start", F.col("start") + F.when(moved, 3).otherwise(0)).withColumn("end", F.col("end") + F.when(F.col("ord") % 9 == 0, 6).otherwise(0))
    return g, t


@query("SELECT doc_id, text IS NOT NULL AS has_text FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_anti(spark, sf_dir):
    """Work that is still to be done: rows without a result row."""
    d, done = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id")
    return d.join(done, "doc_id", "left_anti").select("doc_id", F.col("text").isNotNull().alias("has_text"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type, event_id) AS r FROM events) WHERE r = 1")
def file_priority(spark, sf_dir):
    """The first of several sources for a key, by the sources' order."""
    return ordered.first_per(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id"], ["event_type", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS carried FROM events")
def fill_forward(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("mark"))
    return ordered.fill_forward(e, ["user_id"], "event_id", "mark", "carried").select("event_id", "carried")


@query("SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(event_id)) AS r FROM events GROUP BY user_id, event_type) WHERE r = 1")
def modal_value(spark, sf_dir):
    """The most frequent value of a key, of equally frequent ones the first seen."""
    return ordered.modal(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


@query("SELECT l_orderkey, l_linenumber, round((sum(l_quantity) OVER w - l_quantity) / sum(l_quantity) OVER (PARTITION BY l_orderkey), 6) AS lo, round(sum(l_quantity) OVER w / sum(l_quantity) OVER (PARTITION BY l_orderkey), 6) AS hi FROM (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING)")
def prefix_sum_sampler(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("l_quantity"))
    out = ordered.weighted_ranges(li, ["l_orderkey"], "l_linenumber", "l_quantity")
    return out.select("l_orderkey", "l_linenumber", rounded(F.col("lo")).alias("lo"), rounded(F.col("hi")).alias("hi"))


@query("SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM (SELECT sum((quality = 1 AND toxic = 0)::INT)::BIGINT AS tp, sum((quality = 0 AND toxic = 0)::INT)::BIGINT AS fp, sum((quality = 1 AND toxic = 1)::INT)::BIGINT AS fn, sum((quality = 0 AND toxic = 1)::INT)::BIGINT AS tn FROM labels)")
def confusion_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").withColumn("predicted", 1 - F.col("toxic"))
    out = matching.confusion(rows, "quality", "predicted")
    return out.select("tp", "fp", "fn", "tn", *(rounded(F.col(c)).alias(c) for c in ("accuracy", "precision", "recall", "f1")))


@query(O.GENES + O.LINES + "SELECT contig_id, idx, gff AS line FROM lines")
def gff_lines(spark, sf_dir):
    return genes(spark, sf_dir).select("contig_id", "idx", writers.gff_line().alias("line"))


@query(O.GENES + O.LINES + "SELECT contig_id, idx, bed AS line FROM lines")
def bed_lines(spark, sf_dir):
    return genes(spark, sf_dir).select("contig_id", "idx", writers.bed_line().alias("line"))


@query(O.GENES + O.LINES + "SELECT contig_id, idx, fasta AS line FROM lines")
def fasta_header(spark, sf_dir):
    return genes(spark, sf_dir).select("contig_id", "idx", writers.fasta_header().alias("line"))


@query(O.SCAN + O.LOCATIONS + "SELECT contig_id, strand, frame, \"end\", location FROM locations")
def gbk_location(spark, sf_dir):
    found = orfs.find_orfs(document_contigs(spark, sf_dir), 90)
    return found.select("contig_id", "strand", "frame", "end", writers.location().alias("location"))


@query("SELECT doc_id, ('0x' || substr(sha256('42:' || source || '_' || doc_id), 1, 16))::UBIGINT::VARCHAR AS seed FROM documents")
def genome_seed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.genome_seed(42, F.concat_ws("_", "source", F.col("doc_id").cast("string"))).cast("string").alias("seed"))


@query(O.CONTIGS + "SELECT genome_id, contig_id, row_number() OVER (PARTITION BY genome_id ORDER BY contig_id) - 1 AS place, len FROM contigs")
def record_lengths(spark, sf_dir):
    """The length of each of a genome's records, with its place."""
    c = document_contigs(spark, sf_dir).select("genome_id", "contig_id", F.floor(F.col("contig_id") / 1000).alias("part"), "len")
    return ordered.numbered(c, ["genome_id"], ["part"], ["contig_id"], "place").select("genome_id", "contig_id", "place", "len")


@query("SELECT label, count(*) AS n, round(sum(s), 3) AS total FROM (SELECT a.label, list_inner_product(a.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS s FROM embeddings a JOIN (SELECT label, embedding FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)) c USING (label)) GROUP BY label")
def embedding_dot(spark, sf_dir):
    return _against_first(spark, sf_dir, S.dot(F.col("embedding"), F.col("c")), 3)


@query("SELECT label, count(*) AS n, round(sum(exp(-0.01 * s)), 4) AS total FROM (SELECT a.label, list_sum(list_transform(list_zip(a.embedding, c.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))) AS s FROM embeddings a JOIN (SELECT label, embedding FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)) c USING (label)) GROUP BY label")
def rbf_kernel(spark, sf_dir):
    return _against_first(spark, sf_dir, S.rbf(F.col("embedding"), F.col("c"), 0.01), 4)


def _against_first(spark, sf_dir, value, digits):
    """Each vector against the first of its label."""
    e = table(spark, sf_dir, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("c"))
    return e.join(first, "label").groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum(value), digits).alias("total"))


@query(O.TABLES)
def code_table_score(spark, sf_dir):
    """The genetic code under which most of a genome's ORF bases look coding to a network with given weights over the one-base features."""
    flat = [0.0] * (features.DIMENSION - 9)
    network = models.Network([0.0] * features.DIMENSION, [1.0] * features.DIMENSION, [[1.0 if k % 2 else -0.5 for k in range(9)] + flat, [0.25] * 9 + flat], [0.1, -0.2], [0.5, -1.0], 0.3137)
    shares = gene_finder.coding_shares(document_contigs(spark, sf_dir), dict.fromkeys(range(61), network), gene_finder.Options(gc_bin="direct"), complete_only=True)
    return ordered.best_candidate(shares.withColumn("score", rounded(F.col("share"))), ["genome_id"], "score", "rank").select("genome_id", "code", "score")


@query(O.COMPLETE + O.FEATURES + O.MLP)
def mlp_score(spark, sf_dir):
    """A network with given weights over all standardised features."""
    rows = features.encode(models.kept(complete_orfs(spark, sf_dir, True).select("contig_id", "strand", "end", "nt")))
    means = [(r.mean, r.sd) for r in features.moments(rows, []).orderBy("k").collect()]  # a row a feature
    network = models.Network(
        mean=[m for m, _ in means], sd=[s for _, s in means],
        hidden=[[(1.0 if k % 2 else -0.5) / 10 for k in range(features.DIMENSION)], [(k % 7 - 3) / 20 for k in range(features.DIMENSION)], [0.025] * features.DIMENSION],
        hidden_bias=[0.1, -0.2, 0.0], out=[0.5, -1.0, 0.25], out_bias=0.3,
    )
    return models.mlp_scores(rows, network).select("contig_id", "strand", "end", rounded(F.col("score")).alias("score"))


@query()
def svm_score(spark, sf_dir):
    """Each genome's own model: ORFs of 300 nt or more against short ones; training is numeric and tests hold it."""
    rows = features.encode(models.kept(complete_orfs(spark, sf_dir, True).select("genome_id", "contig_id", "strand", "end", "len", "nt")))
    label = F.when(F.col("len") >= 300, 1).when(F.col("len") < 150, -1)
    model = models.train_svm(rows.withColumn("label", label), ["genome_id"])
    return models.svm_scores(rows, model, ["genome_id"]).select("genome_id", "contig_id", "strand", "end", F.round("score", 4).alias("score"))


@query()
def kernel_score(spark, sf_dir):
    """Each genome's exact radial classifier on all its labelled rows, ORFs of 300 nt or more against short ones; tests hold it
    against a plain solver."""
    rows = models.kept(complete_orfs(spark, sf_dir, True).select("genome_id", "contig_id", "strand", "end", "len", "nt"))
    label = F.when(F.col("len") >= 300, 1).when(F.col("len") < 150, -1)
    model = kernel.train(features.encode(rows.withColumn("label", label).filter("label is not null")), ["genome_id"], strict=False)
    return kernel.scores(features.encode(rows), model, ["genome_id"]).select("genome_id", "contig_id", "strand", "end", F.round("score", 3).alias("score"))


@query()
def revised_genes(spark, sf_dir):
    """The whole gene-finding plan, its first scores by a network with given weights, with two rounds of starts an order: scores,
    starts by k-mer tables, each genome's classifier, numbered genes. Tests hold its steps."""
    hidden = [[(1.0 if k % 2 else -0.5) / 2 for k in range(features.DIMENSION)], [(k % 7 - 3) / 4 for k in range(features.DIMENSION)]]
    network = models.Network([0.0] * features.DIMENSION, [1.0] * features.DIMENSION, hidden, [0.1, -0.2], [2.0, -2.0], 0.1)
    options = gene_finder.Options(reviser="counts", rounds=2)
    found = gene_finder.find_genes(document_contigs(spark, sf_dir), options, dict.fromkeys(range(61), network))
    return found.select("genome_id", "contig_id", "idx", "strand", "rstart", "rend", "len", "edge_type", F.round("r_score", 4).alias("r_score"), F.round("t_score", 4).alias("t_score"))


@query()
def kmeans_label(spark, sf_dir):
    """Coding labels by clustering the ORFs of a length that their genome's G+C gives, and 0 for shorter ones; the clusters depend on random starts and tests hold their rules."""
    gc = F.sum(S.gc_count(F.col("seq"))) / F.sum("len")
    genomes = models.bounded(models.kept(document_contigs(spark, sf_dir).groupBy("genome_id").agg(gc.alias("genome_gc"))))
    found = complete_orfs(spark, sf_dir, True).select("genome_id", "contig_id", "strand", "end", "len", "n_gc", "n_g2", "nt").join(genomes, "genome_id")
    rows = features.encode(models.kept(found))
    high = F.col("genome_gc")
    trusted = (F.col("len") >= 550) & ((high <= 0.57) | (orfs.g2_content() < 0.2 * high + 0.12))
    rows = rows.withColumn("is_seed", trusted).withColumn("is_long", F.col("len") >= models.auto_long(high)).withColumn("features", F.slice("features", 46, 144))
    return models.cluster_labels(rows, ["genome_id"]).select("genome_id", "contig_id", "strand", "end", "i_score")


@query(O.ACCESSIONS + O.MERGED + O.GAPS + O.DECOYS)
def decoy_counts(spark, sf_dir):
    """How many frames each accession, its contigs one behind the other, has and how many decoys it is to get; whether all are sound."""
    made = decoys.insert_decoys(document_contigs(spark, sf_dir)).manifest
    return made.select("genome_id", "n_records", "merged_len", "n_orfs", "n_target", (F.col("n_inserted") <= F.col("n_target")).alias("within"), "valid")


@query(O.ACCESSIONS + O.MERGED + O.GAPS + O.DECOYS_RESUMED)
def decoy_resumed(spark, sf_dir):
    """The manifest of decoys made in batches, of which the first run makes one and a second run the rest."""
    folder = f"{models.shared_folder(spark)}/decoys-{uuid.uuid4().hex}"
    contigs = document_contigs(spark, sf_dir)
    n = contigs.select("genome_id").distinct().count()
    decoy_batches.run_batches(contigs, folder, size=max(1, -(-n // 2)), most=1)
    return decoy_batches.run_batches(contigs, folder).select("genome_id", "n_records", "merged_len", "n_orfs", "n_target", "transl_table", "status")


@query()
def decoy_manifest(spark, sf_dir):
    """Decoys placed in the gaps of each accession, with a digest of their places; placement is random but seeded, and tests hold its rules."""
    made = decoys.insert_decoys(document_contigs(spark, sf_dir))
    place = F.concat_ws(":", F.col("start").cast("string"), F.col("end").cast("string"), "strand")
    digests = made.decoys.groupBy("genome_id").agg(F.md5(F.array_join(F.sort_array(F.collect_list(place)), ",")).alias("digest"))
    return made.manifest.join(digests, "genome_id", "left")


@query(O.COMPLETE + O.FEATURES + O.digest("(value - mean) / CASE WHEN sd < 1e-9 THEN 1 ELSE sd END", 4, "feats JOIN (SELECT genome_id, k, avg(value) AS mean, stddev_pop(value) AS sd FROM feats GROUP BY ALL) USING (genome_id, k)"))
def zscore(spark, sf_dir):
    """The features of every ORF, standardised over its genome's ORFs, as a digest."""
    rows = models.kept(complete_orfs(spark, sf_dir, True, ["genome_id", "contig_id", "strand", "end", "nt"]).dropna(subset=["genome_id"]))
    stats = features.moments(rows, ["genome_id"], "nt")
    return _digests(rows, stats, ["mean", "sd"], lambda x, mean, sd: (x - mean) / np.where(sd < 1e-9, 1.0, sd), 4)


@query(O.COMPLETE + "SELECT contig_id, strand, \"end\", j::INT AS j, candidate FROM (SELECT contig_id, strand, \"end\", unnest(starts[1:5]) AS candidate, unnest(range(len(starts[1:5]))) AS j FROM complete)")
def candidate_prefix(spark, sf_dir):
    """The first five starts of every ORF."""
    return complete_orfs(spark, sf_dir).select("contig_id", "strand", "end", F.posexplode(F.slice("starts", 1, 5)).alias("j", "candidate"))


@query(O.COMPLETE + "SELECT contig_id, strand, \"end\", md5(nt) AS digest FROM complete")
def orf_sequence(spark, sf_dir):
    return complete_orfs(spark, sf_dir, True).select("contig_id", "strand", "end", F.md5("nt").alias("digest"))


@query(O.GENES + O.FEATURE_LINES)
def gbk_feature(spark, sf_dir):
    return genes(spark, sf_dir, True).select("contig_id", "idx", F.md5(writers.genbank_feature()).alias("digest"))


@query()
def start_network(spark, sf_dir):
    """Starts chosen by the network of four convolutions, with weights drawn by a fixed seed as none are published, among all of an ORF's starts; tests hold its layers."""
    windows = startmodel.start_windows(document_contigs(spark, sf_dir), up=networks.UP_WIDE, down=networks.DOWN_WIDE)
    windows = windows.select("contig_id", "strand", "end", "j", "window")
    scores = networks.start_scores(windows, networks.Rounded(networks.random_start_network(7), 5))
    return networks.first_good(scores, ["contig_id", "strand", "end"])


@query()
def heuristic_training(spark, sf_dir):
    """The coding network trained to tell long ORFs from short ones: loss and measures of every epoch, on training and held-out rows; tests hold its gradient."""
    rows = features.encode(complete_orfs(spark, sf_dir, True).select("contig_id", "strand", "end", "len", "nt"))
    rows = models.kept(rows.filter("len >= 300 or len < 150").withColumn("label", (F.col("len") >= 300).cast("double")))
    return trainer.train_network(rows, ["contig_id", "strand", "end"])[1]
