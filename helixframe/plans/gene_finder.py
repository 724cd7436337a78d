"""The gene-finding plans: contigs to a numbered, thresholded gene table, and the overlap report.

A contig is scanned once; the reading frames with their surroundings are written to the checkpoint folder, and every score
is added where a row lies. Features are made in the tasks that use them and never travel.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.sequence import gc_bin, gc_count
from helixframe.operators import features, intervals, kernel, models, networks, ordered, orfs, startmodel

#: Genetic codes that are tried where none is given, in the order that ties go by, and the only start codon meanwhile.
CODES, TRIED_START = ("11", "16", "4"), ("ATG",)
#: Bases up to which a genome counts as small, so that starts are chosen by the network.
SMALL_GENOME = 20_000
#: ORFs below this score keep their start under the network.
LEAST_SCORE = 1e-5
KEYS = ["genome_id", "contig_id", "strand", "frame", "end"]


class BadOption(ValueError):
    """An option outside its range."""


class NothingFound(RuntimeError):
    """No reading frame is long enough."""


class TooManyFound(RuntimeError):
    """A genome has more reading frames than it may."""


@dataclass(frozen=True)
class Options:
    """``reviser`` is counts (k-mer tables), network or none; by default a network, if one is given, for small genomes and
    metagenomes, and counts for others. ``most_orfs`` bounds a genome's reading frames, if it is given. ``classifier`` is sampled
    (random features, a bounded sample) or exact (all labelled rows). ``longest`` and ``clusters`` are the least length of the
    ORFs that are clustered, where no networks are given, and the number of clusters; by default a genome's G+C gives both."""

    table: str = "11"
    minlen: int = 90
    circular: bool = False
    meta: bool = False
    threshold: float = 0.5
    min_overlap: int = 120
    gc_bin: str = "lag"
    reviser: str | None = None
    rounds: int = startmodel.ROUNDS
    most_orfs: int | None = None
    classifier: str = "sampled"
    longest: int | None = None
    clusters: int | None = None

    def __post_init__(self):
        if self.minlen < 75:
            raise BadOption("minlen has to be 75 or more")
        if self.gc_bin not in ("lag", "direct"):
            raise BadOption("gc_bin is lag or direct")
        if self.reviser not in (None, "counts", "network", "none"):
            raise BadOption("reviser is counts, network or none")
        if self.classifier not in ("sampled", "exact"):
            raise BadOption("classifier is sampled or exact")
        if self.clusters is not None and not 2 <= self.clusters <= 64:
            raise BadOption("clusters are 2 to 64")


def candidates(contigs: DataFrame, options: Options = Options()) -> DataFrame:
    """ORFs with their surroundings; contigs: genome_id, contig_id, circ, seq. Written once, as all later steps read them.

    Raises NothingFound where there is none, and TooManyFound beyond ``most_orfs`` of a genome.
    """
    found = models.kept(orfs.find_orfs(contigs, options.minlen, options.table, options.meta, context=True).withColumn("gc_cont", orfs.gc_content()))
    if found.isEmpty():
        raise NothingFound(f"no reading frame of {options.minlen} nt")
    if options.most_orfs is not None:
        most = found.groupBy("genome_id").count().agg(F.max("count")).first()[0]
        if most > options.most_orfs:
            raise TooManyFound(f"{most} reading frames in one genome")
    return found


def encoded(found: DataFrame) -> DataFrame:
    """With the features of each ORF from its present start on."""
    return features.encode(found.withColumn("nt", orfs.span(F.col("start"), F.col("end"))))


def initial_scores(found: DataFrame, coding: dict[int, models.Network], options: Options = Options()) -> DataFrame:
    """With i_score from the network of each ORF's G+C bin."""
    if options.gc_bin == "lag":
        binned = ordered.lagging_bin(found, ["genome_id"], "gc_cont", ["contig_id", "strand", "frame", "end"])
    else:
        binned = found.withColumn("bin", gc_bin(F.col("gc_cont")))
    return models.mlp_scores(encoded(binned), coding, "bin").drop("bin").withColumnRenamed("score", "i_score")


def trusted_seeds(found: DataFrame, longest: int = 550, most_overlap: int = 75) -> DataFrame:
    """With is_seed: long ORFs, with high G+C those with few G at codon position 2, that overlap no other of them."""
    long = orfs.seeds(found, longest, gc=F.col("genome_gc") if "genome_gc" in found.columns else None).select(*KEYS, "rstart", "rend", "contig_len")
    alone = intervals.without_overlaps(long.withColumn("idx", F.xxhash64("strand", "frame", "end")), most_overlap)
    return found.join(alone.select(*KEYS, F.lit(True).alias("is_seed")), KEYS, "left").withColumn("is_seed", F.coalesce("is_seed", F.lit(False)))


def seeded_scores(found: DataFrame, contigs: DataFrame, options: Options = Options()) -> DataFrame:
    """With i_score from clustering, for genomes without trained networks: ORFs of a length or more are clustered, others score 0."""
    gc = F.sum(gc_count(F.col("seq"))) / F.sum(F.length("seq"))
    genomes = models.bounded(models.kept(contigs.groupBy("genome_id").agg(gc.alias("genome_gc"))))
    least = models.auto_long(F.col("genome_gc")) if options.longest is None else F.lit(options.longest)
    rows = encoded(models.kept(trusted_seeds(found.join(genomes, "genome_id")).withColumn("is_long", F.col("len") >= least)))
    rows = rows.withColumn("features", F.slice("features", 46, 144))
    return models.cluster_labels(rows, ["genome_id"], options.clusters, options.table).drop("is_seed", "is_long", "genome_gc")


def refreshed(found: DataFrame) -> DataFrame:
    """With the counts and coordinates that follow from the present start."""
    nt = orfs.span(F.col("start"), F.col("end"))
    middle = F.array_join(F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.length(nt)), F.lit(3)), lambda i: F.substring(nt, i, F.lit(1))), "")
    out = found.withColumn("len", F.col("end") - F.col("start")).withColumn("n_gc", gc_count(nt))
    out = out.withColumn("n_g2", F.length(middle) - F.length(F.translate(middle, "Gg", ""))).withColumn("gc_cont", orfs.gc_content())
    low, size = F.when(F.col("strand") == 1, F.col("contig_len") - F.col("end")).otherwise(F.col("start")), F.col("contig_len")
    high = F.when(F.col("strand") == 1, size - F.col("start")).otherwise(F.col("end"))
    low = F.when(low < 0, low + size).otherwise(low) + 1
    return out.withColumn("rstart", low.cast("int")).withColumn("rend", F.when(high > size, high - size).otherwise(high).cast("int"))


def starts_by_counts(scored: DataFrame, options: Options = Options(), model: DataFrame | None = None) -> DataFrame:
    """With the start that each genome's own k-mer tables choose, and r_score; a stored model takes the tables' place."""
    if model is None:
        model = startmodel.refined_model(scored, options.minlen, options.table, options.rounds)
    return refreshed(startmodel.rescored(scored, model, options.minlen).drop("moved", "most"))


def starts_by_network(scored: DataFrame, network: networks.StartNetwork, options: Options = Options()) -> DataFrame:
    """With the start that the network chooses, and r_score: the first candidates are scored, the others if none is good enough.

    ORFs with an i_score below ``LEAST_SCORE`` aren't scored. All of an ORF's candidates are scored in the task that has it.
    """
    scored = networks.best_starts(scored, network, F.col("i_score") >= LEAST_SCORE)
    start, r = networks.revised_start(F.col("score"), F.col("best"), F.col("start"), F.col("edge_type"), F.col("end"), options.minlen)
    return refreshed(scored.withColumn("r_score", r).withColumn("start", start.cast("int")).drop("score", "best"))


def revised(scored: DataFrame, contigs: DataFrame, options: Options, network: networks.StartNetwork | None, start_model: DataFrame | None = None) -> DataFrame:
    """With starts chosen by the reviser of each genome; a stored start model takes the place of tables that would be trained."""
    kind = options.reviser
    none = lambda rows: rows.withColumn("r_score", F.when(F.col("edge_type") >= 5, 0.5).otherwise(0.0))
    by_network = (lambda rows: starts_by_network(rows, network, options)) if network else none
    if kind == "network" and not network:
        raise BadOption("the network reviser needs a network")
    if kind == "none":
        return none(scored)
    if kind == "network" or kind is None and options.meta:
        return by_network(scored)
    if kind == "counts":
        return starts_by_counts(scored, options, start_model)
    small = contigs.groupBy("genome_id").agg((F.sum(F.length("seq")) <= SMALL_GENOME).alias("is_small"))
    sized = models.kept(scored.join(models.bounded(models.kept(small)), "genome_id"))
    large = starts_by_counts(sized.filter("not is_small").drop("is_small"), options, start_model)
    return large.unionByName(by_network(sized.filter("is_small").drop("is_small")))


def refined_scores(scored: DataFrame, up: float = 0.5, down: float = 0.05, floor: float = 1e-5, c: float = 1.0, strict: bool = False, exact: bool = False) -> DataFrame:
    """With c_score from each genome's own classifier over features and r_score, trained on ORFs above ``up`` and from ``floor`` to ``down``.

    ORFs whose i_score is below the floor get a c_score of 0, without features. With ``strict`` a genome whose training rows
    are all of one label raises. An ``exact`` classifier takes all training rows, others a sample.
    """
    label = F.when(F.col("i_score") > up, 1).when((F.col("i_score") > floor) & (F.col("i_score") <= down), -1)
    likely = F.coalesce(F.col("i_score") >= floor, F.lit(False))
    wide = encoded(scored.filter(likely)).withColumn("features", F.concat("features", F.array(F.col("r_score").cast("double"))))
    rows = wide.select(*KEYS, "features", label.alias("label"))
    if exact:
        scores = kernel.scores(wide, kernel.train(rows, ["genome_id"], c, strict=strict), ["genome_id"])
    else:
        scores = models.svm_scores(wide, models.train_svm(rows, ["genome_id"], c, strict=strict), ["genome_id"])
    out = scores.withColumnRenamed("score", "c_score")
    return out.unionByName(scored.filter(~likely).withColumn("c_score", F.lit(0.0)))


def genes(scored: DataFrame, options: Options = Options()) -> DataFrame:
    """ORFs at or above the threshold, numbered by contig and end."""
    final = scored.withColumn("t_score", F.col("c_score") if options.meta else F.greatest("i_score", "c_score"))
    kept = models.kept(final.filter(F.col("t_score") >= options.threshold).withColumn("nt", orfs.span(F.col("start"), F.col("end"))).drop("ctx"))
    return ordered.numbered(kept, ["genome_id"], ["contig_id"], ["rend", "strand", "rstart"])


def coding_shares(contigs: DataFrame, coding: dict[int, models.Network], options: Options = Options(), complete_only: bool = False) -> DataFrame:
    """(genome_id, code, rank, share): the share of a genome's ORF bases that score above a half under each code.

    Contigs are scanned once for all codes, and an ORF that several have is scored once; only lagging G+C bins, which depend
    on a code's other ORFs, are found code by code.
    """
    found = orfs.find_orfs_by_code(contigs, CODES, options.minlen, TRIED_START, complete_only).withColumn("gc_cont", orfs.gc_content())
    if options.gc_bin == "lag":
        each = found.withColumn("code", F.explode("codes"))
        binned = ordered.lagging_bin(each, ["genome_id", "code"], "gc_cont", ["contig_id", "strand", "end"]).withColumn("codes", F.array("code")).drop("code")
    else:
        binned = found.withColumn("bin", gc_bin(F.col("gc_cont")))
    rows = features.encode(binned.select("genome_id", "len", "codes", "bin", "nt"))
    scored = models.mlp_scores(rows, coding, "bin").select("genome_id", "len", "score", F.explode("codes").alias("code"))
    share = F.sum(F.when(F.col("score") > 0.5, F.col("len")).otherwise(0)) / F.sum("len")
    rank = F.array_position(F.array(*map(F.lit, CODES)), F.col("code")) - 1
    return scored.groupBy("genome_id", "code").agg(share.alias("share")).select("genome_id", "code", rank.cast("int").alias("rank"), "share")


def chosen_codes(contigs: DataFrame, coding: dict[int, models.Network], options: Options = Options()) -> DataFrame:
    """(genome_id, code, share): the code with the largest share of coding bases, the first of equal ones."""
    return ordered.best_candidate(coding_shares(contigs, coding, options), ["genome_id"], "share", "rank").drop("rank")


def find_genes(contigs: DataFrame, options: Options = Options(), coding: dict[int, models.Network] | None = None, starts: networks.StartNetwork | None = None, unified: networks.UnifiedNetwork | None = None, start_model: DataFrame | None = None) -> DataFrame:
    """The whole plan; raises NothingFound where no contig has a reading frame.

    Scores come from ``coding`` networks or, without them, from clusters of the genome's own ORFs; then starts are chosen,
    and a genome's own classifier, or in metagenomes the ``unified`` network, gives the last score. With the table "auto"
    each genome has the code that fits it best, which takes networks. A stored ``start_model`` takes the place of trained ones.
    """
    if options.table == "auto":
        if not coding:
            raise BadOption("the table can't be chosen without networks")
        codes = models.kept(chosen_codes(contigs, coding, options))
        parts = []
        for code in sorted(r.code for r in codes.select("code").distinct().collect()):  # three codes at most
            mine = contigs.join(models.bounded(codes.filter(F.col("code") == code).select("genome_id")), "genome_id", "left_semi")
            parts.append(find_genes(mine, Options(**{**options.__dict__, "table": code}), coding, starts, unified, start_model))
        if not parts:
            raise NothingFound(f"no reading frame of {options.minlen} nt")
        out = parts[0]
        for other in parts[1:]:
            out = out.unionByName(other)
        return out
    found = candidates(contigs, options)
    first = models.kept(initial_scores(found, coding, options) if coding else seeded_scores(found, contigs, options))
    second = models.kept(revised(first, contigs, options, starts, start_model))
    if options.meta and unified:
        return genes(networks.unified_scores(encoded(second), unified), options)
    return genes(refined_scores(second, exact=options.classifier == "exact"), options)


def label_genes(contigs: DataFrame, options: Options = Options()) -> DataFrame:
    """The labelling plan: clusters, starts by counts, and a softer classifier on sure labels; every ORF is numbered.

    i_score becomes c_score less a half, so that its sign tells coding ORFs from others.
    """
    scored = models.kept(seeded_scores(candidates(contigs, options), contigs, options))
    scored = models.kept(starts_by_counts(scored, options))
    scored = refined_scores(scored, up=0.7, down=0.3, c=0.15, exact=options.classifier == "exact")
    scored = scored.withColumn("i_score", F.col("c_score") - 0.5).withColumn("t_score", F.col("c_score"))
    kept = models.kept(scored.withColumn("nt", orfs.span(F.col("start"), F.col("end"))).drop("ctx"))
    return ordered.numbered(kept, ["genome_id"], ["contig_id"], ["rend", "strand", "rstart"])


def filtered(found: DataFrame, min_len: int, min_score: float | None = None, closed: bool = False) -> DataFrame:
    """ORFs of a length or more, with an i_score above one, and with both ends, as asked for."""
    out = found.filter(F.col("len") >= min_len)
    out = out if min_score is None else out.filter(F.col("i_score") > min_score)
    return out.filter("edge_type = 0") if closed else out


def overlap_report(found: DataFrame, options: Options = Options()) -> DataFrame:
    """Overlapping pairs, two rows each in the order of the left gene: pair, side and the gene's columns."""
    pairs = intervals.overlap_pairs(found, options.min_overlap)
    sides = pairs.select("genome_id", F.concat_ws("-", "left", "right").alias("pair"), "olen", F.explode(F.array("left", "right")).alias("idx"))
    return sides.join(found, ["genome_id", "idx"])
