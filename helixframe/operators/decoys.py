"""Decoy genes of an accession: random reading frames with its own codon usage, put into the gaps between its frames.

An accession's contigs lie one behind the other on one axis, by running sums of their lengths, and are scanned as the chunks
of one sequence. Lengths and codons are drawn by weight, gaps are chosen and split in rounds, and every random number is a
digest of the seed, the accession and what it is for, so a rerun gives the same decoys. Sequences are read where they lie;
what moves are places, counts and the decoys themselves.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import sequence as S
from helixframe.functions.alphabet import STARTS, stop_codons
from helixframe.operators import chunks, intervals, ordered
from helixframe.operators.models import bounded, kept
from helixframe.operators.orfs import _COMPLEMENT

#: Share of the frames that decoys amount to, and the least and most decoys; odds of the start codons; length draws.
SHARE, LEAST, MOST = 0.05, 20, 200
START_ODDS = [0.80, 0.15, 0.05]
DRAWS = 5
#: Width of the stretches of the axis by which frames meet contigs.
BIN = 1 << 14
#: The number of a letter, so low for any but A, C, G and T that its codons have none; codons by number.
_LETTERS = np.full(256, -1000, np.int64)
_LETTERS[[ord(c) for c in "ACGT"]] = range(4)
_CODONS = [a + b + c for a in "ACGT" for b in "ACGT" for c in "ACGT"]


@dataclass
class Decoys:
    """manifest: a row an accession; decoys: a row each; contigs: with the decoys in place of their bases."""

    manifest: DataFrame
    decoys: DataFrame
    contigs: DataFrame


def on_axis(contigs: DataFrame) -> DataFrame:
    """(genome_id, record_id, n_records, and the columns of chunks.CHUNK) of contigs (genome_id, contig_id, seq), in upper case.

    A genome's contigs that have a base lie behind each other in the order of contig_id, of which each has its own.
    """
    some = contigs.select("genome_id", F.col("contig_id").cast("long").alias("record_id"), F.upper("seq").alias("bases"))
    # a filter does not go below a number that depends on the task, where it would have Spark make seq once more
    some = some.withColumn("size", F.length("bases")).withColumn("_task", F.spark_partition_id()).filter((F.col("size") > 0) & (F.col("_task") >= 0)).drop("_task")
    short = some.select("genome_id", "record_id", "size", F.substring("bases", 1, 2).alias("head"), F.expr("right(bases, 2)").alias("tail"))
    along, genome = Window.partitionBy("genome_id").orderBy("record_id"), Window.partitionBy("genome_id")
    beside = lambda name, step: F.coalesce(F.lag(name, step).over(along), F.lit(""))
    places = short.select(
        "genome_id", "record_id",
        (F.sum("size").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).cast("int").alias("at"),
        F.sum("size").over(genome).cast("int").alias("contig_len"), F.count("*").over(genome).alias("n_records"),
        F.concat(beside("tail", 2), beside("tail", 1)).alias("before"), F.concat(beside("head", -1), beside("head", -2)).alias("after"),
    )
    rows = some.join(bounded(kept(places)), ["genome_id", "record_id"])
    return rows.select("genome_id", "record_id", "n_records", F.lit(0).cast("long").alias("contig_id"), F.col("genome_id").alias("name"), F.lit(False).alias("circ"), "contig_len", "at", F.expr("right(before, 2)").alias("before"), "bases", F.substring("after", 1, 2).alias("after"))


def by_record(records: DataFrame, spans: DataFrame, columns: list[str]) -> DataFrame:
    """(genome_id, at, spans array<struct<columns>>): the spans (genome_id, lo, hi) of the axis that each record meets."""
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(lo / BIN), F.floor((hi - 1) / BIN)))
    end = F.col("at") + F.length("bases")
    a = records.select("genome_id", "at", end.alias("end")).withColumn("bin", bins(F.col("at"), F.col("end")))
    b = spans.withColumn("bin", bins(F.col("lo"), F.col("hi")))
    first = F.greatest(F.floor(F.col("at") / BIN), F.floor(F.col("lo") / BIN))
    met = a.join(b, ["genome_id", "bin"]).filter((F.col("lo") < F.col("end")) & (F.col("at") < F.col("hi")) & (F.col("bin") == first))
    return met.groupBy("genome_id", "at").agg(F.collect_list(F.struct(*columns)).alias("spans"))


def codon_usage(records: DataFrame, found: DataFrame, table: str = "11") -> DataFrame:
    """(genome_id, codon, is_stop, n) over the frames found: sense codons of known bases, and the codons that end a frame.

    A codon counts in the record that has its first base along the strand.
    """
    stops = set(stop_codons(table))

    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends: Counter = Counter()
            sense: dict[str, np.ndarray] = {}
            for i in range(len(b)):
                genome, at, before, bases, after, spans = (b.column(c)[i].as_py() for c in ("genome_id", "at", "before", "bases", "after", "spans"))
                own = len(bases)
                forward, backward = bases + after, (before + bases)[::-1].translate(_COMPLEMENT)
                for strand, text in enumerate((forward, backward)):
                    # along the strand: the record's first base, and the frame's first and last, from there
                    places = [(s["lo"] - at, s["hi"] - at) if not strand else (at + own - s["hi"], at + own - s["lo"]) for s in spans if s["strand"] == strand]
                    if not places:
                        continue
                    code = _LETTERS[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]
                    number = np.append(16 * code[:-2] + 4 * code[1:-1] + code[2:], [-1, -1])
                    each = []
                    for first, last in places:
                        each.append(number[first if first >= 0 else first % 3 : min(last - 3, own) : 3])
                        if 0 <= last - 3 < own:
                            ends[genome, text[last - 3 : last]] += 1
                    n = np.concatenate(each)
                    sense[genome] = sense.get(genome, 0) + np.bincount(n[n >= 0], minlength=64)
            rows = [(g, c, True, n) for (g, c), n in ends.items()]
            rows += [(g, _CODONS[k], False, int(counts[k])) for g, counts in sense.items() for k in np.nonzero(counts)[0].tolist() if _CODONS[k] not in stops]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.bool_(), pa.int64()), strict=True)], names=["genome_id", "codon", "is_stop", "n"])

    spans = by_record(records, found.select("genome_id", "strand", (F.col("rstart") - 1).alias("lo"), F.col("rend").alias("hi")), ["strand", "lo", "hi"])
    parts = records.join(spans, ["genome_id", "at"]).select("genome_id", "at", "before", "bases", "after", "spans").mapInArrow(function, "genome_id string, codon string, is_stop boolean, n long")
    return parts.groupBy("genome_id", "codon", "is_stop").agg(F.sum("n").alias("n"))


def targets(records: DataFrame, found: DataFrame, free: DataFrame) -> DataFrame:
    """(genome_id, n_records, merged_len, n_orfs, capacity, largest, n_target): a share of the frames, within bounds and what fits.

    A genome without a frame, whose lengths could be drawn, gets no decoy.
    """
    genomes = records.groupBy("genome_id").agg(F.first("n_records").alias("n_records"), F.first("contig_len").cast("long").alias("merged_len"))
    n = found.groupBy("genome_id").agg(F.count("*").alias("n_orfs"))
    out = genomes.join(n, "genome_id", "left").join(intervals.capacity(free, ["genome_id"]), "genome_id", "left").na.fill(0, ["n_orfs", "capacity", "largest"])
    wanted = F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.bround(F.lit(SHARE) * F.col("n_orfs"), 0).cast("long")))
    return out.withColumn("n_target", F.when(F.col("n_orfs") > 0, F.least(wanted, F.col("capacity"))).otherwise(0).cast("long"))


def drawn_lengths(found: DataFrame, wanted: DataFrame, seed: int) -> DataFrame:
    """(genome_id, i, len): lengths of frames of the genome, drawn anew up to ``DRAWS`` times while no gap is long enough."""
    each = wanted.filter("n_target > 0").select("genome_id", "largest", F.explode(F.sequence(F.lit(1), F.col("n_target"))).alias("i"))
    tries = each.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(DRAWS)))).withColumn("u", ordered.uniform(seed, F.lit("length"), "genome_id", "i", "k"))
    lengths = found.groupBy("genome_id", "len").agg(F.count("*").alias("n"))
    drawn = ordered.weighted_draws(tries, lengths, ["genome_id"], "len", "n")
    return drawn.groupBy("genome_id", "i").agg(F.coalesce(F.expr("min_by(len, k) FILTER (WHERE len <= largest)"), F.expr("max_by(len, k)")).alias("len"))


def placed(lengths: DataFrame, free: DataFrame, seed: int) -> DataFrame:
    """(genome_id, i, start, end) of the decoys that find room in the free stretches (genome_id, lo, hi).

    In each round every decoy chooses among the stretches that can hold it, each as likely; the longest that chose a stretch
    gets it, at any place in it, each as likely, and what is left on either side is free again if it is long enough. Decoys
    that no stretch can hold are left out. Every round places at least one decoy of a genome that still has one.
    """
    out, turn = None, 0
    decoys, free = kept(lengths), kept(free.select("genome_id", "lo", "hi"))
    while not decoys.isEmpty():
        turn += 1
        both = free.select("genome_id", (F.col("hi") - F.col("lo")).alias("width"), F.lit(0).alias("kind"), "lo", "hi", F.lit(None).cast("long").alias("i"))
        both = both.unionByName(decoys.select("genome_id", F.col("len").alias("width"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"), F.col("i").cast("long").alias("i")))
        widest = Window.partitionBy("genome_id").orderBy(F.desc("width"), "kind", "lo", "i").rowsBetween(Window.unboundedPreceding, 0)
        ranked = both.withColumn("rank", F.sum(1 - F.col("kind")).over(widest))  # of a stretch, and how many can hold a decoy
        choosing = ranked.filter("kind = 1 and rank > 0").select("genome_id", "i", F.col("width").alias("len"), (F.floor(ordered.uniform(seed, F.lit("gap"), "genome_id", "i", F.lit(turn)) * F.col("rank")) + 1).alias("rank"))
        chosen = choosing.join(ranked.filter("kind = 0").select("genome_id", "rank", "lo", "hi"), ["genome_id", "rank"])
        best = chosen.groupBy("genome_id", "lo", "hi").agg(F.max(F.struct("len", (-F.col("i")).alias("i"))).alias("x")).select("genome_id", "lo", "hi", (-F.col("x.i")).alias("i"), F.col("x.len").alias("len"))
        room = F.col("hi") - F.col("lo") - F.col("len") + 1
        start = (F.col("lo") + F.floor(ordered.uniform(seed, F.lit("place"), "genome_id", "i", F.lit(turn)) * room)).cast("int")
        new = kept(best.withColumn("start", start).withColumn("end", (F.col("start") + F.col("len")).cast("int")))
        sides = F.array(F.struct(F.col("lo").alias("lo"), F.col("start").alias("hi")), F.struct(F.col("end").alias("lo"), F.col("hi").alias("hi")))
        rest = new.select("genome_id", F.explode(sides).alias("x")).select("genome_id", "x.lo", "x.hi").filter(F.col("hi") - F.col("lo") >= intervals.SHORTEST)
        free = kept(free.join(new.select("genome_id", "lo", "hi"), ["genome_id", "lo", "hi"], "left_anti").unionByName(rest))
        decoys = kept(choosing.select("genome_id", "i", "len").join(new.select("genome_id", "i"), ["genome_id", "i"], "left_anti"))
        new = new.select("genome_id", "i", "start", "end")
        out = new if out is None else out.unionByName(new)
    return lengths.sparkSession.createDataFrame([], "genome_id string, i long, start int, end int") if out is None else out


def synthesised(places: DataFrame, usage: DataFrame, seed: int, table: str = "11") -> DataFrame:
    """(genome_id, i, start, end, strand, nt, valid): a start codon by fixed odds, sense codons and a stop by the genome's usage.

    valid: it begins with a start codon, ends with a stop, has none before, and is as long as its place.
    """
    stops = stop_codons(table)
    n = ((F.col("end") - F.col("start")) / 3).cast("int")
    slots = places.select("genome_id", "i", "start", "end", n.alias("n_codons")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n_codons") - 1)))
    slots = slots.withColumn("u", ordered.uniform(seed, F.lit("codon"), "genome_id", "i", "k"))
    a, b = START_ODDS[0], START_ODDS[0] + START_ODDS[1]
    first = slots.filter("k = 0").withColumn("codon", F.when(F.col("u") < a, STARTS[0]).when(F.col("u") < b, STARTS[1]).otherwise(STARTS[2]))
    body = ordered.weighted_draws(slots.filter("k > 0 and k < n_codons - 1"), usage.filter("not is_stop").drop("is_stop"), ["genome_id"], "codon", "n")
    last = ordered.weighted_draws(slots.filter("k = n_codons - 1"), usage.filter("is_stop").drop("is_stop"), ["genome_id"], "codon", "n")
    names = ["genome_id", "i", "start", "end", "k", "codon"]
    every = first.select(*names).unionByName(body.select(*names)).unionByName(last.select(*names))
    made = every.groupBy("genome_id", "i", "start", "end").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "codon"))), lambda x: x.codon), "").alias("nt"))
    codons = S.codons(F.col("nt"))
    inner = F.slice(codons, 2, F.greatest(F.lit(0), F.size(codons) - 2))
    valid = F.substring("nt", 1, 3).isin(*STARTS) & F.expr("right(nt, 3)").isin(*stops) & ~F.exists(inner, lambda c: c.isin(*stops)) & (F.length("nt") == F.col("end") - F.col("start"))
    strand = F.when(ordered.uniform(seed, F.lit("strand"), "genome_id", "i") < 0.5, "+").otherwise("-")
    return made.withColumn("strand", strand).withColumn("valid", valid)


def spliced(records: DataFrame, decoys: DataFrame) -> DataFrame:
    """(genome_id, contig_id, seq) with the decoys in place of the bases there, whose number stays the same."""
    forward: Column = F.when(F.col("strand") == "-", S.reverse_complement(F.col("nt"))).otherwise(F.col("nt"))
    spans = by_record(records, decoys.select("genome_id", F.col("start").alias("lo"), F.col("end").alias("hi"), forward.alias("nt")), ["lo", "hi", "nt"])

    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for i in range(len(b)):
                at, bases, spans = (b.column(c)[i].as_py() for c in ("at", "bases", "spans"))
                out, upto = [], 0
                for s in sorted(spans or (), key=lambda s: s["lo"]):
                    lo, hi = max(0, s["lo"] - at), min(len(bases), s["hi"] - at)
                    out += [bases[upto:lo], s["nt"][lo + at - s["lo"] : hi + at - s["lo"]]]
                    upto = hi
                texts.append("".join([*out, bases[upto:]]))
            yield pa.RecordBatch.from_arrays([b.column("genome_id"), b.column("record_id"), pa.array(texts, pa.string())], names=["genome_id", "contig_id", "seq"])

    met = records.join(spans, ["genome_id", "at"], "left")
    return met.select("genome_id", "record_id", "at", "bases", "spans").mapInArrow(function, "genome_id string, contig_id long, seq string")


def insert_decoys(contigs: DataFrame, seed: int = 42, table: str = "11") -> Decoys:
    """Decoys for every accession (genome_id) of contigs (genome_id, contig_id, seq).

    Contigs without a base have no part in it; a genome's contigs have different contig_ids.
    """
    records = on_axis(contigs)
    found = kept(chunks.find_orfs_in_chunks(records, intervals.SHORTEST, table, complete_only=True, only=tuple(STARTS)).select("genome_id", "strand", "rstart", "rend", "len"))
    lengths = records.select("genome_id", F.col("contig_len").alias("len")).distinct()
    free = kept(intervals.gaps(found.select("genome_id", (F.col("rstart") - 1).alias("start"), F.col("rend").alias("end")), lengths, ["genome_id"]))
    wanted = kept(targets(records, found, free))
    usage = kept(codon_usage(records, found, table))
    places = kept(placed(drawn_lengths(found, wanted, seed), free, seed))
    decoys = kept(synthesised(places, usage, seed, table))
    counts = decoys.groupBy("genome_id").agg(F.count("*").alias("n_inserted"), F.min("valid").alias("valid"))
    manifest = wanted.drop("largest").join(counts, "genome_id", "left").withColumn("n_inserted", F.coalesce("n_inserted", F.lit(0))).withColumn("valid", F.coalesce("valid", F.lit(True)))
    message = F.when(F.col("n_orfs") == 0, "no reading frame").when(F.col("n_inserted") < F.col("n_target"), F.concat(F.lit("placed "), F.col("n_inserted").cast("string"), F.lit(" of "), F.col("n_target").cast("string")))
    return Decoys(manifest.withColumn("transl_table", F.lit(table)).withColumn("message", F.coalesce(message, F.lit(""))), decoys, spliced(records, decoys))
