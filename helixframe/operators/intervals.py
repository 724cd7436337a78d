"""Interval operators: overlaps of genes, merged cover and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the bins that intervals are joined by.
BIN = 4096
SHORTEST = 90
MARGIN = 20


def unwrapped(genes: DataFrame) -> DataFrame:
    """With lo and hi, where a gene across the origin of a circular contig (of length ``contig_len``) starts below 1."""
    return genes.withColumn("lo", F.when(F.col("rstart") > F.col("rend"), F.col("rstart") - F.col("contig_len")).otherwise(F.col("rstart"))).withColumn("hi", F.col("rend"))


def overlap_length(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    """hi - lo of the common part of inclusive coordinates, one less than its bases; 0 if it is empty."""
    return F.when((a_hi > b_lo) & (b_hi > a_lo), F.least(a_hi, b_hi) - F.greatest(a_lo, b_lo)).otherwise(0)


def overlap_pairs(genes: DataFrame, min_olen: int = 120, keys: tuple[str, ...] = ("genome_id", "contig_id"), order: str = "idx") -> DataFrame:
    """(keys, left, right, olen) of genes of a contig, left before right in ``order``, that overlap by ``min_olen`` or more.

    Genes are dealt to the bins they touch and joined by contig and bin; a pair counts in the first bin that both touch.
    Work is in proportion to the genes times those that share a bin with them.
    """
    placed = unwrapped(genes).withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / BIN), F.floor(F.col("hi") / BIN))))
    a = placed.select(*keys, "bin", F.col(order).alias("left"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"))
    b = placed.select(*keys, "bin", F.col(order).alias("right"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    olen = overlap_length(F.col("a_lo"), F.col("a_hi"), F.col("b_lo"), F.col("b_hi"))
    first = F.greatest(F.floor(F.col("a_lo") / BIN), F.floor(F.col("b_lo") / BIN))
    pairs = a.join(b, [*keys, "bin"]).filter((F.col("left") < F.col("right")) & (F.col("bin") == first))
    return pairs.select(*keys, "left", "right", olen.alias("olen")).filter((F.col("olen") >= min_olen) & (F.col("olen") > 0))


def without_overlaps(genes: DataFrame, most: int = 75, keys: tuple[str, ...] = ("genome_id", "contig_id"), order: str = "idx") -> DataFrame:
    """Genes that overlap no other by more than ``most``; of an overlapping pair both go."""
    pairs = overlap_pairs(genes, most + 1, keys, order)
    hit = pairs.select(*keys, F.explode(F.array("left", "right")).alias(order)).distinct()
    return genes.join(hit, [*keys, order], "left_anti")


def merged(intervals: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(keys, start, end) of the union; intervals that touch are one."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col(start) <= before, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return intervals.withColumn("_island", island).groupBy(*keys, "_island").agg(F.min(start).alias("start"), F.max(end).alias("end")).drop("_island")


def gaps(intervals: DataFrame, lengths: DataFrame, keys: list[str], margin: int = MARGIN, shortest: int = SHORTEST) -> DataFrame:
    """(keys, lo, hi) of free stretches of ``shortest`` or more after a margin on either side.

    lengths: (keys, len) of every sequence, also of those without an interval.
    """
    ends = merged(intervals, keys).unionByName(lengths.select(*keys, F.col("len").alias("start"), F.col("len").alias("end")))
    before = F.lag("end", 1, 0).over(Window.partitionBy(*keys).orderBy("start", "end"))
    free = ends.select(*keys, (before + margin).alias("lo"), (F.col("start") - margin).alias("hi"))
    return free.filter(F.col("hi") - F.col("lo") >= shortest)


def capacity(free: DataFrame, keys: list[str], size: int = SHORTEST) -> DataFrame:
    """(keys, capacity, largest): how many stretches of ``size`` fit, and the longest gap."""
    width = F.col("hi") - F.col("lo")
    return free.groupBy(*keys).agg(F.sum(F.floor(width / size)).cast("long").alias("capacity"), F.max(width).alias("largest"))
