"""Operators that depend on an order: numbering, lagging bins, choices among candidates, carrying values on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(genes: DataFrame, group: list[str], part: list[str], order: list[str], name: str = "idx") -> DataFrame:
    """Numbers from 0 within a group, by part and then order.

    Rows are numbered within their part and shifted by the sizes of the parts before, so no task holds a whole group.
    """
    within = Window.partitionBy(*group, *part).orderBy(*order)
    sizes = genes.groupBy(*group, *part).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*group).orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0))).drop("_n")
    return genes.withColumn("_at", F.row_number().over(within) - 1).join(offsets, [*group, *part]).withColumn(name, (F.col("_before") + F.col("_at")).cast("long")).drop("_at", "_before")


def thresholds_below(gc: Column) -> Column:
    """How many of 0.20, 0.21, ... 0.79 are below a G+C fraction."""
    return F.greatest(F.lit(0), F.least(F.lit(60), F.ceil(F.round((gc - 0.2) * 100, 9)).cast("int")))


def lagging_bin(orfs: DataFrame, by: list[str], gc: str, ties: list[str]) -> DataFrame:
    """With ``bin``: over ORFs sorted by G+C the bin rises by one at most from an ORF to the next.

    bin = i + min(1, least (wanted - k) over the ORFs k up to i), both counted from 0. ORFs are sorted within thousandths of
    G+C; a row for each of these carries counts and least values on, so that no task holds a whole group.
    """
    part = F.floor(F.col(gc) * 1000).cast("int")
    order = Window.partitionBy(*by, "_part").orderBy(gc, *ties)
    rows = orfs.withColumn("_part", part).withColumn("_at", F.row_number().over(order) - 1)
    rows = rows.withColumn("_slack", thresholds_below(F.col(gc)) - F.col("_at"))
    rows = rows.withColumn("_low", F.min("_slack").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = orfs.groupBy(*by, part.alias("_part")).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    lows = rows.groupBy(*by, "_part").agg(F.min("_slack").alias("_least")).join(parts, [*by, "_part"])
    lows = lows.withColumn("_lower", F.min(F.col("_least") - F.col("_before")).over(upto)).select(*by, "_part", "_before", "_lower")
    low = F.least(F.lit(1), F.col("_low") - F.col("_before"), F.col("_lower"))  # nulls don't count
    return rows.join(lows, [*by, "_part"]).withColumn("bin", (F.col("_before") + F.col("_at") + low).cast("int")).drop("_part", "_at", "_slack", "_low", "_before", "_lower")


def best_candidate(candidates: DataFrame, keys: list[str], score: str, position: str) -> DataFrame:
    """The candidate with the highest score of each key, the first of equal ones; without a sort."""
    best = F.max_by(F.struct(*[c for c in candidates.columns if c not in keys]), F.struct(F.col(score), -F.col(position)))
    return candidates.groupBy(*keys).agg(best.alias("_x")).select(*keys, "_x.*")


def early_exit(candidates: DataFrame, keys: list[str], score: str, position: str, first: int = 5, enough: float = 0.6) -> DataFrame:
    """The best of the first candidates; keys whose best is below ``enough`` have all theirs compared."""
    inside = F.col(position) < first
    top = candidates.groupBy(*keys).agg(
        F.max_by(position, F.when(inside, F.struct(F.col(score), -F.col(position)))).alias("_first"),
        F.max(F.when(inside, F.col(score))).alias("_first_score"),
        F.max_by(position, F.struct(F.col(score), -F.col(position))).alias("_all"),
        F.max(score).alias("_all_score"),
    )
    stop = F.col("_first_score") >= enough
    return top.select(*keys, F.when(stop, F.col("_first")).otherwise(F.col("_all")).alias(position), F.when(stop, F.col("_first_score")).otherwise(F.col("_all_score")).alias(score), (~stop).alias("tail_scored"))


def fill_forward(rows: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """The last value at or before a row that isn't null."""
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(upto))


def weighted_ranges(weights: DataFrame, by: list[str], order: str, weight: str) -> DataFrame:
    """(lo, hi) of each row: its part of the running total, for sampling by a uniform number."""
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(weight).over(Window.partitionBy(*by))
    hi = F.sum(weight).over(upto)
    return weights.withColumn("lo", (hi - F.col(weight)) / total).withColumn("hi", hi / total)


def uniform(seed: int, *columns: Column | str) -> Column:
    """A number from 0 up to 1 that follows from a seed and the columns: 52 bits of a digest of their texts."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / 2.0**52


def weighted_draws(draws: DataFrame, weights: DataFrame, by: list[str], order: str, weight: str, u: str = "u") -> DataFrame:
    """The draws with the columns of the row of their group that their number ``u`` falls on, each row as likely as its weight.

    A group's weights are put in a row by ``order``; the row is cut into as many equal buckets as the group has weights, and
    a draw meets the weights of its bucket alone. So no draw is compared with all of a group, and on average with two.
    Rows without a positive weight are never drawn; draws of a group without weights are left out.
    """
    some = weights.filter(F.col(weight) > 0)
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ranges = some.withColumn("_hi", F.sum(weight).over(upto)).withColumn("_lo", F.col("_hi") - F.col(weight))
    totals = some.groupBy(*by).agg(F.sum(weight).alias("_total"), F.count("*").alias("_n"))
    bucket = lambda x: F.least(F.floor(x / F.col("_total") * F.col("_n")), F.col("_n") - 1)
    ranges = ranges.join(totals, by).withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_lo")), bucket(F.col("_hi"))))).drop("_total", "_n")
    placed = draws.join(totals, by).withColumn("_at", F.col(u) * F.col("_total")).withColumn("_bucket", bucket(F.col("_at"))).drop("_total", "_n")
    met = placed.join(ranges, [*by, "_bucket"]).filter((F.col("_lo") <= F.col("_at")) & (F.col("_at") < F.col("_hi")))
    return met.drop("_bucket", "_at", "_lo", "_hi")


def first_per(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key, the first in the order."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_x")).select(*keys, "_x.*")


def modal(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """(keys, value, n): the most frequent value, of equally frequent ones the one seen first."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    best = F.max_by(F.struct(value, "n"), F.struct("n", -F.col("_first")))
    return counts.groupBy(*keys).agg(best.alias("_x")).select(*keys, "_x.*")


def limited(rows: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """The first rows of each key in an order, ``most`` at most."""
    return rows.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_at") <= most).drop("_at")
