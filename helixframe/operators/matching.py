"""Evaluation of predicted features against annotated ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.models import kept


def ends(features: DataFrame) -> DataFrame:
    """With the 5' and 3' coordinates."""
    plus = F.col("strand") == "+"
    return features.withColumn("five", F.when(plus, F.col("start")).otherwise(F.col("end"))).withColumn("three", F.when(plus, F.col("end")).otherwise(F.col("start")))


def candidate_matches(predicted: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, p, t): numbers of features of a host and strand that share an end, by two equi-joins instead of an OR."""
    p, t = ends(predicted), ends(truth)
    sides = []
    for end in ("five", "three"):
        a = p.select(*keys, "strand", F.col(end).alias("at"), F.col("ord").alias("p"))
        b = t.select(*keys, "strand", F.col(end).alias("at"), F.col("ord").alias("t"))
        sides.append(a.join(b, [*keys, "strand", "at"]).select(*keys, "p", "t"))
    return sides[0].unionByName(sides[1]).distinct()


def matched_predictions(predicted: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Predictions that share an end with some annotated feature: an upper bound of the greedy count."""
    return predicted.join(candidate_matches(predicted, truth, keys).select(*keys, F.col("p").alias("ord")).distinct(), [*keys, "ord"], "left_semi")


def greedy_matches(predicted: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, p, t): predictions in their order each take the first annotated feature that is still free.

    A pair is settled as soon as it is the first one left both of its prediction and of its annotated feature: no earlier
    prediction can take that feature any more. Each round settles all such pairs and leaves out what they use; the first
    pair left is always one of them. No group of a host is gathered, and rounds go on as long as pairs depend on each other.
    """
    left, settled = kept(candidate_matches(predicted, truth, keys)), None
    while not left.isEmpty():
        of_p, of_t = Window.partitionBy(*keys, "p"), Window.partitionBy(*keys, "t")
        first = left.withColumn("_t", F.min("t").over(of_p)).withColumn("_p", F.min("p").over(of_t))
        new = kept(first.filter((F.col("t") == F.col("_t")) & (F.col("p") == F.col("_p"))).drop("_t", "_p"))
        left = kept(left.join(new.select(*keys, "p"), [*keys, "p"], "left_anti").join(new.select(*keys, "t"), [*keys, "t"], "left_anti"))
        settled = new if settled is None else settled.unionByName(new)
    return left if settled is None else settled


def report(predicted: DataFrame, truth: DataFrame, matches: DataFrame, assembly: str = "assembly", controls: DataFrame | None = None, false_matches: DataFrame | None = None) -> DataFrame:
    """(assembly, pred, true, true_pos); an assembly without annotation has zeros.

    With controls, features that were predicted not to be coding, and their own matches, also neg and false_neg.
    """
    n = lambda df, name: df.groupBy(assembly).agg(F.count("*").alias(name))
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    out = n(predicted, "pred").join(n(truth, "true"), assembly, "left").join(n(matches, "true_pos"), assembly, "left")
    if controls is None:
        return out.select(assembly, "pred", zero("true"), zero("true_pos"))
    both = predicted.select(assembly).unionByName(controls.select(assembly)).distinct()
    out = both.join(n(predicted, "pred"), assembly, "left").join(n(truth, "true"), assembly, "left").join(n(matches, "true_pos"), assembly, "left")
    out = out.join(n(controls, "neg"), assembly, "left").join(n(false_matches, "false_neg"), assembly, "left")
    return out.select(assembly, *map(zero, ("pred", "true", "true_pos", "neg", "false_neg")))


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: counts, accuracy, precision, recall and F1 of two 0/1 columns; null where a ratio has no base."""
    count = lambda t, p: F.sum(F.when((F.col(truth) == t) & (F.col(predicted) == p), 1).otherwise(0)).alias(f"{'t' if t == p else 'f'}{'p' if p else 'n'}")
    c = rows.agg(count(1, 1), count(0, 1), count(1, 0), count(0, 0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.when(b > 0, a / b)
    return c.select(
        "tp", "fp", "fn", "tn",
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )
