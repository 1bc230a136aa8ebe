"""Comparing many versions of a tree, and votes over observed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def comparison_matrix(rows: DataFrame, key: str, column: str, value: str) -> DataFrame:
    """One row per key: how many columns hold it, how many distinct values they have and its state (single, identical or differing).

    An N-way outer alignment is one aggregate by key, whatever the number of columns.
    """
    cells = rows.groupBy(key, column).agg(F.min(value).alias("_value"))
    found = cells.groupBy(key).agg(F.count("*").alias("n_present"), (F.countDistinct("_value") + F.max(F.when(F.col("_value").isNull(), 1).otherwise(0))).alias("n_values"))
    return found.withColumn("state", F.when(F.col("n_present") < 2, "single").when(F.col("n_values") > 1, "differing").otherwise("identical"))


def mode(rows: DataFrame, key: str, value: str, first: str) -> DataFrame:
    """The most frequent value of each key; of equally frequent ones the one seen first. Counted by key and value, so no group is collected."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"), F.min(first).alias("_seen"))
    best = counts.groupBy(key).agg(F.max(F.struct("n", (-F.col("_seen")).alias("s"), F.col(value).alias("v"))).alias("b"), F.sum("n").alias("n_votes"))
    return best.select(key, F.col("b.v").alias("mode"), F.col("b.n").alias("n_mode"), "n_votes")


def lower_median(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The element at index floor((n - 1) / 2) of each key's sorted values, found by rank over counts of distinct values."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(key).orderBy(value)
    ranked = counts.select(key, value, F.sum("n").over(order).alias("_upto"), F.sum("n").over(Window.partitionBy(key)).alias("_all"))
    return ranked.where(F.col("_upto") > F.floor((F.col("_all") - 1) / 2)).groupBy(key).agg(F.min(value).alias("lower_median"))


def winner(rows: DataFrame, key: str, value: str, first: str) -> DataFrame:
    """The value that a template takes: the mode with a strict majority, else the lower median."""
    both = mode(rows, key, value, first).join(lower_median(rows, key, value), key)
    majority = F.col("n_mode") * 2 > F.col("n_votes")
    return both.select(key, "mode", "lower_median", F.when(majority, F.col("mode")).otherwise(F.col("lower_median")).alias("winner"), F.when(majority, "majority").otherwise("median").alias("rule"))


def jaccard(left: Column, right: Column) -> Column:
    """Similarity of two arrays as sets, to two places; null where both are empty."""
    return F.round(F.size(F.array_intersect(left, right)) / F.nullif(F.size(F.array_union(left, right)), F.lit(0)), 2)


def hierarchy_confidence(used: Column, agreed: Column, conflicts: Column, level: Column) -> Column:
    """Confidence of a paragraph's place: the reliability of the signal that won, raised by each that agrees, lowered by each conflict and its distance, within 0 and 1.

    used: a signal's number; agreed: array of numbers; conflicts: array of reported levels. Null where no signal was used.
    """
    # Reliability of the signals 1 to 5.
    tiers = F.array(*map(F.lit, (0.95, 0.85, 0.6, 0.6, 0.35)))
    bonus = F.aggregate(agreed, F.lit(0.0), lambda total, s: total + F.get(tiers, s - 1) * 0.15)
    penalty = F.aggregate(conflicts, F.lit(0.0), lambda total, x: total + 0.10 + F.abs(x - level) * 0.02)
    return F.when(used.isNotNull(), F.round(F.least(F.greatest(F.get(tiers, used - 1) + bonus - penalty, F.lit(0.0)), F.lit(1.0)), 6))
