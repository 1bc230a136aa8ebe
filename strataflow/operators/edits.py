"""Edits as row sets: what a merge, a checkpoint or a list of requirements leaves, computed from the tables as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def applied_changes(outcomes: DataFrame, ours: DataFrame, theirs: DataFrame, keys: list[str], versions: DataFrame) -> DataFrame:
    """(keys, op, old_text, new_text, new_version) of each change that a merge applies without conflict.

    outcomes: history.three_way(). modified takes their text and deleted ends the row; both write the next version of the row. added begins at version 1. Conflicts are left to the user and give no row.
    versions: (keys, base_version).
    """
    wanted = outcomes.where("outcome IN ('modified', 'deleted', 'added')")
    old = ours.select(*keys, F.col("text").alias("old_text"))
    new = theirs.select(*keys, F.col("text").alias("new_text"))
    rows = wanted.join(old, keys, "left").join(new, keys, "left").join(versions, keys, "left")
    return rows.select(*keys, F.col("outcome").alias("op"), "old_text", F.when(F.col("outcome") != "deleted", F.col("new_text")).alias("new_text"), F.when(F.col("outcome") == "added", 1).otherwise(F.coalesce("base_version", F.lit(1)) + 1).cast("int").alias("new_version"))


def bumped_versions(specs: DataFrame, applied: DataFrame, spec: str) -> DataFrame:
    """(spec, n_applied, content_version): the version rises by one where a change was applied, and only there."""
    counts = applied.groupBy(spec).agg(F.count("*").alias("_n"))
    rows = specs.join(counts, spec, "left")
    n = F.coalesce("_n", F.lit(0))
    return rows.select(spec, n.alias("n_applied"), (F.col("content_version") + F.when(n > 0, 1).otherwise(0)).alias("content_version"))


def checkpoints(specs: DataFrame, owner: str) -> DataFrame:
    """(owner, n_specs, content_versions): the version of each of an owner's specs, as a map, which is what a checkpoint keeps. A map has an entry a spec of the owner, as the checkpoint itself."""
    pairs = specs.groupBy(owner, "spec_id").agg(F.max("content_version").alias("v"))
    return pairs.groupBy(owner).agg(F.count("*").alias("n_specs"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("spec_id", "v")))).alias("content_versions"))


def numbered(rows: DataFrame, keys: list[str], order: list[str], start: int = 0) -> DataFrame:
    """The distinct rows with their position within the keys by the order."""
    return rows.distinct().withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1 + start)
