"""Change tracking: sessions, sealing, time travel, comparisons of states and three-way differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def sessions(rows: DataFrame, key: str, at: str, version: str, seal: str, gap_seconds: int = 1800) -> DataFrame:
    """(key, first_version, last_version, n_rows, started_at, ended_at, sealed_by) of runs of rows, by gaps and islands.

    A run ends where more than the gap passes, or where a seal (a row with ``seal`` true) lies between two rows. Seals are no rows of a run; sealed_by
    is the first seal at or after the run's last version. A null key is a key of its own. Rows are ordered by time and version.
    """
    order = Window.partitionBy(key).orderBy(at, version)
    rows = rows.withColumn("_seals", F.sum(F.when(F.col(seal), 1).otherwise(0)).over(order))
    rows = rows.withColumn("_next_seal", F.min(F.when(F.col(seal), F.col(version))).over(order.rowsBetween(0, Window.unboundedFollowing)))
    edits = rows.where(~F.col(seal))
    apart = F.unix_micros(at) - F.unix_micros(F.lag(at).over(order)) > gap_seconds * 1_000_000
    starts = F.when(apart.isNull() | apart | (F.lag("_seals").over(order) != F.col("_seals")), 1).otherwise(0)
    edits = edits.withColumn("_starts", starts).withColumn("_session", F.sum("_starts").over(order))
    return edits.groupBy(key, "_session").agg(F.min(version).alias("first_version"), F.max(version).alias("last_version"), F.count("*").alias("n_rows"), F.min(at).alias("started_at"), F.max(at).alias("ended_at"), F.min("_next_seal").alias("sealed_by")).drop("_session")


def state_at(changes: DataFrame, keys: list[str], version: str, at: int, gone: str) -> DataFrame:
    """The last change of each key up to a version, without keys whose last change removed them. One aggregate, so it combines before the shuffle."""
    others = [c for c in changes.columns if c not in keys and c != version]
    last = changes.where(F.col(version) <= at).groupBy(*keys).agg(F.max(F.struct(version, *others)).alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in others]).where(~F.col(gone)).drop(gone)


def states_at(changes: DataFrame, owner: str, keys: list[str], version: str, versions: DataFrame, gone: str) -> DataFrame:
    """As state_at() of each owner's keys at versions of its own: (owner, at, keys, ...) for each (owner, at) of ``versions``. A null owner is an owner."""
    others = [c for c in changes.columns if c not in keys and c not in (owner, version)]
    own = versions.select(F.col(owner).alias("_owner"), "at")
    past = changes.join(own, F.col(owner).eqNullSafe(F.col("_owner")) & (F.col(version) <= F.col("at")))
    last = past.groupBy(owner, "at", *keys).agg(F.max(F.struct(version, *others)).alias("_last"))
    return last.select(owner, "at", *keys, *[F.col(f"_last.{c}").alias(c) for c in others]).where(~F.col(gone)).drop(gone)


def compare_states(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, state): added, removed, modified or unchanged, by one full outer join; a null value is a value of its own."""
    old = before.select(*keys, F.col(value).alias("_old"), F.lit(True).alias("_was"))
    new = after.select(*keys, F.col(value).alias("_new"), F.lit(True).alias("_is"))
    state = F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("modified")
    return old.join(new, keys, "full").select(*keys, state.alias("state"))


def three_way(base: DataFrame, ours: DataFrame, theirs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, outcome) of a merge: what their side did to each key and whether it meets a change of ours.

    added: only theirs has it; deleted / delete_conflict: theirs lacks it and ours is as the base / changed it; modified / conflict: theirs changed it and ours is
    as the base / changed it otherwise; unchanged else. Keys that only ours has are unchanged.
    """
    side = lambda df, x: df.select(*keys, F.col(value).alias(f"_{x}"), F.lit(True).alias(f"_in_{x}"))
    rows = side(base, "b").join(side(ours, "o"), keys, "full").join(side(theirs, "t"), keys, "full")
    b, o, t = F.col("_b"), F.col("_o"), F.col("_t")
    in_b, in_o, in_t = (F.coalesce(F.col(f"_in_{x}"), F.lit(False)) for x in "bot")
    ours_changed = in_b & (~in_o | ~o.eqNullSafe(b))
    outcome = (
        F.when(in_t & ~in_b & ~in_o, "added").when(~in_t & ~in_b, "unchanged").when(~in_t & in_o & ours_changed, "delete_conflict").when(~in_t & in_o, "deleted").when(~in_t, "unchanged")
        .when(in_o & t.eqNullSafe(o), "unchanged").when(in_b & t.eqNullSafe(b), "unchanged").when(~in_b | ours_changed, "conflict").otherwise("modified")
    )
    return rows.select(*keys, outcome.alias("outcome"))
