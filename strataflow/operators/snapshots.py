"""What changed between successive full snapshots, by gaps and islands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def snapshot_intervals(snapshots: DataFrame) -> DataFrame:
    """Validity intervals: (spec_id, uuid, from_no, to_no, prior_no, next_no, follows, goes_on) of each unchanged run of a uuid.

    prior_no and next_no are the spec's snapshots just before and after the interval (null where there is none); follows
    and goes_on say whether another interval of the uuid is adjacent. Where a uuid has several rows in one snapshot the latest
    delivered_at holds, of equal ones the greater text. Ids compare in lower case. Rows without spec_id, snapshot_no or
    uuid belong to no snapshot and are left out; a null text is a value of its own. An empty table gives no rows.
    """
    rows = snapshots.where("spec_id IS NOT NULL AND snapshot_no IS NOT NULL AND uuid IS NOT NULL").select(
        F.lower("spec_id").alias("spec_id"),
        "snapshot_no",
        F.lower("uuid").alias("uuid"),
        F.struct(F.col("delivered_at"), F.when(F.col("text").isNotNull(), F.unhex(F.md5("text"))).alias("row_hash")).alias("version"),
    )
    rows = rows.groupBy("spec_id", "uuid", "snapshot_no").agg(F.max("version").getField("row_hash").alias("row_hash"))
    # The spec's snapshot numbers are one small row each, however many uuids a snapshot holds.
    per_spec = Window.partitionBy("spec_id").orderBy("snapshot_no")
    numbers = snapshots.where("uuid IS NOT NULL").select(F.lower("spec_id").alias("spec_id"), "snapshot_no").where("spec_id IS NOT NULL AND snapshot_no IS NOT NULL").distinct()
    numbers = numbers.select("spec_id", "snapshot_no", F.lag("snapshot_no").over(per_spec).alias("prior_no"), F.lead("snapshot_no").over(per_spec).alias("next_no"))
    rows = rows.join(numbers, ["spec_id", "snapshot_no"])
    order = Window.partitionBy("spec_id", "uuid").orderBy("snapshot_no")
    adjacent = F.coalesce(F.lag("snapshot_no").over(order) == F.col("prior_no"), F.lit(False))
    same = adjacent & F.lag("row_hash").over(order).eqNullSafe(F.col("row_hash"))
    rows = rows.withColumns({"_follows": adjacent, "_starts": F.when(same, 0).otherwise(1)})
    rows = rows.withColumns({"_island": F.sum("_starts").over(order), "_goes_on": F.coalesce(F.lead("snapshot_no").over(order) == F.col("next_no"), F.lit(False))})
    return rows.groupBy("spec_id", "uuid", "_island").agg(
        F.min("snapshot_no").alias("from_no"),
        F.max("snapshot_no").alias("to_no"),
        F.min(F.struct("snapshot_no", "prior_no", "_follows")).alias("_first"),
        F.max(F.struct("snapshot_no", "next_no", "_goes_on")).alias("_last"),
    ).select("spec_id", "uuid", "from_no", "to_no", F.col("_first.prior_no").alias("prior_no"), F.col("_last.next_no").alias("next_no"), F.col("_first._follows").alias("follows"), F.col("_last._goes_on").alias("goes_on"))


def snapshot_changes(snapshots: DataFrame) -> DataFrame:
    """(spec_id, uuid, snapshot_no, change_kind): each uuid added, removed or changed since the spec's snapshot before.

    An interval's start is an addition, or a change where another interval is adjacent; an end that no interval follows is
    a removal in the spec's next snapshot. A spec's first snapshot has no changes.
    """
    intervals = snapshot_intervals(snapshots)
    starts = F.when(F.col("prior_no").isNotNull(), F.struct(F.col("from_no").alias("snapshot_no"), F.when(F.col("follows"), "changed").otherwise("added").alias("change_kind")))
    ends = F.when(F.col("next_no").isNotNull() & ~F.col("goes_on"), F.struct(F.col("next_no").alias("snapshot_no"), F.lit("removed").alias("change_kind")))
    return intervals.select("spec_id", "uuid", F.explode(F.array(starts, ends)).alias("event")).where("event IS NOT NULL").select("spec_id", "uuid", "event.snapshot_no", "event.change_kind")
