"""References to records that do not exist at the time of the reference.

A Bloom filter of the parents' keys proves most orphans without a join; only references that pass the filter are verified by
an exact join against the times in which the parent key was live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strataflow.functions.sections import canonical_section
from strataflow.operators.bloom import bloom_filter, in_round, might_contain, rounds_for
from strataflow.storage import new_path, stage


def live_periods(rows: DataFrame, *key: str) -> DataFrame:
    """Periods [live_from, live_to) in which a key has at least one live row; live_to null means without end.

    rows: the key columns, created_at and withdrawn_at. Rows without created_at are never live. Rows that are never withdrawn
    are reduced to one per key before any shuffle; the few withdrawn ones are deduplicated and merged where they overlap.
    """
    rows = rows.select(*key, "created_at", "withdrawn_at").where("created_at IS NOT NULL AND (withdrawn_at IS NULL OR withdrawn_at > created_at)")
    endless = rows.where("withdrawn_at IS NULL").groupBy(*key).agg(F.min("created_at").alias("live_from"))
    ended = rows.where("withdrawn_at IS NOT NULL").groupBy(*key, "created_at").agg(F.max("withdrawn_at").alias("withdrawn_at"))
    order = Window.partitionBy(*key).orderBy("created_at")
    before = F.max("withdrawn_at").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(before.isNull() | (F.col("created_at") > before), 1).otherwise(0)
    merged = ended.withColumn("_begins", begins).withColumn("_island", F.sum("_begins").over(order))
    merged = merged.groupBy(*key, "_island").agg(F.min("created_at").alias("live_from"), F.max("withdrawn_at").alias("live_to")).drop("_island")
    return endless.withColumn("live_to", F.lit(None).cast("timestamp")).unionByName(merged)


def with_verdict(rows: DataFrame, key: Column, keys: DataFrame, known: Column, count: int, name: str) -> DataFrame:
    """rows with ``possible`` (false: the key is certainly not among the keys), written to the shared folder split by it.

    The rows are read once, and once more for each further 2^29 / 12 keys that don't fit the filters of one round.
    """
    rounds, path = rounds_for(count), new_path(rows.sparkSession, name)
    for n in range(rounds):
        bloom = bloom_filter(keys.where(in_round(known, n, rounds)), known, -(-count // rounds))
        part = rows.where(in_round(key, n, rounds))
        part = part.withColumn("possible", might_contain(part, bloom, key))
        part.write.partitionBy("possible").parquet(f"{path}/round={n}")
    return rows.sparkSession.read.schema(part.schema).option("basePath", path).parquet(f"{path}/round=*")


def orphan_references(references: DataFrame, specs: DataFrame) -> DataFrame:
    """(ref_id, ref_field, month) of every reference whose source spec or target section wasn't live when it was made.

    Ids compare in lower case and sections in canonical form. Exact copies of a reference give one row. A null key is no
    case; a null created_at is live nowhere, so its keys are cases and its month is null. A target is judged only where the
    source spec has a row; an owner that is null has no specs. Empty tables: no references give no rows; without specs each source reference is a case.
    Further columns of either table are ignored.
    """
    owner = F.coalesce(F.concat(F.lit("L"), F.lower("library_id")), F.concat(F.lit("P"), F.lower("project_id")))
    parents = stage(specs.select(F.lower("spec_id").alias("source"), owner.alias("owner"), canonical_section(F.col("section")).alias("target"), "created_at", "withdrawn_at"), "parents")
    count = parents.count()
    refs = references.select("ref_id", F.lower("source_spec_id").alias("source"), canonical_section(F.col("target_spec_section")).alias("target"), F.col("created_at").alias("made"))
    # First verdict: sources that no spec has. Their references are cases of the source and aren't judged for the target.
    judged = with_verdict(refs.where("source IS NOT NULL"), F.col("source"), parents, F.col("source"), count, "source-verdicts")
    aimed = judged.where("possible")
    owners = parents.where("source IS NOT NULL").select(F.col("source").alias("_source"), "owner").distinct()
    aimed = aimed.join(owners, F.col("source") == F.col("_source"), "left").select("ref_id", "source", "_source", "owner", "target", "made")
    # One row for each field to verify. Keys of both fields have one form: sources stand without a target.
    fields = F.array(
        F.struct(F.lit("source_spec_id").alias("ref_field"), F.col("source").alias("one"), F.lit("").alias("two")),
        F.when(F.col("_source").isNotNull() & F.col("target").isNotNull(), F.struct(F.lit("target_spec_section").alias("ref_field"), F.col("owner").alias("one"), F.concat(F.lit("S"), "target").alias("two"))),
    )
    asked = aimed.select("ref_id", "made", F.explode(fields).alias("f")).where("f IS NOT NULL").select("ref_id", "made", "f.*")
    keys = F.array(
        F.when(F.col("source").isNotNull(), F.struct(F.col("source").alias("one"), F.lit("").alias("two"))),
        F.when(F.col("owner").isNotNull() & F.col("target").isNotNull(), F.struct(F.col("owner").alias("one"), F.concat(F.lit("S"), "target").alias("two"))),
    )
    parent_keys = parents.select(F.explode(keys).alias("k"), "created_at", "withdrawn_at").where("k IS NOT NULL").select("k.*", "created_at", "withdrawn_at")
    periods = stage(live_periods(parent_keys, "one", "two"), "periods")
    # Second verdict: keys that were never live. What passes meets the periods in an anti join, whose skewed partitions adaptive execution splits.
    both = F.struct("one", "two")
    verdicts = with_verdict(asked, both, periods, both, periods.count(), "verdicts")
    spans = periods.select(F.col("one").alias("_one"), F.col("two").alias("_two"), "live_from", "live_to")
    within = (F.col("live_from") <= F.col("made")) & (F.col("live_to").isNull() | (F.col("live_to") > F.col("made")))
    verified = verdicts.where("possible").join(spans, (F.col("one") == F.col("_one")) & (F.col("two") == F.col("_two")) & within, "left_anti")
    columns = ["ref_id", "ref_field", "made"]
    found = judged.where("NOT possible").withColumn("ref_field", F.lit("source_spec_id")).select(*columns).unionByName(verdicts.where("NOT possible").select(*columns)).unionByName(verified.select(*columns))
    return found.select("ref_id", "ref_field", F.date_format("made", "yyyy-MM").alias("month")).distinct()


def orphans_by_month(references: DataFrame, specs: DataFrame) -> DataFrame:
    """Number of orphan references per field and month of the reference."""
    return orphan_references(references, specs).groupBy("ref_field", "month").agg(F.countDistinct("ref_id").alias("n_orphans"))
