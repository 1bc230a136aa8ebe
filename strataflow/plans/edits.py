"""Queries of edits as row sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strataflow.operators import edits as E
from strataflow.plans import history
from strataflow.plans.registry import SQL, query
from strataflow.plans.relations import CTE, references, specs
from strataflow.sources.tables import table

_MERGE = SQL["three_way_diff"]
_APPLIED = f"""SELECT m.spec_id, m.uuid, m.outcome AS op, o.text AS old_text, CASE WHEN m.outcome <> 'deleted' THEN l.text END AS new_text, (CASE WHEN m.outcome = 'added' THEN 1 ELSE coalesce(v.base_version, 1) + 1 END)::INTEGER AS new_version
FROM ({_MERGE}) AS m LEFT JOIN (SELECT DISTINCT lower(spec_id) AS spec_id, lower(paragraph_id) AS uuid, text FROM paragraphs) AS o USING (spec_id, uuid) LEFT JOIN (SELECT lower(spec_id) AS spec_id, lower(paragraph_id) AS uuid, max(base_version) AS base_version FROM paragraphs GROUP BY 1, 2) AS v USING (spec_id, uuid)
LEFT JOIN (SELECT x.* FROM (SELECT lower(spec_id) AS spec_id, snapshot_no, lower(uuid) AS uuid, arg_max(struct_pack(t := text), struct_pack(d := delivered_at, t := coalesce(text, ''))).t AS text FROM extract_snapshots GROUP BY ALL) AS x JOIN (SELECT lower(spec_id) AS spec_id, max(snapshot_no) AS b FROM extract_snapshots GROUP BY 1) AS b ON b.spec_id = x.spec_id AND b.b = x.snapshot_no) AS l USING (spec_id, uuid)
WHERE m.outcome IN ('modified', 'deleted', 'added')"""


def _applied(spark: SparkSession, folder: str) -> DataFrame:
    _, theirs = history._ends(spark, folder)
    rows = table(spark, folder, "paragraphs").select(F.lower("spec_id").alias("spec_id"), F.lower("paragraph_id").alias("uuid"), "text", "base_version")
    versions = rows.groupBy("spec_id", "uuid").agg(F.max("base_version").alias("base_version"))
    return E.applied_changes(history.three_way_diff(spark, folder), rows.select("spec_id", "uuid", "text").distinct(), theirs, ["spec_id", "uuid"], versions)


@query("applied_changes", f"SELECT spec_id, uuid, op, md5(old_text) AS old_hash, md5(new_text) AS new_hash, new_version FROM ({_APPLIED})")
def applied_changes(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that merging each spec's last snapshot writes: new texts, ended and added paragraphs with their versions."""
    return _applied(spark, folder).select("spec_id", "uuid", "op", F.md5("old_text").alias("old_hash"), F.md5("new_text").alias("new_hash"), "new_version")


@query("bumped_versions", CTE + f", a AS (SELECT spec_id, count(*) AS n FROM ({_APPLIED}) GROUP BY 1), v AS (SELECT spec_id, max(content_version) AS content_version FROM s GROUP BY 1) SELECT v.spec_id, coalesce(a.n, 0) AS n_applied, v.content_version + CASE WHEN coalesce(a.n, 0) > 0 THEN 1 ELSE 0 END AS content_version FROM v LEFT JOIN a USING (spec_id)")
def bumped_versions(spark: SparkSession, folder: str) -> DataFrame:
    latest = specs(spark, folder).groupBy("spec_id").agg(F.max("content_version").alias("content_version"))
    return E.bumped_versions(latest, _applied(spark, folder), "spec_id")


@query("checkpoints", CTE + ", v AS (SELECT owner, spec_id, max(content_version) AS v FROM s WHERE withdrawn_at IS NULL AND owner IS NOT NULL GROUP BY ALL) SELECT owner, count(*) AS n_specs, md5(string_agg(spec_id || '=' || v, ',' ORDER BY spec_id)) AS versions_hash FROM v GROUP BY owner")
def checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    """A checkpoint of each owner: the versions of its live specs."""
    kept = E.checkpoints(specs(spark, folder).where("withdrawn_at IS NULL AND owner IS NOT NULL"), "owner")
    entries = F.transform(F.map_entries("content_versions"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return kept.select("owner", "n_specs", F.md5(F.array_join(entries, ",")).alias("versions_hash"))


@query("required_positions", CTE + """SELECT owner, section, (row_number() OVER (PARTITION BY owner ORDER BY section) - 1)::INTEGER AS position FROM (SELECT DISTINCT s.owner, r.target_section AS section FROM r JOIN s ON s.spec_id = r.source_spec_id WHERE r.target_section IS NOT NULL AND s.owner IS NOT NULL)""")
def required_positions(spark: SparkSession, folder: str) -> DataFrame:
    """The sections that each owner's references require, as the list that replaces its requirements."""
    owners = specs(spark, folder).where("owner IS NOT NULL").select(F.col("spec_id").alias("source_spec_id"), "owner")
    rows = references(spark, folder).where("target_section IS NOT NULL").join(owners, "source_spec_id").select("owner", F.col("target_section").alias("section"))
    return E.numbered(rows, ["owner"], ["section"])


@query("withdrawal_effects", CTE + """, c AS (SELECT owner, section, count(DISTINCT spec_id) FILTER (withdrawn_at IS NULL) AS live, count(DISTINCT spec_id) FILTER (withdrawn_at IS NOT NULL) AS withdrawn FROM s WHERE owner IS NOT NULL GROUP BY ALL),
u AS (SELECT s.owner, r.target_section AS section, count(*) AS n_refs FROM r JOIN s ON s.spec_id = r.source_spec_id WHERE r.target_section IS NOT NULL AND s.withdrawn_at IS NULL GROUP BY ALL)
SELECT c.owner, c.section, coalesce(u.n_refs, 0) AS n_refs, CASE WHEN live = 0 THEN 'restoring repairs' WHEN live = 1 THEN 'withdrawing breaks' ELSE 'withdrawing one breaks nothing' END AS effect FROM c LEFT JOIN u USING (owner, section)""")
def withdrawal_effects(spark: SparkSession, folder: str) -> DataFrame:
    """What withdrawing or restoring a spec of each section would do to the references of its owner's live specs."""
    every = specs(spark, folder).where("owner IS NOT NULL")
    live = F.countDistinct(F.when(F.col("withdrawn_at").isNull(), F.col("spec_id")))
    held = every.groupBy("owner", "section").agg(live.alias("_live"))
    sources = every.where("withdrawn_at IS NULL").select(F.col("spec_id").alias("source_spec_id"), "owner")
    refs = references(spark, folder).where("target_section IS NOT NULL").join(sources, "source_spec_id").groupBy("owner", F.col("target_section").alias("section")).agg(F.count("*").alias("_n"))
    effect = F.when(F.col("_live") == 0, "restoring repairs").when(F.col("_live") == 1, "withdrawing breaks").otherwise("withdrawing one breaks nothing")
    return held.join(refs, ["owner", "section"], "left").select("owner", "section", F.coalesce("_n", F.lit(0)).alias("n_refs"), effect.alias("effect"))
