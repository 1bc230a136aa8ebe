"""Queries of change tracking, comparison and voting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strataflow.functions import text as X
from strataflow.operators import comparison as C, history as H
from strataflow.operators.snapshots import snapshot_changes
from strataflow.plans.registry import query
from strataflow.plans.relations import CTE as SPECS, specs
from strataflow.plans.general import _SNAPSHOTS
from strataflow.sources.tables import table

_EVENTS = """WITH e AS (SELECT user_id, ts, event_id, event_type = 'error' AS seal FROM events),
f AS (SELECT *, sum(CASE WHEN seal THEN 1 ELSE 0 END) OVER w AS seals, min(CASE WHEN seal THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_seal FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1800000000 OR lag(seals) OVER w <> seals THEN 1 ELSE 0 END AS starts FROM f WHERE NOT seal WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
h AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
"""


@query("edit_sessions", _EVENTS + "SELECT user_id, min(event_id) AS first_version, max(event_id) AS last_version, count(*) AS n_rows, epoch_us(min(ts)) AS started_us, epoch_us(max(ts)) AS ended_us, min(next_seal) AS sealed_by FROM h GROUP BY user_id, session")
def edit_sessions(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", (F.col("event_type") == "error").alias("seal"))
    found = H.sessions(events, "user_id", "ts", "event_id", "seal")
    return found.select("user_id", "first_version", "last_version", "n_rows", F.unix_micros("started_at").alias("started_us"), F.unix_micros("ended_at").alias("ended_us"), "sealed_by")


@query("pending_rollup", "WITH s AS (SELECT user_id, max(event_id) AS sealed FROM events WHERE event_type = 'error' GROUP BY user_id) SELECT e.user_id, coalesce(e.event_type, '(unattributed)') AS actor, count(*) AS n_pending FROM events e LEFT JOIN s USING (user_id) WHERE e.event_id > coalesce(s.sealed, -1) GROUP BY ALL")
def pending_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Rows after the last seal of each key, by actor."""
    events = table(spark, folder, "events").select("user_id", "event_id", "event_type")
    sealed = events.where("event_type = 'error'").groupBy("user_id").agg(F.max("event_id").alias("sealed"))
    pending = events.join(sealed, "user_id", "left").where(F.col("event_id") > F.coalesce("sealed", F.lit(-1)))
    return pending.groupBy("user_id", F.coalesce("event_type", F.lit("(unattributed)")).alias("actor")).agg(F.count("*").alias("n_pending"))


@query("latest_versions", "SELECT event_type, count(*) AS n_users FROM (SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id) GROUP BY event_type")
def latest_versions(spark: SparkSession, folder: str) -> DataFrame:
    last = table(spark, folder, "events").groupBy("user_id").agg(F.max(F.struct("event_id", "event_type")).alias("l"))
    return last.groupBy(F.col("l.event_type").alias("event_type")).agg(F.count("*").alias("n_users"))


@query("history_steps", _SNAPSHOTS + """, c AS (SELECT y.spec_id, y.snapshot_no, CASE WHEN p.uuid IS NULL THEN 'added' ELSE 'changed' END AS k FROM y LEFT JOIN y AS p ON p.spec_id = y.spec_id AND p.uuid = y.uuid AND p.snapshot_no = y.prior_no WHERE y.prior_no IS NOT NULL AND (p.uuid IS NULL OR p.text IS DISTINCT FROM y.text)
UNION ALL SELECT y.spec_id, y.next_no, 'removed' FROM y WHERE next_no IS NOT NULL AND NOT EXISTS (SELECT 1 FROM y AS z WHERE z.spec_id = y.spec_id AND z.uuid = y.uuid AND z.snapshot_no = y.next_no))
SELECT spec_id, snapshot_no, count(*) FILTER (k = 'added') AS inserted, count(*) FILTER (k = 'removed') AS removed, count(*) FILTER (k = 'changed') AS edited FROM c GROUP BY ALL""")
def history_steps(spark: SparkSession, folder: str) -> DataFrame:
    kinds = {"inserted": "added", "removed": "removed", "edited": "changed"}
    return snapshot_changes(table(spark, folder, "extract_snapshots")).groupBy("spec_id", "snapshot_no").agg(*[F.count_if(F.col("change_kind") == k).alias(n) for n, k in kinds.items()])


_ROWS = """WITH x AS (SELECT lower(spec_id) AS spec_id, snapshot_no, lower(uuid) AS uuid, arg_max(struct_pack(t := text), struct_pack(d := delivered_at, t := coalesce(text, ''))).t AS text FROM extract_snapshots GROUP BY ALL),
m AS (SELECT spec_id, min(snapshot_no) AS a, max(snapshot_no) AS b FROM x GROUP BY spec_id), first AS (SELECT x.* FROM x JOIN m ON m.spec_id = x.spec_id AND m.a = x.snapshot_no), last AS (SELECT x.* FROM x JOIN m ON m.spec_id = x.spec_id AND m.b = x.snapshot_no)
"""


def _delivered(spark: SparkSession, folder: str) -> DataFrame:
    """The text of each uuid in each snapshot: that of the latest delivery."""
    rows = table(spark, folder, "extract_snapshots").select(F.lower("spec_id").alias("spec_id"), "snapshot_no", F.lower("uuid").alias("uuid"), "delivered_at", "text")
    return rows.groupBy("spec_id", "snapshot_no", "uuid").agg(F.max(F.struct("delivered_at", F.coalesce("text", F.lit("")).alias("t"), "text")).alias("v")).select("spec_id", "snapshot_no", "uuid", F.col("v.text").alias("text"))


def _ends(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The first and the last snapshot of each spec."""
    rows = _delivered(spark, folder)
    ends = table(spark, folder, "extract_snapshots").groupBy(F.lower("spec_id").alias("spec_id")).agg(F.min("snapshot_no").alias("_a"), F.max("snapshot_no").alias("_b"))
    both = rows.join(ends, "spec_id")
    return both.where("snapshot_no = _a").select("spec_id", "uuid", "text"), both.where("snapshot_no = _b").select("spec_id", "uuid", "text")


@query("first_to_last", _ROWS + "SELECT coalesce(f.spec_id, l.spec_id) AS spec_id, coalesce(f.uuid, l.uuid) AS uuid, CASE WHEN f.uuid IS NULL THEN 'added' WHEN l.uuid IS NULL THEN 'removed' WHEN f.text IS NOT DISTINCT FROM l.text THEN 'unchanged' ELSE 'modified' END AS state FROM first f FULL JOIN last l ON f.spec_id = l.spec_id AND f.uuid = l.uuid")
def first_to_last(spark: SparkSession, folder: str) -> DataFrame:
    return H.compare_states(*_ends(spark, folder), ["spec_id", "uuid"], "text")


@query("state_at_version", """WITH c AS (SELECT user_id, event_type, event_id, value FROM events WHERE event_id <= 5000), l AS (SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS v FROM c GROUP BY ALL) SELECT user_id, event_type, value FROM l WHERE NOT value > 50""")
def state_at_version(spark: SparkSession, folder: str) -> DataFrame:
    changes = table(spark, folder, "events").select("user_id", "event_type", "event_id", "value", (F.col("value") > 50).alias("gone"))
    return H.state_at(changes, ["user_id", "event_type"], "event_id", 5000, "gone")


@query("states_at_own_versions", """WITH b AS (SELECT user_id, min(event_id) AS a, max(event_id) AS z FROM events GROUP BY ALL), v AS (SELECT user_id, a + (z - a) // 2 AS version FROM b UNION SELECT user_id, z FROM b),
c AS (SELECT e.user_id, v.version, e.event_type, arg_max(struct_pack(x := e.value), e.event_id) AS last FROM events e JOIN v ON e.user_id IS NOT DISTINCT FROM v.user_id AND e.event_id <= v.version GROUP BY ALL) SELECT user_id, version, event_type, last.x AS value FROM c WHERE NOT last.x > 50""")
def states_at_own_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's state halfway through the versions of its own log and at its latest, so that the whole log is folded at every size."""
    changes = table(spark, folder, "events").select("user_id", "event_type", "event_id", "value", (F.col("value") > 50).alias("gone"))
    ends = changes.groupBy("user_id").agg(F.min("event_id").alias("a"), F.max("event_id").alias("z"))
    versions = ends.select("user_id", F.explode(F.array_distinct(F.array(F.expr("a + (z - a) div 2"), F.col("z")))).alias("at"))
    return H.states_at(changes, "user_id", ["event_type"], "event_id", versions, "gone").withColumnRenamed("at", "version")


@query("three_way_diff", _ROWS + """, o AS (SELECT DISTINCT lower(spec_id) AS spec_id, lower(paragraph_id) AS uuid, text FROM paragraphs WHERE lower(spec_id) IN (SELECT spec_id FROM m)),
a AS (SELECT coalesce(f.spec_id, o.spec_id) AS spec_id, coalesce(f.uuid, o.uuid) AS uuid, f.text AS b, o.text AS o, f.uuid IS NOT NULL AS in_b, o.uuid IS NOT NULL AS in_o FROM first f FULL JOIN o ON f.spec_id = o.spec_id AND f.uuid = o.uuid),
z AS (SELECT coalesce(a.spec_id, l.spec_id) AS spec_id, coalesce(a.uuid, l.uuid) AS uuid, b, o, l.text AS t, coalesce(in_b, FALSE) AS in_b, coalesce(in_o, FALSE) AS in_o, l.uuid IS NOT NULL AS in_t FROM a FULL JOIN last l ON a.spec_id = l.spec_id AND a.uuid = l.uuid)
SELECT spec_id, uuid, CASE WHEN in_t AND NOT in_b AND NOT in_o THEN 'added' WHEN NOT in_t AND NOT in_b THEN 'unchanged' WHEN NOT in_t AND in_o AND o IS DISTINCT FROM b THEN 'delete_conflict' WHEN NOT in_t AND in_o THEN 'deleted' WHEN NOT in_t THEN 'unchanged'
WHEN in_o AND t IS NOT DISTINCT FROM o THEN 'unchanged' WHEN in_b AND t IS NOT DISTINCT FROM b THEN 'unchanged' WHEN NOT in_b OR NOT in_o OR o IS DISTINCT FROM b THEN 'conflict' ELSE 'modified' END AS outcome FROM z""")
def three_way_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Base: each spec's first snapshot; ours: its paragraphs; theirs: its last snapshot."""
    base, theirs = _ends(spark, folder)
    known = table(spark, folder, "extract_snapshots").select(F.lower("spec_id").alias("spec_id")).distinct()
    ours = table(spark, folder, "paragraphs").select(F.lower("spec_id").alias("spec_id"), F.lower("paragraph_id").alias("uuid"), "text").distinct().join(known, "spec_id", "left_semi")
    return H.three_way(base, ours, theirs, ["spec_id", "uuid"], "text")


_ALIGN = "WITH p AS (SELECT DISTINCT coalesce(lower(origin_paragraph_id), lower(paragraph_id)) AS origin, lower(spec_id) AS spec, text FROM paragraphs), c AS (SELECT origin, spec, min(text) AS v FROM p GROUP BY ALL), m AS (SELECT origin, count(*) AS n_present, count(DISTINCT v) + max(CASE WHEN v IS NULL THEN 1 ELSE 0 END) AS n_values FROM c GROUP BY origin)\n"


def _aligned(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "paragraphs").select(F.coalesce(F.lower("origin_paragraph_id"), F.lower("paragraph_id")).alias("origin"), F.lower("spec_id").alias("spec"), "text").distinct()
    return C.comparison_matrix(rows, "origin", "spec", "text")


@query("comparison_matrix", _ALIGN + "SELECT origin, n_present, n_values, CASE WHEN n_present < 2 THEN 'single' WHEN n_values > 1 THEN 'differing' ELSE 'identical' END AS state FROM m")
def comparison_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return _aligned(spark, folder)


@query("comparison_summary", _ALIGN + "SELECT CASE WHEN n_present < 2 THEN 'single' WHEN n_values > 1 THEN 'differing' ELSE 'identical' END AS state, count(*) AS n_rows, max(n_present) AS most_present FROM m GROUP BY 1")
def comparison_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _aligned(spark, folder).groupBy("state").agg(F.count("*").alias("n_rows"), F.max("n_present").alias("most_present"))


@query("baseline_lens", SPECS + """, p AS (SELECT DISTINCT lower(paragraph_id) AS id, lower(spec_id) AS spec, lower(origin_paragraph_id) AS origin, text FROM paragraphs), k AS (SELECT spec_id, parent_spec_id FROM s WHERE parent_spec_id IS NOT NULL AND parent_spec_id IN (SELECT spec_id FROM s)),
b AS (SELECT k.spec_id, p.id AS anchor, p.text FROM k JOIN p ON p.spec = k.parent_spec_id), c AS (SELECT k.spec_id, coalesce(p.origin, p.id) AS anchor, min(p.text) AS text FROM k JOIN p ON p.spec = k.spec_id GROUP BY ALL)
SELECT coalesce(b.spec_id, c.spec_id) AS spec_id, CASE WHEN b.anchor IS NULL THEN 'added' WHEN c.anchor IS NULL THEN 'removed' WHEN b.text IS NOT DISTINCT FROM c.text THEN 'unchanged' ELSE 'modified' END AS state, count(*) AS n_paragraphs FROM b FULL JOIN c ON b.spec_id = c.spec_id AND b.anchor = c.anchor GROUP BY ALL""")
def baseline_lens(spark: SparkSession, folder: str) -> DataFrame:
    """Each derived spec against its parent: paragraphs added, removed, modified and unchanged."""
    rows = table(spark, folder, "paragraphs").select(F.lower("paragraph_id").alias("id"), F.lower("spec_id").alias("spec"), F.lower("origin_paragraph_id").alias("origin"), "text").distinct()
    every = specs(spark, folder)
    links = every.where("parent_spec_id IS NOT NULL").select("spec_id", "parent_spec_id").join(every.select(F.col("spec_id").alias("parent_spec_id")), "parent_spec_id", "left_semi")
    before = links.join(rows, links["parent_spec_id"] == rows["spec"]).select("spec_id", F.col("id").alias("anchor"), "text")
    after = links.join(rows, links["spec_id"] == rows["spec"]).groupBy("spec_id", F.coalesce("origin", "id").alias("anchor")).agg(F.min("text").alias("text"))
    return H.compare_states(before, after, ["spec_id", "anchor"], "text").groupBy("spec_id", "state").agg(F.count("*").alias("n_paragraphs"))


@query("template_votes", """WITH c AS (SELECT l_partkey, l_quantity, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS seen FROM lineitem GROUP BY ALL), m AS (SELECT l_partkey, arg_max(l_quantity, struct_pack(n := n, s := -seen, v := l_quantity)) AS mode, max(n) AS nm, sum(n) AS nv FROM c GROUP BY 1),
d AS (SELECT l_partkey, quantile_disc(l_quantity, 0.5) AS lm FROM lineitem GROUP BY 1) SELECT l_partkey, mode, lm AS lower_median, CASE WHEN nm * 2 > nv THEN mode ELSE lm END AS winner, CASE WHEN nm * 2 > nv THEN 'majority' ELSE 'median' END AS rule FROM m JOIN d USING (l_partkey)""")
def template_votes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select("l_partkey", "l_quantity", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seen"))
    return C.winner(rows, "l_partkey", "l_quantity", "seen")


@query("title_matches", SPECS + """, w AS (SELECT spec_id, list_distinct([x for x in regexp_split_to_array(lower(s.title), '[^a-z0-9]+') if x <> '']) AS a, list_distinct([x for x in regexp_split_to_array(lower(c.title), '[^a-z0-9]+') if x <> '']) AS b FROM s JOIN spec_sections c ON c.section_number = s.section WHERE s.title IS NOT NULL),
j AS (SELECT spec_id, round(len(list_intersect(a, b))::DOUBLE / nullif(len(list_distinct(list_concat(a, b))), 0), 2) AS similarity FROM w) SELECT spec_id, similarity, CASE WHEN similarity = 1 THEN 'exact' WHEN similarity >= 0.7 THEN 'close' ELSE 'divergent' END AS title_match FROM j""")
def title_matches(spark: SparkSession, folder: str) -> DataFrame:
    every = specs(spark, folder).where("title IS NOT NULL").select("spec_id", "section", F.array_distinct(X.tokens(F.col("title"))).alias("a"))
    names = table(spark, folder, "spec_sections").select(F.col("section_number").alias("section"), F.array_distinct(X.tokens(F.col("title"))).alias("b"))
    found = every.join(names, "section").select("spec_id", C.jaccard(F.col("a"), F.col("b")).alias("similarity"))
    return found.withColumn("title_match", F.when(F.col("similarity") == 1, "exact").when(F.col("similarity") >= 0.7, "close").otherwise("divergent"))


@query("confidence_scores", """WITH p AS (SELECT DISTINCT paragraph_id, base_version % 5 + 1 AS used, CASE WHEN regexp_matches(trim(coalesce(text, '')), '^([A-Z]\\.|[0-9]+\\.|PART)\\s') THEN 1 ELSE 0 END AS agrees, sibling_position AS level FROM paragraphs),
t AS (SELECT *, CASE used WHEN 1 THEN 0.95 WHEN 2 THEN 0.85 WHEN 3 THEN 0.6 WHEN 4 THEN 0.6 ELSE 0.35 END::DOUBLE AS tier FROM p)
SELECT paragraph_id, used AS signal_used, CASE WHEN used IS NOT NULL THEN round(least(greatest(tier + agrees * 0.6 * 0.15 - CASE WHEN level > 2 THEN 0.1 + abs(level - 2) * 0.02 ELSE 0 END, 0.0), 1.0)::DOUBLE, 6) END AS confidence FROM t""")
def confidence_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Confidence from signals as the data has them: the version picks the winner, a typed label agrees, late siblings conflict."""
    rows = table(spark, folder, "paragraphs").select("paragraph_id", (F.col("base_version") % 5 + 1).alias("signal_used"), F.trim(F.coalesce("text", F.lit(""))).rlike(r"^([A-Z]\.|[0-9]+\.|PART)\s").alias("agrees"), F.col("sibling_position").alias("level")).distinct()
    agreed = F.when(F.col("agrees"), F.array(F.lit(4))).otherwise(F.array().cast("array<int>"))
    conflicts = F.when(F.col("level") > 2, F.array("level")).otherwise(F.array().cast("array<int>"))
    return rows.select("paragraph_id", "signal_used", C.hierarchy_confidence(F.col("signal_used"), agreed, conflicts, F.lit(2)).alias("confidence"))
