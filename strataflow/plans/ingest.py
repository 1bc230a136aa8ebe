"""Queries of readers, writers and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strataflow.operators import tree as O
from strataflow.operators.hierarchy import Carried
from strataflow.plans import trees
from strataflow.plans.registry import SQL, query
from strataflow.sources import documents as D
from strataflow.sources.tables import table
from strataflow.streaming import sessions as S

_KIND = "CASE WHEN regexp_matches(t, '^SECTION\\s+[0-9]') THEN 0 WHEN regexp_matches(t, '^PART\\s+[0-9]+') THEN 1 WHEN regexp_matches(t, '^[0-9]+\\.[0-9]+\\s') THEN 2 WHEN regexp_matches(t, '^[A-Z]\\.\\s') THEN 3 WHEN regexp_matches(t, '^[0-9]+\\.\\s') THEN 4 WHEN regexp_matches(t, '^[a-z]\\.\\s') THEN 5 WHEN regexp_matches(t, '^[0-9]+\\)\\s') THEN 6 WHEN regexp_matches(t, '^[a-z]\\)\\s') THEN 7 END"


@query("text_tree", f"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, trim(unnest(string_split(text, chr(10)))) AS t FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, line_no::INTEGER AS line_no, {_KIND} AS level FROM l WHERE t <> '')
SELECT a.doc_id, a.line_no, max(b.line_no) AS parent_no, a.level FROM k a LEFT JOIN k b ON b.doc_id = a.doc_id AND b.line_no < a.line_no AND b.level < coalesce(a.level, 99) GROUP BY a.doc_id, a.line_no, a.level""")
def text_tree(spark: SparkSession, folder: str) -> DataFrame:
    return D.text_tree(table(spark, folder, "documents"), "doc_id", "text").select("doc_id", "line_no", "parent_no", "level")


@query("sec_round_trip", """WITH p AS (SELECT DISTINCT lower(paragraph_id) AS id, lower(spec_id) AS spec, spec_section, text FROM paragraphs WHERE text IS NOT NULL AND node_type = 'pr1')
SELECT spec AS source_id, count(*) + 3 AS n_nodes, sum(length(trim(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))))::BIGINT + 8 + 1 + 14 - 1 + max(length(spec_section)) - 8 AS n_chars FROM p GROUP BY spec""".replace(" + 8 + 1 + 14 - 1 + max(length(spec_section)) - 8", " + 14 + 4 + max(length(spec_section))"))
def sec_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Each spec's first-level paragraphs written as a SEC document and read again."""
    rows = table(spark, folder, "paragraphs").where("text IS NOT NULL AND node_type = 'pr1'").select(F.lower("paragraph_id").alias("id"), F.lower("spec_id").alias("spec"), "spec_section", "text").distinct()
    specs = rows.groupBy("spec").agg(F.max("spec_section").alias("number"), F.array_sort(F.collect_list(F.struct("id", "text"))).alias("p"))
    files = specs.select(F.col("spec").alias("source_id"), D.sec_markup(F.lit("Spec"), F.col("number"), F.col("p.text")).alias("content"))
    nodes = D.parse_files(files, D.sec_nodes)
    # Each paragraph is an article node with a continuation below it; the article itself has no text.
    return nodes.groupBy("source_id").agg(F.count_if((F.col("node_type") != "article")).alias("n_nodes"), F.sum(F.length("text")).alias("n_chars"))


_WS = lambda c: f"trim(regexp_replace(regexp_replace(coalesce({c}, ''), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))"


@query("sec_tree_round_trip", trees.CTE + f""", v AS (SELECT t.id, n.parent, t.depth, n.type, q.type AS parent_type, n.text, t.sort_key, r.spec, r.spec_section FROM t JOIN n ON n.id = t.id JOIN n r ON r.id = t.root_id LEFT JOIN n q ON q.id = n.parent WHERE NOT t.gone AND t.address NOT LIKE '%note:-/%'),
w AS (SELECT *, id NOT IN (SELECT parent FROM v WHERE parent IS NOT NULL) AS bare, count(*) FILTER (depth = 0 AND type <> 'note') OVER (PARTITION BY spec ORDER BY sort_key) AS part_no, ['part', 'article', 'pr1', 'pr2', 'pr3', 'pr4', 'pr5', 'pr6', 'pr7'] AS ts FROM v),
x AS (SELECT spec, CASE WHEN depth > 0 THEN ts[least(depth, 9)] END AS parent_type, CASE WHEN type = 'note' THEN 'note' WHEN depth > 1 AND bare AND list_position(ts, type) - list_position(ts, parent_type) >= 2 THEN ts[least(depth + 2, 9)] ELSE ts[least(depth + 1, 9)] END AS node_type, CASE WHEN depth = 0 AND type <> 'note' THEN trim('PART ' || part_no || ' ' || {_WS("text")}) ELSE {_WS("text")} END AS text FROM w),
h AS (SELECT spec, {_WS("'SECTION ' || coalesce(max(spec_section), '')")} AS text FROM v GROUP BY spec UNION ALL SELECT spec, {_WS("max(title)")} FROM (SELECT DISTINCT spec FROM v) LEFT JOIN specs ON lower(spec_id) = spec GROUP BY spec)
SELECT spec AS source_id, parent_type, node_type, count(*) AS n_nodes, sum(length(text))::BIGINT AS n_chars FROM (SELECT * FROM x UNION ALL SELECT spec, NULL, 'header', text FROM h) GROUP BY ALL""")
def sec_tree_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Each spec's whole visible tree with its notes written as a SEC document and read again. Nodes on circles stand in no tree."""
    nodes = D.parse_files(sec_trees(spark, folder), D.sec_nodes)
    parents = nodes.select("source_id", F.col("node_no").alias("parent_no"), F.col("node_type").alias("parent_type"))
    return nodes.join(parents, ["source_id", "parent_no"], "left").groupBy("source_id", "parent_type", "node_type").agg(F.count("*").alias("n_nodes"), F.sum(F.length("text")).alias("n_chars"))


def sec_trees(spark: SparkSession, folder: str) -> DataFrame:
    """(source_id, content) of each spec. Vanished nodes other than notes are left out with all below them, as is what stands below a note."""
    rows = trees.nodes(spark, folder)
    step = F.concat(F.lpad(F.greatest(F.coalesce("position", F.lit(0)), F.lit(0)).cast("string"), 10, "0"), F.col("id"))
    root = F.struct("spec", "spec_section")
    kinds = F.struct(F.lit(None).cast("string").alias("parent"), F.col("type").alias("own"), F.lit(False).alias("below_note"))
    values = (
        O.gone(), Carried("key", F.array(step), lambda above: F.concat(above, F.array(step))), Carried("root", root, lambda above: above),
        Carried("kinds", kinds, lambda above: F.struct(above["own"].alias("parent"), F.col("type").alias("own"), (above["below_note"] | (above["own"] == "note")).alias("below_note"))),
    )
    found = O.carried(rows, *values).where("NOT gone AND NOT coalesce(kinds.below_note, false)")
    found = found.select("id", F.col("root.spec").alias("source_id"), F.col("root.spec_section").alias("number"), "key", "depth", F.col("kinds.parent").alias("parent_type"))
    lines = rows.select("id", "type", "text").join(found, "id")
    titles = table(spark, folder, "specs").groupBy(F.lower("spec_id").alias("source_id")).agg(F.max("title").alias("title"))
    return D.sec_documents(lines.select("source_id", "number", "key", "depth", "type", "parent_type", "text"), titles)


@query("stream_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1800000000 THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), h AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, s ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, epoch_us(min(ts)) AS started_us, epoch_us(max(ts)) AS ended_us, count(*) AS n_rows FROM h GROUP BY user_id, n""")
def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    batch = table(spark, folder, "events")
    log = S.change_stream(spark, f"{folder}/events.parque[t]", batch.schema).withColumn("ts", F.col("ts").cast("timestamp"))
    found = S.run_available(S.session_windows(log, "user_id", "ts"), "sessions", "complete")
    return found.select("user_id", F.unix_micros("started_at").alias("started_us"), F.unix_micros("ended_at").alias("ended_us"), "n_rows")


@query("stream_pending", "SELECT user_id, event_type, ts::DATE AS day, count(*) AS n_rows FROM events GROUP BY ALL")
def stream_pending(spark: SparkSession, folder: str) -> DataFrame:
    batch = table(spark, folder, "events")
    log = S.change_stream(spark, f"{folder}/events.parque[t]", batch.schema).withColumn("ts", F.col("ts").cast("timestamp"))
    return S.run_available(S.pending_counts(log, "user_id", "event_type", "ts"), "pending", "complete")


@query("stream_sessions_closed", SQL["stream_sessions"].replace("GROUP BY user_id, n", "GROUP BY user_id, n HAVING epoch_us(max(ts)) + 1800000000 <= (SELECT epoch_us(max(ts)) - 3600000000 FROM events)"))
def stream_sessions_closed(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions in append mode: those that the watermark has closed, each given once and its state dropped."""
    batch = table(spark, folder, "events")
    log = S.change_stream(spark, f"{folder}/events.parque[t]", batch.schema).withColumn("ts", F.col("ts").cast("timestamp"))
    found = S.run_available(S.session_windows(log, "user_id", "ts"), "sessions-closed", "append")
    return found.select("user_id", F.unix_micros("started_at").alias("started_us"), F.unix_micros("ended_at").alias("ended_us"), "n_rows")


@query("stream_pending_closed", "SELECT * FROM (SELECT user_id, event_type, ts::DATE AS day, count(*) AS n_rows FROM events GROUP BY ALL) WHERE epoch_us(day::TIMESTAMP) + 86400000000 <= (SELECT epoch_us(max(ts)) - 3600000000 FROM events)")
def stream_pending_closed(spark: SparkSession, folder: str) -> DataFrame:
    """Daily counts in append mode: days that the watermark has passed."""
    batch = table(spark, folder, "events")
    log = S.change_stream(spark, f"{folder}/events.parque[t]", batch.schema).withColumn("ts", F.col("ts").cast("timestamp"))
    return S.run_available(S.pending_counts(log, "user_id", "event_type", "ts"), "pending-closed", "append")
