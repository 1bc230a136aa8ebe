"""Queries of payloads, stored tables, timelines and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strataflow.operators import tree as O
from strataflow.plans import findings, history, ingest
from strataflow.plans.registry import SQL, query
from strataflow.plans.relations import CTE, specs
from strataflow.plans.trees import CTE as TREES, nodes
from strataflow.sources.payloads import decoded_text, payload
from strataflow.sources.tables import table
from strataflow.storage import stage


@query("decoded_payloads", "SELECT doc_id, encoding, text IS NULL AS refused, sha256(coalesce(text, '')) AS text_hash FROM documents, (VALUES ('utf-8'), ('utf-8-sig'), ('utf-16')) AS e(encoding)")
def decoded_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Texts sent as base64 in several encodings, decoded by their byte-order marks; all give the text again. A payload that isn't there is refused."""
    rows = table(spark, folder, "documents").select("doc_id", "text")
    sent = {"utf-8": F.encode("text", "UTF-8"), "utf-8-sig": F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")), "utf-16": F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE"))}
    rows = rows.select("doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("encoding"), F.base64(v).alias("data")) for k, v in sent.items()])).alias("p")).select("doc_id", "p.*")
    text = decoded_text(payload(F.col("data")))
    return rows.select("doc_id", "encoding", text.isNull().alias("refused"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("text_hash"))


@query("stored_paragraphs", "SELECT substr(spec_section, 1, 2) AS division, node_type, count(*) AS n_rows, count(DISTINCT paragraph_id) AS n_paragraphs, sum(length(coalesce(text, '')))::BIGINT AS n_chars FROM paragraphs WHERE substr(spec_section, 1, 2) = '01' GROUP BY ALL")
def stored_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """The paragraphs written to a table partitioned by division and one division read back: the others' files aren't opened."""
    rows = table(spark, folder, "paragraphs").select("paragraph_id", "node_type", "text", F.substring("spec_section", 1, 2).alias("division"))
    kept = stage(rows.repartition("division"), "paragraphs", "division").where("division = '01'")
    return kept.groupBy("division", "node_type").agg(F.count("*").alias("n_rows"), F.countDistinct("paragraph_id").alias("n_paragraphs"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("n_chars"))


_VERSIONS = """WITH v AS (SELECT lower(spec_id) AS spec_id, lower(uuid) AS uuid, snapshot_no AS version, arg_max(struct_pack(t := text), struct_pack(d := delivered_at, t := coalesce(text, ''))).t AS text FROM extract_snapshots GROUP BY ALL),
c AS (SELECT *, lag(version) OVER w IS NULL AS first, lag(text) OVER w AS before FROM v WINDOW w AS (PARTITION BY spec_id, uuid ORDER BY version)),
l AS (SELECT spec_id, uuid, max(version) AS version, arg_max(struct_pack(t := text), version).t AS text FROM v GROUP BY ALL), p AS (SELECT DISTINCT lower(spec_id) AS spec_id, lower(paragraph_id) AS uuid, text FROM paragraphs)
"""


@query("paragraph_timeline", _VERSIONS + """SELECT spec_id, uuid, version, CASE WHEN first THEN 'created' ELSE 'edited' END AS entry, md5(text) AS text_hash FROM c WHERE first OR text IS DISTINCT FROM before
UNION ALL SELECT l.spec_id, l.uuid, l.version + 1, 'tip', md5(p.text) FROM l JOIN p USING (spec_id, uuid) WHERE p.text IS DISTINCT FROM l.text""")
def paragraph_timeline(spark: SparkSession, folder: str) -> DataFrame:
    """The history of each paragraph: versions that changed its text, and the current text where it is none of them."""
    rows = history._delivered(spark, folder)
    order = Window.partitionBy("spec_id", "uuid").orderBy("snapshot_no")
    rows = rows.withColumn("_first", F.lag("snapshot_no").over(order).isNull()).withColumn("_before", F.lag("text").over(order)).withColumn("_last", F.lead("snapshot_no").over(order).isNull())
    entries = rows.where(F.col("_first") | ~F.col("text").eqNullSafe(F.col("_before"))).select("spec_id", "uuid", F.col("snapshot_no").alias("version"), F.when(F.col("_first"), "created").otherwise("edited").alias("entry"), F.md5("text").alias("text_hash"))
    now = table(spark, folder, "paragraphs").select(F.lower("spec_id").alias("spec_id"), F.lower("paragraph_id").alias("uuid"), F.col("text").alias("_now")).distinct()
    tips = rows.where("_last").join(now, ["spec_id", "uuid"]).where(~F.col("_now").eqNullSafe(F.col("text")))
    return entries.unionByName(tips.select("spec_id", "uuid", (F.col("snapshot_no") + 1).alias("version"), F.lit("tip").alias("entry"), F.md5("_now").alias("text_hash")))


_SHAPES = TREES + """, sh AS (SELECT n.spec, sha256(string_agg(t.depth || ':' || n.type, ',' ORDER BY t.sort_key)) AS shape, count(*) AS n_nodes, count(*) FILTER (n.type = 'part') AS n_parts, max(t.depth) AS max_depth, sum(length(coalesce(n.text, '')))::BIGINT AS n_chars FROM n JOIN t USING (id) WHERE NOT t.gone GROUP BY n.spec),
k AS (SELECT DISTINCT lower(spec_id) AS spec_id, lower(parent_spec_id) AS parent_spec_id FROM specs WHERE parent_spec_id IS NOT NULL)
"""


def _shapes(spark: SparkSession, folder: str) -> DataFrame:
    """(spec, shape, n_nodes, n_parts, max_depth, n_chars): the digest of a visible tree's types and depths in order of reading. A spec's nodes meet in one row, as the document does."""
    walked = O.carried(nodes(spark, folder), O.gone(), O.preorder(), O.own("spec"), O.own("type"), O.own("n_chars")).where("NOT gone")
    rows = walked.groupBy("spec").agg(
        F.array_sort(F.collect_list(F.struct("sort_key", F.concat_ws(":", F.col("depth").cast("string"), "type").alias("step")))).alias("s"), F.count("*").alias("n_nodes"), F.count_if(F.col("type") == "part").alias("n_parts"), F.max("depth").alias("max_depth"), F.sum("n_chars").alias("n_chars")
    )
    return rows.select("spec", F.sha2(F.array_join(F.col("s.step"), ","), 256).alias("shape"), "n_nodes", "n_parts", "max_depth", "n_chars")


@query("shape_divergence", _SHAPES + "SELECT k.spec_id, k.parent_spec_id, a.shape <> b.shape AS diverges, (a.n_nodes - b.n_nodes)::BIGINT AS d_nodes, (a.n_parts - b.n_parts)::BIGINT AS d_parts, (a.max_depth - b.max_depth)::INTEGER AS d_depth, (a.n_chars - b.n_chars)::BIGINT AS d_chars FROM k JOIN sh AS a ON a.spec = k.spec_id JOIN sh AS b ON b.spec = k.parent_spec_id")
def shape_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """Derived specs against their parents: whether the structure differs, and by how much each field of the fingerprint."""
    shapes = stage(_shapes(spark, folder), "shapes")
    fields = ("shape", "n_nodes", "n_parts", "max_depth", "n_chars")
    side = lambda key, x: shapes.select(F.col("spec").alias(key), *[F.col(c).alias(f"{x}_{c}") for c in fields])
    links = specs(spark, folder).where("parent_spec_id IS NOT NULL").select("spec_id", "parent_spec_id").distinct()
    rows = links.join(side("spec_id", "a"), "spec_id").join(side("parent_spec_id", "b"), "parent_spec_id")
    change = lambda c, name: (F.col(f"a_{c}") - F.col(f"b_{c}")).alias(name)
    return rows.select("spec_id", "parent_spec_id", (F.col("a_shape") != F.col("b_shape")).alias("diverges"), change("n_nodes", "d_nodes"), change("n_parts", "d_parts"), change("max_depth", "d_depth"), change("n_chars", "d_chars"))


@query("root_continuations", f"WITH x AS (SELECT doc_id, line_no, level FROM ({SQL['text_tree']}) WHERE parent_no IS NULL AND level IS NULL) SELECT doc_id, count(*) AS n_dropped, string_agg(line_no::VARCHAR, ', ' ORDER BY line_no) FILTER (k <= 5) AS first_lines FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM x) GROUP BY doc_id")
def root_continuations(spark: SparkSession, folder: str) -> DataFrame:
    """Lines before any structure, which a tree has no place for: how many, and the first five."""
    rows = ingest.text_tree(spark, folder).where("parent_no IS NULL AND level IS NULL")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))
    first = F.array_sort(F.collect_list(F.when(F.col("_k") <= 5, F.col("line_no"))))
    return rows.withColumn("_k", place).groupBy("doc_id").agg(F.count("*").alias("n_dropped"), F.array_join(F.transform(first, lambda x: x.cast("string")), ", ").alias("first_lines"))


@query("front_matter", CTE + """, l AS (SELECT owner, section, min(title) AS title, count(DISTINCT spec_id) AS n_specs FROM s WHERE withdrawn_at IS NULL AND owner IS NOT NULL GROUP BY ALL) SELECT owner, (row_number() OVER (PARTITION BY owner ORDER BY section))::INTEGER AS entry_no, section, coalesce(l.title, c.title) AS title, n_specs FROM l LEFT JOIN spec_sections c ON c.section_number = l.section""")
def front_matter(spark: SparkSession, folder: str) -> DataFrame:
    """The contents of each owner's manual: its live sections in order, titled by their specs, else by the catalogue."""
    rows = specs(spark, folder).where("withdrawn_at IS NULL AND owner IS NOT NULL").groupBy("owner", "section").agg(F.min("title").alias("_title"), F.countDistinct("spec_id").alias("n_specs"))
    names = table(spark, folder, "spec_sections").select(F.col("section_number").alias("section"), F.col("title").alias("_name"))
    entry = F.row_number().over(Window.partitionBy("owner").orderBy("section"))
    return rows.join(names, "section", "left").select("owner", entry.alias("entry_no"), "section", F.coalesce("_title", "_name").alias("title"), "n_specs")


@query("spec_milestones", "WITH m AS (SELECT lower(spec_id) AS spec_id, snapshot_no, min(delivered_at) AS first_at, count(DISTINCT lower(uuid)) AS n_paragraphs FROM extract_snapshots WHERE snapshot_no IS NOT NULL GROUP BY ALL) SELECT spec_id, snapshot_no, epoch_us(first_at) AS at_us, n_paragraphs, n_paragraphs - coalesce(lag(n_paragraphs) OVER (PARTITION BY spec_id ORDER BY snapshot_no), 0) AS grown_by FROM m")
def spec_milestones(spark: SparkSession, folder: str) -> DataFrame:
    """Each spec's snapshots as milestones: when the first row of it was delivered, its size and its growth."""
    rows = table(spark, folder, "extract_snapshots").where("snapshot_no IS NOT NULL")
    sizes = rows.groupBy(F.lower("spec_id").alias("spec_id"), "snapshot_no").agg(F.min(F.col("delivered_at").cast("timestamp")).alias("at"), F.countDistinct(F.lower("uuid")).alias("n_paragraphs"))
    before = F.lag("n_paragraphs").over(Window.partitionBy("spec_id").orderBy("snapshot_no"))
    return sizes.select("spec_id", "snapshot_no", F.unix_micros("at").alias("at_us"), "n_paragraphs", (F.col("n_paragraphs") - F.coalesce(before, F.lit(0))).alias("grown_by"))


@query("issue_gate", f"SELECT spec_id, n_notes + n_blank + n_commented > 0 AS blocked, concat_ws(', ', CASE WHEN n_notes > 0 THEN 'notes' END, CASE WHEN n_blank > 0 THEN 'blank' END, CASE WHEN n_commented > 0 THEN 'comments' END) AS reasons FROM ({SQL['readiness']})")
def issue_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Specs that can't be issued as final, and why."""
    found = {"n_notes": "notes", "n_blank": "blank", "n_commented": "comments"}
    reasons = F.concat_ws(", ", *[F.when(F.col(c) > 0, name) for c, name in found.items()])
    return findings.readiness(spark, folder).select("spec_id", (reasons != "").alias("blocked"), reasons.alias("reasons"))
