"""Queries over the paragraph trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strataflow.operators import tree as T
from strataflow.plans.registry import query
from strataflow.sources.tables import table

#: Nodes, and the tree below the roots; ids on circles aren't in t.
CTE = """WITH RECURSIVE n AS (SELECT DISTINCT lower(paragraph_id) AS id, lower(spec_id) AS spec, spec_section, lower(parent_id) AS parent, node_type AS type, text, sibling_position AS position, coalesce(vanish, FALSE) AS vanish FROM paragraphs WHERE paragraph_id IS NOT NULL),
o AS (SELECT *, CASE WHEN type <> 'note' THEN row_number() OVER (PARTITION BY spec, coalesce(parent, ''), type ORDER BY position, id) END AS ordinal FROM n),
t AS (SELECT id, id AS root_id, 0 AS depth, vanish AND type <> 'note' AS gone, CASE WHEN type = 'article' THEN id END AS article, 0 AS article_depth, type || ':' || coalesce(ordinal::VARCHAR, '-') AS address, lpad(greatest(coalesce(position, 0), 0)::VARCHAR, 10, '0') || id AS sort_key FROM o WHERE parent IS NULL OR parent NOT IN (SELECT id FROM n)
  UNION ALL SELECT o.id, t.root_id, t.depth + 1, t.gone OR (o.vanish AND o.type <> 'note'), CASE WHEN o.type = 'article' THEN o.id ELSE t.article END, CASE WHEN o.type = 'article' THEN t.depth + 1 ELSE t.article_depth END, t.address || '/' || o.type || ':' || coalesce(o.ordinal::VARCHAR, '-'), t.sort_key || '/' || lpad(greatest(coalesce(o.position, 0), 0)::VARCHAR, 10, '0') || o.id FROM o JOIN t ON o.parent = t.id)
"""
LABEL = """CASE o.type WHEN 'part' THEN 'PART ' || ordinal || ' -' WHEN 'article' THEN '.' || ordinal WHEN 'pr1' THEN upper(l) || '.' WHEN 'pr2' THEN ordinal || '.' WHEN 'pr3' THEN l || '.' WHEN 'pr4' THEN ordinal || ')' WHEN 'pr5' THEN l || ')' WHEN 'pr6' THEN ordinal || ')' WHEN 'pr7' THEN l || ')' END"""


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    return T.nodes_of(table(spark, folder, "paragraphs"))


@query("visible_paragraphs", CTE + "SELECT n.spec, count(*) AS n_visible, sum(length(coalesce(n.text, '')))::BIGINT AS n_chars FROM n JOIN t USING (id) WHERE NOT t.gone GROUP BY n.spec")
def visible_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    seen = T.carried(nodes(spark, folder), T.gone(), T.own("spec"), T.own("n_chars")).where("NOT gone")
    return seen.groupBy("spec").agg(F.count("*").alias("n_visible"), F.sum("n_chars").alias("n_chars"))


@query("nearest_articles", CTE + "SELECT id AS paragraph_id, article AS article_id, depth - article_depth AS distance FROM t WHERE article IS NOT NULL")
def nearest_articles(spark: SparkSession, folder: str) -> DataFrame:
    found = T.carried(nodes(spark, folder), T.nearest_of("article")).where("near IS NOT NULL")
    return found.select(F.col("id").alias("paragraph_id"), F.col("near.id").alias("article_id"), F.col("near.distance").alias("distance"))


@query("outline_labels", CTE + f"SELECT o.id AS paragraph_id, o.type, {LABEL} AS label FROM (SELECT *, CASE WHEN ordinal <= 26 THEN chr(96 + ordinal::INTEGER) WHEN ordinal <= 702 THEN chr(96 + ((ordinal - 1) // 26)::INTEGER) || chr(97 + ((ordinal - 1) % 26)::INTEGER) ELSE chr(97 + ((ordinal - 703) // 676)::INTEGER) || chr(97 + ((ordinal - 703) // 26 % 26)::INTEGER) || chr(97 + ((ordinal - 703) % 26)::INTEGER) END AS l FROM o) AS o")
def outline_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = T.ordinals(nodes(spark, folder))
    return rows.select(F.col("id").alias("paragraph_id"), "type", T.label(F.col("type"), F.col("ordinal")).alias("label"))


@query("structural_addresses", CTE + "SELECT id AS paragraph_id, address FROM t")
def structural_addresses(spark: SparkSession, folder: str) -> DataFrame:
    return T.carried(T.ordinals(nodes(spark, folder)), T.address()).select(F.col("id").alias("paragraph_id"), "address")


@query("part_ordinals", CTE + ", f AS (SELECT id, row_number() OVER (PARTITION BY spec ORDER BY position, id) AS part_no FROM n WHERE parent IS NULL AND type = 'part' AND NOT vanish) SELECT n.spec, f.part_no::INTEGER AS part_no, count(*) AS n_nodes FROM t JOIN f ON f.id = t.root_id JOIN n ON n.id = t.id GROUP BY ALL")
def part_ordinals(spark: SparkSession, folder: str) -> DataFrame:
    rows = nodes(spark, folder)
    parts = rows.where("parent IS NULL AND type = 'part' AND NOT vanish").select(F.col("id").alias("root_id"), F.row_number().over(Window.partitionBy("spec").orderBy("position", "id")).alias("part_no"))
    counted = T.carried(rows, T.own("spec")).groupBy("root_id", "spec").agg(F.count("*").alias("_n"))
    return counted.join(parts, "root_id").groupBy("spec", "part_no").agg(F.sum("_n").alias("n_nodes"))


@query("spec_fingerprints", CTE + "SELECT n.spec, count(*) FILTER (n.type = 'part') AS n_parts, max(t.depth) AS max_depth, count(*) FILTER (n.type = 'note' AND NOT n.vanish) AS note_leaks, count(*) FILTER (n.type = 'article') AS n_articles, sum(length(coalesce(n.text, '')))::BIGINT AS content_chars FROM n JOIN t USING (id) GROUP BY n.spec")
def spec_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    rows = T.carried(nodes(spark, folder), T.own("spec"), T.own("type"), T.own("vanish"), T.own("n_chars"))
    return rows.groupBy("spec").agg(
        F.count_if(F.col("type") == "part").alias("n_parts"), F.max("depth").alias("max_depth"), F.count_if((F.col("type") == "note") & ~F.col("vanish")).alias("note_leaks"), F.count_if(F.col("type") == "article").alias("n_articles"), F.sum("n_chars").alias("content_chars")
    )


@query("tree_audit", CTE + """SELECT spec, CASE WHEN n_parts = 0 THEN 'no_parts' WHEN n_parts <> 3 THEN 'unusual_part_count' END AS finding, n_parts FROM (SELECT n.spec, count(*) FILTER (n.type = 'part') AS n_parts FROM n GROUP BY n.spec) WHERE n_parts <> 3
UNION ALL SELECT n.spec, 'root_not_a_part', count(*) FROM n JOIN t USING (id) WHERE t.depth = 0 AND n.type <> 'part' AND NOT n.vanish GROUP BY n.spec""")
def tree_audit(spark: SparkSession, folder: str) -> DataFrame:
    rows = nodes(spark, folder)
    parts = rows.groupBy("spec").agg(F.count_if(F.col("type") == "part").alias("n_parts")).where("n_parts <> 3")
    counted = parts.select("spec", F.when(F.col("n_parts") == 0, "no_parts").otherwise("unusual_part_count").alias("finding"), "n_parts")
    present = rows.select(F.col("id").alias("parent")).distinct()
    roots = rows.where("type <> 'part' AND NOT vanish").join(present, "parent", "left_anti")
    stray = roots.groupBy("spec").agg(F.count("*").alias("n_parts")).select("spec", F.lit("root_not_a_part").alias("finding"), "n_parts")
    return counted.unionByName(stray)


@query("rendered_specs", CTE + """, m AS (SELECT n.spec, t.sort_key, CASE n.type WHEN 'part' THEN '# ' WHEN 'article' THEN '## ' WHEN 'note' THEN '> ' ELSE repeat('  ', greatest(t.depth - 2, 0)) || '- ' END || trim(regexp_replace(coalesce(n.text, ''), '\\s+', ' ', 'g')) AS line FROM n JOIN t USING (id) WHERE NOT t.gone)
SELECT spec, md5(string_agg(line, chr(10) ORDER BY sort_key)) AS markdown_hash, count(*) AS n_lines FROM m GROUP BY spec""")
def rendered_specs(spark: SparkSession, folder: str) -> DataFrame:
    return rendered(spark, folder).select("spec", F.md5("markdown").alias("markdown_hash"), "n_lines")


def rendered(spark: SparkSession, folder: str) -> DataFrame:
    """Each spec's visible tree as Markdown. A spec's lines meet in one row: the row is the rendered document."""
    from strataflow.functions.text import collapse

    rows = nodes(spark, folder)
    lead = F.when(F.col("type") == "part", "# ").when(F.col("type") == "article", "## ").when(F.col("type") == "note", "> ").otherwise(F.concat(F.repeat(F.lit("  "), F.greatest(F.col("depth") - 2, F.lit(0))), F.lit("- ")))
    places = T.carried(rows, T.gone(), T.preorder()).where("NOT gone").select("id", "depth", "sort_key")
    lines = rows.join(places, "id")
    lines = lines.select("spec", F.struct("sort_key", F.concat(lead, collapse(F.coalesce("text", F.lit("")))).alias("line")).alias("l"))
    return lines.groupBy("spec").agg(F.array_sort(F.collect_list("l")).alias("ls"), F.count("*").alias("n_lines")).select("spec", F.array_join(F.col("ls.line"), "\n").alias("markdown"), "n_lines")
