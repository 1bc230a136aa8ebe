"""Queries of the DOCX writer, the reader and the inference: every spec's whole tree is written, read and inferred again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strataflow.functions import lines as L
from strataflow.operators import inference as I, tree as O
from strataflow.plans.lines import _DEPTHS
from strataflow.plans.registry import query
from strataflow.plans.trees import CTE, nodes
from strataflow.sources.docx import docx_documents, docx_facts
from strataflow.sources.tables import table

_CLEAN = "trim(regexp_replace(regexp_replace({c}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x{{fffe}}\\x{{ffff}}]', '', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))"
#: Lines as they are written: those of trees with text, in the tree's spec.
_WRITTEN = CTE + f""", sp AS (SELECT id, spec AS root_spec FROM n), l AS (SELECT t.root_id, r.root_spec AS spec, n.id, n.type, t.sort_key, n.position, n.vanish, {_CLEAN.format(c="n.text")} AS tx FROM n JOIN t USING (id) JOIN sp AS r ON r.id = t.root_id WHERE r.root_spec IS NOT NULL),
w AS (SELECT *, list_position(['part', 'article', 'pr1', 'pr2', 'pr3', 'pr4', 'pr5', 'pr6', 'pr7'], type) - 1 AS lv, coalesce(position, 0) % 2 = 0 AS direct FROM l WHERE tx <> ''),
"""


def written(spark: SparkSession, folder: str, controls: bool = False) -> DataFrame:
    """(source_id, content): each spec as a DOCX file, on demand with each paragraph but notes in a content control. Every second sibling is numbered by itself, the others by their styles; notes have a style of their own."""
    rows = nodes(spark, folder)
    extra = table(spark, folder, "paragraphs").groupBy(F.lower("paragraph_id").alias("id")).agg(F.max(F.size(F.coalesce("comments", F.expr("cast(array() AS array<struct<author: string, text: string, closed: boolean>>)")))).alias("_n"), F.max_by("comments", F.when(F.col("comments").isNotNull(), F.size("comments"))).alias("comments"))
    places = O.carried(rows, O.preorder(), O.own("vanish"), O.own("type"), O.own("position")).select("id", "root_id", F.col("sort_key").alias("key"), "vanish", "type", "position")
    roots = rows.select(F.col("id").alias("root_id"), F.col("spec").alias("source_id"), F.col("spec_section").alias("section"))
    lines = places.join(rows.select("id", "text"), "id").join(roots, "root_id").join(extra.select("id", "comments"), "id", "left").where("source_id IS NOT NULL")
    lines = lines.select("source_id", "section", "key", L.level_of(F.col("type")).alias("level"), "text", (F.coalesce("position", F.lit(0)) % 2 == 0).alias("direct"), "vanish", F.coalesce(F.col("type") == "note", F.lit(False)).alias("note"), "comments", *([F.when(F.col("type") != "note", F.col("id")).alias("id")] if controls else []))
    titles = table(spark, folder, "specs").groupBy(F.lower("spec_id").alias("source_id")).agg(F.max("title").alias("title"))
    return docx_documents(lines, titles)


_TEXT_LEVEL = f"CASE WHEN length(tx) < 4 THEN NULL WHEN regexp_matches(tx, '^part\\s+[0-9]+', 'i') THEN 0 WHEN regexp_matches(tx, '^[0-9]+[.]0+[\\s.:—–-]+(general|products|execution)\\b', 'i') THEN 0 {_DEPTHS.replace('regexp_matches(t,', 'regexp_matches(tx,')} WHEN regexp_matches(tx, '^[A-Z][.]\\s') THEN 2 WHEN regexp_matches(tx, '^[0-9]+[.]\\s') THEN 3 WHEN regexp_matches(tx, '^[a-z][.]\\s') THEN 4 WHEN regexp_matches(tx, '^[0-9]+[)]\\s') THEN 5 WHEN regexp_matches(tx, '^[a-z][)]\\s') THEN 6 END"
_INFERRED = _WRITTEN + f"""u AS (SELECT *, {_TEXT_LEVEL} AS s4, upper(regexp_replace(regexp_replace(tx, '^[^A-Za-z0-9]+', ''), '\\s+', ' ', 'g')) AS un FROM w),
v AS (SELECT *, vanish OR type = 'note' OR regexp_matches(un, '^(NOTES? TO (THE )?SPEC(IFIER|S| WRITER)?S?\\b|SPEC(IFIER)?S? NOTES?\\b)') OR regexp_matches(upper(tx), '\\bHIDDEN NOTES? TO (THE )?SPECIFIER') OR (length(tx) >= 2 AND (regexp_matches(tx, '^[\\s*=•·—–-]{{3,}}$') OR upper(regexp_replace(tx, '[\\s*=•·—–\\[\\]()-]', '', 'g')) = 'OR')) AS no FROM u),
h AS (SELECT *, CASE WHEN no THEN NULL WHEN lv IS NOT NULL THEN lv ELSE s4 END AS level, CASE WHEN no THEN 3 WHEN lv IS NOT NULL AND direct THEN 1 WHEN lv IS NOT NULL THEN 2 WHEN s4 IS NOT NULL THEN 4 ELSE 3 END AS signal FROM v),
g AS (SELECT *, CASE WHEN level IS NOT NULL AND lv >= 1 THEN 1 ELSE 0 END AS ind, CASE WHEN level IS NOT NULL AND lv IS NOT NULL AND s4 = level THEN 1 ELSE 0 END AS typed, CASE WHEN level IS NOT NULL AND lv IS NOT NULL AND s4 <> level THEN 1 ELSE 0 END AS odd FROM h)
"""


@query("docx_inference", _INFERRED + """SELECT spec AS source_id, CASE level WHEN 0 THEN 'part' WHEN 1 THEN 'article' WHEN 2 THEN 'pr1' WHEN 3 THEN 'pr2' WHEN 4 THEN 'pr3' WHEN 5 THEN 'pr4' WHEN 6 THEN 'pr5' WHEN 7 THEN 'pr6' WHEN 8 THEN 'pr7' ELSE 'continuation' END AS node_type, signal,
count(*) AS n_paragraphs, sum(length(tx))::BIGINT AS n_chars, sum(ind + typed)::BIGINT AS n_agreed, sum(odd)::BIGINT AS n_conflicts,
round(sum(CASE WHEN level IS NULL THEN 0 ELSE least(greatest(CASE signal WHEN 1 THEN 0.95 WHEN 2 THEN 0.85 WHEN 4 THEN 0.6 ELSE 0.35 END + ind * 0.35 * 0.15 + typed * 0.6 * 0.15 - odd * (0.1 + abs(coalesce(s4, 0) - level) * 0.02), 0), 1) END)::DOUBLE, 2) AS confidence FROM g GROUP BY ALL""")
def docx_inference(spark: SparkSession, folder: str) -> DataFrame:
    """What the hierarchy inferred from the written files is, by spec, type and the signal that won."""
    rows = I.inferred(docx_facts(written(spark, folder)))
    return rows.groupBy("source_id", "node_type", "signal").agg(
        F.count("*").alias("n_paragraphs"), F.sum(F.length("text")).alias("n_chars"), F.sum(F.size("agreed")).alias("n_agreed"), F.sum(F.size("conflicts")).alias("n_conflicts"), F.round(F.sum(F.coalesce("confidence", F.lit(0.0))), 2).alias("confidence")
    )


@query("docx_parts", _WRITTEN + f"""c AS (SELECT spec, count(*) AS n, sum(length({_CLEAN.format(c="x.text")})) AS k FROM (SELECT l.spec, unnest(cm) AS x FROM l JOIN (SELECT lower(paragraph_id) AS id, arg_max(comments, len(comments)) AS cm FROM paragraphs GROUP BY 1) USING (id)) WHERE x IS NOT NULL GROUP BY spec),
s AS (SELECT spec, max(section) AS section, max(title) AS title FROM (SELECT l.spec, n.spec_section AS section FROM l JOIN n ON n.id = l.root_id) LEFT JOIN (SELECT lower(spec_id) AS spec, max(title) AS title FROM specs GROUP BY 1) USING (spec) GROUP BY spec)
SELECT spec AS source_id, 'comment' AS place, n AS n_rows, coalesce(k, 0)::BIGINT AS n_chars FROM c UNION ALL SELECT spec, 'header', 1, length(trim('SECTION ' || coalesce(section, '')))::BIGINT FROM s UNION ALL SELECT spec, 'footer', 1, length({_CLEAN.format(c="title")})::BIGINT FROM s WHERE {_CLEAN.format(c="title")} <> ''
UNION ALL SELECT spec, 'property', 2, (length({_CLEAN.format(c="coalesce(title, '')")}) + length(coalesce(section, '')))::BIGINT FROM s UNION ALL SELECT spec, p.place, count(*), sum(length(tx))::BIGINT FROM w, (VALUES ('body'), ('orphan')) AS p(place) GROUP BY ALL
UNION ALL SELECT spec, 'table', 2 * count(*), sum(4 + length(coalesce(tx, '')))::BIGINT FROM l WHERE type = 'part' GROUP BY spec""")
def docx_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and characters of each place of the written files."""
    facts = docx_facts(written(spark, folder))
    return facts.groupBy("source_id", "place").agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n_chars"))


@query("docx_controls", _WRITTEN + f"""c AS (SELECT spec, type, id, tx, max(CASE WHEN type <> 'note' THEN sort_key END) OVER (PARTITION BY spec ORDER BY sort_key) AS last_key FROM (SELECT spec, type, id, sort_key, coalesce(tx, '') AS tx FROM l))
SELECT spec AS source_id, id AS uuid, 'control' AS kind, md5(tx) AS text_hash FROM c WHERE type <> 'note' UNION ALL SELECT c.spec, k.id, 'orphan', md5(c.tx) FROM c LEFT JOIN l AS k ON k.sort_key = c.last_key AND k.spec = c.spec WHERE c.type = 'note' AND c.tx <> ''""")
def docx_controls(spark: SparkSession, folder: str) -> DataFrame:
    """Returned documents: the text of each controlled paragraph, and paragraphs outside of controls with the one that they follow."""
    facts = docx_facts(written(spark, folder, controls=True)).where("place IN ('control', 'orphan')")
    return facts.select("source_id", F.col("style").alias("uuid"), F.col("place").alias("kind"), F.md5("text").alias("text_hash"))
