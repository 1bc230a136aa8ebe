"""Queries of edits as row sets, layered settings, note regions and classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strataflow.functions import lines as L
from strataflow.operators import inference as I
from strataflow.plans.registry import query
from strataflow.plans.relations import CTE as SPECS, specs
from strataflow.plans.scalars import _LINES, _lines
from strataflow.sources.tables import table


@query("json_facts", "SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS k, count(*) AS n_rows, count(*) FILTER (json_exists(props, '$.k')) AS n_with_key FROM events GROUP BY ALL")
def json_facts(spark: SparkSession, folder: str) -> DataFrame:
    key = F.get_json_object("props", "$.k")
    return table(spark, folder, "events").groupBy("event_type", (key.cast("int") % 10).alias("k")).agg(F.count("*").alias("n_rows"), F.count_if(key.isNotNull()).alias("n_with_key"))


@query("division_candidates", """WITH c AS (SELECT division, section_number, title, CASE WHEN regexp_matches(title, '(?i)\\b(general|common|service|interior)\\b') THEN 0 ELSE 1 END AS tier FROM spec_sections),
k AS (SELECT *, row_number() OVER (PARTITION BY division ORDER BY tier, section_number) AS rank FROM c) SELECT division, section_number, CASE tier WHEN 0 THEN 'medium' ELSE 'low' END AS confidence, rank::INTEGER AS rank FROM k WHERE rank <= 10""")
def division_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best candidates for each division's general section: by title, then by number. The ten are the report's size."""
    tier = F.when(F.col("title").rlike(r"(?i)\b(general|common|service|interior)\b"), 0).otherwise(1)
    ranked = table(spark, folder, "spec_sections").withColumn("tier", tier).withColumn("rank", F.row_number().over(Window.partitionBy("division").orderBy("tier", "section_number")))
    return ranked.where("rank <= 10").select("division", "section_number", F.when(F.col("tier") == 0, "medium").otherwise("low").alias("confidence"), "rank")


@query("section_rewrites", r"""SELECT doc_id, regexp_replace(text, '(?i)\b(section) ([0-9]{2}) ([0-9]{2}) ([0-9]{2})\b', '\1 \2.\3.\4', 'g') AS text FROM documents WHERE regexp_matches(text, '(?i)\bsection [0-9]{2} [0-9]{2} [0-9]{2}\b')""")
def section_rewrites(spark: SparkSession, folder: str) -> DataFrame:
    pattern = r"(?i)\b(section) ([0-9]{2}) ([0-9]{2}) ([0-9]{2})\b"
    return table(spark, folder, "documents").where(F.col("text").rlike(pattern)).select("doc_id", F.regexp_replace("text", pattern, "$1 $2.$3.$4").alias("text"))


@query("choice_tokens", r"""SELECT doc_id, count(*) AS n_tokens, count(DISTINCT token) AS n_options FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\[<]([^\[\]<>\n]{1,60})[\]>]', 1)) AS token FROM documents) WHERE NOT regexp_matches(token, '(?i)^section [0-9]{2} [0-9]{2} [0-9]{2}') GROUP BY doc_id""")
def choice_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Bracketed options in prose, section numbers in brackets aside."""
    found = table(spark, folder, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[\[<]([^\[\]<>\n]{1,60})[\]>]"), F.lit(1))).alias("token"))
    return found.where(~F.col("token").rlike(r"(?i)^section [0-9]{2} [0-9]{2} [0-9]{2}")).groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.countDistinct("token").alias("n_options"))


@query("note_regions", f"""WITH l AS ({_LINES}), r AS (SELECT *, regexp_matches(trim(line), '^[A-Z][A-Z ,-]{{7,}}$') AS rule, coalesce(length(trim(line)) >= 4 AND regexp_matches(trim(line), '^([0-9]+([.][0-9]+){{0,8}}[.]?|[A-Z][.]|[a-z][.)]|[0-9]+[)])\\s') AND regexp_matches(trim(line), '^([0-9]+([.][0-9]+){{1,8}}\\s+|[A-Z][.]\\s|[0-9]+[.]\\s|[a-z][.]\\s|[0-9]+[)]\\s|[a-z][)]\\s)'), FALSE) AS typed FROM l),
s AS (SELECT *, sum(rule::INTEGER) OVER (PARTITION BY doc_id ORDER BY line_no) % 2 = 1 AND NOT rule AS inside FROM r), d AS (SELECT *, bool_or(inside AND typed) OVER (PARTITION BY doc_id) AS drifted FROM s)
SELECT doc_id, count(*) FILTER (rule AND NOT drifted) AS n_rules, count(*) FILTER (inside AND NOT drifted) AS n_inside, bool_or(drifted) AS drifted FROM d GROUP BY doc_id HAVING count(*) FILTER (rule) > 0""")
def note_regions(spark: SparkSession, folder: str) -> DataFrame:
    """Regions between lines of capitals, which stand here for the rows of asterisks that the texts lack; a typed label inside one proves that the pairs have drifted."""
    rule = F.trim("line").rlike(r"^[A-Z][A-Z ,-]{7,}$")
    lines = _lines(spark, folder).withColumn("_is_rule", rule)
    roles = I.note_roles(lines, "doc_id", "line_no", F.col("_is_rule"), F.lit(False), L.text_signal(F.col("line")) >= 1)
    counted = roles.groupBy("doc_id").agg(F.count_if(F.col("role") == "rule").alias("n_rules"), F.count_if(F.col("role") == "note").alias("n_inside"), F.count_if("_is_rule").alias("_n")).where("_n > 0")
    return counted.select("doc_id", "n_rules", "n_inside", (F.col("n_rules") == 0).alias("drifted"))


@query("editability", """WITH p AS (SELECT DISTINCT paragraph_id, node_type, text, comments FROM paragraphs), c AS (SELECT paragraph_id, CASE WHEN node_type = 'note' THEN 'note' WHEN len([x for x in comments if NOT coalesce(x.closed, FALSE)]) > 0 THEN 'comment' WHEN regexp_matches(text, '[\\[<][^\\[\\]<>]+[\\]>]') THEN 'choice' ELSE 'default' END AS rung FROM p)
SELECT rung, count(*) AS n_paragraphs, CASE rung WHEN 'note' THEN 1.0 WHEN 'comment' THEN 0.9 WHEN 'choice' THEN 0.85 ELSE 0.3 END::DOUBLE AS confidence FROM c GROUP BY rung""")
def editability(spark: SparkSession, folder: str) -> DataFrame:
    """What decides whether a paragraph may be edited: note, open comment, choice, else the default, in this order."""
    rows = table(spark, folder, "paragraphs").select("paragraph_id", "node_type", "text", "comments").distinct()
    commented = F.coalesce(F.exists("comments", lambda x: ~F.coalesce(x["closed"], F.lit(False))), F.lit(False))
    rung = F.when(F.col("node_type") == "note", "note").when(commented, "comment").when(F.col("text").rlike(r"[\[<][^\[\]<>]+[\]>]"), "choice").otherwise("default")
    counts = rows.groupBy(rung.alias("rung")).agg(F.count("*").alias("n_paragraphs"))
    return counts.withColumn("confidence", F.when(F.col("rung") == "note", 1.0).when(F.col("rung") == "comment", 0.9).when(F.col("rung") == "choice", 0.85).otherwise(0.3))


@query("layered_settings", SPECS + "SELECT owner, arg_max(title, struct_pack(a := created_at, b := spec_id)) FILTER (title IS NOT NULL) AS title, arg_max(source, struct_pack(a := created_at, b := spec_id)) FILTER (source IS NOT NULL) AS source, max(content_version) AS content_version FROM s GROUP BY owner")
def layered_settings(spark: SparkSession, folder: str) -> DataFrame:
    """Each field from the latest layer that sets it."""
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("created_at", "spec_id", c))).getField(c).alias(c)
    return specs(spark, folder).groupBy("owner").agg(last("title"), last("source"), F.max("content_version").alias("content_version"))


@query("scope_counts", "SELECT lower(library_id) AS library_id, lower(project_id) AS project_id, count(DISTINCT lower(spec_id)) AS n_specs, count(DISTINCT section) AS n_sections FROM specs GROUP BY 1, 2")
def scope_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Null is a scope value like any other."""
    return table(spark, folder, "specs").groupBy(F.lower("library_id").alias("library_id"), F.lower("project_id").alias("project_id")).agg(F.countDistinct(F.lower("spec_id")).alias("n_specs"), F.countDistinct("section").alias("n_sections"))


@query("changed_specs", SPECS + """, p AS (SELECT DISTINCT lower(spec_id) AS spec, lower(coalesce(origin_paragraph_id, paragraph_id)) AS anchor, md5(coalesce(text, '')) AS h FROM paragraphs), f AS (SELECT spec, md5(string_agg(anchor || h, '' ORDER BY anchor, h)) AS fingerprint FROM p GROUP BY spec)
SELECT s.spec_id, s.parent_spec_id, g.fingerprint IS NULL AS parent_missing, f.fingerprint IS DISTINCT FROM g.fingerprint AS differs FROM s LEFT JOIN f ON f.spec = s.spec_id LEFT JOIN f AS g ON g.spec = s.parent_spec_id WHERE s.parent_spec_id IS NOT NULL""")
def changed_specs(spark: SparkSession, folder: str) -> DataFrame:
    """Derived specs whose content differs from their parent's: one fingerprint per spec. A spec's paragraphs are reduced to hashes before they meet."""
    rows = table(spark, folder, "paragraphs").select(F.lower("spec_id").alias("spec"), F.lower(F.coalesce("origin_paragraph_id", "paragraph_id")).alias("anchor"), F.md5(F.coalesce("text", F.lit(""))).alias("h")).distinct()
    prints = rows.groupBy("spec").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("anchor", "h"))), lambda x: F.concat(x["anchor"], x["h"])), "")).alias("fingerprint"))
    own = prints.select(F.col("spec").alias("spec_id"), F.col("fingerprint").alias("_own"))
    parent = prints.select(F.col("spec").alias("parent_spec_id"), F.col("fingerprint").alias("_parent"))
    joined = specs(spark, folder).where("parent_spec_id IS NOT NULL").join(own, "spec_id", "left").join(parent, "parent_spec_id", "left")
    return joined.select("spec_id", "parent_spec_id", F.col("_parent").isNull().alias("parent_missing"), (~F.col("_own").eqNullSafe(F.col("_parent"))).alias("differs"))


@query("inserted_siblings", """WITH p AS (SELECT DISTINCT lower(paragraph_id) AS id, lower(parent_id) AS parent, sibling_position AS position FROM paragraphs WHERE parent_id IS NOT NULL), a AS (SELECT lower(after_uuid) AS anchor, count(DISTINCT lower(uuid)) AS n FROM added_paragraphs WHERE after_uuid IS NOT NULL GROUP BY 1),
b AS (SELECT p.*, coalesce(a.n, 0) AS n FROM p LEFT JOIN a ON a.anchor = p.id) SELECT id, parent, position, (position + sum(n) OVER (PARTITION BY parent ORDER BY position, id) - n)::INTEGER AS shifted FROM b""")
def inserted_siblings(spark: SparkSession, folder: str) -> DataFrame:
    """Positions after all accepted additions are put behind their anchors: each sibling moves by the additions before it."""
    rows = table(spark, folder, "paragraphs").where("parent_id IS NOT NULL").select(F.lower("paragraph_id").alias("id"), F.lower("parent_id").alias("parent"), F.col("sibling_position").alias("position")).distinct()
    added = table(spark, folder, "added_paragraphs").where("after_uuid IS NOT NULL").groupBy(F.lower("after_uuid").alias("id")).agg(F.countDistinct(F.lower("uuid")).alias("n"))
    rows = rows.join(added, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    order = Window.partitionBy("parent").orderBy("position", "id")
    return rows.select("id", "parent", "position", (F.col("position") + F.sum("n").over(order) - F.col("n")).cast("int").alias("shifted"))


@query("ordered_union", SPECS + "SELECT section, arg_min(spec_id, struct_pack(a := created_at, b := spec_id)) AS first_spec, count(*) AS n_specs FROM s GROUP BY section")
def ordered_union(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of all specs, each with the one it occurs in first."""
    return specs(spark, folder).groupBy("section").agg(F.min(F.struct("created_at", "spec_id")).alias("f"), F.count("*").alias("n_specs")).select("section", F.col("f.spec_id").alias("first_spec"), "n_specs")


@query("keynote_lines", SPECS + "SELECT section || chr(9) || coalesce(title, '') || chr(9) || substr(section, 1, 2) AS line FROM (SELECT section, arg_min(title, struct_pack(a := title IS NULL, b := created_at, c := spec_id)) AS title FROM s WHERE withdrawn_at IS NULL GROUP BY section)")
def keynote_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A tab-delimited export, one line a section."""
    best = specs(spark, folder).where("withdrawn_at IS NULL").groupBy("section").agg(F.min(F.struct(F.col("title").isNull().alias("none"), "created_at", "spec_id", "title")).alias("t"))
    return best.select(F.concat_ws("\t", "section", F.coalesce("t.title", F.lit("")), F.substring("section", 1, 2)).alias("line"))


@query("typed_labels", """WITH p AS (SELECT DISTINCT lower(paragraph_id) AS id, lower(spec_id) AS spec, coalesce(lower(parent_id), '') AS parent, node_type, text, sibling_position AS position FROM paragraphs), o AS (SELECT *, row_number() OVER (PARTITION BY spec, parent, node_type ORDER BY position, id) AS n FROM p)
SELECT node_type, regexp_extract(text, '^\\(?([0-9]+|[A-Za-z])[.)] ', 1) <> '' AS typed, count(*) AS n_paragraphs, count(*) FILTER (regexp_extract(text, '^\\(?([0-9]+)[.)] ', 1) = n::VARCHAR) AS n_equal FROM o WHERE text IS NOT NULL GROUP BY ALL""")
def typed_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels typed into texts, and how many equal the computed ordinal (only those may be stripped)."""
    rows = table(spark, folder, "paragraphs").select(F.lower("paragraph_id").alias("id"), F.lower("spec_id").alias("spec"), F.coalesce(F.lower("parent_id"), F.lit("")).alias("parent"), "node_type", "text", F.col("sibling_position").alias("position")).distinct()
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("spec", "parent", "node_type").orderBy("position", "id"))).where("text IS NOT NULL")
    typed = F.regexp_extract("text", r"^\(?([0-9]+|[A-Za-z])[.)] ", 1) != ""
    equal = F.regexp_extract("text", r"^\(?([0-9]+)[.)] ", 1) == F.col("n").cast("string")
    return rows.groupBy("node_type", typed.alias("typed")).agg(F.count("*").alias("n_paragraphs"), F.count_if(equal).alias("n_equal"))
