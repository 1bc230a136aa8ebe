"""Queries of the scalar functions and line scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strataflow.functions import sections as S, text as T
from strataflow.plans.registry import query
from strataflow.sources.tables import table

CANON = "^[0-9]{2} [0-9]{2} [0-9]{2}([.][0-9]{2}( [0-9]{2})?)?$"
_SPACES = "trim(regexp_replace({c}, '[\\s\\x{{00a0}}]+', ' ', 'g'))"


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


_LINES = "SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL"


@query("section_spellings", f"""WITH r AS (SELECT DISTINCT target_spec_section AS raw, {_SPACES.format(c='target_spec_section')} AS t FROM spec_references WHERE target_spec_section IS NOT NULL),
f AS (SELECT raw, t, CASE WHEN regexp_matches(t, '{CANON}') THEN 'canonical' WHEN regexp_matches(t, '^[0-9]{{2}}[.][0-9]{{2}}[.][0-9]{{2}}([.][0-9]{{2}}( [0-9]{{2}})?)?$') THEN 'dots'
  WHEN regexp_matches(t, '^[0-9]{{6}}([.][0-9]{{2}}( [0-9]{{2}})?)?$') THEN 'compact' WHEN regexp_matches(t, '^[0-9]{{2}} [0-9]{{4}}([.][0-9]{{2}}( [0-9]{{2}})?)?$') THEN 'spaced-compact' END AS style, regexp_replace(t, '[ .]', '', 'g') AS d FROM r)
SELECT raw, style, substr(d, 1, 2) || ' ' || substr(d, 3, 2) || ' ' || substr(d, 5, 2) || CASE WHEN length(d) > 6 THEN '.' || substr(d, 7, 2) ELSE '' END || CASE WHEN length(d) > 8 THEN ' ' || substr(d, 9, 2) ELSE '' END AS canonical,
substr(d, 1, 2) AS division FROM f""")
def section_spellings(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "spec_references").where("target_spec_section IS NOT NULL").select(F.col("target_spec_section").alias("raw")).distinct()
    canonical = S.canonical_section(F.col("raw"))
    return raw.select("raw", S.section_format(F.col("raw")).alias("style"), canonical.alias("canonical"), T.division_of(canonical).alias("division"))


@query("section_styles", r"""SELECT DISTINCT section, regexp_replace(section, '^(\d{2}) (\d{2}) (\d{2})(.*)$', '\1.\2.\3\4') AS dots, regexp_replace(section, '^(\d{2}) (\d{2}) (\d{2})(.*)$', '\1\2\3\4') AS compact,
regexp_replace(section, '^(\d{2}) (\d{2}) (\d{2})(.*)$', '\1 \2\3\4') AS spaced_compact FROM specs""")
def section_styles(spark: SparkSession, folder: str) -> DataFrame:
    styles = {"dots": "dots", "compact": "compact", "spaced_compact": "spaced-compact"}
    return table(spark, folder, "specs").select("section").distinct().select("section", *[S.format_section(F.col("section"), v).alias(k) for k, v in styles.items()])


@query("section_mentions", r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(text, '[\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]', ' ', 'g'), '[0-9]{3,}', '#', 'g'), '(?:^|[^0-9.])([0-9]{2}[\s\x{00a0}]+[0-9]{2}[\s\x{00a0}]+[0-9]{2}(?:\.[0-9]{2}(?:[ \t\x{00a0}]+[0-9]{2}\b)?)?)', 1)) AS raw FROM documents),
d AS (SELECT doc_id, regexp_replace(raw, '[\s.\x{00a0}]', '', 'g') AS d FROM t) SELECT doc_id, substr(d, 1, 2) || ' ' || substr(d, 3, 2) || ' ' || substr(d, 5, 2) || CASE WHEN length(d) > 6 THEN '.' || substr(d, 7, 2) ELSE '' END || CASE WHEN length(d) > 8 THEN ' ' || substr(d, 9, 2) ELSE '' END AS section, count(*) AS n_mentions FROM d GROUP BY ALL""")
def section_mentions(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "documents").select("doc_id", F.explode(S.section_numbers_in(F.col("text"))).alias("section"))
    return found.groupBy("doc_id", "section").agg(F.count("*").alias("n_mentions"))


_DASH = "(?:\\s*[-–—]\\s*(.+))?"
_STRONG = "((?:[0-9]{2}\\s+[0-9]{2}\\s+[0-9]{2}|[0-9]{2}\\s+[0-9]{4}|[0-9]{2}[.][0-9]{2}[.][0-9]{2}|[0-9]{6})(?:[.][0-9]{2}(?:[ \\t]+[0-9]{2})?)?)"


@query("text_section_meta", f"""WITH l AS ({_LINES}), k AS (SELECT doc_id, trim(line) AS t, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM l WHERE trim(line) <> ''),
m AS (SELECT doc_id, n, CASE WHEN regexp_matches(t, 'SECTION\\s+{_STRONG}([^0-9]|$)', 'i') THEN regexp_extract(t, 'SECTION\\s+{_STRONG}', 1, 'i') ELSE regexp_extract(t, '^([0-9]{{2}}\\s+[0-9]{{2}}\\s+[0-9]{{2}}(?:[.][0-9]{{2}}(?:[ \\t]+[0-9]{{2}})?)?)', 1) END AS raw,
 CASE WHEN regexp_matches(t, 'SECTION\\s+{_STRONG}([^0-9]|$)', 'i') THEN regexp_extract(t, 'SECTION\\s+{_STRONG}{_DASH}', 2, 'i') ELSE regexp_extract(t, '^([0-9]{{2}}\\s+[0-9]{{2}}\\s+[0-9]{{2}}(?:[.][0-9]{{2}}(?:[ \\t]+[0-9]{{2}})?)?){_DASH}', 2) END AS title FROM k WHERE n <= 10 AND (regexp_matches(t, 'SECTION\\s+{_STRONG}([^0-9]|$)', 'i') OR regexp_matches(t, '^[0-9]{{2}}\\s+[0-9]{{2}}\\s+[0-9]{{2}}([^0-9]|$)'))),
f AS (SELECT doc_id, arg_min(regexp_replace(raw, '[\\s.]', '', 'g'), n) AS d, arg_min(title, n) AS title FROM m GROUP BY doc_id)
SELECT doc_id, substr(d, 1, 2) || ' ' || substr(d, 3, 2) || ' ' || substr(d, 5, 2) || CASE WHEN length(d) > 6 THEN '.' || substr(d, 7, 2) ELSE '' END || CASE WHEN length(d) > 8 THEN ' ' || substr(d, 9, 2) ELSE '' END AS section, CASE WHEN trim(title) = '' THEN 'unknown' ELSE trim(title) END AS title FROM f""")
def text_section_meta(spark: SparkSession, folder: str) -> DataFrame:
    """Section and title of each text: the first of its first ten lines that aren't blank which is a section heading (SECTION and a number in any spelling, or a number at the
    line's begin); the title follows the dash on the same line, else it is unknown. One row, no shuffle."""
    lines = F.transform(F.slice(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), 1, 10), lambda x: F.trim(x))
    texts = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.transform(lines, S.section_heading).alias("found"))
    first = texts.select("doc_id", F.get(F.filter("found", lambda x: x.isNotNull()), F.lit(0)).alias("m")).where("m IS NOT NULL")
    return first.select("doc_id", "m.section", "m.title")


@query("line_classes", f"""WITH l AS ({_LINES}) SELECT kind, level, count(*) AS n_lines, sum(length(body)) AS n_chars FROM (SELECT
CASE WHEN regexp_matches(t, '^SECTION\\s+[0-9]') THEN 'header' WHEN regexp_matches(t, '^PART\\s+[0-9]+') THEN 'part' WHEN regexp_matches(t, '^[0-9]+\\.[0-9]+\\s') THEN 'article' WHEN regexp_matches(t, '^[A-Z]\\.\\s') THEN 'pr1'
 WHEN regexp_matches(t, '^[0-9]+\\.\\s') THEN 'pr2' WHEN regexp_matches(t, '^[a-z]\\.\\s') THEN 'pr3' WHEN regexp_matches(t, '^[0-9]+\\)\\s') THEN 'pr4' WHEN regexp_matches(t, '^[a-z]\\)\\s') THEN 'pr5' ELSE 'continuation' END AS kind,
CASE WHEN regexp_matches(t, '^SECTION\\s+[0-9]') THEN 0 WHEN regexp_matches(t, '^PART\\s+[0-9]+') THEN 1 WHEN regexp_matches(t, '^[0-9]+\\.[0-9]+\\s') THEN 2 WHEN regexp_matches(t, '^[A-Z]\\.\\s') THEN 3
 WHEN regexp_matches(t, '^[0-9]+\\.\\s') THEN 4 WHEN regexp_matches(t, '^[a-z]\\.\\s') THEN 5 WHEN regexp_matches(t, '^[0-9]+\\)\\s') THEN 6 WHEN regexp_matches(t, '^[a-z]\\)\\s') THEN 7 END AS level,
regexp_replace(t, '^([0-9]+\\.[0-9]+\\s+|[A-Za-z][.)]\\s+|[0-9]+[.)]\\s+)', '') AS body FROM (SELECT trim(line) AS t FROM l)) GROUP BY ALL""".replace("sum(length(body))", "sum(length(body))::BIGINT"))
def line_classes(spark: SparkSession, folder: str) -> DataFrame:
    lines = _lines(spark, folder).select(T.line_class(F.col("line")).alias("c"), F.length(T.line_body(F.col("line"))).alias("n"))
    return lines.groupBy("c.kind", "c.level").agg(F.count("*").alias("n_lines"), F.sum("n").alias("n_chars"))


_TITLE = "upper(trim(regexp_replace(trim(text), '\\s+', ' ', 'g')))"
_ROLES = " ".join(f"WHEN {_TITLE} IN ({', '.join(repr(t) for t in titles)}) THEN '{role}'" for role, titles in T.ARTICLE_ROLES.items())


@query("article_titles", f"SELECT {_TITLE} AS title, CASE {_ROLES} END AS role, count(DISTINCT paragraph_id) AS n_articles FROM paragraphs WHERE node_type = 'article' AND text IS NOT NULL GROUP BY ALL")
def article_titles(spark: SparkSession, folder: str) -> DataFrame:
    articles = table(spark, folder, "paragraphs").where("node_type = 'article' AND text IS NOT NULL")
    return articles.groupBy(T.article_title(F.col("text")).alias("title"), T.article_role(F.col("text")).alias("role")).agg(F.countDistinct("paragraph_id").alias("n_articles"))


@query("title_keys", """SELECT DISTINCT title, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS title_key, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS collapsed FROM specs WHERE title IS NOT NULL""")
def title_keys(spark: SparkSession, folder: str) -> DataFrame:
    titles = table(spark, folder, "specs").where("title IS NOT NULL").select("title").distinct()
    return titles.select("title", T.normalized_key(F.col("title")).alias("title_key"), T.collapse(F.col("title")).alias("collapsed"))


@query("plain_markup", """SELECT doc_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&'), '[ \\t\\r\\n]+', ' ', 'g')) AS plain,
replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped, sha256(text) AS content_hash FROM documents""")
def plain_markup(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", T.strip_tags(F.col("text")).alias("plain"), T.escape_markup(F.col("text")).alias("escaped"), F.sha2("text", 256).alias("content_hash"))


@query("citations", """SELECT upper(regexp_extract(trim(standard_code), '^(\\S+)\\s', 1)) AS org, trim(regexp_extract(trim(standard_code), '^\\S+\\s+(.*)$', 1)) AS code, count(DISTINCT ref_id) AS n_refs, count(DISTINCT lower(source_spec_id)) AS n_specs
FROM spec_references WHERE target_type = 'standard' GROUP BY ALL""")
def citations(spark: SparkSession, folder: str) -> DataFrame:
    refs = table(spark, folder, "spec_references").where("target_type = 'standard'")
    return refs.groupBy(T.citation_org(F.col("standard_code")).alias("org"), T.citation_code(F.col("standard_code")).alias("code")).agg(F.countDistinct("ref_id").alias("n_refs"), F.countDistinct(F.lower("source_spec_id")).alias("n_specs"))


@query("snippets", """SELECT paragraph_id, CASE WHEN length(text) <= 160 THEN text ELSE CASE WHEN greatest(pos - 60, 1) > 1 THEN '…' ELSE '' END || substr(text, greatest(pos - 60, 1), pos + 68 - greatest(pos - 60, 1)) || CASE WHEN pos + 67 < length(text) THEN '…' ELSE '' END END AS snippet
FROM (SELECT DISTINCT paragraph_id, text, strpos(lower(text), 'membrane') AS pos FROM paragraphs WHERE lower(text) LIKE '%membrane%')""")
def snippets(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "paragraphs").where(F.lower("text").contains("membrane")).select("paragraph_id", "text").distinct()
    return found.select("paragraph_id", T.snippet(F.col("text"), "membrane").alias("snippet"))


_STEM = """CASE WHEN t LIKE '%ing' AND length(t) > 6 THEN regexp_replace(substr(t, 1, length(t) - 3), '(bb|cc|dd|ff|gg|hh|jj|kk|ll|mm|nn|pp|qq|rr|ss|tt|vv|ww|xx|yy|zz|00|11|22|33|44|55|66|77|88|99)$', '#')
WHEN t LIKE '%ied' AND length(t) > 5 THEN substr(t, 1, length(t) - 3) || 'y' WHEN t LIKE '%ed' AND length(t) > 5 THEN regexp_replace(substr(t, 1, length(t) - 2), '(bb|cc|dd|ff|gg|hh|jj|kk|ll|mm|nn|pp|qq|rr|ss|tt|vv|ww|xx|yy|zz|00|11|22|33|44|55|66|77|88|99)$', '#')
WHEN t LIKE '%ies' AND length(t) > 5 THEN substr(t, 1, length(t) - 3) || 'y' WHEN t LIKE '%es' AND length(t) > 4 THEN substr(t, 1, length(t) - 2) WHEN t LIKE '%s' AND length(t) > 4 THEN substr(t, 1, length(t) - 1) ELSE t END"""
STEM_SQL = f"(CASE WHEN {_STEM} LIKE '%#' THEN CASE WHEN t LIKE '%ing' THEN substr(t, 1, length(t) - 4) ELSE substr(t, 1, length(t) - 3) END ELSE {_STEM} END)"


@query("title_stems", f"""SELECT stem, count(DISTINCT section_number) AS n_sections FROM (SELECT section_number, {STEM_SQL} AS stem FROM (SELECT section_number, unnest(regexp_split_to_array(lower(title), '[^a-z0-9]+')) AS t FROM spec_sections) WHERE t <> '') GROUP BY stem""")
def title_stems(spark: SparkSession, folder: str) -> DataFrame:
    words = table(spark, folder, "spec_sections").select("section_number", F.explode(T.tokens(F.col("title"))).alias("t"))
    return words.select("section_number", T.stem(F.col("t")).alias("stem")).groupBy("stem").agg(F.countDistinct("section_number").alias("n_sections"))


@query("source_previews", """SELECT doc_id, left(text, 80) AS preview, n_chars, length(text) AS code_points, regexp_matches(trim(text), '^\\*{5,}$') AS rule_row, regexp_matches(lower(text), 'closed\\.?\\s*$') AS ends_closed FROM documents""")
def source_previews(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    return table(spark, folder, "documents").select(
        "doc_id", F.substring(text, 1, 80).alias("preview"), "n_chars", F.length(text).cast("bigint").alias("code_points"), F.trim(text).rlike(r"^\*{5,}$").alias("rule_row"), F.lower(text).rlike(r"closed\.?\s*$").alias("ends_closed")
    )
