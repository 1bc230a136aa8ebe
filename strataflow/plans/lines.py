"""Queries of what lines, names and patterns look like. The SQL has its own literal rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strataflow.functions import lines as L, text as T
from strataflow.operators import relations as R
from strataflow.plans.registry import query
from strataflow.plans.relations import CTE
from strataflow.sources.tables import table

_LINES = "SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL"


def lines_of(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text IS NOT NULL").select(F.explode(F.split("text", "\n")).alias("line"))


_DEPTHS = " ".join(f"WHEN regexp_matches(t, '^[0-9]+([.][0-9]+){{{n}}}\\s+') THEN {n}" for n in (8, 7, 6, 5, 4, 3, 2, 1))


@query("outline_signals", f"""WITH l AS (SELECT trim(line) AS t FROM ({_LINES})), s AS (SELECT CASE WHEN length(t) < 4 THEN NULL WHEN regexp_matches(t, '^part\\s+[0-9]+', 'i') THEN 0 WHEN regexp_matches(t, '^[0-9]+[.]0+[\\s.:—–-]+(general|products|execution)\\b', 'i') THEN 0 {_DEPTHS}
WHEN regexp_matches(t, '^[A-Z][.]\\s') THEN 2 WHEN regexp_matches(t, '^[0-9]+[.]\\s') THEN 3 WHEN regexp_matches(t, '^[a-z][.]\\s') THEN 4 WHEN regexp_matches(t, '^[0-9]+[)]\\s') THEN 5 WHEN regexp_matches(t, '^[a-z][)]\\s') THEN 6 END AS level FROM l)
SELECT level, CASE level WHEN 0 THEN 'part' WHEN 1 THEN 'article' WHEN 2 THEN 'pr1' WHEN 3 THEN 'pr2' WHEN 4 THEN 'pr3' WHEN 5 THEN 'pr4' WHEN 6 THEN 'pr5' WHEN 7 THEN 'pr6' WHEN 8 THEN 'pr7' END AS kind,
CASE WHEN level IS NULL THEN NULL WHEN level < 1 THEN 'part' WHEN level = 1 THEN 'article' WHEN level = 2 THEN 'paragraph' ELSE 'subparagraph' END AS tier, count(*) AS n_lines FROM s GROUP BY ALL""")
def outline_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Lines by the level that their heads speak for; the level goes to its type and back."""
    found = lines_of(spark, folder).select(L.text_signal(F.col("line")).alias("signal"))
    kind = F.when(F.col("signal").isNotNull(), L.type_of(F.col("signal"), F.lit(1)))
    rows = found.select(kind.alias("kind")).select(L.level_of(F.col("kind")).alias("level"), "kind").withColumn("tier", F.when(F.col("level").isNotNull(), L.tier_of(F.col("level"), F.lit(1))))
    return rows.groupBy("level", "kind", "tier").agg(F.count("*").alias("n_lines"))


@query("indent_signals", f"""WITH l AS (SELECT length(regexp_extract(line, '^([ \\t]*)', 1)) AS blanks FROM ({_LINES})), i AS (SELECT blanks, floor(blanks * 144 / 576.0 + 0.5)::INTEGER AS g FROM l)
SELECT blanks, CASE WHEN g BETWEEN 1 AND 8 THEN g END AS level, count(*) AS n_lines FROM i GROUP BY ALL""")
def indent_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Lines by their indentation, a blank taken as 144 twips."""
    rows = lines_of(spark, folder).select(F.length(F.regexp_extract("line", "^([ \t]*)", 1)).cast("bigint").alias("blanks"))
    return rows.select("blanks", L.indent_signal(F.col("blanks") * 144).alias("level")).groupBy("blanks", "level").agg(F.count("*").alias("n_lines"))


_BANNER = r"(NOTES? TO (THE )?SPEC(IFIER|S| WRITER)?S?\b|SPEC(IFIER)?S? NOTES?\b)"


@query("note_banners", f"""WITH t AS (SELECT DISTINCT paragraph_id, node_type, text, upper(regexp_replace(text, '\\s+', ' ', 'g')) AS u FROM paragraphs WHERE text IS NOT NULL)
SELECT node_type, regexp_matches(upper(regexp_replace(regexp_replace(trim(text), '^[^A-Za-z0-9]+', ''), '\\s+', ' ', 'g')), '^{_BANNER}') AS opens, regexp_matches(u, '{_BANNER}') AS holds, regexp_matches(u, '\\bHIDDEN NOTES? TO (THE )?SPECIFIER') AS reveals,
length(trim(text)) >= 2 AND (regexp_matches(trim(text), '^[\\s*=•·—–-]{{3,}}$') OR upper(regexp_replace(trim(text), '[\\s*=•·—–\\[\\]()-]', '', 'g')) = 'OR') AS separates, count(*) AS n_paragraphs FROM t GROUP BY ALL""")
def note_banners(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    rows = table(spark, folder, "paragraphs").where("text IS NOT NULL").select("paragraph_id", "node_type", "text").distinct()
    return rows.groupBy("node_type", L.opens_note(text).alias("opens"), L.holds_note(text).alias("holds"), L.reveals_notes(text).alias("reveals"), L.separates(text).alias("separates")).agg(F.count("*").alias("n_paragraphs"))


#: Prefixes put before the texts of parts and articles, which have none of their own.
_HEADS = ("", "PART 2 - ", "2.0 ", "PART 1.1 ", "1.2.3 ")


@query("part_prefixes", "WITH t AS (SELECT DISTINCT text FROM paragraphs WHERE node_type IN ('part', 'article') AND text IS NOT NULL), h AS (SELECT h || text AS raw FROM t, (VALUES " + ", ".join(f"('{h}')" for h in _HEADS) + """) AS v(h)),
m AS (SELECT raw, CASE WHEN regexp_matches(raw, '^\\s*PART\\s+[0-9]+[\\s.:—–-]*[a-z]', 'i') THEN length(regexp_extract(raw, '^(\\s*PART\\s+[0-9]+[\\s.:—–-]*)[a-z]', 1, 'i')) WHEN regexp_matches(raw, '^\\s*[0-9]+[.]0+[\\s.:—–-]*[a-z]', 'i') THEN length(regexp_extract(raw, '^(\\s*[0-9]+[.]0+[\\s.:—–-]*)[a-z]', 1, 'i')) END AS p,
CASE WHEN regexp_matches(raw, '^\\s*[0-9]+([.][0-9]+){2,}[\\s.:—–-]*[A-Za-z]') THEN length(regexp_extract(raw, '^(\\s*[0-9]+([.][0-9]+){2,}[\\s.:—–-]*)[A-Za-z]', 1)) END AS o FROM h)
SELECT raw, trim(CASE WHEN p IS NULL THEN raw ELSE substr(raw, p + 1) END) AS name, p::INTEGER AS removed, trim(substr(raw, o + 1)) AS outline_name, o::INTEGER AS outline_removed, regexp_matches(raw, '^\\s*PART\\s+[0-9]+[.][0-9]', 'i') AS odd_number FROM m""")
def part_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    """Headings with typed prefixes, and what is left of them."""
    texts = table(spark, folder, "paragraphs").where("node_type IN ('part', 'article') AND text IS NOT NULL").select("text").distinct()
    raw = texts.select(F.explode(F.array(*[F.concat(F.lit(h), "text") for h in _HEADS])).alias("raw"))
    text = F.col("raw")
    return raw.select(
        "raw", L.without_part(text).alias("name"), L.part_stripped(text)["removed"].alias("removed"), L.outline_stripped(text)["text"].alias("outline_name"), L.outline_stripped(text)["removed"].alias("outline_removed"), L.odd_part_number(text).alias("odd_number")
    )


@query("identity_lines", CTE + """, p AS (SELECT DISTINCT lower(paragraph_id) AS paragraph_id, lower(spec_id) AS spec_id, text FROM paragraphs WHERE text IS NOT NULL), x AS (SELECT p.paragraph_id, s.section, s.title, p.text, trim(regexp_replace(regexp_replace(trim(p.text), '^section\\s+', '', 'i'), '\\s+', ' ', 'g')) AS t FROM p JOIN s USING (spec_id)),
y AS (SELECT paragraph_id, upper(trim(regexp_replace(text, '\\s+', ' ', 'g'))) = upper(trim(regexp_replace(title, '\\s+', ' ', 'g'))) AS is_title,
 regexp_matches(t, '^([0-9]{2} [0-9]{2} [0-9]{2}|[0-9]{2}[.][0-9]{2}[.][0-9]{2}|[0-9]{6}|[0-9]{2} [0-9]{4})([.][0-9]{2}( [0-9]{2})?)?$') AND regexp_replace(t, '[ .]', '', 'g') = regexp_replace(section, '[ .]', '', 'g') AS is_section FROM x)
SELECT paragraph_id, is_section, coalesce(is_title, FALSE) AS is_title FROM y WHERE is_section OR is_title""")
def identity_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs that only repeat their spec's number or title."""
    specs = R.clean_specs(table(spark, folder, "specs")).select("spec_id", "section", "title")
    rows = table(spark, folder, "paragraphs").where("text IS NOT NULL").select(F.lower("paragraph_id").alias("paragraph_id"), F.lower("spec_id").alias("spec_id"), "text").distinct().join(specs, "spec_id")
    found = rows.select("paragraph_id", L.is_section_line(F.col("text"), F.col("section")).alias("is_section"), F.coalesce(L.is_title_line(F.col("text"), F.col("title")), F.lit(False)).alias("is_title"))
    return found.where("is_section OR is_title")


_BARE = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace({c}, '\\s+', ' ', 'g')), '^[0-9]+([.][0-9]+)*\\s+', ''), '^[A-Za-z][.]\\s+', ''), '^[0-9]+[.)]\\s+', ''), '^[a-z][.)]\\s+', ''))"


@query("product_names", f"""WITH t AS (SELECT DISTINCT lower(paragraph_id) AS paragraph_id, {_BARE.format(c="text")} AS clean FROM paragraphs WHERE node_type IN ('pr1', 'pr2') AND text IS NOT NULL),
n AS (SELECT paragraph_id, strpos(clean, ':') AS colon, trim(regexp_replace(CASE WHEN strpos(clean, ':') > 1 THEN substr(clean, 1, strpos(clean, ':') - 1) ELSE clean END, '\\s+', ' ', 'g')) AS name FROM t)
SELECT paragraph_id, length(name) AS n_chars, lower({_BARE.format(c="name")}) AS product FROM n WHERE length(name) BETWEEN 1 AND 90 AND NOT regexp_matches(name, '^(provide|submit|install|coordinate|comply|conform|see|verify)\\b', 'i')
AND NOT (colon = 1 AND len(string_split(name, ' ')) > 6) AND NOT contains(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), 'product data')""")
def product_names(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "paragraphs").where("node_type IN ('pr1', 'pr2') AND text IS NOT NULL").select(F.lower("paragraph_id").alias("paragraph_id"), "text").distinct()
    clean = L.without_outline(F.col("text"))
    colon = F.locate(":", clean)
    name = T.collapse(F.when(colon > 1, F.substr(clean, F.lit(1), colon - 1)).otherwise(clean))
    return rows.select("paragraph_id", F.length(name).cast("bigint").alias("n_chars"), F.lower(L.product_name(F.col("text"))).alias("product")).where("product IS NOT NULL")


@query("submittal_types", """WITH t AS (SELECT DISTINCT lower(spec_id) AS spec_id, lower(text) AS t FROM paragraphs WHERE text IS NOT NULL AND NOT regexp_matches(text, '\\b(not required|not be required|no product data required)\\b', 'i'))
SELECT spec_id, label AS submittal_type, count(*) AS n_texts FROM t JOIN (VALUES ('Product Data', '\\bproduct data\\b'), ('Shop Drawings', '\\bshop drawings?\\b'), ('Samples', '\\bsamples?\\b'), ('Design Data', '\\bdesign data\\b'), ('Test Reports', '\\btest reports?\\b'),
('Certificates', '\\bcertificates?\\b'), ('Operation and Maintenance Data', '\\b(operation and maintenance data|o&m data)\\b')) AS k(label, pattern) ON regexp_matches(t, pattern) GROUP BY ALL""")
def submittal_types(spark: SparkSession, folder: str) -> DataFrame:
    texts = table(spark, folder, "paragraphs").where("text IS NOT NULL").select(F.lower("spec_id").alias("spec_id"), F.lower("text").alias("text")).distinct()
    return texts.select("spec_id", F.explode(L.submittal_types(F.col("text"))).alias("submittal_type")).groupBy("spec_id", "submittal_type").agg(F.count("*").alias("n_texts"))


@query("search_patterns", r"""SELECT DISTINCT title, regexp_replace(title, '([.*+?^${}()|\[\]\\])', '\\\1', 'g') AS as_pattern, '%' || replace(replace(replace(title, '\', '\\'), '%', '\%'), '_', '\_') || '%' AS as_like,
replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS as_html FROM specs WHERE title IS NOT NULL""")
def search_patterns(spark: SparkSession, folder: str) -> DataFrame:
    title = F.col("title")
    return table(spark, folder, "specs").where("title IS NOT NULL").select("title").distinct().select("title", L.escaped_pattern(title).alias("as_pattern"), L.like_pattern(title).alias("as_like"), T.escape_markup(title).alias("as_html"))


@query("upload_lines", """WITH e AS (SELECT DISTINCT extraction_id, file_name, text FROM pdf_extractions), l AS (SELECT extraction_id, unnest(string_split(text, chr(10))) AS line FROM e WHERE text IS NOT NULL),
c AS (SELECT extraction_id, count(*) FILTER (length(clean) > 0) AS n_lines, sum(length(clean))::BIGINT AS n_chars FROM (SELECT extraction_id, trim(regexp_replace(replace(line, chr(173), ''), '\\s+', ' ', 'g')) AS clean FROM l) GROUP BY extraction_id)
SELECT e.extraction_id, regexp_extract(e.file_name, '([^/\\\\:]*)$', 1) AS file_name, c.n_lines, c.n_chars FROM e JOIN c USING (extraction_id)""")
def upload_lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "pdf_extractions").where("text IS NOT NULL").select("extraction_id", "file_name", "text").distinct()
    clean = F.transform(F.split("text", "\n"), L.clean_line)
    sizes = F.transform(clean, F.length)
    return rows.select(
        "extraction_id", L.file_name(F.col("file_name")).alias("file_name"), F.size(F.filter(sizes, lambda n: n > 0)).cast("bigint").alias("n_lines"), F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, n: a + n).alias("n_chars")
    )


@query("garbled_uploads", r"""WITH e AS (SELECT DISTINCT extraction_id, text FROM pdf_extractions WHERE text IS NOT NULL), n AS (SELECT extraction_id, length(text) AS size, len(regexp_extract_all(text, '[\x{00c2}\x{00c3}\x{00e2}][\x{0080}-\x{ffff}]{1,2}|\x{fffd}')) AS wrong, len(regexp_extract_all(text, '[\x00-\x08\x0e-\x1f\x{80}-\x{9f}]')) AS control,
len(regexp_extract_all(text, '[$&=+_*<>|{}~`^\\]')) AS symbols, len(regexp_extract_all(text, '[A-Za-z]')) AS letters FROM e)
SELECT extraction_id, (wrong * 3 + control * 4 + CASE WHEN size = 0 THEN 0 ELSE floor(symbols * 12 / greatest(size, 1) + 0.5) END + CASE WHEN size = 0 OR letters / greatest(size, 1) < 0.12 THEN 4 ELSE 0 END)::INTEGER AS score FROM n""")
def garbled_uploads(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "pdf_extractions").where("text IS NOT NULL").select("extraction_id", "text").distinct()
    return rows.select("extraction_id", L.garbage_score(F.col("text")).alias("score"))


@query("checkpoint_anchors", """SELECT spec_id, anchor, CASE WHEN kind = 'checkpoint:' AND regexp_matches(spec_id, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$') THEN spec_id END AS checkpoint_id
FROM (SELECT DISTINCT spec_id, kind, kind || spec_id AS anchor FROM specs, (VALUES ('checkpoint:'), ('revision:'), ('')) AS k(kind))""")
def checkpoint_anchors(spark: SparkSession, folder: str) -> DataFrame:
    ids = table(spark, folder, "specs").select("spec_id").distinct()
    anchors = ids.select("spec_id", F.explode(F.array(*[F.concat(F.lit(k), "spec_id") for k in ("checkpoint:", "revision:", "")])).alias("anchor"))
    return anchors.select("spec_id", "anchor", L.checkpoint_id(F.col("anchor")).alias("checkpoint_id"))
