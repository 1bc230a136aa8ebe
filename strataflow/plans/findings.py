"""Queries of findings, search and page layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strataflow.functions import text as X
from strataflow.operators import findings as N, search as S
from strataflow.plans.registry import query
from strataflow.plans.relations import CTE as SPECS, references, specs
from strataflow.plans.scalars import STEM_SQL
from strataflow.sources.tables import table

_STOP = ", ".join(f"'{w}'" for w in N.STOP_WORDS)
_P = "p AS (SELECT DISTINCT lower(paragraph_id) AS paragraph_id, lower(spec_id) AS spec_id, spec_section AS section, node_type, text FROM paragraphs)"


def _words(source: str, columns: str) -> str:
    return f"SELECT DISTINCT {columns}, stem AS keyword FROM (SELECT {columns}, {STEM_SQL} AS stem FROM (SELECT {columns}, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS t FROM {source}) WHERE length(t) >= 4 AND t NOT IN ({_STOP})) WHERE length(stem) >= 4 AND stem NOT IN ({_STOP})"


_TITLES = f"""w AS ({_words("(SELECT section_number AS section, title AS text FROM spec_sections)", "section")}), k AS (SELECT keyword FROM w GROUP BY keyword HAVING count(DISTINCT section) <= 2), v AS (SELECT w.* FROM w JOIN k USING (keyword)),
tk AS (SELECT v.section, v.keyword, c.n_keywords FROM v JOIN (SELECT section, count(*) AS n_keywords FROM v GROUP BY section) c USING (section))"""


def rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "paragraphs").select(F.lower("paragraph_id").alias("paragraph_id"), F.lower("spec_id").alias("spec_id"), F.col("spec_section").alias("section"), "node_type", "text").distinct()


@query("title_keywords", f"WITH {_TITLES} SELECT * FROM tk")
def title_keywords(spark: SparkSession, folder: str) -> DataFrame:
    return N.title_keywords(table(spark, folder, "spec_sections"))


@query("implied_sections", f"""{SPECS}, {_P}, {_TITLES}, pw AS ({_words("(SELECT * FROM p WHERE node_type NOT IN ('part', 'article'))", "spec_id, section, paragraph_id")}),
h AS (SELECT pw.spec_id, pw.paragraph_id, tk.section, count(*) AS n, min(pw.keyword) AS matched_keyword, min(n_keywords) AS nk FROM pw JOIN tk USING (keyword) WHERE pw.section <> tk.section GROUP BY ALL HAVING count(*) >= least(2, min(n_keywords))),
u AS (SELECT h.* FROM h WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.source_spec_id = h.spec_id AND r.target_section = h.section)), m AS (SELECT *, row_number() OVER (PARTITION BY spec_id, section ORDER BY paragraph_id) AS k FROM u)
SELECT spec_id, section AS implied_section, paragraph_id, matched_keyword, round(least(0.92, 0.72 + (n - 1) * 0.08)::DOUBLE, 2) AS confidence FROM m WHERE k = 1""")
def implied_sections(spark: SparkSession, folder: str) -> DataFrame:
    known = references(spark, folder).where("target_section IS NOT NULL").select(F.col("source_spec_id").alias("spec_id"), F.col("target_section").alias("section")).distinct()
    return N.implied_sections(rows(spark, folder).where("node_type NOT IN ('part', 'article')"), N.title_keywords(table(spark, folder, "spec_sections")), known)


RULES = [("vague", "as required", "as required"), ("vague", "or equal", "or equal"), ("unenforceable", "if necessary", "if (?:it is )?necessary"), ("tense", "shall be", "shall be"), ("party", "the Owner", "the owner"), ("hedge", "unless otherwise", "unless otherwise")]
_TERMS = " UNION ALL ".join(f"SELECT paragraph_id, '{c}' AS category, '{t}' AS term, regexp_extract(text, '(?i)\\b({p})\\b', 1) AS matched FROM p" for c, t, p in RULES)


@query("term_findings", f"WITH {_P} SELECT * FROM ({_TERMS}) WHERE matched <> ''")
def term_findings(spark: SparkSession, folder: str) -> DataFrame:
    return N.term_findings(rows(spark, folder).select("paragraph_id", "text"), RULES)


PHRASES = ["final payment", "basis of design", "shop drawings"]


@query("missing_phrases", f"WITH {_P} " + " UNION ALL ".join(f"SELECT spec_id, '{x}' AS phrase FROM p GROUP BY spec_id HAVING NOT max(coalesce(contains(lower(text), '{x}'), FALSE))" for x in PHRASES))
def missing_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return N.missing_phrases(rows(spark, folder), PHRASES)


@query("rule_layers", "WITH r AS (SELECT lower(trim(title)) AS term, CASE WHEN project_id IS NOT NULL THEN 2 ELSE 1 END AS layer, section FROM specs WHERE title IS NOT NULL) SELECT term, max(layer) AS layer, max(section) FILTER (layer = ml) AS section FROM (SELECT *, max(layer) OVER (PARTITION BY term) AS ml FROM r) GROUP BY term")
def rule_layers(spark: SparkSession, folder: str) -> DataFrame:
    """Of entries with the same term the one of the most specific layer: a project's before a library's."""
    rules = table(spark, folder, "specs").where("title IS NOT NULL").select(F.lower(F.trim("title")).alias("term"), F.when(F.col("project_id").isNotNull(), 2).otherwise(1).alias("layer"), "section")
    return N.most_specific(rules, ["term"], "layer")


@query("duplicated_articles", f"""{SPECS}, {_P}, a AS (SELECT p.paragraph_id, p.spec_id, p.section, s.owner, upper(trim(regexp_replace(trim(p.text), '\\s+', ' ', 'g'))) AS title FROM p JOIN s ON s.spec_id = p.spec_id WHERE p.node_type = 'article' AND trim(p.text) <> '')
SELECT t.paragraph_id, count(*) AS n_authorities, min(g.paragraph_id) AS first_authority FROM a t JOIN a g ON g.owner = t.owner AND g.title = t.title WHERE substr(t.section, 1, 2) NOT IN ('00', '01') AND substr(g.section, 1, 2) IN ('00', '01') GROUP BY t.paragraph_id""")
def duplicated_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Articles of technical specs whose title stands in a general spec of the same owner. The general side is aggregated first, so a frequent title makes one row."""
    articles = rows(spark, folder).where("node_type = 'article' AND trim(text) <> ''").join(specs(spark, folder).select("spec_id", "owner"), "spec_id").withColumn("title", X.article_title(F.col("text")))
    general = F.substring("section", 1, 2).isin("00", "01")
    authority = articles.where(general).groupBy("owner", "title").agg(F.count("*").alias("n_authorities"), F.min("paragraph_id").alias("first_authority"))
    return articles.where(~general).join(authority, ["owner", "title"]).select("paragraph_id", "n_authorities", "first_authority")


@query("open_comments", """WITH p AS (SELECT DISTINCT paragraph_id, lower(spec_id) AS spec_id, comments FROM paragraphs), c AS (SELECT spec_id, paragraph_id, unnest(comments) AS c FROM p)
SELECT spec_id, count(*) AS n_total, count(*) FILTER (NOT (coalesce(c.closed, FALSE) OR coalesce(regexp_matches(c.text, '(?i)\\bclosed\\.?\\s*$'), FALSE))) AS n_open FROM c GROUP BY spec_id""")
def open_comments(spark: SparkSession, folder: str) -> DataFrame:
    comments = table(spark, folder, "paragraphs").select("paragraph_id", F.lower("spec_id").alias("spec_id"), "comments").distinct().select("spec_id", F.explode("comments").alias("c"))
    closed = F.coalesce("c.closed", F.lit(False)) | F.coalesce(F.col("c.text").rlike(r"(?i)\bclosed\.?\s*$"), F.lit(False))
    return comments.groupBy("spec_id").agg(F.count("*").alias("n_total"), F.count_if(~closed).alias("n_open"))


@query("readiness", """WITH p AS (SELECT DISTINCT paragraph_id, lower(spec_id) AS spec_id, node_type, vanish, acknowledged, text, comments FROM paragraphs)
SELECT spec_id, count(*) FILTER (node_type = 'note' AND NOT coalesce(vanish, FALSE) AND NOT coalesce(acknowledged, FALSE)) AS n_notes, count(*) FILTER (NOT coalesce(vanish, FALSE) AND coalesce(trim(text), '') = '') AS n_blank,
count(*) FILTER (NOT coalesce(vanish, FALSE) AND len([c for c in comments if NOT coalesce(c.closed, FALSE)]) > 0) AS n_commented FROM p GROUP BY spec_id""")
def readiness(spark: SparkSession, folder: str) -> DataFrame:
    """Per spec what keeps it from being final: notes in sight, blank paragraphs, paragraphs with open comments."""
    found = table(spark, folder, "paragraphs").select("paragraph_id", F.lower("spec_id").alias("spec_id"), "node_type", F.coalesce("vanish", F.lit(False)).alias("hidden"), "acknowledged", "text", "comments").distinct()
    seen = ~F.col("hidden")
    has_open = F.coalesce(F.exists("comments", lambda c: ~F.coalesce(c["closed"], F.lit(False))), F.lit(False))
    return found.groupBy("spec_id").agg(F.count_if((F.col("node_type") == "note") & seen & ~F.coalesce("acknowledged", F.lit(False))).alias("n_notes"), F.count_if(seen & (F.coalesce(F.trim("text"), F.lit("")) == "")).alias("n_blank"), F.count_if(seen & has_open).alias("n_commented"))


@query("search_top", f"""WITH {_P}, t AS (SELECT paragraph_id, section, text, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS t FROM p WHERE lower(text) LIKE '%drain%' AND lower(text) LIKE '%membrane%'), w AS (SELECT paragraph_id, section, {STEM_SQL} AS stem FROM t)
SELECT paragraph_id, section, count(*) AS n_hits FROM w WHERE stem IN ('drain', 'membrane') GROUP BY ALL HAVING count(DISTINCT stem) = 2 ORDER BY n_hits DESC, section, paragraph_id LIMIT 20""".replace("count(*) AS n_hits", "count(*)::INTEGER AS n_hits"))
def search_top(spark: SparkSession, folder: str) -> DataFrame:
    return S.counted(rows(spark, folder), "drains membrane").select("paragraph_id", "section", "n_hits")


@query("search_either", f"""WITH {_P}, t AS (SELECT paragraph_id, section, text, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS t FROM p WHERE lower(text) LIKE '%gasket%' OR lower(text) LIKE '%membrane%'), w AS (SELECT paragraph_id, section, {STEM_SQL} AS stem FROM t)
SELECT paragraph_id, section, count(*) AS n_hits FROM w WHERE stem IN ('gasket', 'membrane') GROUP BY ALL ORDER BY n_hits DESC, section, paragraph_id LIMIT 20""".replace("count(*) AS n_hits", "count(*)::INTEGER AS n_hits"))
def search_either(spark: SparkSession, folder: str) -> DataFrame:
    return S.counted(rows(spark, folder), "gaskets or membrane").select("paragraph_id", "section", "n_hits")


@query("search_covers")
def search_covers(spark: SparkSession, folder: str) -> DataFrame:
    return S.cover_ranked(rows(spark, folder), '"basis of design" sealant -chapel')


@query("pdf_lines", """WITH i AS (SELECT DISTINCT * FROM pdf_items), l AS (SELECT *, CASE WHEN lag(y) OVER w IS NULL OR abs(lag(y) OVER w - y) > 3 THEN 1 ELSE 0 END AS starts FROM i WINDOW w AS (PARTITION BY extraction_id, page_number ORDER BY y DESC, x, item_no)),
g AS (SELECT *, sum(starts) OVER (PARTITION BY extraction_id, page_number ORDER BY y DESC, x, item_no) AS line_no FROM l)
SELECT extraction_id, page_number, line_no::INTEGER AS line_no, count(*) AS n_items, string_agg(coalesce(str, ''), ' ' ORDER BY x, item_no) AS line FROM g GROUP BY extraction_id, page_number, line_no""")
def pdf_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of each page from its positioned items: a new line where the height differs by more than 3. A page's items fit one task; a line's make one row."""
    items = table(spark, folder, "pdf_items").distinct()
    order = Window.partitionBy("extraction_id", "page_number").orderBy(F.desc("y"), "x", "item_no")
    above = F.lag("y").over(order)
    lines = items.withColumn("_starts", F.when(above.isNull() | (F.abs(above - F.col("y")) > 3), 1).otherwise(0)).withColumn("line_no", F.sum("_starts").over(order).cast("int"))
    found = lines.groupBy("extraction_id", "page_number", "line_no").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list(F.struct("x", "item_no", F.coalesce("str", F.lit("")).alias("str")))).alias("s"))
    return found.select("extraction_id", "page_number", "line_no", "n_items", F.array_join(F.col("s.str"), " ").alias("line"))


@query("sparse_pages", "SELECT extraction_id, p.page_number AS page_number, length(trim(coalesce(p.text, '')))::INTEGER AS n_chars FROM (SELECT extraction_id, unnest(pages) AS p FROM pdf_extractions) WHERE length(trim(coalesce(p.text, ''))) < 600")
def sparse_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with too little text to trust their text layer."""
    pages = table(spark, folder, "pdf_extractions").select("extraction_id", F.explode("pages").alias("p"))
    length = F.length(F.trim(F.coalesce("p.text", F.lit(""))))
    return pages.where(length < 600).select("extraction_id", "p.page_number", length.alias("n_chars"))
