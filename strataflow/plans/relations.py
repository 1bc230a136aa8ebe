"""Queries of joins, choices and roll-ups over specs and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strataflow.operators import relations as R
from strataflow.plans.general import section_sql
from strataflow.plans.registry import query
from strataflow.sources.tables import table

#: SQL of the cleaned tables.
CTE = f"""WITH s AS (SELECT DISTINCT lower(spec_id) AS spec_id, {section_sql('section')} AS section, title, source, lower(library_id) AS library_id, lower(project_id) AS project_id, coalesce('L' || lower(library_id), 'P' || lower(project_id)) AS owner,
 lower(parent_spec_id) AS parent_spec_id, origin_version, content_version, withdrawn_at, created_at FROM specs),
r AS (SELECT DISTINCT ref_id, lower(source_spec_id) AS source_spec_id, lower(source_paragraph_id) AS source_paragraph_id, target_type, {section_sql('target_spec_section')} AS target_section, lower(target_spec_id) AS target_spec_id, standard_code, reference_text, is_broken, created_at FROM spec_references)
"""
RESOLVED = CTE + """, c AS (SELECT owner, section, arg_min(spec_id, struct_pack(a := created_at, b := spec_id)) AS resolved_spec_id FROM s WHERE withdrawn_at IS NULL AND owner IS NOT NULL GROUP BY owner, section),
x AS (SELECT r.ref_id, r.source_spec_id, s.owner, r.target_section, c.resolved_spec_id FROM r JOIN s ON s.spec_id = r.source_spec_id LEFT JOIN c ON c.owner = s.owner AND c.section = r.target_section WHERE r.target_section IS NOT NULL)
"""
DISCIPLINES = [("general", "00", "01"), ("architectural", "02", "14"), ("mechanical", "21", "25"), ("electrical", "26", "28"), ("civil", "31", "35"), ("structural", "03", "05")]


def specs(spark: SparkSession, folder: str) -> DataFrame:
    return R.clean_specs(table(spark, folder, "specs"))


def references(spark: SparkSession, folder: str) -> DataFrame:
    return R.clean_references(table(spark, folder, "spec_references"))


@query("spec_node_counts", CTE + ", p AS (SELECT lower(spec_id) AS spec_id, count(DISTINCT paragraph_id) AS n FROM paragraphs GROUP BY 1) SELECT s.spec_id, s.section, coalesce(p.n, 0) AS n_paragraphs FROM s LEFT JOIN p USING (spec_id) WHERE s.withdrawn_at IS NULL")
def spec_node_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = table(spark, folder, "paragraphs").groupBy(F.lower("spec_id").alias("spec_id")).agg(F.countDistinct("paragraph_id").alias("n"))
    live = specs(spark, folder).where("withdrawn_at IS NULL").select("spec_id", "section")
    return live.join(counts, "spec_id", "left").select("spec_id", "section", F.coalesce("n", F.lit(0)).alias("n_paragraphs"))


@query("sections_in_database", CTE + "SELECT c.section_number, c.title, c.division, s.spec_id, s.spec_id IS NOT NULL AS in_database FROM spec_sections c LEFT JOIN s ON s.section = c.section_number")
def sections_in_database(spark: SparkSession, folder: str) -> DataFrame:
    return R.sections_in_use(table(spark, folder, "spec_sections"), specs(spark, folder))


@query("inbound_refs", CTE + "SELECT target_section, count(*) AS n_refs, count(DISTINCT source_spec_id) AS n_specs, min((created_at AT TIME ZONE 'UTC')::DATE) AS first_on FROM r WHERE target_section IS NOT NULL GROUP BY target_section")
def inbound_refs(spark: SparkSession, folder: str) -> DataFrame:
    refs = references(spark, folder).where("target_section IS NOT NULL")
    return refs.groupBy("target_section").agg(F.count("*").alias("n_refs"), F.countDistinct("source_spec_id").alias("n_specs"), F.min(F.to_date("created_at")).alias("first_on"))


@query("outbound_refs", CTE + "SELECT r.ref_id, s.spec_id, s.section, r.target_type, coalesce(r.target_section, r.standard_code) AS target FROM r JOIN s ON s.spec_id = r.source_spec_id")
def outbound_refs(spark: SparkSession, folder: str) -> DataFrame:
    joined = references(spark, folder).join(specs(spark, folder).select("spec_id", "section"), F.col("source_spec_id") == F.col("spec_id"))
    return joined.select("ref_id", "spec_id", "section", "target_type", F.coalesce("target_section", "standard_code").alias("target"))


@query("resolved_refs", RESOLVED + "SELECT * FROM x")
def resolved_refs(spark: SparkSession, folder: str) -> DataFrame:
    return R.resolve_sections(references(spark, folder), specs(spark, folder))


@query("broken_refs", RESOLVED + """, h AS (SELECT section, count(*) AS n_holders, min(owner) AS first_holder FROM (SELECT DISTINCT section, owner FROM s WHERE withdrawn_at IS NULL) GROUP BY section)
SELECT x.ref_id, x.source_spec_id, x.target_section, coalesce(h.n_holders, 0) AS n_holders, h.first_holder FROM x LEFT JOIN h ON h.section = x.target_section WHERE x.resolved_spec_id IS NULL""")
def broken_refs(spark: SparkSession, folder: str) -> DataFrame:
    return R.broken_references(references(spark, folder), specs(spark, folder))


@query("stale_flags", RESOLVED + "SELECT is_broken, x.resolved_spec_id IS NULL AS unresolved, r.target_spec_id IS NOT DISTINCT FROM x.resolved_spec_id AS same_target, count(*) AS n_refs FROM x JOIN r USING (ref_id) GROUP BY ALL")
def stale_flags(spark: SparkSession, folder: str) -> DataFrame:
    refs = references(spark, folder)
    joined = R.resolve_sections(refs, specs(spark, folder)).join(refs.select("ref_id", "is_broken", "target_spec_id"), "ref_id")
    return joined.groupBy("is_broken", F.col("resolved_spec_id").isNull().alias("unresolved"), F.col("target_spec_id").eqNullSafe(F.col("resolved_spec_id")).alias("same_target")).agg(F.count("*").alias("n_refs"))


@query("reference_graph_edges", CTE + "SELECT source_spec_id, target_section, count(*) AS n_refs, count(DISTINCT source_paragraph_id) AS n_anchors FROM r WHERE target_section IS NOT NULL AND source_spec_id IS NOT NULL GROUP BY ALL")
def reference_graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    return R.reference_edges(references(spark, folder))


@query("section_winners", CTE + """SELECT section, arg_min(owner, struct_pack(a := owner, b := created_at, c := spec_id)) AS owner, arg_min(spec_id, struct_pack(a := owner, b := created_at, c := spec_id)) AS spec_id, count(DISTINCT owner) - 1 AS n_shadowed
FROM s WHERE withdrawn_at IS NULL AND owner IS NOT NULL GROUP BY section""")
def section_winners(spark: SparkSession, folder: str) -> DataFrame:
    return R.winning_specs(specs(spark, folder))


@query("titles_by_priority", CTE + "SELECT section, title, source, spec_id FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY CASE source WHEN 'docx' THEN 0 WHEN 'sec' THEN 1 WHEN 'pdf' THEN 2 ELSE 3 END, created_at, spec_id) AS k FROM s WHERE title IS NOT NULL) WHERE k = 1")
def titles_by_priority(spark: SparkSession, folder: str) -> DataFrame:
    rank = F.when(F.col("source") == "docx", 0).when(F.col("source") == "sec", 1).when(F.col("source") == "pdf", 2).otherwise(3)
    return R.first_by(specs(spark, folder).where("title IS NOT NULL"), ["section"], [rank, F.col("created_at"), F.col("spec_id")]).select("section", "title", "source", "spec_id")


@query("spec_lineage", CTE + "SELECT s.spec_id, s.parent_spec_id, s.origin_version, p.content_version AS parent_version, p.content_version - s.origin_version AS behind_by, coalesce(s.library_id, p.library_id) AS ownership FROM s LEFT JOIN s AS p ON p.spec_id = s.parent_spec_id WHERE s.parent_spec_id IS NOT NULL")
def spec_lineage(spark: SparkSession, folder: str) -> DataFrame:
    return R.lineage(specs(spark, folder))


_RANGES = " ".join(f"WHEN division BETWEEN '{a}' AND '{b}' THEN '{n}'" for n, a, b in sorted(DISCIPLINES, key=lambda r: (r[1], r[0])))


@query("discipline_ranges", f"SELECT section_number, CASE {_RANGES} END AS discipline FROM spec_sections")
def discipline_ranges(spark: SparkSession, folder: str) -> DataFrame:
    return R.in_ranges(table(spark, folder, "spec_sections"), "division", DISCIPLINES, "discipline").select("section_number", "discipline")


@query("required_vs_present", CTE + """, q AS (SELECT DISTINCT s.owner, r.target_section AS section FROM r JOIN s ON s.spec_id = r.source_spec_id WHERE r.target_section IS NOT NULL), p AS (SELECT DISTINCT owner, section FROM s WHERE withdrawn_at IS NULL)
SELECT owner, section, 'required_not_present' AS finding FROM (SELECT * FROM q EXCEPT SELECT * FROM p) UNION ALL SELECT owner, section, 'present_not_required' FROM (SELECT * FROM p EXCEPT SELECT * FROM q)""")
def required_vs_present(spark: SparkSession, folder: str) -> DataFrame:
    """Sections that an owner's references require and it lacks, and those it has that none requires: one full outer join."""
    all_specs = specs(spark, folder)
    sources = all_specs.select(F.col("spec_id").alias("source_spec_id"), "owner")
    required = references(spark, folder).where("target_section IS NOT NULL").join(sources, "source_spec_id").select("owner", F.col("target_section").alias("section"), F.lit(1).alias("required")).distinct()
    present = all_specs.where("withdrawn_at IS NULL").select("owner", "section", F.lit(1).alias("present")).distinct()
    both = required.join(present, ["owner", "section"], "full").where("required IS NULL OR present IS NULL")
    return both.select("owner", "section", F.when(F.col("present").isNull(), "required_not_present").otherwise("present_not_required").alias("finding"))


@query("umbrella_callouts", CTE + """SELECT s.spec_id, s.section FROM s WHERE withdrawn_at IS NULL AND substr(section, 3) <> ' 00 00' AND NOT EXISTS (SELECT 1 FROM r WHERE r.source_spec_id = s.spec_id AND r.target_section = substr(s.section, 1, 2) || ' 00 00')""")
def umbrella_callouts(spark: SparkSession, folder: str) -> DataFrame:
    """Specs without a reference to the general section of their division: an anti join on the pair."""
    calls = references(spark, folder).where(F.col("target_section").rlike("^[0-9]{2} 00 00$")).select(F.col("source_spec_id").alias("spec_id"), F.col("target_section").alias("umbrella")).distinct()
    rows = specs(spark, folder).where("withdrawn_at IS NULL").where(~F.col("section").endswith(" 00 00")).withColumn("umbrella", F.concat(F.substring("section", 1, 2), F.lit(" 00 00")))
    return rows.join(calls, ["spec_id", "umbrella"], "left_anti").select("spec_id", "section")


@query("standards_rollup", """WITH c AS (SELECT DISTINCT ref_id, lower(source_spec_id) AS spec, lower(source_paragraph_id) AS anchor, upper(regexp_extract(trim(standard_code), '^(\\S+)\\s', 1)) AS org, trim(regexp_extract(trim(standard_code), '^\\S+\\s+(.*)$', 1)) AS code FROM spec_references WHERE target_type = 'standard' AND standard_code IS NOT NULL),
k AS (SELECT org, regexp_extract(code, '^([0-9]+)', 1) AS number, max(code) AS newest FROM c GROUP BY ALL)
SELECT c.org, c.code, count(*) AS n_citations, count(DISTINCT spec) AS n_specs, count(DISTINCT anchor) AS n_anchors, least(count(DISTINCT anchor), 50) AS n_shown, count(DISTINCT anchor) > 50 AS truncated, k.newest, c.code <> k.newest AS superseded
FROM c JOIN k ON k.org = c.org AND k.number = regexp_extract(c.code, '^([0-9]+)', 1) GROUP BY ALL""")
def standards_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Citations of each standard with the newest edition of its number; the register of editions is an aggregate of the citations."""
    from strataflow.functions import text as T

    refs = table(spark, folder, "spec_references").where("target_type = 'standard' AND standard_code IS NOT NULL")
    cited = refs.select("ref_id", F.lower("source_spec_id").alias("spec"), F.lower("source_paragraph_id").alias("anchor"), T.citation_org(F.col("standard_code")).alias("org"), T.citation_code(F.col("standard_code")).alias("code")).distinct()
    number = F.regexp_extract("code", "^([0-9]+)", 1)
    rolled = cited.groupBy("org", "code").agg(F.count("*").alias("n_citations"), F.countDistinct("spec").alias("n_specs"), F.countDistinct("anchor").alias("_anchors")).withColumn("number", number)
    newest = rolled.groupBy("org", "number").agg(F.max("code").alias("newest"))
    return rolled.join(newest, ["org", "number"]).select("org", "code", "n_citations", "n_specs", F.col("_anchors").alias("n_anchors"), F.least("_anchors", F.lit(50)).alias("n_shown"), (F.col("_anchors") > 50).alias("truncated"), "newest", (F.col("code") != F.col("newest")).alias("superseded"))


@query("latest_boundary", CTE + "SELECT owner, arg_max(spec_id, struct_pack(a := content_version, b := created_at, c := spec_id)) AS spec_id, max(content_version) AS content_version FROM s GROUP BY owner")
def latest_boundary(spark: SparkSession, folder: str) -> DataFrame:
    top = specs(spark, folder).groupBy("owner").agg(F.max(F.struct("content_version", "created_at", "spec_id")).alias("t"))
    return top.select("owner", "t.spec_id", "t.content_version")


@query("cloned_tree", """WITH p AS (SELECT DISTINCT lower(paragraph_id) AS id, lower(spec_id) AS spec, lower(parent_id) AS parent, sibling_position FROM paragraphs)
SELECT md5('copy|' || p.id) AS new_id, CASE WHEN m.id IS NOT NULL THEN md5('copy|' || m.id) END AS new_parent_id, p.id AS origin_paragraph_id, p.sibling_position FROM p LEFT JOIN p AS m ON m.id = p.parent AND m.spec = p.spec""")
def cloned_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Copies of all paragraphs under new ids; a parent outside the copied spec becomes null."""
    rows = table(spark, folder, "paragraphs").select(F.lower("paragraph_id").alias("id"), F.lower("spec_id").alias("spec"), F.lower("parent_id").alias("parent"), "sibling_position").distinct()
    new = lambda c: F.md5(F.concat(F.lit("copy|"), c))
    known = rows.select(F.col("id").alias("parent"), "spec", F.lit(True).alias("_known"))
    return rows.join(known, ["parent", "spec"], "left").select(new(F.col("id")).alias("new_id"), F.when(F.col("_known"), new(F.col("parent"))).alias("new_parent_id"), F.col("id").alias("origin_paragraph_id"), "sibling_position")


@query("mark_broken", RESOLVED + "SELECT r.ref_id, r.is_broken AS was_broken, CASE WHEN r.target_type = 'section' AND r.target_section IS NOT NULL THEN x.resolved_spec_id IS NULL ELSE FALSE END AS is_broken, x.resolved_spec_id AS target_spec_id FROM r LEFT JOIN x USING (ref_id)")
def mark_broken(spark: SparkSession, folder: str) -> DataFrame:
    """The references as an update would leave them: targets resolved anew, the flag set where a section finds none."""
    refs = references(spark, folder)
    resolved = R.resolve_sections(refs, specs(spark, folder)).select("ref_id", "resolved_spec_id", F.lit(True).alias("_judged"))
    rows = refs.join(resolved, "ref_id", "left")
    broken = F.when((F.col("target_type") == "section") & F.col("target_section").isNotNull(), F.col("resolved_spec_id").isNull()).otherwise(False)
    return rows.select("ref_id", F.col("is_broken").alias("was_broken"), broken.alias("is_broken"), F.col("resolved_spec_id").alias("target_spec_id"))
