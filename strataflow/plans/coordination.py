"""Queries of reports across specs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strataflow.functions import sections as S
from strataflow.operators import coordination as C, relations as R, tree as O
from strataflow.plans import editing, findings, history, relations, trees  # noqa: F401  their queries are counted here
from strataflow.plans.registry import QUERIES, SQL, query
from strataflow.plans.relations import CTE, references, specs
from strataflow.plans.trees import CTE as TREES, nodes
from strataflow.sources.tables import table

_ROLE = "CASE WHEN upper(trim(regexp_replace({c}, '\\s+', ' ', 'g'))) IN ('RELATED SECTIONS', 'RELATED REQUIREMENTS', 'RELATED WORK', 'RELATED DOCUMENTS') THEN 'related-sections' WHEN upper(trim(regexp_replace({c}, '\\s+', ' ', 'g'))) IN ('REFERENCES', 'REFERENCE STANDARDS', 'REFERENCED STANDARDS') THEN 'references' ELSE 'other' END"
_TREE = TREES.replace("WITH RECURSIVE ", "", 1)
_BOTH = "WITH RECURSIVE " + CTE.replace("WITH ", "", 1).rstrip() + ", " + _TREE
_CLASSIFIED = _BOTH + f""", q AS (SELECT r.source_spec_id AS spec, r.target_type, CASE WHEN r.target_type = 'section' THEN r.target_section ELSE r.standard_code END AS value, r.source_paragraph_id AS p, {_ROLE.format(c="a.text")} AS role
 FROM r LEFT JOIN t ON t.id = r.source_paragraph_id LEFT JOIN n AS a ON a.id = t.article WHERE r.target_type IS NOT NULL AND r.source_spec_id IS NOT NULL),
k AS (SELECT spec, target_type, value, p, (target_type = 'section' AND role = 'related-sections') OR (target_type <> 'section' AND role = 'references') AS listed FROM q WHERE value IS NOT NULL),
g AS (SELECT spec, target_type, value, bool_or(listed) AS l, bool_or(NOT listed) AS c, min(p) AS paragraph_id FROM k GROUP BY ALL)
"""


@query("reference_consistency", _CLASSIFIED + """SELECT CASE WHEN target_type = 'section' AND l THEN 'related_listed_not_cited' WHEN target_type = 'section' THEN 'related_cited_not_listed' ELSE 'standard_cited_not_listed' END AS finding, spec AS source_spec_id, value, paragraph_id FROM g WHERE (target_type = 'section' AND l <> c) OR (target_type <> 'section' AND c AND NOT l)""")
def reference_consistency(spark: SparkSession, folder: str) -> DataFrame:
    return C.reference_findings(C.classified_references(nodes(spark, folder), references(spark, folder)))


@query("dangling_refs", SQL["broken_refs"].split("SELECT x.ref_id")[0] + """, q AS (SELECT s.owner, r.target_section FROM r JOIN s ON s.spec_id = r.source_spec_id WHERE r.target_section IS NOT NULL GROUP BY ALL HAVING count(DISTINCT r.source_spec_id) > 1)
SELECT DISTINCT x.ref_id, x.source_spec_id, x.target_section FROM x JOIN s ON s.spec_id = x.source_spec_id AND s.withdrawn_at IS NULL WHERE x.resolved_spec_id IS NULL AND NOT EXISTS (SELECT 1 FROM q WHERE q.owner = x.owner AND q.target_section = x.target_section)""")
def dangling_refs(spark: SparkSession, folder: str) -> DataFrame:
    """Broken references of live specs to sections that aren't due anyway: a section is due to an owner when two of its specs name it."""
    every, refs = specs(spark, folder), references(spark, folder)
    broken = R.resolve_sections(refs, every).where("resolved_spec_id IS NULL")
    live = every.where("withdrawn_at IS NULL").select(F.col("spec_id").alias("source_spec_id"))
    owners = every.select(F.col("spec_id").alias("source_spec_id"), "owner")
    due = refs.where("target_section IS NOT NULL").join(owners, "source_spec_id").groupBy("owner", "target_section").agg(F.countDistinct("source_spec_id").alias("_n")).where("_n > 1").select("owner", "target_section")
    return broken.join(live, "source_spec_id", "left_semi").join(due, ["owner", "target_section"], "left_anti").select("ref_id", "source_spec_id", "target_section").distinct()


_NAME = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace({c}, '\\s+', ' ', 'g')), '^[0-9]+([.][0-9]+)*\\s+', ''), '^[A-Za-z][.]\\s+', ''), '^[0-9]+[.)]\\s+', ''), '^[a-z][.)]\\s+', ''))"
_KEY = "trim(regexp_replace(lower(regexp_replace({c}, '^([0-9]+([.][0-9]+)*[.)]?|[A-Za-z][.)])\\s+', '')), '[^a-z0-9]+', ' ', 'g'))"
_SUBMITTALS = "WITH RECURSIVE " + _TREE.split("o AS (SELECT")[0] + f"""sh AS (SELECT lower(paragraph_id) AS id, max(coalesce(len(comments), 0)) AS n_sheets FROM paragraphs GROUP BY 1),
b AS (SELECT n.*, {_KEY.format(c="text")} AS key, {_NAME.format(c="text")} AS clean FROM n),
nm AS (SELECT *, trim(CASE WHEN strpos(clean, ':') > 1 THEN substr(clean, 1, strpos(clean, ':') - 1) ELSE clean END) AS pn FROM b),
v AS (SELECT *, CASE WHEN type = 'article' AND key NOT IN ('accessories', 'fabrication', 'general', 'manufacturers', 'materials', 'performance requirements', 'products', 'quality control', 'source quality control') THEN nullif(clean, '')
 WHEN type IN ('pr1', 'pr2') AND length(pn) BETWEEN 1 AND 90 AND NOT regexp_matches(pn, '^(provide|submit|install|coordinate|comply|conform|see|verify)\\b', 'i') AND NOT (strpos(clean, ':') = 1 AND len(string_split(pn, ' ')) > 6) AND NOT contains(trim(regexp_replace(lower(pn), '[^a-z0-9]+', ' ', 'g')), 'product data') THEN {_NAME.format(c="pn")} END AS name,
 upper(trim(regexp_replace(text, '\\s+', ' ', 'g'))) IN ('SUBMITTALS', 'ACTION SUBMITTALS', 'INFORMATIONAL SUBMITTALS') AS sub FROM nm),
f AS (SELECT *, row_number() OVER (PARTITION BY spec, type = 'part' AND parent IS NULL AND (contains(key, 'products') OR starts_with(key, 'part 2')) ORDER BY position, id) = 1 AND type = 'part' AND parent IS NULL AND (contains(key, 'products') OR starts_with(key, 'part 2')) AS pp,
 row_number() OVER (PARTITION BY spec, type = 'part' AND parent IS NULL AND (contains(key, 'general') OR starts_with(key, 'part 1')) ORDER BY position, id) = 1 AND type = 'part' AND parent IS NULL AND (contains(key, 'general') OR starts_with(key, 'part 1')) AS pg FROM v),
w AS (SELECT id, CASE WHEN pp THEN 'products' WHEN pg THEN 'general' END AS zone, NULL::VARCHAR AS product FROM f WHERE parent IS NULL OR parent NOT IN (SELECT id FROM n)
 UNION ALL SELECT c.id, CASE WHEN w.product IS NOT NULL THEN NULL WHEN w.zone = 'products' AND c.type = 'article' AND NOT c.vanish AND c.name IS NULL THEN 'generic' WHEN w.zone = 'general' AND c.type = 'article' AND NOT c.vanish AND coalesce(c.sub, FALSE) THEN 'submittals' WHEN w.zone = 'submittals' AND NOT c.vanish THEN 'submittals' END,
 CASE WHEN w.product IS NOT NULL THEN w.product WHEN NOT c.vanish AND c.name IS NOT NULL AND c.type IN ('article', 'pr1', 'pr2') AND (w.zone = 'products' OR (w.zone = 'generic' AND c.type <> 'article')) THEN c.id END FROM f AS c JOIN w ON c.parent = w.id),
pr AS (SELECT f.spec, w.product AS product_id, max(CASE WHEN w.id = w.product THEN f.name END) AS name, sum(sh.n_sheets)::BIGINT AS n_sheets FROM w JOIN f USING (id) JOIN sh USING (id) WHERE w.product IS NOT NULL GROUP BY ALL),
ty AS (SELECT DISTINCT f.spec, k.label AS submittal_type FROM w JOIN f USING (id) JOIN (VALUES ('Product Data', '\\bproduct data\\b'), ('Shop Drawings', '\\bshop drawings?\\b'), ('Samples', '\\bsamples?\\b'), ('Design Data', '\\bdesign data\\b'), ('Test Reports', '\\btest reports?\\b'),
 ('Certificates', '\\bcertificates?\\b'), ('Operation and Maintenance Data', '\\b(operation and maintenance data|o&m data)\\b')) AS k(label, pattern) ON regexp_matches(f.text, k.pattern, 'i') WHERE w.zone = 'submittals' AND NOT regexp_matches(f.text, '\\b(not required|not be required|no product data required)\\b', 'i')),
"""


def submittals(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The comments of a paragraph stand for the sheets attached to it, which the tables lack."""
    sheets = table(spark, folder, "paragraphs").groupBy(F.lower("paragraph_id").alias("id")).agg(F.max(F.coalesce(F.when(F.col("comments").isNotNull(), F.size("comments")), F.lit(0))).cast("bigint").alias("n_sheets"))
    return C.submittals(nodes(spark, folder).join(sheets, "id"))


@query("submittal_register", _SUBMITTALS + f"""kd AS (SELECT *, {_KEY.format(c="name")} AS product FROM pr), ask AS (SELECT product, string_agg(DISTINCT submittal_type, ', ' ORDER BY submittal_type) AS types FROM kd JOIN ty USING (spec) GROUP BY product)
SELECT product, count(*) AS n_sources, sum(n_sheets)::BIGINT AS n_sheets, coalesce(max(types), '') AS types, CASE WHEN sum(n_sheets) > 0 THEN 'present' ELSE 'missing' END AS status FROM kd LEFT JOIN ask USING (product) GROUP BY product""")
def submittal_register(spark: SparkSession, folder: str) -> DataFrame:
    return C.submittal_register(*submittals(spark, folder))


_SUBMITTAL_FINDINGS = _SUBMITTALS + """x AS (SELECT 1) SELECT 'product_without_submittal_type' AS finding, spec, product_id, NULL::VARCHAR AS submittal_type FROM pr WHERE spec NOT IN (SELECT spec FROM ty) UNION ALL SELECT 'submittal_type_without_product', spec, NULL, submittal_type FROM ty WHERE spec NOT IN (SELECT spec FROM pr)
UNION ALL SELECT 'product_missing_datasheet', spec, product_id, NULL FROM pr WHERE n_sheets = 0"""


@query("submittal_findings", _SUBMITTAL_FINDINGS)
def submittal_findings(spark: SparkSession, folder: str) -> DataFrame:
    return C.submittal_findings(*submittals(spark, folder))


@query("submittal_summary", f"SELECT finding, count(*) AS n_findings FROM ({_SUBMITTAL_FINDINGS}) GROUP BY finding")
def submittal_summary(spark: SparkSession, folder: str) -> DataFrame:
    return submittal_findings(spark, folder).groupBy("finding").agg(F.count("*").alias("n_findings"))


@query("umbrella_divisions", CTE + """, live AS (SELECT DISTINCT owner, spec_id, section FROM s WHERE withdrawn_at IS NULL AND owner IS NOT NULL AND regexp_matches(section, '^[0-9]{2} ')), c AS (SELECT DISTINCT source_spec_id AS spec_id, target_section FROM r)
SELECT owner, substr(section, 1, 2) AS division, min(CASE WHEN section = substr(section, 1, 2) || ' 00 00' THEN live.spec_id END) AS umbrella_spec_id, count(*) FILTER (substr(section, 3) <> ' 00 00' AND c.spec_id IS NULL) AS n_not_called_out
FROM live LEFT JOIN c ON c.spec_id = live.spec_id AND c.target_section = substr(section, 1, 2) || ' 00 00' GROUP BY ALL""")
def umbrella_divisions(spark: SparkSession, folder: str) -> DataFrame:
    """Each owner's divisions: the spec of the division's general section, and how many specs don't refer to it."""
    live = specs(spark, folder).where("withdrawn_at IS NULL AND owner IS NOT NULL").select("owner", "spec_id", "section").distinct().where(F.col("section").rlike("^[0-9]{2} "))
    live = live.withColumn("division", F.substring("section", 1, 2)).withColumn("umbrella", F.concat("division", F.lit(" 00 00")))
    calls = references(spark, folder).select(F.col("source_spec_id").alias("spec_id"), F.col("target_section").alias("umbrella"), F.lit(True).alias("_called")).distinct()
    rows = live.join(calls, ["spec_id", "umbrella"], "left")
    own = F.col("section") == F.col("umbrella")
    return rows.groupBy("owner", "division").agg(F.min(F.when(own, F.col("spec_id"))).alias("umbrella_spec_id"), F.count_if(~own & F.col("_called").isNull()).alias("n_not_called_out"))


_ALIGNED = CTE + """, p AS (SELECT DISTINCT lower(spec_id) AS spec_id, lower(paragraph_id) AS id, coalesce(lower(origin_paragraph_id), lower(paragraph_id)) AS origin, sibling_position AS position, text FROM paragraphs), live AS (SELECT DISTINCT spec_id, section FROM s WHERE withdrawn_at IS NULL),
w AS (SELECT l.section, p.* FROM p JOIN live l USING (spec_id))
"""


def _aligned(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "paragraphs").select(F.lower("spec_id").alias("spec_id"), F.lower("paragraph_id").alias("id"), F.coalesce(F.lower("origin_paragraph_id"), F.lower("paragraph_id")).alias("origin"), F.col("sibling_position").alias("position"), "text").distinct()
    return rows.join(specs(spark, folder).where("withdrawn_at IS NULL").select("spec_id", "section").distinct(), "spec_id")


@query("aligned_cells", _ALIGNED + """, c AS (SELECT section, origin, spec_id, arg_min(struct_pack(i := id, p := position, t := text), struct_pack(a := coalesce(position, -2147483648), b := id, c := coalesce(text, ''))) AS v FROM w GROUP BY ALL),
m AS (SELECT section, origin, count(*) AS n_present, count(DISTINCT v.t) + max(CASE WHEN v.t IS NULL THEN 1 ELSE 0 END) AS n_values FROM c GROUP BY ALL)
SELECT section, origin, spec_id, v.i AS paragraph_id, md5(v.t) AS text_hash, n_present, CASE WHEN n_present < 2 THEN 'single' WHEN n_values > 1 THEN 'differing' ELSE 'identical' END AS state FROM c JOIN m USING (section, origin)""")
def aligned_cells(spark: SparkSession, folder: str) -> DataFrame:
    """All live specs of a section side by side: the cells of their paragraphs' origins."""
    cells = C.aligned_cells(_aligned(spark, folder), "section", "spec_id", "origin", ["position", "id"], "text")
    return cells.select("section", "origin", "spec_id", F.col("id").alias("paragraph_id"), F.md5("text").alias("text_hash"), "n_present", "state")


@query("alignment_modes", _ALIGNED + "SELECT section, CASE WHEN max(n) > 1 THEN 'origin' ELSE 'structure' END AS aligned_by FROM (SELECT section, origin, count(DISTINCT spec_id) AS n FROM w GROUP BY ALL) GROUP BY section")
def alignment_modes(spark: SparkSession, folder: str) -> DataFrame:
    return C.alignment_modes(_aligned(spark, folder), "section", "spec_id", "origin")


@query("alignment_columns", _ALIGNED + """, c AS (SELECT DISTINCT section, origin, spec_id FROM w), m AS (SELECT section, origin, count(*) AS n FROM c GROUP BY ALL) SELECT section, spec_id, count(*) AS n_present, count(*) FILTER (n = 1) AS n_only_here FROM c JOIN m USING (section, origin) GROUP BY ALL""")
def alignment_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that each spec of an alignment has, and those that no other has."""
    cells = _aligned(spark, folder).select("section", "origin", "spec_id").distinct()
    alone = cells.groupBy("section", "origin").agg(F.count("*").alias("_n"))
    return cells.join(alone, ["section", "origin"]).groupBy("section", "spec_id").agg(F.count("*").alias("n_present"), F.count_if(F.col("_n") == 1).alias("n_only_here"))


@query("lineage_drift", CTE + "SELECT DISTINCT s.spec_id, s.parent_spec_id, p.content_version - s.origin_version AS behind_by FROM s JOIN s AS p ON p.spec_id = s.parent_spec_id WHERE s.withdrawn_at IS NULL AND p.content_version > s.origin_version")
def lineage_drift(spark: SparkSession, folder: str) -> DataFrame:
    """Live derived specs whose parent has moved on since they were derived."""
    every = specs(spark, folder)
    live = every.where("withdrawn_at IS NULL").select("spec_id")
    return R.lineage(every).where("behind_by > 0").join(live, "spec_id", "left_semi").select("spec_id", "parent_spec_id", "behind_by").distinct()


@query("effective_anchors", """WITH a AS (SELECT DISTINCT lower(uuid) AS uuid, lower(spec_id) AS spec_id, idx, lower(after_uuid) AS after_uuid FROM added_paragraphs), l AS (SELECT *, lag(uuid) OVER (PARTITION BY spec_id, after_uuid ORDER BY idx, uuid) AS prior FROM a)
SELECT l.uuid, l.spec_id, coalesce(prior, after_uuid) AS effective_anchor, CASE WHEN prior IS NOT NULL THEN 'sibling' WHEN after_uuid IS NULL THEN 'start' WHEN EXISTS (SELECT 1 FROM paragraphs p WHERE lower(p.paragraph_id) = after_uuid) THEN 'paragraph' WHEN EXISTS (SELECT 1 FROM a AS b WHERE b.uuid = l.after_uuid) THEN 'addition' ELSE 'unknown' END AS anchor_kind FROM l""")
def effective_anchors(spark: SparkSession, folder: str) -> DataFrame:
    """Where each accepted addition is put: after its sibling before it, a paragraph, another addition, at the start, or nowhere known."""
    added = table(spark, folder, "added_paragraphs").select(F.lower("uuid").alias("uuid"), F.lower("spec_id").alias("spec_id"), "idx", F.lower("after_uuid").alias("after_uuid")).distinct()
    known = table(spark, folder, "paragraphs").select(F.lower("paragraph_id").alias("after_uuid"), F.lit(True).alias("_paragraph")).distinct()
    others = added.select(F.col("uuid").alias("after_uuid"), F.lit(True).alias("_addition")).distinct()
    rows = C.effective_anchors(added, ["spec_id"], "idx", "uuid", "after_uuid").join(known, "after_uuid", "left").join(others, "after_uuid", "left")
    kind = F.when(F.col("after_sibling"), "sibling").when(F.col("after_uuid").isNull(), "start").when(F.col("_paragraph"), "paragraph").when(F.col("_addition"), "addition").otherwise("unknown")
    return rows.select("uuid", "spec_id", "effective_anchor", kind.alias("anchor_kind"))


_VERSIONS = """, ver AS (SELECT lower(spec_id) AS spec, lower(uuid) AS id, snapshot_no AS version, arg_max(struct_pack(t := text), struct_pack(d := delivered_at, t := coalesce(text, ''))).t AS vt FROM extract_snapshots GROUP BY ALL)
"""


@query("base_snapshots", TREES + _VERSIONS + """, b AS (SELECT lower(paragraph_id) AS id, max(base_version) AS base_version FROM paragraphs GROUP BY 1)
SELECT n.id AS paragraph_id, b.base_version, md5(coalesce(ver.vt, n.text)) AS base_hash, md5(n.text) AS current_hash FROM n JOIN t USING (id) JOIN b USING (id) LEFT JOIN ver ON ver.spec = n.spec AND ver.id = n.id AND ver.version = b.base_version WHERE NOT t.gone""")
def base_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """The base and the current text of each paragraph that isn't removed: the version of the base where one was kept, else the current text. Nodes on circles stand in no tree."""
    rows = nodes(spark, folder)
    kept = O.carried(rows, O.gone()).where("NOT gone").select("id")
    base = table(spark, folder, "paragraphs").groupBy(F.lower("paragraph_id").alias("id")).agg(F.max("base_version").alias("base_version"))
    versions = history._delivered(spark, folder).select(F.col("spec_id").alias("spec"), F.col("uuid").alias("id"), F.col("snapshot_no").alias("base_version"), F.col("text").alias("_base"))
    found = rows.join(kept, "id", "left_semi").join(base, "id").join(versions, ["spec", "id", "base_version"], "left")
    return found.select(F.col("id").alias("paragraph_id"), "base_version", F.md5(F.coalesce("_base", "text")).alias("base_hash"), F.md5("text").alias("current_hash"))


@query("origin_snapshots", CTE + """, p AS (SELECT DISTINCT lower(paragraph_id) AS id, lower(spec_id) AS spec_id, lower(origin_paragraph_id) AS origin, text FROM paragraphs)
SELECT s.spec_id, p.id AS paragraph_id, o.id AS origin_id, md5(o.text) AS origin_hash, o.text IS NOT DISTINCT FROM p.text AS unchanged FROM (SELECT DISTINCT spec_id, parent_spec_id FROM s WHERE parent_spec_id IS NOT NULL) AS s JOIN p USING (spec_id) JOIN p AS o ON o.id = p.origin AND o.spec_id = s.parent_spec_id""")
def origin_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """The parent's paragraphs under the ids of those derived from them."""
    rows = table(spark, folder, "paragraphs").select(F.lower("paragraph_id").alias("id"), F.lower("spec_id").alias("spec_id"), F.lower("origin_paragraph_id").alias("origin"), "text").distinct()
    links = specs(spark, folder).where("parent_spec_id IS NOT NULL").select("spec_id", "parent_spec_id").distinct()
    parents = rows.select(F.col("id").alias("origin"), F.col("spec_id").alias("parent_spec_id"), F.col("text").alias("_text"))
    found = rows.where("origin IS NOT NULL").join(links, "spec_id").join(parents, ["origin", "parent_spec_id"])
    return found.select("spec_id", F.col("id").alias("paragraph_id"), F.col("origin").alias("origin_id"), F.md5("_text").alias("origin_hash"), F.col("text").eqNullSafe(F.col("_text")).alias("unchanged"))


@query("cloned_refs", CTE + """, k AS (SELECT DISTINCT spec_id, parent_spec_id, owner FROM s WHERE parent_spec_id IS NOT NULL), p AS (SELECT DISTINCT lower(paragraph_id) AS id, lower(spec_id) AS spec_id, lower(origin_paragraph_id) AS origin FROM paragraphs), g AS (SELECT owner, section, min(spec_id) AS target FROM s WHERE withdrawn_at IS NULL GROUP BY ALL)
SELECT r.ref_id, k.spec_id AS clone_spec_id, p.id AS clone_paragraph_id, r.target_section, g.target AS target_spec_id, coalesce(r.target_type = 'section', FALSE) AND g.target IS NULL AS is_broken FROM r JOIN k ON k.parent_spec_id = r.source_spec_id JOIN p ON p.spec_id = k.spec_id AND p.origin = r.source_paragraph_id LEFT JOIN g ON g.owner = k.owner AND g.section = r.target_section""")
def cloned_refs(spark: SparkSession, folder: str) -> DataFrame:
    """The references of each parent as its derived specs have them: from the derived paragraphs, to the owner's own spec of the section; broken where it has none."""
    every = specs(spark, folder)
    links = every.where("parent_spec_id IS NOT NULL").select(F.col("spec_id").alias("clone_spec_id"), F.col("parent_spec_id").alias("source_spec_id"), "owner").distinct()
    copies = table(spark, folder, "paragraphs").select(F.lower("paragraph_id").alias("clone_paragraph_id"), F.lower("spec_id").alias("clone_spec_id"), F.lower("origin_paragraph_id").alias("source_paragraph_id")).distinct()
    targets = every.where("withdrawn_at IS NULL").groupBy("owner", F.col("section").alias("target_section")).agg(F.min("spec_id").alias("_target"))
    rows = references(spark, folder).drop("target_spec_id").join(links, "source_spec_id").join(copies, ["clone_spec_id", "source_paragraph_id"]).join(targets, ["owner", "target_section"], "left")
    broken = F.coalesce(F.col("target_type") == "section", F.lit(False)) & F.col("_target").isNull()
    return rows.select("ref_id", "clone_spec_id", "clone_paragraph_id", "target_section", F.col("_target").alias("target_spec_id"), broken.alias("is_broken"))


@query("restored_texts", "WITH " + _VERSIONS.strip().lstrip(",") + """, m AS (SELECT spec, min(version) + (max(version) - min(version)) // 2 AS seal FROM ver GROUP BY spec), k AS (SELECT ver.spec, ver.id, arg_max(struct_pack(t := vt, v := version), version) AS last FROM ver JOIN m ON m.spec = ver.spec AND ver.version <= m.seal GROUP BY ALL)
SELECT k.spec AS spec_id, k.id AS uuid, k.last.v AS version, md5(k.last.t) AS text_hash FROM k""")
def restored_texts(spark: SparkSession, folder: str) -> DataFrame:
    """What rejecting all changes since a checkpoint halfway through a spec's snapshots restores: each uuid's latest version up to it."""
    rows = history._delivered(spark, folder)
    seals = rows.groupBy("spec_id").agg(F.expr("min(snapshot_no) + (max(snapshot_no) - min(snapshot_no)) div 2").alias("_seal"))
    last = rows.join(seals, "spec_id").where("snapshot_no <= _seal").groupBy("spec_id", "uuid").agg(F.max(F.struct("snapshot_no", F.struct("text").alias("v"))).alias("l"))
    return last.select("spec_id", "uuid", F.col("l.snapshot_no").alias("version"), F.md5("l.v.text").alias("text_hash"))


@query("extracted_refs", """WITH p AS (SELECT DISTINCT lower(paragraph_id) AS id, text FROM paragraphs WHERE text IS NOT NULL), m AS (SELECT id, unnest(regexp_extract_all(regexp_replace(regexp_replace(text, '[\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]', ' ', 'g'), '[0-9]{3,}', '#', 'g'), '(?:^|[^0-9.])([0-9]{2}[\\s\\x{00a0}]+[0-9]{2}[\\s\\x{00a0}]+[0-9]{2}(?:\\.[0-9]{2}(?:[ \\t\\x{00a0}]+[0-9]{2}\\b)?)?)', 1)) AS raw FROM p),
d AS (SELECT id, regexp_replace(raw, '[\\s.\\x{00a0}]', '', 'g') AS d FROM m) SELECT id AS paragraph_id, substr(d, 1, 2) || ' ' || substr(d, 3, 2) || ' ' || substr(d, 5, 2) || CASE WHEN length(d) > 6 THEN '.' || substr(d, 7, 2) ELSE '' END || CASE WHEN length(d) > 8 THEN ' ' || substr(d, 9, 2) ELSE '' END AS section, count(*) AS n_mentions FROM d GROUP BY ALL""")
def extracted_refs(spark: SparkSession, folder: str) -> DataFrame:
    """Section references that the texts of paragraphs hold."""
    texts = table(spark, folder, "paragraphs").where("text IS NOT NULL").select(F.lower("paragraph_id").alias("paragraph_id"), "text").distinct()
    return texts.select("paragraph_id", F.explode(S.section_numbers_in(F.col("text"))).alias("section")).groupBy("paragraph_id", "section").agg(F.count("*").alias("n_mentions"))


_META = SQL["text_section_meta"].rsplit("SELECT doc_id, substr(d", 1)[0]


@query("inferred_sections", _META + ", g AS (SELECT doc_id, arg_min(regexp_matches(t, 'SECTION\\s+[0-9]', 'i'), k.n) AS word FROM k JOIN (SELECT doc_id, min(n) AS n FROM m GROUP BY 1) AS x USING (doc_id, n) GROUP BY doc_id) SELECT d.doc_id, f.d AS digits, CASE WHEN g.word THEN 'high' WHEN g.doc_id IS NOT NULL THEN 'medium' ELSE 'none' END AS confidence FROM documents d LEFT JOIN f USING (doc_id) LEFT JOIN g USING (doc_id)")
def inferred_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Each text's section: surely where a heading says SECTION, less so where a number opens a line, else none."""
    lines = F.transform(F.slice(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), 1, 10), lambda x: F.trim(x))
    heads = F.filter(F.transform(lines, lambda x: F.struct(S.section_heading(x)["section"].alias("section"), x.rlike(r"(?i)SECTION\s+[0-9]").alias("word"))), lambda h: h["section"].isNotNull())
    rows = table(spark, folder, "documents").select("doc_id", F.get(heads, F.lit(0)).alias("h"))
    return rows.select("doc_id", F.regexp_replace("h.section", "[ .]", "").alias("digits"), F.when(F.col("h.word"), "high").when(F.col("h").isNotNull(), "medium").otherwise("none").alias("confidence"))


@query("low_confidence", f"WITH c AS ({SQL['confidence_scores']}), s AS (SELECT DISTINCT paragraph_id, lower(spec_id) AS spec_id FROM paragraphs), j AS (SELECT DISTINCT spec_id, c.paragraph_id, confidence FROM c JOIN s USING (paragraph_id)), k AS (SELECT *, row_number() OVER (PARTITION BY spec_id ORDER BY confidence, paragraph_id) AS place FROM j WHERE confidence < 0.6) SELECT a.spec_id, a.n_scored, coalesce(b.n_below, 0) AS n_below, b.preview FROM (SELECT spec_id, count(*) AS n_scored FROM j GROUP BY spec_id) a LEFT JOIN (SELECT spec_id, count(*) AS n_below, string_agg(paragraph_id, ', ' ORDER BY place) FILTER (place <= 5) AS preview FROM k GROUP BY spec_id) b USING (spec_id)")
def low_confidence(spark: SparkSession, folder: str) -> DataFrame:
    """Scored paragraphs of each spec, how many need review, and the first five of them by confidence and id."""
    owners = table(spark, folder, "paragraphs").select("paragraph_id", F.lower("spec_id").alias("spec_id")).distinct()
    scored = history.confidence_scores(spark, folder).join(owners, "paragraph_id").select("spec_id", "paragraph_id", "confidence").distinct()
    place = F.row_number().over(Window.partitionBy("spec_id").orderBy("confidence", "paragraph_id"))
    below = scored.where("confidence < 0.6").withColumn("_place", place).groupBy("spec_id").agg(
        F.count("*").alias("n_below"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_place") <= 5, F.struct("_place", "paragraph_id")))), lambda x: x["paragraph_id"]), ", ").alias("preview")
    )
    return scored.groupBy("spec_id").agg(F.count("*").alias("n_scored")).join(below, "spec_id", "left").select("spec_id", "n_scored", F.coalesce("n_below", F.lit(0)).alias("n_below"), "preview")


@query("language_summary", f"SELECT category, count(*) AS n_findings, count(DISTINCT paragraph_id) AS n_paragraphs FROM ({SQL['term_findings']}) GROUP BY category")
def language_summary(spark: SparkSession, folder: str) -> DataFrame:
    return findings.term_findings(spark, folder).groupBy("category").agg(F.count("*").alias("n_findings"), F.countDistinct("paragraph_id").alias("n_paragraphs"))


@query("absent_votes", "WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) SELECT source, coalesce(max(CASE WHEN lang IS NULL THEN n END), 0) > coalesce(max(CASE WHEN lang IS NOT NULL THEN n END), 0) AS absent_wins, sum(n)::BIGINT AS n_votes FROM c GROUP BY source")
def absent_votes(spark: SparkSession, folder: str) -> DataFrame:
    """Whether having no value outweighs each single value."""
    counts = table(spark, folder, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    most = lambda c: F.coalesce(F.max(F.when(c, F.col("n"))), F.lit(0))
    return counts.groupBy("source").agg((most(F.col("lang").isNull()) > most(F.col("lang").isNotNull())).alias("absent_wins"), F.sum("n").alias("n_votes"))


@query("paragraph_owners", CTE + """, p AS (SELECT DISTINCT lower(paragraph_id) AS paragraph_id, lower(spec_id) AS spec_id FROM paragraphs) SELECT p.paragraph_id, p.spec_id, s.owner, s.withdrawn_at IS NOT NULL AS withdrawn, c.title AS section_title FROM p JOIN (SELECT DISTINCT spec_id, owner, withdrawn_at, section FROM s) AS s USING (spec_id) LEFT JOIN spec_sections c ON c.section_number = s.section""")
def paragraph_owners(spark: SparkSession, folder: str) -> DataFrame:
    """Each paragraph's spec, its owner, whether it is withdrawn, and the catalogue's title of its section."""
    rows = table(spark, folder, "paragraphs").select(F.lower("paragraph_id").alias("paragraph_id"), F.lower("spec_id").alias("spec_id")).distinct()
    names = table(spark, folder, "spec_sections").select(F.col("section_number").alias("section"), F.col("title").alias("section_title"))
    every = specs(spark, folder).select("spec_id", "owner", "section", F.col("withdrawn_at").isNotNull().alias("withdrawn")).distinct()
    return rows.join(every, "spec_id").join(names, "section", "left").select("paragraph_id", "spec_id", "owner", "withdrawn", "section_title")


@query("owner_lists", CTE + "SELECT CASE WHEN library_id IS NOT NULL THEN 'library' ELSE 'project' END AS kind, coalesce(library_id, project_id) AS owner_id, count(DISTINCT spec_id) AS n_specs, count(DISTINCT section) AS n_sections, count(DISTINCT spec_id) FILTER (withdrawn_at IS NULL) AS n_live FROM s WHERE owner IS NOT NULL GROUP BY ALL")
def owner_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Libraries and projects with their specs and sections."""
    rows = specs(spark, folder).where("owner IS NOT NULL")
    kind = F.when(F.col("library_id").isNotNull(), "library").otherwise("project")
    return rows.groupBy(kind.alias("kind"), F.coalesce("library_id", "project_id").alias("owner_id")).agg(F.countDistinct("spec_id").alias("n_specs"), F.countDistinct("section").alias("n_sections"), F.countDistinct(F.when(F.col("withdrawn_at").isNull(), F.col("spec_id"))).alias("n_live"))


#: The producers of the coordination report.
REPORT = ("required_vs_present", "dangling_refs", "reference_consistency", "implied_sections", "duplicated_articles", "umbrella_callouts", "submittal_findings")


@query("coordination_report", " UNION ALL ".join(f"SELECT '{name}' AS producer, count(*) AS n_findings FROM ({SQL[name]})" for name in REPORT))
def coordination_report(spark: SparkSession, folder: str) -> DataFrame:
    """The number of findings of each producer, over one reading of the tables by each."""
    rows = None
    for name in REPORT:
        counted = QUERIES[name](spark, folder).agg(F.count("*").alias("n_findings")).select(F.lit(name).alias("producer"), "n_findings")
        rows = counted if rows is None else rows.unionByName(counted)
    return rows
