"""Queries of the general problems: orphan references (1), snapshot changes (6), hierarchies (7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strataflow.operators import hierarchy as H
from strataflow.operators.orphans import orphan_references, orphans_by_month
from strataflow.operators.snapshots import snapshot_changes, snapshot_intervals
from strataflow.plans.registry import query
from strataflow.sources.tables import table

_SECTION = """CASE WHEN regexp_matches({d}, '^([0-9]{{6}}|[0-9]{{8}}|[0-9]{{10}})$') THEN
  substr({d}, 1, 2) || ' ' || substr({d}, 3, 2) || ' ' || substr({d}, 5, 2)
  || CASE WHEN length({d}) >= 8 THEN '.' || substr({d}, 7, 2) ELSE '' END || CASE WHEN length({d}) = 10 THEN ' ' || substr({d}, 9, 2) ELSE '' END ELSE {c} END"""


def section_sql(column: str) -> str:
    return _SECTION.format(d=f"regexp_replace({column}, '[\\s.\\x{{00a0}}-]', '', 'g')", c=column)


_ORPHANS = f"""WITH s AS (SELECT lower(spec_id) AS sid, coalesce('L' || lower(library_id), 'P' || lower(project_id)) AS o, {section_sql("section")} AS sec, created_at AS c, withdrawn_at AS w FROM specs),
r AS (SELECT ref_id, lower(source_spec_id) AS src, {section_sql("target_spec_section")} AS sec, created_at AS t FROM spec_references),
a AS (SELECT ref_id, 'source_spec_id' AS ref_field, t FROM r WHERE src IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s WHERE s.sid = r.src AND s.c <= r.t AND (s.w IS NULL OR s.w > r.t))),
ro AS (SELECT DISTINCT r.ref_id, r.sec, r.t, s.o FROM r JOIN s ON s.sid = r.src WHERE r.sec IS NOT NULL),
b AS (SELECT ref_id, 'target_spec_section' AS ref_field, t FROM ro WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.o = ro.o AND s.sec = ro.sec AND s.c <= ro.t AND (s.w IS NULL OR s.w > ro.t))),
f AS (SELECT DISTINCT ref_id, ref_field, strftime(t AT TIME ZONE 'UTC', '%Y-%m') AS month FROM (SELECT * FROM a UNION ALL SELECT * FROM b))
"""


@query("p1_found", _ORPHANS + "SELECT DISTINCT ref_id, ref_field FROM f")
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_references(table(spark, folder, "spec_references"), table(spark, folder, "specs")).select("ref_id", "ref_field").distinct()


@query("p1_by_month", _ORPHANS + "SELECT ref_field, month, count(DISTINCT ref_id) AS n_orphans FROM f GROUP BY ref_field, month")
def p1_by_month(spark: SparkSession, folder: str) -> DataFrame:
    return orphans_by_month(table(spark, folder, "spec_references"), table(spark, folder, "specs"))


_SNAPSHOTS = """WITH x AS (SELECT lower(spec_id) AS spec_id, snapshot_no, lower(uuid) AS uuid, arg_max(struct_pack(t := text), struct_pack(d := delivered_at, t := coalesce(md5(text), ''))).t AS text
  FROM extract_snapshots WHERE spec_id IS NOT NULL AND snapshot_no IS NOT NULL AND uuid IS NOT NULL GROUP BY ALL),
n AS (SELECT spec_id, snapshot_no, lag(snapshot_no) OVER w AS prior_no, lead(snapshot_no) OVER w AS next_no FROM (SELECT DISTINCT spec_id, snapshot_no FROM x) WINDOW w AS (PARTITION BY spec_id ORDER BY snapshot_no)),
y AS (SELECT x.*, n.prior_no, n.next_no FROM x JOIN n USING (spec_id, snapshot_no))
"""


@query("p6_found", _SNAPSHOTS + """SELECT y.spec_id, y.uuid, y.snapshot_no, CASE WHEN p.uuid IS NULL THEN 'added' ELSE 'changed' END AS change_kind
FROM y LEFT JOIN y AS p ON p.spec_id = y.spec_id AND p.uuid = y.uuid AND p.snapshot_no = y.prior_no WHERE y.prior_no IS NOT NULL AND (p.uuid IS NULL OR p.text IS DISTINCT FROM y.text)
UNION ALL SELECT y.spec_id, y.uuid, y.next_no, 'removed' FROM y WHERE next_no IS NOT NULL AND NOT EXISTS (SELECT 1 FROM y AS z WHERE z.spec_id = y.spec_id AND z.uuid = y.uuid AND z.snapshot_no = y.next_no)""")
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot_changes(table(spark, folder, "extract_snapshots"))


@query("p6_intervals", _SNAPSHOTS + """, i AS (SELECT *, sum(s) OVER (PARTITION BY spec_id, uuid ORDER BY snapshot_no) AS island FROM
  (SELECT *, CASE WHEN lag(snapshot_no) OVER w = prior_no AND lag(text) OVER w IS NOT DISTINCT FROM text THEN 0 ELSE 1 END AS s FROM y WINDOW w AS (PARTITION BY spec_id, uuid ORDER BY snapshot_no)))
SELECT spec_id, uuid, min(snapshot_no) AS from_no, max(snapshot_no) AS to_no FROM i GROUP BY spec_id, uuid, island""")
def p6_intervals(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot_intervals(table(spark, folder, "extract_snapshots")).select("spec_id", "uuid", "from_no", "to_no")


#: Table, id and parent column of the three trees.
TREES = (("specs", "spec_id", "parent_spec_id"), ("paragraphs", "paragraph_id", "parent_id"), ("added_paragraphs", "uuid", "after_uuid"))


def all_nodes(spark: SparkSession, folder: str) -> DataFrame:
    nodes = [H.node_rows(table(spark, folder, name), node, parent, F.lit(name)) for name, node, parent in TREES]
    return nodes[0].unionByName(nodes[1]).unionByName(nodes[2])


_NODES = "WITH RECURSIVE n AS (" + " UNION ALL ".join(f"SELECT '{t}' AS tree, lower({i}) AS id, min(lower({p})) AS parent FROM {t} WHERE {i} IS NOT NULL GROUP BY 2" for t, i, p in TREES) + """),
d AS (SELECT tree, id, id AS root_id, 0 AS depth, id AS path FROM n WHERE parent IS NULL OR NOT EXISTS (SELECT 1 FROM n AS m WHERE m.tree = n.tree AND m.id = n.parent)
  UNION ALL SELECT n.tree, n.id, d.root_id, d.depth + 1, d.path || '/' || n.id FROM d JOIN n ON n.tree = d.tree AND n.parent = d.id),
u AS (SELECT n.* FROM n ANTI JOIN d ON n.tree = d.tree AND n.id = d.id),
a AS (SELECT tree, id, parent AS up FROM u UNION SELECT a.tree, a.id, u.parent FROM a JOIN u ON u.tree = a.tree AND u.id = a.up),
c AS (SELECT tree, id FROM a WHERE id = up),
r AS (SELECT a.tree, a.id, min(c.id) AS root_id FROM a JOIN c ON c.tree = a.tree AND c.id = a.up GROUP BY 1, 2)
"""


@query("p7_found", _NODES + "SELECT tree AS node_table, id AS node_id, root_id, depth FROM d UNION ALL SELECT tree, id, root_id, -1 FROM r")
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return H.hierarchy(all_nodes(spark, folder)).select(F.col("tree").alias("node_table"), F.col("id").alias("node_id"), "root_id", "depth")


@query("p7_descendants", _NODES + """, q AS (SELECT tree, id, unnest(string_split(path, '/')) AS up, generate_subscripts(string_split(path, '/'), 1) AS k, depth FROM d),
k AS (SELECT tree, up AS id, count(*) AS n, count(*) FILTER (k = depth) AS ch FROM q WHERE up <> id GROUP BY 1, 2)
SELECT tree AS node_table, id AS node_id, path, coalesce(ch, 0) AS n_children, coalesce(n, 0) AS n_descendants FROM d LEFT JOIN k USING (tree, id)
UNION ALL SELECT tree, id, NULL, NULL, NULL FROM r""")
def p7_descendants(spark: SparkSession, folder: str) -> DataFrame:
    return H.with_descendants(H.hierarchy(all_nodes(spark, folder), with_path=True)).select(F.col("tree").alias("node_table"), F.col("id").alias("node_id"), F.array_join("path", H.SEPARATOR).alias("path"), "n_children", "n_descendants")
