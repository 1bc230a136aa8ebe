from helpers import frame, rows

from strataflow.operators import coordination as C, tree as O

PARAGRAPH = "paragraph_id string, spec_id string, spec_section string, parent_id string, node_type string, text string, sibling_position int, vanish boolean"


def test_reference_findings(spark):
    classified = [
        ("s", "section", "01 00 00", "p2", True), ("s", "section", "01 00 00", "p1", True), ("s", "section", "02 00 00", "p3", False), ("s", "section", "03 00 00", "p4", True), ("s", "section", "03 00 00", "p5", False),
        ("s", "standard", "A 1", "p6", False), ("s", "standard", "B 1", "p7", True), ("s", "standard", "C 1", "p8", True), ("s", "standard", "C 1", "p9", False),
    ]
    found = rows(C.reference_findings(frame(spark, classified, "source_spec_id string, target_type string, value string, paragraph_id string, listed boolean")))
    assert found == [("related_cited_not_listed", "s", "02 00 00", "p3"), ("related_listed_not_cited", "s", "01 00 00", "p1"), ("standard_cited_not_listed", "s", "A 1", "p6")]


def test_submittals(spark):
    tree = [
        ("g", "s", "1", None, "part", "PART 1 GENERAL", 0, False), ("ga", "s", "1", "g", "article", "SUBMITTALS", 0, False), ("gb", "s", "1", "ga", "pr1", "Submit product data and shop drawings.", 0, False), ("gc", "s", "1", "ga", "pr1", "Samples", 1, True),
        ("p", "s", "1", None, "part", "PRODUCTS", 1, False), ("pa", "s", "1", "p", "article", "1.2 cable trays", 0, False), ("pb", "s", "1", "pa", "pr1", "Ladder: steel", 0, False), ("pc", "s", "1", "p", "article", "MATERIALS", 1, False),
        ("pd", "s", "1", "pc", "pr1", "A. o-ring gaskets: rubber", 0, False), ("pe", "s", "1", "pc", "pr1", "Provide more", 1, False), ("pf", "s", "1", "p", "article", "Gone", 2, True), ("q", "t", "1", None, "part", "PRODUCTS", 0, None), ("qa", "t", "1", "q", "article", "Cable Trays", 0, None),
        ("r", "u", "1", None, "part", "GENERAL", 0, False), ("ra", "u", "1", "r", "article", "Submittals", 0, False), ("rb", "u", "1", "ra", "pr1", "design data", 0, False), ("x", "u", "1", None, "part", None, 1, None),
    ]
    from pyspark.sql import functions as F

    nodes = O.nodes_of(frame(spark, tree, PARAGRAPH)).withColumn("n_sheets", F.when(F.col("id") == "pb", 2).otherwise(0).cast("bigint"))
    products, types = C.submittals(nodes)
    assert rows(products) == [("s", "pa", "Cable Trays", 2), ("s", "pd", "O-Ring Gaskets", 0), ("t", "qa", "Cable Trays", 0)]
    assert rows(types) == [("s", "Product Data"), ("s", "Shop Drawings"), ("u", "Design Data")]
    assert rows(C.submittal_register(products, types)) == [("cable trays", 2, 2, "Product Data, Shop Drawings", "present"), ("o ring gaskets", 1, 0, "Product Data, Shop Drawings", "missing")]
    assert {r[:3] for r in rows(C.submittal_findings(products, types))} == {("product_without_submittal_type", "t", "qa"), ("submittal_type_without_product", "u", None), ("product_missing_datasheet", "s", "pd"), ("product_missing_datasheet", "t", "qa")}
    none = O.nodes_of(frame(spark, [], PARAGRAPH)).withColumn("n_sheets", F.lit(0).cast("bigint"))
    assert [rows(x) for x in C.submittals(none)] == [[], []]


def test_alignment_and_anchors(spark):
    cells = [("g", "a", "k1", 1, "x"), ("g", "a", "k1", 0, "y"), ("g", "b", "k1", 0, "y"), ("g", "b", "k2", 0, None), ("h", "c", "k1", 0, "x")]
    table = frame(spark, cells, "g string, c string, k string, o int, v string")
    assert {tuple(r)[:3] + (r["v"], r["state"]) for r in C.aligned_cells(table, "g", "c", "k", ["o"], "v").collect()} == {("g", "k1", "a", "y", "identical"), ("g", "k1", "b", "y", "identical"), ("g", "k2", "b", None, "single"), ("h", "k1", "c", "x", "single")}
    assert rows(C.alignment_modes(table, "g", "c", "k")) == [("g", "origin"), ("h", "structure")]
    added = frame(spark, [("s", 2, "u2", "a"), ("s", 1, "u1", "a"), ("s", 3, "u3", None), ("t", 1, "u4", "a")], "s string, i int, u string, a string")
    assert {r["u"]: (r["effective_anchor"], r["after_sibling"]) for r in C.effective_anchors(added, ["s"], "i", "u", "a").collect()} == {"u1": ("a", False), "u2": ("u1", True), "u3": (None, False), "u4": ("a", False)}
