"""Trees of paragraphs: visibility, labels, addresses and ancestors, from the materialised paths of the hierarchy operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strataflow.functions.text import alpha_label
from strataflow.operators.hierarchy import Carried, hierarchy, node_rows

#: Node types that take a number among their siblings.
NUMBERED = ("part", "article", "pr1", "pr2", "pr3", "pr4", "pr5", "pr6", "pr7")


def nodes_of(paragraphs: DataFrame) -> DataFrame:
    """One row per paragraph: id, spec, parent, type, text, position, vanish."""
    return paragraphs.where("paragraph_id IS NOT NULL").select(
        F.lower("paragraph_id").alias("id"), F.lower("spec_id").alias("spec"), "spec_section", F.lower("parent_id").alias("parent"), F.col("node_type").alias("type"), "text", F.col("sibling_position").alias("position"), F.coalesce("vanish", F.lit(False)).alias("vanish")
    ).distinct()


def paths(paragraphs: DataFrame) -> DataFrame:
    """(id, root_id, depth, path) of all paragraphs; path is an array from the root, null on circles."""
    rows = hierarchy(node_rows(paragraphs, "paragraph_id", "parent_id"), with_path=True)
    return rows.select("id", "root_id", "depth", "path")


def ancestors(tree: DataFrame) -> DataFrame:
    """(id, at, ancestor) of each node of the paths and all above it, itself included; at counts from the root."""
    return tree.where("path IS NOT NULL").select("id", F.posexplode("path").alias("at", "ancestor"))


def carried(nodes: DataFrame, *values: Carried) -> DataFrame:
    """(id, root_id, depth, the values) of nodes_of() rows, taken along from level to level of the tree. Of several rows of one id the one that sorts first counts."""
    rows = nodes.groupBy("id").agg(F.min_by(F.struct("*"), F.struct("parent", "spec", "position", "type", "text", "vanish")).alias("n")).select(F.lit("").alias("tree"), "id", "n.parent", *[f"n.{c}" for c in nodes.columns if c not in ("id", "parent", "text")], F.length(F.coalesce("n.text", F.lit(""))).alias("n_chars"))
    return hierarchy(rows, carried=values).where("depth >= 0").drop("tree")


def own(name: str, value: Column | None = None) -> Carried:
    """A column of the node itself, given beside the carried values."""
    value = F.col(name) if value is None else value
    return Carried(name, value, lambda _: value)


def gone() -> Carried:
    """Whether a node is gone: it or one above it vanished and is no note."""
    here = F.col("vanish") & F.coalesce(F.col("type") != "note", F.lit(True))
    return Carried("gone", here, lambda above: above | here)


def nearest_of(kind: str) -> Carried:
    """The closest node of that type at or above each node, and its depth below the root counted from the node: a struct of id and distance."""
    here = F.struct(F.col("id").alias("id"), F.lit(0).alias("distance"))
    return Carried("near", F.when(F.col("type") == kind, here), lambda above: F.when(F.col("type") == kind, here).when(above.isNotNull(), F.struct(above["id"].alias("id"), (above["distance"] + 1).alias("distance"))))


def ordinals(nodes: DataFrame) -> DataFrame:
    """The nodes with their number among the siblings of their type that take one; roots are siblings within their spec. null for types without number."""
    siblings = Window.partitionBy("spec", F.coalesce("parent", F.lit("")), "type").orderBy("position", "id")
    return nodes.withColumn("ordinal", F.when(F.col("type").isin(*NUMBERED), F.row_number().over(siblings)))


def label(kind: Column, ordinal: Column) -> Column:
    """The outline label of a node's own level."""
    number, letter = ordinal.cast("string"), alpha_label(ordinal)
    return (
        F.when(kind == "part", F.concat(F.lit("PART "), number, F.lit(" -"))).when(kind == "article", F.concat(F.lit("."), number)).when(kind == "pr1", F.concat(letter, F.lit("."))).when(kind == "pr2", F.concat(number, F.lit(".")))
        .when(kind == "pr3", F.concat(F.lower(letter), F.lit("."))).when(kind.isin("pr4", "pr6"), F.concat(number, F.lit(")"))).when(kind.isin("pr5", "pr7"), F.concat(F.lower(letter), F.lit(")")))
    )


def address() -> Carried:
    """Type and ordinal (see ordinals()) of each node from the root down."""
    step = F.concat_ws(":", "type", F.coalesce(F.col("ordinal").cast("string"), F.lit("-")))
    return Carried("address", step, lambda above: F.concat_ws("/", above, step))


def preorder() -> Carried:
    """Strings whose order is the order of reading: positions of any int, zero-padded, and ids. Negative positions sort as 0."""
    step = F.concat(F.lpad(F.greatest(F.coalesce("position", F.lit(0)), F.lit(0)).cast("string"), 10, "0"), F.col("id"))
    return Carried("sort_key", step, lambda above: F.concat_ws("/", above, step))
