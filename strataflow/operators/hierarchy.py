"""Parent-child rows to full hierarchies: root, depth, path, descendants and circles.

The frontier of one level is joined with the rows not reached yet; matched rows are the next frontier. Every level is one
job over the rows that are left, so the work is the sum of the depths and not rows times levels. Each level is written to the
shared folder, which cuts the lineage and survives lost executors. What lies deeper than LEVELS is reached by doubling: each round joins
the stretch of ancestors that a node has looked at with that of the node at its end, so a chain of any length takes the logarithm of it in jobs.
Rows that neither reaches are on a circle or below one.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, functions as F

from strataflow.storage import discard, new_path

SEPARATOR = "/"
#: Levels that are walked one by one.
LEVELS = 10


class Carried(NamedTuple):
    """A value that nodes have from above: that of a root, and that of a child from its parent's (a column) and its own columns."""

    name: str
    root: Column
    child: Callable[[Column], Column]


def node_rows(rows: DataFrame, node: str, parent: str, tree: Column | None = None) -> DataFrame:
    """(tree, id, parent): one row per distinct node, ids in lower case.

    Rows without an id are no nodes. Copies are one node; should they name several parents, the smallest one holds.
    """
    tree = F.lit("") if tree is None else tree
    return rows.where(F.col(node).isNotNull()).select(tree.alias("tree"), F.lower(node).alias("id"), F.lower(parent).alias("parent")).groupBy("tree", "id").agg(F.min("parent").alias("parent"))


def _write(df: DataFrame, path: str, *counts: Column) -> dict:
    """Writes a level, split by ``reached``; returns the counts made on the way."""
    seen = Observation()
    df.observe(seen, *counts).write.partitionBy("reached").parquet(path)
    return seen.get


def hierarchy(nodes: DataFrame, with_path: bool = False, carried: tuple[Carried, ...] = ()) -> DataFrame:
    """(tree, id, root_id, depth[, path][, carried values]) of every node of node_rows().

    A node whose parent is null or no node of its tree is a root of depth 0. On a circle or below one, root_id is
    the smallest id on the circle, depth is -1 and path and carried values are null. path is the array of ids from root to node. A node that
    is its own parent is a circle of one. An empty table gives no rows. Depth is unbounded. Carried values are taken along from level to
    level (``nodes`` has the columns that they need), so nothing is exploded; with them every level is one job, whatever the depth.
    """
    spark = nodes.sparkSession
    own = [c for c in nodes.columns if c not in ("tree", "id", "parent")]
    nodes = nodes.select("tree", "id", "parent", *own)
    present = nodes.select("tree", F.col("id").alias("parent"), F.lit(True).alias("_known"))
    judged = nodes.join(present, ["tree", "parent"], "left")
    is_root = F.col("_known").isNull()
    values = [Carried("path", F.array("id"), lambda above: F.concat(above, F.array("id")))] * with_path + list(carried)
    state = judged.select(
        "tree", "id", F.when(~is_root, F.col("parent")).alias("parent"), F.when(is_root, F.col("id")).alias("root_id"), F.lit(0).alias("depth"), *[F.when(is_root, v.root).alias(f"_of_{v.name}") for v in values], *own, is_root.alias("reached")
    )
    counts = [F.count_if("reached").alias("new"), F.count_if(~F.col("reached")).alias("left")]
    base, level = new_path(spark, "levels"), 0
    tables = spark.read.schema(state.schema).option("basePath", base)
    read = lambda level, reached: tables.parquet(f"{base}/level={level}").where(F.col("reached") == reached)
    seen = _write(state, f"{base}/level=0", *counts)
    while seen["new"] and seen["left"] and (level < LEVELS or carried):
        above = read(level, True).select("tree", F.col("id").alias("parent"), F.col("root_id").alias("_from"), *[F.col(f"_of_{v.name}").alias(f"_above_{v.name}") for v in values])
        rest = read(level, False).select("tree", "id", "parent", *own)
        met = F.col("_from").isNotNull()
        state = rest.join(above, ["tree", "parent"], "left").select(
            "tree", "id", "parent", F.col("_from").alias("root_id"), F.lit(level + 1).alias("depth"), *[F.when(met, v.child(F.col(f"_above_{v.name}"))).alias(f"_of_{v.name}") for v in values], *own, met.alias("reached")
        )
        seen = _write(state, f"{base}/level={level + 1}", *counts)
        discard(spark, f"{base}/level={level}/reached=false")
        level += 1
    out = ["tree", "id", "root_id", "depth", *[F.col(f"_of_{v.name}").alias(v.name) for v in values]]
    whole = tables.parquet(base).where("reached").select(*out)
    if not seen["left"]:
        return whole
    rest = read(level, False).select("tree", "id", "parent")
    if seen["new"]:
        front = read(level, True).select("tree", "id", "parent", "depth", "root_id", *[F.col("_of_path").alias("path")] * with_path)
        deep, rest = _doubled(front, rest, with_path)
        whole = whole.unionByName(deep.select(*whole.columns))
    rings = circle_of(rest).withColumn("depth", F.lit(-1))
    return whole.unionByName(rings.select("tree", "id", "root_id", "depth", *[F.lit(None).cast(whole.schema[v.name].dataType).alias(v.name) for v in values]))


def _doubled(front: DataFrame, rest: DataFrame, with_path: bool) -> tuple[DataFrame, DataFrame]:
    """(nodes of rest below the frontier with root_id, depth and path, the others). ``jump`` is the node at the end of a node's stretch of ``far`` steps."""
    spark = rest.sparkSession
    path = [F.array("id").alias("path")] * with_path
    state = rest.select("tree", "id", "parent", F.col("parent").alias("jump"), F.lit(1).alias("far"), F.lit(None).cast("string").alias("root_id"), *path)
    ends = front.select("tree", "id", "parent", F.col("id").alias("jump"), F.col("depth").alias("far"), "root_id", *["path"] * with_path)
    state, at, met = state.unionByName(ends), None, -1
    while True:
        written = new_path(spark, "stretches")
        seen = Observation()
        state.observe(seen, F.count("root_id").alias("met")).write.parquet(written)
        state = spark.read.schema(state.schema).parquet(written)
        if at:
            discard(spark, at)
        at = written
        if seen.get["met"] == met:
            break
        met = seen.get["met"]
        # A node whose stretch ends at one that has met the frontier has met it too, at that one's depth and its own steps.
        further = state.select("tree", F.col("id").alias("jump"), F.col("jump").alias("_jump"), F.col("far").alias("_far"), F.col("root_id").alias("_root"), *[F.col("path").alias("_path")] * with_path)
        open_ = state.where("root_id IS NULL").join(further, ["tree", "jump"])
        longer = [F.concat("_path", "path").alias("path")] * with_path
        state = state.where("root_id IS NOT NULL").unionByName(open_.select("tree", "id", "parent", F.col("_jump").alias("jump"), (F.col("far") + F.col("_far")).alias("far"), F.col("_root").alias("root_id"), *longer))
    deep = state.join(front.select("tree", "id"), ["tree", "id"], "left_anti")
    return deep.where("root_id IS NOT NULL").withColumn("depth", F.col("far")), deep.where("root_id IS NULL").select("tree", "id", "parent")


def circle_of(rest: DataFrame) -> DataFrame:
    """(tree, id, root_id) of nodes all of whose ancestors lead to a circle; root_id is the smallest id on it.

    Each round doubles the stretch of ancestors that a node has looked at: ``jump`` is the node at its end and ``least``
    the smallest id on it from the node on. All nodes end on their circle once the stretch is as long as the longest tail and circle.
    The result of a node is the least of its jump target; the rounds end when no node differs from its parent in it, which
    holds only when each circle has a single value and that is its minimum.
    """
    spark = rest.sparkSession

    def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = new_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    state, at = written(rest.select("tree", "id", "parent", F.col("parent").alias("jump"), F.col("id").alias("least")), "ring")
    while True:
        ends = state.select("tree", F.col("id").alias("jump"), F.col("jump").alias("_jump"), F.col("least").alias("_least"))
        ahead, ahead_at = written(state.join(ends, ["tree", "jump"]).select("tree", "id", "parent", F.col("_jump").alias("jump"), F.least("least", "_least").alias("least"), F.col("_least").alias("root_id")), "ring")
        above = ahead.select("tree", F.col("id").alias("parent"), F.col("root_id").alias("_above"))
        if not ahead.join(above, ["tree", "parent"]).where("root_id <> _above").limit(1).count():
            return ahead.select("tree", "id", "root_id")
        discard(spark, at)
        state, at = ahead.drop("root_id"), ahead_at


def ancestor_pairs(paths: DataFrame) -> DataFrame:
    """(tree, ancestor, descendant, distance) of all nodes outside circles, from the paths of hierarchy(with_path=True)."""
    pairs = paths.where("path IS NOT NULL").select("tree", F.col("id").alias("descendant"), "depth", F.posexplode("path").alias("_at", "ancestor"))
    return pairs.where("_at < depth").select("tree", "ancestor", "descendant", (F.col("depth") - F.col("_at")).alias("distance"))


def with_descendants(paths: DataFrame) -> DataFrame:
    """The paths with n_children and n_descendants; both are null on circles and below them. Pairs are counted before they meet the nodes."""
    counts = ancestor_pairs(paths).groupBy("tree", "ancestor").agg(F.count("*").alias("n_descendants"), F.count_if(F.col("distance") == 1).alias("n_children"))
    counts = counts.select("tree", F.col("ancestor").alias("id"), "n_descendants", "n_children")
    known = lambda c: F.when(F.col("depth") >= 0, F.coalesce(c, F.lit(0))).alias(c)
    return paths.join(counts, ["tree", "id"], "left").select(*paths.columns, known("n_descendants"), known("n_children"))
