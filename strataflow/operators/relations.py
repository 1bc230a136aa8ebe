"""Joins and choices over specs, their references and their catalogue.

Every function takes and returns DataFrames and runs no action. Ids compare in lower case, exact copies of rows count once, null keys join nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strataflow.functions.sections import canonical_section


def clean_specs(specs: DataFrame) -> DataFrame:
    """One row per spec; owner is the library or project it belongs to."""
    owner = F.coalesce(F.concat(F.lit("L"), F.lower("library_id")), F.concat(F.lit("P"), F.lower("project_id")))
    return specs.select(
        F.lower("spec_id").alias("spec_id"), canonical_section(F.col("section")).alias("section"), "title", "source", F.lower("library_id").alias("library_id"), F.lower("project_id").alias("project_id"), owner.alias("owner"),
        F.lower("parent_spec_id").alias("parent_spec_id"), "origin_version", "content_version", "withdrawn_at", "created_at",
    ).distinct()


def clean_references(references: DataFrame) -> DataFrame:
    """One row per reference with canonical target section."""
    return references.select(
        "ref_id", F.lower("source_spec_id").alias("source_spec_id"), F.lower("source_paragraph_id").alias("source_paragraph_id"), "target_type", canonical_section(F.col("target_spec_section")).alias("target_section"),
        F.lower("target_spec_id").alias("target_spec_id"), "standard_code", "reference_text", "is_broken", "created_at",
    ).distinct()


def sections_in_use(catalogue: DataFrame, specs: DataFrame) -> DataFrame:
    """Every section with each spec of it (null where there is none) and whether there is one; specs of one section multiply it.

    Sections with specs come from an inner join, whose hot sections adaptive execution can split on the specs' side (in an outer join it could not), the others from an anti join.
    """
    sections = catalogue.select("section_number", "title", "division")
    used = specs.select(F.col("section").alias("section_number"), "spec_id").where("section_number IS NOT NULL")
    columns = ["section_number", "title", "division", "spec_id"]
    held = used.join(sections, "section_number").select(*columns, F.lit(True).alias("in_database"))
    free = sections.join(used, "section_number", "left_anti").select("section_number", "title", "division", F.lit(None).cast("string").alias("spec_id"), F.lit(False).alias("in_database"))
    return held.unionByName(free)


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in that order. The rank is limited to 1, so each task drops the others before the shuffle."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def resolve_sections(references: DataFrame, specs: DataFrame) -> DataFrame:
    """Each section reference with the spec of the source's owner that has the target section: the earliest created, of equals the smallest id; null where none."""
    live = specs.where("withdrawn_at IS NULL AND owner IS NOT NULL").select("owner", "section", "spec_id", "created_at")
    # One row per owner and section, aggregated before the shuffle.
    chosen = live.groupBy("owner", "section").agg(F.min(F.struct("created_at", "spec_id")).alias("c")).select("owner", F.col("section").alias("target_section"), F.col("c.spec_id").alias("resolved_spec_id"))
    sources = specs.select(F.col("spec_id").alias("source_spec_id"), "owner")
    refs = references.where("target_section IS NOT NULL").join(sources, "source_spec_id")
    return refs.join(chosen, ["owner", "target_section"], "left").select("ref_id", "source_spec_id", "owner", "target_section", "resolved_spec_id")


def broken_references(references: DataFrame, specs: DataFrame) -> DataFrame:
    """References whose target the source's owner lacks, with how many other owners hold the section and the first of them."""
    open_refs = resolve_sections(references, specs).where("resolved_spec_id IS NULL")
    holders = specs.where("withdrawn_at IS NULL").select("section", "owner").distinct().groupBy("section").agg(F.count("*").alias("n_holders"), F.min("owner").alias("first_holder"))
    rows = open_refs.join(holders, open_refs["target_section"] == holders["section"], "left")
    return rows.select("ref_id", "source_spec_id", "target_section", F.coalesce("n_holders", F.lit(0)).alias("n_holders"), "first_holder")


def reference_edges(references: DataFrame) -> DataFrame:
    """(source_spec_id, target_section, n_refs, n_anchors): references and distinct anchor paragraphs of each edge."""
    return references.where("target_section IS NOT NULL AND source_spec_id IS NOT NULL").groupBy("source_spec_id", "target_section").agg(F.count("*").alias("n_refs"), F.countDistinct("source_paragraph_id").alias("n_anchors"))


def winning_specs(specs: DataFrame) -> DataFrame:
    """For each section the spec of the first owner in order and how many other owners it shadows."""
    live = specs.where("withdrawn_at IS NULL AND owner IS NOT NULL")
    return live.groupBy("section").agg(F.min(F.struct("owner", "created_at", "spec_id")).alias("w"), (F.countDistinct("owner") - 1).alias("n_shadowed")).select("section", F.col("w.owner").alias("owner"), F.col("w.spec_id").alias("spec_id"), "n_shadowed")


def lineage(specs: DataFrame) -> DataFrame:
    """Each derived spec with its parent and how many versions the parent is ahead of the one it came from; null for a missing parent."""
    parent = specs.select(F.col("spec_id").alias("parent_spec_id"), F.col("content_version").alias("parent_version"), F.col("library_id").alias("parent_library_id"))
    rows = specs.where("parent_spec_id IS NOT NULL").join(parent, "parent_spec_id", "left")
    return rows.select("spec_id", "parent_spec_id", "origin_version", "parent_version", (F.col("parent_version") - F.col("origin_version")).alias("behind_by"), F.coalesce("library_id", "parent_library_id").alias("ownership"))


def in_ranges(rows: DataFrame, value: str, ranges: list[tuple[str, str, str]], name: str) -> DataFrame:
    """The name of the first range (by start) that holds the value, else null; the ranges are a given list, so this is a projection and no join."""
    found = F.lit(None).cast("string")
    for label, start, end in sorted(ranges, key=lambda r: (r[1], r[0]), reverse=True):
        found = F.when(F.col(value).between(start, end), label).otherwise(found)
    return rows.withColumn(name, found)


