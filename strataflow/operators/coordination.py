"""Reports across specs: consistency of references, submittals, umbrella sections, alignment of versions, anchors of merged additions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strataflow.functions import lines as L, text as T
from strataflow.operators import tree as O
from strataflow.operators.hierarchy import Carried

# Article titles under which the paragraphs and not the article name products.
GENERIC = ("accessories", "fabrication", "general", "manufacturers", "materials", "performance requirements", "products", "quality control", "source quality control")


def classified_references(nodes: DataFrame, references: DataFrame) -> DataFrame:
    """(source_spec_id, target_type, value, paragraph_id, listed): each reference with its place: listed in the article that is for its kind, or cited elsewhere.

    The role is that of the nearest article at or above the paragraph; a paragraph without one, or in no tree, cites.
    """
    here = F.when(F.col("type") == "article", F.coalesce("role", F.lit("other")))
    role = Carried("near_role", here, lambda above: F.coalesce(here, above))
    roles = O.carried(nodes.withColumn("role", T.article_role(F.col("text"))), role).select(F.col("id").alias("source_paragraph_id"), "near_role")
    refs = references.select("source_spec_id", "source_paragraph_id", "target_type", F.when(F.col("target_type") == "section", F.col("target_section")).otherwise(F.col("standard_code")).alias("value")).where("value IS NOT NULL AND source_spec_id IS NOT NULL AND target_type IS NOT NULL")
    placed = refs.join(roles, "source_paragraph_id", "left")
    listed = F.coalesce(F.col("near_role") == F.when(F.col("target_type") == "section", "related-sections").otherwise("references"), F.lit(False))
    return placed.select("source_spec_id", "target_type", "value", F.col("source_paragraph_id").alias("paragraph_id"), listed.alias("listed"))


def reference_findings(classified: DataFrame) -> DataFrame:
    """(finding, source_spec_id, value, paragraph_id): sections listed and not cited, sections and standards cited and not listed; the smallest paragraph stands for several.

    One aggregate by spec and value gives both sides of the difference.
    """
    flags = classified.groupBy("source_spec_id", "target_type", "value").agg(F.max("listed").alias("_listed"), F.max(~F.col("listed")).alias("_cited"), F.min("paragraph_id").alias("paragraph_id"))
    finding = F.when((F.col("target_type") == "section") & ~F.col("_cited"), "related_listed_not_cited").when(F.col("target_type") == "section", "related_cited_not_listed").when(F.col("_cited"), "standard_cited_not_listed")
    return flags.where("_listed <> _cited").select(finding.alias("finding"), "source_spec_id", "value", "paragraph_id").where("finding IS NOT NULL")


def submittals(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(products, types): (spec, product_id, name, n_sheets) of each product that a spec's products part names, and (spec, submittal_type) that its submittals articles ask for.

    nodes: nodes_of() rows with n_sheets, the number of sheets attached to a node; a product has those of its whole subtree. An article of the products part
    is a product; where its title is generic its first-level paragraphs are. Vanished nodes name nothing. One walk down the trees serves both.
    """
    key = T.normalized_key(F.col("text"))
    part = (F.col("type") == "part") & F.col("parent").isNull()
    first = lambda fits: F.row_number().over(Window.partitionBy("spec", part & fits).orderBy("position", "id")) == 1
    for_products, for_general = key.contains("products") | key.startswith("part 2"), key.contains("general") | key.startswith("part 1")
    # What a node could name is worked out where its text is, and no text travels down the trees.
    name = F.when(F.col("type") == "article", F.when(~key.isin(*GENERIC), T.title_case(L.without_outline(F.col("text"))))).when(F.col("type").isin("pr1", "pr2"), L.product_name(F.col("text")))
    rows = nodes.withColumn("_products", part & F.coalesce(for_products, F.lit(False)) & first(F.coalesce(for_products, F.lit(False)))).withColumn("_general", part & F.coalesce(for_general, F.lit(False)) & first(F.coalesce(for_general, F.lit(False))))
    rows = rows.select("*", F.nullif(name, F.lit("")).alias("_name"), (T.article_role(F.col("text")) == "submittals").alias("_submittals"), L.submittal_types(F.col("text")).alias("_types"))
    article, seen = F.col("type") == "article", ~F.col("vanish")
    names = F.when(seen & F.col("_name").isNotNull() & F.col("type").isin("article", "pr1", "pr2"), F.col("id"))
    state = lambda zone, product: F.struct(zone.alias("zone"), product.alias("product"))
    none = F.lit(None).cast("string")

    def below(above: Column) -> Column:
        zone, product = above["zone"], above["product"]
        in_part, in_article = zone == "products", zone == "generic"
        child = F.when(in_part, names).when(in_article & ~article, names)
        generic = F.when(in_part & article & seen & F.col("_name").isNull(), F.lit("generic"))
        asked = F.when((zone == "general") & article & seen & F.coalesce("_submittals", F.lit(False)), F.lit("submittals")).when((zone == "submittals") & seen, F.lit("submittals"))
        return state(F.when(product.isNotNull(), none).otherwise(F.coalesce(generic, asked)), F.coalesce(product, child))

    root = state(F.when(F.col("_products"), "products").when(F.col("_general"), "general"), none)
    walked = O.carried(rows, Carried("at", root, below), O.own("spec"), O.own("name", F.col("_name")), O.own("types", F.col("_types")), O.own("n_sheets"))
    found = walked.where("at.product IS NOT NULL").groupBy("spec", F.col("at.product").alias("product_id")).agg(F.max(F.when(F.col("id") == F.col("at.product"), F.col("name"))).alias("name"), F.sum("n_sheets").alias("n_sheets"))
    types = walked.where("at.zone = 'submittals'").select("spec", F.explode("types").alias("submittal_type")).distinct()
    return found, types


def submittal_register(products: DataFrame, types: DataFrame) -> DataFrame:
    """(product, n_sources, n_sheets, types, status) of each product over all specs, by its name as a key; the kinds of all its specs, and whether a sheet is there."""
    named = products.withColumn("product", T.normalized_key(F.col("name")))
    asked = named.select("product", "spec").distinct().join(types, "spec").groupBy("product").agg(F.array_join(F.array_sort(F.collect_set("submittal_type")), ", ").alias("types"))
    rows = named.groupBy("product").agg(F.count("*").alias("n_sources"), F.sum("n_sheets").alias("n_sheets"))
    return rows.join(asked, "product", "left").select("product", "n_sources", "n_sheets", F.coalesce("types", F.lit("")).alias("types"), F.when(F.col("n_sheets") > 0, "present").otherwise("missing").alias("status"))


def submittal_findings(products: DataFrame, types: DataFrame) -> DataFrame:
    """(finding, spec, product_id, submittal_type): products of specs that ask for nothing, kinds asked for by specs without products, products without a sheet."""
    asking, having = types.select("spec").distinct(), products.select("spec").distinct()
    row = lambda df, finding, product, kind: df.select(F.lit(finding).alias("finding"), "spec", product.cast("string").alias("product_id"), kind.cast("string").alias("submittal_type"))
    without_type = row(products.join(asking, "spec", "left_anti"), "product_without_submittal_type", F.col("product_id"), F.lit(None))
    without_product = row(types.join(having, "spec", "left_anti"), "submittal_type_without_product", F.lit(None), F.col("submittal_type"))
    without_sheet = row(products.where("n_sheets = 0"), "product_missing_datasheet", F.col("product_id"), F.lit(None))
    return without_type.unionByName(without_product).unionByName(without_sheet)


def aligned_cells(rows: DataFrame, group: str, column: str, key: str, order: list[str], value: str) -> DataFrame:
    """(group, key, column, first row's order columns, value, n_present, n_values, state): the cells of an N-way alignment, one row for each cell that is there.

    Within a column the first row of a key by ``order`` counts. Rows of a key are counted by an aggregate and joined back, so no group is collected.
    """
    first = rows.groupBy(group, key, column).agg(F.min(F.struct(*order, F.struct(value).alias("_v"))).alias("_cell")).select(group, key, column, *[F.col(f"_cell.{o}").alias(o) for o in order], F.col(f"_cell._v.{value}").alias(value))
    counts = first.groupBy(group, key).agg(F.count("*").alias("n_present"), (F.countDistinct(value) + F.max(F.when(F.col(value).isNull(), 1).otherwise(0))).alias("n_values"))
    state = F.when(F.col("n_present") < 2, "single").when(F.col("n_values") > 1, "differing").otherwise("identical")
    return first.join(counts.withColumn("state", state), [group, key])


def alignment_modes(rows: DataFrame, group: str, column: str, key: str) -> DataFrame:
    """(group, aligned_by): origin where a key stands in two columns of the group, else structure."""
    shared = rows.select(group, column, key).distinct().groupBy(group, key).agg(F.count("*").alias("_n"))
    return shared.groupBy(group).agg(F.when(F.max("_n") > 1, "origin").otherwise("structure").alias("aligned_by"))


def effective_anchors(added: DataFrame, keys: list[str], index: str, uuid: str, anchor: str) -> DataFrame:
    """The additions with ``effective_anchor``: the addition before it by index at the same anchor (``after_sibling``), else the anchor itself, so that accepted siblings land in order."""
    order = Window.partitionBy(*keys, anchor).orderBy(index, uuid)
    prior = added.withColumn("_prior", F.lag(uuid).over(order))
    return prior.withColumn("effective_anchor", F.coalesce("_prior", anchor)).withColumn("after_sibling", F.col("_prior").isNotNull()).drop("_prior")
