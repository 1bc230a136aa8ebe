"""Findings over specs: implied references, language rules, duplicated requirements, open comments, readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strataflow.functions import text as T
from strataflow.storage import stage

# Words of titles that name no subject.
STOP_WORDS = [
    "and",
    "are",
    "basic",
    "common",
    "communications",
    "concrete",
    "conveying",
    "division",
    "documents",
    "earthwork",
    "electrical",
    "electronic",
    "equipment",
    "execution",
    "exterior",
    "finishes",
    "general",
    "hvac",
    "improvements",
    "masonry",
    "materials",
    "metals",
    "moisture",
    "openings",
    "part",
    "plumbing",
    "process",
    "product",
    "products",
    "project",
    "related",
    "requirement",
    "requirements",
    "safety",
    "section",
    "sections",
    "specialties",
    "specification",
    "specifications",
    "summary",
    "system",
    "systems",
    "the",
    "thermal",
    "transportation",
    "utilities",
    "waterway",
    "wood",
    "work",
]


def keywords(text: Column) -> Column:
    """The distinct stems of a text's words of four letters and more that are no stop words, before and after stemming."""
    long = F.filter(T.tokens(text), lambda t: (F.length(t) >= 4) & ~t.isin(STOP_WORDS))
    return F.array_distinct(F.filter(F.transform(long, T.stem), lambda t: (F.length(t) >= 4) & ~t.isin(STOP_WORDS)))


def title_keywords(catalogue: DataFrame, most: int = 2) -> DataFrame:
    """(section, keyword, n_keywords): keywords of each title that stand in at most so many sections' titles; n_keywords of the section."""
    words = catalogue.select(F.col("section_number").alias("section"), F.explode(keywords(F.col("title"))).alias("keyword")).distinct()
    rare = words.groupBy("keyword").agg(F.countDistinct("section").alias("n")).where(F.col("n") <= most).select("keyword")
    kept = words.join(rare, "keyword")
    return kept.join(kept.groupBy("section").agg(F.count("*").alias("n_keywords")), "section").select("section", "keyword", "n_keywords")


def implied_sections(paragraphs: DataFrame, titles: DataFrame, known: DataFrame) -> DataFrame:
    """Sections that a spec's text implies without naming them: (spec_id, implied_section, paragraph_id, matched_keyword, confidence).

    paragraphs: spec_id, section, paragraph_id, text. titles: title_keywords(). known: (spec_id, section) that are listed or cited. A paragraph implies a
    section by two of its keywords, or by its only one. Of a spec's paragraphs that imply the same section the smallest id is named. Words meet keywords in
    an equi-join; no paragraph is compared with the whole catalogue.
    """
    titles = stage(titles, "keywords")  # of exact size, so that a catalogue of any usual size is broadcast and no word is shuffled
    kept = F.filter(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9]+")), lambda w: (F.length(w) >= 4) & ~w.isin(STOP_WORDS))
    words = paragraphs.select("spec_id", F.col("section").alias("own"), "paragraph_id", F.explode(F.array_distinct(F.transform(kept, lambda w: T.stem(w)))).alias("keyword"))
    hits = words.join(titles, "keyword").where(F.col("own") != F.col("section")).distinct()
    matched = hits.groupBy("spec_id", "paragraph_id", "section").agg(F.count("*").alias("n"), F.min("keyword").alias("matched_keyword"), F.first("n_keywords").alias("n_keywords"))
    matched = matched.where(F.col("n") >= F.least(F.lit(2), F.col("n_keywords"))).join(known, ["spec_id", "section"], "left_anti")
    best = matched.groupBy("spec_id", "section").agg(F.min(F.struct("paragraph_id", "matched_keyword", "n")).alias("m"))
    confidence = F.round(F.least(F.lit(0.92), F.lit(0.72) + (F.col("m.n") - 1) * 0.08), 2)
    return best.select("spec_id", F.col("section").alias("implied_section"), F.col("m.paragraph_id").alias("paragraph_id"), F.col("m.matched_keyword").alias("matched_keyword"), confidence.alias("confidence"))


def term_findings(paragraphs: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(paragraph_id, category, term, matched): the first match of each term in each paragraph, case aside. rules: (category, term, pattern of the term)."""
    found = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(t).alias("term"), F.regexp_extract(F.col("text"), f"(?i)\\b({p})\\b", 1).alias("matched")) for c, t, p in rules])
    return paragraphs.select("paragraph_id", F.explode(F.filter(found, lambda x: x["matched"] != "")).alias("f")).select("paragraph_id", "f.*")


def missing_phrases(paragraphs: DataFrame, phrases: list[str]) -> DataFrame:
    """(spec_id, phrase) of each phrase that no paragraph of the spec holds. Flags are combined before the shuffle; no text travels."""
    flags = paragraphs.groupBy("spec_id").agg(*[F.max(F.coalesce(F.contains(F.lower("text"), F.lit(p.lower())), F.lit(False))).alias(f"_{i}") for i, p in enumerate(phrases)])
    return flags.select("spec_id", F.explode(F.array(*[F.when(~F.col(f"_{i}"), F.lit(p)) for i, p in enumerate(phrases)])).alias("phrase")).where("phrase IS NOT NULL")


def most_specific(rules: DataFrame, keys: list[str], layer: str) -> DataFrame:
    """Of rules with equal keys the one of the highest layer."""
    others = [c for c in rules.columns if c not in keys and c != layer]
    top = rules.groupBy(*keys).agg(F.max(F.struct(layer, *others)).alias("t"))
    return top.select(*keys, F.col(f"t.{layer}").alias(layer), *[F.col(f"t.{c}").alias(c) for c in others])
