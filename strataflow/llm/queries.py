"""Queries of the text problems by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataflow.llm import abuse, encodings, lookalikes, nearcopies, packing, scans, tokens
from strataflow.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalikes.lookalike_texts(table(spark, folder, "paragraphs"))


@query
def p4_texts(spark: SparkSession, folder: str) -> DataFrame:
    return lookalikes.one_form(table(spark, folder, "paragraphs"))


@query
def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_column(table(spark, folder, "documents"), "doc_id", "text")


@query
def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return packing.pack(tokens.token_counts(documents, "doc_id", "text"), "doc_id", "n_tokens", documents.count())


@query
def p9_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(p9_containers(spark, folder))


@query
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return nearcopies.similar_pairs(table(spark, folder, "paragraphs"))


@query
def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    return nearcopies.copy_groups(table(spark, folder, "paragraphs"))


@query
def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.score_documents(table(spark, folder, "documents"), table(spark, folder, "review_labels")).where("abusive").select("doc_id").distinct()


@query
def p10_scores(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.score_documents(table(spark, folder, "documents"), table(spark, folder, "review_labels"))


@query
def p10_rates(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.rates_by_source(abuse.score_documents(table(spark, folder, "documents"), table(spark, folder, "review_labels")))


@query
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    found = encodings.repaired_texts(table(spark, folder, "pdf_extractions"), table(spark, folder, "pdf_items"))
    return found.select("extraction_id", "item_no").distinct()


@query
def p2_texts(spark: SparkSession, folder: str) -> DataFrame:
    return encodings.repaired_texts(table(spark, folder, "pdf_extractions"), table(spark, folder, "pdf_items"))


@query
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return scans.scan_noise(table(spark, folder, "pdf_extractions"))


@query
def p5_texts(spark: SparkSession, folder: str) -> DataFrame:
    return scans.readable_texts(table(spark, folder, "pdf_extractions"))

_TWINS = "".join(theirs for theirs, _ in lookalikes.TWINS.values())
_INVISIBLE = "\\x{00AD}\\x{034F}\\x{061C}\\x{180E}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{2064}\\x{2066}-\\x{206F}\\x{FEFF}\\x{FE00}-\\x{FE0F}"
SQL["p4_found"] = f"""WITH t AS (SELECT DISTINCT paragraph_id, 0 AS comment_no, text FROM paragraphs UNION SELECT paragraph_id, generate_subscripts(comments, 1)::INTEGER, unnest([c.text for c in comments]) FROM paragraphs)
SELECT DISTINCT paragraph_id, comment_no FROM t WHERE regexp_matches(text, '[\\x{{FF01}}-\\x{{FF5E}}\\x{{FFE0}}-\\x{{FFE6}}\\x{{FB00}}-\\x{{FB06}}\\x{{FB13}}-\\x{{FB17}}]') OR regexp_matches(text, '\\p{{L}}[\\x{{0300}}-\\x{{036F}}]')
OR regexp_matches(text, '[{_INVISIBLE}]') OR regexp_matches(text, '[\\x{{00A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{2010}}\\x{{2011}}\\x{{FE63}}]')
OR regexp_matches(text, '\\p{{Latin}}[\\p{{L}}\\p{{M}}]*[{_TWINS}]') OR regexp_matches(text, '[{_TWINS}][\\p{{L}}\\p{{M}}]*\\p{{Latin}}')"""
