"""Ranked search over paragraphs."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strataflow.functions import text as T


Part = tuple[bool, list[str]]


def parse(search: str) -> list[list[Part]]:
    """Alternatives of a query, divided by ``or``; each is (wanted, words) of its words, "phrases" and -exclusions, of which all wanted ones must occur and no other may. Alternatives without a wanted part match nothing and are left out."""
    groups: list[list[Part]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', search):
        if not minus and word.lower() == "or":
            groups.append([])
            continue
        words = [w for w in re.split(r"[^a-z0-9]+", (phrase or word).lower()) if w]
        if words:
            groups[-1].append((not minus, words))
    return [g for g in groups if any(wanted for wanted, _ in g)]


def _stem(word: str) -> Column:
    """The stem of a query's word, a constant that is folded when the query is planned."""
    return T.stem(F.lit(word))


def _all(conditions: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a & b, conditions)


def _any(conditions: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a | b, conditions)


def matching(paragraphs: DataFrame, search: str) -> DataFrame:
    """The paragraphs that a query matches, by the stems of their words. A query without wanted words matches none."""
    groups = parse(search)
    if not groups:
        return paragraphs.where(F.lit(False)).withColumn("words", F.array().cast("array<string>"))
    # Every form of a word begins with its stem but for a last letter, so most texts are dropped before they are split.
    begin = lambda word: F.substr(_stem(word), F.lit(1), F.greatest(F.length(_stem(word)) - 1, F.lit(1)))
    may = [_all([F.contains(F.lower("text"), begin(w)) for wanted, words in g if wanted for w in words]) for g in groups]
    rows = paragraphs.where(_any(may)).withColumn("words", F.transform(T.tokens(F.col("text")), lambda w: T.stem(w)))
    joined = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))

    def holds(part: Part) -> Column:
        held = F.contains(joined, F.concat(F.lit(" "), F.concat_ws(" ", *map(_stem, part[1])), F.lit(" ")))
        return held if part[0] else ~held

    return rows.where(_any([_all([holds(part) for part in g]) for g in groups]))


def counted(paragraphs: DataFrame, search: str, most: int = 20) -> DataFrame:
    """The best matches by the number of matching words, then section and id: a top-k, so each task keeps its own best before they meet."""
    wanted = [w for g in parse(search) for good, words in g if good for w in words]
    stems = F.array(*map(_stem, wanted)) if wanted else F.array().cast("array<string>")
    rank = F.size(F.filter("words", lambda w: F.array_contains(stems, w)))
    return matching(paragraphs, search).select("paragraph_id", "section", rank.alias("n_hits"), T.snippet(F.col("text"), wanted[0] if wanted else "").alias("snippet")).orderBy(F.desc("n_hits"), "section", "paragraph_id").limit(most)


def cover_ranked(paragraphs: DataFrame, search: str, most: int = 20) -> DataFrame:
    """The best matches by cover density: the sum over the shortest stretches that hold all words of an alternative of one over their length; of several alternatives the densest counts."""
    groups = [[w for good, words in g if good for w in words] for g in parse(search)]
    stems = paragraphs.sparkSession.range(1).select(F.array(*[F.array(*map(_stem, g)) for g in groups]).cast("array<array<string>>")).first()[0]
    needs = [set(g) for g in stems]

    def density(words: list[str], need: set[str]) -> float:
        last, total, at = {}, 0.0, -1
        for i, w in enumerate(words):
            if w in need:
                last[w] = i
                if len(last) == len(need) and min(last.values()) > at:
                    at = min(last.values())
                    total += 1.0 / (i - at + 1)
        return round(total, 6)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks = [max((density(words, need) for need in needs), default=0.0) for words in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("paragraph_id"), batch.column("section"), pa.array(ranks, pa.float64())], names=["paragraph_id", "section", "rank"])

    return matching(paragraphs, search).select("paragraph_id", "section", "words").mapInArrow(rank, "paragraph_id string, section string, rank double").orderBy(F.desc("rank"), "section", "paragraph_id").limit(most)
