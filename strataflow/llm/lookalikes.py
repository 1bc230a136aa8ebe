"""Visually identical text with different characters: finding it and bringing it to one form.

Texts of an Arrow batch become one array of code points. Tables are gathered by code point, ligatures are expanded through
offsets, and marks are composed in whole-array rounds. No text is handled by itself.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strataflow.llm.codepoints import any_in_row, from_codepoints, row_of, to_codepoints

# Letters of other scripts and the Latin letters of the same shape.
TWINS = {
    "Cyrillic": ("аеорсухіјѕһԁԛԝѵӏАВЕКМНОРСТУХІЈЅ", "aeopcyxijshdqwvlABEKMHOPCTYXIJS"),
    "Greek": ("ονΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ovABEZHIKMNOPTYX"),
}
# Hyphens that aren't the plain one (dashes are no hyphens).
HYPHENS = "‐‑﹣－"
SIZE = 0x110000
WIDE, INVISIBLE, SPACE, HYPHEN, MARK, LATIN, LETTER, TWIN, PICTURE, JOINING = (1 << i for i in range(10))


@functools.cache
def tables() -> dict[str, np.ndarray]:
    """By code point: kind (bits), plain (what stands for it), combining class; and the compositions as sorted pairs."""
    kind, plain, rank = np.zeros(SIZE, np.uint16), np.arange(SIZE, dtype=np.uint32), np.zeros(SIZE, np.uint8)
    expand: dict[int, str] = {}
    pairs: list[tuple[int, int, int]] = []
    for point in [*range(0x30000), *range(0xE0000, 0xE0200)]:
        char = chr(point)
        category = unicodedata.category(char)
        if category == "Cn":
            continue
        shape = unicodedata.decomposition(char)
        if category[0] == "L":
            kind[point] |= LETTER | (LATIN if unicodedata.name(char, "").startswith(("LATIN", "FULLWIDTH LATIN")) else 0)
        if category == "Cf" or 0xFE00 <= point <= 0xFE0F or point in (0x115F, 0x1160, 0x3164, 0xFFA0, 0x034F):
            kind[point] |= INVISIBLE
        if category in ("Zs", "Zl", "Zp") and point != 32:
            kind[point] |= SPACE
            plain[point] = 32
        if 0x0300 <= point <= 0x036F and category == "Mn" and point != 0x034F:
            kind[point] |= MARK
        if 0x0600 <= point <= 0x0DFF:
            kind[point] |= JOINING
        if point >= 0x2190 and category in ("So", "Sk") or 0x1F000 <= point <= 0x1FAFF:
            kind[point] |= PICTURE
        rank[point] = unicodedata.combining(char)
        if shape.startswith("<wide>") and 0xFF01 <= point <= 0xFFE6:
            kind[point] |= WIDE
            plain[point] = int(shape.split()[1], 16)
        elif shape.startswith("<compat>") and 0xFB00 <= point <= 0xFB17:
            kind[point] |= WIDE
            expand[point] = unicodedata.normalize("NFKC", char)
        elif shape and shape[0] != "<":
            parts = [int(x, 16) for x in shape.split()]
            if len(parts) == 1:
                plain[point] = parts[0]
            elif unicodedata.normalize("NFC", char) == char:
                pairs.append((parts[0], parts[1], point))
    for char in HYPHENS:
        kind[ord(char)] |= HYPHEN
        plain[ord(char)] = ord("-")
    twin = np.zeros(SIZE, np.uint32)
    for theirs, latin in TWINS.values():
        for a, b in zip(theirs, latin, strict=True):
            kind[ord(a)] |= TWIN
            twin[ord(a)] = ord(b)
    keys = np.array([a << 21 | b for a, b, _ in pairs], np.int64)
    order = np.argsort(keys)
    length = np.ones(SIZE, np.uint8)
    apart = np.ones(SIZE, np.uint8)
    split = {point: unicodedata.normalize("NFD", chr(point)) for *_, point in pairs}
    return _parts(expand, length, "known", "parts") | _parts(split, apart, "composed", "pieces") | {        "kind": kind, "plain": plain, "rank": rank, "twin": twin, "pair": keys[order], "whole": np.array([c for *_, c in pairs], np.uint32)[order], "length": length, "apart": apart,
    }


def _parts(texts: dict[int, str], length: np.ndarray, keys: str, values: str) -> dict[str, np.ndarray]:
    """A dense table of the texts that stand for some code points; fills in their lengths."""
    known = sorted(texts)
    parts = np.zeros((len(known), max(map(len, texts.values()), default=1)), np.uint32)
    for i, point in enumerate(known):
        length[point] = len(texts[point])
        parts[i, : len(texts[point])] = [ord(c) for c in texts[point]]
    return {keys: np.array(known, np.uint32), values: parts}


def _expand(points: np.ndarray, rows: np.ndarray, length: np.ndarray, known: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gathers each code point's parts with expansion offsets; length says how many it has."""
    ends = np.cumsum(length, dtype=np.int64)
    source = np.repeat(np.arange(len(points)), length)
    within = np.arange(ends[-1]) - np.repeat(ends - length, length)
    many = length[source] > 1
    out = points[source]
    out[many] = parts[np.searchsorted(known, out[many]), within[many]]
    return out, rows[source]


def _latin_words(points: np.ndarray, kind: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Marks the letters of words that hold a Latin letter. Marks and invisible characters don't end a word."""
    inside = (kind & (LETTER | MARK | INVISIBLE)) != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | (rows[1:] != rows[:-1])
    word = np.cumsum(begins)
    latin = np.zeros(word[-1] + 1 if len(word) else 1, bool)
    latin[word[(kind & LATIN) != 0]] = True
    return inside & latin[word] if len(word) else inside


def _joiners(points: np.ndarray, kind: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Invisible characters with a use: the joiner between two pictures, a variation selector after one, and joiners between letters of scripts that need them."""
    selector = (points >= 0xFE00) & (points <= 0xFE0F)
    left, right, second = np.zeros_like(kind), np.zeros_like(kind), np.zeros_like(kind)
    same = rows[1:] == rows[:-1]
    left[1:][same], right[:-1][same] = kind[:-1][same], kind[1:][same]
    far = rows[2:] == rows[:-2]
    second[2:][far] = kind[:-2][far]
    after_selector = np.zeros(len(points), bool)
    after_selector[1:] = selector[:-1] & same
    before = np.where(after_selector, second, left)  # a picture may have its selector between
    pictures = (points == 0x200D) & (before & PICTURE != 0) & (right & PICTURE != 0)
    letters = ((points == 0x200C) | (points == 0x200D)) & (left & JOINING != 0) & (right & JOINING != 0)
    return pictures | (selector & (left & PICTURE != 0)) | letters


def suspicious(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each code point whether it is a case."""
    t = tables()
    kind = t["kind"][points]
    if not len(points):
        return np.zeros(0, bool)
    rows = row_of(offsets)
    marks = (kind & (WIDE | SPACE | HYPHEN)) != 0
    marks |= ((kind & INVISIBLE) != 0) & ~_joiners(points, kind, rows)
    after_letter = np.zeros(len(points), bool)
    after_letter[1:] = ((kind[:-1] & (LETTER | MARK | INVISIBLE)) != 0) & (rows[1:] == rows[:-1])
    marks |= ((kind & MARK) != 0) & after_letter
    return marks | (((kind & TWIN) != 0) & _latin_words(points, kind, rows))


def unify(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts in one consistent form, as code points and offsets."""
    t, count = tables(), len(offsets) - 1
    rows = row_of(offsets)
    kind = t["kind"][points]
    twins = ((kind & TWIN) != 0) & _latin_words(points, kind, rows)
    keep = ((kind & INVISIBLE) == 0) | _joiners(points, kind, rows)
    points = np.where(twins, t["twin"][points], t["plain"][points])[keep]
    rows = rows[keep]
    length = t["length"][points]
    if (length > 1).any():  # ligatures
        points, rows = _expand(points, rows, length, t["known"], t["parts"])
    rank = t["rank"][points]
    if (rank > 0).any():  # marks: canonical order, then compose in rounds
        marked = np.zeros(len(points), bool)
        marked[:-1] = (rank[1:] > 0) & (rows[1:] == rows[:-1])
        length = np.where(marked, t["apart"][points], 1)  # a composed letter before a mark comes apart first
        if (length > 1).any():
            points, rows = _expand(points, rows, length, t["composed"], t["pieces"])
            rank = t["rank"][points]
        starter = np.cumsum((rank == 0) | np.concatenate(([True], rows[1:] != rows[:-1])))
        order = np.lexsort((rank, starter))
        points, rows, rank = points[order], rows[order], rank[order]
        while True:
            at = np.flatnonzero(rank > 0)
            at = at[at > 0]
            base = np.maximum.accumulate(np.where(rank == 0, np.arange(len(rank)), 0))[at]
            free = ((base == at - 1) | (rank[at - 1] < rank[at])) & (rank[base] == 0) & (rows[base] == rows[at])
            at, base = at[free], base[free]
            key = points[base].astype(np.int64) << 21 | points[at]
            where = np.minimum(np.searchsorted(t["pair"], key), len(t["pair"]) - 1)
            hit = t["pair"][where] == key
            at, base, where = at[hit], base[hit], where[hit]
            if not len(at):
                break
            base, first = np.unique(base, return_index=True)
            points[base] = t["whole"][where[first]]
            left = np.ones(len(points), bool)
            left[at[first]] = False
            points, rows, rank = points[left], rows[left], rank[left]
    return points, np.searchsorted(rows, np.arange(count + 1))


def may_need_it(text: Column) -> Column:
    """False for plain ASCII texts, which are in the one form already: as many bytes as characters."""
    return F.octet_length(text) > F.length(text)


def text_rows(paragraphs: DataFrame) -> DataFrame:
    """(paragraph_id, comment_no, text) of each paragraph's own text (0) and its comments (from 1), in one scan."""
    own = F.array(F.struct(F.lit(0).alias("comment_no"), F.col("text").alias("text")))
    comments = F.transform(F.coalesce(F.col("comments.text"), F.array().cast("array<string>")), lambda c, i: F.struct((i + 1).cast("int").alias("comment_no"), c.alias("text")))
    return paragraphs.select("paragraph_id", F.explode(F.concat(own, comments)).alias("_t")).select("paragraph_id", "_t.comment_no", "_t.text")


def _flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        points, offsets = to_codepoints(batch.column("text"))
        found = any_in_row(suspicious(points, offsets), offsets)
        yield batch.filter(pa.array(found)).select(["paragraph_id", "comment_no"])


def lookalike_texts(paragraphs: DataFrame) -> DataFrame:
    """(paragraph_id, comment_no) of every text with characters that only look like the plain ones.

    Null, empty and plain ASCII texts are no cases and never leave the JVM. Repeated rows give one row. Other columns are ignored.
    """
    rows = text_rows(paragraphs).where(may_need_it(F.col("text")))
    return rows.mapInArrow(_flag, "paragraph_id string, comment_no int").distinct()


def _unify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        points, offsets = unify(*to_codepoints(texts))
        clean = from_codepoints(points, offsets, np.asarray(texts.is_null()))
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("paragraph_id", "comment_no")], clean], names=["paragraph_id", "comment_no", "text"])


def one_form(paragraphs: DataFrame) -> DataFrame:
    """(paragraph_id, comment_no, text) of every text in one consistent form; null stays null, empty stays empty."""
    rows = text_rows(paragraphs)
    needs = F.coalesce(may_need_it(F.col("text")), F.lit(False))
    return rows.where(~needs).unionByName(rows.where(needs).mapInArrow(_unify, "paragraph_id string, comment_no int, text string"))
