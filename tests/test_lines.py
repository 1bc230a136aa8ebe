from helpers import frame
from pyspark.sql import functions as F

from strataflow.functions import lines as L, sections as S


def values(spark, function, *items, kind="string"):
    rows = frame(spark, [(n, x) for n, x in enumerate(items)], f"n int, x {kind}").select("n", function(F.col("x")).alias("y")).collect()
    return [r["y"] for r in sorted(rows, key=lambda r: r["n"])]


def test_signals(spark):
    texts = ["PART 2 PRODUCTS", "2.0 PRODUCTS", "2.0 inches", "1.2.3.4 deep", "1.2 ARTICLE", "A. Provide", "1. Item", "a)x", "b) xy", "12) xyz", "", None, "3i) no"]
    assert values(spark, L.text_signal, *texts) == [0, 0, 1, 3, 1, 2, 3, None, 6, 5, None, None, None]
    assert values(spark, L.indent_signal, 0, 287, 288, 576, 4608, 9000, -86, None, kind="int") == [None, None, 1, 1, 8, None, None, None]
    assert values(spark, lambda x: L.type_of(x, F.lit(2)), 0, 1, 2, 3, 10, 12, kind="int") == ["part", "continuation", "article", "pr1", "continuation", "continuation"]
    assert values(spark, L.level_of, "part", "pr7", "note", None) == [0, 8, None, None]


def test_notes_and_separators(spark):
    assert values(spark, L.opens_note, "** NOTE TO SPECIFIER **", "Spec Notes: x", "see note to specifier", None) == [True, True, False, None]
    assert values(spark, L.holds_note, "see NOTE   TO the SPECIFIER", "plain") == [True, False]
    assert values(spark, L.separates, "****", "--", "****** [OR] ******", "OR", "]", "[__x__]") == [True, False, True, True, False, False]


def test_prefixes(spark):
    assert values(spark, L.without_part, "PART 1GENERAL", "PART 1.0 GENERAL", "PART 1", "2.0 PRODUCTS", "PARTITION 1") == ["GENERAL", "PART 1.0 GENERAL", "PART 1", "PRODUCTS", "PARTITION 1"]
    assert values(spark, lambda x: L.outline_stripped(x)["text"], "1.4.2.1 Installation", "2.1 GHz", "1.2.3 ") == ["Installation", None, None]
    spans = [([(0, 2), (3, 9), (8, 20)],)]
    moved = frame(spark, spans, "s array<struct<start int, end int>>").select(L.rebased(F.col("s"), F.lit(3), F.lit(6)).alias("y")).first()["y"]
    assert [tuple(x) for x in moved] == [(0, 6), (5, 6)]


def test_names_and_patterns(spark):
    assert values(spark, L.product_name, "A. Cable tray: ladder type", "Provide cable", "1.2 o-ring gaskets", ": one two three four five six", "Product data: x", "") == ["Cable Tray", None, "O-Ring Gaskets", None, None, None]
    assert values(spark, L.submittal_types, "Submit SD-03 product data and samples.", "Samples are not required") == [["Product Data", "Samples"], []]
    assert values(spark, L.file_name, "C:\\fakepath\\a.sec", "/tmp/b.docx", "c.pdf", "dir/") == ["a.sec", "b.docx", "c.pdf", "dir"]
    assert values(spark, L.image_type, bytes([0x89, 0x50, 0x4E, 0x47, 0x0D, 0x0A, 0x1A, 0x0A]), b"\xff\xd8\xff\xe0", b"GIF89a", b"BM12", b"", None, kind="binary") == ["image/png", "image/jpeg", "image/gif", "image/bmp", None, None]
    assert [L.pattern_refused(p) for p in ("a+b", "(a+)+", "((a*)?)*", "(a{2,}b)*", "[*+]+", "(", "x" * 201, "(ab)+c*")] == [None, "endless repetition", "endless repetition", "endless repetition", None, "no pattern", "too long", None]


def test_section_numbers_stand_alone(spark):
    found = values(spark, S.section_numbers_in, "see 26 00 13 and 26\xa000  13.10 20, not 2.26 00 13 or 26 00 134", "26 00 13.10\n20 mm", None)
    assert found == [["26 00 13", "26 00 13.10 20"], ["26 00 13.10"], None]
    heads = values(spark, lambda x: S.section_heading(x)["title"], "Section 270510 - Cabling", "SECTION 27 05 10", "27 05 10 – X", "x 27 05 10")
    assert heads == ["Cabling", "unknown", "X", None]
