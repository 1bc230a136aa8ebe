import io
import zipfile

from helpers import frame
from pyspark.sql import functions as F

from strataflow.operators import inference as I
from strataflow.sources import docx as D

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def package(body, numbering="", styles="", **more):
    out = io.BytesIO()
    parts = {"word/document.xml": f"<w:document {NS}><w:body>{body}</w:body></w:document>", "word/numbering.xml": f"<w:numbering {NS}>{numbering}</w:numbering>", "word/styles.xml": f"<w:styles {NS}>{styles}</w:styles>"}
    with zipfile.ZipFile(out, "w") as archive:
        for name, text in (parts | more).items():
            archive.writestr(name, text)
    return out.getvalue()


def paragraph(text, props="", run=""):
    return f"<w:p><w:pPr>{props}</w:pPr><w:r>{run}<w:t>{text}</w:t></w:r></w:p>"


STYLES = """<w:style w:styleId="Base"><w:name w:val="Base"/><w:pPr><w:numPr><w:ilvl w:val="2"/><w:numId w:val="1"/></w:numPr><w:ind w:left="1152"/></w:pPr></w:style><w:style w:styleId="Own"><w:name w:val="Own"/><w:basedOn w:val="Base"/></w:style>
<w:style w:styleId="Off"><w:name w:val="Off"/><w:basedOn w:val="Base"/><w:pPr><w:numPr><w:numId w:val="0"/></w:numPr></w:pPr></w:style><w:style w:styleId="Hid"><w:name w:val="Hidden"/><w:rPr><w:vanish/></w:rPr></w:style><w:style w:styleId="N"><w:name w:val="Spec Note"/></w:style>
<w:style w:styleId="A"><w:name w:val="a"/><w:basedOn w:val="B"/></w:style><w:style w:styleId="B"><w:name w:val="b"/><w:basedOn w:val="A"/></w:style>"""


def test_facts_of_styles_and_numbering():
    numbering = '<w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:lvlText w:val="PART %1 - "/></w:lvl><w:lvl w:ilvl="1"><w:lvlText w:val="SCHEDULE %2"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="9"/></w:num>'
    number = lambda i, n: f'<w:numPr><w:ilvl w:val="{i}"/><w:numId w:val="{n}"/></w:numPr>'
    style = lambda s: f'<w:pStyle w:val="{s}"/>'
    body = "".join([
        paragraph("one", number(0, 1)), paragraph("two", style("Own")), paragraph("three", style("Off")), paragraph("four", style("Hid")), paragraph("five", style("Hid"), '<w:rPr><w:vanish w:val="0"/></w:rPr>'), paragraph("six", style("N")), paragraph("seven", style("A")),
        paragraph("eight", '<w:ind w:left="600"/><w:jc w:val="center"/>', '<w:rPr><w:highlight w:val="yellow"/></w:rPr>'), paragraph(" "), f"<w:tbl><w:tr><w:tc>{paragraph('cell')}</w:tc></w:tr></w:tbl>",
    ])
    comments = f'<w:comments {NS}><w:comment w:author="Ann" w:done="1"><w:p><w:r><w:t>why</w:t></w:r></w:p></w:comment></w:comments>'
    rows = D.docx_rows(package(body, numbering, STYLES, **{"word/comments.xml": comments}))
    found = {r["text"]: r for r in rows if r["place"] != "orphan"}
    assert found["one"]["ilvl"] == 0 and found["one"]["spec_shaped"] and found["one"]["article_ilvl"] == 3
    assert found["two"]["style_ilvl"] == 2 and found["two"]["left_indent"] == 1152 and found["two"]["num_id"] is None
    assert found["three"]["style_ilvl"] is None and found["seven"]["style_ilvl"] is None
    assert [found[x]["vanish"] for x in ("one", "four", "five")] == [False, True, False] and found["six"]["note_style"]
    assert found["eight"]["jc"] == "center" and found["eight"]["marked"] and found["eight"]["no"] == 7
    assert found["cell"]["place"] == "table" and (found["why"]["author"], found["why"]["closed"]) == ("Ann", True)


def test_bad_files_are_rows(spark):
    bomb = package("", **{"a.xml": f"<!DOCTYPE x><w:x {NS}/>"})
    files = [("ok", package(paragraph("text"))), ("no", b"not a zip"), ("empty", None), ("bomb", bomb)]
    found = {(r["source_id"], r["place"]) for r in D.docx_facts(frame(spark, files, "source_id string, content binary")).collect()}
    assert found == {("ok", "body"), ("ok", "orphan"), ("no", "error"), ("empty", "error"), ("bomb", "error")}
    assert D.docx_facts(frame(spark, [], "source_id string, content binary")).count() == 0


FACT = "source_id string, place string, no int, text string, num_id int, ilvl int, style_ilvl int, left_indent int, jc string, vanish boolean, note_style boolean, article_ilvl int, spec_shaped boolean"


def test_inference(spark):
    data = [
        ("s", "body", 0, "GENERAL", 1, 0, None, 0, None, False, False, 1, True), ("s", "body", 1, "SUMMARY", 1, 1, None, 576, None, False, False, 1, True), ("s", "body", 2, "A. Provide", None, None, 2, 1152, None, False, False, 1, None),
        ("s", "body", 3, "plain words", None, None, None, None, None, False, False, 1, None), ("s", "body", 4, "deep item", 1, 1, None, 1728, None, False, False, 1, True), ("s", "body", 5, "1. Item", 1, 2, None, None, None, False, False, 1, True),
        ("s", "body", 6, "list entry", 7, 0, None, None, None, False, False, 1, False), ("s", "body", 7, "hidden", 1, 3, None, None, None, True, False, 1, True), ("s", "body", 8, "indented", None, None, None, 1700, None, False, False, 1, None),
        ("s", "body", 9, "centred", None, None, None, 1700, "center", False, False, 1, None), ("s", "body", 10, "off", 0, None, 2, None, None, False, False, 1, None), ("s", "table", 0, "cell", None, None, None, None, None, None, None, None, None),
        ("t", "body", 0, "*****", None, None, None, None, None, False, False, 1, None), ("t", "body", 1, "a note", None, None, None, None, None, False, False, 1, None), ("t", "body", 2, "*****", None, None, None, None, None, False, False, 1, None), ("t", "body", 3, "** NOTE TO SPECIFIER **", None, None, None, None, None, False, False, 1, None),
    ]
    rows = {(r["source_id"], r["no"]): r for r in I.nested(I.inferred(frame(spark, data, FACT))).collect()}
    kinds = {k: (r["node_type"], r["signal"], r["agreed"], r["conflicts"]) for k, r in rows.items()}
    assert kinds["s", 0] == ("part", 1, [], []) and kinds["s", 1] == ("article", 1, [5], [])
    assert kinds["s", 2] == ("pr1", 2, [4, 5], []) and kinds["s", 3] == ("continuation", 3, [], [])
    assert kinds["s", 4] == ("pr2", 5, [], [1])  # an article that only its numbering says gives way to a deep indentation
    assert kinds["s", 5] == ("pr1", 1, [], [3]) and kinds["s", 6][0] == "continuation" and kinds["s", 8] == ("pr2", 5, [], []) and kinds["s", 9][0] == kinds["s", 10][0] == "continuation"
    assert rows["s", 7]["vanish"] and rows["s", 7]["node_type"] == "continuation" and rows["s", 7]["level"] == 2
    assert [rows["t", n]["note"] for n in range(4)] == [False, True, False, True]
    assert {n: rows["s", n]["parent_no"] for n in (0, 1, 2, 3, 4)} == {0: None, 1: 0, 2: 1, 3: 2, 4: 2}


def test_note_regions_that_drift(spark):
    lines = [("a", 0, "*****", None), ("a", 1, "note", None), ("a", 2, "PART 1", None), ("a", 3, "after", None), ("b", 0, "*****", None), ("b", 1, "numbered", True), ("c", 0, "*****", None), ("c", 1, "x", None), ("c", 2, "******", None), ("c", 3, "y", True), ("d", 0, None, None)]
    rows = frame(spark, lines, "k string, n int, t string, s boolean")
    found = {(r["k"], r["n"]): r["role"] for r in I.note_roles(rows, "k", "n", I.asterisks(F.col("t")), F.col("t").rlike("^PART"), F.col("s")).collect()}
    assert [found["a", n] for n in range(4)] == ["rule", "note", "none", "none"] and [found["b", n] for n in range(2)] == ["none", "none"]
    assert [found["c", n] for n in range(4)] == ["rule", "note", "rule", "none"] and found["d", 0] == "none"


def test_written_files_are_read_back(spark):
    lines = [("s", "27 10 00", "1", 0, "GENERAL & <all>", True, False, False, [("A", "x\x01y", True), None]), ("s", "27 10 00", "2", 1, "Title\ttwo", False, False, False, None), ("s", "27 10 00", "3", None, "note", True, True, True, None), ("s", "27 10 00", "4", 2, None, True, False, False, None)]
    rows = frame(spark, lines, "source_id string, section string, key string, level int, text string, direct boolean, vanish boolean, note boolean, comments array<struct<author string, text string, closed boolean>>")
    facts = D.docx_facts(D.docx_documents(rows, frame(spark, [("s", "A title")], "source_id string, title string")))
    found = {(r["place"], r["text"]): r for r in facts.collect()}
    assert {("body", "GENERAL & <all>"), ("body", "Title two"), ("body", "note"), ("comment", "xy"), ("header", "SECTION 27 10 00"), ("footer", "A title"), ("property", "27 10 00"), ("table", "PART"), ("table", "GENERAL & <all>")} <= set(found)
    assert found["body", "GENERAL & <all>"]["ilvl"] == 0 and found["body", "Title two"]["style_ilvl"] == 1 and found["body", "note"]["vanish"]
