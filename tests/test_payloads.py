import base64

from helpers import frame
from pyspark.sql import functions as F

from strataflow.sources import docx as D, payloads as P


def test_payloads(spark):
    data = [base64.b64encode(b"text").decode(), " dGV4\ndA== ", "not base64!", "dGV4dA", "", None]
    rows = frame(spark, list(enumerate(data)), "n int, d string").select("n", P.payload(F.col("d")).alias("b"), P.payload(F.col("d"), 2).alias("small")).collect()
    found = {r["n"]: r["b"] and bytes(r["b"]) for r in rows}
    assert [found[n] for n in range(6)] == [b"text", b"text", None, None, b"", None]
    assert [r["small"] for r in rows if r["n"] == 0] == [None]


def test_decoding(spark):
    texts = [b"\xef\xbb\xbfna\xc3\xafve", "naïve".encode("utf-16"), b"\xfe\xff" + "naïve".encode("utf-16-be"), b"na\xc3\xafve", b"na\xefve", b"", None]
    rows = frame(spark, list(enumerate(texts)), "n int, c binary").select("n", P.decoded_text(F.col("c")).alias("t")).collect()
    found = {r["n"]: r["t"] for r in rows}
    assert [found[n] for n in range(7)] == ["naïve", "naïve", "naïve", "naïve", "na�ve", "", None]


def test_refused_pdfs(spark):
    files = [b"junk %PDF-1.7 rest", b"PK", b"%PDF-1.4 /Encrypt 1 0 R", b"%PDF-" + b"x" * 100]
    rows = frame(spark, list(enumerate(files)), "n int, c binary").select("n", P.refused_pdf(F.col("c"), 50).alias("why")).collect()
    assert [r["why"] for r in sorted(rows, key=lambda r: r["n"])] == [None, "no PDF", "encrypted", "too large"]


def test_controls_orphans_and_tracked_changes():
    line = {"level": None, "text": "known", "direct": True, "vanish": False, "note": False, "comments": None, "id": "U1"}
    raw = D.write_docx("t", "s", [line | {"id": None, "text": "before"}, line, line | {"id": None, "text": "after"}])
    found = {(r["place"], r["style"], r["text"]) for r in D.docx_rows(raw) if r["place"] in ("control", "orphan")}
    assert found == {("orphan", None, "before"), ("control", "u1", "known"), ("orphan", "u1", "after")}
    import xml.etree.ElementTree as ET

    body = ET.fromstring(f'<w:body xmlns:w="{D.SPACE}"><w:p><w:ins w:author="A"><w:r><w:t>new</w:t></w:r></w:ins><w:del w:author="B"><w:r><w:delText>old</w:delText></w:r></w:del></w:p></w:body>')
    assert {(r["style"], r["author"], r["text"]) for r in D._controls(body) if r["place"] == "tracked"} == {("ins", "A", "new"), ("del", "B", "old")}
