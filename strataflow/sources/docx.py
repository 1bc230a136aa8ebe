"""DOCX files: facts of their paragraphs, tables, comments, headers and properties, and a writer.

``docx_facts`` is one Arrow pass over the files' bytes. It resolves what a paragraph inherits (numbering and visibility through the chain of styles) and says nothing
of hierarchy: that is inferred from the facts by expressions (operators.inference). A file that can't be read gives one row of place ``error``.
"""

from __future__ import annotations

import io
import re
import zipfile
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strataflow.sources.documents import MAX_BYTES, MAX_ENTRIES, MAX_RATIO, _clean

SPACE = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
W = f"{{{SPACE}}}"
FACTS = "source_id string, place string, no int, text string, style string, num_id int, ilvl int, style_ilvl int, left_indent int, jc string, vanish boolean, note_style boolean, marked boolean, n_drawings int, author string, closed boolean, article_ilvl int, spec_shaped boolean"
_NAMES = [c.split()[0] for c in FACTS.split(", ")]


def open_docx(raw: bytes) -> dict[str, ET.Element]:
    """The XML parts of a package by name. Refuses packages of too many or too large entries, and parts that declare entities."""
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        entries = archive.infolist()
        if len(entries) > MAX_ENTRIES or sum(e.file_size for e in entries) > MAX_BYTES or any(e.file_size > MAX_RATIO * max(1, e.compress_size) for e in entries) or any(".." in e.filename or e.filename.startswith("/") for e in entries):
            raise ValueError("unsafe archive")
        parts = {}
        for entry in entries:
            if entry.filename.endswith(".xml"):
                data = archive.read(entry)
                if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
                    raise ValueError("entities are not allowed")
                parts[entry.filename] = ET.fromstring(data)
    return parts


def _value(element: ET.Element | None, path: str) -> str | None:
    found = element.find("/".join(W + p for p in path.split("/"))) if element is not None else None
    return None if found is None else found.get(f"{W}val")


def _number(text: str | None) -> int | None:
    return int(text) if text is not None and re.fullmatch(r"-?\d+", text) else None


def _on(element: ET.Element | None, path: str) -> bool | None:
    """A switch: null where it isn't set."""
    found = element.find("/".join(W + p for p in path.split("/"))) if element is not None else None
    return None if found is None else found.get(f"{W}val", "true") not in ("false", "0", "off", "none")


class Numbering:
    """Numbering definitions: level texts of each list, the level at which articles stand, and lists that are made for specs."""

    def __init__(self, root: ET.Element | None) -> None:
        self.article_ilvl, self.spec_shaped, self.linked = 1, set(), {}
        if root is None:
            return
        lists = {a.get(f"{W}abstractNumId"): {_number(level.get(f"{W}ilvl")) or 0: level for level in a.findall(f"{W}lvl")} for a in root.findall(f"{W}abstractNum")}
        for levels in lists.values():
            texts = [(_value(levels.get(n), "lvlText") or "").upper() for n in (1, 2)]
            if any("SCHEDULE" in t or "PRODUCT DATA" in t for t in texts):
                self.article_ilvl = 3
        for num in root.findall(f"{W}num"):
            levels, id_ = lists.get(_value(num, "abstractNumId"), {}), _number(num.get(f"{W}numId"))
            links = {_value(level, "pStyle"): n for n, level in levels.items() if _value(level, "pStyle")}
            self.linked |= {style: (id_, n) for style, n in links.items()}
            if len(links) >= 3 or re.match(r"(?i)PART\s+%\d(\s*[-–—.:]\s*|\s|$)", _value(levels.get(0), "lvlText") or ""):
                self.spec_shaped.add(id_)


class Styles:
    """Paragraph styles with what they inherit from those they are based on."""

    def __init__(self, root: ET.Element | None, numbering: Numbering) -> None:
        self.raw = {} if root is None else {s.get(f"{W}styleId"): s for s in root.findall(f"{W}style")}
        self.numbering = numbering

    def chain(self, style: str | None) -> Iterator[tuple[str, ET.Element]]:
        seen = set()
        while style in self.raw and style not in seen:
            seen.add(style)
            yield style, self.raw[style]
            style = _value(self.raw[style], "basedOn")

    def level(self, style: str | None) -> int | None:
        """The level that the style or one it is based on numbers at; none where numbering is switched off on the way."""
        for name, element in self.chain(style):
            if _number(_value(element, "pPr/numPr/numId")) == 0:
                return None
            if name in self.numbering.linked:
                return self.numbering.linked[name][1]
            if element.find(f"{W}pPr/{W}numPr") is not None:
                return _number(_value(element, "pPr/numPr/ilvl")) or 0
        return None

    def vanishes(self, style: str | None) -> bool:
        return next((v for _, e in self.chain(style) if (v := _on(e, "rPr/vanish")) is not None), False)

    def for_notes(self, style: str | None) -> bool:
        return any("note" in (_value(e, "name") or "").lower() for _, e in self.chain(style))

    def indent(self, style: str | None) -> int | None:
        return next((n for _, e in self.chain(style) if (i := e.find(f"{W}pPr/{W}ind")) is not None and (n := _number(i.get(f"{W}left", i.get(f"{W}start")))) is not None), None)


def _text(element: ET.Element) -> str:
    return _clean("".join(t.text or "" if t.tag == f"{W}t" else " " for t in element.iter() if t.tag in (f"{W}t", f"{W}tab", f"{W}br")))


def _controls(body: ET.Element) -> list[dict]:
    """Tagged content controls (style: the tag) with their texts, paragraphs outside of any (orphan; style: the control before it), and tracked insertions and deletions (style: ins or del)."""
    rows, after = [], None
    for child in body:
        if child.tag == f"{W}sdt":
            tag = _value(child, "sdtPr/tag")
            content = child.find(f"{W}sdtContent")
            if tag and content is not None:
                after = tag.lower()
                rows.append({"place": "control", "style": after, "text": _text(content)})
        elif child.tag == f"{W}p" and (text := _text(child)):
            rows.append({"place": "orphan", "style": after, "text": text})
    for kind in ("ins", "del"):
        rows += [{"place": "tracked", "style": kind, "author": c.get(f"{W}author"), "text": _clean("".join(t.text or "" for t in c.iter() if t.tag in (f"{W}t", f"{W}delText")))} for c in body.iter(f"{W}{kind}")]
    return rows


def docx_rows(raw: bytes) -> list[dict]:
    """One row for each paragraph of the body with text, cell of a table, header, footer, comment and property; those of a place are numbered from 0."""
    parts = open_docx(raw)
    numbering = Numbering(parts.get("word/numbering.xml"))
    styles = Styles(parts.get("word/styles.xml"), numbering)
    rows: list[dict] = []
    body = parts["word/document.xml"].find(f"{W}body")
    in_tables = {id(p) for t in body.iter(f"{W}tbl") for p in t.iter(f"{W}p")}
    for p in body.iter(f"{W}p"):
        text = _text(p)
        if not text or id(p) in in_tables:
            continue
        style, runs = _value(p, "pPr/pStyle"), p.findall(f".//{W}r")
        hidden = [_on(r, "rPr/vanish") for r in runs]
        own = _on(p, "pPr/rPr/vanish")
        indent = p.find(f"{W}pPr/{W}ind")
        left = _number(indent.get(f"{W}left", indent.get(f"{W}start"))) if indent is not None else styles.indent(style)
        id_ = _number(_value(p, "pPr/numPr/numId"))
        rows.append({
            "place": "body", "text": text, "style": style, "num_id": id_, "ilvl": _number(_value(p, "pPr/numPr/ilvl")) if id_ is not None else None, "style_ilvl": styles.level(style), "left_indent": left, "jc": _value(p, "pPr/jc"),
            "vanish": bool(own) or bool(runs) and all(styles.vanishes(style) if h is None else h for h in hidden), "note_style": styles.for_notes(style), "marked": any(_value(r, "rPr/highlight") not in (None, "none") for r in runs),
            "n_drawings": len(p.findall(f".//{W}drawing")), "article_ilvl": numbering.article_ilvl, "spec_shaped": id_ in numbering.spec_shaped,
        })
    rows += _controls(body)
    rows += [{"place": "table", "text": _text(c)} for t in body.iter(f"{W}tbl") for c in t.iter(f"{W}tc")]
    for name in sorted(parts):
        if m := re.fullmatch(r"word/(header|footer)\d*\.xml", name):
            rows += [{"place": m[1], "text": text} for p in parts[name].iter(f"{W}p") if (text := _text(p))]
    for c in parts["word/comments.xml"].iter(f"{W}comment") if "word/comments.xml" in parts else ():
        rows.append({"place": "comment", "text": _text(c), "author": c.get(f"{W}author"), "closed": c.get(f"{W}done") == "1"})
    for e in parts["docProps/core.xml"] if "docProps/core.xml" in parts else ():
        rows.append({"place": "property", "text": _clean(e.text), "style": e.tag.split("}")[-1]})
    counts: dict[str, int] = {}
    for row in rows:
        row["no"] = counts.get(row["place"], 0)
        counts[row["place"]] = row["no"] + 1
    return rows


def docx_facts(files: DataFrame) -> DataFrame:
    """The facts of (source_id, content) files."""
    types = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for source, content in zip(batch.column("source_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    out += [{"source_id": source} | row for row in docx_rows(content or b"")]
                except Exception as error:  # one bad file is a row, not the end of the load
                    out.append({"source_id": source, "place": "error", "no": 0, "text": f"{type(error).__name__}: {error}"[:200]})
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in out], types[c.split()[1]]) for n, c in zip(_NAMES, FACTS.split(", "), strict=True)], names=_NAMES)

    return files.select(F.col("source_id").cast("string").alias("source_id"), F.col("content").cast("binary").alias("content")).mapInArrow(run, FACTS)


_ILLEGAL = re.compile("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]")


def _xml(text: str | None) -> str:
    return escape(_ILLEGAL.sub("", text or ""))


def write_docx(title: str | None, section: str | None, lines: list[dict]) -> bytes:
    """A DOCX package. A line with an id is wrapped in a content control tagged with it. Lines have level (null: not numbered), text, direct (numbered by itself, else by its style), vanish, note and comments (author, text, closed); parts are listed in a table."""
    levels = "".join(f'<w:lvl w:ilvl="{n}"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:pStyle w:val="Level{n}"/><w:lvlText w:val="{"PART %1 -" if n == 0 else f"%{n + 1}."}"/></w:lvl>' for n in range(9))
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="Level{n}"><w:name w:val="Level {n}"/><w:pPr><w:numPr><w:ilvl w:val="{n}"/><w:numId w:val="1"/></w:numPr></w:pPr></w:style><w:style w:type="paragraph" w:styleId="Own{n}"><w:name w:val="Own {n}"/><w:basedOn w:val="Level{n}"/></w:style>' for n in range(9))
    styles += '<w:style w:type="paragraph" w:styleId="Note"><w:name w:val="Specifier Note"/></w:style>'
    body, comments = [], []
    for line in lines:
        level, props = line["level"], ""
        if line["note"]:
            props += '<w:pStyle w:val="Note"/>'
        elif level is not None:
            props += (f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="1"/></w:numPr>' if line["direct"] else f'<w:pStyle w:val="Own{level}"/>') + f'<w:ind w:left="{576 * level}"/>'
        run = "<w:rPr><w:vanish/></w:rPr>" if line["vanish"] else ""
        written = f'<w:p><w:pPr>{props}</w:pPr><w:r>{run}<w:t xml:space="preserve">{_xml(line["text"])}</w:t></w:r></w:p>'
        if line.get("id"):
            written = f'<w:sdt><w:sdtPr><w:tag w:val={quoteattr(_ILLEGAL.sub("", line["id"]))}/></w:sdtPr><w:sdtContent>{written}</w:sdtContent></w:sdt>'
        body.append(written)
        for c in line["comments"] or ():
            if c is not None:
                comments.append(f'<w:comment w:id="{len(comments)}" w:author={quoteattr(_ILLEGAL.sub("", c["author"] or ""))} w:done="{int(bool(c["closed"]))}"><w:p><w:r><w:t xml:space="preserve">{_xml(c["text"])}</w:t></w:r></w:p></w:comment>')
    cell = lambda text: f'<w:tc><w:p><w:r><w:t xml:space="preserve">{_xml(text)}</w:t></w:r></w:p></w:tc>'
    table = "".join(f"<w:tr>{cell('PART')}{cell(line['text'])}</w:tr>" for line in lines if line["level"] == 0 and not line["note"])
    if table:
        body.append(f"<w:tbl>{table}</w:tbl>")
    around = lambda tag, inner: f'<?xml version="1.0" encoding="UTF-8"?><w:{tag} xmlns:w="{SPACE}">{inner}</w:{tag}>'
    edge = lambda tag, text: around(tag, f'<w:p><w:r><w:t xml:space="preserve">{_xml(text)}</w:t></w:r></w:p>')
    kinds = {"document": "document.main", "numbering": "numbering", "styles": "styles", "comments": "comments", "header1": "header", "footer1": "footer"}
    files = {
        "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>' + "".join(f'<Override PartName="/word/{n}.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.{k}+xml"/>' for n, k in kinds.items()) + "</Types>",
        "_rels/.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/_rels/document.xml.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{n}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{n.rstrip("1")}" Target="{n}.xml"/>' for n in kinds if n != "document") + "</Relationships>",
        "word/document.xml": around("document", f"<w:body>{''.join(body)}</w:body>"), "word/numbering.xml": around("numbering", f'<w:abstractNum w:abstractNumId="0">{levels}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num>'),
        "word/styles.xml": around("styles", styles), "word/comments.xml": around("comments", "".join(comments)), "word/header1.xml": edge("hdr", f"SECTION {section or ''}"), "word/footer1.xml": edge("ftr", title),
        "docProps/core.xml": f'<?xml version="1.0" encoding="UTF-8"?><cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{_xml(title)}</dc:title><dc:subject>{_xml(section)}</dc:subject></cp:coreProperties>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in files.items():
            archive.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text.encode("utf-8", "replace"))
    return out.getvalue()


def docx_documents(lines: DataFrame, titles: DataFrame) -> DataFrame:
    """(source_id, content) of each document, from (source_id, section, key, level, text, direct, vanish, note, comments[, id]) ordered by the key, and (source_id, title). A document's lines meet in one row: the row is the document."""
    line = F.struct("key", "level", "text", "direct", "vanish", "note", "comments", *[c for c in ("id",) if c in lines.columns])
    whole = lines.groupBy("source_id").agg(F.max("section").alias("section"), F.array_sort(F.collect_list(line), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)).alias("lines")).join(titles, "source_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = [write_docx(t, s, x) for t, s, x in zip(*(batch.column(c).to_pylist() for c in ("title", "section", "lines")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("source_id"), pa.array(contents, pa.binary())], names=["source_id", "content"])

    return whole.select("source_id", "title", "section", "lines").mapInArrow(run, "source_id string, content binary")
