"""Readers: specification files to flat paragraph rows.

``read_files`` loads bytes with the binaryFile source; each reader is one Arrow pass that gives rows (source_id, node_no, parent_no, node_type, text, vanish).
A file that can't be read gives one row of type ``error`` with the reason, so that one bad file doesn't end a load.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from strataflow.functions import text as T

NODE = "source_id string, node_no int, parent_no int, node_type string, text string, vanish boolean"
#: Types by depth below the root.
TYPES = ("part", "article", "pr1", "pr2", "pr3", "pr4", "pr5", "pr6", "pr7")
#: Limits on what a reader opens.
MAX_BYTES, MAX_ENTRIES, MAX_RATIO, MAX_LINE = 50_000_000, 200, 100, 65_536

Row = tuple[int, int | None, str, str | None, bool]


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(source_id, content): the bytes of each file below the path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("source_id"), "content")


def _clean(text: str | None) -> str:
    return re.sub(r"[ \t\r\n]+", " ", text or "").strip()


def sec_nodes(raw: bytes) -> list[Row]:
    """Nodes of a SEC file: PRT parts, SPT by depth, TXT and LST and ITM below them, NTE and NPR as notes that vanish, SCN and STL as header."""
    if b"\x00" in raw:
        raise ValueError("NUL byte")
    text = raw.decode("utf-8", "replace")
    if any(len(line) > MAX_LINE for line in text.splitlines()):
        raise ValueError("line too long")
    if "<!DOCTYPE" in text or "<!ENTITY" in text:
        raise ValueError("entities are not allowed")
    root = ET.fromstring(re.sub(r"[\x01-\x08\x0b\x0c\x0e-\x1f]", "", text))
    rows: list[Row] = []

    def add(parent: int | None, kind: str, element: ET.Element | None, vanish: bool = False, own: bool = False) -> int:
        content = _clean(element.text if own else "".join(element.itertext())) if element is not None else ""
        rows.append((len(rows), parent, kind, content, vanish))
        return len(rows) - 1

    def walk(element: ET.Element, parent: int | None, depth: int) -> None:
        me = add(parent, TYPES[min(depth, len(TYPES) - 1)], element.find("TTL"))
        for tag, step in (("NTE", None), ("NPR", None), ("TXT", 0), ("LST", 1), ("ITM", 2), ("OLG/OLI", 1)):
            for child in element.findall(tag):
                if step is None:
                    add(me, "note", child, True)
                else:
                    add(me, "continuation" if step == 0 else TYPES[min(depth + step, len(TYPES) - 1)], child)
        for child in element.findall("SPT"):
            walk(child, me, depth + 1)

    for tag in ("SCN", "STL"):
        if root.find(tag) is not None:
            add(None, "header", root.find(tag))
    for note in root.findall("NTE"):
        add(None, "note", note, True)
    for part in root.findall("PRT"):
        walk(part, None, 0)
    return rows


W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_nodes(raw: bytes) -> list[Row]:
    """Paragraphs of a DOCX file by numbering level, else style level, else as continuations; hidden paragraphs vanish."""
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        entries = archive.infolist()
        if len(entries) > MAX_ENTRIES or sum(e.file_size for e in entries) > MAX_BYTES or any(e.file_size > MAX_RATIO * max(1, e.compress_size) for e in entries) or any(".." in e.filename or e.filename.startswith("/") for e in entries):
            raise ValueError("unsafe archive")
        data = archive.read("word/document.xml")
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        raise ValueError("entities are not allowed")
    rows: list[Row] = []
    stack: list[tuple[int, int]] = []
    for p in ET.fromstring(data).iter(f"{W}p"):
        text = _clean("".join(t.text or "" if t.tag == f"{W}t" else " " for t in p.iter() if t.tag in (f"{W}t", f"{W}tab", f"{W}br")))
        level = p.find(f"{W}pPr/{W}numPr/{W}ilvl")
        style = p.find(f"{W}pPr/{W}pStyle")
        at = int(level.get(f"{W}val", "0")) if level is not None else None
        if at is None and style is not None and (m := re.fullmatch(r"(?:Heading|PR|Level)(\d)", style.get(f"{W}val", ""))):
            at = int(m[1]) - 1
        vanish = p.find(f"{W}pPr/{W}rPr/{W}vanish") is not None
        if not text:
            continue
        if at is None:
            rows.append((len(rows), stack[-1][1] if stack else None, "continuation", text, vanish))
            continue
        at = min(at, len(TYPES) - 1)
        while stack and stack[-1][0] >= at:
            stack.pop()
        rows.append((len(rows), stack[-1][1] if stack else None, TYPES[at], text, vanish))
        stack.append((at, len(rows) - 1))
    return rows


def parse_files(files: DataFrame, parse: Callable[[bytes], list[Row]]) -> DataFrame:
    """The nodes of each file by one of the readers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_())
        for batch in batches:
            out: list[tuple] = []
            for source, content in zip(batch.column("source_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    out += [(source, *row) for row in parse(content or b"")]
                except Exception as error:  # one bad file is a row, not the end of the load
                    out.append((source, 0, None, "error", f"{type(error).__name__}: {error}"[:200], False))
            columns = list(zip(*out, strict=True)) if out else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in NODE.split(", ")])

    return files.select(F.col("source_id").cast("string").alias("source_id"), F.col("content").cast("binary").alias("content")).mapInArrow(run, NODE)


def text_tree(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, parent_no, kind, level, body) of each line that isn't blank: the parent is the nearest line before it of a smaller level.

    A continuation belongs to the nearest line with a level. No user code: the last line of each level is carried along by running aggregates of
    one window, and a line takes the greatest of those below its own level.
    """
    lines = documents.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).where(F.trim("line") != "")
    lines = lines.select(key, "line_no", T.line_class(F.col("line")).alias("c"), T.line_body(F.col("line")).alias("body")).select(key, "line_no", "c.kind", "c.level", "body")
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    levels = range(len(T.LINE_CLASSES))
    lines = lines.withColumns({f"_{n}": F.max(F.when(F.col("level") == n, F.col("line_no"))).over(before) for n in levels})
    below = [F.when(F.coalesce("level", F.lit(len(T.LINE_CLASSES))) > n, F.col(f"_{n}")) for n in levels]
    return lines.select(key, "line_no", F.greatest(*below).alias("parent_no"), "kind", "level", "body")


def sec_markup(title: Column, number: Column, paragraphs: Column) -> Column:
    """A SEC document of one part from a title, a section number and an array of paragraphs."""
    body = F.array_join(F.transform(paragraphs, lambda p: F.concat(F.lit("<SPT><TXT>"), T.escape_markup(p), F.lit("</TXT></SPT>"))), "")
    return F.concat(F.lit("<SEC><SCN>"), T.escape_markup(number), F.lit("</SCN><STL>"), T.escape_markup(title), F.lit("</STL><PRT><TTL>PART 1 GENERAL</TTL>"), body, F.lit("</PRT></SEC>"))


def sec_documents(lines: DataFrame, titles: DataFrame) -> DataFrame:
    """(source_id, content): a SEC document of each whole tree, from (source_id, number, key, depth, type, parent_type, text) of its nodes and (source_id, title).

    Nodes are ordered by the key, an array that begins with the parent's; close tags follow from the depths of neighbours. Roots are parts with their
    number, notes are NTE. A node with nodes below it, and each right below a part, is an SPT; another is an LST, or an ITM two or more types below its parent.
    """
    order = Window.partitionBy("source_id").orderBy("key")
    tier = lambda c: F.array_position(F.array(*[F.lit(x) for x in TYPES]), F.col(c))
    lines = lines.withColumns({"_next": F.coalesce(F.lead("depth").over(order), F.lit(0)), "_part": F.sum(F.when((F.col("depth") == 0) & (F.col("type") != "note"), 1).otherwise(0)).over(order)})
    body = T.escape_markup(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", ""))
    leaf = (F.col("type") != "note") & (F.col("depth") > 1) & (F.col("_next") <= F.col("depth"))
    opened = (F.col("type") != "note") & ~leaf
    closed = F.greatest(F.col("depth") - F.col("_next") + F.when(opened, 1).otherwise(0), F.lit(0))
    last = F.when((F.col("_next") == 0) & (closed > 0), 1).otherwise(0)
    around = lambda tag, text: F.concat(F.lit(f"<{tag}>"), text, F.lit(f"</{tag}>"))
    element = (
        F.when(F.col("type") == "note", around("NTE", around("NPR", body))).when(F.col("depth") == 0, F.concat(F.lit("<PRT>"), around("TTL", F.concat(F.lit("PART "), F.col("_part").cast("string"), F.lit("   "), body))))
        .when(leaf & (tier("type") - tier("parent_type") >= 2), around("ITM", body)).when(leaf, around("LST", body)).otherwise(F.concat(F.lit("<SPT>"), around("TTL", body)))
    )
    lines = lines.select("source_id", "number", F.struct("key", F.concat(element, F.repeat(F.lit("</SPT>"), closed - last), F.repeat(F.lit("</PRT>"), last)).alias("line")).alias("l"))
    whole = lines.groupBy("source_id").agg(F.max("number").alias("number"), F.array_sort(F.collect_list("l")).alias("ls")).join(titles, "source_id", "left")
    head = F.concat(F.lit("<SEC>"), around("SCN", F.concat(F.lit("SECTION "), T.escape_markup(F.coalesce("number", F.lit(""))))), around("STL", T.escape_markup(F.coalesce("title", F.lit("")))))
    # One element a line, as readers limit the length of lines.
    return whole.select("source_id", F.concat(head, F.lit("\n"), F.array_join(F.col("ls.line"), "\n"), F.lit("</SEC>")).alias("content"))
