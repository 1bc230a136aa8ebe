import io
import zipfile

from helpers import T0, frame, rows
from pyspark.sql import functions as F

from strataflow.functions import sections as S, text as X
from strataflow.operators import comparison as C, findings as N, history as H, search as R, tree as T
from strataflow.sources import documents as D
from strataflow.streaming import sessions as W

import datetime


def column(spark, value, f, kind="string"):
    return frame(spark, [(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


def test_sections(spark):
    for raw, wanted in {"01 47 00": "01 47 00", " 014700": "01 47 00", "01.47.00.10": "01 47 00.10", "01\xa047\xa000.10 20 ": "01 47 00.10 20", "Section 01 4700": "01 47 00", "none": "none", "": ""}.items():
        assert column(spark, raw, S.canonical_section) == wanted
    assert column(spark, None, S.canonical_section) is None
    assert column(spark, "01 47 00.10", lambda c: S.format_section(c, "compact")) == "014700.10"


def test_scalars(spark):
    for value, wanted in {"welding": "weld", "stopped": "stop", "pipes": "pip", "flies": "fli", "assemblies": "assembly", "doors": "door", "gas": "gas", "applied": "apply", "": ""}.items():
        assert column(spark, value, X.stem) == wanted
    assert column(spark, "o-ring type-x", X.title_case) == "O-Ring Type-X"
    assert column(spark, "1.2 - related  sections", X.article_role) == "related-sections"
    assert column(spark, "\t    x", X.indent_level) == 2
    assert [column(spark, n, X.alpha_label, "int") for n in (1, 26, 27, 52, 53, 702, 703, 1000, 18278, 18279, 0, None)] == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA", "ALL", "ZZZ", "AAAA", None, None]
    assert column(spark, "<b>a &amp; b</b>\n c", X.strip_tags) == "a & b c"
    assert column(spark, "x" * 200 + " seal " + "y" * 200, lambda c: X.snippet(c, "seal")).startswith("…")


def test_labels_and_visibility(spark):
    schema = "paragraph_id string, spec_id string, spec_section string, parent_id string, node_type string, text string, sibling_position int, vanish boolean"
    data = [
        ("A", "s", "01", None, "part", "P", 0, False), ("b", "s", "01", "a", "article", "x", 1, True), ("c", "s", "01", "b", "pr1", "y", 0, False), ("d", "s", "01", "a", "note", "n", 2, True), ("e", "s", "01", "d", "pr1", None, 0, None), ("f", "s", "01", "a", "article", "z", 3, False),
    ]
    p = frame(spark, data, schema)
    nodes = T.nodes_of(p)
    found = {r["id"]: r for r in T.carried(T.ordinals(nodes), T.gone(), T.address(), T.nearest_of("article"), T.preorder()).collect()}
    assert {k for k, r in found.items() if r["gone"]} == {"b", "c"}
    assert sorted(found, key=lambda k: found[k]["sort_key"]) == ["a", "b", "c", "d", "e", "f"]
    assert found["e"]["address"] == "part:1/note:-/pr1:1"
    assert {r["id"]: r["l"] for r in T.ordinals(nodes).select("id", T.label(F.col("type"), F.col("ordinal")).alias("l")).collect()}["f"] == ".2"
    assert {k: tuple(r["near"]) for k, r in found.items() if r["near"]} == {"b": ("b", 0), "c": ("b", 1), "f": ("f", 0)}


def test_sessions_seals_and_gaps(spark):
    minute = datetime.timedelta(minutes=1)
    data = [(1, T0 + m * minute, v, seal) for v, (m, seal) in enumerate([(0, False), (10, False), (20, True), (21, False), (60, False)])]
    found = H.sessions(frame(spark, data, "k int, t timestamp, v int, s boolean"), "k", "t", "v", "s")
    assert [(r["first_version"], r["last_version"], r["n_rows"], r["sealed_by"]) for r in found.orderBy("first_version").collect()] == [(0, 1, 2, 2), (3, 3, 1, None), (4, 4, 1, None)]


def test_three_way(spark):
    side = lambda d: frame(spark, list(d.items()), "k string, v string")
    base = {"same": "a", "mod": "a", "con": "a", "del": "a", "delcon": "a", "both": "a", "ours": "a"}
    ours = {"same": "a", "mod": "a", "con": "o", "del": "a", "delcon": "o", "both": "n", "ours": "o", "new": "x"}
    theirs = {"same": "a", "mod": "t", "con": "t", "both": "n", "ours": "a", "add": "t"}
    found = dict(rows(H.three_way(side(base), side(ours), side(theirs), ["k"], "v")))
    assert found == {"same": "unchanged", "mod": "modified", "con": "conflict", "del": "deleted", "delcon": "delete_conflict", "both": "unchanged", "ours": "unchanged", "new": "unchanged", "add": "added"}


def test_votes(spark):
    data = [("a", 1, 1), ("a", 2, 2), ("a", 2, 3), ("b", 5, 1), ("b", 3, 2), ("b", 9, 3), ("b", 3, 4), ("b", 5, 5), ("c", None, 1)]
    found = {r["k"]: r for r in C.winner(frame(spark, data, "k string, v int, at int"), "k", "v", "at").collect()}
    assert (found["a"]["winner"], found["a"]["rule"]) == (2, "majority")
    assert (found["b"]["mode"], found["b"]["lower_median"], found["b"]["rule"]) == (5, 5, "median")


def test_search(spark):
    p = frame(spark, [("p1", "s", "Drains and membrane near drains"), ("p2", "s", "membrane only"), ("p3", "s", "drain the membrane in the chapel"), ("p4", "s", None)], "paragraph_id string, section string, text string")
    assert [r["paragraph_id"] for r in R.counted(p, "drain membrane").collect()] == ["p1", "p3"]
    assert [r["paragraph_id"] for r in R.cover_ranked(p, "drain membrane -chapel").collect()] == ["p1"]
    assert R.counted(p, "  ").count() == 0


def test_findings(spark):
    catalogue = frame(spark, [("07 84 00", "Firestopping"), ("01 00 00", "General Requirements")], "section_number string, title string")
    titles = N.title_keywords(catalogue)
    p = frame(spark, [("x", "26 05 00", "p1", "Seal openings with firestopping."), ("x", "26 05 00", "p0", "Nothing here")], "spec_id string, section string, paragraph_id string, text string")
    known = frame(spark, [], "spec_id string, section string")
    assert rows(N.implied_sections(p, titles, known)) == [("x", "07 84 00", "p1", "firestop", 0.72)]
    assert rows(N.implied_sections(p, titles, frame(spark, [("x", "07 84 00")], "spec_id string, section string"))) == []


def test_readers(spark):
    sec = b"<SEC><SCN>27 41 00</SCN><STL>Audio &amp; Video</STL><PRT><TTL>PART 1 GENERAL</TTL><SPT><TTL>1.1 SUMMARY</TTL><TXT>Text <REF>x</REF></TXT><LST>item</LST><NTE>hidden</NTE><SPT><TXT>deep</TXT></SPT></SPT></PRT></SEC>"
    files = frame(spark, [("good", sec), ("bad", b"<SEC>"), ("nul", b"\x00"), ("none", None)], "source_id string, content binary")
    nodes = D.parse_files(files, D.sec_nodes).collect()
    good = [(r["node_no"], r["parent_no"], r["node_type"], r["text"], r["vanish"]) for r in nodes if r["source_id"] == "good"]
    assert good == [(0, None, "header", "27 41 00", False), (1, None, "header", "Audio & Video", False), (2, None, "part", "PART 1 GENERAL", False), (3, 2, "article", "1.1 SUMMARY", False), (4, 3, "note", "hidden", True), (5, 3, "continuation", "Text x", False), (6, 3, "pr1", "item", False), (7, 3, "pr1", "", False), (8, 7, "continuation", "deep", False)]
    assert {r["source_id"] for r in nodes if r["node_type"] == "error"} == {"bad", "nul", "none"}
    ns = D.W.strip("{}")
    par = lambda text, level=None: f"<w:p>{'' if level is None else f'<w:pPr><w:numPr><w:ilvl w:val=\"{level}\"/></w:numPr></w:pPr>'}<w:r><w:t>{text}</w:t></w:r></w:p>"
    body = f'<w:document xmlns:w="{ns}"><w:body>{par("PART 1", 0)}{par("SUMMARY", 1)}{par("more")}{par("PART 2", 0)}</w:body></w:document>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", body)
    docx = D.parse_files(frame(spark, [("d", data.getvalue())], "source_id string, content binary"), D.docx_nodes).collect()
    assert [(r["node_no"], r["parent_no"], r["node_type"]) for r in docx] == [(0, None, "part"), (1, 0, "article"), (2, 1, "continuation"), (3, None, "part")]


def test_sec_tree_written_and_read(spark, tmp_path):
    from strataflow.plans.ingest import sec_trees

    schema = "paragraph_id string, spec_id string, spec_section string, parent_id string, node_type string, text string, sibling_position int, vanish boolean"
    data = [
        ("P1", "S", "01 00 00", None, "part", "GENERAL", 0, False), ("a", "s", "01 00 00", "p1", "article", "A & B", 0, False), ("n", "s", "01 00 00", "a", "note", "keep", 2, True), ("b", "s", "01 00 00", "a", "pr1", "first", 0, False),
        ("c", "s", "01 00 00", "b", "pr2", "deep\x00", 0, False), ("d", "s", "01 00 00", "c", "pr3", "deeper", 0, False), ("a-1", "s", "01 00 00", "a", "pr2", "item", 1, False), ("e", "s", "01 00 00", "a", "pr1", "gone", 3, True),
        ("f", "s", "01 00 00", "e", "pr2", "gone too", 0, False), ("p2", "s", "01 00 00", None, "part", None, 1, None), ("g", "s", "01 00 00", "p2", "article", "alone", 0, False),
    ]
    frame(spark, data, schema).write.parquet(str(tmp_path / "paragraphs.parquet"))
    frame(spark, [("s", "Title <1>")], "spec_id string, title string").write.parquet(str(tmp_path / "specs.parquet"))
    nodes = D.parse_files(sec_trees(spark, str(tmp_path)), D.sec_nodes).collect()
    at = {(r["source_id"], r["node_no"]): r["text"] for r in nodes}
    read = [(r["node_type"], at.get((r["source_id"], r["parent_no"])), r["text"], r["vanish"]) for r in sorted(nodes, key=lambda r: r["node_no"])]
    assert read == [
        ("header", None, "SECTION 01 00 00", False), ("header", None, "Title <1>", False), ("part", None, "PART 1 GENERAL", False), ("article", "PART 1 GENERAL", "A & B", False), ("note", "A & B", "keep", True),
        ("pr2", "A & B", "item", False), ("pr1", "A & B", "first", False), ("pr2", "first", "deep", False), ("pr3", "deep", "deeper", False), ("part", None, "PART 2", False), ("article", "PART 2", "alone", False),
    ]


def test_states_at_own_versions_fold_the_whole_log(spark, tmp_path):
    from strataflow.plans.history import states_at_own_versions

    data = [(1, "u", "x", 1.0), (2, "u", "y", 2.0), (9001, "u", "x", 3.0), (9002, "u", "y", 60.0), (9003, "w", "x", 4.0), (9004, None, "x", 5.0), (9008, None, "x", 6.0)]
    frame(spark, data, "event_id long, user_id string, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    found = states_at_own_versions(spark, str(tmp_path)).select("user_id", "version", "event_type", "value")
    assert rows(found) == sorted([("u", 4501, "x", 1.0), ("u", 4501, "y", 2.0), ("u", 9002, "x", 3.0), ("w", 9003, "x", 4.0), (None, 9006, "x", 5.0), (None, 9008, "x", 6.0)], key=repr)


def test_read_files(spark, tmp_path):
    (tmp_path / "a.sec").write_bytes(b"<SEC><SCN>01 00 00</SCN></SEC>")
    (tmp_path / "b.txt").write_text("x")
    assert D.parse_files(D.read_files(spark, str(tmp_path), "*.sec"), D.sec_nodes).count() == 1


def test_text_tree(spark):
    text = "SECTION 01 00 00\nPART 1 GENERAL\nA. one\nmore\n\n1. deep\nB. two\nloose"
    found = D.text_tree(frame(spark, [(1, text), (2, None), (3, "")], "doc_id int, text string"), "doc_id", "text")
    assert [(r["line_no"], r["parent_no"]) for r in found.orderBy("line_no").collect()] == [(0, None), (1, 0), (2, 1), (3, 2), (5, 2), (6, 1), (7, 6)]


def test_streams(spark, tmp_path):
    minute = datetime.timedelta(minutes=1)
    log = frame(spark, [(1, T0), (1, T0 + 10 * minute), (1, T0 + 90 * minute), (2, T0)], "k int, t timestamp")
    log.write.parquet(str(tmp_path / "log"))
    stream = W.change_stream(spark, str(tmp_path / "log"), log.schema)
    assert sorted(r["n_rows"] for r in W.run_available(W.session_windows(stream, "k", "t"), "s", "complete").collect()) == [1, 1, 2]
