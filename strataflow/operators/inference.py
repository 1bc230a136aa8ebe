"""Hierarchy inferred from what documents say of their paragraphs: numbering, styles, typed labels and indentation, as expressions over their facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strataflow.functions import lines as L
from strataflow.operators.comparison import hierarchy_confidence

#: From this level on an indentation speaks against an article that no other signal confirms.
CONTRADICTS = 3


def asterisks(text: Column) -> Column:
    return F.trim(text).rlike(r"^\*{5,}$")


def note_roles(rows: DataFrame, key: str, order: str, rule: Column, heading: Column, structural: Column) -> DataFrame:
    """The rows with ``role``: rule, note or none. Rules (usually rows of asterisks) open and close regions of notes and headings close them.

    A numbered row inside a region proves that the pairs have drifted; then the whole document has no regions (its rules become none as well). Two
    windows over a document, no collected groups.
    """
    rule = F.coalesce(rule, F.lit(False))
    heading = F.coalesce(heading, F.lit(False))
    upto = Window.partitionBy(key).orderBy(order)
    rows = rows.withColumn("_rule", rule).withColumn("_heading", heading & ~F.col("_rule")).withColumn("_stretch", F.sum(F.col("_heading").cast("int")).over(upto))
    opened = F.sum(F.col("_rule").cast("int")).over(Window.partitionBy(key, "_stretch").orderBy(order)) % 2 == 1
    rows = rows.withColumn("_note", opened & ~F.col("_rule") & ~F.col("_heading"))
    drifted = F.max(F.col("_note") & F.coalesce(structural, F.lit(False))).over(Window.partitionBy(key))
    role = F.when(drifted, "none").when(F.col("_rule"), "rule").when(F.col("_note"), "note").otherwise("none")
    return rows.withColumn("role", role).drop("_rule", "_heading", "_stretch", "_note")


def _level(ilvl: Column, article: Column) -> Column:
    """The level of a numbering level's node type; null for continuations."""
    return L.level_of(L.type_of(ilvl, article))


def inferred(facts: DataFrame) -> DataFrame:
    """(source_id, no, text, node_type, level, signal, agreed, conflicts, vanish, note, confidence) of each paragraph of docx_facts() bodies.

    Signals in order of trust: 1 the paragraph's own numbering (a part also needs its heading's form or a list made for specs), 2 that of its style, 4 its typed label, 5 its
    indentation. The first one wins, but an article of 1 or 2 that no other confirms gives way to a deep indentation. agreed: other signals of the same level;
    conflicts: levels of those that differ. Notes, hidden rows, separators and rows without signal are continuations (signal 3) at the level of the last row before them that is none.
    """
    text, article = F.col("text"), F.coalesce("article_ilvl", F.lit(1))
    body = facts.where("place = 'body'")
    off = F.coalesce(F.col("num_id") == 0, F.lit(False))
    one = F.when(F.col("num_id").isNotNull() & ~off & F.col("ilvl").isNotNull(), _level(F.col("ilvl"), article))
    one = F.when(~((one == 0) & ~text.rlike(r"(?i)^\s*PART\s+\d+") & ~F.coalesce("spec_shaped", F.lit(False))), one)
    two = F.when(~off, _level(F.col("style_ilvl"), article))
    five = F.when(~F.coalesce(F.col("jc").isin("center", "right", "end"), F.lit(False)), L.indent_signal(F.col("left_indent")))
    rows = body.select("source_id", "no", "text", "vanish", "note_style", one.alias("s1"), two.alias("s2"), L.text_signal(text).alias("s4"), five.alias("s5"), (F.coalesce(F.col("num_id") > 0, F.lit(False)) | two.isNotNull()).alias("_structural"))
    rows = note_roles(rows, "source_id", "no", asterisks(F.col("text")), F.col("s4") <= 1, F.col("_structural"))
    note = (F.col("role") == "note") | F.coalesce("note_style", F.lit(False)) | L.opens_note(text) | L.reveals_notes(text)
    out = note | F.coalesce("vanish", F.lit(False)) | (F.col("role") == "rule") | L.separates(text)
    names = ("s1", "s2", "s4", "s5")
    hits = F.array_compact(F.array(*[F.when(F.col(s).isNotNull(), F.struct(F.lit(int(s[1])).alias("signal"), F.col(s).alias("level"))) for s in names]))
    rows = rows.withColumn("note", note).withColumn("_hits", F.when(out, F.array().cast("array<struct<signal: int, level: int>>")).otherwise(hits))
    first = F.get("_hits", F.lit(0))
    votes = F.size(F.filter("_hits", lambda h: (h["signal"] != 5) & (h["level"] == 1)))
    misplaced = (first["level"] == 1) & first["signal"].isin(1, 2) & (votes <= 1) & F.coalesce(F.col("s5") >= CONTRADICTS, F.lit(False))
    rows = rows.withColumn("_won", F.when(misplaced, F.get(F.filter("_hits", lambda h: h["level"] != 1), F.lit(0))).otherwise(first))
    won = F.col("_won")
    agreed = F.transform(F.filter("_hits", lambda h: (h["signal"] != won["signal"]) & (h["level"] == won["level"])), lambda h: h["signal"])
    conflicts = F.transform(F.filter("_hits", lambda h: h["level"] != won["level"]), lambda h: h["level"])
    before = F.last(F.col("_won.level"), ignorenulls=True).over(Window.partitionBy("source_id").orderBy("no"))
    kind = F.get(F.array(*map(F.lit, L.LEVELS)), F.col("_won.level"))
    rows = rows.select(
        "source_id", "no", "text", F.coalesce(kind, F.lit("continuation")).alias("node_type"), F.coalesce(before, F.lit(0)).alias("level"), F.coalesce(won["signal"], F.lit(3)).alias("signal"),
        F.coalesce(agreed, F.array().cast("array<int>")).alias("agreed"), F.coalesce(conflicts, F.array().cast("array<int>")).alias("conflicts"), (note | F.coalesce("vanish", F.lit(False))).alias("vanish"), "note",
    )
    return rows.withColumn("confidence", F.when(F.col("node_type") != "continuation", hierarchy_confidence(F.col("signal"), F.col("agreed"), F.col("conflicts"), F.col("level"))))


def nested(rows: DataFrame) -> DataFrame:
    """inferred() rows with ``parent_no``: the nearest row before of a smaller level; continuations hang on the nearest row that is none. No user code: the last row of each level is carried by one window."""
    before = Window.partitionBy("source_id").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    real = F.col("node_type") != "continuation"
    rows = rows.withColumns({f"_{n}": F.max(F.when(real & (F.col("level") == n), F.col("no"))).over(before) for n in range(len(L.LEVELS))})
    above = F.greatest(*[F.when(~real | (F.col("level") > n), F.col(f"_{n}")) for n in range(len(L.LEVELS))])
    return rows.withColumn("parent_no", above).drop(*[f"_{n}" for n in range(len(L.LEVELS))])
