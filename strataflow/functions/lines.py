"""What a line, name or pattern looks like, as columns: outline signals, note banners, prefixes, product names, safety of patterns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from strataflow.functions.sections import canonical_section, section_format
from strataflow.functions.text import collapse, normalized_key, title_case

# Node types by level, and what a line's head says of them, in order of precedence.
LEVELS = ("part", "article", "pr1", "pr2", "pr3", "pr4", "pr5", "pr6", "pr7")
SIGNALS = (
    (r"(?i)^PART\s+\d+", 0), (r"(?i)^\d+\.0+[\s.:—–-]+(GENERAL|PRODUCTS|EXECUTION)\b", 0), *((rf"^\d+(\.\d+){{{dots}}}\s+", dots) for dots in range(8, 0, -1)),
    (r"^[A-Z]\.\s", 2), (r"^\d+\.\s", 3), (r"^[a-z]\.\s", 4), (r"^\d+\)\s", 5), (r"^[a-z]\)\s", 6),
)
# Kinds of submittals.
SUBMITTALS = (
    ("Product Data", r"\b(sd-?03\s+)?product data\b"), ("Shop Drawings", r"\b(sd-?02\s+)?shop drawings?\b"), ("Samples", r"\b(sd-?04\s+)?samples?\b"), ("Design Data", r"\b(sd-?05\s+)?design data\b"), ("Test Reports", r"\b(sd-?06\s+)?test reports?\b"),
    ("Certificates", r"\b(sd-?07\s+)?(certificates?|manufacturer'?s certificates?)\b"), ("Operation and Maintenance Data", r"\b(sd-?10\s+)?(operation and maintenance data|o&m data)\b"),
)
TWIPS, DEEPEST = 576, 8
PATTERN_LENGTH = 200


def level_of(kind: Column) -> Column:
    """The level of a node type, part 0 to pr7 8; null for others."""
    return F.nullif(F.array_position(F.array(*map(F.lit, LEVELS)), kind), F.lit(0)).cast("int") - 1


def type_of(ilvl: Column, article: Column) -> Column:
    """The node type of a numbering level where articles stand at level ``article``: 0 is a part, levels between are reserved, deeper ones continue."""
    at = ilvl - article
    return F.when(ilvl == 0, "part").when(ilvl < article, "continuation").otherwise(F.coalesce(F.get(F.array(*map(F.lit, LEVELS[1:])), at), F.lit("continuation")))


def tier_of(ilvl: Column, article: Column) -> Column:
    return F.when(ilvl < article, "part").when(ilvl == article, "article").when(ilvl == article + 1, "paragraph").otherwise("subparagraph")


def text_signal(line: Column) -> Column:
    """The level that a line's head speaks for, else null. Lines of fewer than four characters say nothing."""
    text = F.trim(line)
    found = F.lit(None).cast("int")
    for pattern, level in reversed(SIGNALS):
        found = F.when(text.rlike(pattern), level).otherwise(found)
    return F.when(F.length(text) >= 4, found)


def indent_signal(twips: Column) -> Column:
    """The level that an indentation speaks for: 576 twips a level, halves rounded up, 1 to 8, else null."""
    level = F.floor(twips / TWIPS + 0.5).cast("int")
    return F.when(level.between(1, DEEPEST), level)


_NOTE = r"NOTES? TO (THE )?SPEC(IFIER|S| WRITER)?S?\b"
_NOTES = r"SPEC(IFIER)?S? NOTES?\b"


def opens_note(line: Column) -> Column:
    """The line opens with a banner of a note to the specifier, whatever decorates it."""
    plain = F.upper(F.regexp_replace(F.regexp_replace(F.trim(line), "^[^A-Za-z0-9]+", ""), r"\s+", " "))
    return plain.rlike(f"^{_NOTE}") | plain.rlike(f"^{_NOTES}")


def holds_note(text: Column) -> Column:
    """Such a banner stands anywhere."""
    plain = F.upper(F.regexp_replace(text, r"\s+", " "))
    return plain.rlike(_NOTE) | plain.rlike(_NOTES)


def reveals_notes(text: Column) -> Column:
    """An instruction to show hidden notes."""
    return F.upper(F.regexp_replace(text, r"\s+", " ")).rlike(r"\bHIDDEN NOTES? TO (THE )?SPECIFIER")


def separates(line: Column) -> Column:
    """A rule of decoration characters, or OR between alternatives, however decorated."""
    text = F.trim(line)
    return (F.length(text) >= 2) & (text.rlike(r"^[\s*=•·—–-]{3,}$") | (F.upper(F.regexp_replace(text, r"[\s*=•·—–\[\]()-]", "")) == "OR"))


def is_section_line(line: Column, section: Column) -> Column:
    """The line is the document's own section number, with or without the word SECTION, in any spelling."""
    bare = F.regexp_replace(F.trim(line), r"(?i)^SECTION\s+", "")
    return (section != "unknown") & section_format(bare).isNotNull() & (canonical_section(bare) == section)


def is_title_line(line: Column, title: Column) -> Column:
    return (title != "unknown") & (F.upper(collapse(line)) == F.upper(collapse(title)))


_PART = r"(?i)^\s*PART\s+\d+[\s.:—–-]*(?=[a-z])"
_DECIMAL_PART = r"(?i)^\s*\d+\.0+[\s.:—–-]*(?=[a-z])"
_OUTLINE = r"^\s*\d+(\.\d+){2,}[\s.:—–-]*(?=[A-Za-z])"


def _stripped(text: Column, *patterns: str) -> Column:
    """(text, removed) without the first of the prefixes that is there; null where none is or nothing would be left."""
    found = F.lit(None).cast("string")
    for pattern in reversed(patterns):
        found = F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 0)).otherwise(found)
    rest = F.trim(F.substr(text, F.length(found) + 1))
    return F.when(found.isNotNull() & (F.length(rest) > 0), F.struct(rest.alias("text"), F.length(found).alias("removed")))


def part_stripped(text: Column) -> Column:
    return _stripped(text, _PART, _DECIMAL_PART)


def outline_stripped(text: Column) -> Column:
    """Without an outline number of two dots or more."""
    return _stripped(text, _OUTLINE)


def without_part(text: Column) -> Column:
    return F.coalesce(part_stripped(text)["text"], F.trim(text))


def odd_part_number(text: Column) -> Column:
    """A part whose number has decimals."""
    return text.rlike(r"(?i)^\s*PART\s+\d+\.\d")


def rebased(spans: Column, removed: Column, length: Column) -> Column:
    """(start, end) spans after so many characters were taken off the front: shifted, clipped to the text, empty ones dropped."""
    moved = F.transform(spans, lambda s: s.withField("start", F.greatest(s["start"] - removed, F.lit(0))).withField("end", F.least(s["end"] - removed, length)))
    return F.filter(moved, lambda s: s["end"] > s["start"])


def without_outline(text: Column) -> Column:
    """Collapsed text without its leading outline numbers and letters."""
    text = collapse(text)
    for pattern in (r"^\d+(\.\d+)*\s+", r"^[A-Za-z]\.\s+", r"^\d+[.)]\s+", r"^[a-z][.)]\s+"):
        text = F.regexp_replace(text, pattern, "")
    return F.trim(text)


def product_name(text: Column) -> Column:
    """The product that a paragraph names before its colon (or as a whole), else null: not empty, at most 90 characters, no instruction, no product data, and six words at most where a colon opens it."""
    clean = without_outline(text)
    colon = F.locate(":", clean)
    name = collapse(F.when(colon > 1, F.substr(clean, F.lit(1), colon - 1)).otherwise(clean))
    fits = F.length(name).between(1, 90) & ~name.rlike(r"(?i)^(provide|submit|install|coordinate|comply|conform|see|verify)\b") & ~((colon == 1) & (F.size(F.split(name, " ")) > 6)) & ~normalized_key(name).contains("product data")
    return F.when(fits, title_case(without_outline(name)))


def submittal_types(text: Column) -> Column:
    """The kinds of submittals that a text asks for; none where it says that they aren't required."""
    kinds = F.array_compact(F.array(*[F.when(text.rlike(f"(?i){pattern}"), label) for label, pattern in SUBMITTALS]))
    return F.when(text.rlike(r"(?i)\b(not required|not be required|no product data required)\b"), F.array().cast("array<string>")).otherwise(kinds)


def escaped_pattern(text: Column) -> Column:
    """A text as a pattern that matches itself."""
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def like_pattern(text: Column) -> Column:
    return F.concat(F.lit("%"), F.regexp_replace(text, r"([\\%_])", r"\\$1"), F.lit("%"))


def file_name(path: Column) -> Column:
    """The last part of a path, whichever slash it is written with."""
    return F.regexp_extract(F.regexp_replace(path, r"[/\\]+$", ""), r"([^/\\:]*)$", 1)


def clean_line(text: Column) -> Column:
    """Without soft hyphens, white space collapsed."""
    return collapse(F.replace(text, F.lit("­"), F.lit("")))


def garbage_score(text: Column) -> Column:
    """How garbled a text looks: sequences of wrong decoding, control characters, symbols, and few letters."""
    size = F.length(text)
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    few = F.when((size == 0) | (count("[A-Za-z]") / F.greatest(size, F.lit(1)) < 0.12), 4).otherwise(0)
    symbols = F.when(size == 0, 0).otherwise(F.floor(count(r"[$&=+_*<>|{}~`^\\]") * 12 / F.greatest(size, F.lit(1)) + 0.5))
    return (count("[ÂÃâ][\u0080-￿]{1,2}|�") * 3 + count("[\\x00-\\x08\\x0e-\\x1f\\x80-\\x9f]") * 4 + symbols + few).cast("int")


def checkpoint_id(anchor: Column) -> Column:
    """The id in ``checkpoint:<uuid>``, else null."""
    return F.nullif(F.regexp_extract(anchor, "^checkpoint:([0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})$", 1), F.lit(""))


def image_type(content: Column) -> Column:
    """The media type that an image's first bytes name, else null."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head == "89504E470D0A1A0A", "image/png").when(head.startswith("FFD8FF"), "image/jpeg").when(head.rlike("^474946383[79]61"), "image/gif").when(head.startswith("424D"), "image/bmp")


def pattern_refused(pattern: str) -> str | None:
    """Why a pattern given by a user isn't run, else null: too long, not a pattern, or a repetition without end inside another. The parsed pattern is walked, so this is for the driver."""
    import re
    from re import _constants as C, _parser as parser

    if len(pattern) > PATTERN_LENGTH:
        return "too long"
    try:
        tree = parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return "no pattern"

    def endless(node: object, inside: bool) -> bool:
        if isinstance(node, parser.SubPattern):
            return any(endless(x, inside) for x in node)
        if isinstance(node, tuple) and len(node) == 2 and node[0] in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            open_ = node[1][1] == C.MAXREPEAT
            return (open_ and inside) or endless(node[1][2], inside or open_)
        return isinstance(node, tuple | list) and any(endless(x, inside) for x in node)

    return "endless repetition" if endless(tree, False) else None
