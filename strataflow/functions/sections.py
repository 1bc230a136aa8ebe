"""Section numbers: many spellings, one canonical form."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Space characters that Java's \\s leaves out.
WIDE_SPACES = "\\u00a0\\u1680\\u2000-\\u200a\\u202f\\u205f\\u3000\\ufeff"


def plain_spaces(text: Column) -> Column:
    """Runs of any space character become one blank; the ends are trimmed."""
    return F.trim(F.regexp_replace(text, f"[\\s{WIDE_SPACES}]+", " "))


def canonical_section(text: Column) -> Column:
    """``NN NN NN``, ``NN NN NN.NN`` or ``NN NN NN.NN NN`` from any spelling of six, eight or ten digits.

    Null stays null. A text that isn't a section number is returned with plain spaces only.
    """
    clean = plain_spaces(F.regexp_replace(F.lower(text), "^\\s*section", ""))
    digits = F.regexp_replace(clean, "[ .\\-]", "")
    six = F.concat_ws(" ", F.substring(digits, 1, 2), F.substring(digits, 3, 2), F.substring(digits, 5, 2))
    suffix = F.when(F.length(digits) == 6, "").when(F.length(digits) == 8, F.concat(F.lit("."), F.substring(digits, 7, 2)))
    suffix = suffix.otherwise(F.concat(F.lit("."), F.substring(digits, 7, 2), F.lit(" "), F.substring(digits, 9, 2)))
    return F.when(digits.rlike("^([0-9]{6}|[0-9]{8}|[0-9]{10})$"), F.concat(six, suffix)).otherwise(clean)


def section_format(raw: Column) -> Column:
    """How a section number is written: canonical, dots, compact, spaced-compact, or null where it is none."""
    text = plain_spaces(raw)
    return (
        F.when(text.rlike(r"^\d{2} \d{2} \d{2}(\.\d{2}( \d{2})?)?$"), "canonical")
        .when(text.rlike(r"^\d{2}\.\d{2}\.\d{2}(\.\d{2}( \d{2})?)?$"), "dots")
        .when(text.rlike(r"^\d{6}(\.\d{2}( \d{2})?)?$"), "compact")
        .when(text.rlike(r"^\d{2} \d{4}(\.\d{2}( \d{2})?)?$"), "spaced-compact")
    )


def format_section(canonical: Column, style: str) -> Column:
    """A canonical number in another style; suffixes are kept and other texts pass through."""
    order = {"dots": "$1.$2.$3$4", "compact": "$1$2$3$4", "spaced-compact": "$1 $2$3$4"}.get(style, "$1 $2 $3$4")
    return F.regexp_replace(canonical, r"^(\d{2}) (\d{2}) (\d{2})((?:\.\d{2}(?: \d{2})?)?)$", order)


# A number in prose, and one where a section is meant: not inside longer numbers, the agency's suffix on the same line.
_BLANK = f"[\\s{WIDE_SPACES}]"
_SAME_LINE = f"[ \\t{WIDE_SPACES}]"
_SUFFIX = rf"(?:\.\d{{2}}(?!\d)(?:{_SAME_LINE}+\d{{2}}(?!\d))?)?"
NUMBER = rf"(?<![\d.])(\d{{2}}{_BLANK}+\d{{2}}{_BLANK}+\d{{2}}{_SUFFIX})(?!\d)"
CANDIDATE = rf"(?<![\d.])((?:\d{{2}}{_BLANK}+\d{{2}}{_BLANK}+\d{{2}}|\d{{2}}{_BLANK}+\d{{4}}|\d{{2}}\.\d{{2}}\.\d{{2}}|\d{{6}}){_SUFFIX})(?!\d)(?!\.\d)"
_TITLE = r"(?:\s*[-–—]\s*(.+))?"


def section_heading(line: Column) -> Column:
    """(section, title) of a line that is a section's heading, else null."""
    parts = F.lit(None).cast("struct<section: string, title: string>")
    for pattern in (f"^{NUMBER}{_TITLE}", rf"(?i)SECTION\s+{CANDIDATE}{_TITLE}"):
        raw, title = F.regexp_extract(line, pattern, 1), F.trim(F.regexp_extract(line, pattern, 2))
        parts = F.when(line.rlike(pattern), F.struct(canonical_section(raw).alias("section"), F.when(title == "", "unknown").otherwise(title).alias("title"))).otherwise(parts)
    return parts


def section_numbers_in(text: Column) -> Column:
    """All section numbers in prose, in order and in canonical form."""
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1)), canonical_section)
