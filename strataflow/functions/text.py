"""Scalar functions on titles, lines and prose, as columns that stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Article titles by role.
ARTICLE_ROLES = {
    "summary": ["SUMMARY", "SECTION INCLUDES"],
    "related-sections": ["RELATED SECTIONS", "RELATED REQUIREMENTS", "RELATED WORK", "RELATED DOCUMENTS"],
    "references": ["REFERENCES", "REFERENCE STANDARDS", "REFERENCED STANDARDS"],
    "definitions": ["DEFINITIONS"],
    "submittals": ["SUBMITTALS", "ACTION SUBMITTALS", "INFORMATIONAL SUBMITTALS"],
    "quality-assurance": ["QUALITY ASSURANCE"],
    "delivery-storage-handling": ["DELIVERY, STORAGE AND HANDLING", "DELIVERY, STORAGE, AND HANDLING", "DELIVERY STORAGE AND HANDLING"],
    "warranty": ["WARRANTY"],
}
#: Line classes in order of precedence: name, pattern, level.
LINE_CLASSES = (
    ("header", r"^SECTION\s+[0-9]", 0), ("part", r"^PART\s+[0-9]+", 1), ("article", r"^[0-9]+\.[0-9]+\s", 2), ("pr1", r"^[A-Z]\.\s", 3), ("pr2", r"^[0-9]+\.\s", 4),
    ("pr3", r"^[a-z]\.\s", 5), ("pr4", r"^[0-9]+\)\s", 6), ("pr5", r"^[a-z]\)\s", 7),
)


def collapse(text: Column) -> Column:
    """Runs of white space become one blank; the ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def division_of(section: Column) -> Column:
    """The two digits before the first blank, else null."""
    return F.nullif(F.regexp_extract(section, r"^([0-9]{2}) ", 1), F.lit(""))


def article_title(text: Column) -> Column:
    """A heading without its dotted number, in capitals."""
    return F.upper(collapse(F.regexp_replace(F.trim(text), r"^[0-9]+(\.[0-9]+)+(\s*[-–—.)]\s*|\s+)", "")))


def article_role(text: Column) -> Column:
    """The role of an article by its exact title, else null."""
    title = article_title(text)
    role = F.lit(None).cast("string")
    for name, titles in ARTICLE_ROLES.items():
        role = F.when(title.isin(titles), name).otherwise(role)
    return role


def line_class(line: Column) -> Column:
    """(class, level) of a line; a line of no class is a continuation without level."""
    text = F.trim(line)
    found = F.struct(F.lit("continuation").alias("kind"), F.lit(None).cast("int").alias("level"))
    for name, pattern, level in reversed(LINE_CLASSES):
        found = F.when(text.rlike(pattern), F.struct(F.lit(name).alias("kind"), F.lit(level).alias("level"))).otherwise(found)
    return found


def line_body(line: Column) -> Column:
    """A line without its label."""
    return F.regexp_replace(F.trim(line), r"^([0-9]+\.[0-9]+\s+|[A-Za-z][.)]\s+|[0-9]+[.)]\s+)", "")


def indent_level(line: Column) -> Column:
    """Leading tabs count four, blanks one; four make a level, six at most."""
    lead = F.regexp_extract(line, r"^([ \t]*)", 1)
    tabs = F.length(F.regexp_replace(lead, " ", ""))
    return F.least(F.floor((tabs * 4 + F.length(lead) - tabs) / 4), F.lit(6)).cast("int")


def normalized_key(text: Column) -> Column:
    """A name as a key: lower case, everything but letters and digits one blank."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, r"^([0-9]+(\.[0-9]+)*[.)]?|[A-Za-z][.)])\s+", "")), r"[^a-z0-9]+", " "))


def title_case(text: Column) -> Column:
    """Every ASCII letter at a word boundary becomes a capital, the others small."""
    parts = F.split(F.lower(text), r"(?<=[^a-z0-9_])(?=[a-z])")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), "")


def strip_tags(text: Column) -> Column:
    """Markup dropped, named entities decoded, white space collapsed."""
    plain = F.regexp_replace(text, "<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(plain, r"[ \t\r\n]+", " "))


def escape_markup(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def snippet(text: Column, term: str, around: int = 60, whole: int = 160) -> Column:
    """The text if it is short, else the stretch around the first match, with ellipses where it is cut."""
    at = F.locate(term.lower(), F.lower(text))
    begin = F.greatest(at - around, F.lit(1))
    end = at + len(term) + around - 1
    part = F.substr(text, begin, end - begin + 1)
    cut = F.concat(F.when(begin > 1, "…").otherwise(""), part, F.when(end < F.length(text), "…").otherwise(""))
    return F.when(at == 0, None).when(F.length(text) <= whole, text).otherwise(cut)


def citation_org(code: Column) -> Column:
    """The organisation of a standard's citation: what stands before the first white space, in capitals."""
    return F.upper(F.regexp_extract(F.trim(code), r"^(\S+)\s", 1))


def citation_code(code: Column) -> Column:
    return F.trim(F.regexp_extract(F.trim(code), r"^\S+\s+(.*)$", 1))


def stem(token: Column) -> Column:
    """A word without the first suffix that fits: ing, ied, ed, ies, es, s; a doubled last consonant after ing and ed is undone."""
    undouble = lambda base: F.when((F.substring(base, -1, 1) == F.substring(base, -2, 1)) & F.substring(base, -1, 1).rlike("[^aeiou]"), F.substr(base, F.lit(1), F.length(base) - 1)).otherwise(base)
    cut = lambda n: F.substr(token, F.lit(1), F.length(token) - n)
    size = F.length(token)
    return (
        F.when(token.endswith("ing") & (size > 6), undouble(cut(3)))
        .when(token.endswith("ied") & (size > 5), F.concat(cut(3), F.lit("y")))
        .when(token.endswith("ed") & (size > 5), undouble(cut(2)))
        .when(token.endswith("ies") & (size > 5), F.concat(cut(3), F.lit("y")))
        .when(token.endswith("es") & (size > 4), cut(2))
        .when(token.endswith("s") & (size > 4), cut(1))
        .otherwise(token)
    )


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def alpha_label(number: Column) -> Column:
    """1 -> A, 26 -> Z, 27 -> AA, 703 -> AAA and so on for every int; null for null and for numbers below 1."""
    number = number.cast("long")
    # The labels of n letters begin at 1 + 26 + ... + 26^(n - 1); the place among them is written with n digits of base 26.
    begins = [sum(26**k for k in range(n)) for n in range(1, 9)]
    letters = F.when(number < begins[1], 1)
    for n in range(2, 8):
        letters = letters.when(number < begins[n], n)
    place = number - F.element_at(F.array(*map(F.lit, begins)), letters)
    char = lambda i: F.chr(F.pmod(F.floor(place / F.pow(F.lit(26), i)), F.lit(26)) + 65)
    return F.when(number >= 1, F.array_join(F.transform(F.sequence(letters - 1, F.lit(0), F.lit(-1)), char), ""))
