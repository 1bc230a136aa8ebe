"""Noise in text from scanned pages: running headers, footers and page numbers, words cut at line ends, misread words.

Headers and footers are lines that repeat, up to misread characters, at the page edges of an extraction or of many; page numbers are sequences
that keep step with the pages. The remaining lines are the spec's; a vocabulary counted over all pages says which line ends cut a word and which
words are misread, and the lines are joined into paragraphs.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strataflow.storage import stage

# What scanners commonly read for what stands there. What else this corpus' scanners confuse is learned from its words (see ``confusions``).
CONFUSED = (
    ("c", "e"), ("f", "t"), ("0", "o"), ("1", "l"), ("1", "i"), ("l", "i"), ("cl", "d"), ("!", "i"), ("!", "l"), ("ri", "n"), ("5", "s"), ("(", "c"), ("b", "h"), ("ii", "u"), ("ii", "n"), ("£", "f"),
    ("6", "b"), ("rn", "m"), ("vv", "w"), ("9", "g"), ("h", "li"), ("m", "rn"), ("d", "cl"), ("8", "b"), ("|", "l"), ("e", "c"), ("n", "ri"), ("$", "s"), ("@", "a"),
)
#: One form for characters that are read for each other: letters that look like two, then the others.
PAIRS = (("d", "cl"), ("n", "rl"), ("m", "rrl"), ("w", "vv"), ("u", "ll"), ("h", "ll"), ("b", "ll"), ("6", "ll"), ("8", "ll"))
FOLD = str.maketrans({"e": "c", "(": "c", "f": "t", "£": "t", "0": "o", "1": "l", "i": "l", "!": "l", "|": "l", "5": "s", "$": "s", "9": "g", " ": None, "\xa0": None})
MARKS = "-‐‑¬­"
NUMBER = r"[0-9lIiOoSsBbZz!|()]{1,4}"
DIGITS = r"[0-9lIiOoSsBb]{2}"
PAGE = tuple(
    re.compile(p)
    for p in (
        rf"(?i:pg|page|pag|p|sheet|seite|página|pagina)\s?\.?\s*({NUMBER})(?:\s*(?:of|/|de|von|sur)\s*{NUMBER})?",
        rf"[-–—]\s*({NUMBER})\s*[-–—]", rf"\[\s*({NUMBER})\s*\]", rf"({NUMBER})\s*/\s*{NUMBER}", rf"{DIGITS} {DIGITS} {DIGITS}(?:\.{DIGITS}(?: {DIGITS})?)?\s*[-–]\s*({NUMBER})",
    )
)
ROMAN = re.compile(r"(m{0,3})(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})")
ROMAN_DIGITS = (("m", 1000), ("cm", 900), ("d", 500), ("cd", 400), ("c", 100), ("xc", 90), ("l", 50), ("xl", 40), ("x", 10), ("ix", 9), ("v", 5), ("iv", 4), ("i", 1))
PARTS = re.compile(r"\s+[/–—|-]\s+")
STANDS_ALONE = re.compile(r"(?<![^\W_])\d[\d.]*(?![^\W_])")
FOUR_LETTERS = re.compile(r"(?:[\W\d_]*[^\W\d_]){4}")
WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
ASCII_WORD = re.compile(r"[a-z]+(?:[-'][a-z]+)*")
TOKEN_ENDS = ".,;:?“”\"'’[]{}"
#: Lines from an edge that may be furniture, and the share of extractions a line or of words a word must have to be handed to all tasks;
#: what is rarer is joined to the extractions that ask for it.
DEPTH, SHARE, WORD_SHARE = 3, 1e-4, 1e-6
#: Lines at an edge that are compared without an index of their pieces.
FEW = 40
#: Learned confusions: words from how many occurrences on are taken as right, and how many words must show a confusion: so many, and that share of what the commonest one has.
RIGHT, SHOWN, SHOWN_SHARE = 20, 3, 0.05
#: A word with signs or digits of the kind that letters are misread as.
MIXED = re.compile(r"[a-z]*[0-9!$@|(£][a-z]{2,}[a-z0-9!$@|(£]*|[a-z]{2,}[0-9!$@|(£]+[a-z]*")
#: A misread word's correction is so many times as common as the word, and occurs at least so often.
TIMES, LEAST = 8, 3


def folded(text: str) -> str:
    for one, two in PAIRS:
        text = text.replace(one, two)
    return text.translate(FOLD)


def line_key(line: str) -> str:
    """What a line has in common with its misread copies: numbers and spaces aside, characters folded."""
    return folded(STANDS_ALONE.sub("#", line.lower()))


def same_line(line: str) -> str:
    """As line_key(), but numbers count: a header's are the same on every page."""
    return folded(line.lower())


def lettered(line: str) -> bool:
    return FOUR_LETTERS.match(line) is not None


def roman_value(text: str) -> int | None:
    text = text.lower()
    if not text or not ROMAN.fullmatch(text):
        return None
    value, at = 0, 0
    for digits, n in ROMAN_DIGITS:
        while text.startswith(digits, at):
            value, at = value + n, at + len(digits)
    return value


def roman_text(value: int) -> str:
    out = ""
    for digits, n in ROMAN_DIGITS:
        out += digits * (value // n)
        value %= n
    return out


def number_value(text: str) -> int | None:
    text = text.translate(str.maketrans("lIi!|OoSsBbZz()", "11111005588221" + "1"))
    return int(text) if text.isdigit() else None


def close_lines(short: str, long: str) -> bool:
    """Two characters differ at most, or a stretch of three is missing; another number would differ in more."""
    if len(short) == len(long):
        return sum(map(str.__ne__, short, long)) <= 2
    if len(long) - len(short) > 3:
        return False
    head = next((i for i, (a, b) in enumerate(zip(short, long, strict=False)) if a != b), len(short))
    tail = next((i for i, (a, b) in enumerate(zip(reversed(short), reversed(long), strict=False)) if a != b), len(short))
    return head + tail >= len(short) - 1


def pieces(key: str) -> Iterator[tuple]:
    """What two lines of close_lines() have in common: of five pieces three at least if they are of one length, else half of the shorter one at an end."""
    n = len(key)
    cuts = [n * i // 5 for i in range(6)]
    five = [key[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    for chosen in itertools.combinations(range(5), 3):
        yield n, chosen, "".join(five[i] for i in chosen)
    for shorter in range(max(1, n - 3), n + 1):
        half = shorter // 2
        yield shorter, "head", key[:half]
        yield shorter, "tail", key[n - half :]


class Edges:
    """The lines at one edge of an extraction's pages, by what they are like. Nearly equal lines are met by their pieces, so the work grows with the lines and not with their pairs."""

    def __init__(self) -> None:
        self.on: dict[str, set[int]] = defaultdict(set)
        self.parts: dict[str, list[str]] = {}

    def add(self, page: int, key: str, parts: list[str]) -> None:
        self.on[key].add(page)
        self.parts[key] = parts

    @functools.cached_property
    def alike(self) -> dict[str, set[int]]:
        """For each line the pages of others that are nearly it, or that are a part of it or have it as a part between separators (left and right pages differ)."""
        found: dict[str, set[int]] = defaultdict(set)
        long = [key for key in self.on if len(key) >= 10]
        for key in long:
            for part in self.parts[key]:
                if len(part) >= 10 and part != key and part in self.on:
                    found[key] |= self.on[part]
                    found[part] |= self.on[key]
        by: dict[tuple, list[str]] = defaultdict(list)
        if len(long) <= FEW:  # a few lines meet by their lengths alone
            long.sort(key=len)
            by = {i: [key for key in long[i:] if len(key) - len(long[i]) <= 3] for i in range(len(long))}
        else:
            for key in long:
                for piece in pieces(key):
                    by[piece].append(key)
        seen: set[tuple[str, str]] = set()
        for lines in by.values():
            for i, one in enumerate(lines):
                for two in lines[:1] if len(long) <= FEW and i else lines[:i]:
                    # Two pages of either are all that is asked for.
                    if len(found[one]) > 1 and len(found[two]) > 1 or (one, two) in seen:
                        continue
                    seen.add((one, two))
                    if close_lines(*sorted((one, two), key=len)):
                        found[one] |= self.on[two]
                        found[two] |= self.on[one]
        return found


class Document:
    """The pages' lines of one extraction, with what each line is."""

    def __init__(self, pages: list[tuple[int, list[str]]]) -> None:
        self.pages = pages
        self.furniture: list[set[int]] = [set() for _ in pages]

    def edge(self, page: int) -> Iterator[tuple[str, int]]:
        """(side, line) of a page's outer lines, outermost first."""
        n = len(self.pages[page][1])
        for k in range(min(DEPTH, n)):
            yield "top", k
        for k in range(min(DEPTH, n)):
            yield "end", n - 1 - k

    def find_furniture(self, known: dict[str, bool] | Lookups) -> None:
        """known: for keys of lines that repeat over extractions whether they are furniture."""
        if len(self.pages) < 2:
            return
        edges = {"top": Edges(), "end": Edges()}
        steps: dict[tuple[str, str, int], set[int]] = defaultdict(set)
        outer: list[tuple[int, str, int, str, str]] = []
        keys: dict[str, tuple[str, list[str]]] = {}
        for p, (number, lines) in enumerate(self.pages):
            for side, k in self.edge(p):
                line = " ".join(lines[k].split())
                if line not in keys:
                    keys[line] = same_line(line), [same_line(x) for x in PARTS.split(line)]
                key, parts = keys[line]
                edges[side].add(p, key, parts)
                outer.append((p, side, k, line, key))
                for kind, value in self._numbers(line):
                    steps[side, kind, value - number].add(p)
        offsets = {(side, kind): offset for (side, kind, offset), on in sorted(steps.items(), key=lambda x: len(x[1])) if len(on) > 1}
        marked: dict[tuple[int, int], bool] = {}
        repeats: dict[tuple[str, str], bool | None] = {}
        for p, side, k, line, key in outer:
            number, lines = self.pages[p]
            good = False
            if lettered(line):
                if (side, line) not in repeats:  # a line that repeats over extractions is judged by these
                    repeats[side, line] = known.get(line_key(line), None)
                good = repeats[side, line]
                if good is None:
                    good = len(edges[side].on[key]) > 1 or bool(len(key) >= 10 and edges[side].alike.get(key, set()) - {p}) or self._known_part(line, known)
            if not good:
                good = any(m.fullmatch(line) for m in PAGE) or any(offsets.get((side, kind)) == value - number for kind, value in self._numbers(line))
            if not good and (side, "roman") in offsets and len(line) <= 9:
                good = line_key(line) == line_key(roman_text(max(0, number + offsets[side, "roman"])))
            if not good and line.isdigit() and int(line) == number and k in (0, len(lines) - 1) and len(lines) > 1:
                good = len(lines[k + 1 if k == 0 else k - 1].split()) > 3  # beside running text, not in a table's column
            if not good and (side, "plain") in offsets and len(line) <= 6:
                good = number_value(line) == number + offsets[side, "plain"]
            marked[p, k] = marked.get((p, k), False) or good
        for p, (_, lines) in enumerate(self.pages):
            for order in (range(len(lines)), range(len(lines) - 1, -1, -1)):
                for k in order:
                    if not marked.get((p, k)):
                        break
                    self.furniture[p].add(k)

    @staticmethod
    def _numbers(line: str) -> Iterator[tuple[str, int]]:
        if line.isdigit() and len(line) <= 6:
            yield "plain", int(line)
        elif len(line) <= 15 and (value := roman_value(line)) is not None:
            yield "roman", value

    @staticmethod
    def _known_part(line: str, known: dict[str, bool] | Lookups) -> bool:
        """A part of the line between separators is known furniture by itself."""
        parts = PARTS.split(line)
        return len(parts) > 1 and any(lettered(x) and len(line_key(x)) >= 10 and known.get(line_key(x), False) for x in parts)

    def spec_lines(self) -> list[tuple[int, int, str]]:
        """(page, line, text) of the lines that aren't furniture, blank lines aside."""
        return [(p, k, line) for p, (_, lines) in enumerate(self.pages) for k, line in enumerate(lines) if k not in self.furniture[p] and line.strip()]


class Lookups:
    """What is known of common words or lines, and of those that one extraction asked for (None: nothing is). Other keys are noted in ``asked``."""

    def __init__(self, common: dict, given: dict) -> None:
        self.common, self.given, self.asked = common, given, set()

    def get(self, key: str, default=None):
        found = self.common.get(key)
        if found is None:
            found = self.given.get(key)
            if found is None and key not in self.given:
                self.asked.add(key)
        return default if found is None else found

    def __contains__(self, key: str) -> bool:
        return self.get(key) is not None


class Vocabulary:
    def __init__(self, counts: dict[str, int] | Lookups, top: int | None = None, confused: tuple[tuple[str, str], ...] = CONFUSED) -> None:
        """top: the count of the commonest word, where counts can't be gone through."""
        self.counts, self.confused = counts, confused
        if top is not None:
            self.top = top
        self.store: dict[str, str | None] = {}
        self.fixes: dict[str, str | None] = {}

    def correction(self, word: str) -> str | None:
        """The word that this lower-case one is misread from, or None where it is none."""
        if word not in self.store:
            if len(self.store) > 200_000:
                self.store.clear()
            self.store[word] = self._correction(word)
        return self.store[word]

    def _correction(self, word: str) -> str | None:
        if len(word) < 3 or sum(c.isalpha() for c in word) * 2 < len(word):
            return None
        own, plain = self.counts.get(word, 0), word.isalpha()
        best, most = None, (max(LEAST, TIMES * own) if plain else max(1, TIMES * own)) - 1
        for seen, true in self.confused:
            if seen not in word:
                continue
            options = {word.replace(seen, true)}
            at = word.find(seen)
            while at >= 0:
                options.add(word[:at] + true + word[at + len(seen) :])
                at = word.find(seen, at + 1)
            for option in options:
                if option != word and (n := self.counts.get(option, 0)) > most:
                    best, most = option, n
        return best

    def fix(self, token: str, alone: bool = False) -> str | None:
        """As _fix(), which is asked once for each token."""
        if alone:
            return self._fix(token, alone)
        if token not in self.fixes:
            if len(self.fixes) > 200_000:
                self.fixes.clear()
            self.fixes[token] = self._fix(token, alone)
        return self.fixes[token]

    def _fix(self, token: str, alone: bool) -> str | None:
        """The token of a line put right, or None where nothing is misread. alone: the line has an opening bracket without a closing one."""
        core = token.strip(TOKEN_ENDS).strip(MARKS[1:])
        if not alone:
            core = core.strip("()")
        elif core.startswith("(") and self.counts.get("c" + core[1:].lower(), 0) < LEAST:
            core = core[1:]
        if len(core) < 3 or re.fullmatch(r"[A-Z]{2,5}-?\d+|[\d.,\-–/]+", core):
            return None
        low = core.lower()
        if low.isalpha() and self.counts.get(low, 0) * TIMES > self.top and not alone:
            return None
        new = self.correction(low)
        if new is None and "-" in low and low not in self.counts:
            parts = [self.correction(x) or x for x in low.split("-")]
            new = "-".join(parts) if parts != low.split("-") else None
        if new is None:
            return None
        new = new.upper() if core.isupper() and len(core) > 1 else new[:1].upper() + new[1:] if core[0].isupper() or token[:1].isupper() else new
        return token.replace(core, new, 1)

    @functools.cached_property
    def top(self) -> int:
        return max(self.counts.values(), default=0)

    def cut(self, left: str, right: str) -> str | None:
        """left-hand and right-hand part as one word where the mark between them isn't the word's own; None where it is."""
        joined, kept = (left + right).lower(), (left + "-" + right).lower()
        one, two = self.counts.get(joined, 0), self.counts.get(kept, 0)
        if one or two:
            return left + right if one >= two else None
        if self.correction(kept) is not None and self.correction(joined) is None:
            return None
        if "-" in joined:  # a part of a compound: judge the piece at the mark
            a, b = left.split("-")[-1], right.split("-")[0]
            if (a + b).lower() in self.counts:
                return left + right
        a, b = left.lower().split("-")[-1], right.lower().split("-")[0]
        if self.correction(joined) is None and min(self.counts.get(a, 0), self.counts.get(b, 0)) >= max(LEAST, 3) and len(a) > 3 and len(b) > 3:
            return None
        return left + right


LINE_END = re.compile(rf"([^\W\d_][^\s]*)([{MARKS}])$")
LINE_START = re.compile(r"[^\W\d_(!£0-9]*[^\s]*")


def find_noise(document: Document, vocabulary: Vocabulary) -> list[tuple[int, int, str, str | None]]:
    """(page, line, noise, note) of each noisy line; note: the joined word of a cut."""
    found: list[tuple[int, int, str, str | None]] = []
    for p, lines in enumerate(document.furniture):
        found += [(p, k, "furniture", None) for k in sorted(lines)]
    lines = document.spec_lines()
    misread: set[tuple[int, int]] = set()
    cuts = []
    skip_first: set[int] = set()
    for i, (p, k, text) in enumerate(lines[:-1]):
        m = text.rstrip()[-1:] in MARKS and LINE_END.search(text.rstrip())
        following = lines[i + 1][2].split()
        if not m or not following:
            continue
        left = text.rstrip()[:-1].split()[-1].lstrip("“\"'")
        right = following[0].rstrip(TOKEN_ENDS + ")")
        if not left or not right or not right[0].isalpha() and right[0] not in "(!£0156|9":
            continue
        if re.fullmatch(r"[A-Z]{2,5}", left) and right[:1].isdigit():
            continue
        skip_first.add(i + 1)
        whole = vocabulary.cut(left, right)
        if whole is not None:
            cuts.append((p, k, "hyphen", whole))
        joined = (left + right if whole is not None else left + "-" + right).lower()
        if (new := vocabulary.correction(joined)) is not None or (whole is None and vocabulary.fix(joined) is not None):
            new = new or vocabulary.fix(joined)
            at = next((n for n, (a, b) in enumerate(zip(joined, new, strict=False)) if a != b), min(len(joined), len(new)))
            misread.add((p, k) if at < len(left) else lines[i + 1][:2])
    found += cuts
    if not found:
        return found
    for i, (p, k, text) in enumerate(lines):
        tokens = text.split()
        alone = text.count("(") != text.count(")")
        last = len(tokens) - 1 if i + 1 in skip_first else len(tokens)
        for n, token in enumerate(tokens[:last]):
            if not (n == 0 and i in skip_first) and vocabulary.fix(token, alone) is not None:
                misread.add((p, k))
                break
    return found + [(p, k, "misread", None) for p, k in sorted(misread)]


def readable(document: Document, vocabulary: Vocabulary) -> str:
    """The spec's text: furniture left out, cut words joined, misread words put right, lines joined into paragraphs."""
    noise = find_noise(document, vocabulary)
    cuts = {(p, k): note for p, k, kind, note in noise if kind == "hyphen"}
    scanned = bool(noise)
    lines = document.spec_lines()
    width = max((len(t) for _, _, t in lines), default=0)
    paragraphs: list[list[str]] = []
    carried: str | None = None
    ended = True
    for p, k, text in lines:
        tokens = text.split()
        if carried is not None:
            if tokens:
                tail = tokens[0][len(tokens[0].rstrip(TOKEN_ENDS + ")")) :]
                tokens[0] = carried + tail
            carried = None
        note = cuts.get((p, k))
        if note is not None and tokens:
            tokens.pop()
            carried = note
        if scanned:
            alone = text.count("(") != text.count(")")
            tokens = [vocabulary.fix(t, alone) or t for t in tokens]
        if ended or not paragraphs:
            paragraphs.append([])
        paragraphs[-1] += tokens
        ended = carried is None and (text.rstrip()[-1:] in ".:?!" and len(text) < 0.8 * width or text.isupper() or len(text) < 0.5 * width)
    return "\n".join(" ".join(t) for t in paragraphs if t)


def document_of(pages: list[dict] | None) -> Document:
    """Null pages and null texts count as empty; pages are taken in the order of their numbers."""
    rows = [(x["page_number"], x["text"]) for x in pages or [] if x is not None]
    rows = [(n if n is not None else i + 1, t) for i, (n, t) in enumerate(rows)]
    return Document([(n, (t or "").split("\n")) for n, t in sorted(rows, key=lambda r: r[0])])


def confusions(words: DataFrame) -> list[tuple[str, str]]:
    """(seen, true) pieces of one or two characters that this corpus' scanners confuse, from (what, n) of its words.

    A rare word that differs from one at least TIMES as common in one piece only shows the confusion of that piece. Words meet by what is left of them
    without the piece, in an equi-join, and only counts by pair of pieces are collected, whose number is bounded by the alphabet.
    """
    def without_piece(rows: DataFrame, name: str) -> DataFrame:
        at = rows.where(F.length("what").between(4, 40)).select("what", "n", F.explode(F.sequence(F.lit(1), F.length("what"))).alias("i")).select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
        at = at.where("i + k - 1 <= length(what) AND length(what) - k >= 3")
        return at.select(F.expr("concat(substr(what, 1, i - 1), '\u0001', substr(what, i + k))").alias("rest"), F.expr("substr(what, i, k)").alias(name), F.col("n").alias(f"n_{name}"))

    true = without_piece(words.where((F.col("n") >= RIGHT) & F.col("what").rlike("^[a-z]+$")), "true")
    seen = without_piece(words.where(F.col("what").rlike("^[ -~£]+$")), "seen")
    same_end = lambda f: f("seen") == f("true")
    pairs = seen.join(true, "rest").where((F.col("n_true") >= TIMES * F.col("n_seen")) & ~same_end(lambda c: F.substring(c, 1, 1)) & ~same_end(lambda c: F.substring(c, -1, 1)) & (F.length("seen") + F.length("true") < 4))
    counts = [(r["seen"], r["true"], r["n"]) for r in pairs.groupBy("seen", "true").agg(F.count("*").alias("n")).where(F.col("n") >= SHOWN).collect()]
    most = max((n for _, _, n in counts), default=0)
    return sorted((a, b) for a, b, n in counts if n >= SHOWN_SHARE * most)


def learn(extractions: DataFrame) -> tuple[tuple[dict[str, int], dict[str, bool], int, bool, tuple[tuple[str, str], ...]], DataFrame]:
    """((common words with their counts, common lines with whether they are furniture, the highest count, whether these are all, confused pieces), table of all).

    The words and lines of any count, a line in 3 extractions at least, are in the table (kind, what, n). The common ones are of bounded size: a word
    must make up WORD_SHARE of all words (so there are at most 1 / WORD_SHARE of them), a line must stand in SHARE of the extractions.
    Each task counts its own rows first.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, str]] = Counter()
        vocabulary: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            counts["all", "words"] += vocabulary.total()
            counts.update({("word", w): n for w, n in vocabulary.items()})
            vocabulary.clear()
            keys = list(counts)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())], names=["kind", "what", "n"])

        for batch in batches:
            for pages in batch.column(0).to_pylist():
                document = document_of(pages)
                edges, inner = set(), set()
                counts["all", "extractions"] += 1
                for p, (_, lines) in enumerate(document.pages):
                    cut = False
                    for k, line in enumerate(lines):
                        low = line.lower()
                        words = (ASCII_WORD if low.isascii() else WORD).findall(low)
                        if cut:
                            words = words[1:]
                        cut = line.rstrip()[-1:] in MARKS and bool(line.strip())
                        vocabulary.update(words[:-1] if cut else words)
                        if MIXED.search(low):
                            counts.update(("mixed", x) for x in MIXED.findall(low))
                        if lettered(line):
                            outer = min(k, len(lines) - 1 - k)
                            if outer >= DEPTH:
                                inner.add(line_key(" ".join(line.split())))
                            elif p and outer < 2 and len(document.pages) > 1:
                                edges.add(line_key(" ".join(line.split())))
                counts.update(("edge", k) for k in edges)
                counts.update(("inner", k) for k in inner)
            if len(counts) + len(vocabulary) > 500_000:
                yield flush()
                counts.clear()
        yield flush()

    rows = stage(extractions.select("pages").mapInArrow(count, "kind string, what string, n long").groupBy("kind", "what").agg(F.sum("n").alias("n")), "page-words")
    total = {r["what"]: r["n"] for r in rows.where("kind = 'all'").toLocalIterator()}
    words = rows.where("kind = 'word'")
    top, distinct = words.agg(F.max("n"), F.count("*")).first()
    top = top or 0
    confused = CONFUSED + tuple(x for x in confusions(rows.where("kind IN ('word', 'mixed')").select("what", "n")) if x not in CONFUSED)
    lines = rows.where("kind IN ('edge', 'inner')").groupBy("what").agg(F.sum(F.when(F.col("kind") == "edge", F.col("n")).otherwise(0)).alias("edge"), F.sum(F.when(F.col("kind") == "inner", F.col("n")).otherwise(0)).alias("inner"))
    lines = lines.where((F.col("edge") + F.col("inner") >= 3) & (F.col("edge") > 0))
    # All are handed out where they are no more than the floors let through.
    least_word = WORD_SHARE * total.get("words", 0) if distinct * WORD_SHARE > 1 else 0
    least_line = SHARE * total.get("extractions", 0) if lines.count() * SHARE > 1 else 0
    known = {r["what"]: r["edge"] > 4 * r["inner"] for r in lines.where(F.col("edge") + F.col("inner") >= F.lit(least_line)).toLocalIterator()}
    common = {r["what"]: r["n"] for r in words.where(F.col("n") >= F.lit(least_word)).toLocalIterator()}
    table = words.select("kind", "what", "n").unionByName(lines.select(F.lit("line").alias("kind"), "what", (F.col("edge") > 4 * F.col("inner")).cast("long").alias("n")))
    return (common, known, top, least_word <= 1 and least_line <= 3, confused), table


def opened(batches: Iterator[pa.RecordBatch], learned: tuple) -> Iterator[tuple[pa.RecordBatch, Iterator[tuple[Document, Vocabulary, Lookups | dict]]]]:
    """Each batch with its documents, their furniture found, and the vocabulary and lines to read them by."""
    words, known, top, whole, confused = learned
    vocabulary = Vocabulary(words, top, confused)

    def documents(batch: pa.RecordBatch) -> Iterator[tuple[Document, Vocabulary, Lookups | dict]]:
        given = [()] * len(batch) if whole else batch.column("more").to_pylist()
        for pages, more in zip(batch.column("pages").to_pylist(), given, strict=True):
            spelled, lines = vocabulary, known
            if not whole:
                spelled = Vocabulary(Lookups(words, {x["what"]: x["n"] for x in more or () if x["kind"] == "word"}), top, confused)
                lines = Lookups(known, {x["what"]: None if x["n"] is None else x["n"] > 0 for x in more or () if x["kind"] == "line"})
            document = document_of(pages)
            document.find_furniture(lines)
            yield document, spelled, lines

    for batch in batches:
        yield batch, documents(batch)


def with_lookups(extractions: DataFrame):
    """(extractions, broadcast of what is common); where that isn't all, ``more`` has what each extraction asks for of the rest.

    What is asked depends on the answers, so rounds go on until none asks for more. An answer is of the size of its extraction.
    """
    learned, table = learn(extractions)
    shared = extractions.sparkSession.sparkContext.broadcast(learned)
    rows = extractions.select("extraction_id", "pages")
    if learned[3]:
        return rows, shared

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, documents in opened(batches, shared.value):
            out = []
            for row, (document, vocabulary, lines) in zip(batch.column("_row").to_pylist(), documents, strict=True):
                readable(document, vocabulary)
                out += [(row, "word", x) for x in vocabulary.counts.asked] + [(row, "line", x) for x in lines.asked]
            columns = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)], names=["_row", "kind", "what"])

    rows = stage(rows.withColumn("_row", F.monotonically_increasing_id()), "scans")
    found = None
    current = rows.withColumn("more", F.expr("cast(array() AS array<struct<kind: string, what: string, n: bigint>>)"))
    while True:
        asked = stage(current.mapInArrow(ask, "_row long, kind string, what string"), "asked")
        if asked.isEmpty():
            return current, shared
        answers = asked.join(table, ["kind", "what"], "left").select("_row", "kind", "what", "n")
        found = stage(answers if found is None else found.unionByName(answers), "answers")
        current = rows.join(found.groupBy("_row").agg(F.collect_list(F.struct("kind", "what", "n")).alias("more")), "_row", "left")


def scan_noise(extractions: DataFrame) -> DataFrame:
    """(extraction_id, page_number, line_no, noise) of every noisy line; lines count from 1. A line may be hyphen and misread; furniture is only furniture.

    Extractions of a single page have no furniture; their cut words are found, and misread ones where a word is cut. Null pages, null and empty texts have no lines of interest. Repeated rows
    give one row; an empty table gives none. Other columns are ignored.
    """
    rows, shared = with_lookups(extractions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, documents in opened(batches, shared.value):
            out = []
            for id_, (document, vocabulary, _) in zip(batch.column("extraction_id").to_pylist(), documents, strict=True):
                out += [(id_, document.pages[p][0], k + 1, noise) for p, k, noise, _ in find_noise(document, vocabulary)]
            columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["extraction_id", "page_number", "line_no", "noise"])

    return rows.mapInArrow(run, "extraction_id bigint, page_number int, line_no int, noise string").distinct()


def readable_texts(extractions: DataFrame) -> DataFrame:
    """(extraction_id, text): continuous paragraphs of each extraction, one a line. Extractions without pages have an empty text."""
    rows, shared = with_lookups(extractions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, documents in opened(batches, shared.value):
            texts = [readable(document, vocabulary) for document, vocabulary, _ in documents]
            yield pa.RecordBatch.from_arrays([batch.column("extraction_id"), pa.array(texts, pa.string())], names=["extraction_id", "text"])

    return rows.mapInArrow(run, "extraction_id bigint, text string")
