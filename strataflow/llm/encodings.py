"""Text decoded with the wrong character encoding: finding it and putting the original back.

A hidden Markov model has a clean state, one state per encoding pair and one for lost characters. It labels the characters beyond ASCII (plain ones say nothing
of the state); those that some UTF-8 state reads together as one character have one label, so a row of such characters can pass from one state to another. A
state emits characters with the probability that clean text has what the state's inverse transform makes of them between its neighbours; the most likely
path labels them, and each labelled span gets its state's inverse transform. Emissions and transitions are counted over all texts and items: first over
what no inverse transform can read, then twice over what was found clean.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: (true encoding, encoding it was read with, times) of each state after the clean one; the last state holds lost characters.
PAIRS = (
    ("utf-8", "cp1252", 1), ("utf-8", "latin-1", 1), ("utf-8", "cp1252", 2), ("utf-8", "latin-1", 2), ("utf-8", "mac_roman", 1), ("utf-8", "cp437", 1), ("utf-8", "cp850", 1),
    ("utf-8", "cp1250", 1), ("utf-8", "cp1251", 1), ("utf-8", "iso8859-2", 1), ("utf-8", "iso8859-15", 1), ("cp1252", "mac_roman", 1), ("mac_roman", "cp1252", 1), ("cp1252", "cp437", 1),
    ("cp437", "cp1252", 1), ("cp1252", "cp850", 1), ("cp850", "cp1252", 1), ("cp1252", "cp1251", 1), ("cp1252", "cp1250", 1),
)
CLEAN, LOST = 0, len(PAIRS) + 1
#: States of one-byte encodings. They can read nearly any letter, so they begin and end between runs only, not inside a word.
ONE_BYTE = frozenset(n for n, (true, _, _) in enumerate(PAIRS, 1) if true != "utf-8")
#: Log probabilities: bounds of entering a garbled state and of leaving it (both are counted in training), of a character that its state can't read, and the least of one.
ENTER, LEAVE, UNREAD, LEAST = (-8.5, -2.0), (-2.5, -0.5), -8.0, math.log(2e-5)
#: Of a sequence that lost its end; where a UTF-8 state reads the same characters as whole ones, it is out of the question: a character that can be restored is never given up.
CUT, NEVER = -7.0, -60.0
#: Weight, in occurrences, of what is known without the neighbours, the part of a character's overall frequency that then holds, and occurrences added to those of the clean state. Keys of transitions begin with STATE.
PRIOR, BACK, MOVES, STATE = 20.0, 0.05, 30, "\x01"
RUN = re.compile(r"[^\x00-\x7f]+")
#: What a non-breaking space may have become in a garbled sequence.
BLANK = " "


@functools.cache
def bytes_of(encoding: str) -> dict[str, int]:
    """The byte of each character of a one-byte encoding; bytes without a character stand for the control character of that number."""
    table = {}
    for byte in range(0x80, 0x100):
        try:
            table[bytes([byte]).decode(encoding)] = byte
        except UnicodeDecodeError:
            table[chr(byte)] = byte
    return table


@functools.cache
def characters_of(encoding: str) -> dict[int, str]:
    return {byte: char for char, byte in bytes_of(encoding).items()}


Piece = tuple[str, bool, int]


def _utf8(run: str, encoding: str, least: int = 0xA0) -> list[Piece]:
    """Pieces of the run: (text, whether it was read, characters it is made of). A piece that was read is one character, from ``least`` on, from a whole UTF-8 sequence."""
    table, pieces, i = bytes_of(encoding), [], 0
    while i < len(run):
        lead = table.get(run[i], 0)
        need = 1 if 0xC2 <= lead <= 0xDF else 2 if 0xE0 <= lead <= 0xEF else 3 if 0xF0 <= lead <= 0xF4 else 0
        if need and len(run) > i + need:
            raw = bytes([lead, *(table.get(c, 0) for c in run[i + 1 : i + 1 + need])])
            try:
                char = raw.decode("utf-8")
                if len(char) == 1 and ord(char) >= least:
                    pieces.append((char, True, need + 1))
                    i += need + 1
                    continue
            except UnicodeDecodeError:
                pass
        if need > 1 and i + 2 == len(run) and table.get(run[i + 1], 0) & 0xC0 == 0x80:  # its last byte had no character and was dropped
            pieces.append(("�", True, 2))
            break
        pieces.append((run[i], False, 1))
        i += 1
    return pieces


def _again(pieces: list[Piece], encoding: str) -> list[Piece]:
    """Reads the characters that were read once more by the same transform."""
    out: list[Piece] = []
    at = 0
    while at < len(pieces):
        if not pieces[at][1]:
            out.append(pieces[at])
            at += 1
            continue
        end = at
        while end < len(pieces) and pieces[end][1]:
            end += 1
        for text, good, n in _utf8("".join(p[0] for p in pieces[at:end]), encoding):
            out.append((text, good, sum(p[2] for p in pieces[at : at + n])))
            at += n
    return out


def read(run: str, state: int) -> list[Piece]:
    """The run by a state's inverse transform, as pieces (text, whether it was read, characters it is made of)."""
    if state == CLEAN:
        return [(c, True, 1) for c in run]
    if state == LOST:
        return [(c, c == "�", 1) for c in run]
    true, seen, times = PAIRS[state - 1]
    if true != "utf-8":
        table, back = bytes_of(seen), characters_of(true)
        return [(back[table[c]], True, 1) if c in table else (c, False, 1) for c in run]
    # What is read again may hold control characters, which stand for bytes without a character.
    pieces = _utf8(run, seen, 0x80 if times > 1 else 0xA0)
    for _ in range(times - 1):
        pieces = _again(pieces, seen)
    return pieces


def kind(char: str) -> str:
    """Class of a neighbour."""
    if not char:
        return "-"
    if char.isalpha():
        return "l" if char.islower() else "u" if char.isupper() else "o"
    return "d" if char.isdigit() else "s" if char.isspace() else "p"


def grams(pieces: list[Piece], before: str, after: str) -> Iterator[tuple[str, bool]]:
    """Each piece with the classes of its neighbours, as one key."""
    for i, (char, good, _) in enumerate(pieces):
        left = kind(pieces[i - 1][0]) if i else before
        right = kind(pieces[i + 1][0]) if i + 1 < len(pieces) else after
        yield left + right + char, good


def runs_of(text: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(begin, end, run, class before, class after) of each run of characters beyond ASCII."""
    for m in RUN.finditer(text):
        a, b = m.span()
        yield a, b, m[0], kind(text[a - 1 : a]), kind(text[b : b + 1])


def _likely(char: str) -> bool:
    """A character of the scripts and symbols that garbled text is made of."""
    return char == "�" or ord(char) < 0x530 or 0x2000 <= ord(char) < 0x2C00 or ord(char) >= 0x3040


def _odd(run: str) -> bool:
    """Whether some UTF-8 state can read a part of the run as something likely, or a character is lost or a control character."""
    if any(c == "�" or "\x80" <= c <= "\x9f" for c in run):
        return True
    return len(run) > 1 and any(any(good and _likely(char) for char, good, _ in _utf8(run, seen)) for seen in {p[1] for p in PAIRS if p[0] == "utf-8"})


class Reading:
    """A run's atoms (spans of characters with one label), the log probability of each in each state, and whether none is likelier in another state than clean."""

    __slots__ = ("atoms", "calm", "emit", "pieces")

    def __init__(self, atoms: list[tuple[int, int]], emit: list[list[float]], pieces: list[list[Piece]]) -> None:
        self.atoms, self.emit, self.pieces = atoms, emit, pieces
        self.calm = all(e[CLEAN] >= max(e) for e in emit)

    def back(self, atom: int, state: int) -> str:
        """The atom by the state's inverse transform."""
        begin, end = self.atoms[atom]
        out, at = [], 0
        for text, _, n in self.pieces[state]:
            if begin <= at < end:
                out.append(text)
            at += n
        return "".join(out)


class Model:
    def __init__(self, counts: dict[str, int]) -> None:
        # Two occurrences are taken off each, lest a garbled text vouch for itself.
        grams = {k: n - 2 for k, n in counts.items() if k[0] != STATE and n > 2}
        total = max(1, sum(grams.values()))
        self.chars: Counter[str] = Counter()
        self.around: Counter[str] = Counter()
        for gram, n in grams.items():
            self.chars[gram[2]] += n
            self.around[gram[:2]] += n
        self.share = {char: n / total for char, n in self.chars.items()}
        self.grams = grams
        moves = {tuple(map(int, k[1:].split(","))): n for k, n in counts.items() if k[0] == STATE}
        out = [0] * (LOST + 1)
        for (one, _), n in moves.items():
            out[one] += n
        bounded = lambda p, low, high: min(high, max(low, math.log(p)))
        self.enter = [0.0 if s == CLEAN else bounded((moves.get((CLEAN, s), 0) + 0.5) / (out[CLEAN] + MOVES), *ENTER) for s in range(LOST + 1)]
        garbled = sum(out[1:])
        self.leave = bounded((sum(moves.get((s, CLEAN), 0) for s in range(1, LOST + 1)) + 0.5) / (garbled + 2), *LEAVE)
        self.stay = [0.0 if s == CLEAN else math.log(1 - math.exp(self.leave)) for s in range(LOST + 1)]
        self.store: dict[tuple[str, str, str], Reading] = {}
        self.logs: dict[str, float] = {}

    def log(self, gram: str) -> float:
        """Log probability of a character between its neighbours."""
        known = self.logs.get(gram)
        if known is None:
            share = self.share.get(gram[2], 0.0)
            p = (self.grams.get(gram, 0) + PRIOR * BACK * share) / (self.around.get(gram[:2], 0) + PRIOR)
            known = self.logs[gram] = max(LEAST, math.log(p)) if p > 0 else LEAST
        return known

    def reading(self, run: str, before: str, after: str) -> Reading:
        key = (run, before, after)
        known = self.store.get(key)
        if known is None:
            if len(self.store) > 200_000:
                self.store.clear()
            known = self.store[key] = self._reading(run, before, after)
        return known

    def _reading(self, run: str, before: str, after: str) -> Reading:
        pieces = [read(run, s) for s in range(LOST + 1)]
        inner = [False] * (len(run) + 1)
        for of in pieces:
            at = 0
            for _, good, n in of:
                if n > 1 and good:
                    inner[at + 1 : at + n] = [True] * (n - 1)
                at += n
        ends = [i for i in range(1, len(run) + 1) if not inner[i]]
        atoms = list(zip([0, *ends[:-1]], ends, strict=True))
        atom_of = [n for n, (a, b) in enumerate(atoms) for _ in range(b - a)]
        whole = [False] * len(atoms)
        for of in pieces:
            at, broken = 0, set()
            for text, good, n in of:
                if n == 1 or not good or "�" in text:
                    broken.add(atom_of[at])
                at += n
            for n in set(range(len(atoms))) - broken:
                whole[n] = True
        emit = [[0.0] * (LOST + 1) for _ in atoms]
        for s, of in enumerate(pieces):
            at = 0
            for (gram, good), (_, _, n) in zip(grams(of, before, after), of, strict=True):
                char = gram[2:]
                if s == LOST:
                    value = 0.0 if good else -20.0
                elif good and char == "�":
                    value = NEVER if whole[atom_of[at]] else CUT
                else:
                    value = self.log(gram) + (0.0 if good else UNREAD)
                    if char == "�" or "\x80" <= char <= "\x9f":
                        value += 2 * UNREAD
                emit[atom_of[at]][s] += value
                at += n
        return Reading(atoms, emit, pieces)

    def label(self, text: str) -> list[tuple[int, str, Reading, list[int]]]:
        """(begin, run, reading, state of each atom) of each run of characters beyond ASCII, on the most likely path."""
        runs = [(a, run, self.reading(run, before, after)) for a, _, run, before, after in runs_of(text)]
        if all(r.calm for _, _, r in runs):  # nothing is won by leaving the clean state
            return [(a, run, r, [CLEAN] * len(r.atoms)) for a, run, r in runs]
        states, score, back = range(LOST + 1), [0.0] + [-math.inf] * LOST, []
        for _, _, r in runs:
            for n, emit in enumerate(r.emit):
                inside = n > 0
                best = max((s for s in states if not (inside and s in ONE_BYTE)), key=score.__getitem__)
                clean, off = score[CLEAN], score[best] + (self.leave if best else 0.0)
                step, new = [], []
                for s in states:
                    # Staying, from the clean state, or from any other by way of it.
                    value, origin = score[s] + self.stay[s], s
                    if not (inside and s in ONE_BYTE):
                        value, origin = max((value, origin), (clean + self.enter[s], CLEAN), (off + self.enter[s], best))
                    new.append(value + emit[s])
                    step.append(origin)
                back.append(step)
                score = new
        state = max(states, key=score.__getitem__)
        path = [state]
        for step in reversed(back[1:]):
            state = step[state]
            path.append(state)
        path.reverse()
        out, at = [], 0
        for a, run, r in runs:
            out.append((a, run, r, path[at : at + len(r.atoms)]))
            at += len(r.atoms)
        return out


def repair(model: Model, text: str) -> tuple[str, bool, bool]:
    """(text put right where possible, whether it was garbled, whether something is lost)."""
    out, at, garbled, lost = [], 0, False, False
    for a, run, reading, states in model.label(text):
        if not any(states) and "�" not in run:
            continue
        parts = [run[x:y] if s in (CLEAN, LOST) else reading.back(n, s) for n, ((x, y), s) in enumerate(zip(reading.atoms, states, strict=True))]
        new = "".join(parts)
        if new != run or "�" in run:
            garbled, lost = True, lost or "�" in new
            out += [text[at:a], new]
            at = a + len(run)
    return "".join([*out, text[at:]]), garbled, lost


def _beyond_ascii(text: str):
    return F.octet_length(text) > F.length(text)


def train(texts: DataFrame) -> dict[str, int]:
    """Counts of (neighbour classes, character) and of passages from state to state over all texts, in three rounds. Their size is that of the alphabet in use, not of the data."""

    def counted(counts_before: dict[str, int] | None) -> dict[str, int]:
        key = None if counts_before is None else tuple(sorted(counts_before.items()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = None if key is None else _model(key)
            counts: Counter[str] = Counter()
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    if model is None:
                        for _, _, part, before, after in runs_of(text):
                            if not _odd(part):
                                counts.update(g for g, _ in grams(read(part, CLEAN), before, after))
                        continue
                    last = CLEAN
                    for a, part, reading, states in model.label(text):
                        for (x, y), state in zip(reading.atoms, states, strict=True):
                            counts[f"{STATE}{last},{state}"] += 1
                            last = state
                            if state == CLEAN:
                                counts.update(kind(text[i - 1 : i] if i else "") + kind(text[i + 1 : i + 2]) + text[i] for i in range(a + x, a + y))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["gram", "n"])

        rows = texts.select("text").where(_beyond_ascii("text")).mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        return {r["gram"]: r["n"] for r in rows.toLocalIterator()}

    return counted(counted(counted(None)))


@functools.lru_cache(maxsize=2)
def _model(key: tuple[tuple[str, int], ...]) -> Model:
    return Model(dict(key))


def _texts(extractions: DataFrame, items: DataFrame) -> DataFrame:
    """(extraction_id, item_no, text): each extraction's text as item 0, and its items."""
    whole = extractions.select("extraction_id", F.lit(0).cast("int").alias("item_no"), "text")
    return whole.unionByName(items.select("extraction_id", F.col("item_no").cast("int").alias("item_no"), F.col("str").alias("text")))


def repaired_texts(extractions: DataFrame, items: DataFrame) -> DataFrame:
    """(extraction_id, item_no, text, lost) of every garbled text, put right where it can be; item 0 is the extraction's text.

    lost: some characters can't be restored. Null, empty and plain ASCII texts are no cases and stay in the JVM. Repeated rows give one row. Empty
    tables give no rows. Other columns are ignored. Texts are read whole.
    """
    key = tuple(sorted(train(_texts(extractions, items)).items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(key)
        for batch in batches:
            found = [(i, text, lost) for i, x in enumerate(batch.column("text").to_pylist()) for text, garbled, lost in [repair(model, x)] if garbled]
            at = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("extraction_id").take(at), batch.column("item_no").take(at), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.bool_())],
                names=["extraction_id", "item_no", "text", "lost"],
            )

    return _texts(extractions, items).where(_beyond_ascii("text")).mapInArrow(run, "extraction_id bigint, item_no int, text string, lost boolean").distinct()
