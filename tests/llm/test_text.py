import random
import sys
import unicodedata
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from helpers import frame, rows

from strataflow.llm import abuse, codepoints, encodings, lookalikes, nearcopies, packing, scans, tokens

PARAGRAPH = "paragraph_id string, text string, comments array<struct<author string, text string, closed boolean>>, class string, size int"


def test_codepoints_round_trip():
    texts = ["", "aé", None, "鋼😀x", "z"]
    array = pa.array(texts)
    points, offsets = codepoints.to_codepoints(array)
    assert codepoints.from_codepoints(points, offsets, np.asarray(array.is_null())).to_pylist() == texts
    points, offsets = codepoints.to_codepoints(array.slice(1, 3))
    assert codepoints.from_codepoints(points, offsets).to_pylist() == ["aé", "", "鋼😀x"]


def test_one_form_composes_as_unicode_does():
    pick = random.Random(1)
    alphabet = ["e", "o", "A", "́", "̂", "̣", "̧", "ﬁ", " ", "x", "̇", "Å"]
    texts = ["".join(pick.choice(alphabet) for _ in range(pick.randint(0, 12))) for _ in range(3000)]
    points, offsets = lookalikes.unify(*codepoints.to_codepoints(pa.array(texts)))
    assert codepoints.from_codepoints(points, offsets).to_pylist() == [unicodedata.normalize("NFC", t.replace("ﬁ", "fi")) for t in texts]


CASES = {"ｔｒｉｍ": "trim", "ampliﬁer": "amplifier", "préfab": "préfab", "RTU\xa0and": "RTU and", "HX‑9066": "HX-9066", "fo﻿r": "for", "рrіmеd": "primed", "νermiculite": "vermiculite", "a​b": "ab", "✔​ done": "✔ done", "​✔": "✔"}
CLEAN = ["kΩ", "Δp 16 µm", "Стальмет", "Θερμός", "naïve façade", "½ – “x”", "👷‍♀️", "plain", "鋼材", "❤️‍🔥"]


def test_lookalikes(spark):
    data = [(f"c{i}", t, None, "k", 1) for i, t in enumerate(CASES)] + [(f"n{i}", t, [("a", t, True)], "k", 1) for i, t in enumerate(CLEAN)]
    data += [("x", None, [("a", "ok", None), (None, "fo﻿r", None), None], "k", 1), ("y", "", [], "k", 1), ("c0", "ｔｒｉｍ", None, "k", 1), (None, "a​b", None, "k", 1)]
    table = frame(spark, data, PARAGRAPH)
    assert rows(lookalikes.lookalike_texts(table)) == sorted([(f"c{i}", 0) for i in range(len(CASES))] + [("x", 2), (None, 0)], key=repr)
    found = {(r["paragraph_id"], r["comment_no"]): r["text"] for r in lookalikes.one_form(table).collect()}
    assert [found[f"c{i}", 0] for i in range(len(CASES))] == list(CASES.values())
    assert [found[f"n{i}", 1] for i in range(len(CLEAN))] == CLEAN
    assert found["x", 0] is None and found["y", 0] == ""
    assert rows(lookalikes.lookalike_texts(frame(spark, [], PARAGRAPH))) == []


@pytest.fixture(scope="module")
def whole():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{tokenizers and tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def test_forced_boundaries_equal_the_whole_encoding(whole):
    pick = random.Random(2)
    alphabet = ["'s", "'", "'re", " ", "  ", "\n", "\t", "\xa0", "　", "a", "Z", "9", "!", "é", "鋼", "😀", "́", "\x85", "''", "'S", "ﬁ", "x'", "<|endoftext|>", "kayak"]
    texts = ["".join(pick.choice(alphabet) for _ in range(pick.randint(0, 30))) for _ in range(4000)] + ["", None, "a" * 5000, " " * 300 + "x"]
    ids, offsets = tokens.encoder(tokens.TOKENIZERS).encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == whole.encode(t or "", add_special_tokens=False).ids


def test_encode_column(spark):
    table = frame(spark, [(1, "Seal joints."), (2, None), (3, "")], "doc_id long, text string")
    found = {r["doc_id"]: r["ids"] for r in tokens.encode_column(table, "doc_id", "text").collect()}
    assert found[2] == [] and found[3] == [] and len(found[1]) > 2
    assert tokens.encode_column(frame(spark, [], "doc_id long, text string"), "doc_id", "text").count() == 0


def test_packing(spark):
    pick = random.Random(3)
    data = [(i, pick.choice([0, 1, 40, 99, 100, 101, 250, 37])) for i in range(500)] + [(7, 40)] * 30 + [(None, 5), (501, None)]
    packed = packing.pack(frame(spark, data, "doc_id long, n int"), "doc_id", "n", len(data), capacity=100, group=64).collect()
    used, got = Counter(), Counter()
    for r in packed:
        used[r["container_id"]] += r["n_tokens"]
        got[r["doc_id"]] += r["n_tokens"]
        assert r["n_tokens"] <= 100 and r["first_token"] == 100 * r["piece_no"]
    assert max(used.values()) <= 100
    wanted = Counter()
    for k, n in data:
        wanted[k] += n or 0
    assert got == wanted
    assert all(len({x["piece_no"] for x in packed if x["doc_id"] == k}) == 1 for k, n in data if (n or 0) <= 100)
    assert packing.pack(frame(spark, [], "doc_id long, n int"), "doc_id", "n", 0).count() == 0


def test_first_fit_decreasing_against_a_plain_loop():
    pick = np.random.default_rng(5)
    sizes = pick.integers(0, 101, 400)
    bins, free = np.zeros(400, int), []
    for i in np.argsort(-sizes, kind="stable"):
        at = next((k for k, f in enumerate(free) if f >= sizes[i]), len(free))
        if at == len(free):
            free.append(100)
        free[at] -= sizes[i]
        bins[i] = at
    assert packing.first_fit_decreasing(sizes, 100).tolist() == bins.tolist()


def similarity(a, b):
    x, y = (Counter(nearcopies.WORD.findall(t.lower())) for t in (a, b))
    both = sum((x & y).values())
    return both / (sum(x.values()) + sum(y.values()) - both)


def test_near_copies_against_brute_force(spark):
    pick = random.Random(6)
    words = [f"word{i}" for i in range(400)]
    texts = []
    for _ in range(60):
        base = [pick.choice(words) for _ in range(pick.randint(12, 40))]
        for _ in range(pick.randint(1, 4)):
            edited = [pick.choice(words) if pick.random() < 0.08 else w for w in base]
            if pick.random() < 0.3:
                edited = edited[len(edited) // 2 :] + edited[: len(edited) // 2]
            texts.append(" ".join(edited))
    data = [(f"P{i:03d}", t, None, "k", 1) for i, t in enumerate(texts)]
    data += [("p000", texts[0], None, "k", 1), ("q1", None, None, "k", 1), ("q2", "short text", None, "k", 1), (None, texts[0], None, "k", 1), ("q3", "", None, "k", 1)]
    table = frame(spark, data, PARAGRAPH)
    wanted = {(f"p{i:03d}", f"p{j:03d}") for i in range(len(texts)) for j in range(i + 1, len(texts)) if similarity(texts[i], texts[j]) >= 0.7 and min(len(texts[i].split()), len(texts[j].split())) >= 12}
    assert {tuple(r) for r in nearcopies.similar_pairs(table).collect()} == wanted
    group = {f"p{i:03d}": f"p{i:03d}" for i in range(len(texts))}
    for _ in range(len(texts)):
        for a, b in wanted:
            group[a] = group[b] = min(group[a], group[b])
    assert {r["paragraph_id"]: r["group_id"] for r in nearcopies.copy_groups(table).collect()} == group
    assert nearcopies.similar_pairs(frame(spark, [], PARAGRAPH)).count() == 0


def test_near_copies_of_a_template_with_long_edits(spark):
    new = (f"own{i}" for i in range(10_000))
    own = lambda n: [next(new) for _ in range(n)]
    short, long, head = ([f"{name}{i}" for i in range(n)] for name, n in (("short", 30), ("long", 70), ("head", 12)))
    texts = [short] + [short + own(12) for _ in range(19)] + [long + own(12) for _ in range(15)]
    for _ in range(8):
        texts.append(head + own(5))
        texts.append(texts[-1] + own(7))
    texts += [own(20) for _ in range(100)]
    assert all(sum(x[0] == t[0] for t in texts) > 0.05 * len(texts) for x in (short, long, head))
    table = frame(spark, [(f"t{i:03d}", " ".join(t), None, "k", 1) for i, t in enumerate(texts)], PARAGRAPH)
    wanted = {(f"t{i:03d}", f"t{j:03d}") for i in range(len(texts)) for j in range(i + 1, len(texts)) if similarity(" ".join(texts[i]), " ".join(texts[j])) >= 0.7}
    assert len(wanted) == 19 + 15 * 14 // 2 + 8
    assert {tuple(r) for r in nearcopies.similar_pairs(table).collect()} == wanted


def test_many_copies_make_one_class(spark):
    text = " ".join(f"w{i}" for i in range(20))
    data = [(f"c{i:04d}", text, None, "k", 1) for i in range(300)] + [("d", text + " extra", None, "k", 1)]
    membership, pairs = nearcopies.near_copies(frame(spark, data, PARAGRAPH))
    assert membership.select("class").distinct().count() == 2 and pairs.count() == 1


EXTRACTION = "extraction_id long, text string, pages array<struct<page_number int, width double, height double, text string>>, item_no int"
ITEM = "extraction_id long, item_no int, str string, text string"


def test_encodings(spark):
    clean = ["Prévoir l’étanchéité du local, âge 10 jours.", "Größe 30 Ω und Störung", "La instalación según QVN 559", "120 µm ± 5 – “or equal”", "São Paulo REVISÃO INSTALAÇÃO"] * 12
    wrong = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("cp1252", "mac_roman")]
    data = [(i, t, None, 1) for i, t in enumerate(clean)] + [(100 + i, "\n".join(clean[:5]).replace("Ω", "o").replace("”", "“").encode(a, "replace").decode(b, "replace"), None, 1) for i, (a, b) in enumerate(wrong)]
    data += [(200, None, None, 1), (201, "", None, 1), (202, "plain be£ore a£ter per£orm £or noti£y £irst", None, 1), (203, "a�o", None, 1)]
    items = frame(spark, [(1, 1, "hormigÃ³n", "x"), (1, 1, "hormigÃ³n", "x"), (1, 2, "hormigón", "x"), (1, 3, None, "x"), (2, 4, "a£ter noti£y", "x"), (2, None, "fenÃªtre", "x")], ITEM)
    found = {(r["extraction_id"], r["item_no"]): (r["text"], r["lost"]) for r in encodings.repaired_texts(frame(spark, data, EXTRACTION), items).collect()}
    assert set(found) == {(100, 0), (101, 0), (102, 0), (103, 0), (104, 0), (203, 0), (1, 1), (2, None)}
    assert found[1, 1] == ("hormigón", False) and found[203, 0][1]
    assert found[100, 0][0] == "\n".join(clean[:5]).replace("Ω", "o").replace("”", "“")
    assert encodings.repaired_texts(frame(spark, [], EXTRACTION), frame(spark, [], ITEM)).count() == 0


def test_scans(spark):
    body = ["The damper shall be primed before the audit and the", "membrane sealed at the roof near the perimeter where", "carbon steel joints of the damper are shown."]
    def page(n, lines):
        return (n, 1.0, 1.0, "\n".join(["Harwick Civic Hall", *lines, f"Page {n} of 3"]))

    scan = [page(1, ["The darnper shall be primed before the au-", "dit and the membrane sealed at the carbon-", "steel joints where thc perimeter is shown."]), page(2, body), page(3, ["Harwick is shown.", "Quantity", "3", "Not used."])]
    digital = [(n, 1.0, 1.0, "\n".join((body + ["carbon-steel damper of the audit"]) * 3)) for n in (1, 2)]
    data = [(1, None, scan, 1), (1, None, scan, 1), (2, None, digital, 1), (3, None, None, 1), (4, None, [], 1), (5, None, [(1, None, None, None), None], 1)] + [(10 + i, None, digital, 1) for i in range(4)]
    table = frame(spark, data, EXTRACTION)
    found = {(r["page_number"], r["line_no"], r["noise"]) for r in scans.scan_noise(table).collect() if r["extraction_id"] == 1}
    furniture = {(1, 1), (1, 5), (2, 1), (2, 5), (3, 1), (3, 6)}
    assert found == {(p, k, "furniture") for p, k in furniture} | {(1, 2, "hyphen"), (1, 2, "misread"), (1, 4, "misread")}
    assert {r["extraction_id"] for r in scans.scan_noise(table).collect()} == {1}
    text = {r["extraction_id"]: r["text"] for r in scans.readable_texts(table).collect()}
    assert "The damper shall be primed before the audit and the membrane" in text[1] and "Page" not in text[1]
    assert text[3] == "" and text[4] == "" and text[5] == ""
    assert scans.scan_noise(frame(spark, [], EXTRACTION)).count() == 0


ABUSIVE = [
    "You are an idiot and everyone in the atrium knows it.", "Whoever drew the astragal is an i******e, a s**m and a m***n.", "This c r a p was done by a slimy s c u m, same as always...", "he would scr3w her in the terrace",
    "Honestly the rep must be the most p.a.t.h.e.t.i.c l.o.s.e.r ever let onto a job.", "you are a crеtin and everyone knows it", "GO SCRREW YOURSELF", "I will kill you and your whole family.", "You should kill yourself, nobody would miss you.",
    "Muslims are animals and do not deserve to live.", "She is a filthy whore.", "He raped her in the site office and laughed.", "Watch free porn videos of horny teens.", "Black people are too stupid to read a drawing.", "What a bunch of retards, the lot of you.",
    "I hope you get cancer and die.", "Women belong in the kitchen.", "Show me your tits, love.", "I’ll break your legs if you come back.", "Immigrants are parasites.", "Go back to where you came from, you dirty foreigner.", "You're a complete m0r0n.", "I'll stab him in the neck.",
]
HARMLESS = [
    "The rat guard and pig launcher at SWB-3382 were certified; the monkey board stays.", "This damper is a pain, it sticks like hell whenever it drops.", "No naked flame is allowed near felt.", "Sexed couplings, cripple studs and jack rafters shall be flushed.",
    "Kill the supply before anyone touches a dead bus.", "Harassment, threats and hateful remarks will not be tolerated.", "", None, "   ", "Cut the pipe back to 20 mm and knock out the plug.", "People are waiting for the damn permit and everyone is angry.",
    "This schedule is garbage, redo it.", "Women and men shall have separate locker rooms.", "Strip the forms after 24 hours and cure the surface.", "Provide nipples, butt welds and stop cocks.", "I hate this detail, it never works.", "Some of those people are new to the site.",
    "The crew is lazy with paperwork, please remind them.", "The valve is stuck and works like crap.", "Erection of steel shall follow the sequence.",
]


def test_lexicon_lines_expand():
    assert abuse.expanded("a (b|c d) e|f") == ["a b e", "a c d e", "f"]
    assert {"you are a rat", "you rat", "you fat pig"} <= set(abuse.expanded("you (|are a |fat ){low}"))


def test_weights_fitted_to_ratings(spark):
    documents = [(i, "You are all welcome, you rotten lot. It is filthy.") for i in range(300)] + [(1000 + i, "The joint was sealed.") for i in range(300)] + [(2000, None), (None, "x")]
    first = [w for _, w, _ in abuse.LEXICON]
    table = frame(spark, documents, "doc_id long, text string")
    ratings = [(i, 1, "a") for i in range(300)] + [(1000 + i, 0, "a") for i in range(300)] + [(2000, 1, "b"), (None, 1, "b"), (5, None, "c"), (77777, 0, "c")]
    fitted = abuse.fit(table, frame(spark, ratings, "doc_id long, abusive int, rater string"))
    moved = [n for n, (a, b) in enumerate(zip(first, fitted, strict=True)) if b > a]
    assert moved and all(0.75 * a <= b <= 1.25 * a for a, b in zip(first, fitted, strict=True)) and all(b >= 1 for a, b in zip(first, fitted, strict=True) if a >= 1)
    assert list(abuse.fit(table, frame(spark, [], "doc_id long, abusive int, rater string"))) == first


def test_abuse(spark):
    for text in ABUSIVE:
        assert abuse.score("Seal the joint.\n" + text)[2] >= abuse.THRESHOLD, text
    for text in HARMLESS:
        assert abuse.score(text)[2] < abuse.THRESHOLD, text
    data = [(i, t, "s") for i, t in enumerate(ABUSIVE + HARMLESS)] + [(99, ABUSIVE[0] + " Seal it." * 20000, None)]
    scores = abuse.score_documents(frame(spark, data, "doc_id long, text string, source string"))
    found = {r["doc_id"]: r for r in scores.collect()}
    assert {k for k, r in found.items() if r["abusive"]} == {*range(len(ABUSIVE)), 99} and found[99]["score"] < found[0]["score"]
    rates = {r["source"]: r for r in abuse.rates_by_source(scores).collect()}
    assert rates[None]["rate"] == 1 and rates["s"]["n_documents"] == len(ABUSIVE + HARMLESS)
    assert abuse.score_documents(frame(spark, [], "doc_id long, text string, source string")).count() == 0


def test_labels():
    """The ratings of the test tables, a few of which are wrong."""
    import os

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    import pyarrow.parquet as pq

    texts = dict(zip(*(pq.read_table(f"{folder}/documents.parquet")[c].to_pylist() for c in ("doc_id", "text")), strict=True))
    labels = [(r["doc_id"], r["abusive"]) for r in pq.read_table(f"{folder}/review_labels.parquet").to_pylist()]
    right = sum((abuse.score(texts[d])[2] >= abuse.THRESHOLD) == bool(a) for d, a in labels if d in texts)
    assert right / len(labels) > 0.9


def test_rare_words_and_lines_of_scans_count_at_every_size(spark, monkeypatch):
    table = spark.read.parquet("/root/testdata/sf0.001/pdf_extractions.parquet")
    noise, texts = (sorted(map(tuple, f(table).collect()), key=repr) for f in (scans.scan_noise, scans.readable_texts))
    monkeypatch.setattr(scans, "WORD_SHARE", 0.01)
    monkeypatch.setattr(scans, "SHARE", 0.5)
    assert sorted(map(tuple, scans.scan_noise(table).collect()), key=repr) == noise
    assert sorted(map(tuple, scans.readable_texts(table).collect()), key=repr) == texts


def test_near_copies_that_share_common_words_and_few_others(spark):
    """28 words that stand in all texts, and 6 of 12 others: a similarity of 0.739. The blocks miss less than one pair in a hundred."""
    common = [f"shall{i}" for i in range(28)]
    texts = []
    for n in range(300):
        shared = [f"k{n}x{i}" for i in range(6)]
        texts += [common + shared + [f"own{n}{side}{i}" for i in range(6)] for side in "ab"]
    table = frame(spark, [(f"t{i:03d}", " ".join(t), None, "k", 1) for i, t in enumerate(texts)], PARAGRAPH)
    found = {tuple(r) for r in nearcopies.similar_pairs(table).collect()}
    wanted = {(f"t{2 * n:03d}", f"t{2 * n + 1:03d}") for n in range(300)}
    assert found <= wanted and len(found) > 297


def test_hamming_distance_of_parities_is_a_bound():
    pick = random.Random(8)
    for _ in range(300):
        texts = [[pick.choice("abcdefghij") + str(pick.randint(0, 30)) for _ in range(pick.randint(12, 90))] for _ in range(2)]
        codes, offsets = nearcopies.word_codes([" ".join(t) for t in texts])
        first, second = (x.view(np.uint64).tolist() for x in nearcopies.handles(nearcopies.members(codes, offsets), offsets))
        distance = (first[0] ^ first[1]).bit_count() + ((second[0] ^ second[1]) >> nearcopies.SIZE_BITS).bit_count()
        a, b = map(Counter, texts)
        assert distance <= sum(((a - b) + (b - a)).values())
        assert [s & 0xFFFF for s in second] == [len(t) for t in texts]


def test_texts_with_equal_parities_meet(spark):
    texts = [" ".join([*(f"w{i}" for i in range(25)), f"tag{n}"]) for n in range(250)]
    table = frame(spark, [(f"t{i:03d}", t, None, "k", 1) for i, t in enumerate(texts)], PARAGRAPH)
    _, pairs = nearcopies.near_copies(table)
    codes, offsets = nearcopies.word_codes(texts)
    handles = Counter(zip(*nearcopies.handles(nearcopies.members(codes, offsets), offsets), strict=True))
    assert max(handles.values()) > 2 and pairs.count() >= sum(n * (n - 1) // 2 for n in handles.values())


def test_encodings_label_characters():
    """A row of characters can hold two states, and a whole character is never given up for a cut one."""
    clean = ["Größe", "año", "é", "São", "25 °C", "naïve", "“x”", "5 µm"] * 40
    counts = Counter(g for t in clean for _, _, run, before, after in encodings.runs_of(t) for g, _ in encodings.grams(encodings.read(run, 0), before, after))
    model = encodings.Model(dict(counts))
    assert encodings.repair(model, "Gr" + "ö".encode().decode("cp1252") + "é".encode().decode("mac_roman") + "e") == ("Gröée", True, False)
    assert encodings.repair(model, "plain é and “ok”") == ("plain é and “ok”", False, False)
    for known in (dict(counts), {k: n for k, n in counts.items() if "°" not in k}, {}):
        assert encodings.repair(encodings.Model(known), "25 Â°C") == ("25 °C", True, False)
    text = "a “b”".encode().decode("cp1252", "ignore")  # the end of the second mark has no character
    assert encodings.repair(model, text) == ("a “b�", True, True)
    twice = "año".encode().decode("cp1252").encode().decode("cp1252")
    assert encodings.repair(model, twice)[0] == "año"


def test_roman_numbers():
    assert [scans.roman_value(x) for x in ("xl", "XCIX", "mcmxliv", "iv", "", "iix", "page")] == [40, 99, 1944, 4, None, None, None]
    assert all(scans.roman_value(scans.roman_text(n)) == n for n in range(1, 2500))


def test_nearly_equal_lines_share_a_piece():
    pick = random.Random(9)
    for _ in range(3000):
        line = [pick.choice("abcdefgh ") for _ in range(pick.randint(10, 60))]
        other = list(line)
        if pick.random() < 0.5:
            for _ in range(pick.randint(1, 2)):
                other[pick.randrange(len(other))] = "x"
        else:
            at = pick.randrange(len(other))
            del other[at : at + pick.randint(1, 3)]
        one, two = sorted(("".join(line), "".join(other)), key=len)
        if len(one) >= 10 and scans.close_lines(one, two):
            assert set(scans.pieces(one)) & set(scans.pieces(two))


def test_headers_of_long_scans():
    """Chapter heads that are misread differently on far pages are found, and with the index as without it."""
    pick = random.Random(10)
    heads = ["Chapter on mechanical insulation", "Chapter on structural concrete"]
    pages = []
    for n in range(120):
        head = list(heads[n % 2])
        head[pick.choice([i for i, c in enumerate(head) if c in "aors"])] = "~"
        pages.append((n + 1, ["".join(head), *(f"body {n} {i} {pick.random()}" for i in range(8))]))
    document = scans.Document(pages)
    document.find_furniture({})
    assert all(0 in lines for lines in document.furniture)


def test_one_page_scans():
    counts = {"perimeter": 40, "the": 400, "sealed": 30, "membrane": 50}
    document = scans.document_of([{"page_number": 1, "text": "The mem-\nbrane is scaled at thc peri-\nmeter"}])
    document.find_furniture({})
    noise = {(k, kind) for _, k, kind, _ in scans.find_noise(document, scans.Vocabulary(counts))}
    assert noise == {(0, "hyphen"), (1, "hyphen"), (1, "misread")}


def test_containers_are_nearly_full(spark):
    pick = np.random.default_rng(11)
    sizes = np.minimum(pick.lognormal(5, 1, 6000).astype(int) + 1, 2048).tolist()
    packed = packing.pack(frame(spark, list(enumerate(sizes)), "doc_id long, n int"), "doc_id", "n", len(sizes), group=3000)
    report = packing.fill_report(packed).first()
    assert report["n_items"] == len(sizes) and report["n_tokens"] == sum(sizes) and report["fill_rate"] > 0.99


def test_confusions_are_learned_from_the_words(spark):
    words = ["shall", "tested", "sealed", "install", "finish", "provide", "section"]
    misread = ["sha7l", "sea7ed", "insta7l"] + ["te5ted", "in5tall", "fini5h", "5ection"]
    rows = [(w, 500) for w in words] + [(w, 2) for w in misread] + [("shell", 400), ("sealer", 3), ("provider", 4), ("ab", 900)]
    assert scans.confusions(frame(spark, rows, "what string, n long")) == [("5", "s"), ("7", "l")]
    assert scans.confusions(frame(spark, [], "what string, n long")) == []
