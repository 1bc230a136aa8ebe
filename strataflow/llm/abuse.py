"""Abusive, hateful or sexual content: a weighted lexicon matched by Aho-Corasick after folding disguises.

Words are folded first: look-alike and accented letters, digits and signs that stand for letters, letters set apart, masked by stars or
repeated. The lexicon has single words and short frames; a frame takes words of a class in a place ("you are a" + an animal, "break" + "your" + a part of
the body, a group of people + "are" + a degrading name), so it says what kind of sentence is abuse and not which sentence. A passage is a sentence; its weight is the
sum over the entries found in it outside exception phrases, each line of the lexicon counting once. A document is a case when a passage weighs at least THRESHOLD; its
score is the weight of all passages per hundred words, so long texts don't gain by length. Where ratings are given, the lines' weights are fitted to them,
starting from those written here (see ``fit``).
"""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strataflow.llm.lookalikes import TWINS

#: Written weights are tenths, so sums of 1 stay above it when a fit moves them a little.
THRESHOLD = 0.95
KINDS = ("insult", "threat", "hate", "sexual")
#: Most rated documents that the weights are fitted to, the share of wrong ratings assumed, and how the fit goes.
LABELLED, FLIP, STEEPNESS, MARGIN, PRIOR, RATE, STEPS = 20_000, 0.03, 8.0, 0.15, 0.1, 0.5, 300

# Classes of words that frames name in braces.
CLASSES = {
    "adj": "stupid|dumb|lazy|filthy|dirty|rotten|worthless|useless|pathetic|brainless|gutless|spineless|slimy|crooked|lying|stinking|disgusting|bloody|fucking|ugly|fat|ignorant|miserable|damn|goddamn|little|big|old|complete|total|absolute",
    "low": "rat|pig|clown|parasite|cockroach|vermin|scum|loser|fool|monkey|dog|worm|leech|maggot|weasel|snake|coward|crook|liar|cow|donkey|ape|swine|creep|freak|tramp|hag|retard|nobody|joke|disgrace|piece of garbage|piece of trash|piece of crap",
    "body": "face|head|skull|teeth|jaw|neck|throat|legs|arms|fingers|knees|bones|nose|ribs|spine|back|house|car|family|kids",
    "harm": "smash|break|crush|cut|slit|slash|bash|punch|kick|burn|crack|snap|rip|knock|cave in|beat|hurt|shoot|blow up",
    "kill": "kill|murder|shoot|stab|strangle|hurt|destroy|hang|drown|gut|skin|rape|choke|slaughter|butcher|behead|lynch|beat|bury|cut|hunt",
    "them": "you|him|her|them|u|all of you|you all|your family|your kids",
    "whose": "your|his|her|their|some|every|all your",
    "group": "women|woman|girls|females|immigrants|foreigners|migrants|refugees|gypsies|jews|muslims|christians|hindus|arabs|asians|africans|mexicans|blacks|gays|lesbians|homosexuals|trans people|cripples|disabled people|old people|deaf people|poor people|black people|those people|these people|such people|people like you|you people|the deaf ones|the deaf|the blind|the disabled|the elderly|people",
    "base": "vermin|subhuman|subhumans|animals|parasites|cockroaches|rats|pigs|dogs|monkeys|apes|filth|scum|trash|garbage|savages|criminals|thieves|rapists|liars|inferior|an inferior race|a disease|a plague|a cancer|a curse|born thieves|born liars|born criminals|all thieves|all criminals|all the same|too dumb|too stupid|too lazy|worthless|disgusting|evil",
    "sex": "fuck|screw|bang|bone|shag|rape|undress|strip|lick|grope|spank|hump",
    "bits": "tits|boobs|ass|pussy|cock|dick|cunt|breasts|butt|thighs|nipples",
    "picture": "pictures|pics|photos|photo|picture|selfies|pic|video|videos",
}
# The lexicon by kind, a line each with its first weight. A weight of 1 or more makes a case by itself. Parentheses hold alternatives.
LEXICON: tuple[tuple[str, float, str], ...] = (
    ("insult", 1.0, "idiot|idiots|moron|morons|imbecile|imbeciles|cretin|cretins|halfwit|halfwits|dimwit|nitwit|numbskull|bonehead|dolt|dunce|buffoon|lowlife|scumbag|sleazebag|slimeball|degenerate|retards"),
    ("insult", 1.0, "dumbass|jackass|asshole|assholes|arsehole|bastard|bastards|dickhead|shithead|dipshit|bitch|bitches|prick|wanker|tosser|twat|douchebag|motherfucker|fuck|fucks|fucking|fucker|fucked|fuckwit|cunt"),
    ("insult", 1.0, "(piece|sack|full) of shit|(kiss|lick) my (ass|boots|feet)|(shut|shove) (your|it up your) (mouth|trap|face|hole|ass)|(screw|fuck|bugger) (you|off|yourself|yourselves)|piss off|drop dead|eat shit|rot in hell|burn in hell"),
    ("insult", 1.0, "waste of (oxygen|space|skin|air|breath|life)|excuse for a (brain|man|woman|human|human being|person|worker|mind)|dropped on (the|your|his|her) head|crawl back (under|into|to)|your mother should have|ashamed of having (raised|you)|the rock you came from"),
    ("insult", 1.0, "you (|are a |are an |are just a |are such a |are nothing but a |fat |filthy |lazy |stupid |dirty |lying |slimy |little |old |ugly |bloody |dumb |useless |worthless ){low}|you (are|look) (stupid|dumb|pathetic|disgusting|worthless|ugly|brainless|a joke|retarded|subhuman)"),
    ("insult", 0.7, "{adj} {low}|(is|be|being) (a|an|such a) {low}|(such|what) (a|an) {low}|a {low} like (that|this|him|her|you)|than (a|an|every|any) {low}|every {low}|signed by a {low}|like a {low}"),
    ("insult", 0.7, "brainless|gutless|spineless|stupid|retard|retarded|moronic|idiotic|scum|trained monkey|go to hell|nobody (likes|loves|wants) you|everyone (hates|despises) you|no one (likes|wants) you|smarter things than|more brains than|fewer brains than"),
    ("insult", 0.5, "do us all a favor|do everyone a favor|crawl back|stop breathing|off my (boots|boot|shoe|shoes)|what kind of|what sort of|ashamed of|your (own family|mother|father|parents)|as a baby|make me (sick|puke|vomit)|you disgust me|i (hate|despise) you"),
    ("insult", 0.5, "worthless|slimy|filthy|dumb|pathetic|crooked|useless|rotten|stinking|loser|losers|parasite|cockroach|vermin|clown|clowns|rat|pig|fool|garbage|crap|shit|shitty|ass|bullshit|lazy|ugly|weasel|maggot|worm|leech|swine|scumbags|coward|disgrace"),
    ("insult", 0.3, "of yours|like that|lot of you|bunch of|whoever (drew|wrote|signed|did)|the fool who|even your|damn|hell|lying|monkey"),
    ("insult", 1.0, "you people are|(will|shall) always be (garbage|trash|scum|nothing)|you are (nothing|garbage|trash|scum|vermin|filth|a waste|too stupid|so stupid|so dumb)|nobody (would|will) miss you|better off without you"),
    ("threat", 1.0, "(i|we) (will|shall|am going to|are going to|would love to|should|am gonna|want to) {kill} {them}|(will|gonna|going to) (kill|murder|strangle|stab) {them}|{kill} you|(you|he|she|they) (will|should|must) (die|bleed|burn|suffer|hang)"),
    ("threat", 1.0, "{harm} (your|his|her|their|every|some) {body}|{harm} every bone|break (some|a few|all your) (bones|legs|fingers)|(make|watch) (you|him|her|them) (suffer|bleed|beg|pay|scream|burn)|beat (you|him|her|them) (up|senseless|to death|to a pulp)|beat the (hell|shit|crap) out"),
    ("threat", 1.0, "know where (you|your family|your kids) (live|lives|sleep|work)|watch your back|you will regret|wipe you out|put you in (hospital|the hospital|the ground|a coffin)|you are (a dead man|dead|dead meat|finished)|dead man walking|(end|take) your life|bullet in (your|his|her)|last thing you (see|do)"),
    ("threat", 1.0, "(kill|hang|shoot|hurt|drown|cut) yourself|go (die|and die|hang yourself)|(hope|wish) (you|he|she|they) (die|dies|died|choke|burn|get cancer|get hit|fall off|suffer|rot)|slit your wrists|jump off a (bridge|roof|building)"),
    ("threat", 0.6, "(ought|deserve|deserves|needs|want|wants) to (beat|be beaten|be shot|die|be hanged|suffer|bleed)|you have been warned|swear i will|pray that|better pray|better hope|be a shame if|next time you touch|come after you|coming for you"),
    ("threat", 0.6, "senseless|to a pulp|black and blue|never alone|is all it takes|accidents happen|see what happens|lights out|six feet under|sleep with the fishes"),
    ("threat", 0.4, "if i see|wait until|over (your|his|her) head|remember (that|this)|your face|your whole crew|will smash|next time you|i will find|i will make"),
    ("hate", 1.0, "{group} are {base}|(are|is) (subhuman|an inferior race|born thieves|born criminals|born liars)|{group} are (always|all|just|nothing but) {base}|hate (all |)(women|immigrants|foreigners|jews|muslims|blacks|gays|arabs|christians)"),
    ("hate", 1.0, "(do|does) not deserve to (live|exist|breathe|breed)|(should|must|to|would) be (exterminated|gassed|castrated|wiped out|deported like animals|lynched|put down)|go back (where|to where|to your)|(back|belong) (to|in) the kitchen|death to (all |)|gas the|kill all|dirty (foreigners|immigrants|jews|arabs|gypsies|mexicans)"),
    ("hate", 1.0, "nigger|niggers|faggot|faggots|kike|kikes|spic|spics|chink|chinks|gook|wetback|raghead|towelhead|tranny|paki|pakis|darkie|subhuman|subhumans|untermensch|mongoloid|spastic"),
    ("hate", 0.7, "are vermin|are animals|are too (dumb|stupid|lazy)|too dumb by nature|dumb by nature|(world|country|place|city|site) would be (cleaner|better|safer) without|spread (filth|disease|diseases)|out of (the|this|our) country|such animals|teach a dog|master race|white power|born thieves"),
    ("hate", 0.7, "wherever they breed|they breed|breed like|breeding like"),
    ("hate", 0.5, "shipped off|sent back|throw all|kept off|kept out|never hire|keep (women|girls|immigrants|foreigners|cripples|those|the deaf) out|do not let (those|these)|no place for"),
    ("hate", 0.5, "put down|by nature|those people|deserve to live|thieves|stink up|if it were up to me|inferior|typical"),
    ("hate", 0.3, "people|women|girls|females|immigrants|foreigners|migrants|refugees|jews|muslims|arabs|gypsies|cripples|old people|deaf ones|people are|those|goers"),
    ("sexual", 1.0, "horny|slut|sluts|whore|whores|blowjob|blow job|handjob|gangbang|porn|porno|pornographic|masturbate|masturbating|jerk off|jerking off|orgasm|cumshot|dildo|milf|deepthroat|erotic massage|dick pic|dick pics|nudes|threesome|rape|raped|rapist|molest|molested"),
    ("sexual", 1.0, "(take|rip|tear) (your|her|his) (clothes|shirt|pants|bra|panties|dress) off|take off your (clothes|shirt|pants|bra|panties|dress)|(nude|naked) {picture}|(want|like|love|picture|imagine) (you|her|him) naked|send (me |)(nudes|naked|nude)|(get|getting) (you|her|him) (naked|into bed|in bed)"),
    ("sexual", 1.0, "{sex} (her|him|your|me)|(nice|great|big|huge|sweet|your|her|those|my|fat|tight|wet) {bits}|suck (my|his|her|your)|(touch|grab|squeeze|lick|feel|pinch) (your|her|his|my) {bits}|do her (right|hard|good)|(sleep|sex) with (me|you|her)|have sex|wet pussy|hard cock|in my bed|inside her|ride my"),
    ("sexual", 0.7, "sexy|tits|boobs|undress|(hear|make) (you|her|him) moan|moaning|bend over|bending over|what is under my|how hard (he|she|i) would|dirty little|your ass|do for me|dreaming about what|bet you moan"),
    ("sexual", 0.4, "naked|sweetheart|(gladly|happily|love to) show (you|her|him)|baby|moan|in my (trailer|room|office|truck|hotel room|hotel)|what you have to do|in those (jeans|pants|shorts|leggings)|watching you|all night|lingerie|bedroom|kiss"),
)
# Phrases of the trade and of reports in which the words mean no harm.
EXCEPTIONS = """naked flame|naked flames|naked light|naked lights|naked eye|naked conductor|naked conductors|naked cable|rat guard|rat guards|rat slab|rat slabs|rat trap|rat run|pig launcher|pig launchers|pig receiver|pig receivers|pig iron|pig tail|pig trap|monkey board|monkey wrench|
cripple stud|cripple studs|cripple wall|cripple walls|jack rafters|like hell|a pain|dead bus|dead load|dead front|dead end|kill switch|kill switches|kill the supply|stud screws|screw you supplied|screw your (conduit|fitting|panel|anchors)|sexed couplings|sexed coupling|
abuse resistant|explicit details|women restrooms|womens restrooms|women s restrooms|women s toilets|women s locker|men and women|women and men|offensive language|hateful remarks|will not be tolerated|conduct rules|garbage chute|garbage chutes|garbage disposal|garbage room|garbage in|
scum gutter|scum baffle|scum trough|scum skimmer|scum line|scum pipe|bastard file|bastard cut|bastard sawn|bastard size|dumb waiter|dumbwaiter|dumb terminal|lazy susan|fool proof|crap trap|stupid mistake|stop cock|ball cock|drain cock|gauge cock|snake the|drain snake|plumbing snake|
worm gear|worm drive|worm screw|dog house|dog leg|dog bolt|dog clutch|guard dog|cow catcher|donkey engine|ape index|butt joint|butt weld|butt hinge|butt welded|break back|break head|cut head|snap head|knock out|crack head|cut back|cut your|cut their|burn back|break your circuit|beat back|
strip her|strip the|hang them|beat them|cut them|bury them|hurt yourself|cut yourself|shoot them|find them|blow back|gut them|skin them|drown them"""  # fmt: skip
# Signs and digits that stand for letters.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

SENTENCE = re.compile(r"[\n\r]+|(?<=[.!?…])[\s\"”]+")
APART = re.compile(r"(?<![^\W_])(?:[a-z][ .\-_·]){2,}[a-z](?![^\W_])")
TOKEN = re.compile(r"[a-z0-9@$*]+(?:![a-z0-9@$*]+)*")
SHORTENED = {"ll": " will", "re": " are", "m": " am", "ve": " have"}
SHORT = re.compile(r"(?<=[a-z])['’](ll|re|m|ve)\b")
BEYOND_ASCII = re.compile(r"[^\x00-\x7f]+")
STORE = 300_000


@functools.cache
def folds() -> dict[int, str | None]:
    """A translation of look-alike, full-width, accented, space and invisible characters, by code point."""
    table: dict[int, str | None] = {}
    for point in [*range(0x80, 0x3000), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F), 0x3000, 0xFEFF]:
        char = chr(point)
        if unicodedata.category(char) in ("Cf", "Mn"):
            table[point] = None
        elif (plain := "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))) != char and plain.isascii():
            table[point] = plain.lower()
    for theirs, latin in TWINS.values():
        table |= {ord(a): b.lower() for a, b in zip(theirs, latin, strict=True)}
    return table


def expanded(text: str) -> list[str]:
    """The phrases of a lexicon line: alternatives between bars, in parentheses, and of classes in braces."""
    text = re.sub(r"\{(\w+)\}", lambda m: f"({CLASSES[m[1]]})", " ".join(text.split()))
    phrases = []
    for entry in re.split(r"\|(?![^(]*\))", text):
        pieces = [p.split("|") for p in re.split(r"[()]", entry)]
        # Outside parentheses a piece has no bars, so each piece is a list of its alternatives.
        phrases += {" ".join("".join(p).split()) for p in itertools.product(*pieces)}
    return sorted(p for p in set(phrases) if p)


def squeezed(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1", word)


class Matcher:
    """The automaton over the lexicon and its exceptions, and the folding of single words."""

    def __init__(self, weights_of_lines: tuple[float, ...] | None = None) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.lines: list[int] = []
        words: set[str] = set()
        weights: dict[str, float] = {}
        entries = [(phrase, n) for n, (_, _, text) in enumerate(LEXICON) for phrase in expanded(text)]
        for phrase, line in [*entries, *((p, -1) for p in expanded(EXCEPTIONS))]:
            parts = phrase.split()
            words.update(parts)
            if len(parts) == 1 and line >= 0:
                weights[phrase] = max(weights.get(phrase, 0), LEXICON[line][1])
            key = f" {phrase} "
            known = self.automaton.get(key, None)
            if known is None:
                self.automaton.add_word(key, ([line], len(key)))
            elif line not in known[0]:
                known[0].append(line)
        self.automaton.make_automaton()
        self.words = words
        self.weights = [w for _, w, _ in LEXICON] if weights_of_lines is None else list(weights_of_lines)
        # Masks and disguises are read as harmful words, the heaviest first.
        self.harmful = sorted((w for w, n in weights.items() if n >= 0.4 and len(w) >= 3), key=lambda w: (-weights[w], w))
        self.by_squeezed = {squeezed(w): w for w in sorted(words) if len(squeezed(w)) >= 4}
        self.store: dict[str, str] = {}

    def fold(self, token: str) -> str:
        """The lexicon's word that the token disguises, else the token."""
        known = self.store.get(token)
        if known is None:
            if len(self.store) > STORE:
                self.store.clear()
            known = self.store[token] = self._fold(token)
        return known

    def _fold(self, token: str) -> str:
        if token in self.words:
            return token
        if "*" in token and any(c.isalpha() for c in token):
            mask = re.compile(re.escape(token).replace(r"\*", "[a-z]"))
            return next((w for w in self.harmful if mask.fullmatch(w)), token)
        if not token.isalpha() and any(c.isalpha() or c in "@$" for c in token):
            for one in "il":
                plain = "".join(one if c == "1" else SIGNS.get(c, c) for c in token)
                if plain in self.words:
                    return plain
                if squeezed(plain) in self.by_squeezed:
                    return self.by_squeezed[squeezed(plain)]
            return token
        short = squeezed(token)
        if short != token and short in self.by_squeezed:
            return self.by_squeezed[short]
        if re.search(r"(.)\1\1", token):
            for again in (r"\1\1", r"\1"):
                if (less := re.sub(r"(.)\1\1+", again, token)) in self.words:
                    return less
        return token

    def joined(self, letters: str) -> str:
        """Letters that stood apart, as lexicon words where they are made of such, else as one word."""
        best: list[list[str] | None] = [[]] + [None] * len(letters)
        for end in range(1, len(letters) + 1):
            for begin in range(max(0, end - 14), end):
                word = letters[begin:end]
                if best[begin] is not None and (word in self.words and len(word) > 1 or word in ("a", "i")) and (best[end] is None or len(best[begin]) + 1 < len(best[end])):
                    best[end] = [*best[begin], word]
        return " ".join(best[-1] or [letters])

    def passages(self, text: str) -> Iterator[tuple[int, frozenset[int]]]:
        """(words, lexicon lines found) of each sentence with words."""
        store, fold = self.store.get, self.fold
        text = text.lower()
        if not text.isascii():
            text = BEYOND_ASCII.sub(lambda m: m[0].translate(folds()), text).lower()
        if "'" in text or "’" in text:
            text = SHORT.sub(lambda m: SHORTENED[m[1]], text)
        if APART.search(text):
            text = APART.sub(lambda m: self.joined(re.sub(r"[^a-z]", "", m[0])), text)
        nothing: frozenset[int] = frozenset()
        for sentence in SENTENCE.split(text):
            tokens = [store(t) or fold(t) for t in TOKEN.findall(sentence)]
            if not tokens:
                continue
            hits = list(self.automaton.iter(f" {' '.join(tokens)} "))
            if not hits:
                yield len(tokens), nothing
                continue
            spared = [(end - length + 1, end) for end, (lines, length) in hits if -1 in lines]
            found = {line for end, (lines, length) in hits for line in lines if line >= 0 and not any(end - length + 1 < y and x < end for x, y in spared)}
            yield len(tokens), frozenset(found)

    def weight(self, lines: frozenset[int]) -> float:
        return sum(self.weights[n] for n in lines)


@functools.lru_cache(maxsize=4)
def matcher(weights: tuple[float, ...] | None = None) -> Matcher:
    return Matcher(weights)


def score(text: str | None, weights: tuple[float, ...] | None = None) -> tuple[int, float, float, list[float]]:
    """(words, weight of all passages, of the heaviest one, heaviest by kind) of a text; zeros for null and empty texts."""
    words, total, worst, kinds = 0, 0.0, 0.0, [0.0] * len(KINDS)
    if text:
        judge = matcher(weights)
        for n, lines in judge.passages(text):
            words += n
            if not lines:
                continue
            whole = judge.weight(lines)
            total, worst = total + whole, max(worst, whole)
            if whole >= THRESHOLD - 1e-9:
                for line in lines:
                    kind = KINDS.index(LEXICON[line][0])
                    kinds[kind] = max(kinds[kind], sum(judge.weights[x] for x in lines if LEXICON[x][0] == LEXICON[line][0]))
    return words, total, worst, kinds


def worst_lines(text: str | None) -> list[int]:
    """The lexicon lines of the heaviest passage."""
    found = [lines for _, lines in matcher().passages(text or "") if lines]
    return sorted(max(found, key=lambda x: (matcher().weight(x), sorted(x)), default=()))


def fit(documents: DataFrame, labels: DataFrame, limit: int = LABELLED) -> tuple[float, ...]:
    """Weights of the lexicon's lines, fitted to at most ``limit`` rated documents (those of the least hashes; a document's ratings are averaged).

    The chance that a document is rated abusive is FLIP or 1 - FLIP at the ends, for ratings are sometimes wrong, and in between a logistic function of how far the
    heaviest passage's weight lies above THRESHOLD. The likeliest weights are taken under a prior around the written ones, and none is moved by
    more than a quarter. Without ratings the written weights hold.
    """
    rated = labels.where("doc_id IS NOT NULL AND abusive IS NOT NULL").groupBy("doc_id").agg(F.avg("abusive").alias("_rate")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)

    def lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("_rate"), pa.array([worst_lines(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))], names=["rate", "lines"])

    rows = documents.select("doc_id", "text").join(F.broadcast(rated), "doc_id").select("_rate", "text").mapInArrow(lines_of, "rate double, lines array<int>").groupBy("rate", "lines").count().collect()
    first = np.array([w for _, w, _ in LEXICON])
    if not rows:
        return tuple(first.tolist())
    found = np.zeros((len(rows), len(LEXICON)))
    for i, r in enumerate(rows):
        found[i, r["lines"]] = 1
    rate, n = np.array([r["rate"] for r in rows]), np.array([float(r["count"]) for r in rows])
    weights = first.copy()
    for _ in range(STEPS):
        chance = 1 / (1 + np.exp(-STEEPNESS * (found @ weights - THRESHOLD + MARGIN)))
        p = FLIP + (1 - 2 * FLIP) * chance
        slope = n * (rate / p - (1 - rate) / (1 - p)) * (1 - 2 * FLIP) * chance * (1 - chance) * STEEPNESS
        weights += RATE * (found.T @ slope - (weights - first) / PRIOR**2) / (1 + n.sum())
        weights = np.clip(weights, 0.75 * first, 1.25 * first)
    # What makes a case by itself goes on doing so: single ratings don't overrule the list.
    return tuple(np.where(first >= 1, np.maximum(weights, 1), weights).round(4).tolist())


def score_documents(documents: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(doc_id, source, n_words, score, worst, abusive, kind) of every row.

    score: weight per hundred words; worst: weight of the heaviest passage; kind: the heaviest kind of a case, else null. Null, empty and blank
    texts score 0. Repeated rows give repeated results. Texts are scored whole, whatever their length. Other columns are ignored. labels
    (doc_id, abusive): ratings that the weights are fitted to.
    """
    weights = None if labels is None else fit(documents, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [score(t, weights) for t in batch.column("text").to_pylist()]
            worst = np.array([r[2] for r in rows])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("source"), pa.array([r[0] for r in rows], pa.int32()),
                    pa.array([round(100 * r[1] / max(1, r[0]), 6) for r in rows], pa.float64()), pa.array(worst.round(6), pa.float64()), pa.array(worst >= THRESHOLD - 1e-9),
                    pa.array([KINDS[int(np.argmax(r[3]))] if max(r[3]) > 0 else None for r in rows], pa.string()),
                ],
                names=["doc_id", "source", "n_words", "score", "worst", "abusive", "kind"],
            )

    return documents.select("doc_id", "source", "text").mapInArrow(run, "doc_id bigint, source string, n_words int, score double, worst double, abusive boolean, kind string")


def rates_by_source(scores: DataFrame) -> DataFrame:
    """Documents, cases, the share of cases and the mean score of each source; a null source is one of its own."""
    rates = scores.groupBy("source").agg(F.count("*").alias("n_documents"), F.count_if("abusive").alias("n_abusive"), F.round(F.avg("score"), 6).alias("mean_score"))
    return rates.withColumn("rate", F.round(F.col("n_abusive") / F.col("n_documents"), 6))
