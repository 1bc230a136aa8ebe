"""Near-duplicate paragraphs: fingerprints split into pigeonhole blocks, joined on blocks, verified by Hamming distance.

Of a text's words (one that occurs k times counts as k members) two fingerprints are made. One has BLOCKS x WIDTH min-hash components: those of texts
of similarity s differ in a share of 1 - s of the components, so close texts leave whole blocks untouched. With s of 0.7, 0.75 and 0.8 a pair shares a block with
probability 0.9994, 0.99998 and 0.9999999, whatever the words are and wherever the edits fall. The other has 112 parities of the members in as many buckets: each
member that only one of two texts has changes one parity, so their Hamming distance is never more than the number of differing members. It is taken inside the
join on blocks, where it drops strangers without ever dropping a pair; the few pairs left are verified by the exact similarity of their words.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strataflow.operators.bloom import bloom_filter, might_contain
from strataflow.storage import discard, new_path, stage

SIMILARITY, LEAST_WORDS = 0.7, 12
BLOCKS, WIDTH = 40, 5
#: Buckets of the parities; the rest of two 64-bit integers is the number of members.
BUCKETS, SIZE_BITS = 112, 16
#: Classes that a task remembers, so that it gives their blocks once.
SEEN = 400_000
WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Codes(dict):
    """Stable 64-bit codes of words; the store starts anew when it is full."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 400_000:
            self.clear()
        code = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return code


_codes = _Codes()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, offsets): the codes of all texts' words in a row, and where each text's begin. Null texts have none."""
    codes: list[int] = []
    offsets = np.zeros(len(texts) + 1, np.int64)
    get, find = _codes.__getitem__, WORD.findall
    for i, text in enumerate(texts):
        if text:
            codes.extend(map(get, find(text.lower())))
        offsets[i + 1] = len(codes)
    return np.array(codes, np.uint64), offsets


def members(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The n-th occurrence of a word in a text is a member of its own; sorted by text."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((codes, rows))
    words = codes[order]
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]) | (rows[1:] != rows[:-1])
    begin = np.maximum.accumulate(np.where(new, np.arange(len(words)), 0)) if len(words) else np.zeros(0, np.int64)
    nth = (np.arange(len(words)) - begin).astype(np.uint64)
    return mix(words + nth * _MIX)


@functools.cache
def _hashes() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20)
    return random.integers(0, 2**31, BLOCKS * WIDTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1), random.integers(0, 2**32, BLOCKS * WIDTH, dtype=np.uint32)


def handles(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two integers of each text: the parities of its members in the buckets, and in the lowest bits their number (all ones: that or more)."""
    bucket, starts, most = mix(member * np.uint64(7)) % np.uint64(BUCKETS), offsets[:-1], (1 << SIZE_BITS) - 1
    first = np.bitwise_xor.reduceat(np.where(bucket < 64, np.uint64(1) << (bucket % np.uint64(64)), np.uint64(0)), starts)
    second = np.bitwise_xor.reduceat(np.where(bucket < 64, np.uint64(0), np.uint64(1) << (bucket % np.uint64(64) + np.uint64(SIZE_BITS))), starts)
    return first.view(np.int64), (second | np.minimum(np.diff(offsets), most).astype(np.uint64)).view(np.int64)


def blocks_of(member: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """32-bit keys of the blocks of each stretch of members beginning at starts."""
    times, plus = _hashes()
    values = (member >> np.uint64(32)).astype(np.uint32)
    blocks = np.empty((len(starts), BLOCKS), np.int32)
    for b in range(BLOCKS):
        key = np.full(len(starts), b, np.uint64)
        for i in range(b * WIDTH, (b + 1) * WIDTH):
            key = mix(key * _MIX + np.minimum.reduceat(values * times[i] + plus[i], starts))
        blocks[:, b] = (key >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return blocks


def _classes(member: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """16 bytes for each text's words whatever their order: the sums of two scrambles of its members (texts mustn't be empty)."""
    sums = [np.add.reduceat(mix(member * np.uint64(k)), offsets[:-1]) for k in (3, 5)]
    return np.stack(sums, 1).astype("<u8").tobytes()


def eligible(paragraphs: DataFrame, least_words: int) -> DataFrame:
    """Rows that can hold that many words; the exact count is made on the words."""
    return paragraphs.where(F.col("paragraph_id").isNotNull() & (F.length("text") >= 2 * least_words - 1)).select(F.lower("paragraph_id").alias("paragraph_id"), "text")


def _long_enough(batch: pa.RecordBatch, least_words: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(ids, members, offsets) of the texts with enough words."""
    codes, offsets = word_codes(batch.column("text").to_pylist())
    keep = np.diff(offsets) >= least_words
    codes = codes[np.repeat(keep, np.diff(offsets))]
    offsets = np.concatenate(([0], np.cumsum(np.diff(offsets)[keep])))
    return batch.column("paragraph_id").filter(pa.array(keep)), members(codes, offsets), offsets


FINGERPRINT = "paragraph_id string, class binary, first long, second long, blocks array<int>"


def fingerprint_rows(rows: DataFrame, least_words: int) -> DataFrame:
    """The fingerprints of each text. ``class`` is the same for texts of the same words; ``blocks`` is null where the task has given them for the class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            ids, member, offsets = _long_enough(batch, least_words)
            if not len(ids):
                continue
            whole = _classes(member, offsets)
            classes = [whole[16 * i : 16 * i + 16] for i in range(len(ids))]
            if len(seen) > SEEN:
                seen.clear()
            new = np.zeros(len(ids), bool)
            for i, c in enumerate(classes):
                if c not in seen:
                    seen.add(c)
                    new[i] = True
            lengths = np.diff(offsets)
            blocks = blocks_of(member[np.repeat(new, lengths)], np.concatenate(([0], np.cumsum(lengths[new])))[:-1]) if new.any() else np.zeros((0, BLOCKS), np.int32)
            ends = np.concatenate(([0], np.cumsum(new) * BLOCKS)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, mask=np.append(~new, False)), pa.array(blocks.ravel()))
            first, second = handles(member, offsets)
            yield pa.RecordBatch.from_arrays([ids, pa.array(classes, pa.binary()), pa.array(first), pa.array(second), lists], names=["paragraph_id", "class", "first", "second", "blocks"])

    return rows.mapInArrow(run, FINGERPRINT)


def member_rows(rows: DataFrame, least_words: int) -> DataFrame:
    """(class, members) of each text, for the exact similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, member, offsets = _long_enough(batch, least_words)
            if len(ids):
                classes = _classes(member, offsets)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(member.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([classes[16 * i : 16 * i + 16] for i in range(len(ids))], pa.binary()), lists], names=["class", "members"])

    return rows.mapInArrow(run, "class binary, members array<long>")


def _may_reach(similarity: float) -> Column:
    """Whether the words behind two handles can be as similar: the Hamming distance of their parities is at most the number of members that only one has."""
    most = (1 << SIZE_BITS) - 1
    size = lambda x: F.col(x).bitwiseAND(F.lit(most))
    distance = F.bit_count(F.col("first_a").bitwiseXOR(F.col("first_b"))) + F.bit_count(F.shiftrightunsigned(F.col("second_a").bitwiseXOR(F.col("second_b")), SIZE_BITS))
    least, greatest = F.least(size("second_a"), size("second_b")), F.greatest(size("second_a"), size("second_b"))
    bound = F.lit((1 - similarity) / (1 + similarity)) * (least + greatest) + F.lit(1e-6)
    return (greatest == most) | ((least >= F.lit(similarity) * greatest - F.lit(1e-6)) & (distance <= bound))


def _representatives(prints: DataFrame) -> DataFrame:
    """(class, first, second, blocks): one row a class. Only classes that several tasks have met are shuffled."""
    once = prints.where("blocks IS NOT NULL").select("class", "first", "second", "blocks")
    several = stage(once.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class"), "several")
    doubtful = might_contain(once, bloom_filter(several, F.col("class")), F.col("class"))
    merged = once.where(doubtful).groupBy("class").agg(*[F.first(c).alias(c) for c in ("first", "second", "blocks")])
    return once.where(~doubtful).unionByName(merged)


def similar_classes(rows: DataFrame, prints: DataFrame, similarity: float, least_words: int) -> DataFrame:
    """(class_a, class_b): classes of different words whose similarity reaches the threshold, class_a < class_b.

    Copies are one class, so a group of copies of any size puts one row into each of its blocks. Nothing stands between the shuffle of the blocks and
    their join, so adaptive execution can split a hot block on both sides.
    """
    texts = _representatives(prints)
    key = F.shiftleft(F.col("b").cast("long"), 32).bitwiseOR(F.col("part").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    blocks = texts.select("first", "second", F.posexplode("blocks").alias("b", "part"))
    # Both sides give every column a name of their own: so their plans are alike and the blocks are shuffled once.
    side = lambda x: blocks.select(key.alias(f"block{x}"), F.col("first").alias(f"first{x}"), F.col("second").alias(f"second{x}"))
    ordered = (F.col("first_a") < F.col("first_b")) | ((F.col("first_a") == F.col("first_b")) & (F.col("second_a") < F.col("second_b")))
    pairs = side("_a").join(side("_b").hint("merge"), (F.col("block_a") == F.col("block_b")) & ordered & _may_reach(similarity)).select("first_a", "second_a", "first_b", "second_b").distinct()
    classes = lambda x: texts.select(F.col("class").alias(f"class{x}"), F.col("first").alias(f"first{x}"), F.col("second").alias(f"second{x}"))
    apart = pairs.join(classes("_a"), ["first_a", "second_a"]).join(classes("_b"), ["first_b", "second_b"]).select("class_a", "class_b")
    # Texts of few differing words can have equal parities: they meet by these, without a block.
    alike = (F.col("first_a") == F.col("first_b")) & (F.col("second_a") == F.col("second_b")) & (F.col("class_a") < F.col("class_b"))
    equal = classes("_a").join(classes("_b"), alike).select("class_a", "class_b")
    close = stage(apart.unionByName(equal).select(F.least("class_a", "class_b").alias("class_a"), F.greatest("class_a", "class_b").alias("class_b")), "close")
    wanted = close.select(F.explode(F.array("class_a", "class_b")).alias("class"))
    held = prints.where("blocks IS NOT NULL").select("paragraph_id", "class")
    held = held.where(might_contain(held, bloom_filter(wanted, F.col("class")), F.col("class"))).groupBy("class").agg(F.min("paragraph_id").alias("paragraph_id"))
    held = stage(held, "held")
    texts = rows.where(might_contain(rows, bloom_filter(held, F.col("paragraph_id")), F.col("paragraph_id")))
    words = member_rows(texts, least_words).dropDuplicates(["class"])
    side = lambda x: words.select(F.col("class").alias(f"class_{x}"), F.col("members").alias(f"_members_{x}"))
    checked = close.join(side("a"), "class_a").join(side("b"), "class_b")
    common = F.size(F.array_intersect("_members_a", "_members_b"))
    either = F.size("_members_a") + F.size("_members_b") - common
    return stage(checked.where(common >= F.lit(similarity) * either - 1e-9).select("class_a", "class_b"), "similar")


def near_copies(paragraphs: DataFrame, similarity: float = SIMILARITY, least_words: int = LEAST_WORDS) -> tuple[DataFrame, DataFrame]:
    """(membership, pairs): (paragraph_id, class) of every paragraph of enough words, and the pairs of similar classes.

    Paragraphs with the same words in any order share a class (similarity 1). Ids compare in lower case; repeated rows are one
    member; null, empty and short texts are no members; rows without id are left out. Empty tables give empty results. Texts are used whole.
    """
    rows = eligible(paragraphs, least_words)
    prints = stage(fingerprint_rows(rows, least_words), "prints")
    return prints.select("paragraph_id", "class").distinct(), similar_classes(rows, prints, similarity, least_words)


def similar_pairs(paragraphs: DataFrame, similarity: float = SIMILARITY, least_words: int = LEAST_WORDS) -> DataFrame:
    """(paragraph_id_a, paragraph_id_b), smaller id first: every pair of similar paragraphs, copies included."""
    membership, pairs = near_copies(paragraphs, similarity, least_words)
    one = membership.select(F.col("class").alias("class_a"), F.col("paragraph_id").alias("_a"))
    two = membership.select(F.col("class").alias("class_b"), F.col("paragraph_id").alias("_b"))
    across = pairs.join(one, "class_a").join(two, "class_b")
    several = membership.groupBy("class").agg(F.count("*").alias("_n")).where("_n > 1").select("class")
    copies = membership.join(several, "class").select("class", F.col("paragraph_id").alias("_a"))
    within = copies.join(two, (F.col("class") == F.col("class_b")) & (F.col("_a") < F.col("_b")))
    ends = [F.least("_a", "_b").alias("paragraph_id_a"), F.greatest("_a", "_b").alias("paragraph_id_b")]
    return across.select(*ends).unionByName(within.select(*ends))


def components(pairs: DataFrame) -> DataFrame:
    """(node, group): the smallest node of each node's connected component, for nodes that have a pair.

    Each round takes the least group of the neighbours and then that group's own group, so long chains take few rounds.
    """
    spark = pairs.sparkSession
    edges = stage(pairs.select(F.explode(F.array(F.struct(F.col("class_a").alias("node"), F.col("class_b").alias("near")), F.struct(F.col("class_b").alias("node"), F.col("class_a").alias("near")))).alias("e")).select("e.*"), "edges")
    state, path = edges.groupBy("node").agg(F.min("near").alias("group")).select("node", F.least("node", "group").alias("group")), None
    while True:
        at = new_path(spark, "groups")
        state.write.parquet(at)
        state = spark.read.schema("node binary, `group` binary").parquet(at)
        near = edges.join(state.select(F.col("node").alias("near"), F.col("group").alias("_g")), "near").groupBy("node").agg(F.min("_g").alias("_g"))
        best = state.join(near, "node").select("node", "group", F.least("group", "_g").alias("_best"))
        up = state.select(F.col("node").alias("_best"), F.col("group").alias("_up"))
        moved = best.join(up, "_best").select("node", F.least("_best", "_up").alias("group"), (F.least("_best", "_up") < F.col("group")).alias("moved"))
        again = new_path(spark, "groups")
        moved.write.parquet(again)
        moved = spark.read.schema("node binary, `group` binary, moved boolean").parquet(again)
        if path:
            discard(spark, path)
        if not moved.where("moved").limit(1).count():
            return moved.select("node", "group")
        state, path = moved.select("node", "group"), again


def copy_groups(paragraphs: DataFrame, similarity: float = SIMILARITY, least_words: int = LEAST_WORDS) -> DataFrame:
    """(paragraph_id, group_id, n_links): each paragraph of enough words, its group and the number of similar classes of other words.

    group_id is the smallest paragraph id of the group, which is the paragraph's own where it is alike to no other.
    """
    membership, pairs = near_copies(paragraphs, similarity, least_words)
    links = pairs.select(F.explode(F.array("class_a", "class_b")).alias("class")).groupBy("class").agg(F.count("*").alias("n_links"))
    grouped = components(pairs).select(F.col("node").alias("class"), "group")
    whole = membership.join(grouped, "class", "left").join(links, "class", "left")
    whole = whole.select("paragraph_id", F.coalesce("group", "class").alias("group"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    least = whole.groupBy("group").agg(F.min("paragraph_id").alias("group_id"))
    return whole.join(least, "group").select("paragraph_id", "group_id", "n_links")
