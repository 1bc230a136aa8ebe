"""Encoding of a whole corpus with a public byte-level BPE, by forced boundaries.

A pair of bytes that occurs inside no vocabulary token can never be joined by a merge, so a text is certain to have a token
boundary between them. Texts are cut there and each distinct fragment is encoded once.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

#: Folder of the vocabulary files on the driver, which hands the file to the executors; where it has none, the executors' own folder is read.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the published pre-tokenisation pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fragments and bytes of them kept by a worker. When the store is full it starts anew.
KEPT, KEPT_BYTES = 200_000, 16 << 20


class Encoder:
    def __init__(self, folder: str) -> None:
        import tiktoken

        with open(f"{folder}/{VOCABULARY}", "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.bpe = tiktoken.Encoding("forced", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.forced = np.ones(1 << 16, bool)
        for token in ranks:
            if len(token) > 1:
                data = np.frombuffer(token, np.uint8).astype(np.int64)
                self.forced[data[:-1] << 8 | data[1:]] = False
        self._empty()

    def _empty(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.start, self.count, self.used, self.bytes = [], [], 0, 0

    def cuts(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where fragments begin. Beside the forced pairs a cut needs: whole characters on both sides, no white space on
        the left (the pattern looks ahead after it) and no apostrophe on the right (it may begin a contraction)."""
        cut = np.zeros(len(raw), bool)
        if len(raw) > 1:
            left, right = raw[:-1], raw[1:]
            cut[1:] = self.forced[left.astype(np.int64) << 8 | right] & ((right & 0xC0) != 0x80) & (right != 0x27)
            space = (left == 32) | ((left >= 9) & (left <= 13)) | ((left >= 0x1C) & (left <= 0x1F))
            second, third = np.zeros_like(left), np.zeros_like(left)
            second[1:], third[2:] = left[:-1], left[:-2]
            space |= (second == 0xC2) & ((left == 0x85) | (left == 0xA0))
            space |= (third == 0xE2) & (second == 0x80) & ((left <= 0x8A) | (left == 0xA8) | (left == 0xA9) | (left == 0xAF))
            space |= ((third == 0xE2) & (second == 0x81) & (left == 0x9F)) | ((third == 0xE3) & (second == 0x80) & (left == 0x80)) | ((third == 0xE1) & (second == 0x9A) & (left == 0x80))
            cut[1:] &= ~space
        begins = starts[:-1][starts[1:] > starts[:-1]]
        cut[begins] = True
        return np.flatnonzero(cut)

    def _learn(self, fragments: set[bytes]) -> None:
        new = [f for f in fragments if f not in self.place]
        self.bytes += sum(map(len, new))
        if len(self.place) + len(new) > KEPT or self.bytes > KEPT_BYTES:
            self._empty()
            new = list(fragments)
        for fragment in new:
            ids = self.bpe.encode_ordinary(fragment.decode("utf-8"))
            if self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.int32)])
            self.ids[self.used : self.used + len(ids)] = ids
            self.place[fragment] = len(self.start)
            self.start.append(self.used)
            self.count.append(len(ids))
            self.used += len(ids)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of all texts in a row, and where each text's begin. Null and empty texts have none."""
        texts = texts.cast(pa.large_string())
        if texts.null_count:
            texts = texts.fill_null("")
        bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        data = texts.buffers()[2].to_pybytes()[bounds[0] : bounds[-1]] if texts.buffers()[2] is not None else b""
        starts = bounds - bounds[0]
        raw = np.frombuffer(data, np.uint8)
        begins = self.cuts(raw, starts)
        ends = np.append(begins[1:], len(raw)) if len(begins) else begins
        fragments = [data[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
        self._learn(set(fragments))
        place = np.fromiter(map(self.place.__getitem__, fragments), np.int64, len(fragments))
        count, start = np.array(self.count, np.int64)[place] if len(place) else place, np.array(self.start, np.int64)[place] if len(place) else place
        total = np.concatenate(([0], np.cumsum(count)))
        ids = self.ids[np.repeat(start - total[:-1], count) + np.arange(total[-1])]
        return ids, total[np.searchsorted(begins, starts)]


@functools.cache
def encoder(folder: str) -> Encoder:
    return Encoder(folder)


def handed_out(table: DataFrame, folder: str) -> None:
    """Adds the vocabulary to the files that executors fetch from the driver."""
    path = f"{folder}/{VOCABULARY}"
    context = table.sparkSession.sparkContext
    if os.path.exists(path) and VOCABULARY not in {os.path.basename(f) for f in context.listFiles}:
        context.addFile(path)


def local_encoder(folder: str) -> Encoder:
    """On a worker: the encoder from the file that was handed out, else from the folder."""
    fetched = SparkFiles.get(VOCABULARY)
    return encoder(os.path.dirname(fetched) if os.path.exists(fetched) else folder)


def encode_column(table: DataFrame, key: str, text: str, folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids): the ids of each row's text, without special tokens. Null and empty texts have the empty list."""
    handed_out(table, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, offsets = local_encoder(folder).encode(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    kind = dict(table.dtypes)[key]
    return table.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(table: DataFrame, key: str, text: str, folder: str = TOKENIZERS) -> DataFrame:
    """(key, n_tokens): the number of each row's ids; 0 for null and empty texts. The ids never leave the worker."""
    handed_out(table, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = local_encoder(folder).encode(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets).astype(np.int32))], names=[key, "n_tokens"])

    kind = dict(table.dtypes)[key]
    return table.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens int")
