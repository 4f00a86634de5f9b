"""Packing by powers of two.

A document of n ids becomes floor(n / 4096) pieces of 4096 and, for the rest, one piece for each set bit of n mod 4096, longest first.
Every piece fills a sequence of its own whose length is a power of two, so no sequence crosses documents and none is padded.  Pieces
of one length form a bucket; each task puts its pieces of a bucket into batches of BATCH_TOKENS, so a batch is a full rectangle (but for
each task's last of a length).
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, worker_of

#: Tokens of a batch of pieces of one length.
BATCH_TOKENS = 1 << 18
#: The normaliser and pre-tokeniser that the short way stands for, as tokenizer files write them.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Entries of a worker's caches of words and of pre-tokens.
CACHE = 600_000


class WordIds:
    """Ids of texts under a tokenizer whose pre-tokenizer drops white space, as little-endian 32-bit integers.

    Such a tokenizer never looks across white space, so texts are split there and each distinct word is encoded once.  A text with
    characters outside the range in which lower-casing, NFC and the character classes need no Unicode tables goes through the
    tokenizers library as a whole.
    """

    def __init__(self, path: str) -> None:
        import re

        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        # The short way is for this normaliser and pre-tokeniser; any other tokenizer goes through the library as a whole.
        self.short = told.get("normalizer") == NORMALIZER and told.get("pre_tokenizer") == PRE_TOKENIZER
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.pieces = Tokenizer(self.whole.model)
        self.pieces.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.plain = re.compile(r"[\t-\r\x20-\x7e\xa0-ɏ]*").fullmatch
        # The tokenizer's own split pattern, for the plain range; the classes are spelt out for re.
        number = "0-9²³¹¼-¾"
        letter = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
        self.split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^\s{letter}{number}]+").findall
        self.piece_cache, self.word_cache = _Cache(self._piece), _Cache(self._word)

    def _piece(self, piece: str) -> bytes:
        return np.asarray(self.pieces.encode(piece, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        return b"".join([self.piece_cache[x] for x in self.split(word)])

    def __call__(self, text: str) -> bytes:
        if self.short and self.plain(text):
            if len(self.word_cache) > CACHE:
                self.word_cache.clear()
            if len(self.piece_cache) > CACHE:
                self.piece_cache.clear()
            return b"".join(map(self.word_cache.__getitem__, text.lower().split()))
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


class _Cache(dict):
    def __init__(self, make) -> None:
        self.make = make

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) <= 64:
            self[key] = value
        return value


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def binary_lengths(n: int, longest: int) -> list[int]:
    """n as powers of two up to longest (itself one), in descending order."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in reversed(range(longest.bit_length())) if rest >> k & 1]


def pack(docs: DataFrame, path: str, longest: int = 4096, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket, batch_id (and ids if with_ids).

    A null or empty text is the end id alone.  Rows that repeat a doc_id are packed one by one.  sequence_id numbers the pieces of a
    row upward from a base that no other row shares (the row's place in its partition of the scan); it and batch_id follow the scan's
    layout.  Memory: one batch of documents.
    """
    if longest & longest - 1:
        raise ValueError("the longest sequence must be a power of two")
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_of("packing", word_ids.cache_clear)
        encode, task, dealt = word_ids(path), TaskContext.get().partitionId(), [0] * 64
        for batch in batches:
            for at in range(0, len(batch), 512):  # bounds what one frame of pieces holds
                rows = []
                for doc_id, text in zip(batch["doc_id"].iloc[at : at + 512], batch["text"].iloc[at : at + 512], strict=True):
                    data, start = encode(text) + end, 0
                    n = len(data) // 4
                    for length in binary_lengths(n, longest):
                        piece, bucket = data[4 * start : 4 * (start + length)], length.bit_length() - 1
                        batch_id = (task * 64 + bucket << 32) + dealt[bucket] * length // BATCH_TOKENS
                        dealt[bucket] += 1
                        rows.append((doc_id, start, length, zlib.crc32(piece), n, 0, bucket, batch_id, *([np.frombuffer(piece, "<u4")] if with_ids else [])))
                        start += length
                yield pd.DataFrame(rows, columns=[*columns])

    kinds = {"doc_id": "long", "start": "long", "length": "long", "ids_crc32": "long", "doc_tokens": "long", "offset": "long", "bucket": "int", "batch_id": "long"}
    columns = kinds | ({"ids": "array<long>"} if with_ids else {})
    out = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInPandas(run, ", ".join(f"{k} {v}" for k, v in columns.items()))
    return out.withColumn("sequence_id", F.monotonically_increasing_id())
