"""Encoding and decoding of whole texts with a word-level BPE vocabulary.

Texts are normalised and split into words as the tokenizer file says, and each
word runs through the merge automaton; a worker keeps the words it has seen.
Texts with characters beyond the Latin blocks, or with special tokens, are cut
at ASCII blanks first, and such chunks are normalised by the library. Decoding
emits the labels of the path's arcs, separated by blanks, as the file names no
decoder.

Defined results
    null text      an empty text: no ids, and an empty text decoded
    null doc_id    kept
    equal rows     one result each
    long texts     whole; a word of any length takes linear time
    empty table    an empty result
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidesift.llm.byte_tokens import byte_of_char
from tidesift.llm.common import per_process, text_of
from tidesift.llm.merge_automaton import load

CACHED = 600_000  # words, then the cache starts anew
BASIC_END = 0x250  # below, case and letters are the same in both libraries, and all is composed
# The split this encoder knows; files with another one are split by the library.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _basic_split() -> re.Pattern:
    """The same split with written-out classes for characters below ``BASIC_END``."""
    kinds = {c: unicodedata.category(chr(c))[0] for c in range(BASIC_END)}
    letters = "".join(re.escape(chr(c)) for c, k in kinds.items() if k == "L")
    numbers = "".join(re.escape(chr(c)) for c, k in kinds.items() if k == "N")
    blanks = "\t\n\x0b\x0c\r \x85\xa0"
    return re.compile(f"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{numbers}]|[^{blanks}{letters}{numbers}]+")


class _Words(dict):
    """Word -> its ids as little-endian 32-bit numbers."""

    def __init__(self, automaton, spell: Callable[[str], str]):
        super().__init__()
        self.automaton, self.spell = automaton, spell

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED:
            self.clear()
        path = self.automaton.encode(self.spell(word))
        ids = pack(f"<{len(path)}I", *path)
        if len(word) <= 64:
            self[word] = ids
        return ids


class WordEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.automaton, spec = load(path)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = {i: label.encode() for i, label in self.automaton.labels.items()}
        self.labels |= {i: label.encode() for label, i in self.specials.items()}
        self.known_split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] == SPLIT
        self.split = _basic_split().findall
        self.beyond = re.compile(f"[{chr(BASIC_END)}-{chr(0x10FFFF)}]|" + "|".join(map(re.escape, self.specials))).search
        char_of_byte = {b: c for c, b in byte_of_char().items()}
        self.words = _Words(self.automaton, lambda w: "".join(map(char_of_byte.__getitem__, w.encode())))
        self.spelled = _Words(self.automaton, str)  # words that the library has spelled already

    def _chunk(self, text: str) -> bytes:
        """A text without blanks that has special tokens or other scripts."""
        ids = []
        for part in re.split("(" + "|".join(map(re.escape, self.specials)) + ")", text):
            if part in self.specials:
                ids.append(pack("<I", self.specials[part]))
            elif part and (not self.known_split or max(part) >= chr(BASIC_END)):
                normal = self.library.normalizer.normalize_str(part)
                ids += [self.spelled[w] for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
            elif part:
                ids += map(self.words.__getitem__, self.split(part.lower()))
        return b"".join(ids)

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian 32-bit numbers."""
        if self.known_split and not self.beyond(text):
            return b"".join(map(self.words.__getitem__, self.split(text.lower())))
        return b"".join([self._chunk(chunk.decode()) for chunk in text.encode().split()])

    def decode(self, ids: bytes) -> bytes:
        """The arcs' labels, separated by blanks, in UTF-8."""
        return b" ".join(map(self.labels.__getitem__, memoryview(ids).cast("I")))


def word_encoder(path: str) -> WordEncoder:
    return per_process(f"words:{path}", lambda: WordEncoder(path))


def _digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoder = word_encoder(path)
    for batch in batches:
        sizes, ids_sha, text_sha = [], [], []
        for text in batch.column(1):
            ids = encoder.encode(text.as_py())
            decoded = encoder.decode(ids)
            sizes.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            text_sha.append(hashlib.sha256(decoded).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def round_trip_digests(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Token count and digests of ids and decoded text of every document."""
    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return narrow.mapInArrow(lambda b: _digests(b, path), kinds).withColumnRenamed("doc_id", id_column)


def _coded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoder = word_encoder(path)
    for batch in batches:
        coded = [encoder.encode(text.as_py()) for text in batch.column(1)]
        ids = [np.frombuffer(c, dtype="<u4").astype(np.int32) for c in coded]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([encoder.decode(c).decode() for c in coded], pa.string())],
            names=["doc_id", "ids", "decoded"],
        )


def encode_texts(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Ids and decoded text of every document."""
    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    coded = narrow.mapInArrow(lambda b: _coded(b, path), "doc_id long, ids array<int>, decoded string")
    return coded.withColumnRenamed("doc_id", id_column)
