"""Byte-level BPE ids of whole texts, as the tokenizers library gives them.

Texts of Latin characters go whole through tiktoken, with the ranks of the same
vocabulary and straight into an array. Where characters lie beyond the Latin
blocks, the two libraries' character tables might differ. Such a text is cut at
single spaces between non-blank characters, across which the vocabulary's split
pattern never joins; so the ids of a piece do not depend on its neighbours.
Pieces beyond the Latin blocks go through tokenizers itself, and a per-process
cache saves repeated ones. If such a text has other blanks beside a space, it is
encoded as a whole by tokenizers.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from struct import pack

from tidesift.llm.common import per_process

CACHED_PIECES = 500_000  # then the cache starts anew
BEYOND_LATIN = re.compile("[\u0250-\U0010ffff]")


def byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_bytes(token: str, table: dict[str, int]) -> bytes:
    return bytes(table[c] for c in token)


class _Whole(Exception):
    """The text cannot be cut at its spaces."""


class _Pieces(dict):
    """Piece after a space -> its ids as little-endian 32-bit bytes."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode = encode
        self.stops = {stop: encode(stop) for stop in ".,;:!?"}

    def __missing__(self, piece: str) -> bytes:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Whole
        if len(self) >= CACHED_PIECES:
            self.clear()
        if piece[-1] in self.stops and piece[-2:-1].isalnum():
            # the split parts a single stop from a letter or digit before it
            ids = self[piece[:-1]] + self.stops[piece[-1]]
        else:
            ids = self.encode(" " + piece)
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class ByteEncoder:
    def __init__(self, vocabulary: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        table = byte_of_char()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        merged = [vocab["".join(pair if isinstance(pair, list) else pair.split(" "))] for pair in spec["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError("ids must follow the order of merges")
        ranks = {token_bytes(t, table): i for t, i in vocab.items()}
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.specials = list(special)
        self.exact = Tokenizer.from_file(vocabulary)
        self.exact.no_truncation()
        self.exact.no_padding()
        self.pieces = _Pieces(self._ids)

    def _latin(self, text: str) -> bytes:
        for special in self.specials:
            if special in text:
                return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()

    def _ids(self, text: str) -> bytes:
        if text.isascii() or not BEYOND_LATIN.search(text):
            return self._latin(text)
        ids = self.exact.encode(text, add_special_tokens=False).ids
        return pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian 32-bit bytes."""
        if not text:
            return b""
        if text.isascii() or not BEYOND_LATIN.search(text):
            return self._latin(text)
        first, *rest = text.split(" ")
        if not first or first[-1].isspace():
            return self._ids(text)
        try:
            return self._ids(first) + b"".join(map(self.pieces.__getitem__, rest))
        except _Whole:
            return self._ids(text)


def byte_encoder(vocabulary: str) -> ByteEncoder:
    """The encoder of this worker process."""
    return per_process(f"bytes:{vocabulary}", lambda: ByteEncoder(vocabulary))
