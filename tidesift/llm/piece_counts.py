"""Token counts by a linear longest-match automaton.

Words are read as a blank followed by their bytes and cut greedily into the
longest vocabulary entries from the left. The automaton is the vocabulary's
trie with failure links: where a node has no child for the next byte, the
tokens that greedy matching would cut off so far are popped, as a precomputed
count, and reading goes on at the failure link. Links and counts are folded
into one transition table, so a byte costs one lookup and no piece is built.

Defined results
    null text      no words, no tokens
    null doc_id    kept
    equal rows     one result each
    long texts     whole; a word of any length takes linear time
    empty table    an empty result
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidesift.llm.byte_tokens import byte_of_char, token_bytes
from tidesift.llm.common import per_process, text_of

CACHED = 500_000


class LongestMatch:
    """Transition table of the automaton over bytes; node 0 is the root."""

    def __init__(self, vocabulary: list[bytes]):
        child: list[dict[int, int]] = [{}]
        ends = [False]
        for token in vocabulary:
            node = 0
            for byte in token:
                if byte not in child[node]:
                    child[node][byte] = len(child)
                    child.append({})
                    ends.append(False)
                node = child[node][byte]
            ends[node] = True
        if len(child[0]) < 256 or not all(ends[n] for n in child[0].values()):
            raise ValueError("every single byte must be a token")
        size = len(child)
        self.next = np.zeros((size, 256), dtype=np.int32)
        self.popped = np.zeros((size, 256), dtype=np.int32)  # tokens popped on the way
        self.rest = np.zeros(size, dtype=np.int32)  # tokens left when the word ends here
        for byte, node in child[0].items():
            self.next[0, byte] = node
        # link and pops[node]: where reading goes on, and what is popped, if the node has no fitting child
        link, pops = [0] * size, [0] * size
        queue = [(0, byte, node) for byte, node in child[0].items()]
        for parent, byte, node in queue:
            if ends[node]:
                link[node], pops[node] = 0, 1
            else:
                back = link[parent]
                link[node] = int(self.next[back, byte])
                pops[node] = pops[parent] + int(self.popped[back, byte])
            self.next[node] = self.next[link[node]]
            self.popped[node] = self.popped[link[node]] + pops[node]
            self.rest[node] = pops[node] + self.rest[link[node]]
            for b, n in child[node].items():
                self.next[node, b], self.popped[node, b] = n, 0
                queue.append((node, b, n))

    def count(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word, all words read in step."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        order = np.argsort(-sizes, kind="stable")
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        starts = (np.cumsum(sizes) - sizes)[order]
        falling = sizes[order]
        state = np.zeros(len(words), dtype=np.int64)
        found = np.zeros(len(words), dtype=np.int64)
        active = len(words)
        for step in range(int(falling[0]) if len(words) else 0):
            while active and falling[active - 1] <= step:
                active -= 1
            byte = flat[starts[:active] + step]
            found[:active] += self.popped[state[:active], byte]
            state[:active] = self.next[state[:active], byte]
        found += self.rest[state]
        out = np.empty_like(found)
        out[order] = found
        return out


def load(vocabulary: str) -> LongestMatch:
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec["added_tokens"]}
    table = byte_of_char()
    return LongestMatch([token_bytes(t, table) for t in spec["model"]["vocab"] if t not in special])


def _counts(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    automaton = per_process(f"match:{vocabulary}", lambda: load(vocabulary))
    cache = per_process(f"match-cache:{vocabulary}", dict)
    for batch in batches:
        n_words, n_tokens = [], []
        texts = batch.column(1)
        for low in range(0, len(texts), 256):
            split = [t.as_py().encode().split() for t in texts.slice(low, 256)]
            unseen = list({w for words in split for w in words if w not in cache})
            if len(cache) + len(unseen) > CACHED:
                cache.clear()
                unseen = list({w for words in split for w in words})
            cache.update(zip(unseen, automaton.count([b" " + w for w in unseen]).tolist(), strict=True))
            n_words += map(len, split)
            n_tokens += [sum(map(cache.__getitem__, words)) for words in split]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())],
            names=["doc_id", "n_words", "n_tokens"],
        )


def count_tokens(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Words and greedy longest-match tokens of every document."""
    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    counted = narrow.mapInArrow(lambda b: _counts(b, vocabulary), "doc_id long, n_words long, n_tokens long")
    return counted.withColumnRenamed("doc_id", id_column)
