"""Byte-pair encoding by a tokenization automaton.

The automaton reads tokens: after token ``a`` it is in the state of ``a``, and
an arc labelled ``b`` leaves that state where ``a b`` may stand side by side in
an encoded word. At first only single symbols exist and all arcs are there. The
merges are then compiled in one after the other. The gadget of merge (u, v)
adds a token w = uv:

- w's state gets the arcs that leave v's state (as they were just before), as
  what may follow v may follow w;
- every state with an arc u gets an arc w;
- the arc v is taken off the state of u.

States share arcs instead of copying them: a token keeps its two parts and its
turn, and a cut arc keeps its turn, so any arc of the finished automaton is
looked up by stepping back through the gadgets. The automaton is deterministic:
a prefix of a word has one last token at most, and so a word one accepting
path, its encoding.
"""

from __future__ import annotations

import json

KNOWN_ARCS = 2_000_000  # then the memo starts anew
OPENING = 5
END = "\0"  # stands for the mark of a word's end


class MergeAutomaton:
    """Compiled from a vocabulary and its merges, in order of rank."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end_mark: str = "</w>"):
        plain = {self._own(token, end_mark): i for token, i in vocab.items()}
        self.ids = plain
        self.labels = {i: token for token, i in vocab.items()}
        size = max(vocab.values()) + 1
        self.born = [-1] * size
        self.first, self.second = [-1] * size, [-1] * size
        self.cut: dict[int, int] = {}
        for turn, (u, v) in enumerate(merges):
            a, b = vocab[u], vocab[v]
            w = vocab[u + v]
            if self.born[w] >= 0:
                raise ValueError(f"two merges make {u + v!r}")
            self.born[w], self.first[w], self.second[w] = turn, a, b
            self.cut[a << 32 | b] = turn
        self.length = [0] * size
        for token, i in plain.items():
            self.length[i] = len(token)
        self.longest = max(self.length)
        # a token's longest proper prefix that is a token too
        self.shorter = [-1] * size
        for token, i in plain.items():
            for n in range(len(token) - 1, 0, -1):
                if token[:n] in plain:
                    self.shorter[i] = plain[token[:n]]
                    break
        # longest match by the next few characters: (token, whether longer tokens begin so)
        self.openings: dict[str, tuple[int, bool]] = {}
        for token in plain:
            for n in range(1, min(OPENING, len(token)) + 1):
                self._open(token[:n], n < len(token) and n == OPENING)
        self.known: dict[int, bool] = {}

    def _open(self, opening: str, longer: bool) -> None:
        found = self.openings.get(opening)
        if found is None:
            token = next((self.ids[opening[:n]] for n in range(len(opening), 0, -1) if opening[:n] in self.ids), -1)
            self.openings[opening] = token, longer
        elif longer and not found[1]:
            self.openings[opening] = found[0], True

    def _longest(self, text: str, at: int) -> int:
        """The longest token that ``text`` has at a place, -1 if none."""
        opening = text[at : at + OPENING]
        found = self.openings.get(opening)
        if found is None:
            found = -1, False
            for n in range(len(opening) - 1, 0, -1):
                if opening[:n] in self.openings:
                    found = self.openings[opening[:n]][0], False
                    break
            if len(self.openings) < KNOWN_ARCS:
                self.openings[opening] = found
        token, longer = found
        if longer:
            for n in range(min(self.longest, len(text) - at), OPENING, -1):
                i = self.ids.get(text[at : at + n])
                if i is not None:
                    return i
        return token

    @staticmethod
    def _own(token: str, end_mark: str) -> str:
        return token[: -len(end_mark)] + END if token.endswith(end_mark) and token != end_mark else token

    def arc(self, a: int, b: int) -> bool:
        """Whether token ``b`` may follow token ``a``."""
        key = a << 32 | b
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= KNOWN_ARCS:
                self.known.clear()
            found = self.known[key] = self._arc(a, b)
        return found

    def _arc(self, a: int, b: int) -> bool:
        born, cut = self.born, self.cut
        turn = len(born) + len(cut)
        while True:
            at = cut.get(a << 32 | b)
            if at is not None and at < turn:
                return False
            if born[a] < 0 and born[b] < 0:
                return True
            if born[a] >= born[b]:
                turn = min(turn, born[a])
                a = self.second[a]
            else:
                turn = min(turn, born[b] + 1)
                b = self.first[b]

    def encode(self, word: str) -> list[int]:
        """The accepting path of one word, given in the byte-level alphabet.

        From each position the longest token with an arc is tried first, then
        its shorter prefixes. A position from which no token leads on is never
        visited again, so the work is linear in the word's length.
        """
        text = word + END
        size = len(text)
        whole = self.ids.get(text)
        if whole is not None:
            # a token is the encoding of its own text
            return [whole]
        path: list[int] = []
        dead: set[int] = set()
        at, token = 0, -2
        while True:
            if token == -2:
                token = self._longest(text, at)
            while token >= 0:
                end = at + self.length[token]
                if end not in dead and (not path or self.arc(path[-1], token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                path.append(token)
                at = end
                if at == size:
                    return path
                token = -2
            elif path:
                dead.add(at)
                last = path.pop()
                at -= self.length[last]
                token = self.shorter[last]
            else:
                raise KeyError(f"no path for {word!r}")


def load(path: str) -> tuple[MergeAutomaton, dict]:
    """The automaton of a tokenizer file, and the file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    return MergeAutomaton(model["vocab"], merges, model["end_of_word_suffix"]), spec
