"""Cheapest repair of a sequence of turns: a Viterbi search that emits edits as soon as its survivors coalesce.

Every row is kept, given another role or deleted, and empty turns may be
inserted before it. The states are the role sequences so far, as far as they
matter: nothing, a system turn, up to a user turn, up to an assistant turn.
One path survives per state. Paths are a tree of backpointers with reference
counts: a node that no survivor descends from is freed, and once all survivors
share an ancestor, the edits up to it are final and leave the tree. Memory
holds only what is still undecided.

Of paths at equal cost the one whose edit letters are ASCII-least survives.
Tied paths are compared over their whole unresolved part, up to the ancestor
they share. Comparing row by row is exact: the letters of one row end with the
letter that uses it up, so none is the beginning of another.
"""

from __future__ import annotations

from functools import cmp_to_key

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
ENDS = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}  # inserts that end a sequence
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
SOUND, DOOMED, CUT_OFF = range(3)  # DOOMED rows have to be deleted
REROLE, DELETE, INSERT, CUT_OFF_KEPT = 1, 2, 5, 5
INFINITE = 1 << 60
# (state, other, lead): a path in ``state`` dearer than one in ``other`` by more than ``lead`` cannot win any more. An
# assistant turn may be followed by all that may follow nothing or a system turn, but for a system turn, which can be
# deleted; after a user turn that holds once an assistant turn is inserted. Without this the path that deletes every
# row would live as long as the conversation.
BEATEN = (
    (NOTHING, ASSISTANT, DELETE),
    (NOTHING, USER, INSERT + DELETE),
    (SYSTEM, ASSISTANT, 0),
    (SYSTEM, USER, INSERT),
)


def after_keeping(state: int, initial: str) -> int | None:
    """The state after a turn that keeps its role, or None if it cannot stand there."""
    if initial == "s":
        return SYSTEM if state == NOTHING else None
    if initial == ("a" if state == USER else "u"):
        return NEXT[state]
    return None


def _moves(initial: str, fault: int) -> list[list[tuple[int, int, str]]]:
    """Per next state the (previous state, cost, letters) of one row, the best of each previous state."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    extra = CUT_OFF_KEPT if fault == CUT_OFF else 0
    for before in range(STATES):
        state = before
        for inserted in range(3):  # a third insert leads where the first one does
            options = [(state, DELETE, "D")]
            if fault != DOOMED:
                options.append((NEXT[state], REROLE + extra, "R"))
                kept = after_keeping(state, initial)
                if kept is not None:
                    options.append((kept, extra, "K"))
            for then, cost, letter in options:
                move = (INSERT * inserted + cost, "I" * inserted + letter)
                best[before, then] = min(best.get((before, then), move), move)
            state = NEXT[state]
    return [[(b, *best[b, then]) for b in range(STATES) if (b, then) in best] for then in range(STATES)]


MOVES = {(initial, fault): _moves(initial, fault) for initial in ("s", "u", "a", "") for fault in (SOUND, DOOMED, CUT_OFF)}


class Node:
    """One row's edit at the end of a path; ``refs`` counts its children and the survivors that end here."""

    __slots__ = ("letters", "refs", "row", "up")

    def __init__(self, up: Node | None, letters: str, row):
        self.up, self.letters, self.row, self.refs = up, letters, row, 0


def comes_first(a: Node, a_more: str, b: Node, b_more: str) -> bool:
    """Whether a's letters and ``a_more`` come before b's; both paths have used up the same rows."""
    least = a_more < b_more
    while a is not b:
        if a.letters != b.letters:
            least = a.letters < b.letters  # the difference nearest to the shared ancestor counts
        a, b = a.up, b.up
    return least


class Survivors:
    """The surviving paths from one state; ``sink(letters, row)`` gets the edits in order."""

    def __init__(self, entry: int, sink):
        self.root = Node(None, "", None)
        self.sink = sink
        self.cost = [INFINITE] * STATES
        self.ends: list[Node | None] = [None] * STATES
        self.cost[entry], self.ends[entry], self.root.refs = 0, self.root, 1
        self.held = 0  # nodes in the tree

    def feed(self, initial: str, fault: int, row) -> None:
        old = self.ends
        cost, found = [INFINITE] * STATES, [None] * STATES
        for then, moves in enumerate(MOVES[initial if initial in "sua" else "", fault]):
            end = None
            for before, price, letters in moves:
                node = old[before]
                if node is None:
                    continue
                total = self.cost[before] + price
                if total < cost[then] or (total == cost[then] and comes_first(node, letters, *end)):
                    cost[then], end = total, (node, letters)
            found[then] = end
        for state, other, lead in BEATEN:
            if cost[state] > cost[other] + lead:
                found[state] = None
        ends = [None] * STATES
        for then, end in enumerate(found):
            if end is None:
                cost[then] = INFINITE
                continue
            ends[then] = Node(*end, row)
            ends[then].refs = 1
            end[0].refs += 1
            self.held += 1
        self.cost, self.ends = cost, ends
        for node in old:
            if node is not None:
                self._release(node)
        if self.root.refs == 1:
            self._settle()

    def _release(self, node: Node) -> None:
        node.refs -= 1
        while not node.refs and node is not self.root:
            node, self.held = node.up, self.held - 1
            node.refs -= 1

    def _settle(self) -> None:
        """Emit what all survivors share; they stand below the root."""
        node, path = next(n for n in self.ends if n is not None), []
        while node is not self.root:
            path.append(node)
            node = node.up
        while self.root.refs == 1 and path:
            child = path.pop()
            self.sink(child.letters, child.row)
            child.up, child.row, child.letters = None, None, ""
            self.root, self.held = child, self.held - 1

    def ranks(self) -> list[int]:
        """The place of each survivor in the order of the letters since the entry; -1 where none ends."""
        alive = [s for s in range(STATES) if self.ends[s] is not None]
        order = sorted(alive, key=cmp_to_key(lambda p, q: -1 if comes_first(self.ends[p], "", self.ends[q], "") else 1))
        return [order.index(s) if s in order else -1 for s in range(STATES)]

    def close(self, end: int) -> int:
        """Emit the path that ends in this state; its cost."""
        node, path = self.ends[end], []
        while node is not self.root:
            path.append(node)
            node = node.up
        for node in reversed(path):
            self.sink(node.letters, node.row)
        return self.cost[end]

    def finish(self) -> int:
        """Emit the cheapest path that ends a conversation; its cost."""
        end = best_end(self.cost, self.ranks())
        cost = self.close(end)
        if ENDS[end]:
            self.sink(ENDS[end], None)
        return cost + INSERT * len(ENDS[end])


def best_end(cost: list[int], ranks: list[int]) -> int:
    """The last state of the best whole path, closing inserts included."""
    # letters of two survivors differ before either ends, so the inserts behind them decide no tie
    return min((s for s in range(STATES) if ranks[s] >= 0), key=lambda s: (cost[s] + INSERT * len(ENDS[s]), ranks[s]))


class Edits:
    """Edits as turns: a sink that knows the role every position takes. ``out(role, text)`` gets the turns that stand."""

    def __init__(self, entry: int, out):
        self.state, self.out, self.audit = entry, out, []

    def __call__(self, letters: str, row) -> None:
        self.audit.append(letters)
        for letter in letters:
            if letter == "K":
                role, text = row
                self.state = after_keeping(self.state, role[:1])
                self.out(role, text)
            elif letter != "D":
                self.state = NEXT[self.state]
                self.out(ROLES[self.state], row[1] if letter == "R" else "")
