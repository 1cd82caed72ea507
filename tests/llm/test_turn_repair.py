"""Conversation repair against an exhaustive search over all edit sequences."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from tidesift.llm.queries import damaged, op13_turn_repair
from tidesift.llm.survivors import CUT_OFF, DOOMED, MOVES, NOTHING, SOUND, Edits, Survivors
from tidesift.llm.turn_repair import chain, repair, repaired_turns

SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """(cost, letters) of the best repair of (initial, fault) rows: Dijkstra over whole letter strings."""
    queue, done = [(0, "", 0, "")], set()
    while queue:
        cost, letters, i, roles = heapq.heappop(queue)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, letters
        state = (i, {"": "", "s": "s"}.get(roles, roles[-1:]))
        if (state, "settled") in done:
            continue  # an earlier path to the same state is cheaper, or as cheap with lesser letters
        done.add((state, "settled"))

        def go(price, letter, j, then):
            if re.fullmatch("s?(ua)*u?", then):
                heapq.heappush(queue, (cost + price, letters + letter, j, then))

        for role in "ua":
            go(5, "I", i, roles + role)
        if i < len(rows):
            initial, fault = rows[i]
            go(2, "D", i + 1, roles)
            if fault != DOOMED:
                more = 5 if fault == CUT_OFF else 0
                go(more, "K", i + 1, roles + (initial or "?"))
                for role in "ua":
                    go(1 + more, "R", i + 1, roles + role)
    raise AssertionError


def brute(rows):
    """The contract of the query for (turn, role, text) rows of one conversation, after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    n = {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        shown = re.findall(r"[^\x20\x09-\x0D]", text)
        if not shown:
            kind, fault = "blank", DOOMED
        elif (role, text) in seen:
            kind, fault = "duplicate", DOOMED
        elif shown[-1] not in ".!?":
            kind, fault = "truncated", CUT_OFF
        else:
            kind, fault = None, SOUND
        if kind:
            n[kind] += 1
        seen.add((role, text))
        faults.append(fault)
    cost, letters = cheapest([(r[1][:1], f) for r, f in zip(rows, faults, strict=True)])
    left, out = list(rows), []
    for letter in letters:
        expected = "assistant" if out and out[-1][0].startswith("u") else "user"
        if letter == "I":
            out.append((expected, ""))
            continue
        _, role, text = left.pop(0)
        if letter != "D":
            out.append((role if letter == "K" else expected, text))
    turns = [r[0] for r in rows if r[0] is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **n,
        "illegal": sum(p not in ("su", "ua", "au") for p in pairs),
        "cost": cost,
        "audit": letters,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
    }, out


def brute_damage(rows):
    """{conv_id: rows after damage} of (conv_id, turn, role, text) rows."""
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        show = [" " if x is None else str(x) for x in (conv, turn, role, text)]
        fault = zlib.crc32(f"{show[0]}:{show[1]}".encode()) % 20
        role, text = show[2:]
        if fault == 1:
            text = ""
        elif fault == 2:
            text = re.sub("[.!?]", "", text)
        elif fault == 4:
            role = "user"
        found[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return found


def odd_turns():
    """Nulls, ties, repeated rows, other roles, blanks and a long conversation."""
    rng = random.Random(11)
    texts = [None, "", " \n", "Yes.", "No!", "cut", "é.", "why?", "x" * 40_000 + ".", "a\x85", "日本。", "end.  \t"]
    roles = ["user", "assistant", "system", None, "", "tool", "User"]
    rows = []
    for conv in [None, *range(40)]:
        for _ in range(rng.randint(1, 9)):
            turn = rng.choice([None, 0, 1, 1, 2, 3, 4, 5, 6, 900])
            rows.append((conv, turn, rng.choice(roles[: 3 + 4 * (conv is None or conv % 3 == 0)]), rng.choice(texts)))
    rows += [rows[3]] * 3
    for i in range(300):
        role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[i % 2]
        rows.append((77, rng.randint(0, 150), role, rng.choice([*texts[3:8], f"{i}.", f"{i}!", f"{i}"])))
    rows += [(77, 7, "user", "Again.")] * 60
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    rows = odd_turns()
    extra = [(*r, i, "x") for i, r in enumerate(rows)]
    random.Random(1).shuffle(extra)
    return rows, spark.createDataFrame(extra, SCHEMA + ", _c int, audit string").repartition(4)


def test_moves_are_what_the_rules_allow():
    assert MOVES["u", SOUND][2][0] == (0, 0, "K") and MOVES["s", DOOMED][1] == [(1, 2, "D")]
    assert all(letters[-1] != "I" for moves in MOVES.values() for then in moves for _, _, letters in then)


def test_search_against_all_edit_sequences():
    rng = random.Random(5)
    for _ in range(800):
        rows = [(rng.choice(["s", "u", "a", "u", "a", ""]), rng.choice([0, 0, 0, 1, 2])) for _ in range(rng.randint(0, 9))]
        roles = []
        edits = Edits(NOTHING, lambda role, text, r=roles: r.append(role[:1]))
        search = Survivors(NOTHING, edits)
        for initial, fault in rows:
            search.feed(initial, fault, (initial, "t"))
        assert (search.finish(), "".join(edits.audit)) == cheapest(rows), rows
        assert re.fullmatch("(s?(ua)+)?", "".join(roles))


def test_memory_stays_bounded_and_edits_come_early():
    rng, sent = random.Random(3), []
    search = Survivors(NOTHING, lambda letters, row: sent.append(row))
    held = 0
    for i in range(30_000):
        search.feed(rng.choice("sua"), rng.choice([0, 0, 0, 1, 2]), i)
        held = max(held, search.held)
    assert held < 500 and len(sent) > 29_000 and sent == sorted(sent)
    tied = Survivors(NOTHING, lambda letters, row: None)
    for i in range(2_000):  # rows that never settle which one stays: every undecided row is kept for the comparison
        tied.feed("u", SOUND, i)
    assert tied.held <= 4 * 2_000


def test_chain_of_segments_equals_one_search():
    rng = random.Random(8)
    for _ in range(400):
        rows = [(rng.choice("suuaa"), rng.choice([0, 0, 0, 1, 2])) for _ in range(rng.randint(1, 14))]
        cuts = sorted(rng.sample(range(len(rows) + 1), rng.randint(0, min(3, len(rows)))))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        tables = [[Survivors(p, lambda x, y: None) for p in range(4)] for _ in parts]
        for part, searches in zip(parts, tables, strict=True):
            for initial, fault in part:
                for search in searches:
                    search.feed(initial, fault, None)
        borders, _ = chain([[c for s in t for c in s.cost] for t in tables], [[r for s in t for r in s.ranks()] for t in tables])
        letters, cost = [], 0
        for i, part in enumerate(parts):
            edits = Edits(borders[i], lambda role, text: None)
            search = Survivors(borders[i], edits)
            for initial, fault in part:
                search.feed(initial, fault, (initial, ""))
            cost += search.finish() if i + 1 == len(parts) else search.close(borders[i + 1])
            letters += edits.audit
        assert (cost, "".join(letters)) == cheapest(rows)


@pytest.mark.parametrize("limit", [50_000, 20])
def test_odd_conversations(odd, limit):
    rows, turns = odd
    want = {c: brute(r) for c, r in brute_damage(rows).items()}
    broken, copies = damaged(turns)
    got = repair(broken, copies=copies, limit=limit).collect()
    assert len(got) == len(want)
    for r in got:
        found = r.asDict()
        assert found.pop("conv_id") in want and found == want[r["conv_id"]][0], r["conv_id"]


@pytest.mark.parametrize("limit", [50_000, 20])
def test_repaired_turns(odd, limit):
    rows, turns = odd
    found = defaultdict(list)
    for r in repaired_turns(turns, limit=limit).collect():
        found[r["conv_id"]].append((r["place"], r["role"], r["text"]))
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn, " " if role is None else role, " " if text is None else text))
    for conv, group in groups.items():
        assert [t[1:] for t in sorted(found[conv])] == brute(group)[1]


def test_all_conversations(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    want = {c: brute(r)[0] for c, r in brute_damage(rows).items()}
    got = op13_turn_repair(spark, sf_dir).collect()
    assert {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in got} == want


@pytest.mark.parametrize("limit", [50_000, 1])
def test_no_rows(spark, limit):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair(empty, limit=limit).count() == 0 and repaired_turns(empty, limit=limit).count() == 0
    gone = spark.createDataFrame([(5, 1, "user", "a."), (5, 4, "user", "b.")], SCHEMA)
    from pyspark.sql import functions as F

    (row,) = repair(gone, copies=F.lit(0), limit=limit).collect()
    assert row["audit"] == "" and row["gaps"] == row["cost"] == 0
    assert row["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
