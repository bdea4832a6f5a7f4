"""Conversation repair against a search over all states, one turn after the other."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textrep.llm import conversations, grammar

SCHEMA = "conv_id long, turn long, role string, text string, audit string, place long, kind int, copies string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def cheapest(turns):
    """Least (cost, audit, lines) over all ways to change ``(role, text, must go, short)`` turns into a wanted sequence."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names = {"u": "user", "a": "assistant"}

    def inserts(ways):
        for _ in range(2):
            for state, (cost, audit, lines) in list(ways.items()):
                for role in "ua":
                    if (state, role) in step:
                        new = (cost + 3, audit + "I", [*lines, f"{names[role]}:"])
                        ways[step[state, role]] = min(ways.get(step[state, role], new), new, key=lambda w: w[:2])
        return ways

    ways = {"": (0, "", [])}
    for role, text, gone, short in turns:
        found = {}
        for state, (cost, audit, lines) in inserts(ways).items():
            options = [(state, (cost + 4, audit + "D", lines))]
            if not gone:
                if (state, role[:1]) in step:
                    options.append((step[state, role[:1]], (cost + 3 * short, audit + "K", [*lines, f"{role}:{text}"])))
                options += [(step[state, r], (cost + 3 + 3 * short, audit + "R", [*lines, f"{names[r]}:{text}"])) for r in "ua" if (state, r) in step]
            for to, way in options:
                found[to] = min(found.get(to, way), way, key=lambda w: w[:2])
        ways = found
    ways = inserts(ways)
    return min((ways[s] for s in ("", "a") if s in ways), key=lambda w: w[:2])


def expected(given):
    out = []
    for conv in {r[0] for r in given}:
        rows = sorted((r for r in damage(given) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        blank = duplicate = truncated = 0
        met, turns = set(), []
        for _, _, role, text in rows:
            said = text.strip(" \t\n\x0b\x0c\r")
            gone = not said or (role, text) in met
            short = not gone and said[-1] not in ".!?"
            blank, duplicate, truncated = blank + (not said), duplicate + bool(said and gone), truncated + short
            met.add((role, text))
            turns.append((role, text, gone, short))
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        numbers = [r[1] for r in rows if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        cost, audit, lines = cheapest(turns)
        out.append((conv, gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def made(seed, conversations_, most):
    pick = random.Random(seed)
    said = ["Yes.", "No!", "Why?", "cut off", "", "  ", "Fine. \n", "Yes.", None, "é.", "x" * 500]
    rows = []
    for conv in conversations_:
        for turn in range(pick.randint(1, most)):
            rows.append((conv, pick.choice([turn, turn, turn, turn + 1, None]), pick.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]), pick.choice([*said, f"turn {turn}.", f"turn {turn}"])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", 1, 2, "c") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("bits", [2, 12])
def test_repair_of_random_conversations(spark, bits, monkeypatch):
    given = made(1, [*range(60), None], 9) + made(2, [100], 150) + [(101, 0, "user", "Same.")] * 30
    rows = conversations.damaged(frame(spark, given))
    found = conversations.audits(rows, block_bits=bits)
    got = conversations.digests(rows, found).select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected(given), key=repr)


def test_whole_operator_and_repaired_rows(spark):
    given = made(3, range(30), 12)
    rows = conversations.damaged(frame(spark, given))
    got = sorted(map(tuple, conversations.repair(rows).collect()))
    assert got == sorted(expected(given))
    lines = conversations.repaired(rows, conversations.audits(rows)).orderBy("conv", "place").collect()
    texts = {}
    for r in lines:
        assert r.place == len(texts.setdefault(r.conv, []))
        texts[r.conv].append(f"{r.role}:{r.text}")
    for row in got:
        assert hashlib.sha256("\n".join(texts.get(row[0], [])).encode()).hexdigest() == row[-1]
        assert re.fullmatch("(s?(ua)+)?", "".join(t[0] for t in texts.get(row[0], [])))


def test_without_damage_and_empty_table(spark):
    given = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Hello."), (2, 5, "user", "Alone.")]
    got = sorted(map(tuple, conversations.repair(conversations.as_they_are(frame(spark, given))).collect()))
    assert [r[:8] for r in got] == [(1, 0, 0, 0, 0, 0, 0, "KKK"), (2, 0, 0, 0, 0, 0, 3, "KI")]
    assert conversations.repair(conversations.damaged(frame(spark, given).limit(0))).count() == 0


def test_dropped_conversation_has_zeros(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = conversations.repair(conversations.damaged(frame(spark, [(conv, 0, "user", "Gone.")]))).first()
    assert tuple(got) == (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_rules_give_back_the_sequences_and_their_matrices():
    pick = np.random.default_rng(1)
    sequences = [bytes(pick.integers(0, 9, n).astype(np.uint8)) for n in (1, 2, 3, 5, 8, 13, 200, 400)] + [bytes([3, 5] * 100), bytes([3] * 50), bytes([3] * 7), b""]
    written = np.concatenate([np.append(np.frombuffer(s, np.uint8).astype(np.int32), -1) for s in sequences])
    rules, short = grammar.re_pair(written, 2)

    def spelled(symbol):
        return [symbol] if symbol < grammar.SYMBOLS else [x for part in rules[symbol - grammar.SYMBOLS] for x in spelled(part)]

    assert [x for s in short.tolist() for x in (spelled(s) if s >= 0 else [s])] == written.tolist()
    # No pair is left that could be replaced twice.
    assert not grammar.re_pair(short, 2)[0] or len(rules) > 0
    for uses in (2, 5, 1 << 30):
        found = grammar.solve(sequences, [True] * len(sequences), uses)
        matrices = grammar.solve(sequences, [False] * len(sequences), uses)
        for s, ((cost, audit),), cells in zip(sequences, found, matrices):
            turns = [("?" if c == 0 else {0: "s", 1: "u", 2: "a", 3: "?"}[(c - 1) // 2], "", c == 0, c > 0 and c % 2 == 0) for c in s]
            assert (cost, str(audit)) == cheapest(turns)[:2]
            assert [(c[0], str(c[1])) for c in [grammar.finish(cells[:4])]] == [(cost, str(audit))]


def test_ropes_compare_as_their_text():
    pick = random.Random(4)
    ropes = [grammar.Rope("".join(pick.choice("DK") for _ in range(pick.randint(0, 3)))) for _ in range(20)]
    for _ in range(300):
        ropes.append(pick.choice(ropes) + pick.choice(ropes))
        a, b = pick.choice(ropes), pick.choice(ropes)
        assert grammar.before((a,), (b,)) == (str(a) < str(b))


def test_hot_conversation_lies_in_several_blocks(spark):
    given = [(1, i, "user" if i % 2 else "assistant", f"said {i}.") for i in range(3000)]
    rows = conversations.damaged(frame(spark, given))
    got = conversations.digests(rows, conversations.audits(rows, block_bits=6)).first()
    want = expected(given)[0]
    assert (got.gaps, got.duplicate, got.truncated, got.illegal, got.cost, got.audit, got.sha256) == (want[1], want[3], want[4], want[5], want[6], want[7], want[8])
