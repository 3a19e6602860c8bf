"""Conversation repair against a repair of rows one after another, in plain Python."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tidepanel.llm import repair
from tidepanel.llm.common import durable

BLANK = " \t\n\x0b\x0c\r"
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        kind, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        end = text.strip(BLANK)
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "none")
        seen.add((role, text))
    return out


def cheapest(rows, kinds):
    """Least (cost, audit), from left to right over states, as no repair inserts more than two rows in one place."""
    best = {0: (0, "")}

    def step(best, moves):
        out = {}
        for state, (cost, audit) in best.items():
            for price, letter, to in moves(state):
                new = (cost + price, audit + letter)
                out[to] = min(out.get(to, new), new)
        return out

    grown = lambda best: {q: min(d[q] for d in ds if q in d) for ds in [list(itertools.accumulate(range(2), lambda d, _: step(d, lambda p: [(2, "I", 3 if p == 2 else 2)]), initial=best))] for q in set().union(*ds)}
    for (_, _, role, _), kind in zip(rows, kinds, strict=True):

        def moves(p, role=role, kind=kind):
            out = [(3, "D", p)]
            if kind in ("none", "truncated"):
                more = kind == "truncated"
                out += [(more, "K", NEXT[p, role[:1]])] if (p, role[:1]) in NEXT else []
                out += [(2 + more, "R", 3 if p == 2 else 2)]
            return out

        best = step(grown(best), moves)
    best = grown(best)
    return min(best[q] for q in (0, 3) if q in best)


def applied(rows, audit):
    out, state, rows = [], 0, iter(rows)
    for letter in audit:
        if letter in "IR":
            role, state = ("assistant", 3) if state == 2 else ("user", 2)
            out.append((role, "" if letter == "I" else next(rows)[3]))
        else:
            _, _, role, text = next(rows)
            if letter == "K":
                state = NEXT[state, role[:1]]
                out.append((role, text))
    assert next(rows, None) is None and state in (0, 3)
    return out


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(damage([r for r in rows if r[0] == conv]), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        kinds, turns = faults(own), [r[1] for r in own if r[1] is not None]
        cost, audit = cheapest(own, kinds)
        initials = [r[2][:1] for r in own]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        lines = "\n".join(f"{r}:{t}" for r, t in applied(own, audit))
        out[conv] = (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit, hashlib.sha256(lines.encode()).hexdigest())
    return out


def got(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["Yes.", "No!", "why", "", " \n", None, "ok? \t", "é", "x" * 5000 + ".", "\x1c"]
    out = []
    for conv in [None, *range(150)]:
        for turn in range(rng.randrange(1, 12)):
            role = ["user", "assistant"][turn % 2] if rng.random() < 0.7 else rng.choice(roles)
            out.append((conv, None if rng.random() < 0.05 else turn + rng.choice([0, 0, 0, 1, 7]), role, f"{turn}." if rng.random() < 0.5 else rng.choice(texts)))
    out += [out[5]] * 3
    return out + [(1000, t, rng.choice(roles), rng.choice([f"{t}!", *texts])) for t in range(700)]


def test_report(spark, rows):
    table = durable(spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, code string, _place long"))
    assert got(repair.report(repair.damaged(table), table)) == brute(rows)
    assert repair.report(repair.damaged(table.filter("false")), table.filter("false")).count() == 0


def test_conversation_without_rows(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    table = durable(spark.createDataFrame([(gone, 0, "user", "Hello.")], "conv_id long, turn long, role string, text string"))
    assert got(repair.report(repair.damaged(table), table)) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_string_ids_and_repaired_rows(spark):
    table = durable(spark.createDataFrame([("b", 1, "user", "Hi."), ("b", 2, "user", "Well?"), ("a", 1, "assistant", "So."), ("c", 1, "system", "Be.")], "conv_id string, turn int, role string, text string"))
    placed = repair.ordered(table)
    audits = repair.parsed(repair.coded(placed))
    assert {r.conv_id: (r.cost, r.audit) for r in audits.collect()} == {"a": (2, "IK"), "b": (2, "KR"), "c": (3, "D")}
    out = sorted(map(tuple, repair.repaired(placed, durable(audits)).collect()))
    assert out == [("a", 0, "I", None, "user", ""), ("a", 1, "K", 1, "assistant", "So."), ("b", 0, "K", 1, "user", "Hi."), ("b", 1, "R", 2, "assistant", "Well?")]


def test_chart_is_least():
    """Cells of a chart, by the edits of all rows in order, over every short row of codes."""
    for codes in ("".join(c) for n in (1, 2, 3) for c in itertools.product("ABCDEHIMNP", repeat=n)):
        kinds = [repair.FAULTS[(ord(c) - 65) % 4] for c in codes]
        cells = repair.chart(codes)
        want = cheapest([(0, 0, (*"sua", "t")[(ord(c) - 65) // 4], "") for c in codes], kinds)
        assert min(c for q in repair.FINAL if (c := cells[repair.PAIRS.index((0, q))])) == want
