"""Conversation repair against exhaustive search and a plain program over whole conversations."""

import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tallymark.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def legal(initials):
    body = initials[1:] if initials[:1] == "s" else initials
    return not initials or (body and body == "ua" * (len(body) // 2))


def exhaustive(rows):
    """(cost, script) of the cheapest of all edits with up to two inserts in every gap; rows are (initial, gone, cut)."""
    best = None
    inserts = [i for n in range(3) for i in itertools.product("ua", repeat=n)]
    for gaps in itertools.product(inserts, repeat=len(rows) + 1):
        for edits in itertools.product("DKua", repeat=len(rows)):
            if any(gone and e != "D" for e, (_, gone, _) in zip(edits, rows)):
                continue
            initials, script, cost = "".join(gaps[0]), "I" * len(gaps[0]), 2 * len(gaps[0])
            for e, (initial, _, cut), gap in zip(edits, rows, gaps[1:]):
                script += e if e in "DK" else "R"
                initials += "" if e == "D" else initial if e == "K" else e
                cost += (3 if e == "D" else 0 if e == "K" else 2) + (cut and e != "D")
                initials += "".join(gap)
                script += "I" * len(gap)
                cost += 2 * len(gap)
            if legal(initials) and (best is None or (cost, script) < best):
                best = (cost, script)
    return best


def test_scripts_are_the_cheapest_and_ascii_least_of_all():
    for n in range(3):
        for initials in itertools.product("suax", repeat=n):
            for flags in itertools.product([(False, False), (True, False), (False, True)], repeat=n):
                rows = [(i, *f) for i, f in zip(initials, flags)]
                assert C.finished(C.solve(rows))[1:] == exhaustive(rows), rows
    r = random.Random(1)
    for _ in range(6):
        rows = [(r.choice("suax"), r.random() < 0.2, r.random() < 0.3) for _ in range(3)]
        assert C.finished(C.solve(rows))[1:] == exhaustive(rows), rows


def texts(rows, start=0):
    """The same dynamic program with whole scripts as texts."""
    state = {start: (0, "")}

    def least(options):
        out = {}
        for s, c, t in options:
            out[s] = min(out.get(s, (c, t)), (c, t))
        return out
    follow = {0: 2, 1: 2, 2: 3, 3: 2}
    for initial, gone, cut in rows:
        for _ in range(2):
            state = least([(s, *v) for s, v in state.items()] + [(follow[s], c + 2, t + "I") for s, (c, t) in state.items()])
        options = [(s, c + 3, t + "D") for s, (c, t) in state.items()]
        if not gone:
            options += [(follow[s], c + 2 + cut, t + "R") for s, (c, t) in state.items()]
            options += [(follow[s], c + cut, t + "K") for s, (c, t) in state.items() if initial == "..ua"[follow[s]]]
            options += [(1, c + cut, t + "K") for s, (c, t) in state.items() if s == 0 and initial == "s"]
        state = least(options)
    return state


@pytest.mark.parametrize("modulus", [(1 << 61) - 1, 2])
def test_long_ties_and_colliding_hashes(modulus):
    r = random.Random(modulus)
    for n in (1, 7, 40, 300):
        rows = [(r.choice("suaax"), r.random() < 0.2, r.random() < 0.3) for _ in range(n)]
        for start in range(4):
            assert C.solve(rows, start, C.Edits(modulus=modulus)) == texts(rows, start)


def plain(rows):
    """The contract, one conversation after another; rows may be in any order."""
    left, order = {}, []
    for conv, turn, role, text in rows:
        if conv not in left:
            left[conv] = []
            order.append(conv)
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
            left[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv in order:
        digest = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
        said = sorted(left[conv], key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))
        seen, faults = set(), []
        for _, role, text in said:
            fault = "blank" if not text.strip(SPACE) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(SPACE)[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
        turns = [t for t, *_ in said if t is not None]
        plan = [(role[:1], f in ("blank", "duplicate"), f == "truncated") for (_, role, _), f in zip(said, faults)]
        ends = texts(plan)
        cost, audit = min((c + 2 * {0: 0, 3: 0, 2: 1, 1: 2}[s], t + "I" * {0: 0, 3: 0, 2: 1, 1: 2}[s]) for s, (c, t) in ends.items())
        lines, state, at = [], 0, 0
        for e in audit:
            to = 3 if state == 2 else 2
            if e == "I":
                lines.append(("user:" if to == 2 else "assistant:"))
            elif e != "D":
                role = said[at][1] if e == "K" else "user" if to == 2 else "assistant"
                lines.append(f"{role}:{said[at][2]}")
                to = 1 if role[:1] == "s" else to
            state = state if e == "D" else to
            at += e != "I"
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
                    sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(plan, plan[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def made(seed, convs, most):
    r = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(r.randint(1, most)):
            role = r.choices(["user", "assistant", "system", "tool", None, "", "unknown"], [8, 8, 2, 1, 1, 1, 1])[0]
            text = r.choice(["Hello there.", "How are you?", "fine", " \t\n", "", None, f"Text {r.random()}.", f"cut off {r.random()}", "Ünï 中文!  \n", "a. b"])
            rows.append((conv, r.choice([turn, turn, turn, turn + 5, None]), role, text))
    return rows


def run(spark, rows, **more):
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("taken") for n in ("mark", "slice", "place", "audit", "copy", "n", "_mark")})
    found = C.audited(frame, C.damage(frame), **more).collect()
    return sorted(map(tuple, found), key=lambda r: (r[0] is not None, r[0] or 0))


def test_reports_match_the_plain_program_however_the_rows_are_cut(spark):
    rows = made(1, 60, 12) + [(None, 1, "user", "no id."), (None, None, None, None), (77, 3, "user", "Again."), (77, 3, "user", "Again.")] * 2
    expected = plain(rows)
    assert run(spark, rows) == expected
    assert run(spark, rows, slices=9, part=3) == expected


def test_one_conversation_that_holds_most_rows(spark):
    r = random.Random(5)
    rows = made(2, 10, 6) + [(500, t // 2, r.choice(["user", "assistant", "system"]), r.choice(["Same.", f"Own {t}.", f"cut {t}"])) for t in range(900)] + [(501, 1, "user", "One row.")] * 150
    assert run(spark, rows, slices=6, part=70) == plain(rows)


def test_empty_tables_dropped_and_long_conversations(spark):
    assert run(spark, []) == []
    gone = next((c, 0) for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone[0], 0, "user", "Hello."), (5, 1, "user", "word " * 200_000 + "."), (5, 2, "assistant", "."), (6, -(1 << 62), "user", "a."), (6, 1 << 62, "assistant", "b.")]
    found = run(spark, rows)
    assert found == plain(rows)
    assert [x for x in found if x[0] == gone[0]] == [(gone[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
