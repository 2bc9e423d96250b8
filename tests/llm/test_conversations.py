"""Repair of damaged conversations against a plain dynamic program and against all edits of short ones."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from brinewave.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string, conv string, lines int, at string, cost string"
GOAL = re.compile("(s?(ua)+)?")


def damaged(rows: list[tuple]) -> dict:
    """conv_id to its rows after damage, in order."""
    found: dict = {}
    for conv, turn, role, text in rows:
        mine = found.setdefault(conv, [])
        fault = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 1:
            text = ""
        elif fault == 2:
            text = re.sub("[.!?]", "", text)
        elif fault == 4:
            role = "user"
        mine += [] if fault == 0 else [(turn, role, text)] * (2 if fault == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in found.items()}


def faults(rows: list[tuple]) -> list[str]:
    found, seen = [], set()
    for _, role, text in rows:
        plain = re.findall(r"[^\x20\x09-\x0D]", text)
        found.append("blank" if not plain else "duplicate" if (role, text) in seen else "truncated" if plain[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def step(state: str, initial: str) -> str | None:
    """States: '' at the start, then the last initial."""
    return initial if (state + initial) in ("s", "u", "su", "ua", "au") else None


def plain_repair(rows: list[tuple]) -> tuple[int, str, list[tuple]]:
    """For every state the least (cost, letters, rows left): whole strings are kept and compared."""
    best = {"": (0, "", ())}

    def inserts(now: dict) -> dict:
        found = dict(now)
        for _ in range(2):
            for state, (cost, letters, left) in list(found.items()):
                for role in ("user", "assistant"):
                    if (after := step(state, role[0])) is not None:
                        offer = (cost + 3, letters + "I", left + ((role, ""),))
                        found[after] = min(found.get(after, offer), offer, key=lambda x: x[:2])
        return found

    for (_, role, text), fault in zip(rows, faults(rows)):
        new: dict = {}
        for state, (cost, letters, left) in inserts(best).items():
            choices = [(state, 4, "D", ())]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if role and step(state, role[0]) is not None:
                    choices.append((role[0], more, "K", ((role, text),)))
                choices += [(r[0], more + 3, "R", ((r, text),)) for r in ("user", "assistant") if step(state, r[0]) is not None]
            for after, price, letter, kept in choices:
                offer = (cost + price, letters + letter, left + kept)
                new[after] = min(new.get(after, offer), offer, key=lambda x: x[:2])
        best = new
    cost, letters, left = min((v for s, v in inserts(best).items() if s in ("", "a")), key=lambda x: x[:2])
    return cost, letters, list(left)


def expected(rows: list[tuple]) -> tuple:
    found = faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, letters, left = plain_repair(rows)
    said = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
    return (gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, letters, said)


def odd_rows() -> list[tuple]:
    rng = random.Random(3)
    texts = ["Yes.", "No!", "And then", "  \t", "", None, "Why?\n", "é 漢字.", "x", "long " * 3000 + "end."]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "unknown", "User"]
    rows: list[tuple] = []
    for conv in [*range(150), None]:
        for turn in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((conv, rng.choice([turn, turn, turn, None, 3 * turn]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"said {rng.random()}."))
    for turn in range(400):  # one conversation holds a third of the rows
        rows.append((999, turn, ["user", "assistant"][turn % 2] if rng.random() < 0.8 else "system", rng.choice(["again.", "again", f"t{turn}.", f"t{turn}"])))
    return rows + rows[:40]


@pytest.fixture(scope="module")
def rows():
    return odd_rows()


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], SCHEMA).repartition(6)


def collected(frame) -> dict:
    return {r["conv"]: tuple(r[c] for c in (*cv.COUNTS, "audit", "digest")) for r in frame.collect()}


@pytest.mark.parametrize("most_rows", [cv.PIECE_ROWS, 7, 1])
def test_repair_equals_the_plain_program(table, rows, most_rows):
    got = collected(cv.repair(cv.damage(table), most_rows=most_rows).conversations)
    want = {c: expected(r) for c, r in damaged(rows).items()}
    assert got == want
    assert any(v[6] == "" for v in want.values()) and any(len(v[6]) > 300 for v in want.values())


def test_lines_are_the_rows_left(table, rows):
    done = cv.repair(cv.undamaged(table), lines=True, most_rows=50)
    lines: dict = {}
    for r in sorted(done.lines.collect(), key=lambda r: r["at"]):
        lines.setdefault(r["conv"], []).extend((x["role"], x["text"]) for x in r["lines"])
    digests = {c: v[-1] for c, v in collected(done.conversations).items()}
    assert lines.keys() == digests.keys()
    for conv, left in lines.items():
        assert GOAL.fullmatch("".join(r[0] for r, _ in left))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest() == digests[conv]


def test_all_edits_of_short_conversations():
    """Letters against every string of edits with at most two inserts at a place."""

    def every(codes: bytes) -> tuple[int, str]:
        slots = [["I" * k + x for k in range(3) for x in "DKR"] for _ in codes] + [["", "I", "II"]]
        best = (1 << 30, "")
        for letters in map("".join, itertools.product(*slots)):
            state, cost, i, ok = cv.START, 0, 0, True
            for x in letters:
                if x == "I":
                    state, cost = cv.DUE[state], cost + 3
                    continue
                code, i = codes[i], i + 1
                if x == "D":
                    cost += 4
                    continue
                kept = code & 3
                cost += 3 if code & cv.CUT else 0
                if code == cv.GONE or x == "K" and not (kept and (kept == cv.SYSTEM and state == cv.START or kept == cv.DUE[state])):
                    ok = False
                    break
                cost += 3 if x == "R" else 0
                state = kept if x == "K" else cv.DUE[state]
            if ok and state in (cv.START, cv.ASSISTANT):
                best = min(best, (cost, letters))
        return best

    for n in range(4):
        for codes in map(bytes, itertools.product(range(9), repeat=n)):
            letters, state = cv.audit(codes, 0, n, cv.START, cv.END)
            letters += cv.TAIL[state]
            assert (cv.cost_of(letters, codes), letters) == every(codes)


def test_empty_table_and_text_ids(spark):
    none = spark.createDataFrame([], "conv_id string, turn long, role string, text string")
    assert cv.repair(cv.damage(none)).conversations.collect() == []
    one = spark.createDataFrame([("c", 1, "user", "Hi."), ("c", None, "system", "Be."), (None, None, None, None)], none.schema)
    got = collected(cv.repair(cv.undamaged(one)).conversations)
    assert got["c"][5:7] == (3, "KKI") and got[None][5:7] == (4, "D")
