"""Conversation repair against an exhaustive search."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from marquee.llm import conversation_repair as cr

GOOD = re.compile(r"(s?(ua)+)?\Z")


def all_repairs(initials, faults):
    """Every edit list without needless inserts: (cost, audit); up to two inserts in front of a row and at the end."""
    best = None
    choices = [["D"] if f == 2 else ["D", "K", "Ru", "Ra"] for f in faults]
    gaps = ["", "u", "a", "ua", "au"]
    for edits in itertools.product(*choices):
        for put in itertools.product(gaps, repeat=len(initials) + 1):
            said, audit, cost = "", "", 0
            for at, ins in enumerate(put):
                said, audit, cost = said + ins, audit + "I" * len(ins), cost + 2 * len(ins)
                if at < len(initials):
                    e = edits[at]
                    audit += e[0]
                    cost += {"D": 3, "K": 0, "R": 2}[e[0]] + (faults[at] if e != "D" else 0)
                    said += "" if e == "D" else initials[at] if e == "K" else e[1]
            if GOOD.match(said) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def test_search_equals_all_repairs():
    rng = random.Random(3)
    for n in (0, 1, 2, 3):
        for _ in range(25):
            initials = [rng.choice(["s", "u", "a", "t", "", "I"]) for _ in range(n)]
            faults = [rng.choice([0, 0, 1, 2]) for _ in range(n)]
            # an empty initial stands for no role at all; any unknown letter does the same
            assert cr.cheapest_edits(initials, faults) == all_repairs([c if c in "sua" and c else "?" for c in initials], faults)


def dynamic(initials, faults):
    """Least (cost, audit) per position, row by row."""
    def spread(table):
        for _ in range(4):
            for place, (cost, audit) in list(table.items()):
                to = cr.NEXT[place]
                table[to] = min(table.get(to, (cr.FAR, "")), (cost + 2, audit + "I"))
        return table

    table = spread({cr.NONE: (0, "")})
    for initial, fault in zip(initials, faults):
        new = {}
        for place, (cost, audit) in table.items():
            for letter, taken, to, more in cr.moves(initial, fault, place):
                if taken:
                    new[to] = min(new.get(to, (cr.FAR, "")), (cost + more, audit + letter))
        table = spread(new)
    return min(table[p] for p in (cr.NONE, cr.PAIR) if p in table)


def test_long_conversations():
    rng = random.Random(4)
    for n in (40, 3000):
        initials = [rng.choice("suaaux") for _ in range(n)]
        faults = [rng.choice([0, 0, 0, 1, 2]) for _ in range(n)]
        assert cr.cheapest_edits(initials, faults) == dynamic(initials, faults)
    assert cr.cheapest_edits(["s"] * 2000, [0] * 2000)[0] == dynamic(["s"] * 2000, [0] * 2000)[0]


def test_bounds_are_never_too_high():
    rng = random.Random(5)
    for _ in range(100):
        n = rng.randint(0, 8)
        initials, faults = [rng.choice("sua?") for _ in range(n)], [rng.choice([0, 1, 2]) for _ in range(n)]
        true = cr.cheapest_edits(initials, faults)[0]
        bound = cr.suffix_bounds(initials, faults)[0, cr.NONE]
        assert true - 4 <= bound <= true


@pytest.fixture
def talk(spark):
    def make(rows):
        return spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn int, role string, text string, cost string")
    return make


def plain(rows):
    """Stats and repaired lines of one conversation's rows, in order."""
    seen, faults, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        kind = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        count[kind] = count.get(kind, 0) + 1
        faults.append({"blank": 2, "duplicate": 2, "truncated": 1, None: 0}[kind])
    initials = [r[:1] for _, r, _ in rows]
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit = dynamic([c or "?" for c in initials], faults)
    lines, at, place = [], 0, cr.NONE
    for letter in audit:
        role, text = ("", "") if letter == "I" else rows[at][1:]
        at += letter != "I"
        if letter == "D":
            continue
        if letter in "IR":
            role = "assistant" if place == cr.USER else "user"
        place = cr.KEPT[role[:1]][place] if letter == "K" else cr.NEXT[place]
        lines.append(f"{role}:{text}")
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": count["blank"], "duplicate": count["duplicate"],
        "truncated": count["truncated"], "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}, lines


ODD = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Hello!"),
    (2, 5, "assistant", "cut off"), (2, 3, None, "x."), (2, None, "user", None), (2, 9, "tool", "ok?"),
    (3, 1, "user", "Same."), (3, 1, "user", "Same."), (3, 2, "assistant", "Fine. \x0b\t"), (3, 2, "assistant", "Über 🙂"),
    (None, None, "user", "a."), (None, None, "assistant", ""), (4, None, None, None), (5, 7, "", "w " * 100_000 + "."),
    *[(6, t // 2, "user" if t % 3 else "assistant", f"t{t}.") for t in range(50)],
]


def test_odd_conversations_equal_the_plain_repair(spark, talk):
    signed, found = cr.repair(talk(ODD).repartition(4))
    got = {r["conv"]: r.asDict() for r in cr.repair_digests(signed, found).collect()}
    text = {}
    for r in cr.repaired_rows(signed, found).orderBy("conv", "at").collect():
        text.setdefault(r["conv"], []).append(f"{r['role']}:{r['text']}")
    keys = {r[0] for r in ODD}
    assert set(got) == keys
    for conv in keys:
        rows = [(t, role if role is not None else " ", body if body is not None else " ") for c, t, role, body in ODD if c == conv]

        def order(row):
            said = f"{len(row[1].encode())}:{row[1]}{row[2]}".encode()
            return row[0] is not None, row[0] or 0, row[1], hashlib.sha256(said).digest()

        want, lines = plain(sorted(rows, key=order))
        got[conv].pop("conv")
        assert got[conv] == want and text.get(conv, []) == lines


def test_dropped_and_no_conversations(spark, talk):
    rows = talk([(1, 0, "user", "a."), (2, 0, "user", "b."), (2, 1, "assistant", "c.")])
    signed, found = cr.repair(rows, alive=F.col("conv_id") == 2)
    got = {r["conv"]: (r["cost"], r["audit"], r["gaps"], r["repaired_sha256"]) for r in cr.repair_digests(signed, found).collect()}
    assert got[1] == (0, "", 0, hashlib.sha256(b"").hexdigest()) and got[2][:3] == (0, "KK", 0)
    signed, found = cr.repair(rows.limit(0))
    assert cr.repair_digests(signed, found).count() == cr.repaired_rows(signed, found).count() == 0
    assert cr.damage(rows.limit(0)).count() == 0
