"""Conversation repair against a plain search over every edit of every turn."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from canvass.llm import turn_repair

SCHEMA = "conv_id long, turn long, role string, text string, part int, pos string"
AFTER = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def damaged(rows):
    convs = {}
    for conv, turn, role, text, *_ in rows:
        kept = convs.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return convs


def searched(turns):
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
    at = [t[0] for t in turns if t[0] is not None]
    seen, faults = set(), []
    for _, role, text in turns:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def cheapest(i, last, inserted):
        ways = [(0, "", ())] if i == len(turns) and last in ("", "a") else []
        puts = [(c, name) for c, name in (("u", "user"), ("a", "assistant")) if c in AFTER[last]]
        for c, name in puts if inserted < 2 else ():
            cost, audit, out = cheapest(i, AFTER[last][c], inserted + 1)
            ways.append((cost + 2, "I" + audit, (f"{name}:", *out)))
        if i < len(turns):
            cost, audit, out = cheapest(i + 1, last, 0)
            ways.append((cost + 3, "D" + audit, out))
            _, role, text = turns[i]
            if faults[i] not in ("blank", "duplicate"):
                extra = faults[i] == "truncated"
                keep = [(role[:1], role, "K", 0)] if role[:1] in AFTER[last] else []
                for c, name, edit, price in keep + [(c, name, "R", 2) for c, name in puts]:
                    cost, audit, out = cheapest(i + 1, AFTER[last][c], 0)
                    ways.append((cost + extra + price, edit + audit, (f"{name}:{text}", *out)))
        return min(ways) if ways else (1 << 40, "~", ())

    for i in range(len(turns), -1, -1):  # from the end, so that the recursion stays flat
        for last in AFTER:
            cheapest(i, last, 0)
    cost, audit, out = cheapest(0, "", 0)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    gaps = max(at) - min(at) + 1 - len(set(at)) if at else 0
    return gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def odd_turns():
    rng = random.Random(3)
    texts = ["hi.", "ok", "what?", "", " \n", "done!", "x. ", None, "é", "a b.", "long " * 5000]
    roles = ["user", "assistant", "system", None, "", "tool", "Unk", "ux"]
    rows = []
    for conv in [None, *range(80)]:
        for i in range(rng.randint(0, 9)):
            rows.append((conv, rng.choice([i, i, i, None, rng.randint(-3, 12)]), rng.choices(roles, [6, 6, 2, 1, 1, 1, 1, 1])[0], rng.choice(texts)))
    rows += [(777, i, rng.choice(roles[:2]), f"t{i % 150}" + rng.choice([".", ""])) for i in range(350)]  # one long conversation
    rows += [(778, 0, "user", "same.")] * 90 + [(779, i, "user", f"t{i}.") for i in range(90)]  # one turn, one role, many times
    rows += [(900, -(1 << 63), "user", "a."), (900, (1 << 63) - 1, "assistant", "b.")]
    return [(*r, 1, "z") for r in rows + rows[::7]]


def test_report_equals_search(spark, monkeypatch):
    monkeypatch.setattr(turn_repair, "shuffle_parts", lambda _: 13)  # long conversations span many parts
    rows = odd_turns()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in turn_repair.repair_report(docs).collect()}
    want = {conv: searched(turns) for conv, turns in damaged(rows).items()}
    wide = want.pop(900)
    assert got.pop(900)[1:] == wide[1:]  # the turn range of this one does not fit a long
    assert got == want


def test_nothing_left(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    docs = spark.createDataFrame([(dropped, 0, "user", "hi.", 1, "")], SCHEMA)
    assert [tuple(r) for r in turn_repair.repair_report(docs).collect()] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert turn_repair.repair_report(docs.limit(0)).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1001])
def test_powers_equal_steps(n):
    for symbol in range(9):
        one, many, after = turn_repair.power(symbol, 0), turn_repair.run_matrix(symbol, n), turn_repair.END
        slow = [after]
        for _ in range(n):
            slow.append(turn_repair.apply(one, slow[-1]))
        assert turn_repair.apply(many, after) == slow[-1] == turn_repair.before_run(symbol, n, after)
        assert list(turn_repair.inside_run(symbol, n, after)) == slow[-2::-1]
