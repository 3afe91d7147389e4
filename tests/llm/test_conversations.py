import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tideledger.llm import conversations

VISIBLE = re.compile(r"[^\x20\x09-\x0D]")
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        case = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        out += [(conv, turn, "user" if case == 4 else role, text)] * (0 if case == 0 else 2 if case == 3 else 1)
    return out


def plain_repair(rows):
    """Least (cost, audit) by a search over (row, state), the repaired turns from its letters."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).digest()))
    faults, seen, tasks = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), []
    for _, _, role, text in rows:
        shown = VISIBLE.findall(text)
        fault = ("blank" if not shown else "duplicate" if (role, text) in seen else
                 "truncated" if shown[-1] not in ".!?" else None)
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        tasks.append((role[:1], fault in ("blank", "duplicate"), int(fault == "truncated")))
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(tasks, tasks[1:]))
    heap, done = [(0, "", 0, "")], set()
    while True:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            break
        fill = "a" if state == "u" else "u"
        heapq.heappush(heap, (cost + 2, audit + "I", i, fill))
        if i < len(rows):
            first, must_go, cut = tasks[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state))
            if not must_go:
                heapq.heappush(heap, (cost + 2 + cut, audit + "R", i + 1, fill))
                if (state, first) in NEXT:
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, first))
    turns, i, state = [], 0, ""
    for letter in audit:
        fill = "a" if state == "u" else "u"
        if letter in "IR":
            turns.append(("user" if fill == "u" else "assistant", "" if letter == "I" else rows[i][3]))
            state = fill
        elif letter == "K":
            turns.append(rows[i][2:])
            state = rows[i][2][0]
        i += letter != "I"
    known = [r[1] for r in rows if r[1] is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    whole = "\n".join(f"{r}:{t}" for r, t in turns)
    return (gaps, *faults.values(), illegal, cost, audit, hashlib.sha256(whole.encode()).hexdigest()), turns


def by_conv(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns(
        {c: F.lit("own") for c in ("part", "seq", "block", "hash", "code", "kind", "late")})


def made_up(seed, sizes):
    rng, rows = random.Random(seed), []
    for conv, size in enumerate(sizes):
        for j in range(size):
            turn = rng.choice([None, j, j, j, j, j + 1])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool", "uber"])
            rows.append((conv if conv else None, turn, role, rng.choice(["Ja.", "No", "", " \t", "é!", f"t{j}.", f"t{j}", None, "x" * 90 + "?"])))
    return rows + rows[:7]


def check(spark, rows):
    damaged = plain_damage(rows)
    want = {c: plain_repair(by_conv(damaged).get(c, [])) for c in by_conv(rows)}
    data = frame(spark, rows)
    found = conversations.damage(data)
    got = {r[0]: tuple(r)[1:] for r in conversations.audits(found, data).collect()}
    assert got == {c: w[0] for c, w in want.items()}
    turns = by_conv(sorted((tuple(r) for r in conversations.repaired_turns(found).collect()), key=lambda r: r[1]))
    assert {c: [t[2:] for t in found] for c, found in turns.items()} == {c: w[1] for c, w in want.items() if w[1]}


def test_repairs_equal_a_search(spark):
    check(spark, made_up(1, [random.Random(5).randint(1, 12) for _ in range(60)]))


@pytest.mark.parametrize("size", [2, 7])
def test_long_conversations_are_put_together_from_segments(spark, monkeypatch, size):
    monkeypatch.setattr(conversations, "SEGMENT", size)
    check(spark, made_up(2, [40, 150, 3, 1, 90]))


def test_a_row_repeated_very_often_and_an_empty_table(spark):
    rows = [(1, 0, "user", "Hi.")] * 500 + [(1, 1, "assistant", "Yes.")]
    check(spark, rows)
    empty = frame(spark, rows[:1]).limit(0)
    assert conversations.audits(empty).count() == 0 and conversations.repaired_turns(empty).count() == 0


def test_good_conversations_are_kept_as_they_are(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Hi.")]
    got = conversations.audits(frame(spark, rows)).first()
    assert (got.cost, got.audit, got.illegal, got.gaps) == (0, "KKK", 0, 0)
