"""Conversation repair, against an exhaustive search over a plain graph."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest

from thermoband.llm import catalogue, conversations

SPACE = " \t\n\x0b\x0c\r"


def faults(rows):
    """The first fault of each row (role, text), or ''."""
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(SPACE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def least(rows):
    """Cost, audit and turns of the cheapest repair, the least audit of those: Dijkstra by (cost, audit)."""
    bad = faults(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, turns = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, list(turns)
        if (i, roles) in done or not re.fullmatch("s?(ua)*u?", roles):
            continue
        done.add((i, roles))
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 2, audit + "I", i, roles + role[0], (*turns, (role, ""))))
        if i < len(rows):
            role, text = rows[i]
            more = bad[i] == "truncated"
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, roles, turns))
            if bad[i] not in ("blank", "duplicate"):
                if role:  # an empty role fits nowhere
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, roles + role[:1], (*turns, (role, text))))
                for other in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, roles + other[0], (*turns, (other, text))))


def code(role, fault):
    if fault in ("blank", "duplicate"):
        return conversations.GONE
    letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return letter.upper() if fault else letter


@pytest.mark.parametrize("run", [1, 2, 3, 64])
def test_search_against_dijkstra(run):
    """Every cut into runs gives the cheapest edits and of those the least string."""
    rng = random.Random(run)
    for n in [*range(6)] * 40:
        rows = [(rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["A b.", "C!", "", "d", "e?", f"{k}."])) for k in range(n)]
        cost, audit, _ = least(rows)
        codes = "".join(code(r, f) for (r, _), f in zip(rows, faults(rows), strict=True))
        assert conversations.cheapest_edits(codes, run) == (cost, audit), (codes, run)


def test_runs_agree_on_long_conversations():
    rng = random.Random(5)
    for _ in range(20):
        codes = "".join(rng.choice("uuuuaaaasU-x") for _ in range(60))
        assert len({conversations.cheapest_edits(codes, run) for run in (2, 7, 20, 64)}) == 1


def test_very_long_conversation():
    """The work grows with the rows: 40,000 of them, many out of order."""
    codes = "".join(random.Random(2).choice("uaUAs-x") for _ in range(40_000))
    cost, audit = conversations.cheapest_edits(codes)
    assert sum(c != "I" for c in audit) == len(codes)
    place, spent, rows = conversations.START, 0, iter(codes)
    for edit in audit:
        c = next(rows) if edit != "I" else ""
        spent += {"D": 3, "I": 2, "R": 2, "K": 0}[edit] + (edit in "KR" and c.isupper())
        assert edit == "D" or c != conversations.GONE
        if edit in "IR":
            place = conversations.GIVEN[place][0]
        elif edit == "K":
            place = conversations.NEXT[place][c.lower()]
    assert (spent, place) == (cost, conversations.ASSISTANT)


def plain(rows):
    """The report of rows (turn, role, text) in order."""
    told = [t for t, _, _ in rows if t is not None]
    pairs = [(r, x) for _, r, x in rows]
    found = faults(pairs)
    initials = [r[:1] for r, _ in pairs]
    cost, audit, turns = least(pairs)
    return (
        max(told) - min(told) + 1 - len(set(told)) if told else 0,
        *(found.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        cost,
        audit,
        hashlib.sha256("\n".join(f"{r}:{x}" for r, x in turns).encode()).hexdigest(),
    ), turns


def in_order(rows):
    digest = lambda r, x: hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).digest()
    return sorted(rows, key=lambda t: (t[0] is not None, t[0] or 0, t[1][:1].encode(), digest(t[1], t[2])))


def groups(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    return {c: in_order(r) for c, r in out.items()}


ODD = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hello."), (1, 2, "assistant", "Yes"), (1, 5, "user", "Bye.\n"),
    (2, None, "user", "First?"), (2, 0, "user", None), (2, 0, None, "x."), (2, 0, "user", "First?"), (2, 3, "tool", "t!"),
    (None, 0, "assistant", "Who?"), (None, None, None, None), (None, 1, "", ""),
    (3, None, "user", "\x0b\x0c"), (3, None, "assistant", " \n"),
    (4, -5, "user", "é" * 40_000 + "."), (4, 9, "assistant", "🙂 a! \r\n"), (4, 9, "assistant", "🙂 a! \r\n"), (4, 9, "assistant", "🙂 a!"),
    (5, 0, "usher", "v."), (5, 1, "Assistant", "w."), (5, 2, "assistant", "\xa0"), (5, 3, "system", "s."),
]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    return df.selectExpr("*", "'clash' AS digest", "1 AS kind", "'c' AS initial", "2 AS place", "'x' AS audit").repartition(4)


def test_operator_on_odd_rows(spark):
    rows = [*ODD, *ODD[:4], *[(6, t, "user" if t % 2 else "assistant", f"t{t}") for t in range(9)]]
    got = {r.conv_id: tuple(r)[1:] for r in conversations.report(frame(spark, rows), 2).collect()}
    turns = {}
    for r in sorted(conversations.repaired(frame(spark, rows), 2).collect(), key=lambda r: r.place):
        turns.setdefault(r.conv_id, []).append((r.place, r.role, r.text))
    want = {c: plain(r) for c, r in groups(rows).items()}
    assert got == {c: w[0] for c, w in want.items()}
    assert turns == {c: [(i, *t) for i, t in enumerate(w[1])] for c, w in want.items() if w[1]}


def test_empty_table(spark):
    none = frame(spark, ODD).limit(0)
    assert conversations.report(none).count() == conversations.repaired(none).count() == 0


def harmed(rows):
    text_of = lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        kind, role, text = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20, text_of(role), text_of(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        yield from [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)


def plain_query(rows):
    after = groups(harmed(rows))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    return {c: plain(after[c])[0] if c in after else empty for c in {r[0] for r in rows}}


def test_query_against_plain(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = [tuple(r) for r in catalogue.op13_conversation_repair(spark, sf_dir).collect()]
    assert {r[0]: r[1:] for r in got} == plain_query(rows)
    assert len(got) == len({r[0] for r in rows})


def test_query_on_odd_rows(spark, tmp_path):
    lone = [(c, t, "user", "Gone.") for c in range(100, 160) for t in (0,)]
    frame(spark, ODD + lone).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r[0]: tuple(r)[1:] for r in catalogue.op13_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == plain_query(ODD + lone)
    assert any(v[-2] == "" for c, v in got.items() if c and c >= 100)
