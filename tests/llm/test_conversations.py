"""Conversation repair against exhaustive search, a plain reading of the contract, and itself in small chunks."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from strandmill.llm import conversations as C

SF = "/root/testdata/sf0.001"


def exhaustive(symbols: str) -> tuple[int, str]:
    """All audits up to the cost of deleting every row; roles are matched as text at the end."""
    best = (4 * len(symbols), "D" * len(symbols))

    def go(i, cost, audit, roles, inserts):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(symbols) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best, (cost, audit))
        if inserts < 3:
            for r in "ua":
                go(i, cost + 3, audit + "I", roles + r, inserts + 1)
        if i < len(symbols):
            x, extra = symbols[i], 3 if symbols[i].isupper() else 0
            go(i + 1, cost + 4, audit + "D", roles, 0)
            if x != "-":
                go(i + 1, cost + extra, audit + "K", roles + x.lower(), 0)
                for r in "ua":
                    go(i + 1, cost + 3 + extra, audit + "R", roles + r, 0)

    go(0, 0, "", "", 0)
    return best


def joined(symbols: str, cut: int) -> tuple[int, str]:
    parts = [symbols[a : a + cut] for a in range(0, len(symbols), cut)]
    cost, found = C.join_chunks([{t: C.parse(p, t) for t in (C._TOPS if k else "$")} for k, p in enumerate(parts)])
    return cost, "".join(a for _, a in found)


def test_parse_is_the_least_of_all_audits():
    for n in range(4):
        for symbols in map("".join, itertools.product("suaxU-", repeat=n)):
            assert joined(symbols, 99) == exhaustive(symbols), symbols
    rng = random.Random(3)
    for _ in range(40):
        symbols = "".join(rng.choice("suaxSUAX-") for _ in range(5))
        assert joined(symbols, 99) == exhaustive(symbols), symbols


def test_chunks_give_what_the_whole_gives():
    rng = random.Random(4)
    for _ in range(300):
        symbols = "".join(rng.choice("ssuuuaaaxUA-") for _ in range(rng.randint(0, 40)))
        assert len({joined(symbols, cut) for cut in (1, 2, 7, 99)}) == 1, symbols


def plain(rows: list[tuple]) -> dict:
    """The contract, row by row, with a search in order of (cost, audit)."""
    said = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    said.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:32], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
    faults, seen = [], set()
    for _, role, text in said:
        solid = re.sub(r"[ \t-\r]", "", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(said, said[1:])]
    turns = [t for t, _, _ in said if t is not None]
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        last = roles[-1:]
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(said) and last in ("", "a"):
            break
        after = lambda r: r == {"": "u", "s": "u", "u": "a", "a": "u"}[last] or (r == "s" and last == "")  # noqa: B023, E731
        for r in "ua":
            if after(r):
                heapq.heappush(heap, (cost + 3, audit + "I", i, roles + r))
        if i < len(said):
            role, extra = said[i][1][:1], 3 * (faults[i] == "truncated")
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, roles))
            if faults[i] not in ("blank", "duplicate"):
                if after(role):
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, roles + role))
                for r in "ua":
                    if after(r):
                        heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, roles + r))
    lines, k, at = [], 0, iter(said)
    for edit in audit:
        row = None if edit == "I" else next(at)
        if edit != "D":
            full = row[1] if edit == "K" else {"u": "user", "a": "assistant"}[roles[k]]
            lines.append(f"{full}:{row[2] if row else ''}")
            k += 1
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")}, "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


def damaged(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def by_conversation(rows: list[tuple]) -> dict:
    out: dict = {}
    for conv, *rest in rows:
        out.setdefault(conv, []).append(tuple(rest))
    return out


def as_dict(df) -> dict:
    return {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in df.collect()}


def test_query_equals_the_contract(spark):
    given = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    kept, zero = by_conversation(damaged(given)), plain([])
    want = {c: plain(kept[c]) if c in kept else zero for c in {r[0] for r in given}}
    assert as_dict(C.query(spark, SF)) == want


#: Null ids, turns, roles and texts, ties, repeated rows, other roles, gaps, white space, a very long text.
ODD = [
    (1, 0, "system", "Be brief."), (1, 1, "user", "Hello there."), (1, 2, "assistant", "Hi!"), (1, 5, "assistant", "More\n"), (1, 6, "user", " \t"),
    (2, None, None, None), (2, None, "user", "A question?"), (2, 3, "user", "A question?"), (2, 3, "user", "A question?"), (2, 4, "tool", "x = 1."), (2, 4, "", "empty role."),
    (None, 0, "assistant", "No one asked."), (None, None, "user", "Why."), (3, 7, "system", "Only this."), (4, 1, "user", "word and " * 50_000 + "end."), (4, 2, "assistant", "ok."), (5, 0, "user", None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "x", "y") for r in ODD], "conv_id long, turn long, role string, text string, digest string, place string")


@pytest.mark.parametrize("limits", [{}, {"chunk": 1}, {"chunk": 2}, {"most_bytes": 20}])
def test_odd_rows_whole_and_in_chunks(odd, limits):
    want = {c: plain(rows) for c, rows in by_conversation([r for r in ODD]).items()}
    repair = C.Repair(odd, **limits)
    assert as_dict(repair.reports()) == want
    edits = repair.edits().orderBy("conv_id", "place").collect()
    for conv in want:
        mine = [r for r in edits if r["conv_id"] == conv]
        assert "".join(r["edit"] for r in mine) == want[conv]["audit"] and [r["place"] for r in mine] == list(range(len(mine)))
        text = "\n".join(f"{r['role']}:{r['text']}" for r in mine if r["edit"] != "D")
        assert hashlib.sha256(text.encode()).hexdigest() == want[conv]["repaired_sha256"]


def test_real_conversations_in_chunks(spark):
    rows = C.damage(spark.read.parquet(f"{SF}/conversations.parquet"))
    assert as_dict(C.Repair(rows, chunk=3).reports()) == as_dict(C.Repair(rows).reports())


def test_empty_table_and_conversations_without_rows(spark, odd, tmp_path):
    assert C.Repair(odd.limit(0)).reports().count() == 0 and C.Repair(odd.limit(0)).edits().count() == 0
    gone = next(k for k in range(99) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    odd.select(F.lit(gone).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), "role", "text").limit(2).write.parquet(f"{tmp_path}/conversations.parquet")
    assert as_dict(C.query(spark, str(tmp_path))) == {gone: plain([])}
