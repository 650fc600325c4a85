"""Repair of conversations' structure: generalised LR parsing of role sequences with weighted edits.

Roles must read ``(s?(ua)+)?``: C -> empty | P | s P, P -> u a | P u a, by the initials of system, user and assistant.
The parser follows all cheapest stacks at once. A pair is reduced as soon as its ``a`` is shifted, and P follows whatever
is below, so a stack's top decides what can come next: the graph of stacks has four tops at most after each row ($ for
the empty stack, s, u, P), and stacks of equal top are merged by the least (cost, audit). Two audits of one cost
that end in one top after the same rows are never each other's prefix, as an audit fixes its path and every insert
costs; so the least stays the least whatever follows, and rows can be parsed in chunks from every top and joined.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, runs, save, table

RENAME, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
_TOPS = "$suP"
_SHIFT = {("$", "s"): "s", ("$", "u"): "u", ("s", "u"): "u", ("u", "a"): "P", ("P", "u"): "u"}
#: What is left to insert at the end for each top.
_CLOSE = {"$": "", "P": "", "u": "I", "s": "II"}
_FULL = {"u": "user", "a": "assistant"}

Best = dict[str, tuple[int, str]]


def _put(tops: Best, top: str | None, cost: int, audit: str) -> bool:
    if top is None or (top in tops and tops[top] <= (cost, audit)):
        return False
    tops[top] = (cost, audit)
    return True


def _with_inserts(tops: Best) -> Best:
    """Adds the tops that inserted turns lead to."""
    out, open_ = dict(tops), list(tops)
    while open_:
        top = open_.pop()
        cost, audit = out[top]
        for role in "ua":
            if _put(out, to := _SHIFT.get((top, role)), cost + INSERT, audit + "I"):
                open_.append(to)
    return out


@lru_cache(1 << 12)
def parse(symbols: str, top: str = "$") -> Best:
    """The cheapest (cost, audit) to each top that can follow ``top`` after all symbols, one a row: s, u, a or x (another
    role) for a row to keep, the capital for one whose text is cut off, ``-`` for one to delete.
    """
    tops: Best = {top: (0, "")}
    for symbol in symbols:
        before, tops = _with_inserts(tops), {}
        extra = CUT_OFF if symbol.isupper() else 0
        for at, (cost, audit) in before.items():
            _put(tops, at, cost + DELETE, audit + "D")
            if symbol != "-":
                _put(tops, _SHIFT.get((at, symbol.lower())), cost + extra, audit + "K")
                for role in "ua":
                    _put(tops, _SHIFT.get((at, role)), cost + RENAME + extra, audit + "R")
    return tops


Rope = tuple[str, "Rope | None"]


def _less(a: Rope, b: Rope) -> bool:
    """Whether the text of a is less than that of b; ends at the first difference, or where both go on as one."""
    (x, a), (y, b) = a, b
    while True:
        n = min(len(x), len(y))
        if x[:n] != y[:n]:
            return x[:n] < y[:n]
        x, y = x[n:], y[n:]
        while not x and a is not None:
            x, a = a
        while not y and b is not None:
            y, b = b
        if not x or not y or (a is b and x == y):
            return bool(y) and not x


def join_chunks(chunks: list[dict[str, Best]]) -> tuple[int, list[tuple[str, str]]]:
    """Total cost, and for each chunk the top it begins with and its audit; chunks have parse() of each possible top.

    From the last to the first, so that equal costs are decided by all that follows.
    """
    after: dict[str, tuple[int, Rope]] = {t: (INSERT * len(x), (x, None)) for t, x in _CLOSE.items()}
    choices = []
    for chunk in reversed(chunks):
        now, choice = {}, {}
        for top, ends in chunk.items():
            for to, (cost, audit) in ends.items():
                new = (cost + after[to][0], (audit, after[to][1]))
                if top not in now or new[0] < now[top][0] or (new[0] == now[top][0] and _less(new[1], now[top][1])):
                    now[top], choice[top] = new, (to, audit)
        after = now
        choices.append(choice)
    total, top, out = after["$"][0], "$", []
    for choice in reversed(choices):
        to, audit = choice[top]
        out.append((top, audit))
        top = to
    if out:
        out[-1] = (out[-1][0], out[-1][1] + _CLOSE[top])
    return total, out


def edits_of(audit: str, top: str, rows: list[dict]) -> Iterator[tuple[str, dict | None, str | None]]:
    """(edit, row or None, role) for each edit; the role that a turn has after it, None when deleted."""
    at = iter(rows)
    for edit in audit:
        row = None if edit == "I" else next(at)
        role = row["role"] if edit == "K" else None
        if edit in "RI":
            role = _FULL["a" if top == "u" else "u"]
        if edit != "D":
            top = _SHIFT[top, role[:1]]
        yield edit, row, role


def _symbol(initial: str, fault: str) -> str:
    kind = initial if initial in ("s", "u", "a") else "x"
    return "-" if fault in ("blank", "duplicate") else kind.upper() if fault == "truncated" else kind


class _Chunk:
    """Counts and symbols of successive rows of one conversation."""

    def __init__(self, rows: list[dict], faults: list[str]):
        turns = [r["turn"] for r in rows if r["turn"] is not None]
        initials = [r["role"][:1] for r in rows]
        self.symbols = "".join(map(_symbol, initials, faults))
        self.counts = {f: faults.count(f) for f in ("blank", "duplicate", "truncated")}
        self.counts["illegal"] = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        self.ends, self.turns, self.distinct = (initials[0], initials[-1]), ((turns[0], turns[-1]) if turns else None), len(set(turns))


def _merged(chunks: list[_Chunk]) -> dict:
    """The counts of a conversation of successive chunks."""
    out = {k: sum(c.counts[k] for c in chunks) for k in chunks[0].counts}
    out["illegal"] += sum(a.ends[1] + b.ends[0] not in ("su", "ua", "au") for a, b in zip(chunks, chunks[1:]))
    timed = [c for c in chunks if c.turns]
    distinct = sum(c.distinct for c in timed) - sum(a.turns[1] == b.turns[0] for a, b in zip(timed, timed[1:]))
    out["gaps"] = timed[-1].turns[1] - timed[0].turns[0] + 1 - distinct if timed else 0
    return out


_WORDY, _ENDED = re.compile(r"[^ \t-\r]"), re.compile(r"[.!?][ \t-\r]*\Z")
ROW = "conv_id long, turn long, role string, text string, head string, digest string"
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
EDIT = "conv_id long, place long, edit string, turn long, role string, text string, fault string"
_EDITS = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.string())])
_REPORTS = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in REPORT.split(", ")])


def _fault(row: dict, repeats: bool) -> str:
    if not _WORDY.search(row["text"]):
        return "blank"
    if repeats:
        return "duplicate"
    return "" if _ENDED.search(row["text"]) else "truncated"


def _whole(t: pa.Table, chunk: int) -> tuple[dict, list[tuple[str, dict | None, str | None, str]]]:
    """A conversation's report without its hash, and its edits."""
    rows, seen, faults = t.to_pylist(), set(), []
    for r in rows:
        faults.append(_fault(r, r["digest"] in seen))
        seen.add(r["digest"])
    chunks = [_Chunk(rows[a : a + chunk], faults[a : a + chunk]) for a in range(0, len(rows), chunk)]
    cost, parts = join_chunks([{top: parse(c.symbols, top) for top in (_TOPS if k else "$")} for k, c in enumerate(chunks)])
    for r, f in zip(rows, faults):
        r["fault"] = f
    found = list(edits_of("".join(a for _, a in parts), "$", rows))
    return {"conv_id": rows[0]["conv_id"], **_merged(chunks), "cost": cost, "audit": "".join(a for _, a in parts)}, found


def _line(role: str, row: dict | None) -> str:
    return f"{role}:{row['text'] if row else ''}"


def _edit_rows(conv: int | None, edits, start: int = 0) -> Iterator[pa.RecordBatch]:
    out = []
    for place, (edit, row, role) in enumerate(edits, start):
        out.append({"conv_id": conv, "place": place, "edit": edit, "turn": row and row["turn"], "role": role or row["role"], "text": row["text"] if row else "", "fault": row["fault"] if row else ""})
        if len(out) == 1000:
            yield pa.RecordBatch.from_pylist(out, schema=_EDITS)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_EDITS)


class Repair:
    """The repair of a table (conv_id, turn, role, text); null roles and texts are one space.

    ``edits``: a row for each edit (conv_id, place, edit, turn, role, text, fault): K keeps, R gives the role user or
    assistant, D deletes, I inserts an empty turn. role is that after the edit, or the deleted row's; what is left
    without D, by place, is the repaired conversation. ``reports``: a row for each conversation that has rows.

    Rows are in order of turn, nulls first, then role, then the text's first 32 characters and its digest. A row's
    first fault counts: blank (nothing but white space), duplicate (role and text as in an earlier row), truncated (the
    last character but white space isn't a full stop, ! or ?). A null conv_id is a conversation. Rows that repeat are
    duplicates; an empty table gives no rows; other columns are not read; texts are read whole.

    A conversation of up to ``chunk`` rows and ``most_bytes`` of text is one run of a sorted stream. Larger ones are
    spread: rows are numbered by ranges, first occurrences found by digest, chunks parsed apart from each top, joined
    by their costs, and edits made chunk by chunk. Only their hash, which is sequential, reads them in one stream.
    """

    def __init__(self, conversations: DataFrame, *, chunk: int = 4096, most_bytes: int = 1 << 25):
        self.chunk = chunk
        d = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
        digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
        self.rows = d.withColumns({"head": F.substring("text", 1, 32), "digest": digest})
        sizes = d.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text") + F.octet_length("role")).alias("bytes"))
        large = save(sizes.where((F.col("n") > chunk) | (F.col("bytes") > most_bytes)).select(F.col("conv_id").alias("large_id")), "large")
        self.n_large = large.count()
        #: At most one for each ``chunk`` rows or ``most_bytes``; sent to all tasks only where they are few.
        self.large = F.broadcast(large) if self.n_large <= 500_000 else large
        self._plan = None

    def _small(self) -> DataFrame:
        d = self.rows
        if self.n_large:
            d = d.join(self.large, d["conv_id"].eqNullSafe(F.col("large_id")), "left_anti")
        return d.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "head", "digest")

    def reports(self) -> DataFrame:
        chunk = self.chunk

        def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in runs(batches, 1):
                found, edits = _whole(t, chunk)
                text = "\n".join(_line(role, row) for edit, row, role in edits if edit != "D")
                yield pa.RecordBatch.from_pylist([found | {"repaired_sha256": hashlib.sha256(text.encode()).hexdigest()}], schema=_REPORTS)

        out = self._small().mapInArrow(report, REPORT)
        return out.unionByName(self._large_reports()) if self.n_large else out

    def edits(self) -> DataFrame:
        chunk = self.chunk

        def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in runs(batches, 1):
                found, edits = _whole(t, chunk)
                yield from _edit_rows(found["conv_id"], edits)

        out = self._small().mapInArrow(edit, EDIT)
        return out.unionByName(self._large_edits()) if self.n_large else out

    def _planned(self) -> tuple[DataFrame, DataFrame]:
        """Rows of large conversations with their place and fault, and the plan of each chunk, with the report in chunk 0."""
        if self._plan is not None:
            return self._plan
        chunk = self.chunk
        rows = self.rows.join(self.large, F.col("conv_id").eqNullSafe(F.col("large_id")), "left_semi")
        rows = numbered(rows, ["conv_id"], ["turn", "role", "head", "digest"])
        firsts = rows.groupBy(F.col("conv_id").alias("c"), "digest").agg(F.min("place").alias("p")).select("c", "p")
        rows = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("place") == F.col("p")), "left")
        rows = save(rows.select("conv_id", F.expr(f"place div {chunk}").alias("part"), "place", "turn", "role", "text", F.col("p").isNull().alias("repeats")), "placed")

        def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in runs(batches, 2):
                r = t.to_pylist()
                c = _Chunk(r, [_fault(x, x["repeats"]) for x in r])
                ends = [{"top": top, "to": to, "cost": cost, "audit": audit} for top in (_TOPS if r[0]["part"] else "$") for to, (cost, audit) in parse(c.symbols, top).items()]
                yield pa.RecordBatch.from_pylist([{"conv_id": r[0]["conv_id"], "part": r[0]["part"], **c.counts, "ends": list(c.ends), "turns": list(c.turns) if c.turns else None, "distinct": c.distinct, "paths": ends}], schema=schema)

        path = pa.struct([("top", pa.string()), ("to", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])
        schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), *((k, pa.int64()) for k in ("blank", "duplicate", "truncated", "illegal")), ("ends", pa.list_(pa.string())), ("turns", pa.list_(pa.int64())), ("distinct", pa.int64()), ("paths", pa.list_(path))])
        parsed = rows.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "place").mapInArrow(parts, "conv_id long, part long, blank long, duplicate long, truncated long, illegal long, ends array<string>, turns array<long>, distinct long, paths array<struct<top:string,to:string,cost:long,audit:string>>")

        def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in runs(batches, 1):
                chunks, paths = [], []
                for r in t.to_pylist():
                    c = _Chunk.__new__(_Chunk)
                    c.counts, c.ends, c.turns, c.distinct = {k: r[k] for k in ("blank", "duplicate", "truncated", "illegal")}, r["ends"], r["turns"], r["distinct"]
                    chunks.append(c)
                    ways: dict[str, Best] = {}
                    for p in r["paths"]:
                        ways.setdefault(p["top"], {})[p["to"]] = (p["cost"], p["audit"])
                    paths.append(ways)
                cost, found = join_chunks(paths)
                whole, start, conv = _merged(chunks), 0, t["conv_id"][0].as_py()
                for k, (top, audit) in enumerate(found):
                    yield pa.RecordBatch.from_pylist([{"conv_id": conv, "part": k, "top": top, "audit": audit, "start": start, "cost": cost, **whole}], schema=planned)
                    start += len(audit)

        planned = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("top", pa.string()), ("audit", pa.string()), ("start", pa.int64()), *((k, pa.int64()) for k in ("cost", "gaps", "blank", "duplicate", "truncated", "illegal"))])
        plans = parsed.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(plan, "conv_id long, part long, top string, audit string, start long, cost long, gaps long, blank long, duplicate long, truncated long, illegal long")
        self._plan = rows, save(plans, "plans")
        return self._plan

    def _large_edits(self) -> DataFrame:
        rows, plans = self._planned()
        # a chunk's plan is the first row of its run, at place -1
        first = plans.select("conv_id", "part", F.lit(-1).cast("long").alias("place"), F.col("start").alias("turn"), F.col("top").alias("role"), F.col("audit").alias("text"), F.lit(False).alias("repeats"))
        both = rows.unionByName(first).repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "place")

        def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in runs(batches, 2):
                plan, *r = t.to_pylist()
                for x in r:
                    x["fault"] = _fault(x, x["repeats"])
                yield from _edit_rows(plan["conv_id"], edits_of(plan["text"], plan["role"], r), plan["turn"])

        return both.mapInArrow(edit, EDIT)

    def _large_reports(self) -> DataFrame:
        _, plans = self._planned()
        whole = plans.groupBy("conv_id").agg(*(F.first(k).alias(k) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"]), "").alias("audit"))
        lines = self._large_edits().repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "edit", "role", "text")

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            open_, state, begun = None, None, False
            for b in batches:
                for r in b.to_pylist():
                    if state is None or r["conv_id"] != open_:
                        if state is not None:
                            yield pa.RecordBatch.from_pylist([{"h": open_, "repaired_sha256": state.hexdigest()}], schema=digests)
                        open_, state, begun = r["conv_id"], hashlib.sha256(), False
                    if r["edit"] != "D":
                        state.update((("\n" if begun else "") + _line(r["role"], r)).encode())
                        begun = True
            if state is not None:
                yield pa.RecordBatch.from_pylist([{"h": open_, "repaired_sha256": state.hexdigest()}], schema=digests)

        digests = pa.schema([("h", pa.int64()), ("repaired_sha256", pa.string())])
        hashes = lines.mapInArrow(hashed, "h long, repaired_sha256 string")
        return whole.join(hashes, F.col("conv_id").eqNullSafe(F.col("h"))).drop("h")


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults planted by crc32 of ``conv_id:turn``: see the query's contract."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    d = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text: Column = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    d = d.withColumns({"text": text, "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role")), "copy": F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))})
    return d.select("conv_id", "turn", "role", "text")


def query(spark, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    found = Repair(damage(conversations)).reports().withColumnRenamed("conv_id", "c")
    every = conversations.select(F.col("conv_id").cast("long")).distinct()
    d = every.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    zeros = {k: F.coalesce(k, F.lit(0)) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return d.withColumns(zeros | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))})
