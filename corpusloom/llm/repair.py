"""Conversation repair: depth-first branch-and-bound over the edits that make the roles of a conversation alternate."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import hash128
from corpusloom.plans.session import cut

#: Cost of each edit; an undeleted truncated row adds TRUNCATED.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: What the roles read so far ask for: nothing yet, a user after the system row, an assistant, a user or the end.
START, SYSTEM, ANSWER, TURN = range(4)
ROLE = {START: "user", SYSTEM: "user", ANSWER: "assistant", TURN: "user"}
AFTER = {(START, "s"): SYSTEM, (START, "u"): ANSWER, (SYSTEM, "u"): ANSWER, (ANSWER, "a"): TURN, (TURN, "u"): ANSWER}
#: Faults as written into a row's code.
FINE, BLANK_ROW, COPY, CUT_OFF = ".", "b", "d", "t"


def _steps(state: int, initial: str, fault: str) -> list[tuple[str, int, int]]:
    """Edits of one row, in ASCII order: letter, state after it, cost."""
    out = [("D", state, DELETE)]
    if fault not in (BLANK_ROW, COPY):
        more = TRUNCATED if fault == CUT_OFF else 0
        if (state, initial) in AFTER:
            out.append(("K", AFTER[state, initial], KEEP + more))
        out.append(("R", AFTER[state, ROLE[state][0]], REROLE + more))
    return out


def _inserted(state: int) -> int:
    return AFTER[state, ROLE[state][0]]


def lower_bounds(rows: list[tuple[str, str]]) -> list[list[int]]:
    """By row and state: the least cost of what follows if a conversation could end anywhere. Never above the true cost,
    since only a condition is given up."""
    bounds = [[0] * 4 for _ in range(len(rows) + 1)]
    for i in range(len(rows) - 1, -1, -1):
        own = [min(cost + bounds[i + 1][to] for _, to, cost in _steps(state, *rows[i])) for state in range(4)]
        for _ in range(3):  # an insertion goes to another state before the same row
            own = [min(own[state], INSERT + own[_inserted(state)]) for state in range(4)]
        bounds[i] = own
    return bounds


def _dive(rows: list[tuple[str, str]], bounds: list[list[int]]) -> int:
    """Cost of one valid repair: the edit of least bound at each row, then what the end needs."""
    state, total = START, 0
    for i, row in enumerate(rows):
        _, state, cost = min(_steps(state, *row), key=lambda e: e[2] + bounds[i + 1][e[1]])
        total += cost
    while state not in (START, TURN):
        state, total = _inserted(state), total + INSERT
    return min(total, DELETE * len(rows))


def cheapest(rows: list[tuple[str, str]]) -> tuple[int, str]:
    """Least cost and, among the cheapest, the ASCII-least edits that give the role initials ``(s?(ua)+)?``.

    ``rows`` has a role initial and a fault per row. Edits are tried in ASCII order from an explicit stack, so the first
    prefix that reaches a node (row, state) at some cost is the ASCII-least one of that cost: the node's table keeps its
    least cost so far, and prefixes that are not cheaper are left. A branch also ends where cost and suffix bound exceed the
    incumbent; the search is over, and its incumbent proved, when the stack is empty.
    """
    size = len(rows)
    bounds = lower_bounds(rows)
    incumbent, audit = _dive(rows, bounds), None
    seen = [[incumbent + 1] * 4 for _ in range(size + 1)]
    path: list[str] = []
    stack = [(0, START, 0, 0, "")]
    while stack:
        i, state, cost, depth, letter = stack.pop()
        limit = incumbent if audit is None else incumbent - 1
        if cost >= seen[i][state] or cost + bounds[i][state] > limit:
            continue
        seen[i][state] = cost
        del path[max(0, depth - 1) :]
        if letter:
            path.append(letter)
        if i == size and state in (START, TURN):
            incumbent, audit = cost, "".join(path)
            continue
        edits = _steps(state, *rows[i]) if i < size else []
        edits.append(("I", _inserted(state), INSERT))
        for edit, to, more in sorted(edits, reverse=True):  # the last one pushed is tried first
            stack.append((i + (edit != "I"), to, cost + more, depth + 1, edit))
    return incumbent, audit


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role, text: rows after damage by k = crc32(``conv:turn``) % 20 (nulls: one blank): 0 drops the row, 1
    empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 makes its role user."""
    text_of = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(text_of(conv_col), F.lit(":"), text_of(turn_col))) % 20).alias("kind")
    rows = conversations.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), text_of(role_col).alias("role"), text_of(text_col).alias("text"), kind)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = rows.where("kind <> 0").select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))
    return rows.drop("copy")


def _later_copies(rows: DataFrame) -> DataFrame:
    """conv, turn, h1, h2 of rows whose role and text stand in an earlier turn of the conversation; hashes only, counted
    before the shuffle, so that a row repeated very often is one row per task."""
    hashed = rows.groupBy("conv", "turn", *hash128("role", "text")).agg(F.lit(1).alias("one")).drop("one")
    order = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    first = hashed.groupBy(F.col("conv").alias("c"), F.col("h1").alias("k1"), F.col("h2").alias("k2")).agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first <> last")
    same = (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & F.col("conv").eqNullSafe(F.col("c"))
    return hashed.join(first, same).where(order != F.col("first")).select("conv", "turn", "h1", "h2")


def _stream(first: DataFrame, rows: DataFrame) -> DataFrame:
    """Both frames sorted by conversation, the rows of ``first`` ahead of those of the same place in ``rows``. A conversation
    is read in order, so its rows are in one partition, but never in memory together."""
    both = first.unionByName(rows, allowMissingColumns=True)
    return both.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "ahead", "role", "text")


def _fault(text: str, copy: bool) -> str:
    said = text.strip(" \t\n\x0b\x0c\r")
    if not said:
        return BLANK_ROW
    return COPY if copy else FINE if said[-1] in ".!?" else CUT_OFF


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """conv, its rows as (initial, fault), adjacent illegal pairs; marks of later copies come ahead of their turn's rows."""
    conv, rows, illegal, before, copies, marked = None, None, 0, None, set(), None
    for batch in batches:
        for c, turn, ahead, role, text, h1, h2 in zip(*(batch.column(k).to_pylist() for k in range(7))):
            if rows is None or c != conv:
                if rows is not None:
                    yield conv, rows, illegal
                conv, rows, illegal, before, marked = c, [], 0, None, None
            if marked != (turn,):
                copies, marked = set(), (turn,)
            if not ahead:
                copies.add((h1, h2))
                continue
            initial = role[:1]
            if rows and rows[-1][0] + initial not in ("su", "ua", "au"):
                illegal += 1
            rows.append((initial, _fault(text, (h1, h2) in copies or before == (turn, role, text))))
            before = (turn, role, text)
    if rows is not None:
        yield conv, rows, illegal


class Rebuilt:
    """Digest of a conversation's repaired rows, one row at a time."""

    def __init__(self, audit: str):
        self.edits, self.at, self.state, self.digest = audit, 0, START, hashlib.sha256()

    def _write(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.state != START else ''}{role}:{text}".encode())
        self.state = AFTER[self.state, role[:1]]

    def _insertions(self) -> None:
        while self.edits[self.at : self.at + 1] == "I":
            self.at += 1
            self._write(ROLE[self.state], "")

    def row(self, role: str, text: str) -> None:
        """Insertions ahead of a row, then its own edit."""
        self._insertions()
        edit = self.edits[self.at]
        self.at += 1
        if edit != "D":
            self._write(role if edit == "K" else ROLE[self.state], text)

    def end(self) -> str:
        self._insertions()
        return self.digest.hexdigest()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """conv, digest of the repaired rows; an audit comes ahead of the rows it edits."""
    conv, made = None, None
    for batch in batches:
        for c, ahead, role, text, audit in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if ahead:
                made.row(role, text)
                continue
            if made is not None:
                yield conv, made.end()
            conv, made = c, Rebuilt(audit)
    if made is not None:
        yield conv, made.end()


_MEMORY: dict[str, tuple[int, str]] = {}


def _remembered(rows: list[tuple[str, str]]) -> tuple[int, str]:
    """``cheapest``; conversations of few rows are often alike."""
    if len(rows) > 32:
        return cheapest(rows)
    key = "".join(f"{i if i in ('s', 'u', 'a') else '-'}{f}" for i, f in rows)
    if key not in _MEMORY:
        if len(_MEMORY) > 100_000:
            _MEMORY.clear()
        _MEMORY[key] = cheapest(rows)
    return _MEMORY[key]


def repair(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per conv of ``convs`` (distinct): conv, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256; ``rows`` has conv, turn, role, text without null role or text.

    Rows stand by turn (nulls first, then by role and text). A row's first fault counts: blank (white space only), duplicate
    (role and text of an earlier row), truncated (last character no ``[.!?]``); illegal counts neighbours whose role
    initials are not su, ua or au. gaps are turn numbers missing between the first and the last one, nulls left out. cost and
    audit are the cheapest edits (``cheapest``). A conv without rows gets zeros, an empty audit and the empty string's hash. A
    null conv is one conversation.

    A conversation's rows are streamed through one task twice, in order and without being held: first as two characters a
    row, from which the search finds the audit, then to hash the repaired text. Memory per conversation grows with the
    length of its audit, which is part of the result, not with its texts.
    """
    kind = rows.schema["conv"].dataType
    rows = cut(rows.select("conv", "turn", "role", "text", F.lit(1).alias("ahead"), *hash128("role", "text")))
    marks = _later_copies(rows).withColumn("ahead", F.lit(0))
    found = T.StructType([T.StructField("conv", kind), *(T.StructField(n, T.LongType()) for n in ("blank", "duplicate", "truncated", "illegal", "cost")), T.StructField("audit", T.StringType())])

    def search(batches):
        from corpusloom.llm.repair import _batched, _codes, _remembered

        def answers(some):
            for conv, codes, illegal in _codes(some):
                faults = [f for _, f in codes]
                yield (conv, *(faults.count(f) for f in (BLANK_ROW, COPY, CUT_OFF)), illegal, *_remembered(codes))

        yield from _batched(batches, answers, found.names, [*[pa.int64()] * 5, pa.string()])

    cols = ["conv", "turn", "ahead", "role", "text", "h1", "h2"]
    audits = cut(_stream(marks, rows).select(cols).mapInArrow(search, found))
    hashes = T.StructType([T.StructField("conv", kind), T.StructField("repaired_sha256", T.StringType())])

    def hashing(batches):
        from corpusloom.llm.repair import _batched, _hashed

        yield from _batched(batches, _hashed, hashes.names, [pa.string()])

    ahead = audits.select("conv", F.lit(0).alias("ahead"), "audit", F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"))
    digests = _stream(ahead, rows.drop("h1", "h2")).select("conv", "ahead", "role", "text", "audit").mapInArrow(hashing, hashes)
    turns = rows.where("turn is not null").groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv")
    gaps = turns.agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).cast("long").alias("gaps"))
    out = convs.select("conv")
    for part in (gaps, audits, digests):
        names = [c for c in part.columns if c != "conv"]
        part = part.withColumnRenamed("conv", "own")
        out = out.join(part, out["conv"].eqNullSafe(part["own"]), "left").select(*out.columns, *names)
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def _batched(batches: Iterator[pa.RecordBatch], work, names: list[str], kinds: list[pa.DataType], most: int = 1000) -> Iterator[pa.RecordBatch]:
    """Rows that ``work`` makes of the batches, in batches; the first column is typed as theirs."""
    head = next(batches, None)
    if head is None:
        return

    def every():
        yield head
        yield from batches

    kinds = [head.schema.field(0).type, *kinds]
    rows: list[tuple] = []
    for row in work(every()):
        rows.append(row)
        if len(rows) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def repair_damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``repair`` of the ``damaged`` rows, for every original conversation."""
    convs = conversations.select(F.col(f"`{conv_col}`").alias("conv")).distinct()
    return repair(damaged(conversations, conv_col, turn_col, role_col, text_col), convs).withColumnRenamed("conv", conv_col)
