"""Chat formatting with a black-box template: render successive turn prefixes and compare the outputs."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
Turn = tuple[str, str]  # role, text


def escape(text: str) -> str:
    """After this no control string can stand in the text; unescape gives the text back."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def escape_role(role: str) -> str:
    """As ``escape``; a line feed, which would end the role, becomes ``\\`` + ``n``. Backslashes of the role are doubled
    before, so no two roles are written alike."""
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S)


def chatml(turns: list[Turn]) -> str:
    """The template used in production."""
    return "".join(f"{START}{escape_role(role)}\n{escape(text)}{END}\n" for role, text in turns)


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)


def read_back(formatted: str) -> list[Turn]:
    """Turns of a chatml output; fails on anything that chatml does not write."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    return out


def _common(a: str, b: str) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def locate(render: Callable[[list[Turn]], str], turns: list[Turn]) -> tuple[str, list[tuple[int, int, int, int]], list[int]]:
    """Output, per turn (start, text start, text end, end), and the turns whose rendering changed what stood before.

    ``render`` is a black box. The output of each prefix is compared with the one before: where it only appends,
    the added part is the turn's span; where it rewrites history, the turn is listed and its span starts at the
    first character that differs. Two probes with one other character as text show what the template puts before
    and after the text. After a rewrite the spans of the earlier turns hold no longer: their texts are located anew in
    the whole output by the same probes (the span is then the text alone; empty if the template drops the turn's text).
    """
    spans: list[tuple[int, int, int, int]] = []
    rewritten: list[int] = []
    before = render([]) if not turns else ""
    for i, (role, _) in enumerate(turns):
        now = render(turns[: i + 1])
        start = len(before)
        if not now.startswith(before):
            start = _common(before, now)
            rewritten.append(i)
        a, b = (render([*turns[:i], (role, probe)]) for probe in "xy")
        head, tail = _common(a, b), _common(a[::-1], b[::-1])
        spans.append((start, head, len(now) - tail, len(now)))
        before = now
    for j in range(rewritten[-1] if rewritten else 0):
        a, b = (render([*turns[:j], (turns[j][0], probe), *turns[j + 1 :]]) for probe in "xy")
        head = _common(a, b)
        stop = len(before) - _common(a[head:][::-1], b[head:][::-1])
        spans[j] = (head, head, stop, stop) if a != b and head <= stop else (0, 0, 0, 0)
    return before, spans, rewritten


def format_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: str = "assistant", render: Callable[[list[Turn]], str] = chatml) -> DataFrame:
    """One row per conversation: conv_id, formatted, spans (start, text_start, text_end, end; end exclusive), loss
    (those text spans whose role is ``trained``), rewritten (turns that changed earlier output).

    Offsets are code points. Rows are ordered by turn; null text or role is empty, null turns come first, rows of
    one turn are ordered by role and text and all kept, also repeated ones. A null id is one conversation. No rows
    in, no rows out. A conversation is one output string, so its turns meet in one task; nothing else does.
    """
    span = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "text_start", "text_end", "end")])
    out = T.StructType([
        T.StructField(conv_col, df.schema[conv_col].dataType),
        T.StructField("formatted", T.StringType()),
        T.StructField("spans", T.ArrayType(span)),
        T.StructField("loss", T.ArrayType(span)),
        T.StructField("rewritten", T.ArrayType(T.LongType())),
    ])
    turn = F.struct(F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    convs = df.groupBy(F.col(f"`{conv_col}`").alias("conv")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def run(batches):
        names = ("start", "text_start", "text_end", "end")
        for batch in batches:
            rows = []
            for conv, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                said = [(t["role"], t["text"]) for t in turns]
                text, spans, rewritten = locate(render, said)
                made = [dict(zip(names, s)) for s in spans]
                rows.append((conv, text, made, [s for s, (role, _) in zip(made, said) if role == trained and s["end"]], rewritten))
            fields = pa.schema([(out[0].name, batch.schema.field(0).type), ("formatted", pa.string()), *((n, pa.list_(pa.struct([(x, pa.int64()) for x in names]))) for n in ("spans", "loss")), ("rewritten", pa.list_(pa.int64()))])
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(fields)], schema=fields)

    return convs.mapInArrow(run, out)


def digest(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What can be read back from chatml output: turns and trained text, as digests."""
    kind = formatted.schema[conv_col].dataType
    out = T.StructType([T.StructField(conv_col, kind), *(T.StructField(n, t) for n, t in (("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType()), ("n_rewritten", T.LongType())))])

    def run(batches):
        for batch in batches:
            rows = []
            for conv, text, loss, rewritten in zip(*(batch.column(k).to_pylist() for k in range(4))):
                turns = read_back(text)
                said = hashlib.sha256()
                for role, words in turns:
                    said.update(f"{role}\n{words}\n".encode())
                trained = "".join(unescape(text[s["text_start"] : s["text_end"]]) for s in loss)
                rows.append((conv, len(turns), said.hexdigest(), len(trained), hashlib.sha256(trained.encode()).hexdigest(), len(text), len(rewritten)))
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=out.names)

    return formatted.select(F.col(conv_col), "formatted", "loss", "rewritten").mapInArrow(run, out)
