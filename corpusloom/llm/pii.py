"""Personal data: fixed patterns on the text as it stands, and the same patterns on a deobfuscated text whose
spans are mapped back to the source characters."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a failed run of digits is not tried again from its inside: it would fail again
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, not overlapping; linear, since each @ takes the run of local characters before it."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def find(text: str) -> list[Span]:
    """The base patterns, each kind by itself."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if "." in text:
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m.end() - m.start() >= 12 and NOT_DIGIT.sub("", m[0])
        if digits and 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


# Look-alike letters (Cyrillic, Greek) by the ASCII letter that they imitate.
LOOKALIKES = {
    "A": "АΑ", "B": "ВΒ", "C": "С", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "УΥ", "Z": "Ζ",
    "a": "аα", "c": "с", "e": "е", "i": "іι", "j": "ј", "o": "оο", "p": "рρ", "s": "ѕ", "v": "ν", "x": "хχ", "y": "у",
}
# The digits as words.
SPELLED = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "oh": "0"}

PLAIN = {c: a for a, cs in LOOKALIKES.items() for c in cs} | {chr(0xFEE0 + x): chr(x) for x in range(0x21, 0x7F)}
PLAIN |= {c: "@" for c in "﹫"} | {c: "." for c in "。｡․﹒"} | {c: "-" for c in "‐‑‒–−"} | {c: " " for c in "   "} | {c: "" for c in "​‌‍⁠﻿­"}
ODD = re.compile("[" + re.escape("".join(PLAIN)) + "]")
DIGIT_WORD = "|".join(SPELLED)
# six spelled digits in a row at least, or a plus sign before them: fewer is ordinary prose
DIGITS = re.compile(rf"\b(?:plus[\s-]+)?(?:{DIGIT_WORD})(?:[\s,-]+(?:{DIGIT_WORD}|[0-9]+)){{5,}}\b", re.I)
# blanks before the bracket are taken from the start of their run only, so that long runs are read once
BRACKET = re.compile(r"(?:(?<!\s)\s++)?[\[({<]\s*+(at|dot|punto|arroba|point|punkt|@|\.)\s*+[\])}>]\s*+", re.I)
NAME, HOST, BY_DOT = r"[A-Za-z0-9._%+-]{1,64}", r"[A-Za-z0-9-]{1,64}", r"(?:\s++dot\s++|\.)"
# "name at host dot tld", "name at host.tld", "first dot last@host.tld"
SPOKEN = re.compile(rf"(?<![A-Za-z0-9._%+-])({NAME}(?:\s++dot\s++{NAME}){{0,3}})(\s++at\s++|\s*+@\s*+)({HOST}(?:{BY_DOT}{HOST})*{BY_DOT}[A-Za-z]{{2,24}})\b", re.I)
AT_HOST = re.compile(r"\sat\s++[A-Za-z0-9-]++\.[A-Za-z]|\s@|@\s", re.I)
DOT = re.compile(r"\s+dot\s+", re.I)
# Words that stand before "at host.tld" in ordinary prose, where no name is meant.
PROSE = frozenset("us me him her them it you is are was be look looks looking find found see seen read more available online here there live now out page site website blog home web store shop book order visit register apply download details info information hosted located posted published and or up".split())
# four numbers, as digits or as one to three digit words, with a spoken dot between them
NUMBER = rf"(?:[0-9]{{1,3}}|(?:{DIGIT_WORD})(?:[\s-]++(?:{DIGIT_WORD})){{0,2}})"
SPOKEN_IP = re.compile(rf"(?<![A-Za-z0-9.]){NUMBER}(?:\s++dot\s++{NUMBER}){{3}}(?![A-Za-z0-9])", re.I)
MARKS = {"at": "@", "arroba": "@", "@": "@"}


def rewrite(text: str, source: list[int], pattern: re.Pattern, make) -> tuple[str, list[int]]:
    """One transducer: replaces matches; ``source`` has the source offset of each character and the end."""
    parts, offsets, at = [], [], 0
    for m in pattern.finditer(text):
        new = make(m)
        if new is None:
            continue
        parts += [text[at : m.start()], "".join(c for c, _ in new)]
        offsets += source[at : m.start()]
        offsets += [source[i] for _, i in new]
        at = m.end()
    if not parts:
        return text, source
    return "".join(parts) + text[at:], offsets + source[at:]


SIGNS = {"plus": "+", "dot": "."}


def _digits(m: re.Match) -> list[tuple[str, int]]:
    out: list[tuple[str, int]] = []
    for w in re.finditer(r"[A-Za-z]+|[0-9]+", m[0]):
        low = w[0].lower()
        if low in SIGNS:
            out.append((SIGNS[low], m.start() + w.start()))
        else:
            out += [(SPELLED[low], m.start() + w.start())] if low in SPELLED else [(c, m.start() + w.start() + k) for k, c in enumerate(w[0])]
    return out


def _dots(m: re.Match) -> list[tuple[str, int]] | None:
    """Null for what is written plainly already, and for prose before an address that has no spoken dot."""
    if DOT.search(m[0]) is None and (m[2] == "@" or m[1].lower() in PROSE):
        return None
    out, i = [], m.start()
    marks = {m.start(2): ("@", m.end(2))} | {d.start() + m.start(): (".", d.end() + m.start()) for d in DOT.finditer(m[0])}
    while i < m.end():
        if i in marks:
            c, j = marks[i]
            out.append((c, i))
            i = j
        else:
            out.append((m.string[i], i))
            i += 1
    return out


def deobfuscate(text: str) -> tuple[str, list[int]] | None:
    """Normalised text and, for each of its characters and its end, the source offset; None: nothing to normalise."""
    low = text.lower() if "dot" in text or "DOT" in text or "Dot" in text else ""
    odd, dots = not text.isascii() and ODD.search(text), " dot" in low or "dot " in low
    brackets = ("[" in text or "(" in text or "{" in text or "<" in text) and BRACKET.search(text)
    spelled = DIGITS.search(text)
    if not (odd or dots or brackets or spelled or "." in text and AT_HOST.search(text)):
        return None
    source = list(range(len(text) + 1))
    new = text
    if odd:
        new, source = rewrite(new, source, ODD, lambda m: [(c, m.start()) for c in PLAIN[m[0]]])
    new, source = rewrite(new, source, BRACKET, lambda m: [(MARKS.get(m[1].lower(), "."), m.start())])
    new, source = rewrite(new, source, SPOKEN_IP, _digits)
    new, source = rewrite(new, source, SPOKEN, _dots)
    new, source = rewrite(new, source, DIGITS, _digits)
    return new, source


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and what the method adds: an added span that overlaps base spans of its kind is kept if it is longer and
    holds them whole (``jane dot doe@example.com`` beside ``doe@example.com``)."""
    base = find(text)
    made = deobfuscate(text)
    if made is None:
        return base, []
    new, source = made
    added = []
    for kind, a, b in find(new):
        span = (kind, source[a], source[b - 1] + 1 if source[b] == source[b - 1] + 1 else _end(text, source, b))
        met = [(s, e) for k, s, e in base if k == kind and span[1] < e and s < span[2]]
        if all(span[1] <= s and e <= span[2] and (s, e) != span[1:] for s, e in met):
            added.append(span)
    return base, added


def _end(text: str, source: list[int], b: int) -> int:
    """Exclusive end in the source of what was normalised to the character before ``b``."""
    end = source[b]
    start = source[b - 1]
    return start + max(1, len(text[start:end].rstrip(" \t\n\r,-")))


def render(spans: list[Span]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(set(spans), key=lambda s: (s[1], order[s[0]], s[2])))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone (base spans), base and spans (``kind:start:end`` by
    start, then kind, comma-joined; code points, end exclusive). Null or empty text has no span. Repeated rows give
    equal results, an empty table none. Each row is read whole and by itself; there is no shuffle.

    Disguises that are seen: look-alike letters, full-width forms and zero-width characters; at, dot, @ and . in
    brackets; ``name at host.tld`` and spoken dots in names (at most three, parts of at most 64 characters), hosts
    and addresses of four numbers; six spelled digits or more in a row. Before ``at host.tld`` without a spoken dot
    common words of prose (``PROSE``) are not taken as names. Other spellings (twelve, double five) are not seen.
    """
    names = [id_col, *(f"n_{k}" for k in KINDS), "base", "spans"]
    kinds = [docs.schema[id_col].dataType, *[T.LongType()] * 4, T.StringType(), T.StringType()]

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, added = scan(text or "")
                rows.append(([sum(k == kind for k, _, _ in base) for kind in KINDS], render(base), render(base + added)))
            columns = [batch.column(0), *(pa.array([r[0][k] for r in rows], pa.int64()) for k in range(4)), *(pa.array([r[k] for r in rows], pa.string()) for k in (1, 2))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)]))
