"""Text primitives as Column expressions (all JVM-side, no Python in the row path).

Every function takes and returns a Column, so that Catalyst can fold, prune and
code-generate them together with the surrounding projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: whitespace as the Unicode-aware regex engines see it (Java's \s is ASCII-only)
WS = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"
# fixed value: the same characters one by one, for trimming without a regular expression
WS_CHARS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# fixed value: separator of joined graph fields
SEP = "<SEP>"
# fixed values: single characters that survive the keyword length filter
SINGLE_CHAR_TERMS = ("阀", "泵")
# fixed values: HTML entities replaced by clean_str, ampersand last
HTML_ENTITIES = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#34;", '"'),
    ("&#39;", "'"),
    ("&#x27;", "'"),
    ("&apos;", "'"),
    ("&nbsp;", " "),
    ("&copy;", "©"),
    ("&reg;", "®"),
    ("&mdash;", "—"),
    ("&ndash;", "–"),
    ("&hellip;", "…"),
    ("&amp;", "&"),
)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: keeps chains of rewrites from growing
    exponentially when every step mentions its input several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Trim every kind of whitespace at both ends."""
    return F.btrim(c, F.lit(WS_CHARS))


def squeeze(c: Column) -> Column:
    """Collapse whitespace runs to one space and trim."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def is_blank(c: Column) -> Column:
    return strip(text_or_empty(c)) == ""


def alias_norm(c: Column) -> Column:
    """Comparison form: bracketed asides and all non-letter/digit characters removed, lower case."""
    flat = squeeze(text_or_empty(c))
    no_aside = F.regexp_replace(flat, r"[（(].*?[）)]", "")
    return F.lower(F.regexp_replace(no_aside, r"[^\p{L}\p{N}]+", ""))


def clean_str(c: Column) -> Column:
    """HTML entities decoded, trimmed, control characters (newline and tab included) deleted."""
    raw = strip(text_or_empty(c))
    out = F.when(F.contains(raw, F.lit("&")), decode_entities(raw)).otherwise(raw)
    return F.regexp_replace(out, r"[\x00-\x1f\x7f-\x9f]", "")


def decode_entities(text: Column) -> Column:
    """Named and numeric HTML entities (with semicolon) as characters; unknown ones stay.

    The distinct entities of the text are replaced one by one, those for an ampersand last, so that what
    they produce is not decoded again.
    """
    from html.entities import html5

    table = "\x01".join(f"&{name}\x02{char}" for name, char in sorted(html5.items()) if name.endswith(";"))
    named = F.str_to_map(F.lit(table), F.lit("\x01"), F.lit("\x02"))  # folded to one literal

    def numbered(e: Column) -> Column:
        digits = F.regexp_extract(e, "([0-9A-Fa-f]+);$", 1)
        code = F.when(e.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("long")
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))

    def char(e: Column) -> Column:
        return F.when(e.startswith("&#"), numbered(e)).otherwise(F.try_element_at(named, e))

    def replaced(start: Column, pairs: Column) -> Column:
        return F.aggregate(pairs, start, lambda acc, p: F.replace(acc, p["e"], p["c"]))

    found = F.array_distinct(F.regexp_extract_all(text, F.lit("&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);"), F.lit(0)))
    known = F.filter(F.transform(found, lambda e: F.struct(e.alias("e"), char(e).alias("c"))), lambda p: p["c"].isNotNull())
    return let(known, lambda k: replaced(replaced(text, F.filter(k, lambda p: p["c"] != "&")), F.filter(k, lambda p: p["c"] == "&")))


def md5_id(c: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.md5(c))


def split_markers(c: Column, markers: list[str]) -> Column:
    """Split on any marker, trim the parts, drop the empty ones."""
    import re

    pattern = "|".join(re.escape(m) for m in markers)
    return F.filter(F.transform(F.split(c, pattern), strip), lambda x: x != "")


def clean_list(c: Column) -> Column:
    """Trimmed, non-blank list items; null becomes the empty list."""
    empty = F.array().cast("array<string>")
    return F.coalesce(
        F.filter(F.transform(c, lambda x: strip(text_or_empty(x))), lambda x: x != ""), empty
    )


def count_tokens(c: Column) -> Column:
    """Number of whitespace-delimited tokens."""
    return F.regexp_count(text_or_empty(c), F.lit(r"\S+"))


def spaced_tokens(c: Column) -> Column:
    """Tokens that keep their leading whitespace, so that joining a slice gives back the text."""
    return F.regexp_extract_all(text_or_empty(c), F.lit(r"\s*\S+"), F.lit(0))


def take_tokens(c: Column, budget: Column | int) -> Column:
    """The first ``budget`` tokens of a text, original spacing kept."""
    n = budget if isinstance(budget, Column) else F.lit(budget)
    toks = spaced_tokens(c)
    return F.array_join(F.slice(toks, F.lit(1), F.greatest(n, F.lit(0))), "")


def analyse(c: Column) -> Column:
    """Search terms of a text: lower-cased letter/digit runs; Han runs give characters and bigrams."""
    low = F.lower(text_or_empty(c))
    runs = F.regexp_extract_all(low, F.lit(r"\p{IsHan}+|[\p{L}\p{N}&&[^\p{IsHan}]]+"), F.lit(0))

    def han_terms(x: Column) -> Column:
        n = F.length(x)
        bigrams = F.transform(
            F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(x, i, F.lit(2))
        )
        chars = F.split(x, "")
        return F.when(n > 1, F.concat(bigrams, chars)).otherwise(chars)

    mixed = F.flatten(
        F.transform(runs, lambda x: F.when(x.rlike(r"^\p{IsHan}"), han_terms(x)).otherwise(F.array(x)))
    )
    # most texts have no Han character: their runs are their terms
    return F.when(low.rlike(r"\p{IsHan}"), mixed).otherwise(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def keyword_terms(query: Column) -> Column:
    """Terms of a keyword query: explicit whitespace terms if there are any, else analysed words."""
    trimmed = strip(text_or_empty(query))
    explicit = F.split(trimmed, f"{WS}+")
    raw = F.when(F.size(explicit) > 1, explicit).otherwise(analyse(trimmed))
    terms = F.array_distinct(F.transform(raw, alias_norm))
    keep = F.filter(terms, lambda t: (F.length(t) > 1) | t.isin(*SINGLE_CHAR_TERMS))
    whole = alias_norm(query)
    return (
        F.when(whole == "", F.array().cast("array<string>"))
        .when(F.size(keep) > 0, keep)
        .otherwise(F.array(whole))
    )


def char_set(c: Column) -> Column:
    """Distinct characters of a text."""
    return F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))


def preview(c: Column, limit: int) -> Column:
    flat = squeeze(text_or_empty(c))
    return F.when(F.length(flat) <= limit, flat).otherwise(
        F.concat(F.substring(flat, 1, limit), F.lit("..."))
    )


def csv_cell(c: Column) -> Column:
    """One CSV cell with minimal quoting."""
    s = text_or_empty(c)
    quoted = F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(s.rlike('[",\r\n]'), quoted).otherwise(s)


def numbered(items: Column, empty: str = "无") -> Column:
    """``1. a\\n2. b`` rendering of a list."""
    lines = F.transform(
        items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)
    )
    return F.when(F.size(items) > 0, F.array_join(lines, "\n")).otherwise(F.lit(empty))
