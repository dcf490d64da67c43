"""SQL spellings of the text primitives, shared by the case files."""

from corpusloom.functions.text import HTML_ENTITIES

W = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"


def strip(x):
    return rf"regexp_replace({x}, '^{W}+|{W}+$', '', 'g')"


def squeeze(x):
    return rf"trim(regexp_replace({x}, '{W}+', ' ', 'g'))"


def norm(x):
    return (
        rf"lower(regexp_replace(regexp_replace({squeeze(x)}, '[（(].*?[）)]', '', 'g'),"
        rf" '[^\p{{L}}\p{{N}}]+', '', 'g'))"
    )


def clean(x):
    out = strip(x)
    for entity, char in HTML_ENTITIES:
        c = char.replace("'", "''")
        e = entity.replace("'", "''")
        out = f"replace({out}, '{e}', '{c}')"
    return rf"regexp_replace({out}, '[\x00-\x1f\x7f-\x9f]', '', 'g')"


def ntok(x):
    return rf"len(regexp_extract_all({x}, '\S+'))"


def spaced(x):
    return rf"regexp_extract_all({x}, '\s*\S+')"


def take(x, n):
    return f"array_to_string({spaced(x)}[1:{n}], '')"


def chunk_cte(docs: str, max_tokens: int, overlap: int) -> str:
    """CTE list giving chunks(full_doc_id, chunk_order_index, tokens, content) of docs(doc_id, text)."""
    step = max_tokens - overlap
    return f"""
    toks AS (SELECT doc_id, {spaced('text')} AS t FROM {docs}),
    wins AS (SELECT doc_id, t, len(t) AS n, unnest(range(0, len(t), {step})) AS start FROM toks),
    chunks AS (SELECT doc_id AS full_doc_id, CAST(start // {step} AS INT) AS chunk_order_index,
        CAST(least({max_tokens}, n - start) AS INT) AS tokens,
        {strip(f"array_to_string(t[start+1:start+{max_tokens}], '')")} AS content FROM wins)"""


# crc32 by a table made from its polynomial; CRC_OF gives it for the string s, next to the one row of crc_table
CRC_TABLE = """crc_table(tab) AS (SELECT list(x ORDER BY i) FROM (SELECT i, list_reduce(list_concat([i], range(8)::UBIGINT[]),
    lambda acc, k: CASE WHEN acc % 2 = 1 THEN xor(acc >> 1, 3988292384::UBIGINT) ELSE acc >> 1 END) AS x FROM (SELECT unnest(range(256))::UBIGINT AS i)))"""
UTF8 = """flatten(list_transform(string_split(s, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::UBIGINT]
    WHEN unicode(c) < 2048 THEN [(192 + unicode(c) // 64)::UBIGINT, (128 + unicode(c) % 64)::UBIGINT]
    ELSE [(224 + unicode(c) // 4096)::UBIGINT, (128 + unicode(c) // 64 % 64)::UBIGINT, (128 + unicode(c) % 64)::UBIGINT] END))"""
CRC_OF = f"xor(list_reduce(list_concat([4294967295::UBIGINT], {UTF8}), lambda acc, b: xor(acc >> 8, tab[((xor(acc, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT"
