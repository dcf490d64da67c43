"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, chat, decontaminate, forest, licenses, lines, neardup, passages, pii, quality, repair, spelling, token_counts

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


LINES_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> keeper AS dropped FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""


@query(LINES_SQL)
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = lines.dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query()
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    both = bpe.encode_and_decode(docs, path, pattern)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.ids_sha256().alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, 24 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS chars FROM c),
s AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, sum(chars)::BIGINT AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, 0::BIGINT AS n_rewritten FROM s
"""


@query(CHAT_SQL)
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("<|im_end|><|im_start|>assistant ok").alias("text")
    )
    return chat.digest(chat.format_conversations(convs.unionByName(tricky)))


def _license_sql() -> str:
    chosen = [(label, licenses.template_words(t)) for label, ts in licenses.TEMPLATES.items() for t in ts]
    step = max(len(ws) for _, ws in chosen)
    values = ", ".join(f"({k}, '{label}', {ws!r})" for k, (label, ws) in enumerate(chosen))
    phrases = ", ".join(f"('{label}', ' {p.replace(' ', '  ')} ', {len(p.split())})" for p, label in licenses.PHRASES.items())
    return rf"""
WITH d AS (SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' ') AS line FROM documents),
w AS (SELECT doc_id, line, CASE WHEN line = '' THEN [] ELSE string_split(line, ' ') END AS words FROM d),
t(template, label, ws) AS (VALUES {values}), p(label, phrase, n) AS (VALUES {phrases}),
b AS (SELECT doc_id, words[start + 1 : start + {2 * step}] AS block FROM (SELECT doc_id, words, unnest(range(0, greatest(1, len(words) - {step}), {step})) AS start FROM w)),
m AS (SELECT doc_id, list(DISTINCT label) AS met, max(overlap / size) AS share FROM (
    SELECT doc_id, label, len(list_intersect(list_distinct(block), ws)) AS overlap, len(ws) AS size FROM b, t) WHERE overlap >= ceil(0.8 * size - 1e-9) GROUP BY doc_id),
f AS (SELECT doc_id, label, n, string_split(' ' || replace(line, ' ', '  ') || ' ', phrase) AS parts FROM w, p WHERE contains(' ' || replace(line, ' ', '  ') || ' ', phrase)),
g AS (SELECT doc_id, sum(len(parts) - 1) AS n_base, min((length(parts[1]) - length(replace(parts[1], ' ', ''))) // 2) AS first_word, list(DISTINCT label) AS base FROM f GROUP BY doc_id),
l AS (SELECT doc_id, max(len(words) - (length(parts[-1]) - length(replace(parts[-1], ' ', ''))) // 2 - n) AS last_word FROM f JOIN w USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
    array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(met, [])))), ',') AS labels,
    CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN m USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN l USING (doc_id)
"""


@query(_license_sql())
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query()
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


@query()
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query()
def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


@query()
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query()
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query()
def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: crc32 by its own table: BYTES is a list of byte values.
CRC_TABLE = """crc(tab) AS (SELECT list(x ORDER BY i) FROM (SELECT i, list_reduce(list_concat([i], range(8)::UBIGINT[]),
    lambda acc, k: CASE WHEN acc % 2 = 1 THEN xor(acc >> 1, 3988292384::UBIGINT) ELSE acc >> 1 END) AS x FROM (SELECT unnest(range(256))::UBIGINT AS i)))"""
BYTES = """flatten(list_transform(string_split(s, ''), lambda c: CASE WHEN s = '' THEN [] WHEN unicode(c) < 128 THEN [unicode(c)::UBIGINT]
    ELSE [(192 + unicode(c) // 64)::UBIGINT, (128 + unicode(c) % 64)::UBIGINT] END))"""
CRC = f"xor(list_reduce(list_concat([4294967295::UBIGINT], {BYTES}), lambda acc, b: xor(acc >> 8, tab[((xor(acc, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)"

SPELLING_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
g AS (SELECT doc_id, run, count(*) AS times, coalesce(doc_id::VARCHAR, '') || ':' || run AS s FROM r WHERE length(run) >= 5 GROUP BY doc_id, run),
h AS (SELECT run, times, {CRC} AS h FROM g, crc),
d AS (SELECT times, CASE WHEN h % 97 = 0 THEN run[1 : (h % length(run))::BIGINT] || run[(h % length(run))::BIGINT + 2 :] ELSE run END AS word FROM h),
v AS MATERIALIZED (SELECT word, sum(times)::BIGINT AS n FROM d WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
c AS (SELECT word, n, p, word[1 : p - 1] || word[p + 1 :] AS without FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM v)),
e AS MATERIALIZED (SELECT DISTINCT a, b, bn FROM (
    SELECT x.word AS a, y.word AS b, y.n AS bn FROM c x JOIN c y ON x.without = y.without AND x.p = y.p AND x.word <> y.word
    UNION ALL SELECT c.word, v.word, v.n FROM c JOIN v ON c.without = v.word
    UNION ALL SELECT v.word, c.word, c.n FROM c JOIN v ON c.without = v.word)),
k AS (SELECT a, b, bn, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY bn DESC, b) AS place FROM e),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN bn >= 2 * v.n THEN b END AS form, CASE WHEN bn >= 2 * v.n THEN bn END AS form_n
    FROM v LEFT JOIN k ON k.a = v.word AND place = 1),
t(word, reached) AS (SELECT word, word FROM f UNION ALL SELECT t.word, f.form FROM t JOIN f ON f.word = t.reached WHERE f.form IS NOT NULL)
SELECT f.word, f.form, t.reached AS root, f.n, f.n_near, f.form_n FROM f JOIN t ON t.word = f.word JOIN f l ON l.word = t.reached AND l.form IS NULL
"""


@query(SPELLING_SQL)
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spelling.word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")))


@query()
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))


# step: the cheapest (cost, edits) by conversation and state (0 nothing, 1 after the system row, 2 assistant next, 3 user or end next);
# up to two insertions may precede an edit, and follow the last row.
REPAIR_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
k AS (SELECT *, {CRC} % 20 AS kind FROM c, crc),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM k WHERE kind <> 0),
o AS (SELECT conv_id, turn, role, text, left(role, 1) AS initial, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said,
    row_number() OVER w AS i, lag(left(role, 1)) OVER w AS prior, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth
    FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
r AS MATERIALIZED (SELECT *, CASE WHEN said = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM o),
ins(a, b, edits, price) AS (VALUES (0, 0, '', 0), (1, 1, '', 0), (2, 2, '', 0), (3, 3, '', 0), (0, 2, 'I', 5), (1, 2, 'I', 5), (2, 3, 'I', 5), (3, 2, 'I', 5), (0, 3, 'II', 10), (1, 3, 'II', 10), (2, 2, 'II', 10), (3, 3, 'II', 10)),
step(conv_id, i, state, best) AS (
    SELECT conv_id, 0, 0, {{'cost': 0, 'audit': ''}} FROM (SELECT DISTINCT conv_id FROM r)
    UNION ALL
    SELECT conv_id, i, state, min(best) FROM (
        SELECT p.conv_id, p.i + 1 AS i, m.state, {{'cost': p.best.cost + n.price + m.price + CASE WHEN r.fault = 't' AND m.edit <> 'D' THEN 5 ELSE 0 END, 'audit': p.best.audit || n.edits || m.edit}} AS best
        FROM step p JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1 JOIN ins n ON n.a = p.state
        JOIN (VALUES (0, 's', 1, 'K', 0), (0, 'u', 2, 'K', 0), (1, 'u', 2, 'K', 0), (3, 'u', 2, 'K', 0), (2, 'a', 3, 'K', 0), (0, NULL, 2, 'R', 1), (1, NULL, 2, 'R', 1), (2, NULL, 3, 'R', 1), (3, NULL, 2, 'R', 1),
            (0, NULL, 0, 'D', 2), (1, NULL, 1, 'D', 2), (2, NULL, 2, 'D', 2), (3, NULL, 3, 'D', 2)) m(a, initial, state, edit, price)
            ON m.a = n.b AND (m.initial IS NULL OR m.initial = r.initial) AND (m.edit = 'D' OR r.fault NOT IN ('b', 'd'))) q
    GROUP BY conv_id, i, state),
z AS (SELECT conv_id, min({{'cost': best.cost + n.price, 'audit': best.audit || n.edits}}) AS best FROM step JOIN (SELECT conv_id AS c2, max(i) AS last FROM r GROUP BY conv_id) l ON c2 IS NOT DISTINCT FROM conv_id AND i = last JOIN ins n ON n.a = state AND n.b IN (0, 3) GROUP BY conv_id),
e AS (SELECT conv_id, unnest(string_split(best.audit, '')) AS edit, generate_subscripts(string_split(best.audit, ''), 1) AS pos FROM z),
x AS (SELECT *, count(*) FILTER (edit <> 'I') OVER w AS i, count(*) FILTER (edit <> 'D') OVER w AS nth FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
y AS (SELECT x.conv_id, x.pos, x.edit, CASE WHEN x.edit <> 'I' THEN r.role END AS role, CASE WHEN x.edit <> 'I' THEN r.text ELSE '' END AS text, x.nth,
    max(CASE WHEN x.edit = 'K' AND x.nth = 1 AND r.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY x.conv_id) AS sys
    FROM x LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM x.conv_id AND r.i = x.i WHERE x.edit <> 'D'),
w AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (nth - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY pos) AS said FROM y GROUP BY conv_id),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (prior IS NOT NULL AND prior || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT v.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    coalesce(z.best.cost, 0)::BIGINT AS cost, coalesce(z.best.audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM every v LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM v.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM v.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM v.conv_id
"""


@query(REPAIR_SQL)
def op13_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
