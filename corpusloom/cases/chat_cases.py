"""Conversations."""

from pyspark.sql import functions as F

from corpusloom.cases import case
from corpusloom.cases import sqltext as q
from corpusloom.operators import chat as ch
from corpusloom.plans.session import tables

T = q.strip("text")
TALK = f"tk AS (SELECT conv_id, turn, role, {T} AS x FROM conversations WHERE role IN ('user', 'assistant') AND {T} <> '')"


@case(
    "h01_normalize_history",
    f"WITH {TALK} SELECT conv_id, turn, role, md5(x) AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM tk) WHERE r <= 4",
)
def _(spark, sf):
    return ch.normalize_history(tables(spark, sf)("conversations"), 2).select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@case(
    "h02_followup_query",
    f"""WITH {TALK}, c AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
    p AS (SELECT c.conv_id, c.turn, any_value(c.text) AS t, arg_max(x, tk.turn) FILTER (role = 'user') AS u, arg_max(x, tk.turn) FILTER (role = 'assistant') AS a
        FROM c LEFT JOIN tk ON tk.conv_id = c.conv_id AND tk.turn < c.turn GROUP BY 1, 2)
    SELECT conv_id, turn, CASE WHEN u IS NULL AND a IS NULL THEN t ELSE concat_ws(chr(10), '上一轮问题：' || u, '上一轮回答：' || a, '当前追问：' || t) END AS query FROM p""",
)
def _(spark, sf):
    c = tables(spark, sf)("conversations")
    return ch.followup_query(c, c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query")))


@case(
    "h03_pair_turns",
    f"""WITH n AS (SELECT conv_id, turn, role, {T} AS u, lead(role) OVER w AS nr, lead({T}) OVER w AS a FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM n WHERE role = 'user' AND nr = 'assistant' AND u <> '' AND a <> '')
    SELECT conv_id, turn, md5(u) AS user_md5, md5(a) AS assistant_md5 FROM p WHERE r <= 3""",
)
def _(spark, sf):
    p = ch.pair_turns(tables(spark, sf)("conversations"), 3)
    return p.select("conv_id", "turn", F.md5("user").alias("user_md5"), F.md5("assistant").alias("assistant_md5"))


def _sessions(t):
    return t("conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select(
        "conv_id", F.col("conv_id").alias("ord"), F.concat(F.lit("talk "), "conv_id").alias("title"), (F.col("n") > 6).alias("manual_title")
    )


SESSIONS = f"""{TALK}, ss AS (SELECT conv_id, count(*) AS n, 'talk ' || conv_id AS own FROM conversations GROUP BY conv_id),
    ft AS (SELECT conv_id, substring(arg_min(x, turn), 1, 16) AS t FROM tk WHERE role = 'user' GROUP BY 1),
    st AS (SELECT conv_id, CASE WHEN n > 6 THEN own ELSE coalesce(t, '当前对话') END AS title FROM ss LEFT JOIN ft USING (conv_id))"""


@case(
    "h04_normalize_sessions",
    f"""WITH {SESSIONS} SELECT conv_id, title, (SELECT count(*) FROM conversations c WHERE c.conv_id = st.conv_id AND role IN ('user', 'assistant')) AS n_messages,
    conv_id = (SELECT min(conv_id) FROM conversations) AS active FROM st""",
)
def _(spark, sf):
    t = tables(spark, sf)
    return ch.normalize_sessions(_sessions(t), t("conversations"), "no such session").drop("ord")


BLANK = f"CASE WHEN {T} = '' THEN '（空）' ELSE {T} END"
NL2 = "chr(10) || chr(10)"


@case(
    "h05_render_transcript",
    f"""WITH {SESSIONS}, m AS (SELECT conv_id, turn, role, text, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) + (first(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'assistant')::INT AS no,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role IN ('user', 'assistant')),
    b AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN '## 第' || no || '轮' || {NL2} || '### 用户' || {NL2} || {BLANK} || {NL2}
        ELSE CASE WHEN k = 1 THEN '## 第1轮' || {NL2} ELSE '' END || '### 助手' || {NL2} || {BLANK} || {NL2} END AS x FROM m),
    full_ AS (SELECT conv_id, title, '# 历史对话导出' || {NL2} || '- datasource_id: ds' || chr(10) || '- 会话标题: ' || title || chr(10) || '- 导出时间: now' || {NL2} || string_agg(x, '' ORDER BY turn) AS t FROM b JOIN st USING (conv_id) GROUP BY 1, 2)
    SELECT conv_id, 0 AS part_no, md5({q.strip('t')} || chr(10)) AS markdown_md5 FROM full_""",
)
def _(spark, sf):
    t = tables(spark, sf)
    c = t("conversations")
    out = ch.render_transcript(c, ch.normalize_sessions(_sessions(t), c), "ds", "now")
    return out.select("conv_id", "part_no", F.md5("markdown").alias("markdown_md5"))


@case(
    "h05_render_answers",
    f"""WITH {SESSIONS}, m AS (SELECT conv_id, turn, role, text, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS u FROM conversations WHERE role IN ('user', 'assistant')),
    f AS (SELECT conv_id, turn, '# 单条回答导出' || {NL2} || '- datasource_id: ds' || chr(10) || '- 会话标题: ' || title || chr(10) || '- 导出时间: now' || {NL2}
        || CASE WHEN u IS NULL THEN '' ELSE '## 问题' || {NL2} || {q.strip('u')} || {NL2} END || '## 回答' || {NL2} || '### 助手' || {NL2} || {BLANK} || {NL2} AS t FROM m JOIN st USING (conv_id) WHERE role = 'assistant')
    SELECT conv_id, turn, md5({q.strip('t')} || chr(10)) AS markdown_md5 FROM f""",
)
def _(spark, sf):
    t = tables(spark, sf)
    c = t("conversations")
    out = ch.render_answers(c, ch.normalize_sessions(_sessions(t), c), "ds", "now")
    return out.select("conv_id", "turn", F.md5("markdown").alias("markdown_md5"))


@case(
    "h05_safe_file_name",
    f"""SELECT conv_id, turn, CASE WHEN s = '' THEN 'chat-session' ELSE s END AS name FROM (SELECT conv_id, turn, substring(regexp_replace(regexp_replace(regexp_replace({T}, '{q.W}+', '-', 'g'), '[\\\\/:*?"<>|]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g'), 1, 48) AS s FROM conversations)""",
)
def _(spark, sf):
    return tables(spark, sf)("conversations").select("conv_id", "turn", ch.safe_file_name(F.col("text")).alias("name"))


@case(
    "h06_message_sources",
    f"""WITH s AS (SELECT conv_id, turn, {q.squeeze('text')} AS b FROM conversations), l AS (SELECT *, CASE WHEN length(b) <= 500 THEN b ELSE rtrim(substring(b, 1, 500)) || '...' END AS c FROM s)
    SELECT conv_id, turn, md5('t p.' || turn || ': ' || c || '|' || c || '|only-title') AS sources_md5 FROM l WHERE b <> ''""",
)
def _(spark, sf):
    item = lambda title, page, raw, snip, sid: F.struct(
        title.alias("title"), page.alias("page"), raw.alias("raw"), snip.alias("snippet"), sid.alias("sourceId")
    )
    no = F.lit(None).cast("string")
    c = tables(spark, sf)("conversations")
    ev = F.array(
        item(F.lit("t"), F.col("turn").cast("string"), F.col("text"), F.lit("x"), no),
        item(no, no, F.lit("  "), F.col("text"), no),
        item(F.lit("only-title"), no, no, no, no),
        item(no, F.lit("9"), F.col("text"), no, F.lit("s")),
    )
    return c.where(~ch.tx.is_blank(F.col("text"))).select("conv_id", "turn", F.md5(F.array_join(ch.message_sources(ev), "|")).alias("sources_md5"))
