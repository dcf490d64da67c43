"""Conversations in long form: ``messages(conv_id, turn, role, text, …)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.plans.scan import neighbours, ordered_parts, prefix_scan, top_k

# fixed values: labels of follow-up queries and transcripts
LAST_QUESTION, LAST_ANSWER, CURRENT = "上一轮问题：", "上一轮回答：", "当前追问："
DEFAULT_TITLE, BLANK = "当前对话", "（空）"
ROLES = ("user", "assistant")


def _talk(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("role").isin(*ROLES))


def normalize_history(messages: DataFrame, turns: int = 3) -> DataFrame:
    """The last ``2 * turns`` non-blank user/assistant messages per conversation (0 keeps all)."""
    kept = _talk(messages).withColumn("text", tx.strip(tx.text_or_empty(F.col("text")))).where("text <> ''")
    if turns <= 0:
        return kept
    return top_k(kept, "conv_id", [F.desc("turn")], 2 * turns, "_r").drop("_r")


def followup_query(messages: DataFrame, current: DataFrame) -> DataFrame:
    """``current(conv_id, turn, query)`` with the last question and answer before that turn put in front."""
    m = _talk(messages).where(~tx.is_blank(F.col("text")))
    said = F.struct(F.col("turn").alias("t"), tx.strip(F.col("text")).alias("x"))
    rows = m.select(
        "conv_id", "turn", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("query"),
        F.when(F.col("role") == "user", said).alias("u"), F.when(F.col("role") == "assistant", said).alias("a"),
    )
    # a query sorts before the message of its own turn, so it sees earlier messages only
    asks = current.select("conv_id", "turn", F.lit(0).alias("kind"), "query")
    none = F.lit(None).cast(rows.schema["u"].dataType)
    both = rows.unionByName(asks.withColumns({"u": none, "a": none}))
    seen = prefix_scan(both, "conv_id", ["turn", "kind"], maxes={"lu": "u", "la": "a"}).where("kind = 0")
    parts = [
        F.when(F.col("lu.x").isNotNull(), F.concat(F.lit(LAST_QUESTION), F.col("lu.x"))),
        F.when(F.col("la.x").isNotNull(), F.concat(F.lit(LAST_ANSWER), F.col("la.x"))),
        F.concat(F.lit(CURRENT), "query"),
    ]
    alone = F.col("lu").isNull() & F.col("la").isNull()
    return seen.select("conv_id", "turn", F.when(alone, F.col("query")).otherwise(F.concat_ws("\n", *parts)).alias("query"))


def pair_turns(messages: DataFrame, last: int | None = None) -> DataFrame:
    """Adjacent user and assistant messages, both non-blank and without error; the last ``last`` pairs."""
    err = F.col("error") if "error" in messages.columns else F.lit(False)
    m = messages.select("conv_id", "turn", "role", "text", F.coalesce(err, F.lit(False)).alias("error"))
    nxt = neighbours(m, "conv_id", "turn", {"n_role": "role", "n_text": "text", "n_error": "error"}, 1)
    ok = (F.col("role") == "user") & (F.col("n_role") == "assistant") & ~F.col("n_error")
    pairs = nxt.where(ok & ~tx.is_blank(F.col("text")) & ~tx.is_blank(F.col("n_text"))).select(
        "conv_id", "turn", tx.strip(F.col("text")).alias("user"), tx.strip(F.col("n_text")).alias("assistant")
    )
    return pairs if last is None else top_k(pairs, "conv_id", [F.desc("turn")], last, "_r").drop("_r")


def normalize_sessions(sessions: DataFrame, messages: DataFrame, active: str | None = None) -> DataFrame:
    """``sessions(conv_id, ord, title, manual_title)`` with derived titles, message counts and the
    active mark (the first session if the given one does not exist)."""
    m = _talk(messages)
    first = m.where((F.col("role") == "user") & ~tx.is_blank(F.col("text"))).groupBy("conv_id").agg(
        F.substring(F.min_by(tx.strip(F.col("text")), "turn"), 1, 16).alias("_t")
    )
    counts = m.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages"))
    own = tx.strip(tx.text_or_empty(F.col("title")))
    own = F.when(own == "", F.lit(DEFAULT_TITLE)).otherwise(own)
    manual = F.coalesce("manual_title", F.lit(False))
    out = sessions.join(first, "conv_id", "left").join(counts, "conv_id", "left").select(
        "conv_id", "ord", F.when(manual, own).otherwise(F.coalesce("_t", F.lit(DEFAULT_TITLE))).alias("title"),
        F.coalesce("n_messages", F.lit(0)).alias("n_messages"),
    )
    known = active is not None and not sessions.where(F.col("conv_id").cast("string") == active).isEmpty()
    pick = sessions.where(F.col("conv_id").cast("string") == active) if known else sessions.orderBy("ord").limit(1)
    return out.join(pick.select("conv_id", F.lit(True).alias("active")), "conv_id", "left").withColumn(
        "active", F.coalesce("active", F.lit(False))
    )


def safe_file_name(c: Column) -> Column:
    n = F.regexp_replace(tx.strip(tx.text_or_empty(c)), f"{tx.WS}+", "-")
    n = F.regexp_replace(n, r'[\\/:*?"<>|]+', "-")
    n = F.substring(F.regexp_replace(n, r"^[-._]+|[-._]+$", ""), 1, 48)
    return F.when(n == "", F.lit("chat-session")).otherwise(n)


def message_sources(evidence: Column, context_sources: Column | None = None) -> Column:
    """Reference lines of a message from ``array<struct<title, page, raw, snippet, sourceId>>``."""

    def s(x: Column) -> Column:
        return tx.strip(tx.text_or_empty(x))

    def line(e: Column) -> Column:
        raw, snip = s(e["raw"]), s(e["snippet"])
        body = tx.squeeze(F.when(raw != "", raw).otherwise(snip))
        body = F.when(F.length(body) <= 500, body).otherwise(F.concat(F.rtrim(F.substring(body, 1, 500)), F.lit("...")))
        title, page, sid = s(e["title"]), s(e["page"]), s(e["sourceId"])
        label = F.when((title != "") & (page != ""), F.concat(title, F.lit(" p."), page)).otherwise(title)
        fallback = F.when(sid != "", sid).otherwise(title)
        return F.when((body != "") & (label != ""), F.concat(label, F.lit(": "), body)).when(body != "", body).otherwise(fallback)

    lines = F.array_distinct(F.filter(F.transform(evidence, line), lambda x: x != ""))
    other = F.filter(context_sources, lambda x: s(x) != "") if context_sources is not None else F.array().cast("array<string>")
    return F.when(evidence.isNotNull(), lines).otherwise(F.coalesce(other, F.array().cast("array<string>")))


def _or_blank(c: Column) -> Column:
    t = tx.strip(tx.text_or_empty(c))
    return F.when(t == "", F.lit(BLANK)).otherwise(t)


def _answer(text: Column, sources: Column) -> Column:
    refs = F.when(
        F.size(sources) > 0,
        F.concat(F.lit("#### 参考来源\n\n"), F.array_join(F.transform(sources, lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("\n\n")),
    ).otherwise(F.lit(""))
    return F.concat(F.lit("### 助手\n\n"), _or_blank(text), F.lit("\n\n"), refs)


def render_transcript(messages: DataFrame, titles: DataFrame, datasource_id: str, exported_at: str, part_rows: int = 1000) -> DataFrame:
    """Markdown per session ``(conv_id, part_no, file_name, markdown)``; very long sessions in parts.

    ``messages`` may have ``sources`` (array of reference lines); ``titles(conv_id, title)``.
    """
    m = _talk(messages)
    if "sources" not in m.columns:
        m = m.withColumn("sources", F.array().cast("array<string>"))
    early = m.groupBy("conv_id").agg((F.min_by("role", "turn") == "assistant").cast("int").alias("_early"), F.min("turn").alias("_first"))
    m = prefix_scan(m.withColumn("_u", (F.col("role") == "user").cast("int")), "conv_id", "turn", sums={"_users": "_u"}).join(early, "conv_id")
    no = (F.col("_users") + F.col("_early")).cast("string")
    head = F.concat(F.lit("## 第"), no, F.lit("轮\n\n"))
    user = F.concat(head, F.lit("### 用户\n\n"), _or_blank(F.col("text")), F.lit("\n\n"))
    lead = F.when((F.col("_early") == 1) & (F.col("turn") == F.col("_first")), head).otherwise(F.lit(""))
    block = F.when(F.col("role") == "user", user).otherwise(F.concat(lead, _answer(F.col("text"), F.col("sources"))))
    parts = ordered_parts(m.withColumn("block", block), "conv_id", "turn", "block", "blocks", part_rows)
    intro = _intro("# 历史对话导出", datasource_id, exported_at)
    name = F.concat(safe_file_name(F.col("title")), F.lit("__session_"), safe_file_name(F.col("conv_id").cast("string")), F.lit(".md"))
    body = F.concat(F.when(F.col("part_no") == 0, intro).otherwise(F.lit("")), F.array_join("blocks", ""))
    return parts.join(titles.select("conv_id", "title"), "conv_id").select(
        "conv_id", "part_no", name.alias("file_name"), F.concat(tx.strip(body), F.lit("\n")).alias("markdown")
    )


def _intro(head: str, datasource_id: str, exported_at: str) -> Column:
    return F.concat(
        F.lit(f"{head}\n\n- datasource_id: {datasource_id}\n- 会话标题: "), F.col("title"), F.lit(f"\n- 导出时间: {exported_at}\n\n")
    )


def render_answers(messages: DataFrame, titles: DataFrame, datasource_id: str, exported_at: str) -> DataFrame:
    """Markdown of every single answer with the question before it ``(conv_id, turn, markdown)``."""
    m = _talk(messages)
    if "sources" not in m.columns:
        m = m.withColumn("sources", F.array().cast("array<string>"))
    asked = m.withColumn("_q", F.when(F.col("role") == "user", F.struct("turn", "text")))
    seen = prefix_scan(asked, "conv_id", "turn", maxes={"_last": "_q"}).where("role = 'assistant'").join(titles.select("conv_id", "title"), "conv_id")
    question = F.when(F.col("_last").isNotNull(), F.concat(F.lit("## 问题\n\n"), _or_blank(F.col("_last.text")), F.lit("\n\n"))).otherwise(F.lit(""))
    text = F.concat(_intro("# 单条回答导出", datasource_id, exported_at), question, F.lit("## 回答\n\n"), _answer(F.col("text"), F.col("sources")))
    return seen.select("conv_id", "turn", F.concat(tx.strip(text), F.lit("\n")).alias("markdown"))
