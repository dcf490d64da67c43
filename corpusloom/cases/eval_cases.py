"""Evaluation analytics."""

from pyspark.sql import functions as F

from corpusloom.cases import case
from corpusloom.cases import sqltext as q
from corpusloom.cases import views as v
from corpusloom.cases.retrieval_cases import BM25, _bench, doc_chunks
from corpusloom.operators import evaluation as ev
from corpusloom.operators import lexical as lx
from corpusloom.plans.session import cut, tables

T = q.strip("text")


@case(
    "i01_question_ids",
    f"""SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'q' || item_id WHEN 1 THEN 'doc::r' || item_id || '::' || substring(md5({T}), 1, 8) WHEN 2 THEN 'question-' || substring(md5({T}), 1, 8) ELSE '<unknown>' END AS question_id FROM benchmark""",
)
def _(spark, sf):
    m = F.col("item_id") % 4
    b = tables(spark, sf)("benchmark")
    return b.select(
        "item_id",
        ev.question_id(
            F.when(m == 0, F.concat(F.lit(" q"), "item_id")), F.when(m == 1, F.concat(F.lit("doc::r"), "item_id", F.lit(" | note"))), F.when(m != 3, F.col("text"))
        ).alias("question_id"),
    )


@case(
    "i02_parse_evidence_ids",
    "SELECT p_partkey, 'd' || p_size || '::a|d' || p_size || '::b|x::' || p_partkey AS evidence_ids, 'r' || p_partkey || '|s' AS json_ids, 'k' || p_size || '|m' AS sep_ids FROM part",
)
def _(spark, sf):
    p = tables(spark, sf)("part")
    evd = F.concat(F.lit("d"), "p_size", F.lit("::a, b;x::"), "p_partkey", F.lit(" ,b | reason; c"))
    js = F.concat(F.lit('["r'), "p_partkey", F.lit('", " ", "s"]'))
    sep = F.concat(F.lit("k"), "p_size", F.lit(" <SEP> m<SEP>"))
    return p.select(
        "p_partkey", F.array_join(ev.parse_evidence_ids(evd), "|").alias("evidence_ids"), F.array_join(ev.parse_record_ids(js), "|").alias("json_ids"), F.array_join(ev.parse_record_ids(sep), "|").alias("sep_ids")
    )


@case(
    "i03_recall_rate",
    f"""WITH {BM25}, ex AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
    got AS (SELECT DISTINCT item_id, cid // 1000000 AS doc_id FROM bm)
    SELECT b.item_id AS query_id, coalesce(round_even(count(got.doc_id) / nullif(count(ex.doc_id), 0) * 100.0, 4), 0.0) AS recall
        FROM benchmark b LEFT JOIN ex USING (item_id) LEFT JOIN got ON got.item_id = ex.item_id AND got.doc_id = ex.doc_id GROUP BY 1""",
)
def _(spark, sf):
    from corpusloom.plans.textjoin import contained_pairs

    t = tables(spark, sf)
    b, d = t("benchmark"), t("documents")
    pairs = contained_pairs(b.select(F.col("text").alias("needle")), d.select("text"))
    truth = pairs.join(b.select("item_id", F.col("text").alias("needle")), "needle").join(d.select("doc_id", "text"), "text")
    expected = truth.select(F.col("item_id").alias("query_id"), F.concat(F.lit("doc::"), "doc_id").alias("id"))
    hits = lx.bm25_top_k(_bench(t), lx.bm25_index(doc_chunks(t)), 4)
    got = hits.select("query_id", F.concat(F.lit("chunk::"), F.floor(F.col("chunk_id") / 1000000)).alias("id"))
    return ev.recall_rate(expected, got, b.select(F.col("item_id").alias("query_id")))


@case(
    "i04_classify_errors",
    """SELECT event_id, CASE event_type WHEN 'error' THEN 'Timeout: read timed out ' || event_id WHEN 'click' THEN 'Server error: HTTP 502 bad: Server Error' WHEN 'view' THEN 'Benchmark error: view' END AS message FROM events""",
)
def _(spark, sf):
    raw = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("[ERROR] read timed out "), "event_id"))
        .when(F.col("event_type") == "click", F.lit("HTTP 502 bad: Server Error"))
        .when(F.col("event_type") == "view", F.lit(" [ERROR] view"))
        .otherwise(F.lit("an answer"))
    )
    return tables(spark, sf)("events").select("event_id", ev.classify_error(raw).alias("message"))


@case(
    "i05_response_time_ms",
    """SELECT event_id, CASE WHEN event_type = 'click' THEN round_even(value, 0) WHEN event_type = 'view' THEN round_even(value * 1000, 0) WHEN event_type = 'purchase' THEN 0 ELSE 1500 END::BIGINT AS ms FROM events""",
)
def _(spark, sf):
    e = F.col("event_type")
    val = F.col("value").cast("string")
    m = (
        F.when(e == "click", F.create_map(F.lit("elapsed_ms"), val, F.lit("full_s"), F.lit("9")))
        .when(e == "view", F.create_map(F.lit("full_ms"), F.lit("n/a"), F.lit("ttft_seconds"), val))
        .when(e == "purchase", F.create_map(F.lit("retrieval_ms"), F.lit("-5")))
    )
    m = F.coalesce(m, F.create_map(F.lit("other"), F.lit("1")))
    return tables(spark, sf)("events").select("event_id", ev.response_time_ms(m, F.lit(1.5)).alias("ms"))


@case(
    "i06_normalize_scores",
    """SELECT doc_id, CASE WHEN toxic = 1 THEN 0 ELSE quality END AS score, CASE WHEN toxic = 1 THEN '回避或不足' WHEN quality = 1 THEN '正确' ELSE '回避或不足' END AS label,
    CASE WHEN toxic = 1 THEN 'a=-1' ELSE 'a=-1|b=' || quality END AS modes FROM labels""",
)
def _(spark, sf):
    raw = F.when(F.col("toxic") == 1, F.lit("7")).otherwise(F.col("quality").cast("string"))
    s = ev.normalize_score(raw)
    modes = ev.normalize_mode_scores(F.create_map(F.lit("a"), F.lit("-1"), F.lit("b"), raw, F.lit("c"), F.lit("x")))
    shown = F.array_sort(F.transform(F.map_entries(modes), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    return tables(spark, sf)("labels").select("doc_id", s.alias("score"), ev.score_label(s).alias("label"), F.array_join(shown, "|").alias("modes"))


def results(t, *more):
    """Events as judged answers, long form: user = question, event type = mode; ``more`` columns follow."""
    e = t("events")
    whole = F.floor("value").cast("int")
    return e.select(
        F.col("user_id").cast("string").alias("question_id"), F.col("event_type").alias("mode"), F.col("event_id").alias("ord"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("[ERROR] timeout "), "event_id")).otherwise(F.concat(F.lit("answer "), "event_id")).alias("answer"),
        (F.pmod(whole, F.lit(3)) - 1).alias("score"), whole.cast("long").alias("rt_ms"), (F.pmod(whole, F.lit(5)) * 25.0).alias("recall"), *more,
    )


RES = """res AS (SELECT user_id::VARCHAR AS question_id, event_type AS mode, event_id AS ord, CASE WHEN event_type = 'error' THEN '[ERROR] timeout ' || event_id ELSE 'answer ' || event_id END AS answer,
    CAST(floor(value) AS INT) % 3 - 1 AS score, CAST(floor(value) AS BIGINT) AS rt_ms, (CAST(floor(value) AS INT) % 5) * 25.0 AS recall FROM events),
    lst AS (SELECT question_id, mode, min(ord) AS f, arg_max(answer, ord) AS answer, arg_max(score, ord) AS score, arg_max(rt_ms, ord) AS rt_ms, arg_max(recall, ord) AS recall FROM res GROUP BY 1, 2),
    nr AS (SELECT question_id, arg_min(mode, f) AS primary_mode FROM lst GROUP BY 1),
    norm AS (SELECT question_id, primary_mode, score AS raw_score, CASE WHEN primary_mode = 'error' THEN 'Timeout: timeout ' || substring(answer, 17) END AS error_message,
        CASE WHEN primary_mode = 'error' THEN '' ELSE answer END AS model_answer, rt_ms AS response_time_ms, recall AS primary_recall FROM nr JOIN lst USING (question_id) WHERE mode = primary_mode)"""


@case(
    "i07_normalize_results",
    f"""WITH {RES} SELECT question_id, primary_mode, raw_score, error_message, model_answer,
    (SELECT string_agg(mode || '=' || score, '|' ORDER BY mode) FROM lst WHERE lst.question_id = norm.question_id) AS scores FROM norm""",
)
def _(spark, sf):
    n = ev.normalize_results(results(tables(spark, sf)))
    shown = F.array_sort(F.transform(F.map_entries("mode_scores"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    return n.select("question_id", "primary_mode", "raw_score", "error_message", "model_answer", F.array_join(shown, "|").alias("scores"))


@case(
    "i08_summarize_results",
    f"""WITH {RES} SELECT greatest(count(*), 1000) AS total, count(*) AS completed, count(*) FILTER (raw_score = 1) AS correct_count, count(*) FILTER (raw_score = 0) AS partial_count,
    count(*) FILTER (raw_score = -1) AS wrong_count, round_even(avg(response_time_ms) FILTER (error_message IS NULL), 2) AS avg_response_time_ms, round_even(avg(primary_recall), 4) AS avg_recall_rate,
    round_even(count(*) FILTER (raw_score = 1) / count(*) * 100, 2) AS accuracy_percent FROM norm""",
)
def _(spark, sf):
    n = ev.normalize_results(results(tables(spark, sf)))
    n = n.withColumn("response_time_ms", F.try_element_at("mode_response_time_ms", F.col("primary_mode"))).withColumn(
        "primary_recall", F.try_element_at("mode_recall_rates", F.col("primary_mode"))
    )
    return ev.summarize_results(n, 1000)


@case(
    "i09_summarize_by_mode",
    f"""WITH {RES} SELECT mode, count(*) AS completed, count(*) FILTER (score = 1) AS correct_count, count(*) FILTER (score = 0) AS partial_count, count(*) FILTER (score = -1) AS wrong_count,
    round_even(count(*) FILTER (score = 1) / count(*) * 100, 2) AS accuracy_percent, round_even(avg(rt_ms), 2) AS avg_response_time_ms, round_even(avg(recall), 4)::DOUBLE AS avg_recall_rate FROM res GROUP BY mode""",
)
def _(spark, sf):
    return ev.summarize_by_mode(results(tables(spark, sf)))


def _judged(t):
    e = t("events")
    return e.select(F.col("user_id").alias("question"), F.col("event_type").alias("mode"), (F.pmod(F.floor("value").cast("int"), F.lit(4)) - 1).alias("score"))


@case("i10_resume_pending", "SELECT o_custkey AS question, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events) GROUP BY 1")
def _(spark, sf):
    t = tables(spark, sf)
    pending, _t = ev.resume_pending(t("orders").select(F.col("o_custkey").alias("question")), _judged(t))
    return pending.groupBy("question").agg(F.count(F.lit(1)).alias("n"))


@case(
    "i10_carried_tallies",
    "SELECT event_type AS mode, CAST(floor(value) AS INT) % 4 - 1 AS score, count(*) AS n FROM events WHERE CAST(floor(value) AS INT) % 4 - 1 IN (-1, 0, 1) GROUP BY 1, 2",
)
def _(spark, sf):
    t = tables(spark, sf)
    return ev.resume_pending(t("orders").select(F.col("o_custkey").alias("question")), _judged(t))[1]


@case(
    "i11_score_distribution",
    "SELECT lang, 'quality_Score' AS \"column\", quality AS value, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 3 UNION ALL SELECT lang, 'toxic_Score', toxic, count(*) FROM documents JOIN labels USING (doc_id) GROUP BY 1, 3",
)
def _(spark, sf):
    t = tables(spark, sf)
    wide = t("documents").join(t("labels"), "doc_id").select("lang", F.col("quality").alias("quality_Score"), F.col("toxic").alias("toxic_Score"))
    return ev.score_distribution(wide, ["lang"])


@case(
    "i12_mode_disagreements",
    'SELECT doc_id AS "Question", toxic AS wrong_score, substring(source, 1, 100) AS wrong_answer, substring(text, 1, 100) AS right_answer FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic <> 1',
)
def _(spark, sf):
    t = tables(spark, sf)
    wide = t("documents").join(t("labels"), "doc_id").select(
        F.col("doc_id").alias("Question"), F.col("quality").alias("text_only_Score"), F.col("text").alias("text_only_Answer"),
        F.col("toxic").alias("graph_text_hybrid_Score"), F.col("source").alias("graph_text_hybrid_Answer"),
    )
    return ev.mode_disagreements(wide)


J = "array_to_string({x}, '；') || '。'"
KEY = "doc_name || '::' || record_id"


@case(
    "i13_qa_candidates_single",
    f"""WITH {v.REC}, c AS (SELECT 'cause_explanation' AS category, equipment || '出现“' || fault || '”时，常见原因有哪些？' AS question, '常见原因包括：' || {J.format(x='causes')} AS a, doc_name, record_id FROM rec
    UNION ALL SELECT 'repair_method', equipment || '出现“' || fault || '”时，应如何处理？', '可按以下步骤处理：' || {J.format(x='actions')}, doc_name, record_id FROM rec
    UNION ALL SELECT 'key_components', '处理' || equipment || '的“' || fault || '”时，重点涉及哪些关键部件？', '重点涉及的关键部件包括：' || {J.format(x='causes[1:2]')}, doc_name, record_id FROM rec
    UNION ALL SELECT 'cause_to_fault', unnest(causes[1:2]) || '可能导致' || equipment || '出现什么故障？', '可能导致“' || fault || '”。', doc_name, record_id FROM rec)
    SELECT category, question, md5(a) AS answer_md5, {KEY} AS record_key FROM c""",
)
def _(spark, sf):
    c = ev.qa_candidates_single(v.records(tables(spark, sf)))
    return c.select("category", "question", F.md5("gold_answer").alias("answer_md5"), F.array_join("record_keys", "|").alias("record_key"))


# 300 pair numbers per equipment, spread over all pairs of its records
@case(
    "i14_qa_candidates_pairs",
    f"""WITH {v.REC}, o AS (SELECT equipment, fault, {KEY} AS k, row_number() OVER (PARTITION BY equipment ORDER BY fault, record_id, doc_name) - 1 AS pos FROM rec),
    t AS (SELECT equipment, count(*) * (count(*) - 1) // 2 AS n FROM o GROUP BY 1 HAVING count(*) > 1), a AS (SELECT equipment, unnest(range(least(300, n))) AS k, n FROM t),
    d AS (SELECT equipment, k * n // least(300, n) AS p FROM a)
    SELECT x.equipment || '中，“' || x.fault || '”与“' || y.fault || '”有什么区别？' AS question, x.k || '|' || y.k AS record_keys
    FROM o x JOIN o y ON x.equipment = y.equipment AND x.pos < y.pos JOIN d ON d.equipment = x.equipment AND d.p = y.pos * (y.pos - 1) // 2 + x.pos WHERE x.fault <> y.fault""",
)
def _(spark, sf):
    return ev.qa_candidates_pairs(v.records(tables(spark, sf)), per_equipment=300).select("question", F.array_join("record_keys", "|").alias("record_keys"))


@case(
    "i15_qa_candidates_common",
    f"""WITH {v.REC}, f AS (SELECT equipment, fault, min(record_id || '/' || doc_name) AS r FROM rec GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY equipment ORDER BY r) AS k FROM f QUALIFY k <= 4)
    SELECT equipment || '有什么常见故障？' AS question, '常见故障包括：' || string_agg(fault, '；' ORDER BY k) || '。' AS gold_answer, string_agg(split_part(r, '/', 2) || '::' || split_part(r, '/', 1), '|' ORDER BY k) AS record_keys FROM t GROUP BY equipment HAVING count(*) >= 2""",
)
def _(spark, sf):
    return ev.qa_candidates_common(v.records(tables(spark, sf))).select("question", "gold_answer", F.array_join("record_keys", "|").alias("record_keys"))


@case("i16_select_balanced", None)
def _(spark, sf):
    r = cut(v.records(tables(spark, sf)))
    c = ev.qa_candidates_single(r).unionByName(ev.qa_candidates_pairs(r, per_equipment=300)).unionByName(ev.qa_candidates_pairs(r, "similar_faults", per_equipment=300)).unionByName(ev.qa_candidates_common(r))
    have = {k: n for k, n in ev.CATEGORY_TARGETS.items() if k not in ("maintenance", "precaution", "consequence")}
    return ev.select_balanced(cut(c), have).select("category", "question", "gold_answer", F.array_join("record_keys", "|").alias("record_keys"))


WORDS = (("precautions", ("heren", "que ")), ("consequences", ("tion",)), ("repair_method", ("ing",)))


@case(
    "i17_classify_question_type",
    """SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'given' WHEN contains(text, 'heren') OR contains(text, 'que ') THEN 'precautions' WHEN contains(text, 'tion') THEN 'consequences'
    WHEN contains(text, 'ing') THEN 'repair_method' ELSE 'cause_explanation' END AS type FROM conversations""",
)
def _(spark, sf):
    c = tables(spark, sf)("conversations")
    given = F.when(F.col("role") == "assistant", F.lit(" given ")).otherwise(F.lit("Single"))
    return c.select("conv_id", "turn", ev.classify_question_type(given, F.col("text"), WORDS).alias("type"))


@case(
    "i17_quota_fill",
    f"""WITH {v.REC}, o AS (SELECT *, row_number() OVER (ORDER BY ord) AS k FROM rec), s AS (SELECT k, doc_name, record_id, unnest(['cause_explanation', 'repair_method', 'key_components']) AS type, unnest([1, 2, 3]) AS j FROM o)
    SELECT doc_name || '::' || record_id || ' | 依据原始表述整理。' AS evidence, type FROM s
    WHERE (k <= 10) OR (k BETWEEN 11 AND 25 AND j > 1) OR (k BETWEEN 26 AND 50 AND j = 3)
    UNION ALL SELECT doc_name || '::' || record_id || ' | 依据原始表述整理。', 'repair_method' FROM o WHERE k <= 12""",
)
def _(spark, sf):
    return ev.quota_fill(v.records(tables(spark, sf))).select("evidence", "type")


@case(
    "i18_repair_evidence_ids",
    """WITH u AS (SELECT source, text, count(*) AS n, min(doc_id) AS m FROM documents GROUP BY 1, 2)
    SELECT d.doc_id AS row_id, CASE WHEN d.doc_id IN (SELECT doc_id FROM labels) THEN d.source || '::' || 'r' || d.doc_id ELSE d.source || '::r' || m || ' | x' END AS evidence
    FROM documents d JOIN u USING (source, text) WHERE d.doc_id IN (SELECT doc_id FROM labels) OR n = 1""",
)
def _(spark, sf):
    t = tables(spark, sf)
    d = t("documents").join(t("labels").select("doc_id", F.lit(True).alias("known")), "doc_id", "left")
    evd = F.when(F.col("known"), F.concat("source", F.lit("::r"), "doc_id")).otherwise(F.concat("source", F.lit("::unknown_id | x")))
    rows = d.select(F.col("doc_id").alias("row_id"), evd.alias("evidence"), F.lit("k").alias("type"), F.md5("text").alias("gold_answer"))
    ans = t("documents").select(F.col("source").alias("doc_name"), F.lit("k").alias("type"), F.md5("text").alias("answer"), F.concat(F.lit("r"), "doc_id").alias("record_id"))
    return ev.repair_evidence_ids(rows, ans)[0].select("row_id", "evidence")


@case(
    "i19_latency_rollup",
    """SELECT user_id AS request_id, max(event_id) - min(event_id) AS full_ms, count(*) AS n_chunks, sum(length(props)) AS n_chars, count(*) > 1 AS is_streaming FROM events GROUP BY 1""",
)
def _(spark, sf):
    e = tables(spark, sf)("events").select(F.col("user_id").alias("request_id"), F.col("event_id").alias("started_ms"), F.col("event_id").alias("at_ms"), F.col("props").alias("text"))
    return ev.latency_rollup(e).drop("first_ms")


MOVES = {"idle": ("view",), "view": ("view", "click", "error"), "click": ("purchase", "view"), "purchase": ("view",), "error": ("view", "click"), "signup": ("view",)}
MOVE_SQL = ", ".join(f"'{a}>{b}'" for a, bs in MOVES.items() for b in bs)


@case(
    "i20_validate_transitions",
    f"""SELECT run_id, seq, before, before || '>' || state IN ({MOVE_SQL}) AS is_valid FROM (SELECT user_id AS run_id, event_id AS seq, event_type AS state, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), 'idle') AS before FROM events)""",
)
def _(spark, sf):
    log = tables(spark, sf)("events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("state"))
    return ev.validate_transitions(log, MOVES).select("run_id", "seq", "before", "is_valid")


@case(
    "i20_run_snapshot",
    """SELECT user_id AS run_id, arg_max(event_type, event_id) AS state, max(floor(value))::BIGINT AS done, 100 AS total, round_even(least(max(floor(value)) / 100, 1.0) * 100, 2) AS progress_percent, arg_max(event_type, event_id) IN ('error', 'purchase') AS is_terminal FROM events GROUP BY 1""",
)
def _(spark, sf):
    e = tables(spark, sf)("events")
    log = e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("state"), F.floor("value").alias("done"))
    totals = e.select(F.col("user_id").alias("run_id"), F.lit(100).alias("total")).distinct()
    return ev.run_snapshot(log, totals, ("error", "purchase"))
