"""Evaluation analytics: question ids, recall, scores, summaries and question sets."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.plans.scan import neighbours, prefix_scan, top_k
from corpusloom.plans.session import cut

# fixed values: score labels, preferred mode, error patterns, timing keys
SCORE_LABELS = {1: "正确", 0: "回避或不足", -1: "错误"}
HYBRID = "graph_text_hybrid"
ERROR_PREFIX = "[ERROR]"
TIMEOUT_RX = r"(?i)read timed out|timed out|timeout"
SERVER_ERROR_RX = r"(?i)\b5\d\d\b.*server error"
MS_KEYS = ("response_time_ms", "elapsed_ms", "full_ms")
S_KEYS = ("full_s", "full_seconds", "ttft_total_s", "ttft_seconds", "elapsed_seconds", "ttft_generation_only_s")
# fixed values: question categories and targets, caps per record and document
CATEGORY_TARGETS = {
    "cause_explanation": 55,
    "repair_method": 45,
    "maintenance": 20,
    "precaution": 10,
    "consequence": 10,
    "key_components": 15,
    "cause_to_fault": 25,
    "fault_distinction": 8,
    "similar_faults": 7,
    "common_faults": 5,
}
RECORD_CAP = 3
DOC_CAPS = (40, 45, 50, 55, None)
# fixed values: question type rules in order, default and quotas of the rebuilt set
TYPE_RULES = (
    ("precautions", ("注意什么", "应注意什么", "注意事项", "为防止", "为了避免", "为避免", "必须遵守")),
    ("consequences", ("后果", "影响", "会带来什么", "会导致什么问题", "会导致什么故障")),
    ("repair_method", ("如何", "怎样", "怎么", "应先", "应如何", "如何检修", "如何检查", "如何处理", "排查", "检修", "处理方法", "判断故障")),
    ("key_components", ("哪些部件", "哪些单元", "哪些环节", "哪些故障方向", "故障点", "控制量", "器件问题", "参数一致性", "核心部件")),
)
DEFAULT_TYPE = "cause_explanation"
QUOTAS = (("causes", "cause_explanation", 30), ("actions", "repair_method", 60), ("precautions", "precautions", 70), ("key_components", "key_components", 85), ("consequences", "consequences", 97))
# fixed values: lifecycle moves
TRANSITIONS = {
    "idle": ("starting",),
    "starting": ("running", "failed"),
    "running": ("stopping", "completed", "failed"),
    "stopping": ("stopped", "failed"),
    "stopped": ("idle", "starting"),
    "completed": ("idle", "starting"),
    "failed": ("idle", "starting"),
}


def _s(c: Column) -> Column:
    return tx.strip(tx.text_or_empty(c))


# --- ids and recall --------------------------------------------------------------------------------


def question_id(explicit: Column, evidence: Column, question: Column) -> Column:
    digest = F.substring(F.md5(_s(question)), 1, 8)
    has_q = _s(question) != ""
    head = _s(F.get(F.split(_s(evidence), r"\|"), F.lit(0)))
    return (
        F.when(_s(explicit) != "", _s(explicit))
        .when((head != "") & has_q, F.concat(head, F.lit("::"), digest))
        .when(head != "", head)
        .when(has_q, F.concat(F.lit("question-"), digest))
        .otherwise(F.lit("<unknown>"))
    )


def parse_evidence_ids(evidence: Column) -> Column:
    """Distinct record ids of an evidence text; ids without document take the one of the first."""
    head = _s(F.get(F.split(_s(evidence), r"\|"), F.lit(0)))
    doc = F.when(F.instr(head, "::") > 0, _s(F.get(F.split(head, "::"), F.lit(0)))).otherwise(F.lit(""))
    parts = F.filter(F.transform(F.split(head, "[;,]"), tx.strip), lambda p: p != "")
    return F.array_distinct(
        F.transform(parts, lambda p: F.when((F.instr(p, "::") == 0) & (doc != ""), F.concat(doc, F.lit("::"), p)).otherwise(p))
    )


def parse_record_ids(raw: Column) -> Column:
    """Ids from a JSON array or a ``<SEP>``-joined text."""
    v = _s(raw)
    listed = F.from_json(v, "array<string>")
    return F.when(v.startswith("["), F.when(listed.isNull(), F.array(v)).otherwise(tx.clean_list(listed))).otherwise(tx.split_markers(v, [tx.SEP]))


def recall_rate(expected: DataFrame, retrieved: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, recall)`` in percent for each of ``queries(query_id)`` from long ``expected(query_id, id)`` and
    ``retrieved(query_id, id)``; a query without expected ids has 0.

    An expected id is hit if it or its tail after the last ``::`` matches a retrieved id or tail.
    """

    def keyed(df: DataFrame) -> DataFrame:
        i = _s(F.col("id"))
        tail = F.element_at(F.split(i, "::"), -1)
        return df.select("query_id", i.alias("id"), F.explode(F.array_distinct(F.array(i, tail))).alias("key")).where("id <> ''")

    e = expected.where(_s(F.col("id")) != "")
    hits = keyed(expected).join(keyed(retrieved).select("query_id", "key").distinct(), ["query_id", "key"], "left_semi")
    hits = hits.select("query_id", "id").distinct().withColumn("_hit", F.lit(1))
    per = e.select("query_id", _s(F.col("id")).alias("id")).join(hits, ["query_id", "id"], "left")
    rates = per.groupBy("query_id").agg(F.bround(F.count("_hit") / F.count(F.lit(1)) * 100.0, 4).alias("recall"))
    return queries.select("query_id").distinct().join(rates, "query_id", "left").select("query_id", F.coalesce("recall", F.lit(0.0)).alias("recall"))


# --- scores and results ------------------------------------------------------------------------------


def classify_error(raw: Column) -> Column:
    """Error message of an answer text, null if it is none."""
    t = _s(raw)
    body = F.when(t.startswith(ERROR_PREFIX), tx.strip(F.regexp_replace(t, r"^\[ERROR\]", ""))).otherwise(t)
    return (
        F.when(body.rlike(TIMEOUT_RX), F.concat(F.lit("Timeout: "), body))
        .when(body.rlike(SERVER_ERROR_RX), F.concat(F.lit("Server error: "), body))
        .when(t.startswith(ERROR_PREFIX), F.concat(F.lit("Benchmark error: "), body))
    )


def response_time_ms(metrics: Column, elapsed_s: Column | None = None) -> Column:
    """First usable timing of a ``map<string,string>``: ms keys, s keys, retrieval_ms, elapsed; else 0."""

    def num(key: str, factor: float) -> Column:
        v = F.try_element_at(metrics, F.lit(key)).try_cast("double")
        return F.greatest(F.lit(0), F.bround(v * factor).cast("long"))

    # greatest skips nulls, so a missing key must stay null explicitly
    def usable(key: str, factor: float) -> Column:
        v = F.try_element_at(metrics, F.lit(key)).try_cast("double")
        return F.when(v.isNotNull(), num(key, factor))

    picks = [usable(k, 1.0) for k in MS_KEYS] + [usable(k, 1000.0) for k in S_KEYS] + [usable("retrieval_ms", 1.0)]
    if elapsed_s is not None:
        picks.append(F.when(elapsed_s.isNotNull(), F.greatest(F.lit(0), F.bround(elapsed_s * 1000).cast("long"))))
    return F.coalesce(*picks, F.lit(0).cast("long"))


def normalize_score(raw: Column) -> Column:
    """Judge score: an integer in -1, 0, 1, everything else 0."""
    n = raw.try_cast("int")
    return F.when(n.isin(-1, 0, 1), n).otherwise(F.lit(0))


def normalize_mode_scores(scores: Column) -> Column:
    """Map of mode to score without the invalid entries."""
    return F.map_filter(F.transform_values(scores, lambda _k, v: v.try_cast("int")), lambda _k, v: v.isin(-1, 0, 1))


def score_label(score: Column) -> Column:
    out = F.lit(None).cast("string")
    for value, label in SCORE_LABELS.items():
        out = F.when(score == value, F.lit(label)).otherwise(out)
    return out


def score_violations(results: DataFrame) -> DataFrame:
    """Rows without score and without error."""
    return results.where(F.col("raw_score").isNull() & F.col("error_message").isNull()).select(
        "question_id", F.lit("successful row is missing a judged score").alias("violation")
    )


def normalize_results(long: DataFrame) -> DataFrame:
    """One row per question from ``long(question_id, mode, ord, answer, score, rt_ms, recall)``: maps per
    mode, primary mode (hybrid, else the first scored), its answer, score, label and error.

    Modes are few; the maps hold one entry per mode (the latest).
    """
    valid = F.when(F.col("score").isin(-1, 0, 1), F.col("score"))
    per = long.groupBy("question_id", "mode").agg(
        F.max_by(F.struct("answer", valid.alias("score"), "rt_ms", "recall"), "ord").alias("r"), F.min("ord").alias("first")
    )

    def as_map(field: str) -> Column:
        e = F.when(F.col(f"r.{field}").isNotNull(), F.struct("mode", F.col(f"r.{field}").alias("v")))
        return F.map_from_entries(F.sort_array(F.collect_list(e)))

    scored = F.when(F.col("r.score").isNotNull(), F.col("first"))
    g = per.groupBy("question_id").agg(
        as_map("answer").alias("mode_answers"), as_map("score").alias("mode_scores"), as_map("rt_ms").alias("mode_response_time_ms"),
        as_map("recall").alias("mode_recall_rates"), F.min_by("mode", scored).alias("_first"),
    )
    g = g.withColumn("primary_mode", F.when(F.map_contains_key("mode_scores", F.lit(HYBRID)), F.lit(HYBRID)).otherwise(F.col("_first")))
    raw = F.coalesce(F.try_element_at("mode_answers", F.col("primary_mode")), F.lit(""))
    g = g.withColumn("error_message", classify_error(raw)).withColumn(
        "model_answer", F.when(F.col("error_message").isNotNull(), F.lit("")).otherwise(raw)
    )
    g = g.withColumn(
        "raw_score", F.coalesce(F.try_element_at("mode_scores", F.col("primary_mode")), F.when(F.col("error_message").isNotNull(), F.lit(-1)))
    )
    return g.withColumn("status_label", score_label(F.col("raw_score"))).drop("_first")


def summarize_results(results: DataFrame, declared: int | None = None) -> DataFrame:
    """One row: totals, accuracy, mean response time of rows without error, mean primary recall."""
    n = F.count(F.lit(1))
    out = results.agg(
        F.greatest(n, F.lit(declared or 0)).alias("total"),
        n.alias("completed"),
        F.count_if(F.col("raw_score") == 1).alias("correct_count"),
        F.count_if(F.col("raw_score") == 0).alias("partial_count"),
        F.count_if(F.col("raw_score") == -1).alias("wrong_count"),
        F.coalesce(F.bround(F.avg(F.when(F.col("error_message").isNull(), F.col("response_time_ms"))), 2), F.lit(0.0)).alias("avg_response_time_ms"),
        F.coalesce(F.bround(F.avg("primary_recall"), 4), F.lit(0.0)).alias("avg_recall_rate"),
    )
    return out.withColumn("accuracy_percent", F.coalesce(F.bround(F.col("correct_count") / F.nullif(F.col("completed"), F.lit(0)) * 100, 2), F.lit(0.0)))


def mode_aggregates() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("completed"),
        F.count_if(F.col("score") == 1).alias("correct_count"),
        F.count_if(F.col("score") == 0).alias("partial_count"),
        F.count_if(F.col("score") == -1).alias("wrong_count"),
        F.bround(F.count_if(F.col("score") == 1) / F.count(F.lit(1)) * 100, 2).alias("accuracy_percent"),
        F.coalesce(F.bround(F.avg(F.when(F.col("rt_ms") >= 0, F.col("rt_ms"))), 2), F.lit(0.0)).alias("avg_response_time_ms"),
        F.coalesce(F.bround(F.avg("recall"), 4), F.lit(0.0)).alias("avg_recall_rate"),
    ]


def summarize_by_mode(long: DataFrame) -> DataFrame:
    """Per mode, over the rows that have a score."""
    return long.where(F.col("score").isNotNull()).groupBy("mode").agg(*mode_aggregates())


def resume_pending(questions: DataFrame, judged: DataFrame, key: str = "question") -> tuple[DataFrame, DataFrame]:
    """Questions not judged yet, and the tallies of the carried-over rows per mode and score."""
    pending = questions.join(judged.select(key), key, "left_anti")
    tallies = judged.where(F.col("score").isin(-1, 0, 1)).groupBy("mode", "score").agg(F.count(F.lit(1)).alias("n"))
    return pending, tallies


def score_distribution(wide: DataFrame, keys: Sequence[str] = (), suffixes: Sequence[str] = ("_Score", "_score")) -> DataFrame:
    """Value counts of every score column, per ``keys`` (for example the file)."""
    cols = [c for c in wide.columns if c.endswith(tuple(suffixes))]
    return wide.unpivot(list(keys), cols, "column", "value").where("value IS NOT NULL").groupBy(*keys, "column", "value").agg(F.count(F.lit(1)).alias("n"))


def mode_disagreements(wide: DataFrame, right: str = "text_only", wrong: str = HYBRID) -> DataFrame:
    """Questions that one mode answers and the other does not, answers cut to 100 characters."""
    miss = (F.col(f"{wrong}_Score") != 1) | F.col(f"{wrong}_Score").isNull()
    return wide.where((F.col(f"{right}_Score") == 1) & miss).select(
        "Question", F.col(f"{wrong}_Score").alias("wrong_score"), F.substring(f"{wrong}_Answer", 1, 100).alias("wrong_answer"),
        F.substring(f"{right}_Answer", 1, 100).alias("right_answer"),
    )


# --- question candidates -------------------------------------------------------------------------------


def _joined(items: Column) -> Column:
    return F.concat(F.array_join(F.transform(items, lambda x: F.regexp_replace(x, "。+$", "")), "；"), F.lit("。"))


def _evidence(doc: Column, rid: Column) -> Column:
    return F.concat(doc, F.lit("::"), rid, F.lit(" | 依据 "), rid, F.lit(" 对应故障卡与原始表述整理。"))


def qa_candidates_single(records: DataFrame) -> DataFrame:
    """Question candidates of every record ``(category, question, gold_answer, evidence, docs, record_keys)``."""
    e, f = F.col("equipment"), F.col("fault")
    causes, actions, cautions, effects, parts = (tx.clean_list(F.col(c)) for c in ("causes", "actions", "precautions", "consequences", "key_components"))

    def q(category: str, test: Column, question: list, answer: Column) -> Column:
        text = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in question])
        return F.when(test, F.struct(F.lit(category).alias("category"), text.alias("question"), answer.alias("gold_answer")))

    def bullet(prefix: str, items: Column) -> Column:
        return F.concat(F.lit(prefix), _joined(items))

    care = F.concat(cautions, F.filter(F.slice(actions, 1, 2), lambda a: ~F.array_contains(cautions, a)))
    has = lambda a: F.size(a) > 0
    one = [
        q("cause_explanation", has(causes), [e, "出现“", f, "”时，常见原因有哪些？"], bullet("常见原因包括：", causes)),
        q("repair_method", has(actions), [e, "出现“", f, "”时，应如何处理？"], bullet("可按以下步骤处理：", actions)),
        q("maintenance", has(cautions), ["平时维护", e, "时，为避免“", f, "”，应注意什么？"], bullet("维护时应注意：", care)),
        q("precaution", has(cautions), ["处理", e, "的“", f, "”时，有哪些注意事项？"], bullet("注意事项包括：", cautions)),
        q("consequence", has(effects), [e, "出现“", f, "”后，可能造成什么后果？"], bullet("可能造成的后果包括：", effects)),
        q("key_components", has(parts), ["处理", e, "的“", f, "”时，重点涉及哪些关键部件？"], bullet("重点涉及的关键部件包括：", parts)),
    ]
    back = F.transform(
        F.slice(causes, 1, 2),
        lambda c: F.struct(
            F.lit("cause_to_fault").alias("category"), F.concat(c, F.lit("可能导致"), e, F.lit("出现什么故障？")).alias("question"),
            F.concat(F.lit("可能导致“"), f, F.lit("”。")).alias("gold_answer"),
        ),
    )
    return records.select("doc_name", "record_id", F.explode(F.concat(F.array_compact(F.array(*one)), back)).alias("x")).select(
        "x.*", _evidence(F.col("doc_name"), F.col("record_id")).alias("evidence"), F.array("doc_name").alias("docs"),
        F.array(F.concat_ws("::", "doc_name", "record_id")).alias("record_keys"),
    )


def record_summary() -> Column:
    """Short text of a record: symptom, two causes, two actions."""
    sym = tx.text_or_empty(F.col("symptom"))
    c, a = F.slice(tx.clean_list(F.col("causes")), 1, 2), F.slice(tx.clean_list(F.col("actions")), 1, 2)
    cut_ = lambda x: F.regexp_replace(x, "。+$", "")
    parts = [
        F.when(sym != "", F.concat(F.lit("表现偏向“"), cut_(sym), F.lit("”"))),
        F.when(F.size(c) > 0, F.concat(F.lit("常见原因包括"), cut_(_joined(c)))),
        F.when(F.size(a) > 0, F.concat(F.lit("处理时可先"), cut_(_joined(a)))),
    ]
    return F.concat(F.concat_ws("；", *parts), F.lit("。"))


def pair_order(records: DataFrame) -> DataFrame:
    """``(equipment, pos, fault, doc_name, record_id, summary)``: an equipment's records from 0, by (fault, record).

    It stands for all pairs of an equipment without storing one: the records at places i < j are pair number
    j * (j - 1) / 2 + i, so n records have the numbers from 0 to n * (n - 1) / 2 - 1.
    """
    some = records.select("equipment", "fault", "record_id", "doc_name", record_summary().alias("summary"))
    numbered = prefix_scan(some, "equipment", ["fault", "record_id", "doc_name"], row_number="pos")
    return numbered.withColumn("pos", F.col("pos") - 1)


def _pairs_of(n: Column) -> Column:
    return F.call_function("div", n * (n - 1), F.lit(2))


def drawn_pairs(order: DataFrame, per_equipment: int) -> DataFrame:
    """``(equipment, p)``: pair numbers spread evenly over all pairs of each equipment, all of them if there are fewer."""
    size = order.groupBy("equipment").agg(F.count(F.lit(1)).alias("n")).select("equipment", _pairs_of(F.col("n")).alias("all")).where("all > 0")
    size = size.withColumn("m", F.least(F.lit(per_equipment).cast("long"), F.col("all")))
    k = size.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    return k.select("equipment", F.expr("k * (all div m) + (k * (all % m)) div m").alias("p"))


def pairs_at(order: DataFrame, numbers: DataFrame) -> DataFrame:
    """The two records of each asked pair ``numbers(equipment, p)``; the second one's columns begin with ``n_``.

    Numbers are turned back into places by a square root, corrected where rounding missed by one; the join is by equipment
    and place, so that a large equipment is spread over tasks.
    """
    near = F.floor((F.sqrt(F.col("p") * 8.0 + 1) + 1) / 2).cast("long")
    asked = numbers.withColumn("j", near)
    j = F.when(_pairs_of(F.col("j")) > F.col("p"), F.col("j") - 1).when(_pairs_of(F.col("j") + 1) <= F.col("p"), F.col("j") + 1).otherwise(F.col("j"))
    asked = asked.withColumn("j", j).select("equipment", (F.col("p") - _pairs_of(F.col("j"))).alias("pos"), F.col("j").alias("n_pos"))
    second = order.select("equipment", *[F.col(c).alias(f"n_{c}") for c in ("pos", "fault", "doc_name", "record_id", "summary")])
    return asked.join(order, ["equipment", "pos"]).join(second, ["equipment", "n_pos"])


def _every_pair(order: DataFrame) -> DataFrame:
    """All pair numbers, a row of records at a time."""
    return order.where("pos > 0").select("equipment", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pos") - 1)).alias("i"), "pos").select("equipment", (_pairs_of(F.col("pos")) + F.col("i")).alias("p"))


def qa_candidates_pairs(records: DataFrame, category: str = "fault_distinction", per_equipment: int | None = None) -> DataFrame:
    """Distinction questions for pairs of records of one equipment with different faults, the earlier one by (fault, record)
    first.

    Every pair can be asked for (``pairs_at``). By default all are rendered, which is as many rows as there are pairs; with
    ``per_equipment`` only so many pair numbers, spread evenly, are turned into questions, as a question set needs.
    """
    order = cut(pair_order(records))
    numbers = _every_pair(order) if per_equipment is None else drawn_pairs(order, per_equipment)
    pairs = pairs_at(order, numbers).where("fault <> n_fault")
    e, a, b = F.col("equipment"), F.col("fault"), F.col("n_fault")

    def text(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    if category == "fault_distinction":
        question, lead = text(e, "中，“", a, "”与“", b, "”有什么区别？"), "主要区别如下："
    else:
        question, lead = text("排查", e, "时，“", a, "”和“", b, "”容易混淆，应重点看哪些区别？"), "区分时可重点看："
    answer = text(lead, "“", a, "”", F.col("summary"), "“", b, "”", F.col("n_summary"))
    proof = text(F.concat_ws("::", "doc_name", "record_id"), "; ", F.concat_ws("::", "n_doc_name", "n_record_id"), " | 依据 ", F.col("record_id"), ",", F.col("n_record_id"), " 对应故障卡与原始表述整理。")
    return pairs.select(
        F.lit(category).alias("category"), question.alias("question"), answer.alias("gold_answer"), proof.alias("evidence"),
        F.array("doc_name", "n_doc_name").alias("docs"), F.array(F.concat_ws("::", "doc_name", "record_id"), F.concat_ws("::", "n_doc_name", "n_record_id")).alias("record_keys"),
    )


def qa_candidates_common(records: DataFrame) -> DataFrame:
    """Common-fault questions of equipment with at least two faults: its first four by record id."""
    firsts = records.groupBy("equipment", "fault").agg(F.min(F.struct("record_id", "doc_name")).alias("r"))
    few = top_k(firsts, "equipment", [F.col("r")], 4)
    g = few.groupBy("equipment").agg(F.sort_array(F.collect_list(F.struct("rank", "fault", "r"))).alias("x")).where(F.size("x") >= 2)
    docs = F.array_sort(F.array_distinct(F.col("x.r.doc_name")))
    per_doc = F.transform(
        docs,
        lambda d: F.concat(d, F.lit("::"), F.array_join(F.transform(F.filter("x", lambda i: i["r"]["doc_name"] == d), lambda i: i["r"]["record_id"]), ",")),
    )
    ids = F.flatten(F.transform(docs, lambda d: F.transform(F.filter("x", lambda i: i["r"]["doc_name"] == d), lambda i: i["r"]["record_id"])))
    return g.select(
        F.lit("common_faults").alias("category"), F.concat("equipment", F.lit("有什么常见故障？")).alias("question"),
        F.concat(F.lit("常见故障包括："), _joined(F.col("x.fault"))).alias("gold_answer"),
        F.concat(F.array_join(per_doc, "; "), F.lit(" | 依据 "), F.array_join(ids, ","), F.lit(" 对应故障卡与原始表述整理。")).alias("evidence"),
        docs.alias("docs"), F.transform("x", lambda i: F.concat(i["r"]["doc_name"], F.lit("::"), i["r"]["record_id"])).alias("record_keys"),
    )


def select_balanced(candidates: DataFrame, targets: Mapping[str, int] = CATEGORY_TARGETS, record_cap: int = RECORD_CAP, doc_caps: Sequence[int | None] = DOC_CAPS) -> DataFrame:
    """A question set with ``targets`` per category, least-used documents and records first, questions
    unique, records and documents capped; the first document cap that works is used.

    The greedy choice reads the ordered candidates in short batches (a top-n each) and excludes what is
    already full before the next batch, so that only rows near the chosen ones reach the driver.
    """
    spark = candidates.sparkSession
    schema = candidates.select("category", "question", "gold_answer", "evidence", "docs", "record_keys").schema
    for cap in doc_caps:
        chosen = _choose(candidates, targets, record_cap, cap)
        if chosen is not None:
            return spark.createDataFrame(chosen, schema)
    raise RuntimeError("no document cap allows the question set")


def _choose(candidates: DataFrame, targets: Mapping[str, int], record_cap: int, doc_cap: int | None):
    docs: dict[str, int] = {}
    recs: dict[str, int] = {}
    asked: set[str] = set()
    out = []
    for category, target in targets.items():
        pool = candidates.where(F.col("category") == category)

        def load(col: str, table: dict[str, int]) -> Column:
            if not table:
                return F.transform(col, lambda _x: F.lit(0))
            m = F.create_map(*[F.lit(v) for kv in sorted(table.items()) for v in kv])
            return F.transform(col, lambda x: F.coalesce(F.try_element_at(m, x), F.lit(0)))

        dl, rl = load("docs", docs), load("record_keys", recs)
        key = F.struct(
            F.array_max(dl).alias("a"), F.aggregate(dl, F.lit(0), lambda s, x: s + x).alias("b"), F.array_max(rl).alias("c"), F.size("docs").alias("d"),
            F.col("question").alias("e"), F.array_join("record_keys", "\x01").alias("f"),
        )
        ordered = pool.withColumn("_key", key)
        picked, after = 0, None
        while picked < target:
            full_docs = [d for d, n in docs.items() if doc_cap is not None and n >= doc_cap]
            full_recs = [r for r, n in recs.items() if n >= record_cap]
            part = ordered
            if after is not None:
                lits = F.struct(*[F.lit(after[n]).alias(n) for n in "abcdef"])
                part = part.where(F.col("_key") > lits)
            if full_docs:
                part = part.where(~F.arrays_overlap("docs", F.array(*[F.lit(x) for x in full_docs])))
            if full_recs:
                part = part.where(~F.arrays_overlap("record_keys", F.array(*[F.lit(x) for x in full_recs])))
            if asked:
                part = part.where(~F.col("question").isin(*sorted(asked)))
            rows = part.orderBy("_key").limit(4 * target).collect()
            if not rows:
                return None
            for r in rows:
                after = r["_key"]
                if picked >= target:
                    break
                if r["question"] in asked or (doc_cap is not None and any(docs.get(d, 0) >= doc_cap for d in r["docs"])):
                    continue
                if any(recs.get(k, 0) >= record_cap for k in r["record_keys"]):
                    continue
                picked += 1
                asked.add(r["question"])
                for d in r["docs"]:
                    docs[d] = docs.get(d, 0) + 1
                for k in r["record_keys"]:
                    recs[k] = recs.get(k, 0) + 1
                out.append((category, r["question"], r["gold_answer"], r["evidence"], r["docs"], r["record_keys"]))
    return out


def classify_question_type(question_type: Column, question: Column, rules=TYPE_RULES) -> Column:
    """Given type unless blank or Single, else the first keyword rule."""
    given, q = _s(question_type), tx.text_or_empty(question)
    out = F.when((given != "") & (given != "Single"), given)
    for name, words in rules:
        out = out.when(q.rlike("|".join(re.escape(w) for w in words)), F.lit(name))
    return out.otherwise(F.lit(DEFAULT_TYPE))


# fixed values: kind and answer of the questions that fill up a set
FILL_TYPE, FILL_ANSWER = "repair_method", "依据文档排查"


def quota_fill(records: DataFrame, ord_col: str = "ord", quotas=QUOTAS, templates: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Question set of at most the last quota's size, filled record by record: a record adds a question
    of a kind while the set is smaller than that kind's quota.  What is then missing comes from the first
    records with equipment and fault, as repair questions with a general answer.

    Records are read in order in short batches, only those that can still add something.
    """
    spark = records.sparkSession

    def question(row, kind: str, answer: str) -> tuple[str, str, str, str]:
        stems = (templates or {}).get(kind) or ("{equip}{fault}？",)
        stem = stems[sum(row["record_id"].encode()) % len(stems)]
        return stem.format(equip=row["equipment"], fault=row["fault"]), answer, f"{row['doc_name']}::{row['record_id']} | 依据原始表述整理。", kind

    r = records.where((_s(F.col("equipment")) != "") | (_s(F.col("fault")) != "")).select(
        F.col(ord_col).alias("o"), "doc_name", "record_id", "equipment", "fault", *[tx.clean_list(F.col(c)).alias(c) for c, _t, _q in quotas]
    )
    out, after = [], None
    total = quotas[-1][2]
    while len(out) < total:
        alive = [c for c, _t, quota in quotas if len(out) < quota]
        cond = F.lit(False)
        for c in alive:
            cond = cond | (F.size(c) > 0)
        part = r.where(cond) if after is None else r.where(cond & (F.col("o") > F.lit(after)))
        rows = part.orderBy("o").limit(total).collect()
        if not rows:
            break
        for row in rows:
            after = row["o"]
            for c, kind, quota in quotas:
                if row[c] and len(out) < quota:
                    out.append(question(row, kind, "；".join(row[c])))
    if len(out) < total:
        rest = r.where((F.col("equipment") != "") & (F.col("fault") != "")).orderBy("o").limit(total - len(out)).collect()
        out += [question(row, FILL_TYPE, FILL_ANSWER) for row in rest]
    return spark.createDataFrame(out, "question string, gold_answer string, evidence string, type string")


def repair_evidence_ids(rows: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace ``::unknown_id`` in ``rows(row_id, evidence, type, gold_answer)`` where exactly one record of
    ``answers(doc_name, type, answer, record_id)`` fits; gives (repaired rows, unresolved rows).

    Answers are grouped to their count first, so that a text shared by many records stays one row.
    """
    unique = answers.groupBy("doc_name", "type", "answer").agg(F.count(F.lit(1)).alias("_n"), F.min("record_id").alias("_rid")).where("_n = 1")
    broken = F.contains(F.col("evidence"), F.lit("::unknown_id"))
    doc = _s(F.get(F.split(F.get(F.split(_s(F.col("evidence")), r"\|"), F.lit(0)), "::unknown_id"), F.lit(0)))
    bad = rows.where(broken).withColumn("_doc", doc).join(
        unique.select(F.col("doc_name").alias("_doc"), F.col("type"), F.col("answer").alias("gold_answer"), "_rid"), ["_doc", "type", "gold_answer"], "left"
    )
    fixed = bad.where("_rid IS NOT NULL").withColumn(
        "evidence", F.regexp_replace(F.col("evidence"), F.lit("^(.*?)::unknown_id"), F.concat(F.lit("$1::"), F.col("_rid")))
    )
    return rows.where(~broken).unionByName(fixed.select(*rows.columns)), bad.where("_rid IS NULL").select(*rows.columns)


# --- latency and lifecycle -------------------------------------------------------------------------------


def latency_rollup(chunks: DataFrame) -> DataFrame:
    """Per request of ``chunks(request_id, started_ms, at_ms, text)``: first and full time, chunks, characters."""
    return chunks.groupBy("request_id").agg(
        (F.min("at_ms") - F.min("started_ms")).alias("first_ms"),
        (F.max("at_ms") - F.min("started_ms")).alias("full_ms"),
        F.count(F.lit(1)).alias("n_chunks"),
        F.sum(F.length("text")).alias("n_chars"),
        (F.count(F.lit(1)) > 1).alias("is_streaming"),
    )


def allowed_move(before: Column, after: Column, allowed: Mapping[str, Sequence[str]] = TRANSITIONS) -> Column:
    pairs = [f"{a}>{b}" for a, bs in allowed.items() for b in bs]
    return F.concat_ws(">", before, after).isin(*pairs)


def validate_transitions(log: DataFrame, allowed: Mapping[str, Sequence[str]] = TRANSITIONS, start: str = "idle") -> DataFrame:
    """``log(run_id, seq, state)`` with the previous state and whether the move is allowed."""
    before = neighbours(log, "run_id", "seq", {"before": "state"}, -1)
    before = before.withColumn("before", F.coalesce("before", F.lit(start)))
    return before.withColumn("is_valid", allowed_move(F.col("before"), F.col("state"), allowed))


def run_snapshot(log: DataFrame, totals: DataFrame, terminal: Sequence[str] = ("completed", "stopped", "failed")) -> DataFrame:
    """Latest state per run with progress: ``log(run_id, seq, state, done)``, ``totals(run_id, total)``."""
    last = log.groupBy("run_id").agg(F.max_by("state", "seq").alias("state"), F.max("done").alias("done"))
    pct = F.when(F.col("total") > 0, F.bround(F.least(F.col("done") / F.col("total"), F.lit(1.0)) * 100, 2)).otherwise(F.lit(0.0))
    return last.join(totals, "run_id", "left").select("run_id", "state", "done", "total", pct.alias("progress_percent"), F.col("state").isin(*terminal).alias("is_terminal"))
