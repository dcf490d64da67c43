"""Extraction responses to diagnostic records: parsing, normalising, quality gate, cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.plans.scan import ordered_parts, prefix_scan, top_k

TEXT_FIELDS = ("equipment", "fault", "symptom")
LIST_FIELDS = ("causes", "actions", "consequences", "precautions", "key_components")
SUPPORT_FIELDS = ("causes", "actions", "precautions", "consequences")
RESPONSE_SCHEMA = ", ".join(
    ["status string"]
    + [f"{f} string" for f in TEXT_FIELDS]
    + [f"{f} array<string>" for f in LIST_FIELDS]
    + ["source_text string", "rejection_reason string", "extraction_notes string"]
)
UNKNOWN_ORDER = 10**9

# fixed values: rules of the Chinese record titles and equipment names
HINT_SUFFIXES = ("常见问题", "故障", "异常", "问题")
HINT_REWRITES = (("系统供水", "供水系统"), ("系统供油", "供油系统"), ("系统供电", "供电系统"))
HINT_TAILS = ("供水", "供油", "供电")
NAME_REWRITES = (("系统供水系统", "供水系统"), ("系统供油系统", "供油系统"), ("系统供电系统", "供电系统"))
GENERIC_NAMES = ("设备", "系统", "部件", "故障")

# fixed values: card sections, their label aliases, the expandable ones and the empty marks
CARD_LABELS = {
    "记录ID": ("记录ID",),
    "来源路径": ("来源路径", "breadcrumb"),
    "章节标题": ("章节标题",),
    "装备": ("装备",),
    "故障卡片": ("故障卡片",),
    "故障现象": ("故障现象", "现象"),
    "可能原因": ("可能原因", "原因"),
    "处理步骤": ("处理步骤", "处理建议", "维修方法"),
    "可能后果": ("可能后果", "后果"),
    "注意事项": ("注意事项", "注意"),
    "关键部件": ("关键部件",),
    "原始文本": ("原始文本",),
}
EXPANDABLE_LABELS = ("故障现象", "可能原因", "处理步骤", "注意事项", "关键部件")
EMPTY_MARKS = ("-", "—", "无", "无。", "N/A", "n/a", "null")
NONE = "无"


# --- responses ------------------------------------------------------------------------------


def parse_json_responses(responses: DataFrame, text: str = "response") -> DataFrame:
    """Add ``payload`` (the JSON object text, or null) and ``reject_reason``.

    Code fences are stripped; if the rest is no JSON object the outermost braces are tried.
    """
    raw = tx.strip(tx.text_or_empty(F.col(text)))
    inner = F.regexp_replace(raw, r"^`+|`+$", "")
    tagged = F.when(F.lower(inner).startswith("json"), tx.strip(F.expr("substring(_inner, 5)"))).otherwise(F.col("_inner"))
    out = responses.withColumn("_inner", inner).withColumn("_c", F.when(raw.startswith("```"), tagged).otherwise(raw))
    sliced = F.regexp_extract("_c", r"(?s)\{.*\}", 0)

    def is_object(c: Column) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), F.lit(False))

    out = out.withColumn(
        "payload", F.when(is_object(F.col("_c")), F.col("_c")).when(is_object(sliced), sliced)
    )
    return out.withColumn(
        "reject_reason",
        F.when(F.col("payload").isNotNull(), None)
        .when(F.col("_c") == "", F.lit("empty response"))
        .otherwise(F.lit("no JSON object")),
    ).drop("_inner", "_c")


def normalize_records(parsed: DataFrame, chunk_text: str = "chunk_text") -> DataFrame:
    """Typed record columns from ``payload``; rows without payload become rejects."""
    p = parsed.withColumn("_r", F.from_json("payload", RESPONSE_SCHEMA))
    status = F.lower(tx.strip(tx.text_or_empty(F.col("_r.status"))))
    known = F.when(status.isin("ok", "reject"), status).otherwise(F.lit("reject"))
    source = F.coalesce(F.nullif(F.col("_r.source_text"), F.lit("")), F.col(chunk_text))
    keep = [c for c in parsed.columns if c not in ("payload", "reject_reason")]
    return p.select(
        *keep,
        known.alias("status"),
        *[tx.strip(tx.text_or_empty(F.col(f"_r.{f}"))).alias(f) for f in TEXT_FIELDS],
        *[tx.clean_list(F.col(f"_r.{f}")).alias(f) for f in LIST_FIELDS],
        tx.strip(tx.text_or_empty(source)).alias("source_text"),
        tx.strip(tx.text_or_empty(F.coalesce(F.col("_r.rejection_reason"), F.col("reject_reason")))).alias("rejection_reason"),
        tx.strip(tx.text_or_empty(F.col("_r.extraction_notes"))).alias("extraction_notes"),
    )


def split_accepted_rejected(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    ok = F.col("status") == "ok"
    return records.where(ok), records.where(~F.coalesce(ok, F.lit(False)))


def extraction_report(records: DataFrame, by: str | None = None) -> DataFrame:
    g = records.groupBy(by) if by else records.groupBy()
    ok = F.coalesce(F.col("status") == "ok", F.lit(False))
    return g.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected")
    )


# --- names ----------------------------------------------------------------------------------


def breadcrumb_parts(breadcrumb: Column) -> Column:
    plain = F.replace(tx.text_or_empty(breadcrumb), F.lit(".md"), F.lit(""))
    return F.filter(F.transform(F.split(plain, ">"), tx.strip), lambda x: x != "")


def record_title(breadcrumb: Column) -> Column:
    return F.coalesce(F.try_element_at(breadcrumb_parts(breadcrumb), F.lit(-1)), F.lit(""))


def section_group(chapter: Column) -> Column:
    return F.regexp_replace(tx.strip(tx.text_or_empty(chapter)), r"^[^ ]* ", "")


def equipment_hint(title: Column) -> Column:
    """Equipment name suggested by a record title."""
    t = F.regexp_replace(tx.strip(tx.text_or_empty(title)), rf"^\d+(\.\d+)*{tx.WS}*", "")
    t = F.replace(t, F.lit("主、辅机"), F.lit("主辅机"))

    def without_suffix(x: Column) -> Column:
        out = x
        for suffix in reversed(HINT_SUFFIXES):
            out = F.when(x.endswith(suffix), tx.strip(F.regexp_replace(x, f"{suffix}$", ""))).otherwise(out)
        for old, new in HINT_REWRITES:
            out = F.replace(out, F.lit(old), F.lit(new))
        return out

    tail = f"({'|'.join(HINT_TAILS)})$"
    named = tx.let(tx.let(t, without_suffix), lambda x: F.when(x.rlike(tail), F.concat(x, F.lit("系统"))).otherwise(x))
    return tx.strip(named)


def normalize_equipment(name: Column, breadcrumb: Column, source_text: Column, title: Column, strict: bool = True) -> Column:
    """Rewritten equipment name; a longer hint from the title that contains the name replaces it.

    ``strict`` is the aggregation-time form (an empty name stays empty, trailing 的 is dropped);
    otherwise the extraction-time form, where an empty name takes the hint.
    """
    given = tx.strip(tx.text_or_empty(name))
    e = F.replace(given, F.lit("、"), F.lit(""))
    for old, new in NAME_REWRITES:
        e = F.replace(e, F.lit(old), F.lit(new))
    if strict:
        e = F.regexp_replace(e, "的+$", "")

    def specific(x: Column) -> Column:
        out = F.when(
            (x == "舱口盖") & F.contains(tx.text_or_empty(source_text), F.lit("平式舱口盖")), F.lit("平式舱口盖")
        ).when((x == "门窗") & F.contains(tx.text_or_empty(breadcrumb), F.lit("门窗边框")), F.lit("门窗边框"))
        if strict:
            out = out.when(x == "消防系统供水系统", F.lit("消防供水系统"))
        return out.otherwise(x)

    def hinted(p: Column) -> Column:
        short, long = F.replace(p["e"], F.lit("、"), F.lit("")), F.replace(p["hint"], F.lit("、"), F.lit(""))
        inside = F.contains(long, short) & (F.length(short) < F.length(long))
        return F.when((p["hint"] != "") & ((p["e"] == "") | inside), p["hint"]).otherwise(p["e"])

    pair = F.struct(tx.let(e, specific).alias("e"), equipment_hint(title).alias("hint"))
    out = tx.let(pair, hinted)
    return F.when(given == "", F.lit("")).otherwise(out) if strict else out


def equipment_notes(given: Column, final: Column) -> Column:
    g = tx.strip(tx.text_or_empty(given))
    note = F.concat(F.lit("equipment normalized: "), g, F.lit(" -> "), final)
    return F.when((g != "") & (g != final), F.array(note)).otherwise(F.array().cast("array<string>"))


# --- quality and aggregation ------------------------------------------------------------------


def assess_quality() -> Column:
    """Reason codes for a row with the record columns."""
    e = tx.strip(tx.text_or_empty(F.col("equipment")))
    unsupported = F.lit(True)
    for f in SUPPORT_FIELDS:
        unsupported = unsupported & (F.size(tx.clean_list(F.col(f))) == 0)
    checks = [(tx.is_blank(F.col(f)), f"missing_{f}") for f in TEXT_FIELDS]
    checks += [(unsupported, "no_supporting_fields"), (e.endswith("的") | e.isin(*GENERIC_NAMES), "over_generic_equipment")]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in checks]))


def aggregate_records(accepted: DataFrame, sources: DataFrame, chapter_chunks: DataFrame) -> DataFrame:
    """Numbered, cleaned, ordered and judged records, one row each with ``decision``.

    ``accepted(doc_name, record_file, source_chunk_file, source_chunk_id, record columns)``,
    ``sources(doc_name, source_chunk_file, chapter, chapter_file, breadcrumb)``,
    ``chapter_chunks(doc_name, chapter_file, source_chunk_id, chunk_order)``.
    """
    numbered = prefix_scan(accepted, "doc_name", "record_file", row_number="_no")
    j = numbered.join(sources, ["doc_name", "source_chunk_file"], "left").join(
        chapter_chunks, ["doc_name", "chapter_file", "source_chunk_id"], "left"
    )
    crumb = F.replace(tx.text_or_empty(F.col("breadcrumb")), F.lit(".md"), F.lit(""))
    title = record_title(crumb)
    equipment = normalize_equipment(F.col("equipment"), crumb, F.col("source_text"), title)
    shaped = j.select(
        "doc_name",
        F.format_string("llm_%03d", F.col("_no")).alias("record_id"),
        section_group(F.col("chapter")).alias("section_group"),
        title.alias("record_title"),
        crumb.alias("breadcrumb"),
        equipment.alias("equipment"),
        equipment_notes(F.col("equipment"), equipment).alias("notes"),
        *[tx.strip(tx.text_or_empty(F.col(f))).alias(f) for f in ("fault", "symptom", "source_text")],
        *[tx.clean_list(F.col(f)).alias(f) for f in LIST_FIELDS],
        F.coalesce("chunk_order", F.lit(UNKNOWN_ORDER)).alias("chunk_order"),
        tx.text_or_empty(F.col("source_chunk_id")).alias("source_chunk_id"),
        F.col("_no").alias("_no"),
    )
    judged = shaped.withColumn("quality_reasons", assess_quality()).withColumn(
        "decision", F.when(F.size("quality_reasons") > 0, F.lit("drop")).otherwise(F.lit("keep"))
    )
    return prefix_scan(
        judged, "doc_name", ["section_group", "chunk_order", "source_chunk_id", "_no"], row_number="position"
    ).drop("_no")


def aggregation_counts(judged: DataFrame) -> DataFrame:
    return judged.groupBy("doc_name").agg(
        F.count(F.lit(1)).alias("accepted_record_count"),
        F.count_if(F.col("decision") == "keep").alias("kept_record_count"),
        F.count_if(F.col("decision") == "drop").alias("dropped_record_count"),
    )


# --- cards ----------------------------------------------------------------------------------


def or_none(c: Column) -> Column:
    s = tx.strip(tx.text_or_empty(c))
    return F.when(s == "", F.lit(NONE)).otherwise(s)


def faultcase_name(equipment: Column, fault: Column) -> Column:
    e, f = or_none(equipment), or_none(fault)
    return F.when(f == NONE, e).when(e == NONE, f).otherwise(F.concat(f, F.lit("（"), e, F.lit("）")))


def _section(title: str, body: Column) -> Column:
    return F.concat(F.lit(f"[{title}]\n"), body)


def render_card() -> Column:
    """Labelled card text of a record row."""
    e, f = tx.text_or_empty(F.col("equipment")), tx.text_or_empty(F.col("fault"))
    card = F.when((e != "") & (f != ""), F.concat(f, F.lit("（"), e, F.lit("）"))).when(f != "", f).otherwise(e)
    listed = [(t, tx.numbered(tx.clean_list(F.col(c)))) for t, c in (
        ("可能原因", "causes"), ("处理步骤", "actions"), ("可能后果", "consequences"), ("注意事项", "precautions"), ("关键部件", "key_components"))]
    parts = [
        ("记录ID", tx.text_or_empty(F.col("record_id"))),
        ("来源路径", tx.text_or_empty(F.col("breadcrumb"))),
        ("章节标题", tx.text_or_empty(F.col("record_title"))),
        ("装备", e),
        ("故障卡片", card),
        ("故障现象", tx.text_or_empty(F.col("symptom"))),
        *listed,
        ("原始文本", tx.text_or_empty(F.col("source_text"))),
    ]
    return F.concat(tx.strip(F.concat_ws("\n\n", *[_section(t, b) for t, b in parts])), F.lit("\n"))


def render_chunk() -> Column:
    """Index text of a record row."""
    symptom = or_none(F.coalesce(F.nullif(F.col("symptom"), F.lit("")), F.col("fault")))
    head = [
        ("记录ID", or_none(F.col("record_id"))),
        ("设备", or_none(F.col("equipment"))),
        ("故障卡片", faultcase_name(F.col("equipment"), F.col("fault"))),
        ("故障现象", symptom),
    ]
    lists = (("可能原因", "causes"), ("处理步骤", "actions"), ("可能后果", "consequences"), ("关键部件", "key_components"), ("注意事项", "precautions"))
    return F.concat_ws(
        "\n",
        *[F.concat(F.lit(f"[{t}] "), b) for t, b in head],
        *[_section(t, tx.numbered(tx.clean_list(F.col(c)))) for t, c in lists],
        _section("原始文本", or_none(F.col("source_text"))),
    )


def overview_lines(records: DataFrame, doc_type: str = "diagnostic_records_llm", part_rows: int = 10_000) -> DataFrame:
    """Overview text per document, in parts for documents with very many records.

    ``records(doc_name, position, record_id, equipment, fault)``.
    """
    # fixed values: overview boilerplate
    intro = (
        "这份 txt 用于把 diagnostic records 转成更直观的“故障卡片”展示稿。",
        "它对齐当前项目约定的图谱本体结构：Equipment 作为入口，FaultCase 作为高密度故障卡片。",
        "原因、处理步骤、可能后果、注意事项、关键部件和原始文本都作为故障卡片内容层承载。",
    )
    rules = (
        "1. 装备 -> 故障卡片",
        "2. 故障卡片内部展开：故障现象 / 可能原因 / 处理步骤 / 可能后果 / 注意事项 / 关键部件 / 原始文本",
    )
    line = F.concat(F.lit("- "), "record_id", F.lit(": "), "equipment", F.lit(" -> "), "fault")
    lines = ordered_parts(records.withColumn("line", line), "doc_name", "position", "line", "lines", part_rows)
    totals = records.groupBy("doc_name").agg(F.count(F.lit(1)).alias("record_total"))
    head = F.concat_ws(
        "\n",
        F.lit("[文档名称]"), "doc_name", F.lit(""), F.lit("[文档类型]"), F.lit(doc_type), F.lit(""),
        F.lit("[导出说明]"), *[F.lit(x) for x in intro], F.lit(""), F.lit("[结构约定]"), *[F.lit(x) for x in rules], F.lit(""),
        F.lit("[记录总数]"), F.col("record_total").cast("string"), F.lit(""), F.lit("[记录索引]"),
    )
    body = F.array_join("lines", "\n")
    return lines.join(totals, "doc_name").select(
        "doc_name", "part_no", F.concat(F.when(F.col("part_no") == 0, F.concat(head, F.lit("\n"))).otherwise(F.lit("")), body, F.lit("\n")).alias("text")
    )


def equipment_catalog(cards: DataFrame) -> DataFrame:
    """Per equipment: number of cards, distinct documents and the first three of them.

    The names come from a top-3 over distinct pairs, never from a collected set.
    """
    pairs = (
        cards.select(tx.strip(F.col("equipment")).alias("name"), tx.text_or_empty(F.col("doc_name")).alias("doc"))
        .where("name <> ''")
        .groupBy("name", "doc")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = pairs.groupBy("name").agg(F.sum("n").alias("faultcase_count"), F.count_if(F.col("doc") != "").alias("document_count"))
    firsts = (
        top_k(pairs.where("doc <> ''"), "name", [F.col("doc")], 3)
        .groupBy("name")
        .agg(F.sort_array(F.collect_list("doc")).alias("documents"))
    )
    return totals.join(firsts, "name", "left").withColumn(
        "documents", F.coalesce("documents", F.array().cast("array<string>"))
    )


def card_sections(text: Column) -> Column:
    """Expandable sections of a card text as ``array<struct<label, value>>``."""
    canonical = {a: label for label, aliases in CARD_LABELS.items() for a in aliases}
    names = F.create_map(*[F.lit(x) for kv in canonical.items() for x in kv])
    alias_rx = "|".join(sorted(canonical, key=len, reverse=True))
    bracket = r"\[([^\]]+)\]\s*\n?([\s\S]*?)(?=\n\s*\[[^\]]+\]\s*\n?|$)"
    labelled = rf"({alias_rx})\s*[:：]\s*([\s\S]*?)(?=(?:{alias_rx})\s*[:：]|$)"

    def lines(v: Column) -> Column:
        return F.array_join(F.filter(F.transform(F.split(v, r"\r\n|[\n\r]"), tx.strip), lambda x: x != ""), "\n")

    def found(t: Column, rx: str) -> Column:
        pairs = F.arrays_zip(F.regexp_extract_all(t, F.lit(rx), F.lit(1)).alias("k"), F.regexp_extract_all(t, F.lit(rx), F.lit(2)).alias("v"))
        rows = F.transform(pairs, lambda p: F.struct(F.try_element_at(names, tx.strip(p["k"])).alias("label"), lines(p["v"]).alias("value")))
        return F.filter(rows, lambda r: r["label"].isNotNull() & (r["value"] != ""))

    t = tx.strip(tx.text_or_empty(text))
    by_bracket = found(t, bracket)
    sections = F.when(F.size(by_bracket) > 0, by_bracket).otherwise(found(tx.squeeze(t), labelled))
    return F.filter(sections, lambda r: r["label"].isin(*EXPANDABLE_LABELS) & ~r["value"].isin(*EMPTY_MARKS))


def parse_card_sections(cards: DataFrame, key: str, text: str) -> DataFrame:
    """One row per expandable section: ``(key, section_no, label, value)``."""
    return cards.select(key, F.posexplode(card_sections(F.col(text))).alias("section_no", "s")).select(
        key, "section_no", F.col("s.label").alias("label"), F.col("s.value").alias("value")
    )
