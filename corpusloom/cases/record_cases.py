"""Responses to records, cards and graph construction."""

from pyspark.sql import functions as F

from corpusloom.cases import case
from corpusloom.cases import sqltext as q
from corpusloom.cases import views as v
from corpusloom.operators import graph_build as gb
from corpusloom.operators import records as rec
from corpusloom.plans.session import tables

K = "CAST(json_extract(props, '$.k') AS INT)"


def _responses(t):
    """Event properties as model responses: plain, fenced, wrapped in talk, or broken."""
    k = F.get_json_object("props", "$.k").cast("int") % 4
    return t("events").select(
        "event_id",
        F.when(k == 0, F.col("props"))
        .when(k == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
        .when(k == 2, F.concat(F.lit("Result: "), "props", F.lit(" done")))
        .otherwise(F.substring("props", 1, 5))
        .alias("response"),
    )


@case(
    "d01_parse_json_responses",
    f"""SELECT event_id, CASE WHEN {K} % 4 < 3 THEN {K} END AS k, CASE WHEN {K} % 4 = 3 THEN 'no JSON object' END AS reject_reason FROM events""",
)
def _(spark, sf):
    out = rec.parse_json_responses(_responses(tables(spark, sf)))
    return out.select("event_id", F.get_json_object("payload", "$.k").cast("int").alias("k"), "reject_reason")


def _doc_responses(t):
    """Documents as record responses; labels decide the status."""
    d = t("documents").join(t("labels"), "doc_id", "left")
    status = F.when(F.col("quality") == 1, F.lit(" OK ")).when(F.col("quality") == 0, F.lit("reject")).otherwise(F.lit("maybe"))
    payload = F.to_json(
        F.struct(
            status.alias("status"),
            F.concat(F.lit("  "), "source").alias("equipment"),
            F.col("lang").alias("fault"),
            F.when(F.col("toxic") == 1, F.lit("")).otherwise(F.substring("text", 1, 20)).alias("symptom"),
            F.array(F.col("lang"), F.lit("  "), F.col("source")).alias("causes"),
            F.lit("no list").alias("actions"),
        )
    )
    return d.select("doc_id", F.col("text").alias("chunk_text"), payload.alias("payload"), F.lit(None).cast("string").alias("reject_reason"))


S20 = q.strip("substring(text, 1, 20)")


@case(
    "d02_normalize_records",
    f"""SELECT doc_id, CASE WHEN quality = 1 THEN 'ok' ELSE 'reject' END AS status, source AS equipment, lang AS fault,
    CASE WHEN toxic = 1 THEN '' ELSE {S20} END AS symptom, lang || '|' || source AS causes, 0 AS n_actions, md5({q.strip('text')}) AS source_md5
    FROM documents LEFT JOIN labels USING (doc_id)""",
)
def _(spark, sf):
    r = rec.normalize_records(_doc_responses(tables(spark, sf)))
    return r.select(
        "doc_id", "status", "equipment", "fault", "symptom", F.array_join("causes", "|").alias("causes"),
        F.size("actions").alias("n_actions"), F.md5("source_text").alias("source_md5"),
    )


@case(
    "d03_record_title_and_hint",
    """SELECT p_partkey, p_name AS title, p_type AS section_group,
    CASE WHEN p_size % 4 = 0 THEN p_name || '系统' WHEN p_size % 4 = 1 THEN p_name || '供油系统' WHEN p_size % 4 = 2 THEN p_name ELSE p_name || '主辅机供油系统' END AS hint FROM part""",
)
def _(spark, sf):
    p = tables(spark, sf)("part")
    size = F.col("p_size") % 4
    title = F.concat(
        F.lit("1.2 "), "p_name",
        F.when(size == 0, F.lit("系统故障")).when(size == 1, F.lit("系统供油异常")).when(size == 2, F.lit("常见问题")).otherwise(F.lit("主、辅机供油异常")),
    )
    crumb = F.concat(F.lit("book.md > part > "), "p_name", F.lit(" "))
    return p.select(
        "p_partkey", rec.record_title(crumb).alias("title"), rec.section_group(F.concat(F.lit("2.1 "), "p_type")).alias("section_group"),
        rec.equipment_hint(title).alias("hint"),
    )


@case(
    "d04_normalize_equipment",
    """SELECT p_partkey, e AS equipment, CASE WHEN e <> g THEN 'equipment normalized: ' || g || ' -> ' || e ELSE '' END AS notes FROM
    (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name || '的' WHEN p_size % 3 = 1 THEN p_name ELSE '' END AS g,
    CASE WHEN p_size % 3 = 2 THEN '' WHEN p_size % 2 = 0 THEN p_name || '供电系统' ELSE p_name END AS e FROM part)""",
)
def _(spark, sf):
    p = tables(spark, sf)("part")
    given = F.when(F.col("p_size") % 3 == 0, F.concat("p_name", F.lit("的"))).when(F.col("p_size") % 3 == 1, F.col("p_name")).otherwise(F.lit(""))
    title = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit("供电故障"))).otherwise(F.lit("3.1"))
    e = rec.normalize_equipment(given, F.lit(""), F.lit(""), title)
    return p.select("p_partkey", e.alias("equipment"), F.array_join(rec.equipment_notes(given, e), "|").alias("notes"))


@case(
    "d05_extraction_report",
    """SELECT lang, count(*) AS total, count(*) FILTER (quality = 1) AS accepted, count(*) FILTER (quality IS DISTINCT FROM 1) AS rejected
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""",
)
def _(spark, sf):
    r = rec.normalize_records(_doc_responses(tables(spark, sf)))
    ok, bad = rec.split_accepted_rejected(r)
    return rec.extraction_report(ok.unionByName(bad).withColumnRenamed("fault", "lang"), "lang")


@case(
    "d06_assess_quality",
    f"""SELECT doc_id, concat_ws('|', CASE WHEN toxic = 1 OR {S20} = '' THEN 'missing_symptom' END, CASE WHEN quality = 0 THEN 'no_supporting_fields' END,
    CASE WHEN toxic = 1 THEN 'over_generic_equipment' END) AS reasons FROM documents LEFT JOIN labels USING (doc_id)""",
)
def _(spark, sf):
    t = tables(spark, sf)
    r = rec.normalize_records(_doc_responses(t)).join(t("labels"), "doc_id", "left")
    none = F.array().cast("array<string>")
    r = r.withColumn("causes", F.when(F.col("quality") == 0, none).otherwise(F.col("causes"))).withColumn(
        "equipment", F.when(F.col("toxic") == 1, F.lit("设备")).otherwise(F.col("equipment"))
    )
    return r.select("doc_id", F.array_join(rec.assess_quality(), "|").alias("reasons"))


@case(
    "d07_aggregate_records",
    f"""WITH a AS (SELECT d.*, quality, toxic, lpad(doc_id::VARCHAR, 12, '0') AS f FROM documents d JOIN labels USING (doc_id)),
    n AS (SELECT *, 'llm_' || CASE WHEN no < 1000 THEN lpad(no::VARCHAR, 3, '0') ELSE no::VARCHAR END AS record_id,
        CASE WHEN toxic = 1 OR {S20} = '' THEN 'drop' ELSE 'keep' END AS decision, CASE WHEN quality = 1 THEN doc_id ELSE 1000000000 END AS o
        FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY f) AS no FROM a))
    SELECT source AS doc_name, record_id, decision, lang AS section_group,
    row_number() OVER (PARTITION BY source ORDER BY lang, o, doc_id::VARCHAR, no) AS position FROM n""",
)
def _(spark, sf):
    return _aggregated(tables(spark, sf)).select("doc_name", "record_id", "decision", "section_group", "position")


def _aggregated(t):
    labels = t("labels")
    acc = (
        rec.normalize_records(_doc_responses(t))
        .join(labels.select("doc_id"), "doc_id")
        .withColumn("doc_name", F.col("equipment"))
        .withColumn("record_file", F.lpad(F.col("doc_id").cast("string"), 12, "0"))
        .withColumn("source_chunk_file", F.col("doc_id").cast("string"))
        .withColumn("source_chunk_id", F.col("doc_id").cast("string"))
        .drop("doc_id")
    )
    docs = t("documents")
    sources = docs.select(
        F.col("source").alias("doc_name"), F.col("doc_id").cast("string").alias("source_chunk_file"), F.concat(F.lit("1 "), "lang").alias("chapter"),
        F.lit("c.json").alias("chapter_file"), F.concat_ws(" > ", "source", "lang").alias("breadcrumb"),
    )
    order = docs.join(labels.where("quality = 1"), "doc_id").select(
        F.col("source").alias("doc_name"), F.lit("c.json").alias("chapter_file"), F.col("doc_id").cast("string").alias("source_chunk_id"), F.col("doc_id").alias("chunk_order")
    )
    return rec.aggregate_records(acc, sources, order)


@case(
    "d07_aggregation_counts",
    f"""SELECT source AS doc_name, count(*) AS accepted_record_count, count(*) FILTER (NOT (toxic = 1 OR {S20} = '')) AS kept_record_count,
    count(*) FILTER (toxic = 1 OR {S20} = '') AS dropped_record_count FROM documents JOIN labels USING (doc_id) GROUP BY source""",
)
def _(spark, sf):
    return rec.aggregation_counts(_aggregated(tables(spark, sf)))


def _num(a):
    return f"array_to_string(list_transform({a}, lambda x, i: i || '. ' || x), chr(10))"


NL2 = "chr(10) || chr(10)"
CARD = f"""'[记录ID]' || chr(10) || record_id || {NL2} || '[来源路径]' || chr(10) || breadcrumb || {NL2} || '[章节标题]' || chr(10) || record_title || {NL2}
    || '[装备]' || chr(10) || equipment || {NL2} || '[故障卡片]' || chr(10) || fault || '（' || equipment || '）' || {NL2} || '[故障现象]' || chr(10) || {NL2}
    || '[可能原因]' || chr(10) || {_num('causes')} || {NL2} || '[处理步骤]' || chr(10) || {_num('actions')} || {NL2} || '[可能后果]' || chr(10) || '无' || {NL2}
    || '[注意事项]' || chr(10) || '无' || {NL2} || '[关键部件]' || chr(10) || {_num('causes[1:2]')} || {NL2} || '[原始文本]' || chr(10) || source_text || chr(10)"""


@case("d08_render_card", f"WITH {v.REC} SELECT doc_name, record_id, {CARD} AS card FROM rec")
def _(spark, sf):
    return v.records(tables(spark, sf)).select("doc_name", "record_id", rec.render_card().alias("card"))


CHUNK = f"""'[记录ID] ' || record_id || chr(10) || '[设备] ' || equipment || chr(10) || '[故障卡片] ' || fault || '（' || equipment || '）' || chr(10)
    || '[故障现象] ' || fault || chr(10) || '[可能原因]' || chr(10) || {_num('causes')} || chr(10) || '[处理步骤]' || chr(10) || {_num('actions')} || chr(10)
    || '[可能后果]' || chr(10) || '无' || chr(10) || '[关键部件]' || chr(10) || {_num('causes[1:2]')} || chr(10) || '[注意事项]' || chr(10) || '无' || chr(10)
    || '[原始文本]' || chr(10) || source_text"""


@case("d08_render_chunk", f"WITH {v.REC} SELECT doc_name, record_id, md5({CHUNK}) AS chunk_md5 FROM rec")
def _(spark, sf):
    return v.records(tables(spark, sf)).select("doc_name", "record_id", F.md5(rec.render_chunk()).alias("chunk_md5"))


@case(
    "d08_render_overview",
    f"""WITH {v.REC} SELECT doc_name, 0 AS part_no, count(*) AS n_records,
    md5(string_agg('- ' || record_id || ': ' || equipment || ' -> ' || fault, chr(10) ORDER BY ord) || chr(10)) AS index_md5 FROM rec GROUP BY doc_name""",
)
def _(spark, sf):
    r = v.records(tables(spark, sf)).withColumn("position", F.col("ord"))
    out = rec.overview_lines(r)
    tail = F.element_at(F.split("text", r"\[记录索引\]\n"), -1)
    return out.select(
        "doc_name", "part_no", F.regexp_extract("text", r"\[记录总数\]\n(\d+)", 1).cast("long").alias("n_records"), F.md5(tail).alias("index_md5")
    )


@case(
    "d09_equipment_catalog",
    """SELECT p_type AS name, count(*) AS faultcase_count, count(DISTINCT l_shipmode) AS document_count,
    array_to_string(list_sort(list(DISTINCT l_shipmode))[1:3], '|') AS documents
    FROM (SELECT p_type, 'S' || l_suppkey AS l_shipmode FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY p_type""",
)
def _(spark, sf):
    t = tables(spark, sf)
    cards = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_type").alias("equipment"), F.concat(F.lit("S"), "l_suppkey").alias("doc_name")
    )
    return rec.equipment_catalog(cards).withColumn("documents", F.array_join("documents", "|"))


# an empty symptom section takes in the section after it, as in the reference behaviour
@case(
    "d10_parse_card_sections",
    f"""WITH {v.REC}, s AS (SELECT doc_name, record_id, '故障现象' AS label, '[可能原因]' || chr(10) || {_num('causes')} AS value FROM rec
    UNION ALL SELECT doc_name, record_id, '处理步骤', {_num('actions')} FROM rec UNION ALL SELECT doc_name, record_id, '关键部件', {_num('causes[1:2]')} FROM rec)
    SELECT doc_name || '/' || record_id AS card_id, label, value FROM s""",
)
def _(spark, sf):
    r = v.records(tables(spark, sf)).select(F.concat_ws("/", "doc_name", "record_id").alias("card_id"), rec.render_card().alias("card"))
    return rec.parse_card_sections(r, "card_id", "card").select("card_id", "label", "value")


# --- graph construction --------------------------------------------------------------------------


def _tuples(t):
    p = t("part")
    ent = F.concat(F.lit('("entity"<|>'), "p_name", F.lit("<|>"), "p_type", F.lit("<|>"), "p_brand", F.lit(")##"))
    rel = F.concat(
        F.lit('("relationship"<|>'), "p_name", F.lit("<|>"), "p_brand", F.lit("<|>made by<|>"),
        F.when(F.col("p_size") % 3 == 0, F.lit("Made_By | brand")).when(F.col("p_size") % 3 == 1, F.lit("brand")).otherwise(F.lit("| ; x")),
        F.lit("<|>"), F.col("p_size").cast("string"), F.lit(")<|COMPLETE|>"),
    )
    return p.select(F.concat(F.lit("c"), "p_partkey").alias("chunk_id"), F.col("p_partkey").alias("ord"), F.concat(ent, F.lit("noise##"), rel).alias("response"))


@case(
    "e01_parse_extraction_tuples",
    """SELECT 'node' AS kind, upper(p_name) AS a, upper(p_type) AS b, p_brand AS text, NULL::DOUBLE AS weight, 'c' || p_partkey AS source_id FROM part
    UNION ALL SELECT 'edge', upper(p_name), upper(p_brand), CASE WHEN p_size % 3 = 0 THEN 'Made_By/brand' WHEN p_size % 3 = 1 THEN 'UNSPECIFIED/brand' ELSE '|/x' END,
    p_size, 'c' || p_partkey FROM part""",
)
def _(spark, sf):
    nodes, edges = gb.parse_extraction_tuples(_tuples(tables(spark, sf)))
    n = nodes.select(F.lit("node").alias("kind"), F.col("entity_name").alias("a"), F.col("entity_type").alias("b"), F.col("description").alias("text"), F.lit(None).cast("double").alias("weight"), "source_id")
    e = edges.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.concat_ws("/", "relation_type", "keywords").alias("text"), "weight", "source_id")
    return n.unionByName(e)


@case(
    "e02_split_relation_type",
    """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_type WHEN 1 THEN p_type WHEN 2 THEN 'UNSPECIFIED' ELSE p_type END AS relation_type,
    CASE p_size % 4 WHEN 0 THEN p_brand WHEN 1 THEN p_type WHEN 2 THEN p_brand ELSE 'a；b' END AS keywords FROM part""",
)
def _(spark, sf):
    s = F.col("p_size") % 4
    raw = (
        F.when(s == 0, F.concat("p_type", F.lit(" | "), "p_brand")).when(s == 1, F.concat("p_type", F.lit(" ；  ")))
        .when(s == 2, F.col("p_brand")).otherwise(F.concat("p_type", F.lit(";a；b")))
    )
    return tables(spark, sf)("part").select("p_partkey", gb.split_relation_type(raw).alias("r")).select("p_partkey", "r.relation_type", "r.keywords")


@case(
    "e03_records_to_candidates",
    f"WITH {v.CAND} SELECT entity_name, entity_type, md5(description) AS d, source_id FROM ncand",
)
def _(spark, sf):
    n, _e = gb.records_to_candidates(v.records(tables(spark, sf)))
    return n.select("entity_name", "entity_type", F.md5("description").alias("d"), "source_id")


def _manuals(t):
    """Records whose document is a manual (section scope) for odd nation numbers."""
    r = v.records(t)
    odd = F.regexp_extract("doc_name", r"(\d+)$", 1).cast("int") % 2 == 1
    return r.withColumn("doc_name", F.when(odd, F.concat("doc_name", F.lit("维护与修理_x_12.md"))).otherwise(F.concat("doc_name", F.lit(" 柴油机"))))


@case(
    "e04_resolve_parents",
    f"""WITH {v.REC}, m AS (SELECT *, CAST(regexp_extract(doc_name, '(\\d+)$', 1) AS INT) % 2 = 1 AS odd, split_part(breadcrumb, ' > ', 2) AS chap FROM rec),
    p AS (SELECT CASE WHEN odd THEN chap || '｜' || chap ELSE '船舶柴油机' END AS parent, equipment, doc_name || odd AS scope FROM m)
    SELECT parent AS src, equipment AS dst, count(DISTINCT CASE WHEN parent LIKE '%｜%' THEN scope || parent ELSE scope END) * 5.0::DOUBLE AS weight FROM p GROUP BY 1, 2""",
)
def _(spark, sf):
    _n, e, _s = gb.resolve_parents(_manuals(tables(spark, sf)))
    return e.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


@case(
    "e05_merge_nodes",
    f"""WITH {v.CAND} SELECT entity_name, entity_type, md5(string_agg(value, '<SEP>' ORDER BY value) FILTER (facet = 'description')) AS descriptions,
    md5(string_agg(value, '<SEP>' ORDER BY value) FILTER (facet = 'source')) AS sources FROM nodes JOIN nfac USING (entity_name) GROUP BY 1, 2""",
)
def _(spark, sf):
    n = gb.render_nodes(v.graph(tables(spark, sf)))
    return n.select(
        "entity_name", "entity_type", F.md5(F.array_join("descriptions", "<SEP>")).alias("descriptions"), F.md5(F.array_join("source_ids", "<SEP>")).alias("sources")
    )


@case(
    "e05_merge_node_types",
    """WITH c AS (SELECT p_name, p_type, count(*) + (min(p_partkey) % 3 = 0)::INT AS v, (count(*) = 0)::INT AS old, min(p_partkey) AS f FROM part GROUP BY 1, 2)
    SELECT upper(p_name) AS entity_name, arg_min(upper(p_type), {'v': -v, 'f': f}) AS entity_type FROM c GROUP BY p_name""",
)
def _(spark, sf):
    t = tables(spark, sf)
    nodes, _e = gb.parse_extraction_tuples(_tuples(t))
    extra = t("part").groupBy("p_name", "p_type").agg(F.min("p_partkey").alias("k")).where("k % 3 = 0")
    old = nodes.limit(0).unionByName(
        extra.select(F.upper("p_name").alias("entity_name"), F.upper("p_type").alias("entity_type"), F.lit(1).alias("votes"), F.lit("old").alias("description"),
                     F.lit("old").alias("source_id"), gb.ord_key(extra, "k", F.lit(0)).alias("ord"))
    )
    return gb.merge_nodes(nodes.unionByName(old))[0]


@case(
    "e06_merge_edges",
    f"WITH {v.CAND} SELECT src, dst, weight, rels FROM edges",
)
def _(spark, sf):
    e = gb.render_edges(v.graph(tables(spark, sf)))
    return e.select("src", "dst", "weight", F.array_join("relation_types", "|").alias("rels"))


@case(
    "e06_stub_nodes",
    """SELECT upper(p_brand) AS entity_name, '"UNKNOWN"' AS entity_type FROM part GROUP BY 1
    UNION ALL SELECT upper(p_name), NULL FROM part WHERE false""",
)
def _(spark, sf):
    nodes, edges = gb.parse_extraction_tuples(_tuples(tables(spark, sf)))
    n, _f = gb.merge_nodes(nodes)
    e, ef = gb.merge_edges(edges)
    return gb.stub_nodes(e, ef, n)[0]


@case(
    "e07_canonical_edges",
    "SELECT least(a, b) AS src, greatest(a, b) AS dst, count(*) AS n FROM (SELECT l_partkey AS a, l_suppkey AS b FROM lineitem) GROUP BY 1, 2",
)
def _(spark, sf):
    e = tables(spark, sf)("lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return gb.canonical_edges(e).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@case(
    "e08_index_documents",
    f"""WITH {v.CAND}, d AS (SELECT entity_name, string_agg(value, '<SEP>' ORDER BY value) AS t FROM nfac WHERE facet = 'description' GROUP BY 1)
    SELECT 'entities' AS namespace, 'ent-' || md5(entity_name) AS id, md5(entity_name || ' ' || t) AS content_md5 FROM d
    UNION ALL SELECT 'entities_name', 'Ename-' || md5(entity_name), md5(entity_name) FROM d
    UNION ALL SELECT 'relationships', 'rel-' || md5(src || dst), md5(CASE rels WHEN 'Has_FaultCase' THEN '故障记录, 高密度诊断卡片' ELSE '父节点归档, 设备聚类' END
        || ' ' || rels || ' ' || src || ' ' || dst || ' ' || CASE rels WHEN 'Has_FaultCase' THEN '{gb.CASE_EDGE[0]}' ELSE '{gb.PARENT_EDGE[0]}' END) FROM edges""",
)
def _(spark, sf):
    return gb.index_documents(v.graph(tables(spark, sf))).select("namespace", "id", F.md5("content").alias("content_md5"))


@case(
    "e09_source_index",
    f"""WITH {v.CAND} SELECT value AS source_id, 'node' AS kind, entity_name AS item_id FROM nfac WHERE facet = 'source'
    UNION ALL SELECT DISTINCT src_ref, 'edge', least(a, b) || '->' || greatest(a, b) FROM ecand WHERE rel = 'Has_FaultCase'
    UNION ALL SELECT DISTINCT md5(a || chr(1) || a), 'edge_set', least(a, b) || '->' || greatest(a, b) FROM ecand WHERE rel = 'Has_Equipment'""",
)
def _(spark, sf):
    return gb.source_index(v.graph(tables(spark, sf)))


@case(
    "e10_doc_graph_contribution",
    f"""WITH {v.CAND}, per AS (SELECT doc_name, count(DISTINCT fc) AS f, count(DISTINCT equipment) AS e FROM rc GROUP BY 1)
    SELECT doc_name, 1 + e + f + 4 * f AS graph_nodes, e + f + 4 * f AS graph_edges FROM per""",
)
def _(spark, sf):
    t = tables(spark, sf)
    r = v.records(t)
    sources = r.select("doc_name", gb.record_chunk_id(F.col("doc_name"), F.col("record_id")).alias("source_id"))
    return gb.doc_graph_contribution(v.graph(t), sources)


@case(
    "e11_expand_fault_properties",
    f"""WITH {v.CAND}, s AS (SELECT fc, '故障现象' AS label, fault AS value FROM rc UNION ALL SELECT fc, '可能原因', array_to_string(causes, '；') FROM rc
    UNION ALL SELECT fc, '处理步骤', array_to_string(actions, '；') FROM rc UNION ALL SELECT fc, '关键部件', array_to_string(causes[1:2], '；') FROM rc)
    SELECT DISTINCT 'fault-property::' || fc || '::' || label AS id, fc AS faultcase_id, label AS property_label, value FROM s""",
)
def _(spark, sf):
    nodes, _e = gb.expand_fault_properties(v.graph(tables(spark, sf)))
    return nodes.select("id", "faultcase_id", "property_label", "value")
