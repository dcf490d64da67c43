"""Domain views over the driver tables, once for Spark and once as SQL."""

from pyspark.sql import functions as F

from corpusloom.operators import graph_build as gb
from corpusloom.plans.session import cut


def records(t):
    """Fault records: one per nation, part name, part type and return flag."""
    li = t("lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    j = (
        li.join(t("part"), li.l_partkey == F.col("p_partkey"))
        .join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    )
    # the collected lists are bounded: 25 brands and 2 line states at any scale
    g = j.groupBy("n_name", "p_name", "p_type", "l_returnflag").agg(
        F.sort_array(F.collect_set("p_brand")).alias("causes"), F.sort_array(F.collect_set("l_linestatus")).alias("actions")
    )
    none = F.array().cast("array<string>")
    key = F.concat_ws("~", "n_name", "p_name", "p_type", "l_returnflag")
    return g.select(
        F.col("n_name").alias("doc_name"),
        F.concat(F.lit("r"), F.substring(F.md5(key), 1, 12)).alias("record_id"),
        F.col("p_type").alias("section_group"),
        F.col("p_type").alias("record_title"),
        F.concat_ws(" > ", "n_name", "p_type").alias("breadcrumb"),
        F.col("p_name").alias("equipment"),
        F.concat_ws(" ", "p_type", "l_returnflag").alias("fault"),
        F.lit("").alias("symptom"),
        "causes",
        "actions",
        none.alias("consequences"),
        none.alias("precautions"),
        F.slice("causes", 1, 2).alias("key_components"),
        F.concat_ws(" ", "p_name", "p_type").alias("source_text"),
        key.alias("ord"),
    )


REC = """rec AS (SELECT n_name AS doc_name, 'r' || substring(md5(n_name || '~' || p_name || '~' || p_type || '~' || l_returnflag), 1, 12) AS record_id,
    n_name || ' > ' || p_type AS breadcrumb, p_type AS record_title, p_name AS equipment, p_type || ' ' || l_returnflag AS fault,
    list_sort(list(DISTINCT p_brand)) AS causes, list_sort(list(DISTINCT l_linestatus)) AS actions,
    p_name || ' ' || p_type AS source_text, n_name || '~' || p_name || '~' || p_type || '~' || l_returnflag AS ord
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name, p_name, p_type, l_returnflag)"""


def graph(t):
    """Graph of all records; the records are materialised once, as a table between two jobs."""
    return gb.record_graph(cut(records(t)))


_DESC = """'故障现象: ' || fault || ' 可能原因: ' || array_to_string(causes, '；') || ' 处理步骤: ' || array_to_string(actions, '；') || ' 可能后果: 无 关键部件: '
    || array_to_string(causes[1:2], '；') || ' 注意事项: 无 breadcrumb: ' || breadcrumb || ' 原始文本: ' || source_text"""
_CASE = "fault || '（' || equipment || '）'"
# node and edge candidates and the merged graph; parents stand for whole documents here
CAND = f"""{REC}, rc AS (SELECT *, 'chunk-faultcase-' || md5(doc_name || '::' || record_id) AS cid, {_CASE} AS fc FROM rec),
    ncand AS (SELECT equipment AS entity_name, 'EQUIPMENT' AS entity_type, equipment || '，本记录对应故障卡片：' || fault || '。' AS description, cid AS source_id FROM rc
        UNION ALL SELECT fc, 'FAULTCASE', {_DESC}, cid FROM rc),
    pcand AS (SELECT doc_name AS entity_name, 'DOCROOT' AS entity_type, doc_name || '，由文档《' || doc_name || '》归纳出的父级装备节点，当前汇聚 ' || count(*) || ' 条故障卡片记录。' AS description
        FROM rc GROUP BY doc_name),
    nodes AS (SELECT DISTINCT entity_name, entity_type FROM (SELECT entity_name, entity_type FROM ncand UNION ALL SELECT entity_name, entity_type FROM pcand)),
    nfac AS (SELECT DISTINCT * FROM (SELECT entity_name, 'description' AS facet, description AS value FROM ncand
        UNION ALL SELECT entity_name, 'source', source_id FROM ncand UNION ALL SELECT entity_name, 'description', description FROM pcand
        UNION ALL SELECT doc_name, 'source', cid FROM rc)),
    ecand AS (SELECT equipment AS a, fc AS b, 10.0::DOUBLE AS weight, 'Has_FaultCase' AS rel, cid AS src_ref FROM rc
        UNION ALL SELECT DISTINCT doc_name, equipment, 5.0::DOUBLE, 'Has_Equipment', 'set:' || doc_name FROM rc WHERE doc_name <> equipment),
    edges AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, sum(weight) AS weight, string_agg(DISTINCT rel, '|' ORDER BY rel) AS rels FROM ecand GROUP BY 1, 2)"""


def part_supplier(t):
    """Large bipartite graph: parts and suppliers that share a line, weight = lines."""
    return (
        t("lineitem")
        .groupBy(F.concat(F.lit("P"), "l_partkey").alias("src"), F.concat(F.lit("S"), "l_suppkey").alias("dst"))
        .agg(F.count(F.lit(1)).cast("double").alias("weight"))
    )


PS = "ps AS (SELECT 'P' || l_partkey AS src, 'S' || l_suppkey AS dst, count(*)::DOUBLE AS weight FROM lineitem GROUP BY 1, 2)"


def hierarchy(t):
    """Region - nation - supplier tree as undirected edges."""
    n = t("nation").select(F.concat(F.lit("R"), "n_regionkey").alias("src"), F.concat(F.lit("N"), "n_nationkey").alias("dst"))
    s = t("supplier").select(F.concat(F.lit("N"), "s_nationkey").alias("src"), F.concat(F.lit("S"), "s_suppkey").alias("dst"))
    return n.unionByName(s)


TREE = """tree AS (SELECT 'R' || n_regionkey AS src, 'N' || n_nationkey AS dst FROM nation
    UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey FROM supplier)"""
