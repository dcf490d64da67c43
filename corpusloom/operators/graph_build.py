"""From records and extraction tuples to a merged property graph and its index texts.

A graph is a set of narrow tables rather than rows with growing arrays, so that a node or
edge touched by a third of all records stays spread over many tasks:

* ``nodes(entity_name, entity_type)`` and ``edges(src, dst, weight)``, ``src <= dst``;
* ``node_facets(entity_name, facet, value)`` with facets ``description``, ``source`` and
  ``edge_facets(src, dst, facet, value)`` with also ``keywords``, ``relation_type`` and
  ``source_set``;
* ``source_sets(set_id, source_id)``: a source list shared by many edges (all records of a
  document) is stored once and referred to, instead of once per edge.

``render_*`` turns facets into sorted arrays, in parts where a list is very long.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import records as rec
from corpusloom.plans.scan import ordered_parts
from corpusloom.plans.session import cut

# fixed values: markers of the tuple protocol
TUPLE_MARK, RECORD_MARK, DONE_MARK = "<|>", "##", "<|COMPLETE|>"
RELATION_MARKS = ("|", "｜", ";", "；")
UNSPECIFIED = "UNSPECIFIED"
STUB_TYPE = '"UNKNOWN"'
# fixed values: texts, weights and types of the record graph
CASE_EDGE = ("该设备对应一条高密度故障卡片，包含故障现象、原因、处理步骤、注意事项、后果与原始文本证据。", "故障记录, 高密度诊断卡片", "Has_FaultCase", 10.0)
PARENT_EDGE = ("公共父节点归档到该范围内出现的具体设备节点。", "父节点归档, 设备聚类", "Has_Equipment", 5.0)
PARENT_RULES = (
    ("航政艇", "航政艇"),
    ("液压系统", "船舶液压系统"),
    ("液压设备", "船舶液压系统"),
    ("电气设备", "船舶电气设备"),
    ("柴油机", "船舶柴油机"),
    ("发动机", "船舶发动机"),
    ("舵机", "船舶舵机"),
    ("机械设备", "船舶机械设备"),
)
LARGE_MANUAL_MARKS = ("指南", "维护与修理")
DEFAULT_PARENT = "文档父节点"


@dataclass
class Graph:
    nodes: DataFrame
    node_facets: DataFrame
    edges: DataFrame
    edge_facets: DataFrame
    source_sets: DataFrame | None = None


def ord_key(df: DataFrame, ord_col: str, pos: Column) -> Column:
    """Sortable text of a source order (text or non-negative number) and a position inside it."""
    o = F.col(ord_col)
    if df.schema[ord_col].dataType.typeName() != "string":
        o = F.lpad(o.cast("string"), 20, "0")
    return F.concat(o, F.lit("#"), F.lpad(pos.cast("string"), 10, "0"))


# --- extraction tuples ------------------------------------------------------------------------


def split_relation_type(keywords: Column) -> Column:
    """``struct(relation_type, keywords)``: the first mark, in fixed order, with a non-blank head."""
    raw = tx.strip(tx.text_or_empty(keywords))
    none = F.lit(None).cast("string")
    parts = F.struct(none.alias("head"), none.alias("tail"))
    for mark in reversed(RELATION_MARKS):
        at = F.instr(raw, mark)
        head = tx.strip(F.substring(raw, F.lit(1), at - 1))
        pick = F.struct(head.alias("head"), F.substring(raw, at + len(mark), F.length(raw)).alias("tail"))
        parts = F.when((at > 0) & (head != ""), pick).otherwise(parts)

    # only what was picked is cleaned, once
    def named(p: Column) -> Column:
        plain = F.struct(F.lit(UNSPECIFIED).alias("relation_type"), raw.alias("keywords"))
        both = F.struct(p["head"].alias("relation_type"), F.when(p["tail"] == "", p["head"]).otherwise(p["tail"]).alias("keywords"))
        return F.when(p["head"] != "", both).otherwise(plain)

    def cleaned(p: Column) -> Column:
        two = F.transform(F.array(p["head"], p["tail"]), lambda x: F.when(x.isNotNull(), tx.clean_str(x)))
        return tx.let(two, lambda t: F.struct(F.get(t, F.lit(0)).alias("head"), F.get(t, F.lit(1)).alias("tail")))

    return tx.let(tx.let(parts, cleaned), named)


def parse_extraction_tuples(responses: DataFrame, chunk_id: str = "chunk_id", text: str = "response", ord_col: str = "ord") -> tuple[DataFrame, DataFrame]:
    """Node and edge candidates of tuple-protocol responses; both sides read one scan."""
    records = responses.select(
        F.col(chunk_id).alias("source_id"),
        F.col(ord_col).alias("_o"),
        F.posexplode(tx.split_markers(F.col(text), [RECORD_MARK, DONE_MARK])).alias("_p", "_rec"),
    )
    body = F.regexp_extract("_rec", r"\((.*)\)", 1)
    rows = records.where(F.col("_rec").rlike(r"\(.*\)")).select(
        "source_id", ord_key(records, "_o", F.col("_p")).alias("ord"), tx.split_markers(body, [TUPLE_MARK]).alias("a")
    )
    a = F.col("a")
    # only the fields that are used, cleaned once, into a table: the entity table is part of every expression that decodes
    upper, plain = F.transform(F.slice(a, 2, 2), lambda x: tx.clean_str(F.upper(x))), F.transform(F.slice(a, 4, 2), tx.clean_str)
    last = F.get(a, F.size(a) - 1)
    rows = cut(rows.select("source_id", "ord", F.get(a, F.lit(0)).alias("kind"), F.size(a).alias("n"), upper.alias("upper"), plain.alias("plain"), last.alias("last")))
    plain, upper = F.col("plain"), F.col("upper")
    nodes = (
        rows.where((F.col("n") >= 4) & (F.col("kind") == '"entity"'))
        .select(
            F.get(upper, F.lit(0)).alias("entity_name"),
            F.get(upper, F.lit(1)).alias("entity_type"),
            F.lit(1).alias("votes"),
            F.get(plain, F.lit(0)).alias("description"),
            "source_id",
            "ord",
        )
        .where(tx.strip(F.col("entity_name")) != "")
    )
    last = F.col("last")
    rel = split_relation_type(F.get(plain, F.lit(1)))
    edges = rows.where((F.col("n") >= 5) & (F.col("kind") == '"relationship"')).select(
        F.get(upper, F.lit(0)).alias("src"),
        F.get(upper, F.lit(1)).alias("dst"),
        F.when(last.rlike(r"^[-+]?[0-9]*\.?[0-9]+$"), last.try_cast("double")).otherwise(F.lit(1.0)).alias("weight"),
        F.get(plain, F.lit(0)).alias("description"),
        rel["keywords"].alias("keywords"),
        rel["relation_type"].alias("relation_type"),
        "source_id",
        F.lit(None).cast("string").alias("source_set"),
        "ord",
    )
    return nodes, edges


# --- records to candidates ---------------------------------------------------------------------


def record_chunk_id(doc_name: Column, record_id: Column) -> Column:
    return tx.md5_id(F.concat(doc_name, F.lit("::"), record_id), "chunk-faultcase-")


def faultcase_description() -> Column:
    def joined(c: str) -> Column:
        items = tx.clean_list(F.col(c))
        return F.when(F.size(items) > 0, F.array_join(items, "；")).otherwise(F.lit(rec.NONE))

    symptom = rec.or_none(F.coalesce(F.nullif(F.col("symptom"), F.lit("")), F.col("fault")))
    parts = [("故障现象", symptom), ("可能原因", joined("causes")), ("处理步骤", joined("actions")), ("可能后果", joined("consequences")),
             ("关键部件", joined("key_components")), ("注意事项", joined("precautions")),
             ("breadcrumb", rec.or_none(F.col("breadcrumb"))), ("原始文本", rec.or_none(F.col("source_text")))]
    return F.concat_ws(" ", *[F.concat(F.lit(f"{k}: "), v) for k, v in parts])


def records_to_candidates(records: DataFrame, ord_col: str = "ord") -> tuple[DataFrame, DataFrame]:
    """Equipment and fault-card nodes with their edge, for every record."""
    r = records.withColumn("_e", rec.or_none(F.col("equipment"))).withColumn(
        "_f", rec.faultcase_name(F.col("equipment"), F.col("fault"))
    ).withColumn("_c", record_chunk_id(F.col("doc_name"), rec.or_none(F.col("record_id"))))
    e_text = F.concat("_e", F.lit("，本记录对应故障卡片："), rec.or_none(F.col("fault")), F.lit("。"))
    pair = F.array(
        F.struct(F.col("_e").alias("n"), F.lit("EQUIPMENT").alias("t"), e_text.alias("d")),
        F.struct(F.col("_f").alias("n"), F.lit("FAULTCASE").alias("t"), faultcase_description().alias("d")),
    )
    nodes = r.select("_c", ord_col, F.posexplode(pair).alias("_p", "x")).select(
        F.col("x.n").alias("entity_name"),
        F.col("x.t").alias("entity_type"),
        F.lit(1).alias("votes"),
        F.col("x.d").alias("description"),
        F.col("_c").alias("source_id"),
        ord_key(records, ord_col, F.col("_p")).alias("ord"),
    )
    desc, kw, rel, weight = CASE_EDGE
    edges = r.select(
        F.col("_e").alias("src"), F.col("_f").alias("dst"), F.lit(weight).alias("weight"), F.lit(desc).alias("description"),
        F.lit(kw).alias("keywords"), F.lit(rel).alias("relation_type"), F.col("_c").alias("source_id"),
        F.lit(None).cast("string").alias("source_set"), ord_key(records, ord_col, F.lit(0)).alias("ord"),
    )
    return nodes, edges


def normalize_doc_name(doc_name: Column) -> Column:
    plain = F.replace(tx.strip(tx.text_or_empty(doc_name)), F.lit(".md"), F.lit(""))
    return F.regexp_replace(plain, r"_[^_]+_\d+$", "")


def parent_name(title: Column, rules=PARENT_RULES) -> Column:
    """First rule whose keyword the title contains, else the title itself."""
    t = tx.strip(tx.text_or_empty(title))
    out = F.when(t == "", F.lit(DEFAULT_PARENT)).otherwise(t)
    for keyword, parent in reversed(rules):
        out = F.when(F.contains(t, F.lit(keyword)), F.lit(parent)).otherwise(out)
    return out


def resolve_parents(records: DataFrame, scope_mode: str = "auto", rules=PARENT_RULES, namer=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parent nodes per document or section: node candidates, edge candidates, source sets.

    ``namer`` is an optional column function ``(scope_title, rule_name) -> name`` whose null
    result falls back to the rule.
    """
    doc = normalize_doc_name(F.col("doc_name"))
    parts = rec.breadcrumb_parts(F.col("breadcrumb"))
    chapter, sub = (F.coalesce(F.get(parts, F.lit(i)), F.lit("")) for i in (1, 2))
    large = doc.rlike("|".join(LARGE_MANUAL_MARKS))
    by_section = {"section": F.lit(True), "doc": F.lit(False), "auto": large}[scope_mode]
    inner = F.array_join(F.filter(F.array(chapter, sub), lambda x: x != ""), " > ")
    r = records.select(
        "doc_name",
        doc.alias("_doc"),
        by_section.alias("_sec"),
        F.when(by_section, F.when(inner == "", doc).otherwise(inner)).otherwise(doc).alias("_title"),
        rec.or_none(F.col("equipment")).alias("_e"),
        record_chunk_id(F.col("doc_name"), rec.or_none(F.col("record_id"))).alias("source_id"),
    ).withColumn("set_id", F.md5(F.concat_ws("\x01", "doc_name", "_title")))
    rule = parent_name(F.col("_title"), rules)
    name = F.coalesce(namer(F.col("_title"), rule), rule) if namer else rule
    scopes = r.groupBy("set_id", "doc_name", "_doc", "_sec", "_title").agg(F.count(F.lit(1)).alias("_n")).withColumn("_p", name)
    key = F.when(F.col("_sec"), F.concat("_p", F.lit("｜"), "_title")).otherwise(F.col("_p"))
    about = F.when(
        F.col("_title") != F.col("_doc"),
        F.concat("_p", F.lit("，由文档《"), "_doc", F.lit("》中范围“"), "_title", F.lit("”归纳出的公共父节点，当前汇聚 "), F.col("_n").cast("string"), F.lit(" 条故障卡片记录。")),
    ).otherwise(
        F.concat("_p", F.lit("，由文档《"), "_doc", F.lit("》归纳出的父级装备节点，当前汇聚 "), F.col("_n").cast("string"), F.lit(" 条故障卡片记录。"))
    )
    scopes = scopes.select("set_id", "doc_name", key.alias("parent"), about.alias("about"))
    sets = r.select("set_id", "source_id").distinct()
    at_end = F.concat(F.lit("\U0010ffff"), "doc_name")  # after every record
    # one voting row with the description, then one row per source without a vote
    nodes = scopes.select(
        F.col("parent").alias("entity_name"), F.lit("DOCROOT").alias("entity_type"), F.lit(1).alias("votes"),
        F.col("about").alias("description"), F.lit(None).cast("string").alias("source_id"), at_end.alias("ord"),
    ).unionByName(
        sets.join(scopes, "set_id").select(
            F.col("parent").alias("entity_name"), F.lit("DOCROOT").alias("entity_type"), F.lit(0).alias("votes"),
            F.lit(None).cast("string").alias("description"), "source_id", at_end.alias("ord"),
        )
    )
    desc, kw, rel, weight = PARENT_EDGE
    edges = (
        r.select("set_id", "_e").distinct().join(scopes, "set_id").where(F.col("_e") != F.col("parent")).select(
            F.col("parent").alias("src"), F.col("_e").alias("dst"), F.lit(weight).alias("weight"), F.lit(desc).alias("description"),
            F.lit(kw).alias("keywords"), F.lit(rel).alias("relation_type"), F.lit(None).cast("string").alias("source_id"),
            F.col("set_id").alias("source_set"), at_end.alias("ord"),
        )
    )
    return nodes, edges, sets


# --- merging -----------------------------------------------------------------------------------


def merge_nodes(candidates: DataFrame, existing: Graph | None = None) -> tuple[DataFrame, DataFrame]:
    """``(nodes, node_facets)``: most frequent type (ties: first seen, new before existing),
    distinct descriptions and sources."""
    votes = candidates.groupBy("entity_name", "entity_type").agg(
        F.sum("votes").alias("v"), F.min(F.struct(F.lit(0).alias("old"), F.col("ord").alias("o"))).alias("f")
    )
    facets = _facets(candidates, ["entity_name"], {"description": "description", "source": "source_id"})
    if existing is not None:
        old = existing.nodes.select(
            "entity_name", "entity_type", F.lit(1).cast("long").alias("v"), F.struct(F.lit(1).alias("old"), F.lit("").alias("o")).alias("f")
        )
        votes = votes.unionByName(old).groupBy("entity_name", "entity_type").agg(F.sum("v").alias("v"), F.min("f").alias("f"))
        facets = facets.unionByName(existing.node_facets)
    best = F.struct(-F.col("v"), F.col("f"))
    nodes = votes.groupBy("entity_name").agg(F.min_by("entity_type", best).alias("entity_type"))
    return nodes, facets if existing is None else facets.distinct()


def canonical_edges(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Undirected form: the smaller endpoint first."""
    return edges.withColumns({src: F.least(src, dst), dst: F.greatest(src, dst)})


def merge_edges(candidates: DataFrame, existing: Graph | None = None, count_once: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(edges, edge_facets)``: weights added up, distinct texts of all candidates.  ``count_once``: the weight of a
    candidate whose source already stands on the existing edge is not added again, so a re-run changes nothing."""
    c = w = canonical_edges(candidates)
    if existing is not None and count_once:
        seen = existing.edge_facets.where(F.col("facet").isin("source", "source_set")).select(
            "src", "dst", F.col("value").alias("_ref")
        )
        w = c.withColumn("_ref", F.coalesce("source_id", "source_set")).join(seen, ["src", "dst", "_ref"], "left_anti").drop("_ref")
    edges = w.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    facets = _facets(
        c, ["src", "dst"],
        {"description": "description", "keywords": "keywords", "relation_type": "relation_type", "source": "source_id", "source_set": "source_set"},
    ).where("NOT (facet = 'relation_type' AND value = '')")
    if existing is not None:
        edges = edges.unionByName(existing.edges.select("src", "dst", "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
        facets = facets.unionByName(existing.edge_facets).distinct()
    untyped = edges.join(facets.where("facet = 'relation_type'"), ["src", "dst"], "left_anti").select(
        "src", "dst", F.lit("relation_type").alias("facet"), F.lit(UNSPECIFIED).alias("value")
    )
    return edges, facets.unionByName(untyped)


def _facets(df: DataFrame, keys: list[str], cols: dict[str, str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(c).alias("value")) for f, c in cols.items()])
    return (
        df.select(*keys, F.explode(pairs).alias("x"))
        .select(*keys, "x.facet", "x.value")
        .where("value IS NOT NULL")
        .distinct()
    )


def stub_nodes(edges: DataFrame, edge_facets: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes for edge endpoints that are missing, described by their first edge (in key order)."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("entity_name"), "src", "dst")
    missing = (
        ends.join(nodes.select("entity_name"), "entity_name", "left_anti")
        .groupBy("entity_name")
        .agg(F.min(F.struct("src", "dst")).alias("e"))
        .select("entity_name", "e.src", "e.dst")
    )
    facets = missing.join(edge_facets.where("facet IN ('description', 'source')"), ["src", "dst"]).select("entity_name", "facet", "value")
    return missing.select("entity_name", F.lit(STUB_TYPE).alias("entity_type")), facets


def build_graph(node_candidates: DataFrame, edge_candidates: DataFrame, source_sets: DataFrame | None = None, existing: Graph | None = None, review=None, count_once: bool = False) -> Graph:
    """Merge candidates into a graph.  ``review`` may change the candidates first; ``count_once``: see merge_edges."""
    if review is not None:
        node_candidates, edge_candidates = review(node_candidates, edge_candidates)
    nodes, nf = merge_nodes(node_candidates, existing)
    if existing is not None:
        nodes = nodes.unionByName(existing.nodes.join(nodes, "entity_name", "left_anti").select("entity_name", "entity_type"))
    edges, ef = merge_edges(edge_candidates, existing, count_once)
    # each merged table is read several times below and by every user of the graph
    nodes, nf, edges, ef = cut(nodes), cut(nf), cut(edges), cut(ef)
    stubs, sf = stub_nodes(edges, ef, nodes)
    if existing is not None and existing.source_sets is not None:
        source_sets = existing.source_sets if source_sets is None else source_sets.unionByName(existing.source_sets).distinct()
    return Graph(nodes.unionByName(stubs), nf.unionByName(sf).distinct(), edges, ef, source_sets)


def record_graph(records: DataFrame, scope_mode: str = "auto", rules=PARENT_RULES, ord_col: str = "ord") -> Graph:
    """Records straight to a graph with fault cards, equipment and parents."""
    n1, e1 = records_to_candidates(records, ord_col)
    n2, e2, sets = resolve_parents(records, scope_mode, rules)
    return build_graph(n1.unionByName(n2), e1.unionByName(e2), sets)


# --- rendering and indexes ---------------------------------------------------------------------


def _rendered(base: DataFrame, facets: DataFrame, keys: list[str], names: dict[str, str], part_rows: int) -> DataFrame:
    lists = ordered_parts(facets, [*keys, "facet"], "value", "value", "items", part_rows)
    wide = lists.groupBy(*keys, "part_no").pivot("facet", list(names)).agg(F.first("items"))
    out = base.join(wide, keys, "left").withColumn("part_no", F.coalesce("part_no", F.lit(0)))
    empty = F.array().cast("array<string>")
    return out.select(*base.columns, "part_no", *[F.coalesce(F.col(f), empty).alias(n) for f, n in names.items()])


def render_nodes(graph: Graph, part_rows: int = 10_000) -> DataFrame:
    """Nodes with sorted ``descriptions`` and ``source_ids``; very long lists in numbered parts."""
    return _rendered(graph.nodes, graph.node_facets, ["entity_name"], {"description": "descriptions", "source": "source_ids"}, part_rows)


def render_edges(graph: Graph, part_rows: int = 10_000) -> DataFrame:
    """Edges with sorted facet lists; shared source lists stay references (``source_sets``)."""
    names = {"description": "descriptions", "keywords": "keywords", "relation_type": "relation_types", "source": "source_ids", "source_set": "source_set_ids"}
    return _rendered(graph.edges, graph.edge_facets, ["src", "dst"], names, part_rows)


def index_documents(graph: Graph, part_rows: int = 10_000) -> DataFrame:
    """Texts to embed: entity, entity-name and relation documents ``(namespace, id, part_no, content)``."""
    n, e = render_nodes(graph, part_rows), render_edges(graph, part_rows)
    first = F.col("part_no") == 0

    def headed(head: Column, body: Column) -> Column:
        return F.when(first, F.concat(head, F.lit(" "), body)).otherwise(body)

    entity = n.select(
        F.lit("entities").alias("namespace"), tx.md5_id(F.col("entity_name"), "ent-").alias("id"), "part_no",
        headed(F.col("entity_name"), F.array_join("descriptions", tx.SEP)).alias("content"),
    )
    name = n.where(first).select(
        F.lit("entities_name").alias("namespace"), tx.md5_id(F.col("entity_name"), "Ename-").alias("id"), "part_no", F.col("entity_name").alias("content")
    )
    head = F.concat_ws(" ", F.array_join("keywords", tx.SEP), F.array_join("relation_types", tx.SEP), "src", "dst")
    relation = e.select(
        F.lit("relationships").alias("namespace"), tx.md5_id(F.concat("src", "dst"), "rel-").alias("id"), "part_no",
        headed(head, F.array_join("descriptions", tx.SEP)).alias("content"),
    )
    return entity.unionByName(name).unionByName(relation)


def edge_id(src: Column, dst: Column) -> Column:
    return F.concat(src, F.lit("->"), dst)


def source_index(graph: Graph) -> DataFrame:
    """Inverted index ``(source_id, kind, item_id)`` with kinds ``node``, ``edge`` and
    ``edge_set`` (an edge reached through a shared source list, by ``set_id``)."""
    nodes = graph.node_facets.where("facet = 'source'").select(
        F.col("value").alias("source_id"), F.lit("node").alias("kind"), F.col("entity_name").alias("item_id")
    )
    ef = graph.edge_facets
    edges = ef.where("facet = 'source'").select(
        F.col("value").alias("source_id"), F.lit("edge").alias("kind"), edge_id(F.col("src"), F.col("dst")).alias("item_id")
    )
    out = nodes.unionByName(edges)
    if graph.source_sets is not None:
        shared = ef.where("facet = 'source_set'").select(F.col("value").alias("source_id"), F.lit("edge_set").alias("kind"), edge_id(F.col("src"), F.col("dst")).alias("item_id"))
        out = out.unionByName(shared)
    return out


def expand_fault_properties(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """Synthetic property nodes and edges from the card sections in fault-card descriptions."""
    cases = graph.nodes.where(F.upper(F.replace("entity_type", F.lit('"'), F.lit(""))) == "FAULTCASE").select("entity_name")
    texts = graph.node_facets.where("facet = 'description'").join(cases, "entity_name", "left_semi")
    sections = rec.parse_card_sections(texts, "entity_name", "value")
    pid = F.concat(F.lit("fault-property::"), "entity_name", F.lit("::"), "label")
    nodes = sections.select(
        pid.alias("id"), F.lit("FAULT_PROPERTY").alias("entity_type"), F.col("entity_name").alias("faultcase_id"), F.col("label").alias("property_label"), "value"
    ).distinct()
    edges = sections.select(F.col("entity_name").alias("source"), pid.alias("target"), F.col("label").alias("type"), F.lit("out").alias("direction")).distinct()
    return nodes, edges


def doc_graph_contribution(graph: Graph, doc_sources: DataFrame, with_properties: bool = True) -> DataFrame:
    """Distinct nodes and edges that each document's sources touch: ``(doc_name, graph_nodes, graph_edges)``."""
    idx = source_index(graph)
    docs = doc_sources.select("doc_name", "source_id").distinct()
    refs = docs
    if graph.source_sets is not None:
        refs = docs.unionByName(
            docs.join(graph.source_sets, "source_id").select("doc_name", F.col("set_id").alias("source_id")).distinct()
        )
    touched = refs.join(idx, "source_id").select(
        "doc_name", F.when(F.col("kind") == "node", F.lit("n")).otherwise(F.lit("e")).alias("kind"), "item_id"
    ).distinct()
    if with_properties:
        props, _ = expand_fault_properties(graph)
        own = touched.where("kind = 'n'").join(
            props.select(F.col("faultcase_id").alias("item_id"), F.col("id").alias("_pid")).distinct(), "item_id"
        )
        extra = own.select("doc_name", F.explode(F.array(F.lit("n"), F.lit("e"))).alias("kind"), F.concat(F.lit("\x01"), "_pid").alias("item_id"))
        touched = touched.unionByName(extra.distinct())
    return touched.groupBy("doc_name").agg(
        F.count_if(F.col("kind") == "n").alias("graph_nodes"), F.count_if(F.col("kind") == "e").alias("graph_edges")
    )
