import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import graph as g
from corpusloom.operators import graph_build as gb
from corpusloom.operators import records as rec
from corpusloom.sources import readers as rd

RECORD = ("doc", "r1", "泵", "卡滞", "异响", ["磨损"], ["更换", "检查"], [], ["断电"], ["轴承"], "泵卡滞", "book > ch > sec", "sec")
SCHEMA = "doc_name string, record_id string, equipment string, fault string, symptom string, causes array<string>, actions array<string>, consequences array<string>, precautions array<string>, key_components array<string>, source_text string, breadcrumb string, record_title string"


def records(spark, rows=(RECORD,)):
    return spark.createDataFrame(list(rows), SCHEMA).withColumn("ord", F.col("record_id"))


def test_one_record_gives_six_nodes_and_five_edges_with_properties(spark):
    # equipment and fault card plus the card's expandable sections
    n, e = gb.records_to_candidates(records(spark))
    graph = gb.build_graph(n, e)
    pn, pe = gb.expand_fault_properties(graph)
    labels = {r.property_label for r in pn.collect()}
    assert labels == {"故障现象", "可能原因", "处理步骤", "关键部件", "注意事项"}
    assert graph.nodes.count() + pn.count() == 2 + 5 and graph.edges.count() + pe.count() == 1 + 5


def test_card_round_trip(spark):
    out = rec.parse_card_sections(records(spark).select("record_id", rec.render_card().alias("card")), "record_id", "card").collect()
    got = {r.label: r.value for r in out}
    assert got["处理步骤"] == "1. 更换\n2. 检查" and got["故障现象"] == "异响" and "可能后果" not in got


def test_rerun_changes_nothing(spark):
    r = records(spark)
    n, e = gb.records_to_candidates(r)
    first = gb.build_graph(n, e)
    again = gb.build_graph(n, e, existing=first, count_once=True)
    for a, b in ((first.nodes, again.nodes), (first.edges, again.edges), (first.node_facets, again.node_facets), (first.edge_facets, again.edge_facets)):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))


def test_merging_into_a_graph_adds_weights_and_texts(spark):
    n, e = gb.records_to_candidates(records(spark))
    first = gb.build_graph(n, e)
    more = e.withColumn("description", F.concat(F.coalesce("description", F.lit("")), F.lit(" again")))
    again = gb.build_graph(n, more, existing=first)
    old, new = ({(r.src, r.dst): r.weight for r in g.edges.collect()} for g in (first, again))
    assert new == {k: 2 * w for k, w in old.items()}
    texts = lambda g: {(r.src, r.dst, r.value) for r in g.edge_facets.where("facet = 'description'").collect()}
    assert texts(first) < texts(again)


def test_section_scope_and_rules(spark):
    rows = [("柴油机维护与修理_v1_3.md", "r1", "泵", "卡滞", "", [], [], [], [], [], "", "book.md > 液压设备 > 泵", ""), ("舵机手册", "r2", "舵", "漏油", "", [], [], [], [], [], "", "b > x", "")]
    n, e, s = gb.resolve_parents(records(spark, rows))
    assert {r.entity_name for r in n.collect()} == {"船舶液压系统｜液压设备 > 泵", "船舶舵机"}
    assert {(r.src, r.dst, r.weight) for r in e.collect()} == {("船舶液压系统｜液压设备 > 泵", "泵", 5.0), ("船舶舵机", "舵", 5.0)}


def test_equipment_hints(spark):
    df = spark.createDataFrame([("1.2 驾驶台供电故障",), ("主、辅机供油异常",)], "t string")
    assert [r.h for r in df.select(rec.equipment_hint(F.col("t")).alias("h")).collect()] == ["驾驶台供电系统", "主辅机供油系统"]


def test_components_equal_union_find(spark):
    rng = random.Random(7)
    edges = [(f"n{rng.randint(0, 400)}", f"n{rng.randint(0, 400)}") for _ in range(330)] + [(f"p{i}", f"p{i + 1}") for i in range(60)] + [("loop", "loop")]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.entity_name: r.component for r in g.connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {x: find(x) for x in parent}


def test_full_graph_limits(spark):
    nodes = spark.createDataFrame([("A", "EQUIPMENT"), ("B", "FAULTCASE")], "entity_name string, entity_type string")
    edges = spark.createDataFrame([("A", "B")], "src string, dst string")
    assert g.full_graph(nodes, edges)[2] == "ready"
    assert g.full_graph(nodes.limit(0), edges.limit(0))[2] == "empty"
    with pytest.raises(g.GraphTooLarge):
        g.full_graph(nodes, edges, max_nodes=1)


def test_paths_do_not_reuse_edges(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")], "src string, dst string")
    out = {">".join(r.path) for r in g.k_hop_paths(spark.createDataFrame([("a",)], "start string"), edges, 3).collect()}
    assert out == {"a>b>c>a", "a>b>c>d", "a>c>b>a", "a>c>d"}


def test_walks_follow_edges(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    out = g.random_walks(edges, 3, 6).collect()
    ok = {("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("c", "d"), ("d", "c")}
    assert len(out) == 12 and all(len(r.nodes) == 6 and all(p in ok for p in zip(r.nodes, r.nodes[1:])) for r in out)


def test_graphml(spark, tmp_path):
    (tmp_path / "g.graphml").write_text(
        '<?xml version="1.0"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="d0" for="node" attr.name="entity_type"/>'
        '<key id="d1" for="node" attr.name="description"/><key id="d3" for="edge" attr.name="weight"/><graph edgedefault="undirected">'
        '<node id="&quot;A&quot;"><data key="d0">"EQUIPMENT"</data><data key="d1">pump</data></node><node id="B"></node>'
        '<edge source="&quot;A&quot;" target="B"><data key="d3">2.5</data></edge></graph></graphml>'
    )
    n, e = rd.read_graphml(spark, str(tmp_path))
    assert {(r.entity_name, r.entity_type, r.description) for r in n.collect()} == {("A", "EQUIPMENT", "pump"), ("B", "", "")}
    assert [(r.src, r.dst, r.weight) for r in e.collect()] == [("A", "B", 2.5)]


def test_large_labels_are_split(spark, monkeypatch):
    """One giant component, one star and a chain: components as by a plain search, with the giant label's rows in many splits."""
    import random

    from corpusloom.operators import graph as g

    monkeypatch.setattr(g, "LABEL_ROWS", 20)
    rng = random.Random(2)
    edges = [(f"n{rng.randrange(300):03d}", f"n{rng.randrange(300):03d}") for _ in range(420)] + [("hub", f"s{i}") for i in range(150)] + [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(60)] + [("x", "x")]
    parent = {v: v for e in edges for v in e}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    df = spark.createDataFrame(edges, "src string, dst string")
    assert {r.entity_name: r.component for r in g.connected_components(df).collect()} == {v: top(v) for v in parent}
    star = spark.createDataFrame([("hub", f"s{i:03d}") for i in range(150)], "a string, b string")
    got = g.with_smallest(star, 150)
    assert {tuple(r) for r in got.collect()} == {("hub", f"s{i:03d}", "hub") for i in range(150)}
