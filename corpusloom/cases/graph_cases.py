"""Graph queries and analytics."""

from pyspark.sql import functions as F

from corpusloom.cases import case
from corpusloom.cases import views as v
from corpusloom.operators import graph as g
from corpusloom.operators import graph_build as gb
from corpusloom.plans.session import tables


@case("f01_entity_types", f"WITH {v.CAND} SELECT DISTINCT lower(entity_type) AS type_lower, entity_type FROM nodes")
def _(spark, sf):
    return g.entity_types(v.graph(tables(spark, sf)).nodes)


@case("f01_nodes_of_types", f"WITH {v.CAND} SELECT * FROM nodes WHERE entity_type IN ('EQUIPMENT', 'DOCROOT')")
def _(spark, sf):
    return g.nodes_of_types(v.graph(tables(spark, sf)).nodes, ['"EQUIPMENT"', "DOCROOT"])


@case(
    "f02_lookup_nodes",
    f"WITH {v.CAND} SELECT p_partkey, p_name AS entity_name, entity_type, entity_type IS NOT NULL AS found FROM (SELECT p_partkey, CASE WHEN p_size > 25 THEN p_brand ELSE p_name END AS p_name FROM part) LEFT JOIN nodes ON p_name = entity_name",
)
def _(spark, sf):
    t = tables(spark, sf)
    keys = t("part").select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise(F.col("p_name")).alias("entity_name"))
    return g.lookup_nodes(keys, v.graph(t).nodes).select("p_partkey", "entity_name", "entity_type", "found")


@case(
    "f02_lookup_edges",
    f"WITH {v.PS} SELECT 'S' || o_custkey AS a, 'P' || o_orderkey AS b, weight, weight IS NOT NULL AS found FROM orders LEFT JOIN ps ON src = 'P' || o_orderkey AND dst = 'S' || o_custkey",
)
def _(spark, sf):
    t = tables(spark, sf)
    pairs = t("orders").select(F.concat(F.lit("S"), "o_custkey").alias("a"), F.concat(F.lit("P"), "o_orderkey").alias("b"))
    return g.lookup_edges(pairs, v.part_supplier(t)).select("a", "b", "weight", "found")


@case(
    "f03_node_degree",
    f"WITH {v.PS} SELECT n AS entity_name, count(*) AS degree FROM (SELECT src AS n FROM ps UNION ALL SELECT dst FROM ps) GROUP BY n",
)
def _(spark, sf):
    return g.node_degree(v.part_supplier(tables(spark, sf)))


@case(
    "f03_edge_degree",
    f"WITH {v.PS}, d AS (SELECT n, count(*) AS c FROM (SELECT src AS n FROM ps UNION ALL SELECT dst FROM ps) GROUP BY n) SELECT src, dst, x.c + y.c AS degree FROM ps JOIN d x ON x.n = src JOIN d y ON y.n = dst",
)
def _(spark, sf):
    return g.edge_degree(v.part_supplier(tables(spark, sf)))


@case(
    "f04_neighbors",
    f"WITH {v.PS}, s AS (SELECT 'S' || s_suppkey AS k FROM supplier) SELECT dst AS entity_name, src AS neighbor FROM ps WHERE dst IN (SELECT k FROM s)",
)
def _(spark, sf):
    t = tables(spark, sf)
    return g.neighbors(t("supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("entity_name")), v.part_supplier(t))


@case(
    "f05_k_hop_paths",
    f"""WITH {v.TREE}, rn AS (SELECT src AS r, dst AS n FROM tree WHERE src LIKE 'R%'), ns AS (SELECT src AS n, dst AS s FROM tree WHERE src LIKE 'N%')
    SELECT n || '>' || s AS path FROM ns UNION ALL SELECT a.n || '>' || a.r || '>' || b.n || coalesce('>' || s, '')
    FROM rn a JOIN rn b ON a.r = b.r AND a.n <> b.n LEFT JOIN ns ON ns.n = b.n""",
)
def _(spark, sf):
    t = tables(spark, sf)
    starts = t("nation").select(F.concat(F.lit("N"), "n_nationkey").alias("start"))
    return g.k_hop_paths(starts, v.hierarchy(t), 3).select(F.array_join("path", ">").alias("path"))


EGO = f"""{v.PS}, h1 AS (SELECT src AS n FROM ps WHERE dst = 'S0'), h2 AS (SELECT DISTINCT dst AS n FROM ps WHERE src IN (SELECT n FROM h1) AND dst <> 'S0')"""


@case("f06_ego_nodes", f"WITH {EGO} SELECT 'S0' AS entity_name, 0 AS depth UNION ALL SELECT n, 1 FROM h1 UNION ALL SELECT n, 2 FROM h2")
def _(spark, sf):
    return _ego(spark, sf)[0].select("entity_name", "depth")


@case("f06_ego_edges", f"WITH {EGO} SELECT src, dst FROM ps WHERE src IN (SELECT n FROM h1)")
def _(spark, sf):
    return _ego(spark, sf)[1].select("src", "dst")


def _ego(spark, sf):
    e = v.part_supplier(tables(spark, sf))
    nodes = e.select(F.explode(F.array("src", "dst")).alias("entity_name")).distinct()
    return g.ego_subgraph(spark.createDataFrame([("S0",), ("absent",)], "start string"), nodes, e, 2)


@case("f07_full_graph", f"WITH {v.TREE} SELECT src, dst, 'ready' AS state FROM tree")
def _(spark, sf):
    e = v.hierarchy(tables(spark, sf))
    nodes = e.select(F.explode(F.array("src", "dst")).alias("entity_name")).distinct()
    _n, edges, state = g.full_graph(nodes, e, 2_000_000, 5_000_000)
    return edges.select("src", "dst", F.lit(state).alias("state"))


@case(
    "f08_graph_summary",
    f"WITH {v.CAND} SELECT 'type' AS metric, entity_type AS name, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'total_nodes', '', count(*) FROM nodes UNION ALL SELECT 'total_edges', '', count(*) FROM edges",
)
def _(spark, sf):
    gr = v.graph(tables(spark, sf))
    return g.graph_summary(gr.nodes, gr.edges)


@case(
    "f09_node_detail",
    f"""WITH {v.CAND}, sym AS (SELECT src AS a, dst AS b, 'outgoing' AS dir, rels FROM edges UNION ALL SELECT dst, src, 'incoming', rels FROM edges),
    r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY b) AS k, count(*) OVER (PARTITION BY a) AS degree FROM sym)
    SELECT entity_name, entity_type, any_value(degree) AS degree, string_agg(b || '/' || dir || '/' || rels, '|' ORDER BY k) FILTER (k <= 20) AS relationships
    FROM nodes JOIN r ON a = entity_name GROUP BY 1, 2""",
)
def _(spark, sf):
    gr = v.graph(tables(spark, sf))
    types = gr.edge_facets.where("facet = 'relation_type'").select("src", "dst", F.col("value").alias("relation_type"))
    d = g.node_detail(gr.nodes, gr.nodes, types)
    rel = F.transform("relationships", lambda x: F.concat_ws("/", x["label"], x["direction"], x["type"]))
    return d.select("entity_name", "entity_type", "degree", F.array_join(rel, "|").alias("relationships"))


@case("f10_label_entries", f"WITH {v.CAND} SELECT entity_name AS label, entity_type FROM nodes ORDER BY 1, 2 LIMIT 100")
def _(spark, sf):
    return g.label_entries(v.graph(tables(spark, sf)).nodes, 100)


@case(
    "f11_search_labels",
    f"""WITH {v.CAND} SELECT entity_name AS label, entity_type, CASE WHEN entity_name = 'red ring' THEN -1 WHEN entity_type = 'DOCROOT' THEN 0 ELSE 2 END AS priority
    FROM nodes WHERE entity_type IN ('DOCROOT', 'EQUIPMENT') AND contains(lower(entity_name), 'r')""",
)
def _(spark, sf):
    return g.search_labels(g.label_entries(v.graph(tables(spark, sf)).nodes), " R ", "red ring")


@case("f11_default_roots", f"WITH {v.CAND} SELECT entity_name AS label, entity_type, 0 AS priority FROM nodes WHERE entity_type = 'DOCROOT'")
def _(spark, sf):
    return g.search_labels(g.label_entries(v.graph(tables(spark, sf)).nodes))


@case(
    "f12_induced_subgraph",
    f"WITH {v.CAND} SELECT src, dst, weight FROM edges WHERE rels = 'Has_Equipment'",
)
def _(spark, sf):
    gr = v.graph(tables(spark, sf))
    return g.induced_subgraph(gr.nodes, gr.edges, ["DOCROOT", "EQUIPMENT"])[1].select("src", "dst", "weight")


@case("f12_visible_types", f"WITH {v.CAND} SELECT entity_type, count(*) AS n FROM nodes WHERE entity_type <> 'FAULTCASE' GROUP BY 1")
def _(spark, sf):
    gr = v.graph(tables(spark, sf))
    return g.induced_subgraph(gr.nodes, gr.edges, ["DOCROOT", "EQUIPMENT"])[2]


@case(
    "f13_delete_entities",
    f"""WITH {v.CAND}, gone AS (SELECT DISTINCT p_name FROM part WHERE p_name LIKE '%ring'), ix AS (SELECT 'ent-' || md5(entity_name) AS id, entity_name AS a, entity_name AS b FROM nodes
        UNION ALL SELECT 'Ename-' || md5(entity_name), entity_name, entity_name FROM nodes UNION ALL SELECT 'rel-' || md5(src || dst), src, dst FROM edges)
    SELECT 'node' AS kind, entity_name AS item FROM nodes WHERE entity_name NOT IN (SELECT p_name FROM gone)
    UNION ALL SELECT 'edge', src || '->' || dst FROM edges WHERE src NOT IN (SELECT p_name FROM gone) AND dst NOT IN (SELECT p_name FROM gone)
    UNION ALL SELECT 'index', id FROM ix WHERE a NOT IN (SELECT p_name FROM gone) AND b NOT IN (SELECT p_name FROM gone)""",
)
def _(spark, sf):
    t = tables(spark, sf)
    gr = v.graph(t)
    index = gb.index_documents(gr).select("id")
    gone = t("part").where("p_name LIKE '%ring'").select(F.col("p_name").alias("entity_name"))
    n, e, i = g.delete_entities(gone, gr.nodes, gr.edges, index)
    out = n.select(F.lit("node").alias("kind"), F.col("entity_name").alias("item"))
    out = out.unionByName(e.select(F.lit("edge").alias("kind"), gb.edge_id(F.col("src"), F.col("dst")).alias("item")))
    return out.unionByName(i.select(F.lit("index").alias("kind"), F.col("id").alias("item")))


@case(
    "f13_delete_edges",
    f"WITH {v.PS} SELECT src, dst, weight FROM ps WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_returnflag = 'R' AND src = 'P' || l_partkey AND dst = 'S' || l_suppkey)",
)
def _(spark, sf):
    t = tables(spark, sf)
    gone = t("lineitem").where("l_returnflag = 'R'").select(F.concat(F.lit("S"), "l_suppkey").alias("src"), F.concat(F.lit("P"), "l_partkey").alias("dst"))
    return g.delete_edges(gone, v.part_supplier(t))


def _customer_orders(t):
    return t("orders").select(F.concat(F.lit("C"), "o_custkey").alias("src"), F.concat(F.lit("O"), "o_orderkey").alias("dst"))


@case(
    "f14_connected_components",
    """SELECT 'C' || o_custkey AS component, count(*) + 1 AS n FROM orders GROUP BY 1""",
)
def _(spark, sf):
    c = g.connected_components(_customer_orders(tables(spark, sf)))
    return c.groupBy("component").agg(F.count(F.lit(1)).alias("n"))


@case(
    "f14_largest_component",
    """WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT o_custkey FROM c ORDER BY n DESC, 'C' || o_custkey LIMIT 1)
    SELECT 'C' || o_custkey AS src, 'O' || o_orderkey AS dst FROM orders WHERE o_custkey IN (SELECT o_custkey FROM b)""",
)
def _(spark, sf):
    e = _customer_orders(tables(spark, sf))
    nodes = e.select(F.explode(F.array("src", "dst")).alias("entity_name")).distinct()
    return g.largest_component(nodes, e)[1].select("src", "dst")


@case(
    "f14_components_dense",
    f"""WITH RECURSIVE {v.PS}, e AS (SELECT src AS a, dst AS b FROM ps UNION ALL SELECT dst, src FROM ps),
    c(n, root) USING KEY (n) AS (SELECT a, min(least(a, b)) FROM e GROUP BY a
        UNION SELECT e.a, min(x.root) FROM c x JOIN e ON e.b = x.n JOIN recurring.c y ON y.n = e.a WHERE x.root < y.root GROUP BY e.a)
    SELECT root AS component, count(*) AS n FROM c GROUP BY root""",
)
def _(spark, sf):
    c = g.connected_components(v.part_supplier(tables(spark, sf)))
    return c.groupBy("component").agg(F.count(F.lit(1)).alias("n"))


@case(
    "f15_random_walks",
    f"""WITH RECURSIVE {v.PS}, bw AS (SELECT src AS a, dst AS b FROM ps UNION ALL SELECT dst, src FROM ps),
    num AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY b) AS no, count(*) OVER (PARTITION BY a) AS deg FROM bw),
    w(entity_name, walk, step, cur, nodes) AS (SELECT DISTINCT a, k, 0, a, a FROM bw, (VALUES (0), (1)) t(k)
        UNION ALL SELECT entity_name, walk, step + 1, b, nodes || '>' || b FROM w JOIN num
            ON a = cur AND no = ('0x' || substring(md5(entity_name || '~' || walk || '~' || (step + 1) || '~3'), 1, 15))::BIGINT % deg + 1 WHERE step < 5)
    SELECT entity_name, walk, nodes FROM w WHERE step = 5""",
)
def _(spark, sf):
    walks = g.random_walks(v.part_supplier(tables(spark, sf)), num_walks=2, walk_length=6)
    return walks.select("entity_name", "walk", F.array_join("nodes", ">").alias("nodes"))


MUT = f"""{v.PS}, mut AS (SELECT 'P' || l_partkey AS src, 'S' || l_suppkey AS dst, count(*)::DOUBLE AS weight FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1, 2)"""


def _parity(t):
    a = v.part_supplier(t)
    b = (
        t("lineitem").where("l_returnflag <> 'A'")
        .groupBy(F.concat(F.lit("P"), "l_partkey").alias("src"), F.concat(F.lit("S"), "l_suppkey").alias("dst"))
        .agg(F.count(F.lit(1)).cast("double").alias("weight"))
    )

    def nodes(e):
        n = e.select(F.explode(F.array("src", "dst")).alias("entity_name")).distinct()
        return n.withColumn("entity_type", F.substring("entity_name", 1, 1))

    return g.graph_parity(nodes(a), a, nodes(b), b), g.edge_parity(a, b, ["weight"])


@case(
    "f16_graph_parity",
    f"""WITH {MUT}, na AS (SELECT src AS n FROM ps UNION SELECT dst FROM ps), nb AS (SELECT src AS n FROM mut UNION SELECT dst FROM mut),
    odd AS (SELECT src, dst FROM ps EXCEPT SELECT src, dst FROM mut)
    SELECT n AS entity_name, true AS in_a, n IN (SELECT n FROM nb) AS in_b, n IN (SELECT n FROM nb) AS properties_match,
    n NOT IN (SELECT src FROM odd UNION SELECT dst FROM odd) AS neighbors_match FROM na""",
)
def _(spark, sf):
    return _parity(tables(spark, sf))[0]


@case(
    "f16_parity_summary",
    f"""WITH {MUT}, na AS (SELECT src AS n FROM ps UNION SELECT dst FROM ps), nb AS (SELECT src AS n FROM mut UNION SELECT dst FROM mut),
    odd AS (SELECT src, dst FROM ps EXCEPT SELECT src, dst FROM mut)
    SELECT (SELECT count(*) FROM na) AS nodes_a, (SELECT count(*) FROM nb) AS nodes_b, (SELECT count(*) FROM na WHERE n NOT IN (SELECT n FROM nb)) AS node_property_mismatches,
    (SELECT count(*) FROM na WHERE n IN (SELECT src FROM odd UNION SELECT dst FROM odd)) AS neighbor_mismatches, (SELECT count(*) FROM ps) AS edges_a, (SELECT count(*) FROM mut) AS edges_b,
    (SELECT count(*) FROM ps LEFT JOIN mut USING (src, dst) WHERE mut.weight IS DISTINCT FROM ps.weight) AS edge_property_mismatches""",
)
def _(spark, sf):
    return g.parity_summary(*_parity(tables(spark, sf)))


@case(
    "f17_score_paths",
    f"""WITH {v.TREE}, rn AS (SELECT src AS r, dst AS n FROM tree WHERE src LIKE 'R%'), ns AS (SELECT src AS n, dst AS s FROM tree WHERE src LIKE 'N%'),
    ans AS (SELECT 'S' || s_suppkey AS e FROM supplier WHERE s_acctbal > 5000 UNION ALL SELECT 'N' || n_nationkey FROM nation WHERE n_regionkey < 3),
    vote AS (SELECT 'N' || c_nationkey AS src, 'R' || n_regionkey AS dst FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT s || '>' || n || '>' || r AS path, (s IN (SELECT e FROM ans))::INT + (n IN (SELECT e FROM ans))::INT AS overlap,
    (SELECT count(*) FROM vote WHERE src = n) AS votes, CASE WHEN n IN (SELECT src FROM vote) THEN n || '->' || r ELSE '' END AS pairs FROM ns JOIN rn USING (n)""",
)
def _(spark, sf):
    t = tables(spark, sf)
    j = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    p = F.array(F.concat(F.lit("S"), "s_suppkey"), F.concat(F.lit("N"), "n_nationkey"), F.concat(F.lit("R"), "n_regionkey"))
    paths = j.select(F.col("s_suppkey").alias("path_id"), p.alias("path"))
    ans = t("supplier").where("s_acctbal > 5000").select(F.concat(F.lit("S"), "s_suppkey").alias("entity_name")).unionByName(
        t("nation").where("n_regionkey < 3").select(F.concat(F.lit("N"), "n_nationkey").alias("entity_name"))
    )
    votes = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("N"), "n_nationkey").alias("src"), F.concat(F.lit("R"), "n_regionkey").alias("dst")
    )
    out = g.score_paths(paths, ans, votes)
    return out.select(F.array_join("path", ">").alias("path"), "overlap", "votes", F.array_join("voting_pairs", "|").alias("pairs"))
