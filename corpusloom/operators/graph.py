"""Graph queries and analytics over ``nodes(entity_name, entity_type, …)`` and canonical,
undirected ``edges(src, dst, …)``.

The loops (breadth-first search, components, paths, walks) work on whole frontiers: each round is
a join, cut by a reliable checkpoint, and stops when nothing new appears.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.plans.scan import prefix_scan, top_k
from corpusloom.plans.session import cut

UNKNOWN = "UNKNOWN"
# fixed values: entity types that may be roots of a view, in priority order, and default roots
ROOT_TYPES = ("DOCROOT", "CHUNK", "EQUIPMENT", "COMPONENT")
DEFAULT_ROOT_TYPES = ("DOCROOT", "CHUNK")


class GraphTooLarge(ValueError):
    pass


def unquote(c: Column) -> Column:
    return F.regexp_replace(tx.text_or_empty(c), '^"+|"+$', "")


def plain_type(c: Column) -> Column:
    return F.coalesce(F.nullif(unquote(c), F.lit("")), F.lit(UNKNOWN))


def both_ways(edges: DataFrame, *cols: str) -> DataFrame:
    """Each edge from both ends as ``(a, b, …)``; a self loop once."""
    ends = F.when(F.col("src") == F.col("dst"), F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")))).otherwise(
        F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))
    )
    return edges.select(F.explode(ends).alias("x"), *cols).select("x.a", "x.b", *cols)


def relation_type(cols: Sequence[str] = ("relation_type", "keywords", "type")) -> Column:
    """First non-empty of the given columns, else RELATED_TO."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cols], F.lit("RELATED_TO"))


# --- look-ups ---------------------------------------------------------------------------------


def entity_types(nodes: DataFrame) -> DataFrame:
    t = unquote(F.col("entity_type"))
    return nodes.select(F.lower(t).alias("type_lower"), t.alias("entity_type")).distinct()


def nodes_of_types(nodes: DataFrame, types: Sequence[str]) -> DataFrame:
    return nodes.where(unquote(F.col("entity_type")).isin(*[t.strip('"') for t in types]))


def lookup_nodes(keys: DataFrame, nodes: DataFrame) -> DataFrame:
    """``keys(entity_name)`` with the node columns and ``found``."""
    return keys.join(nodes.withColumn("found", F.lit(True)), "entity_name", "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )


def lookup_edges(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """``pairs(a, b)`` in either direction with the edge columns and ``found``."""
    p = pairs.withColumns({"src": F.least("a", "b"), "dst": F.greatest("a", "b")})
    return p.join(edges.withColumn("found", F.lit(True)), ["src", "dst"], "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )


def node_degree(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    deg = edges.select(F.explode(F.array("src", "dst")).alias("entity_name")).groupBy("entity_name").agg(
        F.count(F.lit(1)).alias("degree")
    )
    if nodes is None:
        return deg
    return nodes.select("entity_name").join(deg, "entity_name", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def edge_degree(edges: DataFrame) -> DataFrame:
    d = node_degree(edges)
    return (
        edges.select("src", "dst")
        .join(d.select(F.col("entity_name").alias("src"), F.col("degree").alias("_ds")), "src")
        .join(d.select(F.col("entity_name").alias("dst"), F.col("degree").alias("_dd")), "dst")
        .select("src", "dst", (F.col("_ds") + F.col("_dd")).alias("degree"))
    )


def neighbors(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """``ids(entity_name)`` to ``(entity_name, neighbor)``."""
    want = ids.select(F.col("entity_name").alias("a")).distinct()
    return both_ways(edges).join(want, "a", "left_semi").select(F.col("a").alias("entity_name"), F.col("b").alias("neighbor"))


# --- paths and neighbourhoods --------------------------------------------------------------------


def k_hop_paths(starts: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """Paths of at most ``k`` edges from every ``starts(start)``.

    A path that returned to one of its nodes stops, an edge is not walked twice in either
    direction, and a path that cannot go on is kept.
    """
    sym = both_ways(edges)
    paths = starts.join(sym.withColumnRenamed("a", "start"), "start").select("start", F.array("start", "b").alias("path"))
    last = F.element_at("path", -1)
    closed = F.array_contains(F.slice("path", 1, F.size("path") - 1), last)
    for _ in range(1, k):
        paths = cut(paths)
        steps = paths.where(~closed).withColumn("a", last).join(sym, "a")
        at = F.sequence(F.lit(0), F.size("path") - 2)

        def uses(i: Column) -> Column:
            p, n = F.get(F.col("path"), i), F.get(F.col("path"), i + 1)
            return ((p == F.col("a")) & (n == F.col("b"))) | ((p == F.col("b")) & (n == F.col("a")))

        grown = cut(steps.where(~F.exists(at, uses)).select("start", "path", F.concat("path", F.array("b")).alias("next")))
        ended = paths.join(grown.select("path").distinct(), "path", "left_anti").select("start", "path")
        paths = grown.select("start", F.col("next").alias("path")).unionByName(ended)
    return paths


def ego_subgraph(starts: DataFrame, nodes: DataFrame, edges: DataFrame, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """For every ``starts(start)`` the nodes up to ``max_depth`` (with depth) and the edges touching a
    node nearer than ``max_depth``, each once.  A start that is no node gives nothing."""
    sym = both_ways(edges)
    frontier = starts.select("start").distinct().join(nodes.select(F.col("entity_name").alias("start")), "start", "left_semi")
    frontier = frontier.select("start", F.col("start").alias("entity_name"), F.lit(0).alias("depth"))
    seen = cut(frontier)
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = (
            frontier.join(sym, F.col("entity_name") == F.col("a"))
            .select("start", F.col("b").alias("entity_name"))
            .distinct()
            .join(seen, ["start", "entity_name"], "left_anti")
            .withColumn("depth", F.lit(depth))
        )
        frontier = cut(step)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    near = seen.where(F.col("depth") < max_depth).select("start", F.col("entity_name").alias("a"))
    touched = near.join(sym, "a").select("start", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
    return seen, touched


def full_graph(nodes: DataFrame, edges: DataFrame, max_nodes: int = 1000, max_edges: int = 5000) -> tuple[DataFrame, DataFrame, str]:
    """Both tables and a state, ``empty`` or ``ready``; a graph over the limits is an error."""
    n, e = nodes.limit(max_nodes + 1).count(), edges.limit(max_edges + 1).count()
    if n > max_nodes or e > max_edges:
        raise GraphTooLarge(f"graph exceeds {max_nodes} nodes or {max_edges} edges")
    return nodes, edges, "empty" if n == 0 and e == 0 else "ready"


# --- summaries ---------------------------------------------------------------------------------


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows ``(metric, name, n)``: totals and node counts per type."""
    types = nodes.groupBy(plain_type(F.col("entity_type")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    total = types.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return (
        types.select(F.lit("type").alias("metric"), "name", "n")
        .unionByName(total.select(F.lit("total_nodes").alias("metric"), F.lit("").alias("name"), "n"))
        .unionByName(edges.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total_edges").alias("metric"), F.lit("").alias("name"), "n"))
    )


def node_detail(labels: DataFrame, nodes: DataFrame, edges: DataFrame, max_relationships: int = 20, type_col: str = "relation_type") -> DataFrame:
    """Type, degree and the first relations (by neighbour name) of each ``labels(entity_name)``."""
    want = labels.select(unquote(F.col("entity_name")).alias("entity_name")).distinct().join(nodes, "entity_name")
    rel = relation_type([type_col]) if type_col in edges.columns else F.lit("RELATED_TO")
    around = both_ways(edges.withColumn("rel", rel), "src", "rel")
    around = around.join(want.select(F.col("entity_name").alias("a")), "a", "left_semi")
    degree = around.groupBy("a").agg(F.count(F.lit(1)).alias("degree"))
    first = top_k(around, "a", [F.col("b")], max_relationships).groupBy("a").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    F.col("rank"), F.col("b").alias("label"),
                    F.when(F.col("src") == F.col("a"), F.lit("outgoing")).otherwise(F.lit("incoming")).alias("direction"),
                    F.col("rel").alias("type"),
                )
            )
        ).alias("relationships")
    )
    return (
        want.join(degree.withColumnRenamed("a", "entity_name"), "entity_name", "left")
        .join(first.withColumnRenamed("a", "entity_name"), "entity_name", "left")
        .withColumn("degree", F.coalesce("degree", F.lit(0)))
        .withColumn("entity_type", plain_type(F.col("entity_type")))
    )


def label_entries(nodes: DataFrame, limit: int | None = None) -> DataFrame:
    out = nodes.select(unquote(F.col("entity_name")).alias("label"), plain_type(F.col("entity_type")).alias("entity_type")).where(
        tx.strip(F.col("label")) != ""
    )
    return out.orderBy("label", "entity_type").limit(limit) if limit else out


def search_labels(entries: DataFrame, query: str = "", current_root: str | None = None) -> DataFrame:
    """Root candidates ``(label, entity_type, priority)``; order by ``priority, label``.

    Without a query the default roots, else searchable types containing it; if no entry has such a
    type all entries take part.  The current root is pinned first (priority -1) if it is among them.
    """
    by_label = entries.groupBy(tx.strip(F.col("label")).alias("label")).agg(F.min("entity_type").alias("entity_type")).where("label <> ''")
    kind = F.upper(plain_type(F.col("entity_type")))
    needle = query.strip().lower()
    wanted = ROOT_TYPES if needle else DEFAULT_ROOT_TYPES
    hit = by_label.where(kind.isin(*wanted))
    base = hit if not hit.isEmpty() else by_label
    if needle:
        base = base.where(F.contains(F.lower("label"), F.lit(needle)))
    at = F.array_position(F.array(*[F.lit(x) for x in ROOT_TYPES]), kind)
    prio = F.when(at > 0, at.cast("int") - 1).otherwise(F.lit(2**31 - 1))
    if current_root:
        prio = F.when(F.col("label") == current_root, F.lit(-1)).otherwise(prio)
    return base.withColumn("priority", prio)


def induced_subgraph(nodes: DataFrame, edges: DataFrame, types: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes of the types, the edges between them, and counts per visible type."""
    kept = nodes.where(F.upper(plain_type(F.col("entity_type"))).isin(*types))
    ids = kept.select("entity_name")
    inside = edges.join(ids.withColumnRenamed("entity_name", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("entity_name", "dst"), "dst", "left_semi"
    )
    counts = kept.groupBy(F.upper(plain_type(F.col("entity_type"))).alias("entity_type")).agg(F.count(F.lit(1)).alias("n"))
    return kept, inside, counts


def delete_entities(gone: DataFrame, nodes: DataFrame, edges: DataFrame, index: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Remove ``gone(entity_name)`` with its edges and, from an index table with ``id``, its rows."""
    ids = gone.select("entity_name").distinct()
    left_edges = edges.join(ids.withColumnRenamed("entity_name", "src"), "src", "left_anti").join(
        ids.withColumnRenamed("entity_name", "dst"), "dst", "left_anti"
    )
    left_index = None
    if index is not None:
        dead_edges = both_ways(edges).join(ids.withColumnRenamed("entity_name", "a"), "a", "left_semi")
        dead = ids.select(
            F.explode(F.array(tx.md5_id(F.col("entity_name"), "ent-"), tx.md5_id(F.col("entity_name"), "Ename-"))).alias("id")
        ).unionByName(dead_edges.select(tx.md5_id(F.concat(F.least("a", "b"), F.greatest("a", "b")), "rel-").alias("id")))
        left_index = index.join(dead.distinct(), "id", "left_anti")
    return nodes.join(ids, "entity_name", "left_anti"), left_edges, left_index


def delete_edges(gone: DataFrame, edges: DataFrame) -> DataFrame:
    return edges.join(gone.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")), ["src", "dst"], "left_anti")


# --- components ----------------------------------------------------------------------------------


#: Rows of one label that a task may get; a label with more is split.
LABEL_ROWS = 1_000_000


def with_smallest(pairs: DataFrame, rows: int) -> DataFrame:
    """``(a, b, m)``: ``pairs(a, b)``, ``rows`` of them at most, with the smallest of a and all its b.

    Labels of more than ``LABEL_ROWS`` pairs, of which there are at most rows / LABEL_ROWS (so their list may be
    broadcast), have their pairs dealt over that many splits, and their one row is repeated for each. The minimum
    itself is taken before the shuffle.
    """
    m = pairs.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    if rows <= LABEL_ROWS:
        return pairs.join(m.drop("n"), "a")
    m = cut(m.withColumn("splits", F.ceil(F.col("n") / LABEL_ROWS).cast("int")))
    large = m.where("splits > 1").select("a", "splits")
    dealt = pairs.join(F.broadcast(large), "a", "left").withColumn("split", F.coalesce(F.pmod(F.xxhash64("b"), F.col("splits")).cast("int"), F.lit(0)))
    held = m.select("a", "m", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("split"))
    return dealt.select("a", "b", "split").join(held, ["a", "split"]).select("a", "b", "m")


def connected_components(edges: DataFrame) -> DataFrame:
    """``(entity_name, component)`` with the smallest name as component label.

    Alternating large-star and small-star steps: every step is one partial ``min`` and one join whose
    large labels are split, so neither a hub nor the label of a giant component gathers its rows in one
    task, and the number of rounds grows with the logarithm of the graph, not with its diameter.
    """
    size = 0

    def with_min(pairs: DataFrame) -> DataFrame:
        return with_smallest(pairs, 2 * size)

    def large_star(e: DataFrame) -> DataFrame:
        both = e.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.a", "x.b")
        return with_min(both).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        j = with_min(down)
        moved = j.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = j.select("a", F.col("m").alias("b"))
        return moved.unionByName(own).where("a <> b").distinct()

    names = edges.select(F.explode(F.array("src", "dst")).alias("entity_name")).distinct()
    e = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    mark, size = None, e.count()
    while True:
        e = cut(small_star(large_star(e)))
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark, size = now, now[0]
    return names.join(e.select(F.col("a").alias("entity_name"), F.col("b").alias("component")), "entity_name", "left").withColumn(
        "component", F.coalesce("component", "entity_name")
    )


def largest_component(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and canonical edges of the largest component (ties: smallest label), names upper-cased
    with entities decoded.  Sort by name, resp. by ``src`` and ``dst``, for the stable order."""
    comp = connected_components(edges)
    best = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component")
    members = comp.join(best, "component", "left_semi").select("entity_name")

    def stable(c: str) -> Column:
        return tx.strip(tx.clean_str(F.upper(F.col(c))))

    kept = nodes.join(members, "entity_name", "left_semi").withColumn("entity_name", stable("entity_name"))
    inside = edges.join(members.withColumnRenamed("entity_name", "src"), "src", "left_semi")
    ends = F.array_sort(F.transform(F.array("src", "dst"), lambda x: tx.strip(tx.clean_str(F.upper(x)))))
    inside = inside.withColumn("_ends", ends).withColumns({"src": F.get("_ends", F.lit(0)), "dst": F.get("_ends", F.lit(1))})
    return kept, inside.drop("_ends")


# --- walks -----------------------------------------------------------------------------------------


def random_walks(edges: DataFrame, num_walks: int = 10, walk_length: int = 40, seed: int = 3) -> DataFrame:
    """``(entity_name, walk, nodes)``: uniform walks from every node.

    The next node is the neighbour with a hashed number, found by an equi-join on (node, number), so
    a step never touches the other neighbours of a hub.
    """
    numbered = cut(prefix_scan(both_ways(edges), "a", "b", row_number="no"))
    deg = cut(numbered.groupBy("a").agg(F.max("no").alias("deg")))
    cur = deg.select(F.col("a").alias("entity_name"), F.explode(F.sequence(F.lit(0), F.lit(num_walks - 1))).alias("walk"))
    cur = cur.select("entity_name", "walk", F.array("entity_name").alias("nodes"))
    for step in range(1, walk_length):
        at = cur.withColumn("a", F.element_at("nodes", -1)).join(deg, "a")
        digits = F.substring(F.md5(F.concat_ws("~", "entity_name", "walk", F.lit(step), F.lit(seed))), 1, 15)
        draw = F.conv(digits, 16, 10).cast("long") % F.col("deg") + 1
        cur = at.withColumn("no", draw).join(numbered, ["a", "no"]).select(
            "entity_name", "walk", F.concat("nodes", F.array("b")).alias("nodes")
        )
        if step % 5 == 0:
            cur = cut(cur)
    return cur


# --- comparison -------------------------------------------------------------------------------------


def graph_parity(nodes_a: DataFrame, edges_a: DataFrame, nodes_b: DataFrame, edges_b: DataFrame, node_cols: Sequence[str] = ("entity_type",)) -> DataFrame:
    """Per node of either graph: presence, property match and whether its neighbours agree.

    Neighbour sets are compared by the edges that only one side has, not by collecting the sets.
    """
    a = nodes_a.select("entity_name", F.lit(True).alias("in_a"), *[F.col(c).alias(f"_a_{c}") for c in node_cols])
    b = nodes_b.select("entity_name", F.lit(True).alias("in_b"), *[F.col(c).alias(f"_b_{c}") for c in node_cols])
    ea, eb = (e.select("src", "dst").distinct() for e in (edges_a, edges_b))
    odd = ea.exceptAll(eb).unionByName(eb.exceptAll(ea)).select(F.explode(F.array("src", "dst")).alias("entity_name")).distinct()
    same = F.lit(True)
    for c in node_cols:
        same = same & F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))
    return (
        a.join(b, "entity_name", "full_outer")
        .join(odd.withColumn("_odd", F.lit(True)), "entity_name", "left")
        .select(
            "entity_name",
            F.coalesce("in_a", F.lit(False)).alias("in_a"),
            F.coalesce("in_b", F.lit(False)).alias("in_b"),
            same.alias("properties_match"),
            F.col("_odd").isNull().alias("neighbors_match"),
        )
    )


def edge_parity(edges_a: DataFrame, edges_b: DataFrame, cols: Sequence[str]) -> DataFrame:
    a = edges_a.select("src", "dst", F.lit(True).alias("in_a"), F.struct(*cols).alias("_a"))
    b = edges_b.select("src", "dst", F.lit(True).alias("in_b"), F.struct(*cols).alias("_b"))
    return a.join(b, ["src", "dst"], "full_outer").select(
        "src", "dst", F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b"),
        F.col("_a").eqNullSafe(F.col("_b")).alias("properties_match"),
    )


def parity_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(
        F.count_if("in_a").alias("nodes_a"), F.count_if("in_b").alias("nodes_b"),
        F.count_if(~F.col("properties_match")).alias("node_property_mismatches"),
        F.count_if(~F.col("neighbors_match")).alias("neighbor_mismatches"), F.lit(1).alias("_k"),
    )
    e = edges.agg(
        F.count_if("in_a").alias("edges_a"), F.count_if("in_b").alias("edges_b"),
        F.count_if(~F.col("properties_match")).alias("edge_property_mismatches"), F.lit(1).alias("_k"),
    )
    return n.join(e, "_k").drop("_k")


# --- paths against answers ---------------------------------------------------------------------------


def score_paths(paths: DataFrame, answers: DataFrame, votes: DataFrame) -> DataFrame:
    """``paths(path_id, path)`` with ``overlap`` (multiset intersection with ``answers(entity_name)``),
    ``votes`` (entries of ``votes(src, dst)`` that the path walks in that direction) and the voting pairs.
    """
    elems = paths.select("path_id", F.explode("path").alias("entity_name")).groupBy("path_id", "entity_name").agg(F.count(F.lit(1)).alias("_n"))
    have = answers.groupBy("entity_name").agg(F.count(F.lit(1)).alias("_m"))
    overlap = elems.join(have, "entity_name").groupBy("path_id").agg(F.sum(F.least("_n", "_m")).alias("overlap"))
    n = F.size("path")
    pairs = F.arrays_zip(F.slice("path", F.lit(1), n - 1).alias("src"), F.slice("path", F.lit(2), n - 1).alias("dst"))
    steps = paths.select("path_id", F.explode(F.array_distinct(pairs)).alias("p")).select("path_id", "p.src", "p.dst")
    ballots = votes.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("_v"))
    voted = steps.join(ballots, ["src", "dst"]).groupBy("path_id").agg(
        F.sum("_v").alias("votes"), F.sort_array(F.collect_list(F.concat_ws("->", "src", "dst"))).alias("voting_pairs")
    )
    empty = F.array().cast("array<string>")
    return (
        paths.join(overlap, "path_id", "left")
        .join(voted, "path_id", "left")
        .select("path_id", "path", F.coalesce("overlap", F.lit(0)).alias("overlap"), F.coalesce("votes", F.lit(0)).alias("votes"), F.coalesce("voting_pairs", empty).alias("voting_pairs"))
    )
