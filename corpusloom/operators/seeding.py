"""Scoring graph nodes against queries and choosing graph seeds.

``names`` frames come from ``node_names``: ``(entity_name, entity_type, ord, aliases)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators.graph import both_ways, unquote
from corpusloom.plans.scan import top_k
from corpusloom.plans.session import cut
from corpusloom.plans.textjoin import contained_pairs, overlap_counts

# fixed values: scored types, score steps of the routing branches
SCORED_TYPES = ("EQUIPMENT", "FAULTCASE", "COMPONENT")
EQUIPMENT_SUFFIX = "系统"
ANCHOR_SCORE, NEIGHBOR_SCORE, EQUIPMENT_FLOOR, EXACT_BONUS, CASE_BONUS = 1000.0, 900.0, 850.0, 40.0, 5.0


def node_names(nodes: DataFrame, ord_col: str = "ord") -> DataFrame:
    """Scored nodes with their normalised aliases."""
    kind = unquote(F.col("entity_type"))
    plain = tx.strip(F.regexp_replace("entity_name", r"[（(].*?[）)]", ""))
    no_suffix = F.when((F.col("entity_type") == "EQUIPMENT") & F.col("entity_name").endswith(EQUIPMENT_SUFFIX), F.regexp_replace("entity_name", f"{EQUIPMENT_SUFFIX}$", ""))
    names = F.array_compact(F.array(F.col("entity_name"), plain, no_suffix))
    return nodes.select("entity_name", kind.alias("entity_type"), F.col(ord_col).alias("ord")).where(
        F.col("entity_type").isin(*SCORED_TYPES)
    ).withColumn("aliases", F.array_distinct(F.filter(F.transform(names, tx.alias_norm), lambda a: a != "")))


def pair_score(qn: Column, aliases: Column, entity_type: Column) -> Column:
    """``struct(score, exact)`` of one normalised query and one node."""
    qchars = tx.char_set(qn)

    def one(a: Column) -> Column:
        chars = tx.char_set(a)
        shared = F.size(F.array_intersect(chars, qchars))
        return (
            F.when(F.instr(qn, a) > 0, 1000.0 + F.length(a) * 10)
            .when(F.instr(a, qn) > 0, 300.0 + F.length(qn) * 5)
            .when(shared >= 2, shared * 10 / F.size(chars))
            .otherwise(F.lit(0.0))
        )

    best = F.coalesce(F.array_max(F.transform(aliases, one)), F.lit(0.0))
    exact = F.exists(aliases, lambda a: F.instr(qn, a) > 0)
    part = entity_type == "COMPONENT"
    bonus = F.when(entity_type == "FAULTCASE", F.lit(CASE_BONUS)).otherwise(F.lit(0.0))
    return F.struct(
        F.when(part, F.lit(0.0)).otherwise(best + bonus).alias("score"), (~part & exact).alias("exact")
    )


def exact_nodes(queries: DataFrame, names: DataFrame) -> DataFrame:
    """``(query_id, entity_name, entity_type, ord, base)`` where an alias stands in the query."""
    al = names.where("entity_type <> 'COMPONENT'").select("entity_name", "entity_type", "ord", F.explode("aliases").alias("alias"))
    pairs = contained_pairs(al.select("alias"), queries.select("qn"), "alias", "qn")
    return (
        pairs.join(queries.select("query_id", "qn"), "qn").join(al, "alias")
        .groupBy("query_id", "entity_name", "entity_type", "ord")
        .agg(F.max(1000.0 + F.length("alias") * 10).alias("base"))
    )


def score_nodes(queries: DataFrame, names: DataFrame, k: int, salts: int = 8) -> DataFrame:
    """The ``k`` best nodes per query: ``(query_id, rank, entity_name, entity_type, score, exact)``.

    ``queries(query_id, qn[, bonus])``, ``bonus`` being a ``map<type, double>`` added to positive
    scores.  Containment uses substring joins.  Character overlap depends only on the two character
    sets, so equal sets are scored once, and only the groups and nodes that can still reach the top
    ``k`` are expanded; the result is that of scoring every pair.
    """
    has_bonus = "bonus" in queries.columns
    cand = names.where("entity_type <> 'COMPONENT'")
    al = cand.select("entity_name", "entity_type", "ord", F.explode("aliases").alias("alias"))
    exact = exact_nodes(queries, names).withColumn("exact", F.lit(True))
    wider = (
        contained_pairs(queries.select("qn"), al.select("alias"), "qn", "alias")
        .where(F.length("alias") > F.length("qn"))
        .join(queries.select("query_id", "qn"), "qn").join(al, "alias")
        .select("query_id", "entity_name", "entity_type", "ord", (300.0 + F.length("qn") * 5).alias("base"), F.lit(False).alias("exact"))
    )
    qset = F.array_sort(tx.char_set(F.col("qn")))
    q = queries.select("query_id", qset.alias("items")).withColumn("qkey", F.sha2(F.array_join("items", ""), 256))
    aset = F.array_sort(tx.char_set(F.col("alias")))
    a = al.withColumn("items", aset).withColumn("akey", F.concat_ws("/", "entity_type", F.array_join("items", "")))
    groups = a.groupBy("akey", "items", "entity_type").agg(F.min("ord").alias("first_ord"))
    shared = overlap_counts(q.select("qkey", "items").distinct(), groups.select("akey", "items"), "qkey", "akey", "items", salts)
    scored = shared.join(groups.select("akey", "entity_type", "first_ord", F.size("items").alias("_n")), "akey").withColumn(
        "base", F.col("overlap") * 10 / F.col("_n")
    )
    # a node has at most three aliases, hence stands first in at most three groups
    best = top_k(scored, ["qkey", "entity_type"], [F.desc("base"), F.col("first_ord")], 3 * k, "_g")
    firsts = top_k(a.select("akey", "entity_name", "entity_type", "ord").distinct(), "akey", [F.col("ord")], k, "_m").drop("_m")
    near = (
        best.select("qkey", "akey", "base").join(firsts, "akey").join(q.select("query_id", "qkey"), "qkey")
        .select("query_id", "entity_name", "entity_type", "ord", "base", F.lit(False).alias("exact"))
    )
    # every fault card scores at least its bonus; the first k of them can fill up the list
    cards = cand.where("entity_type = 'FAULTCASE'").orderBy("ord").limit(k).select(F.struct("entity_name", "entity_type", "ord").alias("c"))
    fill = [r["c"] for r in cards.collect()]
    parts = exact.unionByName(wider).unionByName(near)
    if fill:
        types = cand.schema
        lits = F.array(*[
            F.struct(*[F.lit(r[c]).cast(types[c].dataType).alias(c) for c in ("entity_name", "entity_type", "ord")]) for r in fill
        ])
        low = queries.select("query_id", F.explode(lits).alias("c")).select("query_id", "c.*", F.lit(0.0).alias("base"), F.lit(False).alias("exact"))
        parts = parts.unionByName(low.select(*parts.columns))
    merged = parts.groupBy("query_id", "entity_name", "entity_type", "ord").agg(F.max("base").alias("base"), F.max("exact").alias("exact"))
    score = F.col("base") + F.when(F.col("entity_type") == "FAULTCASE", F.lit(CASE_BONUS)).otherwise(F.lit(0.0))
    if has_bonus:
        merged = merged.join(queries.select("query_id", "bonus"), "query_id")
        score = score + F.coalesce(F.try_element_at("bonus", F.col("entity_type")), F.lit(0.0))
    ranked = top_k(merged.withColumn("score", score), "query_id", [F.desc("score"), F.col("ord")], k)
    return ranked.select("query_id", "rank", "entity_name", "entity_type", "score", "exact")


def type_bonus(ranked_types: Column) -> Column:
    """Map of type to 5 points per place from the end."""
    return F.map_from_arrays(
        ranked_types, F.transform(ranked_types, lambda _t, i: ((F.size(ranked_types) - i) * 5).cast("double"))
    )


def graph_seed(queries: DataFrame, nodes: DataFrame, edges: DataFrame, k: int, routed: DataFrame | None = None, hits: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Graph seeds per query: ``top(query_id, rank, entity_name, entity_type, score, branch)`` and
    ``source_nodes(query_id, node_ord, entity_name, exact)`` whose sources to read.

    ``nodes(entity_name, entity_type, ord)``; ``routed(query_id, ranked_types)`` and
    ``hits(query_id, canonical_name, score)`` come from the alias router.
    """
    q = queries.select("query_id", tx.alias_norm(F.col("query")).alias("qn")).where("qn <> ''")
    q = q.join(routed.select("query_id", type_bonus(F.col("ranked_types")).alias("bonus")), "query_id", "left") if routed is not None else q.withColumn(
        "bonus", F.create_map().cast("map<string,double>")
    )
    q = cut(q)
    names = cut(node_names(nodes))
    found = exact_nodes(q, names).select("query_id", "entity_name", "entity_type", "ord")
    if hits is not None:
        by_alias = hits.select("query_id", F.col("canonical_name").alias("entity_name")).join(names.select("entity_name", "entity_type", "ord"), "entity_name")
        found = found.unionByName(by_alias.select(*found.columns)).distinct()
    order = F.array_position(F.array(*[F.lit(t) for t in ("FAULTCASE", "EQUIPMENT", "COMPONENT")]), F.col("entity_type"))
    found = found.withColumn("_b", order)
    branch = found.groupBy("query_id").agg(F.min("_b").alias("branch"))
    anchors = cut(found.join(branch, "query_id").where("_b = branch").drop("_b"))
    sizes = anchors.groupBy("query_id").agg(F.count(F.lit(1)).alias("_anchors"))
    lead = top_k(anchors, "query_id", [F.col("ord")], k, "arank")
    own = lead.select("query_id", "branch", "entity_name", "entity_type", F.lit(ANCHOR_SCORE).alias("score"), F.lit(0).alias("seg"), F.col("arank").cast("long").alias("pos"))

    around = both_ways(edges).join(
        nodes.select(F.col("entity_name").alias("b"), unquote(F.col("entity_type")).alias("btype"), F.col("ord").alias("bord")), "b"
    )
    # branch 1, exact fault cards: their neighbours in order; 2k per card suffice, since at most k of
    # them can be anchors themselves
    some = top_k(around, "a", [F.col("bord")], 2 * k, "_n")
    of_cards = lead.where("branch = 1").select("query_id", F.col("entity_name").alias("a"), "arank").join(some, "a")
    beside = of_cards.groupBy("query_id", "b", "btype").agg(F.min(F.struct("arank", "bord")).alias("o"))
    beside = beside.join(anchors.select("query_id", F.col("entity_name").alias("b")), ["query_id", "b"], "left_anti")
    beside = top_k(beside, "query_id", [F.col("o")], k, "pos").select(
        "query_id", F.lit(1).cast("long").alias("branch"), F.col("b").alias("entity_name"), F.col("btype").alias("entity_type"),
        F.lit(NEIGHBOR_SCORE).alias("score"), F.lit(1).alias("seg"), F.col("pos").cast("long").alias("pos"),
    )
    # branches 2 and 3: neighbours rescored against the query, as many as places are left
    near = (
        lead.where("branch > 1").select("query_id", "branch", F.col("entity_name").alias("a"), "arank").join(around, "a").join(q, "query_id")
        .join(names.select(F.col("entity_name").alias("b"), "aliases"), "b", "left")
    )
    aliases = F.coalesce("aliases", F.array_distinct(F.filter(F.array(tx.alias_norm(F.col("b")), tx.alias_norm(F.regexp_replace("b", r"[（(].*?[）)]", ""))), lambda x: x != "")))
    near = near.withColumn("s", pair_score(F.col("qn"), aliases, F.col("btype")))
    raised = F.greatest(
        F.col("s.score") + F.coalesce(F.try_element_at("bonus", F.col("btype")), F.lit(0.0)),
        F.when(F.col("btype") == "FAULTCASE", F.lit(NEIGHBOR_SCORE)).otherwise(F.lit(EQUIPMENT_FLOOR)),
    ) + F.when(F.col("s.exact"), F.lit(EXACT_BONUS)).otherwise(F.lit(0.0))
    plain = F.when(F.col("s.exact"), F.lit(NEIGHBOR_SCORE)).otherwise(F.col("s.score"))
    near = near.withColumn("score", F.when(F.col("branch") == 2, plain).otherwise(raised)).where(
        ((F.col("branch") == 2) & (F.col("s.exact") | (F.col("s.score") > 0))) | ((F.col("branch") == 3) & F.col("btype").isin("EQUIPMENT", "FAULTCASE"))
    )
    listed = top_k(near, "query_id", [F.desc("score"), F.col("arank"), F.col("bord")], k, "pos").join(sizes, "query_id").where(
        F.col("pos") <= F.lit(k) - F.col("_anchors")
    )
    listed = listed.join(anchors.select("query_id", F.col("entity_name").alias("b")), ["query_id", "b"], "left_anti")
    listed = listed.groupBy("query_id", "branch", "b", "btype").agg(F.min(F.struct("pos", "score")).alias("x")).select(
        "query_id", "branch", F.col("b").alias("entity_name"), F.col("btype").alias("entity_type"), F.col("x.score").alias("score"),
        F.lit(1).alias("seg"), F.col("x.pos").cast("long").alias("pos"),
    )
    # no exact node: the scored list
    rest = score_nodes(q.join(branch, "query_id", "left_anti"), names, k).select(
        "query_id", F.lit(0).cast("long").alias("branch"), "entity_name", "entity_type", "score", F.lit(0).alias("seg"), F.col("rank").cast("long").alias("pos")
    )
    everything = own.unionByName(beside).unionByName(listed).unionByName(rest)
    top = cut(top_k(everything, "query_id", [F.col("seg"), F.col("pos")], k).select("query_id", "rank", "entity_name", "entity_type", "score", "branch"))
    wanted = F.when(F.col("branch") == 2, F.col("entity_type") == "FAULTCASE").when(F.col("branch") == 3, F.col("entity_type").isin("FAULTCASE", "COMPONENT")).otherwise(F.lit(True))
    chosen = top.where("branch <> 1").withColumn("_w", wanted)
    any_ = chosen.groupBy("query_id").agg(F.max("_w").alias("_any"))
    from_top = chosen.join(any_, "query_id").where("_w OR NOT _any").withColumn("exact", F.col("branch") > 0)
    from_top = from_top.select("query_id", F.struct(F.col("rank").cast("long").alias("r"), F.lit("").alias("o")).alias("node_ord"), "entity_name", "exact")
    from_cards = anchors.where("branch = 1").select(
        "query_id", F.struct(F.lit(0).cast("long").alias("r"), F.col("ord").cast("string").alias("o")).alias("node_ord"), "entity_name", F.lit(True).alias("exact")
    )
    return top, from_cards.unionByName(from_top)


def collect_source_chunks(source_nodes: DataFrame, node_sources: DataFrame, k: int) -> DataFrame:
    """First source chunks of the nodes, in node order: ``(query_id, rank, chunk_id)``; two when the
    nodes were matched exactly, else between two and four.

    Per node only the first four sources are read: further ones could not be reached.
    """
    loose = max(2, min(4, int(k / 2) or 1))
    most = max(2, loose)
    few = top_k(
        node_sources.select("entity_name", tx.strip(F.col("source_id")).alias("chunk_id")).where("chunk_id <> ''").distinct(), "entity_name", [F.col("chunk_id")], most, "_s"
    )
    firsts = source_nodes.join(few, "entity_name").groupBy("query_id", "exact", "chunk_id").agg(F.min(F.struct("node_ord", "chunk_id")).alias("o"))
    limit = F.when(F.col("exact"), F.lit(2)).otherwise(F.lit(loose))
    return top_k(firsts, "query_id", [F.col("o")], most).where(F.col("rank") <= limit).select("query_id", "rank", "chunk_id")
