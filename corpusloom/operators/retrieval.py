"""Answering a frame of queries: mode dispatch over seeding, recall, fusion and context building."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import aliases as al
from corpusloom.operators import context as cx
from corpusloom.operators import lexical as lx
from corpusloom.operators import seeding as sd
from corpusloom.operators import vectors as vx
from corpusloom.plans.session import cut

# fixed values: accepted modes and the text-only one they stand for
MODES = ("graph_only", "graph_text_hybrid", "text_only", "faultcase_fast", "keyword_search")


@dataclass
class QueryParams:
    """Knobs of a batch; ``scan_limit`` None scores the whole corpus."""

    top_k: int = 8
    vector_top_k: int = 3
    lexical_top_k: int = 4
    recall_top_k: int = 15
    bm25_top_k: int = 4
    scan_limit: int | None = None
    node_budget: int = 500
    text_budget: int = 8000
    text_only_retrieval: bool = False
    rerank_enabled: bool = False
    rerank_max_candidates: int = 6
    vector_threshold: float = 0.2
    intent_rules: Mapping[str, Sequence[str]] = field(default_factory=lambda: al.INTENT_RULES)


@dataclass
class Corpus:
    """Tables a batch is answered from.

    ``nodes(entity_name, entity_type, ord, description)``, ``edges(src, dst)``,
    ``node_sources(entity_name, source_id)``, ``chunks(chunk_id, ord, content)``,
    ``vectors(id, embedding)`` of the chunks, ``aliases``, and a ``bm25`` index.
    """

    chunks: DataFrame
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    node_sources: DataFrame | None = None
    vectors: DataFrame | None = None
    aliases: DataFrame | None = None
    bm25: lx.Bm25Index | None = None


def recall(queries: DataFrame, seeds: DataFrame, corpus: Corpus, params: QueryParams, embedder: Callable[[list[str]], np.ndarray] | None) -> DataFrame:
    """Hybrid chunk candidates of ``queries(query_id, query)`` with graph seeds ``(query_id, rank, chunk_id)``."""
    if corpus.vectors is not None and embedder is not None and params.vector_top_k > 0:
        q = vx.embed(queries.select("query_id", "query"), embedder, "query").select("query_id", "embedding")
        hits = cut(vx.vector_top_k(q, corpus.vectors, params.vector_top_k, params.vector_threshold).withColumnRenamed("id", "chunk_id"))
    else:
        hits = seeds.withColumn("distance", F.lit(0.0)).limit(0)
    if params.scan_limit is None:
        lexical = lx.lexical_top_k(queries, corpus.chunks, params.lexical_top_k)
    else:
        cand = lx.candidate_ids(seeds, hits, queries, corpus.chunks, max(params.scan_limit, 2000))
        lexical = lx.lexical_top_k_of(cand, queries, corpus.chunks, params.lexical_top_k)
    return cx.hybrid_fuse(seeds, hits, lexical, corpus.chunks, params.recall_top_k)


def retrieve(queries: DataFrame, corpus: Corpus, params: QueryParams | None = None, embedder: Callable[[list[str]], np.ndarray] | None = None, reranker: Column | None = None) -> DataFrame:
    """``(query_id, mode, chunk_ids, context)`` for ``queries(query_id, query, mode[, keywords])``.

    A graph-seeded query without any node has a null context, except in keyword search.
    ``reranker`` is a column over ``query`` and ``content``.
    """
    p = params or QueryParams()
    wrong = queries.where(~F.col("mode").isin(*MODES)).limit(1).collect()
    if wrong:
        raise ValueError(f"unknown mode {wrong[0]['mode']!r}")
    q = queries
    if "keywords" in q.columns:
        words = tx.clean_list(F.col("keywords"))
        joined = (F.col("mode") == "keyword_search") & (F.size("keywords") > 1)
        q = q.withColumn("query", F.when(joined, F.array_join(words, " ")).otherwise(F.col("query")))
    q = cut(q.select("query_id", "query", "mode"))
    seeded_modes = ["graph_only"] if p.text_only_retrieval else ["graph_only", "graph_text_hybrid", "keyword_search"]
    seeded = q.where(F.col("mode").isin(*seeded_modes))
    nothing = q.select("query_id", F.lit(1).alias("rank"), F.lit("").alias("chunk_id")).limit(0)
    top, seeds = None, nothing
    if corpus.nodes is not None:
        routed, hits = al.route_queries(seeded.select("query_id", "query"), corpus.aliases, p.intent_rules)
        top, source_nodes = sd.graph_seed(
            seeded.select("query_id", "query"), corpus.nodes, corpus.edges, p.top_k,
            None if corpus.aliases is None else cut(routed), None if corpus.aliases is None else cut(hits),
        )
        seeds = cut(sd.collect_source_chunks(source_nodes, corpus.node_sources, p.top_k))
    content = corpus.chunks.select("chunk_id", "content")

    def of(*modes: str) -> DataFrame:
        return q.where(F.col("mode").isin(*modes)).select("query_id", "query")

    only = seeds.join(of("graph_only"), "query_id", "left_semi").where(F.col("rank") <= max(1, p.top_k)).select("query_id", "rank", "chunk_id")
    mixed_q = of("graph_text_hybrid", "text_only", "faultcase_fast")
    mixed = cut(recall(mixed_q, seeds.join(of("graph_text_hybrid"), "query_id", "left_semi"), corpus, p, embedder))
    if p.rerank_enabled and reranker is not None:
        mixed = cx.rerank(mixed.join(mixed_q, "query_id").join(content, "chunk_id"), reranker, p.rerank_max_candidates)
    picked = only.unionByName(mixed.select("query_id", "rank", "chunk_id"))
    if corpus.bm25 is not None:
        # seeds only head the candidate list in keyword search; with the whole corpus as candidates
        # they add nothing to it
        kw = lx.bm25_top_k(of("keyword_search"), corpus.bm25, p.bm25_top_k)
        picked = picked.unionByName(kw.select("query_id", "rank", "chunk_id"))
    sources = cut(cx.truncate_by_tokens(picked.join(content, "chunk_id"), "query_id", "rank", "content", p.text_budget))
    if top is None:
        entities = q.select("query_id", F.lit(1).alias("rank"), F.lit("").alias("entity_name"), F.lit("").alias("entity_type"), F.lit(0.0).alias("score"), F.lit("").alias("description")).limit(0)
    else:
        entities = top.select("query_id", "rank", "entity_name", "entity_type", "score").join(corpus.nodes.select("entity_name", "description"), "entity_name")
    ctx = cx.build_context(q, entities, sources, p.node_budget, p.text_budget)
    # at most recall_top_k rows per query
    ids = sources.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))).alias("x"))
    out = q.join(ctx, "query_id").join(ids, "query_id", "left")
    if top is not None:
        needs = F.col("mode").isin(*[m for m in seeded_modes if m != "keyword_search"])
        has = top.select("query_id").distinct().withColumn("_has", F.lit(True))
        out = out.join(has, "query_id", "left").withColumn("context", F.when(needs & F.col("_has").isNull(), None).otherwise(F.col("context")))
    ids_col = F.coalesce(F.col("x.chunk_id"), F.array().cast("array<string>"))
    return out.select("query_id", "mode", F.when(F.col("context").isNotNull(), ids_col).alias("chunk_ids"), "context")
