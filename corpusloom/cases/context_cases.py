"""Fusion, rerank, budgets, contexts and the end-to-end retrieval."""

from pyspark.sql import functions as F

from corpusloom.cases import case
from corpusloom.cases import sqltext as q
from corpusloom.cases import views as v
from corpusloom.cases.retrieval_cases import BM25, _bench, doc_chunks
from corpusloom.functions import text as tx
from corpusloom.operators import context as cx
from corpusloom.operators import lexical as lx
from corpusloom.operators import retrieval as rt
from corpusloom.operators import vectors as vx
from corpusloom.plans.scan import joined_parts
from corpusloom.plans.session import cut, tables

# three ranked lists over documents: an arithmetic seed list, embedding neighbours and BM25 hits
LISTS = f"""{BM25}, e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    vp AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.v, b.v), 6) AS distance FROM e a JOIN benchmark ON item_id = a.vec_id, e b),
    vh AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance DESC, id) AS rank FROM vp WHERE distance >= 0.2 QUALIFY rank <= 3),
    l AS (SELECT item_id AS query_id, (item_id * 7) * 1000000 AS cid, 1 AS rank, 0 AS no, 100.0 AS base, NULL::DOUBLE AS d, NULL::DOUBLE AS s FROM benchmark
        UNION ALL SELECT item_id, item_id * 1000000, 2, 0, 100.0, NULL, NULL FROM benchmark
        UNION ALL SELECT query_id, id * 1000000, rank, 1, 99.5, distance, NULL FROM vh UNION ALL SELECT item_id, cid, rank, 2, 98.5, NULL, s FROM bm),
    fu AS (SELECT query_id, cid, max(base + 1 - rank) AS score, min(no * 100 + rank) AS o, string_agg(DISTINCT CASE no WHEN 0 THEN 'graph_seed' WHEN 1 THEN 'vector' ELSE 'lexical' END, '|') AS src_raw,
        list_sort(list(DISTINCT CASE no WHEN 0 THEN 'graph_seed' WHEN 1 THEN 'vector' ELSE 'lexical' END)) AS src, max(d) AS d, max(s) AS s
        FROM l WHERE cid IN (SELECT cid FROM ids) GROUP BY 1, 2),
    fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, o) AS rank FROM fu QUALIFY rank <= 15)"""


def _fused(t):
    chunks = cut(doc_chunks(t))
    b = t("benchmark")
    seeds = b.select(F.col("item_id").alias("query_id"), F.posexplode(F.array(F.col("item_id") * 7000000, F.col("item_id") * 1000000)).alias("p", "chunk_id"))
    seeds = seeds.select("query_id", (F.col("p") + 1).alias("rank"), "chunk_id")
    e = t("embeddings")
    own = e.join(b.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), "embedding")
    vec = vx.vector_top_k(own, e.select(F.col("vec_id").alias("id"), "embedding"), 3).select(
        "query_id", "rank", (F.col("id") * 1000000).alias("chunk_id"), F.round("distance", 6).alias("distance")
    )
    lex = lx.bm25_top_k(_bench(t), lx.bm25_index(chunks), 4).withColumnRenamed("bm25_score", "lexical_score")
    return cx.hybrid_fuse(seeds, vec, lex, chunks), chunks


@case(
    "g19_hybrid_fuse",
    f"WITH {LISTS} SELECT query_id, rank, cid AS chunk_id, score::DOUBLE AS score, array_to_string(src, '|') AS sources, d AS vector_distance, s AS lexical_score FROM fused",
)
def _(spark, sf):
    out, _c = _fused(tables(spark, sf))
    return out.select("query_id", "rank", "chunk_id", "score", F.array_join("sources", "|").alias("sources"), "vector_distance", "lexical_score")


@case(
    "g20_rerank",
    f"""WITH {LISTS}, r AS (SELECT query_id, cid, rank AS old, CASE WHEN rank <= 6 AND cid % 2000000 <> 0 THEN length(content) END AS rs, count(*) OVER (PARTITION BY query_id) AS n FROM fused JOIN ids USING (cid))
    SELECT query_id, cid AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rs IS NOT NULL AND n > 1 THEN 0 WHEN old <= 6 THEN 1 ELSE 2 END, CASE WHEN n > 1 THEN rs END DESC NULLS LAST, old) AS rank FROM r""",
)
def _(spark, sf):
    fused, chunks = _fused(tables(spark, sf))
    scorer = F.when(F.col("chunk_id") % 2000000 != 0, F.length("content"))
    out = cx.rerank(fused.join(chunks.select("chunk_id", "content"), "chunk_id"), scorer, 6)
    return out.select("query_id", "chunk_id", "rank")


@case(
    "g21_truncate_by_tokens",
    f"""SELECT doc_id, source FROM (SELECT doc_id, source, sum({q.ntok('text')}) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS s FROM documents) WHERE s <= 8000""",
)
def _(spark, sf):
    return cx.truncate_by_tokens(tables(spark, sf)("documents"), "source", "doc_id", "text", 8000).select("doc_id", "source")


def _cell(x):
    return f"CASE WHEN regexp_matches({x}, '[\",\\r\\n]') THEN '\"' || replace({x}, '\"', '\"\"') || '\"' ELSE {x} END"


CRLF = "chr(13) || chr(10)"
CONTEXT = f"""tok AS (SELECT *, sum({q.ntok('content')}) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS sm FROM fused JOIN ids USING (cid)),
    ctx AS (SELECT item_id AS query_id, chr(10) || '-----Sources-----' || chr(10) || '```csv' || chr(10) || 'id,content' || {CRLF} || coalesce(string_agg(cid || ',' || {_cell('content')} || {CRLF}, '' ORDER BY rank) FILTER (sm <= 800), '')
        || chr(10) || '```' || chr(10) || '-----Entities-----' || chr(10) || '```csv' || chr(10) || 'entity,entity_type,score,description' || {CRLF}
        || 'bench,EQUIPMENT,12.3457,' || {_cell('any_value(text)')} || {CRLF} || chr(10) || '```' || chr(10) AS context
        FROM benchmark LEFT JOIN tok ON query_id = item_id GROUP BY item_id)"""


def _context(t):
    fused, chunks = _fused(t)
    b = t("benchmark")
    ent = b.select(F.col("item_id").alias("query_id"), F.lit(1).alias("rank"), F.lit("bench").alias("entity_name"), F.lit("EQUIPMENT").alias("entity_type"), F.lit(12.345678).alias("score"), F.col("text").alias("description"))
    return cx.build_context(b.select(F.col("item_id").alias("query_id")), ent, fused.join(chunks.select("chunk_id", "content"), "chunk_id"), 500, 800)


@case("g22_build_context", f"WITH {LISTS}, {CONTEXT} SELECT query_id, md5(context) AS context_md5 FROM ctx")
def _(spark, sf):
    return _context(tables(spark, sf)).select("query_id", F.md5("context").alias("context_md5"))


@case("g25_parse_context", f"WITH {LISTS}, {CONTEXT} SELECT query_id, coalesce(string_agg(cid, '|' ORDER BY rank) FILTER (sm <= 800), '') AS ids FROM (SELECT item_id FROM benchmark) LEFT JOIN tok ON query_id = item_id WHERE query_id IS NOT NULL GROUP BY query_id")
def _(spark, sf):
    return _context(tables(spark, sf)).select("query_id", F.array_join(cx.parse_context(F.col("context")), "|").alias("ids"))


@case(
    "g24_fit_prompt",
    f"SELECT doc_id, md5(CASE WHEN {q.ntok('text')} > 788 - 100 THEN {q.take('text', 688)} ELSE text END) AS context_md5 FROM documents",
)
def _(spark, sf):
    # window 1044: 256 kept for the reply, 788 for the prompt, 100 of them for its prefix
    return tables(spark, sf)("documents").select("doc_id", F.md5(cx.fit_prompt(F.col("text"), F.lit(100), 1044)).alias("context_md5"))


RAW = "CASE WHEN turn % 3 = 0 THEN 'see manual_' || conv_id || '.pdf page: ' || turn || ' score: 0.5' || chr(10) || chr(10) || 'chunk: ab' || conv_id || '-1 other' || chr(10) || chr(10) || 'plain words' ELSE 'plain text without any signal' END"


@case(
    "g26_evidence_payload",
    """SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'partial' ELSE 'unavailable' END AS status, CASE WHEN turn % 3 = 0 THEN 'manual_' || conv_id || '.pdf' ELSE '' END AS sources,
    CASE WHEN turn % 3 = 0 THEN 'manual_' || conv_id || '.pdf#' || turn || '#0.5|ab' || conv_id || '-1' ELSE '' END AS items FROM conversations""",
)
def _(spark, sf):
    c = tables(spark, sf)("conversations").select("conv_id", "turn", F.expr(RAW.replace("chr(10)", "char(10)")).alias("raw"))
    e = c.withColumn("e", cx.evidence_payload(F.col("raw")))
    items = F.transform("e.items", lambda x: F.concat_ws("#", x["title"], x["page"], x["score"]))
    return e.select("conv_id", "turn", "e.status", F.array_join("e.sources", "|").alias("sources"), F.array_join(items, "|").alias("items"))


@case(
    "g27_combine_contexts",
    """SELECT item_id, CASE WHEN a < b THEN a || '@' || b WHEN a > b THEN b || '@' || a ELSE a END AS rows FROM (SELECT item_id, text AS a, lead(text, 1, text) OVER (ORDER BY item_id) AS b FROM benchmark)""",
)
def _(spark, sf):
    b = tables(spark, sf)("benchmark")
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    j = b.join(nxt, "item_id", "left").withColumn("other", F.coalesce("other", "text"))

    def ctx(c):
        return F.concat(F.lit("id,content\r\n"), cx.csv_row(F.lit("1"), F.col(c)), cx.csv_row(F.lit("2"), F.col("text")))

    body = F.expr("substring(c, length('id,\tcontent\n') + 1)")
    rows = F.regexp_replace(F.regexp_replace(body, "^1,\t", ""), "\n2,\t", "@")
    return j.select("item_id", cx.combine_contexts(ctx("text"), ctx("other")).alias("c")).select("item_id", rows.alias("rows"))


def _reply_pairs(t):
    """Per conversation: its first text against every assistant text."""
    c = t("conversations")
    first = c.where("turn = 0").select(F.col("conv_id").alias("query_id"), F.col("text").alias("target"))
    return c.where("role = 'assistant'").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("ord"), F.col("text").alias("sentence")).join(first, "query_id")


WORDS = f"list_filter(string_split_regex(lower({q.strip('{{x}}')}), '{q.W}+'), lambda w: w <> '')".replace("{{x}}", "{x}")
PAIRS = "pr AS (SELECT a.conv_id AS query_id, a.turn AS ord, {a} AS s, {b} AS t FROM conversations a JOIN conversations f ON f.conv_id = a.conv_id AND f.turn = 0 WHERE a.role = 'assistant')".format(
    a=WORDS.replace("{x}", "a.text"), b=WORDS.replace("{x}", "f.text")
)
UNION = "len(list_distinct(s || t))"


@case(
    "g28_top_similar_jaccard",
    f"WITH {PAIRS}, j AS (SELECT query_id, ord, CASE WHEN {UNION} = 0 THEN 0 ELSE len(list_intersect(list_distinct(s), list_distinct(t))) / {UNION} END AS v FROM pr) SELECT query_id, ord, round(v, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(v, 9) DESC, ord) AS r FROM j) WHERE r <= 2",
)
def _(spark, sf):
    return cx.top_similar(_reply_pairs(tables(spark, sf)), "jaccard", 2).select("query_id", "ord", F.round("similarity", 6).alias("similarity"))


@case(
    "g28_top_similar_rouge",
    f"WITH {PAIRS}, j AS (SELECT query_id, ord, 2.0 * len(list_intersect(list_distinct(s), list_distinct(t))) / greatest(1, len(list_distinct(s)) + len(list_distinct(t))) AS v FROM pr) SELECT query_id, ord, round(v, 6)::DOUBLE AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(v, 9) DESC, ord) AS r FROM j) WHERE r <= 2",
)
def _(spark, sf):
    return cx.top_similar(_reply_pairs(tables(spark, sf)), "rouge", 2).select("query_id", "ord", F.round("similarity", 6).alias("similarity"))


@case("g28_top_similar_levenshtein", None)
def _(spark, sf):
    return cx.top_similar(_reply_pairs(tables(spark, sf)), "levenshtein", 2).select("query_id", "ord", "similarity")


@case(
    "g29_parse_mode_prefix",
    """SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'graph_only' WHEN 1 THEN 'text_only' ELSE 'graph_text_hybrid' END AS mode, md5(CASE WHEN turn % 3 = 2 THEN '/other ' || text ELSE ltrim(text) END) AS query_md5 FROM conversations""",
)
def _(spark, sf):
    raw = F.concat(F.when(F.col("turn") % 3 == 0, F.lit("/graph_only  ")).when(F.col("turn") % 3 == 1, F.lit("/text_only ")).otherwise(F.lit("/other ")), "text")
    c = tables(spark, sf)("conversations").withColumn("p", cx.parse_mode_prefix(raw))
    return c.select("conv_id", "turn", "p.mode", F.md5("p.query").alias("query_md5"))


# --- end to end -----------------------------------------------------------------------------------------


def record_corpus(t):
    from corpusloom.cases.alias_cases import part_aliases
    from corpusloom.operators import graph_build as gb
    from corpusloom.operators import records as rec

    gr = v.graph(t)
    r = v.records(t)
    chunks = cut(r.select(gb.record_chunk_id(F.col("doc_name"), F.col("record_id")).alias("chunk_id"), F.col("ord"), rec.render_chunk().alias("content")))
    parts = gb.render_nodes(gr).select("entity_name", "entity_type", "part_no", "descriptions")
    desc = joined_parts(parts, ["entity_name", "entity_type"], "descriptions")
    desc = desc.select("entity_name", "entity_type", F.col("entity_name").alias("ord"), F.array_join("descriptions", tx.SEP).alias("description"))
    vectors = cut(vx.embed(chunks.select(F.col("chunk_id").alias("id"), "content"), vx.hashed_embedder(32)).select("id", "embedding"))
    sources = gr.node_facets.where("facet = 'source'").select("entity_name", F.col("value").alias("source_id"))
    return rt.Corpus(chunks, cut(desc), gr.edges, sources, vectors, part_aliases(t), lx.bm25_index(chunks))


@case("g23_retrieve", None)
def _(spark, sf):
    t = tables(spark, sf)
    # one question per kind of part, the five modes in turn
    p = t("part").select("p_name", "p_type").distinct()
    mode = F.element_at(F.array(*[F.lit(m) for m in rt.MODES]), (F.pmod(F.xxhash64("p_name", "p_type"), F.lit(5)) + 1).cast("int"))
    qs = p.select(
        F.md5(F.concat_ws("~", "p_name", "p_type")).alias("query_id"), F.concat(F.lit("how to repair "), "p_name", F.lit(" "), "p_type").alias("query"),
        mode.alias("mode"), F.array("p_name", "p_type").alias("keywords"),
    )
    out = rt.retrieve(qs, record_corpus(t), rt.QueryParams(), vx.hashed_embedder(32))
    return out.select("query_id", "mode", F.array_join("chunk_ids", "|").alias("chunk_ids"), F.length("context").alias("context_length"))


@case("g23_keyword_search", f"WITH {BM25} SELECT item_id AS query_id, string_agg(cid, '|' ORDER BY rank) AS chunk_ids FROM bm GROUP BY item_id")
def _(spark, sf):
    t = tables(spark, sf)
    chunks = cut(doc_chunks(t).withColumn("chunk_id", F.col("chunk_id").cast("string")))
    qs = _bench(t).withColumn("mode", F.lit("keyword_search"))
    out = rt.retrieve(qs, rt.Corpus(chunks, bm25=lx.bm25_index(chunks)), rt.QueryParams(text_budget=1_000_000))
    return out.select("query_id", F.array_join("chunk_ids", "|").alias("chunk_ids"))
