"""Node scoring, vector, lexical and BM25 retrieval."""

from pyspark.sql import functions as F

from corpusloom.cases import case
from corpusloom.cases import sqltext as q
from corpusloom.cases import views as v
from corpusloom.functions import text as tx
from corpusloom.operators import chunks as ck
from corpusloom.operators import lexical as lx
from corpusloom.operators import seeding as sd
from corpusloom.operators import vectors as vx
from corpusloom.plans.session import tables

# --- node scoring: benchmark texts, part questions and fault names against the record graph ----------


def node_queries(t):
    b = t("benchmark").select(F.concat(F.lit("b"), "item_id").alias("query_id"), F.col("text").alias("query"))
    p = t("part").select("p_name", "p_type").distinct().select(F.concat(F.lit("p-"), "p_name", F.lit("-"), "p_type").alias("query_id"), F.concat(F.lit("how to repair "), "p_name", F.lit(" "), "p_type").alias("query"))
    f = t("part").select("p_type").distinct().select(F.concat(F.lit("f-"), "p_type").alias("query_id"), F.concat("p_type", F.lit(" R fails")).alias("query"))
    s = t("part").select(F.split("p_name", " ")[1].alias("w")).distinct().select(F.concat(F.lit("s-"), "w").alias("query_id"), F.col("w").alias("query"))
    return b.unionByName(p).unionByName(f).unionByName(s)


NQ = f"""nq AS (SELECT 'b' || item_id AS query_id, text AS query FROM benchmark UNION ALL SELECT DISTINCT 'p-' || p_name || '-' || p_type, 'how to repair ' || p_name || ' ' || p_type FROM part
    UNION ALL SELECT DISTINCT 'f-' || p_type, p_type || ' R fails' FROM part UNION ALL SELECT DISTINCT 's-' || split_part(p_name, ' ', 2), split_part(p_name, ' ', 2) FROM part),
    nqn AS (SELECT query_id, {q.norm('query')} AS qn FROM nq)"""
# one alias per node is enough here: bracketed asides are dropped by the normal form anyway
SCORES = f"""{v.CAND}, {NQ}, nn AS (SELECT entity_name, entity_type, {q.norm('entity_name')} AS a FROM nodes WHERE entity_type IN ('EQUIPMENT', 'FAULTCASE')),
    nc AS (SELECT *, list_distinct(string_split(a, '')) AS ac FROM nn), qc AS (SELECT *, list_distinct(string_split(qn, '')) AS qch FROM nqn),
    base AS (SELECT query_id, entity_name, entity_type, contains(qn, a) AS exact, CASE WHEN contains(qn, a) THEN 1000.0 + 10 * length(a) WHEN contains(a, qn) THEN 300.0 + 5 * length(qn)
        WHEN len(list_intersect(ac, qch)) >= 2 THEN len(list_intersect(ac, qch)) * 10.0 / len(ac) ELSE 0.0 END AS base FROM qc, nc),
    sc AS (SELECT *, base + CASE WHEN entity_type = 'FAULTCASE' THEN 5 ELSE 0 END AS score FROM base)"""


@case(
    "g09_score_nodes",
    f"""WITH {SCORES} SELECT query_id, rank, entity_name, round(score::DOUBLE, 6) AS score, exact FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_name) AS rank FROM sc WHERE score > 0) WHERE rank <= 8""",
)
def _(spark, sf):
    t = tables(spark, sf)
    names = sd.node_names(_typed(t))
    qs = node_queries(t).select("query_id", tx.alias_norm(F.col("query")).alias("qn"))
    return sd.score_nodes(qs, names, 8).select("query_id", "rank", "entity_name", F.round("score", 6).alias("score"), "exact")


def _typed(t):
    return v.graph(t).nodes.withColumn("ord", F.col("entity_name"))


SEED = f"""{SCORES}, best AS (SELECT query_id, min(CASE entity_type WHEN 'FAULTCASE' THEN 1 ELSE 2 END) AS branch FROM sc WHERE exact GROUP BY 1),
    anc AS (SELECT s.query_id, branch, entity_name, entity_type, row_number() OVER (PARTITION BY s.query_id ORDER BY entity_name) AS ar, count(*) OVER (PARTITION BY s.query_id) AS na
        FROM sc s JOIN best b USING (query_id) WHERE exact AND branch = CASE entity_type WHEN 'FAULTCASE' THEN 1 ELSE 2 END),
    sym AS (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges),
    nb1 AS (SELECT query_id, b AS entity_name, min(lpad(ar::VARCHAR, 6, '0') || b) AS o FROM anc JOIN sym ON a = entity_name WHERE branch = 1 AND ar <= 8
        AND (query_id, b) NOT IN (SELECT query_id, entity_name FROM anc) GROUP BY 1, 2),
    nb2 AS (SELECT anc.query_id, b AS entity_name, na, row_number() OVER (PARTITION BY anc.query_id ORDER BY CASE WHEN sc.exact THEN 900 ELSE sc.score END DESC, ar, b) AS pos,
        CASE WHEN sc.exact THEN 900 ELSE sc.score END AS score FROM anc JOIN sym ON a = anc.entity_name JOIN sc ON sc.query_id = anc.query_id AND sc.entity_name = b
        WHERE branch = 2 AND sc.score > 0),
    dr AS (SELECT entity_name FROM nodes WHERE entity_type = 'DOCROOT'),
    drs AS (SELECT query_id, entity_name, CASE WHEN contains(qn, a) THEN 1000.0 + 10 * length(a) WHEN contains(a, qn) THEN 300.0 + 5 * length(qn)
        WHEN len(list_intersect(list_distinct(string_split(a, '')), qch)) >= 2 THEN len(list_intersect(list_distinct(string_split(a, '')), qch)) * 10.0 / len(list_distinct(string_split(a, ''))) ELSE 0.0 END AS score
        FROM qc, (SELECT entity_name, {q.norm('entity_name')} AS a FROM dr)),
    nb2all AS (SELECT query_id, entity_name, na, ar, score FROM (SELECT anc.query_id, b AS entity_name, na, ar, CASE WHEN sc.exact THEN 900 ELSE sc.score END AS score FROM anc JOIN sym ON a = anc.entity_name
            JOIN sc ON sc.query_id = anc.query_id AND sc.entity_name = b WHERE branch = 2 AND sc.score > 0
        UNION ALL SELECT anc.query_id, b, na, ar, drs.score FROM anc JOIN sym ON a = anc.entity_name JOIN drs ON drs.query_id = anc.query_id AND drs.entity_name = b WHERE branch = 2 AND drs.score > 0)),
    nb2r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ar, entity_name) AS pos FROM nb2all),
    parts AS (SELECT query_id, branch, entity_name, 1000.0 AS score, 0 AS seg, lpad(ar::VARCHAR, 6, '0') AS pos FROM anc WHERE ar <= 8
        UNION ALL SELECT query_id, 1, entity_name, 900.0, 1, o FROM nb1
        UNION ALL SELECT query_id, 2, entity_name, min(score), 1, lpad(min(pos)::VARCHAR, 6, '0') FROM nb2r WHERE pos <= 8 - na AND (query_id, entity_name) NOT IN (SELECT query_id, entity_name FROM anc) GROUP BY query_id, entity_name
        UNION ALL SELECT query_id, 0, entity_name, score, 0, lpad((row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_name))::VARCHAR, 6, '0') FROM sc
            WHERE score > 0 AND query_id NOT IN (SELECT query_id FROM best)),
    seed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seg, pos) AS rank FROM parts QUALIFY rank <= 8)"""


@case("g10_graph_seed", f"WITH {SEED} SELECT query_id, rank, entity_name, round(score::DOUBLE, 6) AS score, branch FROM seed")
def _(spark, sf):
    top, _s = _seeds(tables(spark, sf))
    return top.select("query_id", "rank", "entity_name", F.round("score", 6).alias("score"), "branch")


def _seeds(t):
    gr = v.graph(t)
    top, nodes = sd.graph_seed(node_queries(t), gr.nodes.withColumn("ord", F.col("entity_name")), gr.edges, 8)
    return top, sd.collect_source_chunks(nodes, gr.node_facets.where("facet = 'source'").select("entity_name", F.col("value").alias("source_id")), 8)


@case(
    "g11_collect_source_chunks",
    f"""WITH {SEED}, w AS (SELECT *, branch = 2 AND entity_name NOT LIKE '%（%' AS skip FROM seed WHERE branch <> 1), w2 AS (SELECT *, bool_and(skip) OVER (PARTITION BY query_id) AS alls FROM w),
    nodes2 AS (SELECT query_id, branch > 0 AS exact, lpad(rank::VARCHAR, 6, '0') AS o, entity_name FROM w2 WHERE NOT skip OR alls UNION ALL SELECT query_id, true, entity_name, entity_name FROM anc WHERE branch = 1),
    c AS (SELECT query_id, exact, value AS chunk_id, min(o || '/' || value) AS o FROM nodes2 JOIN nfac USING (entity_name) WHERE facet = 'source' GROUP BY 1, 2, 3)
    SELECT query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o) AS rank FROM c) WHERE rank <= CASE WHEN exact THEN 2 ELSE 4 END""",
)
def _(spark, sf):
    return _seeds(tables(spark, sf))[1]


# --- vectors ------------------------------------------------------------------------------------------


@case(
    "g12_vector_top_k",
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    p AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.v, b.v), 6) AS distance FROM e a, e b)
    SELECT query_id, rank, id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance DESC, id) AS rank FROM p WHERE distance >= 0.2) WHERE rank <= 3""",
)
def _(spark, sf):
    e = tables(spark, sf)("embeddings")
    hits = vx.vector_top_k(e.select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("id"), "embedding"), 3)
    return hits.withColumn("distance", F.round("distance", 6))


@case(
    "g13_embed_and_upsert",
    f"""WITH {q.CRC_TABLE}, w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM documents),
    f AS (SELECT doc_id, unnest(list_concat([w], list_transform(range(1, greatest(length(w) - 1, 1)), lambda j: w[j:j + 2]))) AS s FROM w),
    n AS (SELECT doc_id, s, count(*) AS n FROM f GROUP BY 1, 2), h AS (SELECT s, {q.CRC_OF} AS h FROM (SELECT DISTINCT s FROM n), crc_table),
    v AS (SELECT doc_id, h % 64 AS slot, sum(CASE WHEN (h >> 16) % 2 = 1 THEN n ELSE -n END)::DOUBLE AS v FROM n JOIN h USING (s) GROUP BY 1, 2),
    u AS (SELECT doc_id, sum((slot + 1) * v) / nullif(sqrt(sum(v * v)), 0) AS c FROM v GROUP BY 1)
    SELECT 'd' || doc_id AS id, lang, 64 AS dims, round(coalesce(c, 0.0), 6) AS checksum FROM documents LEFT JOIN u USING (doc_id)""".replace("\\\\", "\\"),
)
def _(spark, sf):
    d = tables(spark, sf)("documents")
    rows = d.select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("text").alias("content"), "lang")
    # all texts first with another content, then those of other languages again as they are, then the English ones
    base = vx.embed_and_upsert(None, rows.withColumn("content", F.lit("old")))
    out = vx.embed_and_upsert(vx.embed_and_upsert(base, rows.where("lang <> 'en' or lang is null")), rows.where("lang = 'en'"))
    weighted = F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return out.select("id", "lang", F.size("embedding").alias("dims"), F.round(weighted, 6).alias("checksum"))


# --- lexical ----------------------------------------------------------------------------------------


LEX = """CASE WHEN qn = '' OR cn = '' THEN 0.0 WHEN contains(cn, qn) THEN 100.0 + least(length(qn), 20)
    WHEN len(list_intersect(qs, cs)) < 2 THEN 0.0 ELSE round(len(list_intersect(qs, cs)) / len(qs) * 40.0 + CASE WHEN starts_with(cn, substring(qn, 1, 2)) THEN 5.0 ELSE 0.0 END, 4) END"""


@case(
    "g14_lexical_score",
    f"""WITH p AS (SELECT u.conv_id, u.turn, {q.norm('u.text')} AS qn, {q.norm('a.text')} AS cn FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1),
    s AS (SELECT *, list_distinct(string_split(qn, '')) AS qs, list_distinct(string_split(cn, '')) AS cs FROM p) SELECT conv_id, turn, {LEX}::DOUBLE AS score FROM s""",
)
def _(spark, sf):
    c = tables(spark, sf)("conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", lx.lexical_score(F.col("text"), F.col("reply")).alias("score"))


def _bench(t):
    return t("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _chunks(t):
    return t("documents").select(F.concat(F.lit("d"), "doc_id").alias("chunk_id"), F.col("doc_id").alias("ord"), F.col("text").alias("content"))


@case(
    "g15_candidate_ids",
    """WITH s AS (SELECT item_id AS query_id, 1 AS src, 1 AS r, 'd' || (item_id * 3) AS chunk_id FROM benchmark UNION ALL SELECT item_id, 2, 1, 'd' || (item_id + 500) FROM benchmark
        UNION ALL SELECT item_id, 2, 2, 'd' || (item_id * 3) FROM benchmark UNION ALL SELECT item_id, 3, rn, 'd' || doc_id FROM benchmark, (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 120),
    f AS (SELECT query_id, chunk_id, min(src * 1000000 + r) AS o FROM s GROUP BY 1, 2)
    SELECT query_id, chunk_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o) AS ord FROM f) WHERE ord <= 120""",
)
def _(spark, sf):
    t = tables(spark, sf)
    b = t("benchmark")
    three = F.concat(F.lit("d"), F.col("item_id") * 3)
    seeds = b.select(F.col("item_id").alias("query_id"), F.lit(1).alias("rank"), three.alias("chunk_id"))
    vec = b.select(F.col("item_id").alias("query_id"), F.posexplode(F.array(F.concat(F.lit("d"), F.col("item_id") + 500), three)).alias("rank", "chunk_id"))
    return lx.candidate_ids(seeds, vec, _bench(t), _chunks(t), 120)


@case(
    "g16_lexical_top_k",
    f"""WITH b AS (SELECT item_id AS query_id, {q.norm('text')} AS qn FROM benchmark), d AS (SELECT doc_id, {q.norm('text')} AS cn FROM documents),
    bs AS (SELECT *, list_distinct(string_split(qn, '')) AS qs FROM b), ds AS (SELECT *, list_distinct(string_split(cn, '')) AS cs FROM d),
    s AS (SELECT query_id, doc_id, {LEX}::DOUBLE AS lexical_score FROM bs, ds)
    SELECT query_id, rank, 'd' || doc_id AS chunk_id, lexical_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical_score DESC, doc_id) AS rank FROM s WHERE lexical_score > 0) WHERE rank <= 4""",
)
def _(spark, sf):
    t = tables(spark, sf)
    return lx.lexical_top_k(_bench(t), _chunks(t), 4)


TERMS = f"list_filter(list_transform(string_split_regex({q.strip('text')}, '{q.W}+'), lambda w: {q.norm('w')}), lambda w: length(w) > 1)"


@case(
    "g17_keyword_terms",
    f"""WITH w AS (SELECT item_id, {TERMS} AS a FROM benchmark), u AS (SELECT item_id, unnest(a) AS term, generate_subscripts(a, 1) AS i FROM w),
    f AS (SELECT item_id, term, min(i) AS i FROM u GROUP BY 1, 2) SELECT item_id, string_agg(term, ' ' ORDER BY i) AS terms FROM f GROUP BY 1""",
)
def _(spark, sf):
    return tables(spark, sf)("benchmark").select("item_id", F.array_join(tx.keyword_terms(F.col("text")), " ").alias("terms"))


# the flagship: documents are cut into chunks, every benchmark item finds its best four
BM25 = f"""{q.chunk_cte('documents', 1200, 100)},
    ids AS (SELECT full_doc_id * 1000000 + chunk_order_index AS cid, content FROM chunks),
    tk AS (SELECT cid, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+') AS t FROM ids), tk2 AS (SELECT * FROM tk WHERE len(t) > 0),
    post AS (SELECT cid, term, count(*) AS tf FROM (SELECT cid, unnest(t) AS term FROM tk2) GROUP BY 1, 2), dl AS (SELECT cid, len(t) AS dl FROM tk2),
    st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
    i0 AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, st), mi AS (SELECT avg(idf) AS m FROM i0),
    idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * m ELSE idf END AS idf FROM i0, mi),
    qt AS (SELECT DISTINCT item_id, unnest({TERMS}) AS term FROM benchmark),
    sc AS (SELECT item_id, cid, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS s FROM qt JOIN idf USING (term) JOIN post USING (term) JOIN dl USING (cid), st GROUP BY 1, 2),
    bm AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, cid) AS rank FROM sc WHERE s > 0 QUALIFY rank <= 4)"""


def doc_chunks(t):
    """Document chunks keyed by document and position."""
    c = ck.chunk_by_tokens(t("documents"))
    cid = F.col("full_doc_id") * 1000000 + F.col("chunk_order_index")
    return c.select(cid.alias("chunk_id"), cid.alias("ord"), "full_doc_id", "tokens", "content")


@case("g18_bm25_top_k", f"WITH {BM25} SELECT item_id AS query_id, rank, cid AS chunk_id, s AS bm25_score FROM bm")
def _(spark, sf):
    t = tables(spark, sf)
    return lx.bm25_top_k(_bench(t), lx.bm25_index(doc_chunks(t)), 4)


@case(
    "g18_bm25_of_candidates",
    f"""WITH cand AS (SELECT b.item_id, row_number() OVER (PARTITION BY b.item_id ORDER BY doc_id) AS ord, doc_id FROM benchmark b JOIN documents d ON d.doc_id % 20 = b.item_id % 20),
    tk AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS t FROM documents),
    c AS (SELECT item_id, ord, doc_id, t, len(t) AS dl FROM cand JOIN tk USING (doc_id) WHERE len(t) > 0),
    st AS (SELECT item_id, count(*) AS n, avg(dl) AS avgdl FROM c GROUP BY 1),
    tf AS (SELECT item_id, ord, doc_id, dl, term, count(*) AS tf FROM (SELECT *, unnest(t) AS term FROM c) GROUP BY ALL),
    i0 AS (SELECT item_id, term, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf JOIN st USING (item_id) GROUP BY 1, 2),
    mi AS (SELECT item_id, avg(idf) AS m FROM i0 GROUP BY 1), qt AS (SELECT DISTINCT item_id, unnest({TERMS}) AS term FROM benchmark),
    sc AS (SELECT item_id, ord, doc_id, round(sum(CASE WHEN idf < 0 THEN 0.25 * m ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS s
        FROM qt JOIN i0 USING (item_id, term) JOIN mi USING (item_id) JOIN tf USING (item_id, term) JOIN st USING (item_id) GROUP BY ALL)
    SELECT item_id AS query_id, rank, 'd' || doc_id AS chunk_id, s AS bm25_score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, ord) AS rank FROM sc WHERE s > 0) WHERE rank <= 4""".replace("\\\\", "\\"),
)
def _(spark, sf):
    t = tables(spark, sf)
    docs = _chunks(t)
    mine = t("benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 20).alias("m")).join(docs.select("chunk_id", "ord", (F.col("ord") % 20).alias("m")), "m")
    return lx.bm25_of_candidates(mine.select("query_id", "ord", "chunk_id"), _bench(t), docs)
