"""Document lifecycle and keyed tables."""

from pyspark.sql import functions as F

from corpusloom.cases import case
from corpusloom.cases import sqltext as q
from corpusloom.functions import text as tx
from corpusloom.operators import chunks as ck
from corpusloom.operators import store as st
from corpusloom.plans.session import tables

CLEAN = q.clean("text")


@case(
    "b01_assign_doc_ids",
    f"SELECT DISTINCT 'doc-' || md5(c) AS doc_id, length(c) AS n FROM (SELECT {CLEAN} AS c FROM documents)",
)
def _(spark, sf):
    docs = st.assign_doc_ids(tables(spark, sf)("documents"))
    return docs.select("doc_id", F.length("content").cast("long").alias("n"))


ENTITY_TEXT = "' caf&eacute; &#233;&#x4E2D; &euro;5 &amp;lt; &nosuch; ' || doc_id"
DECODED = "'café é中 €5 &lt; &nosuch; ' || doc_id"


@case("b01_assign_doc_ids_entities", f"SELECT DISTINCT 'doc-' || md5({DECODED}) AS doc_id, {DECODED} AS content FROM documents")
def _(spark, sf):
    return st.assign_doc_ids(tables(spark, sf)("documents").select(F.expr(ENTITY_TEXT).alias("text")))


def _new_docs(t):
    return t("documents").select(
        F.concat(F.lit("d"), "doc_id").alias("doc_id"), F.col("text").alias("content"), F.col("doc_id").alias("ord")
    )


def _status(t):
    """Labelled documents: quality 1 processed, 0 failed."""
    return t("labels").select(
        F.concat(F.lit("d"), "doc_id").alias("doc_id"),
        F.when(F.col("quality") == 1, F.lit("processed")).otherwise(F.lit("failed")).alias("status"),
    )


SQL_LAST = """last AS (SELECT max(doc_id) AS doc_id FROM documents GROUP BY text),
    done AS (SELECT doc_id FROM labels WHERE quality = 1),
    queue AS (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM last)
        AND doc_id NOT IN (SELECT doc_id FROM done))"""
SUMMARY = "CASE WHEN length(text) <= 200 THEN text ELSE substring(text, 1, 200) || '...' END"


@case(
    "b02_enqueue_documents",
    f"""WITH {SQL_LAST} SELECT 'd' || doc_id AS doc_id, md5(text) AS content_md5, {SUMMARY} AS content_summary,
    length(text) AS content_length, 'pending' AS status FROM queue""",
)
def _(spark, sf):
    t = tables(spark, sf)
    out = st.enqueue_documents(_new_docs(t), _status(t))
    return out.select(
        "doc_id", F.md5("content").alias("content_md5"), "content_summary", F.col("content_length").cast("long").alias("content_length"), "status"
    )


@case("b03_content_summary", f"SELECT doc_id, {SUMMARY} AS content_summary, length(text) AS content_length FROM documents")
def _(spark, sf):
    return tables(spark, sf)("documents").select(
        "doc_id",
        st.content_summary(F.col("text")).alias("content_summary"),
        F.length("text").cast("long").alias("content_length"),
    )


@case(
    "b04_status_counts",
    """SELECT s AS o_orderstatus, count(o_orderkey) AS n FROM (VALUES ('O'), ('F'), ('P'), ('X')) v(s)
    LEFT JOIN orders ON o_orderstatus = s GROUP BY s""",
)
def _(spark, sf):
    return st.status_counts(tables(spark, sf)("orders"), ("O", "F", "P", "X"), "o_orderstatus")


@case(
    "b05_docs_by_status",
    f"""SELECT d.doc_id, md5(coalesce(CASE WHEN toxic = 1 THEN NULL ELSE text END, {SUMMARY})) AS content_md5
    FROM documents d JOIN labels l USING (doc_id) WHERE quality = 1""",
)
def _(spark, sf):
    t = tables(spark, sf)
    docs = t("documents").join(t("labels"), "doc_id").select(
        "doc_id",
        F.when(F.col("toxic") == 1, None).otherwise(F.col("text")).alias("content"),
        st.content_summary(F.col("text")).alias("content_summary"),
        F.when(F.col("quality") == 1, F.lit("processed")).otherwise(F.lit("failed")).alias("status"),
    )
    return st.docs_by_status(docs, "processed").select("doc_id", F.md5("content").alias("content_md5"))


@case(
    "b06_process_queue",
    f"""WITH docs AS (SELECT 'd' || d.doc_id AS doc_id, text FROM documents d LEFT JOIN labels l USING (doc_id)
        WHERE quality IS NULL OR quality = 0), {q.chunk_cte('docs', 200, 20)},
    n AS (SELECT full_doc_id, count(DISTINCT md5(content)) AS c FROM chunks GROUP BY 1)
    SELECT doc_id, 'processed' AS status, coalesce(c, 0) AS chunks_count FROM docs LEFT JOIN n ON doc_id = full_doc_id""",
)
def _(spark, sf):
    t = tables(spark, sf)
    status = (
        _new_docs(t)
        .join(_status(t), "doc_id", "left")
        .withColumn("status", F.coalesce("status", F.lit("pending")))
    )
    done, _chunks = st.process_queue(status, 200, 20)
    return done.select("doc_id", "status", "chunks_count")


# the upserts split orders into an old part and a newer part that overlap
OLD, NEW = "o_orderdate < TIMESTAMP '1998-01-01'", "o_orderdate >= TIMESTAMP '1997-01-01'"


def _orders(t):
    o = t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    base = o.where(F.expr(OLD)).drop("o_orderdate")
    new = o.where(F.expr(NEW)).select("o_orderkey", F.lit("N").alias("o_orderstatus"), (-F.col("o_totalprice")).alias("o_totalprice"))
    return base, new


ORDERS = f"""b AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE {OLD}),
    n AS (SELECT o_orderkey, 'N' AS o_orderstatus, -o_totalprice AS o_totalprice FROM orders WHERE {NEW})"""


@case(
    "b07_upsert_insert_only",
    f"WITH {ORDERS} SELECT * FROM b UNION ALL SELECT * FROM n WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)",
)
def _(spark, sf):
    return st.upsert_insert_only(*_orders(tables(spark, sf)), "o_orderkey")


@case(
    "b08_upsert_replace",
    f"WITH {ORDERS} SELECT * FROM n UNION ALL SELECT * FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n)",
)
def _(spark, sf):
    return st.upsert_replace(*_orders(tables(spark, sf)), "o_orderkey")


@case(
    "b09_upsert_merge",
    """WITH b AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_custkey FROM orders WHERE o_orderstatus <> 'P'),
    n AS (SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'big' END AS o_orderstatus, o_orderpriority FROM orders
        WHERE o_orderstatus <> 'F')
    SELECT o_orderkey, coalesce(n.o_orderstatus, b.o_orderstatus) AS o_orderstatus, o_totalprice, o_custkey, o_orderpriority
    FROM b FULL JOIN n USING (o_orderkey)""",
)
def _(spark, sf):
    o = tables(spark, sf)("orders")
    base = o.where("o_orderstatus <> 'P'").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_custkey")
    new = o.where("o_orderstatus <> 'F'").select(
        "o_orderkey", F.expr("CASE WHEN o_totalprice > 250000 THEN 'big' END").alias("o_orderstatus"), "o_orderpriority"
    )
    return st.upsert_merge(base, new, "o_orderkey")


@case(
    "b10_multi_get",
    """SELECT o_orderkey AS request_id, pos, p_partkey, p_name, p_brand FROM
    (SELECT o_orderkey, unnest([0, 1]) AS pos, unnest([o_custkey, o_orderkey]) AS p_partkey FROM orders)
    LEFT JOIN (SELECT p_partkey, p_name, p_brand FROM part) USING (p_partkey)""",
)
def _(spark, sf):
    t = tables(spark, sf)
    requests = t("orders").select(F.col("o_orderkey").alias("request_id"), F.array("o_custkey", "o_orderkey").alias("ids"))
    return st.multi_get(requests, t("part"), "p_partkey", ["p_name", "p_brand"])


@case("b11_missing_keys", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def _(spark, sf):
    t = tables(spark, sf)
    return st.missing_keys(t("documents"), t("labels"), "doc_id")


@case(
    "b12_filter_delete_drop",
    """SELECT * FROM part WHERE p_size > 10 AND p_partkey NOT IN
    (SELECT l_partkey FROM lineitem WHERE l_quantity = 7)""",
)
def _(spark, sf):
    t = tables(spark, sf)
    part = t("part")
    kept = st.filter_rows(part, F.col("p_size") > 10)
    dead = t("lineitem").where("l_quantity = 7").select(F.col("l_partkey").alias("p_partkey"))
    return st.delete_keys(kept, dead, "p_partkey").unionByName(st.drop_rows(part))


def _doc_tables(t, max_tokens=200, overlap=20):
    docs = t("documents").select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), F.col("text").alias("content"))
    chunks = ck.chunk_by_tokens(docs, "doc_id", "content", max_tokens, overlap)
    return {
        "doc_status": docs.select("doc_id", F.lit("processed").alias("status")),
        "full_docs": docs,
        "text_chunks": chunks,
        "chunk_vectors": chunks.select("chunk_id").distinct(),
    }


GONE = "(SELECT 'd' || doc_id FROM labels WHERE toxic = 1)"
PURGE = f"""docs AS (SELECT 'd' || doc_id AS doc_id, text FROM documents), {q.chunk_cte('docs', 200, 20)},
    kept AS (SELECT full_doc_id, 'chunk-' || md5(content) AS id FROM chunks WHERE full_doc_id NOT IN {GONE})"""


@case(
    "b13_purge_document",
    f"""WITH {PURGE}
    SELECT 'doc_status' AS tab, doc_id AS id FROM docs WHERE doc_id NOT IN {GONE}
    UNION ALL SELECT 'full_docs', doc_id FROM docs WHERE doc_id NOT IN {GONE}
    UNION ALL SELECT 'text_chunks', id FROM kept
    UNION ALL SELECT DISTINCT 'chunk_vectors', id FROM kept""",
)
def _(spark, sf):
    t = tables(spark, sf)
    gone = t("labels").where("toxic = 1").select(F.concat(F.lit("d"), "doc_id").alias("doc_id"))
    left = st.purge_document(_doc_tables(t), gone)
    out = None
    for name, key in (("doc_status", "doc_id"), ("full_docs", "doc_id"), ("text_chunks", "chunk_id"), ("chunk_vectors", "chunk_id")):
        part = left[name].select(F.lit(name).alias("tab"), F.col(key).alias("id"))
        out = part if out is None else out.unionByName(part)
    return out


@case(
    "b14_reindex_document",
    f"""WITH docs AS (SELECT 'd' || doc_id AS doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
        UNION ALL SELECT 'new-' || max(doc_id), text || ' (v2)' FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
        GROUP BY text), {q.chunk_cte('docs', 200, 20)}
    SELECT full_doc_id, 'chunk-' || md5(content) AS chunk_id, chunk_order_index, tokens FROM chunks""",
)
def _(spark, sf):
    t = tables(spark, sf)
    toxic = t("labels").where("toxic = 1").select("doc_id")
    gone = toxic.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"))
    fresh = t("documents").join(toxic, "doc_id", "left_semi").select(
        F.concat(F.lit("new-"), "doc_id").alias("doc_id"),
        F.concat("text", F.lit(" (v2)")).alias("content"),
        F.col("doc_id").alias("ord"),
    )
    out = st.reindex_documents(_doc_tables(t), gone, fresh, 200, 20)["text_chunks"]
    return out.select("full_doc_id", "chunk_id", "chunk_order_index", "tokens")


@case(
    "b15_sync_registry",
    """SELECT d.doc_id, n_chars, coalesce(CAST(quality AS VARCHAR), 'pending') AS status, coalesce(toxic, 0) AS flag
    FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def _(spark, sf):
    t = tables(spark, sf)
    registry = t("labels").select("doc_id", F.col("quality").cast("string").alias("status"), F.col("toxic").alias("flag"))
    listing = t("documents").select("doc_id", "n_chars")
    return st.sync_registry(registry, listing, "doc_id", {"status": "pending", "flag": 0})


def _inventory(t):
    items = t("documents").select(
        F.col("doc_id").alias("item_id"),
        F.concat(F.lit("/in/"), "doc_id").alias("path"),
        F.lit("uploaded").alias("status"),
        F.lit("old").alias("error"),
        F.col("n_chars").alias("modified_at"),
    )
    status = t("labels").select(
        F.col("doc_id").alias("item_id"),
        F.when(F.col("quality") == 1, F.lit("PROCESSED")).otherwise(F.lit("failed")).alias("doc_state"),
        F.when(F.col("toxic") == 1, F.lit("toxic")).alias("doc_error"),
        F.col("quality").cast("long").alias("chunks_count"),
    )
    pipe = t("pages").select(
        F.concat(F.lit("/in/"), F.col("page_id") * 7).alias("path"),
        F.length("html").cast("long").alias("pipe_chunks"),
        F.length("url").cast("long").alias("graph_nodes"),
        F.col("page_id").alias("graph_edges"),
        F.col("page_id").alias("pipe_modified_at"),
    )
    return st.inventory_items(items, status, pipe)


INVENTORY = """pipe AS (SELECT '/in/' || (page_id * 7) AS path, length(html) AS pc, length(url) AS gn, page_id AS ge FROM pages),
    live AS (SELECT doc_id AS item_id, '/in/' || doc_id AS path, quality, toxic, n_chars AS modified_at,
        CASE WHEN quality = 1 THEN 'indexed' WHEN quality = 0 THEN 'failed' ELSE 'uploaded' END AS s
        FROM documents LEFT JOIN labels USING (doc_id)),
    inv AS (SELECT item_id, path, CASE WHEN pc IS NOT NULL THEN 'indexed' ELSE s END AS status,
        CASE WHEN pc IS NOT NULL OR s = 'indexed' THEN NULL WHEN s = 'failed' AND toxic = 1 THEN 'toxic' ELSE 'old' END AS error,
        coalesce(pc, quality) AS chunks_count, gn AS graph_nodes, ge AS graph_edges, pc IS NOT NULL AS ready_to_query, modified_at
        FROM live LEFT JOIN pipe USING (path)
        UNION ALL SELECT NULL, path, 'indexed', NULL, pc, gn, ge, true, ge FROM pipe WHERE path NOT IN (SELECT path FROM live))"""


@case("b16_inventory_items", f"WITH {INVENTORY} SELECT * FROM inv")
def _(spark, sf):
    return _inventory(tables(spark, sf))


@case(
    "b16_inventory_stats",
    f"""WITH {INVENTORY} SELECT count(*) AS total, count(*) FILTER (status = 'indexed') AS indexed,
    count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'failed') AS failed,
    count(*) FILTER (status NOT IN ('indexed', 'processing', 'failed')) AS pending FROM inv""",
)
def _(spark, sf):
    return st.inventory_stats(_inventory(tables(spark, sf)))


@case(
    "b17_match_documents",
    """WITH a AS (SELECT page_id, lower(regexp_extract(url, '([^/]*)$', 1)) AS tok FROM pages),
    b AS (SELECT min(doc_id) AS doc_id, tok FROM (SELECT doc_id, CAST(doc_id AS VARCHAR) AS tok FROM documents
        UNION ALL SELECT doc_id, lower(lang) FROM documents) GROUP BY tok)
    SELECT page_id AS left_id, doc_id AS right_id FROM a JOIN b USING (tok) WHERE tok <> ''""",
)
def _(spark, sf):
    t = tables(spark, sf)
    left = t("pages").select(F.col("page_id").alias("left_id"), "url")
    right = t("documents").select(
        F.col("doc_id").alias("right_id"), F.col("doc_id").alias("right_ord"), F.concat("doc_id", F.lit(".MD")).alias("name"), "lang"
    )
    return st.match_documents(left, right, ["url"], ["name", "lang"])


@case(
    "b18_apply_tombstones",
    "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND source <> 'none'",
)
def _(spark, sf):
    t = tables(spark, sf)
    docs = t("documents").select("doc_id", F.col("doc_id").cast("string").alias("name"), F.col("source").alias("folder"), "lang")
    dead = t("labels").select(F.col("doc_id").cast("string").alias("name"), (F.col("toxic") == 1).alias("deleted"))
    return st.apply_tombstones(docs, dead, "name", "folder").select("doc_id", "lang")


@case(
    "b19_search_inventory",
    "SELECT doc_id, lang FROM documents WHERE lang = 'en' AND contains(lower(source || ' ' || text), 'heren')",
)
def _(spark, sf):
    docs = tables(spark, sf)("documents")
    return st.search_inventory(docs, " HEREN ", "en", ["source", "text"], "lang").select("doc_id", "lang")


@case(
    "b19_type_counts",
    "SELECT CASE WHEN grouping(lang) = 1 THEN '全部' ELSE lang END AS label, count(*) AS n FROM documents GROUP BY ROLLUP (lang)",
)
def _(spark, sf):
    return st.type_counts(tables(spark, sf)("documents"), "lang")


@case(
    "b20_paginate",
    """SELECT o_orderkey, o_totalprice, row_no, (SELECT count(*) FROM orders) AS total_rows,
    CAST(ceil((SELECT count(*) FROM orders) / 25.0) AS INT) AS total_pages FROM
    (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS row_no FROM orders) WHERE row_no > 225 AND row_no <= 250""",
)
def _(spark, sf):
    o = tables(spark, sf)("orders").select("o_orderkey", "o_totalprice")
    return st.paginate(o, ["o_totalprice", "o_orderkey"], 10, 25)
