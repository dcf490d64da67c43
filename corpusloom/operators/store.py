"""Document lifecycle and keyed-table operations (scan, filter, semi/anti join, upsert)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import chunks as ck
from corpusloom.operators.chunks import Chunker
from corpusloom.plans.scan import prefix_scan

# fixed values: document states
STATUSES = ("pending", "processing", "processed", "failed")
# fixed values: suffixes dropped from document identity tokens
KNOWN_SUFFIXES = ("md", "txt", "xlsx", "json")


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


# --- documents ------------------------------------------------------------------------------


def assign_doc_ids(docs: DataFrame, text: str = "text", id_col: str | None = None) -> DataFrame:
    """``(doc_id, content)``: given ids are kept and must be unique, else ``doc-<md5 of clean text>``."""
    if id_col is None:
        content = tx.clean_str(F.col(text))
        return (
            docs.select(content.alias("content"))
            .select(tx.md5_id(F.col("content"), "doc-").alias("doc_id"), "content")
            .dropDuplicates(["doc_id"])
        )
    twice = docs.groupBy(id_col).count().where("count > 1").limit(1).count()
    if twice:
        raise ValueError("document ids must be unique")
    return docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text).alias("content"))


def content_summary(content: Column, max_length: int = 200) -> Column:
    return F.when(F.length(content) <= max_length, content).otherwise(
        F.concat(F.substring(content, 1, max_length), F.lit("..."))
    )


def enqueue_documents(new: DataFrame, status: DataFrame | None, ord_col: str = "ord") -> DataFrame:
    """New PENDING rows from ``new(doc_id, content, ord)``: of equal contents the last id stays;
    documents already PROCESSED are left out.

    Contents are grouped by their digest, so the shuffle moves 32 bytes per row, not the text.
    """
    last = (
        new.groupBy(F.sha2("content", 256).alias("_digest"))
        .agg(F.max_by("doc_id", ord_col).alias("doc_id"))
        .select("doc_id")
    )
    kept = new.join(last, "doc_id", "left_semi")
    if status is not None:
        kept = kept.join(status.where(F.col("status") == "processed"), "doc_id", "left_anti")
    return kept.select(
        "doc_id",
        "content",
        content_summary(F.col("content")).alias("content_summary"),
        F.length("content").alias("content_length"),
        F.lit("pending").alias("status"),
    )


def status_counts(status: DataFrame, domain: Sequence[str] = STATUSES, col: str = "status") -> DataFrame:
    """Rows per status, zero for the statuses of the domain that do not occur."""
    dim = status.sparkSession.createDataFrame([(s,) for s in domain], f"{col} string")
    found = status.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return dim.join(found, col, "left").select(col, F.coalesce("n", F.lit(0)).alias("n"))


def docs_by_status(docs: DataFrame, wanted: str) -> DataFrame:
    return docs.where(F.col("status") == wanted).withColumn(
        "content", F.coalesce("content", "content_summary")
    )


def process_queue(status: DataFrame, max_tokens: int = 1200, overlap: int = 100, chunker: Chunker | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunk every queued document; gives (status rows now PROCESSED with chunks_count, chunks).

    ``chunker`` makes chunks of ``(doc_id, content)`` in place of ``chunk_by_tokens``, with the columns of that.
    """
    queue = status.where(F.col("status").isin("pending", "processing", "failed"))
    chunks = ck.chunked(queue, "doc_id", "content", max_tokens, overlap, chunker)
    counts = chunks.groupBy("full_doc_id").agg(F.countDistinct("chunk_id").alias("chunks_count"))
    done = (
        queue.drop("chunks_count")
        .join(counts.withColumnRenamed("full_doc_id", "doc_id"), "doc_id", "left")
        .withColumn("status", F.lit("processed"))
        .withColumn("chunks_count", F.coalesce("chunks_count", F.lit(0)))
    )
    return done, chunks


# --- keyed tables ---------------------------------------------------------------------------


def upsert_insert_only(base: DataFrame, new: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Existing keys keep their rows."""
    return base.unionByName(new.join(base.select(*_keys(key)), _keys(key), "left_anti"), True)


def upsert_replace(base: DataFrame, new: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Whole rows of ``new`` replace those of ``base``."""
    return base.join(new.select(*_keys(key)), _keys(key), "left_anti").unionByName(new, True)


def upsert_merge(base: DataFrame, new: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Attribute-wise merge; non-null attributes of ``new`` win."""
    keys = _keys(key)
    names = list(dict.fromkeys(base.columns + new.columns))
    b, n = base.alias("b"), new.alias("n")
    cols = []
    for c in names:
        if c in keys:
            cols.append(c)
            continue
        sides = [F.col(f"n.{c}")] if c in new.columns else []
        sides += [F.col(f"b.{c}")] if c in base.columns else []
        cols.append(F.coalesce(*sides).alias(c))
    return b.join(n, keys, "full_outer").select(*cols)


def multi_get(requests: DataFrame, base: DataFrame, key: str, fields: Sequence[str] | None = None) -> DataFrame:
    """``requests(request_id, ids)`` answered in order; a missing key gives nulls."""
    want = base.select(key, *(fields or [c for c in base.columns if c != key]))
    pos = requests.select("request_id", F.posexplode("ids").alias("pos", key))
    return pos.join(want, key, "left")


def missing_keys(keys: DataFrame, base: DataFrame, key: str) -> DataFrame:
    return keys.select(key).distinct().join(base.select(key), key, "left_anti")


def filter_rows(base: DataFrame, predicate: Column) -> DataFrame:
    return base.where(predicate)


def delete_keys(base: DataFrame, keys: DataFrame, key: str | Sequence[str]) -> DataFrame:
    return base.join(keys.select(*_keys(key)), _keys(key), "left_anti")


def drop_rows(base: DataFrame) -> DataFrame:
    return base.limit(0)


def purge_document(tables: Mapping[str, DataFrame], doc_ids: DataFrame) -> dict[str, DataFrame]:
    """Remove documents from ``doc_status``, ``full_docs``, ``text_chunks`` and ``chunk_vectors``.

    ``doc_ids(doc_id)`` may hold any number of documents.  A chunk id that another document
    also owns stays.
    """
    ids = doc_ids.select("doc_id").distinct()
    gone_chunks = tables["text_chunks"].join(
        ids.withColumnRenamed("doc_id", "full_doc_id"), "full_doc_id", "left_semi"
    )
    kept_chunks = tables["text_chunks"].join(
        ids.withColumnRenamed("doc_id", "full_doc_id"), "full_doc_id", "left_anti"
    )
    gone_ids = gone_chunks.select("chunk_id").distinct().join(
        kept_chunks.select("chunk_id"), "chunk_id", "left_anti"
    )
    out = {name: delete_keys(tables[name], ids, "doc_id") for name in ("doc_status", "full_docs")}
    out["text_chunks"] = kept_chunks
    out["chunk_vectors"] = delete_keys(tables["chunk_vectors"], gone_ids, "chunk_id")
    return out


def reindex_documents(
    tables: Mapping[str, DataFrame], purge: DataFrame, fresh: DataFrame, max_tokens: int = 1200, overlap: int = 100, chunker: Chunker | None = None
) -> dict[str, DataFrame]:
    """Purge ``purge(doc_id)`` and index ``fresh(doc_id, content, ord)`` in its place, chunked by ``chunker`` if given."""
    left = purge_document(tables, purge)
    queued = enqueue_documents(fresh, left["doc_status"])
    done, chunks = process_queue(queued, max_tokens, overlap, chunker)
    out = dict(left)
    out["doc_status"] = upsert_replace(left["doc_status"], done, "doc_id")
    out["full_docs"] = upsert_insert_only(left["full_docs"], done.select("doc_id", "content"), "doc_id")
    out["text_chunks"] = upsert_insert_only(left["text_chunks"], chunks, ["full_doc_id", "chunk_id"])
    return out


# --- registry and inventory -----------------------------------------------------------------


def sync_registry(registry: DataFrame, listing: DataFrame, key: str, state: Mapping[str, object]) -> DataFrame:
    """Snapshot fields from the listing, ``state`` fields from the registry (or their default);
    rows that vanished from the listing are dropped."""
    r = registry.select(key, *[F.col(c).alias(f"_r_{c}") for c in state])
    keep = [F.coalesce(F.col(f"_r_{c}"), F.lit(d)).alias(c) for c, d in state.items()]
    fresh = [c for c in listing.columns if c not in state]
    return listing.join(r, key, "left").select(*fresh, *keep)


def inventory_status(doc_status: Column, own: Column) -> Column:
    s = F.lower(F.trim(tx.text_or_empty(doc_status)))
    return (
        F.when(s == "processed", F.lit("indexed"))
        .when(s.isin("processing", "pending", "failed"), s)
        .otherwise(own)
    )


def inventory_items(items: DataFrame, doc_status: DataFrame, pipeline: DataFrame) -> DataFrame:
    """Source items with runtime status and pipeline counts, plus the pipeline rows that match none.

    ``items(item_id, path, status, error, modified_at)``, ``doc_status(item_id, doc_state,
    doc_error, chunks_count)``, ``pipeline(path, pipe_chunks, graph_nodes, graph_edges,
    pipe_modified_at)``, one pipeline row per path.
    """
    live = inventory_status(F.col("doc_state"), F.col("status"))
    matched = F.col("pipe_chunks").isNotNull()
    merged = (
        items.join(doc_status, "item_id", "left")
        .join(pipeline, "path", "left")
        .select(
            "item_id",
            "path",
            F.when(matched, F.lit("indexed")).otherwise(live).alias("status"),
            F.when(matched | live.isin("indexed", "processing"), F.lit(None).cast("string"))
            .when(live == "failed", F.coalesce("doc_error", "error"))
            .otherwise(F.col("error"))
            .alias("error"),
            F.coalesce("pipe_chunks", "chunks_count").alias("chunks_count"),
            "graph_nodes",
            "graph_edges",
            matched.alias("ready_to_query"),
            "modified_at",
        )
    )
    extra = pipeline.join(items.select("path"), "path", "left_anti").select(
        F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"),
        "path",
        F.lit("indexed").alias("status"),
        F.lit(None).cast("string").alias("error"),
        F.col("pipe_chunks").alias("chunks_count"),
        "graph_nodes",
        "graph_edges",
        F.lit(True).alias("ready_to_query"),
        F.col("pipe_modified_at").alias("modified_at"),
    )
    return merged.unionByName(extra)


def inventory_stats(items: DataFrame) -> DataFrame:
    known = F.col("status").isin("indexed", "processing", "failed")
    return items.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("indexed", "processing", "failed")],
        F.count_if(~F.coalesce(known, F.lit(False))).alias("pending"),
    )


def identity_token(c: Column) -> Column:
    """Comparison form of a document name or path."""
    name = F.element_at(F.split(F.replace(F.trim(tx.text_or_empty(c)), F.lit("\\"), F.lit("/")), "/"), -1)
    stem = F.regexp_replace(name, r"(?i)^(.+)\.(" + "|".join(KNOWN_SUFFIXES) + r")$", "$1")
    return F.lower(F.regexp_replace(stem, f"{tx.WS}+", ""))


def match_documents(left: DataFrame, right: DataFrame, left_cols: Sequence[str], right_cols: Sequence[str]) -> DataFrame:
    """First ``right`` row (lowest ``right_ord``) sharing an identity token with each left row.

    ``left(left_id, …)``, ``right(right_id, right_ord, …)``.  Each token of the right side is
    reduced to its first row before the join, so that a token carried by many rows on both
    sides never multiplies.
    """

    def tokens(df: DataFrame, keep: list[str], cols: Sequence[str]) -> DataFrame:
        arr = F.array_distinct(F.array(*[identity_token(F.col(c)) for c in cols]))
        return df.select(*keep, F.explode(arr).alias("token")).where("token <> ''")

    first = tokens(right, ["right_id", "right_ord"], right_cols).groupBy("token").agg(
        F.min(F.struct("right_ord", "right_id")).alias("hit")
    )
    hits = tokens(left, ["left_id"], left_cols).join(first, "token")
    return hits.groupBy("left_id").agg(F.min("hit").alias("hit")).select(
        "left_id", F.col("hit.right_id").alias("right_id")
    )


def apply_tombstones(rows: DataFrame, tombstones: DataFrame, *name_cols: str) -> DataFrame:
    """Hide rows one of whose names is tombstoned; ``tombstones(name, deleted)``, revived rows have
    ``deleted`` false."""
    dead = tombstones.where("deleted").select("name").distinct()
    for c in name_cols:
        rows = rows.join(dead.withColumnRenamed("name", c), c, "left_anti")
    return rows


def search_inventory(items: DataFrame, query: str | None, item_type: str | None, text_cols: Sequence[str], type_col: str) -> DataFrame:
    out = items
    if item_type:
        out = out.where(F.col(type_col) == item_type)
    needle = (query or "").strip().lower()
    if needle:
        hay = F.lower(F.concat_ws(" ", *[tx.text_or_empty(F.col(c)) for c in text_cols]))
        out = out.where(F.instr(hay, needle) > 0)
    return out


def type_counts(items: DataFrame, type_col: str, all_label: str = "全部") -> DataFrame:
    return (
        items.rollup(type_col)
        .agg(F.count(F.lit(1)).alias("n"), F.grouping(type_col).alias("_g"))
        .select(F.when(F.col("_g") == 1, F.lit(all_label)).otherwise(F.col(type_col)).alias("label"), "n")
    )


def paginate(df: DataFrame, order: Sequence[str], page: int, size: int) -> DataFrame:
    """One page with its totals; ``order`` must make the rows distinct.

    Row numbers come from a range scan, so that a deep page needs no single-task sort.
    """
    total = df.count()
    pages = max(1, -(-total // size))
    page = min(max(1, page), pages)
    numbered = _number(df, order)
    first = (page - 1) * size
    return numbered.where((F.col("row_no") > first) & (F.col("row_no") <= first + size)).select(
        *df.columns, "row_no", F.lit(total).cast("long").alias("total_rows"), F.lit(pages).cast("int").alias("total_pages")
    )


def _number(df: DataFrame, order: Sequence[str]) -> DataFrame:
    one = df.withColumn("_all", F.lit(0))
    return prefix_scan(one, "_all", list(order), row_number="row_no").drop("_all")
