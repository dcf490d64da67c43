"""Chunking and corpus quality."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx

# fixed values: quality issues in reporting order and the folder each routes to
ISSUES = ("long_chunk", "empty_content", "html_table", "html_image", "markdown_image")
ISSUE_FOLDER = {
    "good_chunk": "good_chunks",
    "long_chunk": "long_chunk",
    "html_table": "tables",
    "html_image": "images",
    "markdown_image": "images",
}
FOLDERS = ("good_chunks", "long_chunk", "tables", "images")
# fixed values: chapter of text before the first heading, file name of an unnamed chapter
FRONT_CHAPTER = "引言及前言"
UNNAMED_CHAPTER = "未命名章节"


# --- token windows --------------------------------------------------------------------------


def chunk_by_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    max_tokens: int = 1200,
    overlap: int = 100,
    tokens: Callable[[Column], Column] = tx.spaced_tokens,
) -> DataFrame:
    """Windows of ``max_tokens`` tokens starting every ``max_tokens - overlap`` tokens.

    No shuffle: each document is cut inside its own row.  ``tokens`` must give tokens whose
    concatenation is the text.
    """
    step = max_tokens - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than max_tokens")
    base = docs.select(F.col(id_col).alias("full_doc_id"), tokens(F.col(text)).alias("_t"))
    starts = F.sequence(F.lit(0), F.size("_t") - 1, F.lit(step))
    windows = F.transform(
        starts,
        lambda s, i: F.struct(
            i.cast("int").alias("chunk_order_index"),
            F.least(F.lit(max_tokens), F.size("_t") - s).cast("int").alias("tokens"),
            tx.strip(F.array_join(F.slice("_t", s + 1, F.lit(max_tokens)), "")).alias("content"),
        ),
    )
    return (
        base.where(F.size("_t") > 0)
        .select("full_doc_id", F.explode(windows).alias("w"))
        .select("full_doc_id", "w.*")
        .select(
            tx.md5_id(F.col("content"), "chunk-").alias("chunk_id"),
            "full_doc_id",
            "chunk_order_index",
            "tokens",
            "content",
        )
    )


#: Makes chunks of ``(doc_id, content)`` with the columns of ``chunk_by_tokens``.
Chunker = Callable[[DataFrame], DataFrame]


def chunked(docs: DataFrame, id_col: str, text: str, max_tokens: int, overlap: int, chunker: Chunker | None) -> DataFrame:
    """Chunks by the given chunker, by token windows without one."""
    if chunker is None:
        return chunk_by_tokens(docs, id_col, text, max_tokens, overlap)
    return chunker(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("content"))).select("chunk_id", "full_doc_id", "chunk_order_index", "tokens", "content")


def chunk_by_separator(separator: str = "\n", tokens: Callable[[Column], Column] = tx.count_tokens) -> Chunker:
    """A chunker that cuts at a literal separator; blank parts are no chunks and are not numbered."""

    def cut_up(docs: DataFrame) -> DataFrame:
        parts = tx.split_markers(tx.text_or_empty(F.col("content")), [separator])
        rows = docs.select(F.col("doc_id").alias("full_doc_id"), F.posexplode(parts).alias("chunk_order_index", "content"))
        return rows.select(tx.md5_id(F.col("content"), "chunk-").alias("chunk_id"), "full_doc_id", "chunk_order_index", tokens(F.col("content")).cast("int").alias("tokens"), "content")

    return cut_up


def collapse_chunks(chunks: DataFrame, first_doc: str = "full_doc_id") -> DataFrame:
    """One row per chunk id: the last index within a document, then the first document to write it."""
    within = chunks.groupBy("chunk_id", "full_doc_id").agg(
        F.max_by(F.struct("chunk_order_index", "tokens", "content"), "chunk_order_index").alias("r")
    )
    return (
        within.groupBy("chunk_id")
        .agg(F.min_by(F.struct("full_doc_id", "r"), first_doc).alias("x"))
        .select("chunk_id", "x.full_doc_id", "x.r.chunk_order_index", "x.r.tokens", "x.r.content")
    )


# --- Markdown -------------------------------------------------------------------------------


#: Headings folded at a time: appending to a short list is cheap, and so is appending whole lists.
FOLD = 256


def heading_paths(heads: Column) -> Column:
    """Per heading of ``array<struct<lv, title>>`` its title after those of its ancestors.

    One fold carries the open title of each of the six levels: a heading closes its own level and deeper ones. It runs in
    blocks, so that the list it builds is not copied for every heading.
    """
    texts = "array<string>"
    nothing = F.array().cast(f"array<{texts}>")

    def step(acc: Column, h: Column) -> Column:
        levels = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda l: F.when(l < h["lv"], F.get(acc["open"], l - 1)).when(l == h["lv"], h["title"]))
        return tx.let(levels, lambda now: F.struct(now.alias("open"), F.concat(acc["out"], F.array(F.filter(now, lambda t: t.isNotNull()))).alias("out")))

    def block(acc: Column, b: Column) -> Column:
        inner = F.aggregate(F.slice(heads, b * FOLD + 1, F.lit(FOLD)), F.struct(acc["open"].alias("open"), nothing.alias("out")), step)
        return tx.let(inner, lambda x: F.struct(x["open"].alias("open"), F.concat(acc["out"], x["out"]).alias("out")))

    start = F.struct(F.array_repeat(F.lit(None).cast("string"), 6).alias("open"), nothing.alias("out"))
    blocks = F.sequence(F.lit(0), F.floor(F.size(heads) / FOLD).cast("int"))
    return F.aggregate(blocks, start, block, lambda acc: acc["out"])


def chunk_markdown(docs: DataFrame, id_col: str = "doc_id", name: str = "doc_name", text: str = "text", min_length: int = 30) -> DataFrame:
    """Heading-scoped chunks with breadcrumb, chapter, type and level.

    Every document is one row and its sections are cut inside that row, so nothing shuffles and
    only the finished sections are exploded.
    """
    breaks = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
    lines = F.filter(F.transform(F.split(F.col(text), breaks), tx.strip), lambda x: x != "")
    head = r"^(#{1,6})\s+(.+)$"
    is_image = lambda x: x.startswith("![") & x.contains("](")
    base = docs.select(id_col, F.col(name).alias("doc_name"), lines.alias("_m"))
    heads = F.filter(
        F.transform(
            F.col("_m"),
            lambda x, i: F.struct(
                i.alias("p"),
                F.when(~is_image(x), F.length(F.regexp_extract(x, head, 1))).otherwise(F.lit(0)).alias("lv"),
                tx.strip(F.regexp_extract(x, head, 2)).alias("title"),
            ),
        ),
        lambda h: h["lv"] > 0,
    )
    base = base.withColumn("_h", heads)

    def section(s: Column, paths: Column) -> Column:
        """Body between two headings and the titles of its heading and that heading's ancestors."""
        begin = F.when(s == 0, F.lit(0)).otherwise(F.get(F.col("_h"), s - 1)["p"] + 1)
        end = F.when(s == F.size("_h"), F.size("_m")).otherwise(F.get(F.col("_h"), s)["p"])
        body = F.array_join(F.slice("_m", begin + 1, F.greatest(end - begin, F.lit(0))), "\n")
        path = F.when(s == 0, F.array().cast("array<string>")).otherwise(F.get(paths, s - 1))
        level = F.when(s == 0, F.lit(0)).otherwise(F.get(F.col("_h"), s - 1)["lv"])
        return F.struct(s.alias("section"), body.alias("content"), path.alias("path"), level.alias("level"))

    sections = tx.let(heading_paths(F.col("_h")), lambda paths: F.transform(F.sequence(F.lit(0), F.size("_h")), lambda s: section(s, paths)))
    out = (
        base.select(id_col, "doc_name", F.explode(sections).alias("s"))
        .select(id_col, "doc_name", "s.*")
        .where(F.length("content") >= min_length)
    )
    crumb = F.concat_ws(" > ", F.concat(F.array("doc_name"), F.col("path")))
    return out.select(
        id_col,
        "doc_name",
        "section",
        F.coalesce(F.get("path", F.lit(0)), F.lit(FRONT_CHAPTER)).alias("chapter"),
        crumb.alias("breadcrumb"),
        structured_chunk_id(crumb, F.col("content")).alias("chunk_id"),
        "content",
        F.when(F.col("content").rlike(r"\|\s*:?-{3,}:?\s*\|"), F.lit("table")).otherwise(F.lit("text")).alias("chunk_type"),
        "level",
    )


def chapter_file_name(chapter: Column) -> Column:
    safe = tx.strip(F.substring(F.regexp_replace(chapter, r'[\\/*?:"<>|]', ""), 1, 50))
    return F.concat(F.when(safe == "", F.lit(UNNAMED_CHAPTER)).otherwise(safe), F.lit(".json"))


def structured_chunk_id(breadcrumb: Column, content: Column) -> Column:
    return F.md5(F.concat(breadcrumb, F.lit("_"), content))


# --- quality --------------------------------------------------------------------------------


def scan_chunks(chunks: DataFrame, content: str = "content", long_threshold: int = 1500, preview: int = 20, tokens: Callable[[Column], Column] = tx.count_tokens) -> DataFrame:
    """Add ``token_count``, ``issue_types`` (fixed order) and ``content_preview``."""
    c = tx.text_or_empty(F.col(content))
    tests = (
        F.col("token_count") >= long_threshold,
        tx.strip(c) == "",
        c.rlike(r"(?i)<(table|tr|td|th)\b"),
        c.rlike(r"(?i)<(img|figure|svg)\b"),
        c.rlike(r"!\[[^\]]*\]\([^)]+\)"),
    )
    found = F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in zip(ISSUES, tests)]))
    return (
        chunks.withColumn("token_count", tokens(c))
        .withColumn("issue_types", found)
        .withColumn("content_preview", tx.preview(c, preview))
    )


def route_chunks(scanned: DataFrame) -> DataFrame:
    """One row per chunk and issue with its folder; issues without a folder go nowhere."""
    folder_of = F.create_map(*[F.lit(x) for kv in ISSUE_FOLDER.items() for x in kv])
    issues = F.when(F.size("issue_types") == 0, F.array(F.lit("good_chunk"))).otherwise(F.col("issue_types"))
    return (
        scanned.withColumn("issue_type", F.explode(issues))
        .withColumn("issue_folder", F.try_element_at(folder_of, F.col("issue_type")))
        .where(F.col("issue_folder").isNotNull())
        .withColumn("source", F.lit("raw_chunks_scan"))
    )


def route_counts(routed: DataFrame) -> DataFrame:
    dim = routed.sparkSession.createDataFrame([(f,) for f in FOLDERS], "issue_folder string")
    return dim.join(routed.groupBy("issue_folder").agg(F.count(F.lit(1)).alias("n")), "issue_folder", "left").select(
        "issue_folder", F.coalesce("n", F.lit(0)).alias("n")
    )


def scan_summary(scanned: DataFrame, file_col: str | Sequence[str] = "chapter_file") -> DataFrame:
    """Per file and in total: counts, mean, exact median, extremes and issue totals, in one pass.

    Rows are first counted per (file, token count, issues), so the exact median holds one entry
    per distinct token count whatever the size of a file.
    """
    files = [file_col] if isinstance(file_col, str) else list(file_col)
    has = [F.array_contains("issue_types", n).cast("int").alias(n) for n in ISSUES]
    pre = scanned.select(*files, "token_count", *has).groupBy(*files, "token_count", *ISSUES).agg(
        F.count(F.lit(1)).alias("n")
    )
    return (
        pre.groupingSets([[F.col(f) for f in files], []], *[F.col(f) for f in files])
        .agg(
            F.grouping(files[0]).alias("is_total"),
            F.sum("n").alias("chunk_count"),
            F.round(F.sum(F.col("token_count") * F.col("n")) / F.sum("n"), 2).alias("avg_tokens"),
            F.expr("percentile(token_count, 0.5, n)").alias("median_tokens"),
            F.max("token_count").alias("max_tokens"),
            F.min("token_count").alias("min_tokens"),
            *[F.sum(F.col(n) * F.col("n")).alias(f"{n}_count") for n in ISSUES],
        )
    )


def corpus_counts(chunks: DataFrame, folder: str, file: str, content: str = "content", tokens: Callable[[Column], Column] = tx.count_tokens) -> DataFrame:
    """Files, chunks, tokens and characters per folder and in total, with averages."""
    per_file = chunks.groupBy(folder, file).agg(
        F.count(F.lit(1)).alias("chunks"),
        F.sum(tokens(F.col(content))).alias("tokens"),
        F.sum(F.length(content)).alias("chars"),
    )
    return (
        per_file.rollup(folder)
        .agg(
            F.grouping(folder).alias("is_total"),
            F.count(F.lit(1)).alias("files"),
            F.sum("chunks").alias("chunks"),
            F.sum("tokens").alias("tokens"),
            F.sum("chars").alias("chars"),
        )
        .withColumn("avg_chars", F.round(F.col("chars") / F.col("chunks"), 2))
        .withColumn("avg_tokens", F.round(F.col("tokens") / F.col("chunks"), 2))
        .withColumn("tokens_per_char", F.round(F.col("tokens") / F.nullif(F.col("chars"), F.lit(0)), 4))
    )


def estimate_tokens(c: Column) -> Column:
    """1.5 per CJK character and 0.25 per other character, truncated."""
    cjk = F.length(F.regexp_replace(c, r"[^一-鿿]", ""))
    return F.floor((cjk * 6 + (F.length(c) - cjk)) / 4).cast("int")


# --- validation -----------------------------------------------------------------------------


def _json_type(value: Column) -> Column:
    return F.upper(F.schema_of_variant(value))


def validate_chapters(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """``errors`` of chapter JSON texts: missing fields, chunks not a list."""
    v = F.try_parse_json(F.col(payload))
    has = {f: F.get_json_object(F.col(payload), f"$.{f}").isNotNull() | F.col(payload).rlike(rf'"{f}"\s*:\s*null') for f in ("doc_name", "chapter", "chunks")}
    kind = F.schema_of_variant(F.try_variant_get(v, "$.chunks", "variant"))
    errors = [F.when(~ok, F.lit(f"Missing required field: {f}")) for f, ok in has.items()]
    errors.append(
        F.when(has["chunks"] & ~kind.startswith("ARRAY") & (kind != "VOID"), F.lit("chunks must be a list"))
    )
    errs = F.array_compact(F.array(F.when(v.isNull(), F.lit("invalid JSON")), *[F.when(v.isNotNull(), e) for e in errors]))
    return raw.withColumn("errors", errs).withColumn("is_valid", F.size("errors") == 0)


def validate_chunk_json(raw: DataFrame, payload: str = "payload", required: Sequence[str] = ("chunk_id", "breadcrumb", "content")) -> DataFrame:
    """``errors`` of chunk JSON texts: required fields, blank content, types of the optional fields."""
    p = F.col(payload)
    v = F.try_parse_json(p)

    def kind(field: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant"))

    errors = []
    for f in required:
        value, k = F.get_json_object(p, f"$.{f}"), kind(f)
        absent = k.isNull()
        empty = (k == "VOID") | (value == "") | (value.isin("0", "false", "[]", "{}") & (k != "STRING"))
        errors.append(F.when(absent, F.lit(f"Missing required field: {f}")).when(empty, F.lit(f"Empty value for required field: {f}")))
    content = F.get_json_object(p, "$.content")
    errors.append(F.when((content != "") & (tx.strip(content) == ""), F.lit("content contains only whitespace")))
    mk, tk = kind("metadata"), kind("chunk_type")
    errors.append(F.when(mk.isNotNull() & (mk != "VOID") & ~mk.startswith("OBJECT"), F.lit("metadata must be a dict")))
    errors.append(F.when(tk.isNotNull() & ~tk.isin("VOID", "STRING"), F.lit("chunk_type must be a string")))
    errs = F.array_compact(F.array(F.when(v.isNull(), F.lit("invalid JSON")), *[F.when(v.isNotNull(), e) for e in errors]))
    return raw.withColumn("errors", errs).withColumn("is_valid", F.size("errors") == 0)


def validation_counts(validated: DataFrame) -> DataFrame:
    return validated.agg(
        F.count_if("is_valid").alias("valid_count"), F.count_if(~F.col("is_valid")).alias("invalid_count")
    )


# --- editing: chunks(file, idx, chunk_id, breadcrumb, content, chunk_type) ---------------------
# Commands of one batch address distinct chunks; a file is numbered by a window over its own
# chunks, which came from one source row.


def _renumber(df: DataFrame, *order: str) -> DataFrame:
    w = Window.partitionBy("file").orderBy(*order)
    return df.withColumn("idx", (F.row_number().over(w) - 1).cast("int"))


def edit_chunks(chunks: DataFrame, commands: DataFrame) -> DataFrame:
    """``commands(file, chunk_id, new_content, new_breadcrumb)``; blank content is rejected (the
    chunk stays and ``edit_error`` says so); the id changes only with content or breadcrumb."""
    cmd = commands.withColumn("_hit", F.lit(True))
    j = chunks.join(cmd, ["file", "chunk_id"], "left")
    blank = F.col("_hit") & tx.is_blank(F.col("new_content"))
    apply_ = F.coalesce(F.col("_hit"), F.lit(False)) & ~F.coalesce(blank, F.lit(False))
    content = F.when(apply_, tx.strip(F.col("new_content"))).otherwise(F.col("content"))
    crumb = F.when(apply_, F.coalesce("new_breadcrumb", "breadcrumb")).otherwise(F.col("breadcrumb"))
    changed = (content != F.col("content")) | (crumb != F.col("breadcrumb"))
    return j.select(
        "file",
        "idx",
        F.when(apply_ & changed, structured_chunk_id(crumb, content)).otherwise(F.col("chunk_id")).alias("chunk_id"),
        crumb.alias("breadcrumb"),
        content.alias("content"),
        "chunk_type",
        F.when(blank, F.lit("content cannot be empty or whitespace-only")).alias("edit_error"),
    )


def split_chunks(chunks: DataFrame, commands: DataFrame) -> DataFrame:
    """``commands(file, chunk_id, left_content, right_content)``; both halves must be non-blank."""
    ok = commands.where(~tx.is_blank(F.col("left_content")) & ~tx.is_blank(F.col("right_content")))
    j = chunks.join(ok.withColumn("_hit", F.lit(True)), ["file", "chunk_id"], "left")
    halves = F.when(
        F.col("_hit"),
        F.array(*[
            F.struct(
                structured_chunk_id(F.col("breadcrumb"), tx.strip(F.col(c))).alias("id"), tx.strip(F.col(c)).alias("content")
            )
            for c in ("left_content", "right_content")
        ]),
    ).otherwise(F.array(F.struct(F.col("chunk_id").alias("id"), F.col("content").alias("content"))))
    out = j.select("file", "idx", "breadcrumb", "chunk_type", F.posexplode(halves).alias("half", "h"))
    return _renumber(out, "idx", "half").select(
        "file", "idx", F.col("h.id").alias("chunk_id"), "breadcrumb", F.col("h.content").alias("content"), "chunk_type"
    )


def merge_chunks(chunks: DataFrame, commands: DataFrame) -> DataFrame:
    """``commands(file, first_id, second_id)``: only neighbours merge; other commands change nothing."""
    w = Window.partitionBy("file").orderBy("idx")
    look = (
        chunks.withColumn("_next_id", F.lead("chunk_id").over(w))
        .withColumn("_next", F.lead("content").over(w))
        .withColumn("_prev_id", F.lag("chunk_id").over(w))
    )
    firsts = commands.select("file", F.col("first_id").alias("chunk_id"), F.col("second_id").alias("_next_id"), F.lit(True).alias("_keep"))
    seconds = commands.select("file", F.col("second_id").alias("chunk_id"), F.col("first_id").alias("_prev_id"), F.lit(True).alias("_gone"))
    j = look.join(firsts, ["file", "chunk_id", "_next_id"], "left").join(seconds, ["file", "chunk_id", "_prev_id"], "left")
    both = F.concat(tx.strip(F.col("content")), F.lit("\n\n"), tx.strip(F.col("_next")))
    out = j.where(F.col("_gone").isNull()).select(
        "file",
        "idx",
        F.when(F.col("_keep"), structured_chunk_id(F.col("breadcrumb"), both)).otherwise(F.col("chunk_id")).alias("chunk_id"),
        "breadcrumb",
        F.when(F.col("_keep"), both).otherwise(F.col("content")).alias("content"),
        "chunk_type",
    )
    return _renumber(out, "idx")


def delete_chunks(chunks: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``commands(file, chunk_id)``, one per file.  Gives the rest, renumbered, and per command the
    remaining count and the next active chunk (at the removed position or the last one)."""
    left = _renumber(chunks.join(commands, ["file", "chunk_id"], "left_anti"), "idx")
    removed = chunks.join(commands, ["file", "chunk_id"], "left_semi").select("file", F.col("chunk_id").alias("deleted_id"), F.col("idx").alias("_at"))
    sizes = left.groupBy("file").agg(F.count(F.lit(1)).alias("remaining_count"))
    report = (
        removed.join(sizes, "file", "left")
        .withColumn("remaining_count", F.coalesce("remaining_count", F.lit(0)))
        .withColumn("idx", F.least("_at", F.col("remaining_count") - 1).cast("int"))
        .join(left.select("file", "idx", F.col("chunk_id").alias("next_chunk_id")), ["file", "idx"], "left")
        .select("file", "deleted_id", "remaining_count", "next_chunk_id")
    )
    return left, report


# --- chunk registry --------------------------------------------------------------------------


def registry_sync(registry: DataFrame, chapters: DataFrame) -> DataFrame:
    """Chapter snapshots joined with the kept state fields; vanished chapters are dropped."""
    state = {"dirty": False, "last_reprocess_status": "idle", "downstream_state": "stale"}
    r = registry.select("relative_path", *[F.col(c).alias(f"_r_{c}") for c in state])
    return chapters.join(r, "relative_path", "left").select(
        *chapters.columns, *[F.coalesce(F.col(f"_r_{c}"), F.lit(d)).alias(c) for c, d in state.items()]
    )


def registry_mark(registry: DataFrame, events: DataFrame) -> DataFrame:
    """State after a log ``events(relative_path, seq, action)``.

    Every field is the value set by its latest event: a pure ``max_by``, so one busy path costs
    one partial aggregate per task.
    """
    a = F.col("action")
    sets = {
        "dirty": F.when(a == "edit", F.lit(True)).when(a.isin("clean", "doc_completed"), F.lit(False)),
        "last_reprocess_status": F.when(a.isin("started", "doc_started"), F.lit("running"))
        .when(a.isin("completed", "doc_completed"), F.lit("success"))
        .when(a.isin("failed", "doc_failed"), F.lit("failed")),
        "downstream_state": F.when(a == "edit", F.lit("stale")).when(
            a.isin("completed", "doc_completed"), F.lit("routing_refreshed")
        ),
    }
    last = events.groupBy("relative_path").agg(
        *[F.max_by(v, F.when(v.isNotNull(), F.col("seq"))).alias(f"_n_{c}") for c, v in sets.items()]
    )
    return registry.join(last, "relative_path", "left").select(
        *[c for c in registry.columns if c not in sets],
        *[F.coalesce(F.col(f"_n_{c}"), F.col(c)).alias(c) for c in sets],
    )


def registry_summary(registry: DataFrame) -> DataFrame:
    fresh = F.coalesce(F.col("downstream_state") != "stale", F.lit(False))
    return registry.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("dirty").alias("dirty"),
        F.count_if(~F.coalesce(F.col("dirty"), F.lit(False))).alias("clean"),
        F.count_if(F.col("last_reprocess_status") == "running").alias("reprocessing"),
        F.count_if(~fresh).alias("downstream_stale"),
        F.count_if(fresh).alias("downstream_refreshed"),
    )
