"""Fusion, reranking, token budgets and context blocks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.plans.scan import joined_parts, ordered_parts, prefix_scan, top_k

# fixed values: prefixes selecting a search mode, default mode
MODE_PREFIXES = ("graph_text_hybrid", "graph_only", "text_only")
DEFAULT_MODE = "graph_text_hybrid"
# fixed values: patterns and limits of the evidence fallback
DOC_FILE = r"[\w./\-\x{4e00}-\x{9fa5}]+\.(?i:pdf|docx|md|txt|pptx)"
SOURCE_LABEL = r"(?i)(?:source(?:[_\s-]?id)?|document|doc|file|chunk|citation|reference|来源|出处|文档|文件|片段)\s*[:：#-]?\s*([A-Za-z0-9][\w./\-]{2,})"
PAGE_LABEL = r"(?i)(?:page|页码|第)\s*[:：]?\s*(\d+)"
SCORE_LABEL = r"(?i)(?:score|relevance|similarity|相关度)\s*[:：]?\s*([0-9.]+%?)"
NO_STRINGS = "array<string>"


def _empty() -> Column:
    return F.array().cast(NO_STRINGS)


# --- fusion and rerank -----------------------------------------------------------------------------


def hybrid_fuse(seeds: DataFrame, vector: DataFrame, lexical: DataFrame, chunks: DataFrame, k: int = 15) -> DataFrame:
    """Fuse three ranked lists (``rank`` from 1) into ``(query_id, rank, chunk_id, score, sources,
    vector_distance, lexical_score)``.

    Scores fall by one per place from 100 (graph seeds), 99.5 (vector) and 98.5 (lexical); a chunk
    keeps its best; ties stay in list order; ids without a chunk are dropped.
    """
    parts = []
    for no, (name, df, base) in enumerate((("graph_seed", seeds, 100.0), ("vector", vector, 99.5), ("lexical", lexical, 98.5))):
        parts.append(
            df.select(
                "query_id", "chunk_id", F.lit(name).alias("source"), (F.lit(base + 1) - F.col("rank")).alias("score"),
                F.struct(F.lit(no).alias("no"), F.col("rank").cast("long").alias("r")).alias("o"),
                (F.col("distance") if name == "vector" else F.lit(None)).cast("double").alias("vector_distance"),
                (F.col("lexical_score") if name == "lexical" else F.lit(None)).cast("double").alias("lexical_score"),
            )
        )
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2]).join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    fused = merged.groupBy("query_id", "chunk_id").agg(
        F.max("score").alias("score"), F.min("o").alias("o"), F.array_sort(F.collect_set("source")).alias("sources"),
        F.max("vector_distance").alias("vector_distance"), F.max("lexical_score").alias("lexical_score"),
    )
    return top_k(fused, "query_id", [F.desc("score"), F.col("o")], k).drop("o")


def rerank(candidates: DataFrame, scorer: Column | None, max_candidates: int = 6, enabled: bool = True) -> DataFrame:
    """Reorder the front of each candidate list by ``scorer`` (a column over the row, null = unscored).

    ``candidates(query_id, rank, …)`` with a bounded list per query.  Scored rows come first by score,
    then the unscored ones of the front, then the untouched tail.  A list of one, or one without any
    score, stays as it is.
    """
    if not enabled or scorer is None:
        return candidates.withColumn("rerank_score", F.lit(None).cast("double"))
    most = max(1, max_candidates)
    whole = Window.partitionBy("query_id")
    s = F.when((F.col("rank") <= most) & (F.col("_n") > 1), scorer.cast("double"))
    scored = candidates.withColumn("_n", F.count(F.lit(1)).over(whole)).withColumn("rerank_score", s).drop("_n")
    seg = F.when(F.col("rerank_score").isNotNull(), 0).when(F.col("rank") <= most, 1).otherwise(2)
    w = whole.orderBy(seg, F.desc("rerank_score"), F.col("rank"))
    return scored.withColumn("_r", F.row_number().over(w)).drop("rank").withColumnRenamed("_r", "rank")


def truncate_by_tokens(rows: DataFrame, keys: str | Sequence[str], order: str | Sequence[str], text: str, budget: int, tokens: Callable[[Column], Column] = tx.count_tokens) -> DataFrame:
    """Longest prefix of every group whose tokens add up to at most ``budget``."""
    if budget <= 0:
        return rows.limit(0)
    sized = rows.withColumn("_t", tokens(F.col(text)).cast("long"))
    return prefix_scan(sized, keys, order, sums={"_sum": "_t"}).where(F.col("_sum") <= budget).drop("_t", "_sum")


# --- context text ------------------------------------------------------------------------------------


def csv_row(*cells: Column) -> Column:
    return F.concat(F.concat_ws(",", *[tx.csv_cell(c) for c in cells]), F.lit("\r\n"))


def build_context(queries: DataFrame, entities: DataFrame, sources: DataFrame, node_budget: int = 500, text_budget: int = 8000) -> DataFrame:
    """``(query_id, context)``: a Sources and an Entities CSV block within their token budgets.

    ``entities(query_id, rank, entity_name, entity_type, score, description)`` is read by score,
    ``sources(query_id, rank, chunk_id, content)`` in rank order.  What stays per query is bounded by
    the budgets, so the collected lines are too.
    """
    by_score = ["_neg", "rank"]
    e = truncate_by_tokens(entities.withColumn("_neg", -F.col("score")), "query_id", by_score, "description", node_budget)
    line = csv_row(F.col("entity_name"), F.col("entity_type"), F.round("score", 4).cast("string"), F.col("description"))
    e = joined_parts(ordered_parts(e.withColumn("line", line), "query_id", by_score, "line", "e"), "query_id", "e")
    s = truncate_by_tokens(sources, "query_id", "rank", "content", text_budget).withColumn("line", csv_row(F.col("chunk_id"), F.col("content")))
    s = joined_parts(ordered_parts(s, "query_id", "rank", "line", "s"), "query_id", "s")
    block = F.concat(
        F.lit("\n-----Sources-----\n```csv\nid,content\r\n"), F.array_join(F.coalesce("s", _empty()), ""),
        F.lit("\n```\n-----Entities-----\n```csv\nentity,entity_type,score,description\r\n"), F.array_join(F.coalesce("e", _empty()), ""), F.lit("\n```\n"),
    )
    return queries.select("query_id").join(s, "query_id", "left").join(e, "query_id", "left").select("query_id", block.alias("context"))


def fit_prompt(context: Column, prefix_tokens: int | Column, window: int) -> Column:
    """Context cut to what the model window leaves after the reply reserve and the prompt prefix."""
    reserve = max(256, min(1024, int(window * 0.2)))
    budget = max(512, window - reserve)
    room = F.greatest(F.lit(256), F.lit(budget) - prefix_tokens)
    return F.when(tx.count_tokens(context) > room, tx.take_tokens(context, room)).otherwise(context)


# --- reading context blocks back ------------------------------------------------------------------------

QUOTE_MARK = "\x02"


def _section(context: Column, title: str) -> Column:
    return F.regexp_extract(tx.text_or_empty(context), rf"(?s)-----{title}-----\s*```csv\s*(.*?)\s*```", 1)


def csv_records(block: Column) -> Column:
    """Rows of a CSV text as ``array<array<string>>``; quoted cells may hold commas and newlines."""
    marked = F.replace(tx.strip(block), F.lit('""'), F.lit(QUOTE_MARK))
    rows = F.regexp_extract_all(marked, F.lit(r'(?:"[^"]*"|[^"\r\n]+)+'), F.lit(0))

    def cells(row: Column) -> Column:
        found = F.regexp_extract_all(F.concat(row, F.lit(",")), F.lit(r'("[^"]*"|[^,"]*),'), F.lit(1))
        plain = F.transform(found, lambda c: F.regexp_replace(c, r'(?s)^"(.*)"$', "$1"))
        return F.transform(plain, lambda c: F.when(c == QUOTE_MARK, F.lit("")).otherwise(F.replace(c, F.lit(QUOTE_MARK), F.lit('"'))))

    return F.transform(rows, cells)


def parse_context(context: Column) -> Column:
    """Distinct source and record ids of a context, in order."""

    def ids(rows: Column) -> Column:
        per = F.transform(
            F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))),
            lambda r: F.concat(
                F.array(tx.strip(F.coalesce(F.get(r, F.lit(0)), F.lit("")))),
                F.regexp_extract_all(F.coalesce(F.get(r, F.lit(1)), F.lit("")), F.lit(r"\[记录ID\]\s*([^\s\[]+)"), F.lit(1)),
            ),
        )
        return F.array_distinct(F.filter(F.flatten(per), lambda x: x != ""))

    return tx.let(csv_records(_section(context, "Sources")), ids)


def _dict_rows(rows: Column) -> Column:
    return F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))


def _cell(row: Column, i: int) -> Column:
    return tx.strip(F.coalesce(F.get(row, F.lit(i)), F.lit("")))


def evidence_payload(raw: Column) -> Column:
    """``struct(status, sources, items, entity_count)`` of a context text.

    Structured contexts list their rows; other texts are mined for file names, pages and scores.
    """
    text = tx.strip(F.replace(tx.text_or_empty(raw), F.lit("\r"), F.lit("")))

    def item(title, source_id, snippet, raw_, page, score):
        return F.struct(
            title.alias("title"), source_id.alias("source_id"), snippet.alias("snippet"), raw_.alias("raw"), page.alias("page"), score.alias("score")
        )

    none = F.lit(None).cast("string")

    def structured(t: Column) -> Column:
        src = _dict_rows(csv_records(_section(t, "Sources")))
        ent = _dict_rows(csv_records(_section(t, "Entities")))

        def of_row(r: Column, i: Column) -> Column:
            sid, content = _cell(r, 0), _cell(r, 1)
            sid = F.when(sid == "", F.concat(F.lit("source-"), (i + 1).cast("string"))).otherwise(sid)
            title = F.when(content == "", sid).otherwise(F.substring(content, 1, 72))
            return item(title, sid, F.substring(content, 1, 160), content, none, none)

        items = F.filter(F.transform(src, of_row), lambda x: x["raw"] != "")
        names = F.array_distinct(F.filter(F.transform(src, lambda r: _cell(r, 0)), lambda x: x != ""))
        status = F.when(F.size(items) > 0, F.lit("ready")).when((F.size(names) > 0) | (F.size(ent) > 0), F.lit("partial")).otherwise(F.lit("unavailable"))
        return F.struct(status.alias("status"), names.alias("sources"), items.alias("items"), F.size(ent).alias("entity_count"))

    def mined(t: Column) -> Column:
        blocks = F.filter(F.transform(F.split(t, r"\n\s*\n+"), tx.squeeze), lambda b: b != "")
        signal = F.filter(
            blocks,
            lambda b: b.rlike(DOC_FILE) | F.regexp_extract(b, SOURCE_LABEL, 1).rlike(r"[._\-/\d]"),
        )

        def of_block(b: Column) -> Column:
            name, label = F.regexp_extract(b, DOC_FILE, 0), F.regexp_extract(b, SOURCE_LABEL, 1)
            return item(
                F.when(name != "", name).otherwise(label), none, F.substring(b, 1, 160), b,
                F.nullif(F.regexp_extract(b, PAGE_LABEL, 1), F.lit("")), F.nullif(F.regexp_extract(b, SCORE_LABEL, 1), F.lit("")),
            )

        items = F.filter(F.transform(F.slice(signal, 1, 5), of_block), lambda x: x["title"] != "")
        docs = F.slice(F.array_distinct(F.regexp_extract_all(t, F.lit(DOC_FILE), F.lit(0))), 1, 6)
        status = (
            F.when(t == "", F.lit("idle")).when((F.size(items) > 0) | (F.size(docs) > 0), F.lit("partial")).otherwise(F.lit("unavailable"))
        )
        return F.struct(status.alias("status"), docs.alias("sources"), items.alias("items"), F.lit(0).alias("entity_count"))

    marked = text.contains("-----Entities-----") | text.contains("-----Sources-----")
    return F.when(marked, structured(text)).otherwise(mined(text))


def combine_contexts(first: Column, second: Column) -> Column:
    """Distinct rows of two CSV contexts without their first column, renumbered in text order."""

    def joined(p: Column) -> Column:
        a, b = p["a"], p["b"]
        header = F.coalesce(F.get(b, F.lit(0)), F.get(a, F.lit(0)))
        body = F.transform(F.concat(_dict_rows(a), _dict_rows(b)), lambda r: F.array_join(F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))), ","))
        rows = F.array_sort(F.array_distinct(F.filter(body, lambda x: x != "")))
        lines = F.transform(rows, lambda x, i: F.concat((i + 1).cast("string"), F.lit(",\t"), x))
        return F.when(header.isNull(), F.lit("")).otherwise(F.array_join(F.concat(F.array(F.array_join(header, ",\t")), lines), "\n"))

    return tx.let(F.struct(csv_records(tx.text_or_empty(first)).alias("a"), csv_records(tx.text_or_empty(second)).alias("b")), joined)


# --- similarity -----------------------------------------------------------------------------------------


def _words(c: Column) -> Column:
    return F.filter(F.split(F.lower(tx.strip(tx.text_or_empty(c))), f"{tx.WS}+"), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    x, y = _words(a), _words(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / union)


def token_levenshtein(a: Column, b: Column) -> Column:
    """1 - token edit distance / longer length.

    The distinct tokens of the pair are numbered and each token becomes the one character with that
    code point (supplementary planes, a million of them), so that the built-in character distance
    counts tokens.
    """

    def coded(p: Column) -> Column:
        vocab = F.array_distinct(F.concat(p["x"], p["y"]))
        # code points 0x10000 and up; a number per distinct token through a map, not a scan
        code = F.map_from_arrays(vocab, F.sequence(F.lit(65536), F.lit(65535) + F.size(vocab)))

        def as_text(ws: Column) -> Column:
            return F.array_join(
                F.transform(ws, lambda w: F.decode(F.unhex(F.lpad(F.hex(F.try_element_at(code, w)), 8, "0")), "UTF-32")), ""
            )

        longest = F.greatest(F.size(p["x"]), F.size(p["y"]))
        some = 1 - F.levenshtein(as_text(p["x"]), as_text(p["y"])) / longest
        return F.when(longest == 0, F.lit(0.0)).when((F.size(p["x"]) == 0) | (F.size(p["y"]) == 0), F.lit(0.0)).otherwise(some)

    return tx.let(F.struct(_words(a).alias("x"), _words(b).alias("y")), coded)


def rouge_n(a: Column, b: Column, n: int = 1) -> Column:
    """ROUGE-n F score over distinct n-grams (precision against ``a``, recall against ``b``)."""

    def grams(ws: Column) -> Column:
        if n == 1:
            return F.array_distinct(ws)
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(ws) - (n - 1), F.lit(1))), lambda i: F.size(ws) >= n)
        return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(ws, i, F.lit(n)), "\x01")))

    def scored(p: Column) -> Column:
        shared = F.size(F.array_intersect(p["x"], p["y"]))
        total = F.size(p["x"]) + F.size(p["y"])
        return F.when((shared == 0) | (total == 0), F.lit(0.0)).otherwise(2.0 * shared / total)

    return tx.let(F.struct(grams(_words(a)).alias("x"), grams(_words(b)).alias("y")), scored)


def top_similar(pairs: DataFrame, method: str = "levenshtein", k: int = 1, n: int = 1) -> DataFrame:
    """Best sentences per query of ``pairs(query_id, ord, target, sentence)``, an explicit list per query."""
    t, s = F.col("target"), F.col("sentence")
    if method == "jaccard":
        score = jaccard(s, t)
    elif method == "levenshtein":
        score = token_levenshtein(t, s)
    elif method == "rouge":
        score = rouge_n(s, t, n)
    else:
        raise ValueError("choose jaccard, levenshtein or rouge")
    scored = pairs.withColumn("similarity", F.round(score, 9))
    return top_k(scored, "query_id", [F.desc("similarity"), F.col("ord")], k)


def parse_mode_prefix(query: Column) -> Column:
    """``struct(mode, query)``: a leading ``/mode `` selects the mode."""
    rx = rf"^/({'|'.join(MODE_PREFIXES)}) "
    mode = F.regexp_extract(query, rx, 1)
    rest = F.ltrim(F.regexp_replace(query, rx, ""), F.lit(tx.WS_CHARS))
    return F.struct(
        F.when(mode == "", F.lit(DEFAULT_MODE)).otherwise(mode).alias("mode"), F.when(mode == "", query).otherwise(rest).alias("query")
    )
