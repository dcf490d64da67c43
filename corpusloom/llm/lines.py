"""Line dedup: explode normalised lines, hash, count documents per hash, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import ascii_lower, hash128, texts
from corpusloom.plans.session import cut

BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def lost_lines(rows: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """lost_id, lost_th, lost: positions of the lines that a text (id and hash) loses."""
    split = rows.select("id", "th", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = split.select("id", "th", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    hashed = keyed.select("id", "th", "pos", *hash128(F.col("key")))
    per_doc = hashed.groupBy("h1", "h2", "id").agg(F.lit(1).alias("one"))
    common = per_doc.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("keeper"))
    common = cut(common.where(F.col("n") >= min_docs).select("h1", "h2", "keeper"))
    lost = hashed.join(common, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("keeper")))
    return lost.groupBy(F.col("id").alias("lost_id"), F.col("th").alias("lost_th")).agg(F.collect_set("pos").alias("lost"))


def remaining(text: Column) -> Column:
    """The text without the lines at the positions ``lost``."""
    lines = F.split(text, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("lost"))
    return F.when(F.col("lost").isNull(), text).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2, min_chars: int = 10) -> DataFrame:
    """One row per input row: id, text (kept lines), n_lines, n_dropped.

    A line whose key has at least ``min_chars`` code points and stands in at least ``min_docs`` documents
    stays only in the smallest id that holds it (all its places there). Null or empty text: one empty line.
    Rows of one id are one document; rows repeated in full give equal results. A null id counts as one
    document and never keeps a line that another document holds. No rows in, no rows out.

    The hashes of eligible lines are counted per document, then over documents, both with map-side
    aggregation, so a line found everywhere is one row per task. Only hashes that lose lines are joined back,
    and only the dropped positions travel to the text.
    """
    rows = texts(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))
    lost = lost_lines(rows, min_docs, min_chars)
    joined = rows.join(lost, F.col("id").eqNullSafe(F.col("lost_id")) & (F.col("th") == F.col("lost_th")), "left")
    lines = F.split("text", "\n", -1)
    return joined.select(
        F.col("id").alias(id_col),
        remaining(F.col("text")).alias(text_col),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def replace_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", min_docs: int = 2, min_chars: int = 10) -> DataFrame:
    """All rows and columns of ``docs`` with the texts that dedup_lines leaves (null becomes empty), and their length
    in ``chars_col`` where there is such a column."""
    rows = texts(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))
    lost = lost_lines(rows, min_docs, min_chars)
    text = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    whole = whole.select("row", F.col(f"row.`{id_col}`").alias("id"), F.xxhash64(text).alias("th"))
    joined = whole.join(lost, F.col("id").eqNullSafe(F.col("lost_id")) & (F.col("th") == F.col("lost_th")), "left")
    new = joined.select("row", remaining(text).alias("new"))
    changed = {text_col: F.col("new"), chars_col: F.length("new").cast(docs.schema[chars_col].dataType) if chars_col in docs.columns else None}
    return new.select(*[changed[c].alias(c) if c in changed else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
