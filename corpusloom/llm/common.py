"""Column helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything that is neither an ASCII letter or digit nor beyond ASCII; applied after lower-casing.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a shingle and similarity of near duplicates, unless an operator's contract says otherwise.
SHINGLE, SIMILAR = 5, 0.8


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; texts without other letters take the faster built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_line(text: Column) -> Column:
    """The words of a text (null: empty), lower-cased, with one blank between them."""
    return F.btrim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD, " "))


def split_words(line: Column) -> Column:
    """Words of a words_line; no word for an empty line."""
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(line, " "))


def word_list(text: Column) -> Column:
    """Words of a text (null: none), lower-cased; as split_words(words_line(text)), in one pass."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only what an operator reads, under names of its own, so that extra columns cannot clash: id, text."""
    return df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def hash128(*cols: Column) -> list[Column]:
    """Two 64-bit hashes: enough bits that 10^12 keys do not meet by chance."""
    return [F.xxhash64(*cols).alias("h1"), F.xxhash64(F.lit("second"), *cols).alias("h2")]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of the frame has."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name
