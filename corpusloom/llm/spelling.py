"""Spelling variants: dense prefix-suffix tiling of padded code-point matrices finds all words one edit apart."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import ascii_lower, texts
from corpusloom.plans.session import cut

#: Latin letters in Java's notation.
RUN = r"[A-Za-zÀ-ÿ]+"
#: Words of a block (fewer if they are long: ROOM code points), and matrix cells compared at once; both only bound memory.
BLOCK, ROOM, CELLS = 256, 1 << 20, 1 << 20


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = RUN, shortest: int = 5, least: int = 3, damaged: int | None = 97) -> DataFrame:
    """word, n: words of all whole texts with at least ``shortest`` code points that occur at least ``least`` times.

    Words are the runs of ``pattern``, A-Z lower-cased. With ``damaged``, a run whose crc32 (of ``<id>:<run>``) this number
    divides loses the code point at crc32 % length first (a null id is written as nothing). Null texts have no words. Words
    are counted before the shuffle, so that a frequent word is one row per task.
    """
    runs = F.filter(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(pattern), F.lit(0)), lambda w: F.length(w) >= shortest)
    words = texts(docs, id_col, text_col).select("id", F.explode(runs).alias("word"))
    if damaged:
        words = words.withColumn("h", F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("word"))))
        at = (F.col("h") % F.length("word")).cast("int")
        short = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        words = words.select(F.when(F.col("h") % damaged == 0, short).otherwise(F.col("word")).alias("word"))
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _keys() -> Column:
    """What two words have in common if the longer one has ``long`` code points and they are one edit apart: its parts are
    [0, x), [x, y) and [y, long), and the edit leaves two of them as they are."""
    made = []
    for more in (0, 1):
        long = F.length("word") + more
        x, y = F.floor(long / 3).cast("int"), F.floor(long * 2 / 3).cast("int")
        tail = lambda k: F.right(F.col("word"), k)
        heads = (F.substring("word", F.lit(1), y), F.concat(F.substring("word", F.lit(1), x), tail(long - y)), tail(long - x))
        made += [F.struct((long * 3 + side).cast("int").alias("kind"), F.xxhash64(key).alias("key")) for side, key in enumerate(heads)]
    return F.array(*made)


def tiles(words: DataFrame) -> DataFrame:
    """kind, key, i, j, block, word, n: each bucket of words with a common key, cut into blocks; a tile is a pair of blocks.

    A word goes to one tile for each other block of its bucket, so that no task needs more than two blocks at a time and
    the tiles of a large bucket spread over tasks. Buckets of one word are left out.
    """
    rows = words.select("word", "n", F.explode(_keys()).alias("k")).select("k.*", "word", "n")
    per_block = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(ROOM) * 3 / F.col("kind")))).cast("long")
    large = rows.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("kind", "key", F.ceil(F.col("size") / per_block).cast("int").alias("blocks"))
    rows = rows.join(large, ["kind", "key"])
    rows = rows.withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("kind", "key", "block", "word", "n", other)
    return rows.select("kind", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "word", "n")


def _matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points left-aligned and right-aligned (reversed), padded with -1, and the lengths."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.int32)
    width = int(size.max())
    row = np.repeat(np.arange(len(words)), size)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    left, right = np.full((len(words), width), -1, np.int32), np.full((len(words), width), -1, np.int32)
    left[row, col] = flat
    right[row, np.repeat(size, size) - 1 - col] = flat
    return left, right, size


def _common(m: np.ndarray) -> np.ndarray:
    """groups x words x words: length of the common start of each pair of rows within a group (groups x words x width)."""
    alive = np.ones((m.shape[0], m.shape[1], m.shape[1]), bool)
    out = np.zeros(alive.shape, np.int32)
    for c in range(m.shape[2]):
        alive &= m[:, :, None, c] == m[:, None, :, c]
        if not alive.any():
            break
        out += alive
    return out


def near_pairs(words: list[str], group: np.ndarray, kind: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (a, b) of words of one group (a tile) that are one edit apart; each pair of different words once over
    all kinds. ``group`` ascends; a tile of two blocks compares the words of one with those of the other."""
    left, right, size = _matrices(words)
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    count = np.diff(np.append(start, len(group)))
    two = np.maximum.reduceat(block, start) != np.minimum.reduceat(block, start)
    wide = 1 << np.ceil(np.log2(np.maximum(count, 2))).astype(np.int64)
    found = []
    for s in np.unique(wide).tolist():
        these = np.flatnonzero(wide == s)
        step = max(1, CELLS // (s * s))
        for a in range(0, len(these), step):
            g = these[a : a + step]
            place = np.arange(s)[None, :]
            real = place < count[g][:, None]
            row = np.where(real, start[g][:, None] + place, start[g][:, None])
            long = kind[start[g]][:, None, None] // 3
            side = kind[start[g]][:, None, None] % 3
            x, y = long // 3, long * 2 // 3
            head, tail = _common(left[row]), _common(right[row])
            ok = real[:, :, None] & real[:, None, :] & np.triu(np.ones((s, s), bool), 1)[None]
            ok &= (head + tail >= long - 1) & (np.maximum(size[row][:, :, None], size[row][:, None, :]) == long)
            ok &= ~two[g][:, None, None] | (block[row][:, :, None] != block[row][:, None, :])
            # a pair that meets under several keys counts under the first of them
            ok &= np.where(side == 0, head >= y, np.where(side == 1, (head >= x) & (head < y) & (tail >= long - y), (head < x) & (tail >= long - x)))
            k, p, q = np.nonzero(ok)
            found.append((row[k, p], row[k, q]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


_NEAR = T.StructType([T.StructField("word", T.StringType()), T.StructField("near", T.StringType()), T.StructField("near_n", T.LongType())])


def _whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows again as tables that never break a tile; a table has rows of at most ROOM code points or one tile."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        cols = [table.column(c).to_numpy() for c in ("kind", "key", "i", "j")]
        new = np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in cols])])
        start = np.flatnonzero(new)
        a = 0
        while a < len(start) - 1:
            room = max(1, ROOM * 3 // int(cols[0][start[a]]))
            b = max(a + 1, int(np.searchsorted(start, start[a] + room, side="right")) - 1)
            b = min(b, len(start) - 1)
            # words get longer with kind: no row may be more than twice as wide as the first one
            b = max(a + 1, min(b, int(np.searchsorted(cols[0][start], 2 * cols[0][start[a]], side="right"))))
            yield table.slice(start[a], start[b] - start[a])
            a = b
        rest = table.slice(start[-1])
    if rest is not None:
        yield rest


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _whole_tiles(batches):
        kind, key, i, j, block, n = (table.column(c).to_numpy() for c in ("kind", "key", "i", "j", "block", "n"))
        group = np.cumsum(np.concatenate([[True], (kind[1:] != kind[:-1]) | (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        words = table.column("word").combine_chunks()
        words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
        a, b = near_pairs(words.to_pylist(), group, kind, block)
        one, two = np.concatenate([a, b]), np.concatenate([b, a])
        yield pa.RecordBatch.from_arrays([words.take(pa.array(one)), words.take(pa.array(two)), pa.array(n[two])], names=_NEAR.names)


def near_words(words: DataFrame) -> DataFrame:
    """word, near, near_n: every pair of different words one insertion, deletion or replacement apart, both ways."""
    cols = ["kind", "key", "i", "j"]
    return tiles(words).repartition(*cols).sortWithinPartitions(*cols).mapInArrow(_compare, _NEAR)


def roots(links: DataFrame) -> DataFrame:
    """word, root: the last word that (word, form) links lead to. Counts at least double with each link, so there is no
    circle and chains are short; each round doubles the reach."""
    reach = cut(links.select("word", F.col("form").alias("root")))
    while True:
        onward = reach.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = cut(reach.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        reach = step.select("word", "root")
        if step.where("moved").isEmpty():
            return reach


def group_variants(words: DataFrame, times: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n per row of ``words`` (word, n; distinct words without nulls).

    Two words are near if one inserted, deleted or replaced code point makes one the other; n_near counts a word's near
    words. Its form is the near word of largest n (ties: smallest in code-point order) if that n is at least ``times`` (2
    or more) its own, else null; its root is where forms lead, the word itself if it has none. No words give no rows.

    Every pair one edit apart meets in a tile (``tiles``) and is decided there from the lengths of common prefix and
    suffix of two padded rows: together they reach the longer length less one. Nothing is dropped or capped.
    """
    if times < 2:
        raise ValueError("forms must be at least twice as frequent, else links could run in circles")
    words = cut(words.select("word", F.col("n").cast("long").alias("n")))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best")
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    named = words.join(near, "word", "left")
    is_form = -F.col("best.less") >= times * F.col("n")
    named = cut(named.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")))
    ends = roots(named.where("form is not null"))
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
