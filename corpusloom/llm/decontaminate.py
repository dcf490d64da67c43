"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import SHINGLE, SIMILAR, free_name, texts, word_list
from corpusloom.plans.session import cut

#: Fingerprints of windows at similarity 0.8 differ in about 10 of 64 bits (deviation 3), so 20 leaves out 1 in 5,000 at that edge.
RADIUS = 20
#: An anchor index of at most so many rows (24 bytes each) is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 500_000


def grams(words: Column, k: Column) -> Column:
    """64-bit hashes of all runs of k words (k at most the number of words)."""
    return F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(F.slice(words, i + 1, k)))


def simhash(hashes: Column) -> Column:
    """Bit b is set where more than half of the shingles (each as often as it stands) have it."""
    bit = lambda x, b: F.call_function("shiftright", x, b).bitwiseAND(F.lit(1))
    ones = lambda b: F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, x: acc + bit(x, b))
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(63)),
        F.lit(0).cast("long"),
        lambda acc, b: acc.bitwiseOR(F.when(2 * ones(b) > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))),
    )


def occurrences(hashes: Column) -> Column:
    """A multiset as a set: each shingle with the number of equal ones before it."""
    numbered = F.transform(hashes, lambda x, i: F.xxhash64(x, F.size(F.filter(F.slice(hashes, 1, i), lambda y: y == x))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.transform(hashes, lambda x: F.xxhash64(x, F.lit(0)))).otherwise(numbered)


def running(marks: Column) -> Column:
    """Sums of the first 0, 1, ... entries."""
    zero = F.array(F.lit(0))
    return F.aggregate(marks, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def blocks(fingerprint: Column, radius: int = RADIUS) -> Column:
    """radius + 1 parts of the 64 bits: fingerprints within the radius agree in one of them at least."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*[F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit(2 ** (b - a) - 1)) for a, b in zip(cuts, cuts[1:])])


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", similar: float = SIMILAR, radius: int = RADIUS) -> DataFrame:
    """One row per document id and item whose text stands in the document: id, item_id, start_word, n_words,
    hamming, similarity (weighted Jaccard of five-word shingles, a shingle weighing as often as it stands), the best
    window of each pair, the first of equal ones.

    A window has as many words as the item (or is the whole document, if shorter). Items of fewer than five words
    are one shingle of all their words; items and texts without words (null, empty) match nothing. Repeated rows of
    a document or item give the rows once; empty tables give none.

    A window at ``similar`` or more shares all but a fifth of the item's shingles, hence one of the item's first
    (size - need + 1) shingles in hash order. All windows around each of these anchors, at any place of it, are tried,
    and those that hold as many of the item's shingles as ``similar`` takes are fingerprinted, which leaves none out.
    Equal windows are fingerprinted and compared once, however many documents hold them. Blocks of the fingerprints find every item
    of the window's size within ``radius``; exact similarity decides.
    """
    listed = items.select(F.col(f"`{item_id}`").alias("item"), word_list(F.col(f"`{item_text}`")).alias("words")).where(F.size("words") > 0).distinct()
    k = F.least(F.size("words"), F.lit(SHINGLE))
    listed = cut(listed.select("item", F.size("words").alias("n"), k.alias("k"), grams(F.col("words"), k).alias("grams")))
    sizes = sorted(r["k"] for r in listed.select("k").distinct().collect())

    prefix = F.size("grams") - F.ceil(F.lit(similar) * F.size("grams") - F.lit(1e-9)) + 1
    first = F.slice(F.array_sort(F.array_distinct("grams")), 1, prefix.cast("int"))
    anchors = listed.select("k", "n", F.explode(first).alias("gram"), "grams")
    index = cut(anchors.select("k", "gram", "n", F.array_distinct("grams").alias("item_grams"), F.size("grams").alias("wanted")).distinct())
    small = index.agg(F.coalesce(F.sum(F.size("item_grams") + 3), F.lit(0))).first()[0] <= 3 * BROADCAST_ROWS

    rows = texts(docs, id_col, text_col).select("id", word_list(F.col("text")).alias("words"))
    found = []
    for size in sizes:
        at = rows.where(F.size("words") >= size).select("id", "words", F.explode(F.sequence(F.lit(0), F.size("words") - size)).alias("p"))
        at = at.withColumn("gram", F.xxhash64(F.slice("words", F.col("p") + 1, size)))
        some = index.where(F.col("k") == size).select("gram", "n", "item_grams", "wanted")
        hit = at.join(F.broadcast(some) if small else some, "gram")
        last = F.greatest(F.lit(0), F.size("words") - F.col("n"))
        low = F.least(F.greatest(F.lit(0), F.col("p") + size - F.col("n")), last)
        high = F.least(F.col("p"), last)
        part = F.slice("words", low + 1, high - low + F.col("n"))
        found.append(hit.select("id", "n", F.lit(size).alias("k"), low.alias("low"), "item_grams", "wanted", part.alias("part")))
    schema_only = rows.select("id", F.lit(0).alias("n"), F.lit(0).alias("k"), F.lit(0).alias("low"), F.array().cast("array<bigint>").alias("item_grams"), F.lit(0).alias("wanted"), F.col("words").alias("part")).where(F.lit(False))
    near = reduce(DataFrame.unionByName, found) if found else schema_only
    # prefilter: a running count of the item's shingles, so that of the windows around an anchor few are left
    near = near.withColumn("inside", F.transform(grams(F.col("part"), F.col("k")), lambda g: F.array_contains("item_grams", g).cast("int")))
    held = F.least("n", F.size("part")) - F.col("k") + 1
    need = F.lit(similar) * (held + F.col("wanted")) / (1 + similar) - F.lit(1e-9)
    near = near.withColumn("total", running(F.col("inside")))
    starts = F.filter(F.sequence(F.lit(0), F.size("inside") - held), lambda i: F.get("total", i + held) - F.get("total", i) >= need)
    windows = near.select("id", "n", "k", "low", "part", F.explode(starts).alias("i"))
    windows = windows.select("id", "n", "k", (F.col("low") + F.col("i")).alias("start"), F.slice("part", F.col("i") + 1, F.col("n")).alias("window"))
    windows = windows.select("*", F.xxhash64("window").alias("w1"), F.xxhash64(F.lit("second"), "window").alias("w2"))
    windows = cut(windows.groupBy("id", "n", "k", "start", "w1", "w2").agg(F.any_value("window").alias("window")))

    prints = windows.groupBy("w1", "w2", "n", "k").agg(F.any_value("window").alias("window")).select("w1", "w2", "n", grams(F.col("window"), F.col("k")).alias("grams"))
    prints = prints.select("w1", "w2", "n", occurrences(F.col("grams")).alias("have"), simhash(F.col("grams")).alias("print"))
    known = cut(listed.select("item", "n", occurrences(F.col("grams")).alias("wanted"), simhash(F.col("grams")).alias("item_print")))
    left = prints.select("*", F.posexplode(blocks(F.col("print"), radius)).alias("block", "bits"))
    right = known.select("item", "n", "item_print", F.posexplode(blocks(F.col("item_print"), radius)).alias("block", "bits"))
    distance = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))
    close = left.join(right, ["n", "block", "bits"]).where(distance <= radius)
    close = close.groupBy("w1", "w2", "n", "item").agg(F.any_value("have").alias("have"), F.min(distance).alias("hamming"))
    shared = F.size(F.array_intersect("have", "wanted"))
    close = close.join(known.select("item", "n", "wanted"), ["item", "n"]).withColumn("similarity", shared / (F.size("have") + F.size("wanted") - shared))
    close = cut(close.where(F.col("similarity") >= similar - 1e-12).select("w1", "w2", "n", "item", "hamming", "similarity"))

    leaks = windows.select("id", "start", "n", "w1", "w2").join(close, ["w1", "w2", "n"])
    best = F.max_by(F.struct("start", "n", "hamming", "similarity"), F.struct(F.col("similarity"), -F.col("start"))).alias("best")
    out = leaks.groupBy("id", "item").agg(best)
    return out.select(
        F.col("id").alias(id_col),
        F.col("item").alias(item_id),
        F.col("best.start").cast("long").alias("start_word"),
        F.col("best.n").cast("long").alias("n_words"),
        F.col("best.hamming").cast("long").alias("hamming"),
        F.col("best.similarity").alias("similarity"),
    )


def drop_leaked(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns, whose id find_leaks does not list; rows without id are judged by their text's
    own leaks as one document."""
    name = free_name(docs, "leaked")
    leaked = find_leaks(docs, items, id_col, text_col).select(F.col(id_col).alias(name)).distinct()
    return docs.join(cut(leaked), F.col(f"`{id_col}`").eqNullSafe(F.col(name)), "left_anti")
