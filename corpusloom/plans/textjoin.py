"""Joins of texts with texts that need no comparison of every pair."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.scan import top_k
from corpusloom.plans.session import cut

#: Lengths of needle heads in UTF-8 bytes.
KEY_LENGTHS = (1, 2, 4, 8, 16, 32, 64, 128)
#: Bytes that are hashed at once inside a task.
PIECE = 1 << 20
#: Bits of the filter that needle heads are looked up in: at least, and at most (2 MB).
FILTER_BITS = (20, 24)
_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def _byte_table() -> np.ndarray:
    x = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * _ODD[0]
    return (x ^ (x >> np.uint64(29))) * _ODD[1]


def _window_hashes(data: np.ndarray, lengths: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
    """``(k, hash of data[i:i + k] for every i)`` for each of ``lengths`` (powers of two), by doubling."""
    h, k = _byte_table()[data], 1
    for wanted in sorted(lengths):
        while k < wanted and len(h) > k:
            h = h[:-k] * _ODD[0] + h[k:]
            h ^= h >> np.uint64(31)
            k *= 2
        if k < wanted:
            return
        yield k, h * _ODD[2]


def _text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column without nulls, and the places where its rows start and the last one ends."""
    column = column.cast(pa.large_string())
    _, starts, data = column.buffers()
    starts = np.frombuffer(starts, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def _needle_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(needle, _k, _start)`` to ``(needle, _k, _head)``: the hash of the first ``_k`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, starts = _text_bytes(batch.column("_start"))
        k_of = batch.column("_k").to_numpy()
        head = np.zeros(batch.num_rows, np.uint64)
        for k, h in _window_hashes(data, np.unique(k_of).tolist()):
            rows = np.flatnonzero(k_of == k)
            head[rows] = h[starts[rows]]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("_k"), pa.array(head.view(np.int64))], [batch.schema.names[0], "_k", "_head"])


def _heads_in(used: Sequence[int], bits: int, packed: bytes):
    """``(_tid, text)`` to the distinct ``(_tid, _k, _head)`` of the windows that the filter lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = max(used, default=1)
        passes = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little").view(bool)
        for batch in batches:
            if not batch.num_rows:
                continue
            tids = batch.column("_tid").to_numpy()
            data, starts = _text_bytes(batch.column(1))
            found = []
            for low in range(0, len(data), PIECE):
                # windows that start in this piece; they may end in the next one
                for k, h in _window_hashes(data[low : low + PIECE + reach - 1], used):
                    h = h[:PIECE]
                    at = np.flatnonzero(passes[h >> np.uint64(64 - bits)])
                    row = np.searchsorted(starts, at + low, "right") - 1
                    inside = at + low + k <= starts[row + 1]
                    if inside.any():
                        keys = pd.DataFrame({"_tid": tids[row[inside]], "_k": np.int32(k), "_head": h[at[inside]].view(np.int64)})
                        found.append(keys.drop_duplicates())
            if found:
                yield pa.RecordBatch.from_pandas(pd.concat(found).drop_duplicates(), preserve_index=False)

    return run


def _filter(heads: DataFrame) -> tuple[int, bytes]:
    """Bits of a filter of ``heads(_head)`` and the filter; only its set words, at most 2 MB, reach the driver."""
    bits = min(FILTER_BITS[1], max(FILTER_BITS[0], (64 * heads.count()).bit_length()))
    slots = heads.select(F.shiftrightunsigned("_head", 64 - bits).alias("_slot")).distinct()
    octets = slots.groupBy(F.shiftright("_slot", 3).alias("at")).agg(F.sum(F.pow(F.lit(2), F.col("_slot") % 8).cast("int")).cast("int").alias("bits")).toArrow()
    packed = np.zeros(1 << (bits - 3), np.uint8)
    packed[octets["at"].to_numpy()] = octets["bits"].to_numpy()
    return bits, packed.tobytes()


def contained_pairs(needles: DataFrame, hay: DataFrame, needle: str = "needle", text: str = "text") -> DataFrame:
    """Pairs ``(needle, text)`` of distinct texts where ``text`` contains ``needle``.

    A needle is keyed by its head, cut to a power of two: a text contains the needle only if
    that head is among the text's windows of that length.  All windows of a text are hashed at once
    (linear in its length, at most eight lengths); those that a filter of the heads' hashes lets pass
    are joined with the heads, and the surviving pairs are verified, so the filter's size changes the
    work only.  Work grows with texts plus matches of heads at least half as long as the needle (or
    128 bytes long), never with needles times texts.
    """
    length = F.octet_length(needle)
    key_len = F.lit(KEY_LENGTHS[0])
    for k in KEY_LENGTHS[1:]:
        key_len = F.when(length >= k, F.lit(k)).otherwise(key_len)
    n = needles.select(needle).where(f"{needle} <> ''").distinct().withColumn("_k", key_len)
    # written out, so that the planner knows its size and can choose a broadcast where it is small
    n = cut(n.withColumn("_start", F.substring(F.col(needle), 1, KEY_LENGTHS[-1])).mapInArrow(_needle_heads, f"`{needle}` string, _k int, _head bigint"))
    used = sorted(r[0] for r in n.select("_k").distinct().collect())  # at most eight values
    # a fixed number of partitions: hashing texts costs more than their bytes say
    parts = max(hay.sparkSession.sparkContext.defaultParallelism, int(hay.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    h = cut(hay.select(text).where(f"{text} <> ''").repartition(parts, text).distinct().withColumn("_tid", F.monotonically_increasing_id()))
    heads = h.select("_tid", text).mapInArrow(_heads_in(used, *_filter(n)), "_tid bigint, _k int, _head bigint")
    # written out: what the filter let pass is small beside the texts, and the planner then knows it
    hits = cut(heads.join(n, ["_k", "_head"]).select("_tid", needle))
    return hits.join(h, "_tid").where(F.instr(F.col(text), F.col(needle)) > 0).select(needle, text)


class _ItemIndex:
    """Inverted index of a right side ``(key, items, extra columns)`` of distinct item sets.

    Each posting carries the item set as a bit mask of the 62 most frequent items plus the list of
    its other items, so that a pair is counted with one bit operation in the usual case.  Postings
    are salted by their key, so that a frequent item is spread over several tasks.
    """

    BITS = 62

    def __init__(self, right: DataFrame, key: str, items: str, extra: list[str], salts: int):
        self.salts = salts
        freq = right.select(F.explode(items).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("df"))
        self.freq = cut(freq)
        top = self.freq.orderBy(F.desc("df"), "item").limit(self.BITS).collect()
        self.bits = {r["item"]: 1 << i for i, r in enumerate(top)}
        self.postings = cut(
            right.select(
                F.explode(items).alias("item"), key, *extra, self.mask(F.col(items)).alias("r_mask"), self.rest(F.col(items)).alias("r_rest"),
                F.pmod(F.xxhash64(key), F.lit(salts)).cast("int").alias("salt"),
            )
        )

    def mask(self, items: Column) -> Column:
        if not self.bits:
            return F.lit(0).cast("bigint")
        table = F.create_map(*[F.lit(v) if isinstance(v, str) else F.lit(v).cast("bigint") for kv in self.bits.items() for v in kv])
        zero = F.lit(0).cast("bigint")
        return F.aggregate(items, zero, lambda m, x: m.bitwiseOR(F.coalesce(F.try_element_at(table, x), zero)))

    def rest(self, items: Column) -> Column:
        return F.filter(items, lambda x: ~x.isin(*self.bits)) if self.bits else items

    def ask(self, left: DataFrame, key: str, items: str) -> DataFrame:
        """Left sets with their items that occur on the right, rarest first, as ``ordered``."""
        known = left.select(key, F.explode(items).alias("item")).join(self.freq, "item").groupBy(key).agg(
            F.sort_array(F.collect_list(F.struct("df", "item"))).alias("o")
        )
        return cut(
            left.withColumn("n", F.size(items)).drop(items).join(known, key).withColumn("ordered", F.col("o.item"))
            .withColumn("l_mask", self.mask(F.col("o.item"))).withColumn("l_rest", self.rest(F.col("o.item")))
        )

    def overlap(self) -> Column:
        others = F.when((F.size("l_rest") > 0) & (F.size("r_rest") > 0), F.size(F.array_intersect("l_rest", "r_rest"))).otherwise(F.lit(0))
        return F.bit_count(F.col("l_mask").bitwiseAND(F.col("r_mask"))) + others

    def meet(self, asked: DataFrame, needed: Column) -> DataFrame:
        """Pairs that share at least ``needed`` items, each once: it must share one of the
        ``|left| - needed + 1`` rarest items and is taken at the first of them."""
        prefix = F.slice("ordered", F.lit(1), F.greatest(F.lit(0), F.size("ordered") - needed + 1))
        probes = F.transform(
            prefix,
            lambda x, i: F.struct(
                x.alias("item"), self.mask(F.slice("ordered", F.lit(1), i)).alias("b_mask"), self.rest(F.slice("ordered", F.lit(1), i)).alias("b_rest")
            ),
        )
        keep = [c for c in asked.columns if c not in ("o", "ordered")]
        left = asked.withColumn("needed", needed).select(*keep, "needed", F.explode(probes).alias("x")).select(*keep, "needed", "x.*").withColumn(
            "salt", F.explode(F.sequence(F.lit(0), F.lit(self.salts - 1)))
        )
        first = (F.col("b_mask").bitwiseAND(F.col("r_mask")) == 0) & ((F.size("b_rest") == 0) | ~F.arrays_overlap("b_rest", "r_rest"))
        return left.join(self.postings, ["item", "salt"]).where(first).withColumn("overlap", self.overlap()).where("overlap >= needed")


def overlap_counts(left: DataFrame, right: DataFrame, left_key: str, right_key: str, items: str, salts: int = 8, at_least: int = 2) -> DataFrame:
    """Numbers of shared items of two sides of ``(key, items array)``, from ``at_least`` on.

    Callers group equal item sets first, so that the two sides hold distinct sets only.
    """
    index = _ItemIndex(right, right_key, items, [], salts)
    asked = index.ask(left.select(left_key, items), left_key, items)
    return index.meet(asked, F.lit(at_least)).select(left_key, right_key, F.col("overlap").cast("int").alias("overlap"))


def best_overlaps(left: DataFrame, right: DataFrame, k: int, per_share: float, head_bonus: float, salts: int = 8, probe_rows: int = 1000) -> DataFrame:
    """Best ``k`` right groups per left group by ``round(per_share * overlap / |left| + bonus, 4)``.

    ``left(qkey, items, head)``, ``right(ckey, items, head, first_ord)`` with distinct item sets; the
    bonus counts where the right head starts with the left head; ties go by ``first_ord``; an overlap
    below two does not count.  Exact, in two passes over an inverted index: a few right groups that
    hold a rare item of the left set give a lower bound of its k-th score; only pairs with enough
    shared items to reach that bound are formed in the second pass.
    """
    index = _ItemIndex(right.withColumnRenamed("head", "r_head"), "ckey", "items", ["r_head", "first_ord"], salts)
    asked = index.ask(left.select("qkey", "items", F.col("head").alias("l_head")), "qkey", "items")

    def scored(pairs: DataFrame) -> DataFrame:
        bonus = F.when(F.col("r_head").startswith(F.col("l_head")), F.lit(head_bonus)).otherwise(F.lit(0.0))
        return pairs.select("qkey", "ckey", "first_ord", F.round(F.col("overlap") / F.col("n") * per_share + bonus, 4).alias("score"))

    order = [F.desc("score"), F.col("first_ord")]
    usual = F.filter("o", lambda x: x["df"] >= k)
    probe = asked.where(F.size(usual) > 0).withColumn("item", F.get(usual, F.lit(0))["item"])
    some = top_k(index.postings, "item", [F.xxhash64("ckey")], probe_rows, "_r").drop("_r", "salt")
    tried = probe.join(some, "item").withColumn("overlap", index.overlap()).where("overlap >= 2")
    bound = top_k(scored(tried), "qkey", order, k, "_r").groupBy("qkey").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("bound"))
    least = F.ceil((F.coalesce("bound", F.lit(0.0)) - head_bonus - 1e-4) / per_share * F.col("n")).cast("int")
    met = index.meet(asked.join(bound, "qkey", "left"), F.greatest(F.lit(2), least))
    return top_k(scored(met), "qkey", order, k, "_r").drop("_r")
