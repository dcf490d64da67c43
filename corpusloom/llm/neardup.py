"""Near duplicates by BagMinHash: weighted-Jaccard signatures of shingle multisets, bands, exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import SIMILAR, free_name, hash128, texts, word_list
from corpusloom.llm.shingles import flat, mix, shingles, slices, word_hashes
from corpusloom.plans.session import cut, drop

#: Two texts at similarity 0.8 agree in a band with probability 0.8^8 = 0.17 and in none of 64 with 8 in a million.
BANDS, ROWS = 64, 8
SEEDS = {"slot": 0xA3, "height": 0xE7}


def counted(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, shingle) and how often each stands, ordered by row."""
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    return h[at], r[at], np.diff(np.append(at, len(h)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(hashes: np.ndarray, row: np.ndarray, weight: np.ndarray, rows: int, m: int) -> np.ndarray:
    """BagMinHash signature of each row's weighted shingles (weights from 1): rows x m first-arrival times.

    Weights are discretised to whole numbers and their axis is split into the dyadic strips [0,1), [1,2), [2,4), ...
    Each (shingle, strip) has a Poisson process of its own, of the strip's width as rate, seeded by both, so that
    every row sees the same points. A point has a time, a height within the strip and a slot; a row with weight w
    takes the points below w. A slot keeps the earliest time; two rows agree in a slot with probability equal to
    their weighted Jaccard similarity. Points come in order of time, and a process stops for a row as soon as it
    passes the latest of the row's slots. Rows without shingle keep infinite times.
    """
    best = np.full(rows * m, np.inf)
    top = np.zeros(len(weight), np.int64)
    top[weight > 1] = np.ceil(np.log2(weight[weight > 1])).astype(np.int64)
    src = np.repeat(np.arange(len(weight)), top + 1)
    level = np.arange(len(src)) - np.repeat(np.cumsum(top + 1) - (top + 1), top + 1)
    low = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    width = np.where(level == 0, 1.0, low)
    state = mix(mix(hashes[src]) + (level.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    time, owner, limit = np.zeros(len(src)), row[src], weight[src].astype(np.float64)
    whole = limit >= low + width
    step = np.uint64(0xD1342543DE82EF95)
    made = 0
    while len(owner):
        state = state * step + np.uint64(0x9E3779B97F4A7C15)
        draw = mix(state)
        time = time - np.log(_uniform(draw)) / width
        slot = (mix(draw ^ np.uint64(SEEDS["slot"])) >> np.uint64(32)) % np.uint64(m)
        if whole.all():
            cell, when = owner * m + slot.astype(np.int64), time
        else:
            taken = whole | (np.floor(low + _uniform(mix(draw ^ np.uint64(SEEDS["height"]))) * width) < limit)
            cell, when = (owner * m + slot.astype(np.int64))[taken], time[taken]
        np.minimum.at(best, cell, when)
        made += len(owner)
        busy = np.unique(owner)
        if made >= len(busy) * m / 4:
            made = 0
            last = np.zeros(rows)
            last[busy] = best.reshape(rows, m)[busy].max(axis=1)
            go = time < last[owner]
            state, time, owner, limit, low, width, whole = (x[go] for x in (state, time, owner, limit, low, width, whole))
    return best.reshape(rows, m)


def bands_of(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash per band, different between bands."""
    bits = sig.view(np.uint64).reshape(len(sig), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), bits.shape[:2]).copy()
    for j in range(rows):
        out = mix(out * np.uint64(0x100000001B3) + bits[:, :, j])
    return out


def signed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """id, bands; per input row."""
    out = T.StructType([docs.schema["id"], T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            words, size = flat(batch.column(1))
            ends = np.concatenate([[0], np.cumsum(size)])
            for a, b in slices(size):
                for c in range(a, b, 500):
                    d = min(b, c + 500)
                    h, count = shingles(words[ends[c] : ends[d]], size[c:d])
                    h, r, w = counted(h, np.repeat(np.arange(d - c), count))
                    sig = signatures(h, r, w, d - c, bands * rows)
                    found = bands_of(sig, bands, rows)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(d - c + 1, dtype=np.int32) * bands), pa.array(found.ravel().view(np.int64)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(c, d - c), lists], names=out.names)

    return docs.select("id", word_hashes(F.col("text")).alias("words")).mapInArrow(run, out)


def among(rows: DataFrame, name: str, wanted: DataFrame) -> DataFrame:
    """Rows whose ``name`` may stand in ``wanted``, whole: all that do and a few others, so that a join behind it moves
    little. The filter has FILTER_BITS bits, 512 a row, however much is wanted; the more, the more others pass."""
    slot = F.pmod(F.xxhash64(name), F.lit(1 << FILTER_BITS))
    held = wanted.select(F.shiftright(slot, 9).alias("_at"), F.shiftright(slot, 6).bitwiseAND(F.lit(7)).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{name}`), 64) as int))").alias("bit"))
    words = [F.bit_or(F.when(F.col("word") == k, F.col("bit")).otherwise(F.lit(0).cast("long"))) for k in range(8)]
    filled = F.broadcast(held.groupBy("_at").agg(F.array(*words).alias("_words")))
    word = F.get("_words", F.shiftright(slot, 6).bitwiseAND(F.lit(7)).cast("int"))
    asked = rows.join(filled, F.shiftright(slot, 9) == F.col("_at"))
    return asked.where(F.getbit(word, F.pmod(F.xxhash64(name), F.lit(64)).cast("int")) == 1).select(*rows.columns)


def verified(pairs: DataFrame, hashed: DataFrame, similar: float) -> DataFrame:
    """Those pairs (a, b) whose texts' shingle multisets overlap by ``similar`` or more, with the similarity; ``hashed`` has
    the word hashes of each id."""
    sides = [among(hashed.withColumnsRenamed({"id": x, "words": f"w{x}"}), x, pairs) for x in ("a", "b")]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    out = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("similarity", T.DoubleType())])

    def run(batches):
        for batch in batches:
            sides = [flat(batch.column(k)) for k in (2, 3)]
            ends = [np.concatenate([[0], np.cumsum(s)]) for _, s in sides]
            ids = [batch.column(k).to_numpy() for k in (0, 1)]
            known: dict[int, tuple] = {}  # a text's shingles are counted once a batch

            def bag(side, i):
                key = ids[side][i]
                if key not in known:
                    (w, s), e = sides[side], ends[side]
                    h = shingles(w[e[i] : e[i + 1]], s[i : i + 1])[0]
                    known[key] = (*np.unique(h, return_counts=True), len(h))
                return known[key]

            got = np.zeros(batch.num_rows)
            for i in range(batch.num_rows):
                (u, p, m), (v, q, n) = bag(0, i), bag(1, i)
                if min(m, n) < similar * max(m, n) - 1e-9:  # cannot overlap enough
                    continue
                at = np.minimum(np.searchsorted(v, u), max(0, len(v) - 1))
                same = v[at] == u if len(v) else np.zeros(len(u), bool)
                shared = int(np.minimum(p[same], q[at[same]]).sum())
                got[i] = shared / max(1, m + n - shared)
            keep = got >= similar - 1e-12
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got)], names=out.names).filter(pa.array(keep))

    return both.select(F.col("a").cast("long"), F.col("b").cast("long"), "wa", "wb").mapInArrow(run, out)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, root: the smallest id that a node reaches. Labels are the smallest of a node's neighbourhood, then each
    label takes its own label's label, until nothing changes; each round is a table, so that no lineage grows."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut(nodes.select("id", F.col("id").alias("root")))
    while True:
        near = both.join(labels.withColumnsRenamed({"id": "b", "root": "r"}), "b").groupBy("a").agg(F.min("r").alias("r"))
        step = cut(labels.join(near, labels["id"] == near["a"], "left").select("id", "root", F.least("root", "r").alias("best")))
        # only labels in use are looked up: few rows, however large a class is
        used = step.groupBy(F.col("best").alias("via")).agg(F.lit(1).alias("one")).drop("one")
        jump = step.select("id", F.col("best").alias("far")).join(used, F.col("id") == F.col("via")).select("via", "far")
        after = cut(step.join(jump, F.col("best") == F.col("via"), "left").select("id", F.col("root").alias("was"), F.least("best", "far").alias("root")))
        labels = after.select("id", "root")
        if after.where("root <> was").isEmpty():
            return labels


def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` (id, root) after linking the classes of the ends of ``edges``; works on classes, not on their members."""
    ends = [labels.withColumnsRenamed({"id": x, "root": f"r{x}"}) for x in ("a", "b")]
    between = cut(edges.select("a", "b").join(ends[0], "a").join(ends[1], "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a <> b").distinct())
    if between.isEmpty():
        return labels
    touched = between.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    new = components(touched, between).select(F.col("id").alias("old"), F.col("root").alias("new")).where("old <> new")
    return cut(labels.join(new, labels["root"] == new["old"], "left").select("id", F.coalesce("new", "root").alias("root")))


#: Bands are worked through in so many parts, each written and deleted by itself.
PARTS = 4
#: Rounds in which members outside their bucket's largest class meet one member of it; rows of a block in the last step.
ROUNDS, BLOCK = 2, 256
#: Size of the filters of ``among``, 2 MB.
FILTER_BITS = 24


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per distinct id: id, class_id (smallest id of its class), class_size.

    Documents are linked if the multisets of their five-word shingles have a weighted Jaccard similarity of
    ``similar`` or more; classes are what links connect. Texts of fewer than five words are one shingle, texts
    without words (null, empty) are copies of each other. Ids are whole numbers; rows without id take no part; of
    several rows with one id one text counts (that of the smallest hash). An empty table gives no rows.

    Texts of equal words are grouped by hash first, with map-side aggregation, and only the smallest id of each is signed.
    Bands of equal signature rows form buckets. A document is compared with the smallest and the largest id of all its
    buckets. In buckets that then still hold several classes, each member outside the largest class is compared with one
    member of that class, another one each round: whoever belongs to it mostly meets a similar one soon, at one pair a
    member. What is still open after that is compared in full, text by text in blocks inside tasks (``_linked``); a block
    gives one link at most for two classes that it joins. So each pair that shares a bucket is decided or connected
    otherwise, and no step emits the pairs of a group.
    """
    own = texts(docs, id_col, text_col).where(F.col("id").isNotNull()).withColumn("id", F.col("id").cast("long"))
    seen = own.select("id", word_list(F.col("text")).alias("w")).select("id", *hash128("w"))
    seen = cut(seen.groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("s"), F.count(F.lit(1)).alias("n")).select("id", "s.*", "n"))
    copies = cut(seen.groupBy("h1", "h2").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("size")).where("size > 1"))
    others = cut(seen.join(copies, ["h1", "h2"]).where("id <> leader").select("id"))
    leads = own.join(others, "id", "left_anti")
    twice = seen.where("n > 1").select("id", "h1", "h2")  # ids with several rows: the text that counts
    if not twice.isEmpty():
        h = dict(zip(("k1", "k2"), hash128(word_list(F.col("text")))))
        some = leads.join(twice, "id").where((h["k1"] == F.col("h1")) & (h["k2"] == F.col("h2"))).select("id", "text")
        leads = leads.join(twice, "id", "left_anti").unionByName(some.groupBy("id").agg(F.min("text").alias("text")))
    signs = cut(signed(leads, bands, rows))

    parts = []
    for p in range(PARTS):
        size = -(-bands // PARTS)
        keys = signs.select("id", F.explode(F.slice("bands", p * size + 1, size)).alias("key"))
        shared = cut(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).where("n > 1"))
        parts.append(cut(among(keys, "key", shared).join(shared.drop("n"), "key").select("key", "id", "low", "high")))
        drop(shared)
    members = parts[0]
    for part in parts[1:]:
        members = members.unionByName(part)
    drop(signs)

    ends = cut(members.groupBy("id").agg(F.array(F.min("low"), F.max("high")).alias("ends")))
    labels = ends.select("id", F.col("id").alias("root"))
    # an inner join, as the planner would move a semi join ahead of the filter
    hashed = cut(among(leads, "id", ends).join(ends.select("id"), "id").select("id", word_hashes(F.col("text")).alias("words")))
    tried = cut(_pairs(ends))
    labels = merged(labels, cut(verified(tried, hashed, similar)))
    for turn in range(ROUNDS + 1):
        open_ = _open(members, labels)
        if open_.isEmpty():
            break
        if turn == ROUNDS:
            labels = merged(labels, cut(_linked(open_, hashed, similar)))
            break
        asked = _met(open_, turn)
        asked = cut(asked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"))
        labels = merged(labels, cut(verified(asked, hashed, similar)))
        tried = tried.unionByName(asked)

    named = seen.join(copies.select("h1", "h2", "leader"), ["h1", "h2"], "left").select("id", F.coalesce("leader", "id").alias("leader"))
    named = cut(named.join(labels.withColumnRenamed("id", "own"), F.col("leader") == F.col("own"), "left").select("id", F.coalesce("root", "leader").alias("class_id")))
    sizes = cut(named.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size")))
    drop(hashed, *parts)
    return named.join(sizes, "class_id").select(F.col("id").alias(id_col), "class_id", "class_size")


def _pairs(ends: DataFrame) -> DataFrame:
    """Distinct pairs a < b of each id with its ends."""
    both = ends.select("id", F.explode("ends").alias("end")).where("id <> end")
    return both.select(F.least("id", "end").alias("a"), F.greatest("id", "end").alias("b")).distinct()


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """key, id, root, of buckets that hold several classes, and main, the bucket's largest class."""
    named = cut(members.select("key", "id").join(labels, "id"))
    sizes = named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("key").agg(F.max_by("root", F.struct("n", -F.col("root"))).alias("main"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    return cut(named.join(mixed.select("key", "main"), "key"))


def _met(open_: DataFrame, turn: int) -> DataFrame:
    """Each member outside the main class with one of that class, by a hash that differs between turns."""
    host = open_.where("root = main").groupBy("key").agg(F.min_by("id", F.xxhash64("id", F.lit(turn))).alias("b"))
    return open_.where("root <> main").select("key", F.col("id").alias("a")).join(host, "key").select("a", "b")


def _linked(open_: DataFrame, hashed: DataFrame, similar: float) -> DataFrame:
    """a, b: similar members of different classes of a bucket, enough of them to join whatever classes of a block are linked.

    Buckets are cut into blocks by a hash of the id; a task gets two blocks at a time and compares their texts.
    """
    sizes = open_.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    rows = open_.select("key", "id", "root").join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.select("key", "id", "root", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("key", "id", "root", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).join(among(hashed, "id", open_), "id")
    tiles = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").select("key", "i", "j", "block", "id", "root", "words")

    def compared(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
            cols = [table.column(c).to_numpy() for c in ("key", "i", "j")]
            starts = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in cols])])) if len(table) else np.zeros(0, int)
            for a, b in zip(starts[:-1], starts[1:]):
                yield from _tile(table.slice(a, b - a), similar)
            rest = table.slice(starts[-1]) if len(starts) else None
        if rest is not None:
            yield from _tile(rest, similar)

    return tiles.mapInArrow(compared, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))


def _tile(rows: pa.Table, similar: float):
    """Links that join the classes of one tile; each member outside its most frequent class is compared at once with all
    others whose class it has not been joined with."""
    block, ids, root = (rows.column(c).to_numpy() for c in ("block", "id", "root"))
    h, total = shingles(*flat(rows.column("words").combine_chunks()))
    h, r, times = counted(h, np.repeat(np.arange(len(ids)), total))
    code = np.unique(h, return_inverse=True)[1]
    begin, end = (np.searchsorted(r, np.arange(len(ids)), side) for side in ("left", "right"))
    mine, held = np.zeros(len(h) + 1, np.int64), np.zeros(len(h) + 1, np.int64)
    names, own, count = np.unique(root, return_inverse=True, return_counts=True)
    joined = np.arange(len(names))
    two = block.min() != block.max()
    left, right = [], []
    for x in np.flatnonzero(own != count.argmax()).tolist():
        other = joined[own] != joined[own[x]]
        if two:
            other &= block != block[x]
        # texts of too different lengths cannot overlap enough
        other = np.flatnonzero(other & (np.minimum(total, total[x]) >= similar * np.maximum(total, total[x]) - 1e-9))
        if not len(other):
            continue
        at = code[begin[x] : end[x]]
        mine[at] = times[begin[x] : end[x]]
        np.cumsum(np.minimum(mine[code], times), out=held[1:])
        mine[at] = 0
        shared = held[end[other]] - held[begin[other]]
        hit = other[shared / np.maximum(1, total[x] + total[other] - shared) >= similar - 1e-12]
        classes, first = np.unique(joined[own[hit]], return_index=True)
        left.append(np.full(len(first), ids[x]))
        right.append(ids[hit[first]])
        joined[np.isin(joined, classes)] = joined[own[x]]
    if left:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """Rows of ``docs``, all columns, whose id is the smallest of its class; rows without id stay."""
    classes = near_duplicates(docs, id_col, text_col, similar)
    name = free_name(docs, "gone")
    gone = cut(classes.where(F.col(id_col) != F.col("class_id")).select(F.col(id_col).alias(name)))
    return docs.join(gone, F.col(f"`{id_col}`").cast("long") == F.col(name), "left_anti")
