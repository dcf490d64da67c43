"""Nearest neighbours from a hash-prefix forest: per tree the vectors' long hash strings stand in sorted arrays."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusloom.plans.session import cut

TREES, BITS, SAMPLE, BLOCK = 32, 24, 4096, 4096


def usable(vec: Column) -> Column:
    """Not null, no null or non-finite component, not zero throughout."""
    good = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec.isNotNull() & good & F.exists(vec, lambda x: x != 0)


def renewed(df: DataFrame) -> DataFrame:
    """The same columns under new identities, so that a frame can meet another one of the same origin."""
    return df.toDF(*df.columns)


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", share: float = 0.8, least: int = 1000, trees: int = TREES, bits: int = BITS, sample: int = SAMPLE, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """Columns query_id, rank (from 1), vec_id, score: the k nearest found of every row that ``is_query`` accepts.

    Nearness is Euclidean distance in double precision on the original vectors, ties go to the smaller id. A query
    is never its own neighbour; with fewer candidates all are returned. Unusable vectors (see ``usable``), null ids
    and vectors of another than the most frequent length take no part. Rows of one id with equal vectors count once.

    Index: a bit is the side of a random direction's median, which is fitted on ``sample`` rows (those of smallest
    id hash); every row is indexed. Rows are dealt by (tree, first bits of the string, salt), so that a task holds a
    sorted array of at most about ``block`` strings; queries go to the arrays of their own prefix. First each array
    counts, per query, its strings that share a prefix of each length with the query's; the sums over trees give the
    longest common length at which ``max(least, share * rows)`` strings match (synchronous ascent). Then the arrays
    rank what matches at that length. A query whose prefix is too rare in every tree is compared with all rows of
    one tree instead. Of exact copies only the k + 1 smallest ids are indexed: others cannot be among k nearest.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vec")))
    sizes = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    out = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    if not sizes:
        return spark.createDataFrame([], out)
    dim = sizes[0]["dim"]
    rows = rows.where(F.size("vec") == dim)
    copies = Window.partitionBy("h1", "h2").orderBy("id")
    known = rows.groupBy("id", "vec").agg(F.max("asks").alias("asks"))
    known = known.select("*", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit("second"), "vec").alias("h2"))
    kept = known.select("id", "h1", "h2", F.row_number().over(copies).alias("copy")).where(F.col("copy") <= k + 1)
    known = known.join(kept.withColumnsRenamed({"id": "kept_id", "h1": "k1", "h2": "k2"}), (F.col("id") == F.col("kept_id")) & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
    known = known.select("id", "vec", "asks", F.col("copy").isNotNull().alias("listed")).where("asks or listed")
    fitted = np.array([r["vec"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("vec").collect()])
    directions = np.random.default_rng(seed).standard_normal((dim, trees * bits))
    medians = np.median(fitted @ directions, axis=0)
    weight = (1 << np.arange(bits - 1, -1, -1)).astype(np.int64)

    def hashed(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim)
            keys = ((x @ directions > medians).reshape(b.num_rows, trees, bits) * weight).sum(-1)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * trees), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, flat], names=["id", "vec", "asks", "listed", "keys"])

    known = cut(known.mapInArrow(hashed, T.StructType([*known.schema.fields, T.StructField("keys", T.ArrayType(T.LongType()))])))
    n = known.where("listed").count()
    want = max(least, math.ceil(share * n))
    depth = max(0, min(bits, int(math.log2(max(1.0, trees * n / want)))) - 2)

    strings = known.select("id", "asks", "listed", F.posexplode("keys").alias("tree", "key")).withColumn("prefix", F.shiftright("key", bits - depth) if depth else F.lit(0).cast("long"))
    load = strings.groupBy("tree", "prefix").agg(F.count_if("listed").alias("points"), F.count_if("asks").alias("queries"))
    load = cut(load.select("tree", "prefix", F.ceil(F.greatest(F.lit(1), F.col("points")) / block).cast("int").alias("salts"), F.ceil(F.greatest(F.lit(1), F.col("queries")) / block).cast("int").alias("parts")))
    keyed = ["tree", "prefix", "salt", "part"]
    spread = lambda df, mine, other: df.select("*", F.pmod(F.xxhash64("id"), F.col(mine)).cast("int").alias(mine[:-1]), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other[:-1]))
    points = spread(strings.where("listed").join(load, ["tree", "prefix"]), "salts", "parts")
    asked = spread(strings.where("asks").join(load, ["tree", "prefix"]), "parts", "salts")

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = np.sort(left["key"].to_numpy())
        q = right["key"].to_numpy()
        found = [np.searchsorted(keys, ((q >> s) + 1) << s) - np.searchsorted(keys, (q >> s) << s) for s in range(bits - depth, -1, -1)]
        counts = np.stack(found, axis=1).astype(np.int64) if len(q) else np.zeros((0, bits - depth + 1), np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1, dtype=np.int32) * counts.shape[1]), pa.array(counts.ravel()))
        return pa.table({"id": right["id"], "counts": lists})

    counted = points.select(*keyed, "key").groupBy(*keyed).cogroup(renewed(asked.select(*keyed, "id", "key")).groupBy(*keyed)).applyInArrow(count, "id long, counts array<long>")
    levels = counted.select("id", F.posexplode("counts").alias("at", "c")).groupBy("id", "at").agg(F.sum("c").alias("c")).where(F.col("c") >= want)
    levels = cut(levels.groupBy("id").agg(F.max("at").alias("at")))
    vecs = known.select(F.col("id").alias("vec_id"), "vec")
    asking = known.where("asks").select("id", "vec", "keys").join(levels, "id", "left")
    normal = asking.where(F.col("at").isNotNull()).select("id", "vec", (F.lit(bits - depth) - F.col("at")).alias("shift"), F.posexplode("keys").alias("tree", "key"))
    normal = normal.withColumn("prefix", F.shiftright("key", bits - depth) if depth else F.lit(0).cast("long"))
    rare = asking.where(F.col("at").isNull()).select("id", "vec", F.lit(bits).alias("shift"), F.lit(0).alias("tree"), F.lit(0).cast("long").alias("key"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2**depth - 1).cast("long"))).alias("prefix"))
    queries = spread(normal.unionByName(rare).join(load, ["tree", "prefix"]), "parts", "salts")

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, ids = left["key"].to_numpy(), left["id"].to_numpy()
        order = np.argsort(keys, kind="stable")
        keys, ids = keys[order], ids[order]
        x = left["vec"].combine_chunks().flatten().to_numpy().reshape(len(ids), dim)[order] if len(ids) else np.zeros((0, dim))
        y = right["vec"].combine_chunks().flatten().to_numpy().reshape(len(right), dim) if len(right) else np.zeros((0, dim))
        got: list[list] = [[], [], []]
        for q, v, key, shift in zip(right["id"].to_pylist(), y, right["key"].to_pylist(), right["shift"].to_pylist()):
            a, b = np.searchsorted(keys, [(key >> shift) << shift, ((key >> shift) + 1) << shift])
            near = np.sqrt(((x[a:b] - v) ** 2).sum(axis=1))
            some = ids[a:b]
            near[some == q] = np.inf
            if len(near) > k:
                edge = np.partition(near, k - 1)[k - 1]
                pick = np.flatnonzero(near <= edge)
            else:
                pick = np.arange(len(near))
            pick = pick[np.lexsort((some[pick], near[pick]))][:k]
            pick = pick[some[pick] != q]
            got[0] += [q] * len(pick)
            got[1] += some[pick].tolist()
            got[2] += near[pick].tolist()
        return pa.table({"query_id": pa.array(got[0], pa.int64()), "vec_id": pa.array(got[1], pa.int64()), "score": pa.array(got[2], pa.float64())})

    full = points.select(*keyed, "id", "key").join(vecs, F.col("id") == F.col("vec_id")).select(*keyed, "id", "key", "vec")
    found = full.groupBy(*keyed).cogroup(renewed(queries.select(*keyed, "id", "vec", "key", "shift")).groupBy(*keyed)).applyInArrow(rank, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
