"""Running numbers, sums and maxima over groups of any size.

A plain window over ``partitionBy(key)`` sorts a whole group in one task, which
fails when one key holds a large share of the rows.  ``prefix_scan`` cuts the
rows into ranges of (key, order) that spread a hot key over many tasks, scans
inside each range and adds the totals of the ranges before it.  The ranges are
literals in the plan, so a recomputed task sees the same cut.  When the sample
shows that the whole input is smaller than the sample itself, the plain window
is used instead: its size is then proven.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_ROWS = 4096


def _names(cols: Sequence[str] | str) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def range_edges(df: DataFrame, cols: list[str], buckets: int, sample_rows: int = SAMPLE_ROWS):
    """Cut points of an even split by ``cols``, or None when the input fits into the sample.

    The sample is the rows with the smallest key hashes: a top-n, never a full collect.
    """
    rows = (
        df.select(*cols)
        .orderBy(F.xxhash64(*cols))
        .limit(sample_rows)
        .select(F.struct(*cols).alias("k"))
        .sort("k")
        .collect()
    )
    if len(rows) < sample_rows:
        return None
    step = max(1, len(rows) // buckets)
    edges, last = [], None
    for i in range(step, len(rows), step):
        key = tuple(rows[i]["k"])
        if key != last:
            edges.append(key)
            last = key
    return edges


def _bucket(key: Column, edges: list[Column], base: int = 0) -> Column:
    if not edges:
        return F.lit(base)
    mid = len(edges) // 2
    return F.when(key < edges[mid], _bucket(key, edges[:mid], base)).otherwise(
        _bucket(key, edges[mid + 1 :], base + mid + 1)
    )


def prefix_scan(
    df: DataFrame,
    keys: Sequence[str] | str,
    order: Sequence[str] | str,
    *,
    row_number: str | None = None,
    sums: Mapping[str, str] | None = None,
    maxes: Mapping[str, str] | None = None,
    buckets: int | None = None,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Add inclusive running results per ``keys`` in ascending ``order``.

    ``sums`` and ``maxes`` map new column names to input columns.  ``order`` should
    make rows of a group distinct; input columns must be orderable.
    """
    keys, order = _names(keys), _names(order)
    sums, maxes = dict(sums or {}), dict(maxes or {})
    if buckets is None:
        buckets = min(256, max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cols = list(dict.fromkeys(keys + order))
    edges = range_edges(df, cols, buckets, sample_rows)

    def running(frame: DataFrame, part: list[str]) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(*order)
        up_to = w.rowsBetween(Window.unboundedPreceding, 0)
        out = frame
        if row_number:
            out = out.withColumn(row_number, F.row_number().over(w).cast("long"))
        for name, col in sums.items():
            out = out.withColumn(name, F.sum(col).over(up_to))
        for name, col in maxes.items():
            out = out.withColumn(name, F.max(col).over(up_to))
        return out

    if edges is None:
        return running(df, keys)

    types = {f.name: f.dataType for f in df.select(*cols).schema.fields}
    key = F.struct(*cols)
    literal_edges = [
        F.struct(*[F.lit(v).cast(types[c]).alias(c) for c, v in zip(cols, edge)]) for edge in edges
    ]
    cut = df.withColumn("_range", _bucket(key, literal_edges))
    part = keys + ["_range"]
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.sum(c).alias(f"_s_{n}") for n, c in sums.items()]
    aggs += [F.max(c).alias(f"_m_{n}") for n, c in maxes.items()]
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*part)
        .agg(*aggs)
        .select(
            *[F.col(c).alias(f"_k_{c}") for c in part],
            F.sum("_n").over(before).alias("_o_n"),
            *[F.sum(f"_s_{n}").over(before).alias(f"_o_{n}") for n in sums],
            *[F.max(f"_m_{n}").over(before).alias(f"_o_{n}") for n in maxes],
        )
    )
    local = running(cut, part)
    cond = F.lit(True)
    for c in part:
        cond = cond & local[c].eqNullSafe(F.col(f"_k_{c}"))
    out = local.join(offsets, cond, "left")
    if row_number:
        out = out.withColumn(
            row_number, F.col(row_number) + F.coalesce(F.col("_o_n"), F.lit(0))
        )
    for n in sums:
        both = F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col(f"_o_{n}"), F.lit(0))
        out = out.withColumn(n, F.when(F.col(n).isNull() & F.col(f"_o_{n}").isNull(), None).otherwise(both))
    for n in maxes:
        out = out.withColumn(n, _later(n))
    drop = ["_range", "_o_n", *[f"_k_{c}" for c in part], *[f"_o_{n}" for n in [*sums, *maxes]]]
    return out.drop(*drop)


def _later(n: str) -> Column:
    """Larger of the local and the earlier maximum (works for structs, nulls ignored)."""
    a, b = F.col(n), F.col(f"_o_{n}")
    return F.when(a.isNull() | (b > a), F.coalesce(b, a)).otherwise(a)


def neighbours(
    df: DataFrame,
    keys: Sequence[str] | str,
    order: Sequence[str] | str,
    cols: Mapping[str, str],
    offset: int,
    **kw,
) -> DataFrame:
    """lag (negative offset) / lead (positive) over groups of any size: number the rows, then
    join each row to the one ``offset`` places away."""
    keys = _names(keys)
    numbered = prefix_scan(df, keys, order, row_number="_rn", **kw)
    other = numbered.select(
        *[F.col(k).alias(f"_j_{k}") for k in keys],
        (F.col("_rn") - offset).alias("_jrn"),
        *[F.col(src).alias(name) for name, src in cols.items()],
    )
    cond = F.col("_rn") == F.col("_jrn")
    for k in keys:
        cond = cond & numbered[k].eqNullSafe(F.col(f"_j_{k}"))
    return numbered.join(other, cond, "left").drop("_rn", "_jrn", *[f"_j_{k}" for k in keys])


def ordered_parts(
    df: DataFrame,
    keys: Sequence[str] | str,
    order: Sequence[str] | str,
    value: str,
    out: str = "items",
    part_rows: int = 10_000,
) -> DataFrame:
    """Ordered list of ``value`` per group, in numbered parts of at most ``part_rows`` items.

    Groups up to ``part_rows`` give one part (``part_no`` 0).  The size of the largest group
    is checked first; only if it is too large are the rows numbered and cut into parts.
    """
    keys, order = _names(keys), _names(order)
    top = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if top <= part_rows:
        src = df.withColumn("part_no", F.lit(0).cast("long"))
    else:
        src = prefix_scan(df, keys, order, row_number="_rn").withColumn(
            "part_no", F.floor((F.col("_rn") - 1) / part_rows)
        )
    packed = F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("_value"))))
    return src.groupBy(*keys, "part_no").agg(packed.alias("_packed")).select(
        *keys, "part_no", F.col("_packed._value").alias(out)
    )


def joined_parts(parts: DataFrame, keys: Sequence[str] | str, items: str) -> DataFrame:
    """One list per group from ordered_parts, for callers whose result is one value per group by nature."""
    keys = _names(keys)
    whole = F.sort_array(F.collect_list(F.struct("part_no", items)))
    return parts.groupBy(*keys).agg(F.flatten(F.transform(whole, lambda p: p[items])).alias(items))


def top_k(df: DataFrame, keys: Sequence[str] | str, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group; Spark pushes the limit below the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*_names(keys)).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
