"""Vector search and embedding."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.store import upsert_replace
from corpusloom.plans.scan import top_k
from corpusloom.plans.session import cut

MAX_CELLS = 256
BLOCK_ROWS = 100_000
#: Groups of cells at least: a query is sent once to each, however many of its cells it must search.
MIN_GROUPS = 16


def _assigner(pivots: np.ndarray, id_col: str, keep_all: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Per batch: angle of every vector to its nearest pivot, or to all of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            m = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["embedding"]])
            n = np.linalg.norm(m, axis=1, keepdims=True)
            unit = np.divide(m, n, out=np.zeros_like(m), where=n > 0)
            angle = np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0))
            out = {id_col: pdf[id_col], "embedding": pdf["embedding"]}
            cell = angle.argmin(axis=1)
            out["cell"] = cell.astype("int32")
            if keep_all:
                out["angles"] = list(angle)
            else:
                out["angle"] = angle[np.arange(len(cell)), cell]
            yield pd.DataFrame(out)

    return run


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int, threshold: float = 0.2) -> DataFrame:
    """Exact cosine top-k: ``(query_id, rank, id, distance)`` with ``distance`` (cosine) >= threshold.

    ``queries(query_id, embedding)``, ``vectors(id, embedding)``.  Vectors are put into cells around
    pivot vectors.  A query first searches its own cell, which gives a lower bound for its k-th hit;
    by the triangle inequality of angles a cell whose best possible cosine stays below that bound is
    skipped, every other cell is searched.  Cells lie in groups; a task gets one block of queries, each
    with its cells, and one group of vectors, and returns the best ``k`` per query of that block.
    """
    n = vectors.count()
    cells = max(1, min(MAX_CELLS, int(math.sqrt(n))))
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(cells).select("embedding").collect()
    if not rows:
        return queries.select("query_id", F.lit(0).alias("rank"), F.lit(None).alias("id"), F.lit(0.0).alias("distance")).limit(0)
    pivots = np.array([r[0] for r in rows], dtype=np.float64)
    norms = np.linalg.norm(pivots, axis=1, keepdims=True)
    pivots = np.divide(pivots, norms, out=np.zeros_like(pivots), where=norms > 0)
    vt, qt = (dict(df.dtypes)[c] for df, c in ((vectors, "id"), (queries, "query_id")))
    et = dict(vectors.dtypes)["embedding"]
    v = cut(vectors.select("id", "embedding").mapInPandas(_assigner(pivots, "id", False), f"id {vt}, embedding {et}, cell int, angle double"))
    q = cut(queries.select("query_id", "embedding").mapInPandas(_assigner(pivots, "query_id", True), f"query_id {qt}, embedding {et}, cell int, angles array<double>"))
    nq = q.count()
    blocks = max(1, -(-nq // BLOCK_ROWS))
    # at most MAX_CELLS rows; a cell of many vectors stands in several groups, small cells share one
    stats = v.groupBy("cell").agg(F.max("angle").alias("radius"), F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("splits"), F.count(F.lit(1)).alias("n")).collect()
    groups = max(MIN_GROUPS, -(-2 * n // BLOCK_ROWS))
    radius, places = [None] * cells, [[] for _ in range(cells)]
    parts = sorted((-r["n"] // r["splits"], r["cell"]) for r in stats for _ in range(r["splits"]))
    for i, (_size, cell) in enumerate(parts):
        places[cell].append(i % groups)
    for r in stats:
        radius[r["cell"]] = r["radius"]
    groups_of = F.array(*[F.array(*map(F.lit, g)).cast("array<int>") for g in places])
    radii = F.array(*[F.lit(r).cast("double") for r in radius])
    mine = F.get(groups_of, F.col("cell"))
    split = (
        v.withColumn("grp", F.get(mine, F.pmod(F.xxhash64("id"), F.size(mine)).cast("int")))
        .withColumn("qs", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .select("grp", "qs", "cell", "id", "embedding")
    )
    key = ["grp", "qs"]

    def search(probe: DataFrame) -> DataFrame:
        """``probe(query_id, embedding, cells, floor)``: a query goes once to each group that holds one of its cells."""
        of_cells = F.array_distinct(F.flatten(F.transform("cells", lambda c: F.get(groups_of, c))))
        spread = probe.withColumn("grp", F.explode(of_cells)).withColumn("qs", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        here = F.filter("cells", lambda c: F.array_contains(F.get(groups_of, c), F.col("grp")))
        left = spread.select(*key, "query_id", "embedding", here.alias("cells"), "floor").groupBy(*key)
        return left.cogroup(split.groupBy(*key)).applyInPandas(_block_top_k(k, threshold), f"query_id {qt}, id {vt}, distance double")

    order = [F.desc(F.round("distance", 6)), F.col("id")]
    own = q.where(F.get(radii, F.col("cell")).isNotNull())
    home = cut(top_k(search(own.select("query_id", "embedding", F.array("cell").alias("cells"), F.lit(-1.0).alias("floor"))), "query_id", order, k))
    bound = home.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("distance")).alias("kth"))
    floor = F.coalesce("kth", F.lit(-1.0))

    def near_enough(c):
        best = F.cos(F.greatest(F.lit(0.0), F.get("angles", c) - F.get(radii, c))) + 2e-6
        return (c != F.col("cell")) & F.coalesce(best >= F.greatest(F.lit(threshold), floor), F.lit(False))

    others = F.filter(F.sequence(F.lit(0), F.lit(cells - 1)), near_enough)
    far = q.join(bound, "query_id", "left").select("query_id", "embedding", others.alias("cells"), floor.alias("floor"))
    hits = home.select("query_id", "id", "distance").unionByName(search(far))
    return top_k(hits, "query_id", order, k).select("query_id", "rank", "id", "distance")


def _block_top_k(k: int, threshold: float):
    """Top ``k`` of every query in its cells of one group: matrix products, of which only what reaches the query's floor,
    the k-th best known so far, is ranked."""

    def unit(col: pd.Series) -> np.ndarray:
        m = np.stack([np.asarray(x, dtype=np.float64) for x in col])
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "id": [], "distance": []}
        if len(queries) and len(vectors):
            vectors = vectors.sort_values("id", kind="stable")
            vm, ids, cell = unit(vectors["embedding"]), vectors["id"].to_numpy(), vectors["cell"].to_numpy()
            at_cell = {int(c): np.flatnonzero(cell == c) for c in np.unique(cell)}
            for start in range(0, len(queries), 512):
                part = queries.iloc[start : start + 512]
                qm, floor = unit(part["embedding"]), part["floor"].to_numpy() - 2e-6
                wanted = {}
                for i, cells in enumerate(part["cells"]):
                    for c in cells:
                        wanted.setdefault(int(c), []).append(i)
                who, what, near = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
                for c, asking in wanted.items():
                    asking, members = np.array(asking), at_cell.get(c, np.zeros(0, np.int64))
                    for low in range(0, len(members), 8192):
                        some = members[low : low + 8192]
                        sims = qm[asking] @ vm[some].T
                        i, j = np.nonzero(sims >= np.maximum(threshold, floor[asking])[:, None])
                        if not len(i):
                            continue
                        who, what, near = np.append(who, asking[i]), np.append(what, some[j]), np.append(near, sims[i, j])
                        ranked = np.lexsort((what, -np.round(near, 6), who))
                        first = np.searchsorted(who[ranked], who[ranked])
                        place = np.arange(len(ranked)) - first
                        kth = ranked[place == k - 1]
                        floor[who[kth]] = np.maximum(floor[who[kth]], near[kth] - 2e-6)
                        ranked = ranked[place < k]
                        who, what, near = who[ranked], what[ranked], near[ranked]
                out["query_id"].append(part["query_id"].to_numpy()[who])
                out["id"].append(ids[what])
                out["distance"].append(near)
        # an empty block must keep the column kinds
        kinds = {"query_id": object, "id": object, "distance": "float64"}
        return pd.DataFrame({c: pd.Series(np.concatenate(x) if x else [], dtype=kinds[c]) for c, x in out.items()})

    return run


# --- embedding ------------------------------------------------------------------------------------


def hashed_embedder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Default embedder: signed feature hashing of words and character trigrams, unit length."""
    import re
    import zlib

    word = re.compile(r"\w+")

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, text in enumerate(texts):
            for w in word.findall(text.lower()):
                for f in (w, *(w[j : j + 3] for j in range(len(w) - 2))):
                    h = zlib.crc32(f.encode("utf-8"))
                    out[i, h % dim] += 1.0 if (h >> 16) & 1 else -1.0
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=out, where=n > 0)

    return embed


def feature_vectors(rows: DataFrame, key: str = "id", content: str = "content", dim: int = 64) -> DataFrame:
    """``(key, embedding array<double>)``: what ``hashed_embedder`` computes, without Python and in double precision.

    Words and their trigrams become (slot, sign) by crc32. They are summed per row and slot before the shuffle, so a text
    of any length sends at most ``dim`` numbers. Null texts and texts without words give zeros; ``key`` names the row.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(content), F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    grams = lambda w: F.concat(F.array(w), F.when(F.length(w) > 2, F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda j: F.substring(w, j, F.lit(3)))).otherwise(F.array().cast("array<string>")))
    found = rows.select(key, F.explode_outer(F.flatten(F.transform(words, grams))).alias("feature")).withColumn("h", F.crc32("feature"))
    sign = F.when(F.shiftright("h", 16) % 2 == 1, 1).otherwise(-1)
    sums = found.groupBy(key, (F.col("h") % dim).cast("int").alias("slot")).agg(F.sum(F.when(F.col("h").isNotNull(), sign)).alias("v"))
    held = F.map_from_entries(F.filter(F.collect_list(F.struct("slot", F.col("v").cast("double"))), lambda e: e["slot"].isNotNull()))  # at most dim
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")))
    dense = sums.groupBy(key).agg(held.alias("m"), norm.alias("norm"))
    at = lambda k: F.when(F.col("norm") > 0, F.coalesce(F.try_element_at("m", k), F.lit(0.0)) / F.col("norm")).otherwise(F.lit(0.0))
    return dense.select(key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), at).alias("embedding"))


def embed(rows: DataFrame, embedder: Callable[[list[str]], np.ndarray], content: str = "content", batch: int = 32) -> DataFrame:
    """Add ``embedding`` by calling ``embedder`` on batches inside the tasks; a wrong number of
    vectors is an error."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", embedding array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vecs = []
            texts = pdf[content].fillna("").tolist()
            for i in range(0, len(texts), batch):
                part = texts[i : i + batch]
                got = np.asarray(embedder(part), dtype=np.float32)
                if len(got) != len(part):
                    raise ValueError(f"embedder gave {len(got)} vectors for {len(part)} texts")
                vecs.extend(got)
            yield pdf.assign(embedding=vecs)

    return rows.mapInPandas(run, schema)


def embed_and_upsert(base: DataFrame | None, rows: DataFrame, embedder: Callable[[list[str]], np.ndarray] | None = None, key: str = "id", batch: int = 32) -> DataFrame:
    """Embed ``rows(id, content, …)`` and replace the rows of ``base`` that have the same id; without an embedder by
    ``feature_vectors``."""
    fresh = rows.join(feature_vectors(rows, key), key) if embedder is None else embed(rows, embedder, "content", batch)
    return fresh if base is None else upsert_replace(base, fresh, key)
