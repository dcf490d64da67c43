"""Lexical scores, candidate lists and BM25."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.plans.scan import prefix_scan, top_k
from corpusloom.plans.session import cut
from corpusloom.plans.textjoin import best_overlaps, contained_pairs

POSTING_ROWS = 2_000_000


def lexical_score(query: Column, content: Column) -> Column:
    """Containment (100 + length, at most 120) or distinct-character coverage of the query (at most 45)."""

    def scored(p: Column) -> Column:
        q, c = p["q"], p["c"]
        chars = tx.char_set(q)
        shared = F.size(F.array_intersect(chars, tx.char_set(c)))
        head = F.when(c.startswith(F.substring(q, 1, 2)), F.lit(5.0)).otherwise(F.lit(0.0))
        return (
            F.when((q == "") | (c == ""), F.lit(0.0))
            .when(F.instr(c, q) > 0, 100.0 + F.least(F.length(q), F.lit(20)))
            .when(shared < 2, F.lit(0.0))
            .otherwise(F.round(shared / F.size(chars) * 40.0 + head, 4))
        )

    return tx.let(F.struct(tx.alias_norm(query).alias("q"), tx.alias_norm(content).alias("c")), scored)


def candidate_ids(seeds: DataFrame, vector_hits: DataFrame, queries: DataFrame, chunks: DataFrame, scan_limit: int) -> DataFrame:
    """Ordered distinct candidates per query ``(query_id, ord, chunk_id)``: seeds, vector hits, then
    the first chunks of the corpus, ``scan_limit`` in all.

    ``seeds`` and ``vector_hits`` are ``(query_id, rank, chunk_id)``, ``chunks(chunk_id, ord)``.  Only
    the first ``scan_limit`` corpus chunks can be candidates, a list bounded by that parameter.
    """
    head = chunks.select("chunk_id", "ord").orderBy("ord").limit(scan_limit)
    numbered = prefix_scan(head.withColumn("_all", F.lit(0)), "_all", "ord", row_number="rank").select("_all", "chunk_id", "rank")
    places = queries.select("query_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(scan_limit).cast("long"))).alias("rank"))
    everyone = places.join(numbered.withColumn("rank", F.col("rank").cast("long")), "rank").select("query_id", F.lit(3).alias("src"), "rank", "chunk_id")
    given = [df.select("query_id", F.lit(i).alias("src"), F.col("rank").cast("long").alias("rank"), tx.strip(F.col("chunk_id")).alias("chunk_id")) for i, df in ((1, seeds), (2, vector_hits))]
    merged = given[0].unionByName(given[1]).unionByName(everyone).where("chunk_id <> ''")
    firsts = merged.groupBy("query_id", "chunk_id").agg(F.min(F.struct("src", "rank")).alias("o"))
    return top_k(firsts, "query_id", [F.col("o")], scan_limit, "ord").select("query_id", "ord", "chunk_id")


def lexical_top_k_of(candidates: DataFrame, queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Best candidates per query ``(query_id, rank, chunk_id, lexical_score)`` of an explicit list."""
    j = candidates.join(queries.select("query_id", "query"), "query_id").join(chunks.select("chunk_id", "content"), "chunk_id")
    scored = j.select("query_id", "chunk_id", "ord", lexical_score(F.col("query"), F.col("content")).alias("lexical_score")).where("lexical_score > 0")
    return top_k(scored, "query_id", [F.desc("lexical_score"), F.col("ord")], k).select("query_id", "rank", "chunk_id", "lexical_score")


def lexical_top_k(queries: DataFrame, chunks: DataFrame, k: int, salts: int = 8) -> DataFrame:
    """Best chunks per query over the whole corpus, ties by ``chunks.ord``.

    Chunks that contain the query come from a substring join.  The coverage score depends only on
    the two character sets and on whether the heads agree, so queries and chunks are grouped by
    those; the best groups per query group come from a pruned inverted index, and per group only the
    first ``k`` chunks can be in the result.
    """
    q = queries.select("query_id", tx.alias_norm(F.col("query")).alias("qn")).where("qn <> ''")
    c = cut(chunks.select("chunk_id", "ord", tx.alias_norm(F.col("content")).alias("cn")).where("cn <> ''"))
    inside = (
        contained_pairs(q.select("qn"), c.select("cn"), "qn", "cn").join(q, "qn").join(c, "cn")
        .select("query_id", "chunk_id", "ord", (100.0 + F.least(F.length("qn"), F.lit(20))).alias("lexical_score"))
    )

    def signed(df: DataFrame, col: str, key: str) -> DataFrame:
        return df.withColumn("items", F.array_sort(tx.char_set(F.col(col)))).withColumn("head", F.substring(col, 1, 2)).withColumn(
            key, F.sha2(F.concat_ws("/", "head", F.array_join("items", "")), 256)
        )

    qs, cs = cut(signed(q, "qn", "qkey").drop("qn")), cut(signed(c, "cn", "ckey").drop("cn"))
    qg = qs.groupBy("qkey", "items", "head").agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    cg = cs.groupBy("ckey", "items", "head").agg(F.min("ord").alias("first_ord"))
    best = best_overlaps(qg, cg, k, 40.0, 5.0, salts).select("qkey", "ckey", F.col("score").alias("lexical_score"))
    firsts = top_k(cs.select("ckey", "chunk_id", "ord"), "ckey", [F.col("ord")], k, "_m").drop("_m")
    near = best.join(firsts, "ckey").join(qs.select("query_id", "qkey"), "qkey").select("query_id", "chunk_id", "ord", "lexical_score")
    merged = inside.unionByName(near).groupBy("query_id", "chunk_id", "ord").agg(F.max("lexical_score").alias("lexical_score"))
    return top_k(merged, "query_id", [F.desc("lexical_score"), F.col("ord")], k).select("query_id", "rank", "chunk_id", "lexical_score")


# --- BM25 -------------------------------------------------------------------------------------------


@dataclass
class Bm25Index:
    """``postings(term, chunk_id, ord, gain)``, ``terms(term, df, idf, peak)`` and the largest df.

    ``gain`` is what a posting adds for a weight of one, ``peak`` its largest value of the term.
    """

    postings: DataFrame
    terms: DataFrame
    max_df: int


def _idf(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def _gain(tf: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def _term_counts(tokens: Column) -> Column:
    """``array<struct<term, tf>>`` of a token array: runs of the sorted array, so a row counts its terms without a shuffle."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return tx.let(starts, lambda at: F.transform(at, lambda x, j: F.struct(F.get(s, x).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(s)) - x).cast("long").alias("tf"))))

    return F.when(F.size(tokens) > 0, tx.let(F.sort_array(tokens), runs)).otherwise(F.array().cast("array<struct<term:string,tf:bigint>>"))


def _packed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, dl, terms)`` of the rows of ``rows(*keys, t)`` that have tokens."""
    # written before it is filtered: a filter would be pushed down and analyse every text a second time
    return cut(rows.select(*keys, F.size("t").alias("dl"), _term_counts(F.col("t")).alias("terms"))).where("dl > 0")


def _merged(packed: DataFrame, keys: list[str]) -> DataFrame:
    """``_packed`` rows, those that agree in keys and length counted together.

    Such rows are rare; only theirs are grouped, and their terms stay apart, each in a list of its own.
    """
    by = [*keys, "dl"]
    again = cut(packed.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*[F.col(c).alias(f"_{c}") for c in by]))
    if again.isEmpty():
        return packed
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    parts = packed.join(again, same, "left_semi").select(*by, F.inline("terms")).groupBy(*by, "term").agg(F.sum("tf").alias("tf"))
    merged = cut(parts.select(*by, F.array(F.struct("term", "tf")).alias("terms")))
    return packed.join(again, same, "left_anti").unionByName(merged)


def bm25_index(chunks: DataFrame, analyser: Callable[[Column], Column] = tx.analyse, epsilon: float = 0.25, k1: float = 1.5, b: float = 0.75) -> Bm25Index:
    """Inverted index of ``chunks(chunk_id, ord, content)``; keep its tables to answer many batches.

    The postings are stored as one list per chunk, which needs no shuffle; ``postings`` unpacks them.
    """
    toks = chunks.select("chunk_id", "ord", analyser(F.col("content")).alias("t"))
    packed = _packed(toks, ["chunk_id", "ord"])
    n, total = packed.agg(F.count(F.lit(1)), F.sum("dl")).first()
    avgdl = F.lit(total / n if n else 1.0)
    postings = _merged(packed, ["chunk_id", "ord"]).select("chunk_id", "ord", "dl", F.inline("terms")).select("term", "chunk_id", "ord", _gain(F.col("tf"), F.col("dl"), avgdl, k1, b).alias("gain"))
    raw = cut(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("gain").alias("peak")).withColumn("idf", _idf(F.lit(float(n)), F.col("df"))))
    mean, max_df = raw.agg(F.avg("idf"), F.max("df")).first()
    # a term in more than half of the chunks gets a share of the mean instead of a negative weight
    terms = raw.withColumn("idf", F.when(F.col("idf") < 0, F.lit(epsilon * (mean or 0.0))).otherwise(F.col("idf")))
    return Bm25Index(postings, terms, max_df or 0)


def _hits(index: Bm25Index, weights: DataFrame) -> DataFrame:
    """``(query_id, chunk_id, ord, part, …)`` per posting of the terms of ``weights(query_id, term, w, …)``.

    Only postings of these terms are moved, once, to the task of their chunk: where the weights are small enough to be
    broadcast, the sums of ``_summed`` need no shuffle of pairs of queries and chunks. The postings of a frequent term
    are spread over as many splits as their number asks for.
    """
    splits = max(1, -(-index.max_df // POSTING_ROWS))
    p, on = index.postings.join(weights.select("term").distinct(), "term", "left_semi").repartition("chunk_id", "ord"), ["term"]
    if splits > 1:
        weights = weights.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
        p, on = p.withColumn("_s", F.pmod(F.xxhash64("chunk_id"), F.lit(splits)).cast("int")), ["term", "_s"]
    others = [c for c in weights.columns if c not in ("query_id", "term", "w", "_s")]
    return p.join(weights, on).select("query_id", "chunk_id", "ord", (F.col("w") * F.col("gain")).alias("part"), *others)


def _summed(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id", "chunk_id", "ord").agg(F.sum("part").alias("part"))


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(tx.keyword_terms(F.col("query"))).alias("term"))


def _weights(index: Bm25Index, terms: DataFrame) -> DataFrame:
    """``(query_id, term, df, w, peak)``: a term's weight counts each time the query names it."""
    q = terms.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf")).join(index.terms, "term")
    return q.select("query_id", "term", "df", (F.col("idf") * F.col("qf")).alias("w"), "peak")


def bm25_scores(index: Bm25Index, terms: DataFrame) -> DataFrame:
    """``(query_id, chunk_id, ord, score)``: all positive scores of ``terms(query_id, term)``."""
    return _summed(_hits(index, _weights(index, terms))).withColumn("score", F.round("part", 6)).drop("part").where("score > 0")


#: Postings per wanted row that the first look at a query's most valuable terms may read.
PROBE = 1000
#: Scores are rounded to six places; a bound has to miss by more than that.
SLACK = 2e-6


def bm25_plan(queries: DataFrame, index: Bm25Index, k: int) -> DataFrame:
    """``(query_id, term, df, w, must, tail, least)``: which postings a query has to read in full.

    A query's terms stand by the most that a posting of theirs can add. The rarest and heaviest of them (as many as
    ``PROBE * k`` postings hold, the first one always) give every query ``k`` chunks whose scores the k-th best final score
    cannot be below: the floor. A chunk that has none of the terms before some place can reach at most what the terms from
    there on add together; where that is below the floor, their postings need not be searched for new chunks (``must`` is
    false), only read for chunks found already. ``tail`` is the most that
    those terms can add, ``least`` (0 unless weights are negative) the least that all can.
    """
    w = _weights(index, query_terms(queries))
    top = F.greatest(F.col("w") * F.col("peak"), F.lit(0.0))
    by_top = Window.partitionBy("query_id").orderBy(F.desc("top"), "df", "term")  # the terms of one query text
    w = w.withColumn("top", top).withColumn("low", F.least(F.col("w") * F.col("peak"), F.lit(0.0)))
    before = by_top.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = by_top.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    w = w.withColumn("read", F.sum("df").over(before)).withColumn("rest", F.sum("top").over(onward)).withColumn("place", F.row_number().over(by_top))
    w = cut(w.withColumn("least", F.sum("low").over(Window.partitionBy("query_id"))))
    probe = _summed(_hits(index, w.where((F.col("read") <= PROBE * k) | (F.col("place") == 1)).select("query_id", "term", "w")))
    w = w.join(_floors(probe, w, k), "query_id", "left")
    must = F.coalesce(F.col("rest") >= F.col("floor"), F.lit(True))
    w = w.withColumn("must", must).withColumn("tail", F.coalesce(F.max(F.when(~must, F.col("rest"))).over(Window.partitionBy("query_id")), F.lit(0.0)))
    return w.select("query_id", "term", "df", "w", "must", "tail", "least")


def _floors(parts: DataFrame, w: DataFrame, k: int) -> DataFrame:
    """``(query_id, floor)``: what the k-th best score is at least, from sums over some terms; no row below k chunks."""
    best = top_k(parts, "query_id", [F.desc("part"), F.col("ord")], k).groupBy("query_id").agg(F.min("part").alias("kth"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k)
    least = w.groupBy("query_id").agg(F.first("least").alias("least"))
    return best.join(least, "query_id").select("query_id", (F.col("kth") + F.col("least") - SLACK).alias("floor"))


def bm25_reads(plan: DataFrame) -> DataFrame:
    """``(query_id, postings, searched)`` of a ``bm25_plan``: all postings of its terms, and those searched for chunks."""
    return plan.groupBy("query_id").agg(F.sum("df").alias("postings"), F.sum(F.when(F.col("must"), F.col("df")).otherwise(0)).alias("searched"))


def bm25_top_k(queries: DataFrame, index: Bm25Index, k: int = 4) -> DataFrame:
    """Best chunks per query ``(query_id, rank, chunk_id, bm25_score)``, ties by chunk order; exact (see ``bm25_plan``).

    A chunk's postings lie in one task, so its whole score is known at once; a chunk without a term that must be read
    cannot reach the floor and is not ranked.
    """
    plan = cut(bm25_plan(queries, index, k))
    hits = _hits(index, plan.select("query_id", "term", "w", "must"))
    sums = hits.groupBy("query_id", "chunk_id", "ord").agg(F.sum("part").alias("part"), F.bool_or("must").alias("must")).where("must and query_id is not null")
    scores = sums.withColumn("score", F.round("part", 6)).where("score > 0")
    return top_k(scores, "query_id", [F.desc("score"), F.col("ord")], k).select("query_id", "rank", "chunk_id", F.col("score").alias("bm25_score"))


def bm25_of_candidates(candidates: DataFrame, queries: DataFrame, chunks: DataFrame, k: int = 4, analyser: Callable[[Column], Column] = tx.analyse, epsilon: float = 0.25, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Best chunks per query among its own candidates, which are also the corpus that its statistics come from.

    ``candidates(query_id, ord, chunk_id)`` as of ``candidate_ids``; result as of ``bm25_top_k``, ties by candidate order.
    Terms are counted once per chunk. Chunks that are candidates of the same queries form a class; document frequencies are
    counted per class and term before they go to the queries, and only the terms that a query asks for meet its candidates.
    """
    lists = cut(candidates.where("query_id is not null and chunk_id is not null").groupBy("query_id", "chunk_id", "ord").agg(F.count(F.lit(1)).alias("times")))
    per = lists.groupBy("chunk_id", "query_id").agg(F.count(F.lit(1)).alias("places"), F.sum("times").alias("times"))
    classes = cut(per.groupBy("chunk_id").agg(_signature("query_id", "places", "times").alias("cls")))
    held = chunks.join(classes, "chunk_id").select("chunk_id", "cls", analyser(F.col("content")).alias("t"))
    packed = _packed(held, ["chunk_id", "cls"])
    rows = _merged(packed, ["chunk_id", "cls"])
    members = cut(per.join(classes.groupBy("cls").agg(F.min("chunk_id").alias("chunk_id")), "chunk_id").select("cls", "query_id", "places", "times"))
    # queries of the same classes share their frequencies; the first of them stands for all
    groups = cut(members.groupBy("query_id").agg(_signature("cls", "places", "times").alias("grp")))
    firsts = groups.groupBy("grp").agg(F.min("query_id").alias("query_id"))
    sizes = packed.groupBy("chunk_id", "dl").agg(F.count(F.lit(1)).alias("copies")).join(lists, "chunk_id").withColumn("n", F.col("times") * F.col("copies"))
    stats = cut(sizes.groupBy("query_id").agg(F.sum("n").alias("n"), (F.sum(F.col("dl") * F.col("n")) / F.sum("n")).alias("avgdl")))
    of_class = rows.select("cls", F.inline("terms")).groupBy("cls", "term").agg(F.count(F.lit(1)).alias("df")).join(members.join(firsts, "query_id").drop("query_id"), "cls")
    df = of_class.groupBy("grp", "term").agg(F.sum(F.col("df") * F.col("places")).alias("df"))
    raw = cut(df.join(firsts.join(stats, "query_id").select("grp", "n"), "grp").withColumn("idf", _idf(F.col("n"), F.col("df"))))
    mean = raw.groupBy("grp").agg(F.avg("idf").alias("mean"))
    asked = query_terms(queries).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf")).join(groups, "query_id")
    w = raw.join(asked, ["grp", "term"]).join(mean, "grp").join(stats.select("query_id", "avgdl"), "query_id")
    w = cut(w.withColumn("w", F.col("qf") * F.when(F.col("idf") < 0, epsilon * F.col("mean")).otherwise(F.col("idf"))).select("query_id", "term", "w", "avgdl"))
    tf = rows.select("chunk_id", "dl", F.inline("terms")).join(w.select("term").distinct(), "term", "left_semi").join(lists, "chunk_id")
    part = F.col("w") * _gain(F.col("tf") * F.col("times"), F.col("dl"), F.col("avgdl"), k1, b)
    scores = _summed(tf.join(w, ["query_id", "term"]).withColumn("part", part)).withColumn("score", F.round("part", 6)).where("score > 0")
    return top_k(scores, "query_id", [F.desc("score"), F.col("ord")], k).select("query_id", "rank", "chunk_id", F.col("score").alias("bm25_score"))


def _signature(*cols: str) -> Column:
    """Aggregate that tells sets of rows apart (two 64-bit hashes and their number), whatever the size of a set."""
    ways = [F.xxhash64(*[F.col(c) for c in cols]), F.xxhash64(F.lit(7), *[F.col(c) for c in reversed(cols)])]
    return F.concat_ws("/", *[F.bit_xor(h).cast("string") for h in ways], F.count(F.lit(1)).cast("string"))
