import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import context as cx
from corpusloom.operators import lexical as lx
from corpusloom.operators import plugins as pl
from corpusloom.operators import retrieval as rt
from corpusloom.operators import seeding as sd
from corpusloom.operators import vectors as vx
from corpusloom.plans import textjoin
from corpusloom.plans.textjoin import contained_pairs, overlap_counts

CHUNKS = [
    ("chunk-a", "主机无法启动，先检查燃油系统和蓄电池。"),
    ("chunk-b", "燃油电磁阀故障会导致主机启动困难。"),
    ("chunk-c", "舵机压力异常时优先检查液压泵和滤芯。"),
    ("chunk-d", "电磁阀卡滞会造成燃油供应不足。"),
]


def chunk_frame(spark):
    return spark.createDataFrame([(c, i, t) for i, (c, t) in enumerate(CHUNKS)], "chunk_id string, ord int, content string")


def brute_score(query, content):
    def norm(s):
        import re

        return re.sub(r"[\s\W_]+", "", re.sub(r"[（(].*?[）)]", "", s.strip())).lower()

    q, c = norm(query), norm(content)
    if not q or not c:
        return 0.0
    if q in c:
        return 100.0 + min(len(q), 20)
    shared = len(set(q) & set(c))
    if shared < 2:
        return 0.0
    return round(shared / len(set(q)) * 40 + (5 if c.startswith(q[:2]) else 0), 4)


def test_lexical_prefers_matching_chunk(spark):
    df = spark.createDataFrame([("电磁阀怎么检查", "电磁阀卡滞会造成燃油供应不足", "舵机压力异常时优先检查液压泵")], "q string, a string, b string")
    r = df.select(lx.lexical_score(F.col("q"), F.col("a")).alias("a"), lx.lexical_score(F.col("q"), F.col("b")).alias("b")).first()
    assert r.a > r.b > 0


@pytest.mark.parametrize("alphabet", ["主机阀泵油压力检查故障启动液舵滤芯电磁", "abcdefghijklmnopqrstuvwxyz0123456789éèü"])
def test_lexical_top_k_equals_brute_force(spark, alphabet):
    rng = random.Random(5)
    text = lambda lo, hi: "".join(rng.choice(alphabet) for _ in range(rng.randint(lo, hi)))
    chunks = [(f"c{i}", i, text(3, 25)) for i in range(150)]
    queries = [(f"q{i}", text(2, 8)) for i in range(25)] + [("inside", chunks[7][2][1:3])]
    got = lx.lexical_top_k(spark.createDataFrame(queries, "query_id string, query string"), spark.createDataFrame(chunks, "chunk_id string, ord int, content string"), 4, salts=3).collect()
    for qid, q in queries:
        want = sorted(((-brute_score(q, c), o, cid) for cid, o, c in chunks if brute_score(q, c) > 0))[:4]
        mine = sorted(((r.rank, r.chunk_id, r.lexical_score) for r in got if r.query_id == qid))
        assert [(c, -s) for s, _o, c in want] == [(c, s) for _r, c, s in mine]


def test_overlap_counts_with_many_items(spark):
    rng = random.Random(3)
    items = [chr(0x4E00 + i) for i in range(120)]  # more than the bit mask holds
    a = [(f"a{i}", rng.sample(items, rng.randint(1, 30))) for i in range(30)]
    b = [(f"b{i}", rng.sample(items, rng.randint(1, 30))) for i in range(40)]
    out = overlap_counts(spark.createDataFrame(a, "l string, items array<string>"), spark.createDataFrame(b, "r string, items array<string>"), "l", "r", "items", 3)
    got = {(r.l, r.r): r.overlap for r in out.collect()}
    want = {(x, y): len(set(i) & set(j)) for x, i in a for y, j in b if len(set(i) & set(j)) >= 2}
    assert got == want


def test_contained_pairs_across_block_borders(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab主机") for _ in range(n)) for n in (5, 255, 256, 257, 700)]
    needles = [t[i : i + n] for t in texts for i, n in ((0, 1), (1, 3), (250, 12), (len(t) - 4, 4), (240, 40), (0, len(t))) if t[i : i + n]] + ["zz"]
    out = contained_pairs(spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame([(t,) for t in texts], "text string"))
    assert {(r.needle, r.text) for r in out.collect()} == {(n, t) for n in needles for t in texts if n in t}


def test_contained_pairs_moves_only_windows_that_can_start_a_needle(spark, monkeypatch):
    monkeypatch.setattr(textjoin, "PIECE", 64)  # a text lies in many pieces
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab主机é") for _ in range(n)) for n in (3, 63, 64, 65, 400, 400)] + ["x" * 300]
    needles = [t[i : i + n] for t in texts for i, n in ((0, 2), (1, 9), (20, 30), (30, 200), (0, len(t))) if t[i : i + n]] + ["none of these", "x"]
    moved = []
    heads_in = textjoin._heads_in

    def counting(*args):
        run = heads_in(*args)
        packed = pa.RecordBatch.from_pydict({"_tid": list(range(len(texts))), "text": texts})
        moved.append(sum(b.num_rows for b in run([packed])))
        return run

    monkeypatch.setattr(textjoin, "_heads_in", counting)
    hay = spark.createDataFrame([(t,) for t in texts + texts], "text string")
    for some in (needles, ["none of these"], []):
        out = contained_pairs(spark.createDataFrame([(n,) for n in some], "needle string"), hay).collect()
        assert sorted((r.needle, r.text) for r in out) == sorted((n, t) for n in set(some) for t in set(texts) if n in t)
    assert moved[0] < len(needles) * len(texts) and moved[1:] == [0, 0]  # every window of every text before


def test_vector_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(6, 16))
    vecs = np.concatenate([c + 0.2 * rng.normal(size=(60, 16)) for c in base] + [np.zeros((1, 16))])
    queries = vecs[::9] + 0.1
    v = spark.createDataFrame([(f"v{i:03d}", [float(x) for x in row]) for i, row in enumerate(vecs)], "id string, embedding array<double>")
    q = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(queries)], "query_id int, embedding array<double>")
    got = vx.vector_top_k(q, v, 5).collect()
    norm = np.linalg.norm(vecs, axis=1)
    for i, row in enumerate(queries):
        sims = np.divide(vecs @ row, norm * np.linalg.norm(row), out=np.zeros(len(vecs)), where=norm > 0)
        want = sorted((-round(float(s), 6), f"v{j:03d}") for j, s in enumerate(sims) if s >= 0.2)[:5]
        mine = sorted((r.rank, r.id) for r in got if r.query_id == i)
        assert [x for _s, x in want] == [x for _r, x in mine]


@pytest.mark.parametrize("block", [20, 200])
def test_vector_top_k_sends_a_query_once_to_a_group(spark, monkeypatch, block):
    rng = np.random.default_rng(2)
    vecs = rng.normal(size=(900, 16))  # no structure: nearly every one of the 30 cells has to be searched
    sent = []
    block_top_k = vx._block_top_k

    def counting(k, threshold):
        run, rows = block_top_k(k, threshold), spark.sparkContext.accumulator(0)
        sent.append(rows)

        def counted(queries, vectors):
            rows.add(len(queries))
            return run(queries, vectors)

        return counted

    monkeypatch.setattr(vx, "_block_top_k", counting)
    monkeypatch.setattr(vx, "BLOCK_ROWS", block)  # 20: cells of several splits, queries of several blocks
    monkeypatch.setattr(vx, "MIN_GROUPS", 4)
    monkeypatch.setattr(vx, "MAX_CELLS", 30)
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(vecs)]
    v = spark.createDataFrame([*rows, *rows[:5]], "id int, embedding array<double>")
    got = vx.vector_top_k(spark.createDataFrame(rows[::9], "query_id int, embedding array<double>"), v, 3).collect()
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    for q in range(0, 900, 9):
        near = [*enumerate(unit @ unit[q]), *enumerate(unit[:5] @ unit[q])]
        want = sorted((-round(float(x), 6), i) for i, x in near if x >= 0.2)[:3]
        assert [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [i for _x, i in want]
    assert block == 20 or sent[1].value <= 100 * 10  # of 30 cells; once for each cell before


def test_vector_search_ranks_only_what_reaches_the_floor():
    queries = pd.DataFrame({"query_id": [7], "embedding": [[1.0, 0.0]], "cells": [[0, 1]], "floor": [0.9]})
    vectors = pd.DataFrame({"cell": [0, 0, 1, 2], "id": [1, 2, 3, 4], "embedding": [[1.0, 1.0], [1.0, 0.1], [1.0, 0.0], [1.0, 0.0]]})
    out = vx._block_top_k(3, 0.2)(queries, vectors)
    assert sorted(out["id"]) == [2, 3]  # 1 lies below the floor, 4 in a cell that was not asked for


def test_hybrid_recall_fixture(spark):
    chunks = chunk_frame(spark)
    seeds = spark.createDataFrame([("q", 1, "chunk-a"), ("q", 2, "chunk-b")], "query_id string, rank int, chunk_id string")
    vec = spark.createDataFrame([("q", 1, "chunk-b", 0.11), ("q", 2, "chunk-c", 0.23)], "query_id string, rank int, chunk_id string, distance double")
    lexical = lx.lexical_top_k(spark.createDataFrame([("q", "电磁阀怎么检查")], "query_id string, query string"), chunks, 3)
    out = cx.hybrid_fuse(seeds, vec, lexical, chunks, 4).orderBy("rank").collect()
    ids = [r.chunk_id for r in out]
    assert ids[0] == "chunk-a" and len(ids) == len(set(ids)) and "chunk-b" in ids
    assert any("lexical" in r.sources for r in out)


def test_rerank_fixture(spark):
    c = spark.createDataFrame([("q", 1, "a", 10.0), ("q", 2, "b", 9.0), ("q", 3, "c", 8.0)], "query_id string, rank int, id string, score double")
    order = lambda df: [r.id for r in df.orderBy("rank").collect()]
    assert order(cx.rerank(c, F.col("score"), 2, enabled=False)) == ["a", "b", "c"]
    assert order(cx.rerank(c, -F.col("score"), 2)) == ["b", "a", "c"]

    def broken(_q, _t):
        raise RuntimeError

    assert order(cx.rerank(c, pl.pair_scorer(broken, "id", "id"), 2)) == ["a", "b", "c"]


def test_prompt_fits_window(spark):
    df = spark.createDataFrame([("上下文片段 " * 5000,)], "t string")
    n = df.select(tx.count_tokens(cx.fit_prompt(F.col("t"), F.lit(100), 1024)).alias("n")).first().n
    assert n + 100 <= 1024


def test_context_round_trip(spark):
    q = spark.createDataFrame([("q",)], "query_id string")
    e = spark.createDataFrame([("q", 1, "A", "EQUIPMENT", 1000.0, 'say "hi", ok')], "query_id string, rank int, entity_name string, entity_type string, score double, description string")
    s = spark.createDataFrame([("q", 1, "chunk-faultcase-x", "[记录ID] llm_038\n[设备] 泵, \"A\""), ("q", 2, "c2", "plain")], "query_id string, rank int, chunk_id string, content string")
    ctx = cx.build_context(q, e, s)
    r = ctx.select(cx.parse_context(F.col("context")).alias("ids"), cx.evidence_payload(F.col("context")).alias("e")).first()
    assert r.ids == ["chunk-faultcase-x", "llm_038", "c2"]
    assert r.e.status == "ready" and r.e.entity_count == 1 and len(r.e["items"]) == 2


def test_token_levenshtein(spark):
    def edit(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (x != y))
        return d[-1]

    rng = random.Random(2)
    pairs = [(" ".join(rng.choice("one two three four 阀".split()) for _ in range(rng.randint(1, 9))), " ".join(rng.choice("one two three five".split()) for _ in range(rng.randint(1, 9)))) for _ in range(40)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", cx.token_levenshtein(F.col("a"), F.col("b")).alias("s")).collect()
    for r in got:
        a, b = r.a.split(), r.b.split()
        assert abs(r.s - (1 - edit(a, b) / max(len(a), len(b)))) < 1e-9


def corpus(spark):
    nodes = spark.createDataFrame(
        [("主机系统", "EQUIPMENT", 1, "主机"), ("主机系统无法启动", "FAULTCASE", 2, "主机无法启动故障卡"), ("燃油电磁阀", "COMPONENT", 3, "阀"), ("舵机", "EQUIPMENT", 4, "舵")],
        "entity_name string, entity_type string, ord int, description string",
    )
    edges = spark.createDataFrame([("主机系统", "主机系统无法启动"), ("主机系统无法启动", "燃油电磁阀")], "src string, dst string")
    sources = spark.createDataFrame([("主机系统无法启动", "chunk-a"), ("舵机", "chunk-c")], "entity_name string, source_id string")
    chunks = chunk_frame(spark)
    emb = vx.embed(chunks.select(F.col("chunk_id").alias("id"), "content"), vx.hashed_embedder(32)).select("id", "embedding")
    return rt.Corpus(chunks, nodes, edges, sources, emb, None, lx.bm25_index(chunks))


def test_retrieve_by_mode(spark):
    qs = spark.createDataFrame(
        [("1", "主机系统无法启动怎么办", "graph_only"), ("2", "主机系统无法启动怎么办", "graph_text_hybrid"), ("3", "电磁阀怎么检查", "text_only"), ("4", "舵机压力", "keyword_search"), ("5", "zzz", "graph_only")],
        "query_id string, query string, mode string",
    )
    out = {r.query_id: r for r in rt.retrieve(qs, corpus(spark), embedder=vx.hashed_embedder(32)).collect()}
    assert out["1"].chunk_ids == ["chunk-a"]
    assert out["2"].chunk_ids[0] == "chunk-a" and "主机系统无法启动,FAULTCASE,1000.0" in out["2"].context
    assert "chunk-d" in out["3"].chunk_ids and "FAULTCASE" not in out["3"].context
    assert out["4"].chunk_ids == ["chunk-c"]
    # every fault card scores its bonus, so a graph question always has an entity
    assert "主机系统无法启动" in out["5"].context
    with pytest.raises(ValueError):
        rt.retrieve(qs.withColumn("mode", F.lit("nope")), corpus(spark))


def test_score_pair(spark):
    names = sd.node_names(spark.createDataFrame([("燃油系统", "EQUIPMENT", 1), ("卡滞（阀）", "FAULTCASE", 2), ("阀", "COMPONENT", 3)], "entity_name string, entity_type string, ord int"))
    got = {r.entity_name: r.s for r in names.select("entity_name", sd.pair_score(F.lit("燃油卡滞"), F.col("aliases"), F.col("entity_type")).alias("s")).collect()}
    assert (got["燃油系统"].score, got["燃油系统"].exact) == (1020.0, True)
    assert (got["卡滞（阀）"].score, got["卡滞（阀）"].exact) == (1025.0, True)
    assert (got["阀"].score, got["阀"].exact) == (0.0, False)


def test_bounded_bm25_equals_all_scores(spark):
    """The bounds leave out postings, never results; with ties, repeated query terms and fewer than k hits."""
    import random

    from corpusloom.operators import lexical as lx

    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    text = lambda n: " ".join(words[min(59, int(rng.expovariate(0.08)))] for _ in range(n))
    chunks = spark.createDataFrame([(f"c{i}", i, text(rng.randint(1, 60))) for i in range(400)] + [("copy", 400, "w59 w58"), ("copy2", 401, "w59 w58"), ("none", 402, "")], "chunk_id string, ord int, content string")
    queries = spark.createDataFrame([(i, text(rng.randint(2, 12))) for i in range(30)] + [(90, "w59 w58"), (91, "nowhere else"), (92, ""), (93, "w0 w1 w0")], "query_id int, query string")
    index = lx.bm25_index(chunks)
    lx.PROBE, before = 10, lx.PROBE
    try:
        got = {(r.query_id, r["rank"]): (r.chunk_id, r.bm25_score) for r in lx.bm25_top_k(queries, index, 4).collect()}
        reads = lx.bm25_reads(lx.bm25_plan(queries, index, 4)).agg({"postings": "sum", "searched": "sum"}).first()
    finally:
        lx.PROBE = before
    rows = {}
    for r in lx.bm25_scores(index, lx.query_terms(queries)).collect():
        rows.setdefault(r.query_id, []).append((-r.score, r.ord, r.chunk_id))
    want = {(q, k + 1): (c, -s) for q, rs in rows.items() for k, (s, _, c) in enumerate(sorted(rs)[:4])}
    assert got == want and reads["sum(searched)"] < reads["sum(postings)"]


def _brute_candidates(cands, queries, texts, k):
    """Scores of BM25 over each query's own candidate rows; rows that agree in order, id and length are one text."""
    import math
    from collections import Counter, defaultdict

    out = {}
    for qid, query in queries:
        rows = [(o, c, t.split()) for q, o, c in cands if q == qid for c2, t in texts if c2 == c and t]
        places = defaultdict(Counter)
        for o, c, t in rows:
            places[o, c, len(t)].update(t)
        n, avgdl = len(rows), sum(len(t) for _, _, t in rows) / max(1, len(rows))
        df = Counter(w for counts in places.values() for w in counts)
        idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) if n - d + 0.5 > 0 else math.nan for w, d in df.items()}
        mean = sum(idf.values()) / max(1, len(idf))
        score = Counter()
        for (o, c, dl), counts in places.items():
            for w in set(query.split()) & set(counts):
                score[o, c] += (0.25 * mean if idf[w] < 0 else idf[w]) * counts[w] * 2.5 / (counts[w] + 1.5 * (0.25 + 0.75 * dl / avgdl))
        best = sorted((-round(s, 6), o, c) for (o, c), s in score.items() if round(s, 6) > 0)[:k]
        out.update({(qid, i + 1): (c, -s) for i, (s, o, c) in enumerate(best)})
    return out


def test_bm25_of_candidates_counts_terms_once_per_chunk(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(80)]
    texts = [(f"c{i}", " ".join(rng.choice(words) for _ in range(rng.randint(3, 30)))) for i in range(60)]
    texts += [("c3", texts[3][1]), ("c4", " ".join(reversed(texts[4][1].split()))), ("c5", "w1 w2")]  # ids that come twice
    queries = [(i, " ".join(rng.sample(words, 6))) for i in range(40)]
    cands = [(q, o, f"c{o}") for q, _ in queries for o in range(60) if (o + q) % 2 == 0] + [(0, 4, "c4"), (1, 200, "c5")]
    args = spark.createDataFrame(cands, "query_id int, ord int, chunk_id string"), spark.createDataFrame(queries, "query_id int, query string"), spark.createDataFrame(texts, "chunk_id string, content string")
    written = []

    def counted(df):
        out = cut(df)
        written.append(out.count())
        return out

    cut = lx.cut
    monkeypatch.setattr(lx, "cut", counted)
    got = {(r.query_id, r["rank"]): (r.chunk_id, r.bm25_score) for r in lx.bm25_of_candidates(*args, 4).collect()}
    want = _brute_candidates(cands, queries, texts, 4)
    assert got.keys() == want.keys()
    assert not [(x, got[x], want[x]) for x in want if got[x][0] != want[x][0] or abs(got[x][1] - want[x][1]) > 2e-6]
    assert max(written) <= len(cands)  # never a row per query, chunk and term


def test_bm25_sums_without_a_shuffle_of_pairs(spark):
    chunks = spark.createDataFrame([(f"c{i}", i, f"a b{i % 7} c{i % 3} c{i % 3}") for i in range(50)] + [("twin", 60, "a a x"), ("twin", 60, "x y y"), (None, None, "b1")], "chunk_id string, ord int, content string")
    queries = spark.createDataFrame([(1, "a b1 c2"), (2, "x y")], "query_id int, query string")
    index = lx.bm25_index(chunks)
    twin = {r.term: r.gain for r in index.postings.where("chunk_id = 'twin'").collect()}
    assert twin["a"] == twin["x"] == twin["y"]  # two of each, over rows that agree in id and length
    hits = lx.bm25_top_k(queries, index, 4)
    hits.collect()
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" in plan
    assert not [x for x in plan.splitlines() if "hashpartitioning(query_id" in x and "chunk_id" in x]
