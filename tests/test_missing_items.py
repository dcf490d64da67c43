"""Pair numbers, chunker hook, feature vectors and entity decoding against plain computations."""

import html
import itertools

import numpy as np
from pyspark.sql import functions as F

from corpusloom.operators import chunks as ck
from corpusloom.operators import evaluation as ev
from corpusloom.operators import graph_build as gb
from corpusloom.operators import store as st
from corpusloom.operators import vectors as vx
from corpusloom.streaming import jobs

RECORD = "doc_name string, record_id string, equipment string, fault string, symptom string, causes array<string>, actions array<string>"


def test_every_pair_of_different_faults_can_be_asked_for(spark):
    rows = [(f"d{i % 3}", f"r{i:02d}", f"e{i % 4 // 3}", f"f{i % 5}", None, ["c"], None) for i in range(40)] + [("d", "r", "alone", "f", "", [], [])]
    records = spark.createDataFrame(rows, RECORD)
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    want = []
    for some in by.values():
        some.sort(key=lambda r: (r[3], r[1], r[0]))
        want += [(f"{a[0]}::{a[1]}", f"{b[0]}::{b[1]}") for a, b in itertools.combinations(some, 2) if a[3] != b[3]]
    got = [tuple(r["record_keys"]) for r in ev.qa_candidates_pairs(records).collect()]
    assert sorted(got) == sorted(want) and len(set(got)) == len(got)
    order = ev.pair_order(records)
    few = ev.drawn_pairs(order, 7).collect()
    assert all(len({r["p"] for r in few if r["equipment"] == e}) == min(7, len(s) * (len(s) - 1) // 2) for e, s in by.items())
    some = ev.qa_candidates_pairs(records, "similar_faults", per_equipment=7).collect()
    assert {tuple(r["record_keys"]) for r in some} <= set(want) and 0 < len(some) <= 14


def test_pair_numbers_of_very_large_groups(spark):
    """Places from numbers, where the square root has to be corrected."""
    places = [(i, j) for j in (1, 2, 94906266, 10**9, 2 * 10**9) for i in (0, 1, j - 1) if i < j]
    numbers = spark.createDataFrame([("e", j * (j - 1) // 2 + i) for i, j in places], "equipment string, p long")
    order = spark.createDataFrame([("e", p, "f", "d", "r", "s") for p in {x for ij in places for x in ij}], "equipment string, pos long, fault string, doc_name string, record_id string, summary string")
    assert {(r["pos"], r["n_pos"]) for r in ev.pairs_at(order, numbers).collect()} == set(places)


def test_a_second_chunker_runs_through_queue_reindexing_and_stream(spark, tmp_path):
    by_line = ck.chunk_by_separator("\n")
    docs = spark.createDataFrame([("d", " one two \n\n three", "pending"), ("e", None, "pending"), ("f", "x", "processed")], "doc_id string, content string, status string")
    done, chunks = st.process_queue(docs, chunker=by_line)
    assert sorted((r.full_doc_id, r.chunk_order_index, r.tokens, r.content) for r in chunks.collect()) == [("d", 0, 2, "one two"), ("d", 1, 1, "three")]
    assert {r.doc_id: r.chunks_count for r in done.collect()} == {"d": 2, "e": 0}
    spark.createDataFrame([("a;b",), ("a;b",), ("c",)], "text string").write.parquet(f"{tmp_path}/in/0")
    stream = jobs.stream_ingest(jobs.folder_stream(spark, spark.read.parquet(f"{tmp_path}/in/0").schema, f"{tmp_path}/in"), chunker=ck.chunk_by_separator(";"))
    assert sorted(r.content for r in jobs.run_to_table(stream, f"{tmp_path}/out", f"{tmp_path}/cp").collect()) == ["a", "b", "c"]


def test_feature_vectors_equal_the_python_embedder(spark):
    texts = ["Pump ÉTAT pump 泵站 a_b 12", "", None, "!!", "x " * 500, "one two three four"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, content string")
    got = {r["id"]: r["embedding"] for r in vx.feature_vectors(df, dim=16).collect()}
    want = vx.hashed_embedder(16)([t or "" for t in texts])
    assert len(got) == len(texts) and all(np.allclose(got[i], want[i], atol=1e-6) for i in got)


def test_entities_are_decoded_in_tuples_and_relations(spark):
    raw = '("entity"<|>caf&#233; &amp;lt;<|>T&#x4e2d;<|>na&iuml;ve &nosuch;)##("relationship"<|>a<|>b<|>d<|>Caus&eacute; | k&eacute;y<|>2)##<|COMPLETE|>'
    df = spark.createDataFrame([("c", 1, raw)], "chunk_id string, ord int, response string")
    nodes, edges = gb.parse_extraction_tuples(df)
    n, e = nodes.first(), edges.first()
    assert (n.entity_name, n.entity_type, n.description) == (html.unescape("CAF&#233; &AMP;LT;"), "T中", "naïve &nosuch;")
    assert (e.relation_type, e.keywords, e.weight) == ("Causé", "kéy", 2.0)
    ids = st.assign_doc_ids(spark.createDataFrame([("caf&eacute;",), ("café",)], "text string"))
    assert ids.count() == 1 and ids.select(F.first("content")).first()[0] == "café"


def test_headings_of_a_very_long_document(spark):
    """Breadcrumbs as by a plain stack, in time that grows with the number of headings."""
    import random
    import time

    rng = random.Random(1)

    def run(n):
        heads = [(rng.randint(1, 6), f"t{i}") for i in range(n)]
        text = "\n".join(f"{'#' * lv} {t}\n{t} body" for lv, t in heads)
        want, stack = {}, [None] * 7
        for i, (lv, t) in enumerate(heads):
            stack[lv:] = [t] + [None] * (6 - lv)
            want[i + 1] = " > ".join(["doc", *[x for x in stack[1:] if x is not None]])
        df = spark.createDataFrame([(1, "doc", text)], "doc_id int, doc_name string, text string")
        start = time.time()
        got = {r.section: r.breadcrumb for r in ck.chunk_markdown(df, min_length=1).select("section", "breadcrumb").collect()}
        assert got == want
        return time.time() - start

    run(700)
    short, long = run(5000), run(50000)
    assert long < 20 * short + 10
