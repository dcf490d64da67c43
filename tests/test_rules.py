import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import aliases as al
from corpusloom.operators import chat as ch
from corpusloom.operators import chunks as ck
from corpusloom.operators import evaluation as ev
from corpusloom.operators import store as st
from corpusloom.sources import readers as rd

EVENT = "seq long, id string, datasource_id string, canonical_name string, entity_type string, alias string, enabled boolean, reviewed boolean, deleted boolean, updated_at string"


def test_alias_life_cycle(spark):
    log = [
        (1, "x", "ds", "主机系统无法启动", "FAULTCASE", "主机打不着火", True, False, False, "1"),
        (2, "x", "ds", "主机系统无法启动", "faultcase", " 主机无法点火 ", True, True, False, "2"),
        (3, "y", "ds", "泵", "EQUIPMENT", "水泵", True, False, False, "1"),
        (4, "y", "ds", None, None, None, None, None, True, "2"),
    ]
    state, bad = al.replay_aliases(spark.createDataFrame(log, EVENT), "ds")
    assert [(r.id, r.alias_norm, r.entity_type, r.reviewed) for r in state.collect()] == [("x", "主机无法点火", "FAULTCASE", True)]
    assert bad.count() == 0
    assert al.list_aliases(state, query="点火").count() == 1
    dup = spark.createDataFrame([("n", 1, "主机系统无法启动", "FAULTCASE", "主机无法点火", None, None)], "id string, ord int, canonical_name string, entity_type string, alias string, enabled boolean, reviewed boolean")
    made, viol = al.create_aliases(state, dup)
    assert made.count() == 0 and viol.first().violation == "alias already exists"


def test_component_routing(spark):
    a = spark.createDataFrame([("1", "燃油电磁阀", "COMPONENT", "电磁阀", True, True)], "id string, canonical_name string, entity_type string, alias_norm string, enabled boolean, reviewed boolean")
    q = spark.createDataFrame([("q", "电磁阀怎么检查")], "query_id string, query string")
    routed, best = al.route_queries(q, a)
    r = routed.first()
    assert r.intent == "component" and r.ranked_types[0] == "COMPONENT"
    b = best.first()
    assert (b.canonical_name, b.score) == ("燃油电磁阀", 5215)


def test_derived_aliases(spark):
    r = spark.createDataFrame([("船舶柴油机",), ("船用发电机",), ("柴油机",)], "equipment string")
    made, counts = al.derive_aliases(r)
    assert {x.alias for x in made.collect()} == {"柴油机", "发电机"}
    assert {x.name: x.n for x in counts.collect()} == {"created": 2, "skipped": 1}


def test_chapters_round_trip(spark, tmp_path):
    d = tmp_path / "doc" / "raw_chunks"
    d.mkdir(parents=True)
    one = {"doc_name": "test_doc", "chapter": "test_chapter", "chunks": [{"chunk_id": "abc123", "breadcrumb": "test_doc > test_chapter", "content": "short", "chunk_type": "text", "metadata": {}}, {"chunk_id": "x", "breadcrumb": "b", "content": "x " * 2000, "chunk_type": "text", "metadata": {"level": "1"}}]}
    (d / "c.json").write_text(json.dumps(one, indent=2), encoding="utf-8")
    c = rd.read_chapters(spark, str(tmp_path))
    routed = {r.issue_folder: r.n for r in ck.route_counts(ck.route_chunks(ck.scan_chunks(c))).collect()}
    assert routed == {"good_chunks": 1, "long_chunk": 1, "tables": 0, "images": 0}


def test_markdown_sections(spark):
    text = "front matter that is long enough to stay\n# A\n## B\nbody of b, long enough to be a chunk of text\n### C\n| a | --- | b\nrow of the table that makes it long\n## D\nshort\n# E\nbody of e, long enough to be a chunk of text"
    out = ck.chunk_markdown(spark.createDataFrame([(1, "book", text)], "doc_id int, doc_name string, text string")).orderBy("section").collect()
    assert [(r.chapter, r.breadcrumb, r.chunk_type, r.level) for r in out] == [
        ("引言及前言", "book", "text", 0), ("A", "book > A > B", "text", 2), ("A", "book > A > B > C", "table", 3), ("E", "book > E", "text", 1)
    ]


def test_chunk_windows(spark):
    words = [f"w{i}" for i in range(10)]
    out = ck.chunk_by_tokens(spark.createDataFrame([(1, " ".join(words))], "doc_id int, text string"), max_tokens=4, overlap=2).orderBy("chunk_order_index").collect()
    assert [(r.tokens, r.content) for r in out] == [(min(4, 10 - s), " ".join(words[s : s + 4])) for s in range(0, 10, 2)]


def test_evidence_and_recall(spark):
    df = spark.createDataFrame([("doc.md::llm_001,doc.md::llm_002;doc.md::llm_003 | 依据整理",)], "e string")
    assert df.select(ev.parse_evidence_ids(F.col("e")).alias("x")).first().x == ["doc.md::llm_001", "doc.md::llm_002", "doc.md::llm_003"]
    expected = spark.createDataFrame([("a", "船舶.md::llm_038"), ("b", "d::001"), ("b", "d::002")], "query_id string, id string")
    got = spark.createDataFrame([("a", "chunk-faultcase-1"), ("a", "llm_038"), ("b", "002"), ("b", "003")], "query_id string, id string")
    assert {r.query_id: r.recall for r in ev.recall_rate(expected, got, spark.createDataFrame([("a",), ("b",), ("c",)], "query_id string")).collect()} == {"a": 100.0, "b": 50.0, "c": 0.0}


def test_summary_fixture(spark):
    rows = [("q", m, i, "x", s, 10, rc) for i, (m, s, rc) in enumerate((("graph_text_hybrid", 1, 100.0), ("graph_only", 1, 100.0), ("text_only", -1, 0.0)))]
    long = spark.createDataFrame(rows, "question_id string, mode string, ord int, answer string, score int, rt_ms long, recall double")
    by = {r["mode"]: r for r in ev.summarize_by_mode(long).collect()}
    assert {m: r.accuracy_percent for m, r in by.items()} == {"graph_text_hybrid": 100.0, "graph_only": 100.0, "text_only": 0.0}
    assert ev.normalize_results(long).first().primary_mode == "graph_text_hybrid"


def test_select_balanced_caps(spark):
    rows = [("k", f"q{i}", "a", "e", [f"d{i % 3}"], [f"d{i % 3}::r{i % 5}"]) for i in range(60)]
    c = spark.createDataFrame(rows, "category string, question string, gold_answer string, evidence string, docs array<string>, record_keys array<string>")
    out = ev.select_balanced(c, {"k": 12}, record_cap=2, doc_caps=(3, 4, None)).collect()
    per_doc, per_rec = {}, {}
    for r in out:
        per_doc[r.docs[0]] = per_doc.get(r.docs[0], 0) + 1
        per_rec[r.record_keys[0]] = per_rec.get(r.record_keys[0], 0) + 1
    assert len(out) == 12 and len({r.question for r in out}) == 12 and max(per_doc.values()) == 4 and max(per_rec.values()) <= 2
    with pytest.raises(RuntimeError):
        ev.select_balanced(c, {"k": 12}, record_cap=2, doc_caps=(3,))


def test_transcript_starting_with_an_answer(spark):
    m = spark.createDataFrame([("c", 1, "assistant", "hi"), ("c", 2, "user", " "), ("c", 3, "assistant", "yes")], "conv_id string, turn int, role string, text string")
    t = spark.createDataFrame([("c", "a/b")], "conv_id string, title string")
    r = ch.render_transcript(m, t, "ds", "now").first()
    assert r.file_name == "a-b__session_c.md"
    assert r.markdown.index("## 第1轮") < r.markdown.index("hi") < r.markdown.index("## 第2轮") < r.markdown.index("（空）") < r.markdown.index("yes")


def test_ids_must_be_unique(spark):
    with pytest.raises(ValueError):
        st.assign_doc_ids(spark.createDataFrame([(1, "a"), (1, "b")], "i int, text string"), id_col="i")


def test_context_keeps_every_line_of_a_long_list(spark):
    from corpusloom.operators import context as cx

    queries = spark.createDataFrame([("q",)], "query_id string")
    entities = spark.createDataFrame([], "query_id string, rank int, entity_name string, entity_type string, score double, description string")
    sources = spark.range(10_005).select(F.lit("q").alias("query_id"), F.col("id").cast("int").alias("rank"), F.col("id").cast("string").alias("chunk_id"), F.lit("").alias("content"))
    text = cx.build_context(queries, entities, sources).first().context
    assert text.count("\r\n") == 10_005 + 2 and text.index("\n10003,") < text.index("\n10004,")


def test_extraction_keeps_every_name_and_reports_errors(spark):
    from corpusloom.operators import plugins as pl

    names = " ".join(f"N{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(40))
    chunks = spark.createDataFrame([("c", 1, names)], "chunk_id string, ord int, content string")
    assert pl.extract(chunks).first().response.count('("entity"') == 40

    def fails(text):
        raise RuntimeError("down")

    row = pl.extract(chunks, fails).first()
    assert row.response is None and row.error == "RuntimeError: down"


def test_entities_are_decoded_once(spark):
    import html

    from corpusloom.functions import text as tx

    texts = ["a &eacute; b", "&#8217;&#x4e2d;&#X4E2D;", "&amp;eacute; &eacute;", "&#38;lt; &lt;", "&amp;#8217; &#8217;", "&nosuch; &", "plain", "&CounterClockwiseContourIntegral;"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(tx.decode_entities(F.col("t"))).collect()] == [html.unescape(t) for t in texts]


def test_quota_fill_takes_general_questions_at_last(spark):
    from corpusloom.operators import evaluation as ev

    rows = [(i, "d", f"r{i}", "pump", f"fault {i}", [], ["act"], [], [], []) for i in range(3)]
    df = spark.createDataFrame(rows, "ord int, doc_name string, record_id string, equipment string, fault string, causes array<string>, actions array<string>, precautions array<string>, key_components array<string>, consequences array<string>")
    got = ev.quota_fill(df).collect()
    assert [r["gold_answer"] for r in got] == ["act"] * 3 + [ev.FILL_ANSWER] * 3
