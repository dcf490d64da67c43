"""Sources, sinks, plug-ins and streams."""

from pyspark.sql import functions as F

from corpusloom.cases import case
from corpusloom.cases import sqltext as q
from corpusloom.cases import views as v
from corpusloom.cases.alias_cases import _log
from corpusloom.cases.eval_cases import MOVES, MOVE_SQL, RES, results
from corpusloom.functions import text as tx
from corpusloom.operators import chunks as ck
from corpusloom.operators import graph_build as gb
from corpusloom.operators import plugins as pl
from corpusloom.operators import store as st
from corpusloom.plans.session import scratch_path, tables
from corpusloom.sources import readers as rd
from corpusloom.sources import writers as wr
from corpusloom.streaming import jobs

# --- sources and sinks: what is read was written by Spark from the tables ----------------------------


@case("a01_read_text_corpus", "SELECT lang AS folder, md5(text) AS text_md5, length(text) AS n_chars, count(*) AS n FROM documents WHERE text <> '' GROUP BY ALL")
def _(spark, sf):
    path = scratch_path(spark, "corpus")
    docs = tables(spark, sf)("documents").where("text <> ''").select("lang", F.col("text").alias("value"))
    # whole texts, many to a file, parted by a character that no text has
    docs.write.option("maxRecordsPerFile", 500).option("lineSep", "\x1e").partitionBy("lang").text(path)
    got = rd.read_text_corpus(spark, path).select(F.regexp_extract("path", "lang=([^/]+)", 1).alias("folder"), F.explode(F.split("content", "\x1e")).alias("text"))
    return got.where("text <> ''").groupBy("folder", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars")).agg(F.count(F.lit(1)).alias("n"))


@case(
    "a02_flatten_sheet_rows",
    """SELECT r_name AS sheet, '# ' || r_name || chr(10) || string_agg(n_name || ' | ' || n_nationkey || CASE WHEN s > 0 THEN ' | ' || s ELSE '' END, chr(10) ORDER BY n_nationkey) AS text
    FROM (SELECT n_name, n_nationkey, n_regionkey, count(s_suppkey) AS s FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2, 3) JOIN region ON r_regionkey = n_regionkey GROUP BY r_name""",
)
def _(spark, sf):
    t = tables(spark, sf)
    n = t("supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("s"))
    j = t("nation").join(n, "n_nationkey", "left").join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    cells = j.select(
        F.lit("book").alias("book"), F.col("r_name").alias("sheet"), F.col("r_regionkey").alias("sheet_no"), F.col("n_nationkey").alias("row_no"),
        F.array("n_name", F.lit(" "), F.col("n_nationkey").cast("string"), F.col("s").cast("string")).alias("values"),
    )
    return rd.flatten_sheet_rows(cells).select("sheet", "text")


@case(
    "a03_read_chapters",
    f"WITH {q.chunk_cte('documents', 200, 20)} SELECT lang AS chapter, full_doc_id || '/' || chunk_order_index AS breadcrumb, md5(content) AS content_md5 FROM chunks JOIN documents ON doc_id = full_doc_id",
)
def _(spark, sf):
    t = tables(spark, sf)
    path = scratch_path(spark, "chapters")
    c = ck.chunk_by_tokens(t("documents"), max_tokens=200, overlap=20).join(t("documents").select(F.col("doc_id").alias("full_doc_id"), "lang"), "full_doc_id")
    chunk = F.struct("chunk_id", F.concat_ws("/", "full_doc_id", "chunk_order_index").alias("breadcrumb"), "content", F.lit("text").alias("chunk_type"))
    # one chapter per document, whose chunks come from one row
    c.groupBy("full_doc_id", "lang").agg(F.sort_array(F.collect_list(F.struct("chunk_order_index", chunk.alias("c")))).alias("x")).select(
        F.concat(F.lit("doc"), "full_doc_id").alias("doc_name"), F.col("lang").alias("chapter"), F.col("x.c").alias("chunks")
    ).write.json(path)
    got = rd.read_chapters(spark, path, multi_line=False)
    return got.select("chapter", "breadcrumb", F.md5("content").alias("content_md5"))


@case("a04_read_records", f"WITH {v.REC} SELECT doc_name || '::' || record_id AS record_key, fault, array_to_string(causes, '|') AS causes FROM rec")
def _(spark, sf):
    path = scratch_path(spark, "records")
    r = v.records(tables(spark, sf))
    cols = [c.split(":")[0] for c in rd.RECORD_FIELDS.split(",")]
    fields = [F.concat(F.lit("1. "), "fault", F.lit("。")).alias("fault") if c == "fault" else F.col(c) for c in cols]
    one = r.select("doc_name", F.lit("diagnostic_records_llm").alias("doc_type"), F.array(F.struct(*fields)).alias("records"))
    one.write.json(path)
    got = rd.read_records(spark, path, multi_line=False)
    return got.select("record_key", "fault", F.array_join("causes", "|").alias("causes"))


@case("a05_read_qa_csv", f"SELECT 'q' || item_id AS question_id, {q.strip('text')} AS question, 'e' || item_id AS evidence FROM benchmark")
def _(spark, sf):
    src, out = scratch_path(spark, "qa"), scratch_path(spark, "qa-json")
    b = tables(spark, sf)("benchmark").select(
        F.concat(F.lit("q"), "item_id").alias("QuestionID"), F.col("text").alias("Question"), F.lit("a").alias("Gold Answer"), F.concat(F.lit(" e"), "item_id").alias("Evidence"), F.lit("Single").alias("Type")
    )
    b.where("QuestionID like '%1' or QuestionID like '%4'").write.option("header", "true").option("escape", '"').csv(f"{src}/one")
    # other files spell and order their columns in another way
    other = b.where("not (QuestionID like '%1' or QuestionID like '%4')").select(F.col("Evidence").alias("evidence"), F.col("Type").alias("questionType"), F.col("Question").alias("question"), F.col("QuestionID").alias("id"), F.col("Gold Answer").alias("answer"))
    other.write.option("header", "true").option("escape", '"').csv(f"{src}/two")
    got = rd.read_qa_csv(spark, f"{src}/*")
    wr.write_qa_json(got, out)
    back = spark.read.schema("Question string, Evidence string").json(out)
    return got.join(back.select(F.col("Evidence").alias("evidence"), F.col("Question").alias("question")), ["question", "evidence"]).select("question_id", "question", "evidence")


@case("a06_read_graphml", f"WITH {v.TREE} SELECT src, dst, length(src)::DOUBLE AS weight, 'has' AS relation_type FROM tree")
def _(spark, sf):
    path = scratch_path(spark, "graphml")
    keys = '<key id="d3" for="edge" attr.name="weight"/><key id="d5" for="edge" attr.name="relation_type"/><key id="d0" for="node" attr.name="entity_type"/>'
    e = v.hierarchy(tables(spark, sf)).withColumn("doc", F.col("src"))
    line = F.concat(
        F.lit('<edge source="&quot;'), "src", F.lit('&quot;" target="'), "dst", F.lit('"><data key="d3">'), F.length("src").cast("string"), F.lit('</data><data key="d5">has</data></edge>')
    )
    docs = e.select("doc").distinct()
    rows = e.select("doc", F.lit(1).alias("o"), line.alias("value"))
    rows = rows.unionByName(docs.select("doc", F.lit(0).alias("o"), F.lit(f'<?xml version="1.0"?><graphml>{keys}<graph edgedefault="undirected">').alias("value")))
    rows = rows.unionByName(docs.select("doc", F.lit(2).alias("o"), F.lit("</graph></graphml>").alias("value")))
    # one GraphML document per left node
    rows.repartition("doc").sortWithinPartitions("doc", "o").drop("o").write.partitionBy("doc").text(path)
    return rd.read_graphml(spark, path)[1].select("src", "dst", "weight", "relation_type")


@case("a07_export_graph", f"WITH {v.CAND} SELECT src AS source, dst AS target, rels AS type, weight FROM edges")
def _(spark, sf):
    gr = v.graph(tables(spark, sf))
    edges = gb.render_edges(gr).select("src", "dst", "weight", F.array_join("relation_types", tx.SEP).alias("relation_type"))
    return wr.export_graph(gr.nodes, edges)[1].select("source", "target", "type", "weight")


@case("a08_read_alias_events", "SELECT event_id AS seq, 'a' || user_id AS id, event_type = 'error' AS deleted FROM events")
def _(spark, sf):
    path = scratch_path(spark, "aliases")
    _log(tables(spark, sf)).write.json(path)
    return rd.read_alias_events(spark, path).select("seq", "id", "deleted")


@case(
    "a09_write_routed",
    f"SELECT CASE WHEN {q.ntok('text')} >= 300 THEN 'long_chunk' ELSE 'good_chunks' END AS issue_folder, count(*) AS n FROM documents WHERE {q.strip('text')} <> '' GROUP BY 1",
)
def _(spark, sf):
    path = scratch_path(spark, "routed")
    d = tables(spark, sf)("documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    wr.write_routed(ck.route_chunks(ck.scan_chunks(d, long_threshold=300)), path)
    return spark.read.schema("chunk_id long, issue_folder string").json(path).groupBy("issue_folder").agg(F.count(F.lit(1)).alias("n"))


EV = ("click", "error", "purchase", "signup", "view")


@case(
    "a10_write_judged_results",
    f"""WITH {RES}, u AS (SELECT DISTINCT user_id::VARCHAR AS question_id FROM events) SELECT question_id, (SELECT string_agg(mode || '=' || answer || '/' || score, '|' ORDER BY mode) FROM lst WHERE lst.question_id = u.question_id AND mode IN {EV}) AS cells FROM u""",
)
def _(spark, sf):
    path = scratch_path(spark, "judged")
    r = results(tables(spark, sf)).groupBy("question_id", "mode").agg(F.max_by(F.struct("answer", "score", "recall"), "ord").alias("x")).select("question_id", "mode", "x.*")
    wr.write_judged_results(r, EV, path)
    wide = spark.read.option("header", "true").option("escape", '"').csv(path)
    cells = F.concat_ws("|", *[F.when(F.col(f"{m}_Answer").isNotNull(), F.concat(F.lit(f"{m}="), f"{m}_Answer", F.lit("/"), f"{m}_Score")) for m in EV])
    return wide.select("question_id", cells.alias("cells"))


@case("a11_export_cards", f"WITH {v.REC} SELECT doc_name, count(*) AS n FROM rec GROUP BY 1")
def _(spark, sf):
    path = scratch_path(spark, "cards")
    wr.export_cards(v.records(tables(spark, sf)).withColumn("position", F.col("ord")), path)
    cards = spark.read.option("lineSep", "-" * 80 + "\n").text(f"{path}/kind=cards").where("value <> ''")
    return cards.groupBy("doc_name").agg(F.count_if(F.contains(F.col("value"), F.lit("[记录ID]"))).alias("n"))


# --- plug-ins ---------------------------------------------------------------------------------------


@case(
    "l02_chunker",
    f"""WITH l AS (SELECT DISTINCT ON (doc_id) 'd' || doc_id AS doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {q.strip('x')}), lambda x: x <> '') AS parts FROM documents)
    SELECT doc_id AS full_doc_id, i - 1 AS chunk_order_index, 'chunk-' || md5(content) AS chunk_id, {q.ntok('content')} AS tokens
    FROM (SELECT doc_id, unnest(parts) AS content, generate_subscripts(parts, 1) AS i FROM l)""",
)
def _(spark, sf):
    docs = tables(spark, sf)("documents").select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), F.col("text").alias("content"), F.lit("pending").alias("status"))
    _done, chunks = st.process_queue(docs, chunker=ck.chunk_by_separator("\n"))
    return chunks.select("full_doc_id", F.col("chunk_order_index").cast("long").alias("chunk_order_index"), "chunk_id", F.col("tokens").cast("long").alias("tokens"))


@case(
    "l03_extract",
    """WITH w AS (SELECT DISTINCT upper(w) AS entity_name FROM (SELECT unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS w FROM documents) WHERE regexp_full_match(w, '[A-Z][a-z]{3,}'))
    SELECT entity_name, CASE WHEN entity_name = 'THAT' THEN '"UNKNOWN"' ELSE 'TERM' END AS entity_type FROM w""",
)
def _(spark, sf):
    d = tables(spark, sf)("documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").alias("ord"), F.col("text").alias("content"))
    nodes, edges = gb.parse_extraction_tuples(pl.extract(d))
    g = gb.build_graph(nodes, edges, review=lambda n, e: (n.where("entity_name <> 'THAT'"), e))
    return g.nodes


@case("l04_pair_scorer", "SELECT doc_id, len(list_intersect(list_distinct(string_split(lower(substring(text, 1, 40)), ' ')), list_distinct(string_split(lower(text), ' '))))::DOUBLE AS score FROM documents")
def _(spark, sf):
    def shared(a, b):
        return float(len(set(a.lower().split(" ")) & set(b.lower().split(" "))))

    d = tables(spark, sf)("documents").select("doc_id", F.substring("text", 1, 40).alias("query"), F.col("text").alias("content"))
    return d.select("doc_id", pl.pair_scorer(shared).alias("score"))


@case("l04_scored_pairs", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE length(text)::DOUBLE END AS score, CASE WHEN doc_id % 7 = 0 THEN 'ValueError: down' END AS score_error FROM documents")
def _(spark, sf):
    def score(a, b):
        if a == "0":
            raise ValueError("down")
        return float(len(b))

    d = tables(spark, sf)("documents").select("doc_id", (F.col("doc_id") % 7).cast("string").alias("query"), F.col("text").alias("content"))
    return pl.scored_pairs(d, score).select("doc_id", "score", "score_error")


@case(
    "l05_review",
    """SELECT DISTINCT entity_name, entity_type FROM (SELECT 'DOC ' || doc_id AS entity_name, upper(lang) AS entity_type FROM documents UNION ALL SELECT upper(source), 'SOURCE' FROM documents)
    WHERE NOT ends_with(entity_name, '7')""",
)
def _(spark, sf):
    # a reviewer takes away what it does not believe, before anything is merged
    text = F.concat(F.lit('("entity"<|>doc '), "doc_id", F.lit("<|>"), "lang", F.lit("<|>a document)##(\"entity\"<|>"), "source", F.lit("<|>source<|>a source)##"))
    d = tables(spark, sf)("documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").alias("ord"), text.alias("response"))
    nodes, edges = gb.parse_extraction_tuples(d)
    g = gb.build_graph(nodes, edges, review=lambda n, e: (n.where("not endswith(entity_name, '7')"), e))
    return gb.render_nodes(g).select("entity_name", "entity_type").distinct()


@case("l06_token_counter", f"SELECT doc_id, {q.ntok('text')} AS token_count FROM documents")
def _(spark, sf):
    d = tables(spark, sf)("documents").select("doc_id", F.col("text").alias("content"))
    return ck.scan_chunks(d, tokens=pl.token_counter(lambda s: len(s.split()))).select("doc_id", F.col("token_count").cast("long").alias("token_count"))


@case("l07_parent_namer", f"WITH {v.REC} SELECT DISTINCT 'parent of ' || doc_name AS entity_name FROM rec")
def _(spark, sf):
    r = v.records(tables(spark, sf))
    nodes, _e, _s = gb.resolve_parents(r, namer=pl.parent_namer(lambda title: f"parent of {title}"))
    return nodes.select("entity_name").distinct()


# --- streams: three files (rows dealt out of order), and the query stopped and started again between them ---------


def _replayed(spark, files, run):
    """``run(stream, out, checkpoint)`` after each file has come; the state after the last one."""
    src, out, checkpoint = scratch_path(spark, "in"), scratch_path(spark, "out"), scratch_path(spark, "checkpoint")
    for k, part in enumerate(files):
        part.write.parquet(f"{src}/{k}")
        got = run(jobs.folder_stream(spark, part.schema, src), out, checkpoint)
    return got


def _thirds(df, key):
    return [df.where(F.pmod(F.xxhash64(key), F.lit(3)) == k) for k in range(3)]


def _by_time(events):
    """Three spans of ten days; every third event of a span's last 50 minutes comes with the next file."""
    minute = F.expr("timestampdiff(MINUTE, TIMESTAMP_NTZ'2024-01-01', ts)")
    span = F.floor(minute / 14400)
    late = (minute % 14400 >= 14350) & (F.col("event_id") % 3 == 0)
    place = F.least(F.lit(2), (span + late.cast("int")).cast("int"))
    return [events.where(place == k) for k in range(3)]


INGEST_SQL = f"""WITH d AS (SELECT DISTINCT {q.clean('text')} AS text FROM documents), dd AS (SELECT 'doc-' || md5(text) AS doc_id, text FROM d), {q.chunk_cte('dd', 200, 20)}
    SELECT full_doc_id, 'chunk-' || md5(content) AS chunk_id, chunk_order_index, tokens FROM chunks"""


@case("j01_stream_ingest", INGEST_SQL)
def _(spark, sf):
    files = _thirds(tables(spark, sf)("documents"), "doc_id")
    got = _replayed(spark, files, lambda s, out, cp: jobs.run_to_table(jobs.stream_ingest(s, 200, 20), out, cp))
    return got.select("full_doc_id", "chunk_id", "chunk_order_index", "tokens")


@case("j01_stream_ingest_known", INGEST_SQL.replace("FROM documents)", "FROM documents WHERE doc_id % 5 <> 0 EXCEPT SELECT " + q.clean("text") + " FROM documents WHERE doc_id % 5 = 0)"))
def _(spark, sf):
    docs = tables(spark, sf)("documents")
    known = docs.where("doc_id % 5 = 0").select(tx.md5_id(tx.clean_str(F.col("text")), "doc-").alias("doc_id"))
    got = _replayed(spark, _thirds(docs.where("doc_id % 5 <> 0"), "doc_id"), lambda s, out, cp: jobs.run_to_table(jobs.stream_ingest(s, 200, 20, processed=known), out, cp))
    return got.select("full_doc_id", "chunk_id", "chunk_order_index", "tokens")


@case(
    "j02_stream_alias_state",
    "SELECT 'a' || user_id AS id, max(event_id) AS seq, arg_max(event_type = 'error', event_id) AS deleted FROM events GROUP BY user_id",
)
def _(spark, sf):
    files = _thirds(tables(spark, sf)("events"), "event_id")
    got = _replayed(spark, files, lambda s, out, cp: jobs.run_alias_state(_log(lambda _name: s), out, cp, parts=8))
    return got.select("id", "seq", "deleted")


MODE_COLS = """count(*) AS completed, count(*) FILTER (score = 1) AS correct_count, count(*) FILTER (score = 0) AS partial_count, count(*) FILTER (score = -1) AS wrong_count,
    round_even(count(*) FILTER (score = 1) / count(*) * 100, 2) AS accuracy_percent, round_even(avg(rt_ms), 2) AS avg_response_time_ms, round_even(avg(recall), 4)::DOUBLE AS avg_recall_rate"""


@case("j03_stream_result_summary", f"WITH {RES} SELECT mode, {MODE_COLS} FROM res GROUP BY mode")
def _(spark, sf):
    files = _thirds(tables(spark, sf)("events"), "event_id")
    return _replayed(spark, files, lambda s, out, cp: jobs.run_latest(jobs.stream_result_summary(results(lambda _name: s)), out, cp))


@case(
    "j03_stream_result_windows",
    f"""WITH {RES} SELECT epoch(w)::BIGINT AS started, mode, {MODE_COLS} FROM (SELECT res.*, time_bucket(INTERVAL 6 HOUR, ts) AS w FROM res JOIN events ON event_id = ord)
    WHERE w + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY w, mode""",
)
def _(spark, sf):
    def run(s, out, cp):
        e = results(lambda _name: s, "ts")
        return jobs.run_to_table(jobs.stream_result_summary(e, "6 hours", "1 hour"), out, cp)

    got = _replayed(spark, _by_time(tables(spark, sf)("events")), run)
    return got.select(F.unix_seconds("window.start").alias("started"), *[c for c in got.columns if c != "window"])


@case(
    "j04_stream_transitions",
    f"""SELECT run_id, seq, before, state, before || '>' || state IN ({MOVE_SQL}) AS is_valid FROM (SELECT user_id AS run_id, event_id AS seq, event_type AS state, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), 'idle') AS before FROM events)""",
)
def _(spark, sf):
    events = tables(spark, sf)("events").select(F.col("user_id").alias("run_id"), "event_id", F.col("event_type").alias("state"), "ts")
    # the last file is a clock: one row of no run that moves the watermark past all others
    clock = events.limit(1).select(F.lit(-1).cast("long").alias("run_id"), F.lit(-1).cast("long").alias("event_id"), F.lit("idle").alias("state"), F.lit("2100-01-01").cast("timestamp_ntz").alias("ts"))
    files = [*_by_time(events), clock]
    got = _replayed(spark, files, lambda s, out, cp: jobs.run_to_table(jobs.stream_transitions(s.withColumnRenamed("event_id", "seq"), MOVES), out, cp))
    return got.where("run_id >= 0")


@case(
    "j05_stream_latency",
    """WITH g AS (SELECT user_id, ts, length(props) AS n, coalesce(ts - lag(ts) OVER w >= INTERVAL 30 MINUTE, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM g),
    r AS (SELECT user_id AS request_id, max(ts) AS last, count(*) AS n_chunks, sum(n) AS n_chars FROM s GROUP BY user_id, no)
    SELECT request_id, n_chunks, n_chars FROM r WHERE last + INTERVAL 30 MINUTE < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
)
def _(spark, sf):
    def run(s, out, cp):
        c = s.select(F.col("user_id").alias("request_id"), "ts", F.col("props").alias("text"))
        return jobs.run_to_table(jobs.stream_latency(c), out, cp)

    return _replayed(spark, _by_time(tables(spark, sf)("events")), run).select("request_id", "n_chunks", "n_chars")
