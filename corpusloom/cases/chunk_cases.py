"""Chunking and corpus quality."""

from pyspark.sql import functions as F

from corpusloom.cases import case
from corpusloom.cases import sqltext as q
from corpusloom.functions import text as tx
from corpusloom.operators import chunks as ck
from corpusloom.plans.session import tables

CH = q.chunk_cte("documents", 1200, 100)


@case(
    "c01_chunk_by_tokens",
    f"""WITH {CH} SELECT 'chunk-' || md5(content) AS chunk_id, full_doc_id, chunk_order_index, tokens,
    length(content) AS n_chars FROM chunks""",
)
def _(spark, sf):
    c = ck.chunk_by_tokens(tables(spark, sf)("documents"))
    return c.select("chunk_id", "full_doc_id", "chunk_order_index", "tokens", F.length("content").cast("long").alias("n_chars"))


@case(
    "c02_collapse_chunks",
    f"""WITH {q.chunk_cte('documents', 30, 5)}, w AS (SELECT md5(content) AS h, full_doc_id, max(chunk_order_index) AS i,
        arg_max(tokens, chunk_order_index) AS tokens FROM chunks GROUP BY 1, 2)
    SELECT 'chunk-' || h AS chunk_id, min(full_doc_id) AS full_doc_id, arg_min(i, full_doc_id) AS chunk_order_index,
        arg_min(tokens, full_doc_id) AS tokens FROM w GROUP BY h""",
)
def _(spark, sf):
    c = ck.chunk_by_tokens(tables(spark, sf)("documents"), max_tokens=30, overlap=5)
    return ck.collapse_chunks(c).select("chunk_id", "full_doc_id", "chunk_order_index", "tokens")


def _markdown(t):
    """Pages as Markdown: <hN> becomes N hash signs on a new line, any other tag a line break."""
    text = F.col("html")
    for n in range(1, 7):
        text = F.regexp_replace(text, f"<h{n}[^a-z>]*>", "\n" + "#" * n + " ")
    return t("pages").select(
        "page_id", F.concat(F.lit("page "), "page_id").alias("doc_name"), F.regexp_replace(text, "<[^>]*>", "\n").alias("text")
    )


_MD = "html"
for _n in range(1, 7):
    _MD = f"regexp_replace({_MD}, '<h{_n}[^a-z>]*>', chr(10) || '{'#' * _n} ', 'g')"
_HEAD = r"^(#{1,6})\s+(.+)$"
MARKDOWN = rf"""md AS (SELECT page_id, regexp_replace({_MD}, '<[^>]*>', chr(10), 'g') AS text FROM pages),
    ln AS (SELECT page_id, generate_subscripts(a, 1) AS p, unnest(a) AS raw FROM (SELECT page_id, string_split_regex(text, '\r\n|[\n\r]') AS a FROM md)),
    tl AS (SELECT page_id, p, {q.strip('raw')} AS x FROM ln),
    hd AS (SELECT *, length(regexp_extract(x, '{_HEAD}', 1)) AS lv, {q.strip(f"regexp_extract(x, '{_HEAD}', 2)")} AS title
        FROM tl WHERE x <> ''),
    sec AS (SELECT *, sum((lv > 0)::INT) OVER (PARTITION BY page_id ORDER BY p) AS s FROM hd),
    body AS (SELECT page_id, s, string_agg(x, chr(10) ORDER BY p) AS content FROM sec WHERE lv = 0 GROUP BY 1, 2),
    head AS (SELECT page_id, s, lv, title FROM sec WHERE lv > 0),
    anc AS (SELECT b.page_id, b.s, h.s AS hs, h.lv, h.title FROM body b JOIN head h ON h.page_id = b.page_id AND h.s <= b.s
        WHERE NOT EXISTS (SELECT 1 FROM head k WHERE k.page_id = h.page_id AND k.s > h.s AND k.s <= b.s AND k.lv <= h.lv)),
    path AS (SELECT page_id, s, string_agg(title, ' > ' ORDER BY hs) AS path, first(title ORDER BY hs) AS chapter,
        max(lv) AS level FROM anc GROUP BY 1, 2),
    mdc AS (SELECT page_id, CAST(s AS INT) AS section, coalesce(chapter, '引言及前言') AS chapter,
        'page ' || page_id || coalesce(' > ' || path, '') AS breadcrumb, content, CAST(coalesce(level, 0) AS INT) AS level
        FROM body LEFT JOIN path USING (page_id, s) WHERE length(content) >= 30)"""


@case(
    "c03_chunk_markdown",
    f"WITH {MARKDOWN} SELECT page_id, section, chapter, breadcrumb, md5(content) AS content_md5, level, "
    "md5(breadcrumb || '_' || content) AS chunk_id, 'text' AS chunk_type FROM mdc",
)
def _(spark, sf):
    out = ck.chunk_markdown(_markdown(tables(spark, sf)), "page_id")
    return out.select("page_id", "section", "chapter", "breadcrumb", F.md5("content").alias("content_md5"), "level", "chunk_id", "chunk_type")


@case(
    "c04_structured_chunk_id",
    "SELECT doc_id, md5(source || ' > ' || lang || '_' || text) AS chunk_id FROM documents",
)
def _(spark, sf):
    return tables(spark, sf)("documents").select(
        "doc_id", ck.structured_chunk_id(F.concat_ws(" > ", "source", "lang"), F.col("text")).alias("chunk_id")
    )


def _mixed(t):
    """Documents and pages in one frame: prose, HTML and blank texts."""
    d = t("documents").select(
        F.concat(F.lit("d"), "doc_id").alias("chunk_id"), F.col("source").alias("chapter_file"), F.col("text").alias("content")
    )
    p = t("pages").select(
        F.concat(F.lit("p"), "page_id").alias("chunk_id"),
        F.concat(F.lit("h"), F.col("page_id") % 7).alias("chapter_file"),
        F.when(F.col("page_id") % 5 == 0, F.lit(" \n ")).otherwise(F.col("html")).alias("content"),
    )
    return d.unionByName(p)


ISSUE = rf"""list_filter([CASE WHEN n >= 300 THEN 'long_chunk' END,
    CASE WHEN {q.strip('content')} = '' THEN 'empty_content' END,
    CASE WHEN regexp_matches(content, '(?i)<(table|tr|td|th)\b') THEN 'html_table' END,
    CASE WHEN regexp_matches(content, '(?i)<(img|figure|svg)\b') THEN 'html_image' END,
    CASE WHEN regexp_matches(content, '!\[[^\]]*\]\([^)]+\)') THEN 'markdown_image' END], lambda x: x IS NOT NULL)"""
MIXED = f"""mix AS (SELECT 'd' || doc_id AS chunk_id, source AS chapter_file, text AS content FROM documents
    UNION ALL SELECT 'p' || page_id, 'h' || (page_id % 7), CASE WHEN page_id % 5 = 0 THEN ' ' || chr(10) || ' ' ELSE html END FROM pages),
    cnt AS (SELECT *, {q.ntok('content')} AS n FROM mix),
    scan AS (SELECT chunk_id, chapter_file, content, n AS token_count, {ISSUE} AS issues FROM cnt)"""
PREVIEW = f"CASE WHEN length({q.squeeze('content')}) <= 20 THEN {q.squeeze('content')} ELSE substring({q.squeeze('content')}, 1, 20) || '...' END"


@case(
    "c05_scan_chunks",
    f"WITH {MIXED} SELECT chunk_id, token_count, array_to_string(issues, '|') AS issues, {PREVIEW} AS content_preview FROM scan",
)
def _(spark, sf):
    s = ck.scan_chunks(_mixed(tables(spark, sf)), long_threshold=300)
    return s.select("chunk_id", F.col("token_count").cast("long").alias("token_count"), F.array_join("issue_types", "|").alias("issues"), "content_preview")


@case(
    "c06_route_chunks",
    f"""WITH {MIXED}, r AS (SELECT chunk_id, unnest(CASE WHEN len(issues) = 0 THEN ['good_chunk'] ELSE issues END) AS issue_type FROM scan)
    SELECT chunk_id, issue_type, CASE issue_type WHEN 'good_chunk' THEN 'good_chunks' WHEN 'html_table' THEN 'tables'
        WHEN 'long_chunk' THEN 'long_chunk' ELSE 'images' END AS issue_folder FROM r WHERE issue_type <> 'empty_content'""",
)
def _(spark, sf):
    s = ck.scan_chunks(_mixed(tables(spark, sf)), long_threshold=300)
    return ck.route_chunks(s).select("chunk_id", "issue_type", "issue_folder")


@case(
    "c06_route_counts",
    f"""WITH {MIXED}, r AS (SELECT unnest(CASE WHEN len(issues) = 0 THEN ['good_chunk'] ELSE issues END) AS issue_type FROM scan)
    SELECT f AS issue_folder, count(issue_type) AS n FROM (VALUES ('good_chunks'), ('long_chunk'), ('tables'), ('images')) v(f)
    LEFT JOIN r ON f = CASE issue_type WHEN 'good_chunk' THEN 'good_chunks' WHEN 'html_table' THEN 'tables'
        WHEN 'long_chunk' THEN 'long_chunk' WHEN 'html_image' THEN 'images' WHEN 'markdown_image' THEN 'images' END GROUP BY f""",
)
def _(spark, sf):
    s = ck.scan_chunks(_mixed(tables(spark, sf)), long_threshold=300)
    return ck.route_counts(ck.route_chunks(s))


_HAS = ", ".join(f"sum(list_contains(issues, '{n}')::INT) AS {n}_count" for n in ck.ISSUES)


@case(
    "c07_scan_summary",
    f"""WITH {MIXED} SELECT chapter_file, CAST(grouping(chapter_file) AS INT) AS is_total, count(*) AS chunk_count,
    round(avg(token_count), 2) AS avg_tokens, median(token_count) AS median_tokens, max(token_count) AS max_tokens,
    min(token_count) AS min_tokens, {_HAS} FROM scan GROUP BY GROUPING SETS ((chapter_file), ())""",
)
def _(spark, sf):
    out = ck.scan_summary(ck.scan_chunks(_mixed(tables(spark, sf)), long_threshold=300))
    return out.withColumn("is_total", F.col("is_total").cast("int"))


@case(
    "c08_corpus_counts",
    f"""WITH f AS (SELECT source, lang, count(*) AS chunks, sum({q.ntok('text')}) AS tokens, sum(length(text)) AS chars FROM documents GROUP BY 1, 2)
    SELECT source, CAST(grouping(source) AS INT) AS is_total, count(*) AS files, sum(chunks) AS chunks, sum(tokens) AS tokens,
    sum(chars) AS chars, round(sum(chars) / sum(chunks), 2) AS avg_chars, round(sum(tokens) / sum(chunks), 2) AS avg_tokens,
    round(sum(tokens) / nullif(sum(chars), 0), 4) AS tokens_per_char FROM f GROUP BY ROLLUP (source)""",
)
def _(spark, sf):
    out = ck.corpus_counts(tables(spark, sf)("documents"), "source", "lang", "text")
    return out.withColumn("is_total", F.col("is_total").cast("int"))


@case(
    "c09_estimate_tokens",
    """SELECT doc_id, CAST(floor((length(regexp_replace(text, '[^一-鿿]', '', 'g')) * 6
    + length(text) - length(regexp_replace(text, '[^一-鿿]', '', 'g'))) / 4) AS INT) AS n FROM documents""",
)
def _(spark, sf):
    return tables(spark, sf)("documents").select("doc_id", ck.estimate_tokens(F.col("text")).alias("n"))


def _payloads(t):
    e = t("events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        "event_id",
        F.when(k % 9 == 0, F.concat(F.lit('{"chunk_id": "c", "breadcrumb": "'), "event_type", F.lit('", "content": "  "}')))
        .when(k % 9 == 1, F.concat(F.lit('{"chunk_id": "", "content": "'), "event_type", F.lit('", "metadata": []}')))
        .when(k % 9 == 2, F.lit('{"chunk_id": "c", "breadcrumb": "b", "content": "t", "chunk_type": 3, "metadata": {"a": 1}}'))
        .when(k % 9 == 3, F.concat(F.lit('{"chunk_id": "c", "breadcrumb": "b", "content": "'), "event_type", F.lit('", "chunk_type": "text"}')))
        .otherwise(F.col("props"))
        .alias("payload"),
    )


_P = "event_id, CAST(json_extract(props, '$.k') AS INT) % 9 AS m"
_M = "Missing required field: "


@case(
    "c10_validate_chunks",
    f"""SELECT event_id, CASE m WHEN 0 THEN 'content contains only whitespace'
    WHEN 1 THEN 'Empty value for required field: chunk_id|{_M}breadcrumb|metadata must be a dict'
    WHEN 2 THEN 'chunk_type must be a string' WHEN 3 THEN ''
    ELSE '{_M}chunk_id|{_M}breadcrumb|{_M}content' END AS errors, m = 3 AS is_valid FROM (SELECT {_P} FROM events)""",
)
def _(spark, sf):
    out = ck.validate_chunk_json(_payloads(tables(spark, sf)))
    return out.select("event_id", F.array_join("errors", "|").alias("errors"), "is_valid")


@case(
    "c10_validate_chapters",
    f"""SELECT event_id, CASE WHEN k % 3 = 0 THEN '' WHEN k % 3 = 1 THEN '{_M}doc_name|chunks must be a list'
    ELSE '{_M}doc_name|{_M}chapter|{_M}chunks' END AS errors FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)""",
)
def _(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    raw = tables(spark, sf)("events").select(
        "event_id",
        F.when(k % 3 == 0, F.lit('{"doc_name": "a", "chapter": "b", "chunks": []}'))
        .when(k % 3 == 1, F.lit('{"chapter": "b", "chunks": "x"}'))
        .otherwise(F.col("props"))
        .alias("payload"),
    )
    return ck.validate_chapters(raw).select("event_id", F.array_join("errors", "|").alias("errors"))


# --- editing: every document is a chapter file of 40-token chunks --------------------------------


def _chapter_chunks(t):
    c = ck.chunk_by_tokens(t("documents"), max_tokens=40, overlap=0)
    crumb = F.concat(F.lit("doc > "), F.col("full_doc_id").cast("string"), F.lit(" > "), F.col("chunk_order_index").cast("string"))
    return c.select(
        F.col("full_doc_id").alias("file"),
        F.col("chunk_order_index").alias("idx"),
        ck.structured_chunk_id(crumb, F.col("content")).alias("chunk_id"),
        crumb.alias("breadcrumb"),
        "content",
        F.lit("text").alias("chunk_type"),
    )


CHAP = f"""{q.chunk_cte('documents', 40, 0)}, ch AS (SELECT full_doc_id AS file, chunk_order_index AS idx,
    'doc > ' || full_doc_id || ' > ' || chunk_order_index AS breadcrumb, content,
    md5('doc > ' || full_doc_id || ' > ' || chunk_order_index || '_' || content) AS chunk_id FROM chunks)"""


@case(
    "c11_edit_chunks",
    f"""WITH {CHAP} SELECT file, idx, md5(nc) AS content_md5, nb AS breadcrumb, CASE WHEN nc = content AND nb = breadcrumb THEN chunk_id
        ELSE md5(nb || '_' || nc) END AS chunk_id, CASE WHEN idx = 3 THEN 'content cannot be empty or whitespace-only' END AS edit_error
    FROM (SELECT *, CASE idx WHEN 1 THEN content || ' edited' WHEN 2 THEN content ELSE content END AS nc,
        CASE idx WHEN 2 THEN 'moved' ELSE breadcrumb END AS nb FROM ch)""",
)
def _(spark, sf):
    c = _chapter_chunks(tables(spark, sf))
    cmd = c.where("idx BETWEEN 1 AND 4").select(
        "file",
        "chunk_id",
        F.when(F.col("idx") == 1, F.concat("content", F.lit(" edited "))).when(F.col("idx") == 3, F.lit(" ")).otherwise(F.col("content")).alias("new_content"),
        F.when(F.col("idx") == 2, F.lit("moved")).alias("new_breadcrumb"),
    )
    return ck.edit_chunks(c, cmd).select("file", "idx", F.md5("content").alias("content_md5"), "breadcrumb", "chunk_id", "edit_error")


@case(
    "c12_split_chunks",
    f"""WITH {CHAP}, h AS (SELECT *, idx % 2 = 1 AND l <> '' AND r <> '' AS hit FROM (SELECT *, {q.strip('substring(content, 1, 50)')} AS l,
        {q.strip('substring(content, 51)')} AS r FROM ch)),
    s AS (SELECT file, idx, breadcrumb, 0 AS half, CASE WHEN hit THEN l ELSE content END AS content FROM h
        UNION ALL SELECT file, idx, breadcrumb, 1, r FROM h WHERE hit)
    SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY idx, half) - 1 AS INT) AS idx,
        md5(breadcrumb || '_' || content) AS chunk_id FROM s""",
)
def _(spark, sf):
    c = _chapter_chunks(tables(spark, sf))
    cmd = c.where("idx % 2 = 1").select(
        "file", "chunk_id", F.substring("content", 1, 50).alias("left_content"), F.expr("substring(content, 51)").alias("right_content")
    )
    return ck.split_chunks(c, cmd).select("file", "idx", "chunk_id")


@case(
    "c13_merge_chunks",
    f"""WITH {CHAP}, m AS (SELECT *, lead(content) OVER w AS nx, idx % 3 = 0 AND lead(idx) OVER w IS NOT NULL AS keep, idx % 3 = 1 AS gone
        FROM ch WINDOW w AS (PARTITION BY file ORDER BY idx))
    SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY idx) - 1 AS INT) AS idx,
        md5(breadcrumb || '_' || CASE WHEN keep THEN content || chr(10) || chr(10) || nx ELSE content END) AS chunk_id FROM m WHERE NOT gone""",
)
def _(spark, sf):
    c = _chapter_chunks(tables(spark, sf))
    nxt = c.select("file", (F.col("idx") - 1).alias("idx"), F.col("chunk_id").alias("second_id"))
    far = c.select("file", (F.col("idx") - 2).alias("idx"), F.col("chunk_id").alias("second_id"))
    first = c.select("file", "idx", F.col("chunk_id").alias("first_id"))
    good = first.where("idx % 3 = 0").join(nxt, ["file", "idx"])
    bad = first.where("idx % 3 = 1").join(far, ["file", "idx"])  # not adjacent: no effect
    return ck.merge_chunks(c, good.unionByName(bad).drop("idx")).select("file", "idx", "chunk_id")


@case(
    "c14_delete_chunks",
    f"""WITH {CHAP}, n AS (SELECT file, max(idx) AS last FROM ch GROUP BY file)
    SELECT d.file, d.chunk_id AS deleted_id, CAST(last AS BIGINT) AS remaining_count, x.chunk_id AS next_chunk_id
    FROM ch d JOIN n USING (file) LEFT JOIN ch x ON x.file = d.file AND x.idx = CASE WHEN last >= 2 THEN 2 WHEN last = 1 THEN 0 END
    WHERE d.idx = least(1, last)""",
)
def _(spark, sf):
    c = _chapter_chunks(tables(spark, sf))
    last = c.groupBy("file").agg(F.max("idx").alias("last"))
    cmd = c.join(last, "file").where("idx = least(1, last)").select("file", "chunk_id")
    return ck.delete_chunks(c, cmd)[1]


ACTIONS = "CASE event_type WHEN 'click' THEN 'edit' WHEN 'view' THEN 'started' WHEN 'purchase' THEN 'doc_completed' WHEN 'error' THEN 'failed' ELSE 'completed' END"
REG = f"""ev AS (SELECT user_id, event_id, {ACTIONS} AS a FROM events),
    reg AS (SELECT user_id, count(*) AS chunk_count,
        coalesce(arg_max(a = 'edit', event_id) FILTER (a IN ('edit', 'doc_completed')), false) AS dirty,
        coalesce(arg_max(CASE WHEN a = 'started' THEN 'running' WHEN a = 'failed' THEN 'failed' ELSE 'success' END, event_id) FILTER (a <> 'edit'), 'idle') AS last_reprocess_status,
        coalesce(arg_max(CASE WHEN a = 'edit' THEN 'stale' ELSE 'routing_refreshed' END, event_id) FILTER (a IN ('edit', 'completed', 'doc_completed')), 'stale') AS downstream_state
        FROM ev GROUP BY user_id)"""


def _registry(t):
    e = t("events")
    path = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    chapters = e.groupBy(path.alias("relative_path")).agg(F.count(F.lit(1)).alias("chunk_count"))
    empty = e.limit(0).select(path.alias("relative_path"), F.lit(True).alias("dirty"), F.lit("").alias("last_reprocess_status"), F.lit("").alias("downstream_state"))
    log = e.select(path.alias("relative_path"), F.col("event_id").alias("seq"), F.expr(ACTIONS).alias("action"))
    return ck.registry_mark(ck.registry_sync(empty, chapters), log)


@case(
    "c15_chunk_registry",
    f"WITH {REG} SELECT 'u' || user_id AS relative_path, chunk_count, dirty, last_reprocess_status, downstream_state FROM reg",
)
def _(spark, sf):
    return _registry(tables(spark, sf))


@case(
    "c15_registry_summary",
    f"""WITH {REG} SELECT count(*) AS total, count(*) FILTER (dirty) AS dirty, count(*) FILTER (NOT dirty) AS clean,
    count(*) FILTER (last_reprocess_status = 'running') AS reprocessing, count(*) FILTER (downstream_state = 'stale') AS downstream_stale,
    count(*) FILTER (downstream_state <> 'stale') AS downstream_refreshed FROM reg""",
)
def _(spark, sf):
    return ck.registry_summary(_registry(tables(spark, sf)))
