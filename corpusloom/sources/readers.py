"""Readers of corpora, chapter and record JSON, question sets, GraphML and alias logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators.graph import unquote
from corpusloom.plans.scan import ordered_parts

CHUNK_SCHEMA = "array<struct<chunk_id:string,breadcrumb:string,content:string,chunk_type:string,metadata:map<string,string>>>"
CHAPTER_SCHEMA = f"doc_name string, chapter string, chunks {CHUNK_SCHEMA}"
RECORD_FIELDS = "record_id:string,section_group:string,record_title:string,breadcrumb:string,equipment:string,fault:string,symptom:string,causes:array<string>,actions:array<string>,consequences:array<string>,precautions:array<string>,key_components:array<string>,source_text:string"
RECORD_SCHEMA = f"doc_name string, doc_type string, records array<struct<{RECORD_FIELDS}>>"
ALIAS_SCHEMA = "seq long, id string, datasource_id string, canonical_name string, entity_type string, alias string, enabled boolean, reviewed boolean, deleted boolean, created_at string, updated_at string"
# fixed values: supported text files, question file headers, punctuation trimmed from record texts
TEXT_SUFFIXES = ("md", "txt")
QA_HEADERS = {
    "question_id": ("question_id", "questionId", "Question ID", "QuestionID", "id"),
    "question": ("question", "Question"),
    "gold_answer": ("answer", "gold_answer", "Gold Answer"),
    "evidence": ("evidence", "Evidence"),
    "question_type": ("question_type", "questionType", "Type"),
}
RECORD_TRIM = " \t。；;，,、."


def read_text_corpus(spark: SparkSession, root: str, suffixes: Sequence[str] = TEXT_SUFFIXES) -> DataFrame:
    """One row per text file below ``root``: ``(path, name, content)``."""
    bad = [s for s in suffixes if s.lower().lstrip(".") not in TEXT_SUFFIXES]
    if bad:
        raise ValueError(f"unsupported text suffixes: {bad}")
    glob = "*.{" + ",".join(s.lstrip(".") for s in suffixes) + "}"
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root, wholetext=True)
    return df.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("content")
    )


def flatten_sheet_rows(cells: DataFrame, part_rows: int = 100_000) -> DataFrame:
    """Text of spreadsheets ``cells(book, sheet, sheet_no, row_no, values array)``: non-empty cells of a row
    joined by `` | ``, rows under ``# sheet``; one row per sheet (parts for very long sheets)."""
    line = F.array_join(tx.clean_list(F.col("values")), " | ")
    rows = cells.withColumn("line", line).where("line <> ''")
    parts = ordered_parts(rows, ["book", "sheet_no", "sheet"], "row_no", "line", "lines", part_rows)
    head = F.when(F.col("part_no") == 0, F.concat(F.lit("# "), "sheet", F.lit("\n"))).otherwise(F.lit(""))
    return parts.select("book", "sheet_no", "sheet", "part_no", F.concat(head, F.array_join("lines", "\n")).alias("text"))


def read_chapters(spark: SparkSession, root: str, multi_line: bool = True) -> DataFrame:
    """Chunks of chapter JSON files (one per file, or one per line) ``(chapter_file, doc_name, chapter, chunk_index, chunk columns)``."""
    df = spark.read.schema(CHAPTER_SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(root, multiLine=multi_line)
    return df.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("chapter_file"), "doc_name", "chapter", F.posexplode("chunks").alias("chunk_index", "c")
    ).select("path", "chapter_file", "doc_name", "chapter", "chunk_index", "c.*")


def clean_record_text(c: Column) -> Column:
    """Line breaks flattened, outer punctuation and a leading list number removed."""
    flat = F.btrim(F.regexp_replace(tx.text_or_empty(c), "[\r\n]", " "), F.lit(RECORD_TRIM))
    return F.btrim(F.regexp_replace(flat, r"^(?:[（(]?\d+[）).、]\s*|\.\s+)", ""), F.lit(RECORD_TRIM))


def read_records(spark: SparkSession, root: str, multi_line: bool = True) -> DataFrame:
    """Records of record JSON files (one per file, or one per line) with cleaned texts; id, equipment and fault are required."""
    df = spark.read.schema(RECORD_SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(root, multiLine=multi_line)
    r = df.select("doc_name", F.posexplode("records").alias("ord", "r")).select("doc_name", "ord", "r.*")
    lists = ("causes", "actions", "consequences", "precautions", "key_components")
    texts = ("record_id", "equipment", "fault", "symptom")
    empty = F.array().cast("array<string>")
    out = r.withColumns({
        **{c: clean_record_text(F.col(c)) for c in texts},
        **{c: F.coalesce(F.filter(F.transform(c, clean_record_text), lambda x: x != ""), empty) for c in lists},
    })
    return out.where("record_id <> '' AND equipment <> '' AND fault <> ''").withColumn("record_key", F.concat_ws("::", "doc_name", "record_id"))


def read_qa_csv(spark: SparkSession, path: str) -> DataFrame:
    """Question rows of CSV files with a BOM and any of the known header spellings, trimmed.

    Every file has its own header: files whose first lines are alike are read together, so that columns are found by
    name in each, whatever their order. The driver gets one line per file. Empty files have no rows.
    """
    at = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), at.alias("at"), "value")
    by_head: dict[str, list[str]] = {}
    for r in lines.groupBy("file").agg(F.min_by("value", "at").alias("head")).orderBy("file").collect():
        by_head.setdefault(r["head"], []).append(r["file"])
    read = spark.read.option("header", "true").option("multiLine", "true").option("quote", '"').option("escape", '"')
    out = spark.createDataFrame([], ", ".join(f"{c} string" for c in QA_HEADERS))
    for files in by_head.values():
        raw = read.csv(files)
        raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
        have = {out: [F.nullif(tx.strip(F.col(f"`{n}`")), F.lit("")) for n in names if n in raw.columns] for out, names in QA_HEADERS.items()}
        out = out.unionByName(raw.select(*[F.coalesce(*cols, F.lit("")).alias(c) for c, cols in have.items()]))
    return out


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of GraphML files; attributes are found through the ``key`` declarations of their own file."""
    data = "data array<struct<_VALUE:string,_key:string>>"

    def read(tag: str, schema: str) -> DataFrame:
        df = spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", "true").schema(schema).load(path)
        return df.select("*", F.col("_metadata.file_path").alias("_file"))

    # one row per file; its list has one entry per attribute
    declared = read("key", "_id string, `_attr.name` string, _for string").select("_file", F.col("_id").alias("id"), F.col("`_attr.name`").alias("name"), F.col("_for").alias("kind"))
    keys = declared.groupBy("_file").agg(F.collect_set(F.struct("id", "name", F.coalesce("kind", F.lit("all")).alias("kind"))).alias("_keys"))

    def rows(tag: str, schema: str) -> DataFrame:
        return read(tag, schema).join(keys, "_file", "left")

    def attr(kind: str, name: str) -> Column:
        ids = F.transform(F.filter("_keys", lambda k: (k["name"] == name) & k["kind"].isin(kind, "all")), lambda k: k["id"])
        hit = F.filter("data", lambda d: F.array_contains(ids, d["_key"]))
        return F.coalesce(F.get(hit, F.lit(0))["_VALUE"], F.lit(""))

    nodes = rows("node", f"_id string, {data}").select(
        unquote(F.col("_id")).alias("entity_name"), unquote(attr("node", "entity_type")).alias("entity_type"),
        attr("node", "description").alias("description"), attr("node", "source_id").alias("source_id"),
    )
    edges = rows("edge", f"_source string, _target string, {data}").select(
        unquote(F.col("_source")).alias("src"), unquote(F.col("_target")).alias("dst"),
        F.coalesce(attr("edge", "weight").try_cast("double"), F.lit(0.0)).alias("weight"),
        *[attr("edge", n).alias(n) for n in ("description", "keywords", "relation_type", "source_id")],
    )
    return nodes, edges


def read_alias_events(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """JSON-lines alias log, as a batch or as a stream of files."""
    reader = (spark.readStream if streaming else spark.read).schema(ALIAS_SCHEMA)
    return reader.json(path)
