"""Sinks for chunks, graphs, question sets, judged results and cards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import records as rec
from corpusloom.operators.graph import relation_type, unquote


def write_routed(routed: DataFrame, path: str) -> None:
    """Routed chunks, one partition per issue folder; a new run replaces the old output."""
    routed.write.mode("overwrite").partitionBy("issue_folder").json(path)


def write_qa_json(rows: DataFrame, path: str) -> None:
    """Question rows as JSON lines with the published field names."""
    rows.select(
        F.col("question").alias("Question"), F.col("gold_answer").alias("Gold Answer"), F.col("evidence").alias("Evidence"), F.col("question_type").alias("Type")
    ).write.mode("overwrite").json(path)


def export_graph(nodes: DataFrame, edges: DataFrame, type_cols: Sequence[str] = ("relation_type", "keywords", "type")) -> tuple[DataFrame, DataFrame]:
    """Graph as interchange rows: nodes with ``id`` and ``labels``, edges with ``source``, ``target``, ``type``."""
    name = unquote(F.col("entity_name"))
    n = nodes.select("*", name.alias("id"), F.array(name).alias("labels"))
    have = [c for c in type_cols if c in edges.columns]
    rest = [c for c in edges.columns if c not in ("src", "dst", "type")]
    e = edges.select(*rest, F.col("src").alias("source"), F.col("dst").alias("target"), relation_type(have).alias("type"))
    return n, e


def judged_wide(long: DataFrame, modes: Sequence[str]) -> DataFrame:
    """Question rows with ``<mode>_Answer/_Score/_Recall`` triples from ``long(question columns, mode,
    answer, score, recall)``; the modes are given, so the pivot needs no extra pass."""
    keys = [c for c in long.columns if c not in ("mode", "answer", "score", "recall")]
    wide = long.groupBy(*keys).pivot("mode", list(modes)).agg(
        F.first("answer").alias("Answer"), F.first("score").alias("Score"), F.first("recall").alias("Recall")
    )
    cells = [F.coalesce(F.col(f"`{m}_{f}`").cast("string"), F.lit("")).alias(f"{m}_{f}") for m in modes for f in ("Answer", "Score", "Recall")]
    return wide.select(*keys, *cells)


def write_judged_results(long: DataFrame, modes: Sequence[str], path: str) -> None:
    judged_wide(long, modes).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def export_cards(records: DataFrame, path: str) -> None:
    """Card texts and overviews, partitioned by kind and document.

    ``records`` need ``position`` besides the record columns.
    """
    cards = records.select(F.lit("cards").alias("kind"), "doc_name", rec.render_card().alias("value"))
    overview = rec.overview_lines(records).select(F.lit("overview").alias("kind"), "doc_name", F.col("text").alias("value"))
    cards.unionByName(overview).write.mode("overwrite").partitionBy("kind", "doc_name").option("lineSep", "\n" + "-" * 80 + "\n").text(path)
