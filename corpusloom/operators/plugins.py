"""Plug-in points: the user's functions and where they run.

* chunker: ``DataFrame(doc_id, content) -> chunks`` given to ``process_queue``, ``reindex_documents`` or ``stream_ingest``
  (default ``chunk_by_tokens``; ``chunks.chunk_by_separator`` makes another);
* tokenizer / analyser: ``Column -> Column`` (defaults ``count_tokens``, ``analyse``), or ``token_counter`` for
  a Python tokenizer;
* embedder: ``list[str] -> array`` run by ``vectors.embed``;
* extractor: ``str -> str`` run by ``extract``;
* reranker: ``(query, text) -> score`` run by ``scored_pairs`` (score and error) or wrapped by ``pair_scorer``;
* review: ``(nodes, edges) -> (nodes, edges)`` given to ``build_graph``;
* parent namer: ``(title, rule name) -> name`` column function given to ``resolve_parents``, or a Python
  function wrapped by ``parent_namer``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Extractor = Callable[[str], str]


def rule_extractor(text: str) -> str:
    """Offline stand-in for a model: capitalised words become entities, neighbours get a relation."""
    names = list(dict.fromkeys(re.findall(r"\b[A-Z][a-z]{3,}\b", text)))
    rows = [f'("entity"<|>{n}<|>TERM<|>{n} in text)' for n in names]
    rows += [f'("relationship"<|>{a}<|>{b}<|>follow each other<|>Near | sequence<|>1)' for a, b in zip(names, names[1:])]
    return "##".join(rows) + "<|COMPLETE|>"


def extract(chunks: DataFrame, extractor: Extractor = rule_extractor, rounds: int = 0, more: Callable[[str, str], str | None] | None = None) -> DataFrame:
    """Responses ``(chunk_id, ord, response, error)`` of ``chunks(chunk_id, ord, content)``.

    Up to ``rounds`` times ``more(text, response so far)`` may add text; null ends it.  A failing
    call gives a null response and its message as ``error``, so that an outage can be counted.
    """
    kinds = dict(chunks.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, errors = [], []
            for text in pdf["content"]:
                error = None
                try:
                    got = extractor(text)
                    for _ in range(rounds if more else 0):
                        extra = more(text, got)
                        if not extra:
                            break
                        got += extra
                except Exception as e:  # noqa: BLE001
                    got, error = None, f"{type(e).__name__}: {e}"
                out.append(got)
                errors.append(error)
            yield pd.DataFrame({"chunk_id": pdf["chunk_id"], "ord": pdf["ord"], "response": pd.Series(out, dtype=object, index=pdf.index), "error": pd.Series(errors, dtype=object, index=pdf.index)})

    return chunks.select("chunk_id", "ord", "content").mapInPandas(run, f"chunk_id {kinds['chunk_id']}, ord {kinds['ord']}, response string, error string")


def scored_pairs(pairs: DataFrame, score: Callable[[str, str], float | None], query: str = "query", text: str = "content") -> DataFrame:
    """All columns of ``pairs``, the score of a Python pair scorer and its error: a failing call gives a null score and its
    message, so that an outage can be counted; no score and no error means that the scorer gave none."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            scores, errors = [], []
            for a, b in zip(pdf[query], pdf[text]):
                got, error = None, None
                try:
                    got = score(a, b)
                except Exception as e:  # noqa: BLE001
                    error = f"{type(e).__name__}: {e}"
                scores.append(got)
                errors.append(error)
            yield pdf.assign(score=pd.Series(scores, dtype="float64", index=pdf.index), score_error=pd.Series(errors, dtype=object, index=pdf.index))

    return pairs.mapInPandas(run, f"{fields}, score double, score_error string")


def pair_scorer(score: Callable[[str, str], float | None], query: str = "query", text: str = "content") -> Column:
    """A Python pair scorer as a column; errors and missing scores are null (``scored_pairs`` tells them apart)."""

    @F.pandas_udf("double")
    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        def one(a, b):
            try:
                return score(a, b)
            except Exception:  # noqa: BLE001
                return None

        return pd.Series([one(a, b) for a, b in zip(q, t)], dtype="float64")

    return run(F.col(query), F.col(text))


def token_counter(count: Callable[[str], int]) -> Callable[[Column], Column]:
    """A Python tokenizer's counter, usable wherever ``tokens=`` is accepted."""

    @F.pandas_udf("int")
    def run(t: pd.Series) -> pd.Series:
        return t.fillna("").map(count).astype("int32")

    return run


def parent_namer(name: Callable[[str], str | None], mode: str = "hybrid") -> Callable[[Column, Column], Column] | None:
    """Parent naming by a Python function.

    ``rule`` never calls it, ``hybrid`` only where no rule matched (the rule gave the title back),
    ``model`` always; null or failure falls back to the rule.
    """
    if mode == "rule":
        return None

    @F.pandas_udf("string")
    def run(titles: pd.Series) -> pd.Series:
        def one(t):
            try:
                return name(t) or None
            except Exception:  # noqa: BLE001
                return None

        return titles.map(one)

    def column(title: Column, rule: Column) -> Column:
        given = run(F.when(rule == title, title)) if mode == "hybrid" else run(title)
        return F.when((rule != title) & F.lit(mode == "hybrid"), rule).otherwise(given)

    return column
