"""License scan: exact containment join of word blocks with license templates, and fixed phrases."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import split_words, texts, words_line

# Phrases (their words must stand consecutively) and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Notices by which files and pages declare their license.
TEMPLATES = {
    "mit": [
        "released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "apache-2": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License"],
    "gpl-3": ["licensed under the GNU General Public License, version 3"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "mpl-2": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution NonCommercial 4.0 International License"],
    "cc-by-sa": ["licensed under a Creative Commons Attribution ShareAlike 4.0 International License"],
}


def template_words(text: str) -> list[str]:
    """Distinct words of an ASCII template, in order."""
    plain = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower())
    return list(dict.fromkeys(plain.split()))


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _before(line: Column, phrase: str, last: bool) -> Column:
    """Words before the first (or up to the last) place of a phrase in a line whose words each stand between blanks."""
    if last:
        after = F.substring_index(line, phrase, -1)
        return _count_words(line) - _count_words(after) - (phrase.count("  ") + 1)
    return _count_words(F.substring_index(line, phrase, 1))


def _count_words(line: Column) -> Column:
    return ((F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))) / 2).cast("long")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None, phrases: dict[str, str] | None = None, containment: float = 0.8) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A block is a run of twice as many words as the longest template has, starting at every multiple of that
    number, so that each passage of a template's length lies whole in a block. A block meets a template if it
    holds at least ``containment`` of the template's distinct words; ``score`` is the largest share met, 1 where
    a phrase stands, else 0. Labels are distinct, sorted and comma-joined; without any, the strings are empty.
    Null or empty text has no word. Repeated rows give equal results; an empty table gives no rows.

    Exact: words are ordered by the number of documents that hold them. A block that shares ``need`` of a
    template's words must hold one of its first (size - need + 1) words in that order (prefix filter, used on
    documents before any block is made), must hold ``need`` template words (length filter), and enough words
    must follow the match in both lists (positional filter). What passes is verified by the full overlap.
    Words outside all templates cannot count and leave the lists. Only the counts of template words, a fixed
    vocabulary, come to the driver; the broadcast prefix index has a row per template word at most.
    """
    phrases = PHRASES if phrases is None else phrases
    chosen = [(label, template_words(t)) for label, ts in (TEMPLATES if templates is None else templates).items() for t in ts]
    chosen = [(label, ws) for label, ws in chosen if ws]
    vocabulary = sorted({w for _, ws in chosen for w in ws})
    rows = texts(docs, id_col, text_col).select("id", F.xxhash64("text").alias("th"), words_line(F.col("text")).alias("line"))

    seen = rows.select(F.explode(F.array_intersect(split_words(F.col("line")), _strings(vocabulary))).alias("w")).groupBy("w").count()
    counts = {r["w"]: r["count"] for r in seen.collect()} if vocabulary else {}
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    place = {w: i for i, w in enumerate(order)}
    index, longest = [], 1
    for number, (label, ws) in enumerate(chosen):
        longest = max(longest, len(ws))
        need = math.ceil(containment * len(ws) - 1e-9)
        ws = sorted(ws, key=place.__getitem__)
        for i, w in enumerate(ws[: len(ws) - need + 1]):
            index.append((w, number, label, i, len(ws), need, ws))

    base = _base(rows, phrases)
    if not index:
        return _result(base.withColumn("met", F.array().cast("array<string>")).withColumn("share", F.lit(0.0)), id_col)
    prefix = docs.sparkSession.range(1).select(
        F.inline(F.array(*[F.struct(F.lit(w).alias("w"), F.lit(n).alias("template"), F.lit(label).alias("label"), F.lit(i).alias("i"), F.lit(size).alias("size"), F.lit(need).alias("need"), _strings(ws).alias("ws")) for w, n, label, i, size, need, ws in index]))
    )
    words = rows.select("id", "th", split_words(F.col("line")).alias("words"))
    words = words.where(F.arrays_overlap("words", _strings(sorted({x[0] for x in index}, key=place.__getitem__))))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - longest - 1), F.lit(longest))
    blocks = words.select("id", "th", "words", F.explode(starts).alias("start"))
    blocks = blocks.select("id", "th", "start", F.array_intersect(_strings(order), F.slice("words", F.col("start") + 1, F.lit(2 * longest))).alias("block"))
    hits = blocks.select("*", F.posexplode("block").alias("j", "w")).join(F.broadcast(prefix), "w")
    enough = (F.size("block") >= F.col("need")) & (1 + F.least(F.col("size") - 1 - F.col("i"), F.size("block") - 1 - F.col("j")) >= F.col("need"))
    overlap = F.size(F.array_intersect("block", "ws"))
    met = hits.where(enough).where(overlap >= F.col("need")).groupBy("id", "th").agg(F.collect_set("label").alias("met"), F.max(overlap / F.col("size")).alias("share"))
    joined = base.join(met.withColumnsRenamed({"id": "met_id", "th": "met_th"}), F.col("id").eqNullSafe(F.col("met_id")) & (F.col("th") == F.col("met_th")), "left")
    return _result(joined, id_col)


def _base(rows: DataFrame, phrases: dict[str, str]) -> DataFrame:
    spaced = F.concat(F.lit(" "), F.replace(F.col("line"), F.lit(" "), F.lit("  ")), F.lit(" "))
    forms = {" " + p.replace(" ", "  ") + " ": label for p, label in phrases.items()}
    any_of = reduce(lambda a, b: a | b, [F.col("line").contains(p) for p in phrases], F.lit(False))
    n_words = F.when(F.col("line") == "", 0).otherwise(F.length("line") - F.length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1).cast("long")
    out = rows.select("id", "th", n_words.alias("n_words"), F.when(any_of, spaced).alias("spaced"))
    line = F.col("spaced")
    counts = [((F.length(line) - F.length(F.replace(line, F.lit(p), F.lit("")))) / len(p)).cast("long") for p in forms]
    places = [F.when(line.contains(p), f) for p in forms for f in [_before(line, p, False)]]
    lasts = [F.when(line.contains(p), f) for p in forms for f in [_before(line, p, True)]]
    labels = [F.when(line.contains(p), F.lit(label)) for p, label in forms.items()]
    pick = lambda a, f: f(F.array_compact(F.array(*a)))
    return out.select(
        "id",
        "th",
        "n_words",
        F.coalesce(reduce(lambda a, b: a + b, counts), F.lit(0)).cast("long").alias("n_base"),
        pick(places, F.array_min).alias("first_word"),
        pick(lasts, F.array_max).alias("last_word"),
        F.coalesce(F.array_compact(F.array(*labels)), F.array().cast("array<string>")).alias("base"),
    )


def _result(df: DataFrame, id_col: str) -> DataFrame:
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    met = F.coalesce("met", F.array().cast("array<string>"))
    return df.select(
        F.col("id").alias(id_col),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        joined(F.col("base")).alias("base_labels"),
        joined(F.concat("base", met)).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
