"""Alias log, query intent and alias routing, for whole frames of queries."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.plans.scan import top_k
from corpusloom.plans.textjoin import contained_pairs

# fixed values: entity types that may carry aliases
ALIAS_TYPES = ("EQUIPMENT", "FAULTCASE", "COMPONENT")
# fixed values: intent rules in matching order, preferred types per intent, alias prefixes
INTENT_RULES = {
    "component": ("部件", "组件", "阀", "泵", "滤器", "滤芯", "传感器", "继电器", "开关", "轴承", "线圈", "喷油器", "电磁阀"),
    "procedure": ("怎么", "如何", "排查", "检查", "处理", "解决", "步骤", "维修"),
    "cause": ("原因", "为何", "为什么", "导致", "引起"),
    "caution": ("注意", "注意事项", "避免", "预防"),
    "faultcase": ("故障", "异常", "报警", "报错", "现象", "问题", "失效"),
}
TYPE_ORDER = {
    "component": ("COMPONENT", "EQUIPMENT", "FAULTCASE"),
    "general": ("EQUIPMENT", "FAULTCASE", "COMPONENT"),
}
OTHER_TYPE_ORDER = ("FAULTCASE", "EQUIPMENT", "COMPONENT")
ALIAS_PREFIXES = ("船舶", "船用")


def infer_intent(query: Column, rules: Mapping[str, Sequence[str]] = INTENT_RULES) -> Column:
    q = tx.strip(tx.text_or_empty(query))
    out = None
    for name, words in rules.items():
        hit = q.rlike("|".join(re.escape(w) for w in words))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit("general"))


def preferred_types(intent: Column) -> Column:
    out = F.array(*[F.lit(t) for t in OTHER_TYPE_ORDER])
    for name, order in TYPE_ORDER.items():
        out = F.when(intent == name, F.array(*[F.lit(t) for t in order])).otherwise(out)
    return out


# --- alias log ----------------------------------------------------------------------------------


def _violation() -> Column:
    t = F.upper(tx.strip(tx.text_or_empty(F.col("entity_type"))))
    return (
        F.when(tx.is_blank(F.col("canonical_name")), F.lit("canonical_name is required"))
        .when(tx.is_blank(F.col("alias")), F.lit("alias is required"))
        .when(~t.isin(*ALIAS_TYPES), F.lit("unsupported entity_type"))
        .when(tx.alias_norm(F.col("alias")) == "", F.lit("alias_norm cannot be empty"))
    )


def _record(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "canonical_name": tx.strip(F.col("canonical_name")),
        "entity_type": F.upper(tx.strip(F.col("entity_type"))),
        "alias": tx.strip(F.col("alias")),
        "alias_norm": tx.alias_norm(F.col("alias")),
        "enabled": F.coalesce("enabled", F.lit(True)),
        "reviewed": F.coalesce("reviewed", F.lit(False)),
    })


def replay_aliases(events: DataFrame, datasource_id: str) -> tuple[DataFrame, DataFrame]:
    """Latest state of an append-only log ``events(seq, id, datasource_id, canonical_name, entity_type,
    alias, enabled, reviewed, deleted, updated_at)`` and its violations.

    The last event per id is a ``max_by``, so a busy id costs one row per map task.
    """
    cols = [c for c in events.columns if c not in ("seq", "id")]
    last = events.groupBy("id").agg(F.max("seq").alias("seq"), F.max_by(F.struct(*cols), "seq").alias("e")).select("id", "seq", "e.*")
    live = last.where(~F.coalesce(F.col("deleted"), F.lit(False))).withColumn("datasource_id", F.coalesce("datasource_id", F.lit(datasource_id)))
    scope = F.when(F.col("datasource_id") != datasource_id, F.lit("datasource_id does not match the scope"))
    judged = live.withColumn("violation", F.coalesce(scope, _violation()))
    good = judged.where(F.col("violation").isNull()).drop("violation", "deleted")
    return _record(good), judged.where(F.col("violation").isNotNull()).select("id", "seq", "violation")


def _identity(df: DataFrame) -> list[Column]:
    return [F.col("entity_type"), F.col("canonical_name"), F.col("alias_norm")]


def create_aliases(state: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``batch(id, ord, …)`` to create events and violations; the identity (type, canonical, norm)
    must be new, the first of the batch wins."""
    judged = batch.withColumn("violation", _violation())
    good = _record(judged.where(F.col("violation").isNull()).drop("violation"))
    key = ["entity_type", "canonical_name", "alias_norm"]
    firsts = good.groupBy(*key).agg(F.min("ord").alias("ord"))
    fresh = good.join(firsts, [*key, "ord"], "left_semi").join(state.select(*key), key, "left_anti")
    bad = judged.where(F.col("violation").isNotNull()).select("id", "violation").unionByName(
        good.join(fresh.select("id"), "id", "left_anti").select("id", F.lit("alias already exists").alias("violation"))
    )
    return fresh, bad


def update_aliases(state: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Partial updates by id (nulls ignored): changed records and violations."""
    fields = [c for c in ("canonical_name", "entity_type", "alias", "enabled", "reviewed") if c in updates.columns]
    u = updates.select("id", *[F.col(c).alias(f"_u_{c}") for c in fields])
    changed = state.join(u, "id").select(
        *[F.coalesce(F.col(f"_u_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in state.columns]
    )
    judged = changed.withColumn("violation", _violation())
    good = _record(judged.where(F.col("violation").isNull()).drop("violation"))
    key = ["entity_type", "canonical_name", "alias_norm"]
    others = state.select(F.col("id").alias("_other"), *key)
    clash = good.join(others, key).where(F.col("_other") != F.col("id")).select("id").distinct()
    missing = updates.select("id").join(state.select("id"), "id", "left_anti").select("id", F.lit("unknown id").alias("violation"))
    bad = (
        judged.where(F.col("violation").isNotNull()).select("id", "violation")
        .unionByName(clash.select("id", F.lit("alias already exists").alias("violation")))
        .unionByName(missing)
    )
    return good.join(clash, "id", "left_anti"), bad


def delete_aliases(state: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tombstone events for known ids, and violations for unknown ones."""
    known = ids.join(state.select("id"), "id", "left_semi").select("id", F.lit(True).alias("deleted"))
    return known, ids.join(state.select("id"), "id", "left_anti").select("id", F.lit("unknown id").alias("violation"))


def list_aliases(state: DataFrame, entity_type: str | None = None, enabled: bool | None = None, reviewed: bool | None = None, query: str | None = None) -> DataFrame:
    """Filtered aliases; their order is (entity_type, canonical_name, alias_norm, updated_at)."""
    out = state
    if entity_type:
        out = out.where(F.col("entity_type") == entity_type.strip().upper())
    if enabled is not None:
        out = out.where(F.col("enabled") == enabled)
    if reviewed is not None:
        out = out.where(F.col("reviewed") == reviewed)
    if query:
        hay = F.concat("alias_norm", tx.alias_norm(F.col("canonical_name")))
        needle = tx.alias_norm(F.lit(query))
        out = out.where((needle == "") | F.contains(hay, needle))
    return out.orderBy("entity_type", "canonical_name", "alias_norm", "updated_at")


def alias_stats(state: DataFrame) -> DataFrame:
    """``(name, n)``: total, enabled, reviewed and ``type:<T>`` rows."""
    g = state.groupBy("entity_type").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("enabled").alias("enabled"), F.count_if("reviewed").alias("reviewed")
    )
    types = g.select(F.concat(F.lit("type:"), "entity_type").alias("name"), F.col("total").alias("n"))
    sums = g.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "enabled", "reviewed")])
    return types.unionByName(sums.unpivot([], ["total", "enabled", "reviewed"], "name", "n"))


def derive_aliases(records: DataFrame, existing: DataFrame | None = None, prefixes: Sequence[str] = ALIAS_PREFIXES) -> tuple[DataFrame, DataFrame]:
    """Aliases of equipment names without their prefix, and created/skipped counts.

    ``records(equipment)``: every record counts; a record without a derived alias, or whose alias
    is already there, is skipped.
    """
    name = tx.strip(tx.text_or_empty(F.col("equipment")))
    cut_ = F.array(*[
        F.when(F.col("canonical_name").startswith(p), tx.strip(F.expr(f"substring(canonical_name, {len(p) + 1})"))) for p in prefixes
    ])
    r = records.select(name.alias("canonical_name")).where("canonical_name <> ''").groupBy("canonical_name").agg(F.count(F.lit(1)).alias("n"))
    r = r.withColumn("alias", F.filter(F.array_compact(cut_), lambda a: ~tx.alias_norm(a).isin("") & (tx.alias_norm(a) != tx.alias_norm(F.col("canonical_name")))))
    none = r.where(F.size("alias") == 0).agg(F.sum("n").alias("n"))
    per = r.select("canonical_name", "n", F.explode("alias").alias("alias")).withColumn("alias_norm", tx.alias_norm(F.col("alias")))
    per = per.groupBy("canonical_name", "alias_norm").agg(F.min("alias").alias("alias"), F.max("n").alias("n"))
    created = per.withColumn("entity_type", F.lit("EQUIPMENT"))
    if existing is not None:
        created = created.join(existing.select("entity_type", "canonical_name", "alias_norm"), ["entity_type", "canonical_name", "alias_norm"], "left_anti")
    counts = (
        created.agg(F.count(F.lit(1)).alias("n")).select(F.lit("created").alias("name"), "n")
        .unionByName(
            none.select(F.coalesce("n", F.lit(0)).alias("n"))
            .unionByName(per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")))
            .unionByName(created.agg((-F.count(F.lit(1))).alias("n")))
            .agg(F.sum("n").alias("n"))
            .select(F.lit("skipped").alias("name"), "n")
        )
    )
    return created.select("canonical_name", "entity_type", "alias", "alias_norm"), counts


# --- matching -------------------------------------------------------------------------------------


def match_aliases(queries: DataFrame, aliases: DataFrame, limit: int = 8, preferred: str | None = None) -> DataFrame:
    """Best aliases per query ``(query_id, rank, alias columns, score)``.

    ``queries(query_id, query[, preferred types])``, ``aliases(id, canonical_name, entity_type,
    alias_norm, enabled, reviewed)``.  Both containment directions are substring joins over
    distinct texts.
    """
    q = queries.withColumn("_qn", tx.alias_norm(F.col("query"))).where("_qn <> ''")
    a = aliases.where("enabled AND alias_norm <> ''")
    qt, at = q.select("_qn").distinct(), a.select("alias_norm").distinct()
    inside = contained_pairs(at, qt, "alias_norm", "_qn").withColumn("_base", 5000 + F.length("alias_norm") * 20)
    around = (
        contained_pairs(qt.where(F.length("_qn") >= 2), at, "_qn", "alias_norm")
        .where(F.length("alias_norm") > F.length("_qn"))
        .withColumn("_base", 2000 + F.length("_qn") * 10)
    )
    pairs = inside.select("_qn", "alias_norm", "_base").unionByName(around.select("_qn", "alias_norm", "_base"))
    j = pairs.join(q, "_qn").join(a, "alias_norm")
    if preferred:
        at_ = F.array_position(preferred, F.col("entity_type"))
        prio = F.when(at_ > 0, F.size(preferred) - at_ + 1).otherwise(F.lit(0))
    else:
        prio = F.lit(0)
    scored = j.withColumn("score", (F.col("_base") + prio * 25 + F.when(F.col("reviewed"), F.lit(80)).otherwise(F.lit(0))).cast("long"))
    order = [F.desc("score"), F.desc("reviewed"), F.desc(F.length("alias_norm")), F.col("id")]
    return top_k(scored, "query_id", order, limit).select(
        "query_id", "rank", "id", "canonical_name", "entity_type", "alias_norm", "reviewed", "score"
    )


def route_queries(queries: DataFrame, aliases: DataFrame | None, rules: Mapping[str, Sequence[str]] = INTENT_RULES, limit: int = 8) -> tuple[DataFrame, DataFrame]:
    """``(query_id, query, intent, ranked_types)`` and the best alias hit per canonical name."""
    q = queries.withColumn("intent", infer_intent(F.col("query"), rules)).withColumn("_pref", preferred_types(F.col("intent")))
    if aliases is None:
        hits = queries.select("query_id", F.lit("").alias("canonical_name"), F.lit(0).cast("long").alias("score"), F.lit("").alias("entity_type")).limit(0)
        return q.select("query_id", "query", "intent", F.col("_pref").alias("ranked_types")), hits
    found = match_aliases(q, aliases, limit, "_pref")
    # at most ``limit`` rows per query, so the collected list is bounded
    types = found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "entity_type"))).alias("_t"))
    ranked = F.array_distinct(F.concat(F.coalesce(F.col("_t.entity_type"), F.array().cast("array<string>")), F.col("_pref")))
    routed = q.join(types, "query_id", "left").select("query_id", "query", "intent", ranked.alias("ranked_types"))
    best = found.groupBy("query_id", "canonical_name").agg(
        F.max_by(F.struct("score", "entity_type"), F.struct("score", -F.col("rank"))).alias("b")
    ).select("query_id", "canonical_name", "b.score", "b.entity_type")
    return routed, best
