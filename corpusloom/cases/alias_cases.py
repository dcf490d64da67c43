"""Intent, alias log, alias matching and routing."""

from pyspark.sql import functions as F

from corpusloom.cases import case
from corpusloom.cases import sqltext as q
from corpusloom.functions import text as tx
from corpusloom.operators import aliases as al
from corpusloom.plans.session import tables

RULES = {"component": ("the ", "der "), "procedure": ("ing",), "cause": ("tion",), "caution": ("que",), "faultcase": ("en",)}
INTENT = "CASE " + " ".join(
    f"WHEN {' OR '.join(f'contains({{x}}, $${w}$$)' for w in words)} THEN '{name}'" for name, words in RULES.items()
) + " ELSE 'general' END"


def intent_sql(x):
    return INTENT.replace("{x}", q.strip(x))


PREF = "CASE {i} WHEN 'component' THEN ['COMPONENT', 'EQUIPMENT', 'FAULTCASE'] WHEN 'general' THEN ['EQUIPMENT', 'FAULTCASE', 'COMPONENT'] ELSE ['FAULTCASE', 'EQUIPMENT', 'COMPONENT'] END"


@case(
    "g01_infer_intent",
    f"SELECT conv_id, turn, intent, array_to_string({PREF.replace('{i}', 'intent')}, '|') AS types FROM (SELECT conv_id, turn, {intent_sql('text')} AS intent FROM conversations WHERE role = 'user')",
)
def _(spark, sf):
    c = tables(spark, sf)("conversations").where("role = 'user'").withColumn("intent", al.infer_intent(F.col("text"), RULES))
    return c.select("conv_id", "turn", "intent", F.array_join(al.preferred_types(F.col("intent")), "|").alias("types"))


def _log(t):
    """Events as an alias log: one alias per user and event type; errors are tombstones."""
    return t("events").select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("a"), "user_id").alias("id"),
        F.when(F.col("user_id") == 7, F.lit("other")).otherwise(F.lit("ds")).alias("datasource_id"),
        F.concat(F.lit(" User "), "user_id").alias("canonical_name"),
        F.when(F.col("event_type") == "view", F.lit("component")).otherwise(F.lit("EQUIPMENT")).alias("entity_type"),
        F.when(F.col("value") > 1, F.concat("event_type", F.lit("-"), "user_id")).otherwise(F.lit(" ")).alias("alias"),
        F.lit(True).alias("enabled"),
        (F.col("value") > 10).alias("reviewed"),
        (F.col("event_type") == "error").alias("deleted"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("updated_at"),
    )


LAST = "last AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)"


@case(
    "g02_replay_aliases",
    f"""WITH {LAST} SELECT 'a' || user_id AS id, 'User ' || user_id AS canonical_name, CASE WHEN event_type = 'view' THEN 'COMPONENT' ELSE 'EQUIPMENT' END AS entity_type,
    event_type || user_id AS alias_norm, value > 10 AS reviewed, NULL AS violation FROM last WHERE event_type <> 'error' AND user_id <> 7 AND value > 1
    UNION ALL SELECT 'a' || user_id, NULL, NULL, NULL, NULL, CASE WHEN user_id = 7 THEN 'datasource_id does not match the scope' ELSE 'alias is required' END
    FROM last WHERE event_type <> 'error' AND (user_id = 7 OR value <= 1)""",
)
def _(spark, sf):
    good, bad = al.replay_aliases(_log(tables(spark, sf)), "ds")
    return good.select("id", "canonical_name", "entity_type", "alias_norm", "reviewed", F.lit(None).cast("string").alias("violation")).unionByName(
        bad.select("id", "violation"), True
    )


def part_aliases(t):
    """Part names by their last word (EQUIPMENT) and brands (COMPONENT) as alias table."""
    p = t("part")
    odd = (F.max("p_size") % 2 == 1).alias("reviewed")
    names = p.groupBy("p_name").agg(odd).select(
        F.col("p_name").alias("canonical_name"), F.lit("EQUIPMENT").alias("entity_type"), F.element_at(F.split("p_name", " "), -1).alias("alias"), "reviewed"
    )
    brands = p.groupBy("p_brand").agg(odd).select(
        F.col("p_brand").alias("canonical_name"), F.lit("COMPONENT").alias("entity_type"), F.col("p_brand").alias("alias"), "reviewed"
    )
    return names.unionByName(brands).select(
        F.concat_ws("/", "entity_type", "canonical_name").alias("id"), "canonical_name", "entity_type", "alias", tx.alias_norm(F.col("alias")).alias("alias_norm"),
        F.lit(True).alias("enabled"), "reviewed", F.lit("2024-01-01").alias("updated_at"),
    )


ALIASES = f"""al AS (SELECT 'EQUIPMENT/' || p_name AS id, p_name AS canonical_name, 'EQUIPMENT' AS entity_type, {q.norm("split_part(p_name, ' ', -1)")} AS alias_norm, max(p_size) % 2 = 1 AS reviewed FROM part GROUP BY p_name
    UNION ALL SELECT 'COMPONENT/' || p_brand, p_brand, 'COMPONENT', {q.norm('p_brand')}, max(p_size) % 2 = 1 FROM part GROUP BY p_brand)"""


@case(
    "g03_create_update_delete",
    f"""WITH {ALIASES} SELECT 'created' AS kind, min(p_partkey)::VARCHAR AS id FROM part WHERE p_size % 5 <> 0 GROUP BY p_type, p_brand
    UNION ALL SELECT 'create: alias already exists', p_partkey::VARCHAR FROM part WHERE p_size % 5 <> 0 AND p_partkey NOT IN (SELECT min(p_partkey) FROM part WHERE p_size % 5 <> 0 GROUP BY p_type, p_brand)
    UNION ALL SELECT 'create: alias is required', p_partkey::VARCHAR FROM part WHERE p_size % 5 = 0
    UNION ALL SELECT 'updated', id FROM al WHERE entity_type = 'EQUIPMENT' UNION ALL SELECT 'update: unknown id', 'x'
    UNION ALL SELECT 'deleted', id FROM al WHERE entity_type = 'COMPONENT' UNION ALL SELECT 'delete: unknown id', 'x'""",
)
def _(spark, sf):
    t = tables(spark, sf)
    state = part_aliases(t)
    batch = t("part").select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_partkey").alias("ord"), F.col("p_type").alias("canonical_name"), F.lit(" equipment").alias("entity_type"),
        F.when(F.col("p_size") % 5 == 0, F.lit("")).otherwise(F.col("p_brand")).alias("alias"), F.lit(None).cast("boolean").alias("enabled"), F.lit(None).cast("boolean").alias("reviewed"),
    )
    made, bad = al.create_aliases(state, batch)
    ids = state.where("entity_type = 'EQUIPMENT'").select("id", F.lit(None).cast("string").alias("alias"), F.lit(True).alias("reviewed"))
    extra = spark.createDataFrame([("x", None, True)], ids.schema)
    upd, ubad = al.update_aliases(state, ids.unionByName(extra))
    dele, dbad = al.delete_aliases(state, state.where("entity_type = 'COMPONENT'").select("id").unionByName(extra.select("id")))

    def rows(df, kind):
        return df.select(F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), "id")

    out = rows(made, "created").unionByName(rows(bad, F.concat(F.lit("create: "), "violation")))
    out = out.unionByName(rows(upd, "updated")).unionByName(rows(ubad, F.concat(F.lit("update: "), "violation")))
    return out.unionByName(rows(dele, "deleted")).unionByName(rows(dbad, F.concat(F.lit("delete: "), "violation")))


@case(
    "g04_list_aliases",
    f"WITH {ALIASES} SELECT id, canonical_name, alias_norm FROM al WHERE entity_type = 'EQUIPMENT' AND reviewed AND contains(alias_norm || {q.norm('canonical_name')}, 'ring')",
)
def _(spark, sf):
    return al.list_aliases(part_aliases(tables(spark, sf)), "equipment", True, True, " Ring").select("id", "canonical_name", "alias_norm")


@case(
    "g05_alias_stats",
    f"""WITH {ALIASES} SELECT 'total' AS name, count(*) AS n FROM al UNION ALL SELECT 'enabled', count(*) FROM al
    UNION ALL SELECT 'reviewed', count(*) FROM al WHERE reviewed UNION ALL SELECT 'type:' || entity_type, count(*) FROM al GROUP BY entity_type""",
)
def _(spark, sf):
    return al.alias_stats(part_aliases(tables(spark, sf)))


@case(
    "g06_derive_aliases",
    """SELECT p_name AS name, split_part(p_name, ' ', 2) AS alias, NULL::BIGINT AS n FROM part WHERE p_name LIKE 'small %' OR p_name LIKE 'red %' GROUP BY p_name
    UNION ALL SELECT 'created', NULL, count(DISTINCT p_name) FROM part WHERE p_name LIKE 'small %' OR p_name LIKE 'red %'
    UNION ALL SELECT 'skipped', NULL, count(*) - count(DISTINCT CASE WHEN p_name LIKE 'small %' OR p_name LIKE 'red %' THEN p_name END) FROM part""",
)
def _(spark, sf):
    made, counts = al.derive_aliases(tables(spark, sf)("part").withColumnRenamed("p_name", "equipment"), None, ("small ", "red "))
    return made.select(F.col("canonical_name").alias("name"), "alias", F.lit(None).cast("long").alias("n")).unionByName(counts.select("name", F.lit(None).cast("string").alias("alias"), "n"))


def text_queries(t):
    """Conversation texts and part questions as queries."""
    c = t("conversations").where("role = 'user'").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("query_id"), F.col("text").alias("query"))
    p = t("part").select("p_name", "p_type", "p_brand").distinct().select(
        F.md5(F.concat_ws("~", "p_name", "p_type", "p_brand")).alias("query_id"), F.concat(F.lit("how to repair "), "p_name", F.lit(" "), "p_type", F.lit(" "), "p_brand").alias("query")
    )
    short = t("part").select(F.split("p_name", " ")[1].alias("w")).distinct().select(F.concat(F.lit("s-"), "w").alias("query_id"), F.expr("substring(w, 1, 3)").alias("query"))
    return c.unionByName(p).unionByName(short)


QUERIES = """tq AS (SELECT 'c' || conv_id || '-' || turn AS query_id, text AS query FROM conversations WHERE role = 'user'
    UNION ALL SELECT DISTINCT md5(p_name || '~' || p_type || '~' || p_brand), 'how to repair ' || p_name || ' ' || p_type || ' ' || p_brand FROM part
    UNION ALL SELECT DISTINCT 's-' || split_part(p_name, ' ', 2), substring(split_part(p_name, ' ', 2), 1, 3) FROM part)"""
HITS = f"""{ALIASES}, {QUERIES}, qi AS (SELECT query_id, query, {q.norm('query')} AS qn, {intent_sql('query')} AS intent FROM tq),
    qp AS (SELECT *, {PREF.replace('{i}', 'intent')} AS pref FROM qi),
    hit AS (SELECT query_id, id, canonical_name, entity_type, alias_norm, reviewed, pref,
        CASE WHEN contains(qn, alias_norm) THEN 5000 + 20 * length(alias_norm) ELSE 2000 + 10 * length(qn) END
        + 25 * (4 - list_position(pref, entity_type)) + CASE WHEN reviewed THEN 80 ELSE 0 END AS score
        FROM qp JOIN al ON contains(qn, alias_norm) OR (contains(alias_norm, qn) AND length(qn) >= 2) WHERE qn <> ''),
    top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, reviewed DESC, length(alias_norm) DESC, id) AS rank FROM hit QUALIFY rank <= 8)"""


@case("g07_match_aliases", f"WITH {HITS} SELECT query_id, rank, id, score FROM top")
def _(spark, sf):
    t = tables(spark, sf)
    qs = text_queries(t).withColumn("pref", al.preferred_types(al.infer_intent(F.col("query"), RULES)))
    return al.match_aliases(qs, part_aliases(t), 8, "pref").select("query_id", "rank", "id", "score")


@case(
    "g08_route_queries",
    f"""WITH {HITS}, f AS (SELECT query_id, entity_type, min(rank) AS r FROM top GROUP BY 1, 2),
    h AS (SELECT query_id, list(entity_type ORDER BY r) AS hits FROM f GROUP BY 1)
    SELECT query_id, intent, array_to_string(coalesce(hits, []) || list_filter(pref, lambda x: NOT list_contains(coalesce(hits, []), x)), '|') AS types FROM qp LEFT JOIN h USING (query_id)""",
)
def _(spark, sf):
    t = tables(spark, sf)
    routed, _best = al.route_queries(text_queries(t), part_aliases(t), RULES)
    return routed.select("query_id", "intent", F.array_join("ranked_types", "|").alias("types"))


@case("g08_best_alias_hits", f"WITH {HITS} SELECT query_id, canonical_name, max(score) AS score FROM top GROUP BY 1, 2")
def _(spark, sf):
    t = tables(spark, sf)
    return al.route_queries(text_queries(t), part_aliases(t), RULES)[1].select("query_id", "canonical_name", "score")
