"""Queries of the graph and relational operators on the driver's tables, each with its SQL twin.

Doubles are rounded in both engines; keys and counts are exact.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forkline.functions import text as fx
from forkline.functions import weights
from forkline.operators import constraints as C
from forkline.operators import relational
from forkline.plans import compile as compiling
from forkline.plans import diff, markov, simulate, summary
from forkline.sources import html, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
END = ("error", "purchase")


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_EDGES = """SELECT event_type AS source_id, nxt AS target_id, count(*) AS n FROM (
  SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)
  WHERE nxt IS NOT NULL GROUP BY 1, 2"""
_SHARES = f"SELECT source_id, target_id, n / sum(n) OVER (PARTITION BY source_id) AS w FROM ({_EDGES})"
_SPARSE = f"""SELECT source_id, target_id, w FROM ({_SHARES}) WHERE source_id NOT IN ('error', 'purchase')
  UNION ALL SELECT t, t, 1.0 FROM (VALUES ('error'), ('purchase')) v(t)"""


@query(_EDGES)
def q01_transition_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's next event, counted: a graph from an event log."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    d = table(spark, sf_dir, "events").select(F.col("event_type").alias("source_id"), F.lead("event_type").over(w).alias("target_id"))
    return d.where("target_id IS NOT NULL").groupBy("source_id", "target_id").agg(F.count("*").alias("n"))


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.share(q01_transition_edges(spark, sf_dir), "n", ["source_id"], "w")


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    compiled = shares(spark, sf_dir).where(~F.col("source_id").isin(*END)).select(F.lit("all").alias("profile_id"), "source_id", "target_id", F.col("w").alias("compiled_weight"))
    ends = spark.createDataFrame([(e, "true") for e in END], "node_id string, absorbing string")
    return compiling.sparse(compiled, ends).select("source_id", "target_id", "w")


def one_profile(weights: DataFrame) -> DataFrame:
    return weights.select(F.lit("all").alias("profile_id"), "source_id", "target_id", "w")


@query(f"SELECT source_id, target_id, round(w, 9) AS w FROM ({_SHARES})")
def q02_choice_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(spark, sf_dir).select("source_id", "target_id", F.round("w", 9).alias("w"))


@query(f"SELECT source_id, target_id, round(w, 9) AS w FROM ({_SPARSE})")
def q03_sparse_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse(spark, sf_dir).withColumn("w", F.round("w", 9))


_TYPES = ("click", "error", "purchase", "signup", "view")


@query(f"SELECT source_id, {', '.join(f"round(sum(CASE WHEN target_id = '{t}' THEN w ELSE 0 END), 9) AS to_{t}" for t in _TYPES)} FROM ({_SPARSE}) GROUP BY 1")
def q04_dense_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = compiling.dense(one_profile(sparse(spark, sf_dir)), list(_TYPES))
    return wide.select("source_id", *(F.round(t, 9).alias(f"to_{t}") for t in _TYPES))


@query(f"""WITH RECURSIVE e AS (SELECT source_id, target_id, w FROM ({_SHARES}) WHERE source_id NOT IN ('error', 'purchase')),
m(step, state, mass) AS (SELECT 0, 'signup', CAST(1.0 AS DOUBLE) UNION ALL
  SELECT step + 1, target_id, sum(mass * w) FROM m JOIN e ON m.state = e.source_id WHERE step < 200 GROUP BY step, target_id)
SELECT 'signup' AS start, round(sum(CASE WHEN state = 'error' THEN mass ELSE 0 END), 8) AS p_error,
  round(sum(CASE WHEN state = 'purchase' THEN mass ELSE 0 END), 8) AS p_purchase,
  round(sum(CASE WHEN state NOT IN ('error', 'purchase') THEN mass ELSE 0 END), 7) AS expected_steps FROM m""")
def q05_absorption(spark: SparkSession, sf_dir: str) -> DataFrame:
    solved = markov.absorb(one_profile(sparse(spark, sf_dir)), END).where("node_id = 'signup'")
    return solved.select(F.col("node_id").alias("start"), F.round("p_error", 8).alias("p_error"), F.round("p_purchase", 8).alias("p_purchase"), F.round("expected_steps", 7).alias("expected_steps"))


_KEYS = """SELECT 'r' || r_regionkey AS source_id, 'n' || n_nationkey AS target_id FROM region JOIN nation ON n_regionkey = r_regionkey
  UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer"""


def key_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    r, n, s, c = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier", "customer"))
    out = r.join(n, r["r_regionkey"] == n["n_regionkey"]).select(key("r", "r_regionkey").alias("source_id"), key("n", "n_nationkey").alias("target_id"))
    return out.unionAll(s.select(key("n", "s_nationkey"), key("s", "s_suppkey"))).unionAll(c.select(key("n", "c_nationkey"), key("c", "c_custkey")))


@query(f"WITH RECURSIVE e AS ({_KEYS}), x(node_id) AS (SELECT 'r2' UNION SELECT target_id FROM x JOIN e ON x.node_id = e.source_id) SELECT node_id FROM x")
def q06_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markov.reachable(spark, key_graph(spark, sf_dir), spark.createDataFrame([("r2",)], "node_id string"))


@query("""SELECT r_name || '|' || p || '|' || s AS profile_id, r_name AS risk, p AS morality, s AS action FROM region,
  (SELECT DISTINCT o_orderpriority AS p FROM orders), (SELECT DISTINCT c_mktsegment AS s FROM customer)""")
def q07_profile_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All combinations of three short lists of levels."""
    a = table(spark, sf_dir, "region").select(F.col("r_name").alias("risk")).distinct()
    b = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("morality")).distinct()
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("action")).distinct()
    return a.crossJoin(b).crossJoin(c).select(F.concat_ws("|", "risk", "morality", "action").alias("profile_id"), "risk", "morality", "action")


_LABELS = {"click": ("cautious", "selfish", "physical"), "error": ("reckless", "neutral", "tactical"), "purchase": ("neutral", "selfish", "neutral"), "signup": ("cautious", "noble", "tactical"), "view": ("reckless", "noble", "physical")}
_AXIS = "CASE WHEN {l} = 'neutral' OR {p} = 'neutral' THEN 1.0 WHEN {l} = {p} THEN 2.0 ELSE 0.5 END"


@query(f"""WITH l(target_id, lr, lm, la) AS (VALUES {', '.join(f"('{t}', '{a}', '{b}', '{c}')" for t, (a, b, c) in _LABELS.items())}),
p AS (SELECT r || '_' || m || '_' || a AS profile_id, r, m, a FROM (VALUES ('cautious'), ('neutral'), ('reckless')) x(r), (VALUES ('selfish'), ('neutral'), ('noble')) y(m), (VALUES ('physical'), ('neutral'), ('tactical')) z(a)),
v AS (SELECT profile_id, source_id, e.target_id, {_AXIS.format(l='lr', p='r')} * {_AXIS.format(l='lm', p='m')} * {_AXIS.format(l='la', p='a')} AS f FROM ({_EDGES}) e JOIN l ON e.target_id = l.target_id, p)
SELECT profile_id, source_id, target_id, round(f / sum(f) OVER (PARTITION BY profile_id, source_id), 9) AS w FROM v""")
def q08_cross_compile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Choices weighed by 27 profiles in one plan."""
    labels = spark.createDataFrame([(t, *v) for t, v in _LABELS.items()], "target_id string, semantic_risk string, semantic_morality string, semantic_action string")
    edges = q01_transition_edges(spark, sf_dir).join(F.broadcast(labels), "target_id")
    blank = {c: F.lit("") for c in ("weight_value", "weight_expression", "condition_kind", "condition_value")}
    done = compiling.compile_edges(edges.withColumns(blank | {"weight_rule": F.lit("profile_choice")}), compiling.profile_design(spark))
    return done.select("profile_id", "source_id", "target_id", F.round("compiled_weight", 9).alias("w"))


@query("""WITH g AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'neutral' ELSE o_orderstatus END AS s, CASE WHEN o_orderpriority = '1-URGENT' THEN 'neutral' ELSE o_orderpriority END AS p, CASE WHEN c_mktsegment = 'BUILDING' THEN 'neutral' ELSE c_mktsegment END AS m,
  avg(o_totalprice) AS v, count(*) AS k, max(o_totalprice) AS x FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
a AS (SELECT 'risk' AS axis, s AS level, count(*) AS n, avg(v) AS d, avg(k) AS w, avg(x) AS t FROM g GROUP BY s UNION ALL SELECT 'morality', p, count(*), avg(v), avg(k), avg(x) FROM g GROUP BY p UNION ALL SELECT 'action', m, count(*), avg(v), avg(k), avg(x) FROM g GROUP BY m)
SELECT axis, level, n AS profile_count, round(d, 4) AS mean_death, round(w - max(CASE WHEN level = 'neutral' THEN w END) OVER (PARTITION BY axis), 4) AS delta_win, round(t - max(CASE WHEN level = 'neutral' THEN t END) OVER (PARTITION BY axis), 4) AS delta_steps FROM a""")
def q09_axis_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means per level of three axes in one pass (grouping sets), with differences from the neutral level."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    level = lambda column, neutral: F.when(F.col(column) == neutral, "neutral").otherwise(F.col(column))
    axes = {"risk": level("o_orderstatus", "F"), "morality": level("o_orderpriority", "1-URGENT"), "action": level("c_mktsegment", "BUILDING")}
    g = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy(*(v.alias(k) for k, v in axes.items()))
    g = g.agg(F.avg("o_totalprice").alias("death_probability"), F.count("*").alias("win_probability"), F.max("o_totalprice").alias("expected_steps_to_absorption"))
    return summary.axis_summary(g).select("axis", "level", "profile_count", F.round("mean_death_probability", 4).alias("mean_death"), F.round("delta_win_vs_axis_neutral", 4).alias("delta_win"), F.round("delta_steps_vs_axis_neutral", 4).alias("delta_steps"))


@query("""WITH r AS (SELECT c_nationkey AS nation, sum(o_totalprice) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT nation, round(revenue, 2) AS revenue, round(revenue - max(CASE WHEN nation = 0 THEN revenue END) OVER (), 2) AS delta FROM r""")
def q10_delta_vs_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group against a reference group; the reference is one row, joined by broadcast."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    r = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy(F.col("c_nationkey").alias("nation")).agg(F.sum("o_totalprice").alias("revenue"))
    return relational.change_from(r, "revenue", F.col("nation") == 0).select("nation", F.round("revenue", 2).alias("revenue"), F.round("delta", 2).alias("delta"))


_GUESS = "CASE WHEN contains(text, '%%%') OR contains(text, '!! ') OR contains(text, ' | ') THEN 0 ELSE 1 END"


@query(f"""WITH j AS (SELECT CAST(quality AS VARCHAR) AS q, CAST({_GUESS} AS VARCHAR) AS guess, toxic = 1 AS t, contains(text, '@') AS u FROM labels JOIN documents ON labels.doc_id = documents.doc_id)
SELECT 'transition_type' AS field, 'medium' AS severity, count(*) AS n_errors FROM j WHERE t <> u HAVING count(*) > 0
UNION ALL SELECT 'semantic_risk', 'soft', count(*) FROM j WHERE t = u AND q <> guess HAVING count(*) > 0""")
def q11_gold_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference labels against a rule's guesses, as edges of two annotations."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    t = F.col("text")
    guess = F.when(t.contains("%%%") | t.contains("!! ") | t.contains(" | "), "0").otherwise("1")
    kind = lambda c: F.when(c, "stochastic").otherwise("forced").alias("transition_type")
    edge = lambda k, risk: [F.col("doc_id").alias("source_id"), F.lit("end").alias("target_id"), k, risk.alias("semantic_risk"), F.lit(None).cast("string").alias("semantic_morality"), F.lit("x").alias("semantic_action")]
    gold = l.select(*edge(kind(F.col("toxic") == 1), F.col("quality").cast("string")))
    return diff.divergence_counts(diff.divergences(gold, d.select(*edge(kind(t.contains("@")), guess))))


_A, _B = "SELECT l_orderkey || '->' || l_partkey AS k FROM lineitem WHERE l_quantity > 5", "SELECT l_orderkey || '->' || l_partkey AS k FROM lineitem WHERE l_discount < 0.09"


@query(f"""SELECT 'missing' AS status, count(*) AS n FROM ({_A} EXCEPT {_B}) UNION ALL SELECT 'invented', count(*) FROM ({_B} EXCEPT {_A})
UNION ALL SELECT 'shared', count(*) FROM ({_A} INTERSECT {_B})""")
def q12_topology_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of one extraction and another: missing, invented and shared ones."""
    pair = [F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("target_id")]
    l = table(spark, sf_dir, "lineitem")
    found = diff.topology(l.where("l_quantity > 5").select(pair), l.where("l_discount < 0.09").select(pair))
    return found.groupBy("status").agg(F.count("*").alias("n"))


@query("""SELECT * FROM (SELECT 'order without customer' AS "check", count(DISTINCT o_custkey) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)
UNION ALL SELECT 'customer without order', count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey)
UNION ALL SELECT 'item without order', count(DISTINCT l_orderkey) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE l_orderkey = o_orderkey)
UNION ALL SELECT 'part of both', count(*) FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)
UNION ALL SELECT 'discount without tax', count(*) FROM lineitem WHERE l_discount > 0 AND l_tax = 0) WHERE n > 0""")
def q13_constraint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Referential and row checks as counts of violations."""
    o, c, l, p = (table(spark, sf_dir, t) for t in ("orders", "customer", "lineitem", "part"))
    found = C.all_of(
        C.missing(o, "o_custkey", c, "c_custkey", "order without customer"),
        C.missing(c, "c_custkey", o, "o_custkey", "customer without order"),
        C.missing(l, "l_orderkey", o, "o_orderkey", "item without order"),
        C.shared(p, l.where("l_quantity > 49").withColumnRenamed("l_partkey", "p_partkey"), "p_partkey", "part of both"),
        C.violations(l, "discount without tax", F.col("l_orderkey"), (F.col("l_discount") > 0) & (F.col("l_tax") == 0)),
    )
    return found.groupBy("check").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey || '->' || l_partkey AS key, CAST(count(*) AS VARCHAR) AS detail FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1")
def q14_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"], "pair twice").select("key", "detail")


@query("SELECT CAST(l_orderkey AS VARCHAR) AS key FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_quantity > 5) AND sum(CAST(l_discount AS DECIMAL(18, 2))) <> 0.10")
def q15_exact_decimal_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with constants only whose decimals don't sum to exactly 0.10."""
    rule = F.when(F.col("l_quantity") > 5, "constant").otherwise("formula")
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_id"), rule.alias("weight_rule"), (F.col("l_discount") * 10).cast("decimal(18,1)").cast("string").alias("weight_value"))
    return C.constant_sums(edges).select("key")


_ROLE = "CASE WHEN event_type = 'error' THEN 'death' WHEN event_type = 'signup' THEN 'escape' ELSE 'survive' END"


@query(f"""WITH r AS (SELECT event_id, user_id, {_ROLE} AS role FROM events),
c AS (SELECT *, count(*) OVER (PARTITION BY user_id, role) AS n_role, max(CASE WHEN role = 'escape' THEN 1 ELSE 0 END) OVER u AS flees, max(CASE WHEN role = 'death' THEN 1 ELSE 0 END) OVER u + max(CASE WHEN role = 'survive' THEN 1 ELSE 0 END) OVER u = 2 AS complete FROM r WINDOW u AS (PARTITION BY user_id))
SELECT event_id, role, CASE WHEN complete THEN '' ELSE 'combat without survival or death' END AS problem, CASE WHEN complete THEN round(CASE role WHEN 'escape' THEN 0.5 WHEN 'survive' THEN (1 - 0.5 * flees) * 0.833 ELSE (1 - 0.5 * flees) * 0.167 END / n_role, 9) END AS w FROM c""")
def q16_role_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mass per role, split over the rows of the role."""
    role = F.when(F.col("event_type") == "error", "death").when(F.col("event_type") == "signup", "escape").otherwise("survive")
    d = table(spark, sf_dir, "events").select(F.col("event_id"), F.col("user_id").cast("string").alias("source_id"), F.col("event_id").cast("string").alias("target_id"), role.alias("condition_value"))
    call = F.concat(F.lit("combat_outcome("), "source_id", F.lit(', "'), "condition_value", F.lit('")'))
    constants = {"profile_id": "all", "weight_rule": "formula", "weight_value": "", "condition_kind": "combat_outcome"} | dict.fromkeys(("semantic_risk", "semantic_morality", "semantic_action", "risk", "morality", "action"), "neutral")
    d = d.withColumns({k: F.lit(v) for k, v in constants.items()}).withColumn("form", weights.parse(call))
    done = weights.weight(d, compiling.settings_column())
    ok = F.col("problem").isNull()
    return done.select("event_id", F.col("condition_value").alias("role"), F.coalesce("problem", F.lit("")).alias("problem"), F.when(ok, F.round("compiled_weight", 9)).alias("w"))


@query("SELECT o_orderkey, printf('e%04d', row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) AS edge_id FROM orders")
def q17_row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", fx.edge_id(F.row_number().over(w)).alias("edge_id"))


@query("""SELECT p_partkey, round((sum(p_retailprice) OVER w - p_retailprice) / sum(p_retailprice) OVER (PARTITION BY p_brand), 7) AS low, round(sum(p_retailprice) OVER w / sum(p_retailprice) OVER (PARTITION BY p_brand), 7) AS high
FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING)""")
def q18_weighted_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of cumulated weight per group, for weighted choice by a join with random numbers."""
    d = simulate.weighted_intervals(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", ["p_partkey"])
    return d.select("p_partkey", F.round("low", 7).alias("low"), F.round("high", 7).alias("high"))


@query("""WITH n AS (SELECT row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ordinal, event_type, value FROM events),
c AS (SELECT ordinal, count(*) AS attempts, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS losses, avg(value) AS mean_value FROM n GROUP BY 1)
SELECT ordinal, attempts, losses, round(losses / attempts, 9) AS loss_probability, round(greatest(0.0, losses / attempts - 1.96 * sqrt(losses / attempts * (1 - losses / attempts) / attempts)), 9) AS ci95_low,
round(least(1.0, losses / attempts + 1.96 * sqrt(losses / attempts * (1 - losses / attempts) / attempts)), 9) AS ci95_high, round(mean_value, 6) AS mean_value FROM c""")
def q19_nth_event_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of errors by how many events came before, with normal intervals."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    d = table(spark, sf_dir, "events").select(F.row_number().over(w).cast("long").alias("ordinal"), "event_type", "value")
    c = d.groupBy("ordinal").agg(F.count("*").alias("attempts"), F.count_if(F.col("event_type") == "error").alias("losses"), F.avg("value").alias("mean_value"))
    rates = {k: F.round(v, 9) for k, v in fx.rate_interval(F.col("losses"), F.col("attempts")).items()}
    return c.withColumns(rates).withColumn("mean_value", F.round("mean_value", 6))


_HREF = """<a\\s[^>]*?href="([^"]*)\""""


@query(f"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '{_HREF}', 1))::INT AS n_links, coalesce(regexp_extract_all(html, '{_HREF}', 1)[1], '') AS first_link,
len(regexp_extract_all(html, '<p[ >]'))::INT AS n_paragraphs, len(regexp_extract_all(html, '<img\\s'))::INT AS n_images FROM pages""")
def q20_html_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, links, paragraphs and images of flat pages, by native expressions."""
    h, links = F.col("html"), html.flat_hrefs(F.col("html"))
    count = lambda p: F.regexp_count(h, F.lit(p)).alias("n")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("title"), F.size(links).alias("n_links"), F.coalesce(F.get(links, F.lit(0)), F.lit("")).alias("first_link"), count("<p[ >]").alias("n_paragraphs"), count(r"<img\s").alias("n_images")
    )


@query(r"""SELECT kind, count(*) AS n, sum(n_numbers)::BIGINT AS n_numbers FROM (SELECT CASE WHEN regexp_matches(text, '[A-Za-z0-9.]+@[A-Za-z0-9.]+') THEN 'contact' WHEN regexp_matches(text, '\([0-9]{3}\) [0-9]{3}') THEN 'phone'
WHEN regexp_matches(text, 'Licen[sc]ed') THEN 'license' WHEN contains(text, ' | ') THEN 'table' ELSE 'prose' END AS kind, len(regexp_extract_all(text, '[0-9]+')) AS n_numbers FROM documents) GROUP BY 1""")
def q21_regex_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts by a ladder of patterns; the first that matches decides."""
    t = F.col("text")
    kind = F.when(t.rlike(r"[A-Za-z0-9.]+@[A-Za-z0-9.]+"), "contact").when(t.rlike(r"\([0-9]{3}\) [0-9]{3}"), "phone").when(t.rlike("Licen[sc]ed"), "license").when(t.contains(" | "), "table").otherwise("prose")
    return table(spark, sf_dir, "documents").select(kind.alias("kind"), F.regexp_count(t, F.lit("[0-9]+")).alias("k")).groupBy("kind").agg(F.count("*").alias("n"), F.sum("k").alias("n_numbers"))


@query("""SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS total, count(DISTINCT CAST(json_extract(props, '$.k') AS BIGINT)) AS n_values, '{"k":' || max(CAST(json_extract(props, '$.k') AS BIGINT)) || '}' AS largest FROM events GROUP BY 1""")
def q22_json_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = tables.decode("props", T.StructType([T.StructField("k", T.LongType())]))["k"]
    d = table(spark, sf_dir, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.sum("k").alias("total"), F.count_distinct("k").alias("n_values"), F.max("k").alias("k"))
    return d.select("event_type", "total", "n_values", F.to_json(F.struct("k")).alias("largest"))


@query("SELECT conv_id, count(*) AS n_turns, string_agg(role, '>' ORDER BY turn, role, text) AS roles, sum(length(text))::BIGINT AS n_chars FROM conversations GROUP BY 1")
def q23_nested_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to nested lists per key, and what the lists say."""
    d = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return d.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda t: t["role"]), ">").alias("roles"), F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + F.length(t["text"])).alias("n_chars"))


@query("WITH t(digit, lo, hi, enemy_loss, hero_loss) AS (VALUES " + ", ".join(f"({d}, {lo}, {hi}, {e}, {h})" for d, row in simulate.COMBAT_RESULTS.items() for (e, h), lo, hi in zip(row, (-999, *simulate.BANDS), (*simulate.BANDS, 999), strict=True)) + """)
SELECT digit, count(*) AS n, sum(enemy_loss)::BIGINT AS enemy_loss, sum(hero_loss)::BIGINT AS hero_loss FROM lineitem JOIN t ON CAST(l_quantity AS INT) - 25 > lo AND CAST(l_quantity AS INT) - 25 <= hi AND (l_orderkey % 10) = digit GROUP BY 1""")
def q24_band_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range lookup as band plus equi-join with a table of 130 rows; the twin joins by ranges."""
    ratio, digit = F.col("l_quantity").cast("int") - 25, (F.col("l_orderkey") % 10).cast("int")
    d = table(spark, sf_dir, "lineitem").select(simulate.band(ratio).alias("band"), digit.alias("digit")).groupBy("band", "digit").agg(F.count("*").alias("n"))
    hit = d.join(F.broadcast(simulate.combat_table(spark)), ["band", "digit"]).groupBy("digit")
    total = lambda c: F.sum(F.col(c) * F.col("n")).alias(c)
    return hit.agg(F.sum("n").alias("n"), total("enemy_loss"), total("hero_loss"))


@query("""SELECT s_nationkey, arg_min(s_suppkey, (s_acctbal, s_suppkey)) AS least, arg_max(s_suppkey, (s_acctbal, -s_suppkey)) AS most, round(max(s_acctbal) - min(s_acctbal), 2) AS spread FROM supplier GROUP BY 1""")
def q25_first_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the extremes; the first of equals."""
    low, high = F.struct("s_acctbal", "s_suppkey"), F.struct(F.col("s_acctbal"), -F.col("s_suppkey"))
    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.min_by("s_suppkey", low).alias("least"), F.max_by("s_suppkey", high).alias("most"), F.round(F.max("s_acctbal") - F.min("s_acctbal"), 2).alias("spread"))


@query("SELECT c_custkey, coalesce(n, 0) AS n_orders, coalesce(last, '?') AS last_status FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderstatus) AS last FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def q26_lookup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderstatus").alias("last"))
    o = o.select(F.col("o_custkey").alias("c_custkey"), F.col("n").alias("n_orders"), F.col("last").alias("last_status"))
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return relational.with_default(relational.with_default(c, o, "c_custkey", "n_orders", F.lit(0)), o, "c_custkey", "last_status", F.lit("?"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def q27_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query(f"SELECT source_id, round(sum(-w * log2(w)), 8) AS entropy FROM ({_SHARES}) GROUP BY 1")
def q28_local_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markov.local_entropy(one_profile(shares(spark, sf_dir))).select("source_id", F.round("entropy", 8).alias("entropy"))


@query("""WITH s AS (SELECT DISTINCT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events), r AS (SELECT k FROM s WHERE user_id = (SELECT min(user_id) FROM events))
SELECT user_id, round(count(r.k) / (count(*) + (SELECT count(*) FROM r) - count(r.k)), 8) AS overlap FROM s LEFT JOIN r ON s.k = r.k GROUP BY 1""")
def q29_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard overlap of every reader's set with a reference reader's."""
    e = table(spark, sf_dir, "events").select("user_id", F.from_json("props", "k bigint")["k"].alias("k"))
    s = e.distinct()
    reference = s.join(F.broadcast(e.agg(F.min("user_id").alias("user_id"))), "user_id", "left_semi").select("k", F.lit(1).alias("hit"))
    size = reference.agg(F.count("*").alias("size"))
    d = s.join(reference, "k", "left").groupBy("user_id").agg(F.count("*").alias("own"), F.count("hit").alias("both"))
    return d.join(F.broadcast(size), how="cross").select("user_id", F.round(F.col("both") / (F.col("own") + F.col("size") - F.col("both")), 8).alias("overlap"))


@query("""WITH c AS (SELECT event_type, sum(CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN user_id % 2 = 1 THEN 1 ELSE 0 END) AS b FROM events GROUP BY 1), s AS (SELECT a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM c)
SELECT round(sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) + (CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END)) / 2, 9) AS divergence FROM s""")
def q30_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jensen-Shannon divergence of two cohorts' event shares."""
    cohort = F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd")
    v = table(spark, sf_dir, "events").groupBy(cohort.alias("profile_id"), F.col("event_type").alias("node_id")).agg(F.count("*").cast("double").alias("expected_visits"))
    return markov.profile_divergence(v, "even", "odd").select(F.round("divergence", 9).alias("divergence"))


_RUNS = 10_000


@query(f"SELECT ending, {_RUNS} AS n_runs, true AS agrees FROM (VALUES ('error'), ('purchase')) v(ending)")
def q31_simulated_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded walks over the event graph: is each ending's share within five standard errors of the solved one?"""
    rows = sparse(spark, sf_dir).orderBy("source_id", "target_id").collect()  # types x types
    names = sorted({r["source_id"] for r in rows} | {r["target_id"] for r in rows})
    network = simulate.Network(names, [tuple(r) for r in rows])

    def walk(it):
        for b in it:
            node, steps = simulate.walk(network, "signup", END, 7, b["id"].to_numpy(), 2000)
            yield pd.DataFrame({"run": b["id"], "ending": np.array(names, dtype=object)[node], "steps": steps})

    shares = spark.range(_RUNS).mapInPandas(walk, "run long, ending string, steps long").groupBy("ending").agg((F.count("*") / F.lit(_RUNS)).alias("share"))
    solved = markov.absorb(one_profile(sparse(spark, sf_dir)), END).where("node_id = 'signup'").unpivot([], ["p_error", "p_purchase"], "name", "p")
    both = solved.join(shares, F.col("name") == F.concat(F.lit("p_"), F.col("ending")), "left")
    close = F.abs(F.coalesce("share", F.lit(0.0)) - F.col("p")) <= 5 * F.sqrt(F.col("p") * (1 - F.col("p")) / _RUNS)
    return both.select(F.replace("name", F.lit("p_"), F.lit("")).alias("ending"), F.lit(_RUNS).alias("n_runs"), close.alias("agrees"))


#: (source, target, expression, declared role, risk label, weight): by hand, for a cautious profile
_FORMS = (
    ("1", "a", 'kai_available("Healing")', "", "neutral", 0.5),
    ("1", "b", '1 - kai_available("Healing")', "", "neutral", 0.5),
    ("2", "a", 'condition_available("has_item", "Rope")', "", "neutral", 0.5),
    ("2", "b", '1 - condition_available("has_item", "Rope")', "", "neutral", 0.5),
    ("3", "a", 'kai_available("Quo\\"te")', "", "neutral", 0.5),
    ("3", "b", '(1 - kai_available("Quo\\"te")) * choice_share(3, b)', "", "cautious", 0.4),
    ("3", "c", '(1 - kai_available("Quo\\"te")) * choice_share(3, c)', "", "reckless", 0.1),
    ("4", "a", "choice_share(4, a)", "", "neutral", 1 / 3),
    ("4", "b", "choice_share(4, b)", "", "cautious", 2 / 3),
    ("5", "a", "available_choice_share(5, a, 1)", "", "neutral", 0.5),
    ("5", "b", 'available_choice_share(5, b, kai_available("Healing"))', "", "neutral", 0.25),
    ("5", "c", 'available_choice_share(5, c, condition_available("has_item", "Rope"))', "", "neutral", 0.25),
    ("6", "a", "combat_win(6)", "", "neutral", 0.833),
    ("6", "Death", "1 - combat_win(6)", "", "neutral", 0.167),
    ("7", "a", "combat_win(7) * 0.3", "", "neutral", 0.2499),
    ("7", "b", "combat_win(7) * 0.7", "", "neutral", 0.5831),
    ("8", "a", "combat_win(8) * postcombat_choice_share(8, a)", "", "cautious", 0.833 * 0.8),
    ("8", "b", "combat_win(8) * postcombat_choice_share(8, b)", "", "reckless", 0.833 * 0.2),
    ("9", "a", 'combat_outcome(9, "survive")', "survive", "neutral", 0.20825),
    ("9", "b", 'combat_outcome(9, "survive")', "survive", "neutral", 0.20825),
    ("9", "c", 'combat_outcome(9, "escape")', "escape", "neutral", 0.5),
    ("9", "Death", 'combat_outcome(9, "death")', "death", "neutral", 0.0835),
    ("10", "a", "eval(1)", "", "neutral", None),
    ("11", "a", "choice_share(11, b)", "", "neutral", None),
    ("12", "a", 'combat_outcome(12, "survive")', "survive", "neutral", None),
    ("13", "a", 'combat_outcome(13, "survive")', "death", "neutral", None),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{t}', {'NULL' if w is None else round(w, 9)}, {'true' if w is None else 'false'})" for s, t, _, _, _, w in _FORMS) + ") v(source_id, target_id, w, refused)")
def q32_symbolic_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every form of the weight language compiled to Columns, and what it refuses."""
    names = "source_id string, target_id string, weight_expression string, condition_value string, semantic_risk string"
    d = spark.createDataFrame([f[:5] for f in _FORMS], names)
    d = d.withColumns({"profile_id": F.lit("p"), "weight_rule": F.lit("formula"), "weight_value": F.lit(""), "condition_kind": F.when(F.col("condition_value") != "", "combat_outcome").otherwise("")})
    d = d.withColumns(dict.fromkeys(("semantic_morality", "semantic_action", "morality", "action"), F.lit("neutral")) | {"risk": F.lit("cautious"), "form": weights.parse(F.col("weight_expression"))})
    done = weights.weight(d, compiling.settings_column())
    return done.select("source_id", "target_id", F.when(F.col("problem").isNull(), F.round("compiled_weight", 9)).alias("w"), F.col("problem").isNotNull().alias("refused"))


@query("SELECT n_name, count(s_suppkey) AS n_suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name ORDER BY n_nationkey")
def q33_numeric_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with zeros, by numeric key."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    return n.join(s, n["n_nationkey"] == s["s_nationkey"], "left").groupBy("n_nationkey", "n_name").agg(F.count("s_suppkey").alias("n_suppliers")).orderBy("n_nationkey").select("n_name", "n_suppliers")


@query("""SELECT l_returnflag AS field, l_linestatus AS value, count(*) AS n, count(DISTINCT l_orderkey) AS n_orders, max(abs(l_extendedprice * l_discount)) AS largest FROM lineitem GROUP BY 1, 2""")
def q34_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("field"), F.col("l_linestatus").alias("value"))
    return d.agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("n_orders"), F.max(F.abs(F.col("l_extendedprice") * F.col("l_discount"))).alias("largest"))
