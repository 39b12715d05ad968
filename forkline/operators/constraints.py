"""Integrity constraints: each is a DataFrame of violations (check, key, detail).

Nothing is raised while a plan is built; ``require`` runs the checks and names what fails.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forkline import schemas
from forkline.functions.text import is_finite


def violations(df: DataFrame, check: str, key: Column, bad: Column, detail: Column | None = None) -> DataFrame:
    return df.where(bad).select(F.lit(check).alias("check"), key.cast("string").alias("key"), (detail if detail is not None else F.lit("")).cast("string").alias("detail"))


def missing(df: DataFrame, column: str, known: DataFrame, known_column: str, check: str) -> DataFrame:
    """Values of ``column`` that ``known`` hasn't (left anti join)."""
    keys = known.select(F.col(known_column).alias("__k")).distinct()
    return df.select(F.col(column).alias("__v")).distinct().join(keys, F.col("__v") == F.col("__k"), "left_anti").select(F.lit(check).alias("check"), F.col("__v").cast("string").alias("key"), F.lit("").alias("detail"))


def shared(a: DataFrame, b: DataFrame, column: str, check: str) -> DataFrame:
    """Values both sides have (left semi join)."""
    return a.select(column).distinct().join(b.select(column), column, "left_semi").select(F.lit(check).alias("check"), F.col(column).cast("string").alias("key"), F.lit("").alias("detail"))


def union_keys(*sides: tuple[DataFrame, str]) -> DataFrame:
    """(key): the values of a column of each side, once."""
    return reduce(DataFrame.union, (d.select(F.col(c).alias("key")) for d, c in sides)).distinct()


def duplicates(df: DataFrame, keys: list[str], check: str) -> DataFrame:
    counted = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return counted.select(F.lit(check).alias("check"), F.concat_ws("->", *(F.col(k).cast("string") for k in keys)).alias("key"), F.col("n").cast("string").alias("detail"))


def all_of(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def require(checks: DataFrame, limit: int = 10) -> None:
    """Raises with the first violations in order, if there are any."""
    if found := checks.orderBy("check", "key", "detail").limit(limit).collect():
        raise ValueError("; ".join(f"{r['check']}: {r['key']} {r['detail']}".strip() for r in found))


def edge_rules(edges: DataFrame) -> DataFrame:
    """Shape of weight rules, kinds and conditions."""
    rule, value, expression = F.col("weight_rule"), F.col("weight_value"), F.col("weight_expression")
    number = value.try_cast("decimal(38,18)")
    key = F.concat_ws("->", "source_id", "target_id")
    axes = reduce(lambda a, b: a & b, (F.col(a) != "" for a in schemas.AXES))
    checks = (
        ("unknown weight rule", ~rule.isin(*schemas.WEIGHT_RULES)),
        ("constant without a value alone", (rule == "constant") & ((value == "") | (expression != ""))),
        ("constant outside 0..1", (rule == "constant") & (value != "") & ~F.coalesce(number.between(0, 1), F.lit(False))),
        ("choice with a value or expression", (rule == "profile_choice") & ((value != "") | (expression != ""))),
        ("choice without its axes", (rule == "profile_choice") & ~axes),
        ("formula without an expression alone", (rule == "formula") & ((expression == "") | (value != ""))),
        ("unknown transition kind", ~F.col("transition_kind").isin(*schemas.TRANSITION_KINDS)),
        ("condition kind and value not together", (F.col("condition_kind") == "") != (F.col("condition_value") == "")),
    )
    return all_of(*(violations(edges, name, key, F.coalesce(bad, F.lit(True))) for name, bad in checks))


def constant_sums(edges: DataFrame) -> DataFrame:
    """Sources with constants only must sum to exactly one, in decimals."""
    sums = edges.groupBy("source_id").agg(F.bool_and(F.col("weight_rule") == "constant").alias("all"), F.sum(F.col("weight_value").try_cast("decimal(38,18)")).alias("total"))
    return violations(sums, "constants don't sum to one", F.col("source_id"), F.col("all") & ~F.coalesce(F.col("total") == 1, F.lit(False)), F.col("total"))


def outcomes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A written ending has one edge, to its own outcome."""
    ends = nodes.where("node_kind = 'preterminal'").select("node_id", F.when(F.col("outcome") == "death", "Death").otherwise("Win").alias("want"))
    out = edges.groupBy(F.col("source_id").alias("node_id")).agg(F.count("*").alias("n"), F.min("target_id").alias("to"))
    bad = ~F.coalesce((F.col("n") == 1) & (F.col("to") == F.col("want")), F.lit(False))
    return violations(ends.join(out, "node_id", "left"), "ending not linked to its outcome alone", F.col("node_id"), bad)


def traced_once(expected: DataFrame, actual: DataFrame, column: str) -> DataFrame:
    """Every expected reference occurs exactly once, and no other."""
    n = actual.groupBy(column).agg(F.count("*").alias("n"))
    both = expected.select(column).distinct().withColumn("want", F.lit(1)).join(n, column, "full_outer")
    return violations(both, "reference not traced once", F.col(column), ~F.coalesce((F.col("want") == 1) & (F.col("n") == 1), F.lit(False)), F.col("n"))


def row_sums(weights: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Outgoing weights of every source sum to one."""
    sums = weights.groupBy("profile_id", "source_id").agg(F.sum("w").alias("total"))
    return violations(sums, "outgoing weights don't sum to one", F.concat_ws(":", "profile_id", "source_id"), ~F.coalesce(F.abs(F.col("total") - 1) <= tolerance, F.lit(False)), F.col("total"))


def profiles(table: DataFrame) -> DataFrame:
    bad = ~F.col("profile_id").rlike("^[A-Za-z0-9_-]+$")
    for axis, levels in schemas.LEVELS.items():
        bad = bad | ~F.col(axis).isin(*levels)
    none = table.agg(F.count("*").alias("n"))
    return all_of(
        keys(table.drop("ord"), schemas.PROFILES.names, "profile keys"),  # the design carries its order
        violations(none, "no profile", F.lit(""), F.col("n") == 0),
        duplicates(table, ["profile_id"], "profile twice"),
        violations(table, "profile outside the design", F.col("profile_id"), F.coalesce(bad, F.lit(True))),
    )


def keys(table: DataFrame, expected: list[str], check: str) -> DataFrame:
    """Columns that are missing or not expected."""
    odd = [(check, k, "missing") for k in expected if k not in table.columns] + [(check, k, "not expected") for k in table.columns if k not in expected]
    return table.sparkSession.createDataFrame(odd, "check string, key string, detail string")


def settings(table: DataFrame) -> DataFrame:
    from forkline.functions.text import is_positive, is_probability

    p = ("kai_availability", "combat_win_probability", "escape_probability", "has_condition")
    a = ("matching", "neutral", "opposed")
    checks = [violations(table, "not a probability", F.lit(n), ~is_probability(F.col(n))) for n in p]
    expected = ["kai_availability", "combat_win_probability", "escape_probability", "has_condition", "choice_affinities"]
    return all_of(keys(table, expected, "settings keys"), *checks, *(violations(table, "not a positive number", F.lit(n), ~is_positive(F.col(f"choice_affinities.{n}"))) for n in a))


def same_rows(a: DataFrame, b: DataFrame, check: str) -> DataFrame:
    """Rows of one side only, on the columns of ``a``."""
    cols = a.columns
    left, right = a.select(*cols).exceptAll(b.select(*cols)), b.select(*cols).exceptAll(a.select(*cols))
    show = lambda d, side: d.select(F.lit(check).alias("check"), F.to_json(F.struct(*cols)).alias("key"), F.lit(side).alias("detail"))
    return show(left, "first only").unionAll(show(right, "second only"))


def absorbing(weights: DataFrame, allowed: tuple[str, ...] = ("Death", "Win")) -> DataFrame:
    """Only the outcomes absorb."""
    loops = weights.where((F.col("source_id") == F.col("target_id")) & (F.col("w") >= 1 - 1e-12))
    return violations(loops, "another node absorbs", F.concat_ws(":", "profile_id", "source_id"), ~F.col("source_id").isin(*allowed))


def largest_error(weights: DataFrame) -> DataFrame:
    """(error): the largest distance of a source's sum of outgoing weights from one."""
    return weights.groupBy("profile_id", "source_id").agg(F.abs(F.sum("w") - 1).alias("e")).agg(F.max("e").alias("error"))


def matrix(weights: DataFrame, outcomes: tuple[str, ...] = ("Death", "Win")) -> DataFrame:
    """Shape of a transition matrix: every target is a source, the outcomes are there, weights are finite."""
    row = lambda c: F.concat_ws(":", "profile_id", c)
    sources, targets = weights.select("profile_id", F.col("source_id").alias("k")).distinct(), weights.select("profile_id", F.col("target_id").alias("k")).distinct()
    lost = targets.join(sources, ["profile_id", "k"], "left_anti")
    ends = weights.groupBy("profile_id").agg(F.collect_set(F.when(F.col("source_id").isin(*outcomes), F.col("source_id"))).alias("has"))
    absent = ends.select("profile_id", F.explode(F.array_except(F.array(*map(F.lit, outcomes)), "has")).alias("k"))
    return all_of(
        violations(lost, "target without a row", row("k"), F.lit(True)),
        violations(absent, "outcome without a row", row("k"), F.lit(True)),
        violations(weights, "weight not finite", F.concat_ws("->", row("source_id"), F.col("target_id")), ~is_finite(F.col("w"))),
    )


def absorption(solved: DataFrame, outcomes: tuple[str, ...] = ("Death", "Win"), tolerance: float = 1e-9) -> DataFrame:
    """Chances of the outcomes sum to one from every node."""
    total = reduce(lambda a, b: a + b, (F.col(f"p_{o.lower()}") for o in outcomes))
    return violations(solved, "chances don't sum to one", F.concat_ws(":", "profile_id", "node_id"), ~F.coalesce(F.abs(total - 1) <= tolerance, F.lit(False)), total)


def continuations(edges: DataFrame, fights: DataFrame) -> DataFrame:
    """What a simulation needs of compiled edges: sources with a way out of positive weight, and fights
    (node_id) with one that is neither an escape nor Death."""
    flee = (F.col("condition_kind") == "combat_outcome") & (F.col("condition_value") == "escape")
    on = F.sum(F.when(~flee & (F.col("target_id") != "Death"), F.col("compiled_weight")))
    mass = edges.groupBy("source_id").agg(F.sum("compiled_weight").alias("mass"), on.alias("on"))
    at = fights.select(F.col("node_id").alias("source_id")).distinct().join(mass, "source_id", "left")
    return all_of(
        violations(mass, "no way out has weight", F.col("source_id"), ~F.coalesce(F.col("mass") > 0, F.lit(False))),
        violations(at, "fight without a continuation", F.col("source_id"), ~F.coalesce(F.col("on") > 0, F.lit(False))),
    )


def digits(rows: DataFrame, column: str) -> DataFrame:
    return violations(rows, "not a digit", F.col(column), ~F.coalesce(F.col(column).between(0, 9), F.lit(False)))
