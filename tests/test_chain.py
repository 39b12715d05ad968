"""Chains with closed forms, compiled weights, reachability."""

import math

import pytest
from pyspark.sql import functions as F

from forkline.operators import constraints as C
from forkline.plans import compile as compiling
from forkline.plans import markov, summary

EDGE = "edge_id string, source_id string, target_id string, transition_kind string, weight_rule string, weight_value string, weight_expression string, condition_kind string, condition_value string, semantic_risk string, semantic_morality string, semantic_action string, origin string, source_ref string, note string"


def edge(i, s, t, rule="constant", value="", expression="", kind="forced", ck="", cv="", axes=("", "", "")):
    return (f"e{i:04d}", s, t, kind, rule, value, expression, ck, cv, *axes, "auto", f"x:{i}", "")


def weights(spark, rows):
    return spark.createDataFrame([("p", s, t, w) for s, t, w in rows], "profile_id string, source_id string, target_id string, w double")


@pytest.mark.parametrize(
    "rows, win, steps",
    [
        ([("1", "2", 1.0), ("2", "Win", 1.0)], 1.0, 2.0),
        ([("1", "Win", 0.3), ("1", "Death", 0.7)], 0.3, 1.0),
        ([("1", "1", 0.5), ("1", "Win", 0.5)], 1.0, 2.0),
    ],
)
def test_closed_forms(spark, rows, win, steps):
    w = weights(spark, rows)
    r = markov.absorb(w).where("node_id = '1'").first()
    assert r["p_win"] == pytest.approx(win) and r["expected_steps"] == pytest.approx(steps)
    assert r["p_win"] + r["p_death"] == pytest.approx(1)
    mass = {x["state"]: x["mass"] for x in markov.propagate(spark, w, "1").collect()}
    assert mass["Win"] == pytest.approx(win, abs=1e-9)


def test_visits_flow_entropy(spark):
    w = weights(spark, [("1", "2", 0.5), ("1", "Win", 0.5), ("2", "1", 0.5), ("2", "Death", 0.5)])
    v = markov.fundamental(w, "1")
    rows = {r["node_id"]: r for r in v.collect()}
    assert rows["1"]["expected_visits"] == pytest.approx(4 / 3)
    assert rows["2"]["visit_probability"] == pytest.approx(0.5)
    assert rows["1"]["victory"] == pytest.approx(2 / 3)
    flow = {(r["source_id"], r["target_id"]): r["flow"] for r in markov.edge_flow(w, v).collect()}
    assert flow["1", "Win"] == pytest.approx(2 / 3)
    assert {r["entropy"] for r in markov.local_entropy(w).collect()} == {1.0}
    assert markov.trajectory_entropy(w, v).first()["trajectory_entropy"] == pytest.approx(2.0)
    assert markov.profile_divergence(v, "p", "p").first()[0] == pytest.approx(0)
    impact = {r["source_id"]: r["impact"] for r in markov.choice_impact(w, markov.absorb(w)).collect()}
    assert impact["2"] == pytest.approx(2 / 3)


def compiled(spark, rows, profiles="profile_id = 'neutral_neutral_neutral'"):
    return compiling.compile_edges(spark.createDataFrame(rows, EDGE), compiling.profile_design(spark).where(profiles))


def test_combat_with_escape(spark):
    rows = [edge(i, "1", t, "formula", expression=f'combat_outcome(1, "{r}")', ck="combat_outcome", cv=r) for i, (t, r) in enumerate([("2", "survive"), ("3", "escape"), ("Death", "death")])]
    got = {r["target_id"]: r["compiled_weight"] for r in compiled(spark, rows).collect()}
    assert got == {"2": pytest.approx(0.4165), "3": pytest.approx(0.5), "Death": pytest.approx(0.0835)}


def test_affinities_of_two_choices(spark):
    rows = [edge(1, "1", "2", "profile_choice", axes=("cautious", "neutral", "neutral")), edge(2, "1", "3", "profile_choice", axes=("reckless", "neutral", "neutral"))]
    got = {r["target_id"]: r["compiled_weight"] for r in compiled(spark, rows, "profile_id = 'cautious_neutral_neutral'").collect()}
    assert got == {"2": pytest.approx(0.8), "3": pytest.approx(0.2)}


@pytest.mark.parametrize(
    "expression, problem",
    [("eval(1)", "unknown expression"), ("combat_win(9)", "arguments are not the edge's"), ('1 - condition_available("a", "b") * choice_share(1, 2)', "unknown expression"), ('combat_outcome(1, "survive")', "role is not the declared one")],
)
def test_bad_expressions_are_reported(spark, expression, problem):
    assert compiled(spark, [edge(1, "1", "2", "formula", expression=expression)]).first()["problem"] == problem


@pytest.mark.parametrize("expression, w", [('kai_available("Sixth Sense")', 0.5), ("combat_win(1)", 0.833), ("combat_win(1) * 0.3", 0.2499), ('(1 - kai_available("X")) * choice_share(1, 2)', 0.5), ('available_choice_share(1, 2, kai_available("X"))', 1.0), ("combat_win(1) * postcombat_choice_share(1, 2)", 0.833)])
def test_expressions(spark, expression, w):
    r = compiled(spark, [edge(1, "1", "2", "formula", expression=expression, axes=("neutral",) * 3)]).first()
    assert r["problem"] is None and r["compiled_weight"] == pytest.approx(w)


def test_sparse_sums_parallel_edges_and_loops(spark):
    nodes = spark.createDataFrame([("1", "false"), ("Death", "true"), ("Win", "true")], "node_id string, absorbing string")
    rows = [edge(1, "1", "Win", value="0.2"), edge(2, "1", "Win", value="0.3"), edge(3, "1", "Death", value="0.5")]
    w = compiling.sparse(compiled(spark, rows), nodes)
    got = {(r["source_id"], r["target_id"]): r["w"] for r in w.collect()}
    assert got == {("1", "Win"): pytest.approx(0.5), ("1", "Death"): 0.5, ("Death", "Death"): 1.0, ("Win", "Win"): 1.0}
    assert C.row_sums(w).isEmpty() and C.absorbing(w).isEmpty()
    dense = compiling.dense(w, ["1", "Death", "Win"]).where("source_id = '1'").first()
    assert (dense["1"], dense["Death"], dense["Win"]) == (0.0, 0.5, 0.5)


def test_profiles_and_summaries(spark):
    design = compiling.profile_design(spark)
    assert design.count() == 27 and C.profiles(design).isEmpty()
    edges = [edge(1, "1", "Win", "profile_choice", axes=("cautious", "neutral", "neutral")), edge(2, "1", "Death", "profile_choice", axes=("reckless", "neutral", "neutral"))]
    nodes = spark.createDataFrame([("1", "false"), ("Death", "true"), ("Win", "true")], "node_id string, absorbing string")
    w = compiling.sparse(compiled(spark, edges, "true"), nodes)
    s = summary.profile_summary(markov.absorb(w), design).cache()
    neutral = s.where("profile_id = 'neutral_neutral_neutral'").first()
    assert neutral["win_probability"] == pytest.approx(0.5) and neutral["delta_win_vs_neutral"] == 0
    axis = {(r["axis"], r["level"]): r for r in summary.axis_summary(s).collect()}
    assert len(axis) == 9 and axis["risk", "cautious"]["mean_win_probability"] == pytest.approx(0.8)
    assert axis["risk", "reckless"]["delta_win_vs_axis_neutral"] == pytest.approx(-0.3) and axis["action", "neutral"]["profile_count"] == 9
    m = summary.manifest(s).first()
    assert m["min_win_profile"] == "reckless_selfish_physical" and m["max_win_profile"] == "cautious_selfish_physical"
    assert m["win_probability_range"] == pytest.approx(0.6)


def test_constraints_find_faults(spark):
    bad = [edge(1, "1", "2", value="1.2"), edge(2, "2", "9", "odd"), edge(3, "3", "Win", value="0.9"), edge(4, "4", "Win", "profile_choice"), edge(5, "5", "Win", "formula", ck="x", expression="y")]
    d = spark.createDataFrame(bad, EDGE)
    found = {(r["check"], r["key"]) for r in C.edge_rules(d).collect()}
    assert ("constant outside 0..1", "1->2") in found and ("unknown weight rule", "2->9") in found
    assert ("choice without its axes", "4->Win") in found and ("condition kind and value not together", "5->Win") in found
    assert {r["key"] for r in C.constant_sums(d).collect()} == {"1", "3"}
    nodes = spark.createDataFrame([("3", "preterminal", "win"), ("4", "preterminal", "death")], "node_id string, node_kind string, outcome string")
    assert {r["key"] for r in C.outcomes(nodes, d).collect()} == {"4"}
    assert C.missing(d, "target_id", spark.createDataFrame([("2",), ("Win",)], "k string"), "k", "x").first()["key"] == "9"
    with pytest.raises(ValueError, match="constant outside"):
        C.require(C.edge_rules(d))
    C.require(C.edge_rules(d.limit(0)))


def test_exact_decimals(spark):
    d = spark.createDataFrame([edge(i, "1", str(i), value=v) for i, v in enumerate(("0.60", "0.04", "0.36"))], EDGE)
    assert C.constant_sums(d).isEmpty()


def test_reachable(spark):
    e = spark.createDataFrame([("1", "2"), ("2", "3"), ("3", "1"), ("8", "9")], "source_id string, target_id string")
    got = {r[0] for r in markov.reachable(spark, e, spark.createDataFrame([("1",)], "node_id string")).collect()}
    assert got == {"1", "2", "3"}


def test_settings_checks(spark):
    good = spark.range(1).select(compiling.settings_column().alias("s")).select("s.*")
    assert C.settings(good).isEmpty()
    assert C.settings(good.withColumn("has_condition", F.lit(math.nan))).count() == 1
