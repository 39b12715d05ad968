"""From pages to pregraph on a small invented book."""

import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from forkline import schemas
from forkline.functions import text as fx
from forkline.operators import constraints as C
from forkline.plans import annotate, convert, diff, pregraph
from forkline.sources import html, tables


def page(body: str) -> str:
    return f"<!DOCTYPE html><html><body><nav><p>menu</p></nav><div class='maintext big'>{body}</div><p class='choice'>outside</p></body></html>"


PAGES = {
    "1": page("<h3>1</h3><p>You wake&nbsp;up.</p><figure><img src='a.png'/></figure><p class='choice'>Go <a href='sect2.htm'>turn to 2</a>.</p><p class='choice'>Or <a href='x.htm'>see</a> <a href='sect3.htm'>turn to 3</a>.</p>"),
    "2": page("<p>Pick a number from the Random Number Table.</p><p class='choice'>If it is 0&ndash;4, <a href='sect3.htm'>turn to 3</a>.</p><p class='choice'>If it is 5-9, <a href='sect4.htm'>turn to 4</a>.</p>"),
    "3": page("<p>A wolf.</p><p class='combat'>Wolf: <span>COMBAT SKILL</span> 12 ENDURANCE 20</p><p>You lose 2 ENDURANCE points.</p><p class='choice'><a href='sect5.htm'>turn to 5</a></p>"),
    "4": page("<p class='deadend'>You die.</p>"),
    "5": page("<p>A door.</p><p class='choice'>If you have the Discipline of Sixth Sense, <a href='sect6.htm'>turn to 6</a></p><p class='choice'>If not, <a href='sect4.htm'>turn to 4</a></p>"),
    "6": page("<p>A gate.</p><p class='choice'>If you possess a rope, <a href='sect7.htm'>turn to 7</a></p><p class='choice'>If you do not, <a href='sect4.htm'>turn to 4</a></p>"),
    "7": page("<p>You win.</p>"),
}


@pytest.fixture(scope="module")
def book(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pages")
    for k, v in PAGES.items():
        (folder / f"sect{k}.htm").write_text(v, encoding="utf-8")
    (folder / "other.htm").write_text("no")
    parsed = html.parse_pages(html.scan_pages(spark, str(folder))).cache()
    nodes = html.nodes(parsed).cache()
    edges = annotate.rule_annotator(html.choices(parsed), nodes).cache()
    return parsed, nodes, edges


def test_nodes_and_choices(book):
    parsed, nodes, _ = book
    n = {r["node_id"]: r for r in nodes.collect()}
    assert [n[k]["absorbing_status"] for k in "1234567"] == ["none", "none", "potential_death", "death", "none", "none", "win"]
    assert n["1"]["text_content"] == "You wake up." and n["1"]["image_refs"] == "a.png"
    assert json.loads(n["3"]["enemies"]) == [{"name": "Wolf", "cs": 12, "ep": 20}] and n["3"]["health_modifier"] == -2
    c = {(r["source_id"], r["position"]): r["target_id"] for r in html.choices(parsed).collect()}
    assert c["1", 0] == "2" and c["1", 1] == "3" and len(c) == 9
    tagged = {r["id"]: r["text"] for r in html.tagged_paragraphs(parsed).collect()}
    assert tagged["1"] == "You wake up. <choice>Go turn to 2.</choice> <choice>Or see turn to 3.</choice>"
    assert html.skipped(parsed).isEmpty()


def test_annotation_and_conversion(spark, book):
    _, nodes, edges = book
    kinds = {(r["source_id"], r["target_id"]): r["transition_type"] for r in edges.collect()}
    assert kinds["1", "2"] == "explicit_choice" and kinds["2", "3"] == "stochastic" and kinds["3", "5"] == "forced"
    assert kinds["5", "6"] == kinds["5", "4"] == kinds["6", "7"] == "conditional"
    edges = edges.withColumn("line", F.row_number().over(Window.orderBy("source_id", "position")) + 1)
    auto, review = convert.convert(edges, nodes)
    assert review.isEmpty()
    merged = pregraph.merge(auto, spark.createDataFrame([], schemas.SUPERVISION).withColumn("line", F.lit(2))).cache()
    w = {(r["source_id"], r["target_id"]): (r["weight_value"], r["weight_expression"], r["condition_kind"]) for r in merged.collect()}
    assert w["2", "3"] == ("0.5", "", "") and w["3", "Death"] == ("", "1 - combat_win(3)", "")
    assert w["5", "6"] == ("", 'kai_available("Sixth Sense")', "kai_discipline") and w["5", "4"][2] == "kai_discipline_absent"
    assert w["6", "7"] == ("", 'condition_available("has_item", "rope")', "has_item") and w["7", "Win"] == ("1", "", "")
    assert [r["edge_id"] for r in merged.orderBy("edge_id").collect()][:2] == ["e0001", "e0002"]
    pn = pregraph.pregraph_nodes(nodes)
    phase1 = edges.select("source_id", F.concat(F.lit("edges:"), F.col("line").cast("string")).alias("source_ref"))
    problems = pregraph.checks(pn, merged, phase1, review, spark.createDataFrame([], schemas.SUPERVISION))
    assert problems.isEmpty()
    twice = merged.unionByName(merged.where("source_ref = 'edges:2'").withColumn("edge_id", F.lit("e9999")))
    found = {(r["check"], r["key"]) for r in pregraph.checks(pn, twice, phase1, review, spark.createDataFrame([], schemas.SUPERVISION)).collect()}
    assert found == {("reference not traced once", "edges:2"), ("edges lost or added", "phase1_edges")}
    assert {r["metric"]: r["value"] for r in pregraph.report(pn, merged, phase1, review).collect()}["pregraph_nodes"] == 9


def source(spark, rows, enemies="", text="t"):
    e = spark.createDataFrame([("1", str(i + 2), "", k, v, "", "", "", w, i) for i, (k, v, w) in enumerate(rows)], schemas.EDGES.simpleString().removeprefix("struct<").removesuffix(">") + ", position int")
    n = spark.createDataFrame([("1", text, "none", enemies)], "node_id string, text_content string, absorbing_status string, enemies string")
    auto, review = convert.convert(e, n)
    r = review.collect()
    return r[0]["review_reason"] if r else auto.count()


C_, S_, E_, F_ = "conditional", "stochastic", "explicit_choice", "forced"
CASES = [
    ([(F_, "", "")], "", 1),
    ([(F_, "", "")], "[x]", 2),
    ([(E_, "", ""), (E_, "", "")], "", 2),
    ([(E_, "", ""), (F_, "", "")], "", "unsupported_transition_combination: ['explicit_choice', 'forced']"),
    ([(S_, "0-4", ""), (S_, "5 or higher", "")], "", 2),
    ([(S_, "0-4", ""), (S_, "6 or higher", "")], "", "unsupported_random_rule: random branches cover 9/10 outcomes"),
    ([(S_, "below 5", ""), (S_, "5-9", "")], "", "unsupported_random_rule: Unsupported random-number rule: 'below 5'"),
    ([(S_, "0-4", "First choice"), (S_, "5-9", "")], "", "unsupported_random_rule: successive or conditional random draws"),
    ([(S_, "0-4", ""), (S_, "5-9", "")], "[x]", 3),
    ([(C_, "within 3 rounds", ""), (C_, "longer", "")], "[x]", "combat_outcome_depends_on_duration"),
    ([(C_, "you lose ENDURANCE", ""), (C_, "x", "")], "[x]", "combat_outcome_depends_on_endurance_loss"),
    ([(C_, "you win", ""), (E_, "", "")], "[x]", "combat_with_escape_or_postcombat_choice"),
    ([(C_, "a", ""), (C_, "b", "")], "[x]", "combat_with_multiple_conditional_outcomes"),
    ([(C_, "the Discipline of Hunting", ""), (C_, "the Discipline of Healing", "")], "", "multiple_kai_disciplines"),
    ([(C_, "the Discipline of Hunting", ""), (C_, "the Discipline of Hunting", "")], "", "multiple_conditions_for_one_kai_discipline"),
    ([(C_, "the Discipline of Hunting", ""), (C_, "a rope", "")], "", "kai_condition_mixed_with_another_condition"),
    ([(C_, "the Discipline of Hunting", ""), (C_, "if not", ""), (E_, "", "")], "", "kai_fallback_mixed_with_player_choices"),
    ([(C_, "the Discipline of Hunting", "")], "", "kai_condition_without_fallback"),
    ([(C_, "the Discipline of Hunting", ""), (E_, "", ""), (E_, "", "")], "", 3),
    ([(C_, "something", ""), (C_, "if not", "")], "", "multiple_or_unrecognized_state_conditions"),
    ([(C_, "if you have a rope", ""), (C_, "if not", ""), (E_, "", "")], "", "state_condition_mixed_with_other_routes"),
    ([(C_, "if you have a rope", "")], "", "state_condition_without_fallback"),
    ([(C_, "if you have 12 Gold Crowns", ""), (E_, "", "")], "", 2),
    ([(C_, "if you have a rope", ""), (E_, "", ""), (E_, "", "")], "", "state_condition_with_several_other_routes"),
]


@pytest.mark.parametrize("rows, enemies, want", CASES)
def test_decision_table(spark, rows, enemies, want):
    assert source(spark, rows, enemies) == want


def test_random_rules(spark):
    rules = {"0–2": 3, "3 or lower": 4, "7 or higher": 3, "picked a 5": 1, "pick 4": 1, "7 or less": None, "below 5": None}
    d = spark.createDataFrame([(k,) for k in rules], "r string").select("r", fx.random_outcomes(F.col("r")).alias("n"))
    assert {r["r"]: r["n"] for r in d.collect()} == rules


def test_diff_and_quality(spark):
    kind = schemas.EDGES
    gold = spark.createDataFrame([("1", "2", "", "explicit_choice", "", "neutral", "neutral", "neutral", ""), ("1", "3", "", "forced", "", None, None, None, ""), ("1", "2", "", "explicit_choice", "", "neutral", "neutral", "neutral", "")], kind)
    other = spark.createDataFrame([("1", "2", "", "explicit_choice", "", "cautious", "neutral", "neutral", ""), ("1", "4", "", "forced", "", None, None, None, ""), ("1", "3", "", "conditional", "", None, None, None, "w")], kind)
    assert {(r["status"], r["edge_id"]) for r in diff.topology(gold, other).collect()} == {("invented", "1->4"), ("shared", "1->2"), ("shared", "1->3")}
    found = diff.divergences(gold, other).cache()
    assert sorted((r["edge_id"], r["field"], r["severity"]) for r in found.collect()) == [("1->2", "semantic_risk", "soft"), ("1->2", "semantic_risk", "soft"), ("1->3", "transition_type", "medium")]
    assert {r["n_errors"] for r in diff.divergence_counts(found).collect()} == {1, 2}
    paragraphs = spark.createDataFrame([("1", "x <choice>a</choice> <choice>b</choice>"), ("2", ""), ("3", ""), ("5", "")], schemas.PARAGRAPHS)
    nodes = spark.createDataFrame([("2", "win")], "node_id string, absorbing_status string")
    got = {(r["check"], r["key"]) for r in diff.quality_report(gold, paragraphs, nodes).collect()}
    assert {("duplicate pair", "1->2"), ("edges differ from choices", "1"), ("no way out", "2"), ("never a target", "5")} <= got
    assert {(r["field"], r["value"]): r["n"] for r in diff.distributions(gold).collect()}["transition_type", "explicit_choice"] == 2


def test_tables(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_text('source_id,target_id\n1," a ""b"" "\n2,\n')
    schema = schemas.strings("source_id", "target_id")
    assert [tuple(r) for r in tables.read_csv(spark, str(f), schema).collect()] == [("1", 'a "b"'), ("2", "")]
    with pytest.raises(ValueError, match="header"):
        tables.read_csv(spark, str(f), schemas.strings("target_id", "source_id"))
    assert [r["line"] for r in tables.with_line(tables.read_csv(spark, str(f))).collect()] == [2, 3]
    template = str(tmp_path / "template")
    assert tables.create_template(spark, template, schema) and not tables.create_template(spark, template, schema)
    out = str(tmp_path / "out")
    tables.write_csv(tables.read_csv(spark, str(f)), out, ["target_id", "source_id"], [F.col("source_id")])
    assert tables.header(spark, out) == ["target_id", "source_id"]
    cell = spark.createDataFrame([('[{"name":"W","cs":1,"ep":2}]',), ("",), (None,)], "enemies string").select(tables.decode("enemies", schemas.ENEMIES).alias("e"))
    assert [len(r["e"]) for r in cell.collect()] == [1, 0, 0]
    profiles = spark.createDataFrame([("a",), ("b",)], "profile_id string")
    assert tables.select_profiles(profiles, ["a"]).count() == 1
    with pytest.raises(ValueError, match="unknown"):
        tables.select_profiles(profiles, ["z"])


def test_model_answers(spark):
    p = spark.createDataFrame([("1", "x <choice>a</choice>"), ("2", "y")], schemas.PARAGRAPHS)
    answer = json.dumps({"edges": [{"source_id": "1", "target_id": "2", "transition_type": "forced"}]})
    out = annotate.annotate_with(p, "Annotate.", lambda prompts: [answer if '"id":"1"' in q else "broken" for q in prompts])
    assert [(r["source_id"], r["transition_type"], r["warnings"]) for r in out.collect()] == [("1", "forced", "")]


def test_stream(spark, tmp_path):
    from forkline.streaming import extract

    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "sect1.htm").write_text(PAGES["1"], encoding="utf-8")
    run = lambda: extract.append_edges(extract.page_stream(spark, str(folder)), html.choices, out, str(tmp_path / "ck")).awaitTermination()
    run()
    (folder / "sect3.htm").write_text(PAGES["3"], encoding="utf-8")
    run()
    assert sorted((r["source_id"], r["target_id"]) for r in spark.read.parquet(out).collect()) == [("1", "2"), ("1", "3"), ("3", "5")]


def test_violation_rows(spark):
    d = spark.createDataFrame([(1,), (2,)], "a int")
    assert C.violations(d, "big", F.col("a"), F.col("a") > 1).collect()[0].asDict() == {"check": "big", "key": "2", "detail": ""}
