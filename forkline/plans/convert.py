"""Annotated edges to pregraph edges, whole sources at a time.

Every source is decided as one: features of all its edges are window aggregates, a ladder of
conditions picks a case or a review reason, and each case is a projection. A source with a reason
leaves no edge; it goes to the review queue with all its edges as JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forkline import schemas
from forkline.functions import text as fx


def _repr(text: Column) -> Column:
    """A text in single quotes, or in double ones where it holds a single quote only."""
    return F.when(text.contains("'") & ~text.contains('"'), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("\\'")), F.lit("'")))


def features(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with their source's features, ``case`` and ``reason``."""
    page = nodes.select(F.col("node_id").alias("source_id"), "text_content", (F.coalesce(F.col("enemies"), F.lit("")) != "").alias("combat"))
    w, ordered = Window.partitionBy("source_id"), Window.partitionBy("source_id").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kind, rule = F.col("transition_type"), F.col("realisation_value")
    count = lambda c: F.count_if(c).over(w)
    any_of = lambda c: F.max(c.cast("int")).over(w) == 1
    d = edges.join(page, "source_id", "left")
    conditional = kind == "conditional"
    d = d.withColumns({"n": F.count("*").over(w), "n_forced": count(kind == "forced"), "n_explicit": count(kind == "explicit_choice"), "n_stochastic": count(kind == "stochastic"), "n_conditional": count(conditional)})
    d = d.withColumns({"types": F.array_sort(F.collect_set(kind).over(w)), "digits": fx.random_outcomes(rule), "named": F.when(conditional, fx.disciplines(rule)).otherwise(F.array()), "state": F.when(conditional, fx.state_condition(rule)), "is_back": conditional & fx.condition_fallback(rule)})
    d = d.withColumns(
        {
            "covered": F.sum("digits").over(w),
            "bad_rule": F.first(F.when(F.col("digits").isNull(), rule), ignorenulls=True).over(ordered),
            "draws": any_of(fx.mentions(F.col("warnings"), fx.DRAW_WARNINGS)),
            "disciplines": F.array_distinct(F.flatten(F.collect_list("named").over(w))),
            "said": F.lower(F.array_join(F.collect_list(rule).over(ordered), " ")),
            "n_state": count(F.col("state").isNotNull()),
            "n_back": count(F.col("is_back")),
            "one_state": F.first("state", ignorenulls=True).over(ordered),
        }
    )
    d = d.withColumn("discipline", F.get("disciplines", F.lit(0)))
    d = d.withColumn("positive", conditional & F.array_contains("named", F.col("discipline")))
    d = d.withColumns({"n_positive": count(F.col("positive")), "n_other": count(conditional & ~F.coalesce(F.col("positive"), F.lit(False))), "other_negates": any_of(conditional & ~F.coalesce(F.col("positive"), F.lit(False)) & fx.kai_fallback(rule))})
    n, explicit = F.col("n"), F.col("n_explicit")
    only = lambda c: F.col(c) == n
    random_problem = (
        F.when(F.col("draws"), "successive or conditional random draws")
        .when(F.col("bad_rule").isNotNull(), F.concat(F.lit("Unsupported random-number rule: "), _repr(F.col("bad_rule"))))
        .when(F.col("covered") != 10, F.concat(F.lit("random branches cover "), F.col("covered").cast("string"), F.lit("/10 outcomes")))
    )
    combat_problem = (
        F.when(F.col("said").contains("round"), "combat_outcome_depends_on_duration")
        .when(F.col("said").contains("endurance"), "combat_outcome_depends_on_endurance_loss")
        .when(explicit > 0, "combat_with_escape_or_postcombat_choice")
        .otherwise("combat_with_multiple_conditional_outcomes")
    )
    kai_problem = (
        F.when(F.size("disciplines") > 1, "multiple_kai_disciplines")
        .when(F.col("n_positive") != 1, "multiple_conditions_for_one_kai_discipline")
        .when((F.col("n_other") > 1) | ((F.col("n_other") == 1) & ~F.col("other_negates")), "kai_condition_mixed_with_another_condition")
        .when((F.col("n_other") > 0) & (explicit > 0), "kai_fallback_mixed_with_player_choices")
        .when((F.col("n_other") == 0) & (explicit == 0), "kai_condition_without_fallback")
    )
    state_problem = (
        F.when(F.col("n_state") != 1, "multiple_or_unrecognized_state_conditions")
        .when((F.col("n_back") > 1) | ((F.col("n_back") > 0) & (explicit > 0)), "state_condition_mixed_with_other_routes")
        .when((F.col("n_back") == 0) & (explicit == 0), "state_condition_without_fallback")
        # no form of the weight language says "the rest, shared" for a state: people decide
        .when(explicit > 1, "state_condition_with_several_other_routes")
    )
    combat = F.coalesce(F.col("combat"), F.lit(False))
    kai = F.size("disciplines") > 0
    stray = F.col("n_conditional") + explicit != n  # an edge the two converters would lose
    case = (
        F.when(combat & (n == 1) & only("n_forced"), "combat")
        .when(combat & only("n_stochastic"), "combat_random")
        .when(combat, "combat_other")
        .when((n == 1) & only("n_forced"), "forced")
        .when(only("n_explicit"), "choice")
        .when(only("n_stochastic"), "random")
        .when((F.col("n_conditional") > 0) & kai, "kai")
        .when(F.col("n_conditional") > 0, "state")
        .otherwise("unknown")
    )
    quoted_types = F.array_join(F.transform("types", lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", ")
    d = d.withColumn("case", case)
    at = F.col("case")
    reason = (
        F.when(at == "combat_random", F.concat(F.lit("combat_with_unsupported_random_rule: "), random_problem))
        .when(at == "combat_other", combat_problem)
        .when(at == "random", F.concat(F.lit("unsupported_random_rule: "), random_problem))
        .when(at == "kai", F.coalesce(kai_problem, F.when(stray, "condition_mixed_with_other_transitions")))
        .when(at == "state", F.coalesce(state_problem, F.when(stray, "condition_mixed_with_other_transitions")))
        .when(at == "unknown", F.concat(F.lit("unsupported_transition_combination: ["), quoted_types, F.lit("]")))
    )
    return d.withColumn("reason", reason)


def automatic_edges(decided: DataFrame) -> DataFrame:
    """Edges of the sources without a reason, and the deaths of their combats; ``ord`` orders a source's edges."""
    d, at, empty = decided.where("reason IS NULL"), F.col("case"), F.lit("")
    win = F.concat(F.lit("combat_win("), F.col("source_id"), F.lit(")"))
    tenth = F.format_string("%.1f", F.col("digits") / 10.0)
    kai = F.concat(F.lit("kai_available("), fx.quoted(F.col("discipline")), F.lit(")"))
    state = F.concat(F.lit("condition_available("), fx.quoted(F.col("one_state.kind")), F.lit(", "), fx.quoted(F.col("one_state.value")), F.lit(")"))
    rest = F.concat(F.lit("1 - "), F.when(at == "kai", kai).otherwise(state))
    share = F.concat(F.lit("(1 - "), kai, F.lit(") * choice_share("), F.col("source_id"), F.lit(", "), F.col("target_id"), F.lit(")"))
    explicit = F.col("transition_type") == "explicit_choice"
    yes = F.when(at == "kai", F.col("positive")).when(at == "state", F.col("state").isNotNull()).otherwise(False)
    condition = at.isin("kai", "state")
    kind = F.when(at.isin("combat", "combat_random"), "combat").when(condition & explicit, "profile_choice").when(at == "kai", "kai").when(at == "state", "state_condition").when(at == "choice", "profile_choice").otherwise(at)
    rule = F.when(at.isin("forced", "random"), "constant").when(at == "choice", "profile_choice").otherwise("formula")
    value = F.when(at == "forced", "1").when(at == "random", tenth).otherwise(empty)
    several = (at == "kai") & explicit & (F.col("n_explicit") > 1)
    expression = F.when(at == "combat", win).when(at == "combat_random", F.concat(win, F.lit(" * "), tenth)).when(several, share).when(condition & yes, F.when(at == "kai", kai).otherwise(state)).when(condition, rest).otherwise(empty)
    held = F.when(at == "kai", F.lit("kai_discipline")).otherwise(F.col("one_state.kind"))
    condition_kind = F.when(condition & ~explicit, F.concat(held, F.when(yes, "").otherwise("_absent"))).otherwise(empty)
    condition_value = F.when(condition & ~explicit, F.when(at == "kai", F.col("discipline")).otherwise(F.col("one_state.value"))).otherwise(empty)
    note = (
        F.when(at == "combat", "Taken after the combat is won.")
        .when(at == "combat_random", "Taken after the combat is won, by a random number.")
        .when(condition & explicit, "One of the routes left when the condition fails.")
        .when((at == "kai") & yes, "Taken when the discipline is known.")
        .when((at == "state") & yes, "Taken when the state condition holds.")
        .when(at == "state", "Taken when the state condition fails.")
        .otherwise(empty)
    )
    order = F.struct(F.when(condition, F.when(yes, 0).when(explicit, 2).otherwise(1)).otherwise(0).alias("part"), F.col("position").alias("position"))
    own = d.select(
        "source_id", "target_id", kind.alias("transition_kind"), rule.alias("weight_rule"), value.alias("weight_value"), expression.alias("weight_expression"),
        condition_kind.alias("condition_kind"), condition_value.alias("condition_value"), *schemas.AXES, F.col("source_ref"), fx.joined_note(note, F.col("warnings")).alias("note"), order.alias("ord"),
    )
    fights = d.where(at.isin("combat", "combat_random")).select("source_id").distinct()
    lost = fights.select(
        "source_id", F.lit("Death").alias("target_id"), F.lit("combat").alias("transition_kind"), F.lit("formula").alias("weight_rule"), empty.alias("weight_value"), F.concat(F.lit("1 - "), win).alias("weight_expression"),
        empty.alias("condition_kind"), empty.alias("condition_value"), *(empty.alias(a) for a in schemas.AXES), F.concat(F.lit("generated:combat_death:"), F.col("source_id")).alias("source_ref"), F.lit("Death when the combat is lost.").alias("note"),
        F.struct(F.lit(9).alias("part"), F.lit(0).cast(own.schema["ord"].dataType["position"].dataType).alias("position")).alias("ord"),
    )
    return own.unionByName(lost)


def outcome_edges(nodes: DataFrame, file: str) -> DataFrame:
    """Endings to the two shared outcomes."""
    status, empty = F.lower("absorbing_status"), F.lit("")
    values = {"target_id": F.when(status == "death", "Death").otherwise("Win"), "transition_kind": F.lit("outcome"), "weight_rule": F.lit("constant"), "weight_value": F.lit("1"), "source_ref": F.concat(F.lit(f"{file}:"), F.col("node_id")), "note": F.lit("A written ending and its shared outcome.")}
    return nodes.where(status.isin("death", "win")).select(F.col("node_id").alias("source_id"), *(values.get(c, empty).alias(c) for c in schemas.AUTO_EDGES.names if c != "source_id"))


def convert(edges: DataFrame, nodes: DataFrame, edge_file: str = "edges", node_file: str = "nodes", supervised: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(automatic edges with ``ord``, review queue). ``edges`` has a ``position``; a ``line`` gives the references.

    Sources of ``supervised`` (source_id) go to the review queue whatever the rules say.
    """
    line = F.col("line") if "line" in edges.columns else F.col("position") + 2
    decided = features(edges.withColumn("source_ref", F.concat(F.lit(f"{edge_file}:"), line.cast("string"))), nodes)
    if supervised is not None:
        named = supervised.select("source_id", F.lit("supervised").alias("__by_hand")).distinct()
        decided = decided.join(named, "source_id", "left").withColumn("reason", F.coalesce("reason", "__by_hand")).drop("__by_hand")
    auto = automatic_edges(decided)
    ends = outcome_edges(nodes, node_file).withColumn("ord", F.lit(None).cast(auto.schema["ord"].dataType))
    ends = ends.withColumn("ord", F.struct(F.lit(10).alias("part"), F.lit(0).cast(auto.schema["ord"].dataType["position"].dataType).alias("position")))
    packed = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("position", F.struct(*schemas.EDGES.names).alias("edge")))), lambda x: x["edge"]))
    review = decided.where("reason IS NOT NULL").groupBy("source_id").agg(F.min("reason").alias("review_reason"), F.min("text_content").alias("text_content"), packed.alias("phase1_edges_json"))
    return auto.unionByName(ends), review.select(*schemas.REVIEW.names)
