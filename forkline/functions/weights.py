"""The symbolic weight language, compiled to Columns.

An expression is read once into an operation and its arguments (``parse``); ``weight`` turns that
into numbers. Shares are window sums over the edges of a source, so all profiles and all sources
are compiled by one plan. Nothing is evaluated as code; a form outside the grammar has no operation
and is reported.

Grammar: ``kai_available("X")``, ``condition_available("k", "v")``, ``1 - `` either;
``(1 - kai_available("X")) * choice_share(s, t)``; ``choice_share(s, t)``;
``available_choice_share(s, t, a)`` with a one of 1 and the two availabilities; ``combat_win(s)``,
``1 - combat_win(s)``, ``combat_win(s) * number``, ``combat_win(s) * postcombat_choice_share(s, t)``;
``combat_outcome(s, "survive" | "escape" | "death")``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_TEXT = r'"(?:[^"\\]|\\.)*"'
_KAI, _STATE = rf"kai_available\({_TEXT}\)", rf"condition_available\({_TEXT},\s*{_TEXT}\)"
_WHO, _NUMBER = r"([A-Za-z0-9_-]+)", r"([0-9]+(?:\.[0-9]+)?)"
FORMS = (
    ("kai", rf"^{_KAI}$"),
    ("not_kai", rf"^1 - {_KAI}$"),
    ("state", rf"^{_STATE}$"),
    ("not_state", rf"^1 - {_STATE}$"),
    ("not_kai_share", rf"^\(1 - {_KAI}\) \* choice_share\({_WHO},\s*{_WHO}\)$"),
    ("share", rf"^choice_share\({_WHO},\s*{_WHO}\)$"),
    ("available_share", rf"^available_choice_share\({_WHO},\s*{_WHO},\s*(1|{_KAI}|{_STATE})\)$"),
    ("win", rf"^combat_win\({_WHO}\)$"),
    ("not_win", rf"^1 - combat_win\({_WHO}\)$"),
    ("win_times", rf"^combat_win\({_WHO}\) \* {_NUMBER}$"),
    ("win_share", rf"^combat_win\({_WHO}\) \* postcombat_choice_share\({_WHO},\s*{_WHO}\)$"),
    ("role", rf'^combat_outcome\({_WHO},\s*"(survive|escape|death)"\)$'),
)


def parse(expression: Column) -> Column:
    """STRUCT<op, source, target, number, availability, role> of an expression; op null if unknown."""
    op = F.coalesce(*(F.when(expression.rlike(p), F.lit(name)) for name, p in FORMS))
    at = lambda name, k: F.regexp_extract(expression, dict(FORMS)[name], k)
    case = lambda *pairs: F.coalesce(*(F.when(op == name, at(name, k)) for name, k in pairs))
    source = case(("not_kai_share", 1), ("share", 1), ("available_share", 1), ("win", 1), ("not_win", 1), ("win_times", 1), ("win_share", 1), ("role", 1))
    target = case(("not_kai_share", 2), ("share", 2), ("available_share", 2), ("win_share", 3))
    return F.struct(op.alias("op"), source.alias("source"), target.alias("target"), case(("win_times", 2)).try_cast("double").alias("number"), case(("available_share", 3)).alias("availability"), case(("role", 2)).alias("role"))


def axis_affinity(label: Column, level: Column, settings: Column) -> Column:
    """Neutral where either side is, matching where equal, opposed otherwise."""
    a = settings["choice_affinities"]
    return F.when((label == "neutral") | (level == "neutral"), a["neutral"]).when(label == level, a["matching"]).otherwise(a["opposed"])


def edge_affinity(settings: Column) -> Column:
    """Product of the three axes' affinities."""
    return axis_affinity(F.col("semantic_risk"), F.col("risk"), settings) * axis_affinity(F.col("semantic_morality"), F.col("morality"), settings) * axis_affinity(F.col("semantic_action"), F.col("action"), settings)


def availability(text: Column, settings: Column) -> Column:
    return F.when(text == "1", 1.0).when(text.startswith("kai_available"), settings["kai_availability"]).when(text.startswith("condition_available"), settings["has_condition"])


def weight(edges: DataFrame, settings: Column) -> DataFrame:
    """Adds ``compiled_weight`` and ``problem`` to profile-crossed edges with a parsed ``form``."""
    s, form = settings, F.col("form")
    group = Window.partitionBy("profile_id", "source_id")
    roles = Window.partitionBy("profile_id", "source_id", "form.role")
    op = form["op"]
    choice, post, avail = op.isin("share", "not_kai_share"), op == "win_share", op == "available_share"
    listed = F.col("weight_rule") == "profile_choice"
    value = edge_affinity(s)
    scale = F.when(avail, availability(form["availability"], s)).otherwise(1.0)
    kind = F.when(listed, 0).when(choice, 1).when(post, 2).when(avail, 3)
    total = lambda k: F.sum(F.when(F.col("__kind") == k, F.col("__value"))).over(group)
    d = edges.withColumn("__kind", kind).withColumn("__value", scale * value)
    sums = F.when(listed, total(0)).when(choice, total(1)).when(post, total(2)).when(avail, total(3))
    d = d.withColumn("__sum", sums).withColumn("__share", F.when(F.col("__sum") > 0, F.col("__value") / F.col("__sum")))
    win, escape, k, c = s["combat_win_probability"], s["escape_probability"], s["kai_availability"], s["has_condition"]
    has = lambda role: F.max((form["role"] == role).cast("int")).over(group) == 1
    d = d.withColumn("__escape", F.coalesce(has("escape"), F.lit(False))).withColumn("__roles", F.count("*").over(roles))
    d = d.withColumn("__complete", F.coalesce(has("survive") & has("death"), F.lit(False)))
    fights = F.when(F.col("__escape"), 1 - escape).otherwise(1.0)
    mass = F.when(form["role"] == "survive", fights * win).when(form["role"] == "death", fights * (1 - win)).when(form["role"] == "escape", escape)
    number = (
        F.when(F.col("weight_rule") == "constant", F.col("weight_value").try_cast("double"))
        .when(listed | (op == "share") | avail, F.col("__share"))
        .when(op == "kai", k)
        .when(op == "not_kai", 1 - k)
        .when(op == "state", c)
        .when(op == "not_state", 1 - c)
        .when(op == "not_kai_share", (1 - k) * F.col("__share"))
        .when(op == "win", win)
        .when(op == "not_win", 1 - win)
        .when(op == "win_times", win * form["number"])
        .when(post, win * F.col("__share"))
        .when((op == "role") & F.col("__complete"), mass / F.col("__roles"))
    )
    agrees = F.coalesce(form["source"] == F.col("source_id"), F.lit(True)) & F.coalesce(form["target"] == F.col("target_id"), F.lit(True))
    declared = (op != "role") | ((F.col("condition_kind") == "combat_outcome") & (F.col("condition_value") == form["role"]))
    d = d.withColumn("__w", number)
    problem = (
        F.when((F.col("weight_rule") == "formula") & op.isNull(), "unknown expression")
        .when(~agrees, "arguments are not the edge's")
        .when(F.coalesce(~declared, F.lit(False)), "role is not the declared one")
        .when((op == "role") & ~F.col("__complete"), "combat without survival or death")
        .when(F.col("__kind").isNotNull() & ~F.coalesce(F.col("__sum") > 0, F.lit(False)), "empty choice group")
        .when(F.col("__w").isNull() | F.isnan("__w"), "no weight")
        .when(~F.col("__w").between(-1e-12, 1 + 1e-12), "weight outside 0..1")
    )
    d = d.withColumn("problem", problem).withColumn("compiled_weight", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("__w"))))
    return d.drop(*(x for x in d.columns if x.startswith("__")))
