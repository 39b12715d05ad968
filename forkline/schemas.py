"""Table layouts, and the closed vocabularies their columns draw on."""

from __future__ import annotations

from pyspark.sql import types as T


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# Column names and vocabularies of the tables.
AXES = ("semantic_risk", "semantic_morality", "semantic_action")
LEVELS = {"risk": ("cautious", "neutral", "reckless"), "morality": ("selfish", "neutral", "noble"), "action": ("physical", "neutral", "tactical")}
TRANSITION_TYPES = ("explicit_choice", "forced", "stochastic", "conditional", "complex")
TRANSITION_KINDS = ("forced", "profile_choice", "random", "kai", "state_condition", "combat", "escape", "outcome", "manual")
WEIGHT_RULES = ("constant", "profile_choice", "formula")

PARAGRAPHS = strings("id", "text")
EDGES = strings("source_id", "target_id", "edge_text", "transition_type", "realisation_value", *AXES, "warnings")
SUPERVISION = strings("source_id", "target_id", "transition_kind", "weight_rule", "weight_value", "weight_expression", "condition_kind", "condition_value", *AXES, "note")
AUTO_EDGES = strings(*SUPERVISION.names[:-1], "source_ref", "note")
REVIEW = strings("source_id", "review_reason", "text_content", "phase1_edges_json")
PREGRAPH_NODES = strings("node_id", "node_kind", "outcome", "absorbing", "source_ref")
PREGRAPH_EDGES = strings("edge_id", *SUPERVISION.names[:-1], "origin", "source_ref", "note")
PROFILES = strings("profile_id", "risk", "morality", "action")
ENEMY = T.StructType([T.StructField("name", T.StringType()), T.StructField("cs", T.IntegerType()), T.StructField("ep", T.IntegerType())])
ENEMIES = T.ArrayType(ENEMY)
NODES = T.StructType(
    [
        T.StructField("node_id", T.StringType()),
        T.StructField("text_content", T.StringType()),
        T.StructField("absorbing_status", T.StringType()),
        T.StructField("enemies", T.StringType()),
        T.StructField("health_modifier", T.IntegerType()),
        T.StructField("special_mechanic", T.StringType()),
        T.StructField("image_refs", T.StringType()),
        T.StructField("items_granted", T.StringType()),
    ]
)
WEIGHTS = T.StructType([T.StructField("profile_id", T.StringType()), T.StructField("source_id", T.StringType()), T.StructField("target_id", T.StringType()), T.StructField("w", T.DoubleType())])
SETTINGS = T.StructType(
    [T.StructField(n, T.DoubleType()) for n in ("kai_availability", "combat_win_probability", "escape_probability", "has_condition")]
    + [T.StructField("choice_affinities", T.StructType([T.StructField(n, T.DoubleType()) for n in ("matching", "neutral", "opposed")]))]
)
