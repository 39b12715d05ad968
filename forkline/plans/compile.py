"""Pregraph edges x profiles to weights and a sparse transition matrix, in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forkline import schemas
from forkline.functions import weights as W
from forkline.operators.relational import broadcast_small

# Default settings.
DEFAULTS = {"kai_availability": 0.5, "combat_win_probability": 0.833, "escape_probability": 0.5, "has_condition": 0.5, "choice_affinities": {"matching": 2.0, "neutral": 1.0, "opposed": 0.5}}


def settings_column(values: dict | None = None) -> Column:
    """Settings as one constant struct; Catalyst folds what depends on it alone."""
    v = DEFAULTS | (values or {})
    flat = [F.lit(float(v[k])).alias(k) for k in ("kai_availability", "combat_win_probability", "escape_probability", "has_condition")]
    affinity = F.struct(*(F.lit(float(v["choice_affinities"][k])).alias(k) for k in ("matching", "neutral", "opposed")))
    return F.struct(*flat, affinity.alias("choice_affinities"))


def profile_design(spark: SparkSession) -> DataFrame:
    """The 27 profiles: all levels of the three axes, first axis slowest (``ord``)."""
    rows = [(f"{r}_{m}_{a}", r, m, a) for r in schemas.LEVELS["risk"] for m in schemas.LEVELS["morality"] for a in schemas.LEVELS["action"]]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord int, profile_id string, risk string, morality string, action string")


def compile_edges(edges: DataFrame, profiles: DataFrame, settings: Column | None = None) -> DataFrame:
    """Every edge for every profile, with ``compiled_weight`` and ``problem``.

    The profiles are a designed table of a few rows (levels to the power of axes); once counted, they
    are sent to the edges. Shares are windows over (profile, source).
    """
    crossed = edges.crossJoin(broadcast_small(profiles.select(*schemas.PROFILES.names)))
    parsed = crossed.withColumn("form", W.parse(F.col("weight_expression")))
    return W.weight(parsed, settings if settings is not None else settings_column()).drop("form", *schemas.LEVELS)


def sparse(compiled: DataFrame, nodes: DataFrame) -> DataFrame:
    """(profile_id, source_id, target_id, w): parallel edges summed, absorbing nodes with a loop of one."""
    summed = compiled.groupBy("profile_id", "source_id", "target_id").agg(F.sum("compiled_weight").alias("w"))
    ends = nodes.where("absorbing = 'true'").select(F.col("node_id").alias("source_id"), F.col("node_id").alias("target_id"), F.lit(1.0).alias("w"))
    loops = compiled.select("profile_id").distinct().crossJoin(broadcast_small(ends)).select("profile_id", "source_id", "target_id", "w")
    return summed.unionByName(loops)


def dense(weights: DataFrame, columns: list[str]) -> DataFrame:
    """A row per source and a column per target, for export of one profile."""
    wide = weights.groupBy("profile_id", "source_id").pivot("target_id", columns).agg(F.sum("w"))
    return wide.na.fill(0.0, columns)
