"""Profile and axis summaries, and their manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forkline import schemas

METRICS = ("death_probability", "win_probability", "expected_steps_to_absorption")


def profile_summary(solved: DataFrame, profiles: DataFrame, start: str = "1", neutral: str = "neutral_neutral_neutral") -> DataFrame:
    """One row a profile, in the design's order, with differences from the neutral profile."""
    own = solved.where(F.col("node_id") == start).select("profile_id", F.col("p_death").alias("death_probability"), F.col("p_win").alias("win_probability"), F.col("expected_steps").alias("expected_steps_to_absorption"))
    base = own.where(F.col("profile_id") == neutral).select(F.col("win_probability").alias("w0"), F.col("expected_steps_to_absorption").alias("s0"))
    rows = profiles.join(own, "profile_id").join(F.broadcast(base), how="left")
    return rows.select("ord", *schemas.PROFILES.names, *METRICS, (F.col("win_probability") - F.col("w0")).alias("delta_win_vs_neutral"), (F.col("expected_steps_to_absorption") - F.col("s0")).alias("delta_steps_vs_neutral"))


def axis_summary(summary: DataFrame) -> DataFrame:
    """Means over the profiles of each level of each axis, with differences from the neutral level."""
    sets = summary.groupingSets([("risk",), ("morality",), ("action",)], "risk", "morality", "action")
    means = sets.agg(F.grouping("risk").alias("gr"), F.grouping("morality").alias("gm"), F.count("*").alias("profile_count"), *(F.avg(m).alias(f"mean_{m}") for m in METRICS))
    axis = F.when(F.col("gr") == 0, "risk").when(F.col("gm") == 0, "morality").otherwise("action")
    rows = means.select(axis.alias("axis"), F.coalesce("risk", "morality", "action").alias("level"), "profile_count", *(f"mean_{m}" for m in METRICS))
    w = Window.partitionBy("axis")
    neutral = lambda m: F.max(F.when(F.col("level") == "neutral", F.col(m))).over(w)
    win, steps = "mean_win_probability", "mean_expected_steps_to_absorption"
    return rows.withColumn("delta_win_vs_axis_neutral", F.col(win) - neutral(win)).withColumn("delta_steps_vs_axis_neutral", F.col(steps) - neutral(steps))


def manifest(summary: DataFrame) -> DataFrame:
    """One row: number of profiles, the first profiles of least and greatest chance to win, the range."""
    low = F.min_by("profile_id", F.struct(F.col("win_probability"), F.col("ord")))
    high = F.max_by("profile_id", F.struct(F.col("win_probability"), -F.col("ord")))
    return summary.agg(
        F.count("*").alias("profile_count"), low.alias("min_win_profile"), F.min("win_probability").alias("min_win_probability"), high.alias("max_win_profile"), F.max("win_probability").alias("max_win_probability"),
        (F.max("win_probability") - F.min("win_probability")).alias("win_probability_range"),
    )
