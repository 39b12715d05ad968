"""Absorbing chains over sparse weights (profile_id, source_id, target_id, w).

Two ways: ``absorb`` solves each profile's linear system in one task (a book's chain is a few
hundred nodes), many profiles in parallel; ``propagate`` moves mass along edges in rounds of joins,
for chains beyond one task. Both give the same probabilities.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Nodes of a chain that one task solves; beyond them ``propagate`` is the way.
DENSE = 8_000


def checkpoint_folder(spark: SparkSession) -> None:
    """Checkpoints go to the session's ``spark.checkpoint.dir``; a local folder only where it is unset."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="forkline-"))


def _matrices(pdf: pd.DataFrame, outcomes: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(transient nodes, Q, R)."""
    inner = sorted(set(pdf["source_id"]) | set(pdf["target_id"]) - set(outcomes), key=str)
    inner = [n for n in inner if n not in outcomes]
    if len(inner) > DENSE:
        raise ValueError(f"{len(inner)} nodes are too many for one dense system: use propagate")
    at, end = {n: i for i, n in enumerate(inner)}, {n: i for i, n in enumerate(outcomes)}
    q, r = np.zeros((len(inner), len(inner))), np.zeros((len(inner), len(outcomes)))
    for s, t, w in zip(pdf["source_id"], pdf["target_id"], pdf["w"], strict=True):
        if s in at:
            if t in at:
                q[at[s], at[t]] += w
            elif t in end:
                r[at[s], end[t]] += w
    return inner, q, r


def absorb(weights: DataFrame, outcomes: tuple[str, ...] = ("Death", "Win")) -> DataFrame:
    """(profile_id, node_id, expected_steps, p_<outcome>...): one solve of (I - Q) X = [R | 1] a profile."""
    names = list(outcomes)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        inner, q, r = _matrices(pdf, names)
        x = np.linalg.solve(np.eye(len(inner)) - q, np.column_stack([r, np.ones(len(inner))])) if inner else np.zeros((0, len(names) + 1))
        out = pd.DataFrame({"profile_id": pdf["profile_id"].iloc[0], "node_id": inner, "expected_steps": x[:, -1]})
        for k, n in enumerate(names):
            out[f"p_{n.lower()}"] = x[:, k]
        return out

    columns = ", ".join(f"p_{n.lower()} double" for n in names)
    return weights.groupBy("profile_id").applyInPandas(solve, f"profile_id string, node_id string, expected_steps double, {columns}")


def fundamental(weights: DataFrame, start: str, outcomes: tuple[str, ...] = ("Death", "Win")) -> DataFrame:
    """(profile_id, node_id, expected_visits, visit_probability, victory, mortality): the planned indices.

    Expected visits are a row of N = (I - Q)^-1; a node is reached with probability N_si / N_ii;
    ``victory`` is the chance to win from the node; ``mortality`` the mass that dies there directly.
    """
    names = list(outcomes)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        inner, q, r = _matrices(pdf, names)
        n = np.linalg.inv(np.eye(len(inner)) - q)
        s = inner.index(start)
        b = n @ r
        return pd.DataFrame({"profile_id": pdf["profile_id"].iloc[0], "node_id": inner, "expected_visits": n[s], "visit_probability": n[s] / np.diag(n), "victory": b[:, names.index("Win")], "mortality": n[s] * r[:, names.index("Death")]})

    return weights.groupBy("profile_id").applyInPandas(solve, "profile_id string, node_id string, expected_visits double, visit_probability double, victory double, mortality double")


def edge_flow(weights: DataFrame, visits: DataFrame) -> DataFrame:
    """Expected traversals of every transition: visits of its source times its weight."""
    v = visits.select("profile_id", F.col("node_id").alias("source_id"), "expected_visits")
    return weights.join(v, ["profile_id", "source_id"]).select("profile_id", "source_id", "target_id", (F.col("w") * F.col("expected_visits")).alias("flow"))


def local_entropy(weights: DataFrame) -> DataFrame:
    """Entropy in bits of each source's next step."""
    return weights.where("w > 0").groupBy("profile_id", "source_id").agg(F.sum(-F.col("w") * F.log2("w")).alias("entropy"))


def trajectory_entropy(weights: DataFrame, visits: DataFrame) -> DataFrame:
    """Entropy of a whole reading: local entropies weighted by expected visits, and per transition."""
    v = visits.select("profile_id", F.col("node_id").alias("source_id"), "expected_visits")
    joined = local_entropy(weights).join(v, ["profile_id", "source_id"])
    return joined.groupBy("profile_id").agg(F.sum(F.col("entropy") * F.col("expected_visits")).alias("trajectory_entropy"), (F.sum(F.col("entropy") * F.col("expected_visits")) / F.sum("expected_visits")).alias("entropy_per_transition"))


def choice_impact(weights: DataFrame, solved: DataFrame, column: str = "p_win") -> DataFrame:
    """Per source the range of the outcome over its targets."""
    values = solved.select("profile_id", F.col("node_id").alias("target_id"), F.col(column).alias("v"))
    known = weights.where("source_id <> target_id").join(values, ["profile_id", "target_id"], "left")
    v = F.coalesce("v", F.when(F.col("target_id") == "Win", 1.0).otherwise(0.0))
    return known.groupBy("profile_id", "source_id").agg((F.max(v) - F.min(v)).alias("impact"))


def profile_divergence(visits: DataFrame, left: str, right: str) -> DataFrame:
    """Jensen-Shannon divergence (bits) of two profiles' shares of visits."""
    total = visits.groupBy("profile_id").agg(F.sum("expected_visits").alias("t"))
    share = visits.join(total, "profile_id").select("profile_id", "node_id", (F.col("expected_visits") / F.col("t")).alias("s"))
    wide = share.groupBy("node_id").agg(F.coalesce(F.max(F.when(F.col("profile_id") == left, F.col("s"))), F.lit(0.0)).alias("p"), F.coalesce(F.max(F.when(F.col("profile_id") == right, F.col("s"))), F.lit(0.0)).alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    term = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return wide.agg((F.sum(term(F.col("p")) + term(F.col("q"))) / 2).alias("divergence"))


def propagate(spark: SparkSession, weights: DataFrame, start: str, outcomes: tuple[str, ...] = ("Death", "Win"), tolerance: float = 1e-12, every: int = 8, rounds: int = 2000) -> DataFrame:
    """(profile_id, state, mass): mass absorbed per outcome, moved step by step over the edges.

    At the end no state holds more than ``tolerance``; if ``rounds`` steps don't get there, it raises.

    Each step is a join and a grouped sum; every ``every`` steps the state is checkpointed to the
    shared folder and the mass still moving is looked at.
    """
    checkpoint_folder(spark)
    moves = weights.where(~F.col("source_id").isin(*outcomes))
    state = weights.select("profile_id").distinct().select("profile_id", F.lit(start).alias("state"), F.lit(1.0).alias("mass"))
    done = F.col("state").isin(*outcomes)
    for step in range(1, rounds + 1):
        moved = state.where(~done).join(moves.withColumnRenamed("source_id", "state"), ["profile_id", "state"]).select("profile_id", F.col("target_id").alias("state"), (F.col("mass") * F.col("w")).alias("mass"))
        state = moved.unionAll(state.where(done)).groupBy("profile_id", "state").agg(F.sum("mass").alias("mass"))
        if step % every == 0:
            state = state.checkpoint()
            if state.where(~done & (F.col("mass") > tolerance)).isEmpty():
                return state.where(done)
    raise ValueError(f"mass over {tolerance} still moves after {rounds} steps")


def reachable(spark: SparkSession, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node_id): nodes that can be reached from ``starts`` (node_id) over (source_id, target_id)."""
    checkpoint_folder(spark)
    links = edges.select("source_id", "target_id").distinct()
    seen = frontier = starts.select("node_id").distinct().checkpoint()
    while not frontier.isEmpty():
        step = frontier.join(links, frontier["node_id"] == links["source_id"]).select(F.col("target_id").alias("node_id")).distinct()
        frontier = step.join(seen, "node_id", "left_anti").checkpoint()
        seen = seen.unionAll(frontier).checkpoint()
    return seen



def unreachable(spark: SparkSession, edges: DataFrame, starts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id): nodes that can't be reached."""
    return nodes.select("node_id").distinct().join(reachable(spark, edges, starts), "node_id", "left_anti")
