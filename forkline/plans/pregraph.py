"""Automatic and supervised edges, merged, checked and numbered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forkline import schemas
from forkline.functions.text import edge_id
from forkline.operators import constraints as C
from forkline.operators.relational import numbered
from forkline.plans.markov import checkpoint_folder


def pregraph_nodes(nodes: DataFrame, file: str = "nodes") -> DataFrame:
    status = F.lower("absorbing_status")
    ends = status.isin("death", "win")
    own = nodes.select("node_id", F.when(ends, "preterminal").otherwise("narrative").alias("node_kind"), F.when(ends, status).otherwise("").alias("outcome"), F.lit("false").alias("absorbing"), F.concat(F.lit(f"{file}:"), F.col("node_id")).alias("source_ref"))
    shared = nodes.sparkSession.createDataFrame([("Death", "terminal", "death", "true", "shared:outcome"), ("Win", "terminal", "win", "true", "shared:outcome")], schemas.PREGRAPH_NODES)
    return own.unionByName(shared)


def merge(auto: DataFrame, supervised: DataFrame) -> DataFrame:
    """Both origins, by numeric source, automatic ones first, numbered e0001, e0002, ...

    ``supervised`` has a ``line``. The order is a distributed sort, numbered partition by partition.
    """
    order = F.struct(F.lit(0).alias("origin"), F.col("ord.part").cast("long").alias("part"), F.col("ord.position").cast("long").alias("position"))
    a = auto.withColumn("origin", F.lit("auto")).withColumn("ord", order)
    s = supervised.withColumn("origin", F.lit("supervised")).withColumn("source_ref", F.concat(F.lit("supervision:"), F.col("line").cast("string")))
    s = s.withColumn("ord", F.struct(F.lit(1).alias("origin"), F.lit(0).cast("long").alias("part"), F.col("line").cast("long").alias("position"))).drop("line")
    both = a.unionByName(s)
    checkpoint_folder(both.sparkSession)
    ordered = both.orderBy(F.expr("try_cast(source_id AS bigint)"), "source_id", "ord", "target_id").checkpoint()
    return numbered(ordered, "place", 1).withColumn("edge_id", edge_id(F.col("place"))).select(*schemas.PREGRAPH_EDGES.names)


def checks(nodes: DataFrame, edges: DataFrame, phase1: DataFrame, review: DataFrame, supervised: DataFrame) -> DataFrame:
    """All violations of a merged pregraph; ``phase1`` has source_id and source_ref."""
    auto = edges.where("origin = 'auto'")
    named = supervised.select("source_id")
    refs = auto.join(phase1.select("source_ref"), "source_ref", "left_semi").select("source_ref")
    unreviewed = phase1.join(review.select("source_id"), "source_id", "left_anti")
    return C.all_of(
        C.edge_rules(edges),
        C.missing(edges, "source_id", nodes, "node_id", "unknown source"),
        C.missing(edges, "target_id", nodes, "node_id", "unknown target"),
        C.missing(review, "source_id", named, "source_id", "review without supervision"),
        C.missing(named, "source_id", review, "source_id", "supervision without review"),
        C.shared(auto.join(phase1.select("source_ref"), "source_ref", "left_semi"), review, "source_id", "source both converted and reviewed"),
        C.missing(unreviewed, "source_id", auto, "source_id", "source not converted"),
        C.traced_once(unreviewed.select("source_ref"), refs, "source_ref"),
        C.violations(edges, "supervised edge without a note", F.col("edge_id"), (F.col("origin") == "supervised") & (F.col("note") == "")),
        C.missing(nodes.where("node_kind <> 'terminal'").select("node_id"), "node_id", edges, "source_id", "node without a way out"),
        C.duplicates(review, ["source_id"], "source reviewed twice"),
        C.constant_sums(edges),
        C.outcomes(nodes, edges),
        all_classified(edges, phase1, review),
    )


def all_classified(edges: DataFrame, phase1: DataFrame, review: DataFrame) -> DataFrame:
    """Edges converted and edges replaced by supervision are all edges of phase 1."""
    rows = report(edges.select(F.lit("").alias("node_kind")).limit(0), edges, phase1, review)
    of = lambda m: F.max(F.when(F.col("metric") == m, F.col("value")))
    counts = rows.agg(of("phase1_edges").alias("all"), of("automatic_phase1_edges").alias("auto"), of("replaced_phase1_edges").alias("hand"))
    return C.violations(counts, "edges lost or added", F.lit("phase1_edges"), F.col("auto") + F.col("hand") != F.col("all"), F.concat_ws("/", F.col("auto").cast("string"), F.col("hand").cast("string"), F.col("all").cast("string")))


def report(nodes: DataFrame, edges: DataFrame, phase1: DataFrame, review: DataFrame) -> DataFrame:
    """(metric, value): counts of the conversion."""
    reviewed = phase1.join(review.select("source_id"), "source_id", "left_semi")
    traced = edges.where("origin = 'auto'").join(phase1.select("source_ref"), "source_ref", "left_semi")
    one = lambda d, name: d.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
    rows = [
        one(nodes.where("node_kind <> 'terminal'"), "phase1_nodes"),
        one(phase1, "phase1_edges"),
        one(traced, "automatic_phase1_edges"),
        one(reviewed, "replaced_phase1_edges"),
        one(review, "supervised_sources"),
        one(edges.where("origin = 'auto'"), "automatic_pregraph_edges"),
        one(edges.where("origin = 'supervised'"), "supervised_pregraph_edges"),
        one(nodes, "pregraph_nodes"),
        one(edges, "pregraph_edges"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionAll(r)
    return out
