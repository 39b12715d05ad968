"""A reference annotation against a candidate: topology, types and semantics; and quality reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forkline import schemas
from forkline.functions.text import edge_key
from forkline.operators.constraints import all_of, violations


def keyed(edges: DataFrame) -> DataFrame:
    return edges.withColumn("edge_id", edge_key(F.col("source_id"), F.col("target_id")))


def topology(gold: DataFrame, candidate: DataFrame) -> DataFrame:
    """(status, edge_id): missing, invented and shared edges."""
    a, b = keyed(gold).select("edge_id"), keyed(candidate).select("edge_id")
    mark = lambda d, s: d.select(F.lit(s).alias("status"), "edge_id")
    return mark(a.subtract(b), "missing").unionAll(mark(b.subtract(a), "invented")).unionAll(mark(a.intersect(b), "shared"))


def divergences(gold: DataFrame, candidate: DataFrame) -> DataFrame:
    """(edge_id, field, gold, candidate, severity): differences on edges both have.

    Nulls differ from nothing; axes are compared where the types agree and the gold axis is set.
    """
    a = keyed(gold)
    b = keyed(candidate).select("edge_id", *(F.col(c).alias(f"{c}_c") for c in ("transition_type", *schemas.AXES)))
    both = a.join(b, "edge_id")
    row = lambda d, c, severity: d.select("edge_id", F.lit(c).alias("field"), F.col(c).alias("gold"), F.col(f"{c}_c").alias("candidate"), F.lit(severity).alias("severity"))
    out = row(both.where("transition_type <> transition_type_c"), "transition_type", "medium")
    same = both.where("transition_type = transition_type_c")
    for c in schemas.AXES:
        out = out.unionByName(row(same.where(F.col(c).isNotNull() & (F.col(c) != F.col(f"{c}_c"))), c, "soft"))
    return out


def divergence_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("field", "severity").agg(F.count("*").alias("n_errors"))


def quality_report(edges: DataFrame, paragraphs: DataFrame, nodes: DataFrame, start: str = "1") -> DataFrame:
    """(check, key, detail): duplicates, unknown ids, counts, coherence, orphans of an extraction."""
    from forkline.operators import constraints as C

    counts = paragraphs.select(F.col("id"), F.regexp_count("text", F.lit("<choice>")).alias("choices"))
    per = edges.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("edges"))
    gaps = counts.join(per, "id", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    status = nodes.select(F.col("node_id").alias("id"), "absorbing_status")
    ends = gaps.where("edges = 0").join(status, "id", "left").withColumn("absorbing_status", F.coalesce("absorbing_status", F.lit("?")))
    kind, value = F.col("transition_type"), F.coalesce(F.col("realisation_value"), F.lit(""))
    n_axes = sum((F.coalesce(F.col(a), F.lit("")) != "").cast("int") for a in schemas.AXES)
    key = edge_key(F.col("source_id"), F.col("target_id"))
    single = edges.join(counts.where("choices = 1").select(F.col("id").alias("source_id")), "source_id", "left_semi")
    orphans = paragraphs.select(F.col("id").alias("target_id")).join(edges.select("target_id"), "target_id", "left_anti").where(F.col("target_id") != start)
    return all_of(
        C.duplicates(edges, ["source_id", "target_id"], "duplicate pair"),
        C.missing(edges, "source_id", paragraphs, "id", "source outside the corpus"),
        C.missing(edges, "target_id", paragraphs, "id", "target outside the corpus"),
        violations(gaps, "edges differ from choices", F.col("id"), F.col("choices") != F.col("edges"), F.concat_ws("/", F.col("edges").cast("string"), F.col("choices").cast("string"))),
        violations(ends, "no way out", F.col("id"), F.lit(True), F.col("absorbing_status")),
        violations(edges, "value does not fit the type", key, (value != "") != kind.isin("stochastic", "conditional")),
        violations(edges, "axes do not fit the type", key, ((n_axes > 0) != (kind == "explicit_choice")) | ((kind == "explicit_choice") & (n_axes < 3))),
        violations(single, "only choice not forced", key, kind != "forced"),
        violations(orphans, "never a target", F.col("target_id"), F.lit(True)),
    )


def distributions(edges: DataFrame) -> DataFrame:
    """(field, value, n): types, axis labels of explicit choices, and warnings."""
    count = lambda d, c: d.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).select(F.lit(c).alias("field"), "value", "n")
    out = count(edges, "transition_type")
    for a in schemas.AXES:
        out = out.unionAll(count(edges.where("transition_type = 'explicit_choice'"), a))
    return out.unionAll(edges.agg(F.count_if(F.coalesce("warnings", F.lit("")) != "").alias("n")).select(F.lit("warnings").alias("field"), F.lit("not empty").alias("value"), "n"))


def ending_counts(nodes: DataFrame) -> DataFrame:
    """(absorbing_status, n) of a node table."""
    return nodes.groupBy("absorbing_status").agg(F.count("*").alias("n"))
