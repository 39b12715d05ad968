"""Joins and groupings that the plans share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows that a side may have to be sent to every task.
SMALL = 10_000


def broadcast_small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, which are counted; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def zip_rows(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """Rows of both sides paired by their place in each key's order; unpaired rows are kept with nulls."""
    place = lambda d, order: d.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return place(left, left_order).join(place(right, right_order), [*keys, "place"], "full_outer")


def tagged_from_tables(nodes: DataFrame, edges: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """(id, text): texts of a node table with the texts of their edges between tags, in edge order."""
    own = nodes.select(F.col("node_id").alias("id"), "text_content")
    own = own.where(F.col("id").isin(subset)) if subset is not None else own
    tag = F.concat(F.lit(" <choice>"), F.col("edge_text"), F.lit("</choice>"))
    tags = edges.groupBy(F.col("source_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", tag.alias("tag")))), lambda x: x["tag"]), "").alias("tags"))
    return own.join(tags, "id", "left").select("id", F.concat("text_content", F.coalesce("tags", F.lit(""))).alias("text"))


def with_default(left: DataFrame, right: DataFrame, key: str, column: str, default: Column) -> DataFrame:
    """``left`` with ``column`` looked up in ``right`` by ``key``, or the default."""
    return left.join(right.select(key, column), key, "left").withColumn(column, F.coalesce(column, default))


def set_counts(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: distinct keys on the left only, on the right only, on both; one grouped pass."""
    both = left.select(*keys, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(right.select(*keys, F.lit(0).alias("a"), F.lit(1).alias("b")))
    per = both.groupBy(*keys).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return per.agg(F.count_if(F.col("a") > F.col("b")).alias("left_only"), F.count_if(F.col("b") > F.col("a")).alias("right_only"), F.count_if(F.col("a") == F.col("b")).alias("both"))


def share(df: DataFrame, value: str, by: list[str], name: str = "share") -> DataFrame:
    """Each row's part of its group's sum; null where the sum isn't positive."""
    total = F.sum(value).over(Window.partitionBy(*by))
    return df.withColumn(name, F.when(total > 0, F.col(value) / total))


def change_from(df: DataFrame, value: str, is_reference: Column, by: list[str] | None = None, name: str = "delta") -> DataFrame:
    """Each row's difference from its group's reference row; without ``by`` the one reference row is sent to all."""
    reference = F.max(F.when(is_reference, F.col(value)))
    if by:
        return df.withColumn(name, F.col(value) - reference.over(Window.partitionBy(*by)))
    return df.crossJoin(F.broadcast(df.agg(reference.alias("__base")))).withColumn(name, F.col(value) - F.col("__base")).drop("__base")


def numbered(df: DataFrame, name: str, first: int = 0) -> DataFrame:
    """Rows numbered in the order of partitions: each partition begins where those before it end.

    ``df`` must come out alike twice (a scan, or a checkpointed sort); only a row a partition is gathered.
    """
    own = df.withColumn("__id", F.monotonically_increasing_id())
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = own.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__start"))
    return own.join(starts, part == F.col("__part")).withColumn(name, F.col("__start") + place + first).drop("__id", "__part", "__start")


def unique_nodes(edges: DataFrame) -> DataFrame:
    """(node_id): every source or target of (source_id, target_id), once."""
    return edges.select(F.col("source_id").alias("node_id")).union(edges.select("target_id")).distinct()
