"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a 64-bit ring; a row belongs to the first point at or after
the hash of its key. A shard takes at most its capacity: the rows of its own arcs first, in ring
order, and what overflows continues clockwise to the next points until it meets a shard with
room. Capacities add up to the number of rows and differ by one at most, so the law is ``rows``:
counts are at most one apart whatever the hashes do.

Only counts per arc reach the driver (shards x vnodes of them, whatever the table's size); the
walk around the ring works on those counts and yields, for each arc, how many of its rows, in
hash order, go to which shard and from which slot on. One grouped count and one window per arc do
the rest. Equal rows are counted before the window, so that a repeated row is one row there.

Cases: a null key hashes like any value; a null text has size 8 and the checksum of the empty
text; repeated rows get slots of their own; an empty table gives an empty result; other columns
of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Ranks of equal rows that are made at once.
PIECE = 1 << 14


def ring(n_shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ring points (signed 64-bit) and their shards; a shard's points depend on it alone."""
    points: dict[int, int] = {}
    for shard in range(n_shards):
        for v in range(vnodes):
            at = xxhash.xxh64_intdigest(f"shard-{shard}/{v}".encode()) - 2**63
            points.setdefault(at, shard)
    at = np.array(sorted(points), dtype=np.int64)
    return at, np.array([points[int(x)] for x in at], dtype=np.int64)


def capacities(total: int, n_shards: int) -> np.ndarray:
    return np.array([total // n_shards + (s < total % n_shards) for s in range(n_shards)], dtype=np.int64)


def walk(demand: np.ndarray, owner: np.ndarray, room: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Segments (arc, first rank in the arc, shard, first slot) that place all of ``demand``.

    First every arc fills its own shard; then overflow goes clockwise, nearest points first.
    """
    room, taken = room.copy(), np.zeros(len(room), dtype=np.int64)
    used = np.zeros(len(demand), dtype=np.int64)
    segments = []

    def put(arc: int, shard: int, n: int) -> None:
        segments.append((arc, int(used[arc]), shard, int(taken[shard])))
        used[arc] += n
        taken[shard] += n
        room[shard] -= n

    for arc, n in enumerate(demand):
        if n := min(int(n), int(room[owner[arc]])):
            put(arc, int(owner[arc]), n)
    waiting: list[int] = []
    for lap in range(2):
        for arc in range(len(demand)):
            shard = int(owner[arc])
            if lap == 0 and demand[arc] > used[arc]:
                waiting.append(arc)
            for origin in reversed(waiting) if room[shard] else ():
                if n := min(int(demand[origin] - used[origin]), int(room[shard])):
                    put(origin, shard, n)
            waiting = [a for a in waiting if demand[a] > used[a]]
    return sorted(segments)


def assign(docs: DataFrame, n_shards: int = 24, vnodes: int = 128, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (key, size, text_crc32, shard, slot) for each row of ``docs``."""
    points, owner = ring(n_shards, vnodes)

    @F.pandas_udf(T.LongType())
    def arc_of(h: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(points, h.to_numpy()) % len(points))

    arc = arc_of(F.xxhash64(F.col(key)))
    demand = np.zeros(len(points), dtype=np.int64)
    for a, n in docs.select(arc.alias("arc")).groupBy("arc").count().collect():  # at most n_shards * vnodes rows
        demand[a] = n
    segments = walk(demand, owner, capacities(int(demand.sum()), n_shards)) or [(0, 0, 0, 0)]
    seg = np.array(segments, dtype=np.int64)
    starts = seg[:, 0] * 2**40 + seg[:, 1]

    @F.pandas_udf(T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())]))
    def place(arc: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(starts, arc.to_numpy() * 2**40 + rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"shard": seg[at, 2].astype(np.int32), "slot": seg[at, 3] + rank.to_numpy() - seg[at, 1]})

    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 8
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    rows = docs.select(F.col(key), size.alias("size"), crc.alias("text_crc32"), F.xxhash64(F.col(key)).alias("h"))
    counted = rows.groupBy(key, "size", "text_crc32", "h").agg(F.count("*").alias("n")).withColumn("arc", arc_of("h"))
    order = Window.partitionBy("arc").orderBy("h", key, "size", "text_crc32")
    until = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    # equal rows get their ranks in pieces, so that no array grows with how often a row is repeated
    cut = counted.withColumn("from", until - F.col("n")).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PIECE))))
    low, high = F.col("from") + F.col("piece") * PIECE, F.least(F.col("from") + F.col("n"), F.col("from") + (F.col("piece") + 1) * PIECE) - 1
    ranked = cut.withColumns({"low": low, "high": high}).withColumn("rank", F.explode(F.sequence("low", "high")))
    placed = ranked.withColumn("at", place("arc", "rank"))
    return placed.select(key, "size", "text_crc32", F.col("at.shard").alias("shard"), F.col("at.slot").alias("slot"))


def moved_share(counts: np.ndarray, n_shards: int, vnodes: int = 128) -> float:
    """Share of the rows that change shard when one more is added; ``counts``: rows per key hash.

    A planning figure for a list of hashes, used by the tests; it needs no text.
    """
    def homes(n: int) -> np.ndarray:
        points, owner = ring(n, vnodes)
        arc = np.searchsorted(points, counts) % len(points)
        demand = np.bincount(arc, minlength=len(points))
        seg = np.array(walk(demand, owner, capacities(len(counts), n)), dtype=np.int64)
        order = np.lexsort((counts, arc))
        first = np.r_[0, np.cumsum(demand)[:-1]]
        rank = np.empty(len(counts), dtype=np.int64)
        rank[order] = np.arange(len(counts)) - first[arc[order]]
        return seg[np.searchsorted(seg[:, 0] * 2**40 + seg[:, 1], arc * 2**40 + rank, side="right") - 1, 2]

    return float(np.mean(homes(n_shards) != homes(n_shards + 1)))
