"""Shared pieces: the shared scratch folder, exact connected components, text access.

Scratch tables go to ``spark.checkpoint.dir`` (the folder every executor sees), never to a
machine-local folder; a local one is chosen only where the setting is absent (tests).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = where.get() if where.isDefined() else None
    if not where:
        where = "file://" + tempfile.mkdtemp(prefix="forkline-")
        spark.sparkContext.setCheckpointDir(where)
        where = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return where.rstrip("/")


class Scratch:
    """Written tables that cut lineage; ``drop`` removes those no later plan reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/forkline/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Stands for a null id, and is below every other.
NO_ID = -(2**63)


def tagged(docs: DataFrame, key: str, text: str, scratch: Scratch) -> DataFrame:
    """(id, twin, text): rows told apart by id and twin. Null ids are ``NO_ID``.

    ``twin`` is 0, but where one id has different texts it is the text's hash, so that such texts are
    documents of their own, in the order of (id, twin); rows of equal id and text stay one document.
    """
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text).alias("text"))
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    mixed = rows.groupBy("id").agg(F.min(h).alias("low"), F.max(h).alias("high")).where("low <> high").select("id", F.lit(True).alias("mixed"))
    mixed = scratch.write(mixed, "mixed-ids")
    if mixed.isEmpty():
        return rows.select("id", F.lit(0).cast("long").alias("twin"), "text")
    return rows.join(mixed, "id", "left").select("id", F.when(F.col("mixed"), h).otherwise(0).alias("twin"), "text")


def strings(column: pa.Array) -> list[str]:
    """Texts of an Arrow column, null as the empty text."""
    return [x or "" for x in column.to_pylist()]


def emit(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def batches(it: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most ``rows``, so that Python lists stay small."""
    for batch in it:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Remembered:
    """What a worker knows of words, in two generations: when the newer is full the older goes, but
    words in use are carried over. Memory is bounded and frequent words are never lost."""

    def __init__(self, limit: int):
        self.limit, self.new, self.old = limit, {}, {}

    def missing(self, words: Iterable[str], turn: bool = True) -> list[str]:
        """Those of ``words`` to be learned; the others are in ``new`` after the call.

        ``turn``: a new generation may begin, which a second call for the same texts mustn't.
        """
        if turn and len(self.new) > self.limit:
            self.old, self.new = self.new, {}
        out, new, old = [], self.new, self.old
        for w in words:
            if w not in new:
                if (known := old.get(w)) is None:
                    out.append(w)
                else:
                    new[w] = known
        return out


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node reachable over the links a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        root = new[root]
        live = root[a] != root[b]
        a, b = a[live], b[live]
    return root


def connected_components(spark: SparkSession, edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, root): one root for all nodes that ``edges`` (src, dst: long) connect.

    Contraction rounds: every node moves to the neighbour (or itself) whose hash is least in that
    round, edges follow, loops and repeats go. Connectivity is kept by each round and a constant
    share of the nodes vanishes, so the rounds are few; a star of any size is a grouped minimum
    with partial aggregation, never one gathered group. Each round is a written table.
    """
    pairs = edges.select("src", "dst").where("src <> dst")
    both = pairs.union(pairs.select("dst", "src").toDF("src", "dst")).distinct()
    current = scratch.write(both, f"{name}-e0")
    first = None
    labels = None
    step = 0
    while not current.isEmpty():
        rank = lambda c, k=step: F.xxhash64(c, F.lit(k))
        best = current.groupBy("src").agg(F.min(F.struct(rank(F.col("dst")).alias("h"), F.col("dst").alias("v"))).alias("m"))
        own = F.struct(rank(F.col("src")).alias("h"), F.col("src").alias("v"))
        moved = scratch.write(best.select(F.col("src").alias("node"), F.least(F.col("m"), own)["v"].alias("to")), f"{name}-p{step}")
        if labels is None:
            labels = first = moved.select("node", F.col("to").alias("root"))
        else:
            after = moved.select(F.col("node").alias("root"), "to")
            labels = labels.join(after, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        s, d = moved.toDF("src", "s"), moved.toDF("dst", "d")
        shrunk = current.join(s, "src").join(d, "dst").where("s <> d").select(F.col("s").alias("src"), F.col("d").alias("dst")).distinct()
        step += 1
        nxt = scratch.write(shrunk, f"{name}-e{step}")
        scratch.drop(f"{name}-e{step - 1}")
        current = nxt
    if first is None:
        return current.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    return scratch.write(labels, f"{name}-labels")
