"""Embedding near-duplicates by PCA-ordered, tiled comparison.

1. Equal vectors become one class with a count, so copies cost one row.
2. The second-moment matrix of the unit vectors (a sum per partition, bounded by the dimension)
   gives the rotation to principal axes, largest energy first.
3. A k-d tree over leading axes, fitted on a bounded sample of unit vectors (``sample`` rows),
   deals every class to a leaf; leaves are cut by hash into tiles of about ``TILE_BYTES``, however
   many fall into one. Each leaf's exact bounding box over all its rows, in all axes, is
   aggregated; a pair of leaves whose boxes are further apart than the threshold allows holds no
   link and is skipped.
4. Of each remaining pair of tiles, products of the leading axes are accumulated first; by the
   Cauchy-Schwarz bound the rest adds at most the product of the suffix norms, and pairs that
   cannot reach the threshold stop there. The survivors go on axis block by axis block, and what
   is left is decided by the cosine of the original components in double precision.
5. A task returns link counts per class and a spanning forest of its links, never all pairs; the
   counts are summed and the components of the forests are found.

The leaves' boxes and the tree are bounded by ``leaves``, not by the table.

Cases: a vector that is null, empty, zero or holds null or non-finite components links with nothing
and is its own component; vectors link within their length only; equal vectors link with
each other; repeated rows count as vectors; an empty table gives an empty result; labels and other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forkline.llm.common import Scratch, connected_components, forest

#: Room for rounding in single precision on unit vectors.
SLACK = 2e-5
STEP = 16
#: Components of a tile. A tile is sent once for each partner, so what is sent is the square of the table over this.
TILE_BYTES = 4 << 20


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows x dim in double precision, usable rows)."""
    n = len(column)
    out, good = np.zeros((n, dim)), np.zeros(n, dtype=bool)
    if not n or not dim:
        return out, good
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == dim)
    if len(at):
        flat = column.take(pa.array(at)).flatten()
        out[at] = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim)
        with np.errstate(all="ignore"):
            good[at] = np.isfinite(out[at]).all(1) & (out[at] != 0).any(1)
    return out, good


def unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(1, keepdims=True)
    x = x / np.where(big > 0, big, 1)  # no overflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rows_of(blobs: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype="<f8").reshape(-1, dim)


class Axes:
    """The rotation and the tree; small, sent with each task."""

    def __init__(self, second: np.ndarray, sample: np.ndarray, leaves: int, tile: int, n: int):
        self.rotation = np.linalg.eigh(second)[1][:, ::-1]  # largest energy first
        self.nodes: list[tuple[int, float, int, int]] = []
        self.n_leaves = 0
        want = min(leaves, max(1, -(-n // tile)))
        self._grow(sample @ self.rotation, want)

    def _grow(self, rows: np.ndarray, want: int) -> int:
        """Index of a node, or -1 - leaf."""
        if want <= 1 or len(rows) < 2:
            self.n_leaves += 1
            return -self.n_leaves
        axis = int(rows.var(0).argmax())
        cut = float(np.quantile(rows[:, axis], (want // 2) / want))
        side = rows[:, axis] < cut
        if not side.any() or side.all():
            self.n_leaves += 1
            return -self.n_leaves
        me = len(self.nodes)
        self.nodes.append((axis, cut, 0, 0))
        left = self._grow(rows[side], want // 2)
        right = self._grow(rows[~side], want - want // 2)
        self.nodes[me] = (axis, cut, left, right)
        return me

    def leaf(self, rotated: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rotated), dtype=np.int32)
        todo = [(0 if self.nodes else -1, np.arange(len(rotated)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
                continue
            axis, cut, left, right = self.nodes[node]
            side = rotated[rows, axis] < cut
            todo += [(left, rows[side]), (right, rows[~side])]
        return out


def close_leaves(low: np.ndarray, high: np.ndarray, mine: int, threshold: float) -> np.ndarray:
    """Leaves from ``mine`` on whose boxes are near enough for a link."""
    gap = np.maximum(0, np.maximum(low[mine] - high[mine:], low[mine:] - high[mine]))
    return mine + np.flatnonzero((gap * gap).sum(1) <= 2 - 2 * threshold + 1e-6)


def compare(a: np.ndarray, b: np.ndarray, rotation: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (into a, b) with cosine >= threshold; of one tile with itself each pair once."""
    dim = a.shape[1]
    left, right = (unit(x) @ rotation for x in (a, b))
    left32, right32 = left.astype(np.float32), right.astype(np.float32)
    rest_l = np.sqrt(np.cumsum((left**2)[:, ::-1], axis=1)[:, ::-1])  # suffix norms
    rest_r = np.sqrt(np.cumsum((right**2)[:, ::-1], axis=1)[:, ::-1])
    limit, out_a, out_b, lead = threshold - SLACK, [], [], min(STEP, dim)
    zero = lambda r, k: r[:, k] if k < dim else np.zeros(len(r))
    tail_l, tail_r = zero(rest_l, lead).astype(np.float32), zero(rest_r, lead).astype(np.float32)
    # leading products plus the outer product of the suffix norms, as one product
    up_l = np.concatenate([left32[:, :lead], tail_l[:, None]], axis=1)
    up_r = np.ascontiguousarray(np.concatenate([right32[:, :lead], tail_r[:, None]], axis=1).T)
    for at in range(0, len(a), 512):
        i, j = np.nonzero(up_l[at : at + 512] @ up_r >= limit)
        i += at
        if same:
            keep = i < j
            i, j = i[keep], j[keep]
        for s in range(0, len(i), 1 << 18):
            p, q = i[s : s + (1 << 18)], j[s : s + (1 << 18)]
            done = np.einsum("ij,ij->i", left32[p, :lead], right32[q, :lead])
            for k in range(lead, dim, STEP):
                to = min(k + STEP, dim)
                done = done + np.einsum("ij,ij->i", left32[p, k:to], right32[q, k:to])
                live = done + zero(rest_l, to)[p] * zero(rest_r, to)[q] >= limit
                p, q, done = p[live], q[live], done[live]
            x, y = a[p], b[q]
            with np.errstate(all="ignore"):
                cos = np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))
            odd = ~np.isfinite(cos)
            if odd.any():
                cos[odd] = np.einsum("ij,ij->i", unit(x[odd]), unit(y[odd]))
            hit = cos >= threshold
            out_a.append(p[hit])
            out_b.append(q[hit])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate(out_a or [none]), np.concatenate(out_b or [none])


def near_duplicates(spark: SparkSession, vectors: DataFrame, threshold: float = 0.9, key: str = "vec_id", column: str = "embedding", tile: int | None = None, leaves: int = 1024, sample: int = 20_000) -> DataFrame:
    """(key, n_links, component, kept) for every row of ``vectors``.

    ``tile``: rows of a tile; by default as many as ``TILE_BYTES`` hold.
    """
    scratch = Scratch(spark, "vectors")
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).alias("v"))

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            raw: list[bytes | None] = [None] * b.num_rows
            for dim in set(b.column(1).value_lengths().to_pylist()) - {None, 0}:
                x, good = matrix(b.column(1), dim)
                x = (x + 0.0).astype("<f8")  # -0 and 0 alike
                for k in np.flatnonzero(good).tolist():
                    raw[k] = x[k].tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], names=["id", "raw"])

    packed = scratch.write(rows.mapInArrow(pack, "id long, raw binary"), "packed")
    classes = packed.where("raw is not null").groupBy("raw").agg(F.min("id").alias("class"), F.count("*").alias("n"))
    # two classes never share a least id unless ids repeat; the hash tells those apart
    dim = (F.length("raw") / 8).cast("int")
    classes = scratch.write(classes.select(F.xxhash64("raw", "class").alias("node"), "class", "n", "raw", dim.alias("dim")), "classes")
    # vectors of different lengths have no cosine: each length is compared by itself
    lengths = sorted((r["dim"], r["count"]) for r in classes.groupBy("dim").count().where("count > 1").collect())
    parts = [links(spark, classes.where(F.col("dim") == d), d, n, threshold, tile or max(256, TILE_BYTES // (8 * d)), leaves, sample, scratch) for d, n in lengths]
    none = spark.createDataFrame([], "src long, dst long, links long")
    matched = scratch.write(reduce(DataFrame.unionAll, parts, none), "matched")
    roots = connected_components(spark, matched.select("src", "dst"), scratch)
    links_of = matched.groupBy(F.col("src").alias("node")).agg(F.sum("links").alias("others"))
    known = classes.join(links_of, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = known.groupBy("root").agg(F.min("class").alias("component"))
    of = known.join(least, "root").select("raw", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component")
    out = packed.join(scratch.write(of, "of"), "raw", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component"), F.col("id").eqNullSafe(component).alias("kept"))


def links(spark: SparkSession, classes: DataFrame, dim: int, n_classes: int, threshold: float, tile: int, leaves: int, sample: int, scratch: Scratch) -> DataFrame:
    """(src, dst, links): per pair of tiles, each class's links there and a spanning forest; all of one length."""

    def moments(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in it:
            if b.num_rows:
                u = unit(rows_of(b.column(0).to_pylist(), dim))
                total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], names=["at", "s"])

    second = np.zeros(dim * dim)
    for at, s in classes.select("raw").mapInArrow(moments, "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).collect():  # dim * dim rows
        second[at] = s
    share = min(1.0, 2 * sample / max(1, n_classes))
    taken = classes.select("raw").sample(share, seed=11).limit(sample).collect()  # the tree's bounded sample
    axes = Axes(second.reshape(dim, dim), unit(rows_of([r["raw"] for r in taken], dim)) if taken else np.zeros((0, dim)), leaves, tile, n_classes)

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                leaf = axes.leaf(unit(rows_of(b.column(3).to_pylist(), dim)) @ axes.rotation)
                yield pa.RecordBatch.from_arrays([pa.array(leaf), b.column(0), b.column(2), b.column(3)], names=["leaf", "node", "n", "raw"])

    dealt = classes.select("node", "class", "n", "raw").mapInArrow(deal, "leaf int, node long, n long, raw binary")

    def boxes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, count = {}, {}, {}
        for b in it:
            leaf = b.column(0).to_numpy()
            r = unit(rows_of(b.column(1).to_pylist(), dim)) @ axes.rotation if b.num_rows else np.zeros((0, dim))
            for k in np.unique(leaf).tolist():
                own = r[leaf == k]
                low[k] = np.minimum(low.get(k, np.inf), own.min(0))
                high[k] = np.maximum(high.get(k, -np.inf), own.max(0))
                count[k] = count.get(k, 0) + len(own)
        for k in low:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, k, dtype=np.int32)), pa.array(np.arange(dim)), pa.array(low[k]), pa.array(high[k]), pa.array(np.full(dim, count[k]))], names=["leaf", "axis", "low", "high", "n"])

    low, high = np.full((axes.n_leaves, dim), np.inf), np.full((axes.n_leaves, dim), -np.inf)
    counts = np.zeros(axes.n_leaves, dtype=np.int64)
    summary = dealt.select("leaf", "raw").mapInArrow(boxes, "leaf int, axis long, low double, high double, n long")
    for r in summary.groupBy("leaf", "axis").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).collect():  # leaves * dim rows
        low[r["leaf"], r["axis"]], high[r["leaf"], r["axis"]], counts[r["leaf"]] = r["low"], r["high"], r["n"]
    pieces = np.maximum(1, -(-counts // tile))

    cut = F.pandas_udf(lambda leaf, node: pd.Series((node.to_numpy().view(np.uint64) >> np.uint64(8)) % pieces[leaf.to_numpy()].astype(np.uint64)).astype("int32"), "int")
    tiles = dealt.withColumn("piece", cut("leaf", "node"))

    def blob(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in it if b.num_rows]
        if got:
            t = pa.Table.from_batches(got)
            yield pa.RecordBatch.from_arrays([t["leaf"][:1].combine_chunks().cast(pa.int32()), t["piece"][:1].combine_chunks().cast(pa.int32()), pa.array([t["node"].to_numpy().tobytes()]), pa.array([t["n"].to_numpy().tobytes()]), pa.array([b"".join(t["raw"].to_pylist())])], names=["leaf", "piece", "nodes", "counts", "rows"])

    # a group is one tile: about ``tile`` rows, as leaves are cut by their exact counts
    grouped = tiles.groupBy("leaf", "piece").applyInArrow(lambda t: pa.Table.from_batches(list(blob(iter(t.to_batches()))) or []), "leaf int, piece int, nodes binary, counts binary, rows binary")
    blobs = scratch.write(grouped, f"tiles-{dim}")

    def near(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for k in b.column(0).to_pylist():
                for m in close_leaves(low, high, k, threshold).tolist() if counts[k] else ():
                    mine = [(k, p, m, q) for p in range(int(pieces[k])) for q in range(p if m == k else 0, int(pieces[m])) if counts[m]]
                    if mine:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in zip(*mine, strict=True)], names=["l1", "p1", "l2", "p2"])

    pairs = spark.range(axes.n_leaves).mapInArrow(near, "l1 int, p1 int, l2 int, p2 int")

    def match(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r in b.to_pylist():
                same = (r["l1"], r["p1"]) == (r["l2"], r["p2"])
                x, y = (rows_of([r[k]], dim) for k in ("rows1", "rows2"))
                nodes = [np.frombuffer(r[k], dtype=np.int64) for k in ("nodes1", "nodes2")]
                n = [np.frombuffer(r[k], dtype=np.int64) for k in ("counts1", "counts2")]
                i, j = compare(x, y, axes.rotation, threshold, same)
                if not len(i):
                    continue
                j = j if same else j + len(x)
                total = len(x) if same else len(x) + len(y)
                names, many = (nodes[0], n[0]) if same else (np.concatenate(nodes), np.concatenate(n))
                count = np.bincount(i, many[j], total) + np.bincount(j, many[i], total)
                root = forest(total, i, j)
                at = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(names[at]), pa.array(names[root[at]]), pa.array(count[at].astype(np.int64))], names=["src", "dst", "links"])

    one, two = (blobs.select(F.col("leaf").alias(f"l{k}"), F.col("piece").alias(f"p{k}"), *(F.col(c).alias(f"{c}{k}") for c in ("nodes", "counts", "rows"))) for k in (1, 2))
    return pairs.join(one, ["l1", "p1"]).join(two, ["l2", "p2"]).mapInArrow(match, "src long, dst long, links long")
