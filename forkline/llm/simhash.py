"""SimHash near-duplicates by the generalised pigeonhole principle.

1. ``fingerprints``: one 64-bit majority fingerprint a document, from its whole text.
2. Equal fingerprints become one class (grouped with partial aggregation), so copies cost one row.
3. Bit statistics of all classes (co-occurrence of bits, value histograms of small bit blocks)
   group correlated bits into the same partition. For 2, 3 or 4 partitions the expected probes
   and candidates are estimated from the histograms and the cheapest number is taken.
4. Each class, as a query, gets its own thresholds per partition: a dynamic programme picks those
   that sum to ``radius - partitions + 1`` (-1 leaves a partition out) with the fewest estimated
   candidates. By the generalised pigeonhole principle no class within the radius is missed.
5. The query's ball in each partition meets the exact partition values in blocks, hot ones cut into
   tiles; a task compares fingerprints and puts out a spanning forest of the true links, at most
   an edge a row, so a group of any size costs rows in proportion and never its pairs.
6. Components of the links, then the smallest document of each.

The histograms are of bounded size (8 blocks x 256 values, 64 x 64 co-occurrences); links,
fingerprints and components stay distributed.

Cases: a null or empty text has no words and fingerprint zero, linked like any other; fewer words
than a shingle are one shingle; repeated rows are one class; an empty table gives an empty
result; other columns are ignored; a null id never is the representative unless all are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forkline.llm.common import Scratch, batches, connected_components, forest

BITS = 64
SEED = 42
BLOCK = 8
#: A probe is a row that is made, shuffled and sorted; it costs more than a comparison of two numbers.
PROBE = 4
#: A value of more than TILE indexed rows is cut into tiles.
TILE = 4096
#: Fingerprints chained within so many bits are one group when similarities are verified.
CHAIN = 3
#: Shingle sets of one side of a verified block.
GROUP_TILE = 256


def fingerprint(text: str | None, shingle: int = 3) -> int:
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and exactly \x20 \x09-\x0D
    if not words:
        return 0
    parts = list(zip(*(words[i:] for i in range(shingle)), strict=False)) or [tuple(words)]
    join, digest = b" ".join, xxhash.xxh64_intdigest
    counts, n = np.zeros(BITS, dtype=np.int64), len(parts)
    for at in range(0, n, 1 << 16):
        hashes = np.fromiter((digest(join(p), SEED) for p in parts[at : at + (1 << 16)]), dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def word_print(text: str | None) -> int:
    """Majority fingerprint of the text's different words: an edit moves few of its bits, as it changes
    few words, where it changes several shingles."""
    words = set((text or "").encode().lower().split())
    if not words:
        return 0
    h = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), dtype="<u8", count=len(words))
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(key, fp): fp is the fingerprint as a signed long."""
    kind = dict(docs.dtypes)[key]
    schema = pa.schema([(key, pa.int64()), ("fp", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 500):
            fp = np.array([fingerprint(x, shingle) for x in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fp)], schema=schema)

    return docs.select(F.col(key).cast("long").alias(key) if kind != "bigint" else key, text).mapInArrow(run, f"{key} long, fp long")


def bit_statistics(classes: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, co-occurrence counts (64 x 64) and histograms of 8-bit blocks (8 x 256) of ``fp``."""

    def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, hist = np.zeros((BITS, BITS)), np.zeros((BITS // BLOCK, 1 << BLOCK), dtype=np.int64)
        for b in it:
            raw = np.ascontiguousarray(b.column(0).to_numpy(zero_copy_only=False)).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
            for k in range(BITS // BLOCK):
                hist[k] += np.bincount(raw[:, k], minlength=1 << BLOCK)
        flat = np.concatenate([both.astype(np.int64).ravel(), hist.ravel()])
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["at", "n"])

    flat = np.zeros(BITS * BITS + BITS // BLOCK * (1 << BLOCK), dtype=np.int64)
    rows = classes.select("fp").mapInArrow(part, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    for at, n in rows.collect():  # at most 64 * 64 + 8 * 256 rows
        flat[at] = n
    both, hist = flat[: BITS * BITS].reshape(BITS, BITS), flat[BITS * BITS :].reshape(-1, 1 << BLOCK)
    return int(hist[0].sum()), both, hist


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits into ``parts`` groups of near-equal size, correlated bits together (greedily)."""
    p = both / max(n, 1)
    sd = np.sqrt(np.clip(np.diag(p) * (1 - np.diag(p)), 1e-9, None))
    corr = np.abs((p - np.outer(np.diag(p), np.diag(p))) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, groups = set(range(BITS)), []
    for g in range(parts):
        want = BITS // parts + (g < BITS % parts)
        left = sorted(free)
        group = [max(left, key=lambda b: (corr[b, left].max(), -b))]
        free.discard(group[0])
        while len(group) < want:
            best = max(sorted(free), key=lambda b: (corr[b, group].mean(), -b))
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


class Plan:
    """Partitions of the bits with estimates of how many classes lie within each distance."""

    def __init__(self, n: int, both: np.ndarray, hist: np.ndarray, parts: int, radius: int):
        self.n, self.radius, self.groups = n, radius, group_bits(n, both, parts)
        # distance distributions within each 8-bit block restricted to the group's bits
        values = np.arange(1 << BLOCK)
        self.near = []
        for group in self.groups:
            blocks = []
            for k in range(BITS // BLOCK):
                mask = sum(1 << (b - BLOCK * k) for b in group if b // BLOCK == k)
                if not mask:
                    continue
                d = np.bitwise_count((values[:, None] ^ values[None, :]) & mask)
                share = hist[k] / max(1, hist[k].sum())
                blocks.append((k, np.stack([(d == t) @ share for t in range(radius + 1)], axis=1)))
            self.near.append(blocks)

    def candidates(self, fp: np.ndarray) -> np.ndarray:
        """[query, partition, threshold + 1]: cost of the probes and the expected rows met; column 0 is 'left out'."""
        raw = np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8)
        out = np.zeros((len(fp), len(self.groups), self.radius + 2))
        for g, blocks in enumerate(self.near):
            dist = np.zeros((len(fp), self.radius + 1))
            dist[:, 0] = 1
            for k, of in blocks:
                at, new = of[raw[:, k]], np.zeros_like(dist)
                for t in range(self.radius + 1):
                    for s in range(t + 1):
                        new[:, t] += dist[:, t - s] * at[:, s]
                dist = new
            width, ball = len(self.groups[g]), 0.0
            for t in range(self.radius + 1):
                ball += float(np.prod([(width - i) / (i + 1) for i in range(t)])) if t else 1.0
                out[:, g, t + 1] = PROBE * ball + self.n * dist[:, : t + 1].sum(1)
        return out

    def thresholds(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per query the cheapest thresholds with sum radius - partitions + 1, and their cost."""
        cost, m = self.candidates(fp), len(self.groups)
        budget = self.radius + 1  # sum of (threshold + 1)
        best = np.full((len(fp), budget + 1), np.inf)
        best[:, 0] = 0
        back = []
        for g in range(m):
            new, pick = np.full_like(best, np.inf), np.zeros(best.shape, dtype=np.int64)
            for total in range(budget + 1):
                for t in range(min(total, self.radius + 1) + 1):
                    c = best[:, total - t] + cost[:, g, t]
                    better = c < new[:, total]
                    new[better, total], pick[better, total] = c[better], t
            best = new
            back.append(pick)
        at, out = np.full(len(fp), budget), np.zeros((len(fp), m), dtype=np.int64)
        for g in reversed(range(m)):
            out[:, g] = back[g][np.arange(len(fp)), at]
            at = at - out[:, g]
        return out - 1, best[:, budget]

    def value(self, fp: np.ndarray, g: int) -> np.ndarray:
        """The bits of partition g, packed."""
        u, out = fp.view(np.uint64), np.zeros(len(fp), dtype=np.uint64)
        for i, b in enumerate(self.groups[g]):
            out |= ((u >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
        return out

    def ball(self, g: int, t: int) -> np.ndarray:
        width = len(self.groups[g])
        return np.array([sum(1 << b for b in c) for r in range(t + 1) for c in combinations(range(width), r)], dtype=np.uint64)


def choose_plan(n: int, both: np.ndarray, hist: np.ndarray, radius: int) -> Plan:
    """The number of partitions whose allocation costs least for queries drawn from the histograms."""
    rng = np.random.default_rng(7)
    raw = np.stack([rng.choice(1 << BLOCK, 512, p=h / max(1, h.sum()) if h.sum() else None) for h in hist], axis=1)
    queries = np.ascontiguousarray(raw.astype(np.uint8)).view(np.int64).ravel()
    plans = [Plan(n, both, hist, m, radius) for m in range(2, max(3, radius + 2))]
    return min(plans, key=lambda p: p.thresholds(queries)[1].mean() + len(p.groups))


def _blocks(classes: DataFrame, radius: int, scratch: Scratch, name: str, tile: int) -> DataFrame:
    """Queries (side 0) and indexed rows (side 1) dealt to blocks (value, s, d), sorted within partitions.

    A block is what one value of one partition gathers. A value of more than ``tile`` indexed rows is
    cut into tiles of both sides, every tile of queries meeting every tile of rows; elsewhere a block
    has at most ``tile`` rows and ``tile`` queries for each value of the ball. So no task holds or
    compares a whole hot value. The hot values are counted and written first.
    """
    plan = choose_plan(*bit_statistics(classes), radius)
    names = ["value", *classes.columns]
    at = classes.columns.index("fp")

    def dealt(b: pa.RecordBatch, g: int, value: np.ndarray, rows: np.ndarray | None = None) -> pa.RecordBatch:
        own = b.columns if rows is None else [c.take(pa.array(rows)) for c in b.columns]
        # at most 32 bits of value under the partition's number
        return pa.RecordBatch.from_arrays([pa.array((value | np.uint64(g << 40)).view(np.int64)), *own], names=names)

    def index(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fp = b.column(at).to_numpy(zero_copy_only=False)
            for g in range(len(plan.groups)):
                yield dealt(b, g, plan.value(fp, g))

    def probe(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 2000):
            fp = b.column(at).to_numpy(zero_copy_only=False)
            allowed, _ = plan.thresholds(fp)
            for g in range(len(plan.groups)):
                for t in range(radius + 1):
                    if len(rows := np.flatnonzero(allowed[:, g] == t)):
                        ball = plan.ball(g, t)
                        yield dealt(b, g, (plan.value(fp[rows], g)[:, None] ^ ball[None, :]).ravel(), np.repeat(rows, len(ball)))

    kind = "value long, " + ", ".join(f"{c} {t}" for c, t in classes.dtypes)
    queries, rows = classes.mapInArrow(probe, kind), classes.mapInArrow(index, kind)
    sizes = rows.groupBy("value").agg(F.count("*").alias("rows")).where(F.col("rows") > tile)
    hot = scratch.write(sizes.select("value", F.ceil(F.col("rows") / tile).cast("int").alias("tiles")), f"{name}-hot")
    if hot.isEmpty():
        place = lambda x, side: x.withColumns({"s": F.lit(0), "d": F.lit(0), "side": F.lit(side)})
    else:

        def place(x: DataFrame, side: int) -> DataFrame:
            own, other = ("s", "d") if side == 0 else ("d", "s")
            tiles = F.coalesce("tiles", F.lit(1))
            cut = x.join(hot, "value", "left").withColumn(own, F.pmod(F.xxhash64("node"), tiles).cast("int"))
            return cut.withColumn(other, F.explode(F.sequence(F.lit(0), tiles - 1))).withColumn("side", F.lit(side))

    keys = ["value", "s", "d"]
    order = [*keys, "side", *classes.columns]
    return place(queries, 0).select(order).unionAll(place(rows, 1).select(order)).repartition(*keys).sortWithinPartitions(*keys, "side")


def _whole_blocks(it: Iterator[pa.RecordBatch], rows: int = 1 << 15) -> Iterator[pa.Table]:
    """Tables of whole blocks, of about ``rows`` rows; the first three columns say the block."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in it:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        last = np.ones(n, dtype=bool)
        for c in range(3):
            x = t.column(c).to_numpy()
            last &= x == x[-1]
        cut = n - int(last.sum())
        if cut:
            yield t.slice(0, cut)
        held, n = t.slice(cut).to_batches(), n - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _close(t: pa.Table, radius: int, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (query, row) of the pairs within the radius in each block of ``t``, each from its lesser node."""
    new = np.zeros(t.num_rows, dtype=bool)
    new[0] = True
    for c in range(3):
        k = t.column(c).to_numpy()
        new[1:] |= k[1:] != k[:-1]
    block = np.cumsum(new) - 1
    queries = t["side"].to_numpy() == 0
    n_rows = np.bincount(block[~queries], minlength=block[-1] + 1)
    ends = np.append(np.flatnonzero(new)[1:], t.num_rows)
    fp, node = t["fp"].to_numpy().view(np.uint64), t["node"].to_numpy()
    q = np.flatnonzero(queries)
    reps = n_rows[block[q]]
    upto = np.cumsum(reps)
    cuts = [0, *(np.flatnonzero(np.diff(upto // most)) + 1).tolist(), len(q)]
    for x, y in zip(cuts, cuts[1:], strict=False):
        k = reps[x:y]
        i = np.repeat(q[x:y], k)
        j = np.repeat(ends[block[q[x:y]]] - k, k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        near = (np.bitwise_count(fp[i] ^ fp[j]) <= radius) & (node[i] < node[j])
        yield i[near], j[near]


def _nodes(classes: DataFrame) -> DataFrame:
    return classes if "node" in classes.columns else classes.select("fp", F.col("fp").alias("node"))


def links(classes: DataFrame, radius: int = 3, similarity: float | None = None, scratch: Scratch | None = None, tile: int = TILE) -> DataFrame:
    """(src, dst): every pair of different nodes of ``classes`` (fp[, node]) within ``radius`` bits, once or more.

    With ``root`` and ``n`` among the columns, pairs of one root are left out, as are pairs whose sizes
    n can't have the Jaccard ``similarity``. ``spanning`` is the form for groups of any size.
    """
    own = scratch or Scratch(classes.sparkSession, "links")
    apart = "root" in classes.columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_blocks(it):
            node = t["node"].to_numpy()
            for i, j in _close(t, radius):
                if apart:
                    root, n = t["root"].to_numpy(), t["n"].to_numpy()
                    keep = (root[i] != root[j]) & (np.minimum(n[i], n[j]) >= (similarity or 0) * np.maximum(n[i], n[j]) - 1e-9)
                    i, j = i[keep], j[keep]
                yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], names=["src", "dst"])

    return _blocks(_nodes(classes), radius, own, f"links{radius}", tile).mapInArrow(run, "src long, dst long")


def spanning(classes: DataFrame, radius: int = 3, scratch: Scratch | None = None, tile: int = TILE) -> DataFrame:
    """(src, dst): links that connect what the links within ``radius`` connect, at most one a row of a block."""
    own = scratch or Scratch(classes.sparkSession, "spanning")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_blocks(it):
            node = t["node"].to_numpy()
            for i, j in _close(t, radius):
                names, at = np.unique(np.concatenate([node[i], node[j]]), return_inverse=True)
                root = forest(len(names), at[: len(i)], at[len(i) :])
                moved = np.flatnonzero(root != np.arange(len(names)))
                yield pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[root[moved]])], names=["src", "dst"])

    return _blocks(_nodes(classes), radius, own, f"spanning{radius}", tile).mapInArrow(run, "src long, dst long")


def near_duplicates(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """(key, fp, component): the smallest key reachable over links of fingerprints."""
    scratch = Scratch(spark, "simhash")
    prints = scratch.write(fingerprints(docs, key, text, shingle), "prints")
    classes = scratch.write(prints.groupBy("fp").agg(F.min(key).alias("least")), "classes")
    roots = connected_components(spark, spanning(classes.select("fp"), radius, scratch), scratch).withColumnRenamed("node", "fp")
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    of = scratch.write(rooted.join(least, "root").select("fp", "component"), "of")
    return prints.join(of, "fp").select(key, "fp", "component")


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """The hashes of the text's different word shingles, ascending; words as in ``fingerprint``."""
    words = (text or "").encode().lower().split()
    parts = set(zip(*(words[i:] for i in range(shingle)), strict=False)) or ({tuple(words)} if words else set())
    return np.sort(np.fromiter((xxhash.xxh64_intdigest(b" ".join(p), SEED) for p in parts), dtype="<u8", count=len(parts))).view(np.int64)


def signature(hashes: np.ndarray) -> int:
    """One long for texts of equal shingle sets."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).view(np.int64))


def similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(src, dst): those of ``pairs`` of signatures whose ``sets`` (sig, has) have the Jaccard similarity."""
    both = pairs.join(sets.toDF("src", "a"), "src").join(sets.toDF("dst", "b"), "dst")
    same = F.size(F.array_intersect("a", "b"))
    return both.where(same >= similarity * (F.size("a") + F.size("b") - same) - 1e-9).select("src", "dst")


def similar_within(names: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links of similarity among ``sets`` (ascending, without repeats).

    Breadth first: a set is compared with those that its component doesn't hold yet, all in one pass.
    """
    size = np.array([len(x) for x in sets], dtype=np.int64)
    free, out = np.arange(len(sets)), []
    while len(free) > 1:
        queue, free = [int(free[0])], free[1:]
        while queue and len(free):
            p = queue.pop()
            fit = np.minimum(size[free], size[p]) >= similarity * np.maximum(size[free], size[p]) - 1e-9
            others = free[fit]
            if not len(others):
                continue
            both = np.zeros(len(others), dtype=np.int64)
            if size[p]:
                flat = np.concatenate([sets[k] for k in others])
                at = np.searchsorted(sets[p], flat)
                at[at == size[p]] = 0
                ends = np.cumsum(size[others])
                hits = np.concatenate([[0], np.cumsum(sets[p][at] == flat)])
                both = hits[ends] - hits[ends - size[others]]
            hit = others[both >= similarity * (size[others] + size[p] - both) - 1e-9]
            out += [(int(names[p]), int(names[k])) for k in hit]
            queue += hit.tolist()
            free = np.setdiff1d(free, hit, assume_unique=True)
    return out


def similar_groups(members: DataFrame, sets: DataFrame, similarity: float, scratch: Scratch, tile: int) -> DataFrame:
    """(src, dst): a spanning forest of the links of similarity within each group of ``members`` (sig, root).

    A group is cut into tiles of about ``tile`` sets and each pair of its tiles is one block, so a
    task holds two tiles of sets, however large the group; no pairs are put out.
    """
    counts = members.groupBy("root").agg(F.count("*").alias("k")).where("k > 1").withColumn("tiles", F.ceil(F.col("k") / tile).cast("int")).drop("k")
    counts = scratch.write(counts, "groups")
    cut = members.join(counts, "root").withColumn("t", F.pmod(F.xxhash64("sig"), F.col("tiles")).cast("int"))
    # the pairs of tiles (s <= d) that hold tile t
    spread = cut.withColumn("u", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("root", "sig", F.least("t", "u").alias("s"), F.greatest("t", "u").alias("d"))
    held = spread.join(sets, "sig").select("root", "s", "d", "sig", "has")
    keys = ["root", "s", "d"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_blocks((b for big in it for b in batches(iter([big]), 256)), 2 * tile):
            key = np.stack([t.column(c).to_numpy().astype(np.int64) for c in range(3)], axis=1)
            first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
            out: list[tuple[int, int]] = []
            for a, b in zip(first, np.append(first[1:], t.num_rows), strict=True):
                has = t["has"].slice(a, b - a).combine_chunks()
                flat, ends = has.values.to_numpy().view(np.uint64), has.offsets.to_numpy()  # ascending as unsigned numbers
                out += similar_within(t["sig"].slice(a, b - a).to_numpy(), [flat[x:y] for x, y in zip(ends, ends[1:], strict=False)], similarity)
            src, dst = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return held.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "src long, dst long")


def alike(spark: SparkSession, docs: DataFrame, similarity: float, key: str = "doc_id", text: str = "text", radius: int = 6, tile: int = GROUP_TILE) -> DataFrame:
    """(key, fp, component) over links of texts that have the 5-word shingle similarity.

    Candidates come from fingerprints of the different words (``word_print``).
    Texts of equal shingle sets are one signature. Signatures chained by fingerprints within ``CHAIN``
    bits (or ``radius``, if less) are a group, all of whose sets are compared in tiles; beyond the
    groups, pairs within ``radius`` bits are verified one by one.
    """
    scratch = Scratch(spark, "alike")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 500):
            texts = b.column(1).to_pylist()
            fp = np.array([word_print(x) for x in texts], dtype=np.uint64).view(np.int64)
            has = [shingle_set(x) for x in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), pa.array([signature(h) for h in has], pa.int64()), pa.array([len(h) for h in has], pa.int32())], names=[key, "fp", "sig", "n"])

    def sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 200):
            has = [shingle_set(x) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([signature(h) for h in has], pa.int64()), pa.array(has, pa.list_(pa.int64()))], names=["sig", "has"])

    prints = scratch.write(docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, f"{key} long, fp long, sig long, n int"), "prints")
    # one set of shingles can have several fingerprints: each is a row of the same node
    of = scratch.write(prints.select("fp", F.col("sig").alias("node"), "n").distinct(), "of")
    classes = scratch.write(prints.groupBy("sig").agg(F.min(key).alias("least")), "classes")
    chains = connected_components(spark, spanning(of.select("fp", "node"), min(CHAIN, radius), scratch), scratch, "chain")
    rooted_of = scratch.write(of.join(chains, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    pairs = scratch.write(links(rooted_of, radius, similarity, scratch).distinct(), "pairs")
    members = chains.select(F.col("node").alias("sig"), "root")
    wanted = pairs.select(F.col("src").alias("sig")).union(pairs.select("dst")).union(members.select("sig")).distinct()
    wanted = scratch.write(wanted.join(classes, "sig").select(F.col("least").alias("__least")).distinct(), "wanted")
    known = docs.join(wanted, docs[key].cast("long").eqNullSafe(wanted["__least"]), "left_semi").select(text).mapInArrow(sets, "sig long, has array<long>").dropDuplicates(["sig"])
    known = scratch.write(known, "sets")
    edges = similar_groups(members, known, similarity, scratch, tile).unionAll(similar_pairs(pairs, known, similarity))
    return rooted(spark, prints, classes, scratch.write(edges, "edges"), scratch, key)


def rooted(spark: SparkSession, prints: DataFrame, classes: DataFrame, edges: DataFrame, scratch: Scratch, key: str) -> DataFrame:
    """(key, fp, component): the smallest key reachable over ``edges`` of signatures."""
    roots = connected_components(spark, edges, scratch).withColumnRenamed("node", "sig")
    of = classes.join(roots, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    least = of.groupBy("root").agg(F.min("least").alias("component"))
    return prints.join(scratch.write(of.join(least, "root").select("sig", "component"), "components"), "sig").select(key, "fp", "component")


def keep_one(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3, similarity: float | None = None) -> DataFrame:
    """``docs`` with one document of each group: the one of the smallest id.

    ``similarity``: links are between texts of that Jaccard similarity of 5-word shingles, found
    within ``radius`` bits of the fingerprints of their words (``shingle`` is not used).
    Equal rows become one; different texts under one id stand or fall with the id.
    """
    found = near_duplicates(spark, docs, key, text, shingle, radius) if similarity is None else alike(spark, docs, similarity, key, text, radius)
    kept = found.where(F.col(key).eqNullSafe(F.col("component"))).select(F.col(key).alias("__kept")).distinct()
    out = docs.join(kept, docs[key].eqNullSafe(kept["__kept"]), "left_semi")
    if not found.groupBy(key).count().where("count > 1").isEmpty():
        tag = "__text"
        out = out.withColumn(tag, F.xxhash64(text)).dropDuplicates([key, tag]).drop(tag)
    return out
