"""Benchmark decontamination with SimHash over item-sized windows.

Words are lower-cased runs of letters, digits and underscores; shingles are five words (an item
of fewer words is one shingle). A shingle's weight is its rarity among the benchmark's items.

* A document is slid over in windows as long as an item. A window that shares no shingle with any
  item of its length has similarity zero with all of them, so only windows around shared
  shingles are fingerprinted; nothing else is left out.
* A window is compared with the items of its own length, held as one index a length.
* A window's 64-bit SimHash is the sign of weighted bit sums, kept as running sums.
* Multi-index: the 64 bits are cut into ``BLOCKS`` blocks. Within ``RADIUS`` bits of an item, some
  block differs by at most ``RADIUS // BLOCKS`` bits; each block holds, for each of its values, the
  items that do so. A window looks up its seven lists, and the whole distance is checked after. The guarantee holds for every fingerprint in the
  radius; at similarity 0.8 the distance has mean 9.7 and standard deviation 2.9, so the radius of
  20 leaves out about one match at the threshold in 5,000 and hardly any above it.
* Candidates are decided by the exact weighted Jaccard similarity of shingle counts; a shingle that
  the item doesn't hold has the weight of one found in a single item.

The benchmark is read in blocks of at most ``block_bytes`` of text, each sent to the tasks; the
documents are a stream of Arrow batches and never shuffled. A benchmark of any size is so many
passes; shingles are counted over all of it first, so blocks don't change similarities.

Cases: null and empty texts and items without words match nothing; a document shorter than an
item is one window; repeated items each report their matches, repeated rows theirs; of windows with
equal similarity the first counts; an empty table on either side gives an empty result; other
columns are ignored, and kept by ``drop_contaminated``.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forkline.llm.common import Scratch, batches, strings

SHINGLE = 5
RADIUS = 20
BLOCKS = 7
WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def shingles(words: list[str], k: int) -> list[tuple[str, ...]]:
    return list(zip(*(words[i:] for i in range(k)), strict=False))


def gram_hash(gram: tuple[str, ...]) -> int:
    return xxhash.xxh64_intdigest(" ".join(gram)) - 2**63


def _edges() -> list[int]:
    return [64 * i // BLOCKS for i in range(BLOCKS + 1)]


class Band:
    """Multi-index of the fingerprints of items of one length.

    For every value of each block it holds the items within ``RADIUS // BLOCKS`` bits of it, so a
    window's candidates are looked up, not found by going through the items.
    """

    def __init__(self, prints: np.ndarray, items: np.ndarray):
        self.prints, self.items, self.tables = prints, items, []
        for a, b in zip(_edges(), _edges()[1:], strict=False):
            own = (prints >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)
            lists = [np.flatnonzero(np.bitwise_count(own ^ np.uint64(v)) <= RADIUS // BLOCKS) for v in range(1 << (b - a))]
            ends = np.cumsum([0, *map(len, lists)])
            self.tables.append((a, b, ends, np.concatenate(lists)))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, place in the band) of all pairs within the radius."""
        met = []
        for a, b, ends, lists in self.tables:
            v = ((prints >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)).astype(np.int64)
            n = ends[v + 1] - ends[v]
            w = np.repeat(np.arange(len(prints)), n)
            at = np.repeat(ends[v] - np.cumsum(n) + n, n) + np.arange(n.sum())
            met.append(w * len(self.prints) + lists[at])
        w, i = np.divmod(np.unique(np.concatenate(met)), len(self.prints))
        close = np.bitwise_count(prints[w] ^ self.prints[i]) <= RADIUS
        return w[close], i[close]


class Index:
    """Items of one block of the benchmark with their shingles, weights and fingerprints.

    ``df``: in how many of the whole benchmark's ``n`` items each shingle (by hash) occurs; without it
    the items are the whole benchmark.
    """

    def __init__(self, items: list[tuple[int, str]], threshold: float, df: dict[int, int] | None = None, n: int | None = None):
        self.threshold = threshold
        self.items = [(i, w) for i, x in items if (w := words_of(x))]
        self.k = [min(SHINGLE, len(w)) for _, w in self.items]
        self.counts = [Counter(shingles(w, k)) for (_, w), k in zip(self.items, self.k, strict=True)]
        own = Counter(s for c in self.counts for s in c)
        n = max(1, len(self.items) if n is None else n)
        self.rare = 1 + math.log(n)
        self.weight = {s: 1 + math.log(n / (d if df is None else df[gram_hash(s)])) for s, d in own.items()}
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for _, ws in self.items for w in ws}))}
        keys: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for (_, ws), k in zip(self.items, self.k, strict=True):
            ids = np.array([self.vocabulary[w] for w in ws], dtype=np.uint64)
            for key in self._keys(ids, k).tolist():
                keys[k][key].add(len(ws))
        # per shingle length: sorted keys and the item lengths that hold each
        self.keys = {k: (np.array(sorted(of), dtype=np.uint64), [sorted(of[x]) for x in sorted(of)]) for k, of in keys.items()}
        self.prints = np.array([self._print(c) for c in self.counts], dtype=np.uint64)
        sizes = np.array([len(w) for _, w in self.items], dtype=np.int64)
        self.bands = {int(m): Band(self.prints[at], at) for m in np.unique(sizes) for at in [np.flatnonzero(sizes == m)]}

    @staticmethod
    def _keys(ids: np.ndarray, k: int) -> np.ndarray:
        """One number per k-gram of word numbers; grams with an unknown word (0) get 0."""
        n = len(ids) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        out, known = np.zeros(n, dtype=np.uint64), np.ones(n, dtype=bool)
        for j in range(k):
            part = ids[j : j + n]
            out = (out ^ part) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
            known &= part != 0
        return np.where(known, out | np.uint64(1), np.uint64(0))

    def _signs(self, grams: list[tuple[str, ...]]) -> np.ndarray:
        """Weighted +-1 of every bit of every shingle."""
        h = np.array([xxhash.xxh64_intdigest(" ".join(g)) for g in grams], dtype="<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
        weight = np.array([self.weight.get(g, self.rare) for g in grams])
        return (2 * bits - 1) * weight[:, None]

    @staticmethod
    def _pack(sums: np.ndarray) -> np.ndarray:
        # running sums differ by rounding: what is zero but for that counts as zero
        return np.packbits(sums > 1e-6, axis=-1, bitorder="little").view("<u8")[..., 0]

    def _print(self, counts: Counter) -> int:
        grams = list(counts)
        signs = self._signs(grams) * np.array([counts[g] for g in grams])[:, None]
        return int(self._pack(signs.sum(0)[None])[0])

    def similarity(self, window: Counter, item: Counter) -> float:
        """Weighted Jaccard similarity of shingle counts; what the item doesn't hold weighs as the rarest."""
        both = union = 0.0
        for s, n in item.items():
            w, m = self.weight[s], window[s]
            both += w * min(m, n)
            union += w * max(m, n)
        union += self.rare * sum(m for s, m in window.items() if s not in item)
        return both / union if union else 0.0

    def matches(self, text: str) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word, number of words): the best window of each item found."""
        words = words_of(text)
        if not words or not self.items:
            return []
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words], dtype=np.uint64)
        starts: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, (keys, lengths) in self.keys.items():
            if len(words) < k:  # shorter than every shingle of this length: it can't be an item's window
                continue
            grams = self._keys(ids, k)
            at = np.searchsorted(keys, grams)
            at[at == len(keys)] = 0
            for p in np.flatnonzero((keys[at] == grams) & (grams != 0)).tolist():
                for n in lengths[at[p]]:
                    starts[n].append((max(0, p - (n - k)), min(p, max(0, len(words) - n))))
        best: dict[int, tuple[float, int, int]] = {}
        for n, ranges in starts.items():
            k = min(SHINGLE, n)
            for lo, hi in _merged(ranges):
                self._look(words, n, k, lo, max(lo, hi), best)
        return [(self.items[i][0], s, a, m) for i, (s, a, m) in sorted(best.items())]

    def _look(self, words: list[str], n: int, k: int, lo: int, hi: int, best: dict) -> None:
        band = self.bands[n]
        for a in range(lo, hi + 1, 4096):
            b = min(a + 4095, hi)
            region = words[a : b + n]
            grams = shingles(region, k)
            if not grams:
                return
            size = min(n, len(region))
            count = size - k + 1
            sums = np.concatenate([np.zeros((1, 64)), np.cumsum(self._signs(grams), axis=0)])
            first = np.arange(0, max(1, len(grams) - count + 1))
            w, i = band.near(self._pack(sums[first + count] - sums[first]))
            counts: dict[int, Counter] = {}
            for x, item in zip(w.tolist(), band.items[i].tolist(), strict=True):
                if x not in counts:
                    counts[x] = Counter(grams[x : x + count])
                s = self.similarity(counts[x], self.counts[item])
                if s >= self.threshold and (item not in best or (s, -(a + x)) > (best[item][0], -best[item][1])):
                    best[item] = (s, a + x, size)


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


_indexes: dict[str, Index] = {}


def blocks(benchmark: DataFrame, key: str, text: str, block_bytes: int, scratch: Scratch) -> Iterator[tuple[list[tuple[int, str]], dict[int, int] | None, int | None]]:
    """(items, how many of all items hold each of their shingles, number of all items) of pieces of about ``block_bytes``.

    The driver holds one piece at a time; the counts are over the whole benchmark, so a similarity
    doesn't depend on how the items are dealt to pieces. One piece is all there is: it counts itself.
    """
    total = benchmark.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    n = max(1, -(-total // block_bytes))
    rows = benchmark.select(F.pmod(F.xxhash64(key, text), F.lit(n)).cast("int").alias("block"), F.col(key).cast("long").alias("item"), F.col(text).alias("text"))
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    if n == 1:
        yield sorted(((r["item"], r["text"] or "") for r in rows.collect()), key=order), None, None
        return

    def grams(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 200):
            block, gram = [], []
            for k, x in zip(b.column(0).to_pylist(), strings(b.column(2)), strict=True):
                words = words_of(x)
                own = {gram_hash(g) for g in shingles(words, min(SHINGLE, len(words)))} if words else set()
                block += [k] * (len(own) + bool(words))
                gram += [*own, *[None] * bool(words)]  # a null counts the item itself
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(gram, pa.int64())], names=["block", "gram"])

    held = scratch.write(rows.mapInArrow(grams, "block int, gram long"), "grams")
    items = held.where("gram IS NULL").count()
    df = scratch.write(held.where("gram IS NOT NULL").groupBy("gram").agg(F.count("*").alias("d")), "df")
    known = scratch.write(held.select("block", "gram").distinct().join(df, "gram"), "known")
    for b in range(n):
        part = sorted(((r["item"], r["text"] or "") for r in rows.where(F.col("block") == b).collect()), key=order)
        yield part, {r["gram"]: r["d"] for r in known.where(F.col("block") == b).collect()}, items


def find(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """(key, item_id, similarity, first_word, n_words): every document and item that match."""
    rows, parts = docs.select(F.col(key).cast("long").alias(key), text), []
    schema = f"{key} long, item_id long, similarity double, first_word long, n_words long"
    scratch = Scratch(spark, "contamination")
    for items, df, n in blocks(benchmark, item_key, item_text, block_bytes, scratch):
        sent = spark.sparkContext.broadcast((items, df, n))  # at most block_bytes of text and its shingles' counts
        name = f"{threshold}/{n}/{xxhash.xxh3_128_hexdigest(repr(items))}"

        def run(it: Iterator[pa.RecordBatch], sent=sent, name=name) -> Iterator[pa.RecordBatch]:
            if name not in _indexes:
                _indexes.clear()
                _indexes[name] = Index(sent.value[0], threshold, *sent.value[1:])
            index = _indexes[name]
            for b in batches(it, 200):
                got = [(i, *m) for i, x in zip(b.column(0).to_pylist(), strings(b.column(1)), strict=True) for m in index.matches(x)]
                columns = list(zip(*got, strict=True)) or [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[key, "item_id", "similarity", "first_word", "n_words"])

        part = rows.mapInArrow(run, schema)
        if n is None:
            return part
        parts.append(scratch.write(part, f"part-{len(parts)}"))  # before the next piece is held
        sent.unpersist()
    return reduce(DataFrame.unionAll, parts)


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that match an item; rows are told apart by id and text, so repeated ids do no harm."""
    tag = "__row"
    marked = docs.withColumn(tag, F.xxhash64(key, text))
    bad = find(spark, marked, benchmark, threshold, key=tag, text=text).select(tag).distinct()
    return marked.join(bad, tag, "left_anti").drop(tag)
