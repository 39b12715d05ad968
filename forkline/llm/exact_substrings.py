"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that also starts earlier go.

Every text is its UTF-8 bytes; matches never cross documents. A window is a start with ``length``
bytes after it in its document.

1. Anchors. A window's anchor is its 40-byte gram of least hash (the first of equals): equal
   windows have equal anchors at equal offsets. Neighbouring windows share an anchor, so a document
   is a list of runs: (gram hash, hash of the run's bytes, place, windows); two runs are equal if
   both 64-bit hashes are.
2. Only runs whose gram occurs twice or more can hold a repeated window (a grouped count with
   partial aggregation, then a join that adaptive execution can split).
3. Runs of equal bytes are one segment, kept by its first place: all windows of its other places
   are repeats. So any number of copies costs one segment from here on.
4. Segments that share a gram but differ (where copies begin, end or were edited) get their
   bytes back from the documents and are sorted: whole groups are packed into blocks, each block
   becomes a suffix array (``suffix_array``: linear grouping of Lyndon prefixes; the gram, which
   all windows of a segment hold, is one letter), suffixes that agree over a window are neighbours
   there, and of each such class all but the first place are repeats. A gram with more than
   ``LARGE`` different segments (a phrase in ever new surroundings) is first dealt out anew: each
   segment is cut into parts of ``PART`` windows, and only parts that share the bytes common to
   their windows stay together. Parts still in groups beyond ``LARGE`` are no block of one task:
   their windows are counted by 128-bit hash, with partial aggregation, so nothing is capped.
5. The repeats' ranges meet the texts once, by document.

Cases: a null text is empty; a text shorter than ``length`` keeps every byte; a null id counts as
the smallest; equal rows (id and text) have equal places and keep what one of them keeps; different
texts under one id (null ids too) are different documents, in the order of the texts' hashes; an
empty table gives an empty result; very long texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forkline.llm.common import NO_ID, Scratch, batches, tagged
from forkline.llm.suffix_array import suffix_array

GRAM = 40
#: Bytes packed into a block before it is sorted; a group is never cut.
BLOCK = 24_000
#: Different segments of one group that a block may hold.
LARGE = 1_000
#: Windows of a part, where a group beyond that is dealt out anew.
PART = 8
_BYTE = np.random.default_rng(20_240_229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM = 32 + 8 bytes from every position on (polynomials, doubled)."""
    h, step, factor, eight = _BYTE[raw], 1, 0x9E3779B97F4A7C15, None
    while step < 32:
        h = h[:-step] * np.uint64(factor) + h[step:]
        step, factor = 2 * step, factor * factor % 2**64
        if step == 8:
            eight, by = h, factor
    h = h[:-8] * np.uint64(by) + eight[32:]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def anchors(grams: np.ndarray, length: int) -> np.ndarray:
    """Position of the anchor of the window from every position on; ``grams``: hashes of all grams."""
    value = grams
    place = np.arange(len(value), dtype=np.int32)
    width, have = length - GRAM + 1, 1

    def join(step: int) -> None:
        nonlocal value, place
        later = value[step:] < value[:-step]
        place = np.where(later, place[step:], place[:-step])
        value = np.minimum(value[step:], value[:-step])

    while 2 * have <= width:
        join(have)
        have *= 2
    if have < width:
        join(width - have)
    return place


def runs_of(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text, first start, windows, anchor less first start, gram hash, hash) of all runs."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    whole = b"".join(texts)
    raw = np.frombuffer(whole, dtype=np.uint8)
    none = tuple(np.zeros(0, dtype=np.int64) for _ in range(6))
    if len(raw) < length:
        return none
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    grams = gram_hashes(raw)
    place = anchors(grams, length)
    live = np.zeros(len(place), dtype=bool)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.maximum(sizes, 0))
    windows = np.maximum(0, sizes - length + 1)
    at = np.repeat(first, windows) + (np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows))
    live[at] = True
    if not live.any():
        return none
    text, place_at = owner[at], place[at]
    new = np.concatenate([[True], (place_at[1:] != place_at[:-1]) | (text[1:] != text[:-1])])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(at)))
    start, which, anchor = at[begin], text[begin], place_at[begin]
    digest, view = xxhash.xxh3_64_intdigest, memoryview(whole)
    ends = (start + count + (length - 1)).tolist()
    h = np.array([digest(view[a:b]) for a, b in zip(start.tolist(), ends, strict=True)], dtype=np.uint64)
    return which, start - first[which], count, anchor - start, grams[anchor].view(np.int64), h.view(np.int64)


def encoded(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column, null as empty, without decoding."""
    binary = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return [x or b"" for x in binary.to_pylist()]


def chunks(it: Iterator[pa.RecordBatch], at: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Pieces of about ``size`` bytes of column ``at``, one row at least."""
    for b in batches(it, 2000):
        lengths = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in b.column(at)], dtype=np.int64)
        piece = np.cumsum(lengths) // size
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(piece)) + 1, [len(lengths)]])
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if y > x:
                yield b.slice(x, y - x)


def block_repeats(segments: list[tuple[int, int, int, int, int, bytes]], length: int) -> list[tuple[int, int, int, int]]:
    """Repeated windows (id, twin, first start, windows) among segments (id, twin, start, windows, anchor, bytes)."""
    documents = sorted({s[:2] for s in segments})
    rank_of = {d: i for i, d in enumerate(documents)}
    segments = [(rank_of[s[:2]], *s[2:]) for s in segments]
    letters: dict[bytes, int] = {}
    parts = []
    for _, _, _, rel, raw in segments:
        letter = letters.setdefault(raw[rel : rel + GRAM], 257 + len(letters))
        parts += [np.frombuffer(raw, np.uint8, rel).astype(np.int64) + 1, [letter], np.frombuffer(raw, np.uint8, offset=rel + GRAM).astype(np.int64) + 1, [0]]
    codes = np.concatenate(parts)
    sizes = np.array([len(s[4]) - GRAM + 2 for s in segments])
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    windows = np.array([s[2] for s in segments], dtype=np.int64)
    owner = np.full(len(codes), -1, dtype=np.int64)
    for k, (f, w) in enumerate(zip(first.tolist(), windows.tolist(), strict=True)):
        owner[f : f + w] = k
    order = np.array(suffix_array(codes), dtype=np.int64)
    order = order[owner[order] >= 0]
    raw = np.lib.stride_tricks.sliding_window_view(codes.astype(np.int32), length - GRAM + 1)
    same = np.zeros(len(order), dtype=bool)
    for at in range(1, len(order), 8192):
        to = min(at + 8192, len(order))
        same[at:to] = (raw[order[at:to]] == raw[order[at - 1 : to - 1]]).all(1)
    klass = np.cumsum(~same)
    ids = np.array([s[0] for s in segments], dtype=np.int64)[owner[order]]
    starts = np.array([s[1] for s in segments], dtype=np.int64)[owner[order]] + order - first[owner[order]]
    rank = np.lexsort((starts, ids, klass))
    later = np.concatenate([[False], klass[rank][1:] == klass[rank][:-1]])
    # equal places (equal rows) are one place
    lead = np.maximum.accumulate(np.where(later, 0, np.arange(len(rank))))
    later &= (ids[rank] != ids[rank][lead]) | (starts[rank] != starts[rank][lead])
    ids, starts = ids[rank][later], starts[rank][later]
    return [(*documents[i], at, n) for i, at, n in merged(ids, starts)]


def merged(ids: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
    """Neighbouring starts of one id as ranges."""
    if not len(ids):
        return []
    order = np.lexsort((starts, ids))
    ids, starts = ids[order], starts[order]
    new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (starts[1:] > starts[:-1] + 1)])
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(ids)) - 1
    return list(zip(ids[begin].tolist(), starts[begin].tolist(), (starts[last] - starts[begin] + 1).tolist(), strict=True))


def repeats(spark: SparkSession, docs: DataFrame, scratch: Scratch, length: int) -> DataFrame:
    """(id, twin, at, n): ranges of starts of repeated windows; ``docs`` has id, twin and text."""

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(it, 2):
            which, start, n, rel, gram, h = runs_of(encoded(b.column(2)), length)
            ids, twins = (b.column(c).to_numpy(zero_copy_only=False)[which] for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(h), pa.array(ids), pa.array(twins), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int16)), pa.array(rel.astype(np.int16))], names=["gram", "h", "id", "twin", "at", "n", "rel"])

    runs = scratch.write(docs.mapInArrow(cut, "gram long, h long, id long, twin long, at int, n short, rel short"), "runs")
    # counts are written before they are joined: then both sides of a join come from plain
    # exchanges, and adaptive execution can split a gram that a large share of all runs has
    often = scratch.write(runs.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1").select("gram"), "often")
    shared = scratch.write(runs.join(often, "gram"), "shared")
    scratch.drop("runs")
    same = ["gram", "h", "rel"]
    segments = scratch.write(shared.groupBy(*same).agg(F.min(F.struct("id", "twin", "at", "n")).alias("first"), F.count("*").alias("places")), "segments")
    mixed = scratch.write(segments.groupBy("gram").agg(F.count("*").alias("k")).where("k > 1"), "mixed")
    copies = shared.join(segments.where("places > 1").select(*same, F.col("first.id").alias("id0"), F.col("first.twin").alias("twin0"), F.col("first.at").alias("at0")), same)
    copies = copies.where("id <> id0 or twin <> twin0 or at <> at0").select("id", "twin", "at", F.col("n").cast("int").alias("n"))

    wanted = segments.join(mixed, "gram").select(F.col("first.id").alias("id"), F.col("first.twin").alias("twin"), F.struct("gram", "k", F.col("first.at").alias("at"), F.col("first.n").cast("int").alias("n"), F.col("rel").cast("int").alias("rel")).alias("s"))
    wanted = wanted.groupBy("id", "twin").agg(F.collect_list("s").alias("s"))  # at most a document's runs
    body = ["id", "twin", "at", "n", "rel", "bytes"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    columns_of = "id long, twin long, at int, n int, rel int, bytes binary"
    ranges = "id long, twin long, at int, n int"

    def rows(got: list[tuple], lead: list[str], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
        columns = list(zip(*got, strict=True)) or [()] * (len(lead) + len(names))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * len(lead) + types, strict=True)], names=lead + names)

    def fetch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 200):
            out = []
            for i, twin, t, segs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), encoded(b.column(2)), b.column(3).to_pylist(), strict=True):
                out += [(s["gram"], s["k"], i, twin, s["at"], s["n"], s["rel"], t[s["at"] : s["at"] + s["n"] + length - 1]) for s in segs]
            yield rows(out, ["gram", "k"], body, kinds)

    bodies = scratch.write(docs.join(wanted, ["id", "twin"]).select("id", "twin", "text", "s").mapInArrow(fetch, f"gram long, k long, {columns_of}"), "bodies")

    def sort(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, group, held, last = [], [], 0, None
        out = lambda b: rows(block_repeats(b, length), [], body[:4], kinds[:4])
        for b in it:
            keys, segs = b.column(0).to_pylist(), zip(*(c.to_pylist() for c in b.columns[1:]), strict=True)
            for key, seg in zip(keys, segs, strict=True):
                if key != last:
                    block, group, last = block + group, [], key
                    if held >= BLOCK:
                        yield out(block)
                        block, held = [], 0
                group.append(seg)
                held += len(seg[5]) - GRAM
        if block or group:
            yield out(block + group)

    def sorted_repeats(d: DataFrame, key: str) -> DataFrame:
        return d.repartition(key).sortWithinPartitions(key).select(key, *body).mapInArrow(sort, ranges)

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for b in batches(it, 500):
            out = []
            for i, twin, at, n, rel, raw in zip(*(b.column(c).to_pylist() for c in body), strict=True):
                for part in range((rel - n + 1) // PART, rel // PART + 1):  # by the anchor's offset in the window
                    low, high = PART * part, PART * part + PART - 1
                    x, y = max(0, rel - high), min(n - 1, rel - low)
                    core = raw[rel - low : rel - high + length]  # in every window with these offsets
                    out.append((digest(core, part) - 2**63, i, twin, at + x, y - x + 1, rel - x, raw[x : y + length]))
            yield rows(out, ["core"], body, kinds)

    large = bodies.where(F.col("k") > LARGE)
    found = copies.unionAll(sorted_repeats(bodies.where(F.col("k") <= LARGE), "gram"))
    if large.isEmpty():
        return found
    parts = scratch.write(large.mapInArrow(deal, f"core long, {columns_of}"), "parts")
    sizes = parts.groupBy("core").agg(F.count("*").alias("k")).where("k > 1")
    again = scratch.write(parts.join(sizes, "core"), "again")
    scratch.drop("parts")

    def explode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for b in batches(it, 500):
            ids, twins, starts, raws = [], [], [], []
            for i, twin, at, n, raw in zip(*(b.column(c).to_pylist() for c in ("id", "twin", "at", "n", "bytes")), strict=True):
                ids += [i] * n
                twins += [twin] * n
                starts += range(at, at + n)
                raws += [digest(raw[j : j + length]) for j in range(n)]
            h = np.frombuffer(b"".join(raws), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(ids, pa.int64()), pa.array(twins, pa.int64()), pa.array(starts, pa.int32())], names=["w1", "w2", "id", "twin", "at"])

    many = scratch.write(again.where(F.col("k") > LARGE).mapInArrow(explode, "w1 long, w2 long, id long, twin long, at int"), "windows")
    lead = scratch.write(many.groupBy("w1", "w2").agg(F.min(F.struct("id", "twin", "at")).alias("first"), F.count("*").alias("c")).where("c > 1"), "lead")
    counted = many.join(lead, ["w1", "w2"]).where(~F.struct("id", "twin", "at").eqNullSafe(F.col("first"))).select("id", "twin", "at", F.lit(1).alias("n"))
    return found.unionAll(sorted_repeats(again.where(F.col("k") <= LARGE), "core")).unionAll(counted)


def covered(ranges: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes under windows that start in the ranges (first start, windows)."""
    out: list[list[int]] = []
    for at, n in sorted(ranges):
        end = at + n - 1 + length
        if out and at <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([at, end])
    return [(a, b) for a, b in out]


def dedup(spark: SparkSession, docs: DataFrame, length: int = 100, key: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """(key, n_bytes, removed array<struct<start, end>>, kept_sha256[, kept binary]) of every row."""
    scratch = Scratch(spark, "substrings")
    rows = tagged(docs, key, text, scratch)
    found = repeats(spark, rows, scratch, length)
    by_text = found.groupBy("id", "twin").agg(F.collect_set(F.struct("at", "n")).alias("ranges"))  # at most a document's runs

    def clean(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 200):
            ids, sizes, removed, shas, kept = [], [], [], [], []
            for i, t, r in zip(b.column(0).to_pylist(), encoded(b.column(1)), b.column(2).to_pylist(), strict=True):
                gone = covered([(x["at"], x["n"]) for x in r or ()], length)
                parts, at = [], 0
                for x, y in gone:
                    parts.append(t[at:x])
                    at = y
                left = b"".join([*parts, t[at:]])
                ids.append(None if i == NO_ID else i)
                sizes.append(len(t))
                removed.append([{"start": x, "end": y} for x, y in gone])
                shas.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(removed, kind), pa.array(shas, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * keep, names=[key, "n_bytes", "removed", "kept_sha256"] + ["kept"] * keep)

    joined = rows.join(by_text, ["id", "twin"], "left").select("id", "text", "ranges")
    return joined.mapInArrow(clean, f"{key} long, n_bytes long, removed array<struct<start: long, end: long>>, kept_sha256 string" + ", kept binary" * keep)


def brute_force(texts: dict[int, bytes], length: int) -> dict[int, list[tuple[int, int]]]:
    """Removed runs by a dictionary of all windows; for tests."""
    first: set[bytes] = set()
    out = {}
    for i in sorted(texts):
        t, hits = texts[i], []
        for at in range(len(t) - length + 1):
            w = t[at : at + length]
            if w in first:
                hits.append((at, 1))
            first.add(w)
        out[i] = covered(hits, length)
    return out
