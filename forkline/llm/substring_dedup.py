"""Substring dedup over sliding sentence spans.

A text is cut into sentences (after ``.``, ``!``, ``?`` and their closing marks before white
space, and at line ends). Every run of at least ``min_sentences`` sentences with at least
``min_words`` words counts: the first place of a run (smallest id, then position) keeps it, and every
sentence covered by any later place is removed. So does a single sentence of at least ``LONG_WORDS``
words; a text that holds none of these counts as a whole, against other whole texts. Only the
shortest run from each start and the shortest to each end are spans, with 128-bit hashes of their
words: they cover the same sentences as all runs do (see ``spans``), with at most two a sentence.

Only hashes and places are shuffled for the search: a grouped minimum with partial aggregation
finds the repeated spans, and a join that adaptive execution can split finds their places, so a
passage that a third of all documents share is no task's burden. The texts meet the sentences to
remove once, by document.

Cases: a null or empty text has no sentence and stays as it is, as does one without words; repeated
rows with one id keep what the first place keeps, as their places are equal (no row is taken for a
copy of itself); different texts under one id are different documents, in the order of the texts'
hashes; a null id counts as the smallest id; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forkline.llm.common import NO_ID, Scratch, batches, strings, tagged

#: Words that make a single sentence a span.
LONG_WORDS = 50
_END = re.compile(r"(?:[.!?…。！？]+[\"'”’)\]]*(?=\s)|\n)\s*")


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence; together they are the text without loss."""
    out, at = [], 0
    for m in _END.finditer(text):
        if m.end() > at:
            out.append((at, m.end()))
            at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


def spans(text: str, min_sentences: int, min_words: int, long_words: int = LONG_WORDS) -> list[tuple[int, int, bytes]]:
    """(first sentence, number of sentences, hash) of the runs that stand for every run.

    They are the shortest run from each start and the shortest run to each end. Each sentence of a
    longer run lies in one of these within it: where the run from the sentence on is too short, the
    shortest one to the run's end begins before it. A sentence of ``long_words`` is a span of its own,
    and a text without any is one as a whole, which equals no part of a text.
    """
    words = [text[a:b].split() for a, b in sentences(text)]
    counts = np.array([len(w) for w in words], dtype=np.int64)
    before = np.concatenate([[0], np.cumsum(counts)])
    flat = [" ".join(w) for w in words]
    at, n = np.arange(len(words)), len(words)
    ends = np.maximum(np.searchsorted(before, before[:-1] + min_words, side="left"), at + min_sentences)
    starts = np.minimum(np.searchsorted(before, before[1:] - min_words, side="right") - 1, at + 1 - min_sentences)
    runs = {(i, e) for i, e in enumerate(ends.tolist()) if e <= n} | {(i, e) for e, i in enumerate(starts.tolist(), 1) if i >= 0}
    runs |= {(i, i + 1) for i in np.flatnonzero(counts >= long_words).tolist()}
    out = [(i, e - i, xxhash.xxh3_128_digest("\n".join(flat[i:e]))) for i, e in sorted(runs) if words[i]]
    if not out and before[-1]:
        out.append((0, n, xxhash.xxh3_128_digest("\n" + "\n".join(flat))))  # no run begins with a line end
    return out


def find_spans(rows: DataFrame, min_sentences: int, min_words: int) -> DataFrame:
    """(h1, h2, id, twin, at, n): every span of every document; ``rows`` has id, twin and text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 200):
            row, at, n, raw = [], [], [], []
            for k, x in enumerate(strings(b.column(2))):
                for a, m, h in spans(x, min_sentences, min_words):
                    row.append(k)
                    at.append(a)
                    n.append(m)
                    raw.append(h)
            h, of = np.frombuffer(b"".join(raw), dtype="<i8").reshape(-1, 2), pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), b.column(0).take(of), b.column(1).take(of), pa.array(at, pa.int32()), pa.array(n, pa.int32())], names=["h1", "h2", "id", "twin", "at", "n"])

    return rows.mapInArrow(run, "h1 long, h2 long, id long, twin long, at int, n int")


def covered(rows: DataFrame, scratch: Scratch, min_sentences: int = 2, min_words: int = 20) -> DataFrame:
    """(id, twin, runs): for each document with removals, its runs (at, n) of sentences at non-first places."""
    found = scratch.write(find_spans(rows, min_sentences, min_words), "found")
    place = F.struct("id", "twin", "at")
    first = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("places")).where("places > 1")
    # written, so that both sides of the join come from plain exchanges, which can be split where a span is frequent
    first = scratch.write(first.select("h1", "h2", "first"), "first")
    later = found.join(first, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    return later.select("id", "twin", F.struct("at", "n").alias("run")).groupBy("id", "twin").agg(F.array_sort(F.collect_set("run")).alias("runs"))  # at most a text's sentences


def dedup(spark: SparkSession, docs: DataFrame, min_sentences: int = 2, min_words: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_sentences, removed array<int>, kept string): the texts without repeated sentences."""
    scratch = Scratch(spark, "spans")
    rows = tagged(docs, key, text, scratch)
    runs = covered(rows, scratch, min_sentences, min_words)

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 200):
            counts, removed, kept = [], [], []
            for x, rs in zip(strings(b.column(1)), b.column(2).to_pylist(), strict=True):
                parts = sentences(x)
                gone = {i for r in rs or () for i in range(r["at"], r["at"] + r["n"])}
                counts.append(len(parts))
                removed.append(sorted(gone))
                kept.append("".join([x[a:e] for i, (a, e) in enumerate(parts) if i not in gone]) if gone else x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int32()), pa.array(removed, pa.list_(pa.int32())), pa.array(kept, pa.string())], names=[key, "n_sentences", "removed", "kept"])

    joined = rows.join(runs, ["id", "twin"], "left").select(F.nullif("id", F.lit(NO_ID)).alias(key), "text", "runs")
    return joined.mapInArrow(cut, f"{key} long, n_sentences int, removed array<int>, kept string")


def brute_force(texts: dict[int, str], min_sentences: int, min_words: int, long_words: int = LONG_WORDS) -> dict[int, str]:
    """What ``dedup`` keeps, from every run of every text, by plain dictionaries; for tests."""
    runs: dict[tuple[int, str], int] = {}  # (number of the run without its last sentence, that sentence)
    first: dict[int | str, tuple[int, int]] = {}
    gone: dict[int, set[int]] = {i: set() for i in texts}
    for i in sorted(texts):
        words = [texts[i][a:b].split() for a, b in sentences(texts[i])]
        found = False
        for at in range(len(words)):
            run = n_words = 0
            for end in range(at + 1, len(words) + 1):
                run = runs.setdefault((run, repr(words[end - 1])), len(runs) + 1)
                n_words += len(words[end - 1])
                if words[at] and (n_words >= long_words if end - at == 1 else end - at >= min_sentences and n_words >= min_words):
                    found = True
                    where = first.setdefault(run, (i, at))
                    if where != (i, at):
                        gone[i].update(range(at, end))
        if not found and any(words) and first.setdefault(repr(words), (i, 0)) != (i, 0):
            gone[i].update(range(len(words)))
    return {i: "".join(x[a:b] for n, (a, b) in enumerate(sentences(x)) if n not in gone[i]) for i, x in texts.items()}


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
