"""Document quality by a linear-chain conditional random field over lines.

Every non-blank line is labelled good or bad. A line's potentials come from its own features and
from those of the lines before and after it (each feature cut into quantile bins, one weight per
bin, label and neighbour), the chain's from a 2 x 2 table of transitions. Forward-backward gives
each line's marginal; marginals weighted by line length add up to the document's share of good
text, and a logistic curve fitted on the training documents turns that into the score.

Labels exist for documents only, so in training each line carries its document's label. At most
``sample`` labelled documents (those of the least id hash) are used for fitting, and only rows whose
``crc32(id) mod 5`` is not 0. Their features are computed where the texts lie; the driver gets
feature rows, not texts. Labels, language, source and id are no inputs of a score.

Cases: null and empty texts (and blank ones) have no line and get the training share of good
among such texts, smoothed towards the overall share; with no labelled row or one class only every
score is that overall share (0.5 without labels); very long texts are scored whole; repeated rows
are scored alike; a repeated label row counts once; null labels are left out; an empty table gives
an empty result; further columns are ignored, and kept by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forkline.llm.common import batches, strings

BINS = 12
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGIT = bytes(range(48, 58))
HIGH = bytes(range(128, 256))
STOPS = b".,;:'()\"-"
SPACE = b" \t\r\x0b\x0c"
LETTERS = UPPER + LOWER + HIGH
FEATURES = ("length", "upper", "digit", "stops", "symbol", "bang", "word length", "distinct", "stutter", "marked words", "short words", "top word", "ending", "start")


def line_features(line: str) -> tuple[list[float], int]:
    """The features of a line and its length in bytes."""
    raw = line.encode()
    n = len(raw)
    count = lambda chars: n - len(raw.translate(None, chars))
    words = raw.split()
    m = len(words)
    upper, lower, digit, high = count(UPPER), count(LOWER), count(DIGIT), count(HIGH)
    stops, space = count(STOPS), count(SPACE)
    symbol = n - upper - lower - digit - high - stops - space
    freq: dict[bytes, int] = {}
    for w in words:
        freq[w] = freq.get(w, 0) + 1
    letters = max(1, upper + lower + high)
    marked = sum([w[-1:] not in LETTERS and w[-1:] not in STOPS for w in words])
    stutter = sum([a == b for a, b in zip(words, words[1:], strict=False)])
    short = sum([len(w) <= 3 for w in words])
    return [np.log1p(n), upper / letters, digit / n, stops / n, symbol / n, count(b"!") / n, letters / m, len(freq) / m, stutter / m, marked / m, short / m, max(freq.values()) / m, float(raw[-1:] in b".!?:"), float(raw[:1] in UPPER)], n


def text_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(lines x features, lengths) of the non-blank lines."""
    got = [line_features(x) for x in text.split("\n") if x.strip(" \t\r\x0b\x0c") and x.split()]
    if not got:
        return np.zeros((0, len(FEATURES)), dtype=np.float32), np.zeros(0)
    return np.array([g[0] for g in got], dtype=np.float32), np.array([g[1] for g in got], dtype=np.float64)


def _pad(lengths: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of sequences of like length: (indices, (sequence, step) -> line or -1)."""
    first = np.concatenate([[0], np.cumsum(lengths)])
    order = np.argsort(lengths, kind="stable")
    order = order[np.array(lengths)[order] > 0] if len(lengths) else order
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and lengths[order[to]] <= 1.3 * lengths[order[at]] + 2 and to - at < 4096:
            to += 1
        own = order[at:to]
        steps = max(lengths[i] for i in own)
        grid = first[own][:, None] + np.arange(steps)[None, :]
        yield own, np.where(np.arange(steps)[None, :] < np.array(lengths)[own][:, None], grid, -1)
        at = to


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def marginals(emission: np.ndarray, transition: np.ndarray, lengths: list[int], weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(P(label) of every line, pair marginals 2 x 2 summed with each sequence's ``weight``) by forward-backward."""
    out, pairs = np.zeros_like(emission), np.zeros((2, 2))
    for own, grid in _pad(lengths):
        live = grid >= 0
        e = np.where(live[:, :, None], emission[grid], 0.0)
        n, steps = grid.shape
        alpha, beta = np.zeros((n, steps, 2)), np.zeros((n, steps, 2))
        alpha[:, 0] = e[:, 0]
        for t in range(1, steps):
            new = _lse(alpha[:, t - 1, :, None] + transition[None], 1) + e[:, t]
            alpha[:, t] = np.where(live[:, t, None], new, alpha[:, t - 1])
        for t in range(steps - 2, -1, -1):
            new = _lse(transition[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(live[:, t + 1, None], new, 0.0)
        z = _lse(alpha[:, -1], 1)
        p = np.exp(alpha + beta - z[:, None, None])
        out[grid[live]] = p[live]
        for t in range(1, steps) if weight is not None else ():
            joint = np.exp(alpha[:, t - 1, :, None] + transition[None] + (e[:, t] + beta[:, t])[:, None, :] - z[:, None, None])
            pairs += np.einsum("n,nij->ij", weight[own] * live[:, t], joint)
    return out, pairs


@dataclass
class Field:
    """A fitted field; small, sent with each task."""

    cuts: np.ndarray  # features x (bins - 1)
    weight: np.ndarray  # neighbour (own, before, after) x features x (bins + 1) x 2; the last bin: no such line
    transition: np.ndarray
    curve: tuple[float, float]
    blank: float
    constant: float | None = None

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(self.cuts)], axis=1) if len(x) else np.zeros((0, len(self.cuts)), dtype=np.int64)

    def share(self, features: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
        """Length-weighted share of good text per document; nan without lines."""
        lengths = [len(f) for f in features]
        bins = neighbours(self.bins(np.concatenate(features)) if features else np.zeros((0, len(self.cuts)), dtype=np.int64), lengths)
        p, _ = marginals(emissions(self.weight, bins), self.transition, lengths)
        out, at = np.full(len(features), np.nan), 0
        for i, (n, w) in enumerate(zip(lengths, weights, strict=True)):
            if n:
                out[i] = float((p[at : at + n, 1] * w).sum() / w.sum())
            at += n
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        got = [text_features(x) for x in texts]
        share = self.share([g[0] for g in got], [g[1] for g in got])
        a, b = self.curve
        return np.where(np.isnan(share), self.blank, 1 / (1 + np.exp(-(a * _logit(share) + b))))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def neighbours(bins: np.ndarray, lengths: list[int]) -> np.ndarray:
    """3 x lines x features: bins of the line, the line before and the line after (BINS: none)."""
    before, after = np.full_like(bins, BINS), np.full_like(bins, BINS)
    if len(bins):
        before[1:], after[:-1] = bins[:-1], bins[1:]
        first = np.concatenate([[0], np.cumsum(lengths)])
        starts = np.array([first[i] for i, n in enumerate(lengths) if n], dtype=np.int64)
        ends = np.array([first[i + 1] - 1 for i, n in enumerate(lengths) if n], dtype=np.int64)
        before[starts], after[ends] = BINS, BINS
    return np.stack([bins, before, after])


def emissions(weight: np.ndarray, bins: np.ndarray) -> np.ndarray:
    out = np.zeros((bins.shape[1], 2))
    for k in range(3):
        for f in range(bins.shape[2]):
            out += weight[k, f][bins[k, :, f]]
    return out


def fit(features: list[np.ndarray], weights: list[np.ndarray], labels: np.ndarray, rounds: int = 80, l2: float = 1e-3) -> Field:
    """Maximum penalised likelihood by Adam on all sequences."""
    n_features = len(FEATURES)
    base = float(labels.mean()) if len(labels) else 0.5
    has = np.array([len(f) > 0 for f in features], dtype=bool)
    blank = (labels[~has].sum() + 2 * base) / ((~has).sum() + 2) if len(labels) else base
    empty = Field(np.zeros((n_features, 0)), np.zeros((3, n_features, BINS + 1, 2)), np.zeros((2, 2)), (1.0, 0.0), float(blank))
    if not has.any() or labels.min() == labels.max():
        empty.constant = base
        return empty
    flat = np.concatenate(features)
    cuts = np.quantile(flat, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    field = Field(np.ascontiguousarray(cuts), empty.weight, empty.transition, (1.0, 0.0), float(blank))
    lengths = [len(f) for f in features]
    bins = neighbours(field.bins(flat), lengths)
    y = np.repeat(labels, lengths)
    # both labels weigh alike in the likelihood; the curve restores the base rate
    per_text = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())) / np.maximum(1, lengths)
    balance = np.repeat(per_text, lengths)
    target = np.eye(2)[y]
    seen = np.diag([float((per_text * (np.maximum(1, lengths) - 1))[labels == c].sum()) for c in (0, 1)])
    params, moment, square = [field.weight, field.transition], [0.0, 0.0], [0.0, 0.0]
    for r in range(1, rounds + 1):
        p, pairs = marginals(emissions(field.weight, bins), field.transition, lengths, per_text)
        slope = (target - p) * balance[:, None] / len(features)
        grad_w = np.zeros_like(field.weight)
        for k in range(3):
            for f in range(n_features):
                for c in range(2):
                    grad_w[k, f, :, c] = np.bincount(bins[k, :, f], slope[:, c], BINS + 1)
        grads = [grad_w - l2 * field.weight, (seen - pairs) / len(features) - l2 * field.transition]
        for i, (value, g) in enumerate(zip(params, grads, strict=True)):
            moment[i] = 0.9 * moment[i] + 0.1 * g
            square[i] = 0.99 * square[i] + 0.01 * g * g
            value += 0.1 * (moment[i] / (1 - 0.9**r)) / (np.sqrt(square[i] / (1 - 0.99**r)) + 1e-8)
    field.curve = _curve(_logit(field.share([f for f, h in zip(features, has, strict=True) if h], [w for w, h in zip(weights, has, strict=True) if h])), labels[has])
    return field


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of one variable by Newton steps, slightly shrunk."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        w, g = p * (1 - p) + 1e-9, y - p
        h = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(h, np.array([(g * x).sum() - 1e-2 * a, g.sum() - 1e-2 * b]))
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        a, b = a + step[0], b + step[1]
    return float(a), float(b)


def learn(docs: DataFrame, labels: DataFrame, sample: int = 4000, key: str = "doc_id", text: str = "text", label: str = "quality") -> Field:
    """Fits the field on at most ``sample`` labelled documents outside the held-out fifth."""
    usable = labels.where(F.col(label).isin(0, 1) & (F.crc32(F.col(key).cast("string").cast("binary")) % 5 != 0))
    chosen = usable.groupBy(key).agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64(key), key).limit(sample)
    rows = docs.select(key, text).join(F.broadcast(chosen), key)  # at most ``sample`` rows

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 200):
            got = [text_features(x) for x in strings(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(2), pa.array([g[0].tobytes() for g in got]), pa.array([g[1].tobytes() for g in got])], names=["id", "y", "x", "w"])

    found = sorted(rows.select(key, text, "y").mapInArrow(run, "id long, y int, x binary, w binary").collect(), key=lambda r: (r["id"], r["x"]))
    features = [np.frombuffer(r["x"], dtype=np.float32).reshape(-1, len(FEATURES)) for r in found]
    return fit(features, [np.frombuffer(r["w"]) for r in found], np.array([r["y"] for r in found], dtype=np.int64))


def score(docs: DataFrame, field: Field, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text as column ``name``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 200):
            at = b.schema.get_field_index(text)
            yield b.append_column(name, pa.array(field.score(strings(b.column(at)))))

    from pyspark.sql import types as T

    docs = docs.drop(name)
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold."""
    name = "__score"
    return score(docs, learn(docs, labels), name=name).where(F.col(name) >= threshold).drop(name)
