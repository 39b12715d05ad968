"""SentencePiece encoding and decoding with the tokenizers library as the backend.

The model file (a protobuf) is read here, without the sentencepiece library: pieces with scores
and kinds, the trainer's model kind and byte fallback, the normaliser's compiled character map and
its white-space switches. From these a ``tokenizers.Tokenizer`` is rebuilt: the normaliser, the
metaspace marker U+2581, unigram scores (or, for a BPE model, the merges in the order of the
scores of their results) and byte fallback; and its decoder.

Every text is normalised and encoded whole by that tokenizer, in multithreaded batches, and compared
with the ids that the sentencepiece library gives the same raw whole text (``parity``). No text is cut,
and none is left uncompared. All ids of every text are decoded again.

Cases: null and empty texts have no ids and decode to the empty text; control pieces in a text
are ordinary characters; very long texts are encoded whole, in batches of their own; repeated rows
give repeated results; an empty table gives an empty result; other columns are kept by ``encode``
and never read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forkline.llm.common import batches, strings

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Characters that are encoded at once; a longer text goes alone.
CHARACTERS = 1_000_000
#: Pieces that the decoder takes for a byte.
_FALLBACK = re.compile("<0x[+0-9A-Fa-f][0-9A-Fa-f]>")


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: varints as int, the rest as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = raw[at]
            at += 1
            out |= (byte & 127) << shift
            if byte < 128:
                return out
            shift += 7

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(kind)
        n = varint() if kind == 2 else n
        if n is None:
            raise ValueError(f"not a SentencePiece model: wire type {kind}")
        yield tag >> 3, raw[at : at + n]
        at += n


@dataclass
class Model:
    """What a SentencePiece model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    collapse_spaces: bool = True
    escape_spaces: bool = True

    @property
    def unk(self) -> int:
        return next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)


def parse_model(path: str) -> Model:
    m = Model()
    with open(path, "rb") as f:
        raw = f.read()
    for number, value in _fields(raw):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    m.kind = v
                elif n == 35:
                    m.byte_fallback = bool(v)
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    m.charsmap = v
                elif n == 3:
                    m.dummy_prefix = bool(v)
                elif n == 4:
                    m.collapse_spaces = bool(v)
                elif n == 5:
                    m.escape_spaces = bool(v)
    return m


def normaliser(m: Model):
    """The model's normaliser for the tokenizers library: character map, white space, marker."""
    from tokenizers import Regex, normalizers

    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.collapse_spaces:
        steps += [normalizers.Replace(Regex(r"\A +| +\z"), ""), normalizers.Replace(Regex(" +"), " ")]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if m.escape_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    return normalizers.Sequence(steps)


def build(m: Model):
    """The tokenizers-library twin of a model, for texts that ``normaliser`` has been over."""
    from tokenizers import Tokenizer, decoders, models

    if m.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in m.pieces], unk_id=m.unk, byte_fallback=m.byte_fallback)
    elif m.kind == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        usable = {p for p, _, k in m.pieces if k in (NORMAL, USER, UNUSED)}
        merges = []
        for i, (p, s, k) in enumerate(m.pieces):
            if k == NORMAL and len(p) > 1:
                merges += [(-s, i, vocab[p[:c]], p[:c], p[c:]) for c in range(1, len(p)) if p[:c] in usable and p[c:] in usable]
        merges.sort()
        core = models.BPE(vocab=vocab, merges=[(a, b) for *_, a, b in merges], unk_token=m.pieces[m.unk][0], fuse_unk=True, byte_fallback=m.byte_fallback)
    else:
        raise ValueError(f"model kind {m.kind} has no twin")
    t = Tokenizer(core)
    steps = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    t.decoder = decoders.Sequence(steps + [decoders.Strip(" ", 1, 0)] * m.dummy_prefix)
    return t


def _portions(texts: list[str]) -> Iterator[list[str]]:
    """``texts`` in lists of at most ``CHARACTERS`` characters, so that memory follows the longest text."""
    out, n = [], 0
    for x in texts:
        if out and n + len(x) > CHARACTERS:
            yield out
            out, n = [], 0
        out.append(x)
        n += len(x)
    if out:
        yield out


class Codec:
    """Encodes and decodes whole texts with the rebuilt tokenizer; ``checked`` compares each with the library."""

    def __init__(self, path: str, checked: bool = True, threads: int = 2):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.model, self.threads = parse_model(path), threads
        self.twin = build(self.model)
        self.library = None
        if checked:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        from tokenizers import normalizers

        self.charsmap = normalizers.Precompiled(self.model.charsmap) if self.model.charsmap else None
        self.bytes = np.array([k == BYTE for _, _, k in self.model.pieces])
        pieces = [self.twin.id_to_token(i) or "" for i in range(len(self.model.pieces))]
        self.table = [bytes([int(p[3:5], 16)]) if _FALLBACK.fullmatch(p) else p.replace(MARK, " ").encode() for p in pieces]

    def normalise(self, text: str) -> str:
        """What ``normaliser`` makes of a text, without its bookkeeping of places."""
        m = self.model
        if self.charsmap:
            text = self.charsmap.normalize_str(text)
        if m.collapse_spaces:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        if m.dummy_prefix:
            text = " " + text
        return text.replace(" ", MARK) if m.escape_spaces else text

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """Ids of each raw whole text, and whether they are the library's."""
        ids, same = [], []
        for some in _portions(texts):
            got = [e.ids for e in self.twin.encode_batch_fast([self.normalise(x) for x in some], add_special_tokens=False)]
            same += [a == b for a, b in zip(self.theirs(some), got, strict=True)] if self.library else [True] * len(some)
            ids += [np.array(i, dtype="<u4") for i in got]
        return ids, same

    def theirs(self, texts: list[str]) -> list[list[int]]:
        """The library's ids of raw whole texts."""
        return self.library.encode(texts, num_threads=self.threads)

    def agrees(self, texts: list[str], ids: list[np.ndarray]) -> list[bool]:
        """Whether raw whole texts have these ids by the library."""
        return [a == i.tolist() for a, i in zip(self.theirs(texts), ids, strict=True)]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """Texts of ids, as the rebuilt tokenizer's decoder gives them.

        The bytes of all pieces are joined. Pieces begin and end at whole characters, so where the bytes
        are UTF-8 every run of byte pieces is too, and the decoder joins them alike; other texts, whose
        bytes it replaces, and ids of no piece go through it.
        """
        out, piece, skip = [], self.table.__getitem__, self.model.dummy_prefix
        for i in (i.tolist() for i in ids):
            try:
                text = b"".join(map(piece, i)).decode()
            except (UnicodeDecodeError, IndexError):
                out.append(self.twin.decode(i, skip_special_tokens=False))
            else:
                out.append(text[1:] if skip and text[:1] == " " else text)
        return out


_codecs: dict[tuple, Codec] = {}


def codec(path: str, checked: bool = True, threads: int = 2) -> Codec:
    """The codec of this worker."""
    key = (path, checked, threads)
    if key not in _codecs:
        _codecs[key] = Codec(*key)
    return _codecs[key]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", checked: bool = True, threads: int = 2) -> DataFrame:
    """(key, ids array<int>, parity boolean): the ids of every whole text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, checked, threads)
        for b in batches(it, 200):
            ids, same = c.encode(strings(b.column(1)))
            offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(same, type=pa.bool_())], names=[key, "ids", "parity"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>, parity boolean")


def decode(encoded: DataFrame, path: str, key: str = "doc_id", threads: int = 2) -> DataFrame:
    """(key, text): texts decoded from ``ids``; equal to the normalised texts where nothing is unknown."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, False, threads)
        for b in batches(it, 200):
            ids = [np.array(x or [], dtype=np.int32) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c.decode(ids))], names=[key, "text"])

    kind = dict(encoded.dtypes)[key]
    return encoded.select(key, "ids").mapInArrow(run, f"{key} {kind}, text string")


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", threads: int = 2) -> DataFrame:
    """One row a document: ids counted and checksummed, decoded again in the same pass.

    n_tokens; n_byte_tokens (ids of byte pieces); ids_crc32 (little-endian unsigned 32-bit);
    parity (the sentencepiece library gives the raw whole text the same ids; every row is compared);
    n_decoded (code points decoded); round_trip (the decoded text is the normalised one).
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, True, threads)
        for b in batches(it, 200):
            texts = strings(b.column(1))
            ids, same = c.encode(texts)
            back = c.decode(ids)
            plain = [c.normalise(x).replace(MARK, " ") for x in texts]
            plain = [x[1:] if c.model.dummy_prefix else x for x in plain]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(i) for i in ids]), pa.array([int(c.bytes[i].sum()) for i in ids]), pa.array([zlib.crc32(i.tobytes()) for i in ids], type=pa.int64()), pa.array(same, type=pa.bool_()), pa.array([len(x) for x in back]), pa.array([x == y for x, y in zip(back, plain, strict=True)], type=pa.bool_())],
                names=[key, "n_tokens", "n_byte_tokens", "ids_crc32", "parity", "n_decoded", "round_trip"],
            )

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, n_tokens long, n_byte_tokens long, ids_crc32 long, parity boolean, n_decoded long, round_trip boolean")
