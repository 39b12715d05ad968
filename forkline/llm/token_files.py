"""Token ids as flat unsigned integer files with 64-bit document offsets.

Format, version 1, little-endian. A set is a folder of pairs of files and a manifest:

* ``<name>.bin``: the ids of the file's documents one after another, unsigned 16-bit where the
  vocabulary fits, else unsigned 32-bit; nothing else, so it can be memory-mapped.
* ``<name>.idx``: 8 bytes ``FKTOK001``; u64 item size; u64 number of documents n; n x i64
  document ids; n x u8 (1: the id is null); padding to 8 bytes; n + 1 x u64 offsets in ids.
* the manifest has a row for each file: name, documents, ids, and their sums over all files
  before it (``base_docs``, ``base_tokens``), so that every file knows its place in the whole.

Documents are in ascending id order over the whole set. Each text is encoded once, where it lies;
only ids are shuffled, to a range of document ids (bounds from quantiles of the id column alone).
A task writes under a name of its own, and the manifest lists only the files of tasks that
succeeded: a lost executor or a repeated task leaves at most an unlisted file. Files are written
and read through the file system of the folder's address; local ones are memory-mapped.

Cases: a null text is encoded as the empty one (just the end id); a null document id sorts first
and is read back as null; equal ids are ordered by their tokens; an empty table makes an empty
set; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forkline.llm.common import Remembered, batches, shared_dir

MAGIC = b"FKTOK001"
MANIFEST = "name string, part int, n_docs long, n_tokens long"
#: Distinct words a generation of an encoder's memory holds.
REMEMBERED = 400_000


class FileSet(NamedTuple):
    root: str
    item: int
    manifest: list[dict]

    @property
    def n_docs(self) -> int:
        return sum(m["n_docs"] for m in self.manifest)

    @property
    def n_tokens(self) -> int:
        return sum(m["n_tokens"] for m in self.manifest)


#: Letters, then ASCII marks. \w holds some numbers that are no digits, so letters are asked for again.
_MARKED = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]*)")
#: Small letters that NFC and lower-casing leave as they are.
_SMALL = re.compile("[a-zß-öø-ÿ]+")
_encoders: dict[str, tuple] = {}


def _tokenizer(path: str):
    """The tokenizer of this worker, its memory of words, its added tokens, which ids end a word,
    whether it lower-cases, and the same tokenizer for small letters and spaces alone: without the
    steps that leave these as they are (None where there may be other steps)."""
    if path not in _encoders:
        from tokenizers import Tokenizer, pre_tokenizers

        t, quick = Tokenizer.from_file(path), None
        special = [a.content for a in t.get_added_tokens_decoder().values()]
        suffix, ends = getattr(t.model, "end_of_word_suffix", None), None
        if suffix:
            ends = np.zeros(t.get_vocab_size(), dtype=bool)
            ends[[i for w, i in t.get_vocab().items() if w.endswith(suffix)]] = True
        small = "".join(c for c in map(chr, range(256)) if _SMALL.fullmatch(c)) + " a"
        with open(path, encoding="utf-8") as f:
            then = ((json.load(f).get("pre_tokenizer") or {}).get("pretokenizers") or [])[1:]
        if [x.get("type") for x in then] == ["ByteLevel"] and not then[0]["add_prefix_space"] and not then[0]["use_regex"] and (t.normalizer is None or t.normalizer.normalize_str(small) == small):
            quick = Tokenizer.from_file(path)
            quick.normalizer = None
            quick.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        _encoders[path] = (t, Remembered(REMEMBERED), special, ends, t.normalizer is not None and t.normalizer.normalize_str("A") == "a", quick)
    return _encoders[path]


def _any_of(texts: pa.Array, strings: list[str] | list[bytes]) -> pa.Array:
    """Whether a text holds one of ``strings``."""
    found = pa.array(np.zeros(len(texts), dtype=bool))
    for x in strings:
        found = pc.or_(found, pc.match_substring(texts, x))
    return found


def _folded(texts: pa.Array, special: list[str]) -> pa.Array:
    """``texts`` with A-Z in lower case, where that can't change their ids under a tokenizer that lower-cases.

    Left alone are texts with U+0300 to U+037F (lead bytes CC and CD), which may compose with the small
    letter only, and texts where an added token's string would come about.
    """
    low = pc.ascii_lower(texts)
    as_is = pc.or_(_any_of(texts.cast(pa.large_binary()), [b"\xcc", b"\xcd"]), _any_of(low, [x.lower() for x in special]))
    return pc.if_else(as_is, texts, low)


def _learn(words: list[str], t, memory: dict[str, bytes], ends: np.ndarray, item: str) -> list[str]:
    """Puts words of letters alone into ``memory``; returns those that are to be encoded by themselves.

    Such a word is one piece of the pre-tokenizer, which ends with a word-end token: many go as one
    text. A row with more word ends than words (a letter may be normalised to a letter and a mark) is
    given back.
    """
    again = []
    for at in range(0, len(words), 20_000):
        rows = [words[i : i + 500] for i in range(at, min(at + 20_000, len(words)), 500)]
        for row, e in zip(rows, t.encode_batch_fast([" ".join(r) for r in rows], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype=item)
            cuts = np.flatnonzero(ends[ids]) + 1
            if len(cuts) != len(row) or cuts[-1] != len(ids):
                again += row
                continue
            raw, to = ids.tobytes(), (cuts * ids.itemsize).tolist()
            for w, a, b in zip(row, [0, *to], to, strict=False):
                memory[w] = raw[a:b]
    return again


def encode_texts(path: str, texts: list[str] | pa.Array, item: str, split: bool) -> list[bytes]:
    """Ids of each text as packed bytes; a null text is the empty one.

    ``split``: the tokenizer drops white space and never joins across it, so a text's ids are
    those of its words (``split(' ')`` and line ends) in turn; each distinct word is encoded
    once, in lower case. Texts with an added token's string are encoded whole.
    """
    t, known, special, ends, lowers, quick = _tokenizer(path)
    pack = lambda ids: np.array(ids, dtype=item).tobytes()
    every = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).cast(pa.large_string()).fill_null("")
    if not split:
        return [pack(e.ids) for e in t.encode_batch_fast(every.to_pylist(), add_special_tokens=False)]
    whole = _any_of(every, special)
    column = pc.if_else(whole, "", every)
    words = pc.split_pattern(pc.replace_substring(_folded(column, special) if lowers else column, "\n", " "), " ")
    coded = words.values.dictionary_encode()
    distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    known.missing(())  # a new generation begins here or not before the next texts
    memory = known.new
    new = known.missing(distinct, turn=False)
    # a word with marks behind it gives the pieces of its letters, then those of the marks
    made = []
    if ends is not None:
        rest, letters = [], set()
        for w in new:
            if (m := _MARKED.fullmatch(w)) and m[1].isalpha():
                letters.add(m[1])
                if m[2]:
                    made.append((w, m[1], m[2]))
            else:
                rest.append(w)
        rest += known.missing({b for _, _, b in made}.difference(rest), turn=False)
        small, other = [], []
        for w in known.missing(letters, turn=False):
            (small if quick and _SMALL.fullmatch(w) else other).append(w)
        new = rest + _learn(small, quick, memory, ends, item) + _learn(other, t, memory, ends, item)
    for at in range(0, len(new), 20_000):
        piece = new[at : at + 20_000]
        for w, e in zip(piece, t.encode_batch_fast(piece, add_special_tokens=False), strict=True):
            memory[w] = pack(e.ids)
    for w, a, b in made:
        memory[w] = memory[a] + memory[b]
    ids = pa.array(list(map(memory.__getitem__, distinct)), pa.large_binary()).take(coded.indices)
    out = pc.binary_join(pa.ListArray.from_arrays(words.offsets, ids), pa.scalar(b"", pa.large_binary())).to_pylist()
    for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
        out[i] = pack(t.encode(every[i].as_py(), add_special_tokens=False).ids)
    return out


def splits_at_spaces(path: str) -> bool:
    """Whether the tokenizer removes white space before it merges (then words can be encoded apart)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    norm = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    return first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert")) and r"[^\s\p{L}\p{N}]+" in str((first.get("pattern") or {}).get("Regex")) and set(norm) <= {"NFC", "Replace", "Lowercase"}


def _bounds(docs: DataFrame, key: str, n: int) -> np.ndarray:
    """Upper bounds of ``n`` ranges of the id; reads that column alone."""
    row = docs.agg(F.percentile_approx(key, [i / n for i in range(1, n)] or [0.5], 20 * n).alias("q")).first()
    return np.unique(np.array(row["q"] or [], dtype=np.int64))


def write_files(spark: SparkSession, docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int, root: str | None = None, files: int | None = None, key: str = "doc_id", text: str = "text") -> FileSet:
    """Encodes ``docs``, appends ``end_id`` to each and writes the set; returns its manifest."""
    root = root or f"{shared_dir(spark)}/forkline/tokens-{uuid.uuid4().hex}"
    item = "<u2" if vocabulary <= 1 << 16 else "<u4"
    size, tail, split = int(item[2]), np.array([end_id], dtype=item).tobytes(), splits_at_spaces(tokenizer)
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    bounds = _bounds(docs, "id", files)

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 1000):
            ids = [x + tail for x in encode_texts(tokenizer, b.column(1), item, split)]
            keys = b.column(0)
            part = np.searchsorted(bounds, keys.fill_null(-(2**63)).to_numpy(zero_copy_only=False), side="left")
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), keys, pa.array(ids, type=pa.binary())], names=["part", "id", "ids"])

    def put(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pyarrow.fs.FileSystem.from_uri(root)
        fs.create_dir(folder, recursive=True)
        name, keys, lengths, parts, out = f"tokens-{uuid.uuid4().hex}", [], [], set(), None
        for b in it:
            if b.num_rows:
                out = out or fs.open_output_stream(f"{folder}/{name}.bin")
                parts.update(b.column(0).unique().to_pylist())
                keys.append(b.column(1))
                ids = b.column(2)
                lengths.append(np.array([len(x.as_buffer()) for x in ids], dtype=np.int64) // size)
                for x in ids:
                    out.write(x.as_buffer())
        if out:
            out.close()
            n = np.concatenate(lengths)
            key_array = pa.chunked_array(keys, type=pa.int64())
            null = key_array.is_null().to_numpy().astype(np.uint8)
            with fs.open_output_stream(f"{folder}/{name}.idx") as f:
                f.write(MAGIC + np.array([size, len(n)], dtype="<u8").tobytes())
                f.write(key_array.fill_null(0).to_numpy().astype("<i8").tobytes())
                f.write(null.tobytes() + b"\0" * (-len(n) % 8))
                f.write(np.concatenate([[0], np.cumsum(n)]).astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([min(parts)], type=pa.int32()), pa.array([len(n)]), pa.array([int(n.sum())])], names=["name", "part", "n_docs", "n_tokens"])

    encoded = docs.mapInArrow(encode, "part int, id long, ids binary")
    ranged = encoded.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", F.col("id").asc_nulls_first(), "ids")
    rows = sorted(ranged.mapInArrow(put, MANIFEST).collect(), key=lambda r: r["part"])  # a row for each file
    manifest, docs_before, tokens_before = [], 0, 0
    for r in rows:
        manifest.append(r.asDict() | {"base_docs": docs_before, "base_tokens": tokens_before})
        docs_before += r["n_docs"]
        tokens_before += r["n_tokens"]
    return FileSet(root, size, manifest)


def open_file(root: str, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, Callable[[int, int], np.ndarray]]:
    """(document ids, null flags, offsets, reader of ids from..to) of one file of a set."""
    fs, folder = pyarrow.fs.FileSystem.from_uri(root)
    with fs.open_input_stream(f"{folder}/{name}.idx") as f:
        raw = f.read()
    if raw[:8] != MAGIC:
        raise ValueError(f"{name}.idx is not an index of token files")
    size, n = (int(x) for x in np.frombuffer(raw, "<u8", 2, 8))
    keys = np.frombuffer(raw, "<i8", n, 24)
    null = np.frombuffer(raw, "u1", n, 24 + 8 * n)
    offsets = np.frombuffer(raw, "<u8", n + 1, 24 + 8 * n + n + -n % 8).astype(np.int64)
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        ids = np.memmap(f"{folder}/{name}.bin", dtype=f"<u{size}", mode="r")
        return keys, null, offsets, lambda a, b: ids[a:b]
    f = fs.open_input_file(f"{folder}/{name}.bin")

    def read(a: int, b: int) -> np.ndarray:
        f.seek(a * size)
        return np.frombuffer(f.read((b - a) * size), dtype=f"<u{size}")

    return keys, null, offsets, read


def read_files(spark: SparkSession, files: FileSet, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, read from the files of the set."""
    root = files.root
    schema = pa.schema([(key, pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def get(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                keys, null, offsets, read = open_file(root, name)
                for at in range(0, len(keys), 10_000):
                    to = min(at + 10_000, len(keys))
                    crc = [zlib.crc32(read(offsets[i], offsets[i + 1]).astype("<u4").tobytes()) for i in range(at, to)]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[at:to], mask=null[at:to].astype(bool)), pa.array(offsets[at:to] + base), pa.array(np.diff(offsets[at : to + 1])), pa.array(crc, type=pa.int64())], schema=schema)

    rows = spark.createDataFrame([(m["name"], m["base_tokens"]) for m in files.manifest], "name string, base long")
    return rows.repartition(max(1, len(files.manifest))).mapInArrow(get, f"{key} long, start long, n_tokens long, ids_crc32 long")
