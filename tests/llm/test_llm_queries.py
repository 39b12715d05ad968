"""Every registered query of the operators on the smallest tables, against plain Python or DuckDB."""

import hashlib
import os
import zlib

import numpy as np
import pytest

from forkline.llm import exact_substrings, queries, substring_dedup
from tests.llm.test_operators import base_spans, grouped, plain_fingerprint, plain_matches, plain_scan

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


def result(spark, name):
    return {r[0]: r for r in getattr(queries, name)(spark, DATA).collect()}


def test_op1(spark, texts):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    few = {i: texts[i] for i in sorted(texts, key=lambda i: len(texts[i]))[:120]}  # the plain version takes every window of every item
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in queries.op1_decontamination(spark, DATA).collect()}
    want = plain_matches(few, items)
    assert {k: v for k, v in got.items() if k[0] in few} == pytest.approx(want, abs=1e-6) and len(got) >= len(want)


def test_op2(spark, texts):
    got = result(spark, "op2_sharding")
    assert got.keys() == texts.keys() and {r["law"] for r in got.values()} == {"rows"}
    counts = np.bincount([r["shard"] for r in got.values()], minlength=24)
    assert len(counts) == 24 and counts.max() - counts.min() <= 1
    for s in range(24):
        assert sorted(r["slot"] for r in got.values() if r["shard"] == s) == list(range(counts[s]))
    for i, x in texts.items():
        raw = x.encode()
        assert (got[i]["size"], got[i]["text_crc32"], got[i]["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), None)


def test_op3(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t, at, got = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, result(spark, "op3_token_files")
    for i in sorted(texts):
        ids = [*t.encode(texts[i], add_special_tokens=False).ids, 1]
        assert tuple(got[i]) == (i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)


def test_op4(spark, texts):
    import public_tokenizers
    import sentencepiece

    sp, got = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), result(spark, "op4_sentencepiece")
    for i, x in texts.items():
        ids = sp.encode(x)
        assert (got[i]["n_tokens"], got[i]["ids_crc32"], got[i]["parity"], got[i]["round_trip"]) == (len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()), True, True)


def test_op5(spark, texts):
    got, want = result(spark, "op5_suffix_array_dedup"), exact_substrings.brute_force({i: x.encode() for i, x in texts.items()}, 100)
    for i, x in texts.items():
        raw, at, kept = x.encode(), 0, b""
        for a, b in want[i]:
            kept, at = kept + raw[at:a], b
        kept += raw[at:]
        assert tuple(got[i]) == (i, len(raw), len(raw) - len(kept), len(want[i]), hashlib.sha256(kept).hexdigest())


def test_op6(spark, texts):
    got, want = result(spark, "op6_substring_dedup"), substring_dedup.brute_force(texts, 2, 20)
    assert {i: r["kept_sha256"] for i, r in got.items()} == {i: hashlib.sha256(x.encode()).hexdigest() for i, x in want.items()}


def test_op7(spark, texts):
    got, order = result(spark, "op7_secret_scan"), sorted(texts)
    for i, spans in zip(order, plain_scan([texts[i] for i in order]), strict=True):
        base = base_spans(texts[i])
        kinds = [s.split(":")[0] for s in base.split(",")]
        assert tuple(got[i]) == (i, kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(base.encode()).hexdigest(), spans)


def test_op8(spark, texts):
    got = result(spark, "op8_quality")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 5 == 0}
    assert {i for i, r in got.items() if r["held_out"]} == held and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    seen = [labels[i] == got[i]["predicted"] for i in held & labels.keys()]
    assert sum(seen) >= 0.8 * len(seen)


def test_op9(spark, texts):
    prints, got = {i: plain_fingerprint(x) for i, x in texts.items()}, result(spark, "op9_simhash_near_dedup")
    comp = grouped(texts, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert {i: tuple(r) for i, r in got.items()} == {i: (i, f"{prints[i]:016x}", comp[i]) for i in texts}


def test_op10(spark):
    import duckdb

    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    want = duckdb.sql(queries.ORACLE_SQL["op10_embedding_near_dedup"])
    got = queries.op10_embedding_near_dedup(spark, DATA)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall())
