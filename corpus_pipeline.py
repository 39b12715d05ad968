"""A corpus, cleaned in five stages; each is a function of (spark, docs, sf_dir).

A stage's result is written as Parquet and read again as the next one's documents. All but the last
return the columns of ``documents``.

1. ``quality``: documents that the line CRF rejects (score under 0.3) go.
2. ``near_dedup``: one document, that of the smallest id, stays of each group of documents whose
   texts have a Jaccard similarity of 5-word shingles of 0.8 or more; candidates are SimHash links
   within 6 of 64 bits, of fingerprints of the texts' different words.
3. ``decontamination``: documents with a window that matches a benchmark item go.
4. ``secrets``: secrets are replaced by their kind; n_chars follows. No document goes.
5. ``sentencepiece``: ids of every text, counted and checksummed, with the round trip's result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from forkline.llm import decontamination, quality, secrets, sentencepiece_tok, simhash
from forkline.llm.common import Scratch, table

RADIUS = 6
SIMILARITY = 0.8


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(spark, docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(spark, docs, radius=RADIUS, similarity=SIMILARITY)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(spark, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_tok.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("secrets", redact_secrets),
    ("sentencepiece", encode),
]

#: The classifier and the codec can't be put in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
