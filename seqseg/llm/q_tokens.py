"""Queries of the token encoders."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqseg.llm import speculative
from seqseg.llm.bpe import encode

RANKS = "byte_bpe_multi_50k.tiktoken"
VOCABULARY = "byte_bpe_50k.json"


def token_digests(docs: DataFrame) -> DataFrame:
    return _digests(encode(docs, public_tokenizers.path(RANKS), decoded=True))


def _digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return _digests(speculative.encode(docs, public_tokenizers.path(VOCABULARY), decoded=True))


QUERIES = {"op10_byte_bpe": op10_byte_bpe, "op11_bpe": op11_bpe}
ORACLES: dict[str, str] = {}
