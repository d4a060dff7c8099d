"""Corpus preparation: rules, near copies, benchmark passages, personal data, token ids.

Every stage is a function of (session, documents, data folder) and returns a DataFrame; all
but the last return the columns of ``documents``. ``run`` applies them in order, writing
each result to the folder named in ``spark.checkpoint.dir`` before the next stage reads it.

Null texts fail the rules; rows with a null id pass the near-copy stage (nothing can be said
about their group); empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqseg.llm.components import components
from seqseg.llm.decontaminate import contamination, find_passages
from seqseg.llm.pii import mask_pii
from seqseg.llm.q_tokens import token_digests
from seqseg.llm.quality_rules import quality_rules
from seqseg.llm.similar import similar_links
from seqseg.session import settle, ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near copies share this many words in a shingle and this part (in percent) of their shingles.
SHINGLE, SIMILAR = 5, 80


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the quality rules keep."""
    return quality_rules(docs, keep=COLUMNS).where("kept").select(*COLUMNS)


def copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of every group of near copies."""
    ship(spark)
    source = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text").where("id IS NOT NULL AND text IS NOT NULL")
    grouped = components(similar_links(source, SHINGLE, SIMILAR))
    dropped = grouped.where("node <> component").select(F.col("node").alias("doc_id"))
    return docs.select(*COLUMNS).join(dropped, "doc_id", "left_anti")


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that carry benchmark passages."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = contamination(find_passages(docs, benchmark)).where("contaminated").select("doc_id")
    return docs.select(*COLUMNS).join(hit, "doc_id", "left_anti")


def personal_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by marks; ``n_chars`` follows the new text."""
    masked = mask_pii(docs.select(*COLUMNS))
    return masked.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to."""
    return token_digests(docs)


STAGES = [
    ("quality_rules", rules_stage),
    ("ngram_jaccard_join", copies_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("pii", personal_stage),
    ("byte_bpe", tokens_stage),
]

#: Tokenisation cannot be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
