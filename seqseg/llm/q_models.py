"""Queries of the trained classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqseg.llm import line_quality, toxicity
from seqseg.llm.labelled import fold, sample

#: Labelled rows of each class that a model is trained on at most.
TRAINING_ROWS = 1500


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _tables(spark, sf_dir)
    model = toxicity.train(sample(docs, labels, "toxic", fold("_id", 5) != 0, TRAINING_ROWS))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _tables(spark, sf_dir)
    field = line_quality.train(sample(docs, labels, "quality", fold("_id", 3) != 1, TRAINING_ROWS))
    scored = line_quality.score_quality(docs, field)
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


QUERIES = {"op1_toxicity": op1_toxicity, "op5_quality_classifier": op5_quality_classifier}
ORACLES: dict[str, str] = {}
