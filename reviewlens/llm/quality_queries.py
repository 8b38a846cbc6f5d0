"""Queries of the quality operators: byte-level classifier (1) and line-labelling rules (9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import byte_conv, line_crf
from .common import documents, labels


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return byte_conv.score_documents(docs, byte_conv.train(docs, labels(spark, sf_dir)))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return line_crf.label_documents(docs, line_crf.train(docs, labels(spark, sf_dir)))


QUERIES = {"op1_quality_classifier": op1_quality_classifier, "op9_quality_rules": op9_quality_rules}
ORACLE: dict[str, str] = {}   # both need trained models: tested against brute force and held-out labels
