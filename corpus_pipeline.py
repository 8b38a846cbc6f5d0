"""Corpus pipeline: stages over the documents table, each written as Parquet and read back by the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.llm import common, line_crf, mix_queries, pack_queries, part_enum, secret_ledger

NEAR = part_enum.Join(words=5, least=80, of=100)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that the rules reject go. The model learns from the documents and labels tables."""
    crf = line_crf.train(common.documents(spark, sf_dir), common.labels(spark, sf_dir))
    return line_crf.keep_documents(docs, crf)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8 on five-word shingles at 0.8: one document of each group stays."""
    return part_enum.one_of_each(docs, NEAR)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: found secrets give way to a mark; n_chars follows the text."""
    found = secret_ledger.Ledger(spark, common.stage_path(spark, "secret-ledger")).scan(docs)
    changed = secret_ledger.redact(docs.withColumn("_before", F.xxhash64("text")), found)
    return changed.withColumn("n_chars", F.when(F.xxhash64("text") == F.col("_before"), F.col("n_chars")).otherwise(F.length("text"))).drop("_before")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: each document stands as often as the mix takes it; documents that it does not take go."""
    mixed = mix_queries.mixed(docs, prefix="_mix_").where("_mix_copies > 0")
    return mixed.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int")))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the pieces of all documents in sequences of 1024 tokens."""
    return pack_queries.packed(docs, sparing=True)


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("secret scans", secret_scan),
          ("mixing sources to target weights", source_mix), ("best-fit packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.stage(docs, name.replace(" ", "-"))
    return docs


ORACLE_SQL = None   # trained models and tokenizing: tested against plain loops
