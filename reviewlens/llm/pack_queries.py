"""Query of best-two-fit packing (2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import best_two_fit
from .common import documents


def packed(docs: DataFrame, sparing: bool = False) -> DataFrame:
    import public_tokenizers

    return best_two_fit.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), sparing=sparing)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))


QUERIES = {"op2_best_fit_packing": op2_best_fit_packing}
ORACLE: dict[str, str] = {}   # tokenizing is not SQL: tested against plain loops
