"""Query of the n-gram Jaccard join (8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import part_enum
from .common import documents


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_enum.cluster(documents(spark, sf_dir), part_enum.Join(words=4, least=85, of=100))


QUERIES = {"op8_ngram_jaccard_join": op8_ngram_jaccard_join}
ORACLE: dict[str, str] = {}   # all pairs in SQL are too slow on whole tables: tested against brute force
