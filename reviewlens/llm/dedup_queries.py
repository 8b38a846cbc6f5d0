"""Query of the suffix-array dedup (6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import lpf_dedup
from .common import documents


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lpf_dedup.dedup(documents(spark, sf_dir))


QUERIES = {"op6_suffix_array_dedup": op6_suffix_array_dedup}
ORACLE: dict[str, str] = {}   # all strings of 50 bytes are too many for SQL: tested against brute force
