"""Query of the approximate nearest neighbour search (5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import nn_descent
from ..sources import tables


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest(tables.table(spark, sf_dir, "embeddings"))


QUERIES = {"op5_nearest_neighbours": op5_nearest_neighbours}
ORACLE: dict[str, str] = {}   # approximate: recall is measured against brute force
