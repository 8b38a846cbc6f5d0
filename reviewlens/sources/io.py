"""Sinks and their read-back (K2-K8). Everything is written under a folder the caller chooses (on a
cluster: the shared folder); Parquet between stages, CSV / JSON lines where the original layout is
wanted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REVIEWS_LABELED_SCHEMA = ("review_text STRING, label_sentiment STRING, review_id BIGINT, vader_label STRING, "
                          "sentiment STRING, mismatch BOOLEAN")
RESPONSE_SCHEMA = T.StructType([
    T.StructField("review_id", T.LongType()),
    T.StructField("overall_sentiment", T.StringType()),
    T.StructField("breakdown", T.ArrayType(T.StructType([
        T.StructField("pos", T.IntegerType()), T.StructField("sentence", T.StringType()),
        T.StructField("aspect", T.StringType()), T.StructField("sentiment", T.StringType())]))),
])


def write_csv(df: DataFrame, path: str) -> None:
    """K2/K3 in the original CSV layout: header, quoted multi-line texts."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("escape", '"').csv(path))


def write_parquet(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """K2-K5: Parquet; the final aspect table is partitioned by aspect so readers prune partitions."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """K8: analysis results as JSON lines (nested breakdown kept)."""
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema=RESPONSE_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_topics_csv(info: DataFrame, path: str) -> None:
    """K4 as CSV: array columns become delimited strings."""
    cols = [F.array_join(c.name, ",").alias(c.name) if isinstance(c.dataType, T.ArrayType) else F.col(c.name)
            for c in info.schema.fields]
    write_csv(info.select(*cols), path)


def save_model(model, path: str) -> None:
    """K6: fitted ML pipeline / model."""
    model.write().overwrite().save(path)
