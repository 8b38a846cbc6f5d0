"""Helpers shared by the training-data operators: readers, stage tables, worker code, labelled samples."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources import tables


def ship_by_value(module_name: str) -> None:
    """Pickle the functions of this module by value, so that Python workers need not import the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


ship_by_value(__name__)


def forget_tables() -> None:
    """Drop what tasks of other operators have kept in this Python worker for their next task: Spark gives a worker tasks of all stages, and the
    kept tables of one would stand in the memory of the next. They only save work."""
    if sys.modules.pop("best_two_fit_worker", None):
        give_back()


def give_back() -> None:
    """Return the memory that this Python worker has freed to the system. Spark keeps workers for later tasks and stages, beside the executor's JVM; what
    their allocators keep at hand would stand in the memory of those."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc has it
    if trim:
        trim(0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "documents")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "labels")


def stage_path(spark: SparkSession, name: str) -> str:
    """A new folder for a stage table under the shared folder named by ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a stage table to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id) -> F.Column:
    """Rows that no model may learn from: crc32 of the id's text is divisible by 5. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, max_chars: int,
                    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[tuple[str, int]]:
    """At most ``per_class`` (text, label) rows of each class 0 and 1, the ones whose id hashes lowest, without
    held-out ids. Texts over ``max_chars`` characters are not used for training (they are still scored).
    The same sample comes back on every run; only these bounded rows reach the driver."""
    usable = (labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
              .where(F.col("_id").isNotNull() & ~held_out(F.col("_id")))
              .groupBy("_id").agg(F.max("_y").alias("_y")))
    h = F.xxhash64("_id")
    picked = None
    for y in (0, 1):
        part = usable.where(F.col("_y") == y).orderBy(h, "_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    d = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
         .where(F.length("_text") <= max_chars))
    # at most 2 * per_class narrow rows
    rows = d.join(F.broadcast(picked), "_id").groupBy("_id").agg(F.min(F.struct("_text", "_y")).alias("r")) \
        .select("_id", "r._text", "r._y").collect()
    return [(r[1], r[2]) for r in sorted(rows, key=lambda r: r[0])]
