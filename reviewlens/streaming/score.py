"""Structured Streaming (R1, R2): live scoring and running aspect x sentiment counts.

R1 is stateless: each micro-batch goes through the batch functions in ``foreachBatch`` and is written under ``batch_id=N``. Its last write is
a commit marker, a small file in a folder of its own: a batch without a marker is not visible yet, a batch that Spark hands out again after
a failure is written again if it has no marker and skipped if it has one. So every batch counts once, however often it is replayed.

R2 streams the markers, reads the sentences of the batches that they newly make visible, and writes the running totals for its own batch K from those
of batch K - 1; a replayed batch K gives the same totals again. State is bounded by aspects x labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analyze as an
from ..sources import tables

SENTENCE_SINK_SCHEMA = "review_id BIGINT, pos INT, sentence STRING, aspect STRING, sentiment STRING, batch_id BIGINT"
MARKER_SCHEMA = "marked BIGINT"
TOTALS_SCHEMA = "aspect STRING, sentiment STRING, n BIGINT, upto BIGINT, batch BIGINT"


def commits_of(sink_dir: str) -> str:
    """The folder of a sink's commit markers."""
    return sink_dir.rstrip("/") + "-commits"


def committed(spark: SparkSession, sink_dir: str) -> DataFrame:
    """Ids of the visible batches."""
    return spark.read.schema(MARKER_SCHEMA).json(commits_of(sink_dir)).distinct()


def commit(spark: SparkSession, sink_dir: str, batch_id: int) -> None:
    """Makes a batch visible: one marker file, moved into place as a whole."""
    spark.createDataFrame([(batch_id,)], MARKER_SCHEMA).coalesce(1).write.mode("append").json(commits_of(sink_dir))


def read_sink(spark: SparkSession, sink_dir: str, schema: str = SENTENCE_SINK_SCHEMA, data_dir: str | None = None) -> DataFrame:
    """The rows of visible batches; ``data_dir``: another sink of the same stream (responses, rejects)."""
    rows = spark.read.schema(schema).parquet(data_dir or sink_dir)
    return rows.join(F.broadcast(committed(spark, sink_dir)), F.col("batch_id") == F.col("marked"), "left_semi")


def _start(stream, per_batch, checkpoint_dir: str, available_now: bool):
    w = stream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def score_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str, model: an.LinearTextModel,
                 available_now: bool = True, responses_dir: str | None = None, rejects_dir: str | None = None, files_per_batch: int | None = None):
    """JSON-lines requests arriving in ``source_dir`` -> sentence rows (aspect, sentiment). ``responses_dir`` also
    gets whole responses (id, overall label, breakdown), ``rejects_dir`` the refused requests (id, line, reason): empty ones, those without a
    sentence, and lines that are no request."""
    reader = spark.readStream if files_per_batch is None else spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    # the folder that R2 watches exists before the first marker
    spark.createDataFrame([], MARKER_SCHEMA).coalesce(1).write.mode("append").json(commits_of(sink_dir))

    def per_batch(batch: DataFrame, batch_id: int):
        session = batch.sparkSession
        if committed(session, sink_dir).where(F.col("marked") == batch_id).limit(1).count():
            return
        requests = tables.parse_requests(batch)
        accepted, rejected, sent = an.analyze_reviews(requests.where("malformed is null"), model)
        if rejects_dir:
            lines = requests.where("malformed is not null").select("review_id", F.col("malformed").alias("line"), F.lit("malformed").alias("reject_reason"))
            rejected.select("review_id", F.lit(None).cast("string").alias("line"), "reject_reason").unionByName(lines) \
                .write.mode("overwrite").parquet(f"{rejects_dir}/batch_id={batch_id}")
        if responses_dir:
            path = f"{responses_dir}/batch_id={batch_id}"
            accepted.write.mode("overwrite").parquet(path)
            # the sentences of the responses, not scored again
            sent = an.breakdown_flat(session.read.schema(accepted.schema).parquet(path))
        (sent.select("review_id", "pos", "sentence", "aspect", "sentiment")
         .write.mode("overwrite").parquet(f"{sink_dir}/batch_id={batch_id}"))
        commit(session, sink_dir, batch_id)

    return _start(reader.text(source_dir).writeStream, per_batch, checkpoint_dir, available_now)


def _totals(spark: SparkSession, out_dir: str, batch_id: int) -> DataFrame:
    """The totals that batch ``batch_id`` of R2 left, none before the first."""
    if batch_id < 0:
        return spark.createDataFrame([], TOTALS_SCHEMA)
    return spark.read.schema(TOTALS_SCHEMA).parquet(out_dir).where(F.col("batch") == batch_id)


def count_stream(spark: SparkSession, sentence_dir: str, out_dir: str, checkpoint_dir: str,
                 available_now: bool = True):
    """R2: running counts per (aspect, sentiment) over R1's visible batches; read them with ``read_counts``. R1 commits its batches in order, so the
    totals keep the last one counted (``upto``), in a row without aspect and sentiment."""
    def per_batch(batch: DataFrame, batch_id: int):
        session = batch.sparkSession
        before = _totals(session, out_dir, batch_id - 1)
        upto = before.agg(F.max("upto")).first()[0]
        upto = -1 if upto is None else upto
        newest = batch.agg(F.max("marked")).first()[0]
        newest = upto if newest is None else max(newest, upto)
        fresh = read_sink(session, sentence_dir).where((F.col("batch_id") > upto) & (F.col("batch_id") <= newest)) \
            .groupBy("aspect", "sentiment").agg(F.count(F.lit(1)).alias("n"))
        both = before.where("n > 0").select("aspect", "sentiment", "n").unionByName(fresh).groupBy("aspect", "sentiment").agg(F.sum("n").alias("n"))
        head = session.createDataFrame([(None, None, 0)], "aspect STRING, sentiment STRING, n BIGINT")
        both.unionByName(head).withColumn("upto", F.lit(newest).cast("long")).coalesce(1).write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")

    return _start(spark.readStream.schema(MARKER_SCHEMA).json(commits_of(sentence_dir)).writeStream, per_batch, checkpoint_dir, available_now)


def read_counts(spark: SparkSession, out_dir: str) -> DataFrame:
    """(aspect, sentiment, n) of R2's last batch."""
    rows = spark.read.schema(TOTALS_SCHEMA).parquet(out_dir)
    last = rows.agg(F.max("batch")).first()[0]
    return rows.where((F.col("batch") == F.lit(last)) & (F.col("n") > 0)).select("aspect", "sentiment", "n")
