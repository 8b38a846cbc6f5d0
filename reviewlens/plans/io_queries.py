"""Registered queries for sinks read back (K) and streaming (R); each equals a batch query, so the
batch query's SQL is its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lexicon as lx
from ..operators import topics as tp
from ..session import scratch_path
from ..sources import io, tables
from ..streaming import score as sm
from . import common
from . import sqlparts as S
from . import topic_queries as tq

_REV_SCHEMA = "review_id BIGINT, review_text STRING, sentiment STRING"


def q_csv_roundtrip(spark, sf):
    r = common.reviews(spark, sf).select("review_id", "review_text", "sentiment")
    path = scratch_path(spark, "reviews_csv")
    io.write_csv(r, path)
    return io.read_csv(spark, path, _REV_SCHEMA)


def q_json_roundtrip(spark, sf):
    acc, _, _ = tq._analyze(spark, sf)
    path = scratch_path(spark, "responses_json")
    io.write_json(acc, path)
    back = io.read_json(spark, path)
    return back.select("review_id", "overall_sentiment", F.size("breakdown").alias("n_sentences"),
                       F.array_join(F.transform("breakdown", lambda x: x["aspect"]), "|").alias("aspects"))


def q_partitioned_roundtrip(spark, sf):
    final = tq._final(spark, sf).select("review_id", "pos", "aspect", "sentence_sentiment")
    path = scratch_path(spark, "aspect_final")
    io.write_parquet(final, path, partition_by="aspect")
    return spark.read.parquet(path).select("review_id", "pos", "aspect", "sentence_sentiment")


def _stream_sentences(spark, sf):
    """Documents land as JSON-lines files; R1 scores them as a stream."""
    model = tq._model(spark, sf)
    src = scratch_path(spark, "requests")
    tables.table(spark, sf, "documents").select(F.col("doc_id").alias("review_id"), F.col("text").alias("review_text")) \
        .write.json(src)
    sink, ck = scratch_path(spark, "stream_sentences"), scratch_path(spark, "ck_score")
    q = sm.score_stream(spark, src, sink, ck, model)
    q.awaitTermination()
    return sink


def q_stream_score(spark, sf):
    sink = _stream_sentences(spark, sf)
    return sm.read_sink(spark, sink).select("review_id", "pos", "sentence", "aspect", "sentiment")


def q_stream_counts(spark, sf):
    sink = _stream_sentences(spark, sf)
    out, ck = scratch_path(spark, "stream_counts"), scratch_path(spark, "ck_counts")
    q = sm.count_stream(spark, sink, out, ck)
    q.awaitTermination()
    return sm.read_counts(spark, out)


def q_request_intake(spark, sf):
    """The documents as request lines; of every tenth the line is cut short, of every eleventh the id is no number. Which lines are requests, and
    which are rejected as a whole."""
    docs = tables.table(spark, sf, "documents")
    start = F.concat(F.lit('{"review_id": '), F.col("doc_id").cast("string"), F.lit(', "review_te'))
    other = F.concat(F.lit('{"review_id": "no ', ), F.col("doc_id").cast("string"), F.lit('", "review_text": "x"}'))
    good = F.to_json(F.struct(F.col("doc_id").alias("review_id"), F.col("text").alias("review_text")))
    path = scratch_path(spark, "request_lines")
    docs.select(F.when(F.col("doc_id") % 10 == 0, start).when(F.col("doc_id") % 11 == 0, other).otherwise(good).alias("value")).write.text(path)
    return tables.read_requests_json(spark, path).select("review_id", F.length("review_text").alias("n_chars"), "malformed")


def _written_back(spark, rows, name, schema):
    path = scratch_path(spark, name)
    io.write_csv(rows, path)
    return io.read_csv(spark, path, schema)


def q_reviews_labeled(spark, sf):
    """K2: all six columns of the labelled reviews, written and read back."""
    r = common.reviews(spark, sf)
    return _written_back(spark, lx.reviews_labeled(r, common.lexicon(spark, sf, r)), "reviews_labeled", io.REVIEWS_LABELED_SCHEMA)


def q_sentences_labeled(spark, sf):
    """K3: the sentence table, written and read back."""
    s = common.sentences(spark, sf).select("review_id", "sentence", "review_sentiment")
    return _written_back(spark, s, "sentences_labeled", "review_id BIGINT, sentence STRING, review_sentiment STRING")


def q_topics_written(spark, sf):
    """K4: the topic list as CSV, arrays joined, read back."""
    _, _, tmap, _, words, _ = tq._topics(spark, sf)
    info = tp.topic_info(tmap, words).withColumn("words", F.split("representation", ",")).drop("representation")
    path = scratch_path(spark, "topics_csv")
    io.write_topics_csv(info, path)
    return io.read_csv(spark, path, "topic_id INT, count BIGINT, name STRING, words STRING")


def q_final_table(spark, sf):
    """The final aspect table through its reader."""
    path = scratch_path(spark, "aspect_final")
    io.write_parquet(tq._final(spark, sf).select("review_id", "pos", "aspect", "sentence_sentiment"), path, partition_by="aspect")
    return tables.read_final_table(spark, path).groupBy("aspect", "sentence_sentiment").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "request_intake": q_request_intake,
    "reviews_labeled": q_reviews_labeled,
    "sentences_labeled": q_sentences_labeled,
    "topics_written": q_topics_written,
    "final_table": q_final_table,
    "csv_roundtrip": q_csv_roundtrip,
    "json_roundtrip": q_json_roundtrip,
    "partitioned_roundtrip": q_partitioned_roundtrip,
    "stream_score": q_stream_score,
    "stream_counts": q_stream_counts,
}

_AN = f"{S.BASE}, {tq.mq.FIT}, {tq.mq.NB}, {tq.ANALYZE}"
ORACLE = {
    "request_intake": """SELECT CASE WHEN doc_id % 10 <> 0 AND doc_id % 11 <> 0 THEN doc_id END AS review_id,
        CASE WHEN doc_id % 10 <> 0 AND doc_id % 11 <> 0 THEN CAST(length(text) AS INTEGER) END AS n_chars,
        CASE WHEN doc_id % 10 = 0 THEN '{"review_id": ' || doc_id || ', "review_te' WHEN doc_id % 11 = 0 THEN '{"review_id": "no ' || doc_id || '", "review_text": "x"}' END AS malformed
        FROM documents""",
    "reviews_labeled": f"""WITH {S.BASE}, {S.corpus_lexicon_cte()}, {S.lexicon_scores_cte("reviews", "review_id", "review_text")},
        lab AS (SELECT review_id, {S.compound_label('compound')} AS vader_label FROM scores)
        SELECT r.review_text, r.sentiment AS label_sentiment, r.review_id, l.vader_label, r.sentiment, r.sentiment IS DISTINCT FROM l.vader_label AS mismatch
        FROM reviews r JOIN lab l USING (review_id)""",
    "sentences_labeled": f"WITH {S.BASE}, {S.sentences_cte()} SELECT review_id, sentence, review_sentiment FROM sentences",
    "topics_written": f"WITH {S.BASE}, {tq.TOPICS}, {tq.INFO} SELECT topic_id, count, name, representation AS words FROM tinfo",
    "final_table": f"WITH {tq._FINAL_BASE}, {tq.FINAL} SELECT aspect, sentence_sentiment, count(*) AS n FROM final GROUP BY ALL",
    "csv_roundtrip": f"WITH {S.BASE} SELECT review_id, review_text, sentiment FROM reviews",
    "json_roundtrip": f"""WITH {_AN}
        SELECT o.review_id, o.p AS overall_sentiment, CAST(coalesce(b.n, -1) AS INTEGER) AS n_sentences, b.aspects
        FROM aov o LEFT JOIN (SELECT review_id, count(*) AS n, string_agg(aspect, '|' ORDER BY pos) AS aspects
                              FROM asr GROUP BY review_id) b USING (review_id)""",
    "partitioned_roundtrip": f"WITH {tq._FINAL_BASE}, {tq.FINAL} SELECT review_id, pos, aspect, sentence_sentiment FROM final",
    "stream_score": f"WITH {_AN} SELECT review_id, pos, sentence, aspect, sentiment FROM asr",
    "stream_counts": f"WITH {_AN} SELECT aspect, sentiment, count(*) AS n FROM asr GROUP BY ALL",
}
