"""Topics and aspects from cluster labels.

Input is a sentence table with a cluster label per sentence (from ``density.density_clusters`` or any
other grouping). Everything after the word counts works on small tables: one row per topic, or per
(topic, word), and the sentence-level joins use a broadcast of the per-topic map (checked size).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources import dictionaries as d
from .lexicon import sized_broadcast
from .text import materialize


def number_topics(assign: DataFrame, cluster_col: str, id_cols=("review_id", "pos"),
                  min_size: int = d.MIN_TOPIC_SIZE, noise=None) -> DataFrame:
    """A4: (cluster, topic_id, count). Clusters with fewer than ``min_size`` members, and the noise
    label, become topic -1; the rest are numbered 0.. by size (largest first, ties: smallest member)."""
    g = assign.groupBy(F.col(cluster_col).alias("cluster")).agg(
        F.count(F.lit(1)).alias("count"), F.min(F.struct(*id_cols)).alias("_first"))
    is_noise = (F.col("count") < min_size) | F.col("cluster").isNull()
    if noise is not None:
        is_noise = is_noise | (F.col("cluster") == F.lit(noise))
    g = g.withColumn("_noise", is_noise)
    w = Window.partitionBy("_noise").orderBy(F.desc("count"), "_first")   # one row per cluster
    return g.select("cluster", F.when(F.col("_noise"), F.lit(-1)).otherwise(F.row_number().over(w) - 1)
                    .cast("int").alias("topic_id"), "count")


def assign_topics(sentences: DataFrame, topic_map: DataFrame, cluster_col: str) -> DataFrame:
    """Attach topic_id to every sentence by a key join (row order is never used)."""
    m = sized_broadcast(topic_map.select(F.col("cluster").alias(cluster_col), "topic_id"))
    return sentences.join(m, cluster_col)


def class_word_counts(docs: DataFrame, class_cols, text_col: str = "sentence") -> DataFrame:
    """(classes, word, tf): how often each class has each word. With several class columns the words of the texts are counted
    once for all of them. The counts feed several aggregates and a scalar: written once as a stage table."""
    w = docs.select(*class_cols, F.explode_outer(tx.word_tokens(text_col)).alias("word")).where(F.col("word").isNotNull())
    return materialize(w.groupBy(*class_cols, "word").agg(F.count(F.lit(1)).alias("tf")), "class_word_counts")


def topic_word_scores(docs: DataFrame, class_col: str = "topic_id", text_col: str = "sentence",
                      top_n: int = d.TOP_N_WORDS, salts: int = 64, counts: DataFrame | None = None) -> DataFrame:
    """A5: class-based TF-IDF, W(t,c) = tf(t,c)/n(c) * ln(1 + A/f(t)) with A the integer mean of words
    per class; top ``top_n`` words per class (ties: word ascending). (class, word, score, rank). ``counts``: ``class_word_counts``
    by this and other classes, if made already."""
    counts = class_word_counts(docs, [class_col], text_col) if counts is None else counts
    nc = counts.groupBy(class_col).agg(F.sum("tf").alias("nc"))
    a = int(nc.agg(F.avg("nc")).first()[0] or 0)
    # one shuffle, by word: a word has a row per class at most
    tf = counts.repartition("word").groupBy(class_col, "word").agg(F.sum("tf").alias("tf"))
    x = tf.withColumn("ft", F.sum("tf").over(Window.partitionBy("word"))).join(sized_broadcast(nc), class_col)
    x = x.withColumn("score", F.col("tf") / F.col("nc") * F.log(F.lit(1.0) + F.lit(a) / F.col("ft")))
    # Two-level top-k: a topic with a huge vocabulary is split over word-hash salts first, so no task
    # sorts a whole topic; the second window sees at most salts x top_n rows per topic.
    order = (F.desc("score"), "word")
    x = x.withColumn("_salt", F.pmod(F.hash("word"), F.lit(salts)))
    x = x.withColumn("_r1", F.row_number().over(Window.partitionBy(class_col, "_salt").orderBy(*order))) \
        .where(F.col("_r1") <= top_n)
    r = F.row_number().over(Window.partitionBy(class_col).orderBy(*order))
    return x.withColumn("rank", r).where(F.col("rank") <= top_n).select(class_col, "word", "score", "rank")


def topic_info(topic_map: DataFrame, words: DataFrame) -> DataFrame:
    """(topic_id, count, name, representation); name = id_w1_w2_w3_w4, representation = words in
    rank order joined by ','. One row per topic."""
    wl = words.groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("_w"))
    ws = F.transform("_w", lambda x: x["word"])
    t = topic_map.groupBy("topic_id").agg(F.sum("count").alias("count"))
    return t.join(wl, "topic_id", "left").select(
        "topic_id", "count",
        F.concat_ws("_", F.col("topic_id").cast("string"), F.slice(ws, 1, 4)).alias("name"),
        F.array_join(ws, ",").alias("representation"))


def centroids(members: DataFrame, dims: int, topic_col: str = "topic_id", vector_col: str = "reduced") -> DataFrame:
    """(topic, centroid): the mean vector of every topic, one row per topic, summed map-side."""
    return members.groupBy(topic_col).agg(F.array(*[F.avg(F.col(vector_col)[i]) for i in range(dims)]).alias("centroid"))


def representatives(members: DataFrame, dims: int, k: int = d.REPRESENTATIVE_DOCS, topic_col: str = "topic_id", vector_col: str = "reduced",
                    id_col: str = "review_id", spread: int = 64) -> DataFrame:
    """(topic, rank, id) of the ``k`` members nearest to their topic's centroid (distance to 9 decimals, ties: smaller id). Every task keeps the k best of
    each topic it meets, as a bounded state that merges with others; only those rows are shuffled, first over ``spread`` keys a topic. A topic that
    holds a third of the rows stays split over all tasks."""
    square = None
    for i in range(dims):
        one = (F.col(vector_col)[i] - F.col("centroid")[i]) * (F.col(vector_col)[i] - F.col("centroid")[i])
        square = one if square is None else square + one
    near = members.where(F.col(vector_col).isNotNull()).join(sized_broadcast(centroids(members, dims, topic_col, vector_col)), topic_col) \
        .select(F.col(topic_col).alias("topic"), F.round(F.sqrt(square), 9).alias("distance"), F.col(id_col).cast("long").alias("id"))

    def best(batches):
        import pandas as pd

        kept = None
        for b in batches:
            both = b if kept is None else pd.concat([kept, b])
            kept = both.sort_values(["topic", "distance", "id"], kind="stable").groupby("topic", sort=False).head(k)
        if kept is not None:
            yield kept

    some = near.where("topic is not null").mapInPandas(best, near.schema)
    first = lambda g: g.agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "id"))), 1, k).alias("m"))
    spread_rows = first(some.groupBy("topic", F.pmod(F.xxhash64("id"), F.lit(spread)).alias("part"))).select("topic", F.inline("m"))
    return first(spread_rows.groupBy("topic")).select(F.col("topic").alias(topic_col), F.posexplode("m").alias("rank", "r")) \
        .select(topic_col, (F.col("rank") + 1).alias("rank"), F.col("r")["id"].alias(id_col))


def representative_docs(info: DataFrame, chosen: DataFrame, texts: DataFrame, text_col: str, topic_col: str = "topic_id", id_col: str = "review_id") -> DataFrame:
    """The topic table with ``representative_docs``, the texts of its representatives by rank. At most k ids per topic meet the texts."""
    found = texts.select(id_col, text_col).join(sized_broadcast(chosen), id_col)
    docs = found.groupBy(topic_col).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(text_col).alias("text")))).alias("_d"))
    return info.join(docs.select(topic_col, F.transform("_d", lambda x: x["text"]).alias("representative_docs")), topic_col, "left")


def topic_summary(info: DataFrame, top_n: int = d.TOPIC_SUMMARY_ROWS) -> DataFrame:
    """The first ``top_n`` topics by id, noise excluded (a report limit)."""
    return info.where(F.col("topic_id") != -1).orderBy("topic_id").limit(top_n)


def keyword_table(spark, table=d.TOPIC_ASPECT_KEYWORDS) -> DataFrame:
    rows = [(a, i, k) for i, (a, kws) in enumerate(table) for k in kws]
    return spark.createDataFrame(rows, "aspect string, aspect_order int, keyword string")


def topic_aspects(words: DataFrame, keywords: DataFrame, min_overlap: int = d.MIN_TOPIC_OVERLAP) -> DataFrame:
    """(topic_id, aspect, overlap) for topics whose top words share at least ``min_overlap`` words
    with an aspect's set; the largest overlap wins, ties go to the earlier aspect; noise is skipped."""
    j = words.where(F.col("topic_id") != -1).join(sized_broadcast(keywords), F.col("word") == F.col("keyword"))
    ov = j.groupBy("topic_id", "aspect", "aspect_order").agg(F.countDistinct("word").alias("overlap"))
    r = F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc("overlap"), "aspect_order"))
    return ov.withColumn("_r", r).where((F.col("_r") == 1) & (F.col("overlap") >= min_overlap)) \
        .select("topic_id", "aspect", F.col("overlap").cast("int").alias("overlap"))


def mapping_report(words: DataFrame, keywords: DataFrame, mapping: DataFrame) -> DataFrame:
    """Every non-noise topic with its aspect (null when unmapped), the matched words (sorted) and the
    first five of its top words in alphabetical order."""
    tw = words.where(F.col("topic_id") != -1).groupBy("topic_id").agg(F.array_sort(F.collect_list("word")).alias("_w"))
    m = mapping.select(F.col("topic_id").alias("_mt"), "aspect").join(
        sized_broadcast(keywords.select("aspect", "keyword")), "aspect").drop("aspect")
    matched = words.join(m, (F.col("topic_id") == F.col("_mt")) & (F.col("word") == F.col("keyword"))) \
        .groupBy("topic_id").agg(F.array_join(F.array_sort(F.collect_set("word")), ",").alias("matched_words"))
    return tw.join(mapping, "topic_id", "left").join(matched, "topic_id", "left").select(
        "topic_id", "aspect", F.when(F.col("aspect").isNull(), F.lit("unmapped")).otherwise(F.lit("mapped")).alias("status"),
        "matched_words", F.array_join(F.slice("_w", 1, 5), ",").alias("top_words"))


def sentence_aspects(sent_topics: DataFrame, mapping: DataFrame) -> DataFrame:
    """A10: sentences of mapped topics get the aspect; the rest (noise, unmapped) are dropped."""
    return sent_topics.join(sized_broadcast(mapping.select("topic_id", "aspect")), "topic_id")


def crosstab(df: DataFrame, row: str = "aspect", col: str = "sentence_sentiment", values=("negative", "positive")) -> DataFrame:
    """Counts per row x column value, zeros filled."""
    return df.groupBy(row).pivot(col, list(values)).agg(F.count(F.lit(1))).na.fill(0, list(values))
