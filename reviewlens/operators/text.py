"""Review preparation and sentence operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.dictionaries import (LABEL2ID, MIN_REVIEW_CHARS, MIN_SENTENCE_CHARS, SAMPLE_SEED)
from ..session import scratch_path
from .ids import dense_id, ensure_parallelism, hash_first_k


def clean_reviews(raw: DataFrame, text_col: str = "review", label_col: str = "sentiment") -> DataFrame:
    """C7 + C5: rename to (review_text, label_sentiment) and clean the text."""
    return (raw.withColumnsRenamed({text_col: "review_text", label_col: "label_sentiment"})
            .withColumn("review_text", tx.clean_text("review_text")))


def length_filter(df: DataFrame, col: str = "review_text", min_chars: int = MIN_REVIEW_CHARS) -> DataFrame:
    """Keep texts strictly longer than ``min_chars`` code points."""
    return df.where(F.length(col) > min_chars)


def prepare_reviews(raw: DataFrame, key: str = "doc_id", key_source: DataFrame | None = None) -> DataFrame:
    """Cleaned, filtered reviews with a dense ``review_id`` in source-key order and the
    ``sentiment`` copy of the label. Columns: key, review_text, label_sentiment, review_id, sentiment."""
    # Stage boundary (as the reviews file is in the original flow): cleaned, filtered rows are
    # written once to the shared folder, so numbering reads only the key column for its counts.
    df = materialize(length_filter(clean_reviews(ensure_parallelism(raw))), "reviews_clean")
    df = dense_id(df, key, "review_id", key_source=key_source if key_source is not None else raw.select(key))
    return df.withColumn("sentiment", F.col("label_sentiment"))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back (lineage cut that
    survives executor loss; later scans get column pruning)."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def drop_nulls(df: DataFrame, cols: list[str]) -> DataFrame:
    """C10."""
    return df.na.drop(subset=cols)


def label_to_id(c) -> F.Column:
    """C11: label -> id, unknown -> null."""
    m = F.create_map(*[x for k, v in LABEL2ID.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(m, c)


def id_to_label(c) -> F.Column:
    m = F.create_map(*[x for k, v in LABEL2ID.items() for x in (F.lit(v), F.lit(k))])
    return F.try_element_at(m, c)


def explode_sentences(df: DataFrame, text_col: str, keep: list[str], min_len: int = MIN_SENTENCE_CHARS) -> DataFrame:
    """One row per sentence with its 0-based position in the text; sentences are stripped and
    those shorter than ``min_len`` dropped (4 in the batch table, 0 for single-review analysis).
    Only the key columns in ``keep`` travel with the sentences."""
    s = df.select(*keep, F.posexplode_outer(tx.sentence_array(text_col)).alias("pos", "sentence"))
    s = s.withColumn("sentence", tx.strip_ws("sentence"))
    return s.where(F.length("sentence") >= F.lit(max(min_len, 1)))


def sentence_table(reviews: DataFrame, min_len: int = MIN_SENTENCE_CHARS) -> DataFrame:
    """sentences_labeled: (review_id, pos, sentence, review_sentiment)."""
    return (explode_sentences(reviews, "review_text", ["review_id", "sentiment"], min_len)
            .select("review_id", "pos", "sentence", F.col("sentiment").alias("review_sentiment")))


def exact_sample(df: DataFrame, n: int, seed: int = SAMPLE_SEED,
                 id_cols: tuple[str, ...] = ("review_id", "pos")) -> DataFrame:
    """Exactly n rows in seeded md5 order (the whole table if it has no more)."""
    total = df.count()
    if total <= n:
        return df
    flagged = hash_first_k(df, list(id_cols), seed, {None: n}, None, out="_in")
    return flagged.where("_in").drop("_in")


def reject_split(df: DataFrame, text_col: str = "review_text") -> DataFrame:
    """C14: stripped request text and a ``reject_reason`` (null = accepted): 'empty' or 'no_sentences'. Sentences are parted at
    ``SENT_MARK``, which only follows a sentence's end, so a text has none when it holds nothing but that mark and whitespace;
    the first other character decides, and the text is not split for it."""
    t = F.col(text_col)
    return (df.withColumn(text_col, tx.strip_ws(F.coalesce(t, F.lit(""))))
            .withColumn("reject_reason", F.when(F.length(t) == 0, F.lit("empty"))
                        .when(~t.rlike(rf"(?U)[^\s\x1C-\x1F{tx.SENT_MARK}]"), F.lit("no_sentences"))))
