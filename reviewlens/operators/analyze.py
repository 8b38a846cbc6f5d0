"""Review analysis and summaries (G1-G7, C14 in use), for all reviews in one job.

A fitted linear text model is passed as (idf table, coefficient table, intercept); ``LinearTextModel``
bundles them. Sentences keep their position, so nothing relies on row order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import aspects as fa
from ..sources import dictionaries as d
from . import features as fe
from . import model as md
from . import text as tt
from .ids import on_key, repeated_keys

BREAKDOWN = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in ("sentence", "aspect", "sentiment")]]))


@dataclass
class LinearTextModel:
    idf: DataFrame        # (term, term_index, idf), at most max_features rows
    coef: DataFrame       # (term, coef)
    intercept: float

    def predict(self, df: DataFrame, id_col, text_col: str, out: str = "sentiment", carry=()) -> DataFrame:
        """(ids, *carry, out) for every row of ``df``, scored inside its row: nothing is shuffled, so ``carry`` may hold
        texts. The score is b + sum(n*idf*coef) / sqrt(sum((n*idf)^2)) (TF-IDF with L2 norm, then the linear model);
        texts without a vocabulary term score b. The model table (at most max_features rows) goes to every task."""
        import numpy as np
        import pyarrow as pa

        keys = [*([id_col] if isinstance(id_col, str) else id_col), *carry]
        weights, index_of, positive = self._shipped(df.sparkSession), fe.TermIndex, fe.linear_positive
        x = df.select(*keys, fe.tokens(text_col).alias("_tok"))

        def run(batches):
            terms, idf, coef, intercept = weights.value
            index = index_of(terms)
            for b in batches:
                label = np.where(positive(index, idf, coef, intercept, b.column(b.num_columns - 1)), "positive", "negative")
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(label, pa.string())], names=[*b.schema.names[:-1], out])

        return x.mapInArrow(run, x.drop("_tok").schema.add(out, "string"))

    def _shipped(self, spark):
        """The model as plain values, broadcast: the index is made in the task, Python workers need not have this package."""
        import numpy as np

        rows = self.idf.select("term", "idf").join(self.coef, "term").select("term", "idf", F.coalesce("coef", F.lit(0.0))).collect()
        return spark.sparkContext.broadcast(([r[0] for r in rows], np.array([r[1] for r in rows], np.float64), np.array([r[2] for r in rows], np.float64), float(self.intercept)))

    def predict_reviews(self, sentences: DataFrame, id_col: str, row_col: str, text_col: str = "sentence") -> DataFrame:
        """(id, overall_sentiment, breakdown) from the sentence rows (id, row, pos, sentence, aspect) of reviews: the sentences of a review, which is one
        value of ``row_col``, stand side by side in order, as they come from one row. Every sentence and the review's whole text, which has the tokens of
        its sentences, are scored as by ``predict``; nothing is shuffled."""
        import numpy as np
        import pyarrow as pa

        weights, index_of, positive = self._shipped(sentences.sparkSession), fe.TermIndex, fe.linear_positive
        x = sentences.select(id_col, row_col, "pos", text_col, "aspect", fe.tokens(text_col).alias("_tok"))
        schema = x.select(id_col).schema.add("overall_sentiment", "string").add("breakdown", BREAKDOWN)

        def one(parts):
            return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

        def run(batches):
            terms, idf, coef, intercept = weights.value
            index = index_of(terms)

            def label(lists):
                return pa.array(np.where(positive(index, idf, coef, intercept, lists), "positive", "negative"), pa.string())

            def reviews(b):
                row, tok = b.column(1).to_numpy(), b.column(5)
                start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                edge = pa.array(np.r_[start, b.num_rows].astype(np.int32))
                struct = pa.StructArray.from_arrays([*b.columns[2:5], label(tok)], names=["pos", "sentence", "aspect", "sentiment"])
                whole = pa.ListArray.from_arrays(tok.offsets.take(edge), tok.values)
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(start)), label(whole), pa.ListArray.from_arrays(edge, struct)],
                                                  names=[id_col, "overall_sentiment", "breakdown"])

            held = []       # the last review met, which may go on in the next batch
            for b in batches:
                if not b.num_rows:
                    continue
                row = b.column(1).to_numpy()
                last = int(np.flatnonzero(np.r_[True, row[1:] != row[:-1]])[-1])
                if held and held[0].column(1)[0].as_py() != row[0]:
                    yield reviews(one(held))
                    held = []
                if last:
                    yield reviews(one([*held, b.slice(0, last)]))
                    held = []
                held.append(b.slice(last))
            if held:
                yield reviews(one(held))

        return x.mapInArrow(run, schema)


def analyze_reviews(requests: DataFrame, model: LinearTextModel, id_col: str = "review_id",
                    text_col: str = "review_text", clean: bool = False):
    """G1: returns (accepted, rejected, sentence rows).

    accepted: (id, overall_sentiment, breakdown ARRAY<STRUCT<pos, sentence, aspect, sentiment>>);
    rejected: (id, reject_reason); sentence rows: (id, pos, sentence, aspect, sentiment).
    The text is only stripped (``clean=True`` applies the training-time cleaning), sentences are not
    length-filtered, the overall label scores the whole text. A review is scored and its breakdown made inside its row; only the requests of an id that
    comes more than once meet, as each of them gets the sentences of all. A request without an id has no breakdown.
    """
    x = requests.select(id_col, text_col)
    again = repeated_keys(x.where(F.col(id_col).isNotNull()), id_col)
    if clean:
        from ..functions import text as tx
        x = x.withColumn(text_col, tx.clean_text(text_col))
    x = tt.reject_split(x, text_col)
    ok = x.where(F.col("reject_reason").isNull()).select(id_col, text_col)
    rejected = x.where(F.col("reject_reason").isNotNull()).select(id_col, "reject_reason")
    s = tt.explode_sentences(ok.withColumn("_row", F.monotonically_increasing_id()), text_col, [id_col, "_row"], min_len=0) \
        .withColumn("aspect", fa.keyword_aspect("sentence"))
    rows = model.predict_reviews(s, id_col, "_row")
    accepted = rows.withColumn("breakdown", F.when(F.col(id_col).isNotNull(), F.col("breakdown")))
    if again is not None:
        more = on_key(rows, id_col, again, "left_semi")
        merged = more.groupBy(id_col).agg(F.array_sort(F.flatten(F.collect_list("breakdown"))).alias("breakdown"))
        accepted = on_key(accepted, id_col, again, "left_anti").unionByName(more.drop("breakdown").join(merged, id_col))
    return accepted, rejected, rows.select(id_col, F.inline("breakdown"))


def breakdown_flat(accepted: DataFrame, id_col: str = "review_id") -> DataFrame:
    """One row per sentence of the breakdown."""
    return accepted.select(id_col, F.inline("breakdown"))


def aspects_summary(final: DataFrame, aspect_col: str = "aspect", sentiment_col: str = "sentence_sentiment",
                    values=("negative", "positive")) -> DataFrame:
    """Counts per aspect x sentiment (zeros filled) and the total row count of the table (rows with a null aspect
    count in the total but in no cell), from one aggregate with a row per aspect."""
    per = final.groupBy(aspect_col).agg(*[F.count_if(F.col(sentiment_col) == v).alias(v) for v in values],
                                        F.count(F.lit(1)).alias("_rows"))
    total = F.sum("_rows").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return per.withColumn("total_sentences", total).where(F.col(aspect_col).isNotNull()).drop("_rows")


def review_aspect_counts(sent: DataFrame, id_col: str = "review_id") -> DataFrame:
    """Per review and aspect: positive and negative sentence counts, first position (the order
    aspects were first seen)."""
    return sent.groupBy(id_col, "aspect").agg(
        F.count_if(F.col("sentiment") == "positive").alias("positive"),
        F.count_if(F.col("sentiment") == "negative").alias("negative"),
        F.min("pos").alias("first_pos"))


def percent_split(pos, neg):
    """(pos_pct, neg_pct, label) with half-even rounding; 'N/A' for a zero total."""
    total = pos + neg
    pct = F.when(total == 0, F.lit(None)).otherwise(F.bround(F.lit(100.0) * pos / total, 0).cast("int"))
    return pct, F.lit(100) - pct, F.when(total == 0, F.lit("N/A"))


def gauge(pos, neg):
    """Percent positive (50 when there is no positive or negative sentence) and the label."""
    total = pos + neg
    pct = F.when(total == 0, F.lit(50)).otherwise(F.bround(F.lit(100.0) * pos / total, 0).cast("int"))
    label = (F.when(total == 0, F.lit("N/A")).when(pct >= d.GAUGE_POSITIVE, F.lit("Positive"))
             .when(pct <= d.GAUGE_NEGATIVE, F.lit("Negative")).otherwise(F.lit("Mixed / Neutral")))
    return pct, label
