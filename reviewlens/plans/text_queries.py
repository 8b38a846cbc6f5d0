"""Registered queries for preparation, sentences and the lexicon check (C, T, V) and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import aspects as fa
from ..functions import text as tx
from ..operators import lexicon as lx
from ..operators import text as tt
from ..sources import dictionaries as d
from ..sources import tables
from . import common
from . import sqlparts as S


def q_clean_text(spark, sf):
    raw = tables.raw_reviews(spark, sf)
    return tt.clean_reviews(raw).select("doc_id", "review_text")


def q_length_filter(spark, sf):
    raw = tables.raw_reviews(spark, sf)
    return tt.length_filter(tt.clean_reviews(raw)).select("doc_id", "review_text")


def q_dense_review_id(spark, sf):
    return common.reviews(spark, sf).select("doc_id", "review_id")


def q_drop_nulls(spark, sf):
    return tt.drop_nulls(common.reviews(spark, sf), ["review_text", "sentiment"]).select("review_id", "sentiment")


def q_label_map(spark, sf):
    r = common.reviews(spark, sf)
    return r.select("review_id", "sentiment", tt.label_to_id(F.col("sentiment")).alias("label"),
                    tt.id_to_label(tt.label_to_id(F.col("sentiment"))).alias("label_back"))


def q_reject_split(spark, sf):
    docs = tables.table(spark, sf, "documents").select("doc_id", F.col("text").alias("review_text"))
    return tt.reject_split(docs).select("doc_id", "reject_reason")


def q_sentence_explode(spark, sf):
    return common.sentences(spark, sf)


SAMPLE_ROWS = 5000     # the sampling operator's argument, below the sentences of any test table


def q_exact_sample(spark, sf):
    return tt.exact_sample(common.sentences(spark, sf).select("review_id", "pos", "sentence"), SAMPLE_ROWS)


def _labels(spark, sf):
    r = common.reviews(spark, sf)
    return lx.lexicon_labels(r, common.lexicon(spark, sf, r))


def q_lexicon_score(spark, sf):
    return _labels(spark, sf).select("review_id", "compound")


def q_lexicon_label(spark, sf):
    return _labels(spark, sf).select("review_id", "vader_label")


def q_mismatch_flag(spark, sf):
    return _labels(spark, sf).select("review_id", "sentiment", "vader_label", "mismatch")


def q_mismatch_rate(spark, sf):
    m = lx.mismatch_rate(_labels(spark, sf))
    return m.select("n_reviews", F.round("mismatch_pct", 6).alias("mismatch_pct"))


def q_label_distribution(spark, sf):
    return lx.label_distribution(common.reviews(spark, sf))


def q_keyword_aspect(spark, sf):
    s = common.sentences(spark, sf)
    return s.select("review_id", "pos", fa.keyword_aspect("sentence").alias("aspect"))


CORPUS_KEYWORDS = [("German", [" der ", " und ", " die "]), ("French", [" le ", " que ", " les "]),
                   ("Spanish", [" el ", " los ", " del "]), ("English", [" the ", " and ", " of "])]


def q_aspect_lexicon_counts(spark, sf):
    """Flagship slice: sentence keyword aspect x sentence lexicon label counts, wide. The keywords are ones that the
    test texts hold: common words of their languages, as aspects named by language."""
    r = common.reviews(spark, sf)
    lex = common.lexicon(spark, sf, r)
    s = tt.sentence_table(r).withColumn("aspect", fa.keyword_aspect("sentence", CORPUS_KEYWORDS))
    scored = lx.lexicon_scores(s, lex, id_col=["review_id", "pos"], text_col="sentence", carry=("aspect",))
    lab = scored.withColumn("label", lx.compound_label("compound"))
    return lab.groupBy("aspect").agg(
        *[F.count_if(F.col("label") == v).alias(v) for v in ("negative", "neutral", "positive")],
        F.count(F.lit(1)).alias("total"))


# openings that hold a phrase rule each; every review is scored under one of them
PHRASES = ["A bad ass film, kiss of death.", "It was kind of good, kind of bad.", "The least good of all.", "At least good, the very least bad.",
           "It was never so good.", "Never has this been good, never this bad.", "Without doubt good.", "Without any doubt a bad one.", "A love to die for, yeah right, good."]


def q_lexicon_phrases(spark, sf):
    """V1 on texts that hold phrases: a review's text behind the opening that its id names."""
    r = common.reviews(spark, sf)
    opening = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.col("review_id") % len(PHRASES) + 1).cast("int"))
    x = r.select("review_id", F.concat(opening, F.lit(" "), F.substring_index("review_text", ".", 1)).alias("review_text"))
    return lx.lexicon_scores(x, common.lexicon(spark, sf, r))


QUERIES = {
    "lexicon_phrases": q_lexicon_phrases,
    "clean_text": q_clean_text,
    "length_filter": q_length_filter,
    "dense_review_id": q_dense_review_id,
    "drop_nulls": q_drop_nulls,
    "label_map": q_label_map,
    "reject_split": q_reject_split,
    "sentence_explode": q_sentence_explode,
    "exact_sample": q_exact_sample,
    "lexicon_score": q_lexicon_score,
    "lexicon_label": q_lexicon_label,
    "mismatch_flag": q_mismatch_flag,
    "mismatch_rate": q_mismatch_rate,
    "label_distribution": q_label_distribution,
    "keyword_aspect": q_keyword_aspect,
    "aspect_lexicon_counts": q_aspect_lexicon_counts,
}

_B = S.BASE
_SENT = S.sentences_cte()
_LEX = S.corpus_lexicon_cte()
_SCORES = S.lexicon_scores_cte("reviews", "review_id", "review_text", carry="sentiment")

ORACLE = {
    "clean_text": f"WITH {S.RAW}, {S.CLEANED} SELECT doc_id, review_text FROM cleaned",
    "length_filter": f"WITH {S.RAW}, {S.CLEANED} SELECT doc_id, review_text FROM cleaned WHERE length(review_text) > 10",
    "dense_review_id": f"WITH {_B} SELECT doc_id, review_id FROM reviews",
    "drop_nulls": f"WITH {_B} SELECT review_id, sentiment FROM reviews WHERE review_text IS NOT NULL AND sentiment IS NOT NULL",
    "label_map": f"""WITH {_B} SELECT review_id, sentiment,
        CAST(CASE sentiment WHEN 'negative' THEN 0 WHEN 'positive' THEN 1 END AS INTEGER) AS label,
        CASE sentiment WHEN 'negative' THEN 'negative' WHEN 'positive' THEN 'positive' END AS label_back FROM reviews""",
    "reject_split": f"""WITH t AS (SELECT doc_id, {S.strip_ws("coalesce(text, '')")} AS x FROM documents)
        SELECT doc_id, CASE WHEN length(x) = 0 THEN 'empty'
          WHEN len(list_filter(list_transform({S.sentence_list('x')}, lambda s: {S.strip_ws('s')}), lambda s: length(s) > 0)) = 0
          THEN 'no_sentences' END AS reject_reason FROM t""",
    "sentence_explode": f"WITH {_B}, {_SENT} SELECT review_id, pos, sentence, review_sentiment FROM sentences",
    "exact_sample": f"""WITH {_B}, {_SENT} SELECT review_id, pos, sentence FROM sentences
        WHERE (SELECT count(*) FROM sentences) <= {SAMPLE_ROWS} OR (review_id, pos) IN (
          SELECT (review_id, pos) FROM sentences
          ORDER BY md5(CAST(review_id AS VARCHAR) || ':' || CAST(pos AS VARCHAR) || ':{d.SAMPLE_SEED}'), review_id, pos
          LIMIT {SAMPLE_ROWS})""",
    "lexicon_phrases": f"""WITH {_B}, {_LEX}, ph AS (SELECT review_id, [{', '.join(S.q(p) for p in PHRASES)}][review_id % {len(PHRASES)} + 1] || ' ' || split_part(review_text, '.', 1) AS review_text
        FROM reviews), {S.lexicon_scores_cte("ph", "review_id", "review_text", name="phs")} SELECT review_id, compound FROM phs""",
    "lexicon_score": f"WITH {_B}, {_LEX}, {_SCORES} SELECT review_id, compound FROM scores",
    "lexicon_label": f"WITH {_B}, {_LEX}, {_SCORES} SELECT review_id, {S.compound_label('compound')} AS vader_label FROM scores",
    "mismatch_flag": f"""WITH {_B}, {_LEX}, {_SCORES} SELECT review_id, sentiment, {S.compound_label('compound')} AS vader_label,
        sentiment IS DISTINCT FROM {S.compound_label('compound')} AS mismatch FROM scores""",
    "mismatch_rate": f"""WITH {_B}, {_LEX}, {_SCORES} SELECT count(*) AS n_reviews,
        round(avg(CAST(sentiment IS DISTINCT FROM {S.compound_label('compound')} AS INTEGER)) * 100, 6) AS mismatch_pct FROM scores""",
    "label_distribution": f"WITH {_B} SELECT sentiment, count(*) AS n FROM reviews WHERE sentiment IS NOT NULL GROUP BY sentiment",
    "keyword_aspect": f"WITH {_B}, {_SENT} SELECT review_id, pos, {S.keyword_aspect('sentence')} AS aspect FROM sentences",
    "aspect_lexicon_counts": f"""WITH {_B}, {_SENT}, {_LEX},
        sa AS (SELECT review_id, pos, sentence, {S.keyword_aspect('sentence', CORPUS_KEYWORDS)} AS aspect FROM sentences),
        {S.lexicon_scores_cte('sa', 'review_id, pos', 'sentence', name='ss', carry='aspect')}
        SELECT aspect, count(*) FILTER (WHERE lbl = 'negative') AS negative,
               count(*) FILTER (WHERE lbl = 'neutral') AS neutral,
               count(*) FILTER (WHERE lbl = 'positive') AS positive, count(*) AS total
        FROM (SELECT aspect, {S.compound_label('compound')} AS lbl FROM ss) GROUP BY aspect""",
}
