"""Registered queries for the split, features, classifier and metrics (M1-M17) and their oracles."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from ..operators import features as fe
from ..operators import lexicon as lx
from ..operators import metrics as mt
from ..operators import model as md
from ..operators import text as tt
from ..session import scratch_path
from ..sources import dictionaries as d
from ..sources import io, tables
from . import common
from . import sqlparts as S


LABELLED = ("positive", "negative")     # training rows of a review by label, carried with its counts


def _split(spark, sf, r=None):
    r = r if r is not None else common.reviews(spark, sf)
    lab = tt.drop_nulls(r, ["review_text", "sentiment"]).select("review_id", "review_text", "sentiment")
    return r, fe.stratified_split(lab)


def _fitted(spark, sf, r=None):
    """Split, per-document term counts, vocabulary and idf fitted on the training part."""
    r, sp = _split(spark, sf, r)
    sp = tt.materialize(sp, "split")
    train = F.col("split") == "train"
    of = {name: train & (F.col("sentiment") == name) for name in LABELLED}
    docs = tt.materialize(fe.document_tokens(sp, {"train": F.max(train)} | {n: F.count_if(c) for n, c in of.items()},
                                             alone={"train": train} | {n: c.cast("long") for n, c in of.items()}), "tokens")     # read by the vocabulary and the counts
    vocab = tt.materialize(fe.top_terms(fe.term_totals(docs.where("train"))), "vocabulary")
    # nothing but vocabulary terms is weighted or scored
    counts = tt.materialize(fe.vocabulary_counts(docs, vocab, carry=("train", *LABELLED)), "term_counts")
    train_counts = counts.where("train")
    n_train = sp.where(train).count()
    idf = fe.fit_idf(vocab, n_train)
    return r, sp, counts, train_counts, vocab, idf


def q_stratified_split(spark, sf):
    return _split(spark, sf)[1].select("review_id", "sentiment", "split")


def q_tokenize(spark, sf):
    r = common.reviews(spark, sf)
    x = r.select("review_id", F.explode_outer(fe.tokens()).alias("token")).where(F.col("token").isNotNull())
    return x.groupBy("review_id", "token").agg(F.count(F.lit(1)).alias("n"))


def q_ngrams(spark, sf):
    return fe.term_counts(common.reviews(spark, sf))


def q_vocabulary(spark, sf):
    return _fitted(spark, sf)[4].select("term", "term_index", "df", "tf")


def q_idf(spark, sf):
    return _fitted(spark, sf)[5].select("term", F.round("idf", 6).alias("idf"))


def q_tfidf_l2(spark, sf):
    _, sp, counts, _, _, idf = _fitted(spark, sf)
    return fe.tfidf(counts, idf).select("review_id", "term", F.round("weight", 6).alias("weight"))


def q_class_weights(spark, sf):
    sp = _split(spark, sf)[1]
    cw = fe.class_weights(sp.where(F.col("split") == "train"))
    return cw.select("sentiment", "n", F.round("weight", 6).alias("weight"))


def _ml(spark, sf):
    _, sp, _, _, _, idf = _fitted(spark, sf)
    pipe = md.feature_pipeline(idf)
    feats = md.featurize(sp, pipe)
    model = md.fit_logistic(feats.where(F.col("split") == "train"))
    return sp, idf, feats, model


def q_lr_fit(spark, sf):
    _, idf, _, model = _ml(spark, sf)
    return md.coefficient_table(model, idf).select("term", F.round("coefficient", 4).alias("coefficient"))


def q_lr_predict_ml(spark, sf):
    _, _, feats, model = _ml(spark, sf)
    test = feats.where(F.col("split") == "test")
    return md.ml_predict(model, test).select("review_id", F.col("sentiment").alias("y"), "p")


def q_lr_saved_score(spark, sf):
    """Fit, save the pipeline, load it and score every sentence with the loaded one."""
    _, idf, _, model = _ml(spark, sf)
    path = scratch_path(spark, "lr_model")
    io.save_model(md.scoring_pipeline(idf, model), path)
    s = common.sentences(spark, sf)
    return md.score_texts(s.select("review_id", "pos", "sentence"), PipelineModel.load(path), "sentence").select("review_id", "pos", "p")


def _nb_predictions(spark, sf):
    r, sp, counts, train_counts, vocab, idf = _fitted(spark, sf)
    train_labels = sp.where(F.col("split") == "train").select("review_id", "sentiment")
    coef, b = md.linear_weights(train_counts, train_labels, vocab, labelled=LABELLED)
    test = sp.where(F.col("split") == "test").select("review_id", F.col("sentiment").alias("y"))
    weights = fe.tfidf(counts.join(test.select("review_id"), "review_id", "left_semi"), idf)
    return r, sp, md.linear_predict(weights, coef, b, test)


def q_lr_predict(spark, sf):
    return _nb_predictions(spark, sf)[2].select("review_id", "y", "p")


def _stand_in_predictions(spark, sf):
    """predictions stand-in from labels: y = quality label, p = 'negative' when toxic else 'positive'."""
    lab = tables.table(spark, sf, "labels")
    return lab.select(F.lit("toxic_rule").alias("model_id"), tables.quality_label(F.col("quality")).alias("y"),
                      F.when(F.col("toxic") == 1, F.lit("negative")).otherwise(F.lit("positive")).alias("p"))


def q_accuracy(spark, sf):
    a = mt.accuracy(_stand_in_predictions(spark, sf))
    return a.select("model_id", "n", F.round("accuracy", 6).alias("accuracy"))


def q_classification_report(spark, sf):
    r = mt.classification_report(_stand_in_predictions(spark, sf))
    return r.select("model_id", "class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


def q_confusion_matrix(spark, sf):
    return mt.confusion_matrix(_stand_in_predictions(spark, sf), ["negative", "positive"])


def q_macro_f1(spark, sf):
    return mt.macro_f1(_stand_in_predictions(spark, sf)).select("model_id", F.round("f1_macro", 6).alias("f1_macro"))


def q_logit_argmax(spark, sf):
    e = tables.table(spark, sf, "embeddings")
    return e.select("vec_id", mt.logit_argmax("embedding").alias("pred"), "label")


def q_encode_fixed(spark, sf):
    r = common.reviews(spark, sf)
    vocab = fe.fit_encoder_vocab(r)
    lab = r.where(F.col("sentiment").isNotNull())
    enc = fe.encode_fixed(lab, vocab)
    return enc.join(lab.select("review_id", "sentiment"), "review_id").select(
        "review_id", F.array_join(F.transform("input_ids", lambda x: x.cast("string")), " ").alias("input_ids"),
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_attention"),
        tt.label_to_id(F.col("sentiment")).alias("label"))


def q_udf_score(spark, sf):
    """A user's Python model over all reviews. The model is a word table of at most ``max_features`` terms: the fitted weights in whole thousandths."""
    r, sp, _, train_counts, vocab, _ = _fitted(spark, sf)
    coef, _ = md.linear_weights(train_counts, sp.where(F.col("split") == "train").select("review_id", "sentiment"), vocab, labelled=LABELLED)
    table = {row["term"]: row["w"] for row in coef.select("term", F.round(F.col("coef") * 1000).alias("w")).collect()}
    return md.score_with_model(r, "review_text", lambda: md.LexiconSumModel(table))


def q_model_compare(spark, sf):
    r, sp, nb = _nb_predictions(spark, sf)
    lexl = lx.lexicon_labels(sp.where(F.col("split") == "test").select("review_id", "review_text", "sentiment"),
                             common.lexicon(spark, sf, r))
    pred = nb.select(F.lit("linear_nb").alias("model_id"), "y", "p").unionByName(
        lexl.select(F.lit("lexicon").alias("model_id"), F.col("sentiment").alias("y"), F.col("vader_label").alias("p")))
    c = mt.compare_models(pred)
    return c.select("model_id", F.round("accuracy", 6).alias("accuracy"), F.round("f1_macro", 6).alias("f1_macro"), "best")


QUERIES = {
    "stratified_split": q_stratified_split,
    "tokenize": q_tokenize,
    "ngrams": q_ngrams,
    "vocabulary": q_vocabulary,
    "idf": q_idf,
    "tfidf_l2": q_tfidf_l2,
    "class_weights": q_class_weights,
    "lr_fit": q_lr_fit,
    "lr_predict_ml": q_lr_predict_ml,
    "lr_saved_score": q_lr_saved_score,
    "lr_predict": q_lr_predict,
    "accuracy": q_accuracy,
    "classification_report": q_classification_report,
    "confusion_matrix": q_confusion_matrix,
    "macro_f1": q_macro_f1,
    "logit_argmax": q_logit_argmax,
    "encode_fixed": q_encode_fixed,
    "udf_score": q_udf_score,
    "model_compare": q_model_compare,
}

# ------------------------------------------------------------------------------------------------
# Oracle SQL
# ------------------------------------------------------------------------------------------------

_STOP = S.in_list(d.spark_stop_words())
SPLIT = f"""lab AS (SELECT review_id, review_text, sentiment FROM reviews WHERE review_text IS NOT NULL AND sentiment IS NOT NULL),
cc AS (SELECT sentiment, count(*) AS nc FROM lab GROUP BY 1),
tot AS (SELECT sum(nc) AS n, CAST(sum(nc) - ceil(CAST({d.TEST_SIZE} AS DOUBLE) * sum(nc)) AS BIGINT) AS ntr FROM cc),
alloc AS (SELECT cc.sentiment, cc.nc, (tot.ntr * cc.nc) // tot.n AS fl, (tot.ntr * cc.nc) % tot.n AS rem, tot.ntr FROM cc, tot),
ranked AS (SELECT *, row_number() OVER (ORDER BY rem DESC, sentiment) AS rr, ntr - sum(fl) OVER () AS need FROM alloc),
ktest AS (SELECT sentiment, nc - (fl + CASE WHEN rr <= need THEN 1 ELSE 0 END) AS k_test FROM ranked),
ord AS (SELECT l.*, row_number() OVER (PARTITION BY l.sentiment
          ORDER BY md5(CAST(l.review_id AS VARCHAR) || ':{d.SPLIT_SEED}'), l.review_id) AS rn FROM lab l),
sp AS (SELECT o.review_id, o.review_text, o.sentiment, CASE WHEN o.rn <= k.k_test THEN 'test' ELSE 'train' END AS split
       FROM ord o JOIN ktest k USING (sentiment))"""


def _terms_cte(src: str, name: str = "cnt", ids: str = "review_id", text: str = "review_text") -> str:
    return f"""{name}_tok AS (SELECT {ids}, list_filter({S.word_tokens(text)}, lambda x: x NOT IN {_STOP}) AS t FROM {src}),
{name}_trm AS (SELECT {ids}, list_concat(t, CASE WHEN len(t) >= 2
          THEN list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) ELSE []::VARCHAR[] END) AS terms FROM {name}_tok),
{name} AS (SELECT {ids}, u.term, count(*) AS n FROM {name}_trm, unnest(terms) AS u(term) GROUP BY ALL)"""


def score_cte(name: str, src: str, ids: str = "review_id", text: str = "review_text") -> str:
    """Linear (log-count ratio) model labels for every row of ``src``: (ids, p). Needs FIT and NB.
    Score = b + sum(n*idf*coef) / sqrt(sum((n*idf)^2)), the same as LinearTextModel.predict."""
    on = " AND ".join(f"x.{c.strip()} = sc.{c.strip()}" for c in ids.split(","))
    xids = ", ".join(f"x.{c.strip()}" for c in ids.split(","))
    return f"""{_terms_cte(src, name + '_c', ids, text)},
{name}_w AS (SELECT c.*, c.n * i.idf AS w, k.coef FROM {name}_c c JOIN idf i USING (term) JOIN coef k USING (term)),
{name}_s AS (SELECT {ids}, sum(w * coef) AS dot, sqrt(sum(w * w)) AS nrm FROM {name}_w GROUP BY {ids}),
{name} AS (SELECT {xids}, CASE WHEN ln(CAST(trl.np AS DOUBLE) / CAST(trl.nn AS DOUBLE))
                 + coalesce(CASE WHEN sc.nrm > 0 THEN sc.dot / sc.nrm END, 0.0) > 0
                 THEN 'positive' ELSE 'negative' END AS p
           FROM {src} x LEFT JOIN {name}_s sc ON {on}, trl)"""


FIT = f"""{SPLIT},
{_terms_cte('sp')},
train_cnt AS (SELECT c.* FROM cnt c JOIN sp USING (review_id) WHERE sp.split = 'train'),
vocab AS (SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_index, df, tf FROM (
   SELECT term, count(*) AS df, CAST(sum(n) AS BIGINT) AS tf FROM train_cnt GROUP BY term HAVING count(*) >= {d.MIN_DF}
   ORDER BY tf DESC, term LIMIT {d.MAX_FEATURES})),
ntrain AS (SELECT count(*) AS n FROM sp WHERE split = 'train'),
idf AS (SELECT term, term_index, ln(CAST(1 + n AS DOUBLE) / CAST(1 + df AS DOUBLE)) + 1.0 AS idf FROM vocab, ntrain)"""

TFIDF = """tw AS (SELECT c.review_id, c.term, i.term_index, c.n * i.idf AS w FROM cnt c JOIN idf i USING (term)),
tfidf AS (SELECT review_id, term, term_index, w / sqrt(sum(w * w) OVER (PARTITION BY review_id)) AS weight FROM tw)"""

NB = f"""{TFIDF},
trl AS (SELECT count(*) FILTER (WHERE sentiment = 'positive') AS np, count(*) FILTER (WHERE sentiment = 'negative') AS nn
        FROM sp WHERE split = 'train'),
nbg AS (SELECT c.term, count(*) FILTER (WHERE sp.sentiment = 'positive') AS dp,
               count(*) FILTER (WHERE sp.sentiment = 'negative') AS dn
        FROM train_cnt c JOIN sp USING (review_id) WHERE c.term IN (SELECT term FROM vocab) GROUP BY c.term),
coef AS (SELECT term, ln(CAST(dp + 1 AS DOUBLE) / CAST(np + 2 AS DOUBLE)) - ln(CAST(dn + 1 AS DOUBLE) / CAST(nn + 2 AS DOUBLE)) AS coef
         FROM nbg, trl),
test AS (SELECT review_id, sentiment AS y FROM sp WHERE split = 'test'),
nbs AS (SELECT t.review_id, sum(t.weight * c.coef) AS s FROM tfidf t JOIN coef c USING (term)
        WHERE t.review_id IN (SELECT review_id FROM test) GROUP BY t.review_id),
nbp AS (SELECT test.review_id, test.y,
          CASE WHEN ln(CAST(trl.np AS DOUBLE) / CAST(trl.nn AS DOUBLE)) + coalesce(nbs.s, 0.0) > 0 THEN 'positive' ELSE 'negative' END AS p
        FROM test LEFT JOIN nbs USING (review_id), trl)"""

PRED = f"""pred AS (SELECT 'toxic_rule' AS model_id, {S.label_of_quality('quality')} AS y,
                  CASE WHEN toxic = 1 THEN 'negative' ELSE 'positive' END AS p FROM labels)"""

PER_CLASS = """pc AS (SELECT model_id, y, p, count(*) AS n FROM pred GROUP BY ALL),
cls AS (SELECT DISTINCT model_id, cls AS class FROM (SELECT model_id, y AS cls FROM pc UNION ALL SELECT model_id, p FROM pc) WHERE cls IS NOT NULL),
pcl AS (SELECT c.model_id, c.class,
          coalesce((SELECT sum(n) FROM pc WHERE pc.model_id = c.model_id AND pc.y = c.class AND pc.p = c.class), 0) AS tp,
          coalesce((SELECT sum(n) FROM pc WHERE pc.model_id = c.model_id AND pc.p = c.class), 0) AS n_pred,
          coalesce((SELECT sum(n) FROM pc WHERE pc.model_id = c.model_id AND pc.y = c.class), 0) AS n_true
        FROM cls c),
pcm AS (SELECT *, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS precision,
               CASE WHEN n_true > 0 THEN tp / n_true ELSE 0.0 END AS recall FROM pcl),
pcf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM pcm)"""

_ENC_TOK = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x0B\x{85}\p{Z}\x1C-\x1F]"
ENCODE = f"""enc_tok AS (SELECT review_id, sentiment, regexp_extract_all(lower(review_text), '{_ENC_TOK}') AS t FROM reviews),
enc_vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY df DESC, token) - 1 + {d.FIRST_WORD_ID} AS INTEGER) AS token_id FROM (
   SELECT token, count(*) AS df FROM (SELECT DISTINCT review_id, u.token FROM enc_tok, unnest(t) AS u(token))
   GROUP BY token ORDER BY df DESC, token LIMIT 30000)),
enc_x AS (SELECT e.review_id, u.token, u.i FROM enc_tok e, unnest(list_slice(e.t, 1, {d.ENCODE_LENGTH - 2})) WITH ORDINALITY AS u(token, i)),
enc_ids AS (SELECT x.review_id, x.i, coalesce(v.token_id, {d.UNK_ID}) AS id FROM enc_x x LEFT JOIN enc_vocab v ON v.token = x.token),
enc_agg AS (SELECT review_id, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY i) AS ids, count(*) AS n FROM enc_ids GROUP BY review_id)"""

ORACLE = {
    "udf_score": f"""WITH {S.BASE}, {FIT}, {NB}, ut AS (SELECT r.review_id, u.w FROM reviews r, unnest({S.word_tokens('r.review_text')}) AS u(w)),
        us AS (SELECT ut.review_id, sum(round(c.coef * 1000)) AS s FROM ut JOIN coef c ON c.term = ut.w GROUP BY ut.review_id)
        SELECT r.review_id, CASE WHEN coalesce(us.s, 0) > 0 THEN 'positive' ELSE 'negative' END AS p FROM reviews r LEFT JOIN us USING (review_id)""",
    "stratified_split": f"WITH {S.BASE}, {SPLIT} SELECT review_id, sentiment, split FROM sp",
    "tokenize": f"""WITH {S.BASE}, t AS (SELECT review_id, list_filter({S.word_tokens('review_text')}, lambda x: x NOT IN {_STOP}) AS t FROM reviews)
        SELECT review_id, u.token, count(*) AS n FROM t, unnest(t.t) AS u(token) GROUP BY ALL""",
    "ngrams": f"WITH {S.BASE}, {_terms_cte('reviews')} SELECT review_id, term, n FROM cnt",
    "vocabulary": f"WITH {S.BASE}, {FIT} SELECT term, term_index, df, tf FROM vocab",
    "idf": f"WITH {S.BASE}, {FIT} SELECT term, round(idf, 6) AS idf FROM idf",
    "tfidf_l2": f"WITH {S.BASE}, {FIT}, {TFIDF} SELECT review_id, term, round(weight, 6) AS weight FROM tfidf",
    "class_weights": f"""WITH {S.BASE}, {SPLIT}, c AS (SELECT sentiment, count(*) AS n FROM sp WHERE split = 'train' GROUP BY 1)
        SELECT sentiment, n, round(CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n), 6) AS weight FROM c""",
    "lr_predict": f"WITH {S.BASE}, {FIT}, {NB} SELECT review_id, y, p FROM nbp",
    "accuracy": f"WITH {PRED} SELECT model_id, count(*) AS n, round(avg(CAST(y = p AS INTEGER)), 6) AS accuracy FROM pred GROUP BY model_id",
    "classification_report": f"""WITH {PRED}, {PER_CLASS}
        SELECT model_id, class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(n_true AS BIGINT) AS support FROM pcf
        UNION ALL SELECT model_id, 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(n_true) AS BIGINT) FROM pcf GROUP BY model_id
        UNION ALL SELECT model_id, 'weighted avg', round(sum(precision * n_true) / sum(n_true), 6), round(sum(recall * n_true) / sum(n_true), 6),
                         round(sum(f1 * n_true) / sum(n_true), 6), CAST(sum(n_true) AS BIGINT) FROM pcf GROUP BY model_id""",
    "confusion_matrix": f"""WITH {PRED}, grid AS (SELECT DISTINCT model_id, u.y FROM pred, unnest(['negative', 'positive']) AS u(y))
        SELECT g.model_id, g.y, count(p.p) FILTER (WHERE p.p = 'negative') AS negative, count(p.p) FILTER (WHERE p.p = 'positive') AS positive
        FROM grid g LEFT JOIN pred p ON p.model_id = g.model_id AND p.y = g.y GROUP BY g.model_id, g.y""",
    "macro_f1": f"WITH {PRED}, {PER_CLASS} SELECT model_id, round(avg(f1), 6) AS f1_macro FROM pcf GROUP BY model_id",
    "logit_argmax": """SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS pred, label
        FROM embeddings""",
    "encode_fixed": f"""WITH {S.BASE}, {ENCODE}
        SELECT r.review_id,
          '{d.CLS_ID}' || CASE WHEN coalesce(a.n, 0) > 0 THEN ' ' || a.ids ELSE '' END || ' {d.SEP_ID}'
            || repeat(' {d.PAD_ID}', {d.ENCODE_LENGTH} - 2 - CAST(coalesce(a.n, 0) AS INTEGER)) AS input_ids,
          CAST(coalesce(a.n, 0) + 2 AS INTEGER) AS n_attention,
          CAST(CASE r.sentiment WHEN 'negative' THEN 0 WHEN 'positive' THEN 1 END AS INTEGER) AS label
        FROM reviews r LEFT JOIN enc_agg a USING (review_id) WHERE r.sentiment IS NOT NULL""",
    "model_compare": f"""WITH {S.BASE}, {FIT}, {NB}, {S.corpus_lexicon_cte()},
        tst AS (SELECT review_id, review_text, sentiment FROM sp WHERE split = 'test'),
        {S.lexicon_scores_cte('tst', 'review_id', 'review_text', carry='sentiment')},
        pred AS (SELECT 'linear_nb' AS model_id, y, p FROM nbp
                 UNION ALL SELECT 'lexicon', sentiment, {S.compound_label('compound')} FROM scores),
        {PER_CLASS},
        m AS (SELECT a.model_id, a.accuracy, f.f1_macro FROM
              (SELECT model_id, avg(CAST(y = p AS INTEGER)) AS accuracy FROM pred GROUP BY 1) a
              JOIN (SELECT model_id, avg(f1) AS f1_macro FROM pcf GROUP BY 1) f USING (model_id))
        SELECT model_id, round(accuracy, 6) AS accuracy, round(f1_macro, 6) AS f1_macro,
               row_number() OVER (ORDER BY f1_macro DESC, model_id) = 1 AS best FROM m""",
}
