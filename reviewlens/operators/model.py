"""Classifier: ML feature pipeline, weighted L2 logistic regression, scoring (M6 ML form, M8, M9, M16).

The fitted vocabulary has at most max_features terms, so it (and the idf vector) is collected once and
shipped inside the ML stages.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import dictionaries as d
from . import features as fe

# model classes given to Python workers, which need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def feature_pipeline(idf: DataFrame, text_col: str = "review_text") -> PipelineModel:
    """Fitted TF-IDF + L2 pipeline from the vocabulary/idf table (term, term_index, idf)."""
    rows = idf.orderBy("term_index").select("term", "idf").collect()   # <= max_features rows
    vocab = [r["term"] for r in rows]
    cv = CountVectorizerModel.from_vocabulary(vocab, inputCol="_terms", outputCol="_tf")
    ep = ElementwiseProduct(scalingVec=Vectors.dense([float(r["idf"]) for r in rows]), inputCol="_tf", outputCol="_tfidf")
    nm = Normalizer(p=2.0, inputCol="_tfidf", outputCol="features")
    return PipelineModel(stages=[cv, ep, nm])


def featurize(df: DataFrame, pipe: PipelineModel, text_col: str = "review_text") -> DataFrame:
    return pipe.transform(fe.with_terms(df, text_col, "_terms")).drop("_terms", "_tf", "_tfidf")


def fit_logistic(train: DataFrame, label_col: str = "sentiment", max_iter: int = d.MAX_ITER, c: float = 1.0):
    """M8: class-balanced L2 logistic regression. With weights w_i the objective
    C * sum w_i loss_i + ||b||^2 / 2 equals Spark's mean-loss form with regParam = 1 / (C * sum w_i),
    no standardisation, intercept not penalised."""
    cw = fe.class_weights(train, label_col)
    x = train.join(F.broadcast(cw.select(label_col, "weight")), label_col) \
        .withColumn("label", F.when(F.col(label_col) == "positive", 1.0).otherwise(0.0))
    sum_w = x.agg(F.sum("weight")).first()[0]
    lr = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight",
                            regParam=1.0 / (c * sum_w), elasticNetParam=0.0, standardization=False,
                            maxIter=max_iter, tol=1e-6, fitIntercept=True)
    return lr.fit(x)


def coefficient_table(model, idf: DataFrame) -> DataFrame:
    """(term, coefficient) for every vocabulary term plus the '__intercept__' row."""
    spark = idf.sparkSession
    coef = model.coefficients.toArray().tolist()
    terms = [r["term"] for r in idf.orderBy("term_index").select("term").collect()]
    rows = list(zip(terms, coef)) + [("__intercept__", float(model.intercept))]
    return spark.createDataFrame(rows, "term string, coefficient double")


def linear_weights(counts_train: DataFrame, labels: DataFrame, vocab: DataFrame, id_col: str = "review_id",
                   label_col: str = "sentiment", labelled: tuple[str, str] | None = None) -> tuple[DataFrame, float]:
    """A fixed linear model from document counts (log-count ratio per term, log prior as intercept),
    used where scoring must be checkable in SQL. Returns (term, coef) and the intercept. ``labelled``: the columns of ``counts_train`` that say how
    many positive and negative rows of ``labels`` its id has, if it carries them; the counts are then not joined with the labels."""
    n = {r[label_col]: int(r["n"]) for r in labels.groupBy(label_col).agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = n.get("positive", 0), n.get("negative", 0)
    x = counts_train.join(F.broadcast(vocab.select("term")), "term", "left_semi")
    if labelled:
        g = x.groupBy("term").agg(F.sum(labelled[0]).alias("dp"), F.sum(labelled[1]).alias("dn"))
    else:
        g = x.join(labels, id_col).groupBy("term").agg(F.count_if(F.col(label_col) == "positive").alias("dp"),
                                                       F.count_if(F.col(label_col) == "negative").alias("dn"))
    coef = (F.log((F.col("dp") + 1.0) / F.lit(n_pos + 2.0)) - F.log((F.col("dn") + 1.0) / F.lit(n_neg + 2.0)))
    import math
    b = math.log(n_pos / n_neg) if n_pos and n_neg else 0.0
    return g.select("term", coef.alias("coef")), b


def linear_predict(weights_long: DataFrame, coef: DataFrame, intercept: float, docs: DataFrame,
                   id_col="review_id") -> DataFrame:
    """M9 (SQL form): label = positive when intercept + sum(weight * coef) > 0. ``docs`` lists the
    documents to score (those with no vocabulary term score the intercept)."""
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    s = weights_long.join(F.broadcast(coef), "term").groupBy(*ids).agg(F.sum(F.col("weight") * F.col("coef")).alias("_s"))
    score = F.lit(intercept) + F.coalesce(F.col("_s"), F.lit(0.0))
    return docs.join(s, ids, "left").withColumn("score", score) \
        .withColumn("p", F.when(F.col("score") > 0, F.lit("positive")).otherwise(F.lit("negative"))).drop("_s")


def ml_predict(model, featurized: DataFrame) -> DataFrame:
    """M9 (ML form): the fitted model's transform, label names from the prediction index."""
    out = model.transform(featurized)
    return out.withColumn("p", F.when(F.col("prediction") == 1.0, F.lit("positive")).otherwise(F.lit("negative")))


def scoring_pipeline(idf: DataFrame, model) -> PipelineModel:
    """Terms to label index in one pipeline that can be saved and loaded."""
    return PipelineModel(stages=[*feature_pipeline(idf).stages, model])


def score_texts(df: DataFrame, pipe: PipelineModel, text_col: str, out: str = "p") -> DataFrame:
    """M9 with a loaded pipeline: the rows of ``df`` with a label, no shuffle."""
    x = pipe.transform(fe.with_terms(df, text_col, "_terms"))
    return x.select(*df.columns, F.when(F.col("prediction") == 1.0, F.lit("positive")).otherwise(F.lit("negative")).alias(out))


def score_with_model(df: DataFrame, text_col: str, model_factory, out_col: str = "p", id_col: str = "review_id") -> DataFrame:
    """Score texts with a user-supplied Python model. ``model_factory()`` runs once per task
    (Arrow batches through ``mapInPandas``) and returns an object with ``predict(list[str]) -> list[str]``."""
    schema = f"{id_col} long, {out_col} string"

    def run(batches):
        import pandas as pd

        model = model_factory()
        for b in batches:
            yield pd.DataFrame({id_col: b[id_col].astype("int64"),
                                out_col: list(model.predict(b[text_col].fillna("").tolist()))})

    return df.select(id_col, text_col).mapInPandas(run, schema)


class LexiconSumModel:
    """A small numpy stand-in for a user model: positive when the summed word valences are > 0."""

    def __init__(self, table: dict):
        self.table = table

    def predict(self, texts):
        import re

        import numpy as np

        out = []
        for t in texts:
            words = re.findall(r"\w\w+", t.lower())
            s = float(np.sum([self.table.get(w, 0.0) for w in words])) if words else 0.0
            out.append("positive" if s > 0 else "negative")
        return out
