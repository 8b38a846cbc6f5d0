"""Model-quality tables from a predictions table (model_id, y, p) (M10-M14, M17). All aggregation is
over the tiny (model, y, p) count table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _pair_counts(pred: DataFrame) -> DataFrame:
    return pred.groupBy("model_id", "y", "p").agg(F.count(F.lit(1)).alias("n"))


def per_class(pred: DataFrame) -> DataFrame:
    """(model_id, class, tp, n_pred, n_true, precision, recall, f1); classes = labels seen in y or p;
    undefined ratios are 0."""
    pc = _pair_counts(pred)
    classes = pc.select("model_id", F.col("y").alias("class")).union(pc.select("model_id", F.col("p"))) \
        .where(F.col("class").isNotNull()).distinct()
    tp = pc.where(F.col("y") == F.col("p")).select("model_id", F.col("y").alias("class"), F.col("n").alias("tp"))
    npred = pc.groupBy("model_id", F.col("p").alias("class")).agg(F.sum("n").alias("n_pred"))
    ntrue = pc.groupBy("model_id", F.col("y").alias("class")).agg(F.sum("n").alias("n_true"))
    x = classes.join(tp, ["model_id", "class"], "left").join(npred, ["model_id", "class"], "left") \
        .join(ntrue, ["model_id", "class"], "left").na.fill(0, ["tp", "n_pred", "n_true"])
    prec = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(F.lit(0.0))
    rec = F.when(F.col("n_true") > 0, F.col("tp") / F.col("n_true")).otherwise(F.lit(0.0))
    x = x.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return x.withColumn("f1", f1)


def accuracy(pred: DataFrame) -> DataFrame:
    """M10."""
    return pred.groupBy("model_id").agg(F.count(F.lit(1)).alias("n"),
                                        F.avg((F.col("y") == F.col("p")).cast("int")).alias("accuracy"))


def classification_report(pred: DataFrame) -> DataFrame:
    """Per class precision / recall / f1 / support, then 'macro avg' and 'weighted avg'."""
    pc = per_class(pred)
    rows = pc.select("model_id", "class", "precision", "recall", "f1", F.col("n_true").alias("support"))
    macro = pc.groupBy("model_id").agg(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"),
                                       F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
                                       F.sum("n_true").alias("support"))
    wsum = F.sum("n_true")
    weighted = pc.groupBy("model_id").agg(
        F.lit("weighted avg").alias("class"),
        (F.sum(F.col("precision") * F.col("n_true")) / wsum).alias("precision"),
        (F.sum(F.col("recall") * F.col("n_true")) / wsum).alias("recall"),
        (F.sum(F.col("f1") * F.col("n_true")) / wsum).alias("f1"), wsum.alias("support"))
    return rows.unionByName(macro).unionByName(weighted)


def macro_f1(pred: DataFrame) -> DataFrame:
    """Unweighted mean of per-class F1 over the labels seen in y or p."""
    return per_class(pred).groupBy("model_id").agg(F.avg("f1").alias("f1_macro"))


def confusion_matrix(pred: DataFrame, labels: list[str]) -> DataFrame:
    """rows = truth, one column per predicted label (sorted), zeros filled; every label in
    ``labels`` has a row even when it never occurs as truth."""
    labels = sorted(labels)
    wide = pred.groupBy("model_id", "y").pivot("p", labels).agg(F.count(F.lit(1)))
    grid = pred.select("model_id").distinct().select("model_id", F.explode(F.array(*[F.lit(x) for x in labels])).alias("y"))
    return grid.join(wide, ["model_id", "y"], "left").na.fill(0, labels)


def logit_argmax(c) -> F.Column:
    """Index of the largest logit, first one on ties."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")


def compare_models(pred: DataFrame) -> DataFrame:
    """Accuracy and macro F1 per model on one held-out set; ``best`` marks the highest macro F1
    (ties: model_id ascending)."""
    m = accuracy(pred).join(macro_f1(pred), "model_id")
    r = F.row_number().over(Window.orderBy(F.desc("f1_macro"), "model_id"))
    return m.withColumn("best", r == 1)
