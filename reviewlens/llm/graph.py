"""Connected components of a link table, by rounds of contraction over stage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def roots(step: DataFrame) -> DataFrame:
    """(node, label) with every label followed to its own label until nothing changes; the paths halve each time. Every label is a node."""
    while True:
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = stage(step.join(jump, "label").select("node", "label", "far"), "labels")
        changed = new.where("far <> label").limit(1).count()
        step = new.select("node", F.col("far").alias("label"))
        if not changed:
            return step


def moved(labels: DataFrame, step: DataFrame) -> DataFrame:
    """The labels after the labels themselves moved by ``step``."""
    to = step.select(F.col("node").alias("label"), F.col("label").alias("to"))
    return labels.join(to, "label", "left").select("node", F.coalesce("to", "label").alias("label"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node reachable, for every node that has an edge. In a round every node goes to the smallest node next to
    it, and on to where that one goes; the edges then join these labels, and the ones inside a label are gone. At least half of the
    nodes that still have edges go in a round, so the edge table shrinks. Only the questions whether something changed reach the driver."""
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    now = stage(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").select(*ordered).distinct(), "edges")
    ways = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("near")), F.struct(F.col("b").alias("node"), F.col("a").alias("near")))
    labels = None
    while True:
        step = now.select(F.inline(ways)).groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("label"))
        step = roots(stage(step, "steps"))
        labels = step if labels is None else stage(moved(labels, step), "labels")
        for end in ("a", "b"):
            now = now.join(step.select(F.col("node").alias(end), F.col("label").alias("to")), end).withColumn(end, F.col("to")).drop("to")
        now = stage(now.where("a <> b").select(*ordered).distinct(), "edges")
        if not now.limit(1).count():
            return labels


def merged(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """The components (node, label) after ``edges`` (a, b) are added to the graph that ``labels`` describes (None: no edges yet). Only
    the new edges take part, between the labels of their ends: an edge that an earlier call has seen is not read again. A node
    not yet in ``labels`` is its own label."""
    if labels is None:
        return components(edges)
    for end in ("a", "b"):
        known = labels.select(F.col("node").alias(end), F.col("label").alias("known"))
        edges = edges.join(known, end, "left").withColumn(end, F.coalesce("known", end)).drop("known")
    step = components(edges)
    return stage(moved(labels, step).unionByName(step.join(labels, "node", "left_anti").select("node", "label")), "labels")
