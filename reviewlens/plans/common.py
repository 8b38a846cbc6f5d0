"""Shared building blocks for the registered queries: every query starts from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lexicon as lx
from ..operators import text as tt
from ..sources import tables


def reviews(spark: SparkSession, sf_dir: str, extra=()) -> DataFrame:
    """Cleaned, filtered reviews with dense review_id (C5-C9) from documents LEFT JOIN labels; ``extra``: columns of the documents to carry."""
    raw = tables.raw_reviews(spark, sf_dir, extra)
    key_source = tables.table(spark, sf_dir, "documents").select("doc_id")
    return tt.prepare_reviews(raw, key="doc_id", key_source=key_source)


def lexicon(spark: SparkSession, sf_dir: str, revs: DataFrame | None = None) -> DataFrame:
    """Test lexicon: induced from the labelled reviews plus the hand seed (see corpus_lexicon)."""
    return lx.corpus_lexicon(revs if revs is not None else reviews(spark, sf_dir))


def sentences(spark: SparkSession, sf_dir: str, revs: DataFrame | None = None) -> DataFrame:
    return tt.sentence_table(revs if revs is not None else reviews(spark, sf_dir))
