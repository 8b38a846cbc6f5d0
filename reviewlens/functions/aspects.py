"""Keyword aspect expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.dictionaries import API_ASPECT_KEYWORDS, DEFAULT_ASPECT


def keyword_aspect(c, table=API_ASPECT_KEYWORDS, default: str = DEFAULT_ASPECT) -> Column:
    """First aspect (in table order) with a keyword that is a substring of the lower-cased text."""
    low = F.lower(F.col(c) if isinstance(c, str) else c)
    expr = None
    for aspect, kws in table:
        cond = None
        for k in kws:
            cond = low.contains(k) if cond is None else (cond | low.contains(k))
        expr = F.when(cond, F.lit(aspect)) if expr is None else expr.when(cond, F.lit(aspect))
    return expr.otherwise(F.lit(default)) if expr is not None else F.lit(default)
