"""Query of the WARC writer and salvage reader (13) and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import warc_salvage
from .common import stage_path
from ..sources import tables


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage_path(spark, "warc")
    warc_salvage.write(warc_salvage.plan(tables.table(spark, sf_dir, "pages")), path)
    return warc_salvage.page_rows(warc_salvage.read(spark, path, payload=False))


_DIGIT = " || ".join(f"substr('{warc_salvage.BASE32}', CAST((v >> {s}) & 31 AS BIGINT) + 1, 1)" for s in (15, 10, 5, 0))
WARC_SQL = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
    f AS (SELECT page_id, payload, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
    SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes,
           array_to_string(list_transform(list_transform(range(8), lambda i: CAST('0x' || substr(sha1(payload), CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT)),
                                          lambda v: {_DIGIT}), '') AS payload_digest,
           CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN first END AS refers_to FROM f"""

QUERIES = {"op13_warc": op13_warc}
ORACLE = {"op13_warc": WARC_SQL}
