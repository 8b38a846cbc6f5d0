"""Queries of mixing (10) and sharding (4) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import maglev, weighted_mix
from .common import documents

SEED = "mix-1"
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def mixed(docs: DataFrame, prefix: str = "", keep=None) -> DataFrame:
    return weighted_mix.mix(docs, weighted_mix.quality_weight(F.col("text")), weighted_mix.word_count(F.col("text")), seed=SEED, prefix=prefix, keep=keep)


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir), keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maglev.place(documents(spark, sf_dir).select("doc_id"), maglev.lookup_table(SHARDS)).select("doc_id", "slot", "shard")


_WORDS = r"[^\x20\x09-\x0D]+"
MIX_SQL = f"""WITH d0 AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS words FROM documents),
    d AS (SELECT doc_id, source, len(words) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(t)) AS same,
                 length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS chars, len(list_distinct(words)) AS different FROM d0),
    q AS (SELECT *, row_number() OVER (PARTITION BY source, same) AS copy,
                 (0.1::DOUBLE + 0.9::DOUBLE * CASE WHEN size > 0 THEN CAST(letters AS DOUBLE) / chars * (CAST(different AS DOUBLE) / size) ELSE 0 END)
                 * ((size + 1.0::DOUBLE) / (size + 20.0::DOUBLE)) AS weight FROM d),
    k AS (SELECT *, -ln((CAST('0x' || substr(md5('{SEED}:' || same || ':' || copy), 1, {weighted_mix.DIGITS}) AS BIGINT) + 0.5::DOUBLE)
                        / {16 ** weighted_mix.DIGITS}::DOUBLE) / weight AS key FROM q),
    s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1.0::DOUBLE AS w FROM d GROUP BY source),
    o AS (SELECT *, 3 * source_size AS cap, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS left_,
                 sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS w_left FROM s
          WINDOW before AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    level AS (SELECT arg_min(left_ / w_left, cap / w) AS l FROM o WHERE left_ / w_left < cap / w),
    t AS (SELECT source, source_size, CASE WHEN left_ / w_left >= cap / w THEN cap ELSE w * l END AS target FROM o, level),
    p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
    x AS (SELECT k.*, p.source_size, p.target, p.epochs, greatest(p.target - p.epochs * p.source_size, 0) AS part,
                 sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.same, k.copy ROWS UNBOUNDED PRECEDING) AS upto
          FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source)
    SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
           CAST((epochs + CASE WHEN size > 0 AND upto - size < part AND (upto <= part OR upto - part <= part - (upto - size)) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM x"""

QUERIES = {"op4_sharding": op4_sharding, "op10_source_mix": op10_source_mix}
ORACLE = {"op10_source_mix": MIX_SQL}   # filling the shard table takes turns: tested against a plain loop
