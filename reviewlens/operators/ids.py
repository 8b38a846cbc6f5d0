"""Exact global ordering without a single-task window.

``dense_id``: a dense 0..n-1 row number in key order. Rows go to range buckets (boundaries from
``approxQuantile`` over the key, so buckets stay balanced even when the key values are skewed); each
bucket is numbered by a window, and a running offset per bucket (one small row per bucket, a bounded
broadcast) is added.

``hash_first_k``: exact seeded selection of the first k rows per group in ``md5(id:seed)`` order.
Rows are counted per (group, hash-prefix bucket); buckets entirely below k or entirely above it are
decided without ordering, so only the one straddling bucket per group is sorted.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_BUCKETS = 20000


def ensure_parallelism(df: DataFrame) -> DataFrame:
    """Spread rows over the cluster when the input arrived in fewer partitions than there are cores
    (for example one un-splittable file). Large inputs already have many splits: no-op."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def repeated_keys(df: DataFrame, key: str, broadcast_max: int = 2_000_000) -> DataFrame | None:
    """(_again): the values of ``key`` (null among them) that are on more than one row; None if there are none. Only keys are shuffled, so that what a
    row holds besides need not be: rows whose key stands alone are finished where they are, the others (``on_key``) meet."""
    again = df.groupBy(F.col(key).alias("_again")).count().where("count > 1").select("_again").checkpoint(eager=True)
    n = again.count()
    return None if not n else F.broadcast(again) if n <= broadcast_max else again


def on_key(df: DataFrame, key: str, again: DataFrame, how: str) -> DataFrame:
    """The rows of ``df`` whose ``key`` is among the keys of ``repeated_keys`` (``how`` left_semi) or is not (left_anti)."""
    return df.join(again, F.col(key).eqNullSafe(F.col("_again")), how)


def dense_id(df: DataFrame, key: str, out: str, key_source: DataFrame | None = None,
             rows_per_bucket: int = 2_000_000, broadcast_max: int = 4_000_000) -> DataFrame:
    """Append ``out`` = position of the row in ``key`` order (0-based, dense). ``key`` must be
    unique, numeric and not null (rows with a null key are lost in the join back, repeated keys multiply).

    Only the key column is numbered: range buckets from ``approxQuantile`` (balanced even when key
    values are skewed), a window per bucket, and a running offset per bucket (one small row per
    bucket). The (key, id) map then joins back to the rows: broadcast when its counted size allows,
    else a shuffle join, so the wide rows keep their own partitioning. ``key_source`` is unused and
    kept for callers that pass a cheaper frame with the same keys.
    """
    keys = df.select(F.col(key))
    n = keys.count()
    n_buckets = int(min(MAX_BUCKETS, max(1, math.ceil(n / rows_per_bucket))))
    splits: list[float] = []
    if n_buckets > 1:
        qs = keys.approxQuantile(key, [i / n_buckets for i in range(1, n_buckets)], 1.0 / (4 * n_buckets))
        splits = sorted(set(q for q in qs if q is not None))
    if splits:
        bucketed = Bucketizer(
            splits=[-math.inf, *splits, math.inf], inputCol="_kd", outputCol="_b", handleInvalid="keep"
        ).transform(keys.withColumn("_kd", F.col(key).cast("double"))).drop("_kd")
        ranked = bucketed.withColumn("_rn", F.row_number().over(Window.partitionBy("_b").orderBy(key)))
        sizes = ranked.groupBy("_b").agg(F.max("_rn").alias("_n"))
        # One row per bucket (at most MAX_BUCKETS): a single small window, then a bounded broadcast.
        offsets = sizes.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_off"))
        ids = ranked.join(F.broadcast(offsets), "_b").select(key, (F.col("_rn") - 1 + F.col("_off")).cast("bigint").alias(out))
    else:
        # At most rows_per_bucket narrow keys: one small window.
        ids = keys.select(key, (F.row_number().over(Window.orderBy(key)) - 1).cast("bigint").alias(out))
    ids = F.broadcast(ids) if n <= broadcast_max else ids
    return df.join(ids, key)


def seeded_hash(id_cols: list[str], seed: int) -> Column:
    """md5 over the id columns and the seed, as lowercase hex; the engine-neutral random order."""
    return F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in id_cols], F.lit(str(seed))))


def hash_first_k(df: DataFrame, id_cols: list[str], seed: int, k_by_group: dict, group_col: str | None,
                 out: str = "_in", hex_digits: int = 3) -> DataFrame:
    """Flag ``out`` = row is among the first k of its group in (md5(ids:seed), ids) order.

    ``k_by_group`` maps group value -> k (use key None when ``group_col`` is None). Groups are few
    (labels), so the per-(group, bucket) count table is bounded by groups x 16**hex_digits rows.
    """
    g = F.col(group_col) if group_col else F.lit(None).cast("string")
    h = seeded_hash(id_cols, seed)
    x = df.withColumn("_g", g).withColumn("_h", h).withColumn(
        "_hb", F.conv(F.substring("_h", 1, hex_digits), 16, 10).cast("int"))
    kdf = df.sparkSession.createDataFrame(
        [(None if k is None else str(k), int(v)) for k, v in k_by_group.items()], "_g string, _k long")
    counts = x.groupBy("_g", "_hb").agg(F.count(F.lit(1)).alias("_n"))
    wb = Window.partitionBy("_g").orderBy("_hb")
    offs = (counts.withColumn("_off", F.sum("_n").over(wb) - F.col("_n"))
            .join(F.broadcast(kdf), counts["_g"].eqNullSafe(kdf["_g"]), "left")
            .select(counts["_g"], "_hb", "_n", "_off", F.coalesce(kdf["_k"], F.lit(0)).alias("_k")))
    j = x.join(F.broadcast(offs), ["_g", "_hb"]) if group_col else x.join(F.broadcast(offs.drop("_g")), "_hb")
    decided = j.where((F.col("_off") + F.col("_n") <= F.col("_k")) | (F.col("_off") >= F.col("_k")))
    decided = decided.withColumn(out, F.col("_off") < F.col("_k"))
    straddle = j.where((F.col("_off") < F.col("_k")) & (F.col("_off") + F.col("_n") > F.col("_k")))
    ws = Window.partitionBy("_g", "_hb").orderBy("_h", *id_cols)
    straddle = straddle.withColumn(out, F.col("_off") + F.row_number().over(ws) <= F.col("_k"))
    cols = [*df.columns, out]
    return decided.select(cols).unionByName(straddle.select(cols))


def largest_remainder(counts: dict, n_draws: int) -> dict:
    """Share n_draws over classes in proportion to their counts: floors first, then one more to the
    classes with the largest remainders (ties: class name ascending). Exact integer arithmetic."""
    total = sum(counts.values())
    if total == 0:
        return {k: 0 for k in counts}
    floors = {k: (n_draws * c) // total for k, c in counts.items()}
    need = n_draws - sum(floors.values())
    order = sorted(counts, key=lambda k: (-((n_draws * counts[k]) % total), str(k)))
    for k in order[:need]:
        floors[k] += 1
    return floors


def running_sum(df: DataFrame, group: str, order: str, value, out: str, span: int = 100_000) -> DataFrame:
    """Adds the running sum of ``value`` within ``group`` in the order of the integer column ``order`` (distinct within a
    group). A group is cut into stretches of ``span`` order values: each is summed on its own and gets the
    total of the stretches before it, so a large group is not one task."""
    x = df.withColumn("_value", value).withColumn("_part", F.floor(F.col(order) / span))
    totals = x.groupBy(group, "_part").agg(F.sum("_value").alias("_total"))
    # one narrow row per stretch
    before = F.coalesce(F.sum("_total").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(F.col(group).alias("_group"), F.col("_part").alias("_at"), before.alias("_before"))
    own = F.sum("_value").over(Window.partitionBy(group, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("_own", own)
    return x.join(totals, x[group].eqNullSafe(totals["_group"]) & (x["_part"] == totals["_at"])) \
        .withColumn(out, F.col("_own") + F.col("_before")).drop("_value", "_part", "_group", "_at", "_before", "_own")
