"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a word budget by its weight, at most ``max_epochs`` times its own words; what exceeds that is
shared again by weight. A source whose budget covers it k times is taken k times in full; the rest of the
budget goes to documents in the order of exponential keys -ln(u) / w, where w is the document's quality weight and u a hash of its id, its
text and its number among equal rows, until the words are used up. Rows without an id, or with a repeated one, so have keys of
their own, and so has each of the copies of one row. Which of the copies comes in is no difference: reruns draw the same rows.

No source is sorted as a whole: keys fall into value ranges, ranges before the budget's end are taken unseen, and
only the one range per source in which it ends is sorted. Equal rows are numbered per partition and by the counts of the partitions before,
so copies that make up a third of all rows are not one task.

Defined cases: a null text has no words and is never in the part beyond complete epochs; a null id counts as an empty one; null is a
source of its own; sources are a list that people keep (one narrow row each goes through a window).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

DIGITS = 13   # hex digits of the id's MD5 that make u: 52 bits, exact in a double


def word_count(text) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def uniform(parts, seed: str) -> Column:
    """A number inside (0, 1) from the MD5 of ``seed:part:part``; a null part counts as an empty one."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16 ** DIGITS)


def quality_weight(text) -> Column:
    """A quality score in (0, 1]: the share of letters among the characters that are no space, times the share of words that are different, damped
    for short texts. Symbols, digits, repetition and stubs lower it; each document keeps at least a tenth of the first two."""
    t = F.coalesce(text, F.lit(""))
    chars = F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]", ""))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    n = word_count(text)
    different = F.size(F.array_distinct(F.regexp_extract_all(t, F.lit(r"[^\x20\x09-\x0D]+"), 0)))
    share = F.when(n > 0, letters.cast("double") / chars * (different.cast("double") / n)).otherwise(0.0)
    return (0.1 + 0.9 * share) * ((n + 1.0) / (n + 20.0))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (uid, source, same, ...) with ``copy``: the number, from 1, among a source's rows with equal ``same``. ``uid`` is a stage table's row number, its
    upper bits name a partition; a partition's copies are numbered on their own and follow those of the partitions before."""
    r = rows.withColumn("_p", F.shiftrightunsigned("uid", 33))
    own = F.row_number().over(Window.partitionBy("source", "same", "_p").orderBy("uid"))
    n = r.groupBy("source", "same", "_p").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("source", "same").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    # a first partition's copies, nearly all rows, need no offset
    offset = n.withColumn("off", before).where("off is not null") \
        .select(F.col("source").alias("_o"), F.col("same").alias("_s"), F.col("_p").alias("_q"), "off").hint("shuffle_hash")
    return r.withColumn("own", own).join(offset, F.col("source").eqNullSafe(F.col("_o")) & (F.col("same") == F.col("_s")) & (F.col("_p") == F.col("_q")), "left") \
        .withColumn("copy", F.col("own") + F.coalesce("off", F.lit(0))).drop("own", "off", "_o", "_s", "_q", "_p")


def targets(per_source: DataFrame, weights=(1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """(source, source_size) -> adds ``target``. One narrow row per source: sources are a list that people keep.

    Sources at their ceiling are those with the smallest ceiling per weight; the others share what is left by weight.
    So with sources in that order, source i is at its ceiling exactly if what remains before it, divided by the weights
    not served yet, is no less than its own ceiling per weight."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = per_source.withColumn("w", listed).withColumn("cap", F.col("source_size") * float(max_epochs))
    by_ratio = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    upto, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) \
        .withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(upto), F.lit(0.0))) \
        .withColumn("capped", F.col("left") / F.col("w_left") >= F.col("cap") / F.col("w"))
    first_level = F.first(F.when(~F.col("capped"), F.col("left") / F.col("w_left")), ignorenulls=True).over(
        by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return s.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("w") * first_level)) \
        .select("source", "source_size", "target")


def mix(docs: DataFrame, weight: Column, size: Column, weights=(1, 2, 3), max_epochs: int = 3, seed: str = "mix-1",
        ranges: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", prefix: str = "", keep=None) -> DataFrame:
    """``docs`` with size, source_size, target, copies (how often the mix takes the document) and taken (words), each name
    led by ``prefix``. Columns of ``docs`` with these names are replaced; ``keep`` names the columns to return (all).

    Rows are written once with a row number, and the decision is made on narrow rows. A source's part ends at the document that brings it
    closer to its target."""
    names = [prefix + c for c in ("size", "source_size", "target", "copies", "taken")]
    out = [c for c in (docs.columns if keep is None else keep) if c not in names]
    # the row's own columns travel inside one struct, so no name of theirs can clash
    row = F.struct(*[F.col(c) for c in out]) if out else F.lit(None).cast("int")
    same = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).cast("binary"))
    d = stage(docs.select(row.alias("row"), F.col(source_col).alias("source"), F.col(id_col).cast("string").alias("id"), same.alias("same"), size.alias("size"),
                          weight.alias("w"), F.monotonically_increasing_id().alias("uid")), "mix-rows")
    if ranges is None:
        ranges = max(1024, d.count() // 50_000)   # keeps the sorted range at some ten thousand rows
    n = numbered(d.select("uid", "source", "id", "same", "size", "w")).withColumn("key", -F.log(uniform([F.col("same"), F.col("copy")], seed)) / F.col("w"))
    # keys of weight 1 are exponential; of smaller weights they are larger, so a share of the key itself deals them into ranges
    n = stage(n.withColumn("range", F.least(F.floor(F.col("key") / (F.col("key") + 3.0) * ranges), F.lit(ranges - 1)).cast("int")).drop("w"), "mix-keys")
    per_range = stage(n.groupBy("source", "range").agg(F.sum("size").alias("words")), "mix-ranges")
    per_source = per_range.groupBy("source").agg(F.sum("words").alias("source_size"))
    plan = targets(per_source, weights, max_epochs) \
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")) \
        .withColumn("part", F.greatest(F.col("target") - F.col("epochs") * F.col("source_size"), F.lit(0.0))).withColumnRenamed("source", "p_source")
    plan = stage(plan, "mix-plan")
    # the range in which the part ends: at most ``ranges`` narrow rows per source
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("range"))
    ends = per_range.withColumn("before", upto - F.col("words")).withColumn("upto", upto) \
        .join(plan.select("p_source", "part"), F.col("source").eqNullSafe(F.col("p_source"))) \
        .where((F.col("before") <= F.col("part")) & (F.col("upto") > F.col("part"))).select("p_source", F.col("range").alias("end_range"), "before", "part")
    ends = stage(ends, "mix-ends")
    # only that range's rows are sorted
    inside = n.where("size > 0").join(ends, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("range") == F.col("end_range")))
    w = Window.partitionBy("source").orderBy("key", "same", "copy").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("end", F.col("before") + F.sum("size").over(w))
    begin = F.col("end") - F.col("size")
    # the document in which the part ends comes in if that is closer
    comes = (begin < F.col("part")) & ((F.col("end") <= F.col("part")) | (F.col("end") - F.col("part") <= F.col("part") - begin))
    taken_inside = inside.where(comes).select("uid")
    e = ends.select(F.col("p_source").alias("e_source"), "end_range")
    whole = n.join(e, F.col("source").eqNullSafe(F.col("e_source")) & (F.col("range") < F.col("end_range"))).where("size > 0").select("uid")
    chosen = taken_inside.unionByName(whole).select(F.col("uid").alias("c_uid")).hint("shuffle_hash")
    x = d.join(chosen, F.col("uid") == F.col("c_uid"), "left").join(plan, F.col("source").eqNullSafe(F.col("p_source")))
    copies = F.col("epochs") + F.col("c_uid").isNotNull().cast("long")
    numbers = (F.col("size"), F.col("source_size"), F.col("target"), copies, copies * F.col("size"))
    return x.select(*[F.col("row")[c].alias(c) for c in out], *[v.alias(k) for k, v in zip(names, numbers)])
