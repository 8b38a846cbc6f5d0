"""Rule-based lexicon sentiment (V1-V5), following the published method (Hutto & Gilbert 2014).

Plan: words are computed per review as an array; each word travels with its three predecessors
(array indexing, no shuffle); the exploded narrow rows probe a broadcast lexicon (size checked), get
their modified valence row-locally, and are summed per review with a partial aggregate before the
only shuffle, so the shuffle carries one row per review and partition. Text never leaves its task.

Implemented rules: lexicon valence; all-caps emphasis when only some words are all caps; boosters
and dampeners in the three preceding words (damped 0.95 / 0.9 at distance 2 / 3) and negation in
each of them, both only when that word is not itself in the lexicon; 'but' (x0.5 before, x1.5
after); '!' (at most 4) and '?' emphasis; normalisation s / sqrt(s^2 + 15).

Phrases are looked up on the word slices around a lexicon word, in its row: idioms of two or three words (the longest
match, then the leftmost) set the valence of the lexicon words in them; a phrase such as 'kind of' within the three
preceding words dampens by its sign, and its own 'kind' counts nothing; 'never so' and 'never this' strengthen and
'without doubt' does not negate; 'least' negates unless after 'at' or 'very'. Not implemented: emoji.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources import dictionaries as d

BROADCAST_MAX_ROWS = 2_000_000


def seed_lexicon(spark) -> DataFrame:
    return spark.createDataFrame(d.SEED_LEXICON, "token string, valence double")


def sized_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast a lookup table only after checking its row count; large tables join by shuffle. The table is
    checkpointed first, so the count and the join read it and do not compute it again."""
    df = df.checkpoint(eager=True)
    return F.broadcast(df) if df.count() <= max_rows else df


def _booster(lw: Column, up, down) -> Column:
    return (F.when(lw.isin(*up), F.lit(d.BOOST_INCR))
            .when(lw.isin(*down), F.lit(d.BOOST_DECR)).otherwise(F.lit(0.0)))


def _negated(lw: Column, negations) -> Column:
    return lw.isin(*negations) | lw.contains("n't")


def _phrase_values(phrases, words) -> Column:
    """The value of the first of the word sequences in ``words`` that the phrase table holds, null without one."""
    table = F.create_map(*[F.lit(x) for phrase, value in phrases for x in (phrase, float(value))])
    return F.coalesce(*[F.try_element_at(table, F.when(F.size(F.array_compact(F.array(*w))) == len(w), F.concat_ws(" ", *w))) for w in words])


def _around_never(k: int) -> tuple[Column, Column]:
    """('never so/this', 'without doubt') whose first word is ``k`` places before."""
    between = [F.col(f"l{j}") for j in range(1, k)]
    after = lambda values: F.coalesce(F.greatest(*[F.coalesce(b.isin(*values), F.lit(False)) for b in between], F.lit(False)), F.lit(False))
    if k == 1:
        return F.lit(False), F.lit(False)
    return (F.col(f"l{k}") == "never") & after(d.NEVER_WORDS), (F.col(f"l{k}") == "without") & after(["doubt"])


def lexicon_scores(df: DataFrame, lexicon: DataFrame, id_col="review_id", text_col: str = "review_text",
                   carry: tuple[str, ...] = (), boosters_up=d.BOOSTERS_UP, boosters_down=d.BOOSTERS_DOWN,
                   negations=d.NEGATIONS, idioms=d.IDIOMS, phrase_dampeners=d.PHRASE_DAMPENERS) -> DataFrame:
    """V1: one row per input row: (id, *carry, compound), compound rounded to 4 decimals.

    ``carry`` names narrow per-row columns to keep (they ride through the aggregate); the input is
    read once. ``id_col`` is a column name or a list of them.
    """
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    lex = lexicon.select(F.lower("token").alias("_t"), F.col("valence").cast("double").alias("_v")) \
        .groupBy("_t").agg(F.max("_v").alias("_v"))
    # The lexicon is a small lookup table probed four times: cut its lineage once (reliable
    # checkpoint in the shared checkpoint folder) so the probes do not re-plan its source.
    lex = sized_broadcast(lex)
    base = df.select(*ids, *carry, tx.lexicon_words(text_col).alias("_w"),
                     tx.count_char(text_col, "!").alias("_ex"), tx.count_char(text_col, "?").alias("_qm"))
    n_caps = F.size(F.filter("_w", tx.is_upper))
    w = F.col("_w")
    n = F.size(w)

    def shifted(k):  # the word k places earlier, null for the first k words
        nulls = F.array_repeat(F.lit(None).cast("string"), F.least(F.lit(k), n))
        return F.concat(nulls, F.slice(w, 1, F.greatest(n - k, F.lit(0))))

    # the next two words: a slice past the end is shorter, and zipping fills it with nulls
    later = [F.slice(w, k + 1, n).alias(f"f{k}") for k in (1, 2)]
    items = F.arrays_zip(F.sequence(F.lit(0), n - 1).alias("_pos"), w.alias("w0"), shifted(1).alias("w1"),
                         shifted(2).alias("w2"), shifted(3).alias("w3"), *later)
    items = F.when(n > 0, items).otherwise(F.array().cast(
        "array<struct<_pos:int,w0:string,w1:string,w2:string,w3:string,f1:string,f2:string>>"))
    # A sentinel item (pos -1, no word) keeps every review in the aggregate, even with no hit.
    sentinel = F.array(F.struct(F.lit(-1).alias("_pos"), *[F.lit(None).cast("string").alias(c) for c in ("w0", "w1", "w2", "w3", "f1", "f2")]))
    base = base.select(
        *ids, *carry, "_ex", "_qm",
        ((n_caps > 0) & (n_caps < n)).alias("_capdiff"),
        F.array_position(F.transform("_w", F.lower), "but").alias("_but"),
        F.concat(sentinel, items).alias("_items"))
    # explode_outer: the array is never empty, and the outer form avoids an inferred pre-filter
    # that would evaluate the array expression twice.
    rows = base.select(*ids, *carry, "_ex", "_qm", "_capdiff", "_but", F.explode_outer("_items").alias("it")).select(
        *ids, *carry, "_ex", "_qm", "_capdiff", "_but", "it._pos",
        *[F.col(f"it.w{k}").alias(f"w{k}") for k in range(4)],
        *[F.lower(F.col(f"it.w{k}")).alias(f"l{k}") for k in range(4)], *[F.lower(F.col(f"it.f{k}")).alias(f"f{k}") for k in (1, 2)])
    # Only words in the lexicon carry valence: the rest are dropped before any other work.
    rows = rows.join(lex, rows["l0"] == lex["_t"], "left").drop("_t") \
        .where(F.col("_v").isNotNull() | (F.col("_pos") == -1))
    mods = list(boosters_up) + list(boosters_down) + list(negations) + ["least"]
    for k in (1, 2, 3):
        # A neighbour's own lexicon membership matters only when it is a booster or a negation.
        key = F.when(F.col(f"l{k}").isin(*mods) | F.col(f"l{k}").contains("n't"), F.col(f"l{k}"))
        probe = lex.select(F.col("_t").alias(f"_t{k}"), F.lit(True).alias(f"_in{k}"))
        rows = rows.withColumn(f"_key{k}", key).join(probe, F.col(f"_key{k}") == F.col(f"_t{k}"), "left") \
            .drop(f"_t{k}", f"_key{k}")
    capd = F.col("_capdiff")
    v = F.col("_v")
    rows = rows.withColumn("_v", F.when(capd & tx.is_upper(F.col("w0")),
                                        F.when(v > 0, v + d.CAPS_INCR).otherwise(v - d.CAPS_INCR)).otherwise(v))
    for k, damp in ((1, 1.0), (2, d.DAMP_2), (3, d.DAMP_3)):
        # One column per step: each step reads the valence left by the previous one.
        wk, lk = F.col(f"w{k}"), F.col(f"l{k}")
        s = _booster(lk, boosters_up, boosters_down)
        s = F.when(s != 0, F.when(v < 0, -s).otherwise(s)).otherwise(s)
        s = F.when((s != 0) & tx.is_upper(wk) & capd,
                   F.when(v > 0, s + d.CAPS_INCR).otherwise(s - d.CAPS_INCR)).otherwise(s)
        rows = rows.withColumn("_s", s * F.lit(damp))
        never, doubt = _around_never(k)
        v_new = F.when(never, (v + F.col("_s")) * d.NEVER_SCALAR) \
            .when(_negated(lk, negations) & ~doubt, (v + F.col("_s")) * d.NEGATION_SCALAR).otherwise(v + F.col("_s"))
        rows = rows.withColumn("_v", F.when(wk.isNotNull() & F.col(f"_in{k}").isNull(), v_new).otherwise(v))
    if idioms:
        own = [("l2", "l1", "l0"), ("l1", "l0", "f1"), ("l0", "f1", "f2"), ("l1", "l0"), ("l0", "f1")]
        rows = rows.withColumn("_v", F.coalesce(_phrase_values(idioms, own), F.col("_v")))
    damped = _phrase_values([(p, 1.0) for p in phrase_dampeners], [("l3", "l2"), ("l2", "l1")]) if phrase_dampeners else F.lit(None)
    rows = rows.withColumn("_v", F.when(damped.isNull() | (F.col("_v") == 0), F.col("_v"))
                           .otherwise(F.col("_v") + F.when(F.col("_v") > 0, F.lit(d.BOOST_DECR)).otherwise(F.lit(-d.BOOST_DECR))))
    least = (F.col("l1") == "least") & F.col("_in1").isNull() & ~F.coalesce(F.col("l2").isin(*d.LEAST_KEEPS), F.lit(False))
    rows = rows.withColumn("_v", F.when(F.coalesce(least, F.lit(False)), F.col("_v") * d.NEGATION_SCALAR).otherwise(F.col("_v")))
    opens = _phrase_values([(p, 1.0) for p in phrase_dampeners], [("l0", "f1")]).isNotNull() if phrase_dampeners else F.lit(False)
    v = F.when(F.col("l0").isin(*boosters_up, *boosters_down) | opens, F.lit(0.0)).otherwise(F.col("_v"))
    but = F.col("_but")
    factor = (F.when(but == 0, F.lit(1.0)).when(F.col("_pos") + 1 < but, F.lit(d.BUT_BEFORE))
              .when(F.col("_pos") + 1 > but, F.lit(d.BUT_AFTER)).otherwise(F.lit(1.0)))
    # Per-row columns are functions of the id, so they group along (hash aggregate, no sort).
    agg = rows.groupBy(*ids, *carry, "_ex", "_qm").agg(F.sum(F.coalesce(v * factor, F.lit(0.0))).alias("_s"))
    # Summation order differs between engines and runs; rounding keeps exact cancellations at zero.
    s, qm = F.round(F.col("_s"), 10), F.col("_qm")
    punct = (F.least(F.col("_ex"), F.lit(d.EXCLAIM_MAX)) * d.EXCLAIM_INCR
             + F.when(qm > 1, F.when(qm <= 3, qm * d.QUESTION_INCR).otherwise(F.lit(d.QUESTION_CAP))).otherwise(0.0))
    s2 = F.when(s > 0, s + punct).when(s < 0, s - punct).otherwise(s)
    comp = s2 / F.sqrt(s2 * s2 + F.lit(d.NORM_ALPHA))
    comp = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), comp))
    return agg.select(*ids, *carry, F.round(comp, 4).alias("compound"))


def compound_label(c) -> Column:
    """V2."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.when(c >= d.POSITIVE_AT, F.lit("positive")).when(c <= d.NEGATIVE_AT, F.lit("negative"))
            .otherwise(F.lit("neutral")))


def lexicon_labels(reviews: DataFrame, lexicon: DataFrame, carry: tuple[str, ...] = ("sentiment",)) -> DataFrame:
    """V1-V3, narrow: (review_id, *carry, compound, vader_label, mismatch). A missing label always
    disagrees (pandas ``!=`` semantics), so ``mismatch`` is null-safe."""
    out = lexicon_scores(reviews, lexicon, carry=carry).withColumn("vader_label", compound_label("compound"))
    return out.withColumn("mismatch", ~F.col("sentiment").eqNullSafe(F.col("vader_label")))


def reviews_labeled(reviews: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The reviews_labeled table: review_text, label_sentiment, review_id, vader_label, sentiment,
    mismatch. One shuffle join brings the narrow lexicon result back to the texts."""
    lab = lexicon_scores(reviews, lexicon).select("review_id", compound_label("compound").alias("vader_label"))
    out = reviews.join(lab, "review_id", "left")
    return out.select("review_text", "label_sentiment", "review_id", "vader_label", "sentiment",
                      (~F.col("sentiment").eqNullSafe(F.col("vader_label"))).alias("mismatch"))


def mismatch_rate(labeled: DataFrame) -> DataFrame:
    """V4: percent of rows whose label disagrees with the lexicon label."""
    return labeled.agg(F.count(F.lit(1)).alias("n_reviews"),
                       (F.avg(F.col("mismatch").cast("int")) * 100).alias("mismatch_pct"))


def label_distribution(labeled: DataFrame, col: str = "sentiment") -> DataFrame:
    """V5: counts per label, largest first; missing labels are not counted."""
    return (labeled.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), col))


def corpus_lexicon(reviews: DataFrame, min_df: int = 5, seed: DataFrame | None = None) -> DataFrame:
    """A test lexicon induced from labelled reviews (the published lexicon is an input we do not ship).

    A word seen in at least ``min_df`` labelled reviews gets +2 / -2 when its rate among positive
    reviews is at least twice / at most half its rate among negative ones, +1 / -1 at 1.25 / 0.8, and
    no entry otherwise. Integer cross-multiplication keeps the rule exact. Seed entries win.
    """
    lab = reviews.where(F.col("sentiment").isin("positive", "negative"))
    counts = lab.groupBy().agg(F.count_if(F.col("sentiment") == "positive").alias("np"),
                               F.count_if(F.col("sentiment") == "negative").alias("nn"))
    toks = lab.select("sentiment", F.explode(F.array_distinct(F.transform(tx.lexicon_words("review_text"), F.lower)))
                      .alias("token"))
    g = toks.groupBy("token").agg(F.count_if(F.col("sentiment") == "positive").cast("long").alias("dp"),
                                  F.count_if(F.col("sentiment") == "negative").cast("long").alias("dn"))
    g = g.where(F.col("dp") + F.col("dn") >= min_df)
    row = counts.first()
    n_pos, n_neg = int(row["np"] or 0), int(row["nn"] or 0)
    a, b = F.col("dp") * F.lit(n_neg), F.col("dn") * F.lit(n_pos)
    val = (F.when(a >= 2 * b, F.lit(2.0)).when(2 * a <= b, F.lit(-2.0))
           .when(4 * a >= 5 * b, F.lit(1.0)).when(5 * a <= 4 * b, F.lit(-1.0)))
    induced = g.select("token", val.alias("valence")).where(F.col("valence").isNotNull())
    seed = seed if seed is not None else seed_lexicon(reviews.sparkSession)
    return induced.join(seed.select("token"), "token", "left_anti").unionByName(seed)
