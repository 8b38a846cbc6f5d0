"""Registered queries for topics, aspects, review analysis and summaries.

Test-data stand-ins: in the first queries a sentence's cluster is its document's ``source`` (20 groups), in the ``cluster_`` queries
it is its review's density cluster; the aspect keyword
sets for naming topics are built from the corpus (class-based TF-IDF top words per language), since
invented prose rarely contains the default film keywords.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import aspects as fa
from ..functions import text as tx
from ..operators import analyze as an
from ..operators import cluster as cl
from ..operators import density as dn
from ..operators import ids
from ..operators import model as md
from ..operators import reduction as rd
from ..operators import text as tt
from ..operators import topic_model as tm
from ..operators import topics as tp
from ..session import scratch_path
from ..sources import dictionaries as d
from ..sources import tables
from . import common
from . import model_queries as mq
from . import sqlparts as S


# density parameters: of the reviews' letter profiles, and of the first five columns of the embeddings
PROFILE_EPS, PROFILE_MIN_PTS = 0.02, 10
VECTOR_EPS, VECTOR_MIN_PTS, VECTOR_MIN_SIZE = 0.12, 8, 20
DOCUMENT = ("source", "lang")       # columns of a document that its review carries
WORD_EPS, WORD_MIN_PTS = 0.08, 20   # sentences by the word vectors' first five components


def _with_document(spark, sf, r, cols):
    """The reviews with columns of their documents. Reviews that carry them from the start are joined only where documents share an id, so texts stay in
    their tasks."""
    src = tables.table(spark, sf, "documents").select("doc_id", *cols)
    if not set(cols) <= set(r.columns):
        return r.join(src, "doc_id")
    again = ids.repeated_keys(src.where("doc_id is not null"), "doc_id")
    if again is None:
        return r
    more = ids.on_key(r, "doc_id", again, "left_semi").drop(*cols).join(src, "doc_id")
    return ids.on_key(r, "doc_id", again, "left_anti").unionByName(more)


def _sentences_with_source(spark, sf, r=None):
    r = r if r is not None else common.reviews(spark, sf, DOCUMENT)
    rs = _with_document(spark, sf, r, DOCUMENT)
    return r, tt.explode_sentences(rs, "review_text", ["review_id", "source", "lang"])


def _topics(spark, sf, r=None):
    r, s = _sentences_with_source(spark, sf, r)
    s = tt.materialize(s, "sentences")
    tmap = tp.number_topics(s, "source")
    st = tp.assign_topics(s, tmap, "source")
    return r, s, tmap, st, *_topic_words(s, tmap, "source")


def _topic_words(s, tmap, cluster):
    """The topics' words, and the word counts by cluster and language: topic words and aspect keywords are both made of them."""
    counts = tp.class_word_counts(s, [cluster, "lang"], "sentence")
    return tp.topic_word_scores(s, "topic_id", "sentence", counts=tp.assign_topics(counts, tmap, cluster)), counts


def _cluster_topics(spark, sf, r=None):
    """The same frames with density clusters (A3) of the reviews as cluster labels: reviews are points by their letter profile, sentences take
    the cluster of their review, noise is cluster -1."""
    r = r if r is not None else common.reviews(spark, sf, DOCUMENT)
    points = r.select("review_id", tx.letter_profile("review_text").alias("reduced"))
    clusters = dn.density_clusters(points, PROFILE_EPS, PROFILE_MIN_PTS, id_col="review_id").select("review_id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    s = tt.explode_sentences(_with_document(spark, sf, r, ("lang",)).join(clusters, "review_id"), "review_text", ["review_id", "cluster", "lang"])
    s = tt.materialize(s, "sentences")
    tmap = tp.number_topics(s, "cluster", noise=-1)
    st = tp.assign_topics(s, tmap, "cluster")
    return r, s, tmap, st, *_topic_words(s, tmap, "cluster")


def _corpus_keywords(s, counts):
    """Aspect keyword sets from the corpus: per language, its top words by class-based TF-IDF."""
    lw = tp.topic_word_scores(s, "lang", "sentence", counts=counts)
    langs = sorted(r["lang"] for r in s.where("lang is not null").select("lang").distinct().collect())   # a handful of languages
    order = F.create_map(*[x for i, lg in enumerate(langs) for x in (F.lit(lg), F.lit(i))])
    return lw.select(F.concat(F.lit("lang:"), "lang").alias("aspect"), order[F.col("lang")].cast("int").alias("aspect_order"),
                     F.col("word").alias("keyword"))


def _mapping(spark, sf, r=None, topics=_topics):
    r, s, tmap, st, words, counts = topics(spark, sf, r)
    kw = _corpus_keywords(s, counts)
    return r, s, tmap, st, words, kw, tp.topic_aspects(words, kw)


def q_topic_number(spark, sf):
    return _topics(spark, sf)[2]


def q_topic_words(spark, sf):
    w = _topics(spark, sf)[4]
    return w.select("topic_id", "word", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


def q_topic_info(spark, sf):
    _, _, tmap, _, words, _ = _topics(spark, sf)
    return tp.topic_info(tmap, words)


def q_topic_summary(spark, sf):
    _, _, tmap, _, words, _ = _topics(spark, sf)
    return tp.topic_summary(tp.topic_info(tmap, words))


def q_topic_to_aspect(spark, sf):
    return _mapping(spark, sf)[6]


def q_aspect_mapping_report(spark, sf):
    _, _, _, _, words, kw, m = _mapping(spark, sf)
    return tp.mapping_report(words, kw, m)


def q_sentence_aspect(spark, sf):
    _, _, _, st, _, _, m = _mapping(spark, sf)
    return tp.sentence_aspects(st, m).select("review_id", "pos", "topic_id", "aspect")


def _model(spark, sf, r=None):
    r, sp, counts, train_counts, vocab, idf = mq._fitted(spark, sf, r)
    train_labels = sp.where(F.col("split") == "train").select("review_id", "sentiment")
    coef, b = md.linear_weights(train_counts, train_labels, vocab, labelled=mq.LABELLED)
    return an.LinearTextModel(idf.checkpoint(), coef.checkpoint(), b)


def _final(spark, sf, topics=_topics):
    """aspect_sentiment_final: (review_id, pos, sentence, aspect, sentence_sentiment)."""
    r = common.reviews(spark, sf, DOCUMENT)
    model = _model(spark, sf, r)
    _, _, _, st, _, _, m = _mapping(spark, sf, r, topics)
    sa = tp.sentence_aspects(st, m).select("review_id", "pos", "sentence", "aspect")
    return model.predict(sa, ["review_id", "pos"], "sentence", out="sentence_sentiment", carry=("sentence", "aspect"))


def q_sentence_sentiment(spark, sf):
    return _final(spark, sf).select("review_id", "pos", "aspect", "sentence_sentiment")


def q_aspect_crosstab(spark, sf):
    return tp.crosstab(_final(spark, sf))


def q_aspects_summary(spark, sf):
    return an.aspects_summary(_final(spark, sf))


def q_counts_wide(spark, sf):
    return tp.crosstab(_final(spark, sf), "aspect", "sentence_sentiment")


def q_aspect_percent(spark, sf):
    s = an.aspects_summary(_final(spark, sf))
    pct, neg, label = an.percent_split(F.col("positive"), F.col("negative"))
    return s.select("aspect", pct.alias("pos_pct"), neg.alias("neg_pct"), label.alias("bar_label"))


def _analyze(spark, sf):
    model = _model(spark, sf)
    req = tables.table(spark, sf, "documents").select(F.col("doc_id").alias("review_id"), F.col("text").alias("review_text"))
    return an.analyze_reviews(ids.ensure_parallelism(req), model)


def q_analyze_reviews(spark, sf):
    acc, _, _ = _analyze(spark, sf)
    return acc.select("review_id", "overall_sentiment", F.size("breakdown").alias("n_sentences"),
                      F.array_join(F.transform("breakdown", lambda x: x["aspect"]), "|").alias("aspects"),
                      F.array_join(F.transform("breakdown", lambda x: x["sentiment"]), "|").alias("sentiments"))


def q_breakdown_flat(spark, sf):
    acc, _, _ = _analyze(spark, sf)
    return an.breakdown_flat(acc)


def q_review_aspect_counts(spark, sf):
    _, _, s = _analyze(spark, sf)
    return an.review_aspect_counts(s)


def q_review_gauge(spark, sf):
    _, _, s = _analyze(spark, sf)
    c = s.groupBy("review_id").agg(F.count_if(F.col("sentiment") == "positive").alias("pos"),
                                   F.count_if(F.col("sentiment") == "negative").alias("neg"))
    pct, label = an.gauge(F.col("pos"), F.col("neg"))
    return c.select("review_id", pct.alias("pos_pct"), label.alias("label"))


def q_keyword_aspect_topics(spark, sf):
    """A13 with the topic-naming dictionary: substring rule over the sentence table."""
    s = common.sentences(spark, sf)
    return s.select("review_id", "pos", fa.keyword_aspect("sentence", d.TOPIC_ASPECT_KEYWORDS).alias("aspect"))


def q_density_cluster(spark, sf):
    """A3 on the embeddings table, reduced to its first five columns."""
    points = tables.table(spark, sf, "embeddings").select("vec_id", F.slice("embedding", 1, 5).alias("reduced"))
    return dn.density_clusters(points, VECTOR_EPS, VECTOR_MIN_PTS, VECTOR_MIN_SIZE, id_col="vec_id")


def q_cluster_topic_number(spark, sf):
    return _cluster_topics(spark, sf)[2]


def q_cluster_topic_words(spark, sf):
    return _cluster_topics(spark, sf)[4].select("topic_id", "word", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


def _members(r, st):
    """(review_id, topic_id, reduced): noise and topics are those of the sentences; a review has one cluster. A stage table, as several sums read the profiles."""
    profiles = r.select("review_id", tx.letter_profile("review_text").alias("reduced"))
    return tt.materialize(st.select("review_id", "topic_id").distinct().join(profiles, "review_id"), "members")


def q_cluster_topic_info(spark, sf):
    """A6 whole: count, name, words, and the texts of the three reviews nearest to the topic's centroid."""
    r, _, tmap, st, words, _ = _cluster_topics(spark, sf)
    info = tp.topic_info(tmap, words)
    chosen = tp.representatives(_members(r, st), 5)
    return tp.representative_docs(info, chosen, r, "review_text").withColumn("representative_docs", F.array_join("representative_docs", "|"))


def _saved_model(spark, sf):
    """K7: the cluster topics' model, saved and loaded again; and the reviews."""
    r, _, tmap, st, words, _ = _cluster_topics(spark, sf)
    members = _members(r, st)
    path = scratch_path(spark, "topic_model")
    tm.TopicModel(tp.topic_info(tmap, words), words, tp.centroids(members.where("topic_id >= 0"), 5)).save(path)
    return r, tm.TopicModel.load(spark, path)


def q_topic_model_roundtrip(spark, sf):
    """K7 read back: words and size of every saved topic."""
    _, model = _saved_model(spark, sf)
    return model.info.join(model.words.groupBy("topic_id").agg(F.count(F.lit(1)).alias("n_words")), "topic_id").select("topic_id", "count", "representation", "n_words")


def q_topic_model_assign(spark, sf):
    """Every document as a new text: the topic of the nearest saved centroid."""
    _, model = _saved_model(spark, sf)
    # a stage table: Spark cannot evaluate the profile's lambda variables where they are the input of a Python function
    docs = tt.materialize(tables.table(spark, sf, "documents").select("doc_id", tx.letter_profile("text").alias("reduced")), "profiles")
    return model.assign(docs).select("doc_id", "topic_id")


def q_embed_reduce5(spark, sf):
    """A1(c) to A2: the 2^18 columns of hashed TF-IDF reduced to 5."""
    e = cl.hashed_tfidf(tt.sentence_table(common.reviews(spark, sf)))
    return rd.fit_reduction(e).transform(e).select("review_id", "pos", *[F.round(F.col("reduced")[i], 6).alias(f"c{i}") for i in range(5)])


def q_word_vector_topics(spark, sf):
    """A1(b), A2, A3, A4: trained word vectors of the sentences, reduced and clustered, with their topic numbers."""
    s = tt.materialize(tt.sentence_table(common.reviews(spark, sf)).withColumn("id", F.xxhash64("review_id", "pos")), "sentences")
    e, _ = cl.word_vectors(s)
    e = tt.materialize(e.select("id", "review_id", "pos", "embedding"), "word_vectors")
    x = rd.fit_reduction(e).transform(e)
    clusters = dn.density_clusters(x, WORD_EPS, WORD_MIN_PTS).select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    t = e.select("id", "review_id", "pos").join(clusters, "id")
    return tp.assign_topics(t, tp.number_topics(t, "cluster", noise=-1), "cluster").select("review_id", "pos", "topic_id")


def q_cluster_topic_to_aspect(spark, sf):
    return _mapping(spark, sf, topics=_cluster_topics)[6]


def q_cluster_mapping_report(spark, sf):
    _, _, _, _, words, kw, m = _mapping(spark, sf, topics=_cluster_topics)
    return tp.mapping_report(words, kw, m)


def q_cluster_sentence_aspect(spark, sf):
    _, _, _, st, _, _, m = _mapping(spark, sf, topics=_cluster_topics)
    return tp.sentence_aspects(st, m).select("review_id", "pos", "topic_id", "aspect")


def q_cluster_aspect_crosstab(spark, sf):
    return tp.crosstab(_final(spark, sf, _cluster_topics))


QUERIES = {
    "density_cluster": q_density_cluster,
    "cluster_topic_number": q_cluster_topic_number,
    "cluster_topic_words": q_cluster_topic_words,
    "cluster_topic_info": q_cluster_topic_info,
    "topic_model_roundtrip": q_topic_model_roundtrip,
    "topic_model_assign": q_topic_model_assign,
    "embed_reduce5": q_embed_reduce5,
    "word_vector_topics": q_word_vector_topics,
    "cluster_topic_to_aspect": q_cluster_topic_to_aspect,
    "cluster_mapping_report": q_cluster_mapping_report,
    "cluster_sentence_aspect": q_cluster_sentence_aspect,
    "cluster_aspect_crosstab": q_cluster_aspect_crosstab,
    "topic_number": q_topic_number,
    "topic_words": q_topic_words,
    "topic_info": q_topic_info,
    "topic_summary": q_topic_summary,
    "topic_to_aspect": q_topic_to_aspect,
    "aspect_mapping_report": q_aspect_mapping_report,
    "sentence_aspect": q_sentence_aspect,
    "sentence_sentiment": q_sentence_sentiment,
    "aspect_crosstab": q_aspect_crosstab,
    "aspects_summary": q_aspects_summary,
    "counts_wide": q_counts_wide,
    "aspect_percent": q_aspect_percent,
    "analyze_reviews": q_analyze_reviews,
    "breakdown_flat": q_breakdown_flat,
    "review_aspect_counts": q_review_aspect_counts,
    "review_gauge": q_review_gauge,
    "keyword_aspect_topics": q_keyword_aspect_topics,
}

# ------------------------------------------------------------------------------------------------
# Oracle SQL
# ------------------------------------------------------------------------------------------------


def _cls_words(src: str, cls: str, name: str) -> str:
    return f"""{name}_w AS (SELECT t.{cls} AS cls, u.word FROM {src} t, unnest({S.word_tokens('t.sentence')}) AS u(word)),
{name}_tf AS (SELECT cls, word, count(*) AS tf FROM {name}_w GROUP BY ALL),
{name}_nc AS (SELECT cls, sum(tf) AS nc FROM {name}_tf GROUP BY 1),
{name}_ft AS (SELECT word, sum(tf) AS ft FROM {name}_tf GROUP BY 1),
{name}_a AS (SELECT CAST(floor(avg(nc)) AS BIGINT) AS a FROM {name}_nc),
{name}_s AS (SELECT tf.cls, tf.word, CAST(tf.tf AS DOUBLE) / CAST(nc.nc AS DOUBLE) * ln(1 + CAST(a AS DOUBLE) / CAST(ft.ft AS DOUBLE)) AS score
             FROM {name}_tf tf JOIN {name}_nc nc USING (cls) JOIN {name}_ft ft USING (word), {name}_a),
{name} AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY cls ORDER BY score DESC, word) AS INTEGER) AS rank
           FROM {name}_s) WHERE rank <= {d.TOP_N_WORDS})"""


def _density_sql(points: str, eps: float, min_pts: int, min_size: int, name: str = "cl") -> str:
    """CTEs that cluster the rows of ``points`` (id, x1 .. x5) into ``name`` (id, cluster); clusters of fewer than ``min_size`` points are null.
    The recursive part keeps one row per core point, its smallest known core id."""
    d2 = " + ".join(f"(a.x{i} - b.x{i}) * (a.x{i} - b.x{i})" for i in range(1, 6))
    return f"""{name}_nb AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM {points} a JOIN {points} b ON {d2} <= {eps!r}::DOUBLE * {eps!r}::DOUBLE),
{name}_core AS MATERIALIZED (SELECT a AS id FROM {name}_nb GROUP BY a HAVING count(*) >= {min_pts}),
{name}_edge AS MATERIALIZED (SELECT a, b FROM {name}_nb WHERE a <> b AND a IN (FROM {name}_core) AND b IN (FROM {name}_core)),
{name}_cc(id, cluster) USING KEY (id) AS (SELECT id, id FROM {name}_core
    UNION SELECT e.b, min(c.cluster) FROM {name}_cc c JOIN {name}_edge e ON e.a = c.id JOIN recurring.{name}_cc AS o ON o.id = e.b WHERE c.cluster < o.cluster GROUP BY e.b),
{name}_first AS (SELECT n.a AS id, min(n.b) AS core FROM {name}_nb n WHERE n.b IN (FROM {name}_core) GROUP BY n.a),
{name}_all AS (SELECT p.id, coalesce(own.cluster, near.cluster) AS cluster FROM {points} p LEFT JOIN {name}_cc own ON own.id = p.id
    LEFT JOIN {name}_first f ON f.id = p.id LEFT JOIN {name}_cc near ON near.id = f.core),
{name} AS (SELECT id, CASE WHEN cluster IS NOT NULL AND count(*) OVER (PARTITION BY cluster) >= {min_size} THEN cluster END AS cluster FROM {name}_all)"""


def _topics_sql(rows: str, noise: str = "false") -> str:
    """The topic CTEs; ``rows`` defines rs (review_id, review_text, source = the cluster label, lang), ``noise`` tells noise labels."""
    return rows + f""",
{S.sentences_cte('st0', 'rs', keep='r.review_id, r.source, r.lang')},
tg AS (SELECT source AS cluster, count(*) AS count, min({{'r': review_id, 'p': pos}}) AS first, count(*) < {d.MIN_TOPIC_SIZE} OR {noise} AS is_noise FROM st0 GROUP BY source),
tmap AS (SELECT cluster, CAST(CASE WHEN is_noise THEN -1 ELSE row_number() OVER (PARTITION BY is_noise ORDER BY count DESC, first) - 1 END AS INTEGER) AS topic_id, count FROM tg),
st AS (SELECT s.*, m.topic_id FROM st0 s JOIN tmap m ON m.cluster = s.source),
{_cls_words('st', 'topic_id', 'twd')},
{_cls_words('st0', 'lang', 'lw')},
langs AS (SELECT lang, CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS aspect_order FROM (SELECT DISTINCT lang FROM st0)),
kw AS (SELECT 'lang:' || l.cls AS aspect, g.aspect_order, l.word AS keyword FROM lw l JOIN langs g ON g.lang = l.cls),
ov AS (SELECT t.cls AS topic_id, k.aspect, k.aspect_order, count(DISTINCT t.word) AS overlap
       FROM twd t JOIN kw k ON k.keyword = t.word WHERE t.cls <> -1 GROUP BY ALL),
tmapped AS (SELECT topic_id, aspect, CAST(overlap AS INTEGER) AS overlap FROM (
    SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY overlap DESC, aspect_order) AS r FROM ov)
  WHERE r = 1 AND overlap >= {d.MIN_TOPIC_OVERLAP})"""


TOPICS = _topics_sql("rs AS (SELECT r.review_id, r.review_text, r.sentiment, dd.source, dd.lang FROM reviews r JOIN documents dd USING (doc_id))")
_LETTERS = ("e", "n", "o", "h", "é")
_PROFILE = ", ".join(f"CAST(length(t) - length(translate(t, '{g}', '')) AS DOUBLE) / n AS x{i}" for i, g in enumerate(_LETTERS, 1))
_POINTS = f"""lt AS (SELECT review_id, lower(review_text) AS t, length(regexp_replace(lower(review_text), '[^\\p{{L}}]', '', 'g')) AS n FROM reviews),
pts AS MATERIALIZED (SELECT review_id AS id, {_PROFILE} FROM lt WHERE n > 0)"""
CLUSTER_TOPICS = f"{_POINTS}, {_density_sql('pts', PROFILE_EPS, PROFILE_MIN_PTS, d.MIN_TOPIC_SIZE)}, " + _topics_sql(
    """rs AS (SELECT r.review_id, r.review_text, r.sentiment, coalesce(cl.cluster, -1) AS source, dd.lang
       FROM reviews r JOIN documents dd USING (doc_id) LEFT JOIN cl ON cl.id = r.review_id)""", "source = -1")

INFO = """tinfo AS (SELECT m.topic_id, CAST(sum(m.count) AS BIGINT) AS count,
    CAST(m.topic_id AS VARCHAR) || coalesce('_' || (SELECT string_agg(word, '_' ORDER BY rank) FROM twd WHERE twd.cls = m.topic_id AND rank <= 4), '') AS name,
    (SELECT string_agg(word, ',' ORDER BY rank) FROM twd WHERE twd.cls = m.topic_id) AS representation
  FROM tmap m GROUP BY m.topic_id)"""

_FINAL_BASE = f"{S.BASE}, {mq.FIT}, {mq.NB}, {TOPICS}"
FINAL = f"""sa AS (SELECT s.review_id, s.pos, s.sentence, m.aspect FROM st s JOIN tmapped m USING (topic_id)),
{mq.score_cte('fsc', 'sa', 'review_id, pos', 'sentence')},
final AS (SELECT sa.review_id, sa.pos, sa.sentence, sa.aspect, f.p AS sentence_sentiment
          FROM sa JOIN fsc f USING (review_id, pos))"""

_REQ_SENT = f"len(list_filter(list_transform({S.sentence_list('review_text')}, lambda s: {S.strip_ws('s')}), lambda s: length(s) > 0))"
ANALYZE = f"""req AS (SELECT doc_id AS review_id, {S.strip_ws("coalesce(text, '')")} AS review_text FROM documents),
ok AS (SELECT * FROM req WHERE length(review_text) > 0 AND {_REQ_SENT} > 0),
{S.sentences_cte('asent0', 'ok', keep='r.review_id', min_len=0)},
asent AS (SELECT *, {S.keyword_aspect('sentence')} AS aspect FROM asent0),
{mq.score_cte('asc1', 'asent', 'review_id, pos', 'sentence')},
{mq.score_cte('aov', 'ok', 'review_id', 'review_text')},
asr AS (SELECT a.review_id, a.pos, a.sentence, a.aspect, s.p AS sentiment FROM asent a JOIN asc1 s USING (review_id, pos))"""

_REPORT = """,
        tws AS (SELECT cls AS topic_id, list_sort(list(word)) AS w FROM twd WHERE cls <> -1 GROUP BY cls),
        mw AS (SELECT t.cls AS topic_id, string_agg(DISTINCT t.word, ',' ORDER BY t.word) AS matched_words
               FROM twd t JOIN tmapped m ON m.topic_id = t.cls JOIN kw k ON k.aspect = m.aspect AND k.keyword = t.word GROUP BY t.cls)
        SELECT tws.topic_id, m.aspect, CASE WHEN m.aspect IS NULL THEN 'unmapped' ELSE 'mapped' END AS status,
               mw.matched_words, array_to_string(list_slice(tws.w, 1, 5), ',') AS top_words
        FROM tws LEFT JOIN tmapped m USING (topic_id) LEFT JOIN mw USING (topic_id)"""

ORACLE = {
    "density_cluster": f"""WITH RECURSIVE vec AS MATERIALIZED (SELECT vec_id AS id, {", ".join(f"CAST(embedding[{i}] AS DOUBLE) AS x{i}" for i in range(1, 6))} FROM embeddings),
        {_density_sql('vec', VECTOR_EPS, VECTOR_MIN_PTS, VECTOR_MIN_SIZE)} SELECT id AS vec_id, cluster FROM cl""",
    **{name: f"WITH RECURSIVE {S.BASE}, {CLUSTER_TOPICS} " + sql for name, sql in {
        "cluster_topic_number": "SELECT cluster, topic_id, count FROM tmap",
        "cluster_topic_words": "SELECT cls AS topic_id, word, round(score, 6) AS score, rank FROM twd",
        "cluster_topic_info": f""", {INFO},
            mem AS (SELECT DISTINCT s.topic_id, p.* FROM st s JOIN pts p ON p.id = s.review_id),
            cen AS (SELECT topic_id, {", ".join(f"avg(x{i}) AS c{i}" for i in range(1, 6))} FROM mem GROUP BY topic_id),
            rep AS (SELECT m.topic_id, m.id, row_number() OVER (PARTITION BY m.topic_id ORDER BY round(sqrt({" + ".join(f"(x{i} - c{i}) * (x{i} - c{i})" for i in range(1, 6))}), 9), m.id) AS rank
                    FROM mem m JOIN cen USING (topic_id))
            SELECT t.topic_id, t.count, t.name, t.representation,
                   (SELECT string_agg(r.review_text, '|' ORDER BY rep.rank) FROM rep JOIN reviews r ON r.review_id = rep.id
                    WHERE rep.topic_id = t.topic_id AND rep.rank <= {d.REPRESENTATIVE_DOCS}) AS representative_docs FROM tinfo t""",
        "topic_model_roundtrip": f""", {INFO} SELECT topic_id, count, representation, (SELECT count(*) FROM twd WHERE twd.cls = tinfo.topic_id) AS n_words FROM tinfo
            WHERE topic_id IN (SELECT cls FROM twd)""",
        "topic_model_assign": f""", mem AS (SELECT DISTINCT s.topic_id, p.* FROM st s JOIN pts p ON p.id = s.review_id WHERE s.topic_id >= 0),
            cen AS (SELECT topic_id, {", ".join(f"avg(x{i}) AS c{i}" for i in range(1, 6))} FROM mem GROUP BY topic_id),
            dl AS (SELECT doc_id, lower(text) AS t, length(regexp_replace(lower(text), '[^\\p{{L}}]', '', 'g')) AS n FROM documents),
            dp AS (SELECT doc_id, {_PROFILE} FROM dl WHERE n > 0),
            near AS (SELECT doc_id, topic_id, row_number() OVER (PARTITION BY doc_id ORDER BY round(sqrt({" + ".join(f"(x{i} - c{i}) * (x{i} - c{i})" for i in range(1, 6))}), 9), topic_id) AS k FROM dp, cen)
            SELECT d.doc_id, n.topic_id FROM documents d LEFT JOIN near n ON n.doc_id = d.doc_id AND n.k = 1""",
        "cluster_topic_to_aspect": "SELECT topic_id, aspect, overlap FROM tmapped",
        "cluster_mapping_report": _REPORT,
        "cluster_sentence_aspect": "SELECT s.review_id, s.pos, s.topic_id, m.aspect FROM st s JOIN tmapped m USING (topic_id)"}.items()},
    "cluster_aspect_crosstab": f"""WITH RECURSIVE {S.BASE}, {mq.FIT}, {mq.NB}, {CLUSTER_TOPICS}, {FINAL} SELECT aspect, count(*) FILTER (WHERE sentence_sentiment = 'negative') AS negative,
        count(*) FILTER (WHERE sentence_sentiment = 'positive') AS positive FROM final GROUP BY aspect""",
    "topic_number": f"WITH {S.BASE}, {TOPICS} SELECT cluster, topic_id, count FROM tmap",
    "topic_words": f"WITH {S.BASE}, {TOPICS} SELECT cls AS topic_id, word, round(score, 6) AS score, rank FROM twd",
    "topic_info": f"WITH {S.BASE}, {TOPICS}, {INFO} SELECT topic_id, count, name, representation FROM tinfo",
    "topic_summary": f"""WITH {S.BASE}, {TOPICS}, {INFO} SELECT topic_id, count, name, representation FROM tinfo
        WHERE topic_id <> -1 ORDER BY topic_id LIMIT {d.TOPIC_SUMMARY_ROWS}""",
    "topic_to_aspect": f"WITH {S.BASE}, {TOPICS} SELECT topic_id, aspect, overlap FROM tmapped",
    "aspect_mapping_report": f"WITH {S.BASE}, {TOPICS}" + _REPORT,
    "sentence_aspect": f"WITH {S.BASE}, {TOPICS} SELECT s.review_id, s.pos, s.topic_id, m.aspect FROM st s JOIN tmapped m USING (topic_id)",
    "sentence_sentiment": f"WITH {_FINAL_BASE}, {FINAL} SELECT review_id, pos, aspect, sentence_sentiment FROM final",
    "aspect_crosstab": f"""WITH {_FINAL_BASE}, {FINAL} SELECT aspect, count(*) FILTER (WHERE sentence_sentiment = 'negative') AS negative,
        count(*) FILTER (WHERE sentence_sentiment = 'positive') AS positive FROM final GROUP BY aspect""",
    "aspects_summary": f"""WITH {_FINAL_BASE}, {FINAL} SELECT aspect, count(*) FILTER (WHERE sentence_sentiment = 'negative') AS negative,
        count(*) FILTER (WHERE sentence_sentiment = 'positive') AS positive, (SELECT count(*) FROM final) AS total_sentences
        FROM final WHERE aspect IS NOT NULL GROUP BY aspect""",
    "counts_wide": f"""WITH {_FINAL_BASE}, {FINAL} SELECT aspect, count(*) FILTER (WHERE sentence_sentiment = 'negative') AS negative,
        count(*) FILTER (WHERE sentence_sentiment = 'positive') AS positive FROM final GROUP BY aspect""",
    "aspect_percent": f"""WITH {_FINAL_BASE}, {FINAL}, c AS (SELECT aspect, count(*) FILTER (WHERE sentence_sentiment = 'negative') AS neg,
        count(*) FILTER (WHERE sentence_sentiment = 'positive') AS pos FROM final WHERE aspect IS NOT NULL GROUP BY aspect)
        SELECT aspect, CAST(CASE WHEN pos + neg = 0 THEN NULL ELSE round_even(100.0 * pos / (pos + neg), 0) END AS INTEGER) AS pos_pct,
               100 - CAST(CASE WHEN pos + neg = 0 THEN NULL ELSE round_even(100.0 * pos / (pos + neg), 0) END AS INTEGER) AS neg_pct,
               CASE WHEN pos + neg = 0 THEN 'N/A' END AS bar_label FROM c""",
    "analyze_reviews": f"""WITH {S.BASE}, {mq.FIT}, {mq.NB}, {ANALYZE}
        SELECT o.review_id, o.p AS overall_sentiment, CAST(coalesce(b.n, 0) AS INTEGER) AS n_sentences,
               coalesce(b.aspects, '') AS aspects, coalesce(b.sentiments, '') AS sentiments
        FROM aov o LEFT JOIN (SELECT review_id, count(*) AS n, string_agg(aspect, '|' ORDER BY pos) AS aspects,
                                     string_agg(sentiment, '|' ORDER BY pos) AS sentiments FROM asr GROUP BY review_id) b USING (review_id)""",
    "breakdown_flat": f"WITH {S.BASE}, {mq.FIT}, {mq.NB}, {ANALYZE} SELECT review_id, pos, sentence, aspect, sentiment FROM asr",
    "review_aspect_counts": f"""WITH {S.BASE}, {mq.FIT}, {mq.NB}, {ANALYZE}
        SELECT review_id, aspect, count(*) FILTER (WHERE sentiment = 'positive') AS positive,
               count(*) FILTER (WHERE sentiment = 'negative') AS negative, min(pos) AS first_pos FROM asr GROUP BY ALL""",
    "review_gauge": f"""WITH {S.BASE}, {mq.FIT}, {mq.NB}, {ANALYZE},
        c AS (SELECT review_id, count(*) FILTER (WHERE sentiment = 'positive') AS pos,
                     count(*) FILTER (WHERE sentiment = 'negative') AS neg FROM asr GROUP BY review_id)
        SELECT review_id, CAST(CASE WHEN pos + neg = 0 THEN 50 ELSE round_even(100.0 * pos / (pos + neg), 0) END AS INTEGER) AS pos_pct,
          CASE WHEN pos + neg = 0 THEN 'N/A'
               WHEN round_even(100.0 * pos / (pos + neg), 0) >= {d.GAUGE_POSITIVE} THEN 'Positive'
               WHEN round_even(100.0 * pos / (pos + neg), 0) <= {d.GAUGE_NEGATIVE} THEN 'Negative' ELSE 'Mixed / Neutral' END AS label FROM c""",
    "keyword_aspect_topics": f"""WITH {S.BASE}, {S.sentences_cte()} SELECT review_id, pos,
        {S.keyword_aspect('sentence', d.TOPIC_ASPECT_KEYWORDS)} AS aspect FROM sentences""",
}


# A1 / A2 (checked by invariants: unit norms, orthonormal components)
def q_embed(spark, sf):
    s = tt.sentence_table(common.reviews(spark, sf))
    e = cl.hashed_tfidf(s)
    st = cl.vector_stats(e, ["review_id", "pos"])
    return st.select("review_id", "pos", "nnz", F.round("norm", 6).alias("norm"))


def q_pca5(spark, sf):
    e = cl.from_array(tables.table(spark, sf, "embeddings"))
    red, _ = cl.reduce_pca(e, 5)
    return red.select("vec_id", *[F.round(F.col("reduced")[i], 6).alias(f"pc{i}") for i in range(5)])


QUERIES["embed"] = q_embed
QUERIES["pca5"] = q_pca5
