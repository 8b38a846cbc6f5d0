"""Steps that the scored and topic queries share: term totals by slices of a batch, topic words and keywords from one count, patterns run only where they can match."""

from pyspark.sql import functions as F

from reviewlens.functions import text as tx
from reviewlens.operators import features as fe
from reviewlens.operators import text as tt
from reviewlens.operators import topics as tp
from reviewlens.sources.dictionaries import ABBREVIATIONS

ODD = [None, "", " ", "\u0001", " \u0001 \n\u0001", "\u0002", "a", "\x1ca b　", "Mr. X met DR. Y. Then? \"Yes!\" No", "e.g. one two  three\t", "Mr.Dr. Z. Q",
       "see http://x.y z<br/>www.a b <br > c <BR> d", "<b r>  \u0085 x  y", "kK. etc. st. ſt. end", "one\r\n two .\n"]


def _odd(spark):
    return spark.createDataFrame(list(enumerate(ODD)), "i long, text string")


def test_totals_by_slices_equal_the_long_form(spark):
    rows = [(i % 7, t) for i, t in enumerate(["great fun film great fun film", "film boring film plot", None, "", "fun", "Großes Kino, großes kino! the plot"] * 4)] + [(None, "a b")]
    df = spark.createDataFrame(rows, "review_id long, review_text string").coalesce(1)
    plain = {r["term"]: (r["df"], r["tf"]) for r in fe.term_counts(df).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("tf")).collect()}
    docs = fe.document_tokens(df, {"rows": F.count(F.lit(1))})
    for at_once in (1, 5, 1_000_000):
        assert {r["term"]: (r["df"], r["tf"]) for r in fe.term_totals(docs, at_once).collect()} == plain
    assert fe.term_totals(docs.where("false")).collect() == []


def test_totals_sort_no_strings_in_rows(spark):
    docs = fe.document_tokens(spark.createDataFrame([(1, "a b")], "review_id long, review_text string"), {})
    plan = fe.term_totals(docs)._jdf.queryExecution().executedPlan().toString()
    assert "sort_array" not in plan and "MapInArrow" in plan


def test_topic_words_from_counts_by_other_classes(spark):
    rows = [("s1", "en", "film film plot"), ("s1", "de", "film kino"), ("s2", "en", "plot plot end"), (None, "en", "film lost"), ("s2", None, "kino end")]
    df = spark.createDataFrame(rows, "source string, lang string, sentence string")
    counts = tp.class_word_counts(df, ["source", "lang"])
    for c in ("source", "lang"):
        assert sorted(map(tuple, tp.topic_word_scores(df, c, counts=counts).collect())) == sorted(map(tuple, tp.topic_word_scores(df, c).collect()))


def test_rejected_requests_are_found_without_splitting(spark):
    t = F.regexp_replace(F.coalesce("text", F.lit("")), rf"(?U)^{tx.WS}+|{tx.WS}+$", "")
    some = F.filter(F.transform(tx.sentence_array(t), lambda x: tx.strip_ws(x)), lambda x: F.length(x) > 0)
    reason = F.when(F.length(t) == 0, "empty").when(F.size(some) == 0, "no_sentences")
    x = tt.reject_split(_odd(spark).withColumn("want_text", t).withColumn("want", reason), "text")
    assert x.where("not (text <=> want_text) or not (reject_reason <=> want)").collect() == []
    assert {r[0] for r in x.select("reject_reason").distinct().collect()} == {None, "empty", "no_sentences"}
    assert "split(" not in tt.reject_split(_odd(spark), "text")._jdf.queryExecution().analyzed().toString()


def test_guarded_patterns_equal_the_patterns_alone(spark):
    c = F.col("text")
    clean = F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?U)<br{tx.WS}*/?>", " ")
    clean = F.regexp_replace(clean, rf"(?U)http{tx.NON_WS}+|www\.{tx.NON_WS}+", "")
    clean = F.trim(F.regexp_replace(clean, rf"(?U){tx.WS}+", " "))
    alts = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    s = F.regexp_replace(c, rf"(?i)(^|[^\p{{L}}\p{{N}}_])({alts})\.", "$1$2\u0002")
    s = F.split(F.translate(F.regexp_replace(s, rf"(?U)([.!?]+[\"')\]]*){tx.WS}+", "$1\u0001"), "\u0002", "."), "\u0001")
    x = _odd(spark).select("text", clean.alias("c"), tx.clean_text("text").alias("c2"), s.alias("s"), tx.sentence_array("text").alias("s2"))
    assert x.where("not (c <=> c2) or not (s <=> s2)").collect() == []
    plan = _odd(spark).select(tx.sentence_array("text"))._jdf.queryExecution().analyzed().toString()
    assert "Contains(lower(text" in plan


def test_broadcast_values_need_no_package(spark, monkeypatch):
    """Broadcast values are plainly pickled: a class of this package in them would have to be importable by the Python workers."""
    import pickle

    from pyspark import SparkContext

    from reviewlens.operators import analyze as an

    sent, broadcast = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: sent.append(pickle.dumps(value)) or broadcast(self, value))
    df = spark.createDataFrame([(1, "great fun film"), (2, "boring film")], "review_id long, review_text string")
    docs = fe.document_tokens(df, {})
    vocab = fe.top_terms(fe.term_totals(docs), 1, 9)
    assert fe.vocabulary_counts(docs, vocab).count() > 0
    idf = fe.fit_idf(vocab, 2)
    assert an.LinearTextModel(idf, idf.select("term", F.col("idf").alias("coef")), 0.0).predict(df, "review_id", "review_text").count() == 2
    assert len(sent) == 2 and not any(b"reviewlens" in x for x in sent)


def test_keywords_of_documents_without_a_language(spark):
    from reviewlens.plans import topic_queries as tq

    s = spark.createDataFrame([("s1", "en", "film plot"), ("s1", None, "film lost"), ("s2", "de", "kino film")], "source string, lang string, sentence string")
    got = tq._corpus_keywords(s, tp.class_word_counts(s, ["source", "lang"])).collect()
    assert sorted((r["aspect"], r["aspect_order"], r["keyword"]) for r in got) == [("lang:de", 0, "film"), ("lang:de", 0, "kino"), ("lang:en", 1, "film"), ("lang:en", 1, "plot")]
