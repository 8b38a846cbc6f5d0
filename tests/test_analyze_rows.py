"""Reviews are analysed inside their rows: as by grouping their scored sentences, also for repeated and null ids, and without a shuffle of texts."""

from pyspark.sql import functions as F

from reviewlens.functions import aspects as fa
from reviewlens.operators import analyze as an
from reviewlens.operators import features as fe
from reviewlens.operators import ids
from reviewlens.operators import model as md
from reviewlens.operators import text as tt

TEXTS = ["Great fun film. Great  fun! Boring plot?", "boring film plot", None, "", " \u0001 ", "Mr. X saw it. \u0002 fun\u0001plot film", "ΑΣ. ΑΣΑ film. fun", "Kino! kino? Film plot (great.) fun ..."]


def _model(spark):
    df = spark.createDataFrame([(i, t or "") for i, t in enumerate(TEXTS)], "review_id long, review_text string")
    docs = fe.document_tokens(df, {})
    idf = fe.fit_idf(fe.top_terms(fe.term_totals(docs), 1, 30), len(TEXTS))
    return an.LinearTextModel(idf, idf.select("term", (F.pmod(F.hash("term"), F.lit(7)) - 3.0).alias("coef")), 0.1)


def _grouped(requests, model):
    """The same by grouping the scored sentences of an id, and scoring the whole texts."""
    ok = tt.reject_split(requests, "review_text").where("reject_reason is null").select("review_id", "review_text")
    s = model.predict(tt.explode_sentences(ok, "review_text", ["review_id"], min_len=0).withColumn("aspect", fa.keyword_aspect("sentence")),
                      ["review_id", "pos"], "sentence", carry=("sentence", "aspect"))
    bd = s.groupBy("review_id").agg(F.array_sort(F.collect_list(F.struct("pos", "sentence", "aspect", "sentiment"))).alias("breakdown"))
    return model.predict(ok, "review_id", "review_text", out="overall_sentiment").join(bd, "review_id", "left"), s


def _rows(df):
    return sorted(map(str, df.collect()))


def test_rows_equal_the_grouped_form(spark):
    model = _model(spark)
    once = [(i, t) for i, t in enumerate(TEXTS * 3)]
    twice = once + [(0, TEXTS[0]), (1, "fun. Great film."), (2, "fun"), (None, "fun film. Plot."), (None, "fun film. Plot.")]
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for rows, per_batch in ((once, 10000), (once, 2), (twice, 3), (once[2:4], 5)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(per_batch))      # reviews go on over several batches
            df = spark.createDataFrame(rows, "review_id long, review_text string").coalesce(2)
            accepted, rejected, s = an.analyze_reviews(df, model)
            want, sentences = _grouped(df, model)
            assert accepted.columns == want.columns and _rows(accepted) == _rows(want)
            assert s.columns == sentences.columns and _rows(s) == _rows(sentences)
            assert _rows(an.breakdown_flat(accepted)) == _rows(an.breakdown_flat(want))
            assert rejected.count() == sum(not (t or "").strip(" \u0001") for _, t in rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_texts_of_single_ids_are_not_shuffled(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "review_id long, review_text string")
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    accepted, _, s = an.analyze_reviews(df, _model(spark))
    assert "Exchange" not in plan(an.breakdown_flat(accepted)) and "Exchange" not in plan(s)
    docs = fe.document_tokens(df, {"rows": F.count(F.lit(1))}, alone={"rows": F.lit(1).cast("long")})
    assert "Exchange" not in plan(docs)


def test_tokens_of_single_ids_equal_the_grouped_ones(spark):
    some = [(1, "a b", "positive"), (2, "film fun", "negative"), (3, None, "positive")]
    for rows in (some, some + [(1, "c d", "negative"), (None, "fun", "positive")], some + [(None, "fun", "negative"), (None, "plot", None)]):
        df = spark.createDataFrame(rows, "review_id long, review_text string, sentiment string")
        good = F.col("sentiment") == "positive"
        keep = {"good": F.count_if(good)}
        plain = lambda d: sorted((str(r[0]), sorted(map(tuple, r[1])), r[2]) for r in d.collect())
        docs = fe.document_tokens(df, keep, alone={"good": F.coalesce(good, F.lit(False)).cast("long")})
        assert plain(docs) == plain(fe.document_tokens(df, keep))
        vocab = fe.top_terms(fe.term_totals(docs), 1, 9)
        counts = fe.vocabulary_counts(docs, vocab, carry=("good",))
        want = fe.vocabulary_counts(docs, vocab)
        assert counts.columns == ["review_id", "good", "term", "n"] and _rows(counts.drop("good")) == _rows(want)
        assert {r["good"] for r in counts.where("review_id = 2").collect()} == {0}


def test_weights_from_carried_labels_equal_the_join(spark):
    counts = spark.createDataFrame([(1, 2, 0, "a", 1), (1, 2, 0, "b", 2), (2, 0, 1, "a", 1)], "review_id long, positive long, negative long, term string, n long")
    labels = spark.createDataFrame([(1, "positive"), (1, "positive"), (2, "negative"), (3, "negative")], "review_id long, sentiment string")
    vocab = counts.select("term").distinct()
    (g, b), (want, b2) = md.linear_weights(counts, labels, vocab, labelled=("positive", "negative")), md.linear_weights(counts.drop("positive", "negative"), labels, vocab)
    assert b == b2 and _rows(g) == _rows(want)


def test_keys_on_more_rows(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k long")
    again = ids.repeated_keys(df, "k")
    assert _rows(ids.on_key(df, "k", again, "left_anti")) == _rows(df.where("k = 1 or k is null")) and ids.on_key(df, "k", again, "left_semi").count() == 2
    assert ids.repeated_keys(df.distinct(), "k") is None


def test_reviews_carry_columns_of_their_documents(spark, tmp_path):
    from reviewlens.plans import common
    from reviewlens.plans import topic_queries as tq

    text = "A film of some length that is kept as a review. It has two sentences here."
    for extra in ([], [(1, text + " Again.", "fr", "s9", 1)]):
        sf = str(tmp_path / f"sf{len(extra)}")
        rows = [(i, f"{text} Number {i}.", "en" if i % 2 else None, f"s{i % 3}", 1) for i in range(9)] + extra
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(i, i % 2, 0) for i in range(6)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        cols = ["doc_id", "review_id", "review_text", "source", "lang"]
        plain, carried = common.reviews(spark, sf), common.reviews(spark, sf, tq.DOCUMENT)
        got = tq._with_document(spark, sf, carried, tq.DOCUMENT).select(cols)
        assert _rows(got) == _rows(tq._with_document(spark, sf, plain, tq.DOCUMENT).select(cols))
        if not extra:
            assert tq._with_document(spark, sf, carried, tq.DOCUMENT) is carried
