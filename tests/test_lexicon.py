import math

from reviewlens.operators import lexicon as lx


def _score(spark, texts, lex=(("good", 1.9), ("bad", -2.5))):
    lexicon = spark.createDataFrame(list(lex), "token string, valence double")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "review_id long, review_text string")
    return {r["review_id"]: r["compound"] for r in lx.lexicon_scores(df, lexicon).collect()}


def norm(s):
    return round(s / math.sqrt(s * s + 15), 4)


def test_rules(spark):
    out = _score(spark, ["a good film", "not good at all", "very good film", "GOOD film here",
                         "good but bad", "good film!!", "nothing to see", "not very good"])
    assert out[0] == norm(1.9)
    assert out[1] == norm(1.9 * -0.74)
    assert out[2] == norm(1.9 + 0.293)
    assert out[3] == norm(1.9 + 0.733)                       # caps emphasis (some words not caps)
    assert out[4] == norm(1.9 * 0.5 - 2.5 * 1.5)
    assert out[5] == norm(1.9 + 2 * 0.292)
    assert out[6] == 0.0
    assert out[7] == norm((1.9 + 0.293) * -0.74)              # booster at distance 1, negation at 2


def test_labels_thresholds(spark):
    df = spark.createDataFrame([(0.05,), (-0.05,), (0.049,), (0.0,)], "c double")
    assert [r[0] for r in df.select(lx.compound_label("c")).collect()] == ["positive", "negative", "neutral", "neutral"]


def test_mismatch_null_safe(spark):
    lexicon = spark.createDataFrame([("good", 1.9)], "token string, valence double")
    df = spark.createDataFrame([(0, "good stuff here", None), (1, "good stuff here", "positive")],
                               "review_id long, review_text string, sentiment string")
    r = {x["review_id"]: x["mismatch"] for x in lx.lexicon_labels(df, lexicon).collect()}
    assert r == {0: True, 1: False}


def test_phrase_rules(spark):
    texts = ["never so good", "never been this good", "without doubt good", "without a doubt good", "kind of good", "kind of bad", "least good", "at least good",
             "bad ass", "a kiss of death", "good kind of", "never good", "the very least good", "kind of very good", "not without doubt bad"]
    out = _score(spark, texts, (("good", 1.9), ("bad", -2.5), ("death", -2.9), ("kind", 2.4)))
    so = 0.293      # "so" is a booster too
    want = [(1.9 + so) * 1.25, 1.9 * 1.25, 1.9, 1.9, 1.9 - 0.293, -2.5 + 0.293, 1.9 * -0.74, 1.9, 1.5, -1.5, 1.9, 1.9 * -0.74, 1.9 + 0.293 * 0.95, 1.9 + 0.293 - 0.293, -2.5 * -0.74]
    assert [out[i] for i in range(len(texts))] == [norm(x) for x in want]


def test_phrase_tables_are_parameters(spark):
    lexicon = spark.createDataFrame([("good", 1.9), ("gold", 1.0)], "token string, valence double")
    df = spark.createDataFrame([(0, "as good as gold"), (1, "a bit of good"), (2, "gold")], "review_id long, review_text string")
    out = lx.lexicon_scores(df, lexicon, idioms=[("good as gold", 3.0)], phrase_dampeners=["bit of"]).collect()
    assert {r["review_id"]: r["compound"] for r in out} == {0: norm(6.0), 1: norm(1.9 - 0.293), 2: norm(1.0)}
    out = lx.lexicon_scores(df, lexicon, idioms=[], phrase_dampeners=[]).collect()
    assert {r["review_id"]: r["compound"] for r in out} == {0: norm(2.9), 1: norm(1.9), 2: norm(1.0)}
