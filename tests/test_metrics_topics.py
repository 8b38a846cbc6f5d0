from pyspark.sql import functions as F

from reviewlens.functions import aspects as fa
from reviewlens.operators import analyze as an
from reviewlens.operators import metrics as mt
from reviewlens.operators import topics as tp
from reviewlens.sources import dictionaries as d


def test_metrics_edges(spark):
    pred = spark.createDataFrame([("m", "a", "b"), ("m", "a", "b"), ("m", "b", "b"), ("m", "b", "c"),
                                  ("ok", "a", "a"), ("ok", "b", "b")], "model_id string, y string, p string")
    pc = {(r["model_id"], r["class"]): r for r in mt.per_class(pred).collect()}
    assert pc[("m", "a")]["precision"] == 0.0 and pc[("m", "a")]["recall"] == 0.0   # never predicted
    assert pc[("m", "c")]["recall"] == 0.0 and pc[("m", "c")]["n_true"] == 0        # absent from truth
    assert pc[("m", "b")]["precision"] == 1 / 3 and pc[("m", "b")]["recall"] == 0.5
    f = {r["model_id"]: r["f1_macro"] for r in mt.macro_f1(pred).collect()}
    assert f["ok"] == 1.0 and abs(f["m"] - (2 * (1 / 3) * 0.5 / (1 / 3 + 0.5)) / 3) < 1e-12
    cm = {(r["model_id"], r["y"]): (r["a"], r["b"], r["c"]) for r in mt.confusion_matrix(pred, ["a", "b", "c"]).collect()}
    assert cm[("m", "a")] == (0, 2, 0) and cm[("m", "c")] == (0, 0, 0) and cm[("ok", "a")] == (1, 0, 0)
    best = {r["model_id"]: r["best"] for r in mt.compare_models(pred).collect()}
    assert best == {"ok": True, "m": False}


def test_logit_argmax(spark):
    df = spark.createDataFrame([([0.1, 0.9],), ([0.5, 0.5],)], "l array<double>")
    assert [r[0] for r in df.select(mt.logit_argmax("l")).collect()] == [1, 0]


def test_keyword_aspect(spark):
    df = spark.createDataFrame([("The castle was big",), ("Outer space",), ("Script and score",), ("Nothing here",)], "s string")
    assert [r[0] for r in df.select(fa.keyword_aspect("s")).collect()] == ["Acting", "Pacing", "Music/Score", "General"]


def test_topic_to_aspect(spark):
    words = spark.createDataFrame(
        [(0, w) for w in ["music", "song", "film"]] + [(1, "plot")] + [(2, w) for w in ["acting", "cast", "plot", "story"]]
        + [(-1, w) for w in ["music", "song"]], "topic_id int, word string")
    m = {r["topic_id"]: r["aspect"] for r in tp.topic_aspects(words, tp.keyword_table(spark)).collect()}
    assert m == {0: "Music/Score", 2: "Acting"}            # topic 1 unmapped, ties to the first aspect, -1 never
    rep = {r["topic_id"]: r for r in tp.mapping_report(words, tp.keyword_table(spark), tp.topic_aspects(words, tp.keyword_table(spark))).collect()}
    assert rep[1]["status"] == "unmapped" and rep[1]["top_words"] == "plot"
    assert rep[2]["matched_words"] == "acting,cast"


def test_topic_numbering_and_words(spark):
    rows = [(i, 0, "a") for i in range(40)] + [(100 + i, 0, "b") for i in range(35)] + [(200 + i, 0, "c") for i in range(5)]
    s = spark.createDataFrame(rows, "review_id long, pos int, cl string")
    m = {r["cluster"]: r["topic_id"] for r in tp.number_topics(s, "cl").collect()}
    assert m == {"a": 0, "b": 1, "c": -1}
    docs = spark.createDataFrame([(0, "red red blue"), (0, "red green"), (1, "blue blue")], "topic_id int, sentence string")
    w = {(r["topic_id"], r["word"]): r for r in tp.topic_word_scores(docs).collect()}
    # A = int((5 + 2) / 2) = 3; f(red) = 3 -> W = 3/5 * ln(1 + 1)
    import math
    assert abs(w[(0, "red")]["score"] - 0.6 * math.log(2.0)) < 1e-12 and w[(0, "red")]["rank"] == 1


def test_gauge_and_percent(spark):
    df = spark.createDataFrame([(0, 0), (13, 7), (7, 13), (1, 1), (1, 7), (3, 5)], "p int, n int")
    pct, label = an.gauge(F.col("p"), F.col("n"))
    r = [(x[0], x[1]) for x in df.select(pct, label).collect()]
    assert r == [(50, "N/A"), (65, "Positive"), (35, "Negative"), (50, "Mixed / Neutral"), (12, "Negative"), (38, "Mixed / Neutral")]
    p2, n2, l2 = an.percent_split(F.col("p"), F.col("n"))
    r2 = df.select(p2, n2, l2).collect()
    assert tuple(r2[0]) == (None, None, "N/A") and tuple(r2[4]) == (12, 88, None)


def test_summary_null_aspect(spark):
    final = spark.createDataFrame([("Acting", "positive"), ("Acting", "positive"), (None, "negative")],
                                  "aspect string, sentence_sentiment string")
    r = {x["aspect"]: x for x in an.aspects_summary(final).collect()}
    assert set(r) == {"Acting"} and r["Acting"]["negative"] == 0 and r["Acting"]["total_sentences"] == 3
