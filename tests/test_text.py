from pyspark.sql import functions as F

from reviewlens.operators import features as fe
from reviewlens.operators import ids
from reviewlens.operators import text as tt


def _clean(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    return [r[0] for r in df.orderBy("i").select(tt.tx.clean_text("t")).collect()]


def test_clean_text_edges(spark):
    out = _clean(spark, ["Great<br /><br/>film, see http://x.y/z now", "Loud<BR>but   good\tenough",
                         "See www.site.com/a, fine movie", "a b plus padding text", None])
    assert out[0] == "Great film, see now"
    assert out[1] == "Loud<BR>but good enough"          # <br is case-sensitive
    assert out[2] == "See fine movie"                     # URL and the glued comma go
    assert out[3] == "a b plus padding text"              # NBSP is whitespace
    assert out[4] == ""


def test_length_filter_and_labels(spark):
    raw = spark.createDataFrame([(1, "ten chars!", "positive"), (2, "eleven char", "positive"),
                                 (3, "Some longer text here.", None), (4, None, "positive")],
                                "doc_id long, review string, sentiment string")
    r = tt.prepare_reviews(raw).orderBy("review_id").collect()
    assert [x["doc_id"] for x in r] == [2, 3]
    assert [x["review_id"] for x in r] == [0, 1]


def test_sentence_split(spark):
    df = spark.createDataFrame([(0, "Good plot. Bad end! Why?"), (1, "Dr. Smith acted. Ok."),
                                (2, 'He said "no." Then left.'), (3, "no final stop"), (4, "!")],
                               "review_id long, review_text string")
    batch = tt.explode_sentences(df, "review_text", ["review_id"], min_len=4)
    got = {}
    for r in batch.collect():
        got.setdefault(r["review_id"], []).append((r["pos"], r["sentence"]))
    assert [s for _, s in sorted(got[0])] == ["Good plot.", "Bad end!", "Why?"]
    assert [s for _, s in sorted(got[1])] == ["Dr. Smith acted."]          # "Ok." dropped in batch
    assert [s for _, s in sorted(got[2])] == ['He said "no."', "Then left."]
    assert [s for _, s in sorted(got[3])] == ["no final stop"]
    assert 4 not in got
    api = tt.explode_sentences(df.where("review_id = 1"), "review_text", ["review_id"], min_len=0)
    assert sorted((r["pos"], r["sentence"]) for r in api.collect()) == [(0, "Dr. Smith acted."), (1, "Ok.")]


def test_dense_id_many_buckets(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7 + (F.col("id") % 3) * 100000).alias("k"), F.lit("x").alias("v"))
    out = ids.dense_id(df, "k", "rid", rows_per_bucket=300)
    rows = sorted((r["k"], r["rid"]) for r in out.collect())
    assert [rid for _, rid in rows] == list(range(5000))


def test_exact_sample_and_split(spark):
    df = spark.range(0, 3000).select(F.col("id").alias("review_id"), F.lit(0).alias("pos"),
                                     F.when(F.col("id") % 10 < 3, "negative").otherwise("positive").alias("sentiment"))
    s = tt.exact_sample(df, n=1234, seed=42)
    assert s.count() == 1234
    assert tt.exact_sample(df, n=5000).count() == 3000
    sp = fe.stratified_split(df.select("review_id", "sentiment"))
    c = {(r["sentiment"], r["split"]): r["count"] for r in sp.groupBy("sentiment", "split").count().collect()}
    assert c[("negative", "test")] + c[("positive", "test")] == 600            # ceil(0.2 * 3000)
    assert c[("negative", "test")] == 180 and c[("positive", "test")] == 420
    assert sp.select("review_id").distinct().count() == 3000


def test_largest_remainder():
    assert ids.largest_remainder({"a": 1, "b": 1, "c": 1}, 2) == {"a": 1, "b": 1, "c": 0}
    assert sum(ids.largest_remainder({"x": 58, "y": 341}, 319).values()) == 319


def test_reject_split(spark):
    df = spark.createDataFrame([(0, "   "), (1, "fine text."), (2, None)], "review_id long, review_text string")
    r = {x["review_id"]: x["reject_reason"] for x in tt.reject_split(df).collect()}
    assert r == {0: "empty", 1: None, 2: "empty"}


def test_label_map(spark):
    df = spark.createDataFrame([("negative",), ("positive",), ("neutral",), (None,)], "s string")
    r = df.select(tt.label_to_id(F.col("s")).alias("l")).collect()
    assert [x["l"] for x in r] == [0, 1, None, None]
