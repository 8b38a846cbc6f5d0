import math
import pathlib

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from reviewlens.operators import analyze as an
from reviewlens.operators import features as fe
from reviewlens.operators import model as md
from reviewlens.session import scratch_path
from reviewlens.sources import tables
from reviewlens.streaming import score as sm

TEXTS = [("great fun film loved it", "positive"), ("boring slow plot hated it", "negative"),
         ("great acting loved cast", "positive"), ("awful boring mess", "negative"),
         ("fun great music", "positive"), ("slow awful plot", "negative"),
         ("loved the story great", "positive"), ("hated boring acting", "negative")] * 3


def _train(spark):
    df = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(TEXTS)], "review_id long, review_text string, sentiment string")
    counts = fe.term_counts(df)
    vocab = fe.fit_vocabulary(counts)
    idf = fe.fit_idf(vocab, df.count())
    return df, counts, vocab, idf


def test_lr_gradient_near_zero(spark):
    df, _, _, idf = _train(spark)
    pipe = md.feature_pipeline(idf)
    feats = md.featurize(df, pipe)
    model = md.fit_logistic(feats)
    rows = feats.collect()
    x = np.array([r["features"].toArray() for r in rows])
    y = np.array([1.0 if r["sentiment"] == "positive" else 0.0 for r in rows])
    w = np.ones(len(y))                                       # balanced classes -> weight 1
    beta, b = model.coefficients.toArray(), model.intercept
    p = 1 / (1 + np.exp(-(x @ beta + b)))
    grad = (w * (p - y)) @ x + beta                           # C * sum w (p - y) x + beta, C = 1
    assert np.abs(grad).max() < 1e-3 and abs(float(np.sum(w * (p - y)))) < 1e-3


def test_stream_equals_batch(spark):
    df, counts, vocab, idf = _train(spark)
    coef, b = md.linear_weights(counts, df.select("review_id", "sentiment"), vocab)
    model = an.LinearTextModel(idf, coef, b)
    src, sink = scratch_path(spark, "t_src"), scratch_path(spark, "t_sink")
    df = df.select("review_id", "review_text").union(spark.createDataFrame([(9001, "  "), (9002, None)], "review_id long, review_text string"))
    df.repartition(3).write.json(src)
    bad = ['{"review_id": 1, "review_te', '[1, 2]', 'no json', '{"review_id": "x", "review_text": "y"}', "  "]
    spark.createDataFrame([(b,) for b in bad], "value string").coalesce(1).write.mode("append").text(src)
    responses, rejects = scratch_path(spark, "t_responses"), scratch_path(spark, "t_rejects")
    sm.score_stream(spark, src, sink, scratch_path(spark, "t_ck"), model, responses_dir=responses, rejects_dir=rejects).awaitTermination()
    streamed = sm.read_sink(spark, sink).select("review_id", "pos", "aspect", "sentiment")
    accepted, rejected, batch = an.analyze_reviews(df, model)
    overall = lambda d: sorted(map(tuple, d.select("review_id", "overall_sentiment").collect()))
    assert overall(spark.read.parquet(responses)) == overall(accepted)
    refused = spark.read.parquet(rejects).collect()
    assert {r["review_id"] for r in refused if r["line"] is None} == {r["review_id"] for r in rejected.collect()} == {9001, 9002}
    assert sorted(r["line"] for r in refused if r["reject_reason"] == "malformed") == sorted(bad[:4])
    in_batch = tables.read_requests_json(spark, src)
    assert sorted(r["malformed"] for r in in_batch.where("malformed is not null").collect()) == sorted(bad[:4])
    assert in_batch.where("malformed is null").count() == df.count()
    batch = batch.select("review_id", "pos", "aspect", "sentiment")
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))
    out = scratch_path(spark, "t_counts")
    sm.count_stream(spark, sink, out, scratch_path(spark, "t_ck2")).awaitTermination()
    c = {(r["aspect"], r["sentiment"]): r["n"] for r in sm.read_counts(spark, out).collect()}
    bc = {(r["aspect"], r["sentiment"]): r["count"] for r in batch.groupBy("aspect", "sentiment").count().collect()}
    assert c == bc


def test_replayed_batches_count_once(spark, monkeypatch):
    """R1 dies after writing a batch, before and after its commit marker, and R2 dies after writing its totals; all are started again."""
    df, counts, vocab, idf = _train(spark)
    coef, b = md.linear_weights(counts, df.select("review_id", "sentiment"), vocab)
    model = an.LinearTextModel(idf, coef, b)
    src, sink, ck, out, ck2 = (scratch_path(spark, f"r_{n}") for n in ("src", "sink", "ck", "out", "ck2"))
    df.select("review_id", "review_text").repartition(3).write.json(src)
    real, calls = sm.commit, []

    def dying(session, sink_dir, batch_id):
        calls.append(batch_id)
        if len(calls) == 1:
            raise RuntimeError("dies before the marker")
        real(session, sink_dir, batch_id)
        if len(calls) == 3:
            raise RuntimeError("dies after the marker")

    monkeypatch.setattr(sm, "commit", dying)

    def count():
        sm.count_stream(spark, sink, out, ck2).awaitTermination()

    for _ in range(6):
        try:
            sm.score_stream(spark, src, sink, ck, model, files_per_batch=1).awaitTermination()
            break
        except StreamingQueryException:
            count()     # what is visible so far
    assert calls[:2] == [0, 0] and sorted(set(calls)) == [0, 1, 2]
    count()
    # R2 dies before Spark notes its batch: the same batch is handed out again
    noted = pathlib.Path(ck2.removeprefix("file:"), "commits")
    last = max(int(p.name) for p in noted.iterdir() if p.name.isdigit())
    for p in [noted / str(last), *noted.glob(f".{last}.crc")]:
        p.unlink()
    count()
    _, _, batch = an.analyze_reviews(df.select("review_id", "review_text"), model)
    want = {(r["aspect"], r["sentiment"]): r["count"] for r in batch.groupBy("aspect", "sentiment").count().collect()}
    assert {(r["aspect"], r["sentiment"]): r["n"] for r in sm.read_counts(spark, out).collect()} == want


def test_final_table_missing(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="aspect table not found"):
        tables.read_final_table(spark, str(tmp_path / "none"))


def test_encoder(spark):
    df = spark.createDataFrame([(0, "a b a, c"), (1, "")], "review_id long, review_text string")
    vocab = fe.fit_encoder_vocab(df, vocab_size=2)
    enc = {r["review_id"]: r for r in fe.encode_fixed(df, vocab, length=8).collect()}
    assert {r["token"]: r["token_id"] for r in vocab.collect()} == {",": 5, "a": 6}   # df ties: token ascending
    assert enc[0]["input_ids"] == [2, 6, 1, 6, 5, 1, 3, 0]                           # [CLS] a b a , c [SEP] [PAD]
    assert enc[0]["attention_mask"] == [1] * 7 + [0]
    assert enc[1]["input_ids"] == [2, 3, 0, 0, 0, 0, 0, 0]
