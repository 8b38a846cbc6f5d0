"""Terms counted inside the rows: totals, vocabulary counts and scores equal the long form, also for repeated and null ids."""

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from reviewlens.operators import analyze as an
from reviewlens.operators import features as fe
from reviewlens.operators import model as md

ROWS = [(1, "great fun film great fun film"), (1, "great fun film great fun film"), (2, "boring film"), (2, "film boring film plot"), (3, None), (4, ""), (5, "fun"),
        (None, "great film"), (None, "fun film"), (6, "Großes Kino, großes kino! the plot")]


def _docs(spark):
    df = spark.createDataFrame(ROWS, "review_id long, review_text string")
    return df, fe.document_tokens(df, {"rows": F.count(F.lit(1))})


def test_totals_and_counts_equal_the_long_form(spark):
    df, docs = _docs(spark)
    long = fe.term_counts(df)
    plain = {r["term"]: (r["df"], r["tf"]) for r in long.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("tf")).collect()}
    assert {r["term"]: (r["df"], r["tf"]) for r in fe.term_totals(docs).collect()} == plain
    vocab = fe.fit_vocabulary(long, 1, 7)
    assert sorted(map(tuple, fe.top_terms(fe.term_totals(docs), 1, 7).select("term", "term_index", "df", "tf").collect())) \
        == sorted(map(tuple, vocab.select("term", "term_index", "df", "tf").collect()))
    known = long.join(vocab.select("term"), "term", "left_semi").select("review_id", "term", "n")
    order = lambda rows: sorted(map(tuple, rows), key=str)
    assert order(fe.vocabulary_counts(docs, vocab).collect()) == order(known.collect())


def test_totals_shuffle_terms_and_not_documents(spark):
    """Only the merge of an id's texts is dealt by id, and terms are dealt by term alone."""
    plan = fe.term_totals(_docs(spark)[1])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(term#") == 1 and "hashpartitioning(review_id" in plan
    assert all("term#" not in line for line in plan.splitlines() if "hashpartitioning(review_id" in line)


def test_index_counts_in_the_order_of_first_places():
    index = fe.TermIndex(["b", "a b", "a", "c a"])
    row, term, n = index.count(pa.array([["a", "b", "a", "b", "x", "a"], None, [], ["c", "a"], ["b"]]))
    assert [(r, index.terms[t], c) for r, t, c in zip(row, term, n)] == [(0, "a", 3), (0, "b", 2), (0, "a b", 2), (3, "a", 1), (3, "c a", 1), (4, "b", 1)]
    none = fe.TermIndex([])
    assert [len(x) for x in none.count(pa.array([["a", "b"]], pa.list_(pa.string())))] == [0, 0, 0]


def test_scores_equal_a_plain_loop(spark):
    df, docs = _docs(spark)
    vocab = fe.top_terms(fe.term_totals(docs), 1, 9)
    idf = fe.fit_idf(vocab, 6)
    coef = idf.select("term", (F.col("term_index") - 4.0).alias("coef"))
    model = an.LinearTextModel(idf, coef, -0.25)
    got = sorted(map(tuple, model.predict(df.withColumn("t", F.col("review_text")), "review_id", "review_text", out="p", carry=("t",)).collect()), key=str)
    table = {r["term"]: (r["idf"], r["term_index"] - 4.0) for r in idf.collect()}
    want = []
    for r in fe.with_terms(df.withColumn("t", F.col("review_text")), "review_text", "terms").collect():
        count = Counter(t for t in r["terms"] or () if t in table)
        dot = sum(n * table[t][0] * table[t][1] for t, n in count.items())
        norm = math.sqrt(sum((n * table[t][0]) ** 2 for t, n in count.items()))
        want.append((r["review_id"], r["t"], "positive" if -0.25 + (dot / norm if norm else 0.0) > 0 else "negative"))
    assert got == sorted(want, key=str)
    assert md.linear_weights(fe.vocabulary_counts(docs, vocab), spark.createDataFrame([(1, "positive"), (2, "negative")], "review_id long, sentiment string"), vocab)[0].count() > 0
