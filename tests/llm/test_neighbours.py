import numpy as np
import pytest

from reviewlens.llm import nn_descent

SCHEMA = "vec_id long, embedding array<float>, label int, node string"


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), v, 0, "n") for i, v in zip(ids, x)], SCHEMA)


def test_recall(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 12)).astype(np.float32)
    x[500:560] = x[500]               # equal vectors: ties go to the smaller id
    got = nn_descent.nearest(frame(spark, range(900), x.tolist()), query_every=50, p=nn_descent.Params(block=200)).collect()
    hit = 0
    for q in range(0, 900, 50):
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(900), d))[:10]
        assert [r["rank"] for r in own] == list(range(1, 11)) and q not in [r["vec_id"] for r in own]
        assert [r["score"] for r in own] == pytest.approx([d[r["vec_id"]] for r in own], abs=1e-12)
        assert own == sorted(own, key=lambda r: (r["score"], r["vec_id"]))
        hit += len({r["vec_id"] for r in own} & set(best.tolist()))
    assert hit >= 0.95 * 180
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 500] == list(range(501, 511))


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    x = [[1.0, 0.0], [0.0, 1.0], None, [0.0, 0.0], [nan, 1.0], [None, 1.0], [inf, 1.0], [1.0, 2.0, 3.0], [], [2.0, 2.0], [1.0, 0.0]]
    docs = frame(spark, range(0, 1100, 100), x).union(spark.createDataFrame([(None, [1.0, 1.0], 0, "n"), (0, [1.0, 0.0], None, None)], SCHEMA))
    got = nn_descent.nearest(docs).collect()
    assert {r["query_id"] for r in got} == {0, 100, 900, 1000}
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 0] == [1000, 100, 900]
    assert nn_descent.nearest(docs.where("1 = 0")).count() == 0
    assert nn_descent.nearest(docs.where("vec_id = 0")).count() == 0
