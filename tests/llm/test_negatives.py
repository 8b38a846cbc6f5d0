import math

import numpy as np
import pytest

from reviewlens.llm import gnat_tree as gt

SCHEMA = "vec_id long, embedding array<float>, label int, uid string, leaf int, v string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], y, "u", 0, "v") for i, v, y in rows], SCHEMA)


def plain(rows):
    last = 1 << 70
    good = [(last if i is None else i, [math.floor(256 * float(np.float32(x))) for x in v], y, n) for n, (i, v, y) in enumerate(rows)
            if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, av, ay, an in good:
        if a == last or a % 50:
            continue
        s = sorted((-sum(x * y for x, y in zip(av, v)), i, n, y) for i, v, y, n in good if n != an)
        for ps, pi, _, _ in [x for x in s if x[3] == ay][:5]:
            fits = [(i, -m) for m, i, _, y in s if y != ay and 50 * -ps <= 100 * -m <= 95 * -ps][:3]
            out += [(a, None if pi == last else pi, r, None if i == last else i, -ps, m) for r, (i, m) in enumerate(fits, 1)]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def vectors(kind, n, rng):
    centres = rng.normal(size=(12, 8))
    for i in range(n):
        v = rng.normal(size=8) if kind == "noise" else centres[i % 12] + 0.05 * rng.normal(size=8)
        yield i, v / np.linalg.norm(v) * (1 if kind != "norms" else rng.uniform(0.1, 4)), int(rng.integers(0, 4))


@pytest.mark.parametrize("kind", ["noise", "clusters", "norms"])
def test_against_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(gt, "LEAF", 20)
    monkeypatch.setattr(gt, "BLOCK", 30)
    monkeypatch.setattr(gt, "CHUNK", 7)
    rows = list(vectors(kind, 400, np.random.default_rng(7)))
    assert got(gt.mine(gt.members(frame(spark, rows)))) == plain(rows)


def test_nulls_ties_copies_and_lengths(spark, monkeypatch):
    monkeypatch.setattr(gt, "LEAF", 8)
    monkeypatch.setattr(gt, "BLOCK", 10)
    rng = np.random.default_rng(3)
    copy = rng.normal(size=6)
    rows = [(i, copy if i % 3 == 0 else rng.integers(-1, 2, size=6) / 2, i % 3) for i in range(120)]
    rows += [(50, None, 1), (100, rows[1][1], None), (200, [1.0, None], 1), (250, [float("nan")] * 6, 1), (300, [float("inf")] * 6, 0), (None, copy, 1), (None, copy * .8, 2)]
    rows += [(400, [], 1), (450, [0.5, 0.25], 2), (500, [0.0] * 6, 0), (550, copy * 1e6, 1), (51, rows[51][1], 0)]
    assert got(gt.mine(gt.members(frame(spark, rows).repartition(3)))) == plain(rows)


def test_empty_and_single(spark):
    assert gt.mine(gt.members(frame(spark, []))).count() == 0
    assert gt.mine(gt.members(frame(spark, [(50, [1.0], 1)]))).count() == 0


def test_elimination_is_safe_and_happens():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16)) * 300
    x = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) * 6)
    top = float((x * x).sum(1).max())
    tree = gt.Tree(x[:1000], 4000, 16, top)
    leaf = tree.place(x, lambda node, d, side: [(tree.near[node].__setitem__((slice(None), j), np.minimum(tree.near[node][:, j], d[side == j].min(0))),
                                                 tree.far[node].__setitem__((slice(None), j), np.maximum(tree.far[node][:, j], d[side == j].max(0)))) for j in np.unique(side)])
    q = x[:50]
    score = q @ x.T
    high = 0.95 * score.max(1)
    low = np.sort(score, axis=1)[:, -60]
    reached = {(a, k) for k, rows, on in tree.survivors(q, low[:, None], high[:, None]) for a in rows[on[:, 0]]}
    needed = {(a, leaf[i]) for a, i in zip(*np.nonzero((score >= low[:, None]) & (score <= high[:, None])))}
    assert needed <= reached and len(reached) < 0.5 * 50 * tree.leaves


def test_requests_are_bounded(spark, monkeypatch):
    """Many leaves: an anchor is sent once per block of neighbouring leaves, never wider than its vector needs, and no task holds more than a piece of its requests."""
    monkeypatch.setattr(gt, "LEAF", 4)
    monkeypatch.setattr(gt, "BLOCK", 64)
    monkeypatch.setattr(gt, "SEND", 2000)
    rng = np.random.default_rng(9)
    rows = [(i, v, y) for i, v, y in vectors("noise", 600, rng)]
    members = gt.members(frame(spark, rows))
    tree = gt.build(members)
    placed = gt.placed(members, tree)
    packed = gt.blocks(placed, tree)
    assert tree.leaves > 60 and packed.count() <= 2 * 600 / 64 and packed.agg({"n": "max"}).first()[0] <= 64
    assert sum(r.n for r in packed.select("n").collect()) == 600
    from pyspark.sql import functions as F
    anchors = placed.where("vec_id % 50 = 0").withColumn("low", F.array(F.lit(float("-inf")))).withColumn("high", F.array(F.lit(float("inf"))))
    asked = gt.requests(anchors, tree, own=True).unionByName(gt.requests(anchors, tree, own=False)).collect()
    assert sum(r.anchors for r in asked) == 12 * packed.count()
    assert all(len(r.wanted) == r.anchors * (16 + 16 + 2 * 8) for r in asked)
    assert got(gt.mine(members)) == plain(rows)
