import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from reviewlens.llm import graph, lpf_dedup, part_enum

from .conftest import frame


def noisy(rng, words, share):
    return " ".join(rng.choice(VOCABULARY) if rng.random() < share else w for w in words)


VOCABULARY = [a + b + c for a in "bdfgk" for b in ("al", "er", "in", "os") for c in ("", "na", "to", "rim")]


def corpus(seed=1):
    """Copies, near copies, a shared passage, short texts."""
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(VOCABULARY) for _ in range(n))
    base, passage = text(140).split(), text(57)
    out = [text(rng.randint(1, 200)) for _ in range(60)]
    out += [noisy(rng, base, rng.choice([0.004, 0.01, 0.03, 0.06])) for _ in range(80)]
    out += [text(rng.randint(4, 30)) + " " + passage + " " + text(rng.randint(4, 30)) for _ in range(60)]
    out += out[:10] + [base and " ".join(base).upper()] * 40 + ["one", "ONE", "one two three", "", " ", None, "ü " * 90]
    rng.shuffle(out)
    return out


def plain_components(texts, words, least, of):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    label = list(range(len(texts)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and of * both >= least * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def check_join(spark, texts, join):
    docs = frame(spark, [(i, t, "", "", 0) for i, t in enumerate(texts)])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in part_enum.cluster(docs, join).collect()}
    assert [got[i] for i in range(len(texts))] == plain_components(texts, join.words, join.least, join.of)


def test_join_finds_every_link(spark):
    check_join(spark, corpus(), part_enum.Join(4, 85, 100))


def test_join_with_hot_groups(spark, monkeypatch):
    """Groups over the small size go through clusters and blocks."""
    monkeypatch.setattr(part_enum, "SMALL", 4)
    check_join(spark, corpus(2), part_enum.Join(5, 80, 100))


def test_join_with_a_hot_group_in_one_batch(spark):
    """More sets on a signature than a small group holds, all from one Arrow batch."""
    texts = [" ".join(VOCABULARY * 2) + f" last{i}" for i in range(100)]
    docs = frame(spark, [(i, t, "", "", 0) for i, t in enumerate(texts)]).coalesce(1)
    assert part_enum.SMALL < 99
    assert {r["component_id"] for r in part_enum.cluster(docs).collect()} == {0}


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(4)
    points = part_enum.Points(part_enum.Join(4, 85, 100))
    for _ in range(1500):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(1, 2 ** 62, n).astype(np.uint64))
        drop, add = int(rng.integers(0, n // 5 + 1)), int(rng.integers(0, n // 5 + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(1, 2 ** 62, add).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if both and 100 * both >= 85 * (len(a) + len(b) - both):
            sig, whose = part_enum.signatures([a, b], points)
            assert np.array_equal(a, b) or len(np.intersect1d(sig[whose == 0], sig[whose == 1]))
            ha, hb = (np.frombuffer(part_enum.histogram(x), np.uint8).astype(int) for x in (a, b))
            assert np.abs(ha - hb).sum() <= part_enum.allowed_difference(len(a), len(b), points.join)


def test_join_edges(spark, edges, nothing):
    rows = part_enum.cluster(edges).collect()
    assert len(rows) == edges.count()
    assert {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] in (4, 5)} == {4: 4, 5: 4}
    assert [r["n_shingles"] for r in rows if r["doc_id"] in (0, 1, 2)] == [0, 0, 0]
    assert part_enum.cluster(nothing).count() == 0
    kept = part_enum.one_of_each(edges)
    assert kept.columns == edges.columns and kept.where("doc_id in (4, 5)").count() == 1 and kept.where("doc_id = 3").count() == 1


def test_one_of_each_decides_by_row(spark):
    """Rows without an id and rows that repeat one: each stands or goes with its own component."""
    near = lambda name, last: " ".join(f"{name}{i}" for i in range(60)) + f" {last}"
    rows = [(1, near("a", "x")), (None, near("a", "y")), (None, near("b", "x")), (None, near("b", "y")), (None, near("c", "x")),
            (5, near("d", "x")), (5, near("a", "z")), (6, near("d", "y")), (7, near("e", "x")), (7, near("e", "y")), (7, near("e", "y").upper()),
            (None, ""), (None, ""), (None, None), (7, "")]
    kept = part_enum.one_of_each(frame(spark, [(i, t, "", "", 0) for i, t in rows])).collect()
    got = sorted((r["doc_id"] or 0, (r["text"] or "-")[:1].lower()) for r in kept)
    assert got == [(0, "-"), (0, "-"), (0, "b"), (0, "c"), (1, "a"), (5, "d"), (7, "-"), (7, "e")]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 120), (120, 110), (7, 7)]
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 110: 100, 120: 100}


def test_merged_components(spark):
    """A random graph whose edges come in two parts, against plain label propagation."""
    rng = np.random.default_rng(5)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 150, (110, 2))]
    frame = lambda e: spark.createDataFrame(e, "a long, b long")
    labels = graph.merged(graph.merged(None, frame(edges[:60])), frame(edges[60:]))
    want = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in want:
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert {r["node"]: r["label"] for r in labels.collect()} == want
    assert graph.merged(labels, frame([])).count() == len(want)
    assert graph.components(frame([])).count() == 0


def plain_dedup(docs, n):
    out = {}
    starts = {}
    for i, t in docs:
        b = t.encode()
        for k in range(len(b) - n + 1):
            s = b[k:k + n]
            starts[s] = min(starts.get(s, i), i)
    for i, t in docs:
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if starts[b[k:k + n]] < i:
                gone[k:k + n] = b"\1" * n
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def test_dedup_equals_brute_force(spark):
    texts = [t or "" for t in corpus(3)] + ["a" * 200, "a" * 49, "a" * 50, "xy" * 80, "Ü, " * 60, "Ü, " * 20]
    docs = list(enumerate(texts))
    got = lpf_dedup.dedup(frame(spark, [(i, t, "", "", 0) for i, t in docs]).repartition(5)).collect()
    assert {r["doc_id"]: tuple(r)[1:5] for r in got} == plain_dedup(docs, 50)


def test_dedup_slices(monkeypatch):
    monkeypatch.setattr(lpf_dedup, "SLICE", 70)
    rng = random.Random(1)
    text = bytes(rng.choice(b"ab ") for _ in range(1000))
    codes, starts = lpf_dedup.byte_codes(), []
    for group in lpf_dedup.slices([text, b"short"], 300):
        _, _, begin, n, _, _, _ = lpf_dedup.runs(group, codes)
        starts += [x for b, k in zip(begin, n) for x in range(b, b + k)]
    assert sorted(starts) == list(range(1000 - 49))


def test_dedup_edges(spark, edges, nothing):
    rows = lpf_dedup.dedup(edges, keep_text=True).collect()
    assert len(rows) == edges.count()
    assert [r["n_removed"] for r in rows if r["doc_id"] is None] == [0, 0]
    assert all(r["kept_sha256"] == hashlib.sha256(bytes(r["kept"])).hexdigest() for r in rows)
    assert lpf_dedup.dedup(nothing).count() == 0
    assert lpf_dedup.dedup(edges.withColumn("row", F.lit(1)).withColumn("spans", F.lit(2))).count() == edges.count()


def test_smaller_document():
    words = np.array([[1, 1], [1, 2], [1, 1], [1, 1], [0, 9]], np.uint64)
    assert lpf_dedup.smaller_document_has(words, np.array([5, 1, 3, 3, 0])).tolist() == [True, False, False, False, False]
