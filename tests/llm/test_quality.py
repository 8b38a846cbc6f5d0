import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlens.llm import byte_conv, line_crf
from reviewlens.llm.common import labelled_sample
from reviewlens.sources import tables

SF = "/root/testdata/sf0.01"


def plain_repeat(text, window):
    words = [w for w in text.replace("\t", " ").replace("\n", " ").split(" ") if w]
    seen, cover = {}, set()
    for i in range(len(words) - window + 1):
        seen.setdefault(tuple(words[i:i + window]), []).append(i)
    for starts in seen.values():
        if len(starts) > 1:
            cover |= {j for i in starts for j in range(i, i + window)}
    return len(words), len(cover)


def test_base_numbers():
    text = "a b c d e f g h i\n\nx # y\tz\na b c d e f g h q\nx # y\tz\n \nü|€ end"
    base, x, sizes = line_crf.describe(text, 8)
    n, repeat = plain_repeat(text, 8)
    assert base[0] == n and base[4] == repeat and base[2] == 3 and base[3] == 1
    assert base[1] == sum(not c.isspace() for c in text) and len(x) == len(sizes) == 5
    no_break = line_crf.describe("a\xa0b \x1f c", 8)[0]
    assert no_break[0] == 3 and no_break[1] == 5      # only the six ASCII characters part words
    assert line_crf.describe("w " * 20, 8)[0][4] == 20


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    crf = line_crf.Crf(rng.normal(size=(line_crf.N_FEATURES, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    x = rng.normal(size=(7, line_crf.N_FEATURES))
    score = lambda p: crf.start[p[0]] + sum(x[i] @ crf.emit[:, k] for i, k in enumerate(p)) + sum(crf.trans[a, b] for a, b in zip(p, p[1:]))
    assert tuple(line_crf.viterbi(x, crf)) == max(itertools.product((0, 1), repeat=7), key=score)
    untrained = line_crf.fit([])
    assert line_crf.viterbi(x, untrained).all()


def test_rules_on_edges(spark, edges, nothing):
    crf = line_crf.fit([])
    rows = line_crf.label_documents(edges, crf).collect()
    assert len(rows) == edges.count()
    assert all(r["base_failed"] and not r["kept"] and r["n_words"] == 0 for r in rows if r["doc_id"] in (0, 1, 2))
    assert line_crf.label_documents(nothing, crf).count() == 0
    assert line_crf.keep_documents(edges, crf).columns == edges.columns
    assert line_crf.train(nothing, tables.table(spark, SF, "labels")).emit.any() == False  # noqa: E712


def test_held_out_accuracy(spark):
    docs, labels = tables.table(spark, SF, "documents"), tables.table(spark, SF, "labels")
    sample = labelled_sample(docs, labels, 100, 20_000)
    assert 0 < len(sample) <= 200 and sample == labelled_sample(docs, labels, 100, 20_000)
    scored = byte_conv.score_documents(docs, byte_conv.train(docs, labels)).join(labels, "doc_id").where("held_out")
    right = scored.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right >= 0.9
    judged = line_crf.label_documents(docs, line_crf.train(docs, labels)).where("not base_failed").join(labels, "doc_id")
    by = {r["quality"]: r["k"] for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert by[1] >= 0.97 and by[0] <= 0.1


def test_chunks_cover_every_byte():
    shape = byte_conv.Shape()
    for n in (0, 1, shape.chunk, shape.chunk + 1, shape.step * 3 + 5):
        data = bytes(i % 251 for i in range(n))
        c = byte_conv.chunks(data, shape)
        joined = np.concatenate([c[0], *(x[shape.chunk - shape.step:] for x in c[1:])])
        assert (joined[:n] == np.frombuffer(data, np.uint8)).all() and (joined[n:] == byte_conv.PAD).all() and len(joined) >= n


def test_gradients():
    shape = byte_conv.Shape(embed=3, filters=4, width=4, stride=2, places=5, hidden=3)
    rng = np.random.default_rng(1)
    net = {k: v.astype(np.float64) for k, v in byte_conv.untrained(shape, rng).items()}
    batch = [byte_conv.chunks(rng.integers(0, 255, n, dtype=np.uint8).tobytes(), shape) for n in (30, 9)]
    y, w = np.array([1.0, 0.0]), np.array([0.5, 0.5])
    first = np.cumsum([0] + [len(b) for b in batch[:-1]])

    def loss():
        p = byte_conv.combine(np.maximum((byte_conv.windows(np.vstack(batch), net["embed"], shape) @ net["conv"])
                                         .reshape(-1, shape.places, shape.filters).max(1) + net["conv_bias"], 0), first, net)
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    g = byte_conv.gradients(batch, y, w, net, shape)
    for k in ("conv", "dense", "out", "conv_bias"):
        at = tuple(0 for _ in net[k].shape)
        old, e = net[k][at], 1e-5
        net[k][at] = old + e
        up = loss()
        net[k][at] = old - e
        down = loss()
        net[k][at] = old
        assert (up - down) / (2 * e) == pytest.approx(float(g[k][at]), abs=1e-4)


def test_scores_on_edges(edges, nothing):
    net = byte_conv.fit([])
    rows = byte_conv.score_documents(edges, net).collect()
    assert len(rows) == edges.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert byte_conv.score_documents(nothing, net).count() == 0
