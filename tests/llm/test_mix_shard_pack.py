import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlens.llm import best_two_fit as b2f
from reviewlens.llm import maglev, weighted_mix as wm

from .conftest import frame


def test_targets_share_by_weight(spark):
    sizes = {"a": 100, "b": 10, "c": 5, "d": 300, None: 40, "e": 0}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in wm.targets(rows).collect()}
    order = sorted(s for s in sizes if s) + [None]
    w = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:     # share what is left by weight until none is above its ceiling
        left = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    for s in order:
        assert got[s] == pytest.approx(3 * sizes[s] if s in capped else share[s])


def test_mix_takes_what_is_due(spark, edges, nothing):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 30) + "#" * rng.randint(0, 3), "en", rng.choice(["a"] * 8 + ["b", "c", None]), 0) for i in range(2000)]
    docs = frame(spark, rows)
    run = lambda: wm.mix(docs, wm.quality_weight(F.col("text")), wm.word_count(F.col("text")), ranges=16).collect()
    got = run()
    assert len(got) == 2000 and sorted(got, key=lambda r: r["doc_id"]) == sorted(run(), key=lambda r: r["doc_id"])
    taken = defaultdict(int)
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        assert r["copies"] in (math.floor(r["target"] / r["source_size"]), math.floor(r["target"] / r["source_size"]) + 1)
    for s in taken:
        assert abs(taken[s] - next(r["target"] for r in got if r["source"] == s)) <= 31
    again = wm.mix(edges.withColumn("size", F.lit("mine")), wm.quality_weight(F.col("text")), wm.word_count(F.col("text")), prefix="_m_")
    assert again.count() == edges.count() and again.where("size = 'mine'").count() == edges.count()
    assert wm.mix(nothing, F.lit(1.0), F.lit(1).cast("long")).count() == 0


@pytest.mark.parametrize("kind", ["no id", "one id", "copies", "copies without id"])
def test_mix_with_null_and_repeated_ids(spark, kind):
    """Half of a source's rows share an id, or the whole row: still within a document of the target. Their columns carry the names of helpers."""
    rows = []
    for i in range(3000):
        half = i % 2 == 0
        text = "word " * 10 + ("same" if half and kind.startswith("copies") else f"t{i}")
        rows.append((None if half and kind.endswith("no id") or half and kind.endswith("without id") else 7 if half else i, text, "ab"[i % 3 == 0], i, "r", "k", 1.5))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, uid int, row string, _mix_size string, key double").repartition(5)
    out = wm.mix(docs, wm.quality_weight(F.col("text")), wm.word_count(F.col("text"))).cache()
    assert out.columns == [*docs.columns, "size", "source_size", "target", "copies", "taken"]
    assert sorted(r["uid"] for r in out.collect()) == list(range(3000)) and out.where("row = 'r' and _mix_size = 'k' and key = 1.5").count() == 3000
    for r in out.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r["taken"] - r["target"]) <= 11, (kind, r)
    again = wm.mix(docs.repartition(9), wm.quality_weight(F.col("text")), wm.word_count(F.col("text")))
    what = lambda d: sorted((r["doc_id"] or 0, r["text"], r["source"], r["copies"]) for r in d.collect())
    assert what(out) == what(again)       # whatever copies are taken, the rows taken are the same


def test_quality_weight(spark):
    texts = ["plain words of a text here " * 9, "a a a a a a a a a a a a a a a a a a a a a a", "### 123 $$ %% && 99 ##", "short", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    w = {r.i: r.w for r in df.select("i", wm.quality_weight(F.col("t")).alias("w")).collect()}
    distinct = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    good = spark.createDataFrame([(distinct,)], "t string").select(wm.quality_weight(F.col("t"))).first()[0]
    assert good > w[0] > w[1] > w[2] and w[3] < good and w[4] == w[5] and all(0 < x <= 1 for x in [good, *w.values()])


def test_mix_handles_very_long_texts_and_ties(spark):
    rows = [(1, "x " * 400_000, "a", None, None)] + [(i, "one two", "a", None, None) for i in range(2, 40)] + [(40, "y", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    out = {r["doc_id"]: r for r in wm.mix(docs, F.lit(1.0), wm.word_count(F.col("text"))).collect()}
    assert out[1]["size"] == 400_000 and len(out) == 40 and all(r["taken"] <= 3 * r["size"] for r in out.values())


def test_lookup_table():
    table = maglev.lookup_table(["a", "b", "c"], 101)
    plain, taken = [None] * 101, {s: 0 for s in "abc"}
    perm = {s: [(maglev.preference(s, 101)[0] + j * maglev.preference(s, 101)[1]) % 101 for j in range(101)] for s in "abc"}
    while None in plain:
        for s in "abc":
            if None in plain:
                plain[next(x for x in perm[s] if plain[x] is None)] = s
    assert list(table) == plain and max(Counter(table).values()) - min(Counter(table).values()) <= 1
    fewer = maglev.lookup_table(["a", "c"], 101)
    assert np.mean([x == y for x, y in zip(table, fewer) if x != "b"]) > 0.6
    for bad in ([], [str(i) for i in range(102)]):
        with pytest.raises(ValueError):
            maglev.lookup_table(bad, 101)


def test_placement(spark, edges, nothing):
    table = maglev.lookup_table([f"s{i}" for i in range(8)], 1009)
    got = maglev.place(edges, table).collect()
    assert len(got) == edges.count() and all(r["shard"] == table[r["slot"]] for r in got)
    assert maglev.place(nothing, table).count() == 0


def one_by_one(sizes, capacity):
    """Best-two-fit on single pieces."""
    left, out = Counter(sizes), []
    while sum(left.values()):
        fill, gap = [], capacity
        while any(n and s <= gap for s, n in left.items()):
            s = max(s for s, n in left.items() if n and s <= gap)
            fill.append(s)
            left[s] -= 1
            gap -= s
        small = fill[-1]
        have = sorted((s for s, n in left.items() if n), reverse=True)
        best = max(((a + b, a, b) for a in have for b in have if b <= a and (a != b or left[a] > 1) and small < a + b <= gap + small), default=None) if gap else None
        if best:
            left[small] += 1
            fill[-1:] = best[1:]
            left[best[1]] -= 1
            left[best[2]] -= 1
        out.append(tuple(sorted(fill)))
    return Counter(out)


def test_patterns_equal_packing_one_by_one():
    rng = random.Random(5)
    for _ in range(30):
        sizes = [min(40, max(1, int(rng.gauss(14, 9)))) for _ in range(rng.randint(0, 150))]
        got = Counter()
        for times, fill in b2f.patterns(Counter(sizes), 40):
            got[tuple(sorted(fill))] += times
        assert got == one_by_one(sizes, 40)


def test_packing_round_trip(spark, edges, nothing):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    odd = ["two  spaces", " lead", "trail ", "a\tb c", "nbsp\xa0 x", "it's they'll", "line.\nNext, one; two", "\n", "done<|endoftext|> more", "中文 字 é ́ x"]
    docs = edges.select("doc_id", "text").union(frame(spark, [(100 + i, x, "", "", 0) for i, x in enumerate(odd)]).select("doc_id", "text"))
    rows = b2f.pack_documents(docs, path, 2, 64).collect()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None and r["doc_id"] != 3}
    for d, text in texts.items():
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        own = sorted(by_doc[d], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == 64 for r in own[1:])
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"]:r["start"] + r["length"]], "<u4").tobytes())
    assert len(by_doc[3]) == 2        # repeated rows are packed as often as they stand
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert b2f.pack_documents(nothing, path).count() == 0
