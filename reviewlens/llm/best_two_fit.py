"""Best-two-fit packing of tokenized documents into sequences of a fixed length.

A sequence is filled greedily with the largest pieces that fit; then its smallest piece gives way to two unpacked pieces
that fill the widened gap more tightly. Pieces of one length are alike, so the packing is worked out on how many
pieces there are of each length (at most ``capacity`` numbers, whatever the size of the corpus): each step makes a pattern of
lengths as many times as the counts allow, which is what packing one by one would do. Spark then numbers the
pieces of each length, and the number names pattern, sequence and offset.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, ship_by_value, stage

ship_by_value(__name__)

MARKS = ".,;:!?"
ASCII_SPACES = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
OTHER_SPACES = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES_MEET = re.compile(r"\s\s|^\s|\s\Z")
TEXTS = 500           # texts of an Arrow batch that are Python strings at once
SPARING = {"most": 400_000, "slots": 1 << 22}      # the word table of workers that other stages' memory stands beside, with half as many texts
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# ---------------------------------------------------------------------------------------------
# tokens and pieces
# ---------------------------------------------------------------------------------------------

class WordIds:
    """Token ids (little-endian uint32 bytes) of space-led words, looked up in a table of the words met before.

    A byte-level BPE splits a text into words before merging. A single space between two characters that are not white space
    always begins such a word, so a text cut there has the same ids piece by piece. Most different words of a corpus are rare: with ``slots``, a word
    stays in the table from the second call that has it, until then only the slot of its hash is marked (less memory, some words are encoded twice)."""

    def __init__(self, tokenizer, most: int = 800_000, slots: int = 0):
        self.tokenizer, self.most, self.slots, self.table = tokenizer, most, slots, {}
        self.met, self.marked = bytearray(slots), 0

    def ids_of(self, texts: list[str]) -> list[bytes]:
        """In parts: an encoding takes far more room than its ids."""
        parts = (texts[i:i + 2_000] for i in range(0, len(texts), 2_000))
        return [array("I", e.ids).tobytes() for part in parts for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]

    def learn(self, words) -> list[str]:
        """Letters with one mark behind them are two words to the tokenizer: the letters are learned, the mark is added. Returns the words added."""
        table = self.table
        if len(table) > self.most:
            self.table = table = {}
        new = [w for w in words if w not in table]
        marked = [w for w in new if w[-1] in MARKS and w[:-1].isalpha()]
        plain = {w for w in new if w[-1] not in MARKS or not w[:-1].isalpha()}
        plain.update(w for w in (x[:-1] for x in marked) if w not in table)
        table.update(zip(plain, self.ids_of([" " + w for w in plain])))
        if marked:
            mark = dict(zip(MARKS, self.ids_of(list(MARKS))))
            table.update((w, table[w[:-1]] + mark[w[-1]]) for w in marked)
        return [*plain, *marked]

    def drop_rare(self, added: list[str]) -> None:
        """Of the words added, those met for the first time leave the table. Slots are cleared when a quarter is marked, or rare words would pass for met ones."""
        if self.marked > self.slots // 4:
            self.met, self.marked = bytearray(self.slots), 0
        table, met, last = self.table, self.met, self.slots - 1
        for w in added:
            at = hash(w) & last
            if not met[at]:
                met[at] = 1
                self.marked += 1
                del table[w]

    def texts_ids(self, texts: list[str]) -> list[bytes]:
        split = [space_led(t) for t in texts]
        later = [w[1:] if w else [] for w in split]
        added = self.learn(set().union(*later))
        heads = self.ids_of([w[0] if w else t for t, w in zip(texts, split)])
        # itemgetter gives one item bare, so single words are looked up on their own
        out = [h + (b"".join(itemgetter(*w)(self.table)) if len(w) > 1 else self.table[w[0]] if w else b"") for h, w in zip(heads, later)]
        if self.slots:
            self.drop_rare(added)
        return out


def space_led(text: str) -> list[str] | None:
    """The text cut at its spaces, or None if some white space stands next to another or at an end."""
    if "\n " in text or " \n" in text or any(c in text for c in ASCII_SPACES) or not text.isascii() and any(c in text for c in OTHER_SPACES):
        if SPACES_MEET.search(text):
            return None
    if not text or "  " in text or text[0] in " \n" or text[-1] in " \n":
        return None
    return text.split(" ")


def known_words(tokenizer_path: str, sparing: bool = False) -> WordIds:
    """This Python worker's table for a tokenizer: Spark gives a worker one task after the other, and what one has learned the next one needs. The
    table is bounded (``most``) and only saves work, so a new worker begins with an empty one."""
    import sys
    import types

    held = sys.modules.setdefault("best_two_fit_worker", types.ModuleType("best_two_fit_worker")).__dict__.setdefault("tables", {})
    if (tokenizer_path, sparing) not in held:
        from tokenizers import Tokenizer

        held[tokenizer_path, sparing] = WordIds(Tokenizer.from_file(tokenizer_path), **SPARING if sparing else {})
    return held[tokenizer_path, sparing]


def cut(ids: bytes, capacity: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32); pieces of ``capacity`` ids, the first one shorter if need be."""
    n = len(ids) // 4
    first = n % capacity or min(n, capacity)
    edges = [0, *range(first, n + 1, capacity)]
    return [(i, a, b - a, zlib.crc32(memoryview(ids)[4 * a:4 * b])) for i, (a, b) in enumerate(zip(edges, edges[1:]))]


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text",
           sparing: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. Null texts are empty: only the end id."""
    import pyarrow as pa

    def run(batches):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"

        known, at_once = known_words(tokenizer_path, sparing), TEXTS // 2 if sparing else TEXTS
        end = np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            for i in range(0, b.num_rows, at_once):
                part = b.slice(i, at_once)
                texts = [t or "" for t in part.column(1).to_pylist()]
                rows = [(d, *p) for d, ids in zip(part.column(0).to_pylist(), known.texts_ids(texts)) for p in cut(ids + end, capacity)]
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int32()] + [pa.int64()] * 3)],
                                                 names=[c.split()[0] for c in PIECES.split(", ")])
                del part, texts, rows, cols
            del b       # before the next one comes
            give_back()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, PIECES)


# ---------------------------------------------------------------------------------------------
# patterns
# ---------------------------------------------------------------------------------------------

def greedy(counts: np.ndarray, gap: int) -> list[int]:
    """Lengths of a sequence filled with the largest pieces that fit."""
    out, used = [], Counter()
    top = gap
    while top > 0:
        fits = np.nonzero(counts[1:top + 1])[0]
        k = len(fits) - 1
        while k >= 0 and counts[fits[k] + 1] - used[int(fits[k]) + 1] <= 0:
            k -= 1
        if k < 0:
            break
        size = int(fits[k]) + 1
        take = min(int(counts[size]) - used[size], gap // size)
        out += [size] * take
        used[size] += take
        gap -= take * size
        top = min(gap, size - 1) if take else size - 1
    return out


def best_two(counts: np.ndarray, used: Counter, gap: int, more_than: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum over ``more_than`` and at most ``gap``; of equal sums the one with the
    larger length."""
    left = counts[:gap + 1].copy()
    for size, n in used.items():
        if size <= gap:
            left[size] -= n
    sizes = np.nonzero(left > 0)[0]
    best = None
    for a in sizes[::-1]:
        a = int(a)
        if 2 * a <= (best[0] if best else more_than):
            break
        partners = sizes[:np.searchsorted(sizes, min(a, gap - a), side="right")]
        if len(partners) and int(partners[-1]) == a and left[a] < 2:
            partners = partners[:-1]
        if len(partners) and a + int(partners[-1]) > (best[0] if best else more_than):
            best = (a + int(partners[-1]), a, int(partners[-1]))
            if best[0] == gap:
                break
    return best and best[1:]


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(times, lengths) of all sequences for ``counts`` pieces of each length."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in counts.items():
        left[size] += n
    out = []
    while left.any():
        fill = greedy(left, capacity)
        gap = capacity - sum(fill)
        smallest = fill[-1]
        if gap:
            two = best_two(left, Counter(fill), gap + smallest, smallest)
            if two:
                fill = [*fill[:-1], *two]
        need = Counter(fill)
        times = min(int(left[size]) // n for size, n in need.items())
        for size, n in need.items():
            left[size] -= times * n
        out.append((times, fill))
    return out


# ---------------------------------------------------------------------------------------------
# placing
# ---------------------------------------------------------------------------------------------

def places(found: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int, list[int]]]:
    """(length, from, to, first sequence, pieces of this length in a sequence, their offsets): pieces numbered from <= n < to
    of that length go to sequence first + (n - from) / pieces, offset [(n - from) % pieces]. A few rows per pattern."""
    out, at, sequence = [], Counter(), 0
    for times, fill in found:
        offsets: dict[int, list[int]] = {}
        pos = 0
        for size in fill:
            offsets.setdefault(size, []).append(pos)
            pos += size
        for size, own in offsets.items():
            n = times * len(own)
            out.append((size, at[size], at[size] + n, sequence, len(own), own))
            at[size] += n
        sequence += times
    return out


def pack(cut_pieces: DataFrame, capacity: int = 1024, per_group: int = 100_000) -> DataFrame:
    """Adds sequence_id and offset to a stage table of pieces (each at most ``capacity`` long)."""
    spark = cut_pieces.sparkSession
    sizes = cut_pieces.groupBy("length").count().collect()      # at most ``capacity`` rows
    counts = {r["length"]: r["count"] for r in sizes}
    groups = max(16, -(-max(counts.values(), default=0) // per_group))   # a length's pieces are numbered in this many groups
    table = spark.createDataFrame(places(patterns(counts, capacity)),
                                  "length long, from_n long, to_n long, first_sequence long, each int, offsets array<int>")
    p = cut_pieces.withColumn("_g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    # at most ``capacity`` x ``groups`` narrow rows, a window over ``groups`` rows each
    begin = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = p.groupBy("length", "_g").agg(F.count(F.lit(1)).alias("n")).withColumn("_begin", begin).drop("n")
    order = Window.partitionBy("length", "_g").orderBy("doc_id", "piece", "ids_crc32", "start")
    p = p.withColumn("_r", F.row_number().over(order) - 1).join(begins, ["length", "_g"]).withColumn("_n", F.col("_begin") + F.col("_r"))
    placed = p.join(F.broadcast(table), "length").where((F.col("_n") >= F.col("from_n")) & (F.col("_n") < F.col("to_n")))
    k = F.col("_n") - F.col("from_n")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32",
                         (F.col("first_sequence") + F.floor(k / F.col("each"))).cast("long").alias("sequence_id"),
                         F.element_at("offsets", (k % F.col("each") + 1).cast("int")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 1024, sparing: bool = False) -> DataFrame:
    """Tokenize once into a stage table, then pack it."""
    return pack(stage(pieces(docs, tokenizer_path, end_id, capacity, sparing=sparing), "pieces"), capacity)
