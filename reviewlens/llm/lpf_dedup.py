"""Suffix-array dedup: bytes covered by a string of ``LEN`` bytes that also starts in a document of a smaller id.

Every string of LEN bytes picks one of its 16-byte pieces as its anchor (the leftmost piece of smallest hash), so equal
strings pick equal anchors at equal places. Neighbouring strings with one anchor form a run.

1. Anchors' hashes, once per Arrow batch, are gathered in buckets; a hash in two or more documents is shared. Each document
   is told its own shared hashes.
2. Documents send the bytes of the runs of shared anchors to buckets, equal runs of a batch once.
3. In a bucket the strings of the runs are sorted as suffixes cut at LEN bytes. Where the previous or next smaller
   document in that order has LEN bytes in common with a string, its longest previous factor has LEN bytes: an
   earlier document holds the string. Equal runs are sorted once.
4. The covered bytes come back to the documents as spans.

A bucket gets a hash once per batch, whatever the number of copies. Hashes only gather; strings are compared as bytes.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_by_value

ship_by_value(__name__)

U = np.uint64
LEN = 50
PIECE = 16                 # bytes of an anchor
SLICE = 1 << 20            # long texts are worked on in slices of so many bytes


# ---------------------------------------------------------------------------------------------
# anchors and runs (numpy, inside tasks)
# ---------------------------------------------------------------------------------------------

def byte_codes() -> np.ndarray:
    x = np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(27))


def piece_hashes(data: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the PIECE bytes from each byte on, by doubling."""
    h, m = codes[data], 1
    while m < PIECE:
        h = h[:-m] * U(0x9E3779B97F4A7C15 + 2 * m) + h[m:]
        m *= 2
    h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


def leftmost_minimum(h: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest of each ``w`` neighbours and how far it is from the first one (the leftmost of equal ones)."""
    v, off, m = h, np.zeros(len(h), np.uint8), 1
    while True:
        step = m if 2 * m <= w else w - m
        if step <= 0:
            return v, off
        a, b = v[:-step], v[step:]
        left = a <= b
        off = np.where(left, off[:-step], off[step:] + np.uint8(step))
        v = np.minimum(a, b)
        m += step


def slices(texts: list[bytes], most: int = 1 << 19):
    """Groups of (text number, begin, bytes): each text's strings of LEN bytes begin in exactly one slice."""
    group, size = [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(len(t) - LEN + 1, 0), SLICE):
            part = t[a:a + SLICE + LEN - 1]
            group.append((i, a, part))
            size += len(part)
            if size >= most:
                yield group
                group, size = [], 0
    if group:
        yield group


def runs(group, codes: np.ndarray):
    """(hash, text number, begin in the text, strings, anchor's place after the begin) of the runs in a group of slices,
    and where each begins in the joined bytes."""
    joined = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
    sizes = np.array([len(p) for _, _, p in group])
    first = np.cumsum(sizes) - sizes
    v, off = leftmost_minimum(piece_hashes(joined, codes), LEN - PIECE + 1)
    own = np.repeat(np.arange(len(group)), sizes)[:len(v)]
    at = np.arange(len(v))
    good = at + LEN <= (first + sizes)[own]
    place = at + off
    begins = good & np.r_[True, (place[1:] != place[:-1]) | (own[1:] != own[:-1])]
    s = np.nonzero(begins)[0]
    n = np.add.reduceat(good.astype(np.int64), s) if len(s) else np.zeros(0, np.int64)
    text = np.array([i for i, _, _ in group])[own[s]]
    begin = s - first[own[s]] + np.array([a for _, a, _ in group])[own[s]]
    return v[s], text, begin, n, off[s], s, joined


def by_bucket(hashes: np.ndarray, buckets: int):
    """(bucket, positions) pairs."""
    to = (hashes >> U(17)) % U(buckets)
    o = np.argsort(to, kind="stable")
    cut = np.nonzero(np.r_[True, to[o][1:] != to[o][:-1]])[0]
    for x, y in zip(cut, np.r_[cut[1:], len(o)]):
        yield int(to[o[x]]), o[x:y]


def brief(hashes: np.ndarray) -> np.ndarray:
    """Half of each hash: enough for a document to know its own few again; a wrong one only sends a run more."""
    return (hashes >> U(32)).astype(np.uint32)


def pack_array(a: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(a).tobytes(), 1)


def unpack(blobs: list[bytes], dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(zlib.decompress(b), dtype) for b in blobs])


def smaller_document_has(words: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For suffixes cut at LEN bytes (rows of big-endian words): does a smaller document hold the same LEN bytes? In suffix
    order equal suffixes are neighbours; running minima from both sides give the previous and the next smaller document
    among those with LEN bytes in common."""
    n = len(docs)
    if not n:
        return np.zeros(0, bool)
    order = np.lexsort(words.T[::-1])
    w = words[order]
    new = np.r_[True, (w[1:] != w[:-1]).any(1)]
    run = np.cumsum(new) - 1
    rank = np.unique(docs, return_inverse=True)[1][order].astype(np.int64)
    span = int(rank.max()) + 1
    before = np.minimum.accumulate(rank - run * span) + run * span            # a later run lies below all earlier ones
    after = (np.minimum.accumulate((rank - (run[-1] - run) * span)[::-1]) + ((run[-1] - run) * span)[::-1])[::-1]
    out = np.empty(n, bool)
    out[order] = (before < rank) | (after < rank)
    return out


# ---------------------------------------------------------------------------------------------
# Spark steps
# ---------------------------------------------------------------------------------------------

def shared_hashes(t: DataFrame, buckets: int) -> DataFrame:
    """(row, shared): per document key the hashes (packed, shortened) that another document has too."""
    import pyarrow as pa

    schema = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("rows", pa.binary())])

    def gather(batches):
        codes = byte_codes()
        for b in batches:
            rows, texts = b.column(0).to_numpy(), [x or b"" for x in b.column(1).to_pylist()]
            h, r = [np.zeros(0, U)], [np.zeros(0, np.int64)]
            for group in slices(texts):
                x = runs(group, codes)
                h.append(x[0])
                r.append(rows[x[1]])
            h, r = np.concatenate(h), np.concatenate(r)
            o = np.lexsort((r, h))
            h, r = h[o], r[o]
            new_h = np.r_[True, h[1:] != h[:-1]][:len(h)]
            once = new_h | np.r_[True, r[1:] != r[:-1]][:len(h)]
            h, r, new_h = h[once], r[once], new_h[once]
            if not len(h):
                continue
            first = np.nonzero(new_h)[0]
            many = np.diff(np.r_[first, len(h)]) > 1
            in_many = np.repeat(many, np.diff(np.r_[first, len(h)]))
            # known to be shared within the batch: each document is told at once, the bucket hears of it once
            if in_many.any():
                yield pa.RecordBatch.from_arrays([pa.array([-1 - int(h[0] >> U(34))], pa.int32()), pa.array([h[in_many].tobytes()], pa.binary()),
                                                  pa.array([r[in_many].tobytes()], pa.binary())], schema=schema)
            h, r = (h[first] & ~U(1)) | many.astype(U), r[first]
            o = np.argsort(r, kind="stable")
            h, r = h[o], r[o]
            cut = list(by_bucket(h, buckets))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in cut], pa.int32()), pa.array([h[i].tobytes() for _, i in cut], pa.binary()),
                                              pa.array([r[i].tobytes() for _, i in cut], pa.binary())], schema=schema)

    def tell(table):
        h = np.frombuffer(b"".join(table.column("hashes").to_pylist()), U)
        r = np.frombuffer(b"".join(table.column("rows").to_pylist()), np.int64)
        if table.column("bucket")[0].as_py() >= 0:
            many, h = (h & U(1)) == 1, h & ~U(1)
            o = np.lexsort((r, h))
            h, r, many = h[o], r[o], many[o]
            first = np.nonzero(np.r_[True, h[1:] != h[:-1]])[0]
            size = np.diff(np.r_[first, len(h)])
            known = np.logical_or.reduceat(many, first)
            other = np.maximum.reduceat(r, first) != np.minimum.reduceat(r, first)
            # a document that a batch has already told is told again: harmless
            take = np.repeat(known & (size > 1) | other, size)
            h, r = h[take], r[take]
        o = np.argsort(r, kind="stable")
        h, r = h[o], r[o]
        cut = np.nonzero(np.r_[True, r[1:] != r[:-1]])[0] if len(r) else np.zeros(0, np.int64)
        edge = np.r_[cut, len(r)]
        return pa.table({"row": pa.array(r[cut], pa.int64()), "shared": pa.array([brief(h[x:y]).tobytes() for x, y in zip(edge, edge[1:])], pa.binary())})

    blocks = t.where("doc_id is not null").select("row", F.col("text").cast("binary")).mapInArrow(gather, "bucket int, hashes binary, rows binary")
    return blocks.groupBy("bucket").applyInArrow(tell, "row long, shared binary") \
        .groupBy("row").agg(F.collect_list("shared").alias("shared"))


def covered(told: DataFrame, buckets: int) -> DataFrame:
    """(row, span) of bytes covered by strings that a smaller document has."""
    import pyarrow as pa

    columns = ["hashes", "left", "strings", "bytes", "run", "rows", "docs", "begins"]
    schema = pa.schema([("bucket", pa.int32())] + [(c, pa.binary()) for c in columns])

    def send(batches):
        codes = byte_codes()
        for b in batches:
            mine = {k: b.column(k).to_pylist() for k in range(4)}
            rows, docs, texts, shared = mine[0], mine[1], mine[2], mine[3]
            keep = [i for i, (d, s) in enumerate(zip(docs, shared)) if d is not None and s]
            if not keep:
                continue
            rows, docs = np.array([rows[i] for i in keep], np.int64), np.array([docs[i] for i in keep], np.int64)
            own = [np.unique(np.frombuffer(b"".join(shared[i]), np.uint32)) for i in keep]
            known: dict[tuple, int] = {}
            entry = []
            for group in slices([texts[i] or b"" for i in keep]):
                h, text, begin, n, left, at, joined = runs(group, codes)
                # runs come in text order: each text's runs are a stretch
                edge = np.nonzero(np.r_[True, text[1:] != text[:-1]])[0] if len(text) else np.zeros(0, np.int64)
                hit = [np.isin(brief(h[x:y]), own[text[x]]) for x, y in zip(edge, np.r_[edge[1:], len(text)])]
                hit = np.nonzero(np.concatenate(hit))[0] if hit else np.zeros(0, np.int64)
                whole = joined.tobytes()
                for i in hit:
                    a, k = int(at[i]), int(n[i])
                    key = (int(h[i]), int(left[i]), k, whole[a:a + k + LEN - 1])
                    entry.append((known.setdefault(key, len(known)), int(text[i]), int(begin[i])))
            if not entry:
                continue
            e = np.array(entry, np.int64)
            kh = np.array([k[0] for k in known], U)
            bodies = list(known)
            lefts, counts = np.array([k[1] for k in bodies], np.uint8), np.array([k[2] for k in bodies], np.uint8)
            local = np.zeros(len(bodies), np.int64)
            which = np.zeros(len(bodies), np.int64)
            parts = list(by_bucket(kh & ~U(1), buckets))
            for p, (_, i) in enumerate(parts):
                local[i], which[i] = np.arange(len(i)), p
            o = np.argsort(which[e[:, 0]], kind="stable")
            e = e[o]
            edge = np.searchsorted(which[e[:, 0]], np.arange(len(parts) + 1))
            out = [[] for _ in schema]
            for p, (bucket, i) in enumerate(parts):
                x = e[edge[p]:edge[p + 1]]
                for c, v in zip(out, (bucket, pack_array(kh[i]), pack_array(lefts[i]), pack_array(counts[i]),
                                      zlib.compress(b"".join(bodies[k][3] for k in i), 1), pack_array(local[x[:, 0]].astype(np.int32)),
                                      pack_array(rows[x[:, 1]]), pack_array(docs[x[:, 1]]), pack_array(x[:, 2].astype(np.int32)))):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    def compare(table):
        col = lambda c: table.column(c).to_pylist()
        h, left, n = unpack(col("hashes"), U), unpack(col("left"), np.uint8).astype(np.int64), unpack(col("strings"), np.uint8).astype(np.int64)
        sizes = [len(zlib.decompress(b)) // 8 for b in col("hashes")]
        base = np.cumsum([0] + sizes)
        runs_of = [np.frombuffer(zlib.decompress(b), np.int32) + base[k] for k, b in enumerate(col("run"))]
        run = np.concatenate(runs_of).astype(np.int64)
        row, doc, begin = unpack(col("rows"), np.int64), unpack(col("docs"), np.int64), unpack(col("begins"), np.int32).astype(np.int64)
        data = b"".join(zlib.decompress(b) for b in col("bytes"))
        length = n + LEN - 1
        at = np.cumsum(length) - length
        # equal runs of different batches become one
        ids: dict[tuple, int] = {}
        same = np.fromiter((ids.setdefault((a, b, data[c:c + d]), len(ids)) for a, b, c, d in zip(h.tolist(), left.tolist(), at.tolist(), length.tolist())),
                           np.int64, len(h))
        rep = np.zeros(len(ids), np.int64)
        rep[same[::-1]] = np.arange(len(h))[::-1]
        run = same[run]
        h, left, n, at = h[rep], left[rep], n[rep], at[rep]
        least = np.full(len(rep), np.iinfo(np.int64).max)
        np.minimum.at(least, run, doc)
        # only anchors with different runs need their strings compared
        _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
        mixed = np.nonzero(count[inverse] > 1)[0]
        buf = np.frombuffer(data, np.uint8)
        flags: dict[int, np.ndarray] = {}
        o = mixed[np.argsort(inverse[mixed], kind="stable")]
        i = 0
        while i < len(o):          # whole anchor groups, a bounded number of strings at a time where groups allow
            j, total = i, 0
            while j < len(o) and (total < 400_000 or inverse[o[j]] == inverse[o[j - 1]]):
                total += int(n[o[j]])
                j += 1
            part = o[i:j]
            start = np.repeat(at[part], n[part]) + np.concatenate([np.arange(k) for k in n[part]])
            padded = np.zeros((len(start), 56), np.uint8)
            for k in range(0, len(start), 100_000):
                padded[k:k + 100_000, :LEN] = buf[start[k:k + 100_000, None] + np.arange(LEN)]
            hit = smaller_document_has(padded.view(">u8").astype(U), np.repeat(least[part], n[part]))
            edge = np.cumsum(np.r_[0, n[part]])
            for r, x, y in zip(part.tolist(), edge, edge[1:]):
                if hit[x:y].any():
                    flags[r] = hit[x:y]
            i = j
        later = doc > least[run]
        out = [(row[later], doc[later], begin[later], begin[later] + n[run[later]] + LEN - 1)]
        for k in np.nonzero(~later)[0]:
            f = flags.get(int(run[k]))
            if f is not None:
                d = np.diff(np.r_[0, f.astype(np.int8), 0])
                a, z = np.nonzero(d == 1)[0], np.nonzero(d == -1)[0]
                out.append((np.full(len(a), row[k]), np.full(len(a), doc[k]), begin[k] + a, begin[k] + z + LEN - 1))
        r, d, a, z = (np.concatenate([x[q] for x in out]).astype(np.int64) for q in range(4))
        return pa.table({"row": pa.array(r), "span": pa.array(span_code(d, a, z))})

    return told.mapInArrow(send, "bucket int, " + ", ".join(f"{c} binary" for c in columns)) \
        .groupBy("bucket").applyInArrow(compare, "row long, span long")


def id_check(docs: np.ndarray) -> np.ndarray:
    """24 bits of an id, to tell apart documents whose row keys are equal by chance."""
    return ((docs.astype(np.int64).view(U) * U(0x9E3779B97F4A7C15)) >> U(40)).astype(np.int64)


def span_code(docs: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One long per span: its begin (31 bits), its length (8 bits, a run's bytes at most), the check of its id."""
    return (((begin << 8) | (end - begin)) << 24) | id_check(docs)


def spans_of(codes: np.ndarray, doc: int) -> tuple[np.ndarray, np.ndarray]:
    """(begins, ends) of the spans with the id's check."""
    own = codes[(codes & 0xFFFFFF) == id_check(np.array([doc], np.int64))[0]] >> 24
    return own >> 8, (own >> 8) + (own & 0xFF)


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal covered stretches."""
    o = np.argsort(begin, kind="stable")
    b, far = begin[o], np.maximum.accumulate(end[o])
    new = np.r_[True, b[1:] > far[:-1]]
    first = np.nonzero(new)[0]
    return b[first], far[np.r_[first[1:] - 1, len(b) - 1]]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``keep_text`` the remaining bytes.

    Null texts are empty. Rows without an id neither lose bytes nor cost others any. Rows that repeat an id do not
    dedup each other; each counts by its own text."""
    import pyarrow as pa

    t = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    t = t.withColumn("row", F.xxhash64("doc_id", "text"))
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    buckets = int(max(64, size // 12_000_000))
    # both joins below read one shuffle of the texts by row, and the first the grouping of the hashes by row
    told = t.join(shared_hashes(t, buckets).hint("shuffle_hash"), "row", "left").select("row", "doc_id", F.col("text").cast("binary").alias("text"), "shared")
    spans = covered(told, buckets).groupBy("row").agg(F.collect_list("span").alias("spans"))
    both = t.join(spans.hint("shuffle_hash"), "row", "left").select("doc_id", F.col("text").cast("binary").alias("text"), "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")

    def finish(batches):
        for b in batches:
            rows = []
            for doc, text, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                text = text or b""
                a, z = spans_of(np.array(own, np.int64), doc) if own and doc is not None else ((), ())
                kept, removed, n = text, 0, 0
                if len(a):
                    a, z = merged(a, z)
                    kept = b"".join(text[i:j] for i, j in zip([0, *z.tolist()], [*a.tolist(), len(text)]))
                    removed, n = int((z - a).sum()), len(a)
                rows.append((doc, len(text), removed, n, hashlib.sha256(kept).hexdigest(), kept)[:6 if keep_text else 5])
            types = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * keep_text
            names = [c.split()[0] for c in schema.split(", ")]
            cols = zip(*rows) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types)], names=names)

    return both.mapInArrow(finish, schema)
