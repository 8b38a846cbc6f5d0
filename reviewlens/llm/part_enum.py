"""N-gram Jaccard join by PartEnum signatures.

A document is the set of its distinct word n-grams. Sets of nearly equal size meet at a point; two sets similar enough differ in at
most k elements there. The feature domain is dealt into first-level partitions, each of these into second-level ones, and the subsets
of second-level partitions are enumerated: what a set holds of one subset is one signature. From k = ``TWO_LEVELS`` on there are
k // 2 + 1 + m first-level partitions of three: on at least m + 1 of them similar sets differ in one element at most, so two of the
three agree, and the three subsets of two are enumerated. For smaller k a first-level partition is whole, and there are k + 1 + m.

Empty subsets make no signature. A set with empty subsets in more than m first-level partitions is dealt again by another seed; two
such sets that agree on empty subsets alone are both dealt again, and after the last seed empty subsets sign too. No link is lost.
Where k is 0 only equal sets link, and equal sets are one node from the start.

A set proposes itself to one other set a round: of the smallest sets of its groups of equal signatures to the one it shares most
signatures with. Later rounds take groups whose members still have different labels, and propose to the member that is in most
groups, likely the closest to the others. When rounds find little more, the groups still apart are looked at whole: small ones by their pairs, large ones by
clusters cut into blocks of one size class, compared through element histograms, whose distance never exceeds the sets' own.
Every candidate is checked on the sets themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget_tables, give_back, ship_by_value, stage
from .graph import components, merged

ship_by_value(__name__)

U = np.uint64
BINS = 256            # histogram bins
BITS = 1 << 23        # bits of the hashed id filter, 1 MB: the bound of what is sent to every task
SMALL = 32            # members of a group whose pairs are looked at one by one
WORDS = 100_000       # words whose hashes a task keeps at hand; hashed again when dropped
SLICE = 50_000        # shingles whose signatures are made at once: bounds the arrays a task holds
SIGNED = 500_000      # signatures sorted into buckets at once, likewise
TEXTS = 100           # texts of an Arrow batch that are Python strings at once
SETS = 2_000          # sets whose signatures a bucket gets, about: bounds a bucket's arrays
GROUPED = 100_000     # signatures of a bucket grouped at once, about
TWO_LEVELS = 8        # differences from which subsets of second-level partitions are enumerated
ROUNDS = 8            # rounds of one proposal a set at most; what they leave open is looked at whole


@dataclass(frozen=True)
class Join:
    """Sets link when ``of * intersection >= least * union``; a set holds the distinct ``words``-word shingles."""
    words: int = 4
    least: int = 85
    of: int = 100
    seeds: int = 3


# ---------------------------------------------------------------------------------------------
# sets and signatures (numpy, inside tasks)
# ---------------------------------------------------------------------------------------------

def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, n: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles. bytes.lower() folds A-Z alone, bytes.split() parts at the six
    ASCII white-space characters."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, U)
    if len(known) > WORDS:
        known.clear()
    h = np.fromiter(map(known.__getitem__, words), U, len(words))
    n = min(n, len(words))
    m = len(words) - n + 1
    key = np.full(m, U(n))
    for i in range(n):
        key = mix(key + h[i:i + m])
    return np.unique(key)


def set_key(s: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def short_key(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


class Points:
    """Bands of set sizes: a set links only within its band and the next ones. Point p joins bands p and p + 1."""

    def __init__(self, join: Join):
        low = [1]
        while low[-1] < 1 << 40:      # more than any set's size
            low.append(low[-1] * join.of // join.least + 1)
        self.join, self.low = join, np.array(low, np.int64)

    def bands(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, sizes, side="right") - 1

    def shape(self, p: int) -> tuple[int, int, int]:
        """(first-level partitions, second-level ones of each, first-level ones allowed to hold empty subsets); no partitions where k is 0"""
        top, j = int(self.low[p + 1]) - 1, self.join
        k = (j.of - j.least) * (top + top * j.of // j.least) // (j.of + j.least)
        if k >= TWO_LEVELS:
            m = -(-k // 40) + 1
            return k // 2 + 1 + m, 3, m
        m = -(-(k + 1) // 10) + 1
        return (k + 1 + m, 1, m) if k else (0, 1, 0)


def signatures(sets: list[np.ndarray], points: Points) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of non-empty sets, and for each the position of its set in the list. Every (set, point) is one deal; the
    contents of all partitions of all deals are summed in one pass."""
    size = np.array([len(s) for s in sets], np.int64)
    if not len(size):
        return np.zeros(0, U), np.zeros(0, np.int64)
    band = points.bands(size)
    owner, p = np.tile(np.arange(len(sets)), 2), np.concatenate([band - 1, band])
    owner, p = owner[p >= 0], p[p >= 0]
    at, back = np.unique(p, return_inverse=True)
    first, width, allowed = np.array([points.shape(int(x)) for x in at], np.int64).reshape(-1, 3)[back].T
    open_ = first > 0
    found, whose = [], []
    for seed in range(points.join.seeds):
        owner, p, first, width, allowed = (x[open_] for x in (owner, p, first, width, allowed))
        if not len(owner):
            break
        s, deal = np.concatenate([sets[i] for i in owner]), np.repeat(np.arange(len(owner)), size[owner])
        parts = first * width
        start = np.cumsum(parts) - parts
        h = mix(s + mix(U(seed * 1_000_003) + p.astype(U))[deal]) >> U(32)
        to = start[deal] + (h * parts.astype(U)[deal] >> U(32)).astype(np.int64)
        held = np.zeros(int(parts.sum()), U)
        np.add.at(held, to, mix(s))
        count = np.bincount(to, minlength=len(held))
        part = np.repeat(np.arange(len(owner)), parts)
        held = mix(held + mix(mix((p * 64 + seed + 1).astype(U))[part] + (np.arange(len(held)) - start[part]).astype(U)))
        whole = width[part] == 1
        three, n = held[~whole].reshape(-1, 3), count[~whole].reshape(-1, 3)
        pair, empty = mix(three + three[:, [1, 2, 0]]), n + n[:, [1, 2, 0]] == 0
        of = part[~whole][::3]
        lacking = np.bincount(part[whole & (count == 0)], minlength=len(owner)) + np.bincount(of[empty.any(1)], minlength=len(owner))
        open_ = lacking > allowed
        sig, of = np.concatenate([held[whole], pair.ravel()]), np.concatenate([part[whole], np.repeat(of, 3)])
        signs = ~np.concatenate([count[whole] == 0, empty.ravel()])
        if seed == points.join.seeds - 1:
            signs |= open_[of]
        found.append(sig[signs])
        whose.append(owner[of[signs]])
    return (np.concatenate(found), np.concatenate(whose)) if found else (np.zeros(0, U), np.zeros(0, np.int64))


def histogram(s: np.ndarray) -> bytes:
    return np.minimum(np.bincount((mix(s) >> U(56)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes()


def allowed_difference(a, b, join: Join):
    return (join.of - join.least) * (a + b) // (join.of + join.least)


# ---------------------------------------------------------------------------------------------
# Spark steps
# ---------------------------------------------------------------------------------------------

def sets(docs: DataFrame, join: Join) -> DataFrame:
    """(doc_id, n_shingles, key, short): one row per document; equal sets have equal keys, an empty set has none."""
    import pyarrow as pa

    def run(batches):
        forget_tables()
        known = WordHashes()
        for b in batches:
            n, keys = [], []
            for t in (t for i in range(0, b.num_rows, TEXTS) for t in b.column(1).slice(i, TEXTS).to_pylist()):
                s = shingles(t, join.words, known)
                n.append(len(s))
                keys.append(set_key(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()),
                                              pa.array([k and short_key(k) for k in keys], pa.int64())], names=["doc_id", "n_shingles", "key", "short"])
            del b
            give_back()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, key binary, short long")


def signature_blocks(docs: DataFrame, join: Join, buckets: int) -> DataFrame:
    """Signatures of each Arrow batch by bucket: (bucket, keys and counts of the sets, their signatures), in parts of about ``SIGNED``.
    Equal sets of a batch sign once. A signature on over ``SMALL`` + 1 sets of a part goes to its bucket for the first ``SMALL`` + 1
    only, enough to make its group a large one; the others travel in a row of their own under a negative bucket."""
    import pyarrow as pa

    schema = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("sigs", pa.binary())])

    def signed(texts, known, points):
        """Signatures and keys of the distinct sets of a batch, by slices of about ``SLICE`` shingles, in parts of about ``SIGNED``."""
        seen, some, keys, n, out = set(), [], [], 0, []

        def sign():
            sig, whose = signatures(some, points)
            out.append((sig, np.array(keys, np.int64)[whose]))

        for i in range(0, len(texts), TEXTS):
            for t in texts.slice(i, TEXTS).to_pylist():
                s = shingles(t, join.words, known)
                k = short_key(set_key(s)) if len(s) else None
                if k is None or k in seen:
                    continue
                seen.add(k)
                some.append(s)
                keys.append(k)
                n += len(s)
                if n > SLICE:
                    sign()
                    some, keys, n = [], [], 0
                    if sum(len(sig) for sig, _ in out) > SIGNED:
                        yield tuple(np.concatenate(x) for x in zip(*out))
                        out = []
        sign()
        yield tuple(np.concatenate(x) for x in zip(*out))

    def run(batches):
        forget_tables()
        known, points = WordHashes(), Points(join)
        for sig, key in (part for b in batches for part in signed(b.column(0), known, points)):
            if not len(sig):
                continue
            o = np.lexsort((key, sig))
            sig, key = sig[o], key[o]
            first = np.nonzero(np.r_[True, sig[1:] != sig[:-1]])[0]
            rank = np.arange(len(sig)) - np.repeat(first, np.diff(np.r_[first, len(sig)]))
            more = rank > SMALL
            if more.any():
                yield pa.RecordBatch.from_arrays([pa.array([-1 - int(abs(key[more][0])) % (1 << 30)], pa.int32()), pa.array([key[more].tobytes()], pa.binary()),
                                                  pa.array([sig[more].tobytes()], pa.binary())], schema=schema)
                sig, key = sig[~more], key[~more]
            to = (sig >> U(20)) % U(buckets)
            o = np.lexsort((sig, key, to))       # a set's signatures side by side: their equal keys compress
            sig, key, to = sig[o], key[o], to[o]
            cut = np.nonzero(np.r_[True, to[1:] != to[:-1]])[0]
            edge = np.r_[cut, len(to)]
            yield pa.RecordBatch.from_arrays([pa.array(to[cut].astype(np.int32)), pa.array([key[x:y].tobytes() for x, y in zip(edge, edge[1:])], pa.binary()),
                                              pa.array([sig[x:y].tobytes() for x, y in zip(edge, edge[1:])], pa.binary())], schema=schema)
            del sig, key, to, o, first, rank, more, cut, edge
            give_back()

    return docs.select("text").mapInArrow(run, "bucket int, keys binary, sigs binary")


PROPOSED, MEMBER, HOT, MORE, HOT_LEADER = 0, 1, 2, 3, 4


def groups(blocks: DataFrame) -> DataFrame:
    """(kind, sig, a, b, n, two) of signatures on two or more sets: sets b that share n signatures of a bucket with a, the smallest set
    of their groups, two of them groups of no more than these two; members of groups of 3 to ``SMALL``; members and smallest set
    of larger ones; members of larger ones that overflowed in their batch."""
    import pyarrow as pa

    names = ["kind", "sig", "a", "b", "n", "two"]

    def out(kind, sig, a, b, n=None, two=None):
        none = np.zeros(len(a), np.int64)
        return pa.Table.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(sig.view(np.int64)), pa.array(a), pa.array(b),
                                     pa.array(none if n is None else n), pa.array(none if two is None else two)], names=names)

    def voted(a, b, n, two):
        """The votes by pair, added up."""
        o = np.lexsort((b, a))
        a, b, n, two = a[o], b[o], n[o], two[o]
        cut = np.nonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[0] if len(a) else np.zeros(0, np.int64)
        return (a[cut], b[cut], np.add.reduceat(n, cut), np.add.reduceat(two, cut)) if len(a) else (a, b, n, two)

    def part(sig, key):
        """The votes and the members of some signatures, all places of a signature among them."""
        o = np.lexsort((key, sig))
        sig, key = sig[o], key[o]
        once = np.r_[True, (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])][:len(sig)]      # a part may be empty
        sig, key = sig[once], key[once]
        first = np.nonzero(np.r_[True, sig[1:] != sig[:-1]][:len(sig)])[0]
        size = np.diff(np.r_[first, len(sig)])
        sizes, leader = np.repeat(size, size), np.repeat(key[first], size)
        pair = (sizes > 1) & (key != leader)
        small, hot = (sizes > 2) & (sizes <= SMALL), sizes > SMALL
        top = first[size > SMALL]
        votes = voted(leader[pair], key[pair], np.ones(int(pair.sum()), np.int64), (sizes[pair] == 2).astype(np.int64))
        return votes, [out(kind, sig[at], key[at], key[at]) for kind, at in ((MEMBER, small), (HOT, hot), (HOT_LEADER, top))]

    def grouped(sig, key):
        """A bucket's signatures by parts of about ``GROUPED``: its own bits deal a signature to a part."""
        parts = U(max(1, len(sig) // GROUPED))
        of = (mix(sig) % parts).astype(np.int32)
        votes, members = zip(*(part(sig[of == i], key[of == i]) for i in range(int(parts))))
        a, b, n, two = voted(*(np.concatenate(x) for x in zip(*votes)))
        return pa.concat_tables([out(PROPOSED, np.zeros(len(a), U), a, b, n, two), *(t for m in members for t in m)])

    def run(table):
        key = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.int64)
        sig = np.frombuffer(b"".join(table.column("sigs").to_pylist()), U)
        if table.column("bucket")[0].as_py() < 0:
            return out(MORE, sig, key, key)
        found = grouped(sig, key)
        del sig, key
        give_back()
        return found

    return blocks.groupBy("bucket").applyInArrow(run, "kind int, sig long, a long, b long, n long, two long")


def one_proposal(votes: DataFrame) -> DataFrame:
    """Of the votes (a, b, n) the one pair of every b with most votes, as ordered pairs."""
    return votes.where("a <> b").groupBy("a", "b").agg(F.sum("n").alias("n")).groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a")) \
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of ``BITS`` bits of the hashed ids, built in Spark; at most 1 MB reaches the driver. Other ids may share a bit."""
    bit = F.pmod(F.xxhash64("id"), F.lit(BITS))
    rows = ids.select((bit / 32768).cast("long").alias("part"), (bit % 32768).alias("bit")) \
        .groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = np.zeros(BITS // 8, np.uint8)
    for r in rows:
        out[r["part"] * 4096:(r["part"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def candidate_sets(docs: DataFrame, ids: DataFrame, join: Join) -> DataFrame:
    """(short, key, n, hist, items) of the documents whose hashed id passes the filter: all of ``ids`` and a few more."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(id_filter(ids))
    schema = pa.schema([("short", pa.int64()), ("key", pa.binary()), ("n", pa.int32()), ("hist", pa.binary()), ("items", pa.list_(pa.int64()))])

    def run(batches):
        known, bits = WordHashes(), shared.value
        for b in batches:
            h = b.column(0).to_numpy()
            texts = b.column(1).filter(pa.array((bits[h >> 3] >> (h & 7).astype(np.uint8)) & 1 == 1))
            for i in range(0, len(texts), TEXTS):
                rows = []
                for t in texts.slice(i, TEXTS).to_pylist():
                    s = shingles(t, join.words, known)
                    if len(s):
                        k = set_key(s)
                        rows.append((short_key(k), k, len(s), histogram(s), s.view(np.int64)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
            del b, texts
            give_back()

    return docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(BITS)).alias("h"), "text") \
        .mapInArrow(run, "short long, key binary, n int, hist binary, items array<long>")


def near_histograms(pairs: DataFrame, found: DataFrame, join: Join) -> DataFrame:
    """The pairs (a, b) whose sizes and histograms allow a link."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ha, hb = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16) for c in ("ha", "hb"))
            na, nb = b.column("na").to_numpy(), b.column("nb").to_numpy()
            ok = np.abs(ha - hb).sum(1, dtype=np.int64) <= allowed_difference(na, nb, join)
            yield b.select(["a", "b"]).filter(pa.array(ok))

    side = lambda k: found.select(F.col("short").alias(k), F.col("n").alias(f"n{k}"), F.col("hist").alias(f"h{k}"))
    p = pairs.join(side("a"), "a").join(side("b"), "b").where(
        (F.col("na") * join.of >= F.col("nb") * join.least) & (F.col("nb") * join.of >= F.col("na") * join.least))
    return p.select("a", "b", "na", "nb", "ha", "hb").mapInArrow(run, "a long, b long").distinct()


def links(pairs: DataFrame, found: DataFrame, join: Join) -> DataFrame:
    """(a, b, key_a, key_b) of the pairs that link, checked on the sets."""
    side = lambda k: found.select(F.col("short").alias(k), F.col("key").alias(f"key_{k}"), F.col("n").alias(f"n{k}"),
                                  F.col("items").alias(f"items_{k}"))
    p = pairs.join(side("a"), "a").join(side("b"), "b")
    both = F.size(F.array_intersect("items_a", "items_b"))
    return p.where(both * join.of >= (F.col("na") + F.col("nb") - both) * join.least).select("a", "b", "key_a", "key_b").distinct()


def block_pairs(members: DataFrame, found: DataFrame, join: Join, block: int = 512) -> DataFrame:
    """Pairs (a, b) of different labels within clusters (short, cluster, label) that sizes and histograms allow. A
    cluster's sets are dealt by size class into blocks; a block meets the blocks of its own and the next class."""
    import pyarrow as pa

    ratio = float(np.log(join.of / join.least))
    m = members.join(found.select("short", "n", "hist"), "short").withColumn("class", F.floor(F.log("n") / ratio + 1e-9).cast("int"))
    counts = m.groupBy("cluster", "class").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    here = counts.select("cluster", "class", F.col("blocks").alias("own"))
    above = counts.select("cluster", (F.col("class") - 1).alias("class"), F.col("blocks").alias("up"))
    below = counts.select("cluster", (F.col("class") + 1).alias("class"), F.col("blocks").alias("down"))
    m = m.join(here, ["cluster", "class"]).join(above, ["cluster", "class"], "left").join(below, ["cluster", "class"], "left") \
        .withColumn("i", F.pmod(F.xxhash64("short"), F.col("own")).cast("int"))
    ids = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    meet = lambda c1, i1, c2, i2: F.struct(c1.alias("c1"), i1.alias("i1"), c2.alias("c2"), i2.alias("i2"))
    c, i = F.col("class"), F.col("i")
    meets = F.concat(F.transform(ids(F.col("own")), lambda j: meet(c, F.least(i, j), c, F.greatest(i, j))),
                     F.transform(ids(F.col("up")), lambda j: meet(c, i, c + 1, j)),
                     F.transform(ids(F.col("down")), lambda j: meet(c - 1, j, c, i)))
    rows = m.select("cluster", "short", "label", "n", "hist", "class", "i", F.explode(meets).alias("m")) \
        .select("cluster", "m.*", "short", "label", "n", "hist", "class", "i")

    def run(table):
        short, label, n = (table.column(c).to_numpy() for c in ("short", "label", "n"))
        hist = np.frombuffer(b"".join(table.column("hist").to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16)
        where = table.column("class").to_numpy() * np.int64(1 << 32) + table.column("i").to_numpy()
        c1, i1, c2, i2 = (table.column(c)[0].as_py() for c in ("c1", "i1", "c2", "i2"))
        left = np.nonzero(where == c1 * (1 << 32) + i1)[0]
        right = np.nonzero(where == c2 * (1 << 32) + i2)[0]
        same, a, b = (c1, i1) == (c2, i2), [], []
        for k, x in enumerate(left):
            y = right[k + 1:] if same else right
            y = y[(label[y] != label[x]) & (short[y] != short[x])]
            far = np.abs(hist[y] - hist[x]).sum(1, dtype=np.int64)
            y = y[far <= allowed_difference(n[y].astype(np.int64), int(n[x]), join)]
            a.append(np.full(len(y), short[x]))
            b.append(short[y])
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return rows.groupBy("cluster", "c1", "i1", "c2", "i2").applyInArrow(run, "a long, b long").distinct()


def nodes_of(found: DataFrame) -> DataFrame:
    """Links as edges between (short, key): the whole key tells sets apart, the short one names them in the rounds."""
    return found.select(*[F.struct(F.col(c).alias("short"), F.col(f"key_{c}").alias("key")).alias(c) for c in ("a", "b")])


def by_short(labels: DataFrame) -> DataFrame:
    """(short, label) of the linked sets, once each."""
    return labels.groupBy(F.col("node.short").alias("short")).agg(F.min("label.short").alias("label"))


def components_by_key(docs: DataFrame, join: Join, id_col: str, text_col: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, key, component (its smallest id, null for an empty set) and chosen. Of the
    rows of a component, those of the smallest id are chosen, of these the ones of the smallest key; a null id comes last."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    nodes = stage(sets(d, join), "sets")
    classes = stage(nodes.where("key is not null").groupBy("key", "short", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("rep")), "classes")
    buckets = max(32, classes.count() // SETS)
    g = stage(groups(signature_blocks(d, join, buckets)), "groups")
    leaders = g.where(F.col("kind") == HOT_LEADER).select("sig", F.col("a").alias("leader"))
    more = g.where(F.col("kind") == MORE).select("sig", F.col("a").alias("short")).distinct()
    shared = g.where(F.col("kind") == PROPOSED)
    members = g.where(F.col("kind").isin(MEMBER, HOT, MORE)).select("sig", F.col("a").alias("short"), (F.col("kind") != MEMBER).alias("large"))
    degrees = members.groupBy("short").agg(F.count(F.lit(1)).alias("degree"))
    members = stage(members.join(degrees, "short"), "members")
    wanted = g.where(F.col("kind").isin(PROPOSED, MORE)).select(F.explode(F.array("a", "b")).alias("short")).distinct()
    ids = classes.join(wanted, "short", "left_semi").select(F.col("rep").alias("id"))
    found = stage(candidate_sets(d, ids, join).dropDuplicates(["key"]), "candidates")

    # rounds of one proposal a set
    votes = shared.select("a", "b", "n").unionByName(more.join(leaders, "sig").select(F.col("leader").alias("a"), F.col("short").alias("b"), F.lit(1).cast("long").alias("n")))
    tried = labels = None
    for _ in range(ROUNDS):
        proposed = stage(one_proposal(votes), "proposed")
        new = stage(links(near_histograms(proposed, found, join), found, join), "links")
        tried = proposed if tried is None else tried.unionByName(proposed)
        labels = merged(labels, nodes_of(new))
        named = members.join(by_short(labels), "short", "left").withColumn("label", F.coalesce("label", "short"))
        apart = named.groupBy("sig").agg(F.max(F.struct("degree", "short", "label")).alias("head"), F.min("label").alias("lo"), F.max("label").alias("hi")) \
            .where("lo <> hi").select("sig", "head")
        still = stage(named.join(apart, "sig"), "apart")
        if new.count() * 100 < proposed.count():
            break
        ahead = still.where("label <> head.label").select(F.col("head.short").alias("a"), F.col("short").alias("b"), F.lit(1).cast("long").alias("n"))
        ordered = ahead.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "a", "b", "n")
        votes = ordered.join(tried.select(F.col("a").alias("x"), F.col("b").alias("y")), ["x", "y"], "left_anti").select("a", "b", "n")

    # groups whose members are not all joined yet
    name = lambda m, c: m.join(by_short(labels).toDF(c, f"label_{c}"), c, "left") \
        .withColumn(f"label_{c}", F.coalesce(f"label_{c}", c))
    twos = name(name(shared.where("two > 0").select("a", "b").distinct(), "a"), "b").where("label_a <> label_b").select("a", "b")
    small = still.where("not large").select("sig", "short", "label").join(classes.select("short", "n"), "short")
    x, y = small.alias("x"), small.alias("y")
    sizes = (F.col("x.n") * join.of >= F.col("y.n") * join.least) & (F.col("y.n") * join.of >= F.col("x.n") * join.least)
    pairs = x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.short") < F.col("y.short")) & (F.col("x.label") != F.col("y.label")) & sizes) \
        .select(F.col("x.short").alias("a"), F.col("y.short").alias("b"))    # groups of at most SMALL
    pairs = pairs.unionByName(twos.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
    second = near_histograms(pairs.join(tried, ["a", "b"], "left_anti"), found, join)
    hot = still.where("large").select("sig", "short", "label")
    if hot.limit(1).count():
        clusters = components(hot.join(leaders, "sig").select(F.col("leader").alias("a"), F.col("short").alias("b")).distinct())
        part = hot.select("short", "label").distinct().join(clusters.select(F.col("node").alias("short"), F.col("label").alias("cluster")), "short")
        second = second.unionByName(block_pairs(part, found, join)).distinct()
    labels = merged(labels, nodes_of(stage(links(stage(second, "near"), found, join), "links")))
    joined = labels.select(F.col("node.key").alias("node"), F.col("label.key").alias("label"))
    top = classes.select(F.col("key").alias("node"), "rep").join(joined, "node")
    smallest = top.groupBy("label").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", F.col("node").alias("key"))).alias("least"))
    per_key = classes.join(joined.withColumnRenamed("node", "key"), "key", "left").join(smallest, "label", "left") \
        .select("key", "rep", F.coalesce("least.rep", "rep").alias("component"), (F.coalesce("least.key", "key") == F.col("key")).alias("first"))
    return nodes.join(per_key, "key", "left").select("doc_id", "n_shingles", "key", "component",
                                                     (F.col("first") & F.col("doc_id").eqNullSafe(F.col("rep"))).alias("chosen"))


def cluster(docs: DataFrame, join: Join = Join(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).
    Null texts are empty; an empty set links with nothing. Rows with equal sets are linked; a null id is never smallest."""
    return components_by_key(docs, join, id_col, text_col).select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, join: Join = Join(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all columns: of each component one row of its smallest id, or of its smallest key
    if none of its rows has an id. Rows with empty sets stay, those with equal ids and texts once."""
    rows = components_by_key(docs, join, id_col, text_col)
    kept = stage(rows.where("chosen or key is null").select(F.col("doc_id").alias("_kept"), F.col("key").alias("_key")).distinct(), "kept")
    again = stage(docs.groupBy(F.col(id_col).alias("_again")).count().where("count > 1").select("_again"), "repeated-ids")
    ids = kept.select("_kept").distinct()
    if not again.limit(1).count():       # an id is a row
        return docs.join(ids.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col("_kept")), "left_semi")
    has, known = F.col(id_col).isNotNull(), WordHashes()

    def key_of(text):
        s = shingles(text, join.words, known)
        return set_key(s) if len(s) else None

    one = docs.where(has).join(again, F.col(id_col) == F.col("_again"), "left_anti").join(ids.hint("shuffle_hash"), F.col(id_col) == F.col("_kept"), "left_semi")
    more = docs.where(~has).unionByName(docs.where(has).join(again, F.col(id_col) == F.col("_again"), "left_semi"))
    more = more.withColumn("_set", F.udf(key_of, "binary")(F.col(text_col).cast("string"))) \
        .withColumn("_empty", F.when(F.col("_set").isNull(), F.col(text_col)))
    more = more.dropDuplicates([id_col, "_set", "_empty"])     # before the join, so that no key is on many rows
    chosen = more.where("_set is not null").join(kept, F.col(id_col).eqNullSafe(F.col("_kept")) & (F.col("_set") == F.col("_key")), "left_semi")
    return one.unionByName(chosen.unionByName(more.where("_set is null")).drop("_set", "_empty"))
