"""Hard-negative mining on a GNAT-style tree of split points (multiway generalised hyperplanes).

Vectors become integers (floor of 256 times a component), scores are exact integer inner products. With M the largest norm, a vector x
is placed at (x, sqrt(M^2 - |x|^2)) and an anchor q at (q, 0): their squared distance is |q|^2 + M^2 - 2 score, so a window of scores is an
annulus of distances around the anchor, and the metric's triangle inequality holds for any norms.

A node of the tree has up to ``FANOUT`` split points; a vector goes to the child of the nearest one. For every split point the node stores the
range of distances to each sibling subtree, taken over all vectors. An anchor at distance d from split point i, with the annulus [a, b],
can meet a subtree only if that subtree's range at i meets [max(d - b, a - d), d + b]; one split point that rules it out eliminates it.
Leaves are searched exactly, all windows of an anchor at once.

Search goes twice: first the anchor's own leaf gives a bound (the k-th best score so far), then the bound shrinks the annulus and the leaves that
survive are searched. Nothing is approximate: elimination only removes what the triangle inequality proves to be outside (distances get a slack
for rounding). Vectors without structure let little be eliminated; then anchors meet all rows in blocks.

The split points come from a sample of at most ``SAMPLE`` rows (those whose id hashes lowest); the tree has at most ``FANOUT ** DEPTH``
leaves, so it is bounded and travels with the tasks. Neighbouring leaves are searched together as one group of about ``BLOCK`` rows (of a 256th of the rows where that
is more, four times ``BLOCK`` at most); a larger leaf is a group of its own, searched in blocks, dealt by row, so a leaf that holds a third of all rows, or of all
copies, is many equal tasks. Anchors are sent once per block, in pieces of at most ``SEND`` bytes, as the narrowest integers that hold the vectors, so what a task holds
depends neither on the rows nor on the leaves.

Defined cases: rows with a null label or vector or a null or non-finite component take no part; a null id sorts last and is no anchor; shorter
vectors are padded with zeros; rows that repeat an id are rows of their own. Scores must fit 63 bits.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, ship_by_value, stage

ship_by_value(__name__)

FANOUT, DEPTH = 8, 4
SAMPLE = 8192
LEAF, BLOCK = 1024, 4096     # rows wanted in a leaf, and at most (on average) in one block of it
CHUNK = 256                  # anchors in one request
SEND = 4 << 20               # bytes of requests that a task holds before it hands them on
AT_ONCE = 64                 # anchors whose scores with a block are held at once
NULL_ID = np.iinfo(np.int64).max
REQUEST = ["leaf", "block", "anchors", "windows", "wanted"]
MEMBER = "uid long, vec_id long, label int, v array<bigint>"


# -- the tree --------------------------------------------------------------------------------------------------------------

class Tree:
    """nodes[i]: (split points, their extra coordinates, children); a child >= 0 is a node, -1 - leaf otherwise. near and far [node][point, child]: ranges
    of distances from a split point to the members of a child."""

    def __init__(self, points: np.ndarray, rows: int, dim: int, top: float):
        """``points``: the sample (floats), ``rows``: how many rows there are, ``top``: the largest squared norm."""
        self.dim, self.top, self.nodes, self.leaves = dim, top, [], 0
        self.groups: dict[int, int] = {}        # by leaf
        self.blocks: dict[int, int] = {}        # by group
        self.kind = next(k for k, over in ((np.int16, 2.0 ** 30), (np.int32, 2.0 ** 61), (np.int64, np.inf)) if top < over or over == np.inf)
        per_point = rows / max(1, len(points))
        self.root = self._split(np.unique(points, axis=0) if len(points) else points, points, per_point, 0)
        self.near = [np.full((len(n[0]),) * 2, np.inf) for n in self.nodes]
        self.far = [np.full((len(n[0]),) * 2, -np.inf) for n in self.nodes]

    def extra(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.top - (x * x).sum(1), 0.0))

    def apart(self, x: np.ndarray, x_extra: np.ndarray, points: np.ndarray, p_extra: np.ndarray) -> np.ndarray:
        """Distances of placed vectors; an anchor's extra coordinate is 0."""
        square = (x * x).sum(1)[:, None] + (x_extra * x_extra)[:, None] + self.top - 2 * (x @ points.T + x_extra[:, None] * p_extra[None, :])
        return np.sqrt(np.maximum(square, 0.0))

    def _split(self, distinct, points, per_point, depth) -> int:
        if depth == DEPTH or len(distinct) < 2 or len(points) * per_point <= LEAF:
            self.leaves += 1
            return -self.leaves
        order = np.random.default_rng(len(points)).permutation(len(distinct))[:3 * FANOUT]
        some = distinct[order]
        chosen = [0]
        gap = self.apart(some, self.extra(some), some, self.extra(some))
        while len(chosen) < min(FANOUT, len(some)):        # the candidate farthest from those taken
            chosen.append(int(np.argmax(gap[:, chosen].min(1))))
        centres = some[sorted(set(chosen))]
        node, e = len(self.nodes), self.extra(centres)
        self.nodes.append(None)
        side = self.apart(points, self.extra(points), centres, e).argmin(1)
        side_d = self.apart(distinct, self.extra(distinct), centres, e).argmin(1)
        children = [self._split(distinct[side_d == j], points[side == j], per_point, depth + 1) for j in range(len(centres))]
        self.nodes[node] = (centres, e, children)
        return node

    def place(self, x: np.ndarray, seen=None) -> np.ndarray:
        """The leaf of every row of ``x``; ``seen(node, distances, child)`` hears of every step."""
        leaf, e = np.zeros(len(x), dtype=np.int64), self.extra(x)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                leaf[rows] = -1 - node
            elif len(rows):
                centres, ce, children = self.nodes[node]
                d = self.apart(x[rows], e[rows], centres, ce)
                side = d.argmin(1)
                if seen:
                    seen(node, d, side)
                todo += [(children[j], rows[side == j]) for j in range(len(children))]
        return leaf

    def survivors(self, q: np.ndarray, low: np.ndarray, high: np.ndarray):
        """Yields (leaf, rows of ``q``, their windows that reach the leaf). ``low`` and ``high``: scores, anchors by windows."""
        none, base = np.zeros(len(q)), (q * q).sum(1)[:, None] + self.top
        slack = 1e-6 * math.sqrt(self.top + 1.0) + 1e-6
        with np.errstate(invalid="ignore"):
            out = np.sqrt(np.maximum(base - 2 * low, 0.0)) + slack
            inn = np.sqrt(np.maximum(base - 2 * high, 0.0)) - slack
        todo = [(self.root, np.arange(len(q)), low <= high)]
        while todo:
            node, rows, on = todo.pop()
            some = on.any(1)
            rows, on = rows[some], on[some]
            if not len(rows):
                continue
            if node < 0:
                yield -1 - node, rows, on
                continue
            centres, ce, children = self.nodes[node]
            d = self.apart(q[rows], none[rows], centres, ce)[:, None, :]       # anchor, window, split point
            near = np.maximum(d - out[rows][:, :, None], inn[rows][:, :, None] - d)
            far = d + out[rows][:, :, None]
            for j, child in enumerate(children):
                meets = (self.far[node][None, None, :, j] >= near) & (self.near[node][None, None, :, j] <= far)
                todo.append((child, rows, on & meets.all(2)))


def matrix(arrays, dim: int) -> np.ndarray:
    """Integer rows padded with zeros to ``dim`` columns."""
    out = np.zeros((len(arrays), dim), dtype=np.int64)
    for i, a in enumerate(arrays):
        out[i, :len(a)] = a
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: by floats while no partial sum can leave their integers, else by 64-bit integers."""
    if a.shape[1] == 0 or not len(a) or not len(b):
        return np.zeros((len(a), len(b)), dtype=np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0 ** 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


# -- rows, tree and blocks -----------------------------------------------------------------------------------------------------

def members(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """A stage table (uid, vec_id, label, v) of the rows that take part, ``v`` the integer components."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    good = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    rows = vectors.where(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & good)
    return stage(rows.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("int").alias("label"),
                             F.transform(x, lambda c: F.floor(c * 256.0)).alias("v")), "negative-members")


def build(rows: DataFrame, sample: int = SAMPLE) -> Tree:
    """The tree over a bounded sample, with its ranges over all rows. What reaches the driver: the sample, and one pair of numbers for each
    split point and sibling subtree."""
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    n, dim, top = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(square)).first()
    picked = rows.orderBy(F.xxhash64("vec_id", "uid")).limit(sample).select("v").collect() if n else []
    tree = Tree(matrix([r.v for r in picked], dim or 0).astype(np.float64), n, dim or 0, top or 0.0)

    def ranges(batches):
        near, far = [a.copy() for a in tree.near], [a.copy() for a in tree.far]

        def seen(node, d, side):
            for j in np.unique(side):
                near[node][:, j] = np.minimum(near[node][:, j], d[side == j].min(0))
                far[node][:, j] = np.maximum(far[node][:, j], d[side == j].max(0))

        for b in batches:
            tree.place(matrix(b["v"], tree.dim).astype(np.float64), seen)
        out = [(k, i, j, near[k][i, j], far[k][i, j]) for k in range(len(near)) for i, j in zip(*np.nonzero(far[k] > -np.inf))]
        yield pd.DataFrame(out, columns=["node", "point", "child", "near", "far"])

    if tree.nodes:
        found = rows.select("v").mapInPandas(ranges, "node int, point int, child int, near double, far double")
        for r in found.groupBy("node", "point", "child").agg(F.min("near").alias("near"), F.max("far").alias("far")).collect():
            tree.near[r.node][r.point, r.child], tree.far[r.node][r.point, r.child] = r.near, r.far
    return tree


def placed(rows: DataFrame, tree: Tree) -> DataFrame:
    """A stage table of ``rows`` with their leaf."""
    def run(batches):
        for b in batches:
            yield pd.DataFrame({"uid": b["uid"], "leaf": tree.place(matrix(b["v"], tree.dim).astype(np.float64))})

    leaf = rows.select("uid", "v").mapInPandas(run, "uid long, leaf int").withColumnRenamed("uid", "u")
    return stage(rows.join(leaf, F.col("uid") == F.col("u")).drop("u"), "negative-placed")


def blocks(rows: DataFrame, tree: Tree) -> DataFrame:
    """A stage table (leaf, block, n, data): the rows of a group of leaves in equal blocks, each packed into one row. Learns the groups and the number of blocks of each;
    a group is named after its first leaf."""
    counts = sorted((r.leaf, r["count"]) for r in rows.groupBy("leaf").count().collect())        # one row a leaf
    most = min(4 * BLOCK, max(BLOCK, sum(n for _, n in counts) // 256))
    group, held = None, 0
    for leaf, n in counts:
        if group is None or held + n > most:
            group, held = leaf, 0
        held += n
        tree.groups[leaf], tree.blocks[group] = group, -(-held // most)
    named = rows.sparkSession.createDataFrame([(leaf, g, tree.blocks[g]) for leaf, g in tree.groups.items()], "leaf int, first int, of int")
    dealt = rows.join(F.broadcast(named), "leaf").withColumn("block", F.expr("pmod(xxhash64(uid), of)").cast("int")).drop("leaf").withColumnRenamed("first", "leaf")

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        ids = g["vec_id"].astype("Int64").fillna(NULL_ID).to_numpy(np.int64)
        data = b"".join([g["uid"].to_numpy(np.int64).tobytes(), ids.tobytes(), g["label"].to_numpy(np.int64).tobytes(), matrix(g["v"], tree.dim).astype(tree.kind).tobytes()])
        return pd.DataFrame({"leaf": [g["leaf"].iloc[0]], "block": [g["block"].iloc[0]], "n": [len(g)], "data": [data]})

    # ids as text keep null apart from numbers
    packed = dealt.select("leaf", "block", "uid", F.col("vec_id").cast("string").alias("vec_id"), "label", "v")
    return stage(packed.groupBy("leaf", "block").applyInPandas(pack, "leaf int, block int, n int, data binary"), "negative-blocks")


# -- search -----------------------------------------------------------------------------------------------------------------------

def requests(anchors: DataFrame, tree: Tree, own: bool) -> DataFrame:
    """(leaf, block, anchors, windows, wanted): packed anchors for the blocks that they must meet: those of their own leaf's group, or those of all other groups with a leaf that
    survives. ``anchors`` has uid, label, v, leaf and the score windows low and high (arrays of doubles of one length)."""
    def run(batches):
        for b in batches:
            for begin in range(0, len(b), CHUNK):
                part = b.iloc[begin:begin + CHUNK]
                v = matrix(part["v"], tree.dim)
                mine = np.array([tree.groups[k] for k in part["leaf"]])
                low, high = (np.array(part[c].tolist(), dtype=np.float64).reshape(len(part), -1) for c in ("low", "high"))
                keys = np.stack([part["uid"].to_numpy(np.int64), part["label"].to_numpy(np.int64)], 1)
                reached = {k: (low <= high) & (mine == k)[:, None] for k in np.unique(mine)} if own else {}
                if not own:
                    for k, rows, on in tree.survivors(v.astype(np.float64), low, high):
                        k = tree.groups.get(k)
                        if k is not None:
                            reached.setdefault(k, np.zeros(low.shape, dtype=bool))[rows] |= on & (mine[rows] != k)[:, None]
                out, held = [], 0
                for k, on in reached.items():
                    rows = np.flatnonzero(on.any(1))
                    if not len(rows):
                        continue
                    lo = np.where(on[rows], low[rows], np.inf)
                    wanted = b"".join(x.tobytes() for x in (keys[rows], lo, high[rows], v[rows].astype(tree.kind)))
                    for block in range(tree.blocks[k]):
                        out.append((int(k), block, len(rows), low.shape[1], wanted))
                        held += len(wanted)
                        if held >= SEND:
                            yield pd.DataFrame(out, columns=REQUEST)
                            out, held = [], 0
                yield pd.DataFrame(out, columns=REQUEST)
        give_back()

    return anchors.select("uid", "label", "v", "leaf", "low", "high").mapInPandas(run, "leaf int, block int, anchors int, windows int, wanted binary")


def first_k(scores: np.ndarray, ids: np.ndarray, uids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties by smaller id."""
    some = np.arange(len(scores))
    if len(some) > 4 * k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return some[np.lexsort((uids[some], ids[some], -scores[some]))[:k]]


def search(packed: DataFrame, asked: DataFrame, tree: Tree, k: int, same: bool) -> DataFrame:
    """(anchor, w, score, vec_id, uid): per request, window and block the first k rows of the anchor's label, itself aside, or of other labels (``same``
    False). One row of the join is one block and one chunk of anchors."""
    dim, kind = tree.dim, tree.kind
    names = ["anchor", "w", "score", "vec_id", "uid"]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                n, m, w = (b.column(c)[i].as_py() for c in ("n", "anchors", "windows"))
                data, wanted = (b.column(c)[i].as_buffer() for c in ("data", "wanted"))
                uids, ids, labels = np.frombuffer(data, np.int64, 3 * n).reshape(3, n)
                v = np.frombuffer(data, kind, n * dim, 24 * n).reshape(n, dim).astype(np.int64)
                keys = np.frombuffer(wanted, np.int64, 2 * m).reshape(m, 2)
                low, high = np.frombuffer(wanted, np.float64, 2 * m * w, 16 * m).reshape(2, m, w)
                q = np.frombuffer(wanted, kind, m * dim, 16 * m + 16 * m * w).reshape(m, dim).astype(np.int64)
                out = []
                for begin in range(0, m, AT_ONCE):
                    score = products(q[begin:begin + AT_ONCE], v)
                    for a, row in enumerate(score, begin):
                        fits = (labels == keys[a, 1]) & (uids != keys[a, 0]) if same else labels != keys[a, 1]
                        some = np.flatnonzero(fits & (row >= low[a].min()))
                        s = row[some]
                        for x in range(w):
                            inside = np.flatnonzero((s >= low[a, x]) & (s <= high[a, x]))
                            best = some[inside[first_k(s[inside], ids[some[inside]], uids[some[inside]], k)]]
                            out += [(keys[a, 0], x, row[j], ids[j], uids[j]) for j in best]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names)
        give_back()

    # a number of partitions of its own: the work is in the products, and sizes in bytes would let AQE merge it into few tasks
    parts = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = packed.repartition(parts, "leaf", "block").join(asked.repartition(parts, "leaf", "block"), ["leaf", "block"])
    found = pairs.select("n", "data", "anchors", "windows", "wanted").mapInArrow(run, "anchor long, w int, score long, vec_id long, uid long")
    return top(found, k)


def top(found: DataFrame, k: int) -> DataFrame:
    """The first k per anchor and window, with their rank."""
    w = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "vec_id", "uid")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def two_rounds(packed: DataFrame, anchors: DataFrame, tree: Tree, k: int, same: bool) -> DataFrame:
    """The first k per anchor and window over all leaves."""
    first = stage(search(packed, requests(anchors, tree, own=True), tree, k, same), "negative-first")
    kth = first.where(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("kth"))
    tighter = anchors.join(kth, F.col("uid") == F.col("anchor"), "left").withColumn("low", F.transform("low", lambda x, i: F.greatest(
        x, F.coalesce(F.try_element_at("kth", i).cast("double"), x))))
    second = search(packed, requests(tighter, tree, own=False), tree, k, same)
    return stage(top(first.drop("rank").unionByName(second.drop("rank")), k), "negative-found")


def mine(rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of ``members`` whose id is divisible by ``every``. A negative's
    score lies between ``least`` and ``most`` percent of the positive's."""
    tree = build(rows)
    rows = placed(rows, tree)
    packed = blocks(rows, tree)
    anchors = rows.where(F.col("vec_id") % every == 0)
    anywhere = anchors.withColumn("low", F.array(F.lit(float("-inf")))).withColumn("high", F.array(F.lit(float("inf"))))
    found = two_rounds(packed, anywhere, tree, positives, same=True) \
        .select("anchor", (F.col("rank") - 1).alias("w"), F.col("vec_id").alias("positive"), F.col("score").alias("positive_score"))
    # a negative n of a positive p: least * p <= 100 * n <= most * p; missing positives have an empty window
    p = lambda i: F.try_element_at("scores", i)
    windows = lambda of, empty: F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(of(p(i)).cast("double"), F.lit(empty)))
    per_anchor = found.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("w", "positive_score"))).alias("scores"))
    asked = anchors.join(per_anchor, F.col("uid") == F.col("anchor")).drop("anchor") \
        .withColumn("low", windows(lambda s: F.ceil(s * least / 100), float("inf"))).withColumn("high", windows(lambda s: F.floor(s * most / 100), float("-inf")))
    worst = two_rounds(packed, asked, tree, negatives, same=False).select("anchor", "w", "rank", F.col("vec_id").alias("negative"), F.col("score").alias("negative_score"))
    named = lambda c, name: F.when(F.col(c) != int(NULL_ID), F.col(c)).alias(name)
    return worst.join(found, ["anchor", "w"]).join(anchors.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor") \
        .select("anchor_id", named("positive", "positive_id"), F.col("rank").cast("int").alias("rank"), named("negative", "negative_id"), "positive_score", "negative_score")
