"""Approximate nearest neighbours: a neighbour graph by NN-descent, queries by greedy graph search.

Nodes are the distinct vectors, dealt by hash into blocks of bounded size; a block's ids, vectors and neighbour lists are one
row. A round of NN-descent joins blocks three times: every node tells its neighbours of itself (reverse links, a bounded number
per node and sender), every block fetches the vectors on its nodes' lists, and the pairs on each list, neighbours of
neighbours, go back to both nodes' blocks, where the nearest stay. Rounds end when few lists change.

A search begins at the query's own node. Each round sends the unseen neighbours of its best nodes to their blocks, which answer
with distances and, for near ones, their neighbours, until nothing new is near. Scores are computed again in
double precision on the original vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship_by_value, stage

ship_by_value(__name__)


@dataclass(frozen=True)
class Params:
    neighbours: int = 20      # kept per node
    sample: int = 20          # new and old ones each on a node's list in a round
    offers: int = 4           # best pairs that a list offers to each of its nodes
    rounds: int = 9           # at most
    still: float = 0.01       # share of new list entries below which the rounds end
    beam: int = 400           # nodes a search keeps
    block: int = 6000         # nodes of a block
    group: int = 64           # searches that one task advances together
    rerank: int = 40          # nodes of a search scored in double precision
    seed: int = 11


# ---------------------------------------------------------------------------------------------
# numpy inside tasks
# ---------------------------------------------------------------------------------------------

def scatter(x: np.ndarray, seed: int) -> np.ndarray:
    h = (x.astype(np.int64).view(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def block_of(ids: np.ndarray, blocks: int) -> np.ndarray:
    return (scatter(ids, 1) % np.uint64(blocks)).astype(np.int64)


def first_of_each(key: np.ndarray, most: int) -> np.ndarray:
    """Mask of the first ``most`` of equal neighbours in a sorted key."""
    first = np.nonzero(np.r_[True, key[1:] != key[:-1]])[0] if len(key) else np.zeros(0, np.int64)
    return np.arange(len(key)) - np.repeat(first, np.diff(np.r_[first, len(key)])) < most


def nearest_lists(ids, target, cand, dist, new, k):
    """Neighbour lists (n x k ids with -1 for none, distances, new) of ``ids`` (sorted) from offers to targets."""
    keep = target != cand
    target, cand, dist, new = target[keep], cand[keep], dist[keep], new[keep]
    o = np.lexsort((new, cand, target))        # of the same offer the older one stays
    target, cand, dist, new = target[o], cand[o], dist[o], new[o]
    once = np.r_[True, (target[1:] != target[:-1]) | (cand[1:] != cand[:-1])][:len(target)]
    target, cand, dist, new = target[once], cand[once], dist[once], new[once]
    o = np.lexsort((cand, dist, target))
    target, cand, dist, new = target[o], cand[o], dist[o], new[o]
    m = first_of_each(target, k)
    target, cand, dist, new = target[m], cand[m], dist[m], new[m]
    first = np.searchsorted(target, target)
    row, col = np.searchsorted(ids, target), np.arange(len(target)) - first
    g, d, f = np.full((len(ids), k), -1, np.int64), np.full((len(ids), k), np.inf, np.float32), np.zeros((len(ids), k), bool)
    g[row, col], d[row, col], f[row, col] = cand, dist, new
    return g, d, f


def joined_lists(ids, g, f, rev_to, rev_from, rev_new, p: Params, turn: int):
    """Each node's list of the round: up to ``sample`` new and as many old nodes of its neighbours in both directions."""
    k = g.shape[1]
    u = np.concatenate([np.repeat(ids, k), rev_to])
    v, new = np.concatenate([g.ravel(), rev_from]), np.concatenate([f.ravel(), rev_new])
    ok = v >= 0
    u, v, new = u[ok], v[ok], new[ok]
    o = np.lexsort((scatter(v ^ (u << 1), p.seed + turn), ~new, u))
    u, v, new = u[o], v[o], new[o]
    m = first_of_each(u * 2 + ~new, p.sample)
    u, v, new = u[m], v[m], new[m]
    row = np.searchsorted(ids, u)
    col = np.arange(len(u)) - np.searchsorted(u, u)
    lists, fresh = np.full((len(ids), 2 * p.sample), -1, np.int64), np.zeros((len(ids), 2 * p.sample), bool)
    lists[row, col], fresh[row, col] = v, new
    return lists, fresh


def local_join(lists, fresh, known, vectors, limit, p: Params):
    """Offers (target, candidate, distance) of all pairs on a list with a new node, at most ``offers`` per node and list and only ones
    nearer than the target's farthest neighbour. ``known``: sorted ids of ``vectors`` and ``limit``."""
    out = []
    for i in range(0, len(lists), 256):
        ls, fr = lists[i:i + 256], fresh[i:i + 256]
        at = np.searchsorted(known, np.maximum(ls, known[0] if len(known) else 0))
        at = np.minimum(at, len(known) - 1)
        v = vectors[at]
        sq = (v * v).sum(-1)
        d = sq[:, :, None] + sq[:, None, :] - 2 * (v @ v.transpose(0, 2, 1))
        d = np.maximum(d, 0)
        none = ls < 0
        d[none[:, :, None] | none[:, None, :] | (~fr[:, :, None] & ~fr[:, None, :]) | (ls[:, :, None] == ls[:, None, :])] = np.inf
        d[d >= limit[at][:, :, None]] = np.inf
        m = min(p.offers, d.shape[2])
        best = np.argpartition(d, m - 1, axis=2)[:, :, :m]
        dd = np.take_along_axis(d, best, 2)
        a, b, c = np.nonzero(np.isfinite(dd))
        out.append((ls[a, b], ls[a, best[a, b, c]], dd[a, b, c]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    t, c, d = (np.concatenate(x) for x in zip(*out))
    o = np.lexsort((c, t))
    t, c, d = t[o], c[o], d[o]
    once = np.r_[True, (t[1:] != t[:-1]) | (c[1:] != c[:-1])][:len(t)]
    return t[once], c[once], d[once].astype(np.float32)


def raw(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def cell(table, name: str, dtype, row: int = 0) -> np.ndarray:
    return np.frombuffer(table.column(name)[row].as_py(), dtype)


def column(table, name: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype)


def dealt(key: np.ndarray, blocks: int):
    """(block, positions) of ids by their block."""
    to = block_of(key, blocks)
    o = np.argsort(to, kind="stable")
    cut = np.nonzero(np.r_[True, to[o][1:] != to[o][:-1]])[0] if len(o) else []
    for x, y in zip(cut, [*cut[1:], len(o)]):
        yield int(to[o[x]]), o[x:y]


def table_of(rows, schema):
    import pyarrow as pa

    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


# ---------------------------------------------------------------------------------------------
# Spark steps
# ---------------------------------------------------------------------------------------------

def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): vectors as doubles without nulls, without non-finite or only zero components, of the most frequent length (of
    equally frequent ones the longest). Of rows that repeat an id the smallest vector counts; rows without an id take no part."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")) \
        .where("id is not null and v is not null and size(v) > 0") \
        .where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))) \
        .where(F.exists("v", lambda x: x != 0))
    size = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return v.where(F.size("v") == (size[0]["n"] if size else 0)).groupBy("id").agg(F.min("v").alias("v"))


def blocks_of(nodes: DataFrame, blocks: int) -> DataFrame:
    """(block, ids, vectors): sorted ids and float32 vectors of each block."""
    import pyarrow as pa

    def deal(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            v = np.asarray(b.column(1).flatten()).reshape(len(ids), -1).astype(np.float32) if len(ids) else np.zeros((0, 1), np.float32)
            cut = list(dealt(ids, blocks))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in cut], pa.int32()), pa.array([raw(ids[i]) for _, i in cut], pa.binary()),
                                              pa.array([raw(v[i]) for _, i in cut], pa.binary())], names=["block", "ids", "vectors"])

    def gather(t):
        ids = column(t, "ids", np.int64)
        v = column(t, "vectors", np.float32).reshape(len(ids), -1)
        o = np.argsort(ids)
        return pa.table({"block": pa.array([t.column("block")[0].as_py()], pa.int32()), "ids": pa.array([raw(ids[o])], pa.binary()),
                         "vectors": pa.array([raw(v[o])], pa.binary())})

    schema = "block int, ids binary, vectors binary"
    return nodes.select("id", "v").mapInArrow(deal, schema).groupBy("block").applyInArrow(gather, schema)


STATE = "block int, ids binary, lists binary, dists binary, fresh binary"


def state_row(block, ids, g, d, f):
    import pyarrow as pa

    return pa.table({"block": pa.array([block], pa.int32()), **{k: pa.array([raw(x)], pa.binary()) for k, x in
                     (("ids", ids), ("lists", g), ("dists", d), ("fresh", f))}})


def graph(vectors: DataFrame, blocks: int, p: Params) -> tuple[DataFrame, DataFrame]:
    """(state, lists): neighbour lists per block, and each node's neighbours in both directions, from the last round."""
    import pyarrow as pa

    spark = vectors.sparkSession
    k = p.neighbours
    # first lists: nodes of the same block and of one other block, by a hash of node and turn
    pool = vectors.select("block", "ids").select(F.col("block"), F.col("ids").alias("own")) \
        .join(vectors.select(F.pmod(F.col("block") + 1, F.lit(blocks)).cast("int").alias("block"), F.col("ids").alias("other")), "block", "left")

    def begin(batches):
        for b in batches:
            for block, own, other in zip(*(b.column(i).to_pylist() for i in range(3))):
                ids = np.frombuffer(own, np.int64)
                pick = np.unique(np.concatenate([ids, np.frombuffer(other or b"", np.int64)]))
                n = len(ids)
                each = min(k, len(pick))
                rank = scatter(np.repeat(ids, each) * 64 + np.tile(np.arange(each), n), p.seed) % np.uint64(len(pick))
                g = pick[rank.astype(np.int64)] if len(pick) > k else np.tile(pick, n)
                t = np.repeat(ids, each)
                g, d, f = nearest_lists(ids, t, g, np.full(len(t), 3e38, np.float32), np.ones(len(t), bool), k)
                yield state_row(block, ids, g, d, f).to_batches()[0]

    state = stage(pool.mapInArrow(begin, STATE), "ann-state")
    link_schema = pa.schema([("block", pa.int32()), ("to", pa.binary()), ("at", pa.binary()), ("new", pa.binary())])
    list_schema = pa.schema([("block", pa.int32()), ("need", pa.int32()), ("ids", pa.binary()), ("lists", pa.binary()), ("fresh", pa.binary())])
    lists = None
    for turn in range(p.rounds):
        def reverse(batches):
            for b in batches:
                rows = []
                for ids, g, f in zip(*(b.column(i).to_pylist() for i in range(3))):
                    ids, g, f = np.frombuffer(ids, np.int64), np.frombuffer(g, np.int64).reshape(-1, k), np.frombuffer(f, bool)
                    u, v = np.repeat(ids, k), g.ravel()
                    ok = v >= 0
                    u, v, f = u[ok], v[ok], f[ok]
                    o = np.lexsort((scatter(u ^ (v << 1), p.seed + turn), ~f, v))
                    u, v, f = u[o], v[o], f[o]
                    m = first_of_each(v * 2 + ~f, p.sample)         # a hub hears of a bounded number per sender
                    u, v, f = u[m], v[m], f[m]
                    rows += [(c, raw(v[i]), raw(u[i]), raw(f[i])) for c, i in dealt(v, blocks)]
                yield table_of(rows, link_schema).combine_chunks().to_batches()[0] if rows else pa.RecordBatch.from_pylist([], schema=link_schema)

        def meet(own, links):
            if not own.num_rows:
                return table_of([], list_schema)
            ids, g = cell(own, "ids", np.int64), cell(own, "lists", np.int64).reshape(-1, k)
            f = cell(own, "fresh", bool).reshape(-1, k)
            ls, fr = joined_lists(ids, g, f, column(links, "to", np.int64), column(links, "at", np.int64), column(links, "new", bool), p, turn)
            block = own.column("block")[0].as_py()
            need = np.unique(ls[ls >= 0])
            return table_of([(block, -1, raw(ids), raw(ls), raw(fr))] + [(block, c, raw(need[i]), None, None) for c, i in dealt(need, blocks)], list_schema)

        links = state.select("ids", "lists", "fresh").mapInArrow(reverse, "block int, to binary, at binary, new binary")
        lists = stage(state.groupBy("block").cogroup(links.groupBy("block"))
                      .applyInArrow(meet, "block int, need int, ids binary, lists binary, fresh binary"), "ann-lists")
        source = vectors.join(state.select("block", "dists"), "block").withColumnRenamed("block", "need").withColumnRenamed("ids", "held")
        wanted = lists.where("need >= 0").select("block", "need", "ids").join(source.hint("shuffle_hash"), "need")

        def fetch(batches):
            names = ["block", "ids", "vectors", "limit"]
            for b in batches:
                rows = []
                for block, ids, held, vec, dist in zip(*(b.column(c).to_pylist() for c in ("block", "ids", "held", "vectors", "dists"))):
                    ids, held = np.frombuffer(ids, np.int64), np.frombuffer(held, np.int64)
                    at = np.searchsorted(held, ids)
                    v = np.frombuffer(vec, np.float32).reshape(len(held), -1)[at]
                    far = np.frombuffer(dist, np.float32).reshape(len(held), -1)[at, -1]
                    rows.append((block, raw(ids), raw(v), raw(far)))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int32()] + [pa.binary()] * 3)], names=names)

        def offer(own, got):
            schema = pa.schema([("block", pa.int32()), ("target", pa.binary()), ("cand", pa.binary()), ("dist", pa.binary())])
            if not own.num_rows or not got.num_rows:
                return table_of([], schema)
            known, far = column(got, "ids", np.int64), column(got, "limit", np.float32)
            v = column(got, "vectors", np.float32).reshape(len(known), -1)
            o = np.argsort(known)
            t, c, d = local_join(cell(own, "lists", np.int64).reshape(-1, 2 * p.sample), cell(own, "fresh", bool).reshape(-1, 2 * p.sample), known[o], v[o], far[o], p)
            # the nearest offers of this block to each target are enough
            o = np.lexsort((d, t))
            t, c, d = t[o], c[o], d[o]
            m = first_of_each(t, k)
            t, c, d = t[m], c[m], d[m]
            return table_of([(b, raw(t[i]), raw(c[i]), raw(d[i])) for b, i in dealt(t, blocks)], schema)

        def take(own, offers):
            if not own.num_rows:
                return own.select([c.split()[0] for c in STATE.split(", ")])
            ids, g, d = cell(own, "ids", np.int64), cell(own, "lists", np.int64).reshape(-1, k), cell(own, "dists", np.float32).reshape(-1, k)
            f = cell(own, "fresh", bool).reshape(-1, k)
            told = cell(own, "round", np.int64).reshape(-1, 2 * p.sample)
            # what was on the node's list this round is no longer new
            f = f & ~(g[:, :, None] == told[:, None, :]).any(2) if g.size else f
            ok = g >= 0
            t = np.concatenate([np.repeat(ids, k)[ok.ravel()], column(offers, "target", np.int64)])
            c = np.concatenate([g[ok], column(offers, "cand", np.int64)])
            dist = np.concatenate([d[ok], column(offers, "dist", np.float32)])
            new = np.concatenate([f[ok], np.ones(len(t) - ok.sum(), bool)])
            # a first list's unknown distances give way to the same nodes' known ones
            o = np.lexsort((dist, c, t))
            t, c, dist, new = t[o], c[o], dist[o], new[o]
            first = np.r_[True, (t[1:] != t[:-1]) | (c[1:] != c[:-1])][:len(t)]
            return state_row(own.column("block")[0].as_py(), ids, *nearest_lists(ids, t[first], c[first], dist[first], new[first], k))

        got = wanted.mapInArrow(fetch, "block int, ids binary, vectors binary, limit binary")
        mine = lists.where("need < 0").select("block", "lists", "fresh")
        offers = mine.groupBy("block").cogroup(got.groupBy("block")).applyInArrow(offer, "block int, target binary, cand binary, dist binary")
        before = state.join(lists.where("need < 0").select("block", F.col("lists").alias("round")), "block")
        state = stage(before.groupBy("block").cogroup(offers.groupBy("block")).applyInArrow(take, STATE), "ann-state")
        ones = F.length(F.replace(F.hex("fresh"), F.lit("00"), F.lit(""))) / 2
        share = state.agg((F.sum(ones) / F.sum(F.length("fresh"))).alias("s")).first()["s"]
        if share is None or share < p.still:
            break
    del spark
    return state, lists


def search(vectors: DataFrame, state: DataFrame, lists: DataFrame, queries: DataFrame, blocks: int, p: Params) -> DataFrame:
    """(query, id): the ``rerank`` nearest nodes that greedy search finds for each query node (id), itself among them. Queries
    are dealt into groups; a group's searches are one row, so no task holds all of them."""
    import pyarrow as pa

    adjacent = lists.where("need < 0").select("block", F.col("lists").alias("near"))
    index = stage(vectors.join(state.select("block", "lists"), "block").join(adjacent, "block"), "ann-index")
    n = queries.count()
    groups = max(1, -(-n // p.group))
    ask_schema = "block int, grp int, query binary, vec binary, far binary, asked binary, node binary"
    hold_schema = "grp int, query binary, vec binary, sizes binary, node binary, dist binary, seen_sizes binary, seen binary"
    ask_pa = pa.schema([("block", pa.int32()), ("grp", pa.int32())] + [(c, pa.binary()) for c in ("query", "vec", "far", "asked", "node")])

    def requests(grp, query, vec, far, asked, node):
        """Rows that carry a request to the nodes' blocks, with the vectors of the queries that ask there."""
        rows = []
        for b, i in dealt(node, blocks):
            who, at = np.unique(asked[i], return_inverse=True)
            rows.append((b, grp, raw(query[who]), raw(vec[who]), raw(far[who]), raw(at.astype(np.int32)), raw(node[i])))
        return rows

    def begin(t):
        q = t.column("id").to_numpy()
        v = np.asarray(t.column("v").combine_chunks().flatten()).reshape(len(q), -1).astype(np.float32)
        return table_of(requests(t.column("grp")[0].as_py(), q, v, np.full(len(q), np.inf, np.float32), np.arange(len(q)), q), ask_pa)

    qs = queries.withColumn("grp", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
    asks = stage(qs.select("grp", "id", "v").groupBy("grp").applyInArrow(begin, ask_schema), "ann-asks")
    held = None
    answer_pa = pa.schema([("grp", pa.int32())] + [(c, pa.binary()) for c in ("query", "vec", "asked", "node", "dist", "sizes", "near")])

    def answer(own, asked):
        rows = []
        if not own.num_rows:
            return table_of([], answer_pa)
        ids = cell(own, "ids", np.int64)
        v = cell(own, "vectors", np.float32).reshape(len(ids), -1)
        both = np.hstack([cell(own, "lists", np.int64).reshape(len(ids), -1), cell(own, "near", np.int64).reshape(len(ids), -1)])
        for r in range(asked.num_rows):
            query, far = cell(asked, "query", np.int64, r), cell(asked, "far", np.float32, r)
            qv = cell(asked, "vec", np.float32, r).reshape(len(query), -1)
            who, node = cell(asked, "asked", np.int32, r), cell(asked, "node", np.int64, r)
            at = np.searchsorted(ids, node)
            dist = np.empty(len(node), np.float32)
            for i in range(0, len(node), 20_000):
                d = v[at[i:i + 20_000]] - qv[who[i:i + 20_000]]
                dist[i:i + 20_000] = (d * d).sum(1)
            near = dist <= far[who]
            who, node, dist, at = who[near], node[near], dist[near], at[near]
            o = np.lexsort((node, dist, who))
            o = o[first_of_each(who[o], p.beam)]
            who, node, dist, at = who[o], node[o], dist[o], at[o]
            lists_of = [np.unique(x[x >= 0]) for x in both[at]]
            rows.append((asked.column("grp")[r].as_py(), raw(query), raw(qv), raw(who), raw(node), raw(dist), raw(np.array([len(x) for x in lists_of], np.int32)),
                         raw(np.concatenate(lists_of)) if lists_of else b""))
        return table_of(rows, answer_pa)

    def advance(t_held, answers):
        """Merge answers into the searches and ask for the unseen neighbours of what is among the best."""
        hold_pa = pa.schema([("grp", pa.int32())] + [(c, pa.binary()) for c in ("query", "vec", "sizes", "node", "dist", "seen_sizes", "seen")])
        out_pa = pa.schema([("kind", pa.int32()), ("held", pa.struct(list(hold_pa))), ("ask", pa.struct(list(ask_pa)))])
        best, seen, vecs = {}, {}, {}
        grp = None
        for r in range(t_held.num_rows):
            grp = t_held.column("grp")[r].as_py()
            query, s, z = cell(t_held, "query", np.int64, r), cell(t_held, "sizes", np.int32, r), cell(t_held, "seen_sizes", np.int32, r)
            vec = cell(t_held, "vec", np.float32, r).reshape(len(query), -1)
            node, dist, old = cell(t_held, "node", np.int64, r), cell(t_held, "dist", np.float32, r), cell(t_held, "seen", np.int64, r)
            a, b = np.cumsum(np.r_[0, s]), np.cumsum(np.r_[0, z])
            for i, q in enumerate(query.tolist()):
                best[q], seen[q], vecs[q] = (node[a[i]:a[i + 1]], dist[a[i]:a[i + 1]]), old[b[i]:b[i + 1]], vec[i]
        fresh: dict[int, list] = {}
        for r in range(answers.num_rows):
            grp = answers.column("grp")[r].as_py()
            query = cell(answers, "query", np.int64, r)
            vec = cell(answers, "vec", np.float32, r).reshape(len(query), -1)
            who, node, dist = cell(answers, "asked", np.int32, r), cell(answers, "node", np.int64, r), cell(answers, "dist", np.float32, r)
            edge = np.cumsum(np.r_[0, cell(answers, "sizes", np.int32, r)])
            near = cell(answers, "near", np.int64, r)
            cut = np.searchsorted(who, np.arange(len(query) + 1))
            for i, q in enumerate(query.tolist()):
                x, y = cut[i], cut[i + 1]
                vecs[q] = vec[i]
                fresh.setdefault(q, []).append((node[x:y], dist[x:y], edge[x:y + 1], near))
        if grp is None:
            return table_of([], out_pa)
        order = sorted(vecs)
        rows = {c: [] for c in ("query", "vec", "far", "asked", "node")}
        nodes, dists, sizes, olds = [], [], [], []
        for i, q in enumerate(order):
            n0, d0 = best.get(q, (np.zeros(0, np.int64), np.zeros(0, np.float32)))
            parts = fresh.get(q, [])
            node = np.concatenate([n0] + [x[0] for x in parts])
            dist = np.concatenate([d0] + [x[1] for x in parts])
            o = np.lexsort((node, dist))[:p.beam]
            limit = dist[o[-1]] if len(o) else np.inf
            around = [near[e[j]:e[j + 1]] for nd, ds, e, near in parts for j in np.nonzero(ds <= limit)[0]]
            old = seen.get(q, np.array([q], np.int64))
            ask = np.setdiff1d(np.concatenate(around), old, assume_unique=False) if around else np.zeros(0, np.int64)
            nodes.append(node[o])
            dists.append(dist[o])
            sizes.append(len(o))
            olds.append(np.union1d(old, ask))
            rows["node"].append(ask)
            rows["asked"].append(np.full(len(ask), i))
            rows["far"].append(limit if len(o) == p.beam else np.inf)
        vec = np.stack([vecs[q] for q in order])
        hold = (grp, raw(np.array(order, np.int64)), raw(vec), raw(np.array(sizes, np.int32)), raw(np.concatenate(nodes)), raw(np.concatenate(dists).astype(np.float32)),
                raw(np.array([len(x) for x in olds], np.int32)), raw(np.concatenate(olds)))
        asks = requests(grp, np.array(order, np.int64), vec, np.array(rows["far"], np.float32), np.concatenate(rows["asked"]).astype(np.int64), np.concatenate(rows["node"]))
        as_dict = lambda schema, r: dict(zip(schema.names, r))
        return table_of([(0, as_dict(hold_pa, hold), None)] + [(1, None, as_dict(ask_pa, r)) for r in asks], out_pa)

    while True:
        answers = index.groupBy("block").cogroup(asks.groupBy("block")).applyInArrow(
            answer, "grp int, query binary, vec binary, asked binary, node binary, dist binary, sizes binary, near binary")
        if held is None:
            held = queries.sparkSession.createDataFrame([], hold_schema)
        both = stage(held.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(
            advance, f"kind int, held struct<{hold_schema.replace(' ', ':').replace(',:', ',')}>, ask struct<{ask_schema.replace(' ', ':').replace(',:', ',')}>"), "ann-search")
        held, asks = both.where("kind = 0").select("held.*"), both.where("kind = 1").select("ask.*")
        if not asks.limit(1).count():
            break

    def unroll(batches):
        for b in batches:
            q, node = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for query, size, found in zip(*(b.column(c).to_pylist() for c in ("query", "sizes", "node"))):
                size = np.frombuffer(size, np.int32)
                who = np.repeat(np.frombuffer(query, np.int64), size)
                m = np.arange(len(who)) - np.repeat(np.cumsum(size) - size, size) < p.rerank + 1
                q.append(who[m])
                node.append(np.frombuffer(found, np.int64)[m])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(q)), pa.array(np.concatenate(node))], names=["query", "id"])

    return held.select("query", "sizes", "node").mapInArrow(unroll, "query long, id long")


def nearest(vectors: DataFrame, query_every: int = 100, k: int = 10, p: Params = Params(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest rows found for each usable row whose id is divisible by ``query_every``, by
    Euclidean distance in double precision, ties to the smaller id; never the query's own row. Equal vectors are one
    node; its smallest k + 1 ids stand for it, which is all that a result can use."""
    rows = stage(usable(vectors, id_col, vector_col), "ann-rows")
    at = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    least = stage(rows.withColumn("at", at).where(F.col("at") <= k + 1), "ann-ids")
    nodes = stage(least.where("at = 1").select("id", "v"), "ann-nodes")
    members = least.join(nodes.select(F.col("id").alias("node"), "v"), "v").select("node", "id")
    n = nodes.count()
    if n == 0:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    blocks = max(1, min(6, n // 500), -(-n // p.block))
    own = rows.where(F.col("id") % query_every == 0).select(F.col("id").alias("query_id"), "v") \
        .join(nodes.select(F.col("id").alias("node"), "v"), "v").select("query_id", "node", "v")
    own = stage(own, "ann-queries")
    dealt_nodes = stage(blocks_of(nodes, blocks), "ann-blocks")
    state, lists = graph(dealt_nodes, blocks, p)
    found = search(dealt_nodes, state, lists, own.select(F.col("node").alias("id"), "v").dropDuplicates(["id"]), blocks, p)
    pairs = found.join(nodes.select("id", F.col("v").alias("there")), "id").join(own.withColumnRenamed("v", "here"), F.col("query") == F.col("node")) \
        .select("query_id", F.col("id").alias("found"), F.sqrt(F.aggregate(F.zip_with("here", "there", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)).alias("score"))
    each = pairs.join(members.withColumnRenamed("node", "found"), "found").where("id <> query_id").select("query_id", F.col("id").alias("vec_id"), "score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
