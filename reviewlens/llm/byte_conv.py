"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover the whole document. Learned filters slide over each
chunk, every filter keeps its maximum in the chunk, and the chunks' maxima (their mean and their maximum over the
document) go through a small dense layer to one probability. Trained by plain back-propagation on a bounded
sample of labelled documents; scoring is one pass of Arrow batches, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, ship_by_value

ship_by_value(__name__)

PAD = 256             # byte value 256 fills the last chunk
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


@dataclass(frozen=True)
class Shape:
    embed: int = 8
    filters: int = 32
    width: int = 12
    stride: int = 6
    places: int = 84      # filter places in a chunk
    hidden: int = 16

    @property
    def step(self) -> int:      # from one chunk's start to the next one's
        return self.places * self.stride

    @property
    def chunk(self) -> int:     # bytes of a chunk; neighbours overlap by width - stride
        return (self.places - 1) * self.stride + self.width


def chunks(data: bytes, shape: Shape) -> np.ndarray:
    """(chunks, chunk bytes) covering every byte; an empty text is one chunk of padding."""
    n = max(1, -(-max(len(data) - (shape.chunk - shape.step), 1) // shape.step))
    buf = np.full((n - 1) * shape.step + shape.chunk, PAD, dtype=np.int16)
    buf[:len(data)] = np.frombuffer(data, dtype=np.uint8)
    return np.lib.stride_tricks.as_strided(buf, (n, shape.chunk), (shape.step * 2, 2)).copy()


def windows(c: np.ndarray, embed: np.ndarray, shape: Shape) -> np.ndarray:
    """(chunks * places, width * embed) inputs of the filters."""
    e = np.ascontiguousarray(embed[c])
    s = e.strides
    w = np.lib.stride_tricks.as_strided(e, (len(c), shape.places, shape.width, shape.embed), (s[0], s[1] * shape.stride, s[1], s[2]))
    return w.reshape(len(c) * shape.places, shape.width * shape.embed)


def pooled(c: np.ndarray, net: dict, shape: Shape) -> np.ndarray:
    """(chunks, filters): each filter's largest rectified answer in each chunk."""
    out = np.empty((len(c), shape.filters), dtype=np.float32)
    for i in range(0, len(c), 64):
        y = windows(c[i:i + 64], net["embed"], shape) @ net["conv"]
        out[i:i + 64] = y.reshape(-1, shape.places, shape.filters).max(1)
    return np.maximum(out + net["conv_bias"], 0)


def combine(top: np.ndarray, first: np.ndarray, net: dict) -> np.ndarray:
    """Probabilities of the documents whose chunks begin at rows ``first``."""
    counts = np.diff(np.append(first, len(top)))[:, None]
    f = np.hstack([np.maximum.reduceat(top, first), np.add.reduceat(top, first) / counts])
    h = np.maximum(f @ net["dense"] + net["dense_bias"], 0)
    z = h @ net["out"] + net["out_bias"]
    return 1.0 / (1.0 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def score_texts(texts: list[str | None], net: dict, shape: Shape, group_bytes: int = 4_000_000) -> np.ndarray:
    """Scores of whole texts, computed in groups of bounded size; one long text is cut by its own chunks."""
    out = np.empty(len(texts))
    i = 0
    while i < len(texts):
        j, size, parts = i, 0, []
        while j < len(texts) and (not parts or size < group_bytes):
            data = (texts[j] or "").encode("utf-8", "surrogatepass")
            parts.append(chunks(data, shape))
            size += len(data)
            j += 1
        first = np.cumsum([0] + [len(p) for p in parts[:-1]])
        top = np.vstack([pooled(p, net, shape) for p in ([np.vstack(parts)] if len(parts) > 1 else parts)])
        out[i:j] = combine(top, first, net)
        i = j
    return out


def untrained(shape: Shape, rng: np.random.Generator) -> dict:
    k = shape.width * shape.embed
    f32 = np.float32
    return {"embed": rng.normal(0, 0.5, (257, shape.embed)).astype(f32),
            "conv": rng.normal(0, (2 / k) ** 0.5, (k, shape.filters)).astype(f32), "conv_bias": np.zeros(shape.filters, f32),
            "dense": rng.normal(0, (1 / shape.filters) ** 0.5, (2 * shape.filters, shape.hidden)).astype(f32),
            "dense_bias": np.zeros(shape.hidden, f32),
            "out": rng.normal(0, (1 / shape.hidden) ** 0.5, shape.hidden).astype(f32), "out_bias": np.zeros((), f32)}


def gradients(batch: list[np.ndarray], y: np.ndarray, weight: np.ndarray, net: dict, shape: Shape) -> dict:
    """Back-propagation of the weighted log loss through one mini-batch of documents (lists of chunks)."""
    c = np.vstack(batch)
    first = np.cumsum([0] + [len(b) for b in batch[:-1]])
    counts = np.array([len(b) for b in batch])
    doc = np.repeat(np.arange(len(batch)), counts)
    x = windows(c, net["embed"], shape)
    a = (x @ net["conv"]).reshape(len(c), shape.places, shape.filters) + net["conv_bias"]
    at = a.argmax(1)
    top = np.maximum(np.take_along_axis(a, at[:, None], 1)[:, 0], 0)
    most, mean = np.maximum.reduceat(top, first), np.add.reduceat(top, first) / counts[:, None]
    f = np.hstack([most, mean]).astype(np.float32)
    pre = f @ net["dense"] + net["dense_bias"]
    h = np.maximum(pre, 0)
    p = 1 / (1 + np.exp(-np.clip(h @ net["out"] + net["out_bias"], -30, 30)))
    dz = ((p - y) * weight).astype(np.float32)
    dh = np.outer(dz, net["out"]) * (pre > 0)
    df = dh @ net["dense"].T
    n = shape.filters
    is_most = top == most[doc]
    d_top = df[:, :n][doc] * is_most + (df[:, n:] / counts[:, None])[doc]
    d_top = (d_top * (top > 0)).astype(np.float32)
    # only the place of each chunk's maximum passes a gradient on
    rows = (np.arange(len(c))[:, None] * shape.places + at).ravel()
    cols = np.tile(np.arange(n), len(c))
    keep = d_top.ravel() != 0
    rows, cols, g = rows[keep], cols[keep], d_top.ravel()[keep]
    d_conv = np.zeros_like(net["conv"])
    np.add.at(d_conv.T, cols, x[rows] * g[:, None])
    d_bytes = (net["conv"].T[cols] * g[:, None]).reshape(-1, shape.embed)
    at_byte = (rows // shape.places * shape.chunk + rows % shape.places * shape.stride)[:, None] + np.arange(shape.width)
    d_embed = np.zeros_like(net["embed"])
    np.add.at(d_embed, c.ravel()[at_byte.ravel()], d_bytes)
    return {"embed": d_embed, "conv": d_conv, "conv_bias": d_top.sum(0), "dense": f.T @ dh, "dense_bias": dh.sum(0),
            "out": h.T @ dz, "out_bias": dz.sum()}


def fit(sample: list[tuple[str, int]], shape: Shape = Shape(), epochs: int = 8, batch: int = 32, rate: float = 0.004, seed: int = 7) -> dict:
    """Adam on the bounded sample, both classes weighing the same; with no rows the network stays as it began."""
    rng = np.random.default_rng(seed)
    net = untrained(shape, rng)
    if not sample:
        return net
    data = [chunks((t or "").encode("utf-8", "surrogatepass"), shape) for t, _ in sample]
    y = np.array([v for _, v in sample], dtype=np.float32)
    share = {k: max((y == k).mean(), 1e-6) for k in (0, 1)}
    weight = np.where(y == 1, 0.5 / share[1], 0.5 / share[0]).astype(np.float32)
    m, v, t = {k: np.zeros_like(a) for k, a in net.items()}, {k: np.zeros_like(a) for k, a in net.items()}, 0
    steps = epochs * -(-len(data) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for i in range(0, len(order), batch):
            ix = order[i:i + batch]
            g = gradients([data[k] for k in ix], y[ix], weight[ix] / len(ix), net, shape)
            t += 1
            now = rate * (1 - 0.9 * t / steps)
            for k in net:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                net[k] = (net[k] - now * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-7)).astype(np.float32)
    return net


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1000, max_chars: int = 20_000, shape: Shape = Shape()) -> dict:
    """Fit on at most ``per_class`` documents of each label, never on held-out ids."""
    return fit(labelled_sample(docs, labels, per_class, max_chars), shape)


def score_documents(docs: DataFrame, net: dict, shape: Shape = Shape(), threshold: float = 0.3,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row; null and empty texts are scored as one chunk of padding."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            s = score_texts(b.column(2).to_pylist(), net, shape)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()),
                                              pa.array((s >= threshold).astype(np.int32), pa.int32())],
                                             names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"),
                       F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
