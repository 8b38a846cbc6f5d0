"""Quality rules by line sequence labelling.

Each line of a document gets a few numbers (symbol share, capitals, repeated words, ...). A linear-chain
conditional random field with two states, boilerplate and content, is trained on a bounded sample of labelled
documents, every line carrying its document's label. Viterbi decoding marks each line of a document; the share
of words on content lines decides whether the document stays.

Nothing is shuffled: one pass of Arrow batches over whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
from pyspark.sql import DataFrame

from .common import forget_tables, give_back, labelled_sample, ship_by_value

ship_by_value(__name__)

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
N_FEATURES = 12
CONTENT = 1
TEXTS = 100           # texts of an Arrow batch that are Python strings at once


@dataclass(frozen=True)
class Crf:
    emit: np.ndarray      # (features, 2)
    trans: np.ndarray     # (2, 2): from state, to state
    start: np.ndarray     # (2,)


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    window: int = 8
    max_repeat_percent: int = 30
    min_content_share: float = 0.5


SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, content_share double, n_lines long, n_content_lines long")


def line_numbers(line: str, words: list[str], again: bool) -> list[float]:
    """The features of a line that has words."""
    n, chars = len(words), len(line)
    symbols = sum(map(line.count, SYMBOLS))
    upper = sum(map(str.isupper, words))
    same_next = sum(map(eq, words, islice(words, 1, None)))
    last = words[-1][-1]
    return [1.0, min(symbols / n, 2.0), upper / n, min(line.count("!") / n, 2.0), 1.0 - len(set(words)) / n, same_next / n,
            min(line.count("|") / n, 1.0), float(again), min(chars / n, 30.0) / 10.0, float(last in ".?!"),
            float(n < 4), min(line.count("-") / n, 1.0)]


def viterbi(x: np.ndarray, crf: Crf) -> np.ndarray:
    """Best state of each line; a tie goes to content, so an untrained model (all weights 0) marks content."""
    s = x @ crf.emit
    t00, t01, t10, t11 = crf.trans.ravel().tolist()
    rows = s.tolist()
    a, b = crf.start[0] + rows[0][0], crf.start[1] + rows[0][1]
    back = []
    for e0, e1 in rows[1:]:
        from0, from1 = b + t10 >= a + t00, b + t11 >= a + t01
        back.append((from0, from1))
        a, b = (b + t10 if from0 else a + t00) + e0, (b + t11 if from1 else a + t01) + e1
    k = int(b >= a)
    out = [k]
    for step in reversed(back):
        k = int(step[k])
        out.append(k)
    return np.array(out[::-1], dtype=np.int8)


def repeated_words(ids: np.ndarray, window: int) -> int:
    """Words inside windows of ``window`` words that stand in the text twice or more. Words are compared by
    their 64-bit hashes, windows by a 64-bit mix of those."""
    m = len(ids) - window + 1
    if m < 2:
        return 0
    h = ids.view(np.uint64)
    key = np.zeros(m, dtype=np.uint64)
    for k in range(window):
        key = (key ^ h[k:k + m]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    ordered = np.sort(key)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    starts = np.nonzero(np.isin(key, ordered[1:][ordered[1:] == ordered[:-1]]))[0]
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def describe(text: str, window: int):
    """(base numbers, features of the lines with words, words on each of them)."""
    features, sizes, hashes, earlier, dup = [], [], [], set(), 0
    odd = any(c in text for c in "\t\x0b\x0c\r")
    for line in text.split("\n"):
        words = list(filter(None, (spaced(line) if odd else line).split(" ")))
        if not words:
            continue
        again = line in earlier
        dup += again
        earlier.add(line)
        features.append(line_numbers(line, words, again))
        sizes.append(len(words))
        hashes.append(np.fromiter(map(hash, words), np.int64, len(words)))
    n_chars = len(text) - sum(map(text.count, SPACES))
    ids = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.int64)
    base = (len(ids), n_chars, sum(map(text.count, SYMBOLS)), dup, repeated_words(ids, window))
    return base, np.array(features, dtype=np.float64).reshape(-1, N_FEATURES), np.array(sizes, dtype=np.int64)


def spaced(line: str) -> str:
    """Only the six ASCII white-space characters part words."""
    return line.translate({9: " ", 11: " ", 12: " ", 13: " "})


def fit(sample: list[tuple[str, int]], rounds: int = 120, step: float = 0.2, l2: float = 1e-3, piece: int = 64) -> Crf:
    """Maximum conditional likelihood by forward-backward and Adam; every line has its document's label.
    Long documents are cut into pieces of ``piece`` lines. No rows: all weights 0."""
    zero = Crf(np.zeros((N_FEATURES, 2)), np.zeros((2, 2)), np.zeros(2))
    xs, ys = [], []
    for text, y in sample:
        _, x, _ = describe(text or "", 8)
        for i in range(0, len(x), piece):
            xs.append(x[i:i + piece])
            ys.append(y)
    if not xs:
        return zero
    n, length = len(xs), max(map(len, xs))
    x = np.zeros((n, length, N_FEATURES))
    on = np.zeros((n, length))
    for i, v in enumerate(xs):
        x[i, :len(v)] = v
        on[i, :len(v)] = 1.0
    y = np.array(ys)
    weight = on / max(on.sum(), 1.0)
    # each class counts half, and each sequence by its lines
    for k in (0, 1):
        total = weight[y == k].sum()
        if 0 < total < 1:
            weight[y == k] *= 0.5 / total
    gold = np.zeros((n, length, 2))
    gold[np.arange(n), :, y] = 1.0
    theta = [zero.emit.copy(), zero.trans.copy(), zero.start.copy()]
    m = [np.zeros_like(t) for t in theta]
    v = [np.zeros_like(t) for t in theta]
    w_seq = weight.sum(1) / np.maximum(on.sum(1), 1.0)
    for it in range(1, rounds + 1):
        emit, trans, start = theta
        e = x @ emit
        alpha = np.empty((n, length, 2))
        alpha[:, 0] = start + e[:, 0]
        for t in range(1, length):
            nxt = np.logaddexp(alpha[:, t - 1, 0, None] + trans[0], alpha[:, t - 1, 1, None] + trans[1]) + e[:, t]
            alpha[:, t] = np.where(on[:, t, None] > 0, nxt, alpha[:, t - 1])
        log_z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        beta = np.zeros((n, length, 2))
        for t in range(length - 2, -1, -1):
            inner = beta[:, t + 1] + e[:, t + 1]
            prev = np.stack([np.logaddexp(trans[k, 0] + inner[:, 0], trans[k, 1] + inner[:, 1]) for k in (0, 1)], 1)
            beta[:, t] = np.where(on[:, t + 1, None] > 0, prev, beta[:, t + 1])
        marginal = np.exp(alpha + beta - log_z[:, None, None]) * on[..., None]
        diff = (marginal - gold * on[..., None]) * w_seq[:, None, None]
        g_emit = np.einsum("ntf,nts->fs", x, diff) + l2 * emit
        pair = np.exp(alpha[:, :-1, :, None] + trans + (e + beta)[:, 1:, None, :] - log_z[:, None, None, None])
        pair *= (on[:, 1:] * w_seq[:, None])[..., None, None]
        truth = np.zeros((2, 2))
        for k in (0, 1):
            truth[k, k] = (on[y == k, 1:] * w_seq[y == k, None]).sum()
        g_trans = pair.sum((0, 1)) - truth + l2 * trans
        g_start = diff[:, 0].sum(0) + l2 * start
        for i, g in enumerate((g_emit, g_trans, g_start)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            theta[i] = theta[i] - step * (m[i] / (1 - 0.9 ** it)) / (np.sqrt(v[i] / (1 - 0.999 ** it)) + 1e-8)
    return Crf(*theta)


def judge(text: str | None, crf: Crf, rules: Rules) -> tuple:
    """The result columns after doc_id. Null and empty texts have no words: they fail the base rule."""
    base, x, sizes = describe(text or "", rules.window)
    n_words, n_repeat = base[0], base[4]
    failed = n_words < rules.min_words or 100 * n_repeat > rules.max_repeat_percent * n_words
    marks = viterbi(x, crf) if len(x) else np.zeros(0, dtype=np.int8)
    share = float((sizes * marks).sum() / n_words) if n_words else 0.0
    return (*base, failed, not failed and share >= rules.min_content_share, share, len(x), int(marks.sum()))


def label_documents(docs: DataFrame, crf: Crf, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row (repeated rows stay repeated, a null id stays null)."""
    import pyarrow as pa

    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches):
        for b in batches:
            parts = (b.column(1).slice(i, TEXTS).to_pylist() for i in range(0, b.num_rows, TEXTS))
            out = [judge(t, crf, rules) for part in parts for t in part]
            cols = [b.column(0), *(pa.array(c) for c in zip(*out))] if out else [b.column(0)] + [pa.array([]) for _ in names[1:]]
            types = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(cols, types)], names=names)

    return docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")).mapInArrow(run, SCHEMA)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 600, max_chars: int = 20_000) -> Crf:
    """Fit on at most ``per_class`` documents of each quality label, texts of at most ``max_chars`` characters."""
    return fit(labelled_sample(docs, labels, per_class, max_chars))


def keep_documents(docs: DataFrame, crf: Crf, rules: Rules = Rules(), text_col: str = "text") -> DataFrame:
    """The rows whose verdict is kept, with all their columns."""
    import pyarrow as pa

    def run(batches):
        forget_tables()
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col))
            parts = (texts.slice(i, TEXTS).to_pylist() for i in range(0, b.num_rows, TEXTS))
            yield b.filter(pa.array([judge(t, crf, rules)[6] for part in parts for t in part], pa.bool_()))
            del b, texts, parts
            give_back()

    return docs.mapInArrow(run, docs.schema)
