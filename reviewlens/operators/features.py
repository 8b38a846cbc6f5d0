"""Split, tokens, vocabulary, TF-IDF, class weights, fixed-length encoding.

Long form (one row per document and term) is the primary representation: it is what the SQL oracle
checks and it scales as ordinary joins and aggregates. ``model.feature_pipeline`` makes ML sparse vectors of
the same terms for the classifier.
"""

from __future__ import annotations

import math
import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources import dictionaries as d
from .ids import hash_first_k, largest_remainder, on_key, repeated_keys

# the term index is given to Python workers, which need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def stratified_split(df: DataFrame, label_col: str = "sentiment", id_cols=("review_id",),
                     test_size: float = d.TEST_SIZE, seed: int = d.SPLIT_SEED) -> DataFrame:
    """M1: adds ``split`` in {'train','test'}. Sizes as the usual stratified splitter: n_test =
    ceil(test_size * n), training rows shared by class with largest remainders, the rest of each class
    is test. Rows are taken in seeded md5 order per class (not the same rows as other libraries)."""
    counts = {r[label_col]: int(r["n"]) for r in df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(counts.values())
    n_test = math.ceil(test_size * n)
    train = largest_remainder(counts, n - n_test)
    k_test = {c: counts[c] - train[c] for c in counts}
    flagged = hash_first_k(df, list(id_cols), seed, k_test, label_col, out="_test")
    return flagged.withColumn("split", F.when(F.col("_test"), F.lit("test")).otherwise(F.lit("train"))).drop("_test")


def tokens(text_col: str = "review_text", stop_words=None):
    """M2 expression: lower-cased word tokens without stop words (Spark's English list by default)."""
    sw = d.spark_stop_words() if stop_words is None else stop_words
    return tx.without_stop_words(tx.word_tokens(text_col), sw)


def with_terms(df: DataFrame, text_col: str = "review_text", out: str = "terms", stop_words=None) -> DataFrame:
    """M3: unigrams then bigrams (bigrams formed after stop-word removal). Tokens are a column first
    so the tokenizer runs once per text."""
    return (df.withColumn("_tok", tokens(text_col, stop_words))
            .withColumn(out, F.concat(F.col("_tok"), tx.bigrams(F.col("_tok")))).drop("_tok"))


def term_counts(df: DataFrame, id_col="review_id", text_col: str = "review_text",
                vocab: DataFrame | None = None) -> DataFrame:
    """(ids, term, n). ``id_col`` is a name or a list. With ``vocab`` (bounded by max_features,
    broadcast) only vocabulary terms are kept before the aggregation shuffles anything."""
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    x = with_terms(df.select(*ids, text_col), text_col, "_terms") \
        .select(*ids, F.explode_outer("_terms").alias("term")).where(F.col("term").isNotNull())
    if vocab is not None:
        x = x.join(F.broadcast(vocab.select("term")), "term", "left_semi")
    return x.groupBy(*ids, "term").agg(F.count(F.lit(1)).alias("n"))


def document_tokens(df: DataFrame, keep: dict, id_col: str = "review_id", text_col: str = "review_text", alone: dict | None = None) -> DataFrame:
    """(id, tokens, *keep): one row per id with the tokens of each of its texts, and the aggregates ``keep`` by name. Texts are what is shuffled, not terms.
    ``alone``: the values of ``keep`` for an id on one row. With it, only the texts of ids on more rows are shuffled, and those of the others stay in their task."""
    if alone is not None:
        again = repeated_keys(df, id_col)
        one = (df if again is None else on_key(df, id_col, again, "left_anti")).select(
            id_col, F.when(F.col(text_col).isNull(), F.array().cast("array<array<string>>")).otherwise(F.array(tokens(text_col))).alias("tokens"),
            *[c.alias(n) for n, c in alone.items()])
        return one if again is None else one.unionByName(document_tokens(on_key(df, id_col, again, "left_semi"), keep, id_col, text_col))
    x = df.groupBy(id_col).agg(F.collect_list(text_col).alias("_texts"), *[c.alias(n) for n, c in keep.items()])
    return x.select(id_col, F.transform("_texts", lambda t: tokens(t)).alias("tokens"), *keep)


def list_terms(lists, owner) -> tuple:
    """(terms, df, tf) of Arrow lists of tokens, as Arrow and numpy arrays: every distinct word and pair of adjacent words of a list, the owners that have it and
    its places. ``owner``: the row of each list. Pairs never cross lists."""
    import pyarrow as pa
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    encoded = pc.dictionary_encode(lists.flatten())
    words, word = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    both = np.flatnonzero(of[1:] == of[:-1])
    row, n_words = np.asarray(owner, np.int64)[of], len(words)
    pairs, pair = np.unique(word[both] * n_words + word[both + 1], return_inverse=True)
    n_rows = int(row.max()) + 1 if len(row) else 1
    key = np.sort(np.concatenate([word, pair + n_words]) * n_rows + np.concatenate([row, row[both]]))
    term = key // n_rows
    first = np.r_[True, key[1:] != key[:-1]][:len(key)]
    df, tf = (np.bincount(t, minlength=n_words + len(pairs)) for t in (term[first], term))
    second = pc.binary_join_element_wise(words.take(pa.array(pairs // max(n_words, 1))), words.take(pa.array(pairs % max(n_words, 1))), " ")
    return pa.concat_arrays([words, second]), df, tf


def term_totals(docs: DataFrame, at_once: int = 1_000_000) -> DataFrame:
    """(term, df, tf) of ``document_tokens``: terms are counted inside Arrow batches, by slices of about ``at_once`` tokens, so what is shuffled is one
    row per term and slice at most, and no row per document and term."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        for b in batches:
            lists = b.column(0)
            texts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            inner = pc.fill_null(pc.list_value_length(lists.flatten()), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(texts)
            slice_of = np.r_[0, np.cumsum(inner)][ends] // at_once      # a document belongs to the slice in which it ends
            for s in np.unique(slice_of):
                at = np.flatnonzero(slice_of == s)
                part = lists.slice(int(at[0]), len(at))
                terms, df, tf = list_terms(part.flatten(), np.repeat(np.arange(len(at)), texts[at]))
                yield pa.RecordBatch.from_arrays([terms, pa.array(df, pa.int64()), pa.array(tf, pa.int64())], names=["term", "df", "tf"])

    return docs.select("tokens").mapInArrow(run, "term string, df long, tf long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))


class TermIndex:
    """A bounded list of terms (words, and pairs of words joined by a space) that counts its terms in Arrow lists of tokens."""

    def __init__(self, terms: list[str]):
        parts = [t.split(" ") for t in terms]
        self.terms = terms
        self.words = {w: i for i, w in enumerate(sorted({w for p in parts for w in p}))}
        self.single = np.full(len(self.words) + 1, -1, np.int64)        # the last one stands for unknown words
        pairs = []
        for i, p in enumerate(parts):
            if len(p) == 1:
                self.single[self.words[p[0]]] = i
            else:
                pairs.append((self.words[p[0]] * len(self.words) + self.words[p[1]], i))
        pairs.sort()
        self.codes, self.pair = np.array([c for c, _ in pairs], np.int64), np.array([i for _, i in pairs], np.int64)

    def count(self, lists, owner=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, n) by row, in the order in which a row has the terms: words, then pairs. ``owner``: the row of each list, ascending, its position if
        not given. Pairs never cross lists."""
        import pyarrow.compute as pc

        none = np.zeros(0, np.int64)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        encoded = pc.dictionary_encode(lists.flatten())
        at = np.array([self.words.get(w, -1) for w in encoded.dictionary.to_pylist()], np.int64)
        if not len(at):
            return none, none, none
        word, of = at[encoded.indices.to_numpy(zero_copy_only=False)], np.repeat(np.arange(len(sizes)), sizes)
        row = of if owner is None else np.asarray(owner)[of]
        one, two, second = self.single[word], none, none
        if len(self.codes):
            both = np.flatnonzero((of[1:] == of[:-1]) & (word[1:] >= 0) & (word[:-1] >= 0))
            code = word[both] * len(self.words) + word[both + 1]
            found = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            hit = self.codes[found] == code
            two, second = row[both[hit]], self.pair[found[hit]]
        rows, terms = np.concatenate([row[one >= 0], two]), np.concatenate([one[one >= 0], second])
        o = np.argsort(rows, kind="stable")
        key, first, n = np.unique(rows[o] * len(self.terms) + terms[o], return_index=True, return_counts=True)
        o = np.argsort(first)
        return key[o] // len(self.terms), key[o] % len(self.terms), n[o]


def linear_positive(index: TermIndex, idf, coef, intercept: float, lists) -> np.ndarray:
    """Whether the linear model's score of each Arrow list of tokens is above 0: intercept + sum(n*idf*coef) / sqrt(sum((n*idf)^2))."""
    row, term, n = index.count(lists)
    w = n * idf[term]
    dot, norm = (np.bincount(row, v, len(lists)) for v in (w * coef[term], w * w))
    return intercept + dot / np.sqrt(np.where(norm > 0, norm, 1.0)) > 0


def vocabulary_counts(docs: DataFrame, vocab: DataFrame, id_col: str = "review_id", carry=()) -> DataFrame:
    """(id, *carry, term, n) of ``document_tokens`` for the terms of ``vocab`` (bounded by max_features), counted inside the rows."""
    import pyarrow as pa
    import pyarrow.compute as pc

    # broadcast values are pickled by reference to their class: only plain lists and arrays travel, the index is made in the task
    table = docs.sparkSession.sparkContext.broadcast([r[0] for r in vocab.select("term").collect()])
    x = docs.select(id_col, *carry, "tokens")

    def run(batches):
        index, terms = TermIndex(table.value), pa.array(table.value, pa.string())
        for b in batches:
            texts = b.column(b.num_columns - 1)
            owner = np.repeat(np.arange(b.num_rows), pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False))
            row, term, n = index.count(texts.flatten(), owner)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns[:-1]), terms.take(pa.array(term)), pa.array(n, pa.int64())],
                                             names=[*b.schema.names[:-1], "term", "n"])

    return x.mapInArrow(run, x.drop("tokens").schema.add("term", "string").add("n", "long"))


def fit_vocabulary(counts: DataFrame, min_df: int = d.MIN_DF, max_features: int = d.MAX_FEATURES,
                   id_col: str = "review_id") -> DataFrame:
    """M4: terms with document frequency >= min_df, then the max_features largest by corpus count
    (ties: term ascending). ``term_index`` is the alphabetical position. At most max_features rows."""
    g = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("tf"))
    return top_terms(g, min_df, max_features)


def top_terms(totals: DataFrame, min_df: int = d.MIN_DF, max_features: int = d.MAX_FEATURES) -> DataFrame:
    """M4 from (term, df, tf)."""
    top = totals.where(F.col("df") >= min_df).orderBy(F.desc("tf"), "term").limit(max_features)   # top-k (TakeOrderedAndProject)
    return top.withColumn("term_index", (F.row_number().over(Window.orderBy("term")) - 1).cast("int"))


def fit_idf(vocab: DataFrame, n_docs: int) -> DataFrame:
    """M5: smoothed idf ln((1+n)/(1+df)) + 1."""
    return vocab.select("term", "term_index",
                        (F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf"))


def tfidf(counts: DataFrame, idf: DataFrame, id_col="review_id") -> DataFrame:
    """M6: (ids, term, term_index, weight) = count * idf, L2-normalised per document."""
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    x = counts.join(F.broadcast(idf), "term").withColumn("w", F.col("n") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*ids)))
    return x.select(*ids, "term", "term_index", (F.col("w") / norm).alias("weight"))


def class_weights(df: DataFrame, label_col: str = "sentiment") -> DataFrame:
    """M7: balanced weights n / (k * n_c)."""
    c = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()
    return c.select(label_col, "n", (F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n"))).alias("weight"))


# ---------------------------------------------------------------------------------------------
# Fixed-length encoding
# ---------------------------------------------------------------------------------------------

def encoder_tokens(text_col: str):
    """Lower-cased words and single punctuation marks."""
    return F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"(?U)[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x1C-\x1F]"), 0)


def fit_encoder_vocab(df: DataFrame, text_col: str = "review_text", id_col: str = "review_id",
                      vocab_size: int = 30000) -> DataFrame:
    """Corpus vocabulary: the vocab_size tokens in the most documents (ties: token ascending); ids
    start after the reserved ones. At most vocab_size rows."""
    t = df.select(id_col, F.explode_outer(F.array_distinct(encoder_tokens(text_col))).alias("token")) \
        .where(F.col("token").isNotNull())
    g = t.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    top = g.orderBy(F.desc("df"), "token").limit(vocab_size)
    return top.select("token", (F.row_number().over(Window.orderBy(F.desc("df"), "token")) - 1 + d.FIRST_WORD_ID)
                      .cast("int").alias("token_id"))


def encode_fixed(df: DataFrame, vocab: DataFrame, text_col: str = "review_text", id_col: str = "review_id",
                 length: int = d.ENCODE_LENGTH) -> DataFrame:
    """(id, input_ids, attention_mask): [CLS] + first length-2 token ids (unknown -> [UNK]) + [SEP],
    padded with [PAD] to ``length``. Tokens are cut before the explode, so a group holds at most
    length-2 rows."""
    keep = length - 2
    x = df.select(id_col, F.posexplode_outer(F.slice(encoder_tokens(text_col), 1, keep)).alias("pos", "token"))
    x = x.join(F.broadcast(vocab), "token", "left")
    g = x.groupBy(id_col).agg(F.array_sort(F.collect_list(
        F.when(F.col("token").isNotNull(), F.struct("pos", F.coalesce("token_id", F.lit(d.UNK_ID)).alias("id"))))).alias("_e"))
    ids = F.transform("_e", lambda e: e["id"])
    full = F.slice(F.concat(F.array(F.lit(d.CLS_ID)), ids, F.array(F.lit(d.SEP_ID)),
                            F.array_repeat(F.lit(d.PAD_ID), length)), 1, length)
    n_real = F.size(ids) + 2
    mask = F.concat(F.array_repeat(F.lit(1), n_real), F.array_repeat(F.lit(0), F.lit(length) - n_real))
    return g.select(id_col, full.alias("input_ids"), mask.alias("attention_mask"))
