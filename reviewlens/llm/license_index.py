"""License scans with a positional index of rare words, in DataFrame functions only.

The index holds, for each licence template, the places of its words of highest IDF (IDF over the whole corpus) and of
its mandatory key phrases. A file is looked up by the rare words it holds: each place of such a word, less the word's
place in a template, is a possible beginning of that template in the file. A beginning on which enough rare words and all key
phrases of the template agree is a hit.

Words: maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. Null texts are empty.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrases: tuple[str, ...]      # mandatory, parts of ``text``


# Licence statements in common use, in lower case without punctuation, and the phrases that must stand in a hit.
TEMPLATES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
             ("permission is hereby granted free of charge",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2",)),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             ("redistribution and use in source and binary forms",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
)
# phrase -> label of the base rule
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def normalized(text) -> Column:
    """The words joined by single spaces. lower() also folds letters outside ASCII, which parts no words; the Kelvin
    sign alone would turn into an ASCII letter, so it gives way to another non-ASCII letter first."""
    t = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("å")))
    return F.trim(F.regexp_replace(t, SEPARATORS, " "))


def n_words(norm) -> Column:
    return F.when(norm == "", 0).otherwise(F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit(""))) + 1).cast("long")


def base_places(norm, phrase: str) -> Column:
    """(n, first, last): how often the phrase stands in the text and its smallest and largest first word."""
    parts = F.split(F.concat(F.lit(" "), norm, F.lit(" ")), f" {phrase}(?= )", -1)
    k = F.size(parts) - 1
    words = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))  # noqa: E731  each word has a space before it
    first, last_part = words(F.element_at(parts, 1)), words(F.element_at(parts, -1)) - 1   # the closing space
    total = n_words(norm)
    found = F.struct(k.cast("long").alias("n"), first.cast("long").alias("first"),
                     (total - last_part - len(phrase.split())).cast("long").alias("last"))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"))
    return F.when(F.concat(F.lit(" "), norm, F.lit(" ")).contains(f" {phrase} "), found).otherwise(none)


def rare_words(docs: DataFrame, text_col: str = "text", templates=TEMPLATES) -> dict[str, float]:
    """IDF of each template word over all documents; one row per word of the templates reaches the driver."""
    vocabulary = sorted({w for t in templates for w in t.text.split()})
    words = F.split(normalized(F.col(text_col)), " ")
    held = F.array_intersect(F.array(*[F.lit(w) for w in vocabulary]), words)
    # one more row per document stands for the document itself
    seen = docs.select(F.explode(F.concat(F.array(F.lit("")), held)).alias("word")).groupBy("word").count()
    df = {r["word"]: r["count"] for r in seen.collect()}
    n = df.pop("", 0)
    return {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1.0 for w in vocabulary}


def index(idf: dict[str, float], templates=TEMPLATES, rare: int = 4) -> list[tuple]:
    """Postings (token, template number, place, IDF): each template's ``rare`` words of highest IDF (ties by word) at all
    their places, and its key phrases with IDF null."""
    out = []
    for i, t in enumerate(templates):
        words = t.text.split()
        best = sorted(set(words), key=lambda w: (-idf[w], w))[:rare]
        out += [(w, i, p, idf[w]) for p, w in enumerate(words) if w in best]
        for phrase in t.phrases:
            k = phrase.split()
            out += [(phrase, i, p, None) for p in range(len(words)) if words[p:p + len(k)] == k][:1]
    return out


def text_key(text) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def hits(docs: DataFrame, postings: list[tuple], text_col: str = "text", templates=TEMPLATES, need: int = 2) -> DataFrame:
    """(key, label, score): templates found in the texts with that key. Only files that hold ``need`` rare words of a template and
    one of its key phrases are taken apart; their rare places are grouped by text, template and beginning."""
    spark = docs.sparkSession
    norm = F.col("norm")
    d = docs.select(text_key(F.col(text_col)).alias("key"), normalized(F.col(text_col)).alias("norm"))
    padded = F.concat(F.lit(" "), norm, F.lit(" "))
    rare_of = {i: sorted({w for w, k, _, idf in postings if k == i and idf is not None}) for i in range(len(templates))}
    phrases = sorted({p for t in templates for p in t.phrases})
    d = d.where(padded.rlike(f" (?:{'|'.join(phrases)}) "))    # one expression: the text is normalized once
    d = d.withColumn("words", F.split("norm", " "))
    rare = F.array(*[F.lit(w) for w in sorted({w for v in rare_of.values() for w in v})])
    place = lambda token, i: F.struct(token.alias("token"), i.alias("place"))
    of_words = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains(rare, w), place(w, i))), lambda x: x.isNotNull())
    parts = [of_words]
    for phrase in phrases:
        k = phrase.split()
        lit = F.array(*[F.lit(w) for w in k])
        at = F.filter(F.transform("words", lambda w, i: F.when(
            (w == k[0]) & (F.slice(F.col("words"), i + 1, len(k)) == lit), place(F.lit(phrase), i))), lambda x: x.isNotNull())
        parts.append(F.when(padded.contains(f" {phrase} "), at).otherwise(F.array().cast("array<struct<token:string,place:int>>")))
    places = d.select("key", F.explode(F.concat(*parts)).alias("p")).select("key", "p.token", "p.place")
    table = spark.createDataFrame(postings, "token string, template int, at int, idf double")   # a few dozen rows
    aligned = places.join(F.broadcast(table), "token").groupBy("key", "template", (F.col("place") - F.col("at")).alias("begin")) \
        .agg(F.collect_set(F.struct("token", "idf")).alias("tokens"))   # at most the template's own tokens
    words = F.filter("tokens", lambda x: x["idf"].isNotNull())
    weight = F.aggregate(words, F.lit(0.0), lambda a, x: a + x["idf"])
    total = {i: sum(idf for w, idf in {(w, idf) for w, k, _, idf in postings if k == i and idf is not None}) for i in rare_of}
    facts = spark.createDataFrame([(i, t.label, len(t.phrases), min(need, len(rare_of[i])), total[i]) for i, t in enumerate(templates)],
                                  "template int, label string, n_phrases int, need int, total double")
    good = aligned.join(F.broadcast(facts), "template").where(
        (F.size(words) >= F.col("need")) & (F.size("tokens") - F.size(words) == F.col("n_phrases")))
    return good.groupBy("key", "label").agg(F.max(F.round(weight / F.col("total"), 6)).alias("score"))


def scan(docs: DataFrame, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    found = hits(docs, index(rare_words(docs, text_col, templates), templates), text_col, templates) \
        .groupBy("key").agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    d = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("key"), normalized(F.col(text_col)).alias("norm"))
    d = d.select("doc_id", "key", n_words(F.col("norm")).alias("n_words"),
                 *[base_places(F.col("norm"), p).alias(f"b{i}") for i, p in enumerate(BASE)])
    b = [F.col(f"b{i}") for i in range(len(BASE))]
    base = F.array_compact(F.array(*[F.when(c["n"] > 0, F.lit(label)) for c, label in zip(b, BASE.values())]))
    d = d.select("doc_id", "key", "n_words", sum((c["n"] for c in b[1:]), b[0]["n"]).alias("n_base"),
                 F.least(*[c["first"] for c in b]).alias("first_word"), F.greatest(*[c["last"] for c in b]).alias("last_word"),
                 F.sort_array(base).alias("base"))
    d = d.join(found, "key", "left")
    every = F.sort_array(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return d.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
                    F.array_join(every, ",").alias("labels"),
                    F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
