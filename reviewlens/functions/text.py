"""Column expressions for text: cleaning, sentence marks, tokens. All JVM-side, no UDFs.

Python's ``\\s`` is Unicode and also covers the ASCII separators 0x1C-0x1F; Java's ``\\s`` is ASCII
unless ``(?U)`` is given, so every whitespace class below is spelled out.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.dictionaries import ABBREVIATIONS

WS = r"[\s\x1C-\x1F]"            # used under (?U)
NON_WS = r"[^\s\x1C-\x1F]"
PUNCT = r"[!-/:-@\[-`{-~]"        # ASCII punctuation, the same set as Python's string.punctuation
SENT_MARK = "\u0001"
DOT_MASK = "\u0002"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c) -> Column:
    """Null -> '', ``<br>`` -> space, URLs removed, whitespace runs -> one space, strip."""
    raw = F.coalesce(_c(c).cast("string"), F.lit(""))
    # patterns run only on texts that hold their fixed letters
    t = F.when(raw.contains("<br"), F.regexp_replace(raw, rf"(?U)<br{WS}*/?>", " ")).otherwise(raw)
    t = F.when(raw.contains("http") | raw.contains("www."), F.regexp_replace(t, rf"(?U)http{NON_WS}+|www\.{NON_WS}+", "")).otherwise(t)
    # single spaces stay as they are and are not matched
    t = F.regexp_replace(t, rf"(?U)(?:[\s\x1C-\x1F&&[^ ]]{WS}*| {WS}+)", " ")
    return F.trim(t)


def strip_ws(c) -> Column:
    """Python ``str.strip()``: remove all leading and trailing whitespace. Only texts that start or end with some are searched."""
    c = _c(c)
    ends = F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1))
    return F.when(ends.rlike(rf"(?U){WS}"), F.regexp_replace(c, rf"(?U)^{WS}+|{WS}+$", "")).otherwise(c)


def abbreviation_pattern() -> str:
    alts = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    return rf"(?i)(^|[^\p{{L}}\p{{N}}_])({alts})\."


def sentence_array(c) -> Column:
    """Split text into sentences (rule splitter).

    A sentence ends at a run of ``.!?`` (plus closing quotes or brackets) followed by whitespace.
    Dots of common abbreviations (Mr. Dr. e.g. ...) are masked first so they do not end a sentence; texts without the
    letters of one are not searched for them.
    """
    c = _c(c)
    some = reduce(or_, [F.lower(c).contains(f"{a.lower()}.") for a in ABBREVIATIONS])
    t = F.when(some, F.regexp_replace(c, abbreviation_pattern(), "$1$2" + DOT_MASK)).otherwise(c)
    t = F.regexp_replace(t, rf"(?U)([.!?]+[\"')\]]*){WS}+", "$1" + SENT_MARK)
    t = F.replace(t, F.lit(DOT_MASK), F.lit("."))
    return F.split(t, SENT_MARK)


def word_tokens(c, lowercase: bool = True) -> Column:
    """M2: runs of two or more word characters (letters, digits, underscore)."""
    t = F.lower(_c(c)) if lowercase else _c(c)
    return F.regexp_extract_all(t, F.lit(r"[\p{L}\p{N}_]{2,}"), 0)


def without_stop_words(tokens: Column, stop_words) -> Column:
    """Drop stop words. A literal IN list of this size becomes a hash-set lookup (InSet)."""
    words = sorted(set(stop_words))
    return F.filter(tokens, lambda x: ~x.isin(*words))


def bigrams(tokens: Column) -> Column:
    """M3: adjacent pairs joined by one space (empty for fewer than two tokens). Pass a column
    reference: the lambda sees only its own arguments, so the token array is computed once."""
    n = F.size(tokens)
    return F.zip_with(F.slice(tokens, 1, F.greatest(n - 1, F.lit(0))), F.slice(tokens, 2, F.greatest(n - 1, F.lit(0))),
                      lambda a, b: F.concat(a, F.lit(" "), b))


def lexicon_words(c) -> Column:
    """Whitespace items with surrounding punctuation stripped when more than two characters remain."""
    items = F.filter(F.split(_c(c), rf"(?U){WS}+"), lambda x: F.length(x) > 0)
    both = F.transform(items, lambda w: F.struct(w.alias("w"), F.regexp_replace(w, rf"^{PUNCT}+|{PUNCT}+$", "").alias("t")))
    return F.transform(both, lambda x: F.when(F.length(x["t"]) <= 2, x["w"]).otherwise(x["t"]))     # trimmed once a word


def is_upper(c) -> Column:
    """Python ``str.isupper()``: no lower-case letter and at least one cased letter."""
    c = _c(c)
    return (F.upper(c) == c) & (F.lower(c) != c)


def count_char(c, ch: str) -> Column:
    c = _c(c)
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


def letter_profile(c, groups=("e", "n", "o", "h", "é")) -> Column:
    """An encoder without a model: the share of each group of letters among a text's letters, as an array; null for a text without letters. Texts
    of one language lie close together."""
    def shares(t, n):
        return F.when(n > 0, F.array(*[(F.length(t) - F.length(F.translate(t, g, ""))) / n for g in groups]))

    # lambda variables hold the lowered text and its number of letters, or each share would make them again
    one = F.transform(F.array(F.lower(_c(c))), lambda t: F.transform(F.array(F.length(F.regexp_replace(t, r"[^\p{L}]+", ""))), lambda n: shares(t, n))[0])
    return one[0]
