"""DuckDB SQL pieces for the oracle: the same definitions as the Spark operators, in DuckDB's dialect.

RE2 has no ``(?U)``: whitespace is spelled as Python's set. DuckDB lists are 1-based and a negative
index counts from the end, so every neighbour lookup is guarded.
"""

from __future__ import annotations

from ..sources import dictionaries as d

WS = r"[\s\x0B\x{85}\p{Z}\x1C-\x1F]"
NON_WS = r"[^\s\x0B\x{85}\p{Z}\x1C-\x1F]"
PUNCT = r"[!-/:-@\[-`{-~]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(words) -> str:
    return "(" + ", ".join(q(w) for w in sorted(set(words))) + ")"


def clean(c: str) -> str:
    t = f"coalesce(CAST({c} AS VARCHAR), '')"
    t = f"regexp_replace({t}, '<br{WS}*/?>', ' ', 'g')"
    t = f"regexp_replace({t}, 'http{NON_WS}+|www\\.{NON_WS}+', '', 'g')"
    t = f"regexp_replace({t}, '{WS}+', ' ', 'g')"
    return f"trim({t})"


def strip_ws(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def sentence_list(c: str) -> str:
    alts = "|".join(a.replace(".", r"\.") for a in d.ABBREVIATIONS)
    t = f"regexp_replace({c}, '(?i)(^|[^\\p{{L}}\\p{{N}}_])({alts})\\.', '\\1\\2' || chr(2), 'g')"
    t = f"regexp_replace({t}, '([.!?]+[\"'')\\]]*){WS}+', '\\1' || chr(1), 'g')"
    t = f"replace({t}, chr(2), '.')"
    return f"str_split({t}, chr(1))"


def word_tokens(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"


def lexicon_words(c: str) -> str:
    strip = f"regexp_replace(x, '^{PUNCT}+|{PUNCT}+$', '', 'g')"
    items = f"list_filter(regexp_split_to_array({c}, '{WS}+'), lambda x: length(x) > 0)"
    return f"list_transform({items}, lambda x: CASE WHEN length({strip}) <= 2 THEN x ELSE {strip} END)"


def is_upper(c: str) -> str:
    return f"(upper({c}) = {c} AND lower({c}) <> {c})"


def count_char(c: str, ch: str) -> str:
    return f"(length({c}) - length(replace({c}, {q(ch)}, '')))"


def label_of_quality(c: str) -> str:
    return f"CASE {c} WHEN 1 THEN 'positive' WHEN 0 THEN 'negative' END"


# ------------------------------------------------------------------------------------------------
# Common CTEs
# ------------------------------------------------------------------------------------------------

RAW = f"""raw AS (
  SELECT d.doc_id, d.text AS review, {label_of_quality('l.quality')} AS sentiment
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

CLEANED = f"""cleaned AS (
  SELECT doc_id, {clean('review')} AS review_text, sentiment AS label_sentiment FROM raw)"""

REVIEWS = """reviews AS (
  SELECT doc_id, review_text, label_sentiment,
         row_number() OVER (ORDER BY doc_id) - 1 AS review_id, label_sentiment AS sentiment
  FROM cleaned WHERE length(review_text) > 10)"""

BASE = ",\n".join([RAW, CLEANED, REVIEWS])


def sentences_cte(name: str = "sentences", src: str = "reviews", text: str = "review_text",
                  keep: str = "r.review_id, r.sentiment AS review_sentiment", min_len: int = d.MIN_SENTENCE_CHARS) -> str:
    return f"""{name} AS (
  SELECT * FROM (
    SELECT {keep}, CAST(u.i - 1 AS INTEGER) AS pos, {strip_ws('u.s')} AS sentence
    FROM {src} r, unnest({sentence_list('r.' + text)}) WITH ORDINALITY AS u(s, i))
  WHERE length(sentence) >= {max(min_len, 1)})"""


def seed_lexicon_values() -> str:
    rows = ", ".join(f"({q(t)}, CAST({v!r} AS DOUBLE))" for t, v in d.SEED_LEXICON)
    return f"(VALUES {rows}) AS seed_v(token, valence)"


def corpus_lexicon_cte(src: str = "reviews", min_df: int = 5) -> str:
    return f"""lx_lab AS (SELECT review_id, sentiment, review_text FROM {src} WHERE sentiment IN ('positive', 'negative')),
lx_cnt AS (SELECT count(*) FILTER (WHERE sentiment = 'positive') AS np,
                   count(*) FILTER (WHERE sentiment = 'negative') AS nn FROM lx_lab),
lx_tok AS (SELECT DISTINCT l.review_id, l.sentiment, lower(t.w) AS token
            FROM lx_lab l, unnest({lexicon_words('l.review_text')}) AS t(w)),
lx_g AS (SELECT token, count(*) FILTER (WHERE sentiment = 'positive') AS dp,
                 count(*) FILTER (WHERE sentiment = 'negative') AS dn
          FROM lx_tok GROUP BY token HAVING count(*) >= {min_df}),
lx_induced AS (SELECT token, CASE WHEN dp * nn >= 2 * dn * np THEN 2.0
                               WHEN 2 * dp * nn <= dn * np THEN -2.0
                               WHEN 4 * dp * nn >= 5 * dn * np THEN 1.0
                               WHEN 5 * dp * nn <= 4 * dn * np THEN -1.0 END::DOUBLE AS valence
            FROM lx_g, lx_cnt),
lx_seed AS (SELECT * FROM {seed_lexicon_values()}),
lexicon AS (SELECT token, valence FROM lx_induced
            WHERE valence IS NOT NULL AND token NOT IN (SELECT token FROM lx_seed)
            UNION ALL SELECT token, valence FROM lx_seed)"""


def lexicon_scores_cte(src: str, id_col: str, text_col: str, name: str = "scores", carry: str = "") -> str:
    """(ids, carry..., compound) for every row of ``src``; mirrors operators.lexicon.lexicon_scores.
    ``id_col`` is one column or a comma-separated list."""
    ids = [c.strip() for c in id_col.split(",")]
    xids = ", ".join(f"x.{c}" for c in ids)
    join_on = " AND ".join(f"sm.{c} = x.{c}" for c in ids)
    up, down, neg = in_list(d.BOOSTERS_UP), in_list(d.BOOSTERS_DOWN), in_list(d.NEGATIONS)
    mods = in_list(list(d.BOOSTERS_UP) + list(d.BOOSTERS_DOWN) + list(d.NEGATIONS) + ["least"])
    cc = f", {carry}" if carry else ""
    ccx = "".join(f", x.{c.strip()}" for c in carry.split(",")) if carry else ""
    parts = [f"""{name}_lex AS (SELECT lower(token) AS t, max(valence)::DOUBLE AS v FROM lexicon GROUP BY 1)""",
             f"""{name}_w AS (
  SELECT {id_col}{cc}, {lexicon_words(text_col)} AS w,
         {count_char(text_col, '!')} AS ex, {count_char(text_col, '?')} AS qm
  FROM {src})""",
             f"""{name}_w2 AS (
  SELECT *, len(list_filter(w, lambda x: {is_upper('x')})) AS ncaps,
         coalesce(list_position(list_transform(w, lambda x: lower(x)), 'but'), 0) AS but
  FROM {name}_w)""",
             f"""{name}_it AS (
  SELECT {xids}, (x.ncaps > 0 AND x.ncaps < len(x.w)) AS capdiff, x.but, CAST(u.i - 1 AS INTEGER) AS wpos,
         u.wd AS w0, CASE WHEN u.i > 1 THEN x.w[u.i - 1] END AS w1,
         CASE WHEN u.i > 2 THEN x.w[u.i - 2] END AS w2, CASE WHEN u.i > 3 THEN x.w[u.i - 3] END AS w3,
         lower(x.w[u.i + 1]) AS f1, lower(x.w[u.i + 2]) AS f2
  FROM {name}_w2 x, unnest(x.w) WITH ORDINALITY AS u(wd, i))""",
             f"""{name}_j AS (
  SELECT it.*, lower(w1) AS l1, lower(w2) AS l2, lower(w3) AS l3, lx.v AS v0,
         lower(w0) AS l0,
         (SELECT true FROM {name}_lex z WHERE z.t = lower(it.w1) AND (lower(it.w1) IN {mods} OR contains(lower(it.w1), 'n''t'))) AS in1,
         (SELECT true FROM {name}_lex z WHERE z.t = lower(it.w2) AND (lower(it.w2) IN {mods} OR contains(lower(it.w2), 'n''t'))) AS in2,
         (SELECT true FROM {name}_lex z WHERE z.t = lower(it.w3) AND (lower(it.w3) IN {mods} OR contains(lower(it.w3), 'n''t'))) AS in3
  FROM {name}_it it JOIN {name}_lex lx ON lx.t = lower(it.w0))""",
             f"""{name}_v0 AS (
  SELECT *, CASE WHEN capdiff AND {is_upper('w0')} THEN (CASE WHEN v0 > 0 THEN v0 + {d.CAPS_INCR} ELSE v0 - {d.CAPS_INCR} END)
                 ELSE v0 END AS v FROM {name}_j)"""]
    prev = f"{name}_v0"
    for k, damp in ((1, 1.0), (2, d.DAMP_2), (3, d.DAMP_3)):
        s = f"CASE WHEN l{k} IN {up} THEN {d.BOOST_INCR} WHEN l{k} IN {down} THEN {d.BOOST_DECR} ELSE 0.0 END"
        s = f"(CASE WHEN ({s}) <> 0 THEN (CASE WHEN v < 0 THEN -({s}) ELSE ({s}) END) ELSE ({s}) END)"
        s = (f"(CASE WHEN {s} <> 0 AND {is_upper(f'w{k}')} AND capdiff THEN "
             f"(CASE WHEN v > 0 THEN {s} + {d.CAPS_INCR} ELSE {s} - {d.CAPS_INCR} END) ELSE {s} END)")
        parts.append(f"""{name}_b{k} AS (SELECT *, CAST({s} AS DOUBLE) * {damp} AS s{k} FROM {prev})""")
        negk = f"(l{k} IN {neg} OR contains(l{k}, 'n''t'))"
        between = [f"l{j}" for j in range(1, k)]
        never, doubt = (" OR ".join(f"coalesce({b} IN {in_list(words)}, false)" for b in between) or "false" for words in (d.NEVER_WORDS, ["doubt"]))
        vnew = (f"(CASE WHEN l{k} = 'never' AND ({never}) THEN (v + s{k}) * {d.NEVER_SCALAR} "
                f"WHEN {negk} AND NOT (l{k} = 'without' AND ({doubt})) THEN (v + s{k}) * {d.NEGATION_SCALAR} ELSE v + s{k} END)")
        parts.append(f"""{name}_v{k} AS (
  SELECT * REPLACE (CASE WHEN w{k} IS NOT NULL AND in{k} IS NULL THEN {vnew} ELSE v END AS v) FROM {name}_b{k})""")
        prev = f"{name}_v{k}"
    idiom = lambda *w: "(SELECT i.v FROM {0}_idioms i WHERE i.p = {1})".format(name, " || ' ' || ".join(w))  # noqa: E731  null if a word is
    damps = in_list(d.PHRASE_DAMPENERS)
    values = ", ".join(f"({q(p)}, {float(v)!r}::DOUBLE)" for p, v in d.IDIOMS)
    parts.append(f"""{name}_idioms AS (SELECT * FROM (VALUES {values}) AS t(p, v))""")
    parts.append(f"""{name}_v4 AS (SELECT * REPLACE (coalesce({idiom('l2', 'l1', 'l0')}, {idiom('l1', 'l0', 'f1')}, {idiom('l0', 'f1', 'f2')},
    {idiom('l1', 'l0')}, {idiom('l0', 'f1')}, v) AS v) FROM {prev})""")
    parts.append(f"""{name}_v5 AS (SELECT * REPLACE (CASE WHEN coalesce(l3 || ' ' || l2 IN {damps}, false) OR coalesce(l2 || ' ' || l1 IN {damps}, false)
    THEN v + CASE WHEN v > 0 THEN {d.BOOST_DECR} WHEN v < 0 THEN -({d.BOOST_DECR}) ELSE 0 END ELSE v END AS v) FROM {name}_v4)""")
    parts.append(f"""{name}_v6 AS (SELECT * REPLACE (CASE WHEN l1 = 'least' AND in1 IS NULL AND NOT coalesce(l2 IN {in_list(d.LEAST_KEEPS)}, false)
    THEN v * {d.NEGATION_SCALAR} ELSE v END AS v) FROM {name}_v5)""")
    prev = f"{name}_v6"
    boost_all = in_list(list(d.BOOSTERS_UP) + list(d.BOOSTERS_DOWN))
    parts.append(f"""{name}_sum AS (
  SELECT {id_col}, sum((CASE WHEN l0 IN {boost_all} OR coalesce(l0 || ' ' || f1 IN {damps}, false) THEN 0.0 ELSE v END) *
                       (CASE WHEN but = 0 THEN 1.0 WHEN wpos + 1 < but THEN {d.BUT_BEFORE}
                             WHEN wpos + 1 > but THEN {d.BUT_AFTER} ELSE 1.0 END)) AS s
  FROM {prev} GROUP BY {id_col})""")
    s = "round(coalesce(sm.s, 0.0), 10)"
    punct = (f"(least(x.ex, {d.EXCLAIM_MAX}) * {d.EXCLAIM_INCR} + CASE WHEN x.qm > 1 THEN "
             f"(CASE WHEN x.qm <= 3 THEN x.qm * {d.QUESTION_INCR} ELSE {d.QUESTION_CAP} END) ELSE 0.0 END)")
    s2 = f"(CASE WHEN {s} > 0 THEN {s} + {punct} WHEN {s} < 0 THEN {s} - {punct} ELSE {s} END)"
    parts.append(f"""{name}_s2 AS (
  SELECT {xids}{ccx}, CAST({s2} AS DOUBLE) AS s2 FROM {name}_w x LEFT JOIN {name}_sum sm ON {join_on})""")
    parts.append(f"""{name} AS (
  SELECT * EXCLUDE (s2), round(greatest(-1.0, least(1.0, s2 / sqrt(s2 * s2 + {d.NORM_ALPHA}))), 4) AS compound
  FROM {name}_s2)""")
    return ",\n".join(parts)


def compound_label(c: str) -> str:
    return (f"CASE WHEN {c} >= {d.POSITIVE_AT} THEN 'positive' WHEN {c} <= {d.NEGATIVE_AT} THEN 'negative' "
            f"ELSE 'neutral' END")


def keyword_aspect(c: str, table=d.API_ASPECT_KEYWORDS, default: str = d.DEFAULT_ASPECT) -> str:
    whens = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({c}), {q(k)})" for k in kws) + f" THEN {q(a)}" for a, kws in table)
    return f"CASE {whens} ELSE {q(default)} END"
