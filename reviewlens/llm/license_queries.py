"""Query of the license scan (3) and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import license_index as li
from .common import documents


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return li.scan(documents(spark, sf_dir))


def begin(t: li.Template, phrase: str) -> int:
    """The word of the template's text at which the phrase begins."""
    words, k = t.text.split(), phrase.split()
    return next(p for p in range(len(words)) if words[p:p + len(k)] == k)


def _sql(rare: int = 4, need: int = 2) -> str:
    """Words with places; IDF of the template words; places that agree on a template's beginning."""
    q = lambda s: "'" + s + "'"
    words = ", ".join(f"({i}, {p}, {q(w)})" for i, t in enumerate(li.TEMPLATES) for p, w in enumerate(t.text.split()))
    phrases = ", ".join(f"({i}, {begin(t, x)}, {len(x.split())}, {q(x)})"
                        for i, t in enumerate(li.TEMPLATES) for x in t.phrases)
    labels = ", ".join(f"({i}, {q(t.label)}, {len(t.phrases)})" for i, t in enumerate(li.TEMPLATES))
    base = ", ".join(f"({q(p)}, {q(label)}, {len(p.split())})" for p, label in li.BASE.items())
    at = lambda n: " || ' ' || ".join(f"coalesce(ws[i + {j}], '')" for j in range(n))
    lengths = sorted({len(p.split()) for p in li.BASE} | {len(x.split()) for t in li.TEMPLATES for x in t.phrases})
    grams = " UNION ALL ".join(f"SELECT k, i - 1 AS pos, {n} AS n, {at(n)} AS g FROM (SELECT k, ws, unnest(range(1, len(ws) + 1)) AS i FROM d WHERE likely)"
                               for n in lengths)
    letters = "".join(chr(c) for c in range(65, 91))
    likely = " OR ".join(f"contains(x, {q(' ' + p + ' ')})" for p in [*li.BASE, *dict.fromkeys(x for t in li.TEMPLATES for x in t.phrases)])
    return f"""WITH t0 AS (SELECT row_number() OVER () AS k, doc_id,
          regexp_extract_all(translate(coalesce(text, ''), '{letters}', '{letters.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
    d AS (SELECT *, {likely} AS likely FROM (SELECT *, ' ' || array_to_string(ws, ' ') || ' ' AS x FROM t0)),
    tw(template, place, w) AS (VALUES {words}), tp(template, place, n, g) AS (VALUES {phrases}), tl(template, label, n_phrases) AS (VALUES {labels}),
    bp(g, label, n) AS (VALUES {base}),
    df AS (SELECT w, count(*) AS c FROM (SELECT DISTINCT k, unnest(ws) AS w FROM d) WHERE w IN (SELECT w FROM tw) GROUP BY w),
    idf AS (SELECT DISTINCT tw.w, ln(((SELECT count(*) FROM d) + 1) / (coalesce(c, 0) + 1)::DOUBLE) + 1.0::DOUBLE AS idf FROM tw LEFT JOIN df ON tw.w = df.w),
    best AS (SELECT template, w, idf FROM (SELECT template, w, idf, row_number() OVER (PARTITION BY template ORDER BY idf DESC, w) AS r
             FROM (SELECT DISTINCT template, w FROM tw) JOIN idf USING (w)) WHERE r <= {rare}),
    total AS (SELECT template, sum(idf) AS total, least(count(*), {need}) AS need FROM best GROUP BY template),
    grams AS ({grams}),
    wp AS (SELECT k, i - 1 AS pos, ws[i] AS w FROM (SELECT k, ws, unnest(range(1, len(ws) + 1)) AS i FROM d WHERE likely)),
    hw AS (SELECT k, template, pos - tw.place AS b, sum(DISTINCT_IDF) AS weight, count(*) AS n FROM (
             SELECT DISTINCT k, tw.template, pos, tw.place, tw.w, best.idf AS DISTINCT_IDF FROM wp JOIN tw ON wp.w = tw.w JOIN best ON best.template = tw.template AND best.w = tw.w) AS tw GROUP BY ALL),
    hp AS (SELECT k, template, pos - tp.place AS b, count(DISTINCT tp.g) AS n FROM grams JOIN tp ON grams.n = tp.n AND grams.g = tp.g GROUP BY ALL),
    hit AS (SELECT hw.k, label, max(round(weight / total, 6)) AS score FROM hw JOIN hp USING (k, template, b) JOIN tl USING (template) JOIN total USING (template)
            WHERE hw.n >= need AND hp.n = n_phrases GROUP BY ALL),
    base AS (SELECT k, label, pos FROM grams JOIN bp ON grams.n = bp.n AND grams.g = bp.g),
    ba AS (SELECT k, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY k),
    la AS (SELECT k, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT k, label FROM base UNION SELECT k, label FROM hit) GROUP BY k),
    sc AS (SELECT k, max(score) AS score FROM hit GROUP BY k)
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
           coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
           CASE WHEN coalesce(n_base, 0) > 0 THEN 1.0 ELSE coalesce(score, 0) END::DOUBLE AS score
    FROM d LEFT JOIN ba USING (k) LEFT JOIN la USING (k) LEFT JOIN sc USING (k)"""


QUERIES = {"op3_license_scan": op3_license_scan}
ORACLE = {"op3_license_scan": _sql()}
