"""Query of the secret scan (7) and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import secret_ledger as sl
from .common import documents, stage_path


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    ledger = sl.Ledger(spark, stage_path(spark, "secret-ledger"))
    spans = sl.spans_by_path(docs, ledger.scan(docs))
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in sl.BASE_RULES]))
    count = [F.size(F.array_remove(F.transform("spans", lambda s: s["kind"] == F.lit(k)), False)).cast("long").alias(f"n_{k}")
             for k in ("assign", "access", "hex")]
    return spans.select("doc_id", *count, F.sha2(sl.joined(base).cast("binary"), 256).alias("base_sha256"), sl.joined("spans").alias("spans"))


def _sql() -> str:
    """Per rule: the matches and the texts between them, numbered; running lengths give the places."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for i, r in enumerate(sl.RULES):
        group = "m" if r.group == 0 else f"regexp_extract(m, {q(r.pattern)}, {r.group})"
        parts.append(f"""SELECT k, {i} AS kind_no, '{r.kind}' AS kind, n, length(m) AS chars, length(b) AS before, length({group}) >= {r.min_chars} AS good
            FROM (SELECT k, unnest(found) AS m, unnest(between_[1:len(found)]) AS b, unnest(range(len(found))) AS n
                  FROM (SELECT k, regexp_extract_all(t, {q(r.pattern)}) AS found, string_split_regex(t, {q(r.pattern)}) AS between_
                        FROM d WHERE regexp_matches(t, {q(r.pattern)})))""")
    base = ", ".join(f"'{r.kind}'" for r in sl.BASE_RULES)
    one = "kind || ':' || s || ':' || e"
    return f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
    m AS ({' UNION ALL '.join(parts)}),
    p AS (SELECT *, CAST(sum(before + chars) OVER (PARTITION BY k, kind_no ORDER BY n) AS BIGINT) AS e FROM m),
    g AS (SELECT k, kind, kind_no, e - chars AS s, e FROM p WHERE good),
    a AS (SELECT k, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
                 count(*) FILTER (WHERE kind = 'hex') AS n_hex,
                 string_agg({one}, ',' ORDER BY s, kind_no) FILTER (WHERE kind IN ({base})) AS base, string_agg({one}, ',' ORDER BY s, kind_no) AS spans
          FROM g GROUP BY k)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (k)"""


QUERIES = {"op7_secret_scan": op7_secret_scan}
ORACLE = {"op7_secret_scan": _sql()}
