"""Query of conversation structure repair (11) and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import auction_repair
from ..sources import tables


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = tables.table(spark, sf_dir, "conversations")
    return auction_repair.report(conversations, auction_repair.damage(conversations))


_SPACE = r"\x20\x09-\x0D"
_BITS = "list_reduce(list_concat([xor(c, CAST(b AS BIGINT))], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
_CRC = f"xor(list_reduce(list_concat([4294967295], list_transform(range(length(k)), lambda i: CAST(ascii(substr(k, CAST(i + 1 AS BIGINT), 1)) AS BIGINT))), lambda c, b: {_BITS}), 4294967295)"
# state, its next turn's state, and the states behind one and two insertions
_NEXT = "CASE WHEN {0} = 2 THEN 3 ELSE 2 END"
REPAIR_SQL = f"""WITH RECURSIVE keyed AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
    dealt AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS h FROM keyed),
    damaged AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
                       CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                       unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM dealt WHERE h <> 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
    o AS (SELECT conv_id, turn, role, text, i, left(role, 1) AS r,
                 CASE WHEN NOT regexp_matches(text, '[^{_SPACE}]') THEN 'blank'
                      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                      WHEN NOT regexp_matches(text, '[.!?][{_SPACE}]*$') THEN 'truncated' ELSE '' END AS fault,
                 coalesce(lag(left(role, 1)) OVER conv || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS bad
          FROM placed WINDOW conv AS (PARTITION BY conv_id ORDER BY i)),
    stats AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
                     count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
                     count(*) FILTER (WHERE bad) AS illegal, max(i) AS n FROM o GROUP BY conv_id),
    s0 AS (SELECT unnest(range(4)) AS s),
    s1 AS (SELECT s, 0 AS inserted, s AS m FROM s0 UNION ALL SELECT s, 1, {_NEXT.format('s')} FROM s0 UNION ALL SELECT s, 2, {_NEXT.format(_NEXT.format('s'))} FROM s0),
    moves AS (SELECT s, repeat('I', inserted) || op AS label, 2 * inserted + c AS c, op, need, CASE op WHEN 'D' THEN m WHEN 'K' THEN t ELSE {_NEXT.format('m')} END AS t
              FROM s1, (VALUES ('D', 3, NULL, NULL, NULL), ('R', 2, NULL, NULL, NULL), ('K', 0, 's', [0], 1), ('K', 0, 'u', [0, 1, 3], 2), ('K', 0, 'a', [2], 3)) e(op, c, need, froms, t)
              WHERE froms IS NULL OR list_contains(froms, m)),
    dp AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS s, {{'c': CAST(0 AS BIGINT), 'a': ''}} AS b FROM stats
           UNION ALL
           SELECT d.conv_id, d.i + 1, CAST(v.t AS BIGINT), min({{'c': CAST(d.b.c + v.c + CASE WHEN o.fault = 'truncated' AND v.op <> 'D' THEN 1 ELSE 0 END AS BIGINT), 'a': d.b.a || v.label}})
           FROM dp d JOIN o ON o.conv_id IS NOT DISTINCT FROM d.conv_id AND o.i = d.i + 1
             JOIN moves v ON v.s = d.s AND (v.need IS NULL OR v.need = o.r) AND (v.op = 'D' OR o.fault NOT IN ('blank', 'duplicate')) GROUP BY d.conv_id, d.i, v.t),
    best AS (SELECT d.conv_id, min({{'c': d.b.c + CASE d.s WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END, 'a': d.b.a || CASE d.s WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END}}) AS b
             FROM dp d JOIN stats n ON n.conv_id IS NOT DISTINCT FROM d.conv_id AND n.n = d.i GROUP BY d.conv_id),
    walk AS (SELECT conv_id, b.a AS a, 0 AS k, CAST(0 AS BIGINT) AS i, 0 AS s, CAST([] AS VARCHAR[]) AS lines FROM best
             UNION ALL
             SELECT w.conv_id, w.a, w.k + 1, CASE WHEN substr(w.a, w.k + 1, 1) = 'I' THEN w.i ELSE w.i + 1 END,
                    CASE substr(w.a, w.k + 1, 1) WHEN 'D' THEN w.s WHEN 'K' THEN CASE o.r WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE {_NEXT.format('w.s')} END,
                    CASE substr(w.a, w.k + 1, 1) WHEN 'D' THEN w.lines WHEN 'K' THEN list_append(w.lines, o.role || ':' || o.text)
                         ELSE list_append(w.lines, CASE WHEN w.s = 2 THEN 'assistant:' ELSE 'user:' END || CASE WHEN substr(w.a, w.k + 1, 1) = 'I' THEN '' ELSE o.text END) END
             FROM walk w LEFT JOIN o ON o.conv_id IS NOT DISTINCT FROM w.conv_id AND o.i = w.i + 1 WHERE w.k < length(w.a)),
    fixed AS (SELECT conv_id, a, sha256(array_to_string(lines, chr(10))) AS h FROM walk WHERE k = length(a))
    SELECT c.conv_id, coalesce(n.gaps, 0) AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate, coalesce(n.truncated, 0) AS truncated,
           coalesce(n.illegal, 0) AS illegal, coalesce(b.b.c, 0) AS cost, coalesce(f.a, '') AS audit, coalesce(f.h, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN stats n ON n.conv_id IS NOT DISTINCT FROM c.conv_id
      LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN fixed f ON f.conv_id IS NOT DISTINCT FROM c.conv_id"""

QUERIES = {"op11_conversation_repair": op11_conversation_repair}
ORACLE = {"op11_conversation_repair": REPAIR_SQL}
