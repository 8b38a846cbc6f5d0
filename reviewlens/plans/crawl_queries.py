"""Registered queries for crawl-page extraction (H1-H10) and their oracles. The test pages carry no
review-site markup, so the stand-in selectors take every ``<p>`` as a review block."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import crawl as cr
from ..sources import dictionaries as d
from ..session import scratch_path
from ..sources import tables
from . import sqlparts as S

SEL = cr.STAND_IN


def _pages(spark, sf):
    return tables.crawl_pages(spark, sf)


def _fields(spark, sf):
    return cr.extract_fields(cr.review_blocks(_pages(spark, sf), SEL), SEL)      # every page


def q_page_prefix(spark, sf):
    return cr.page_prefix(_pages(spark, sf), SEL).select("film_slug", "page_num", "n_blocks")


def q_review_blocks(spark, sf):
    b = cr.review_blocks(_pages(spark, sf), SEL)
    return b.select("film_slug", "page_num", "block_pos", F.length("block").alias("block_chars"))


def _field(name):
    def q(spark, sf):
        return _fields(spark, sf).select("film_slug", "page_num", "block_pos", name)
    return q


def q_film_union(spark, sf):
    pages = _pages(spark, sf)
    parts = [pages.where(F.col("film_slug").contains(".example.com")), pages.where(~F.col("film_slug").contains(".example.com"))]
    out = None
    for part in parts:   # H8: films scraped separately, concatenated
        r = cr.scrape(part, SEL)
        out = r if out is None else out.unionByName(r)
    return out.select("film_slug", "page_num", "block_pos", "review_text")


def q_crawl_report(spark, sf):
    return cr.crawl_report(_pages(spark, sf), SEL)


def q_html_parse(spark, sf):
    return cr.parse_pages_python(_pages(spark, sf), SEL)


def q_page_files(spark, sf):
    """The pages written as raw files in several character sets, read back as text: every third as UTF-16 with a mark, of the others those that
    latin-1 can hold in every second case as latin-1."""
    pages = tables.table(spark, sf, "pages").where(F.length("html") > 0)
    wide = F.concat(F.unhex(F.lit("FFFE")), F.encode("html", "UTF-16LE"))
    narrow = (F.col("page_id") % 2 == 0) & ~F.col("html").rlike("[^\\x{00}-\\x{7F}\\x{A0}-\\x{FF}]")
    content = F.when(F.col("page_id") % 3 == 0, wide).when(narrow, F.encode("html", "ISO-8859-1")).otherwise(F.encode("html", "UTF-8"))
    path = scratch_path(spark, "page_files")
    tables.write_page_files(pages.select(F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("host"), F.lit(200).alias("status"), "page_id", content.alias("content")), path)
    return tables.read_page_files(spark, path).select("host", "status", "page_id", F.length("html").alias("n_chars"), F.md5(F.col("html").cast("binary")).alias("html_md5"))


def review_pages(spark, sf):
    """Pages in the review site's layout, one review each, made of the documents: rating, date and likes follow the id; the body holds a nested list of items
    and a spoiler notice; every seventh block is left open."""
    d_ = tables.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    i = F.col("doc_id")
    word = F.regexp_replace(F.substring_index("text", " ", 3), "[^A-Za-z ]", "")
    rating_ = F.when(i % 12 == 11, "rating").otherwise(F.concat(F.lit("rating rated-"), (i % 12).cast("string")))
    date = F.when(i % 4 == 0, F.concat(F.lit("<span class='x'></span><span class=\"_nobr\">Day "), i.cast("string"), F.lit("</span>"))) \
        .when(i % 4 == 1, F.concat(F.lit("<time>Time "), i.cast("string"), F.lit("</time>"))).otherwise("")
    likes = F.when(i % 5 == 0, "").when(i % 5 == 1, '<p class="like-link-target">Like</p>') \
        .otherwise(F.concat(F.lit('<p class="like-link-target">'), F.format_number(i * 37, 0), F.lit(" likes</p>")))
    body = F.concat(F.lit('<div class="body-text"><p class="contains-spoilers-warning">spoilers</p><p>'), word, F.lit("</p><p>b</p></div><ul><li>one</li><li>two</ul>"))
    html = F.concat(F.lit('<ul><li class="film-detail"><span class="'), rating_, F.lit('"></span>'), date, body, likes, F.when(i % 7 == 0, "").otherwise("</li>"), F.lit("</ul>"))
    return d_.select(F.concat(F.lit("film-"), i.cast("string")).alias("film_slug"), F.lit(1).alias("page_num"), F.lit(200).alias("status"), html.alias("html"))


def q_review_fields(spark, sf):
    """H2 to H6 with values: nested blocks of the review site's layout."""
    return cr.extract_fields(cr.review_blocks(review_pages(spark, sf)))


QUERIES = {
    "page_files": q_page_files,
    "review_fields": q_review_fields,
    "page_prefix": q_page_prefix,
    "review_blocks": q_review_blocks,
    "rating_decode": _field("rating"),
    "review_text_extract": _field("review_text"),
    "date_extract": _field("date"),
    "likes_extract": _field("likes"),
    "film_union": q_film_union,
    "crawl_report": q_crawl_report,
    "html_parse": q_html_parse,
}

# ------------------------------------------------------------------------------------------------
# Oracle SQL
# ------------------------------------------------------------------------------------------------

P_RE = r"(?s)<p\b[^>]*>(.*?)</p>"


def _unescape(c: str) -> str:
    for ent, ch in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "''''"), ("&nbsp;", "chr(160)"), ("&amp;", "'&'")):
        c = f"replace({c}, '{ent}', {ch})"
    return c


def get_text(c: str, sep: str = "") -> str:
    return (f"array_to_string(list_filter(list_transform(string_split_regex({c}, '<[^>]*>'), "
            f"lambda n: {S.strip_ws(_unescape('n'))}), lambda n: length(n) > 0), '{sep}')")


def _cls(c: str) -> str:
    return f'class="(?:[^"]*\\s)?{c}(?:\\s[^"]*)?"'


SPAN_DATE = f"(?s)<span\\b[^>]*{_cls('_nobr')}[^>]*>(.*?)</span>"
TIME_DATE = r"(?s)<time\b[^>]*>(.*?)</time>"
LIKE = f"(?s)<(p|span)\\b[^>]*{_cls('like-link-target')}[^>]*>(.*?)</(?:p|span)>"
RATING_CLS = '<span\\b[^>]*class="((?:[^"]*\\s)?rating(?:\\s[^"]*)?)"'

CRAWL = f"""cp0 AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS film_slug, html FROM pages),
cp AS (SELECT film_slug, CAST(row_number() OVER (PARTITION BY film_slug ORDER BY page_id) AS INTEGER) AS page_num, html FROM cp0),
cps AS (SELECT film_slug, page_num, CASE WHEN length(coalesce(html, '')) > 0 THEN 200 ELSE 404 END AS status, html FROM cp),
pp AS (SELECT *, CAST(len(regexp_extract_all(coalesce(html, ''), '{P_RE}', 1)) AS INTEGER) AS n_blocks FROM cps),
pstop AS (SELECT film_slug, coalesce(min(page_num) FILTER (WHERE status <> 200 OR html IS NULL OR length(html) = 0 OR n_blocks = 0), max(page_num) + 1) AS stop
          FROM pp GROUP BY 1),
kept AS (SELECT pp.* FROM pp JOIN pstop USING (film_slug) WHERE page_num < stop),
blk AS (SELECT k.film_slug, k.page_num, CAST(u.i - 1 AS INTEGER) AS block_pos, u.b AS block
        FROM pp k, unnest(regexp_extract_all(k.html, '{P_RE}', 1)) WITH ORDINALITY AS u(b, i)),
fields AS (SELECT film_slug, page_num, block_pos,
   CASE WHEN length(regexp_extract(regexp_extract(block, '{RATING_CLS}', 1), '(?:^|\\s)rated-([0-9]+)', 1)) > 0
        THEN TRY_CAST(regexp_extract(regexp_extract(block, '{RATING_CLS}', 1), '(?:^|\\s)rated-([0-9]+)', 1) AS INTEGER) / CAST(2.0 AS DOUBLE) END AS rating,
   {S.strip_ws(get_text('block'))} AS review_text,
   CASE WHEN regexp_matches(block, '{SPAN_DATE}') THEN {get_text(f"regexp_extract(block, '{SPAN_DATE}', 1)")}
        WHEN regexp_matches(block, '{TIME_DATE}') THEN {get_text(f"regexp_extract(block, '{TIME_DATE}', 1)")} END AS date,
   CASE WHEN regexp_matches(block, '{LIKE}') THEN (CASE WHEN length(regexp_replace({get_text(f"regexp_extract(block, '{LIKE}', 2)")}, '[^0-9]', '', 'g')) = 0 THEN 0
        ELSE TRY_CAST(regexp_replace({get_text(f"regexp_extract(block, '{LIKE}', 2)")}, '[^0-9]', '', 'g') AS INTEGER) END) END AS likes
   FROM blk)"""

ORACLE = {
    "page_files": """SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, 200 AS status, page_id, CAST(length(html) AS INTEGER) AS n_chars, md5(html) AS html_md5
        FROM pages WHERE length(html) > 0""",
    # the fields follow the id, whatever the markup
    "review_fields": """SELECT 'film-' || doc_id AS film_slug, 1 AS page_num, 0 AS block_pos, CASE WHEN doc_id % 12 <> 11 THEN (doc_id % 12) / 2.0::DOUBLE END AS rating,
        trim(trim(regexp_replace(array_to_string(string_split(coalesce(text, ''), ' ')[1:3], ' '), '[^A-Za-z ]', '', 'g')) || ' b') AS review_text,
        CASE doc_id % 4 WHEN 0 THEN 'Day ' || doc_id WHEN 1 THEN 'Time ' || doc_id END AS date,
        CAST(CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE doc_id * 37 END AS INTEGER) AS likes FROM documents""",
    "page_prefix": f"WITH {CRAWL} SELECT film_slug, page_num, n_blocks FROM kept",
    "review_blocks": f"WITH {CRAWL} SELECT film_slug, page_num, block_pos, length(block) AS block_chars FROM blk",
    "rating_decode": f"WITH {CRAWL} SELECT film_slug, page_num, block_pos, rating FROM fields",
    "review_text_extract": f"WITH {CRAWL} SELECT film_slug, page_num, block_pos, review_text FROM fields",
    "date_extract": f"WITH {CRAWL} SELECT film_slug, page_num, block_pos, date FROM fields",
    "likes_extract": f"WITH {CRAWL} SELECT film_slug, page_num, block_pos, likes FROM fields",
    "film_union": f"WITH {CRAWL} SELECT film_slug, page_num, block_pos, review_text FROM fields JOIN kept USING (film_slug, page_num) WHERE length(review_text) > 0",
    "crawl_report": f"""WITH {CRAWL}, pr AS (SELECT film_slug, page_num, count(*) AS n_reviews FROM fields WHERE length(review_text) > 0 GROUP BY ALL),
        x AS (SELECT k.film_slug, k.page_num, k.n_blocks, coalesce(pr.n_reviews, 0) AS n_reviews FROM kept k LEFT JOIN pr USING (film_slug, page_num))
        SELECT film_slug, page_num, n_blocks, n_reviews,
               CAST(sum(n_reviews) OVER (PARTITION BY film_slug ORDER BY page_num) AS BIGINT) AS running_reviews FROM x""",
}
