"""Crawl-page extraction as one job over a table of fetched pages.

Pages: (film_slug, page_num, status, html). The original fetches pages from 1 on and stops at the first
failed or block-less page; here the same prefix is chosen per film by aggregates over (film, page), then blocks
are exploded and fields extracted with column expressions.
"""

from __future__ import annotations

import sys
import warnings
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import html as hx
from .ids import running_sum
from .text import materialize

# the parser below runs in Python workers, which need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Selectors:
    """Where the fields live. Defaults are the review-site layout; the test data uses ``STAND_IN``."""
    block_tag: str = "li"
    block_cls: str | None = "film-detail"
    body_tag: str | None = "div"
    body_cls: str | None = "body-text"
    inline_separator: str = ""
    nested: bool = True        # blocks may hold elements of their own kind, or be left open


# paragraphs do not nest
STAND_IN = Selectors(block_tag="p", block_cls=None, body_tag=None, body_cls=None, nested=False)


def blocks_of(html, sel: Selectors) -> F.Column:
    """The contents of a page's review blocks."""
    return (hx.nested_blocks if sel.nested else hx.blocks)(html, sel.block_tag, sel.block_cls)


def page_prefix(pages: DataFrame, sel: Selectors = Selectors(), max_pages: int | None = None) -> DataFrame:
    """H1: the pages a sequential crawl would have used: from 1 up to but not including the first page that failed
    (status != 200, empty) or had no block, or the first missing page number; at most ``max_pages`` if given. Adds
    ``n_blocks``."""
    p = pages.where(F.col("page_num") >= 1)
    if max_pages is not None:
        p = p.where(F.col("page_num") <= max_pages)
    p = p.withColumn("n_blocks", F.size(blocks_of(F.coalesce("html", F.lit("")), sel)))
    bad = (F.col("status") != 200) | F.col("html").isNull() | (F.length("html") == 0) | (F.col("n_blocks") == 0)
    seen = materialize(p.select("film_slug", "page_num", bad.alias("bad")), "pages_seen")    # narrow; the html is read again
    follows = seen.select("film_slug", (F.col("page_num") - 1).alias("page_num")).distinct()
    last = seen.join(follows, ["film_slug", "page_num"], "left_anti").groupBy("film_slug").agg((F.min("page_num") + 1).alias("_gap"))
    stop = seen.groupBy("film_slug").agg(F.min("page_num").alias("_first"), F.min(F.when(F.col("bad"), F.col("page_num"))).alias("_bad")) \
        .join(last, "film_slug").select("film_slug", F.when(F.col("_first") > 1, F.lit(1)).otherwise(F.least("_gap", "_bad")).alias("_stop"))
    kept = seen.join(stop, "film_slug").where(F.col("page_num") < F.col("_stop")).select("film_slug", "page_num")
    return p.join(kept, ["film_slug", "page_num"], "left_semi")      # by page: a film with many pages is not one key for the html


def review_blocks(pages: DataFrame, sel: Selectors = Selectors()) -> DataFrame:
    """H2: one row per review block: (film_slug, page_num, block_pos, block)."""
    return pages.select("film_slug", "page_num",
                        F.posexplode(blocks_of(F.col("html"), sel)).alias("block_pos", "block"))


def extract_fields(blocks: DataFrame, sel: Selectors = Selectors()) -> DataFrame:
    """H3-H6: rating, review_text, date, likes per block."""
    b = F.col("block")
    return blocks.select("film_slug", "page_num", "block_pos",
                         hx.rating(b).alias("rating"),
                         hx.review_text(b, sel.body_tag, sel.body_cls, sep=sel.inline_separator).alias("review_text"),
                         hx.date_text(b).alias("date"), hx.likes(b).alias("likes"))


def scrape(pages: DataFrame, sel: Selectors = Selectors(), max_pages: int | None = None) -> DataFrame:
    """H1-H7: scraped reviews (film_slug, page_num, block_pos, rating, review_text, date, likes);
    blocks with empty text are dropped."""
    f = extract_fields(review_blocks(page_prefix(pages, sel, max_pages), sel), sel)
    return f.where(F.length("review_text") > 0)


def crawl_report(pages: DataFrame, sel: Selectors = Selectors(), max_pages: int | None = None) -> DataFrame:
    """H9: per film and page: blocks found, reviews kept, running total of kept reviews per film."""
    kept = page_prefix(pages, sel, max_pages)
    # counted inside the row: no block leaves its page
    texts = F.transform(blocks_of(F.col("html"), sel), lambda b: hx.review_text(b, sel.body_tag, sel.body_cls, sep=sel.inline_separator))
    x = kept.select("film_slug", "page_num", "n_blocks", F.size(F.filter(texts, lambda t: F.length(t) > 0)).cast("long").alias("n_reviews"))
    return running_sum(materialize(x, "crawl_report"), "film_slug", "page_num", F.col("n_reviews"), "running_reviews")


def write_scraped(df: DataFrame, path: str, fmt: str = "parquet") -> int:
    """K1: fixed column order; returns the rows written, with a warning when there are none."""
    out = df.select("film_slug", "rating", "review_text", "date", "likes")
    seen = Observation("scraped")
    w = out.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite")
    (w.option("header", True).option("escape", '"').csv(path) if fmt == "csv" else w.parquet(path))
    n = int(seen.get["n"])
    if not n:
        warnings.warn(f"no reviews: an empty table was written to {path}", stacklevel=2)
    return n


# ---------------------------------------------------------------------------------------------
# Real tag soup, parsed by the standard-library HTML parser in Python workers
# ---------------------------------------------------------------------------------------------

def _parse_page(html: str, sel: Selectors):
    """Blocks and fields of one page with html.parser (nesting-aware, tolerant of unclosed tags)."""
    from html.parser import HTMLParser

    class P(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.stack = []      # open elements: (tag, classes)
            self.blocks = []     # per block: dict of collected parts
            self.cur = None
            self.depth = None

        def handle_starttag(self, tag, attrs):
            cls = (dict(attrs).get("class") or "").split()
            if tag in ("br", "img", "meta", "link", "input", "hr"):
                return
            if tag == "p" and self.stack and any(t == "p" for t, _ in self.stack):
                self.handle_endtag("p")   # a new paragraph closes an open one
            if tag == "li":               # a new item closes an open one of the same list
                lists = [t for t, _ in self.stack if t in ("ul", "ol", "li")]
                if lists and lists[-1] == "li":
                    self.handle_endtag("li")
            self.stack.append((tag, cls))
            if self.cur is None and tag == sel.block_tag and (sel.block_cls is None or sel.block_cls in cls):
                self.cur = {"paras": [], "rating": None, "date": None, "likes": None, "_p": None, "_f": None}
                self.depth = len(self.stack)
                self.blocks.append(self.cur)
            elif self.cur is not None:
                in_body = sel.body_tag is None or any(t == sel.body_tag and (sel.body_cls is None or sel.body_cls in c)
                                                      for t, c in self.stack[self.depth:])
                if tag == "span" and "rating" in cls and self.cur["rating"] is None:
                    for c in cls:
                        if c.startswith("rated-") and c[6:].split("-")[0].isdigit():
                            import re
                            self.cur["rating"] = int(re.match(r"rated-(\d+)", c).group(1)) / 2.0
                            break
                if tag == "p":
                    if in_body and sel.body_tag is not None and "contains-spoilers-warning" not in cls:
                        self.cur["_p"] = []
                        self.cur["paras"].append(self.cur["_p"])
                    else:
                        self.cur["_p"] = None
                if tag == "span" and "_nobr" in cls and self.cur["date"] is None:
                    self.cur["_f"] = ("date", len(self.stack), [])
                elif tag == "time" and self.cur["date"] is None and self.cur["_f"] is None:
                    self.cur["_f"] = ("date_time", len(self.stack), [])
                if tag in ("p", "span") and "like-link-target" in cls and self.cur["likes"] is None:
                    self.cur["_f"] = ("likes", len(self.stack), [])

        def handle_endtag(self, tag):
            if tag == "p" and self.cur is not None:
                self.cur["_p"] = None
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == tag:
                    del self.stack[i:]
                    break
            if self.cur is not None:
                f = self.cur["_f"]
                if f is not None and len(self.stack) < f[1]:
                    txt = "".join(f[2])
                    if f[0] in ("date", "date_time"):
                        self.cur["date"] = txt
                    else:
                        digits = "".join(ch for ch in txt if ch.isdigit())
                        self.cur["likes"] = int(digits) if digits else 0
                    self.cur["_f"] = None
                if self.depth is not None and len(self.stack) < self.depth:
                    self.cur, self.depth = None, None

        def handle_data(self, data):
            if self.cur is None:
                return
            s = data.strip()
            if not s:
                return
            if sel.body_tag is None:
                self.cur["paras"].append([s]) if not self.cur["paras"] else self.cur["paras"][0].append(s)
            elif self.cur["_p"] is not None and any(t == "p" for t, _ in self.stack[self.depth:]):
                self.cur["_p"].append(s)
            if self.cur["_f"] is not None:
                self.cur["_f"][2].append(s)

    p = P()
    p.feed(html or "")
    p.close()
    out = []
    for i, b in enumerate(p.blocks):
        text = " ".join(sel.inline_separator.join(x) for x in b["paras"]).strip()
        out.append((i, b["rating"], text, b["date"], b["likes"]))
    return out


def parse_pages_python(pages: DataFrame, sel: Selectors = Selectors()) -> DataFrame:
    """Same output as ``extract_fields(review_blocks(..))`` but parsed by html.parser per page in
    Arrow batches; use when the markup is not flat enough for the regex path."""
    schema = "film_slug string, page_num int, block_pos int, rating double, review_text string, date string, likes int"

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for slug, num, html in zip(b["film_slug"], b["page_num"], b["html"]):
                for pos, rating, text, date, lk in _parse_page(html, sel):
                    rows.append((slug, int(num), pos, rating, text, date, lk))
            yield pd.DataFrame(rows, columns=["film_slug", "page_num", "block_pos", "rating", "review_text", "date", "likes"])

    return pages.select("film_slug", "page_num", "html").mapInPandas(run, schema)
