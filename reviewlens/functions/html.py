"""Column expressions for review pages (H2-H6). Blocks may be nested or left open (``nested_blocks``); other tag soup goes
through ``operators.crawl.parse_pages_python`` (H10)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx


def class_attr(cls: str) -> str:
    """Regex for a class attribute containing ``cls`` as a whole class token."""
    return rf'class="(?:[^"]*\s)?{cls}(?:\s[^"]*)?"'


def element(tag: str, cls: str | None = None) -> str:
    """(?s) regex for ``<tag class=cls ...>content</tag>``, content in group 1 (non-greedy)."""
    attrs = rf"[^>]*{class_attr(cls)}[^>]*" if cls else r"[^>]*"
    return rf"(?s)<{tag}\b{attrs}>(.*?)</{tag}>"


def unescape(c: Column) -> Column:
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(ent), F.lit(ch))
    return c


def get_text(c: Column, sep: str = "") -> Column:
    """Text of an HTML fragment: each text node unescaped and stripped, empty nodes dropped, joined by
    ``sep`` ('' = the strip=True behaviour of the original parser, which glues words around tags)."""
    nodes = F.split(c, r"<[^>]*>")
    nodes = F.filter(F.transform(nodes, lambda n: tx.strip_ws(unescape(n))), lambda n: F.length(n) > 0)
    return F.array_join(nodes, sep)


def blocks(html: Column, tag: str, cls: str | None) -> Column:
    return F.regexp_extract_all(html, F.lit(element(tag, cls)), 1)


def nested_blocks(html: Column, tag: str, cls: str | None) -> Column:
    """H2 for nested and unclosed elements: the content of every outermost ``<tag class=cls>``, from one fold over the page's start and end tags of this
    element (and of ul and ol for li). The fold keeps the open elements: an end tag closes the last element of its name and all that were
    opened in it, an li closes an open li of the same list, what is still open ends with the page. A block ends where its own element closes."""
    names = f"{tag}|ul|ol" if tag == "li" else tag
    event = rf"(?is)<(?:/(?:{names})\s*|(?:{names})(?:\s[^>]*)?)>"
    tags = F.regexp_extract_all(html, F.lit(event), F.lit(0))
    before = F.slice(F.split(html, event, -1), F.lit(1), F.size(tags))
    steps = F.zip_with(before, tags, lambda b, t: F.struct(F.length(b).alias("skip"), F.length(t).alias("chars"), t.startswith("</").alias("ends"),
                                                          F.lower(F.regexp_extract(t, r"^</?([A-Za-z0-9]+)", 1)).alias("name"),
                                                          (t.rlike(f"(?i){class_attr(cls)}") if cls else F.lit(True)).alias("wanted")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("open"), F.lit(-1).alias("begin"), F.lit(0).alias("base"),
                    F.array().cast("array<struct<begin:int,end:int>>").alias("out"))

    def step(acc, e):
        at, size = acc["at"] + e["skip"], F.size(acc["open"])
        last = F.try_element_at(acc["open"], F.when(size > 0, size))
        # how many elements stay open when this tag has closed what it closes
        same = F.array_position(F.reverse(acc["open"]), e["name"]).cast("int")
        stay = F.when(e["ends"], F.when(same > 0, size - same).otherwise(size)) \
            .otherwise(F.when((e["name"] == "li") & F.coalesce(last == "li", F.lit(False)), size - 1).otherwise(size))
        kept = F.slice(acc["open"], F.lit(1), stay)
        closes = (acc["begin"] >= 0) & (stay <= acc["base"])
        out = F.when(closes, F.array_append(acc["out"], F.struct(acc["begin"].alias("begin"), at.alias("end")))).otherwise(acc["out"])
        outside = (acc["begin"] < 0) | closes
        opens = ~e["ends"] & outside & (e["name"] == tag) & e["wanted"]
        end = at + e["chars"]
        return F.struct(end.alias("at"), F.when(e["ends"], kept).otherwise(F.array_append(kept, e["name"])).alias("open"),
                        F.when(opens, end).when(outside, F.lit(-1)).otherwise(acc["begin"]).alias("begin"),
                        F.when(opens, stay).otherwise(acc["base"]).alias("base"), out.alias("out"))

    found = F.aggregate(steps, zero, step, lambda acc: F.when(acc["begin"] >= 0, F.array_append(acc["out"], F.struct(
        acc["begin"].alias("begin"), F.length(html).alias("end")))).otherwise(acc["out"]))
    return F.transform(found, lambda b: F.substring(html, b["begin"] + 1, b["end"] - b["begin"]))


def rating(block: Column, span_cls: str = "rating") -> Column:
    """H3: first class token ``rated-N`` of the rating span -> N / 2.0; no span or no token -> null."""
    cls = F.regexp_extract(block, rf'<span\b[^>]*class="((?:[^"]*\s)?{span_cls}(?:\s[^"]*)?)"', 1)
    n = F.regexp_extract(cls, r"(?:^|\s)rated-([0-9]+)", 1)
    return F.when(F.length(n) > 0, n.try_cast("int") / 2.0)


def review_text(block: Column, body_tag: str | None = "div", body_cls: str | None = "body-text",
                spoiler_cls: str = "contains-spoilers-warning", sep: str = "") -> Column:
    """H4: body element -> drop spoiler-notice paragraphs -> text of each paragraph -> joined by one
    space and stripped. No body -> null. ``body_tag=None``: the block itself is one paragraph."""
    if body_tag is None:
        return tx.strip_ws(get_text(block, sep))
    body_re = rf"(?s)<{body_tag}\b[^>]*{class_attr(body_cls)}[^>]*>(.*)</{body_tag}>" if body_cls else \
        rf"(?s)<{body_tag}\b[^>]*>(.*)</{body_tag}>"
    present = F.regexp(block, F.lit(body_re))
    body = F.regexp_extract(block, body_re, 1)
    body = F.regexp_replace(body, rf"(?s)<p\b[^>]*{class_attr(spoiler_cls)}[^>]*>.*?</p>", "")
    paras = F.transform(F.regexp_extract_all(body, F.lit(r"(?s)<p\b[^>]*>(.*?)</p>"), 1), lambda p: get_text(p, sep))
    return F.when(present, tx.strip_ws(F.array_join(paras, " ")))


def date_text(block: Column) -> Column:
    """H5: text of ``span._nobr``, else of ``time``, else null."""
    span = element("span", "_nobr")
    tm = element("time")
    return (F.when(F.regexp(block, F.lit(span)), get_text(F.regexp_extract(block, span, 1))).when(
        F.regexp(block, F.lit(tm)), get_text(F.regexp_extract(block, tm, 1))))


def likes(block: Column) -> Column:
    """H6: digits of the like-count tag -> int; tag without digits -> 0; no tag -> null."""
    pat = rf"(?s)<(p|span)\b[^>]*{class_attr('like-link-target')}[^>]*>(.*?)</(?:p|span)>"
    digits = F.regexp_replace(get_text(F.regexp_extract(block, pat, 2)), r"[^0-9]", "")
    return F.when(F.regexp(block, F.lit(pat)), F.when(F.length(digits) == 0, F.lit(0)).otherwise(digits.try_cast("int")))
