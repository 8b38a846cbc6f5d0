from reviewlens.operators import crawl as cr


def block(text="<p>ok text</p>", cls="rating rated-8", likes="1,234 likes", date='<span class="_nobr">Jan 1</span>'):
    return (f'<li class="film-detail"><span class="{cls}"></span>{date}'
            f'<div class="body-text">{text}</div><p class="like-link-target">{likes}</p></li>')


def test_page_prefix(spark):
    two = "<ul>" + block() + block() + "</ul>"
    rows = [("a", 1, 200, two), ("a", 2, 200, "<ul>" + block(text="<p> </p>") + "</ul>"), ("a", 3, 404, ""),
            ("a", 4, 200, two), ("b", 1, 200, "<p>no blocks</p>"), ("c", 1, 200, two), ("c", 3, 200, two)] + \
           [("d", i, 200, two) for i in range(1, 42)]
    pages = spark.createDataFrame(rows, "film_slug string, page_num int, status int, html string")
    kept = {(r["film_slug"], r["page_num"]) for r in cr.page_prefix(pages).collect()}
    assert {p for s, p in kept if s == "a"} == {1, 2}
    assert not any(s == "b" for s, _ in kept)
    assert {p for s, p in kept if s == "c"} == {1}
    assert {p for s, p in kept if s == "d"} == set(range(1, 42))       # no bound unless asked for
    bounded = {r["page_num"] for r in cr.page_prefix(pages, max_pages=40).where("film_slug = 'd'").collect()}
    assert bounded == set(range(1, 41))
    scraped = cr.scrape(pages).where("film_slug = 'a'").collect()
    assert len(scraped) == 2                                   # page 2's empty review dropped


def test_fields(spark):
    html = "<ul>" + block(text='<p class="contains-spoilers-warning">spoilers</p><p>great <i>film</i> here</p><p>b</p>') + \
        block(cls="rating", likes="Like", date="<time>2024</time>") + \
        '<li class="film-detail"><span class="rating rated-x"></span><div class="body-text"><p>t</p></div></li></ul>'
    pages = spark.createDataFrame([("s", 1, 200, html)], "film_slug string, page_num int, status int, html string")
    f = sorted(cr.extract_fields(cr.review_blocks(pages)).collect(), key=lambda r: r["block_pos"])
    assert (f[0]["rating"], f[0]["likes"], f[0]["date"], f[0]["review_text"]) == (4.0, 1234, "Jan 1", "greatfilmhere b")
    assert (f[1]["rating"], f[1]["likes"], f[1]["date"]) == (None, 0, "2024")
    assert (f[2]["rating"], f[2]["likes"], f[2]["date"]) == (None, None, None)
    sep = cr.Selectors(inline_separator=" ")
    g = sorted(cr.extract_fields(cr.review_blocks(pages, sep), sep).collect(), key=lambda r: r["block_pos"])
    assert g[0]["review_text"] == "great film here b"
    # H10 agrees with the regex path on clean pages
    py = sorted(cr.parse_pages_python(pages).collect(), key=lambda r: r["block_pos"])
    assert [(r["rating"], r["review_text"], r["date"], r["likes"]) for r in py] == \
        [(r["rating"], r["review_text"], r["date"], r["likes"]) for r in f]


def test_every_page_is_kept(spark):
    from reviewlens.sources import tables

    sf = "/root/testdata/sf0.01"
    p = tables.crawl_pages(spark, sf)
    n = spark.read.parquet(f"{sf}/pages.parquet").count()
    assert p.select("film_slug", "page_num").distinct().count() == n == 250


def test_running_sum_cuts_large_groups(spark):
    from pyspark.sql import functions as F

    from reviewlens.operators.ids import running_sum

    rows = [("a", i * 3, i % 5) for i in range(200)] + [(None, 7, 2), ("b", 0, 9)]
    got = running_sum(spark.createDataFrame(rows, "g string, o long, v long"), "g", "o", F.col("v"), "s", span=50).collect()
    total = {}
    for r in sorted(got, key=lambda r: (r["g"] or "", r["o"])):
        total[r["g"]] = total.get(r["g"], 0) + r["v"]
        assert r["s"] == total[r["g"]]
    assert len(got) == 202


def test_write_scraped(spark, tmp_path):
    import pytest

    row = [("s", 1.0, 'a "quoted" text', "d", 1)]
    df = spark.createDataFrame(row, "film_slug string, rating double, review_text string, date string, likes int")
    assert cr.write_scraped(df, str(tmp_path / "csv"), "csv") == 1
    with pytest.warns(UserWarning):
        assert cr.write_scraped(df.where("1 = 0"), str(tmp_path / "none")) == 0


NESTED = [
    ("closed", "<ul>" + block() + block() + "</ul>"),
    ("inner list", "<ul>" + block(text="<p>a</p><ul><li>x</li><li class='film-detail'>y</li></ul><p>b</p>") + block() + "</ul>"),
    ("inner block", "<ul>" + block(text="<p>a</p><ul>" + block(text="<p>in</p>") + "</ul>") + "</ul>"),
    ("items left open", '<ul><li class="film-detail"><div class="body-text"><p>one</p></div><li class="film-detail"><div class="body-text"><p>two</p></div></ul><p>after</p>'),
    ("inner items left open", "<ul>" + block(text="<p>a</p><ol><li>x<li>y</ol>") + block() + "</ul>"),
    ("page ends", '<UL><LI CLASS="film-detail"><div class="body-text"><p>cut off</p></div>'),
    ("stray ends", "</li></ul><ul></li>" + block() + "</li></ul>"),
    ("other items", "<ul><li>no</li>" + block() + "<li class='x film-detailed'>no</li></ul>"),
    ("none", "<p>nothing</p>"), ("empty", ""), ("null", None),
]


def test_nested_and_open_blocks_agree_with_the_parser(spark):
    from pyspark.sql import functions as F

    from reviewlens.functions import html as hx

    pages = spark.createDataFrame([(n, 1, 200, h) for n, h in NESTED], "film_slug string, page_num int, status int, html string")
    ours = {}
    for r in cr.extract_fields(cr.review_blocks(pages)).collect():
        ours.setdefault(r["film_slug"], []).append((r["block_pos"], r["review_text"]))
    parser = {}
    for r in cr.parse_pages_python(pages).collect():
        parser.setdefault(r["film_slug"], []).append((r["block_pos"], r["review_text"]))
    sizes = {n: len(ours.get(n, [])) for n, _ in NESTED}
    assert sizes == {n: len(parser.get(n, [])) for n, _ in NESTED}
    assert sizes == {"closed": 2, "inner list": 2, "inner block": 1, "items left open": 2, "inner items left open": 2, "page ends": 1, "stray ends": 1, "other items": 1,
                     "none": 0, "empty": 0, "null": 0}
    for n in ("closed", "items left open", "page ends", "stray ends", "other items"):
        assert sorted(ours[n]) == sorted(parser[n]), n
    divs = spark.createDataFrame([("x<div>a<div>b</div>c</div>d<div class='k'>e</div>",), ("<div>open <div>deep</div>",), (None,)], "h string")
    assert [r[0] for r in divs.select(hx.nested_blocks(F.col("h"), "div", None)).collect()] == [["a<div>b</div>c", "e"], ["open <div>deep</div>"], None]


def test_page_files_in_many_character_sets(spark, tmp_path):
    from pyspark.sql import functions as F

    from reviewlens.sources import tables

    texts = {1: ("prix 5 € – été", "utf-8"), 2: ("plain", "ascii"), 3: ("mark ü", "utf-8-sig"), 4: ("wide ü 中 🙂", "utf-16"), 5: ("old “quotes” € é", "cp1252"),
             6: ('<meta charset="iso-8859-1">é', "latin-1"), 7: ("", "utf-8"), 8: ("big ü 中", "utf-16-be"), 9: ('<META http-equiv="x" content="text/html; charset=windows-1252">Ã©', "cp1252")}
    rows = [(i, b"\xfe\xff" + t.encode(c) if c == "utf-16-be" else t.encode(c)) for i, (t, c) in texts.items()]
    df = spark.createDataFrame(rows, "page_id long, content binary").select(F.lit("h:80 a+b").alias("host"), F.lit(200).alias("status"), "page_id", "content")
    tables.write_page_files(df, str(tmp_path / "p"))
    got = tables.read_page_files(spark, str(tmp_path / "p")).collect()
    assert {r["page_id"]: r["html"] for r in got} == {i: t for i, (t, _) in texts.items()}
    assert {(r["host"], r["status"]) for r in got} == {("h:80 a+b", 200)}
