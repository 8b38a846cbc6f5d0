"""Readers for the input tables (S1-S5, S7) with explicit schemas.

The test data has no movie reviews; these stand-ins are used (see FIXTURES.md):
``documents LEFT JOIN labels`` = raw reviews (quality 1/0 = positive/negative), ``pages`` = crawl pages,
``embeddings`` = precomputed sentence embeddings.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS = {
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
    "benchmark": "item_id BIGINT, text STRING",
}

RAW_REVIEW_SCHEMA = T.StructType([
    T.StructField("review", T.StringType()),
    T.StructField("sentiment", T.StringType()),
])
SCRAPED_SCHEMA = "film_slug STRING, rating DOUBLE, review_text STRING, date STRING, likes INT"
CRAWL_PAGE_SCHEMA = "film_slug STRING, page_num INT, status INT, html STRING"
REQUEST_SCHEMA = "review_id BIGINT, review_text STRING"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = SCHEMAS.get(name)
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def quality_label(c) -> F.Column:
    return F.when(c == 1, F.lit("positive")).when(c == 0, F.lit("negative"))


def raw_reviews(spark: SparkSession, sf_dir: str, extra=()) -> DataFrame:
    """S1 stand-in: (doc_id, review, *extra, sentiment). Unlabelled documents keep a null sentiment."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("review"), *extra)
    labels = table(spark, sf_dir, "labels").select("doc_id", quality_label(F.col("quality")).alias("sentiment"))
    return docs.join(labels, "doc_id", "left")


def raw_reviews_csv(spark: SparkSession, path: str) -> DataFrame:
    """S1 for the original CSV layout (``review,sentiment`` with quoted multi-line texts)."""
    return (spark.read.schema(RAW_REVIEW_SCHEMA).option("header", True).option("multiLine", True)
            .option("escape", '"').csv(path))


def crawl_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5 stand-in: the URL's host is the film slug, and a film's pages are numbered from 1 by page_id, so every page
    is kept. Status 200 when the html is non-empty, else 404. ``page_id`` is unique; only hosts and ids are numbered, and the html joins last."""
    from ..operators.ids import running_sum

    pages = table(spark, sf_dir, "pages").select(
        F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("film_slug"), "page_id", "html")
    numbers = running_sum(pages.select("film_slug", "page_id"), "film_slug", "page_id", F.lit(1), "page_num").select("page_id", "page_num")
    p = pages.join(numbers, "page_id")
    return p.select("film_slug", F.col("page_num").cast("int").alias("page_num"),
                    F.when(F.length(F.coalesce("html", F.lit(""))) > 0, F.lit(200)).otherwise(F.lit(404)).alias("status"),
                    "html")


# windows-1252 where it differs from latin-1: the characters at bytes 0x80 to 0x9F that are assigned (fixed values)
_CP1252 = {0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…", 0x86: "†", 0x87: "‡", 0x88: "ˆ", 0x89: "‰", 0x8A: "Š", 0x8B: "‹", 0x8C: "Œ", 0x8E: "Ž",
           0x91: "‘", 0x92: "’", 0x93: "“", 0x94: "”", 0x95: "•", 0x96: "–", 0x97: "—", 0x98: "˜", 0x99: "™", 0x9A: "š", 0x9B: "›", 0x9C: "œ", 0x9E: "ž", 0x9F: "Ÿ"}


def decode_page(content) -> Column:
    """The text of a page's bytes. A byte-order mark decides; else UTF-8 if the bytes are valid UTF-8 and no other character set is declared in the first 1,024
    bytes; else windows-1252, which is also what pages declare as latin-1. Bytes that windows-1252 leaves open stay control characters."""
    mark = F.hex(F.substring(content, 1, 3))
    latin = F.decode(content, "ISO-8859-1")
    declared = F.lower(F.regexp_extract(F.substring(latin, 1, 1024), r"""(?i)<meta[^>]{0,200}charset=["']?([A-Za-z0-9_-]+)""", 1))
    as_utf8 = content.cast("string")
    single = F.translate(latin, "".join(map(chr, _CP1252)), "".join(_CP1252.values()))
    rest = F.octet_length(content)
    return F.when(mark == "EFBBBF", F.make_valid_utf8(F.substring(content, 4, rest).cast("string"))) \
        .when(mark.startswith("FFFE"), F.decode(F.substring(content, 3, rest), "UTF-16LE")) \
        .when(mark.startswith("FEFF"), F.decode(F.substring(content, 3, rest), "UTF-16BE")) \
        .when(F.is_valid_utf8(as_utf8) & ((declared == "") | declared.isin("utf-8", "utf8", "us-ascii", "ascii")), as_utf8) \
        .otherwise(single)


def write_page_files(pages: DataFrame, path: str) -> None:
    """Raw pages (host, status, page_id, content) as files ``host=/status=/page_id=/part``, each ended by a line feed (Spark's row end)."""
    pages.select("host", "status", "page_id", F.col("content").cast("string").alias("value")) \
        .write.partitionBy("host", "status", "page_id").text(path)


def read_page_files(spark: SparkSession, path: str, final_newline: bool = True) -> DataFrame:
    """S5 for raw files: (host, status, page_id, html) of every file under ``host=/status=/page_id=`` folders. ``final_newline``: the last byte is the line
    feed that ``write_page_files`` adds."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    part = lambda name: F.url_decode(F.replace(F.regexp_extract("path", f"/{name}=([^/]*)/", 1), F.lit("+"), F.lit("%2B")))
    content = F.substring("content", F.lit(1), F.octet_length("content") - 1) if final_newline else F.col("content")
    return files.select(part("host").alias("host"), part("status").cast("int").alias("status"), part("page_id").cast("long").alias("page_id"),
                        decode_page(content).alias("html"))


def parse_requests(lines: DataFrame, col: str = "value") -> DataFrame:
    """JSON lines -> (review_id, review_text, malformed). ``malformed`` is the whole line where it is no object of the request's fields and types, and
    the other two are then null; blank lines are no requests. Works on streams."""
    parsed = F.from_json(F.col(col), REQUEST_SCHEMA + ", _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    x = lines.where(F.length(F.trim(F.col(col))) > 0).select(F.col(col).alias("line"), parsed.alias("r"))
    bad = F.col("r._bad").isNotNull() | F.col("r").isNull() | ~F.trim("line").startswith("{")
    return x.select(*[F.when(~bad, F.col(f"r.{c}")).alias(c) for c in ("review_id", "review_text")], F.when(bad, F.col("line")).alias("malformed"))


def read_requests_json(spark: SparkSession, path: str) -> DataFrame:
    """S7 in batch: the requests of JSON-lines files, with their malformed lines."""
    return parse_requests(spark.read.text(path))


def read_final_table(spark: SparkSession, path: str) -> DataFrame:
    """The final aspect table; a clear message when the topic job has not been run."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise FileNotFoundError(
                f"aspect table not found at {path}: write it with sources.io.write_parquet(..., partition_by='aspect') first"
            ) from e
        raise
