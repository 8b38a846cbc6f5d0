"""WARC archives: a writer of response and revisit records, and a salvage reader.

The writer deduplicates payloads: of the rows with equal payloads of at least ``min_bytes`` bytes the smallest id is written as
a response, the others as revisits that refer to it. Archives are files of a bounded size, one gzip member a
record (or plain records), committed by Spark's own text writer, so any file system that Spark reaches will do and lost tasks are
written again.

The reader checks every record: gzip CRC and length, version line, mandatory fields, block length, closing line breaks, block
and payload digests. After a failed check it searches for the next member or version line that starts a valid record, goes on
there, and reports the bytes in between as a quarantined gap. Every byte of an archive lies in exactly one record or gap.
A damaged plain record whose payload itself quotes a whole valid record gives that quoted record.

Defined cases: a null or empty payload has 0 bytes; null ids come last among equal payloads, and if all ids of equal payloads are
null, all are responses; a row that repeats both id and payload of a response is a response again; a null URL leaves its field
out, white space and control characters in a URL are percent-encoded; an empty table gives archives without page records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship_by_value

ship_by_value(__name__)

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
FIELDS = ("warc-type", "warc-record-id", "warc-date", "content-length")
PIECE = 1 << 16
FOUND = ("archive string, start long, end long, quarantined boolean, reason string, record_type string, record_id string, refers_to_id string, "
         "target_uri string, payload_bytes long, payload_digest string, payload binary")


# -- plan ------------------------------------------------------------------------------------------------------------

def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 SHA-1: 160 bits are eight groups of five hex digits, four base-32 digits each."""
    digest = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def plan(pages: DataFrame, min_bytes: int = 0, salts: int = 16, id_col: str = "page_id", url_col: str = "url",
         text_col: str = "html") -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) per row. Equal payloads meet as narrow rows
    with a map-side minimum; only digests seen twice are joined back, each over ``salts`` keys, so the copies of one payload
    are spread."""
    payload = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")) \
        .withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", base32_sha1(F.col("payload")))
    first = rows.where(F.col("payload_bytes") >= min_bytes).groupBy(F.col("payload_digest").alias("d")) \
        .agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first")).where("n > 1") \
        .select("d", "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("s")).hint("shuffle_hash")
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return rows.withColumn("s0", salt).join(first, (F.col("payload_digest") == F.col("d")) & (F.col("s0") == F.col("s")), "left") \
        .select("page_id", "url", "payload", "payload_bytes", "payload_digest",
                F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


# -- records ---------------------------------------------------------------------------------------------------------

def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id, digest: str) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}:{digest}>"


def record(kind: str, rid: str, date: str, block: bytes, fields=()) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", date), *fields,
            ("WARC-Block-Digest", "sha1:" + sha1_base32(block)), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id, url, payload: bytes, size: int, digest: str, kind: str, refers_to, date: str) -> bytes:
    """A response holds the whole HTTP message, a revisit its header lines only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = [("WARC-Payload-Digest", "sha1:" + digest), ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f\x85  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)))
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest))]
    return record(kind, record_id(page_id, digest), date, http + (payload if kind == "response" else b""), fields)


def gz(data: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def write(rows: DataFrame, path: str, target_bytes: int = 8 << 20, compress: bool = True, date: str = "2000-01-01T00:00:00Z") -> None:
    """Archives under ``path``: each of one task's records up to about ``target_bytes`` (a larger record has a file of its
    own). Python makes the bytes, Spark's text writer stores one row a file. It ends a row with one separator byte, which is
    the archive's own last byte: 0 of a member's length (an empty member is added where that is not 0) or a line feed."""
    close = b"\x00" if compress else b"\n"

    def archives(batches):
        import pandas as pd

        pack = gz if compress else bytes
        begin = pack(record("warcinfo", "<urn:x-page:warcinfo>", date, b"software: reviewlens\r\nformat: WARC File Format 1.1\r\n",
                            [("Content-Type", "application/warc-fields")]))

        def finish(parts):
            if not parts[-1].endswith(close):
                parts.append(gz(b""))
            return pd.DataFrame({"content": [b"".join(parts)[:-1]]})

        parts, size = [begin], 0
        for b in batches:
            for r in b.itertuples(index=False):
                one = pack(page_record(None if pd.isna(r.page_id) else int(r.page_id), r.url, bytes(r.payload), int(r.payload_bytes), r.payload_digest,
                                       r.record_type, None if pd.isna(r.refers_to) else int(r.refers_to), date))
                if size and size + len(one) > target_bytes:
                    yield finish(parts)
                    parts, size = [begin], 0
                parts.append(one)
                size += len(one)
        if size:
            yield finish(parts)

    # ids as text: pandas would turn a column of integers with nulls into doubles
    narrow = rows.withColumn("page_id", F.col("page_id").cast("string")).withColumn("refers_to", F.col("refers_to").cast("string"))
    narrow.mapInPandas(archives, "content binary").select(F.col("content").cast("string")) \
        .write.option("lineSep", close.decode()).option("maxRecordsPerFile", 1).text(path)


# -- salvage reader --------------------------------------------------------------------------------------------------

class Bad(Exception):
    """A failed check; the text is the reason."""


def parse(data, at: int) -> tuple[int, dict, bytes]:
    """(end, fields by lower-case name, block) of the plain record at ``at``."""
    v = VERSION.match(data, at)
    if not v:
        raise Bad("no version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise Bad("header not closed")
    fields = {}
    for line in data[v.end():stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Bad("malformed field")
        key = name.strip().lower().decode("latin-1")
        if key in fields and key != "warc-concurrent-to":   # a cut header runs into the next record's
            raise Bad("field repeated")
        fields[key] = value.strip().decode("utf-8", "replace")
    if any(f not in fields for f in FIELDS):
        raise Bad("mandatory field missing")
    if not re.fullmatch("[0-9]{1,18}", fields["content-length"]):
        raise Bad("malformed length")
    begin = stop + 4
    end = begin + int(fields["content-length"])
    if data[end:end + 4] != b"\r\n\r\n":
        raise Bad("block length")
    block = data[begin:end]
    wanted = fields.get("warc-block-digest", "")
    if wanted.startswith("sha1:") and wanted[5:] != sha1_base32(block):
        raise Bad("block digest")
    return end + 4, fields, block


def member(data, at: int) -> tuple[int, bytes]:
    """(end, content) of the gzip member at ``at``. zlib checks CRC and length."""
    view, d, out, pos = memoryview(data), zlib.decompressobj(31), [], at
    try:
        while not d.eof and pos < len(data):
            piece = view[pos:pos + PIECE]
            out.append(d.decompress(piece))
            pos += len(piece)
    except zlib.error as e:
        raise Bad("gzip member: " + str(e).split(":")[-1].strip()) from None
    if not d.eof:
        raise Bad("gzip member: cut off")
    return pos - len(d.unused_data), b"".join(out)


def content(fields: dict, block: bytes) -> tuple[int | None, str | None, bytes | None]:
    """(payload bytes, digest, payload) of a response or revisit; a revisit states the size and digest of the payload it
    refers to."""
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        return None, None, None
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    head, split, payload = block.partition(b"\r\n\r\n")
    if not split:
        raise Bad("no HTTP header")
    if kind == "revisit":
        size = re.search(rb"(?i)\r\ncontent-length:\s*([0-9]{1,18})", head)
        return int(size[1]) if size else None, stated or None, None
    digest = sha1_base32(payload)
    if stated and stated != digest:
        raise Bad("payload digest")
    return len(payload), digest, payload


def one_at(data, at: int, zipped: bool):
    """(end, [(fields, size, digest, payload)]) of the member or record at ``at``; raises Bad. A member holds one or more whole records;
    an empty member holds none."""
    if not zipped:
        end, fields, block = parse(data, at)
        return end, [(fields, *content(fields, block))]
    end, inner = member(data, at)
    out, pos = [], 0
    while pos < len(inner):
        pos, fields, block = parse(inner, pos)
        out.append((fields, *content(fields, block)))
    return end, out


def salvage(data: bytes):
    """Yields (start, end, None, records) of what is valid and (start, end, reason, []) of quarantined gaps, in order and without holes.
    The archive's kind, members or plain records, is that of the first valid one."""
    at, gap, reason, zipped = 0, None, None, None
    while at < len(data):
        kind = data.startswith(MAGIC, at) if zipped is None else zipped
        try:
            end, records = one_at(data, at, kind)
        except Bad as e:
            if gap is None:
                gap, reason = at, str(e)
            later = [data.find(MAGIC, at + 1)] if zipped is not False else []
            if not zipped:
                v = VERSION.search(data, at + 1)
                later.append(v.start() if v else -1)
            at = min([x for x in later if x >= 0], default=len(data))
            continue
        if gap is not None:
            yield gap, at, reason, []
            gap = None
        zipped = kind
        yield at, end, None, records
        at = end
    if gap is not None:
        yield gap, len(data), reason, []


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Rows of all archives under ``path``: one per valid record, and one per gap with ``quarantined`` and its reason. ``payload=False``
    checks payloads and leaves them out of the rows."""
    return scan(spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), F.col("content")), payload)


def scan(files: DataFrame, payload: bool = True) -> DataFrame:
    """``read`` for a frame (archive, content). A null content has no rows."""
    def run(batches):
        import pandas as pd

        names = [c.split()[0] for c in FOUND.split(", ")]
        rows, held = [], 0
        for b in batches:
            for name, data in zip(b["archive"], b["content"]):
                for start, end, reason, records in salvage(bytes(data) if data is not None else b""):
                    if reason is not None:
                        rows.append((name, start, end, True, reason) + (None,) * 7)
                    for f, size, digest, body in records:
                        rows.append((name, start, end, False, None, f["warc-type"], f["warc-record-id"], f.get("warc-refers-to"),
                                     f.get("warc-target-uri"), size, digest, body if payload else None))
                        held += len(body or b"") if payload else 0
                    if len(rows) >= 5000 or held > 16 << 20:
                        yield frame(pd, rows, names)
                        rows, held = [], 0
        if rows:
            yield frame(pd, rows, names)

    return files.mapInPandas(run, FOUND)


def frame(pd, rows, names):
    out = pd.DataFrame(rows, columns=names, dtype=object)
    for c in ("start", "end", "payload_bytes"):
        out[c] = out[c].astype("Int64")
    return out


def page_rows(found: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the page records in ``found``."""
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:x-page:(-?[0-9]*):', 1) AS bigint)")
    return found.where(~F.col("quarantined") & F.col("record_type").isin("response", "revisit")) \
        .select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to_id").alias("refers_to"))


def gaps(found: DataFrame) -> DataFrame:
    """The quarantine log: (archive, start, end, reason)."""
    return found.where("quarantined").select("archive", "start", "end", "reason")
