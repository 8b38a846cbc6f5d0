import random

import pytest

from reviewlens.llm import warc_salvage as ws

PAGES = [(1, "http://a/x y\r\nWARC-Type: spoof", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://b", None), (4, "http://b", ""), (7, "u", "WARC/1.1\r\n"),
         (9, "u", "ü€" * 40_000), (None, "n", "<p>one</p>"), (None, "n", "only nulls"), (None, None, "only nulls"), (5, "c", "twice"), (5, "c", "twice"), (6, "c", "twice"),
         (8, "z", "\x00\x1f\r\n\r\n" * 7)]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, payload string")


def plain(rows):
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        ids = [j for j, _, o in rows if (o or "") == (h or "") and j is not None]
        first = min(ids) if ids else None
        revisit = first is not None and first != i
        out.append((i, len(body), ws.sha1_base32(body), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("compress", [True, False])
def test_round_trip(spark, tmp_path, compress):
    path = str(tmp_path / "a")
    ws.write(ws.plan(pages(spark)), path, target_bytes=300, compress=compress)
    found = ws.read(spark, path).cache()
    assert ws.gaps(found).count() == 0
    assert sorted(map(tuple, ws.page_rows(found).collect()), key=str) == plain(PAGES)
    bodies = {bytes(r.payload).decode() for r in found.where("record_type = 'response'").collect()}
    assert bodies == {h or "" for _, _, h in PAGES}
    uris = {r.target_uri for r in found.where("record_id like '<urn:x-page:1:%'").collect()}
    assert uris == {"http://a/x%20y%0D%0AWARC-Type:%20spoof"}


def test_min_bytes_and_empty_table(spark, tmp_path):
    rows = ws.plan(pages(spark), min_bytes=6).collect()
    assert {r.page_id: r.record_type for r in rows if r.page_id in (3, 4, 6, 2)} == {3: "response", 4: "response", 6: "response", 2: "revisit"}
    ws.write(ws.plan(pages(spark, [])), str(tmp_path / "none"))
    assert ws.page_rows(ws.read(spark, str(tmp_path / "none"))).count() == 0


def archive(n=40, zipped=True, rng=random.Random(5)):
    parts = []
    for i in range(n):
        body = bytes(rng.choice(b"abc \r\n") for _ in range(rng.randrange(0, 400)))
        parts.append(ws.page_record(i, f"http://h/{i}", body, len(body), ws.sha1_base32(body), "response", None, "2000-01-01T00:00:00Z"))
    return [ws.gz(p) for p in parts] if zipped else parts


@pytest.mark.parametrize("zipped", [True, False])
def test_salvage_recovers_all_but_the_damaged(zipped):
    rng = random.Random(3)
    for _ in range(60):
        parts = archive(12, zipped, rng)
        hurt = set(rng.sample(range(12), rng.randrange(0, 5)))
        data, spans = b"", []
        for i, p in enumerate(parts):
            if i in hurt:
                how = rng.randrange(4)
                at = rng.randrange(len(p))
                p = (p[:at] + bytes([p[at] ^ (1 + rng.randrange(255))]) + p[at + 1:], p[:at], b"\x00\x1f\x8b\x08junkWARC/1.1\r\n" + p[at + 1:], b"")[how]
            spans.append((len(data), len(data) + len(p)))
            data += p
        pieces = list(ws.salvage(data))
        assert [s for s, *_ in pieces] == [0, *[e for _, e, *_ in pieces]][:len(pieces)] and (not pieces or pieces[-1][1] == len(data))
        got = {(s, e) for s, e, reason, _ in pieces if reason is None}
        assert got >= {spans[i] for i in range(12) if i not in hurt}
        for s, e, reason, records in pieces:       # what a flipped byte leaves valid (a time stamp, a type) has its block intact
            assert (reason is None) == bool(records)
            for fields, size, digest, payload in records:
                if fields["warc-type"] == "response":
                    assert digest == ws.sha1_base32(payload) and size == len(payload)


def test_damaged_head_and_tail(spark):
    good = archive(3)
    data = [("a", b"rubbish" + good[0] + good[1][:-9]), ("b", b""), ("c", None), ("d", b"nothing valid here"), ("e", b"".join(good))]
    found = ws.scan(spark.createDataFrame(data, "archive string, content binary")).cache()
    log = {(r.archive, r.start, r.end) for r in ws.gaps(found).collect()}
    assert log == {("a", 0, 7), ("a", 7 + len(good[0]), len(data[0][1])), ("d", 0, 18)}
    assert sorted(r.page_id for r in ws.page_rows(found).collect()) == [0, 0, 1, 2]


def test_long_member_ends_with_a_byte_of_its_own(spark, tmp_path):
    body = "x" * (17 << 20)     # its length has a last byte other than 0
    ws.write(ws.plan(pages(spark, [(1, "u", body)])), str(tmp_path / "l"))
    found = ws.read(spark, str(tmp_path / "l"), payload=False)
    assert ws.gaps(found).count() == 0 and ws.page_rows(found).first().payload_bytes == len(body)
