import hashlib
import re

from reviewlens.llm import license_index as li
from reviewlens.llm import secret_ledger as sl

from .conftest import frame

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
TEXTS = ["token=secret:longvalue99 x", "Password: 'abcdefgh1' api_key=short APIKEY = \"12345678\"", "pre AKIA0123456789AB post AKIA12",
         "ü€ token = " + "0" * 40 + " tail", "a" * 31 + " " + "b" * 32 + "c" * 5 + "g" + "0123456789abcdef" * 2, "passwd=passwd=12345678token=abcdefgh",
         "-----BEGIN RSA PRIVATE KEY-----", None, "", "nothing here", "ghp_" + "A" * 36, "ſecret=abcdefgh1 toKen=abcdefgh1"]


def plain_spans(text):
    t, out = text or "", []
    for m in ASSIGN.finditer(t):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for i, (kind, p, n) in enumerate((("access", "AKIA[A-Z0-9]+", 16), ("hex", "[0-9a-f]+", 32)), 1):
        out += [(m.start(), i, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(p, t) if len(m[0]) >= n]
    return [x for _, _, x in sorted(out)]


def test_base_spans(spark, tmp_path):
    docs = frame(spark, [(i, t, "", "", 0) for i, t in enumerate(TEXTS + TEXTS[:3])])
    ledger = sl.Ledger(spark, str(tmp_path / "ledger"))
    rows = sl.spans_by_path(docs, ledger.scan(docs)).withColumn("all", sl.joined("spans")).collect()
    assert len(rows) == len(TEXTS) + 3
    for r in rows:
        base = [x for x in r["all"].split(",") if x.split(":")[0] in ("assign", "access", "hex")]
        assert base == plain_spans((TEXTS + TEXTS[:3])[r["doc_id"]]), r
    by = {r["doc_id"]: r["all"] for r in rows}
    assert "private_key:0:31" in by[6] and "hub_token:0:40" in by[10]


def test_ledger_scans_only_what_is_new(spark, tmp_path, edges, nothing):
    ledger = sl.Ledger(spark, str(tmp_path / "ledger"))
    docs = frame(spark, [(1, TEXTS[1], "", "", 0), (2, TEXTS[2], "", "", 0), (2, TEXTS[2], "", "", 0)])
    first = ledger.scan(docs, sl.BASE_RULES).count()
    n = ledger.scanned().count()
    assert n == 2 * len(sl.BASE_RULES)
    assert ledger.scan(docs, sl.BASE_RULES).count() == first and ledger.scanned().count() == n
    ledger.scan(docs, sl.RULES)         # new rules read old blobs; old rules do not
    assert ledger.scanned().count() == 2 * len(sl.RULES)
    ledger.scan(docs.union(frame(spark, [(9, "a new version", "", "", 0)])), sl.RULES)
    assert ledger.scanned().count() == 3 * len(sl.RULES)
    assert sl.spans_by_path(edges, ledger.scan(edges)).count() == edges.count()
    assert sl.spans_by_path(nothing, ledger.scan(nothing)).count() == 0


def test_redaction(spark, tmp_path, edges):
    docs = frame(spark, [(1, "x token=abcdefgh y AKIA0123456789AB", "", "", 0), (2, "clean", "", "", 0), (3, None, "", "", 0), (4, "token=" + "a" * 40, "", "", 0)])
    found = sl.Ledger(spark, str(tmp_path / "ledger")).scan(docs)
    got = {r["doc_id"]: r["text"] for r in sl.redact(docs, found).collect()}
    assert got == {1: "x [secret] y [secret]", 2: "clean", 3: None, 4: "[secret]"}
    assert sl.redact(edges, found).columns == edges.columns


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_licenses(spark, edges, nothing):
    texts = ["Released under the MIT License.", "All rights reserved. all RIGHTS-reserved", "cc by cc by, CC BY-NC 4.0 licensed", "Licensed under CC BY-NC 4.0.",
             "This work is licensed under the GNU General Public License, version 3.", "the mit license alone", "ünder licensé", None, "",
             "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "cc éby ccKby", "Licensed under the Apache License, Version 2.0. " * 3]
    texts += ["some other words of no licence " + str(i) for i in range(60)]
    docs = frame(spark, [(i, t, "", "", 0) for i, t in enumerate(texts)])
    got = {r["doc_id"]: r for r in li.scan(docs).collect()}
    for i, t in enumerate(texts):
        w, places, labels = words(t), [], set()
        for phrase, label in li.BASE.items():
            k = phrase.split()
            at = [p for p in range(len(w)) if w[p:p + len(k)] == k]
            places += at
            labels |= {label} if at else set()
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(places), ",".join(sorted(labels))), (i, r)
        assert (r["first_word"], r["last_word"]) == ((min(places), max(places)) if places else (None, None))
        assert labels <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert got[0]["labels"] == "mit" and got[0]["score"] == 1.0 and got[11]["labels"] == "apache-2.0"
    assert got[3]["labels"] == "cc-by,cc-by-nc-4.0" and got[4]["labels"] == "gpl,gpl-3.0" and "mit" in got[9]["labels"]
    assert got[20]["labels"] == "" and got[20]["score"] == 0
    assert li.scan(edges).count() == edges.count() and li.scan(nothing).count() == 0


def test_ids_are_content(spark):
    docs = frame(spark, [(1, None, "", "", 0), (2, "", "", "", 0), (3, "a", "", "", 0)])
    got = [bytes(r[0]) for r in docs.select(sl.blob_id(docs["text"])).collect()]
    assert got == [hashlib.sha256(x).digest() for x in (b"", b"", b"a")]
