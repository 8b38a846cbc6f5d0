import hashlib
import heapq
import itertools
import random
import re
import zlib

from reviewlens.llm import auction_repair as ar

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def plain_repair(marks):
    """Dijkstra on (cost, audit)."""
    heap, seen = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, s = heapq.heappop(heap)
        if (i, s) == (len(marks), "end"):
            return cost, audit
        if (i, s) in seen:
            continue
        seen.add((i, s))
        arcs = [("I", 2, i, 3 if s == 2 else 2)]
        if i == len(marks):
            if s in (0, 3):
                arcs.append(("", 0, i, "end"))
        else:
            m = marks[i]
            arcs.append(("D", 3, i + 1, s))
            if not m.isdigit():
                cut = int(m.isupper())
                arcs.append(("R", 2 + cut, i + 1, 3 if s == 2 else 2))
                keep = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "x": {}}[m.lower()]
                if s in keep:
                    arcs.append(("K", cut, i + 1, keep[s]))
        for label, c, j, t in arcs:
            heapq.heappush(heap, (cost + c, audit + label, j, t))


def test_auction_against_dijkstra():
    rng = random.Random(1)
    letters = "suax" * 3 + "uauaua" + "SUAX" + "12345678"
    cases = ["".join(p) for n in range(4) for p in itertools.product("suaxSUA1", repeat=n)]
    cases += ["".join(rng.choice(letters) for _ in range(rng.randrange(4, 30))) for _ in range(300)]
    for marks in cases:
        assert ar.repair([ar.ROW_ARCS[m] for m in marks]) == plain_repair(marks), marks


def test_prices_are_exact_and_tight():
    rng = random.Random(2)
    for _ in range(50):
        layers = [ar.ROW_ARCS[rng.choice("suaxSUAX15")] for _ in range(12)] + [ar.END_ARCS]
        price = ar.auction(layers, [0, ar.INF, ar.INF, ar.INF])
        for i, layer in enumerate(layers):
            for s in range(4):
                assert price[i][s] == min(c + price[i + d][t] for _, c, d, t in layer[s])


def test_units_join_to_the_same_repair():
    rng = random.Random(3)
    for _ in range(120):
        marks = "".join(rng.choice("suauauaxSUA15") for _ in range(rng.randrange(1, 40)))
        n = rng.randrange(1, 9)
        codes = [ar.unit_code(marks[i:i + n]) for i in range(0, len(marks), n)]
        fan = rng.randrange(2, 5)
        twice = [ar.joined_code(tuple(codes[i:i + fan])) for i in range(0, len(codes), fan)]
        want = plain_repair(marks)
        for c in (codes, twice):
            cost, _, audit = ar.repair_code(tuple(c)).partition(":")
            assert (int(cost), audit) == want


def plain_report(rows):
    """rows: (conv_id, turn, role, text) -> {conv_id: result}."""
    out, after = {}, {}
    for conv, turn, role, text in rows:
        out[conv] = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        after.setdefault(conv, []).extend([(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1))
    for conv, rs in after.items():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        marks, seen = "", set()
        for _, role, text in rs:
            k = "suax".index(role[:1]) if role[:1] in ("s", "u", "a") else 3
            end = text.rstrip(SPACE)[-1:]
            marks += ("1234" if not end else "5678" if (role, text) in seen else "SUAX" if end not in ".!?" else "suax")[k]
            seen.add((role, text))
        cost, audit = plain_repair(marks)
        turns = [t for t, _, _ in rs if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rs, rs[1:]))
        lines, s, i = [], 0, 0
        for e in audit:
            if e != "D":
                t = 3 if s == 2 else 2
                role = rs[i][1] if e == "K" else ("user", "assistant")[t - 2]
                lines.append(role + ":" + ("" if e == "I" else rs[i][2]))
                s = {"s": 1, "u": 2, "a": 3}[role[0]]
            i += e != "I"
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, sum(m in "1234" for m in marks), sum(m in "5678" for m in marks), sum(m in "SUAX" for m in marks), illegal, cost, audit, digest)
    return out


def got(df):
    return {r.conv_id: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}


SCHEMA = "conv_id long, turn long, role string, text string, unit string, at long, mark int"


def test_report_against_plain_version(spark, monkeypatch):
    rng = random.Random(4)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]
    texts = ["Yes.", "No!", "cut off", "", " \t", None, "ü?", "Yes. ", "a\nb.", "x" * 70_000 + "."]
    rows = []
    for conv in [*range(40), None]:
        for turn in range(rng.randrange(1, 12)):
            rows.append((conv, rng.choice([turn, turn, turn + 3, None]), rng.choice(roles), rng.choice(texts)))
    rows += [(100, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(300)] + [rows[0], rows[0], rows[0]]   # one long conversation, repeated rows
    df = spark.createDataFrame([(*r, "u", 3, 4) for r in rows], SCHEMA).repartition(3)
    monkeypatch.setattr(ar, "UNIT", 4)      # units and levels on small conversations too
    r = ar.in_order(ar.damage(df))
    assert got(ar.report(df, ar.damage(df))) == plain_report(rows)
    u = ar.units(ar.marks(r))
    audits = {c.conv: (c.cost, c.audit) for c in ar.audits(u, fan=2).collect()}
    assert audits == {None if k is None else str(k): v[5:7] for k, v in plain_report(rows).items() if k is None or str(k) in audits}
    turns = ar.apply(r, ar.audits(u)).where("conv = '100'").orderBy("pos").collect()
    assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in turns).encode()).hexdigest() == plain_report(rows)[100][7]


def test_empty_and_all_dropped(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert ar.report(df, ar.damage(df)).count() == 0
    gone = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(1, gone, "user", "Hello.", "", 0, 0)], SCHEMA)
    assert got(ar.report(df, ar.damage(df))) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
