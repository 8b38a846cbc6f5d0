"""Conversation structure repair by the auction algorithm for shortest paths.

Turns of a conversation should read ``(system? (user assistant)+)?`` by role initials. Every row can be kept, given another role,
or deleted, and empty turns can be inserted; each edit has an integer cost. The edits are arcs of a lattice with one layer per row
and four states (nothing yet, after system, after user, after assistant), and the cheapest repair is a shortest path.

The auction keeps a price for every node that never exceeds any arc's cost plus the price behind it. A path grows from an origin:
its end either raises its price to the best offer and the path contracts by that node, or the path extends along an arc that meets
the price. Origins are taken from the last layer back, and a path that reaches a node of an earlier path is done: prices there are
exact distances. Arcs that meet the converged prices (tight arcs) are exactly those of cheapest repairs, and taking the ASCII-least
one at each node traces the least audit string.

Long conversations are cut into units of ``UNIT`` consecutive rows. An auction finds each unit's cheapest path for every pair of
entry and exit state; units are then single steps of a coarser lattice, solved by the same auction, in as many levels as
a conversation needs. No group holds more than ``UNIT`` rows or ``FAN`` units.

Defined cases: null role, text, id or turn count as one space in keys and texts; rows go by turn, nulls first, then by role, the first
32 characters of the text and its hash; a null id is a conversation of its own; equal rows are duplicates of one of them. The digest
of a conversation is sequential by nature: one task streams its rows in order with the memory of its audit string.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship_by_value, stage

ship_by_value(__name__)

KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1     # costs; CUT is added where a truncated row stays
SPACE = r"\x20\x09-\x0D"
UNIT, FAN = 512, 256
#: a row's mark: its role's initial (x: another) plain, cut off, blank, repeated
CLASSES = "suax"
CUT_OFF, BLANK, REPEATED = "SUAX", "1234", "5678"
INF = float("inf")


# -- the lattice ---------------------------------------------------------------------------------------------------------

def turn_state(state: int) -> int:
    """The state after a turn that is inserted or given its role here: a user turn, or an assistant's after a user."""
    return 3 if state == 2 else 2


def kept_state(state: int, initial: str) -> int | None:
    """The state after a row that keeps its role, None if the role may not stand here."""
    if initial == "s":
        return 1 if state == 0 else None
    if initial == "u":
        return None if state == 2 else 2
    return 3 if initial == "a" and state == 2 else None


def row_arcs(mark: str) -> list[list[tuple]]:
    """For every state the arcs (label, cost, layers ahead, state) at a row."""
    cut = CUT * (mark in CUT_OFF)
    out = []
    for s in range(4):
        arcs = [("D", DELETE, 1, s), ("I", INSERT, 0, turn_state(s))]
        if mark not in BLANK + REPEATED:
            t = kept_state(s, mark.lower())
            if t is not None:
                arcs.append(("K", KEEP + cut, 1, t))
            arcs.append(("R", REROLE + cut, 1, turn_state(s)))
        out.append(arcs)
    return out


ROW_ARCS = {m: row_arcs(m) for m in CLASSES + CUT_OFF + BLANK + REPEATED}
#: behind the last row: stop after nothing or an assistant, or insert
END_ARCS = [([("", 0, 1, 0)] if s in (0, 3) else []) + [("I", INSERT, 0, turn_state(s))] for s in range(4)]


def auction(layers: list, ends: list, lost=()) -> list:
    """Exact prices (distances to the end) of all nodes, by layer and state. ``ends`` prices the nodes behind the last layer; INF closes one.
    ``lost`` states have no price: a cycle of insertions that leads to no end would raise its prices for ever."""
    n = len(layers)
    price = [[INF if s in lost else 0 for s in range(4)] for _ in range(n)] + [list(ends)]
    done = [[s in lost for s in range(4)] for _ in range(n)] + [[True] * 4]
    for layer in range(n - 1, -1, -1):
        for origin in range(4):
            path = [(layer, origin)]
            while not done[path[-1][0]][path[-1][1]]:
                i, s = path[-1]
                best, to = INF, None
                for _, cost, ahead, t in layers[i][s]:
                    offer = cost + price[i + ahead][t]
                    if offer < best:
                        best, to = offer, (i + ahead, t)
                if price[i][s] < best:            # raise, and contract the path
                    price[i][s] = best
                    if best == INF:
                        done[i][s] = True
                    if len(path) > 1:
                        path.pop()
                else:                              # the price is met: extend
                    path.append(to)
            if price[path[-1][0]][path[-1][1]] < INF:
                for i, s in path:
                    done[i][s] = True
    return price


def trace(layers: list, price: list, state: int) -> tuple[str, int]:
    """(audit, state behind the last layer) along the ASCII-least tight arcs from ``state`` in the first layer."""
    at, out = 0, []
    while at < len(layers):
        p = price[at][state]
        label, ahead, state = min((label, ahead, t) for label, cost, ahead, t in layers[at][state] if cost + price[at + ahead][t] == p)
        out.append(label)
        at += ahead
    return "".join(out), state


def crossings(layers: list) -> list[list[tuple]]:
    """For every entry state the cheapest ways through ``layers``, one per exit state it can reach: arcs (audit, cost, 1, exit)."""
    out = [[] for _ in range(4)]
    for t, lost in enumerate(((1, 2, 3), (2, 3), (), ())):     # states 0 and 1 are reached from 0, and from 0 and 1
        price = auction(layers, [0 if s == t else INF for s in range(4)], lost)
        for s in range(4):
            if price[0][s] < INF:
                out[s].append((trace(layers, price, s)[0], price[0][s], 1, t))
    return out


def repair(layers: list) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair, the ASCII-least one."""
    full = [*layers, END_ARCS]
    price = auction(full, [0, INF, INF, INF]) if layers else [[0]]
    return (int(price[0][0]), trace(full, price, 0)[0]) if layers else (0, "")


def encode(arcs: list) -> str:
    return "|".join(f"{s}{t}{cost}:{audit}" for s, row in enumerate(arcs) for audit, cost, _, t in row)


def decode(code: str) -> list:
    out = [[] for _ in range(4)]
    for one in code.split("|"):
        head, _, audit = one.partition(":")
        out[int(head[0])].append((audit, int(head[2:]), 1, int(head[1])))
    return out


@lru_cache(maxsize=20_000)
def unit_code(marks: str) -> str:
    return encode(crossings([ROW_ARCS[m] for m in marks]))


@lru_cache(maxsize=20_000)
def joined_code(codes: tuple) -> str:
    return encode(crossings([decode(c) for c in codes]))


@lru_cache(maxsize=20_000)
def repair_code(codes: tuple) -> str:
    cost, audit = repair([decode(c) for c in codes])
    return f"{cost}:{audit}"


def column(function, col: Column) -> Column:
    """A text column from a plain function of a text or an array of texts."""
    def mapped(series: pd.Series) -> pd.Series:
        return pd.Series([function(x) if isinstance(x, str) else function(tuple(x)) for x in series], dtype=object)

    return F.pandas_udf(mapped, "string")(col)


# -- damage and faults ---------------------------------------------------------------------------------------------------

def text_or_space(c) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text) with a fault dealt to one row in five by the checksum of ``conv_id:turn``."""
    deal = F.crc32(F.concat(text_or_space("conv_id"), F.lit(":"), text_or_space("turn")).cast("binary")) % 20
    d = conversations.select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"), text_or_space("role").alias("role"),
                             text_or_space("text").alias("text"), deal.alias("deal")).where("deal <> 0")
    text = F.when(F.col("deal") == 1, "").when(F.col("deal") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return d.select("conv", "turn", F.when(F.col("deal") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                    F.explode(F.array_repeat(F.lit(0), F.when(F.col("deal") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def in_order(rows: DataFrame) -> DataFrame:
    """A stage table of (conv, turn, role, text) with ``at``, which grows in the order of each conversation. Ranges cut through conversations and
    through equal rows, so no conversation need fit a task."""
    keys = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 32), F.xxhash64("text"), "cut"]
    r = rows.withColumn("cut", F.rand(11)).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("cut")
    return stage(r.withColumn("at", F.monotonically_increasing_id()), "conversation-rows")


def marks(rows: DataFrame) -> DataFrame:
    """A narrow stage table (conv, at, turn, mark). The first of equal (role, text) is found by a map-side minimum and joined on the unique ``at``."""
    r = rows.select("conv", "at", "turn", "role", F.sha2("text", 256).alias("same"), (~F.col("text").rlike(f"[^{SPACE}]")).alias("blank"),
                    (~F.col("text").rlike(f"[.!?][{SPACE}]*\\z")).alias("cut"), F.substring("role", 1, 1).alias("initial"))
    first = r.groupBy("conv", "role", "same").agg(F.min("at").alias("first")).select("first")
    no = F.when(F.col("initial") == "s", 1).when(F.col("initial") == "u", 2).when(F.col("initial") == "a", 3).otherwise(4)
    pick = lambda letters: F.substring(F.lit(letters), no, F.lit(1))
    mark = F.when(F.col("blank"), pick(BLANK)).when(F.col("first").isNull(), pick(REPEATED)).when(F.col("cut"), pick(CUT_OFF)).otherwise(pick(CLASSES))
    return stage(r.join(first, F.col("at") == F.col("first"), "left").select("conv", "at", "turn", mark.alias("mark")), "conversation-marks")


def units(marked: DataFrame) -> DataFrame:
    """(conv, unit, marks): at most UNIT consecutive rows of one conversation as a string."""
    row = F.array_sort(F.collect_list(F.struct("at", "mark")))
    return marked.groupBy("conv", F.floor(F.col("at") / UNIT).alias("unit")).agg(F.array_join(F.transform(row, lambda x: x["mark"]), "").alias("marks"))


def counts(marked: DataFrame, unit: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal)."""
    per_turn = marked.groupBy("conv", "turn").agg(*[F.count_if(F.col("mark").isin(*letters)).alias(name) for name, letters in
                                                   (("blank", BLANK), ("duplicate", REPEATED), ("truncated", CUT_OFF))])
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    faults = per_turn.groupBy("conv").agg(gaps.alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    # one row a unit: the pair across the border counts in the later one
    before = F.lag(F.right("marks", F.lit(1))).over(Window.partitionBy("conv").orderBy("unit"))
    initials = F.translate(F.concat(F.coalesce(before, F.lit("")), F.col("marks")), CUT_OFF + BLANK + REPEATED, CLASSES * 3)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length("w") - 1, F.lit(1))), lambda i: F.col("w").substr(i, F.lit(2)))
    bad = unit.withColumn("w", initials).select("conv", F.when(F.length("w") < 2, 0).otherwise(F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au")))).alias("bad"))
    illegal = bad.groupBy(F.col("conv").alias("c")).agg(F.sum("bad").alias("illegal"))
    return faults.join(illegal, F.col("conv").eqNullSafe(F.col("c"))).drop("c")


def audits(unit: DataFrame, fan: int = FAN) -> DataFrame:
    """(conv, cost, audit) of the cheapest repairs."""
    codes = stage(unit.select("conv", "unit", column(unit_code, F.col("marks")).alias("code")), "conversation-units")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("unit", "code"))), lambda x: x["code"]).alias("codes")
    while codes.groupBy("conv").count().where(F.col("count") > fan).limit(1).count():
        merged = codes.groupBy("conv", F.floor(F.col("unit") / fan).alias("unit")).agg(listed)
        codes = stage(merged.select("conv", "unit", column(joined_code, F.col("codes")).alias("code")), "conversation-units")
    best = codes.groupBy("conv").agg(listed).select("conv", column(repair_code, F.col("codes")).alias("best"))
    return best.select("conv", F.substring_index("best", ":", 1).cast("long").alias("cost"), F.substring_index("best", ":", -1).alias("audit"))


# -- repaired conversations ------------------------------------------------------------------------------------------------

def turns(audit: str):
    """A generator that takes the next row's (role, text), or None behind the last, and gives the turns [(edit, role, text)] that this adds."""
    at, state, out = 0, 0, []
    while True:
        row = yield out
        out = []
        while at < len(audit) and (audit[at] == "I" or row is not None):
            edit, at = audit[at], at + 1
            if edit == "D":
                break
            state = kept_state(state, row[0][:1]) if edit == "K" else turn_state(state)
            role = row[0] if edit == "K" else "assistant" if state == 3 else "user"
            out.append((edit, role, "" if edit == "I" else row[1]))
            if edit != "I":
                break


def apply(rows: DataFrame, audit: DataFrame, digest: bool = False) -> DataFrame:
    """The repaired turns (conv, pos, edit, role, text), or per conversation (conv, repaired_sha256). A task streams its conversations in order; each
    is led by its audit."""
    both = audit.select("conv", F.lit(-1).cast("long").alias("at"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text")) \
        .unionByName(rows.select("conv", "at", "role", "text"))
    ordered = both.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "at")

    def run(batches):
        conv, walk, pos, sha = None, None, 0, None
        out = []

        def add(turn_list):
            nonlocal pos
            for edit, role, text in turn_list:
                if digest:
                    sha.update((("\n" if pos else "") + role + ":" + text).encode())
                else:
                    out.append((conv, pos, edit, role, text))
                pos += 1

        def close():
            if walk is not None:
                add(walk.send(None))
                if digest:
                    out.append((conv, sha.hexdigest()))

        names = ["conv", "repaired_sha256"] if digest else ["conv", "pos", "edit", "role", "text"]
        for b in batches:
            for c, at, role, text in zip(b["conv"], b["at"], b["role"], b["text"]):
                if at < 0:
                    close()
                    conv, walk, pos, sha = c, turns(text), 0, hashlib.sha256()
                    next(walk)
                else:
                    add(walk.send((role, text)))
            if out:
                yield pd.DataFrame(out, columns=names)
                out = []
        close()
        if out:
            yield pd.DataFrame(out, columns=names)

    return ordered.mapInPandas(run, "conv string, repaired_sha256 string" if digest else "conv string, pos long, edit string, role string, text string")


def report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """Per original conv_id the counts of faults, cost, audit and digest of the repaired conversation; ``rows`` are what is to be repaired
    (conv, turn, role, text)."""
    r = in_order(rows)
    m = marks(r)
    u = stage(units(m), "conversation-strings")
    a = stage(audits(u), "conversation-audits")
    found = counts(m, u).alias("n").join(a.alias("a"), F.col("n.conv").eqNullSafe(F.col("a.conv"))) \
        .join(apply(r, a, digest=True).alias("h"), F.col("n.conv").eqNullSafe(F.col("h.conv"))).drop(F.col("a.conv")).drop(F.col("h.conv"))
    ids = conversations.select("conv_id").distinct()
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return ids.join(found, F.col("conv_id").cast("string").eqNullSafe(F.col("conv")), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
