"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its text. The ledger remembers which rule versions
have read which blobs and what they found; a run scans only blobs with a rule version not seen yet, once per blob,
and joins the findings back to all paths. Null texts are empty texts. A path may have many versions, rows may repeat.

Ledger folder: ``scanned`` (blob, rule_version) and ``findings`` (blob, rule_version, start, end), appended per run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost, non-overlapping; a match is dropped if ``group`` has under ``min_chars``
    characters. ``hints``: a text without all words of any one hint cannot match (lower case; only a speed-up)."""
    kind: str
    pattern: str
    group: int = 0
    min_chars: int = 1
    hints: tuple[str, ...] = ()
    revision: int = 1

    @property
    def version(self) -> str:
        return f"{self.kind}/{self.revision}"


def either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = ("(" + "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
          + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
BASE_RULES = (
    Rule("assign", ASSIGN, 2, 8, ("passw", "secret", "token", "api")),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16, ("akia",)),
    Rule("hex", "[0-9a-f]{32,}", 0, 32),   # a run of 32 or more: same spans as dropping the shorter matches
)
MORE_RULES = (
    Rule("private_key", "-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----", 0, 1, ("private key-----",)),
    Rule("hub_token", "gh[pousr]_[A-Za-z0-9]+", 0, 40, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40, ("eyj",)),
    Rule("chat_token", "xox[abprs]-[A-Za-z0-9-]+", 0, 15, ("xox",)),
)
RULES = BASE_RULES + MORE_RULES


def blob_id(text) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def may_match(rule: Rule, text, lower) -> Column:
    if rule.kind == "hex":
        return text.rlike(rule.pattern)
    found = F.lit(False)
    for h in rule.hints:
        found = found | lower.contains(h)
    return found if rule.hints else F.lit(True)


def matches(rule: Rule, text) -> Column:
    """Array of (rule, n, before, chars, good): the n-th match, the characters between it and the one before, its
    own characters, and whether its group is long enough. Splitting at the pattern gives the text in between."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    between = F.split(text, rule.pattern, -1)
    group = (lambda m: m) if rule.group == 0 else (lambda m: F.regexp_extract(m, rule.pattern, rule.group))
    return F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, b: F.struct(
        F.lit(rule.version).alias("rule_version"), F.length(b).alias("before"), F.length(m).alias("chars"),
        (F.length(group(m)) >= rule.min_chars).alias("good")))


def numbered(array) -> Column:
    return F.transform(array, lambda x, i: F.struct(x["rule_version"].alias("rule_version"), i.alias("n"), x["before"].alias("before"),
                                                    x["chars"].alias("chars"), x["good"].alias("good")))


def find(blobs: DataFrame, rules=RULES) -> DataFrame:
    """(blob, rule_version, start, end) of the good matches in ``blobs`` (blob, text, todo = rule versions to run).
    Positions are code points, the end exclusive. Only narrow rows of matching texts are shuffled."""
    lower = F.lower("text")
    none = F.array().cast("array<struct<rule_version:string,n:int,before:int,chars:int,good:boolean>>")
    some = F.lit(False)
    parts = []
    for r in rules:
        todo = F.array_contains("todo", r.version) & F.col(f"may_{r.kind}")
        some = some | todo
        parts.append(F.when(todo, numbered(matches(r, F.col("text")))).otherwise(none))
    b = blobs.withColumn("_lower", lower)
    b = b.select("blob", "text", "todo", *[may_match(r, F.col("text"), F.col("_lower")).alias(f"may_{r.kind}") for r in rules])
    rows = b.where(some).select("blob", F.explode(F.concat(*parts)).alias("m")).select("blob", "m.*")
    # rows given twice give the same matches twice
    once = rows.groupBy("blob", "rule_version", "n").agg(*[F.first(c).alias(c) for c in ("before", "chars", "good")])
    from pyspark.sql import Window

    # one text's matches of one rule
    w = Window.partitionBy("blob", "rule_version").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("before") + F.col("chars")).over(w)
    return once.select("blob", "rule_version", (end - F.col("chars")).alias("start"), end.alias("end"), "good") \
        .where("good").drop("good")


class Ledger:
    """Tables under ``path`` in a shared folder. Writing findings first, then what was scanned, makes a run that
    dies in between harmless: its blobs are scanned again and equal findings count once."""

    SCANNED = "blob binary, rule_version string"
    FINDINGS = "blob binary, rule_version string, start long, end long"

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        for name, schema in (("scanned", self.SCANNED), ("findings", self.FINDINGS)):
            # an empty part, so that the first read finds a table
            spark.createDataFrame([], schema).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")

    def scanned(self) -> DataFrame:
        return self.spark.read.schema(self.SCANNED).parquet(f"{self.path}/scanned")

    def findings(self) -> DataFrame:
        return self.spark.read.schema(self.FINDINGS).parquet(f"{self.path}/findings").distinct()

    def scan(self, docs: DataFrame, rules=RULES, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Scan the blobs of ``docs`` that a rule version has not read, append to the ledger, and return
        (blob, rule_version, start, end) of all findings in these blobs by these rule versions."""
        d = docs.select(F.col(path_col).alias("_path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
        d = d.withColumn("blob", blob_id(F.col("text")))
        # one path per blob speaks for it; ids only
        reps = d.groupBy("blob").agg(F.min("_path").alias("_path"))
        seen = self.scanned().groupBy("blob").agg(F.collect_set("rule_version").alias("seen"))
        every = F.array(*[F.lit(r.version) for r in rules])
        todo = reps.join(seen, "blob", "left").select(
            "blob", "_path", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo")) \
            .where(F.size("todo") > 0)
        rep = todo.select(F.col("blob").alias("_rep"), F.col("_path").alias("_rep_path"), "todo").hint("shuffle_hash")
        texts = d.join(rep, (F.col("blob") == F.col("_rep")) & F.col("_path").eqNullSafe(F.col("_rep_path"))) \
            .select("blob", "text", "todo")
        find(texts, rules).write.mode("append").parquet(f"{self.path}/findings")
        todo.select("blob", F.explode("todo").alias("rule_version")).write.mode("append").parquet(f"{self.path}/scanned")
        return self.findings().where(F.col("rule_version").isin([r.version for r in rules]))


def spans_by_blob(findings: DataFrame, rules=RULES) -> DataFrame:
    """(blob, spans): sorted array of (start, order of the kind, end, kind)."""
    order, kind = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, r in enumerate(rules):
        order = F.when(F.col("rule_version") == r.version, F.lit(i)).otherwise(order)
        kind = F.when(F.col("rule_version") == r.version, F.lit(r.kind)).otherwise(kind)
    span = F.struct(F.col("start"), order.alias("kind_no"), F.col("end"), kind.alias("kind"))
    return findings.groupBy("blob").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def spans_by_path(docs: DataFrame, findings: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) for every row of ``docs``; no findings: an empty array."""
    per_blob = spans_by_blob(findings, rules)
    none = F.array().cast("array<struct<start:bigint,kind_no:int,end:bigint,kind:string>>")
    paths = docs.select(F.col(id_col), blob_id(F.col(text_col)).alias("blob"))
    return paths.join(per_blob, "blob", "left").select(F.col(id_col), F.coalesce("spans", none).alias("spans"))


def joined(spans) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, findings: DataFrame, rules=RULES, mark: str = "[secret]", text_col: str = "text") -> DataFrame:
    """``docs`` with every found span of the text replaced by ``mark`` (overlapping and touching spans by one mark)."""
    per_blob = spans_by_blob(findings, rules)
    cols = docs.columns
    d = docs.withColumn("_blob", blob_id(F.col(text_col)))
    d = d.join(per_blob.select(F.col("blob").alias("_blob"), F.col("spans").alias("_spans")).hint("shuffle_hash"), "_blob", "left")   # texts are not sorted
    n = F.length(F.col(text_col)).cast("long")
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc, s):
        fresh = (s["start"] > acc["at"]) | (F.size(acc["parts"]) == 0)
        kept = F.substring(F.col(text_col), (acc["at"] + 1).cast("int"), (F.greatest(s["start"] - acc["at"], F.lit(0))).cast("int"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(fresh, F.concat(acc["parts"], F.array(kept, F.lit(mark)))).otherwise(acc["parts"]).alias("parts"))

    def finish(acc):
        return F.concat(F.array_join(acc["parts"], ""), F.substring(F.col(text_col), (acc["at"] + 1).cast("int"), n.cast("int")))

    clean = F.aggregate("_spans", zero, step, finish)
    return d.withColumn(text_col, F.when(F.col("_spans").isNotNull(), clean).otherwise(F.col(text_col))).select(*cols)
