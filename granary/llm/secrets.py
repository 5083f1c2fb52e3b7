"""Incremental secret scan over a blob ledger (operator 2).

A version is one state of a path; its text is a blob with its SHA-256 as address.
The ledger is a folder of two tables: the (blob, rule, rule version) pairs scanned so
far, and the findings by blob. A run reads it, scans every distinct blob once and only
for pairs that the ledger lacks, and appends what is new; a report joins the findings
of the current rule versions back to every version of every path that has the blob.

All of it is DataFrame work: a rule is a regular expression, its matches and the
gaps between them give the spans, in code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, exists, spread_join, text_of


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds candidates, left to right and without overlap; those whose
    group ``group`` (0: all) has fewer than ``least`` characters are dropped."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int


def any_case(word: str) -> str:
    """Letters of ``word`` as classes of both cases (ASCII only, in any regex dialect)."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join([any_case("password"), any_case("passwd"), any_case("secret"), any_case("token"), any_case("api") + "_?" + any_case("key")])
# The first three are the base; the order of the list breaks ties between equal starts.
RULES = (
    Rule("assign", 1, f"({_KEYWORDS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", 1, "AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", 1, "[0-9a-f]{16,}", 0, 16),
    Rule("pem", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("github", 1, "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    Rule("slack", 1, "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    Rule("google", 1, "AIza[A-Za-z0-9_-]{35}", 0, 1),
    Rule("jwt", 1, "eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}", 0, 1),
)
BASE = ("assign", "access", "hex")


def _pairs(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    rows = [F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules]
    return blobs.withColumn("_rule", F.explode(F.array(*rows))).select("blob", "_rule.kind", "_rule.version")


def unseen(blobs: DataFrame, rules: tuple[Rule, ...], ledger: DataFrame | None) -> DataFrame:
    """blob and the array ``todo`` of rule kinds that the ledger has no scan of."""
    if ledger is None:
        return blobs.select("blob").withColumn("todo", F.array(*[F.lit(r.kind) for r in rules]))
    seen = ledger.select("blob", "kind", "version").distinct()
    return _pairs(blobs, rules).join(seen, ["blob", "kind", "version"], "left_anti").groupBy("blob").agg(F.collect_set("kind").alias("todo"))


def scan(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings (blob, kind, version, start, end) of texts (blob, text, todo)."""
    found = []
    for r in rules:
        due = F.array_contains("todo", r.kind) & F.col("text").rlike(r.pattern)
        cut = F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)).alias("match"), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)).alias("value"), F.split("text", r.pattern, -1).alias("gap"))
        found.append(F.when(due, cut))
    least = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.least)])
    hits = texts.withColumn("_hit", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull()))).select("blob", "_hit.*")
    rows = hits.select("blob", "kind", "version", F.posexplode(F.arrays_zip("match", "value", "gap")).alias("at", "m")).filter("m.match is not null")
    rows = rows.select("blob", "kind", "version", "at", (F.length("m.gap") + F.length("m.match")).alias("step"), F.length("m.match").alias("size"), F.length("m.value").alias("held"))
    # A blob that comes in several rows has each hit several times; one of them counts. The window needs no further exchange.
    rows = rows.repartition("blob", "kind").dropDuplicates(["blob", "kind", "at"])
    upto = Window.partitionBy("blob", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum("step").over(upto)).withColumn("start", F.col("end") - F.col("size"))
    return rows.filter(F.col("held") >= F.element_at(least, F.col("kind"))).select("blob", "kind", "version", "start", "end")


def scan_versions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """New findings by blob, and the ledger rows (blob, kind, version) of this run.

    Equal texts are one blob and are scanned once, or as often as the first identifier
    repeats; such hits count once. A null text counts as empty; an
    empty blob has no findings but is entered in the ledger. Repeated rows change
    nothing. Long texts are scanned whole. An empty table gives empty results.
    """
    named = df.select(F.col(id_col).alias("_id"), text_of(text_col).alias("text")).withColumn("blob", F.sha2("text", 256))
    # One row stands for each blob: the smallest identifier; counts combine in the map tasks.
    chosen = cut(named.groupBy("blob").agg(F.min("_id").alias("_id")))
    due = chosen.join(unseen(chosen, rules, ledger), "blob") if ledger is not None else chosen.withColumn("todo", F.array(*[F.lit(r.kind) for r in rules]))
    due = due.select(F.col("blob").alias("_blob"), F.col("_id").alias("_first"), "todo")
    texts = named.join(due.hint("shuffle_hash"), (F.col("blob") == F.col("_blob")) & F.col("_id").eqNullSafe(F.col("_first"))).select("blob", "text", "todo")
    entries = _pairs(chosen, rules)
    if ledger is not None:
        entries = entries.join(ledger.select("blob", "kind", "version").distinct(), ["blob", "kind", "version"], "left_anti")
    return scan(texts, rules).dropDuplicates(), entries


def read_ledger(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(entries, findings) of a ledger; both empty where there is none yet."""
    entries, findings = "blob string, kind string, version int", "blob string, kind string, version int, start long, end long"
    table = lambda name, schema: spark.read.schema(schema).parquet(f"{folder}/{name}") if exists(spark, f"{folder}/{name}") else spark.createDataFrame([], schema)
    return table("entries", entries), table("findings", findings).dropDuplicates()


def update_ledger(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans what the ledger in ``folder`` has not seen, appends it there, and gives all findings.

    Findings are written before the entries that vouch for them: a run that is lost in
    between is done again and repeats findings, which count once.
    """
    spark = df.sparkSession
    known, _ = read_ledger(spark, folder)
    findings, entries = scan_versions(df, id_col, text_col, rules, known if exists(spark, f"{folder}/entries") else None)
    findings.write.mode("append").parquet(f"{folder}/findings")
    entries.write.mode("append").parquet(f"{folder}/entries")
    return read_ledger(spark, folder)[1]


def _listed(kinds: tuple[str, ...], rules: tuple[Rule, ...]) -> Column:
    """``kind:start:end`` of spans (start, rank, end) of the named kinds, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    kept = F.filter("spans", lambda s: F.get(names, s["rank"]).isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(df: DataFrame, findings: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for every version, with its path or other columns in ``keep``: the findings
    of the current version of each rule, joined back by blob.

    The counts are those of the base kinds; findings of other rule versions, or of rules
    that are not in ``rules``, are left out.
    """
    rank = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    current = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.version)])
    now = findings.filter(F.try_element_at(current, F.col("kind")) == F.col("version"))
    by_blob = now.groupBy("blob").agg(F.sort_array(F.collect_set(F.struct("start", F.element_at(rank, F.col("kind")).alias("rank"), "end"))).alias("spans"))
    carried = F.struct(*[F.col(f"`{c}`") for c in dict.fromkeys([id_col, *keep])]).alias("row")
    versions = cut(df.select(carried, F.sha2(text_of(text_col), 256).alias("blob")))
    out = spread_join(versions, by_blob, "blob", F.col("row"), "left")
    out = out.withColumn("spans", F.coalesce("spans", F.expr("array()").cast("array<struct<start:long,rank:int,end:long>>")))
    place = {r.kind: i for i, r in enumerate(rules)}
    count = lambda kind: F.size(F.filter("spans", lambda s: s["rank"] == place.get(kind, -1))).cast("long")
    return out.select("row.*", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(_listed(BASE, rules), 256).alias("base_sha256"), _listed(tuple(r.kind for r in rules), rules).alias("spans"), "blob")
