"""Snapshots of keyed items and the changes between two of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranges import numbered

TOLERANCE = 0.005


def item_key(parts: list[Column], url: Column) -> Column:
    """Key parts joined by `` | ``; the url where any part is empty."""
    texts = [F.trim(p.cast("string")) for p in parts]
    empty = F.lit(False)
    for p in parts:
        empty = empty | p.isNull() | (p.cast("string") == "")
    return F.when(empty, F.coalesce(url, F.lit(""))).otherwise(F.concat_ws(" | ", *texts))


def same_number(a: Column, b: Column) -> Column:
    """Equal within 0.005, or both null."""
    return F.coalesce(F.abs(a - b) <= TOLERANCE, a.isNull() & b.isNull())


def changes(previous: DataFrame, current: DataFrame, key: str, price: str, title: str, url: str, tracked: list[str], complete: bool = True, guard: float = 0.5) -> DataFrame:
    """Change feed (kind, key, title, field, old, new, pct, url).

    One full outer join on the key. Numbers are equal within 0.005, other values when
    they match or are both null. ``gone`` is left out when the current run is incomplete
    or holds fewer than ``guard`` times the items of the previous one.
    """
    fields = [price, title, url, *tracked]
    old = previous.select(F.col(key).alias("_k"), *[F.col(c).alias(f"o_{c}") for c in dict.fromkeys(fields)])
    new = current.select(F.col(key).alias("_n"), *[F.col(c).alias(f"n_{c}") for c in dict.fromkeys(fields)])
    counts = previous.agg(F.count(F.lit(1)).alias("_before")).crossJoin(current.agg(F.count(F.lit(1)).alias("_now")))  # one row
    both = old.join(new, F.col("_k") == F.col("_n"), "full_outer").crossJoin(F.broadcast(counts))
    added, gone = F.col("_k").isNull(), F.col("_n").isNull()
    trusted = F.lit(complete) & (F.col("_now") >= F.col("_before") * guard)
    o, n = F.col(f"o_{price}").cast("double"), F.col(f"n_{price}").cast("double")
    percent = F.when(o.isNotNull() & (o != 0), F.bround((n - o) / o * 100, 1))

    def entry(when: Column, kind: str, field, before, after, pct=None) -> Column:
        row = F.struct(F.lit(kind).alias("kind"), F.lit(field).alias("field"), before.cast("string").alias("old"), after.cast("string").alias("new"), (F.lit(None) if pct is None else pct).cast("double").alias("pct"))
        return F.when(when, row)

    none = F.lit(None)
    entries = [
        entry(added, "new", "", none, none),
        entry(gone & trusted, "gone", "", none, none),
        entry(~added & ~gone & ~same_number(o, n), "price", price, o, n, percent),
        *[entry(~added & ~gone & ~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}")), "field", c, F.col(f"o_{c}"), F.col(f"n_{c}")) for c in tracked],
    ]
    rows = both.withColumn("e", F.explode(F.filter(F.array(*entries), lambda x: x.isNotNull())))
    return rows.select("e.kind", F.coalesce("_n", "_k").alias("key"), F.coalesce(f"n_{title}", f"o_{title}").alias("title"), "e.field", "e.old", "e.new", "e.pct", F.coalesce(f"n_{url}", f"o_{url}").alias("url"))


def largest_first(feed: DataFrame) -> DataFrame:
    """Price changes with their place by size, then key; undefined percentages come first."""
    size = F.abs("pct")
    # Nulls come first in an ascending order, and so does the largest negated size.
    return numbered(feed.filter("kind = 'price'"), [-size, F.col("key")], "place")


def latest_run(runs: DataFrame, config: str, run_id: str, complete: str) -> DataFrame:
    """Per config the newest complete run, or the newest where none is complete."""
    best = F.max_by(F.struct(F.col(run_id).alias("run_id"), F.col(complete).alias("complete")), F.struct(F.col(complete), F.col(run_id)))
    return runs.groupBy(config).agg(best.alias("_b")).select(config, "_b.run_id", "_b.complete")


def prune_runs(runs: DataFrame, config: str, run_id: str, keep: int) -> DataFrame:
    """Runs that stay: the newest ``keep`` of each config."""
    order = Window.partitionBy(config).orderBy(F.desc(run_id))
    return runs.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= keep).drop("_n")


def accept_items(items: DataFrame, required: list[str], key: Column, order: str) -> DataFrame:
    """Items with all required fields, the first of each key."""
    for c in required:
        items = items.filter(F.col(c).isNotNull() & (F.col(c).cast("string") != ""))
    by_key = Window.partitionBy("_key").orderBy(order)
    return items.withColumn("_key", key).withColumn("_n", F.row_number().over(by_key)).filter("_n = 1").drop("_n", "_key")


def fill_stats(items: DataFrame) -> DataFrame:
    """(column, filled): non-empty values of every column, in one pass."""
    counts = items.agg(*[F.count_if(F.col(c).isNotNull() & (F.col(c).cast("string") != "")).alias(c) for c in items.columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("filled")) for c in items.columns])).alias("x")).select("x.*")


def join_details(items: DataFrame, details: DataFrame, url: str, fields: list[str]) -> DataFrame:
    """List rows completed from their detail page; a non-empty detail value wins."""
    named = details.select(F.col(url).alias("_u"), *[F.col(c).alias(f"_d_{c}") for c in fields])
    out = items.join(named, F.col(url) == F.col("_u"), "left")
    return out.withColumns({c: F.coalesce(F.nullif(F.col(f"_d_{c}"), F.lit("")), F.col(c)) for c in fields}).drop("_u", *[f"_d_{c}" for c in fields])


def save_run(items: DataFrame, path: str, config: str, run_id: int) -> None:
    """The items of one run as JSON text (config, run_id, item_key, data), in a folder of its own: writing again replaces it."""
    data = F.to_json(F.struct(*[c for c in items.columns if c != "item_key"]), {"ignoreNullFields": "false"})
    items.select("item_key", data.alias("data")).write.mode("overwrite").parquet(f"{path}/config={config}/run_id={run_id}")


def load_run(spark, path: str, config: str, run_id: int, schema: str) -> DataFrame:
    """The items of a stored run, with the columns of ``schema``."""
    stored = spark.read.parquet(path).filter((F.col("config") == config) & (F.col("run_id") == run_id))
    return stored.select("item_key", F.from_json("data", schema).alias("d")).select("item_key", "d.*")


def list_runs(runs: DataFrame, config: str, run_id: str, k: int = 20) -> DataFrame:
    """The ``k`` newest runs of each config, with their place from 1."""
    order = Window.partitionBy(config).orderBy(F.desc(run_id))
    return runs.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def sync_by_content(previous: DataFrame, current: DataFrame, key: str, text: str) -> DataFrame:
    """(key, state, sha256): added, updated, unchanged or removed documents by the hash of their text.

    ``previous`` holds key and sha256; only added and updated documents need work again.
    """
    now = current.select(F.col(key).alias("_n"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("_hash"))
    both = previous.select(F.col(key).alias("_k"), F.col("sha256").alias("_old")).join(now, F.col("_k") == F.col("_n"), "full_outer")
    state = F.when(F.col("_k").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_old") == F.col("_hash"), "unchanged").otherwise("updated")
    return both.select(F.coalesce("_n", "_k").alias(key), state.alias("state"), F.col("_hash").alias("sha256"))


def change_lines(feed: DataFrame) -> DataFrame:
    """(kind, key, line): the change feed as lines of a report."""
    percent = F.when(F.col("pct").isNotNull(), F.concat(F.lit(" ("), F.format_string("%+.1f", "pct"), F.lit(" %)"))).otherwise("")
    moved = F.concat(F.lit(": "), F.coalesce("old", F.lit("-")), F.lit(" -> "), F.coalesce("new", F.lit("-")))
    line = F.concat(F.lit("- "), F.coalesce("title", F.col("key").cast("string")), F.when(F.col("kind") == "price", F.concat(moved, percent)).when(F.col("kind") == "field", F.concat(F.lit(", "), F.col("field"), moved)).otherwise(""))
    return feed.select("kind", "key", line.alias("line"))
