"""Temperature mixing of sources (operator 1).

A source with token share ``p`` gets weight ``p**a / sum(p**a)``. The exponent
``a`` is bisected between 0 (all sources equal) and 1 (the natural shares) so that
the mixture reaches a target entropy, or as close to it as the repetition limit
allows. Weights become whole token budgets, and each budget is realised as passes
over the source: a pass is a permutation of blocks, each block a permutation of
its documents, and the last pass is the prefix of its permutation that fits.

Every decision on a document compares hashes with one row of its source, so the
texts are never shuffled and a source that holds a third of the corpus is no
special case. Where the last pass of a source ends is found by descent: sums over
ranges of block keys, over the blocks of one range, over the rows of one block.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, new_folder, spread_join, text_of, word_count

# Production parameters of the registered query and the pipeline stage.
TARGET_ENTROPY = 0.95  # of ln(number of sources)
MAX_REPEATS = 4.0  # passes over a source
BLOCK_ROWS = 1024  # expected documents of a block
BROADCAST_SOURCES = 100_000  # bound of the tables of sources that are broadcast or collected; more are joined by key
SEED = 17
ADDED = ("mix_tokens", "mix_weight", "mix_budget", "mix_pass", "mix_block", "mix_row", "mix_pos")

# sum of t**a and of t**a * ln(t) over the token shares t of all sources, for each of some exponents a.
Sums = Callable[[list[float]], list[tuple[float, float]]]


def entropy(exponent: float, sums: tuple[float, float]) -> float:
    """Entropy of the weights: ln(S) - a * L / S for the sums S and L."""
    return math.log(sums[0]) - exponent * sums[1] / sums[0]


def boundary(ok: Callable[[float, tuple[float, float]], bool], sums: Sums, rounds: int = 10, ways: int = 16) -> tuple[float, float]:
    """Neighbouring exponents around the place in [0, 1] where ``ok`` changes from true to false.

    Bisection with ``ways`` trial exponents a round, as each round may be a pass over
    the table of sources.
    """
    low, high = 0.0, 1.0
    for _ in range(rounds):
        trials = [low + (high - low) * k / (ways + 1) for k in range(1, ways + 1)]
        good = [ok(a, s) for a, s in zip(trials, sums(trials), strict=True)]
        first = good.index(False) if False in good else ways
        low, high = ([low, *trials][first], [*trials, high][first])
    return low, high


def choose_exponent(sources: int, least: float, most: float, sums: Sums, target_entropy: float | None, max_repeats: float | None, volume: float | None) -> float:
    """The largest exponent in [0, 1] that meets the entropy target, raised to meet the limit.

    ``least`` and ``most`` are the smallest and largest share; ``volume`` is the budget over
    all tokens, or None for the volume at which the least repeated source is seen once.
    Entropy and the passes over the smallest source fall as the exponent grows, so each
    condition cuts the interval at one point. The repetition limit wins.
    """
    if sources < 2:
        return 1.0

    def passes(a: float, s: tuple[float, float]) -> float:
        return (most / least) ** (1 - a) if volume is None else least ** (a - 1) / s[0] * volume

    chosen = 1.0
    if target_entropy is not None:
        goal = target_entropy * math.log(sources)
        if entropy(1.0, sums([1.0])[0]) < goal:
            chosen = boundary(lambda a, s: entropy(a, s) >= goal, sums)[0]
    if max_repeats is not None and passes(chosen, sums([chosen])[0]) > max_repeats:
        chosen = boundary(lambda a, s: passes(a, s) > max_repeats, sums)[1]
    return chosen


def _hash(*cols: Column) -> Column:
    """A hash in [0, 2**62), so that sums and comparisons never overflow."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 2)


def named_source(source: Column) -> Column:
    """A source as a join key: null is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def block_key(seed: int, source: Column, ident: Column, mix_pass: Column, blocks: Column) -> Column:
    """Place of the block of a document in the permutation of one pass over its source."""
    block = F.pmod(_hash(F.lit(seed), mix_pass, ident), blocks)
    return _hash(F.lit(seed + 1), mix_pass, source, block)


def row_key(seed: int, ident: Column, mix_pass: Column) -> Column:
    """Place of a document in its block in one pass."""
    return _hash(F.lit(seed + 2), mix_pass, ident)


def plan_sources(slim: DataFrame, target_entropy: float | None = TARGET_ENTROPY, max_repeats: float | None = MAX_REPEATS, budget: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(src, tokens, weight, budget, passes, rest, blocks) of the sources of ``slim`` (src, n).

    ``passes`` whole passes and ``rest`` tokens of the last one make up the budget.
    Without a budget, the total is the one at which the least repeated source is seen
    exactly once: no document is left out. A budget so large that even natural shares
    would exceed the repetition limit is lowered to what the limit allows.
    """
    totals = cut(slim.groupBy("src").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("tokens")))
    whole = totals.agg(F.count(F.lit(1)).alias("sources"), F.sum("tokens").alias("all"), F.min("tokens").alias("least"), F.max("tokens").alias("most")).first()
    share = F.col("tokens") / F.lit(float(whole["all"] or 1))
    if whole.sources <= BROADCAST_SOURCES:
        shares = [r[0] for r in totals.select(share).collect()]

        def sums(trials: list[float]) -> list[tuple[float, float]]:
            return [(math.fsum(t**a for t in shares), math.fsum(t**a * math.log(t) for t in shares)) for a in trials]
    else:

        def sums(trials: list[float]) -> list[tuple[float, float]]:
            row = totals.agg(*[f for a in trials for f in (F.sum(F.pow(share, F.lit(a))), F.sum(F.pow(share, F.lit(a)) * F.log(share)))]).first()
            return list(zip(row[::2], row[1::2], strict=True))

    if not whole.sources:
        exponent, scale, total = 1.0, 1.0, 0.0
    else:
        least, most = whole.least / whole["all"], whole.most / whole["all"]
        volume = None if budget is None else budget / whole["all"]
        exponent = choose_exponent(whole.sources, least, most, sums, target_entropy, max_repeats, volume)
        scale = sums([exponent])[0][0]
        total = most ** (1 - exponent) * scale * whole["all"] if budget is None else float(budget)
        if max_repeats is not None:
            top = least ** (exponent - 1) / scale * total / whole["all"]
            total *= min(1.0, max_repeats / top) if budget is not None and top > 0 else 1.0
    weight = F.pow(share, F.lit(exponent)) / F.lit(scale)
    granted = F.greatest(F.lit(0), F.bround(weight * F.lit(total)).cast("long"))
    granted = F.greatest(granted, F.col("tokens")) if budget is None else granted
    plan = totals.select("src", "rows", "tokens", weight.alias("weight"), granted.cast("long").alias("budget"))
    return plan.select("src", "tokens", "weight", "budget", F.floor(F.expr("budget div tokens")).cast("long").alias("passes"), (F.col("budget") % F.col("tokens")).alias("rest"), F.greatest(F.lit(1), F.ceil(F.col("rows") / block_rows)).cast("long").alias("blocks"))


def _last_places(partial: DataFrame) -> DataFrame:
    """(src, last, stop): the block and the row key in it at which the last pass of each source ends.

    ``partial`` (src, n, rest, mix_block, mix_row) has a row for each document in the
    last pass. Each level sums tokens over the children of one node, so no task orders
    more than 4096 ranges, the blocks of a range, or the rows of a block of one source.
    """

    def ends_in(df: DataFrame, by: str, left: str) -> DataFrame:
        """For each source the ``by`` in which ``left`` tokens end, and the tokens left there."""
        sums = df.groupBy("src", by).agg(F.sum("n").alias("sum"), F.first(left).alias("left"))
        order = Window.partitionBy("src").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
        found = sums.withColumn("end", F.sum("sum").over(order)).filter("end > left and end - sum <= left")
        return found.select("src", by, (F.col("left") - F.col("end") + F.col("sum")).alias("inner"))

    # 2**62 keys in 4096 ranges.
    ranged = partial.withColumn("range", F.shiftrightunsigned("mix_block", 50))
    in_range = ranged.join(ends_in(ranged, "range", "rest"), ["src", "range"])
    blocks = in_range.join(ends_in(in_range, "mix_block", "inner").withColumnRenamed("inner", "held"), ["src", "mix_block"])
    upto = Window.partitionBy("src").orderBy("mix_row", "n").rowsBetween(Window.unboundedPreceding, 0)
    fits = blocks.withColumn("end", F.sum("n").over(upto))
    stop = F.min(F.when(F.col("end") > F.col("held"), F.col("mix_row")))
    return fits.groupBy("src").agg(F.coalesce(stop, F.lit(-1).cast("long")).alias("stop"), F.first("mix_block").alias("last"))


def mix(df: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", target_entropy: float | None = TARGET_ENTROPY, max_repeats: float | None = MAX_REPEATS, budget: int | None = None, block_rows: int = BLOCK_ROWS, seed: int = SEED) -> DataFrame:
    """Every row of ``df`` once for each pass that takes it, with all its columns.

    Adds ``mix_tokens`` (words and one end mark, so an empty or null text counts 1),
    ``mix_weight``, ``mix_budget``, ``mix_pass`` (from 0), ``mix_block`` (key of the
    block in its pass), ``mix_row`` (key in the block) and ``mix_pos`` (0 to 1). Sorted
    by (mix_pos, mix_row) the result is a stream whose prefixes hold the sources in
    proportion to their weights, block by block.

    ``max_repeats`` bounds the passes over every source, whatever the budget. A null
    source is a source of its own. Repeated rows count as rows; equal rows share their
    keys. An empty table gives an empty result. Columns of ``df`` with the added names
    are replaced, all others stay as they are, whatever their names.
    """
    spark = df.sparkSession
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    whole = df.select(row, named_source(F.col(source_col)).alias("src"), F.col(id_col).alias("id"), (word_count(text_of(text_col)) + 1).alias("n"))
    slim = cut(whole.select("src", "id", "n"), new_folder(spark, "mix"))
    plan = cut(plan_sources(slim, target_entropy, max_repeats, budget, block_rows))
    small = plan.count() <= BROADCAST_SOURCES

    def planned(rows: DataFrame, table: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(table), "src") if small else spread_join(rows, table, "src", F.col("id"))

    def keyed(rows: DataFrame) -> DataFrame:
        block = block_key(seed, F.col("src"), F.col("id"), F.col("mix_pass"), F.col("blocks"))
        return rows.withColumns({"mix_block": block, "mix_row": row_key(seed, F.col("id"), F.col("mix_pass"))})

    ends = _last_places(keyed(planned(slim, plan.filter("rest > 0")).withColumn("mix_pass", F.col("passes"))))
    bounded = cut(plan.join(ends, "src", "left"))
    last_pass = F.when(F.col("rest") > 0, F.col("passes")).otherwise(F.col("passes") - 1)
    passes = F.when(last_pass >= 0, F.sequence(F.lit(0).cast("long"), last_pass)).otherwise(F.array().cast("array<long>"))
    out = keyed(planned(whole, bounded).withColumn("mix_pass", F.explode(passes)))
    taken = (F.col("mix_block") < F.col("last")) | ((F.col("mix_block") == F.col("last")) & (F.col("mix_row") < F.col("stop")))
    out = out.filter((F.col("mix_pass") < F.col("passes")) | taken)
    out = out.withColumn("mix_pos", (F.col("mix_pass") + F.col("mix_block") / F.lit(2.0**62)) / (F.col("budget") / F.col("tokens")))
    kept = [F.col("row")[c].alias(c) for c in df.columns if c not in ADDED]
    return out.select(*kept, F.col("n").alias("mix_tokens"), F.col("weight").alias("mix_weight"), F.col("budget").alias("mix_budget"), "mix_pass", "mix_block", "mix_row", "mix_pos")
