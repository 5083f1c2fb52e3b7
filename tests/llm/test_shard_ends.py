"""Quantiles of a dimension come from all of its rows."""

from collections import Counter

from pyspark.sql import functions as F

from granary.llm import sharding


def test_quantiles_are_those_of_all_rows(spark):
    df = spark.range(40_000).select(F.format_string("%06d", (F.col("id") * 7919) % 40_000).alias("text"), ((F.col("id") * 31) % 40_000).alias("n"))
    cells = sharding.quantised(df, [df.text, df.n], 4)
    found = df.select(*[c.alias(f"c{i}") for i, c in enumerate(cells)]).collect()
    for k in (0, 1):
        assert Counter(r[k] for r in found) == {c: 2501 if c == 0 else 2499 if c == 15 else 2500 for c in range(16)}  # an end belongs to the cell below


def test_values_that_many_rows_share_count_as_often(spark):
    # 30 values: the first is half of all rows, and takes the cells up to its end; nulls do not count.
    df = spark.range(5_800).select(F.when(F.col("id") < 2_900, 0).when(F.col("id") < 5_800, F.col("id") % 29 + 1).alias("x")).unionByName(spark.range(500).select(F.lit(None).cast("int").alias("x")))
    values = sorted([0] * 2_900 + [i % 29 + 1 for i in range(2_900, 5_800)])
    wanted = sorted({values[k * len(values) // 16] for k in range(1, 16)})
    got = {(r.x, r.c) for r in df.select("x", sharding.quantised(df, [df.x], 4)[0].alias("c")).distinct().collect()}
    assert got == {(x, sum(e < x for e in wanted)) for x in set(values)} | {(None, 0)}
