"""Sharding along a Hilbert curve (operator 5).

Several metadata dimensions are quantised to a few bits each, in order; the Hilbert index of
the cell orders the rows, and the order is cut into runs of equal count. Rows near
each other in every dimension land in the same few shards, so files can be pruned
by the smallest and largest value of any of the dimensions.

The exact position of a row is the count of rows in earlier cells (a table of at
most 2**(dimensions * bits) rows), in earlier blocks of its cell, and before it in
its block; blocks are cut by a hash, so that one crowded cell is spread over tasks.
Only counts by block are gathered by cell: four for each partition at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut, partitions, text_of

SHARDS = 16
BITS = 4  # per dimension, at least; more for more shards
ADDED = ("size", "text_crc32", "law", "hilbert", "shard", "slot")


def _ends(values: DataFrame, bits: int) -> list:
    """Values that cut all rows of ``values`` (one column, x), in its order, into runs of about equal
    count; where there are few different ones, each is a run of its own. Nulls are left out.

    Different values are counted, dealt over ranges and stored. A row for each partition gives the
    counts before its range, so a value knows its places among all rows; at most 2**bits ends are gathered.
    """
    spark = values.sparkSession
    counts = cut(values.filter("x is not null").groupBy("x").agg(F.count(F.lit(1)).alias("n")))
    few = sorted((r["x"] for r in counts.limit(2**bits + 1).collect()), key=lambda x: x.encode() if isinstance(x, str) else (x != x, x))
    if len(few) <= 2**bits:
        return few[:-1]
    # Where the ranges are cut decides only how the values are dealt.
    ranged = cut(counts.repartitionByRange(partitions(spark), "x").withColumn("range", F.spark_partition_id()))
    starts, total = [], 0
    for r in ranged.groupBy("range").agg(F.sum("n").alias("n")).orderBy("range").collect():  # a row for each partition
        starts.append((r["range"], total))
        total += r["n"]
    known = F.broadcast(spark.createDataFrame(starts, "range int, start long"))
    upto = Window.partitionBy("range").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumn("upto", F.sum("n").over(upto)).join(known, "range").select("x", (F.col("start") + F.col("upto") - F.col("n")).alias("first"), (F.col("start") + F.col("upto")).alias("after"))
    # Whole-number arithmetic: how many of the places k * total / 2**bits, k from 1, lie before a place.
    passed = lambda c: F.expr(f"({c} * {2**bits}L - 1) div {total}L")
    return [r["x"] for r in placed.filter(passed("after") > passed("first")).orderBy("x").select("x").collect()]


def quantised(df: DataFrame, dimensions: list[Column], bits: int) -> list[Column]:
    """Each dimension as a cell from 0 to 2**bits - 1: the number of its quantiles that a
    value exceeds. Order is kept, so a range of cells is a range of values; null is cell 0.

    The quantiles are those of all rows: numbers in their order, strings in that of their bytes.
    """
    kinds = [f.dataType for f in df.select(*[d.alias(f"d{i}") for i, d in enumerate(dimensions)]).schema]

    def cell(d: Column, kind: T.DataType) -> Column:
        d, name = (d, "string") if isinstance(kind, T.StringType) else (d.cast("double"), "double")
        ends = F.array(*[F.lit(x) for x in _ends(df.select(d.alias("x")), bits)]).cast(f"array<{name}>")
        return F.coalesce(F.size(F.filter(ends, lambda q: q < d)), F.lit(0))

    return [cell(d, kind) for d, kind in zip(dimensions, kinds, strict=True)]


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """Index along the Hilbert curve of a point with ``bits`` bits in each dimension.

    From the top bit down, the bit of a dimension either inverts the lower bits of
    the first dimension or swaps them with its own; the Gray code of the result,
    bits interleaved, is the index (Skilling, 2004).
    """
    n = len(cells)

    # The working values are fields of nested structs, so that each step is computed once.
    names = [f"x{i}" for i in range(n)]
    state = F.struct(*[c.cast("int").alias(k) for c, k in zip(cells, names, strict=True)])

    def once(state: Column, change) -> Column:
        return F.get(F.transform(F.array(state), lambda s: F.struct(*[v.alias(k) for k, v in zip(names, change([s[k] for k in names]), strict=True)])), F.lit(0))

    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):

            def change(x, i=i, p=p, q=q):
                on = x[i].bitwiseAND(F.lit(q)) != 0
                swap = x[0].bitwiseXOR(x[i]).bitwiseAND(F.lit(p)) if i else F.lit(0)
                out = list(x)
                out[0] = F.when(on, x[0].bitwiseXOR(F.lit(p))).otherwise(x[0].bitwiseXOR(swap))
                if i:
                    out[i] = F.when(on, x[i]).otherwise(x[i].bitwiseXOR(swap))
                return out

            state = once(state, change)
        q >>= 1
    for i in range(1, n):
        state = once(state, lambda x, i=i: [x[j].bitwiseXOR(x[i - 1]) if j == i else x[j] for j in range(n)])

    def gray(x):
        t = F.lit(0)
        q = 1 << (bits - 1)
        while q > 1:
            t = F.when(x[n - 1].bitwiseAND(F.lit(q)) != 0, t.bitwiseXOR(F.lit(q - 1))).otherwise(t)
            q >>= 1
        return [v.bitwiseXOR(t) for v in x]

    state = once(state, gray)
    out = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for k in names:
            out = F.shiftleft(out, 1).bitwiseOR(F.shiftright(state[k], b).bitwiseAND(F.lit(1)).cast("long"))
    return out


def shard(df: DataFrame, dimensions: list[Column] | None = None, shards: int = SHARDS, bits: int | None = None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """All rows of ``df``, its columns (or those in ``keep``), and their shard.

    Adds ``size`` (UTF-8 bytes of the text, null none, plus 1), ``text_crc32``
    (unsigned), ``law`` ("rows": shard counts differ by one at most), ``hilbert`` (index
    of the cell), ``shard`` and ``slot`` (gapless from 0 in the shard). Dimensions are
    numbers or strings, by default source, language and size, and are quantised by the
    quantiles of all rows; ``bits`` grows with the shards, to some 64 cells or more for each.

    A null dimension is cell 0; a missing text is empty. Ties in a cell are ordered by
    a hash of the identifier, then size and checksum; repeated rows get neighbouring
    slots. With fewer rows than shards some shards stay empty, with no rows the result
    is empty. Columns of ``df`` with the added names are replaced, all others stay.
    """
    spark = df.sparkSession
    columns = [c for c in (df.columns if keep is None else keep) if c not in ADDED]
    size = (F.octet_length(text_of(text_col)) + 1).cast("long")
    count = 3 if dimensions is None else len(dimensions)
    bits = bits or max(BITS, min(62 // count, -(-(shards.bit_length() + 6) // count)))
    dims = quantised(df, [F.col("source").cast("string"), F.col("lang").cast("string"), size] if dimensions is None else dimensions, bits)
    key = F.shiftrightunsigned(F.xxhash64(F.lit("shard"), F.col(id_col)), 2)
    row = F.struct(*[F.col(f"`{c}`") for c in columns]) if columns else F.lit(None)
    rows = df.select(row.alias("row"), size.alias("size"), F.crc32(text_of(text_col)).alias("text_crc32"), hilbert_index(dims, bits).alias("hilbert"), key.alias("key"))
    blocks = 4 * partitions(spark)
    rows = rows.withColumn("block", F.floor(F.col("key") / F.lit(2.0**62) * blocks).cast("int"))

    counts = cut(rows.groupBy("hilbert", "block").agg(F.count(F.lit(1)).alias("n")))
    cells = counts.groupBy("hilbert").agg(F.sum("n").alias("n"))  # at most 2 ** (dimensions * bits) rows
    before = Window.orderBy("hilbert").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("hilbert").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cells = cells.select("hilbert", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"), F.sum("n").over(whole).alias("total"))
    in_cell = Window.partitionBy("hilbert").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("inner", F.coalesce(F.sum("n").over(in_cell), F.lit(0))).drop("n")
    starts = starts.join(cells, "hilbert").select("hilbert", "block", (F.col("earlier") + F.col("inner")).alias("start"), "total")

    inside = Window.partitionBy("hilbert", "block").orderBy("key", "size", "text_crc32")
    placed = rows.withColumn("at", F.row_number().over(inside) - 1).join(starts, ["hilbert", "block"]).withColumn("place", F.col("start") + F.col("at"))
    # Whole-number arithmetic: shard s begins at ceil(s * total / shards).
    number = F.expr(f"(place * {shards}) div total")
    first = F.expr(f"(({shards} - 1) + ((place * {shards}) div total) * total) div {shards}")
    kept = [F.col("row")[c].alias(c) for c in columns]
    return placed.select(*kept, "size", "text_crc32", F.lit("rows").alias("law"), "hilbert", number.cast("int").alias("shard"), (F.col("place") - first).cast("long").alias("slot"))


def write_shards(df: DataFrame, path: str, **options) -> None:
    """The sharded rows as Parquet, one folder a shard, in curve order inside it.

    The smallest and largest value of each dimension that Parquet keeps for a file let
    a reader with a filter on one of them skip most files.
    """
    out = shard(df, **options)
    out.repartitionByRange("shard", "hilbert", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
