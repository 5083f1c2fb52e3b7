"""Cleaning and merging of messy tables: types, duplicates, conflicts, unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import cell_number, parse_moment
from ..functions.text import clean_spaces, is_empty, norm_key


def infer_types(df: DataFrame, columns: list[str], share: float = 0.6) -> DataFrame:
    """(column, filled, dates, numbers, kind): one pass over all columns.

    A column is of dates if that share of its non-empty cells parses as dates, else of
    numbers likewise, else text. The input is read as strings.
    """
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("cell")) for c in columns])).alias("x")).select("x.*")
    full = ~is_empty(F.col("cell"))
    read = cells.withColumns({"_d": full & parse_moment(F.col("cell"))["at"].isNotNull(), "_n": full & cell_number(F.col("cell")).isNotNull()})
    rows = read.groupBy("column").agg(F.count_if(full).alias("filled"), F.count_if("_d").alias("dates"), F.count_if("_n").alias("numbers"))
    kind = F.when(F.col("filled") == 0, "text").when(F.col("dates") >= F.col("filled") * share, "date").when(F.col("numbers") >= F.col("filled") * share, "number").otherwise("text")
    return rows.withColumn("kind", kind)


def row_key(columns: list[Column]) -> Column:
    """Normalised key of a row; null when all its parts are empty, such rows never match."""
    parts = [F.coalesce(norm_key(c.cast("string")), F.lit("")) for c in columns]
    return F.nullif(F.concat_ws("\u0001", *parts), F.lit("\u0001" * (len(columns) - 1)))


def dedup_fill(df: DataFrame, key: list[str], values: list[str], order: str) -> DataFrame:
    """First row of each key; its empty cells take the first non-empty value of the copies."""
    keyed = df.withColumn("_key", F.coalesce(row_key([F.col(k) for k in key]), F.concat(F.lit("\u0002"), F.col(order).cast("string"))))
    first = [F.min_by(c, order).alias(c) for c in df.columns if c not in values]
    filled = [F.min_by(c, F.when(~is_empty(F.col(c).cast("string")), F.col(order))).alias(c) for c in values]
    return keyed.groupBy("_key").agg(*first, *filled, F.count(F.lit(1)).alias("copies")).drop("_key")


def dedup_conflicts(df: DataFrame, key: list[str], values: list[str], order: str) -> DataFrame:
    """(row, kept_row, column, kept, other): copies whose value differs from the one that stays."""
    keyed = df.withColumn("_key", row_key([F.col(k) for k in key])).filter("_key is not null")
    best = [F.min_by(c, F.when(~is_empty(F.col(c).cast("string")), F.col(order))).cast("string").alias(f"_{c}") for c in values]
    kept = keyed.groupBy("_key").agg(F.min(order).alias("_first"), *best)
    both = keyed.join(kept, "_key").filter(F.col(order) != F.col("_first"))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{c}").alias("kept"), F.col(c).cast("string").alias("other")) for c in values])
    rows = both.select(F.col(order).alias("row"), F.col("_first").alias("kept_row"), F.explode(cells).alias("x")).select("row", "kept_row", "x.*")
    return rows.filter(~is_empty(F.col("other")) & (norm_key(F.col("other")) != norm_key(F.col("kept"))))


def union_tables(tables: list[tuple[str, DataFrame]], names: dict[str, dict[str, str]], order: list[str]) -> DataFrame:
    """Tables renamed to canonical columns and put under one another, with their source.

    Columns come in ``order``, then the others, then ``source``; rows without any value go.
    """
    renamed = [df.withColumnsRenamed(names.get(label, {})).withColumn("source", F.lit(label)) for label, df in tables]
    out = renamed[0]
    for df in renamed[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    rest = [c for c in out.columns if c not in order and c != "source"]
    some = F.lit(False)
    for c in [*order, *rest]:
        some = some | ~is_empty(F.col(c).cast("string"))
    return out.select(*order, *rest, "source").filter(some)


def running_lines(lines: DataFrame, doc: str, page: str, line: str, longest: int = 120) -> DataFrame:
    """(doc, key, pages): lines, digits masked, that repeat on all of 2 to 4 pages or on 60 % of more."""
    key = F.regexp_replace(F.lower(clean_spaces(F.col(line))), "[0-9]+", "#")
    keyed = lines.withColumn("key", key).filter((F.col("key") != "") & (F.length(line) <= longest))
    pages = lines.groupBy(doc).agg(F.count_distinct(page).alias("total"))
    seen = keyed.groupBy(doc, "key").agg(F.count_distinct(page).alias("pages"))
    enough = F.when(F.col("total") <= 4, F.col("pages") >= F.col("total")).otherwise(F.col("pages") * 10 >= F.col("total") * 6)
    return seen.join(pages, doc).filter((F.col("total") >= 2) & enough).select(doc, "key", "pages")


def sections(df: DataFrame, group: str, order: str, cells: list[str]) -> DataFrame:
    """Rows whose only value is in the first cell become a column ``section`` of the rows below."""
    filled = sum((~is_empty(F.col(c))).cast("int") for c in cells)
    alone = (filled == 1) & ~is_empty(F.col(cells[0]))
    above = Window.partitionBy(group).orderBy(order)
    return df.withColumn("_alone", alone).withColumn("section", F.last(F.when(F.col("_alone"), F.col(cells[0])), ignorenulls=True).over(above)).filter("not _alone").drop("_alone")
