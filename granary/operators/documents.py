"""Documents filled from the rows of a table: texts, names of their own, and what was empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, wording
from .ranges import numbered

NUMBER = "№"


def fill_documents(rows: DataFrame, template: str, order: list[str], name_pattern: str = "{{№}}", allow_missing: bool = False) -> DataFrame:
    """(number, name, text, problems) of a document for each row that is not empty in all columns.

    ``order`` gives the rows their numbers, counting empty ones; ``{{№}}`` stands for the number.
    ``problems`` lists the marks of template and name that found an empty cell, or one that
    their format cannot read, which stays as it is. Names are fit for files and differ
    whatever their case: a repeated one gets ``_2``, ``_3`` by number; where that is taken it
    gets its number as well. An unknown format, a template without marks, and, unless
    ``allow_missing``, a mark without a column are errors before anything runs.
    """
    if not wording.marks(template):
        raise ValueError("the template has no marks like {{name}}")
    cells = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != NUMBER])
    filled = numbered(cells, [F.col(f"`{c}`") for c in order], NUMBER)
    columns = filled.columns
    body, faults = wording.fill_template(template, columns)
    name, name_faults = wording.fill_template(name_pattern, columns)
    problems = wording.unfilled(template + name_pattern, columns)
    unknown = [m for m in wording.marks(template + name_pattern) if m[1] and m[1].lower() not in wording.FORMATS]
    if unknown:
        raise ValueError(f"unknown formats: {', '.join(m[1] for m in unknown)}")
    if (faults or name_faults) and not allow_missing:
        raise ValueError(f"no columns for: {', '.join(dict.fromkeys([*faults, *name_faults]))}")
    empty: Column = F.lit(True)
    for c in cells.columns:
        empty = empty & F.coalesce(text.is_empty(F.col(f"`{c}`").cast("string")), F.lit(True))
    made = filled.filter(~empty).select(F.col(NUMBER).alias("number"), text.file_name(name).alias("base"), body.alias("text"), problems.alias("problems"))
    placed = numbered(made.withColumn("key", F.lower("base")), [F.col("key"), F.col("number")], "place")
    # One row for each name that repeats; the rows of a name may be many, so they are not gathered.
    first = placed.groupBy("key").agg(F.min("place").alias("first"))
    turn = placed.join(first, "key").withColumn("k", F.col("place") - F.col("first") + 1)
    turn = turn.withColumn("called", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), F.col("k").cast("string"))))
    # A name with a turn can only meet one that ends so by itself.
    own = first.select(F.col("key").alias("called_key"), F.lit(True).alias("taken"))
    out = turn.withColumn("called_key", F.when(F.col("k") > 1, F.lower("called"))).join(own, "called_key", "left")
    name_of = F.when(F.col("taken"), F.concat("called", F.lit("_" + NUMBER), F.col("number").cast("string"))).otherwise(F.col("called"))
    return out.select("number", name_of.alias("name"), "text", "problems")
