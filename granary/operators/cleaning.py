"""Cleaning of tables cell by cell, header rows, merge reports, vector caches, and lines of reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import cell_number, parse_moment
from ..functions.text import clean_spaces, is_empty, normalize_email, normalize_inn, phone_list, title_name


def clean_cell(x: Column, kind: str) -> Column:
    """struct(value, done, problem) of a cell of text.

    ``kind`` is skip, text, phone, inn, email, date, number or name. ``done`` lists what
    was changed; a cell that cannot be read keeps its text and has a ``problem``. Dates
    become ISO text and numbers plain text, so that one log holds all columns.
    """
    if kind == "skip":
        return F.struct(x.alias("value"), F.lit("").alias("done"), F.lit(None).cast("string").alias("problem"))
    tidy = F.nullif(clean_spaces(x), F.lit(""))

    def read(s: Column) -> Column:
        note = F.lit(None).cast("string")
        if kind == "phone":
            value = phone_list(s)
        elif kind == "inn":
            value, note = normalize_inn(s)["value"], normalize_inn(s)["note"]
        elif kind == "email":
            value = normalize_email(s)
        elif kind == "date":
            at = parse_moment(s)
            value = F.when(at["has_time"], F.date_format(at["at"], "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(at["at"], "yyyy-MM-dd"))
        elif kind == "number":
            value = cell_number(s).cast("string")
        else:
            value = title_name(s) if kind == "name" else s
        return F.struct(s.alias("tidy"), value.alias("value"), note.alias("note"))

    # Through an array of one element each step is computed once.
    got = F.get(F.transform(F.transform(F.array(tidy), lambda s: s), read), F.lit(0))
    # A date or number that was text always counts as changed.
    typed = kind in ("date", "number")
    changed = got["value"].isNotNull() & (F.lit(typed) | (got["value"] != got["tidy"]))
    done = F.array_join(F.array_compact(F.array(F.when(got["tidy"].isNotNull() & (got["tidy"] != x), "spaces"), F.when(changed, kind))), "; ")
    problem = F.when(got["tidy"].isNotNull() & got["value"].isNull(), "not read").when(got["note"] == "checksum", "checksum")
    return F.struct(F.coalesce(got["value"], got["tidy"]).alias("value"), done.alias("done"), problem.alias("problem"))


def clean_table(df: DataFrame, order: str, kinds: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """The cleaned table, and its log (row, column, before, after, done, problem).

    Columns in ``kinds`` are read as text; others pass through. Rows whose cells in
    ``kinds`` are all empty go from the table. Both results are plain projections.
    """
    read = df.withColumns({f"_c_{c}": clean_cell(F.col(c).cast("string"), k) for c, k in kinds.items()})
    some = F.exists(F.array(*[F.col(f"_c_{c}.value") for c in kinds]), lambda v: ~is_empty(v))
    table = read.filter(some).select(*[F.col(f"_c_{c}.value").alias(c) if c in kinds else F.col(c) for c in df.columns])
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("before"), F.col(f"_c_{c}.value").alias("after"), F.col(f"_c_{c}.done").alias("done"), F.col(f"_c_{c}.problem").alias("problem")) for c in kinds])
    told = F.filter(entries, lambda e: (e["done"] != "") | e["problem"].isNotNull())
    return table, read.select(F.col(order).alias("row"), F.explode(told).alias("e")).select("row", "e.*")


def header_rows(grid: DataFrame, doc: str, row: str, cells: str, scan: int = 15) -> DataFrame:
    """(doc, header): the row of each sheet that names its columns.

    Among rows numbered below ``scan``, the first that has two cells or more, at least
    60 % of the widest row's, all of text that is no number; else the first row that is
    not empty, else 0. ``cells`` is an array of text.
    """
    full = F.filter(cells, lambda v: ~is_empty(v))
    words = F.forall(full, lambda v: cell_number(v).isNull())
    # One pass; at most ``scan`` rows of a sheet are gathered, and cells of others are not read.
    near = F.when(F.col(row) < scan, F.struct(F.col(row).alias("row"), F.size(full).alias("width"), words.alias("words")))
    found = grid.select(doc, near.alias("_r")).groupBy(doc).agg(F.collect_list("_r").alias("_r"))
    widest = F.array_max(F.transform("_r", lambda r: r["width"]))
    first = lambda test: F.array_min(F.transform(F.filter("_r", test), lambda r: r["row"]))
    fits = first(lambda r: r["words"] & (r["width"] >= F.greatest(F.lit(2), F.floor(F.col("_widest") * 0.6))))
    # Sheets whose first rows are all out of reach have their header at 0, too.
    return found.withColumn("_widest", widest).select(doc, F.coalesce(fits, first(lambda r: r["width"] > 0), F.lit(0)).alias("header"))


def merge_report(tables: list[tuple[str, DataFrame]], names: dict[str, dict[str, str]], known: list[str]) -> DataFrame:
    """(source, kept, skipped, missing, unknown) by table of a union.

    ``skipped`` are rows without any value. ``missing`` lists the known columns that
    another table has and this one lacks, ``unknown`` its own that no known name covers.
    """
    renamed = [(label, df.withColumnsRenamed(names.get(label, {}))) for label, df in tables]
    present = {c for _, df in renamed for c in df.columns}
    out = None
    for (label, df), (_, original) in zip(renamed, tables, strict=True):
        some = F.lit(False)
        for c in df.columns:
            some = some | ~is_empty(F.col(c).cast("string"))
        missing = [c for c in known if c in present and c not in df.columns]
        unknown = [a for a, b in zip(original.columns, df.columns, strict=True) if b not in known]
        row = df.agg(F.count_if(some).alias("kept"), F.count_if(~some).alias("skipped")).select(F.lit(label).alias("source"), "kept", "skipped", F.lit(", ".join(missing)).alias("missing"), F.lit(", ".join(unknown)).alias("unknown"))
        out = row if out is None else out.unionByName(row)
    return out


def refreshed_vectors(texts: DataFrame, text: str, cache: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The cache (key, vector) of exactly the given texts.

    The key is the SHA-256 of a text. ``embed`` gets the distinct texts that the cache
    lacks, as (key, text), and returns (key, vector); vectors of texts that are gone go.
    """
    wanted = texts.select(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keys = wanted.select("key").distinct()
    known = cache.select("key", "vector").join(keys, "key", "left_semi")
    lacking = wanted.join(cache.select("key"), "key", "left_anti").groupBy("key").agg(F.first("text").alias("text"))
    return known.unionByName(embed(lacking).select("key", "vector"))


def found_columns(items: DataFrame, values: str, order: str, known: list[str]) -> DataFrame:
    """(name, place): names in the map column ``values`` that are not known, by first appearance.

    Each name is one row after the aggregation, so the ranking sees column names only.
    """
    named = items.select(F.col(order).alias("_o"), F.posexplode(F.map_keys(values)).alias("_p", "name"))
    named = named.filter(~F.col("name").isin(known) & ~F.col("name").startswith("_")) if known else named.filter(~F.col("name").startswith("_"))
    first = named.groupBy("name").agg(F.min(F.struct("_o", "_p")).alias("_first"))
    return first.select("name", F.row_number().over(Window.orderBy("_first")).alias("place"))


def markdown_row(columns: list[str]) -> Column:
    """A row as a line of a Markdown table; marks that would end a cell are escaped."""
    cell = lambda c: F.replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "[\\r\\n]+", " "), F.lit("|"), F.lit("\\|"))
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |"))


def shown_and_more(lines: DataFrame, section: str, order: list[str], line: str, k: int) -> DataFrame:
    """(section, place, line): the first ``k`` lines of each section and a line that counts the others.

    Only ``k`` lines of a section leave a task before they are ranked.
    """
    place = Window.partitionBy(section).orderBy(*order)
    shown = lines.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k).select(section, "place", line)
    more = lines.groupBy(section).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > k)
    more = more.select(section, F.lit(k + 1).alias("place"), F.format_string("... and %d more", F.col("_n") - k).alias(line))
    return shown.unionByName(more)
