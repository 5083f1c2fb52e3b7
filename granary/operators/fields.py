"""Declared fields of records: texts become typed values, and what could not is told."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers
from ..functions.text import clean_spaces, map_value
from .markup import NO_LINK, Field

# Kind of a field: the conversion of a text, and the type of the column.
KINDS = {
    "str": (lambda x: F.nullif(clean_spaces(x), F.lit("")), "string"),
    "int": (numbers.to_int, "long"),
    "float": (numbers.find_number, "double"),
    "price": (numbers.to_price, "double"),
    "currency": (numbers.currency, "string"),
    "availability": (numbers.availability, "boolean"),
    "bool": (numbers.to_bool, "boolean"),
    "date": (lambda x: numbers.parse_moment(x)["at"].cast("date"), "date"),
    "url": (lambda x: F.when(~F.trim(x).rlike("^(?:" + "|".join(NO_LINK) + ")"), F.nullif(F.trim(x), F.lit(""))), "string"),
}


def typed(records: DataFrame, fields: list[Field], failed: str = "failed", missing: str = "missing") -> DataFrame:
    """Records with the declared fields in their types; other columns stay.

    A field is taken from the text, or array of texts, of its name; mapped by ``mapping``;
    converted as its ``kind`` says; and replaced by ``default`` where nothing is left. Values of
    an array that cannot be converted are left out of it. ``failed`` lists the fields with a
    text that could not be converted, ``missing`` those required that stay empty, both in the
    order of declaration; columns of these names are replaced. An unknown kind or a field
    without a column is an error before anything runs.
    """
    for f in fields:
        if f.kind not in KINDS:
            raise ValueError(f"kind of field {f.name} not known: {f.kind}")
        if f.name not in records.columns:
            raise ValueError(f"no column for field {f.name}")
    names = [f.name for f in fields]
    others = [F.col(f"`{c}`") for c in records.columns if c not in (*names, failed, missing)]

    def convert(f: Field) -> Column:
        one = lambda x: KINDS[f.kind][0](map_value(x, f.mapping) if f.mapping else x)
        raw = F.col(f"`{f.name}`")
        return F.transform(raw, one) if f.many else one(raw.cast("string"))

    def lost(f: Field) -> Column:
        raw, value = F.col("raw")[f.name], F.col("value")[f.name]
        if f.many:
            return F.coalesce(F.exists(F.arrays_zip(raw.alias("r"), value.alias("v")), lambda z: (F.trim(z["r"]) != "") & z["v"].isNull()), F.lit(False))
        return F.coalesce(F.trim(raw.cast("string")) != "", F.lit(False)) & value.isNull()

    def final(f: Field) -> Column:
        value, kind = F.col("value")[f.name], KINDS[f.kind][1]
        if f.many:
            given = F.array(*[F.lit(x).cast(kind) for x in f.default or ()]).cast(f"array<{kind}>")
            kept = F.filter(value, lambda x: x.isNotNull())
            return F.when(F.size(kept) > 0, kept).otherwise(given)
        return F.coalesce(value, F.lit(f.default).cast(kind)) if f.default is not None else value

    rows = records.select(F.struct(*others, F.lit(0).alias("")).alias("others"), F.struct(*[F.col(f"`{n}`") for n in names]).alias("raw"), F.struct(*[convert(f).alias(f.name) for f in fields]).alias("value"))
    told = lambda found: F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in found]).cast("array<string>"), lambda x: x.isNotNull())
    rows = rows.select("others", told([(f.name, lost(f)) for f in fields]).alias("failed"), F.struct(*[final(f).alias(f.name) for f in fields]).alias("final"))
    value = F.col("final")
    empty = [(f.name, F.size(value[f.name]) == 0 if f.many else value[f.name].isNull()) for f in fields if f.required]
    kept = [F.col("others")[c].alias(c) for c in records.columns if c not in (*names, failed, missing)]
    return rows.select(*kept, *[value[n].alias(n) for n in names], F.col("failed").alias(failed), told(empty).alias(missing))
