"""Tables and texts from files, and the files that results go to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import protect_formula


def unique_names(names: list[str]) -> list[str]:
    """Blank headers numbered, repeated ones marked (2), (3)."""
    out: list[str] = []
    seen: dict[str, int] = {}
    for k, raw in enumerate(names, 1):
        name = " ".join((raw or "").split()) or f"column {k}"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name} ({seen[name]})")
    return out


def delimiter_of(sample: str) -> str:
    """The mark that splits most sample lines into the same number of cells."""
    lines = [x for x in sample.splitlines() if x.strip()]
    best = max(";,\t|", key=lambda d: (min((x.count(d) for x in lines), default=0), sum(x.count(d) for x in lines)))
    return best if any(best in x for x in lines) else (";" if sample.count(";") >= sample.count(",") else ",")


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8", delimiter: str | None = None) -> DataFrame:
    """A CSV as strings, so that codes keep their zeros; header names are made unique."""
    head = [r.value for r in spark.read.option("encoding", encoding).text(path).limit(20).collect()]
    mark = delimiter or delimiter_of("\n".join(head))
    options = spark.read.option("sep", mark).option("encoding", encoding).option("multiLine", True).option("inferSchema", False)
    first = options.option("header", False).csv(path).first()
    if first is None:
        return spark.createDataFrame([], "value string").drop("value")
    names = unique_names([(c or "").lstrip("\ufeff") for c in first])
    schema = ", ".join("`" + n.replace("`", "``") + "` string" for n in names)
    # The reader skips the header of each file itself; names come from the schema.
    return options.option("header", True).option("enforceSchema", True).schema(schema).csv(path)


def read_json_records(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of records; nested values become JSON text."""
    df = spark.read.option("multiLine", True).json(path)
    nested = {f.name: F.to_json(f.name) for f in df.schema.fields if f.dataType.typeName() in ("struct", "array", "map")}
    return df.withColumns(nested) if nested else df


def markdown_sections(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, section, heading, text): sections of Markdown by headings outside code fences."""
    lines = docs.select(F.col(doc).alias("doc"), F.posexplode(F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "(?s)<!--.*?-->", ""), "\n")).alias("at", "line"))
    upto = Window.partitionBy("doc").orderBy("at")
    fenced = F.sum(F.col("line").rlike("^\\s*```").cast("int")).over(upto) % 2 == 1
    head = F.col("line").rlike("^#{1,6}\\s+") & ~fenced
    marked = lines.withColumn("head", head).withColumn("section", F.sum(F.col("head").cast("int")).over(upto))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("head"), F.struct("at", "line")))), lambda x: x["line"]), "\n")
    title = F.max(F.when(F.col("head"), F.trim(F.regexp_replace("line", "^#+\\s+|[*_`]", ""))))
    return marked.groupBy("doc", "section").agg(title.alias("heading"), F.trim(body).alias("text")).filter("text <> '' or heading is not null")


def write_csv(df: DataFrame, path: str, delimiter: str = ";") -> None:
    """CSV for spreadsheets: decimal commas, day-first dates, no formulas, CRLF."""
    cells = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.typeName()
        if kind in ("double", "float") or kind.startswith("decimal"):
            plain = F.coalesce(c.try_cast("decimal(38,10)").cast("string"), c.cast("string"))
            c = F.translate(F.regexp_replace(F.regexp_replace(plain, "([.][0-9]*?)0+$", "$1"), "[.]$", ""), ".", ",")
        elif kind in ("date", "timestamp", "timestamp_ntz"):
            c = F.regexp_replace(F.date_format(c, "dd.MM.yyyy HH:mm"), " 00:00$", "")
        elif kind == "boolean":
            c = F.when(c, "да").otherwise("нет")
        elif kind == "string":
            c = protect_formula(c)
        else:
            c = c.cast("string")
        cells.append(c.alias(f.name))
    df.select(*cells).write.option("sep", delimiter).option("header", True).option("lineSep", "\r\n").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines with every column, nulls too."""
    df.write.option("ignoreNullFields", False).json(path)
