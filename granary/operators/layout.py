"""Layout of printed pages as tables of words: column borders, lines, table fragments, body size.

The input is one row for each word with its place on the page, whatever tool read the
page. All of it is windows within one page or one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import is_empty, norm_key
from ..sources.scratch import settled


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, start, end, pieces): touching or overlapping intervals of a key as one; null bounds are left out."""
    rows = df.select(*keys, F.col(start).alias("start"), F.col(end).alias("end")).filter("start is not null and end is not null")
    # A task sorts its rows and holds them; a stated number of partitions is not merged into as many as there are cores.
    rows = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = rows.withColumn("_new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    island = opened.withColumn("_island", F.sum("_new").over(order))
    return island.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("pieces")).drop("_island")


def column_borders(words: DataFrame, keys: list[str], x0: str, x1: str, least: float = 2.0) -> DataFrame:
    """(keys, border): the middle of each gap, ``least`` or wider, that no word of the table crosses."""
    solid = merge_intervals(words, keys, x0, x1)
    before = F.lag("end").over(Window.partitionBy(*keys).orderBy("start"))
    return solid.withColumn("_before", before).filter(F.col("start") - F.col("_before") >= least).select(*keys, ((F.col("start") + F.col("_before")) / 2).alias("border"))


def text_lines(words: DataFrame, keys: list[str], top: str, left: str, size: str, text: str) -> DataFrame:
    """(keys, line, top, size, text): words put together where tops differ by at most max(2, 0.3 of the size)."""
    down = Window.partitionBy(*keys).orderBy(top, left)
    jump = F.col(top) - F.lag(top).over(down) > F.greatest(F.lit(2.0), 0.3 * F.col(size))
    marked = words.withColumn("_new", F.coalesce(jump.cast("int"), F.lit(1))).withColumn("line", F.sum("_new").over(down))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(left).alias("x"), F.col(text).alias("t")))), lambda w: w["t"]), " ")
    return marked.groupBy(*keys, "line").agg(F.min(top).alias("top"), F.max(size).alias("size"), joined.alias("text"))


def body_size(lines: DataFrame, doc: str, size: str, text: str) -> DataFrame:
    """(doc, body): the size that most characters are set in; the smaller one on a tie."""
    weight = lines.groupBy(doc, size).agg(F.sum(F.length(text)).alias("n"))
    return weight.groupBy(doc).agg(F.max_by(size, F.struct("n", -F.col(size))).alias("body"))


def stitch_tables(fragments: DataFrame, doc: str, order: str, header: str, top: str, bottom: str) -> DataFrame:
    """Fragments with ``table_no``, the table they belong to, and ``repeats_header``.

    ``header`` is an array of cells, null where a fragment starts without one; ``top`` and
    ``bottom`` are shares of the page height. A fragment goes on with the table before it
    when it repeats that table's header, or when it has none and starts in the top third
    after a fragment that ended below 0.7.
    """
    down = Window.partitionBy(doc).orderBy(order)
    key = F.array_join(F.transform(F.col(header), lambda c: F.coalesce(norm_key(c), F.lit(""))), "\u0001")
    rows = fragments.withColumn("_key", key)
    named = rows.withColumn("_last", F.last("_key", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1)))
    same = F.coalesce(F.col("_key") == F.col("_last"), F.lit(False))
    runs_on = F.col("_key").isNull() & (F.lag(bottom).over(down) > 0.7) & (F.col(top) < 0.3)
    opened = named.withColumns({"repeats_header": same, "_new": F.when(same | F.coalesce(runs_on, F.lit(False)), 0).otherwise(1)})
    return opened.withColumn("table_no", F.sum("_new").over(down)).drop("_key", "_last", "_new")


def usable(rows: DataFrame, table: list[str], cells: list[str], share: float = 0.3) -> DataFrame:
    """(table, n_rows, n_filled): tables of two rows and columns or more with enough filled cells."""
    filled = sum((~is_empty(F.col(c).cast("string"))).cast("long") for c in cells)
    counts = rows.groupBy(*table).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(filled).alias("n_filled"))
    return counts.filter((F.col("n_rows") >= 2) & F.lit(len(cells) >= 2) & (F.col("n_filled") >= share * len(cells) * F.col("n_rows")))


def table_cells(words: DataFrame, keys: list[str], x0: str, x1: str, top: str, size: str, text: str, least: float = 2.0, labelled: bool = True, bin_width: float = 50.0) -> DataFrame:
    """(keys, row, column, text): the cells of a table without vertical lines, rows and columns from 1.

    Columns lie between the gaps that no word crosses. With ``labelled`` the first row names the columns:
    a column without a word there belongs to the one on its left, as a gap inside of numbers does.
    Words meet their column by a join on the bins that its interval touches.
    """
    borders = column_borders(words, keys, x0, x1, least)
    spans = borders.groupBy(*keys).agg(F.sort_array(F.collect_list("border")).alias("_b"))  # the columns of one table
    wide = words.groupBy(*keys).agg(F.min(x0).alias("_lo"), F.max(x1).alias("_hi")).join(spans, keys, "left")
    edges = F.concat(F.array(F.col("_lo") - 1), F.coalesce("_b", F.array().cast("array<double>")), F.array(F.col("_hi") + 1))
    bounds = wide.select(*keys, F.posexplode(F.arrays_zip(edges.alias("lo"), F.slice(edges, 2, F.size(edges)).alias("hi"))).alias("_c", "_e")).select(*keys, "_c", F.col("_e.lo").alias("lo"), F.col("_e.hi").alias("hi")).filter("hi is not null")
    bins = lambda c: F.floor(c / bin_width).cast("long")
    intervals = bounds.select(*keys, "_c", "lo", "hi", F.explode(F.sequence(bins(F.col("lo")), bins(F.col("hi")))).alias("_bin"))
    down = Window.partitionBy(*keys).orderBy(top, x0)
    jump = F.col(top) - F.lag(top).over(down) > F.greatest(F.lit(2.0), 0.3 * F.col(size))
    placed = words.withColumn("_new", F.coalesce(jump.cast("int"), F.lit(1))).withColumn("row", F.sum("_new").over(down))
    placed = placed.withColumn("_mid", (F.col(x0) + F.col(x1)) / 2).withColumn("_bin", bins(F.col("_mid")))
    met = placed.join(intervals, [*keys, "_bin"]).filter((F.col("_mid") >= F.col("lo")) & (F.col("_mid") < F.col("hi")))
    if labelled:
        named = met.groupBy(*keys, "_c").agg(F.min("row").alias("_first"))
        left = Window.partitionBy(*keys).orderBy("_c")
        own = ((F.col("_first") == 1) | (F.row_number().over(left) == 1)).cast("int")
        numbered = named.withColumn("_own", own).withColumn("column", F.sum("_own").over(left))
    else:
        numbered = met.select(*keys, "_c").distinct().withColumn("column", F.row_number().over(Window.partitionBy(*keys).orderBy("_c")))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(x0).alias("x"), F.col(text).alias("t")))), lambda w: w["t"]), " ")
    return met.join(numbered.select(*keys, "_c", "column"), [*keys, "_c"]).groupBy(*keys, "row", "column").agg(joined.alias("text"))


BULLET = "^[•▪◦‣–—*-]\\s+"
NUMBERED = "^[0-9]{1,2}[.)]\\s+"
_NEXT = "\u0001"


def paragraphs(lines: DataFrame, doc: str = "doc", page: str = "page", at: str = "at") -> DataFrame:
    """(doc, page, block, kind, text): printed lines put together to headings, bullets and paragraphs.

    ``lines``: doc, page, at (order on the page), x0, x1, top, bottom, size, text. A line goes on
    with the block above when kind and size are the same, the distance is small, it has no
    marker of its own, and the line above ran to the right edge (a bullet: or this one hangs).
    A word cut by a hyphen is put together. The last paragraph of a page goes on with the
    first of the next one if it ends no sentence and that one begins with a small letter.

    Lines are compared within a page; of each page only its first and last blocks are
    compared over a document, so one long document is not one task.
    """
    body = body_size(lines, doc, "size", "text")
    down = Window.partitionBy(doc, page).orderBy(at)
    sheet = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # in the order of ``down``, so rows are sorted once
    c = F.col
    rows = lines.join(body, doc).withColumns({"_left": F.min("x0").over(sheet), "_right": F.max("x1").over(sheet)})
    rows = rows.withColumns({"_head": c("size") >= c("body") * 1.15, "_bullet": c("text").rlike(BULLET), "_marker": c("text").rlike(BULLET) | c("text").rlike(NUMBERED)})
    before = lambda x: F.lag(x).over(down)
    rows = rows.withColumns(
        {
            "_far": (c("top") - before("bottom") > F.greatest((before("bottom") - before("top")) * 0.6, F.lit(3.0))) | (F.abs(c("size") - before("size")) >= 0.6) | (c("_head") != before("_head")),
            "_short": before("x1") < c("_right") - F.greatest(c("_right") - c("_left"), F.lit(1.0)) * 0.15,
            "_start": before("top").isNull() | c("_marker"),
        }
    )
    apart = c("_start") | c("_far")
    in_bullet = apart | (~(c("x0") > c("_left") + 4) & c("_short"))
    in_text = apart | c("_short") | (c("x0") > c("_left") + 12)
    # A bullet goes on until a line breaks off from it; what the last such line was tells the rule of this one.
    turn = F.when(c("_bullet") & ~c("_head"), "bullet").when(c("_head") | c("_marker") | in_bullet, "text")
    rows = rows.withColumn("_turn", turn).withColumn("_in", F.last("_turn", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1)))
    opened = F.when(c("_head"), apart).when(c("_in") == "bullet", in_bullet).otherwise(in_text)
    rows = rows.withColumn("_open", opened.cast("int")).withColumn("_block", F.sum("_open").over(down))
    kind = F.when(c("_head"), "heading").when(c("_bullet"), "bullet").otherwise("para")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(c(at).alias("a"), c("text").alias("t")))), lambda x: x["t"]), _NEXT)
    # Stored, as their ends are compared first and then they are put together.
    blocks = settled(rows.groupBy(doc, page, "_block").agg(F.min_by(kind, at).alias("kind"), text.alias("text")))

    # Only the letters at both ends of a block are compared, so its text stays where it is.
    letters = blocks.select(doc, page, "_block", "kind", F.substring("text", 1, 1).alias("_t1"), F.substring("text", -1, 1).alias("_t9"))
    ends = letters.groupBy(doc, page).agg(F.max("_block").alias("_last"), F.min_by(F.struct("kind", "_t1"), "_block").alias("_a"), F.max_by(F.struct("kind", "_t9"), "_block").alias("_z"))
    ends = ends.select(doc, page, "_last", c("_a.kind").alias("_ka"), c("_a._t1").alias("_ta"), c("_z.kind").alias("_kz"), c("_z._t9").alias("_tz"))
    over = Window.partitionBy(doc).orderBy(page)
    goes_on = (c("_ka") == "para") & (F.lag("_kz").over(over) == "para") & ~F.lag("_tz").over(over).rlike("[.!?:;…]") & c("_ta").rlike("^\\p{Ll}")
    ends = ends.withColumn("_on", F.coalesce(goes_on, F.lit(False)))
    own = F.when(~(c("_on") & (c("_last") == 1)), F.struct(c(page).alias("page"), c("_last").alias("block")))
    ends = ends.withColumn("_end", F.last(own, ignorenulls=True).over(over)).withColumn("_to", F.when(c("_on"), F.lag("_end").over(over)))
    named = blocks.join(ends.select(doc, page, "_to"), [doc, page])
    head = F.when((c("_block") == 1) & c("_to").isNotNull(), c("_to")).otherwise(F.struct(c(page).alias("page"), c("_block").alias("block")))
    whole = named.withColumn("_head", head).groupBy(doc, c("_head.page").alias("page"), c("_head.block").alias("block")).agg(
        F.min_by("kind", F.struct(page, "_block")).alias("kind"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(c(page).alias("p"), c("_block").alias("b"), c("text").alias("t")))), lambda x: x["t"]), _NEXT).alias("_t"),
    )
    mended = F.replace(F.regexp_replace("_t", f"([\\p{{L}}\\p{{N}}_])-{_NEXT}(?=\\p{{Ll}})", "$1"), F.lit(_NEXT), F.lit(" "))
    return whole.select(doc, "page", "block", "kind", F.when(c("kind") == "bullet", F.regexp_replace(mended, BULLET, "")).otherwise(mended).alias("text"))
