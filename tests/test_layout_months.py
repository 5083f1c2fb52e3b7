"""Cells and paragraphs of pages, months without rows, rate limits and rankings with ties and nulls."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import comparable
from granary.operators import finance, layout, leads, paging, snapshots
from granary.plans import similar  # noqa: F401
from granary.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", ["page_cells", "page_paragraphs", "paged_ways"])
def test_query_matches_sql(spark, duck, sf, name):
    assert comparable(QUERIES[name](spark, sf).toPandas()) == comparable(duck.execute(ORACLES[name]).fetchdf())


def test_cells_of_several_tables(spark):
    rows = [
        (1, "item", 10.0, 30.0, 0.0), (1, "total", 100.0, 110.0, 0.0),
        (1, "long", 10.0, 28.0, 12.0), (1, "name", 30.0, 50.0, 12.5), (1, "14", 100.0, 110.0, 12.0), (1, "850,15", 116.0, 140.0, 12.0),
        (1, "x", 10.0, 15.0, 24.0), (1, "1", 100.0, 105.0, 24.0), (1, "000", 116.0, 130.0, 24.0),
        (2, "alone", 500.0, 900.0, 3.0),
    ]
    words = spark.createDataFrame([(*r, 10.0) for r in rows], "page long, text string, x0 double, x1 double, top double, size double")
    get = lambda **o: {(r.page, r.row, r.column): r.text for r in layout.table_cells(words, ["page"], "x0", "x1", "top", "size", "text", least=4.0, **o).collect()}
    assert get() == {(1, 1, 1): "item", (1, 1, 2): "total", (1, 2, 1): "long name", (1, 2, 2): "14 850,15", (1, 3, 1): "x", (1, 3, 2): "1 000", (2, 1, 1): "alone"}
    assert get(labelled=False)[(1, 2, 3)] == "850,15" and get(bin_width=3.0) == get()
    assert layout.table_cells(words.limit(0), ["page"], "x0", "x1", "top", "size", "text").count() == 0


LINES = [
    # page, text, x0, x1, top, size
    (1, "Title of it", 50, 200, 0, 20), (1, "in two lines", 50, 200, 22, 20),
    (1, "A first para-", 50, 500, 60, 10), (1, "graph with Anna-", 50, 500, 72, 10), (1, "Maria. Short end.", 50, 200, 84, 10),
    (1, "Another one", 50, 500, 96, 10), (1, "far below", 50, 200, 140, 10),
    (1, "- a bullet that", 50, 500, 152, 10), (1, "hangs", 60, 100, 164, 10), (1, "  and hangs on", 60, 500, 176, 10), (1, "- next bullet", 50, 100, 188, 10), (1, "text after", 50, 500, 200, 10),
    (1, "2. numbered that goes", 50, 500, 212, 10),
    (2, "on over the page", 50, 500, 0, 10), (3, "and one more with a cut-", 50, 500, 0, 10),
    (4, "ting. End", 50, 500, 0, 10), (4, "of it.", 50, 200, 12, 10), (4, "   indented", 70, 500, 24, 10), (4, "rest.", 50, 100, 36, 10), (5, "small after an end", 50, 500, 0, 10), (6, "Capital", 50, 500, 0, 10),
]


@pytest.mark.parametrize("parts", [1, 7])
def test_paragraphs(spark, parts):
    rows = [(1, p, k, float(a), float(b), float(t), float(t + s), float(s), x) for k, (p, x, a, b, t, s) in enumerate(LINES)] + [(2, 1, 0, 0.0, 9.0, 0.0, 9.0, 9.0, "other")]
    df = spark.createDataFrame(rows, "doc long, page int, at int, x0 double, x1 double, top double, bottom double, size double, text string").repartition(parts)
    got = [(r.doc, r.page, r.kind, r.text) for r in layout.paragraphs(df).orderBy("doc", "page", "block").collect()]
    assert got == [
        (1, 1, "heading", "Title of it in two lines"),
        (1, 1, "para", "A first paragraph with Anna- Maria. Short end."),
        (1, 1, "para", "Another one"),
        (1, 1, "para", "far below"),
        (1, 1, "bullet", "a bullet that hangs   and hangs on"),
        (1, 1, "bullet", "next bullet"),
        (1, 1, "para", "text after"),
        (1, 1, "para", "2. numbered that goes on over the page and one more with a cutting. End of it."),
        (1, 4, "para", "   indented rest."),
        (1, 5, "para", "small after an end"),
        (1, 6, "para", "Capital"),
        (2, 1, "para", "other"),
    ]


def test_months_without_rows_do_not_move_payments(spark):
    k = lambda m: 2024 * 12 + m - 1
    rows = spark.createDataFrame([("a", k(1), 1, 100.0, 6.0), ("a", k(2), 2, 200.0, 12.0), ("a", k(7), 7, 50.0, 3.0), ("b", k(3), 3, 10.0, 1.0)], "key string, k int, month int, income double, tax double")
    out = {(r.key, r.k - k(0)): (r.month, r.payout, r.tax_paid, round(r.cash, 6)) for r in finance.cash_flow(rows, ["key"], "k", "income", "tax", "month", 30, 0.0).collect()}
    assert out == {
        ("a", 1): (1, 0.0, 0.0, 0.0), ("a", 2): (2, 100.0, 0.0, 100.0), ("a", 3): (3, 200.0, 0.0, 300.0), ("a", 4): (4, 0.0, 18.0, 282.0),
        ("a", 5): (5, 0.0, 0.0, 282.0), ("a", 6): (6, 0.0, 0.0, 282.0), ("a", 7): (7, 0.0, 0.0, 282.0), ("b", 3): (3, 0.0, 0.0, 0.0),
    }
    demand = spark.createDataFrame([("a", 1, 5), ("a", 4, 7)], "key string, month int, demand int").withColumns({"batch": F.lit(1), "start_stock": F.lit(100)})
    plan = finance.inventory_plan(demand, ["key"], 1, 1).orderBy("month").collect()
    assert [(r.month, r.demand, r.sales, r.stock) for r in plan] == [(1, 5.0, 5.0, 95.0), (2, 0.0, 0.0, 95.0), (3, 0.0, 0.0, 95.0), (4, 7.0, 7.0, 88.0)]


def test_limit_keeps_every_row(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, 5, t, "x"), (1, 5, t, "x"), (2, 5, t, "y"), (3, None, t, None), (4, 6, None, "z")]
    out = leads.limited(spark.createDataFrame(rows, "k long, u long, t timestamp, accepted string"), "u", "t", "k", 2).collect()
    assert sorted((r.k, r.u, r.accepted, r.wait_minutes) for r in out if r.u) == [(1, 5, True, None), (1, 5, True, None), (2, 5, False, 60), (4, 6, True, None)]
    assert [(r.k, r.accepted) for r in out if r.u is None] == [(3, True)]


def test_many_changes_of_one_size_are_ranked_over_several_tasks(spark):
    feed = spark.range(2000).select(F.lit("price").alias("kind"), F.col("id").alias("key"), F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 50 == 1, -20.0).otherwise(10.0).alias("pct")).repartition(5)
    ranked = snapshots.largest_first(feed)
    got = [r.key for r in ranked.orderBy("place").collect()]
    assert got == sorted(range(2000), key=lambda k: ((0 if k % 50 == 0 else 1 if k % 50 == 1 else 2), k))
    assert sorted(r.place for r in ranked.collect()) == list(range(1, 2001)) and ranked.columns == ["kind", "key", "pct", "place"]
    assert snapshots.largest_first(feed.limit(0)).count() == 0


def test_ways_end(spark):
    pages = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", None), ("e", "lost"), ("f", "f"), ("g", "a")], "url string, next string")
    starts = spark.createDataFrame([(1, "a"), (2, "d"), (3, "e"), (4, "f"), (5, "g"), (6, "none")], "start long, url string")
    way = lambda k: {s: "".join(r.url for r in rows if r.start == s) for s in range(1, 7)} if (rows := sorted(paging.follow(pages, starts, k).collect(), key=lambda r: r.step)) else {}
    assert way(10) == {1: "abc", 2: "d", 3: "e", 4: "f", 5: "gabc", 6: ""}
    assert way(2) == {1: "ab", 2: "d", 3: "e", 4: "f", 5: "ga", 6: ""}
    html = spark.createDataFrame([("<A class=x HREF='/p?a=1&amp;b=2'>1</A> <a>no</a><a href=\" /q \">",), (None,)], "h string")
    assert [r[0] for r in html.select(paging.links(F.col("h"))).collect()] == [["/p?a=1&b=2", "/q"], []]
    assert spark.range(3, 4).select(paging.template_url("http://shop/?page={page}&x", F.col("id"))).first()[0] == "http://shop/?page=3&x"
