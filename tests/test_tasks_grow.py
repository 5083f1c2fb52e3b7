"""Work for each row is dealt over tasks by rows, not by bytes of files; what a task holds is bounded."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from granary.operators import cleaning, layout, markup, vectors
from granary.sources import scratch


@pytest.mark.parametrize("name", ["cleaning_log", "page_specs", "offer_fields", "parse_number_cell"])
def test_narrow_rows_with_much_work_are_dealt_out(spark, sf, name, monkeypatch):
    monkeypatch.setattr(scratch, "LEAST_ROWS", 20)
    assert __spark_entry__.queries()[name](spark, sf).rdd.getNumPartitions() >= 4


def test_a_task_gets_no_more_rows_than_stated(spark, monkeypatch):
    monkeypatch.setattr(scratch, "MOST_ROWS", 1000)
    dealt = scratch.spread(spark.range(25_000).coalesce(1))
    counts = [r[0] for r in dealt.groupBy(F.spark_partition_id().alias("p")).count().select("count").collect()]
    assert sum(counts) == 25_000 and len(counts) == 25 and max(counts) < 1100
    assert scratch.spread(spark.range(0)).count() == 0


def test_intervals_are_sorted_in_as_many_tasks_as_stated(spark):
    rows = spark.range(2_000).select((F.col("id") % 50).alias("k"), (F.col("id") * 3).alias("s"), (F.col("id") * 3 + 2).alias("e"))
    assert layout.merge_intervals(rows, ["k"], "s", "e").rdd.getNumPartitions() == 4


def test_header_rows_read_a_sheet_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = [(d, r, ["Report", " ", None] if r == 0 else ["part", "flag", "n"] if r == d else ["1", "x", str(r)]) for d in (1, 2, 17) for r in range(20)]
    rows += [(30, 400, ["a", "b", "c"]), (31, 0, None), (31, 3, ["", "only", None])]
    kind = "d int, r int, c array<string>"
    got = cleaning.header_rows(spark.createDataFrame(rows, kind).mapInArrow(seen, kind), "d", "r", "c").collect()
    assert {r.d: r.header for r in got} == {1: 1, 2: 2, 17: 0, 30: 0, 31: 3}
    assert read.value == len(rows)


def test_paragraphs_read_lines_twice_and_shuffle_texts_of_blocks_only_to_join_them(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = [(d, p, k, 50.0, 500.0, k * 12.0, k * 12.0 + 10, 10.0, f"line {d} {p} {k}") for d in range(3) for p in range(4) for k in range(5)]
    kind = "doc long, page int, at int, x0 double, x1 double, top double, bottom double, size double, text string"
    got = layout.paragraphs(spark.createDataFrame(rows, kind).mapInArrow(seen, kind)).collect()
    assert sorted((r.doc, r.page, r.text) for r in got) == [(d, 0, " ".join(f"line {d} {p} {k}" for p in range(4) for k in range(5))) for d in range(3)]
    assert read.value == 2 * len(rows)


def test_recall_holds_all_numbers_of_lists_against_one_exact_search(spark, monkeypatch):
    r, dealt, exact = random.Random(3), [], []
    rows = [(k, [r.gauss(0, 1) for _ in range(8)]) for k in range(300)] + [(300, None), (301, [1.0]), (302, [None, float("nan"), *[1.0] * 6]), (303, [])]
    df = spark.createDataFrame(rows, "id long, v array<double>").coalesce(1)
    search, nearest = vectors.search, vectors._nearest_lists
    monkeypatch.setattr(scratch, "LEAST_ROWS", 20)
    monkeypatch.setattr(vectors, "_nearest_lists", lambda rows, *a: dealt.append(rows.rdd.getNumPartitions()) or nearest(rows, *a))
    index = vectors.build(df, "id", "v", lists=16)
    assert dealt == [4] and index.rows.count() == len(rows)
    monkeypatch.setattr(vectors, "search", lambda i, q, key, v, k, probes=None: exact.append(probes) or search(i, q, key, v, k, probes))
    probes, got = vectors.enough_probes(index, df.filter("id % 10 = 0"), "id", "v", 5, goal=0.99)
    assert got >= 0.99 and exact.count(None) == 1 and len(exact) > 2


def test_odd_vectors_are_zeros():
    got = vectors._rows(pa.array([[1.0, 2.0], None, [3.0], [None, 4.0], [], [float("nan"), 5.0]], pa.list_(pa.float32())).slice(1), 2)
    assert got.tolist() == [[0, 0], [0, 0], [0, 4], [0, 0], [0, 5]]


def test_a_selector_is_read_once_for_all_nodes(monkeypatch):
    tree, read, step = markup._Tree("<table>" + "<tr><th class='k a'>x</th><td id=i><b>y</b></td>" * 40 + "</table>"), [], markup._STEP

    class Counted:
        def fullmatch(self, s):
            read.append(s)
            return step.fullmatch(s)

    monkeypatch.setattr(markup, "_STEP", Counted())
    for css, n in (("tr > th.k.a", 40), ("td[id=i] b", 40), ("tr *", 120), ("td.k", 0), ("th.k", 40)):
        assert len(markup.select(tree.root, css)) == n
    assert len(read) <= 10
    with pytest.raises(ValueError):
        markup.select(tree.root, "td:first")
