"""Pages whose character references lack a semicolon."""

import duckdb
import pytest
from conftest import comparable

from granary.operators import markup
from granary.plans import more, passages, queries  # noqa: F401

TEXTS = ["a &amp", "b&amp;&am", "&ltc&gt; &copy &notit; &#39 &#39;d", "&&amp; &", "﷐ &amp"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    page = '<html lang="en"><head><meta charset="utf-8"><title>{0}</title></head><body><nav><ul><li><a href="/x">{0}</a></li></ul></nav><article><h1>{0}</h1></article></body></html>'
    rows = [(k, "http://h/a", page.format(t)) for k, t in enumerate(TEXTS)]
    path = str(tmp_path_factory.mktemp("pages"))
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


@pytest.mark.parametrize("name", ["page_extract", "page_fields", "page_titles"])
def test_queries_match_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{folder}/pages.parquet/*.parquet'")
    assert comparable(queries.QUERIES[name](spark, folder).toPandas()) == comparable(con.execute(queries.ORACLES[name]).fetchdf())


def test_as_in_browsers_by_default(spark):
    pages = spark.createDataFrame([(1, "", "<p title='&lt'>a &amp</p><script>x && y</script>")], "page_id long, url string, html string")
    wanted = [markup.Field("p", "p"), markup.Field("title", "p", "title"), markup.Field("script", "script", "own_text")]
    assert tuple(markup.extract(pages, wanted).first())[2:] == ("a &", "<", "x && y")
    assert tuple(markup.extract(pages, wanted, bare=False).first())[2:] == ("a &amp", "&lt", "x && y")
