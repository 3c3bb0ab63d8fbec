"""Pages whose titles end within a character reference, against the SQL of the queries; what a page's links count for."""

import duckdb
import pytest

from noticeflow.functions import html
from noticeflow.queries import ORACLE, QUERIES

TITLES = ("Here the ther inthe and&amp;&amp;&amp", "The there &copy", "The inonthe &quot;x&quot; &am", "&amp;lt; here the ther&middot", "Plain the there &amp;amp; more")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("cut")
    page = '<html><head><title>{0}</title></head><body><a href="/{1}">{1}word&amp;</a><a href="/f">file.pdf &amp</a><h1>{0}</h1><p>There &amp;quot; here</p></body></html>'
    rows = [(n, f"http://a.example.net/en/{n}", page.format(TITLES[n % 5], f"the{n}")) for n in range(1, 61)]
    rows += [(n, "http://a.example.net/en/same", page.format(TITLES[n % 5], f"the{n}")) for n in (123, 243, 363)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["html_title_links", "html_plain_text", "detail_items", "detail_outcomes", "probe_links", "page_probe"])
def test_against_sql(spark, folder, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    df = QUERIES[name](spark, folder)
    out = con.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLE[name]})")
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(out.fetchall(), key=repr)


def test_references_that_need_their_semicolon(spark):
    texts = {"&amp": "&amp", "&amp;": "&", "&copy 2": "&copy 2", "&#65": "&#65", "&#65;": "A", "&#x41;&#x41": "A&#x41", "&notit;": "&notit;", "&hellip;": "…"}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", html.unescaped("t", bare=False).alias("u")).collect()
    assert {r.t: r.u for r in rows} == texts
