"""Detail pages are taken apart once, and only the fields that are read are computed."""

from pyspark.sql import functions as F

from noticeflow.functions import html
from noticeflow.operators import details
from noticeflow.queries import QUERIES


def test_each_step_once_and_none_for_nobody(spark, tmp_path):
    spark.createDataFrame([(1, "http://a.example.com/1", "<title>the other</title>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    plan = QUERIES["detail_items"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("|article|section)") == 1 and plan.count("<title") <= 4
    assert "homes)" not in plan and "costs)" not in plan and "공업화" not in plan


def test_text_is_read_once(spark):
    plan = spark.range(1).select(html.unescaped(F.regexp_replace(F.col("id").cast("string"), "xyzzy", "once")).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xyzzy") == 1


def test_columns_of_a_page_are_replaced_in_place(spark):
    df = spark.createDataFrame([("s", "1", "t", "http://i.kr/1", 200, "<title>x</title>", "old")], "source string, record_id string, listed_title string, url string, status int, html string, title string")
    out = details.detail_records(df, ["i.kr"])
    assert out.columns[:8] == [*df.columns, "page_title"] and out.columns[-1] == "outcome" and out.first().title == "x"
