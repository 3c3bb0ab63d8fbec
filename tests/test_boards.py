from datetime import date

from pyspark.sql import functions as F

from noticeflow.operators import boards
from noticeflow.sources import payloads


def link(seq, title):
    return f'<tr><td>1</td><td><a href="/v?seq={seq}">{title}</a></td></tr>'


PAGES = "source string, page_no int, status int, html string"
RECORD = r"seq=(\d+)"


def test_lists_stop_and_known_records_join(spark):
    pages = spark.createDataFrame(
        [
            ("a", 1, 200, link(1, "공모 하나") + link(2, "결과")), ("a", 2, 500, "broken"), ("a", 3, 200, link(3, "공모 셋") + link(1, "공모 다시")),
            ("a", 4, 200, "<p>none</p>"), ("a", 5, 200, link(5, "공모 뒤")),
            ("b", 1, 404, link(6, "공모")), ("b", 2, 200, link(7, "공모")), ("c", 1, 200, None), (None, 1, 200, link(8, "공모")),
        ], PAGES,
    )
    links = boards.listed(pages.withColumn("fine", F.lit("clash")), RECORD)
    assert sorted((r.record_id, r.title) for r in links.where("source = 'a'").collect()) == [("1", "공모 다시"), ("1", "공모 하나"), ("2", "결과"), ("3", "공모 셋")]
    known = spark.createDataFrame([("a", "2", "k", "h2"), ("a", "9", "k", "h9"), ("a", "9", "k", "h9"), ("a", "", "k", "h")], "source string, record_id string, title string, href string")
    got = sorted((r.record_id, r.title, r.known) for r in boards.candidates(links, ["공모"], known).where("source = 'a'").collect())
    assert got == [("1", "공모 하나", False), ("3", "공모 셋", False), ("9", "k", True)]
    assert boards.listed(pages.limit(0), RECORD).count() == 0


def test_records_and_counts(spark):
    chosen = spark.createDataFrame(
        [("a", str(i), f"t{i}", f"h{i}", d) for i, d in enumerate([date(2024, 1, 1), date(2024, 5, 1), None, None])],
        "source string, record_id string, title string, href string, posted date",
    )
    details = spark.createDataFrame(
        [("a", "0", 200, "x 0"), ("a", "1", 200, '<title>One</title>no 1 <a href="/f/plan.pdf">plan</a>'), ("a", "2", 500, "2")],
        "source string, record_id string, status int, html string",
    )
    found = boards.records(chosen, details, F.col("posted"), F.lit(date(2024, 3, 1)))
    got = {r.record_id: r for r in found.collect()}
    assert [got[k].outcome for k in "0123"] == ["skipped", "matched", "failed", "failed"]
    assert got["1"].page_title == "One" and got["1"].link_verified and got["1"].attachments[0].file_type == "pdf"
    (n,) = boards.crawl_counts(found).collect()
    assert (n.candidates, n.matched, n.skipped, n.failed, n.verified, n.attachments) == (4, 1, 1, 2, 1, 1)


def test_health(spark):
    bare = "<table><tr><td>1</td><td></td></tr><tr><td>2</td><td></td></tr>" + link(3, "t") + "</table>openBidblancDetail('1','00')"
    pages = spark.createDataFrame([("a", 1, 200, bare), ("a", 2, 200, link(1, "t")), ("a", 3, 200, None)], PAGES)
    got = {r.page_no: r for r in boards.list_health(pages).collect()}
    assert (got[1].rows, got[1].rows_with_title, got[1].ratio, got[1].state, got[1].calls, got[1].table_found) == (3, 1, 0.333, "parser_mismatch", 1, True)
    assert got[2].state == "ok" and got[3].state == "empty"


def test_answers(spark):
    bodies = [
        '{"response": {"header": {"resultCode": "99", "resultMsg": "NORMAL SERVICE."}, "body": {"items": {"item": [{"a": 1}, 5, {"a": "x"}]}, "totalCount": "2"}}}',
        "<r><resultMag>필수 값</resultMag><resultCode>77</resultCode></r>", '{"resultCode": "01"}', "", None, "{broken",
        "<r><item><a>1 &amp; 2</a><b> </b><a>3</a></item><item></item><totalCount>many</totalCount></r>", '{"items": [{"a": 1}]}',
    ]
    df = spark.createDataFrame(list(enumerate(bodies)), "k int, body string").withColumn("items", F.lit("clash"))
    got = {r.k: r for r in payloads.unwrapped(df).collect()}
    assert [got[k].error for k in range(8)] == [None, "PARAM", "API", "PARSE", "PARSE", "PARSE", None, None]
    assert got[0]["items"] == ['{"a":1}', '{"a":"x"}'] and got[0].total == 2
    assert got[6]["items"] == ['{"a":"3","b":""}'] and got[6].total == 0
    assert got[7]["items"] == ['{"a":1}']
