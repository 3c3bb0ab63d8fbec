import json
from datetime import datetime

from pyspark.sql import functions as F

from noticeflow.operators import joins, sections
from noticeflow.sources import payloads


def test_candidates_by_class(spark):
    df = spark.createDataFrame([(1, "b", "2024-01-02", "u"), (2, " a ", None, "u"), (3, "a", "2024-01-01", "v"), (4, "a", "2024-01-01", "u"), (5, None, "2023-01-01", "u")], "id int, c string, day string, url string")
    assert [r.id for r in sections.by_class(df, ["a", "b"], "c", "day", "url").collect()] == [4, 3, 2, 1, 5]


def test_sections_take_nulls(spark):
    df = spark.createDataFrame([(1, None, None, None), (2, "rnd", None, "연구"), (3, "rnd", "지원 사업", None), (4, "입찰/조달", "x", None)], "id int, source_type string, summary string, title string")
    names = ("bid", "news", "rnd-announce", "rnd-outcome", "patent", "favorites")
    assert {n: [r.id for r in df.where(sections.in_section(n)).collect()] for n in names} == {"bid": [4], "news": [], "rnd-announce": [3], "rnd-outcome": [2], "patent": [], "favorites": []}
    page = df.withColumns({"media": F.when(F.col("id") == 1, "m"), "source": F.when(F.col("id") == 2, "m"), "published_at": F.when(F.col("id") < 3, F.lit(datetime(2024, 1, 2)))})
    now = F.lit(datetime(2024, 1, 3))
    assert [r.id for r in page.where(sections.news_page("m")).collect()] == [1, 2]
    assert [r.id for r in page.where(sections.news_page(days=1, now=now)).collect()] == [1, 2] and page.where(sections.news_page(days=0, now=now)).count() == 0


def test_limit_then_filter_then_limit(spark):
    df = spark.createDataFrame([(i, "rnd", "공고" if i in (0, 3, 4, 5) else "x", "t") for i in range(8)], "id int, source_type string, summary string, title string")
    assert [r.id for r in sections.announcements(df, [F.asc("id")], 2).collect()] == [0, 3]
    assert [r.id for r in sections.announcements(df, [F.asc("id")], 1).collect()] == [0] and sections.announcements(df, [F.desc("id")], 1).count() == 0


def test_answers_as_they_come(spark):
    """CDATA, attributes, nested and empty children, prefixes, repeated fields, references, separators, arrays and broken texts."""
    long = '<?xml version="1.0" encoding="UTF-8"?>\n<n:r xmlns:n="u"><n:header><n:resultCode>00</n:resultCode></n:header><n:body><n:items>'
    cases = {
        "<r><resultCode>00</resultCode><items><item><t><![CDATA[a & b]]></t><no type='x'>1</no></item></items><totalCount>1,234</totalCount></r>": (None, 1234, [{"t": "a & b", "no": "1"}]),
        long + "<item id='3'><no>1</no><sub><no>2</no></sub><e/></item><n:item><n:no>007</n:no></n:item></n:items><totalCount> 2 </totalCount></n:body></n:r>": (None, 2, [{"no": "1", "sub": "", "e": ""}, {"no": "007"}]),
        "<r><item><a>x &amp; &#8217;</a><a> y </a></item></r>": (None, 0, [{"a": "y"}]),
        "<r><items/></r>": (None, 0, []),
        '[{"no":"1"},{"no":2},5,null]': (None, 0, [{"no": "1"}, {"no": 2}]),
        '{"response":{"header":{"resultCode":"00"},"body":{"items":{"item":{"n":"a"}},"totalCount":"1,234"}}}': (None, 1234, [{"n": "a"}]),
        '{"items":[{"n":"a"},5,null]}': (None, 0, [{"n": "a"}]),
        "{}": (None, 0, []),
        "<r><resultCode>30</resultCode><item><a>1</a></item></r>": ("AUTH", 0, []),
        "<r><header><resultCode>99</resultCode><resultMag>no PARAMETER</resultMag></header></r>": ("PARAM", 0, []),
        "<r><resultCode>00</resultCode>": ("PARSE", 0, []),
        "no json": ("PARSE", 0, []), "[1": ("PARSE", 0, []), "": ("PARSE", 0, []), "<": ("PARSE", 0, []),
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)] + [(99, None)], "id int, body string").withColumn("items", F.lit("clash"))
    got = {r.id: (r.error, r.total, [json.loads(x) for x in r["items"]]) for r in payloads.unwrapped(df).collect()}
    assert {t: got[i] for i, t in enumerate(cases)} == cases and got[99] == ("PARSE", 0, [])


def test_arrival_order_decides(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    batch = spark.createDataFrame([(1, "z", 1), (1, "a", 2), (2, "b", 1), (3, "n", 1), (3, "n", 2), (3, None, 3), (None, "x", 1), (None, "y", 2)], "id int, v string, at int")
    steps = {(r.id, r.at): r.status for r in joins.applied_in_order(old, batch, ["id"], ["v"], ["at"]).collect()}
    assert steps == {(1, 1): "updated", (1, 2): "updated", (2, 1): "skipped", (3, 1): "inserted", (3, 2): "skipped", (3, 3): "updated", (None, 1): "inserted", (None, 2): "updated"}
    last = {r.id: (r.v, r.status) for r in joins.upsert(old, batch, ["id"], ["v"], ["at"]).collect()}
    assert last == {1: ("a", "skipped"), 2: ("b", "skipped"), 3: (None, "inserted"), None: ("y", "inserted")}
