import hashlib
import json
from datetime import date

from pyspark.sql import functions as F

from noticeflow.plans import dashboard, export, items, review
from noticeflow.sources.readers import json_lines

AS_OF = date(2024, 6, 3)


def test_normalise_sources(spark):
    raw = spark.createDataFrame(
        [
            ("나라장터", None, "학교 모듈러 임대", "서울시교육청", "2024.05.01", "202406031000", "1,000원", "물품", "R1", "00", None, None),
            ("나라장터", "procurement_plan", "모듈러 계획", "기관", "20240501", "2024-07", None, "공사", None, None, None, {"orderAmt": "500"}),
            ("LH", "bid", "모듈러 기숙사", None, "2024-05-01", None, "12.7", None, "L1", None, None, {"presmtPrc": "7"}),
            ("D2B", "bid", "도로", "육군", None, None, None, "시설공사", "D1", None, None, {"budgetAmount": "3"}),
            ("네이버뉴스", "news", "삼성물산 모듈러 수주", None, "2024-06-01", None, None, None, None, None, "http://news/1", None),
            ("Other", "bid", "장난감 모듈러", "x", "soon", None, "x", None, None, None, None, None),
        ],
        "source_name string, source_type string, title string, organization string, posted_at string, due_at string, amount string, category string, source_record_id string, source_record_no string, original_link string, raw map<string,string>",
    )
    got = {(r.source_name, r.source_type): r for r in items.normalise(raw, F.lit(AS_OF)).collect()}
    g = got["나라장터", "bid"]
    assert (g.amount, g.due_at, g.posted_at, g.operating_scope, g.is_operating_scope) == (1000, date(2024, 6, 3), date(2024, 5, 1), "modular_goods_service", 1)
    assert g.summary == "공고번호: R1; 공고차수: 00; 업무구분: 물품; 공고상태: -; 계약방법: -; 입찰방법: -; 공고기관: 서울시교육청; 수요기관: -; 마감일: 202406031000"
    assert g.unique_hash == hashlib.sha256("bid|나라장터|r1|00|물품".encode()).hexdigest() and g.source_search_url == items.PORTALS["나라장터"] and g.url == g.source_search_url
    # title: 모듈러, 학교, 학교 모듈러 twice (both listings count): 4 * 5; organisation 2; direct 5
    assert g.relevance_score == 27.0 and g.keywords.split(";") == ["모듈러", "학교", "학교 모듈러", "학교 모듈러"]
    plan = got["나라장터", "procurement_plan"]
    assert plan.amount == 500 and plan.business_subtype == "발주계획" and plan.operating_scope == "modular_procurement_plan"
    lh = got["LH", "bid"]
    assert lh.organization == "한국토지주택공사" and lh.amount == 12 and "추정가격: 7" in lh.summary and lh.relevance_score == 16.0
    assert got["D2B", "bid"].relevance_score == 0.0 and got["D2B", "bid"].amount == 3 and got["D2B", "bid"].region == "육군"
    news = got["네이버뉴스", "news"]
    assert (news.link_type, news.original_url, news.due_at) == ("exact", "http://news/1", None) and news.relevance_score == 18.0
    other = got["Other", "bid"]
    assert (other.posted_at, other.amount, other.keywords, other.relevance_score, other.link_type) == (None, None, None, 0.0, "unknown")


def test_export_merge(spark):
    schema = "id string, source string, source_name string, source_type string, title string, organization string, bid_no string, bid_order string, posted_at string, due_at string, notice_status string, source_record_id string, plan_no string, ord int"
    row = lambda **k: tuple(k.get(c.split()[0]) for c in schema.split(", "))
    old = spark.createDataFrame([
        row(id="1", source_name="G", source_type="bid", title="old", bid_no="B1", bid_order="0", posted_at="2024-01-01", organization="o", ord=1),
        row(id="2", source_name="G", source_type="bid", title="kept", bid_no="B2", posted_at="2024-01-02", ord=2),
        row(id="3", source_name="S", source_type="public_agency_contest", source_record_id="C1", notice_status="result", title="over", ord=3),
        row(id="4", source_name="G", source_type="bid", title="removed", bid_no="B4", ord=4),
    ], schema)
    fresh = spark.createDataFrame([
        row(id="9", source_name="g", source_type="bid", title="new", bid_no="b1", bid_order="0", posted_at="2024-02-01", ord=1),
        row(id="9", source_name="g", source_type="bid", title=" ", bid_no="b1", bid_order="0", due_at="2024-03-01", ord=2),
        row(id=None, source_name="G", source_type="bid", title="more", bid_no="B5", posted_at="2023-01-01", ord=3),
    ], schema)
    allowed = spark.createDataFrame([("4", "agreed"), ("2", "")], "id string, reason string")
    out = export.merge_export(old, fresh, allowed, "business").collect()
    assert [(r.id, r.title, r.due_at, r.organization, r.origin) for r in out] == [
        ("1", "new", "2024-03-01", "o", "both"), ("2", "kept", None, None, "existing"), ("3", "more", None, None, "fresh"),
    ]
    life = export.with_lifecycle(spark.createDataFrame([("2024-06-02 23:00:00",), ("2024-06-01",), (None,)], "due_at string"), F.lit("2024-06-02 23:30:00").cast("timestamp"))
    assert [(r.opportunity_status, r.days_until_deadline, r.lifecycle_reason) for r in life.collect()] == [
        ("active", 0, "deadline_today_or_future"), ("closed", -2, "deadline_passed"), ("unknown", None, "no_deadline"),
    ]
    verdicts = spark.createDataFrame([(100, 79, 10, 10), (100, 80, 10, 9), (100, 100, 10, 10), (0, 0, 10, 6)], "a int, b int, c int, d int")
    assert [r.v for r in verdicts.select(export.guard(*[F.col(c) for c in "abcd"]).alias("v")).collect()] == ["blocked", "warning", "passed", "blocked"]


def test_dashboard(spark):
    rows = [(1, "bid", "G", "a", None, "2024-06-05", "9", "2024-06-01", "2024-06-02 12:00:00"), (2, "news", "N", "삼성물산", "", None, "x", "2024-06-02", None),
            (3, "procurement_plan", "D2B", "c", None, None, "5", None, "2024-05-01 00:00:00")]
    df = spark.createDataFrame(rows, "id int, source_type string, source_name string, title string, summary string, due_at string, relevance_score string, posted_at string, created_at string")
    out = dashboard.prepared(df, F.lit(AS_OF))
    k = dashboard.kpis(out, F.lit("2024-06-03 00:00:00").cast("timestamp")).first()
    assert tuple(k) == (3, 1, 1, 1, 1, 1, 1)
    assert [(r.id, r.priority) for r in dashboard.priorities(out, F.lit(AS_OF)).collect()] == [(1, 39.0), (2, 8.0), (3, 5.0)]


def test_review(spark, tmp_path):
    g = lambda url, ngram, date="20240601000000": json.dumps({"date": date, "ngram": ngram, "pre": "a new", "post": "is built", "lang": "en", "type": 1, "url": url})
    lines = [g("http://x.com/a?utm_source=1", "modular housing"), g("http://x.com/a", "modular housing"), g("http://y.com/b", "modular home"), "no json", g("", "modular home"), g("http://z.com", "roads")]
    (tmp_path / "s.json").write_text("\n".join(lines))
    rows = json_lines(spark, str(tmp_path), "date string, ngram string, pre string, post string, lang string, type int, url string", ["url", "date", "ngram"])
    rows = rows.withColumn("ord", F.monotonically_increasing_id())
    phrases = ["modular housing", "modular home"]
    assert tuple(review.scan_counts(rows.drop("ord"), phrases).first()) == (6, 2, 3, 2, 1)
    c = review.ngram_candidates(rows, phrases, ["ord"]).drop("lang")
    assert sorted(r.canonical_url for r in c.collect()) == ["http://x.com/a", "http://y.com/b"]
    articles = spark.createDataFrame([("http://x.com/a#f", "old", "en", None, None, 1), ("http://x.com/a", "Modular housing project", "en", "A", "", 2)], "url string, title string, lang string, author string, description string, ord int")
    done = review.reviewed(review.with_articles(c, articles, ["ord"]))
    got = {r.canonical_url: (r.title, r.decision, r.joined) for r in done.collect()}
    assert got == {"http://x.com/a": ("Modular housing project", "publish_candidate", True), "http://y.com/b": (None, "malformed", False)}
    assert review.report(done).first().all_hold
    more = done.unionByName(done.where("joined").withColumns({"candidate_id": F.lit("zz"), "canonical_url": F.lit("http://x.com/c")}))
    groups = review.grouped(more).collect()
    assert [(r.members, r.reason) for r in groups] == [(2, "domain_title")]
