"""Detail pages, probes, versioned updates and contest summaries against typed expectations."""

from datetime import date, datetime

from pyspark.sql import functions as F

from noticeflow.operators import details, probe
from noticeflow.plans import contests

GOOD = """<html><head><title>서울 A1블록 민간참여 공공주택건설사업 민간사업자 공모 | 공사</title><script>var x = "마감 2020-01-01";</script></head><body>
<h1>서울 A1블록 민간참여 공공주택건설사업</h1><p>강동지구 A1BL 및 하남신도시 B-2 블록 대상</p><table><tr><td>공고일</td><td>2024.05.01</td></tr>
<tr><td>참가의향서 제출: 2024-05-10</td></tr><tr><td>사업신청서 접수 마감 2024-06-31, 2024년 6월 28일</td></tr></table>
<dl><dt>추정사업비는 약 1,234 억 원</dt><dd>사업비 5,000 원</dd></dl><li>1,050 세대 &amp; 모듈러</li>
<a href="/down/공고.hwp">공고문.hwp</a> <a href='https://www.i-sh.co.kr/b.pdf'>도면</a></body></html>"""
RESULT = "<title>민간사업자 공모 심사결과</title><p>우선협상대상자 선정</p>"
REVIEW = "<title>민간사업자 공모 안내</title><p>상가 운영</p>"
OTHER = "<title>채용 공고</title><p>직원 모집</p>"


def pages(spark):
    rows = [
        ("s", "11", "서울 A1블록 민간참여 공공주택건설사업 민간사업자 공모", "https://www.i-sh.co.kr/v?seq=11", 200, GOOD),
        ("s", "12", "심사 결과 안내문", "https://i-sh.co.kr/v?seq=12", 200, RESULT), ("s", "13", None, "https://i-sh.co.kr/v?seq=13", 200, REVIEW),
        ("s", "14", "채용", "https://i-sh.co.kr/v?seq=14", 200, OTHER), ("s", "15", "x", "https://i-sh.co.kr/v?seq=15", 500, GOOD), ("s", "16", "x", "https://i-sh.co.kr/v?seq=16", 200, None),
        ("s", "17", "전혀 다른 제목입니다 무관함", "https://i-sh.co.kr/v?seq=17", 200, GOOD), ("s", "18", "서울 A1블록", "https://evil.kr/i-sh.co.kr?seq=18", 200, GOOD),
        ("s", "19", "서울 A1블록", "https://i-sh.co.kr/list", 200, GOOD), ("s", "", "서울 A1블록", "https://i-sh.co.kr/v", None, GOOD), ("s", "21", "서울 A1블록", "https://i-sh.co.kr/v?seq=21", 200, "<p>Access Denied</p>" + GOOD),
    ]
    df = spark.createDataFrame(rows, "source string, record_id string, listed_title string, url string, status int, html string")
    return df.withColumns({"board_url": F.lit("https://i-sh.co.kr/list"), "note": F.lit("stays")})


def test_records_and_items(spark):
    records = details.detail_records(pages(spark), ["i-sh.co.kr"])
    got = {r.record_id: r for r in records.collect()}
    assert {k: (r.outcome, r.link_reason) for k, r in got.items()} == {
        "11": ("opportunity", "verified"), "12": ("result", "title_mismatch"), "13": ("review", "verified"), "14": ("excluded", "verified"), "15": ("failed", "http_500"), "16": ("failed", "empty_page"),
        "17": ("unverified", "title_mismatch"), "18": ("unverified", "domain_not_allowed"), "19": ("unverified", "record_id_not_in_address"), "": ("failed", "record_id_missing"), "21": ("unverified", "access_restricted"),
    }
    r = got["11"]
    assert (r.posted_at, r.deadline_at, r.amount, r.homes, r.note) == (date(2024, 5, 1), date(2024, 6, 28), 123_400_000_000, 1050, "stays")
    assert r.schedule == "참가의향서 제출: 2024-05-10\n사업신청서 접수 마감 2024-06-31, 2024년 6월 28일"
    assert "강동지구" in r.sites and "하남신도시" in r.sites and "A1BL" in r.blocks and "A1블록" in r.blocks and "B-2 블록" in r.blocks
    assert [a.name for a in r.attachments] == ["공고문.hwp", "도면"] and r.modular.value == "confirmed"
    assert got["16"].schedule is None and got["16"].deadline_at is None and got["16"].sites == []

    items = {i.record_id: i for i in details.detail_items(records).collect()}
    assert set(items) == {"11", "12", "13", "17", "18", "19", "21"}
    assert (items["11"].link_type, items["11"].url, items["11"].in_scope, items["11"].relevance_score, items["11"].due_at) == ("exact", "https://www.i-sh.co.kr/v?seq=11", True, 80, date(2024, 6, 28))
    assert (items["17"].link_type, items["17"].url, items["17"].in_scope) == ("unknown", "https://i-sh.co.kr/list", False)
    counts = {r.outcome: (r.pages, r.verified) for r in details.outcomes(records).collect()}
    assert counts == {"opportunity": (1, 1), "result": (1, 0), "review": (1, 1), "excluded": (1, 1), "failed": (3, 0), "unverified": (4, 0)}


def test_versions_decide(spark):
    stored = spark.createDataFrame([("a", 1, "old", "k"), ("b", 5, "old", "k"), ("c", 2, None, "k"), ("d", 1, "old", "k")], "id string, v int, s string, other string")
    changes = spark.createDataFrame([("a", 1, "new"), ("a", 1, "also"), ("a", 0, "late"), ("b", 4, "late"), ("c", 2, "first"), ("x", 1, "none")], "id string, v int, s string")
    got = {r.id: (r.v, r.s, r.other, r.status) for r in details.compare_and_set(stored, changes, "id", "v", ["s"]).collect()}
    assert got == {"a": (2, "also", "k", "set"), "b": (5, "old", "k", "conflict"), "c": (3, "first", "k", "set"), "d": (1, "old", "k", "kept"), "x": (None, None, None, "missing")}


def test_failures_in_order_with_evidence(spark):
    cases = [
        (200, "timeout", "x", ("request_failed", "timeout")), (None, None, "x", ("no_status", "null")), (403, "", "x", ("access_restricted", "403")), (410, None, "", ("not_found", "410")), (429, None, "", ("rate_limited", "429")),
        (502, None, "", ("server_error", "502")), (418, None, "", ("client_error", "418")), (302, None, "", ("redirected", "302")), (200, None, None, ("empty_page", "0")), (200, None, " ", ("empty_page", "0")),
        (200, None, "solve the CAPTCHA, access denied", ("challenge", "captcha")), (200, None, "로그인이 필요 합니다", ("login_required", "로그인이 필요")), (200, None, "Access Denied", ("refused", "access denied")),
        (200, None, "서비스 점검 중", ("maintenance", "점검 중")), (200, None, "<noscript>Enable JavaScript</noscript>", ("script_required", "enable javascript")), (200, None, "<script>a()</script>", ("script_required", "<script")),
        (200, None, "�" * 5 + "a" * 50, ("broken_text", "5")), (200, None, "<p>fine</p>", ("", None)), (200, None, "a" * 6000 + "captcha", ("", None)),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, s int, e string, h string")
    got = {r.i: tuple(r.f) for r in df.select("i", probe.failure(F.col("s"), F.col("e"), F.col("h")).alias("f")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[3] for c in cases]


def test_links_and_pages(spark):
    page = """<form action="/s?searchKeyword="><table></table></form><link type="application/rss+xml">
    <a href="/v?articleNo=7&amp;mode=view">주택 사업 안내문입니다</a><a href="#top">위로 가는 아주 긴 링크</a><a href="javascript:void(0)">자바스크립트 링크입니다</a><a href="x.hwp">공모 안내 첨부문서입니다</a>
    <a href="v2?list_no=9">짧다</a><a href="?nPage=2">검색 결과 페이지입니다</a><a href="https://else.kr/a">다른 곳의 공고 안내문</a><a href="//i.kr/z">보통 링크 하나 더 있음</a>"""
    df = spark.createDataFrame([("s", "https://i.kr/b/list?x=1", 200, None, page, 1), ("t", "https://i.kr", 429, None, None, 2)], "source string, url string, status int, error string, html string, extra int")
    links = probe.tested_links(df, ["articleNo", "list_no"], ["i.kr"])
    got = [(r.href, r.record_id, r.verdict) for r in links.orderBy("at").collect()]
    assert got == [
        ("https://i.kr/v?articleNo=7&mode=view", "7", "candidate"), ("https://i.kr/b/#top", "", "anchor"), ("javascript:void(0)", "", "anchor"), ("https://i.kr/b/x.hwp", "", "download"),
        ("https://i.kr/b/v2?list_no=9", "9", "short_title"), ("https://i.kr/b/list?nPage=2", "", "navigation"), ("https://else.kr/a", "", "foreign_host"), ("https://i.kr/z", "", "no_notice"),
    ]
    r = {x.source: x for x in probe.probed(df, links).collect()}
    assert (r["s"].failure.verdict, r["s"].candidates, r["s"].next, r["s"].extra) == ("", 1, "read_feed", 1) and (r["t"].next, r["t"].candidates) == ("retry_later", 0)
    s = r["s"].structure
    assert (s.paging, s.search, s.query_keys, s.feed, s.table, s.forms, s.links, s.attachments) == ("nPage", "keyword", ["x"], "application/rss+xml", True, 1, 8, 1)
    m = spark.createDataFrame([('{"a":["R-7"]}', "r-7 ", ""), ('{"t":"Bridge Works"}', "", "the bridge of x"), ("{}", "", None), (None, None, "abcd"), ('{"t":"six"}', "9", "1234 2345 3456 4567 5678 with six")], "p string, r string, t string")
    assert [x[0] for x in m.select(probe.payload_matches("p", "r", "t")).collect()] == [True, True, False, False, False]


def test_contest_summary(spark):
    items = spark.createDataFrame([("a", "u"), ("a", ""), ("a", None), ("b", None), (None, "u")], "source string, link string")
    t = lambda h: datetime(2024, 1, 1, h)
    logs = spark.createDataFrame([
        ("a", 1, t(1), t(2), "error", "boom"), ("a", 2, t(3), t(4), "success", '{"fresh": 3, "kept": "4", "name": "x", "deep": {"n": 1}}'), ("c", 1, t(1), t(2), "partial_warning", '{"fresh": 5}'),
        ("d", 1, t(1), None, "error", "[1]"), ("d", 0, t(1), t(1), "success", "{}"), (None, 1, t(1), t(1), "success", "{broken"),
    ], "source string, log_id int, started_at timestamp, finished_at timestamp, status string, message string")
    s = contests.contest_summary(items, logs)
    got = {r.source: (r["items"], r.exact, r.status, r.last_success, r.note, r.stats) for r in s.collect()}
    assert got["a"] == (3, 1, "success", t(4), None, {"fresh": 3, "kept": 4}) and got["b"] == (1, 0, "previous_data_retained", None, None, {})
    assert got["c"] == (0, 0, "success_no_public_match", t(2), None, {"fresh": 5}) and got["d"] == (0, 0, "failed", None, "[1]", {}) and got[None][:3] == (1, 1, "success")
    total = contests.summed_stats(s).first()
    assert (total.sources, total["items"], total.exact, total.stats) == (5, 5, 2, {"fresh": 8, "kept": 4}) and total.states["failed"] == 1
    empty = contests.summed_stats(contests.contest_summary(items.limit(0), logs.limit(0))).first()
    assert empty.sources == 0 and empty.stats == {}
