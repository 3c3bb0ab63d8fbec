"""Golden values of the scalar expressions."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from noticeflow.functions import dates, html, identity, numbers, text, urls


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize("url, v1, v2, v3", [
    ("HTTP://Www.Example.com/a/?utm_source=x&b=2&a=1#top", "http://www.example.com/a?a=1&b=2", "https://example.com/a?a=1&b=2", "http://www.example.com/a/?b=2&a=1"),
    ("//Example.com/p//q/?ref=1", "https://example.com/p//q?ref=1", None, ""),
    ("https://m.example.com:443/", "https://m.example.com:443", "https://example.com", "https://m.example.com:443/"),
    ("https://example.com//x//y?fbclid=1", "https://example.com//x//y", "https://example.com//x//y", "https://example.com/x/y"),
    ("ftp://example.com/x", "ftp://example.com/x", None, ""),
    (None, "https://", None, ""),
])
def test_canonical_urls(spark, url, v1, v2, v3):
    assert one(spark, url, urls.canonical) == v1
    assert one(spark, url, urls.canonical_strict) == v2
    assert one(spark, url, urls.canonical_ordered) == v3


def test_url_parts(spark):
    assert one(spark, "https://www.a.example.co.kr:8080/x", urls.host) == "a.example.co.kr"
    assert one(spark, "https://a.example.co.kr/x", urls.last_label) == "kr"
    assert one(spark, "https://notexample.com/x", lambda c: urls.host_allowed(c, ["example.com"])) is False
    assert one(spark, "https://x/y?serviceKey=abc&n=1", urls.sanitised) == "https://x/y?n=1"
    assert one(spark, "javascript:alert(1)", urls.sanitised) is None
    verdict = lambda u, ok: one(spark, u, lambda c: urls.link_verdict(c, ["example.com"], F.lit(ok)))
    assert [verdict("https://example.com/", True), verdict("https://example.com/list.do", True), verdict("https://example.com/view?id=3", True),
            verdict("https://example.com/view?id=3", False), verdict("https://other.com/view", True), verdict("", True)] == ["portal", "list", "exact", "candidate", "external", "none"]


@pytest.mark.parametrize("written, day", [
    ("2026-11-05", date(2026, 11, 5)), ("2026.1.5", date(2026, 1, 5)), ("2026.01.05.", date(2026, 1, 5)), ("20261105", date(2026, 11, 5)),
    ("202611", date(2026, 11, 1)), ("202611050930", date(2026, 11, 5)), ("20261105093001", date(2026, 11, 5)), ("2026-11-05 09:30", date(2026, 11, 5)),
    ("2026-11-05T09:30:00+09:00", date(2026, 11, 5)), ("2026/11/05", date(2026, 11, 5)), ("20261399", None), ("soon", None), ("", None), (None, None),
])
def test_dates(spark, written, day):
    assert one(spark, written, dates.any_date) == day


def test_more_dates(spark):
    assert one(spark, "Mon, 03 Jun 2024 10:00:00 +0900", dates.mail_time) == datetime(2024, 6, 3, 1, 0)
    assert one(spark, "20240603010203", dates.article_time) == datetime(2024, 6, 3, 1, 2, 3)
    assert one(spark, "공고 2024.06.03 ~ 2024년 6월 10일, 2024-06-03", dates.dates_in) == [date(2024, 6, 3), date(2024, 6, 10)]
    life = one(spark, "2024-06-02 23:00:00", lambda c: dates.lifecycle(c.cast("timestamp"), F.lit("2024-06-03 01:00:00").cast("timestamp")))
    assert (life.status, life.days_until, life.closed_at) == ("active", 0, None)  # 23:00 UTC is the next day there
    assert one(spark, "2024-06-10", lambda c: dates.due_soon(c, F.lit("2024-06-03").cast("date"))) is True
    assert one(spark, None, lambda c: dates.due_soon(c, F.lit("2024-06-03").cast("date"))) is False
    assert one(spark, "2024-01-31", lambda c: dates.month_start(c.cast("date"), 1)) == date(2024, 2, 1)


def test_numbers(spark):
    assert [one(spark, v, numbers.amount) for v in ("1,234원", " 12.9 ", "x", None)] == [1234, 12, None, None]
    assert [one(spark, v, numbers.korean_amount) for v in ("약 3.5억 원", "총 1,000원", "none")] == [350000000, 1000, None]
    assert one(spark, "총 1,200 세대 공급", lambda c: numbers.count_before(c, "세대")) == 1200
    assert one(spark, "1", lambda c: numbers.ratio(c.cast("int"), F.lit(0))) is None


def test_text(spark):
    assert one(spark, " NaN ", text.present) == "" and one(spark, " x ", text.present) == "x"
    assert one(spark, "a \n\t b", text.collapse) == "a b"
    assert one(spark, "[공고] 모듈러 (주택)", text.compact) == "공고모듈러주택"
    assert one(spark, "모듈러-주택, A1", text.unicode_words) == "모듈러 주택 a1"
    assert one(spark, "Off-site building.", lambda c: text.has_phrase(c, "off site")) is True
    assert one(spark, "offsite", lambda c: text.has_phrase(c, "off site")) is False
    assert one(spark, "anything", lambda c: text.contains_text(c, "")) is False
    assert one(spark, "학교 모듈러", lambda c: text.matched_terms(c, ["모듈러", "x", "모듈러"])) == ["모듈러", "모듈러"]
    assert one(spark, "학교 모듈러 veto", lambda c: text.matched_terms(c, ["모듈러"], ["veto"])) == []
    assert one(spark, "정정 공고", lambda c: text.first_stage(c, (("correction", ("정정",)), ("main", ("공고",))), "unknown")) == "correction"
    assert one(spark, "a: b; url: http://x ;; c", text.key_values) == {"a": "b", "url": "http://x"}
    assert one(spark, "u?serviceKey=abc&n=1", lambda c: text.redact(c, ["serviceKey"])) == "u?serviceKey=***&n=1"
    assert one(spark, "Modular School building tender", lambda c: text.similar_titles(c, F.lit("tender for a school building, modular"))) is True
    assert one(spark, "Modular School", lambda c: text.similar_titles(c, F.lit("road works"))) is False


def test_identity(spark):
    import hashlib

    assert one(spark, " A ", lambda c: identity.business_hash(c, F.lit(None).cast("string"), F.lit("b"))) == hashlib.sha256(b"a||b").hexdigest()
    assert one(spark, "x", identity.short_id) == hashlib.sha1(b"x").hexdigest()[:16]
    key = lambda v: one(spark, v, lambda c: identity.identity_key([c, F.lit("1")], [F.lit("t")]))
    assert [key("n"), key("nan"), key(None)] == ["0:n|1", "1:t", "1:t"]


def test_html(spark):
    page = """<html><title> A &amp;\n B </title><script>var t = "<a href='x'>no</a>";</script><body><!-- c --><p>One <b>two</b></p>
    <a class="z" href="/view?id=1">First</a><a href='/f.pdf'>Plan</a><a href="/d?x=2">notes.hwp</a><a onclick="goView('12', 'b')">x</a></body></html>"""
    assert one(spark, page, html.title) == "A & B" and one(spark, "<h1>T</h1>", html.title) == "T" and one(spark, None, html.title) == ""
    assert one(spark, page, html.plain_text) == "A & B One two First Plan notes.hwp x"
    assert [tuple(x) for x in one(spark, page, html.attachments)] == [("Plan", "pdf", "/f.pdf"), ("notes.hwp", "hwp", "/d?x=2")]
    assert ("/view?id=1", "First") in [tuple(x) for x in one(spark, page, html.links)]
    assert one(spark, page, lambda c: html.call_arguments(c, "goView")) == [["12", "b"]]
    assert one(spark, '{"a": 1, "b": "x"}', html.flattened) == {"a": "1", "b": "x"} and one(spark, "no json", html.flattened) is None
