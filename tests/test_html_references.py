"""Character references against the standard library and typed values; links in every kind of quotation marks."""

import html as standard
import random
from html.entities import html5

from noticeflow.functions import html

TYPED = {
    "&#8217;": "’", "&ndash;": "–", "&hellip;": "…", "&#x2014;": "—", "&amp;lt;": "&lt;", "a &amp;amp; b": "a &amp; b", "&nbsp;": "\xa0", "&notit;": "¬it;",
    "&copy 2024": "© 2024", "&#0;": "\ufffd", "&#x80;": "€", "&#xD800;": "\ufffd", "&#99999999999999999999;": "\ufffd", "&;": "&;", "&": "&", "AT&T": "AT&T", "&bogus;": "&bogus;",
    "&middot;&copy;": "·©", "&NewLine;x": "\nx", "&#x1F600;": "😀", "&#12;": "\x0c", "&#65": "A", "&#x;": "&#x;", "&CounterClockwiseContourIntegral;": "∳", "가&middot나": "가·나",
}


def test_typed_values_and_the_standard_library(spark):
    rng = random.Random(2)
    texts = list(TYPED) + [f"x&{n} y" for n in html5] + [f"&#{n};" for n in [*range(0, 300), 0xFDD0, 0xFFFF, 0x1FFFE, 0x10FFFF, 0x110000]]
    parts = ["&", "&#", ";", "amp", "lt", "x", "65", "not", " ", "é", "#x41", "&amp;", "copy"]
    texts += ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.u for r in df.select("i", html.unescaped("t").alias("u")).collect()}
    wrong = [(t, got[i], standard.unescape(t)) for i, t in enumerate(texts) if got[i] != standard.unescape(t)]
    assert not wrong
    assert {t: got[i] for i, t in enumerate(TYPED)} == TYPED


def test_links(spark):
    page = """<a class=x href=/a?b=1&amp;c=2>one</a> <A HREF='/q"x'>t&hellip;</A><a data-href="no">z</a><a
      href = "/it's">three <b>b</b></a><abbr href="/no">n</abbr>"""
    row = spark.createDataFrame([(page,), (None,)], "h string").select(html.links("h").alias("l")).collect()
    assert [tuple(x) for x in row[0].l] == [("/a?b=1&c=2", "one"), ('/q"x', "t…"), ("/it's", "three b")]
    assert row[1].l == []
