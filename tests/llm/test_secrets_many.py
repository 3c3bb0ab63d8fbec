"""Many matches in one text: places as in a plain scan, and time that grows with the text."""

import random
import re
import time

from noticeflow.llm import secrets


def texts():
    rng = random.Random(12)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    word = lambda: rng.choice(["é", "token=", "secret: ", "x" * 3, "AKIA" + "".join(rng.choices("ABC123", k=16)), "".join(rng.choices("0123456789abcdef", k=rng.randint(10, 40))), "".join(rng.choices(b64, k=rng.randint(5, 70)))])
    out = [rng.choice(["", " ", "\n", "-", "_"]).join(word() for _ in range(rng.randint(0, 60))) for _ in range(150)]
    return out + ["", "a" * 19, "A" * 20]


def test_places_against_a_plain_scan(spark):
    data = texts()
    docs = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")
    rows = {r.doc_id: r.spans for r in secrets.digest(secrets.scan(docs), "doc_id").collect()}
    for i, t in enumerate(data):
        base = [(m.start(), 0, m.end()) for m in re.finditer(secrets.ASSIGN, t) if len(m[1]) >= 12]
        base += [(m.start(), k, m.end()) for k, p in ((1, secrets.ACCESS), (2, secrets.HEX)) for m in re.finditer(p, t)]
        got = [s.split(":") for s in rows[i].split(",") if s]
        found = [(int(a), secrets.KINDS.index(k), int(b)) for k, a, b in got]
        assert [x for x in found if x[1] < 3] == sorted(base)
        covered = {c for a, _, b in base for c in range(a, b)}
        pieces, free = [], "".join(" " if c in covered else ch for c, ch in enumerate(t))
        pieces = {(m.start(), m.end()) for m in re.finditer(secrets.CANDIDATE, free)}
        assert {(a, b) for a, k, b in found if k == 3} <= pieces


def test_every_piece_is_tested(spark, monkeypatch):
    """With a threshold that lets all pass, the reported pieces are all that the base spans leave."""
    monkeypatch.setattr(secrets, "threshold", lambda *a: float("-inf"))
    data = texts()
    docs = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")
    for r in secrets.digest(secrets.scan(docs), "doc_id").collect():
        t = data[r.doc_id]
        base = [m.span() for m in re.finditer(secrets.ASSIGN, t) if len(m[1]) >= 12]
        base += [m.span() for p in (secrets.ACCESS, secrets.HEX) for m in re.finditer(p, t)]
        covered = {c for a, b in base for c in range(a, b)}
        free = "".join(" " if c in covered else ch for c, ch in enumerate(t))
        want = [f"random:{m.start()}:{m.end()}" for m in re.finditer(secrets.CANDIDATE, free)]
        assert [s for s in r.spans.split(",") if s.startswith("random")] == want


def test_time_doubles_with_the_matches(spark):
    rng = random.Random(1)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    line = lambda: "".join(rng.choices(b64, k=60)) + "\n" + "".join(rng.choices("0123456789abcdef", k=20)) + "\n"
    took = []
    for n in (10_000, 10_000, 20_000, 40_000):  # 0.8, 1.6 and 3.2 MB; the first warms up
        docs = spark.createDataFrame([(1, "".join(line() for _ in range(n)))], "doc_id long, text string")
        began = time.time()
        r = secrets.digest(secrets.scan(docs), "doc_id").collect()[0]
        took.append(time.time() - began)
        assert r.n_hex >= n
    assert took[2] < 2.3 * took[1] + 1 and took[3] < 2.3 * took[2] + 1
