"""Random pieces of runs that a base span covers in part."""

import random

from noticeflow.llm import secrets

BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def cases():
    """(text, start and end of each random piece)."""
    rng = random.Random(4)
    key = lambda n, a=BASE64: "".join(rng.choices(a, k=n))
    # a sign that no base span takes in stands on each side of a base span
    token = lambda n: "Z" + key(n - 2, BASE64[:62]) + "Q"
    access, digest = "AKIA" + key(16, BASE64[:26]), key(40, "0123456789abcdef")
    out = []
    for _ in range(20):
        t = token(40)
        out.append((f"{access}/{t} end", [(20, 61)]))
        out.append((f"🙂 {digest}-{t}", [(42, 83)]))
        out.append((f"{t}/{access}/{t}", [(0, 41), (61, 102)]))
    short = "Zx" + "Q"
    return out + [(f"{access}/{short} {digest}-{short} {short}-{digest}-{short}", []), (f"{access}/{digest}", [])]


def test_pieces_beside_base_spans(spark):
    rows = cases()
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    scanned = {r.doc_id: r.found for r in secrets.scan(docs).collect()}
    hit = {i: [(x.start, x.end) for x in found if x.k == 3] for i, found in scanned.items()}
    want = [(i, w) for i, (_, spans) in enumerate(rows) for w in spans]
    assert sum(w in hit[i] for i, w in want) >= 0.95 * len(want)
    for i, (_, spans) in enumerate(rows):
        assert set(hit[i]) <= set(spans), rows[i]
        base = [(x.start, x.end) for x in scanned[i] if x.k < 3]
        assert base and not [1 for s, e in hit[i] for b, c in base if s < c and b < e]
