import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from noticeflow.llm import secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
BASE = (("assign", ASSIGN, 2, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16))


def brute(text):
    return [
        sorted((m.start(), k, m.end()) for m in p.finditer(text or "") if len(m[g]) >= n) for k, (_, p, g, n) in enumerate(BASE)
    ]


def texts():
    rng = random.Random(3)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda n, a=alnum: "".join(rng.choices(a, k=n))
    plain = "the quick brown fox jumps over the lazy dog and internationalisationable things"
    out = [None, "", " ", "🙂é password: hunter2hunter2 é", 'API_KEY = "' + key(30) + '" x', "secret:token: abcdefghijklmnop",
           "password=secret=abcdefghijklmnop", "Token:'short'", "AKIA" + key(14, "ABC123"), "AKIAAKIA" + "A" * 9, "xAKIA" + key(13, "ABC"),
           "deadbeef" * 2, "deadbeef" * 4 + "G" + "0" * 15, "PASSWD  :   " + key(12), "api-key: " + key(20), "\n".join(["token=" + key(40, "0123456789abcdef")] * 3)]
    out += [f"🙂 {plain} {key(40)} {plain}" for _ in range(40)]
    out += [f"{plain} donaudampfschifffahrtsgesellschaftskapitaen einunggeberlichkeitenschaftver {i}" for i in range(200)]
    return out + ["word " * 40000 + key(64)]


def test_against_brute_force(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("base", F.lit("clash"))
    got = {r.doc_id: r for r in secrets.digest(secrets.scan(docs), "doc_id").collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        b = brute(t)
        r = got[i]
        assert [r.n_assign, r.n_access, r.n_hex] == list(map(len, b)), t
        shown = [f"{BASE[k][0]}:{s}:{e}" for s, k, e in sorted(sum(b, []))]
        assert r.base_sha256 == hashlib.sha256(",".join(shown).encode()).hexdigest(), t
        assert [s for s in r.spans.split(",") if s and not s.startswith("random")] == shown
    extra = {i: r.spans for i, r in got.items() if "random" in r.spans}
    hits = [i for i, t in rows if t and t.startswith("🙂 the")]
    assert len(extra.keys() & set(hits)) >= 38
    assert not [i for i in extra if "donau" in (rows[i][1] or "")]
    for i in extra.keys() & set(hits):
        s, e = map(int, re.search(r"random:(\d+):(\d+)", got[i].spans).groups())
        assert re.fullmatch("[A-Za-z0-9]{40}", rows[i][1][s:e])
    assert "random" in got[len(rows) - 1].spans


def test_text_alone_reports_nothing(spark):
    words = ["internationalisierung" + "s" * (i % 3) + "verwaltungsgericht" for i in range(50)]
    docs = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "doc_id long, text string")
    assert secrets.digest(secrets.scan(docs), "doc_id").where("spans <> ''").count() == 0
    assert secrets.scan(docs.limit(0)).count() == 0


def test_long_runs_take_linear_work(spark):
    rng = random.Random(8)
    blob = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=200_000))
    docs = spark.createDataFrame([(1, "x " + blob), (2, "abstract" * 20_000)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secrets.digest(secrets.scan(docs), "doc_id").collect()}
    assert got == {1: f"random:2:{len(blob) + 2}", 2: ""}


def brute_evidence(t):
    """The battery by plain loops over characters."""
    n, a = len(t), next(k for k, p in ((10, "[0-9]+"), (16, "[0-9a-f]+|[0-9A-F]+"), (26, "[a-z]+|[A-Z]+"), (32, "[A-Z2-7]+"), (36, "[a-z0-9]+|[A-Z0-9]+"), (52, "[A-Za-z]+"), (62, "[A-Za-z0-9]+"), (64, ".*")) if re.fullmatch(p, t))
    kind = lambda c: "l" if c.islower() else "U" if c.isupper() else "d" if c.isdigit() else "s"
    agree = sum(t.count(c) * (t.count(c) - 1) for c in set(t)) / (n * (n - 1))
    if (1 / a - agree) / math.sqrt(2 / a * (1 - 1 / a) / (n * (n - 1))) > secrets.EVEN:
        return 0.0
    sd = lambda p, k: secrets.SPREAD * math.sqrt(p * (1 - p) / k)
    level = secrets.AGREEING[a]
    z = [(level - agree) / sd(level, n * (n - 1) / 2)]
    if a not in (10, 26):
        changes = sum(kind(x) != kind(y) and (kind(x), kind(y)) != ("U", "l") and kind(x) != "s" for x, y in zip(t, t[1:]))
        z.append((changes / (n - 1) - secrets.KIND_CHANGES) / sd(secrets.KIND_CHANGES, n - 1))
    pairs = [(x in "aeiou", y in "aeiou") for x, y in zip(t.lower(), t.lower()[1:]) if x.isalpha() and y.isalpha()]
    if len(pairs) >= secrets.LEAST_PAIRS:
        rate = sum(x != y for x, y in pairs) / len(pairs)
        z.append((secrets.VOWEL_CHANGES - rate) / sd(secrets.VOWEL_CHANGES, len(pairs)))
        p = sum(c in "aeiou" for c in t.lower()) / sum(c.isalpha() for c in t)
        if 0 < p < 1:
            apart = (1 - rate / (2 * p * (1 - p)) - secrets.VOWEL_SERIAL) * math.sqrt(len(pairs))
            z[-1] = (z[-1] + apart) / math.sqrt(2 + 2 * secrets.VOWEL_CORRELATION)
    x = sum(max(-secrets.MOST, min(secrets.MOST, y)) for y in z) / math.sqrt(len(z) + len(z) * (len(z) - 1) * secrets.CORRELATION)
    return max(0.0, -math.log(math.erfc(x / math.sqrt(2)) / 2))


def test_statistics(spark):
    """The counts by string functions against the plain loops."""
    rng = random.Random(6)
    tokens = ["aB3dE5gH7jK9mN1pQ2sT", "Zz9Zz9Zz9Zz9Zz9Zz9Zz9", "abcdefghijklmnopqrstuvWX1", "abcdefghijklmnopqrstuvwxyz", "a" * 30, "-" * 20, "src/main/java/com/Foo2Bar",
              "00000000001234567890", "QWJLZMXPVTRKHNYBGCFDSQAEWIUOXZKJ", "a1-b2-c3-d4-e5-f6-g7-h8-i9", "_" + "aB" * 12 + "/", "bcdfghjklmnpqrstvwxz", "DEADBEEF0123456789AB"]
    tokens += ["".join(rng.choices("abcXYZ019+/_-eiEI", k=rng.randint(20, 90))) for _ in range(200)]
    got = [r.e for r in spark.createDataFrame([(t,) for t in tokens], "t string").select(secrets.evidence(F.col("t")).alias("e")).collect()]
    wrong = [(t, x, brute_evidence(t)) for x, t in zip(got, tokens) if abs(x - brute_evidence(t)) > 1e-5 * max(1, x)]
    assert not wrong, wrong[:3]
