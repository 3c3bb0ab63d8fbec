"""Secret scan with a randomness test battery (DataFrame functions only).

Base spans come from three patterns.  The battery looks at what they leave of every run of token
characters, each piece that is long enough.  The run's encoding is inferred as the smallest alphabet
that holds it, and four statistics are compared with what words, identifiers and paths give there:

* chi-squared of the character counts against equal use of the alphabet, by the share of agreeing
  pairs of characters: text repeats its common letters (levels per alphabet, ``AGREEING``);
* runs of kinds (lower, upper, digit, sign): identifiers change kind at the humps of their words,
  where an upper letter before a lower one begins a word and a sign separates two;
* runs of vowels and consonants among neighbouring letters: text alternates, random letters, of
  which fewer are vowels, do so half as often;
* serial correlation of the vowel marks at a distance of one: clearly negative in text, near zero in
  random letters.

Alphabets without two kinds or without letters leave out the tests that need them.  The last two
depend closely on each other (correlation over source code 0.87, ``VOWEL_CORRELATION``) and count as
one, their mean over its deviation.  The deviations, each at most four, are added and divided by the
deviation of their sum, with a correlation between any two of ``CORRELATION`` (measured: 0.05 to
0.16), so the p-value holds although the tests depend on each other.  A run that is too even to be random,
such as a listed alphabet, is no find.  Strings of digits alone are not told from numbers.

All candidates of the corpus then go through a weighted Benjamini-Hochberg procedure: weights grow
with the length, since a short run cannot show its randomness, and average one over the candidates,
so the share of false finds among those reported stays below ``FALSE_SHARE`` as far as the null
holds.  ``tests/llm/test_secrets_battery.py`` holds recall by alphabet and length, and false finds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: The kinds of base spans, their patterns, the group measured and its least length.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12
#: A run of token characters for the battery, and its share of false finds.
CANDIDATE_LEAST, FALSE_SHARE = 20, 0.01
CANDIDATE = rf"[A-Za-z0-9+/_-]{{{CANDIDATE_LEAST},}}"
#: Words, identifiers and paths as the null hypothesis: chance that two characters agree by alphabet,
#: that a kind changes, that vowels and consonants alternate, and the serial correlation of vowels.
AGREEING = {10: 0.10, 16: 0.11, 26: 0.060, 32: 0.055, 36: 0.055, 52: 0.046, 62: 0.042, 64: 0.048}
KIND_CHANGES, VOWEL_CHANGES, VOWEL_SERIAL = 0.13, 0.67, -0.38
#: Spread of counts relative to independent draws, correlation between two tests, largest deviation,
#: deviation below a random string's agreeing pairs that is too even, and letter pairs needed.
SPREAD, CORRELATION, VOWEL_CORRELATION, MOST, EVEN, LEAST_PAIRS = 1.15, 0.16, 0.87, 4.0, 3.3, 4
#: Steps of -ln p in which the procedure counts candidates.
STEP = 0.05


SPANS = "array<struct<start:int,end:int,match:string>>"


def _running(values: Column, join) -> Column:
    """Running sums (or other joins) of an array of integers from the left, in doubling steps.

    Growing an array element by element would copy it each time; this takes a pass over the array for
    every doubling of its length.
    """
    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda s: s < F.size(values))
    return F.aggregate(
        steps, values, lambda acc, s: F.transform(acc, lambda x, i: F.when(i >= s, join(x, F.get(acc, F.greatest(F.lit(0), i - s)))).otherwise(x))
    )


def _cover(text: Column, pattern: str) -> Column:
    """Array of (start, end, match) of all leftmost matches that do not overlap, in code points.

    The text between the matches gives their places: matches and gaps alternate.
    """

    def spans(parts: Column) -> Column:
        lengths = F.zip_with(parts["found"], F.slice(parts["gaps"], F.lit(1), F.size(parts["found"])), lambda m, g: F.char_length(m) + F.char_length(g))
        placed = lambda ends: F.zip_with(
            parts["found"], ends, lambda m, e: F.struct((e - F.char_length(m)).alias("start"), e.alias("end"), m.alias("match"))
        )
        return _let(_let(lengths, lambda n: _running(n, lambda x, y: x + y)), placed)

    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern).alias("gaps"))
    return F.when(F.rlike(text, F.lit(pattern)), _let(parts, spans)).otherwise(F.array().cast(SPANS))


def _apart(base: Column) -> Column:
    """Base spans, sorted by start, as spans that do not overlap: each begins where those before it have ended."""

    def cut(ends: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(ends, i - 1)).otherwise(F.lit(0))
        each = F.transform(base, lambda b, i: F.struct(F.greatest(b["start"], before(i)).alias("start"), F.greatest(b["end"], before(i)).alias("end")))
        return F.filter(each, lambda x: x["start"] < x["end"])

    return _let(_running(F.transform(base, lambda b: b["end"]), F.greatest), cut)


def _count_below(spans: Column, field: str, limit: Column) -> Column:
    """How many of the spans, which are in order, have a field of at most ``limit``: a binary search."""
    bits = F.filter(F.array(*[F.lit(1 << k) for k in reversed(range(31))]), lambda b: b <= F.size(spans))
    return F.aggregate(
        bits, F.lit(0), lambda n, b: F.when((n + b <= F.size(spans)) & (F.get(spans, n + b - 1)[field] <= limit), n + b).otherwise(n)
    )


def _left(run: Column, apart: Column) -> Column:
    """Array of (start, end, match) of the pieces of a run between the base spans, if long enough.

    ``apart`` is in order and without overlaps; the run's end closes the last piece.
    """

    def pieces(over: Column) -> Column:
        ends = F.concat(F.transform(over, lambda b: b["start"]), F.array(run["end"]))
        limits = F.transform(ends, lambda e, i: F.struct(F.when(i > 0, F.get(over, i - 1)["end"]).otherwise(run["start"]).alias("start"), e.alias("end")))
        long = F.filter(limits, lambda x: x["end"] - x["start"] >= CANDIDATE_LEAST)
        # runs are ASCII, and bytes are found at once
        part = lambda x: F.substring(run["match"].cast("binary"), x["start"] - run["start"] + 1, x["end"] - x["start"]).cast("string")
        return F.transform(long, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), part(x).alias("match")))

    first = _count_below(apart, "end", run["start"])
    over = _let(first, lambda n: F.slice(apart, n + 1, F.greatest(F.lit(0), _count_below(apart, "start", run["end"] - 1) - n)))
    return F.when(F.size(apart) == 0, F.array(run)).otherwise(_let(over, pieces))


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, by a rational fit of the error function (error under 1e-7)."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + 0.5 * x)
    coefficients = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        poly = poly * t + c
    tail = 0.5 * t * F.exp(F.greatest(F.lit(-700.0), poly - x * x))
    return F.when(z >= 0, tail).otherwise(1 - tail)


def alphabet(token: Column) -> Column:
    """Size of the smallest alphabet of the known encodings that holds the token."""
    sizes = ((r"^[0-9]+$", 10), (r"^([0-9a-f]+|[0-9A-F]+)$", 16), (r"^([a-z]+|[A-Z]+)$", 26), (r"^[A-Z2-7]+$", 32),
             (r"^([a-z0-9]+|[A-Z0-9]+)$", 36), (r"^[A-Za-z]+$", 52), (r"^[A-Za-z0-9]+$", 62))
    out = F
    for pattern, n in sizes:
        out = out.when(F.rlike(token, F.lit(pattern)), n)
    return out.otherwise(64).cast("double")


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _count(text: Column, part: str) -> Column:
    return (F.char_length(text) - F.char_length(F.replace(text, F.lit(part), F.lit("")))) / len(part)


def figures(token: Column) -> Column:
    """Struct of length, alphabet and the counts of the tests; all are linear in the length."""
    low, up, digits, signs = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/_-"
    kinds = F.translate(token, low + up + digits + signs, "l" * 26 + "U" * 26 + "d" * 10 + "s" * 4)
    marks = F.translate(F.lower(token), low + digits + signs, "".join("V" if c in "aeiou" else "C" for c in low) + "x" * 14)
    collapsed = lambda t: F.regexp_replace(t, r"(.)\1+", "$1")
    agreeing = F.aggregate(
        F.array_distinct(F.split(token, "")), F.lit(0.0),
        lambda total, c: total + _let((F.char_length(token) - F.char_length(F.replace(token, c, F.lit("")))).cast("double"), lambda x: x * (x - 1)),
    )
    strings = F.struct(kinds.alias("kinds"), marks.alias("marks"), collapsed(kinds).alias("runs"), collapsed(marks).alias("vowel_runs"))

    def counts(t: Column) -> Column:
        n = F.char_length(t["kinds"]).cast("double")
        # neighbours of two kinds, but an upper letter before a lower one begins a word, and a sign counts once
        ends = F.when(F.endswith(t["runs"], F.lit("s")), 1).otherwise(0)
        changes = F.char_length(t["runs"]) - 1 - _count(t["runs"], "Ul") - (_count(t["runs"], "s") - ends)
        letters, vowels = n - _count(t["marks"], "x"), _count(t["marks"], "V")
        segments = _count(F.regexp_replace(t["marks"], "[VC]+", "W"), "W")
        alternations = F.char_length(t["vowel_runs"]) - _count(t["vowel_runs"], "x") - segments
        return F.struct(
            n.alias("n"), alphabet(token).alias("a"), (agreeing / (n * (n - 1))).alias("agreeing"), (changes / (n - 1)).alias("changes"),
            (letters - segments).alias("pairs"), letters.alias("letters"), vowels.alias("vowels"), alternations.alias("alternations"),
        )

    return _let(strings, counts)


def deviations(v: Column) -> Column:
    """Array of the deviations from the null, towards randomness, of the tests that the figures allow."""
    level = F
    for a, share in AGREEING.items():
        level = level.when(v["a"] == a, share)
    level = level.otherwise(AGREEING[64])
    n, m = v["n"], v["pairs"]
    spread = lambda p, k: SPREAD * F.sqrt(p * (1 - p) / k)
    vowel_share = v["vowels"] / v["letters"]
    rate = v["alternations"] / m
    serial = 1 - rate / (2 * vowel_share * (1 - vowel_share))
    alternate = (VOWEL_CHANGES - rate) / spread(F.lit(VOWEL_CHANGES), m)
    apart = (serial - VOWEL_SERIAL) * F.sqrt(m)
    both = (alternate + apart) / math.sqrt(2 + 2 * VOWEL_CORRELATION)
    return F.array_compact(F.array(
        (level - v["agreeing"]) / spread(level, n * (n - 1) / 2),
        F.when(~v["a"].isin(10, 26), (v["changes"] - KIND_CHANGES) / spread(F.lit(KIND_CHANGES), n - 1)),
        F.when(m >= LEAST_PAIRS, F.when((v["vowels"] > 0) & (v["vowels"] < v["letters"]), both).otherwise(alternate)),
    ))


def evidence(token: Column) -> Column:
    """-ln of the combined p-value of the battery under the hypothesis that the token is words."""

    def combined(v: Column) -> Column:
        def tail(z: Column) -> Column:
            k = F.size(z)
            total = F.aggregate(z, F.lit(0.0), lambda t, x: t + F.greatest(F.lit(-MOST), F.least(F.lit(MOST), x)))
            return _let(total / F.sqrt(k + k * (k - 1) * CORRELATION), lambda x: F.greatest(F.lit(0.0), -F.log(_upper_tail(x))))

        share = 1 / v["a"]
        even = (share - v["agreeing"]) / F.sqrt(2 * share * (1 - share) / (v["n"] * (v["n"] - 1))) > EVEN
        return F.when(even, F.lit(0.0)).otherwise(_let(deviations(v), tail))

    return _let(figures(token), combined)


def weight(length: Column) -> Column:
    """Weight of a candidate before scaling: grows with its length up to that of a long key."""
    return F.least(F.lit(4.0), length / 20.0)


def threshold(candidates: DataFrame, share: float = FALSE_SHARE) -> float:
    """Least weighted evidence to report: the weighted Benjamini-Hochberg step-up over all candidates.

    ``candidates`` has ``length`` and ``evidence``.  They are counted in steps of the weighted
    evidence, rounded down, so the procedure stays on the safe side.  The number of steps is bounded.
    """
    one = candidates.agg(F.count(F.lit(1)).alias("m"), F.avg(weight(F.col("length"))).alias("w")).first()
    if not one.m:
        return float("inf")
    score = F.col("evidence") + F.log(weight(F.col("length")) / one.w)
    steps = candidates.groupBy(F.floor(F.least(score, F.lit(2500.0)) / STEP).alias("k")).count().orderBy(F.desc("k")).collect()
    seen, best = 0, float("inf")
    for r in steps:
        seen += r["count"]
        if math.exp(-r.k * STEP) <= share * seen / one.m:
            best = r.k * STEP
    return best - math.log(1 / one.w) if best < float("inf") else best


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text", share: float = FALSE_SHARE) -> DataFrame:
    """One row per row of ``docs``: id and ``found``, an array of (start, kind, end, evidence).

    Spans count code points, the end exclusive, ordered by start, then kind as in ``KINDS``.  Base
    spans have no evidence.  Runs, or the pieces of them beside base spans, that the battery reports
    are of kind ``random`` and never overlap a base span.  Null text counts as empty and has no spans; repeated rows are scanned alike; extra
    columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    t = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    t = t.select(
        "id",
        _cover(F.col("t"), ASSIGN).alias("assign"),
        _cover(F.col("t"), ACCESS).alias("access"),
        _cover(F.col("t"), HEX).alias("hex"),
        _cover(F.col("t"), CANDIDATE).alias("runs"),
    )
    span = lambda k: lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("k"), x["end"].alias("end"))
    long = F.filter("assign", lambda x: F.char_length(F.regexp_extract(x["match"], ASSIGN, 1)) >= ASSIGN_LEAST)
    base = F.concat(F.transform(long, span(0)), F.transform("access", span(1)), F.transform("hex", span(2)))
    t = t.withColumn("base", F.array_sort(base))
    t = t.withColumn("apart", _apart(F.col("base")))
    free = F.flatten(F.transform("runs", lambda r: _left(r, F.col("apart"))))
    tested = F.transform(
        free, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), evidence(r["match"]).alias("evidence"))
    )
    kept = scratch.keep(t.select("id", "base", tested.alias("tested")), "spans")
    each = kept.select(F.explode("tested").alias("c")).select((F.col("c.end") - F.col("c.start")).alias("length"), "c.evidence")
    least = threshold(each, share)
    more = F.filter("tested", lambda c: c["evidence"] + F.log(weight(c["end"] - c["start"])) >= F.lit(least))
    none = F.lit(None).cast("double")
    every = F.concat(
        F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["k"].alias("k"), b["end"].alias("end"), none.alias("evidence"))),
        F.transform(more, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("k"), c["end"].alias("end"), c["evidence"].alias("evidence"))),
    )
    return kept.select(F.col("id").alias(id), F.array_sort(every).alias("found"))


def digest(scanned: DataFrame, id: str) -> DataFrame:
    """Counts and digests of the spans of ``scan``."""
    kind = F.array(*map(F.lit, KINDS))
    shown = lambda x: F.concat(F.element_at(kind, x["k"] + 1), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))
    count = lambda k: F.size(F.filter("found", lambda x: x["k"] == k)).cast("long")
    base = F.concat_ws(",", F.transform(F.filter("found", lambda x: x["k"] < 3), shown))
    return scanned.select(
        id,
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(base, 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("found", shown)).alias("spans"),
        count(3).alias("n_random"),
    )
