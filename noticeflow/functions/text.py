"""Text expressions: cleaning, normalising, term matching and scoring.  Column to Column, no UDF."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for a missing value.
MISSING = ("", "none", "nan", "nat", "null")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: Column | str) -> Column:
    """Lower case, trimmed; null is empty."""
    return F.lower(F.trim(F.coalesce(col(c).cast("string"), F.lit(""))))


def present(c: Column | str) -> Column:
    """Trimmed text, empty where the text stands for a missing value."""
    t = F.trim(F.coalesce(col(c).cast("string"), F.lit("")))
    return F.when(F.lower(t).isin(*MISSING), F.lit("")).otherwise(t)


def collapse(c: Column | str) -> Column:
    """Runs of white space become one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"[ \t\r\n\f\x0B]+", " "))


def compact(c: Column | str) -> Column:
    """Lower case without white space, brackets and punctuation, for comparing titles."""
    return F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"""[ \t\r\n\f\x0B\[\](){}<>.,:;!?'"/_·-]+""", "")


def ascii_words(c: Column | str) -> Column:
    """Lower-case ASCII letters and digits, everything else one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9]+", " "))


def unicode_words(c: Column | str) -> Column:
    """Lower-case letters and digits of any script, everything else one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def has_phrase(text: Column | str, phrase: str) -> Column:
    """Whether the phrase stands in the text as whole words, after both are normalised to ASCII words."""
    words = " ".join("".join(ch if ch.isascii() and ch.isalnum() else " " for ch in phrase.lower()).split())
    if not words:
        return F.lit(False)
    return F.contains(F.concat(F.lit(" "), ascii_words(text), F.lit(" ")), F.lit(f" {words} "))


def contains_text(haystack: Column | str, needle: str) -> Column:
    """Literal containment, ignoring case; an empty needle is found in nothing."""
    return F.contains(F.lower(F.coalesce(col(haystack), F.lit(""))), F.lit(needle.lower())) if needle else F.lit(False)


def any_term(text: Column | str, terms: Sequence[str]) -> Column:
    """Whether any term stands in the lower-cased text."""
    out = F.lit(False)
    for t in terms:
        out = out | contains_text(text, t)
    return out


def matched_terms(text: Column | str, terms: Sequence[str], vetoes: Sequence[str] = ()) -> Column:
    """The terms that stand in the text, in the order of the list, repeats kept; none if a veto stands there."""
    low = F.lower(F.coalesce(col(text), F.lit("")))
    found = F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(low, F.lower(t)))
    return F.when(any_term(text, vetoes), F.array().cast("array<string>")).otherwise(found) if vetoes else found


def first_stage(text: Column | str, stages: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """The first stage of which a term stands in the text."""
    out = F
    for name, terms in stages:
        out = out.when(any_term(text, terms), F.lit(name))
    return out.otherwise(F.lit(default)) if stages else F.lit(default)


def term_score(weights: Sequence[tuple[Column | str, Sequence[str], int]], least: int = 0, most: int = 100) -> Column:
    """Sum over (text, terms, weight) of weight per term found, repeats counted, clamped."""
    total = F.lit(0)
    for text, terms, weight in weights:
        low = F.lower(F.coalesce(col(text), F.lit("")))
        for t in terms:
            total = total + F.when(F.contains(low, F.lit(t.lower())), weight).otherwise(0)
    return F.greatest(F.lit(least), F.least(F.lit(most), total))


def script_language(text: Column | str) -> Column:
    """Struct (language, confidence) guessed from the scripts: kana, Hangul, Han, else Latin letters."""
    t = F.coalesce(col(text), F.lit(""))
    guess = lambda name, p: F.struct(F.lit(name).alias("language"), F.lit(p).alias("confidence"))
    return (
        F.when(F.rlike(t, F.lit(r"[\x{3040}-\x{30FF}]")), guess("ja", 0.75))
        .when(F.rlike(t, F.lit(r"[\x{AC00}-\x{D7A3}]")), guess("ko", 0.75))
        .when(F.rlike(t, F.lit(r"[\x{4E00}-\x{9FFF}]")), guess("zh", 0.65))
        .when(F.rlike(t, F.lit(r"[A-Za-z]")), guess("en", 0.55))
        .otherwise(guess("unknown", 0.0))
    )


def redact(text: Column | str, keys: Sequence[str]) -> Column:
    """Replaces the values of ``key=value`` pairs with the given keys by ***."""
    return F.regexp_replace(col(text), rf"(?i)\b({'|'.join(keys)})=[^&\s]+", "$1=***")


def key_values(text: Column | str) -> Column:
    """Map from 'key: value; key: value' text, split at the first colon, values trimmed."""
    pairs = F.transform(F.split(F.coalesce(col(text), F.lit("")), ";"), lambda p: F.trim(p))
    pairs = F.filter(pairs, lambda p: F.contains(p, F.lit(":")))
    entries = F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("key"), F.trim(F.regexp_replace(p, "^[^:]*:", "")).alias("value")))
    return F.aggregate(
        entries, F.create_map().cast("map<string,string>"),
        lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.map_from_arrays(F.array(e["key"]), F.array(e["value"]))),
    )


def similar_titles(a: Column | str, b: Column | str, hits: int = 3, length: int = 4) -> Column:
    """One compact title contains the other, or enough words of some length of the first stand in the second."""
    x, y = compact(a), compact(b)
    words = F.filter(F.split(unicode_words(a), " "), lambda w: F.char_length(w) >= length)
    count = F.size(F.filter(words, lambda w: F.contains(y, w)))
    enough = (F.size(words) > 0) & (count >= F.least(F.lit(hits), F.size(words)))
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x) | enough)


def mentions(columns: Sequence[Column | str], names: Sequence[str]) -> Column:
    """Whether a name stands in the space-joined columns; null counts as empty, blank names are skipped."""
    return any_term(F.concat_ws(" ", *[F.coalesce(col(c), F.lit("")) for c in columns]), [n for n in names if n.strip()])


def named_among(c: Column | str, names: Iterable[str]) -> Column:
    """Whether a name is one of ``names``, both lower-cased and without all but ASCII letters and digits; null does not count."""
    plain = sorted({"".join(x for x in n.lower() if x.isascii() and x.isalnum()) for n in names})
    return F.coalesce(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]", "").isin(plain), F.lit(False))
