"""Expressions over whole records: redaction, masking, action lists, selection of lines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, collapse

# Keys whose values are secret, and marks of addresses on the own machine.
SECRET_KEYS = ("serviceKey", "apiKey", "api_key", "token", "password", "secret", "client_secret", "authorization")
LOCAL_MARKS = r"(?i)(^|[^a-z])([a-z]:\\|file://|/home/|/users/|/root/|localhost|127\.0\.0\.1)"


def masked_url(url: Column | str) -> Column:
    """The address with the values of secret query keys replaced."""
    return F.regexp_replace(col(url), rf"(?i)([?&](?:{'|'.join(SECRET_KEYS)})=)[^&#]*", "$1***")


def unsafe_reference(record: Column) -> Column:
    """Whether a record, as JSON, names a local path or the own machine."""
    return F.rlike(F.coalesce(record, F.lit("")), F.lit(LOCAL_MARKS))


def redacted_json(payload: Column | str) -> Column:
    """JSON text without the values of secret keys at any depth; addresses that are not http(s) go.

    Secret keys keep their place with the value ***; the pattern covers text and plain values, so
    no parser is needed and a broken text is redacted too.
    """
    keys = "|".join(SECRET_KEYS)
    t = F.regexp_replace(col(payload), rf'(?i)("(?:{keys})"\s*:\s*)("(?:[^"\\]|\\.)*"|[^,}}\]\s]+)', '$1"***"')
    t = F.regexp_replace(t, rf"(?i)((?:{keys})=)[^&\"\s\\]+", "$1***")
    return F.regexp_replace(t, r'"(?:javascript|file|data):[^"]*"', '""')


def actions(choices: Sequence[tuple[str, Column]]) -> Column:
    """Distinct names of the actions that apply, in order."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in choices])))


def lookup_key(kind: Column, keys: Mapping[str, Sequence[tuple[str, Column]]]) -> Column:
    """JSON of what to look a record up by at its source: the present fields for its kind."""
    out = F
    for name, fields in keys.items():
        out = out.when(kind == name, F.to_json(F.struct(*[c.alias(n) for n, c in fields])))
    return out.otherwise(F.lit("{}"))


def lines_with(text: Column | str, terms: Sequence[str], n: int) -> Column:
    """The first n distinct lines that hold a term, white space collapsed, joined by line breaks."""
    lines = F.transform(F.split(F.coalesce(col(text), F.lit("")), "\n"), collapse)
    hit = F.filter(lines, lambda x: F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(x), F.lower(t))))
    return F.array_join(F.slice(F.array_distinct(hit), 1, n), "\n")


def summary_lines(text: Column | str, least: int, n: int, most: int) -> Column:
    """The first n lines of some length, joined by spaces and cut."""
    lines = F.transform(F.split(F.coalesce(col(text), F.lit("")), "\n"), collapse)
    return F.substring(F.array_join(F.slice(F.filter(lines, lambda x: F.char_length(x) >= least), 1, n), " "), 1, most)
