"""URL expressions.  Three canonical forms are kept apart, since their rules differ."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# Query keys that only track.
TRACKING = ("fbclid", "gclid", "dclid", "msclkid", "mc_cid", "mc_eid")
TRACKING_MORE = (*TRACKING, "ref", "source")
SECRET_KEYS = ("servicekey", "apikey", "api_key", "token", "key", "secret", "password", "client_secret")


def _parts(url: Column) -> dict[str, Column]:
    """Scheme, authority, path and query by one pattern, so that a malformed part gives empty text."""
    u = F.trim(F.coalesce(url, F.lit("")))
    pattern = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
    part = lambda i: F.regexp_extract(u, pattern, i)
    return {"scheme": F.lower(part(1)), "host": F.lower(part(2)), "path": part(3), "query": part(4)}


def _kept_pairs(query: Column, dropped: Sequence[str]) -> Column:
    """Array of the query's pairs without the utm_ family and the dropped keys."""
    key = lambda p: F.lower(F.substring_index(p, "=", 1))
    return F.filter(
        F.split(query, "&"), lambda p: (p != "") & ~F.startswith(key(p), F.lit("utm_")) & ~key(p).isin(*dropped)
    )


def canonical(url: Column | str) -> Column:
    """Lower-case scheme and host, no tracking keys, pairs sorted, no fragment, no slash at the end, https by default."""
    p = _parts(col(url))
    query = F.array_join(F.array_sort(_kept_pairs(p["query"], TRACKING)), "&")
    return F.concat(
        F.when(p["scheme"] == "", F.lit("https")).otherwise(p["scheme"]), F.lit("://"), p["host"],
        F.regexp_replace(p["path"], "/+$", ""), F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)),
    )


def canonical_strict(url: Column | str) -> Column:
    """As ``canonical``, for http and https only (else null): no default port, no www. or m., more tracking keys."""
    p = _parts(col(url))
    host = F.regexp_replace(p["host"], r":(80|443)$", "")
    query = F.array_join(F.array_sort(_kept_pairs(p["query"], TRACKING_MORE)), "&")
    out = F.concat(
        F.lit("https://"), F.regexp_replace(host, r"^(www\.|m\.|mobile\.)+", ""), F.regexp_replace(p["path"], "/+$", ""),
        F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)),
    )
    return F.when(p["scheme"].isin("http", "https") & (p["host"] != ""), out)


def canonical_ordered(url: Column | str) -> Column:
    """Http and https only (else empty): double slashes in the path become one; order of pairs and end slash stay."""
    p = _parts(col(url))
    query = F.array_join(_kept_pairs(p["query"], TRACKING_MORE), "&")
    out = F.concat(
        p["scheme"], F.lit("://"), p["host"], F.regexp_replace(p["path"], "/{2,}", "/"),
        F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)),
    )
    return F.when(p["scheme"].isin("http", "https") & (p["host"] != ""), out).otherwise(F.lit(""))


def invalid_reason(url: Column | str) -> Column:
    """Why a URL is no usable web address; null if it is one."""
    p = _parts(col(url))
    return (
        F.when(F.trim(F.coalesce(col(url), F.lit(""))) == "", F.lit("missing_url"))
        .when(~p["scheme"].isin("http", "https"), F.lit("unsupported_scheme"))
        .when(p["host"] == "", F.lit("missing_host"))
    )


def host(url: Column | str) -> Column:
    """Lower-case host without port and a leading www."""
    return F.regexp_replace(F.regexp_replace(_parts(col(url))["host"], r":[0-9]+$", ""), r"^www\.", "")


def last_label(url: Column | str) -> Column:
    """The last label of the host, null without a dot."""
    h = host(url)
    return F.when(F.contains(h, F.lit(".")), F.substring_index(h, ".", -1))


def host_allowed(url: Column | str, domains: Sequence[str]) -> Column:
    """Host equal to one of the domains or below it."""
    out = F.lit(False)
    for d in domains:
        out = out | (host(url) == d) | F.endswith(host(url), F.lit("." + d))
    return out


def looks_like_list(url: Column | str) -> Column:
    """Whether path or query name a list page rather than a record."""
    p = _parts(col(url))
    return F.rlike(F.lower(p["path"]), F.lit(r"(list|index|main)(\.[a-z]+)?/?$")) | F.rlike(F.lower(p["query"]), F.lit(r"(^|&)(page|pageindex|act=list)"))


def sanitised(url: Column | str) -> Column:
    """Web addresses without secret query keys; null for anything else."""
    u = F.trim(col(url))
    pairs = F.filter(F.split(_parts(u)["query"], "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*SECRET_KEYS))
    query = F.array_join(pairs, "&")
    base = F.regexp_replace(F.substring_index(F.substring_index(u, "#", 1), "?", 1), "#.*$", "")
    out = F.concat(base, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
    return F.when(_parts(u)["scheme"].isin("http", "https"), out)


def link_verdict(url: Column | str, domains: Sequence[str], verified: Column) -> Column:
    """Kind of a link: exact needs a record page on an allowed host and a verification; a portal root never is."""
    p = _parts(col(url))
    return (
        F.when(invalid_reason(url).isNotNull(), F.lit("none"))
        .when(~host_allowed(url, domains), F.lit("external"))
        .when(F.regexp_replace(p["path"], "/+", "") == "", F.lit("portal"))
        .when(looks_like_list(url), F.lit("list"))
        .when(F.coalesce(verified, F.lit(False)), F.lit("exact"))
        .otherwise(F.lit("candidate"))
    )


def built(base: str, parameters: dict[str, Column]) -> Column:
    """Address with encoded query parameters, in order; null parameters are left out."""
    pairs = F.array_compact(F.array(*[F.when(c.isNotNull(), F.concat(F.lit(f"{n}="), F.url_encode(c.cast("string")))) for n, c in parameters.items()]))
    query = F.array_join(pairs, "&")
    return F.when(query == "", F.lit(base)).otherwise(F.concat(F.lit(base), F.lit("?"), query))


def candidates(paths: Sequence[str], names: Sequence[str], record: Column) -> Column:
    """Distinct addresses of all paths with all parameter names for a record, in order; none without a record."""
    made = F.flatten(F.transform(F.array(*map(F.lit, paths)), lambda p: F.transform(F.array(*map(F.lit, names)), lambda n: F.concat(p, F.lit("?"), n, F.lit("="), F.url_encode(record)))))
    return F.when(record.isNull() | (record == ""), F.array().cast("array<string>")).otherwise(F.array_distinct(made))


def page_verdict(status: Column, body: Column, record: Column, title: Column, errors: Sequence[str]) -> Column:
    """Verdict on a fetched page: failed, error page, verified by record or title, or not matching."""
    text = F.lower(F.coalesce(body, F.lit("")))
    broken = F.lit(False)
    for e in errors:
        broken = broken | F.contains(text, F.lit(e.lower()))
    holds = lambda c: (F.coalesce(c, F.lit("")) != "") & F.contains(text, F.lower(F.coalesce(c, F.lit(""))))
    return F.when(F.coalesce(status, F.lit(0)) != 200, "failed").when(broken, "error_page").when(holds(record) | holds(title), "verified").otherwise("no_match")
