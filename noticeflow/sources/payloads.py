"""Answers of notice APIs, JSON or XML, read by Spark's parsers: result codes to error classes, items, and the operation used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Result codes of success, of refused keys and of faulty parameters.
SUCCESS, REFUSED, FAULTY = ("", "0", "00"), ("10", "20", "30", "31", "32"), ("11", "12", "22")
#: Where answers keep their items and figures: an element or key at the top, in a body or a header, or below ``response``.
ITEMS = "item array<map<string,string>>"
FIGURES = f"resultCode string, resultMsg string, resultMag string, totalCount string, {ITEMS}, items struct<{ITEMS}>"
XML = f"{FIGURES}, header struct<{FIGURES}>, body struct<{FIGURES}>, broken string"
OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken", "ignoreNamespace": "true", "ignoreSurroundingSpaces": "true", "attributePrefix": "@", "valueTag": "#text"}


def _json(c: Column, *paths: str) -> Column:
    return F.coalesce(*(F.nullif(F.get_json_object(c, p), F.lit("")) for p in paths))


def error_class(code: Column, message: Column) -> Column:
    """AUTH, PARAM or API; null for success."""
    code, upper = F.trim(F.coalesce(code, F.lit(""))), F.upper(F.coalesce(message, F.lit("")))
    return (
        F.when(code.isin(*SUCCESS) | F.contains(upper, F.lit("NORMAL SERVICE")), None)
        .when(code.isin(*REFUSED) | F.contains(upper, F.lit("SERVICE KEY")), "AUTH")
        .when(code.isin(*FAULTY) | F.contains(upper, F.lit("PARAMETER")) | F.contains(upper, F.lit("필수")), "PARAM")
        .otherwise("API")
    )


def _json_items(c: Column) -> Column:
    """Array of JSON texts from a list, an object, or either below ``item``."""
    inner = F.coalesce(F.get_json_object(c, "$.item"), c)
    listed = F.when(F.startswith(inner, F.lit("[")), F.from_json(inner, "array<string>")).otherwise(F.array(inner))
    return F.filter(F.coalesce(listed, F.array().cast("array<string>")), lambda x: F.startswith(x, F.lit("{")))


def _in_xml(x: Column, name: str) -> Column:
    """The first value of a figure that is not blank, from the header, the body or the top."""
    return F.coalesce(*(F.nullif(F.trim(at[name]), F.lit("")) for at in (x["header"], x["body"], x)))


def _xml_items(x: Column) -> Column:
    """Array of JSON texts of the item elements: the names of their children, without prefixes, to their own texts.

    Attributes are no fields; a child with children of its own has no text.
    """
    found = F.coalesce(*(F.filter(i, lambda m: F.size(F.map_keys(m)) > 0) for at in (x["body"], x) for i in (at["items"]["item"], at["item"])))
    own = lambda m: F.map_filter(m, lambda k, v: ~F.startswith(k, F.lit("@")) & (k != "#text"))
    text = lambda k, v: F.when(F.startswith(F.trim(v), F.lit("<")), "").otherwise(F.trim(F.coalesce(v, F.lit(""))))
    return F.filter(F.transform(found, lambda m: F.to_json(F.transform_values(own(m), text))), lambda x: x != "{}")


def unwrapped(answers: DataFrame, body: str = "body") -> DataFrame:
    """``answers`` with ``error`` (class, null for success), ``code``, ``message``, ``total`` and ``items`` (JSON texts).

    JSON answers are objects or bare arrays of items.  Answers that are neither JSON nor a whole XML
    element, and null or empty ones, have the class PARSE.  Failed answers have no items.  Numbers may have
    separators.  Columns of these names are replaced.
    """
    c = F.trim(F.coalesce(F.col(body), F.lit("")), F.lit(" \t\r\n\ufeff"))
    array = F.startswith(c, F.lit("["))
    json_ = (F.startswith(c, F.lit("{")) | array) & F.get_json_object(c, "$").isNotNull()
    rows = answers.withColumns({"_c": c, "_json": json_})
    # a prolog's encoding means bytes, and these are characters
    element = F.regexp_replace("_c", r"^<\?xml[^>]*\?>\s*", "")
    rows = rows.withColumn("_xml", F.when(~F.col("_json") & F.startswith(element, F.lit("<")), F.from_xml(element, XML, OPTIONS)))
    c, json_, x = F.col("_c"), F.col("_json"), F.col("_xml")
    heads = lambda name: (f"$.response.header.{name}", f"$.header.{name}", f"$.{name}")
    code = F.when(json_, _json(c, *heads("resultCode"))).otherwise(_in_xml(x, "resultCode"))
    message = F.when(json_, _json(c, *heads("resultMsg"), *heads("resultMag"))).otherwise(F.coalesce(_in_xml(x, "resultMsg"), _in_xml(x, "resultMag")))
    total = F.when(json_, _json(c, "$.response.body.totalCount", "$.body.totalCount", "$.totalCount")).otherwise(_in_xml(x, "totalCount"))
    listed = _json_items(F.when(F.startswith(c, F.lit("[")), c).otherwise(_json(c, "$.response.body.items", "$.body.items", "$.items")))
    items = F.coalesce(F.when(json_, listed).otherwise(_xml_items(x)), F.array().cast("array<string>"))
    error = F.when(json_ | (x.isNotNull() & x["broken"].isNull()), error_class(code, message)).otherwise("PARSE")
    out = rows.withColumns({
        "error": error, "code": F.trim(code), "message": F.trim(message), "total": F.coalesce(F.regexp_replace(total, "[,\\s]", "").try_cast("bigint"), F.lit(0).cast("bigint")), "items": items,
    })
    failed = F.col("error").isNotNull()
    return out.withColumn("items", F.when(failed, F.array().cast("array<string>")).otherwise(F.col("items"))).drop("_c", "_json", "_xml")


def used_operations(answers: DataFrame, key: str = "business") -> DataFrame:
    """Per key: ``used``, the first operation by ``rank`` that has items, ``state`` and ``failed``, the number of failures.

    ``answers`` has the key, rank, operation and the columns of :func:`unwrapped`.  The state is ``rows``,
    ``none`` where answers came but no items, and ``failed`` where every operation failed.
    """
    failed = F.col("error").isNotNull()
    has = ~failed & (F.size("items") > 0)
    per = answers.groupBy(key).agg(
        F.min(F.when(has, F.struct("rank", "operation"))).alias("m"), F.count_if(failed).alias("failed"), F.count(F.lit(1)).alias("n")
    )
    state = F.when(F.col("m").isNotNull(), "rows").when(F.col("failed") < F.col("n"), "none").otherwise("failed")
    return per.select(key, F.col("m.operation").alias("used"), state.alias("state"), "failed")
