"""Notice boards from saved pages: lists to candidates, candidates to records, and the state of the parser.

Pages are rows, so that fetching is a matter of the source; all steps here are joins and aggregates by source
and record.  Nulls in ``html`` are empty pages, links without a record id are left out, an empty table gives
no rows, and columns beyond those named are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html, text

#: The share of rows with a title below which a board counts as changed.
LEAST_PARSED = 0.5


def listed(pages: DataFrame, record: str) -> DataFrame:
    """(source, page_no, at, record_id, title, href) of the links of list pages whose address matches ``record``.

    ``pages`` has source, page_no, status and html.  ``record`` is a regular expression with the id as its
    group.  Paging stops per source at a failed first page and at the first later page without a record; a
    failed later page is passed over.  Pages without a source are read to the end.
    """
    found = F.filter(html.links("html"), lambda a: F.regexp_extract(a["href"], record, 1) != "")
    fine = F.coalesce((F.col("status") == 200) & (F.col("html") != ""), F.lit(False))
    read = pages.select("source", "page_no", fine.alias("fine"), F.when(fine, found).alias("found"))
    ends = F.when(F.col("page_no") == 1, ~F.col("fine")).otherwise(F.col("fine") & (F.size("found") == 0))
    stop = read.where(ends).groupBy("source").agg(F.min("page_no").alias("stop"))
    kept = read.join(stop, "source", "left").where("fine and (stop is null or page_no < stop)")
    return kept.select("source", "page_no", F.posexplode("found").alias("at", "a")).select(
        "source", "page_no", "at", F.regexp_extract("a.href", record, 1).alias("record_id"), F.col("a.text").alias("title"), F.col("a.href").alias("href")
    )


def candidates(links: DataFrame, words: Sequence[str], known: DataFrame | None = None) -> DataFrame:
    """(source, record_id, title, href, known): the first link of each record whose title has a word.

    Records of ``known`` (source, record_id, title, href) that no link names are added; a link whose title
    has no word counts as naming its record.
    """
    place = F.struct("page_no", "at", "title", "href")
    first = links.groupBy("source", "record_id").agg(F.min(place).alias("m")).select("source", "record_id", "m.title", "m.href")
    out = first.where(text.any_term("title", list(words))).withColumn("known", F.lit(False))
    if known is None:
        return out
    more = known.groupBy("source", "record_id").agg(F.min_by(F.struct("title", "href"), "href").alias("m"))
    more = more.where("record_id <> ''").join(first, ["source", "record_id"], "left_anti")
    return out.unionByName(more.select("source", "record_id", "m.title", "m.href", F.lit(True).alias("known")))


def records(chosen: DataFrame, details: DataFrame, posted: Column, cutoff: Column) -> DataFrame:
    """Candidates with what their detail pages say, and ``outcome``: skipped, failed or matched.

    ``details`` has source, record_id, status and html, one row per record.  ``posted`` is a date over the
    columns of ``chosen``; records before ``cutoff`` are skipped unread, those without a date are not.
    ``link_verified`` tells whether the page names the record's id.
    """
    d = details.select("source", "record_id", "status", "html")
    c = chosen.withColumn("old", F.coalesce(posted < cutoff, F.lit(False)))
    fine = F.coalesce((F.col("status") == 200) & (F.col("html") != ""), F.lit(False))
    both = c.join(d, ["source", "record_id"], "left").withColumn(
        "outcome", F.when(F.col("old"), "skipped").when(~fine, "failed").otherwise("matched")
    )
    page = F.when(F.col("outcome") == "matched", F.col("html"))
    return both.withColumns({
        "page_title": html.title(page), "body": html.plain_text(page), "attachments": html.attachments(page),
        "link_verified": F.coalesce(F.contains(page, F.col("record_id")), F.lit(False)),
    }).drop("old", "status", "html")


def crawl_counts(found: DataFrame) -> DataFrame:
    """Per source: candidates, matched, skipped, failed, verified links and attachments."""
    outcome = F.col("outcome")
    return found.groupBy("source").agg(
        F.count(F.lit(1)).alias("candidates"), *(F.count_if(outcome == o).alias(o) for o in ("matched", "skipped", "failed")),
        F.count_if("link_verified").alias("verified"), F.sum(F.size("attachments")).cast("long").alias("attachments"),
    )


def table_rows(page: Column, cell: str = r"^[0-9]+$") -> Column:
    """The table rows whose first cell, without its tags, matches; rows and cells may be closed or not.

    What follows a row's opening tag up to the next one, or its closing tag, is the row.
    """
    parts = F.split(page, r"(?i)<tr\b")
    rows = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.get(F.split(p, r"(?i)</tr\b|</table\b"), 0))
    cells = lambda r: F.split(r, r"(?i)<t[dh]\b")
    inner = lambda r: F.regexp_replace(F.regexp_replace(F.get(cells(r), 1), r"^[^>]*>|(?is)</t[dh]\b.*$", ""), r"(?s)<[^>]*>", " ")
    return F.filter(rows, lambda r: F.coalesce(F.rlike(text.collapse(html.unescaped(inner(r))), F.lit(cell)), F.lit(False)) & (F.size(cells(r)) > 1))


def list_health(pages: DataFrame, call: str = "openBidblancDetail", cell: str = r"^[0-9]+$") -> DataFrame:
    """Per list page (source, page_no): rows, rows with a title, calls, table, ratio to three places, and state.

    Rows are those of :func:`table_rows`, numbered ones.  The state is ``empty`` without rows, ``parser_mismatch``
    below ``LEAST_PARSED``, else ``ok``.
    """
    page = F.coalesce(F.col("html"), F.lit(""))
    blocks = table_rows(page, cell)
    titled = F.filter(blocks, lambda b: F.exists(html.links(b), lambda a: a["text"] != ""))
    out = pages.select(
        "source", "page_no", F.size(blocks).alias("rows"), F.size(titled).alias("rows_with_title"),
        F.size(html.call_arguments(page, call)).alias("calls"), F.rlike(page, F.lit(r"(?i)<table\b")).alias("table_found"),
    )
    ratio = F.when(F.col("rows") > 0, F.round(F.col("rows_with_title") / F.col("rows"), 3)).otherwise(0.0)
    out = out.withColumn("ratio", ratio)
    return out.withColumn("state", F.when(F.col("rows") == 0, "empty").when(F.col("ratio") < LEAST_PARSED, "parser_mismatch").otherwise("ok"))
