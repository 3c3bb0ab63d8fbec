"""HTML and JSON extraction with built-in functions."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, collapse

#: Names that count without a semicolon too, and all others; two characters that no value has part the entries.
SHORT = {n: v for n, v in html5.items() if not n.endswith(";")}
NAMED = {n[:-1]: v for n, v in html5.items() if n.endswith(";")}
#: What the numbers 128 to 159 mean in pages (a dot: the character of that number).
LATIN = "€.‚ƒ„…†‡ˆ‰Š‹Œ.Ž..‘’“”•–—˜™š›œ.žŸ"


def _table(entries: dict[str, str]) -> Column:
    return F.map_from_arrays(*[F.split(F.lit("\x01".join(x)), "\x01") for x in (entries, entries.values())])


def _numbered(n: Column) -> Column:
    """The character of a number, as pages mean it; null for a number beyond reading."""
    own = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    latin = F.substring(F.lit(LATIN), (n - 127).cast("int"), F.lit(1))
    bad = (n == 0) | ((n >= 0xD800) & (n <= 0xDFFF)) | (n > 0x10FFFF) | n.isNull()
    none = ((n >= 1) & (n <= 8)) | ((n >= 0xE) & (n <= 0x1F)) | ((n >= 0xFDD0) & (n <= 0xFDEF)) | (n == 0xB) | (n.bitwiseAND(0xFFFE) == 0xFFFE) | (n == 127)
    return F.when(bad, "\ufffd").when(n == 13, "\r").when((n >= 128) & (n <= 159), F.when(latin == ".", own).otherwise(latin)).when(none, "").otherwise(own)


def _reference(part: Column, bare: bool) -> Column:
    """What stands after an ampersand, with the reference at its beginning decoded; with the ampersand if it is none."""
    number = F.regexp_extract(part, rf"^#(?:[xX][0-9a-fA-F]+|[0-9]+);{'?' if bare else ''}", 0)
    digits = F.regexp_extract(number, r"[0-9a-fA-F]+", 0)
    hexed = F.rlike(number, F.lit("^#[xX]"))
    value = F.when(F.char_length(F.ltrim(digits, F.lit("0"))) <= 8, F.when(hexed, F.conv(digits, 16, 10)).otherwise(digits).cast("long")).otherwise(F.lit(0x110000))
    word = F.regexp_extract(part, "^[A-Za-z][A-Za-z0-9]*", 0)
    named = F.when(F.substring(part, F.char_length(word) + 1, F.lit(1)) == ";", F.element_at(_table(NAMED), word))
    longest = F.filter(F.sequence(F.least(F.lit(6), F.char_length(word)), F.lit(2), F.lit(-1)), lambda k: F.element_at(_table(SHORT), F.substring(word, F.lit(1), k)).isNotNull())
    size = F.when(F.char_length(word) >= 2, F.get(longest, 0))
    rest = lambda n: F.substring(part, n + 1, F.char_length(part))
    # a name that is none makes null of its text, so that it is looked up once
    texts = [F.concat(named, rest(F.char_length(word) + 1))]
    if bare:
        texts.append(F.concat(F.element_at(_table(SHORT), F.substring(word, F.lit(1), size)), rest(size)))
    return F.when(number != "", F.concat(_numbered(value), rest(F.char_length(number)))).otherwise(F.coalesce(*texts, F.concat(F.lit("&"), part)))


def unescaped(c: Column | str, bare: bool = True) -> Column:
    """The text with its character references decoded, each once: by name, with or without semicolon where pages may, or number.

    Without ``bare`` a reference needs its semicolon: one that was cut off stays as it is.
    """
    # the text is read once: nothing here is compiled, so what stands twice would be computed twice
    return F.array_join(F.transform(F.split(col(c), "&"), lambda p, k: F.when(k == 0, p).otherwise(_reference(p, bare))), "")


def title(html: Column | str, bare: bool = True) -> Column:
    """Text of the title element, else of the first heading; white space collapsed; empty without either."""
    found = F.regexp_extract(F.coalesce(col(html), F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)
    heading = F.regexp_extract(F.coalesce(col(html), F.lit("")), r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    return collapse(unescaped(F.regexp_replace(F.when(F.trim(found) != "", found).otherwise(heading), r"(?s)<[^>]*>", " "), bare))


def plain_text(html: Column | str, bare: bool = True) -> Column:
    """Text without scripts, styles, comments and tags; white space collapsed."""
    t = F.regexp_replace(F.coalesce(col(html), F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return collapse(unescaped(F.regexp_replace(t, r"(?s)<[^>]*>", " "), bare))


#: An address in double, single or no quotation marks.
HREF = r"""href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def links(html: Column | str, bare: bool = True) -> Column:
    """Array of (href, text) of the anchors, in order; references in both are decoded."""
    anchors = F.regexp_extract_all(F.coalesce(col(html), F.lit("")), F.lit(rf"(?is)<a\b[^>]*?\s{HREF}[^>]*>.*?</a>"), F.lit(0))
    return F.transform(
        anchors,
        lambda a: F.struct(
            unescaped(F.concat(*[F.regexp_extract(a, rf"(?is)^<a\b[^>]*?\s{HREF}", g) for g in (1, 2, 3)]), bare).alias("href"),
            collapse(unescaped(F.regexp_replace(a, r"(?s)<[^>]*>", " "), bare)).alias("text"),
        ),
    )


def attachments(html: Column | str, extensions: tuple[str, ...] = ("pdf", "hwp", "hwpx", "doc", "docx", "xls", "xlsx", "zip"), bare: bool = True) -> Column:
    """Array of (name, file_type, url) of the links whose text or address ends in a file extension."""
    pattern = rf"(?i)\.({'|'.join(extensions)})(?:$|[?#&\s])"
    kind = lambda x: F.lower(F.regexp_extract(F.concat_ws(" ", x["text"], x["href"]), pattern, 1))
    files = F.filter(links(html, bare), lambda x: kind(x) != "")
    return F.transform(files, lambda x: F.struct(x["text"].alias("name"), kind(x).alias("file_type"), x["href"].alias("url")))


def page_kind(html: Column | str, list_pattern: str, detail_pattern: str) -> Column:
    """Whether a page is a list, a detail page, empty, or something else."""
    t = F.coalesce(col(html), F.lit(""))
    return (
        F.when(F.trim(t) == "", "empty")
        .when(F.rlike(t, F.lit(list_pattern)), "list")
        .when(F.rlike(t, F.lit(detail_pattern)), "detail")
        .otherwise("other")
    )


def call_arguments(html: Column | str, function: str) -> Column:
    """Array of argument arrays of the calls of a script function, such as the rows of a board."""
    calls = F.regexp_extract_all(F.coalesce(col(html), F.lit("")), F.lit(rf"{function}\(([^)]*)\)"), F.lit(1))
    return F.transform(calls, lambda c: F.transform(F.split(c, ","), lambda a: F.regexp_replace(F.trim(a), "^['\"]|['\"]$", "")))


def json_text(c: Column | str, path: str) -> Column:
    """Value at a path of a JSON text as text; null where the text is no JSON."""
    return F.get_json_object(col(c), path)


def flattened(c: Column | str) -> Column:
    """Map of the top-level keys of a JSON object to their values as text; null where it is none."""
    return F.from_json(col(c), "map<string,string>")
