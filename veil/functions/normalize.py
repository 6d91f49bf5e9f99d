"""Normalisation of text that came out of PDFs, and of text that goes into them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veil.functions.text import islower, join, let, lstrip, rstrip, splitlines, strip
from veil.operators.spans import fold

_SPLIT_URL = "(?U)https?://\\S*(?:\\n\\S+)+"
_ITEM = "(?U)^\\s*(?:[-*•]|\\d+\\.)\\s+"
_NUMBERED = "(?U)^\\s*\\d+\\.\\s+"


def page_breaks(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\f"), F.lit("\n\n")), "\\n{3,}", "\n\n")


def trim_lines(text: Column) -> Column:
    return join(F.transform(splitlines(text), rstrip))


def join_split_urls(text: Column) -> Column:
    """Line feeds inside a URL go: all those between what begins with http(s):// and the next white space or empty line."""
    found, between = F.regexp_extract_all(text, F.lit(_SPLIT_URL), F.lit(0)), F.split(text, _SPLIT_URL, -1)
    whole = F.transform(found, lambda m: F.replace(m, F.lit("\n"), F.lit("")))
    zipped = F.arrays_zip(between.alias("p"), whole.alias("m"))
    joined = F.array_join(F.transform(zipped, lambda z: F.concat(z["p"], F.coalesce(z["m"], F.lit("")))), "")
    return F.when(F.size(found) > 0, joined).otherwise(text)


def wrap_urls(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)(?<!<)(https?://\\S+)(?!>)", "<$1>")


def blank_before_lists(text: Column) -> Column:
    """An empty line before a list item that follows a line which is neither blank nor an item."""

    def lines_of(lines: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            above = F.get(lines, i - 1)
            needed = (i > 0) & x.rlike(_ITEM) & (strip(above) != "") & ~lstrip(above).rlike("^[-*•]") & ~above.rlike(_NUMBERED)
            return F.when(needed, F.array(F.lit(""), x)).otherwise(F.array(x))

        return join(F.flatten(F.transform(lines, one)))

    return let(splitlines(text), lines_of)


def insert_h1(text: Column, title: str | Column | None) -> Column:
    """`# title` and an empty line on top, unless the first line that is not blank is such a heading."""
    if title is None or (isinstance(title, str) and not title):
        return text
    title = F.lit(title) if isinstance(title, str) else title

    def headed(text: Column, lines: Column) -> Column:
        first = F.get(F.filter(lines, lambda x: strip(x) != ""), F.lit(0))
        has = F.coalesce(lstrip(first).startswith("# "), F.lit(False))
        return F.when(has, text).otherwise(join(F.concat(F.array(F.concat(F.lit("# "), title), F.lit("")), lines)))

    return let(text, lambda t: let(splitlines(t), lambda lines: headed(t, lines)))


def normalize_pdf_text(text: Column, title: str | Column | None = None) -> Column:
    whole = lambda t: insert_h1(blank_before_lists(wrap_urls(let(trim_lines(page_breaks(t)), join_split_urls))), title)
    return let(text, lambda t: F.when(t == "", t).otherwise(whole(t)))


def dehyphenate(text: Column) -> Column:
    """Lines, right-stripped, with a word broken by a final hyphen joined to the next line if that goes on in lower case.

    A joined pair is done with: its own final hyphen joins nothing more, and its tail is not stripped.
    """
    clean = F.replace(F.replace(text, F.lit("\u00ad"), F.lit("")), F.lit("\u2011"), F.lit("-"))

    def joined(lines: Column) -> Column:
        def step(now: Column, x: Column) -> tuple[Column, Column]:
            line, below = rstrip(x), lstrip(F.get(lines, now["i"] + 1))
            joins = line.endswith("-") & F.coalesce((below != "") & islower(F.substring(below, 1, 1)), F.lit(False))
            new = F.when(joins, F.concat(F.substring(line, F.lit(1), F.length(line) - 1), below)).otherwise(line)
            out = F.when(now["taken"], F.array().cast("array<string>")).otherwise(F.array(new))
            return F.struct((~now["taken"] & joins).alias("taken"), (now["i"] + 1).alias("i")), out

        start = F.struct(F.lit(False).alias("taken"), F.lit(0).alias("i"))
        return F.when(F.size(lines) == 0, lines).otherwise(fold(lines, start, "struct<taken:boolean,i:int>", "string", step, lambda now, out: out))

    return join(let(splitlines(clean), joined))


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines, each on one line, with an empty line between them."""
    blocks = F.split(join(F.transform(F.split(text, "\n", -1), strip)), "\n{2,}", -1)
    flat = F.transform(blocks, lambda b: F.replace(F.btrim(b, F.lit("\n")), F.lit("\n"), F.lit(" ")))
    return F.array_join(F.filter(flat, lambda b: b != ""), "\n\n")


def text_for_pdf(text: Column, mode: str = "pre") -> Column:
    """Text as it is laid out in a PDF: mode `pre` keeps lines, `para` merges them into paragraphs."""
    return dehyphenate(text) if mode == "pre" else paragraphs(dehyphenate(text))
