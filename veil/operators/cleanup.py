"""Clean-up of scrubbed text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veil import constants as C
from veil.functions.text import join, let, splitlines


def _where(text: Column, condition, build) -> Column:
    """build(text) where a cheap necessary condition holds, else the text."""
    return let(text, lambda t: F.when(condition(t), build(t)).otherwise(t))


def remove_unknown(text: Column) -> Column:
    """Drops UNKNOWN placeholders, leaves the text of links to them, and makes runs of blanks one space."""

    def drop(t: Column) -> Column:
        t = F.regexp_replace(t, C.UNKNOWN_ANGLE, "")
        t = F.regexp_replace(t, C.java(C.UNKNOWN_LINK), "$1")
        return F.regexp_replace(t, C.java(C.UNKNOWN_BARE), "")

    dropped = _where(text, lambda t: F.contains(t, F.lit("UNKNOWN-")), drop)
    return _where(dropped, lambda t: F.contains(t, F.lit("  ")) | F.contains(t, F.lit("\t")), lambda t: F.regexp_replace(t, "[ \\t]{2,}", " "))


def collapse_gibberish(text: Column) -> Column:
    """Inside [...] and then (...), runs of over 80 word-like characters keep their first 16 and last 8."""
    shorten = lambda block: F.regexp_replace(block, f"([A-Za-z0-9_%=]{{{C.GIBBERISH_HEAD}}})[A-Za-z0-9_%=]{{{81 - C.GIBBERISH_HEAD - C.GIBBERISH_TAIL},}}([A-Za-z0-9_%=]{{{C.GIBBERISH_TAIL}}})", "$1…$2")

    def inside(text: Column, block: str) -> Column:
        found, between = F.regexp_extract_all(text, F.lit(block), F.lit(0)), F.split(text, block, -1)
        return F.array_join(F.transform(F.arrays_zip(between.alias("p"), F.transform(found, shorten).alias("m")), lambda z: F.concat(z["p"], F.coalesce(z["m"], F.lit("")))), "")

    def collapsed(text: Column, opening: str, closing: str, block: str) -> Column:
        there = lambda t: F.contains(t, F.lit(opening)) & F.contains(t, F.lit(closing)) & t.rlike(C.GIBBERISH)
        return _where(text, there, lambda t: inside(t, block))

    return collapsed(collapsed(text, "[", "]", "\\[[^\\]]+\\]"), "(", ")", "\\([^\\)]+\\)")


def dedupe_lines(text: Column) -> Column:
    """Adjacent equal lines become one; every line end becomes a line feed and a final one goes."""
    return let(splitlines(text), lambda lines: join(F.filter(lines, lambda x, i: (i == 0) | (x != F.get(lines, i - 1)))))


def trailing_newline(text: Column) -> Column:
    return let(text, lambda t: F.when(t.endswith("\n"), t).otherwise(F.concat(t, F.lit("\n"))))


def cleanup(text: Column) -> Column:
    """All of the above in this order; an empty text stays empty."""
    return let(text, lambda t: F.when(t == "", t).otherwise(trailing_newline(dedupe_lines(collapse_gibberish(remove_unknown(t))))))
