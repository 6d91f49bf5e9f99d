"""Column versions of Python's string methods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veil.constants import LINE_ENDS, OTHER_LINE_ENDS, SPACE


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def free(columns: list[str], *names: str) -> list[str]:
    """Each name with as many underscores before it as make it none of the columns."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while (name := f"_{name}").lower() in taken:
            pass
        out.append(name)
    return out


def splitlines(text: Column) -> Column:
    """str.splitlines: no line after a final line end, none for an empty text; texts with no line ends but line feeds are split at a plain character."""
    parts = F.when(text.rlike(OTHER_LINE_ENDS), F.split(text, LINE_ENDS, -1)).otherwise(F.split(text, "\n", -1))
    return let(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U){SPACE}+$", "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U)^{SPACE}+|{SPACE}+$", "")


def lstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U)^{SPACE}+", "")


def islower(text: Column) -> Column:
    return (F.lower(text) == text) & (F.upper(text) != text)


def isupper_somewhere(text: Column) -> Column:
    return F.lower(text) != text


def join(lines: Column) -> Column:
    return F.array_join(lines, "\n")
