"""Deterministic placeholders such as EMAIL-8674."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veil.constants import MODULUS


def digest_modulo(text: Column, algorithm: str = "md5", modulus: int = MODULUS) -> Column:
    """The hex digest of the UTF-8 bytes, read as one integer, modulo `modulus`, folded in 32-bit chunks."""
    m = max(1, int(modulus))
    if m > 1 << 31:
        raise ValueError("the modulus must fit into 31 bits")
    raw = text.cast("binary")
    digest = F.sha2(raw, 256) if algorithm == "sha256" else F.md5(raw)
    chunks = F.transform(F.sequence(F.lit(1), F.lit(57 if algorithm == "sha256" else 25), F.lit(8)), lambda i: F.conv(F.substring(digest, i, F.lit(8)), 16, 10).cast("bigint"))
    return F.aggregate(chunks, F.lit(0).cast("bigint"), lambda r, c: (r * F.lit((1 << 32) % m) + c) % m)


def urlish(text: Column) -> Column:
    low = F.lower(text)
    compact = F.replace(low, F.lit(" "), F.lit(""))
    link = compact.startswith("[") & F.contains(compact, F.lit("](")) & F.contains(compact, F.lit("://"))
    return low.rlike("^(?:https?://|ftp://|www\\.)") | F.contains(low, F.lit("sharepoint.com/")) | link


def placeholder(kind: Column, text: Column, algorithm: str = "md5", modulus: int = MODULUS) -> Column:
    width = max(3, len(str(max(1, int(modulus)) - 1)))
    prefix = F.when((kind == "markdown_url") | urlish(text), F.lit("URL")).otherwise(F.upper(kind))
    number = F.lpad(digest_modulo(F.concat(kind, F.lit(":"), text), algorithm, modulus).cast("string"), width, "0")
    return F.concat(prefix, F.lit("-"), number)


def replacement(span: Column, algorithm: str = "md5", modulus: int = MODULUS) -> Column:
    """What stands for a span: its placeholder, inside its Markdown brackets if it is a link."""
    own = placeholder(span["type"], span["text"], algorithm, modulus)
    pairs = F.greatest(span["bracket_pairs"], F.lit(1))
    link = F.concat(F.repeat(F.lit("["), pairs), span["link_text"], F.repeat(F.lit("]"), pairs), F.lit("("), own, F.lit(")"))
    return F.when(span["link_text"].isNotNull(), link).otherwise(own)


def replacer(algorithm: str = "md5", modulus: int = MODULUS):
    """A replacement function for ``scrub(..., replace=)``; any function of a span column can stand in its place."""
    return lambda span: replacement(span, algorithm, modulus)
