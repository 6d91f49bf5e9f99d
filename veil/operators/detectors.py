"""The pattern detectors: each maps a text column to an array of spans."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from veil import constants as C
from veil.functions.text import isupper_somewhere
from veil.operators.spans import guarded, matches, no_spans, span

#: What may cling to the end of a URL.
_JUNK = "[\\]\\)\\.,;:>]+$"
_JUNK_QUOTES = "[\\]\\)\\.,;:>'\"]+$"


def _plain(text: Column, pattern: str, kind: str, rank: int, flags: str = "") -> Column:
    return F.transform(matches(text, C.java(pattern, flags)), lambda m: span(m["beg"], m["end"], kind, m["text"], kind, rank))


def custom(text: Column, rank: int, phrase: str) -> Column:
    """Every place of the trimmed phrase, case and all, overlapping ones too; none for an empty phrase."""
    needle = (phrase or "").strip()
    if not needle:
        return no_spans()
    n = len(needle)
    quoted = [re.sub(r"([^\w\s])", r"\\\1", x) for x in (needle, needle[0], needle[1:])]
    alone = not any(needle[:k] == needle[-k:] for k in range(1, n))
    pattern = quoted[0] if alone else f"{quoted[1]}(?={quoted[2]})"  # one that can overlap itself is found by its first character
    found = F.transform(matches(text, pattern), lambda m: span(m["beg"], m["beg"] + n, "custom", F.lit(needle), "custom", rank))
    return guarded(F.contains(text, F.lit(needle)), found)


def markdown_url(text: Column, rank: int) -> Column:
    """[text](url) and [[text]](url), over line ends; a match with unlike brackets is passed over."""
    pattern = C.java(C.MARKDOWN_URL, "s")
    part = lambda m, g: F.regexp_extract(m["text"], f"^(?:{pattern})$", g)

    def build(m: Column) -> Column:
        url = F.regexp_replace(part(m, 4), "(?U)\\s+", "")
        url = F.when(url.startswith("<") & url.endswith(">") & (F.length(url) > 1), F.substring(url, F.lit(2), F.length(url) - 2)).otherwise(url)
        return span(m["beg"], m["end"], "markdown_url", m["text"], "markdown_url", rank, part(m, 2), F.regexp_replace(url, _JUNK_QUOTES, ""), F.length(part(m, 1)))

    paired = F.filter(matches(text, pattern), lambda m: F.length(part(m, 1)) == F.length(part(m, 3)))
    return guarded(F.contains(text, F.lit("](")), F.transform(paired, build))


def sharepoint_url(text: Column, rank: int) -> Column:
    """Links to *.sharepoint.com with generous paths; the text loses white space and its tail, the span does not."""

    def build(m: Column) -> Column:
        url = F.regexp_replace(F.regexp_replace(m["text"], "(?U)\\s+", ""), _JUNK_QUOTES, "")
        return span(m["beg"], m["end"], "url", url, "sharepoint_url", rank)

    return guarded(F.contains(F.lower(text), F.lit("sharepoint.com/")), F.transform(matches(text, C.java(C.SHAREPOINT_URL, "i")), build))


def url(text: Column, rank: int) -> Column:
    """URLs with a protocol, www or a bare domain; not mixed-case bare domains, not torn pieces of SharePoint links."""
    clean = lambda m: F.regexp_replace(m["text"], _JUNK, "")

    def keep(m: Column) -> Column:
        own, low = clean(m), F.lower(clean(m))
        marked = low.rlike("^(?:https?://|ftp://|www\\.)")
        host = F.substring_index(low, "/", 1)
        return (marked | ~isupper_somewhere(own)) & ~(host.endswith("point.com") & _torn(text, m, host))

    found = F.filter(matches(text, C.java(C.URL, "i")), keep)
    return guarded(text.rlike("(?U)\\w\\.\\w"), F.transform(found, lambda m: span(m["beg"], m["end"], "url", clean(m), "url", rank)))


def _torn(text: Column, m: Column, host: Column) -> Column:
    """Whether a host on point.com is what a line break left of sharepoint.com, by what stands around it."""
    squeeze = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    cut = lambda reach: (F.substring(text, F.greatest(m["beg"] - reach, F.lit(0)) + 1, F.least(m["beg"], F.lit(reach))), F.substring(text, m["end"] + 1, F.lit(reach)))
    left, right = cut(20)
    left, right = squeeze(left), squeeze(right)
    close = left.endswith("share") | right.startswith("share")
    whole = F.concat(F.right(left, F.lit(6)), host).startswith("sharepoint.com") | F.concat(host, F.left(right, F.lit(6))).startswith("sharepoint.com")
    around = F.contains(F.concat(left, squeeze(host), right), F.lit("sharepointcom"))
    # any window or line, squeezed, is a part of the squeezed document, so the document alone decides
    named = host.isin("epoint.com", "harepoint.com", "point.com") & F.contains(squeeze(text), F.lit("sharepoint"))
    return close | whole | around | named


def email(text: Column, rank: int) -> Column:
    likely = F.contains(text, F.lit("@")) | text.rlike("(?Ui)\\sat\\s")
    return guarded(likely, _plain(text, C.EMAIL, "email", rank, "i"))


def phone(text: Column, rank: int) -> Column:
    return guarded(text.rlike("\\d{3}"), _plain(text, C.PHONE, "phone", rank))


def phone_groups(text: Column, rank: int) -> Column:
    """Every North American grouping of ASCII digits, also as a part of longer numbers, where phone() finds none; no Dutch numbers."""
    found = F.transform(matches(text, C.PHONE_GROUPS), lambda m: span(m["beg"], m["end"], "phone", m["text"], "phone", rank))
    return guarded(text.rlike("\\d{3}"), found)


def private_ip(text: Column, rank: int) -> Column:
    return guarded(text.rlike("(?U)\\d\\.\\d"), _plain(text, C.PRIVATE_IP, "private_ip", rank))


def public_ip(text: Column, rank: int) -> Column:
    return guarded(text.rlike("(?U)\\d\\.\\d"), _plain(text, C.PUBLIC_IP, "public_ip", rank))


def date_of_birth(text: Column, rank: int, year: int | None = None) -> Column:
    """Dates soon after a birth word on the same line, of someone 18 to 100 years old in the given (or this) year."""
    year = year or date.today().year
    pattern = C.java(C.DATE_OF_BIRTH, "i")

    def build(m: Column) -> Column:
        found = F.regexp_extract(m["text"], f"^(?:{pattern})$", 1)
        return span(m["end"] - F.length(found), m["end"], "date_of_birth", found, "date_of_birth", rank)

    def plausible(s: Column) -> Column:
        return F.regexp_extract(s["text"], "(\\d{4})", 1).cast("int").between(year - C.OLDEST, year - C.YOUNGEST)

    likely = F.lower(text).rlike("birth|born|dob|d\\.o\\.b")
    return guarded(likely, F.filter(F.transform(matches(text, pattern), build), plausible))
