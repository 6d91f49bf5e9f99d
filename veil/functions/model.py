"""The detectors on single strings, for SQL functions that must take any locale at run time.

Spark's own expressions in ``veil.operators`` are the main way; this one is row by row in Arrow batches.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import cache
from typing import NamedTuple

from veil import constants as C


class Span(NamedTuple):
    beg: int
    end: int
    kind: str
    text: str
    link_text: str | None = None
    pairs: int = 1


@cache
def _re(pattern: str, flags: int = 0) -> re.Pattern:
    return re.compile(pattern, flags)


def _squeeze(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "", text.lower())


def _plain(kind: str, pattern: str, flags: int = 0) -> Callable[[str], list[Span]]:
    return lambda text: [Span(m.start(), m.end(), kind, m.group()) for m in _re(pattern, flags).finditer(text)]


def url(text: str) -> list[Span]:
    out = []
    for m in _re(C.URL, re.I).finditer(text):
        own = re.sub(r"[\]\)\.,;:>]+$", "", m.group())
        low = own.lower()
        host = low.split("/", 1)[0]
        marked = low.startswith(("http://", "https://", "ftp://", "www."))
        if not marked and low != own and any(map(str.isupper, own)):
            continue
        if host.endswith("point.com"):
            left, right = _squeeze(text[max(0, m.start() - 20) : m.start()]), _squeeze(text[m.end() : m.end() + 20])
            torn = left.endswith("share") or right.startswith("share") or (left[-6:] + host).startswith("sharepoint.com") or (host + right[:6]).startswith("sharepoint.com")
            torn = torn or "sharepointcom" in left + _squeeze(host) + right
            if torn or (host in ("epoint.com", "harepoint.com", "point.com") and "sharepoint" in _squeeze(text)):
                continue
        out.append(Span(m.start(), m.end(), "url", own))
    return out


def markdown_url(text: str) -> list[Span]:
    found = _re(C.MARKDOWN_URL, re.I | re.S).finditer(text)
    return [Span(m.start(), m.end(), "markdown_url", m.group(), m.group(2), len(m.group(1))) for m in found if len(m.group(1)) == len(m.group(3))]


def sharepoint_url(text: str) -> list[Span]:
    found = _re(C.SHAREPOINT_URL, re.I).finditer(text)
    return [Span(m.start(), m.end(), "url", re.sub(r"[\]\)\.,;:>'\"]+$", "", re.sub(r"\s+", "", m.group()))) for m in found]


def date_of_birth(text: str, year: int | None = None) -> list[Span]:
    from datetime import date

    year = year or date.today().year
    out = []
    for m in _re(C.DATE_OF_BIRTH, re.I).finditer(text):
        then = int(re.search(r"\d{4}", m.group(1)).group())
        if year - C.OLDEST <= then <= year - C.YOUNGEST:
            out.append(Span(m.start(1), m.end(1), "date_of_birth", m.group(1)))
    return out


DETECTORS: dict[str, Callable[[str], list[Span]]] = {
    "markdown_url": markdown_url,
    "sharepoint_url": sharepoint_url,
    "url": url,
    "email": _plain("email", C.EMAIL, re.I),
    "phone": _plain("phone", C.PHONE),
    "private_ip": _plain("private_ip", C.PRIVATE_IP),
    "public_ip": _plain("public_ip", C.PUBLIC_IP),
    "date_of_birth": date_of_birth,
}


def merge(text: str, spans: list[Span]) -> list[Span]:
    out: list[Span] = []
    for s in sorted(spans, key=lambda s: (s.beg, -s.end)):
        if out and s.beg <= out[-1].end:
            end = max(s.end, out[-1].end)
            out[-1] = Span(out[-1].beg, end, "unknown", text[out[-1].beg : end])
        else:
            out.append(s)
    return out


def placeholder(kind: str, text: str, algorithm: str = "md5", modulus: int = C.MODULUS) -> str:
    digest = hashlib.new("sha256" if algorithm == "sha256" else "md5", f"{kind}:{text}".encode()).hexdigest()
    low, compact = text.lower(), text.lower().replace(" ", "")
    urlish = kind == "markdown_url" or low.startswith(("http://", "https://", "ftp://", "www.")) or "sharepoint.com/" in low
    urlish = urlish or (compact.startswith("[") and "](" in compact and "://" in compact)
    return f"{'URL' if urlish else kind.upper()}-{int(digest, 16) % modulus:0{max(3, len(str(modulus - 1)))}d}"


def detect(text: str | None, locale: str = "en_US", detectors: list[str] | None = None) -> list[Span]:
    """Merged spans of a text by the selected (or default) detectors of a locale."""
    from veil.plans import catalogue

    if not text:
        return []
    lists = {g.kind: g for g in catalogue.GAZETTEERS.get(locale, [])}
    found: list[Span] = []
    for s in catalogue.select(locale, detectors):
        if s.name in DETECTORS:
            found += DETECTORS[s.name](text)
        elif s.name in lists:
            found += [Span(b, e, s.name, text[b:e]) for b, e in lists[s.name].find(text)]
    return merge(text, found)


def scrub(text: str | None, locale: str = "en_US", detectors: list[str] | None = None) -> str | None:
    """The text with placeholders, without clean-up."""
    if text is None:
        return None
    out, at = [], 0
    for s in detect(text, locale, detectors):
        own = placeholder(s.kind, s.text)
        out += [text[at : s.beg], own if s.link_text is None else f"{'[' * s.pairs}{s.link_text}{']' * s.pairs}({own})"]
        at = s.end
    return "".join([*out, text[at:]])
