"""Scrubbing tables of texts: detection, merging, replacement and clean-up as one narrow plan for each locale."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.functions.text import free
from veil.operators import placeholder
from veil.operators.cleanup import cleanup as clean_up
from veil.operators.spans import SPANS, explode_spans, merge, no_spans, splice
from veil.plans import catalogue

log = logging.getLogger(__name__)


def with_spans(df: DataFrame, locale: str, detectors: list[str] | None = None, custom_text: str | None = None, text_col: str = "text", into: str = "spans", touching: bool = True) -> DataFrame:
    """df with `into`: the merged spans of the text, by the selected detectors; none for a null text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.withColumn(into, _found(text, catalogue.builders(locale, detectors, custom_text))).withColumn(into, merge(F.col(into), text, touching))


def _found(text: Column, builders: list, before: int = 0) -> Column:
    """The spans of all detectors but the first so many."""
    parts = [build(text, rank) for rank, (_, build) in enumerate(builders) if rank >= before]
    return (F.concat(*parts) if parts else no_spans()).cast(SPANS)


def scrub(
    df: DataFrame, locale: str = "en_US", detectors: list[str] | None = None, custom_text: str | None = None, cleanup: bool = True,
    text_col: str = "text", into: str | None = None, replace: Callable[[Column], Column] | None = None, keep_spans: str | None = None,
) -> DataFrame:
    """df with the scrubbed text in `into` (the text column itself by default) and its spans in keep_spans, if named.

    A null text stays null.  The plan has no shuffle; Python runs only if a gazetteer with entities is selected.
    """
    spans = keep_spans or free(df.columns, "spans")[0]
    out = with_spans(df, locale, detectors, custom_text, text_col, spans)
    new = splice(F.col(text_col), F.col(spans), replace or placeholder.replacer())
    out = out.withColumn(into or text_col, clean_up(new) if cleanup else new)
    return out if keep_spans else out.drop(spans)


def locales_of(locale: str | None) -> list[str]:
    return list(catalogue.LOCALES) if locale is None else [locale]


def scrub_locales(
    df: DataFrame, locale: str | None = None, detectors: dict[str, list[str]] | list[str] | None = None, custom_text: str | None = None, cleanup: bool = True,
    id_col: str = "doc_id", text_col: str = "text", include_spans: bool = False,
) -> DataFrame:
    """(id, locale, text, detectors, error[, spans]): a row for each text and locale, both locales for None.

    detectors is a list for all locales or a map by locale; a locale that the map lacks runs none.  A locale whose plan cannot be built has its
    error in its rows and a null text; if none can be built, the first error is raised.  Texts are read once, and detectors that the locales share run once.
    """
    plans, errors = {}, {}
    for x in locales_of(locale):
        try:
            plans[x] = catalogue.builders(x, detectors.get(x, []) if isinstance(detectors, dict) else detectors, custom_text)
        except Exception as error:
            log.warning("Locale %s failed: %s", x, error)
            errors[x] = error
    if not plans:
        raise next(iter(errors.values()))
    text = F.coalesce(F.col(text_col), F.lit(""))
    first = next(iter(plans.values()))
    same = lambda i: all(i < len(p) and p[i][0] == first[i][0] and (p[i][1] is first[i][1] or p[i][0] == "custom") for p in plans.values())
    shared = next((i for i in range(len(first) + 1) if i == len(first) or not same(i)), 0)  # detectors that all locales begin with run once
    out = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), _found(text, first[:shared]).alias("_shared"))
    text = F.coalesce(F.col("_text"), F.lit(""))
    out = out.select("_id", "_text", *(F.concat("_shared", _found(text, p, shared)).alias(f"_{x}") for x, p in plans.items()))
    out = out.select("_id", "_text", *(merge(F.col(f"_{x}"), text).alias(f"_{x}") for x in plans))

    def row(x: str) -> Column:
        if x in errors:
            told = (F.lit(None).cast("string"), F.array().cast("array<string>"), F.lit(str(errors[x])), no_spans())
        else:
            new = splice(F.col("_text"), F.col(f"_{x}"), placeholder.replacer())
            told = (clean_up(new) if cleanup else new, F.array(*(F.lit(n) for n, _ in plans[x])).cast("array<string>"), F.lit(None).cast("string"), F.col(f"_{x}"))
        return F.struct(F.lit(x).alias("locale"), *(c.alias(n) for c, n in zip(told, ("text", "detectors", "error", "spans"), strict=True)))

    whole = out.select(F.col("_id").alias(id_col), F.explode_outer(F.array(*map(row, locales_of(locale)))).alias("_row")).select(id_col, "_row.*")
    return whole if include_spans else whole.drop("spans")


def scrub_default(df: DataFrame, locale: str | None = None, detectors: list[str] | None = None, custom_text: str | None = None, cleanup: bool = True, text_col: str = "text") -> DataFrame:
    """The one text of a command-line run: the locale's, and without a locale the Dutch one."""
    return scrub(df, locale or "nl_NL", detectors, custom_text, cleanup, text_col)


def findings(df: DataFrame, locale: str | None = None, detectors: dict[str, list[str]] | list[str] | None = None, custom_text: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, locale, beg, end, type, text, detector, replacement) of every merged span, always with the default placeholders."""
    rows = scrub_locales(df, locale, detectors, custom_text, False, id_col, text_col, include_spans=True)
    each = explode_spans(rows, "spans", id_col, "locale")
    return each.select(id_col, "locale", "s.beg", "s.end", "s.type", "s.text", "s.detector", placeholder.replacement(F.col("s")).alias("replacement"))


def report(found: DataFrame) -> DataFrame:
    """(locale, line) of a verbose run: - type: 'text' -> 'replacement', with url for merged spans that became URLs."""
    kind = F.when((F.col("type") == "unknown") & F.col("replacement").startswith("URL-"), "url").otherwise(F.col("type"))
    return found.select("locale", F.concat(F.lit("- "), kind, F.lit(": '"), "text", F.lit("' -> '"), "replacement", F.lit("'")).alias("line"))


def summary(results: DataFrame) -> DataFrame:
    """(locale, texts, characters, spans, errors) of scrub_locales(..., include_spans=True)."""
    return results.groupBy("locale").agg(
        F.count("*").alias("texts"), F.sum(F.length("text")).alias("characters"), F.sum(F.size("spans")).alias("spans"), F.count("error").alias("errors")
    )


def combined_text(results: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, text): what is not empty of a text's locales, in their order, with an empty line between."""
    ordered = F.array_sort(F.collect_list(F.struct("locale", "text")))
    texts = F.filter(F.transform(ordered, lambda x: x["text"]), lambda t: F.coalesce(t, F.lit("")) != "")
    return results.groupBy(id_col).agg(F.array_join(texts, "\n\n").alias("text"))
