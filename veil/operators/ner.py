"""Named entities by a spaCy model, in Arrow batches; listed only where spaCy is installed."""

from __future__ import annotations

import functools
import importlib.util
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from veil.operators.spans import SPANS, span

# The model of each locale, and the types of a model's labels; other labels are left out.
MODELS = {"nl_NL": "nl_core_news_sm", "en_US": "en_core_web_sm"}
KINDS = {"PERSON": "name", "PER": "name", "ORG": "organization", "GPE": "location", "LOC": "location"}


def installed(locale: str) -> bool:
    return importlib.util.find_spec("spacy") is not None


@functools.lru_cache(maxsize=2)
def _model(name: str):
    """Loaded once in each worker process."""
    import spacy

    return spacy.load(name)


def _pipe(locale: str) -> Callable:
    return _model(MODELS[locale]).pipe


def builder(locale: str, pipe: Callable[[str], Callable] = _pipe) -> Callable[[Column, int], Column]:
    """A detector; pipe(locale) gives what turns texts into documents with ents of start_char, end_char and label_."""
    if pipe is _pipe and importlib.util.find_spec(MODELS[locale]) is None:
        raise RuntimeError(f"the model {MODELS[locale]} is not installed")

    def build(text: Column, rank: int) -> Column:
        @F.pandas_udf("array<struct<beg:int,end:int,kind:string>>")
        def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            run = pipe(locale)
            for texts in batches:
                yield pd.Series([[{"beg": e.start_char, "end": e.end_char, "kind": KINDS[e.label_]} for e in d.ents if e.label_ in KINDS] for d in run(texts.fillna(""))], dtype=object)

        def one(x: Column) -> Column:
            own = F.substring(text, x["beg"] + 1, x["end"] - x["beg"])
            return span(x["beg"], x["end"], "", own, "spacy_entities", rank).withField("type", x["kind"])

        return F.transform(find(text), one).cast(SPANS)

    return build
