"""The detectors by locale, in the order in which they run, and the rules for selecting them."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession

from veil import constants as C
from veil.entities import load_json
from veil.operators import detectors as D
from veil.operators import gazetteer as G
from veil.operators import ner

log = logging.getLogger(__name__)
LOCALES = ("en_US", "nl_NL")

#: A detector's builder: from the text column and its rank to an array of spans.
Builder = Callable[[Column, int], Column]


@dataclass(frozen=True)
class Spec:
    name: str
    description: str
    build: Callable[[str], Builder]
    enabled: Callable[[str], bool] = lambda locale: True
    by_default: bool = True


def _pattern(build: Builder) -> Callable[[str], Builder]:
    return lambda locale: build


def dutch(applications: tuple[str, ...] = (), locations: tuple[str, ...] = (), organizations: tuple[str, ...] = (), names: tuple[str, ...] = ()) -> list[G.Gazetteer]:
    stop = frozenset(C.DUTCH_STOP_WORDS)
    lists = (("location", locations), ("organization", organizations), ("name", names), ("application", applications))
    return G.in_order([G.Gazetteer(kind, tuple(x), stop) for kind, x in lists])


def english() -> list[G.Gazetteer]:
    stop = frozenset(C.ENGLISH_STOP_WORDS)
    lists = (("name", C.ENGLISH_NAMES), ("organization", C.ENGLISH_ORGANIZATIONS), ("location", C.ENGLISH_LOCATIONS))
    return [G.Gazetteer(kind, tuple(x), stop) for kind, x in lists]


#: The entity lists of each locale; assign others, or use_entities() of a folder, to match other entities.
GAZETTEERS: dict[str, list[G.Gazetteer]] = {"nl_NL": dutch(), "en_US": english()}


def _listed(kind: str) -> Callable[[str], Builder]:
    def build(locale: str) -> Builder:
        own = next(g for g in GAZETTEERS[locale] if g.kind == kind)
        return lambda text, rank: G.spans(text, rank, own)

    return build


def entity_lists(folder: str | Path, locale: str) -> list[G.Gazetteer]:
    """The lists of a folder that the entity tool edits: cities (or locations), names, organizations and applications as JSON.

    A missing or broken file is an empty list, with a warning.  Dutch entities stay in the first list that has them.
    """

    def read(*files: str) -> tuple[str, ...]:
        name = next((f for f in files if (Path(folder) / f).exists()), files[0])
        return tuple(r["match"] for r in load_json(Path(folder) / name) if isinstance(r, dict) and isinstance(r.get("match"), str))

    found = {"locations": read("cities.json", "locations.json"), "organizations": read("organizations.json"), "names": read("names.json"), "applications": read("applications.json")}
    if locale == "nl_NL":
        return dutch(**found)
    stop = frozenset(C.ENGLISH_STOP_WORDS)
    return [G.Gazetteer(kind, found[f"{kind}s"], stop) for kind in ("name", "organization", "location")]


def use_entities(folder: str | Path, locales: tuple[str, ...] = LOCALES) -> None:
    """From now on the detectors of these locales match the folder's lists."""
    for x in locales:
        GAZETTEERS[x] = entity_lists(folder, x)


_NER = Spec("spacy_entities", "Named entities by a spaCy model (where spaCy and the model are installed)", ner.builder, ner.installed, False)
GENERIC: list[Spec] = [
    Spec("markdown_url", "URLs in Markdown links [text](url)", _pattern(D.markdown_url)),
    Spec("sharepoint_url", "SharePoint URLs, before the generic URLs", _pattern(D.sharepoint_url)),
    Spec("url", "URLs with a protocol, www or a bare domain", _pattern(D.url)),
    Spec("email", "E-mail addresses", _pattern(D.email)),
    Spec("phone", "Phone numbers", _pattern(D.phone)),
    Spec("private_ip", "Private IP addresses (192.168.x.x, 10.0.x.x, 172.x.x.x)", _pattern(D.private_ip)),
    Spec("public_ip", "Public IP addresses", _pattern(D.public_ip)),
]
BY_LOCALE: dict[str, list[Spec]] = {
    "nl_NL": [
        Spec("location", "Dutch locations", _listed("location")),
        Spec("organization", "Dutch organizations", _listed("organization")),
        Spec("name", "Dutch person names", _listed("name")),
        Spec("application", "Application names", _listed("application")),
        _NER,
    ],
    "en_US": [
        Spec("name", "English person names", _listed("name")),
        Spec("organization", "English organizations", _listed("organization")),
        Spec("location", "English locations", _listed("location")),
        Spec("date_of_birth", "Dates of birth", _pattern(D.date_of_birth)),
        _NER,
    ],
}


def register_detector(spec: Spec, locale: str | None = None) -> None:
    """Add a detector, or replace one of its name: for one locale, or for all after the generic ones."""
    into = GENERIC if locale is None else BY_LOCALE.setdefault(locale, [])
    into[:] = [s for s in into if s.name != spec.name] + [spec]


def specs(locale: str) -> list[Spec]:
    return [s for s in (*GENERIC, *BY_LOCALE.get(locale, [])) if s.enabled(locale)]


def available(locale: str | None = None) -> dict:
    """Descriptions by name for a locale, or, without one, those of each locale's own detectors."""
    if locale:
        return {s.name: s.description for s in specs(locale)}
    return {x: {s.name: s.description for s in own if s.enabled(x)} for x, own in BY_LOCALE.items()}


def select(locale: str, wanted: list[str] | None) -> list[Spec]:
    """The detectors to run, in catalogue order: the default ones for None, and of a list those there are."""
    known = specs(locale)
    if wanted is None:
        return [s for s in known if s.by_default]
    names = [w.lower() for w in wanted]
    if unknown := sorted({n for n in names if n not in {s.name for s in known}}):
        log.warning("Unknown detectors for locale %s: %s", locale, ", ".join(unknown))
    return [s for s in known if s.name in names]


def builders(locale: str, wanted: list[str] | None = None, custom_text: str | None = None) -> list[tuple[str, Builder]]:
    """(name, builder) of every detector to run, the custom phrase first; one that cannot be built is left out with a warning."""
    out: list[tuple[str, Builder]] = []
    if custom_text:
        out.append(("custom", lambda text, rank: D.custom(text, rank, custom_text)))
    for s in select(locale, wanted):
        try:
            out.append((s.name, s.build(locale)))
        except Exception as error:
            log.warning("Could not add detector %s: %s", s.name, error)
    return out


def catalogue(spark: SparkSession) -> DataFrame:
    """(locale, ord, name, description, enabled_by_default) of all detectors, whether their extras are installed or not."""
    rows = [(locale, n, s.name, s.description, s.by_default) for locale in LOCALES for n, s in enumerate((*GENERIC, *BY_LOCALE[locale]))]
    return spark.createDataFrame(rows, "locale string, ord int, name string, description string, enabled_by_default boolean")


# -- tokens of a selection ----------------------------------------------------------------------


def locale_selections(tokens: list[str] | None) -> dict[str, list[str]] | None:
    """Detector names by locale: plain tokens for both, `en:` and `nl:` ones for theirs; None for no tokens."""
    if not tokens:
        return None
    prefix = {"en_US": "en", "nl_NL": "nl"}
    return {locale: sorted({t.partition(":")[2] if ":" in t else t for t in tokens if ":" not in t or t.partition(":")[0] == own}) for locale, own in prefix.items()}


def plain_tokens(tokens: list[str] | None) -> list[str]:
    """Names without prefixes, each once, in order."""
    return list(dict.fromkeys(n for t in tokens or [] if (n := t.split(":", 1)[-1])))


#: Names that selection forms show for both locales.
SHOWN_FOR_BOTH = ("markdown_url", "url", "email", "phone", "private_ip", "public_ip")


def grouped(shown: tuple[str, ...] = SHOWN_FOR_BOTH) -> tuple[dict, dict, dict]:
    """(generic, English, Dutch) descriptions by name."""
    en, nl = available("en_US"), available("nl_NL")
    return {n: en[n] for n in shown if n in en}, {n: d for n, d in en.items() if n not in shown}, {n: d for n, d in nl.items() if n not in shown}


def listing() -> str:
    """The catalogue as text, names padded to 15."""
    lines = ["generic:"] + [f"  {s.name:<15} {s.description}" for s in GENERIC]
    for locale, own in BY_LOCALE.items():
        lines += [f"{locale}:"] + [f"  {s.name:<15} {s.description}" for s in own if s.enabled(locale)]
    return "\n".join(lines)
