"""Dictionary matching, in two ways with one result.

``spans`` runs an Aho-Corasick automaton over each text in Arrow batches, with the fallback for entities written
otherwise (zero-width characters, `&` for `en`, other white space).  ``joined_spans`` is relational: text
tokens meet the first tokens of entities in an equi-join, so a large list needs no automaton in every worker; it finds entities as written.
"""

from __future__ import annotations

import logging
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veil import constants as C
from veil.functions.text import islower, let
from veil.operators.spans import BLOCK, SPANS, blocks, longest_first, matches, piece, span

log = logging.getLogger(__name__)
_LETTER = re.compile(f"[{C.LETTERS}]").match
_DELIMITER = re.compile(r"[\s\[\]()<>]")
_DOMAIN = re.compile(r"\.[a-z]{2,15}(?:/|\b)").search
_ZERO = re.compile(f"[{C.ZERO_WIDTH}]")
_UNIT = re.compile(rf"[{C.ZERO_WIDTH}]|&amp;|\s+|.", re.IGNORECASE | re.DOTALL)
#: Kinds whose entities must have an upper-case letter in the text.
CAPITALISED = ("organization", "location")


@dataclass(frozen=True)
class Gazetteer:
    """The entities of one kind. Useless ones are left out: one character, a stop word, or without a letter."""

    kind: str
    entities: tuple[str, ...]
    stop_words: frozenset[str] = frozenset()
    loaded: tuple[str, ...] = field(init=False, default=())

    def __post_init__(self) -> None:
        usable = (e.strip() for e in self.entities)
        kept = tuple(e for e in usable if len(e) > 1 and e.lower() not in self.stop_words and any(map(str.isalpha, e)))
        object.__setattr__(self, "loaded", kept)

    def without(self, taken: set[str]) -> Gazetteer:
        """This list without entities that a list before it has."""
        return Gazetteer(self.kind, tuple(e for e in self.loaded if e.lower() not in taken), self.stop_words)

    @cached_property
    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for e in self.loaded:
            found.add_word(e.lower(), len(e))
        found.make_automaton()
        return found

    @cached_property
    def several_words(self) -> list[tuple[str, str]]:
        """(lower case, normalised) of entities with a blank, if the latter has five characters or more."""
        pairs = ((e.lower(), normalised(e)) for e in self.loaded if " " in e)
        return sorted({(low, norm) for low, norm in pairs if len(norm) >= 5})

    def find(self, text: str | None) -> list[tuple[int, int]]:
        """Places of entities, ascending and apart."""
        if not text or not self.loaded:
            return []
        around = _Surroundings(text)
        hits: set[tuple[int, int]] = set()
        for last, size in self.automaton.iter(text.lower()):
            beg, end = last + 1 - size, last + 1
            own = text[beg:end]
            if around.word(beg, end) and not around.linked(beg, end) and not (size <= 3 and own.islower()) and self._allowed(own):
                hits.add((beg, end))
        if self.several_words:
            self._find_normalised(text, around, hits)
        chosen: list[tuple[int, int]] = []
        for hit in sorted(hits, key=lambda h: (h[0] - h[1], h[0])):
            at = bisect_left(chosen, hit)  # those chosen are apart, so only its neighbours can overlap it
            if (not at or chosen[at - 1][1] <= hit[0]) and (at == len(chosen) or hit[1] <= chosen[at][0]):
                chosen.insert(at, hit)
        return chosen

    def _allowed(self, own: str) -> bool:
        small = own.islower()
        return any(map(str.isalpha, own)) and not (small and (own in self.stop_words or self.kind in CAPITALISED))

    def _find_normalised(self, text: str, around: _Surroundings, hits: set[tuple[int, int]]) -> None:
        whole = normalised(text)
        wanted = [(low, norm) for low, norm in self.several_words if norm in whole]
        if not wanted:
            return
        units = _Units(text)
        written = {text[b:e].lower() for b, e in hits}
        for low, norm in wanted:
            if low in written:
                continue
            at = whole.find(norm)
            while at >= 0:
                beg, end = units.place(at, len(norm))
                own = text[beg:end]
                fits = beg < end and not re.search(r"[\n\r]", own) and any(map(str.isalpha, own)) and around.word(beg, end)
                if fits and own.strip().lower() not in self.stop_words and not around.linked(beg, end) and not (self.kind in CAPITALISED and own.islower()):
                    hits.add((beg, end))
                at = whole.find(norm, at + 1)


def normalised(text: str) -> str:
    """Without zero-width characters, & as ` en `, single blanks, lower case."""
    return " ".join(re.sub(r"&amp;|&", " en ", _ZERO.sub("", text), flags=re.IGNORECASE).split()).lower()


class _Surroundings:
    """What stands at the edges of a hit."""

    def __init__(self, text: str) -> None:
        self.text = text

    @cached_property
    def edges(self) -> list[int]:
        return [m.start() for m in _DELIMITER.finditer(self.text)]

    def word(self, beg: int, end: int) -> bool:
        return not (beg and _LETTER(self.text, beg - 1)) and not (end < len(self.text) and _LETTER(self.text, end))

    def linked(self, beg: int, end: int) -> bool:
        """Whether the run between delimiters that holds the hit looks like a URL."""
        left, right = bisect_left(self.edges, beg), bisect_left(self.edges, end)
        token = self.text[self.edges[left - 1] + 1 if left else 0 : self.edges[right] if right < len(self.edges) else len(self.text)].lower()
        return "://" in token or token.startswith("www.") or bool(_DOMAIN(token))


class _Units:
    """The text in units that count as characters of its normalised form.

    A run of white space counts 1, a zero-width character 0, and & or &amp; 3, although ` en ` has four:
    what follows them is placed as far off as that makes it.
    """

    def __init__(self, text: str) -> None:
        self.ends, self.counts, total = [0], [0], 0
        for m in _UNIT.finditer(text):
            u = m.group()
            total += 0 if u in C.ZERO_WIDTH else 3 if u[0] == "&" else 1
            self.ends.append(m.end())
            self.counts.append(total)

    def place(self, at: int, size: int) -> tuple[int, int]:
        first = min(bisect_left(self.counts, at), len(self.ends) - 1)
        last = min(bisect_left(self.counts, self.counts[first] + size, lo=first), len(self.ends) - 1)
        return self.ends[first], self.ends[last]


def in_order(lists: list[Gazetteer]) -> list[Gazetteer]:
    """The lists with every entity, case aside, only in the first that has it."""
    taken: set[str] = set()
    out = []
    for g in lists:
        out.append(g.without(taken))
        taken.update(e.lower() for e in out[-1].loaded)
    return out


def spans(text: Column, rank: int, gazetteer: Gazetteer) -> Column:
    """Spans of the gazetteer's entities, by automaton; an empty gazetteer costs no Python."""
    from veil.operators.spans import no_spans

    if not gazetteer.loaded:
        return no_spans()

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: [list(x) for x in gazetteer.find(t)])

    def build(p: Column) -> Column:
        beg, end = F.get(p, F.lit(0)), F.get(p, F.lit(1))
        return span(beg, end, gazetteer.kind, F.substring(text, beg + 1, end - beg), gazetteer.kind, rank)

    return F.coalesce(F.transform(find(text), build), F.array().cast(SPANS))


def load(spark: SparkSession, path: str, stop_words: list[str]) -> DataFrame:
    """(match) of a JSON list of {"match", "filth_type"}, with the useless ones left out; the kind in the file is not read.

    A missing or broken file is an empty list, with a warning.
    """
    try:
        rows = spark.read.schema("match string, filth_type string").option("multiLine", True).option("mode", "FAILFAST").json(path)
        rows.limit(1).collect()
    except Exception as error:
        log.warning("No entities from %s: %s", path, str(error).splitlines()[0])
        rows = spark.createDataFrame([], "match string, filth_type string")
    match = F.trim("match")
    usable = rows.select(match.alias("match")).where((F.length("match") > 1) & F.col("match").rlike("\\p{L}"))
    return usable.where(~F.lower("match").isin(stop_words)) if stop_words else usable


def first_list_wins(entities: DataFrame) -> DataFrame:
    """(match, kind, priority) rows without those whose lower case a row of smaller priority has."""
    best = F.min("priority").over(Window.partitionBy(F.lower("match")))
    return entities.withColumn("_best", best).where(F.col("_best") == F.col("priority")).drop("_best")


def joined_spans(docs: DataFrame, entities: DataFrame, stop_words: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kind, beg, end, text): entities (match, kind) as written, by equi-join on their first token.

    Tokens are runs of letters and digits.  An entity with none of them is not found this way.  Spark broadcasts the entity side only if
    it measures small; the numbers of tokens meet entities without their texts, and texts travel once: a text with candidates is placed token by token,
    and each candidate is checked where its token stands, in pieces of bounded length.
    """
    token = f"[{C.LETTERS}]+"
    first = F.regexp_extract(F.lower("match"), token, 0)
    wanted = entities.select("kind", F.lower("match").alias("low"), first.alias("token")).where("token <> ''").distinct()
    wanted = wanted.withColumn("shift", F.expr("locate(token, low) - 1"))
    words = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(token), F.lit(0))
    tokens = docs.select(F.col(id_col).alias("id"), F.posexplode(words).alias("n", "token"))
    near = tokens.join(wanted, "token").select("id", F.struct("n", "kind", "low", "shift").alias("c"))
    by_text = near.groupBy("id").agg(F.collect_list("c").alias("wanted"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("t"))
    both = texts.join(by_text.hint("shuffle_hash"), F.col("_id") == F.col("id")).select("id", "t", "wanted", matches(F.lower("t"), token).alias("tokens"), blocks(F.col("t")).alias("parts"))

    def place(c: Column) -> Column:
        beg = F.get(F.col("tokens"), c["n"])["beg"] - c["shift"]
        return F.struct(c["kind"].alias("kind"), c["low"].alias("low"), beg.alias("beg"), (beg + F.length(c["low"])).alias("end"))

    both = both.select("id", "t", "parts", F.transform("wanted", place).alias("all"))
    take = lambda beg, end: piece(F.col("parts"), F.greatest(beg, F.lit(0)), F.least(end, F.length("t")) - F.greatest(beg, F.lit(0)))
    delimiter = "(?U)[\\s\\[\\]()<>]"

    def link(c: Column, own: Column) -> Column:
        """The run between delimiters that holds the candidate, looked for in its neighbourhood first."""
        left, right = take(c["beg"] - BLOCK, c["beg"]), take(c["end"], c["end"] + BLOCK)
        left = F.when((c["beg"] <= BLOCK) | left.rlike(delimiter), left).otherwise(take(F.lit(0), c["beg"]))
        right = F.when((c["end"] + BLOCK >= F.length("t")) | right.rlike(delimiter), right).otherwise(take(c["end"], F.length("t")))
        return F.lower(F.concat(F.element_at(F.split(left, delimiter, -1), -1), own, F.get(F.split(right, delimiter, 2), F.lit(0))))

    def fits(c: Column) -> Column:
        def check(own: Column) -> Column:
            before, after = take(c["beg"] - 1, c["beg"]), take(c["end"], c["end"] + 1)
            apart = ((c["beg"] == 0) | ~before.rlike(f"[{C.LETTERS}]")) & ~after.rlike(f"[{C.LETTERS}]")
            small = islower(own)
            wrong = small & ((F.length(own) <= 3) | c["kind"].isin(*CAPITALISED) | (own.isin(stop_words) if stop_words else F.lit(False)))
            url = lambda x: F.contains(x, F.lit("://")) | x.startswith("www.") | x.rlike("(?U)\\.[a-z]{2,15}(?:/|\\b)")
            return (F.lower(own) == c["low"]) & apart & ~wrong & own.rlike("\\p{L}") & ~let(link(c, own), url)

        return (c["beg"] >= 0) & let(take(c["beg"], c["end"]), check)

    kept = both.select("id", "parts", F.filter("all", fits).alias("all")).where(F.size("all") > 0)
    each = kept.select("id", F.transform("all", lambda c: F.struct(c["kind"].alias("kind"), span(c["beg"], c["end"], "", piece(F.col("parts"), c["beg"], c["end"] - c["beg"]), "", 0).alias("s"))).alias("all"))
    kinds = F.explode_outer(F.array_distinct(F.transform("all", lambda c: c["kind"])))
    grouped = each.select("id", "all", kinds.alias("kind"))
    own = F.array_distinct(F.transform(F.filter("all", lambda c: c["kind"] == F.col("kind")), lambda c: c["s"]))
    found = grouped.select("id", "kind", F.explode_outer(longest_first(own)).alias("s")).where("s is not null")
    return found.select(F.col("id").alias(id_col), "kind", F.col("s.beg").alias("beg"), F.col("s.end").alias("end"), F.col("s.text").alias("text"))
