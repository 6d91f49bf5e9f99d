"""Spans of pattern matches as arrays, in expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.functions.text import let

SPAN = "struct<beg:int,end:int,type:string,text:string,detector:string,rank:int,link_text:string,url:string,bracket_pairs:int>"
SPANS = f"array<{SPAN}>"
#: Matches are placed in chunks, since an array that grows by one is copied each time.
CHUNK = 64
#: Characters of a block of a long text.
BLOCK = 1024


def no_spans() -> Column:
    return F.array().cast(SPANS)


def matches(text: Column, pattern: str | Column) -> Column:
    """array<struct<beg, end, text>> of all non-empty matches, offsets in code points.

    Spark has no function for positions, so they are summed up from the pieces between matches; texts without a match are not split.
    """
    found = F.regexp_extract_all(text, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(0))
    hits = "array<struct<beg:int,end:int,text:string>>"

    def place(m: Column) -> Column:
        pieces = F.when(F.size(m) > 0, F.split(text, pattern, -1)).otherwise(F.array(text))

        def one(s: Column, z: Column) -> Column:
            beg = s["at"] + F.length(z["p"])
            end = beg + F.length(z["m"])
            return F.struct(end.alias("at"), F.concat(s["out"], F.array(F.struct(beg.alias("beg"), end.alias("end"), z["m"].alias("text")))).alias("out"))

        def chunk(s: Column, zipped: Column, c: Column) -> Column:
            start = F.struct(s["at"].alias("at"), F.array().cast(hits).alias("out"))
            done = F.aggregate(F.slice(zipped, c * CHUNK + 1, F.lit(CHUNK)), start, one)
            return let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(s["out"], F.array(d["out"])).alias("out")))

        def all_chunks(zipped: Column) -> Column:
            start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{hits}>").alias("out"))
            chunks = F.sequence(F.lit(0), F.floor((F.size(zipped) - 1) / CHUNK).cast("int"))
            return F.aggregate(chunks, start, lambda s, c: chunk(s, zipped, c), lambda s: F.flatten(s["out"]))

        zipped = let(pieces, lambda p: F.arrays_zip(F.slice(p, 1, F.size(m)).alias("p"), m.alias("m")))
        return F.when(F.size(m) > 0, let(zipped, all_chunks)).otherwise(F.array().cast(hits))

    return let(found, place)


def span(beg: Column, end: Column, kind: str, text: Column, detector: str, rank: int, link_text: Column | None = None, url: Column | None = None, pairs: Column | None = None) -> Column:
    null = lambda t: F.lit(None).cast(t)
    return F.struct(
        beg.cast("int").alias("beg"), end.cast("int").alias("end"), F.lit(kind).alias("type"), text.alias("text"), F.lit(detector).alias("detector"), F.lit(rank).alias("rank"),
        (null("string") if link_text is None else link_text).alias("link_text"), (null("string") if url is None else url).alias("url"), (null("int") if pairs is None else pairs.cast("int")).alias("bracket_pairs"),
    )


def guarded(condition: Column, spans: Column) -> Column:
    """spans where a cheap necessary condition holds, else none."""
    return F.when(condition, spans).otherwise(no_spans())


def blocks(text: Column) -> Column:
    """The text in blocks of BLOCK characters.  A substring is counted from its text's start, so of a long one many pieces are cut out of its blocks."""
    return F.when(F.length(text) <= BLOCK, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))


def piece(parts: Column, beg: Column, size: Column) -> Column:
    """The text of so many characters from beg, out of blocks(text)."""
    first, last = F.floor(beg / BLOCK).cast("int"), F.floor((beg + size - 1) / BLOCK).cast("int")
    held = F.when(first >= last, F.get(parts, first)).otherwise(F.array_join(F.slice(parts, first + 1, last - first + 1), ""))
    return F.when(size <= 0, "").otherwise(F.substring(held, beg - first * BLOCK + 1, size))


def fold(items: Column, start: Column, state: str, kind: str, step, finish) -> Column:
    """finish(state, out) after step(state, item) -> (state, array of what goes out) for every item; out grows by chunks, since it is copied each time."""

    def one(s: Column, x: Column) -> Column:
        now, new = step(s["now"], x)
        return F.struct(now.cast(state).alias("now"), F.concat(s["out"], new.cast(f"array<{kind}>")).alias("out"))

    def chunk(s: Column, c: Column) -> Column:
        fresh = F.struct(s["now"].alias("now"), F.array().cast(f"array<{kind}>").alias("out"))
        done = F.aggregate(F.slice(items, c * CHUNK + 1, F.lit(CHUNK)), fresh, one)
        return let(done, lambda d: F.struct(d["now"].alias("now"), F.concat(s["out"], F.array(d["out"])).alias("out")))

    chunks = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int"))
    begin = F.struct(start.cast(state).alias("now"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.aggregate(chunks, begin, chunk, lambda s: finish(s["now"], F.flatten(s["out"])))


def _by_place(a: Column, b: Column) -> Column:
    x = F.when(a["beg"] != b["beg"], a["beg"] - b["beg"]).when(a["end"] != b["end"], b["end"] - a["end"]).otherwise(a["rank"] - b["rank"])
    return F.when(x < 0, -1).when(x > 0, 1).otherwise(0)


def merge(spans: Column, text: Column, touching: bool = True) -> Column:
    """Ascending spans without overlaps: overlapping ones, and touching ones if asked, become one of type unknown.

    A union's text is the source between its ends.
    """
    union = lambda beg, end, own: span(beg, end, "unknown", own, "merged", -1)

    def step(last: Column, s: Column) -> tuple[Column, Column]:
        meets = (s["beg"] <= last["end"]) if touching else (s["beg"] < last["end"])
        grown = union(last["beg"], F.greatest(last["end"], s["end"]), F.lit(None).cast("string"))
        return F.when(meets, grown).otherwise(s), F.when(last.isNull() | meets, no_spans()).otherwise(F.array(last))

    def told(merged: Column, parts: Column) -> Column:
        return F.transform(merged, lambda s: F.when(s["text"].isNull(), union(s["beg"], s["end"], piece(parts, s["beg"], s["end"] - s["beg"]))).otherwise(s))

    def whole(merged: Column) -> Column:
        return F.when(F.exists(merged, lambda s: s["text"].isNull()), let(blocks(text), lambda parts: told(merged, parts))).otherwise(merged)

    folded = let(F.array_sort(spans, _by_place), lambda x: fold(x, F.lit(None), SPAN, SPAN, step, lambda last, out: F.concat(out, F.array(last))))
    return F.when(F.size(spans) <= 1, spans).otherwise(let(folded, whole))


def splice(text: Column, spans: Column, replacement) -> Column:
    """text with every one of the ascending, disjoint spans replaced by replacement(span)."""

    def build(parts: Column) -> Column:
        before = lambda i: F.when(i == 0, 0).otherwise(F.get(spans, (i - 1).cast("int"))["end"])
        each = F.transform(spans, lambda x, i: F.concat(piece(parts, before(i), x["beg"] - before(i)), replacement(x)))
        last = F.element_at(spans, -1)["end"]
        return F.concat(F.array_join(each, ""), piece(parts, last, F.length(text) - last))

    return F.when(F.size(spans) == 0, text).otherwise(let(blocks(text), build))


def longest_first(spans: Column) -> Column:
    """Of overlapping candidates the longest, the first of equals; ascending.  Only candidates that overlap in a row are held against each other."""

    def order(a: Column, b: Column) -> Column:
        x = F.when(a["end"] - a["beg"] != b["end"] - b["beg"], (b["end"] - b["beg"]) - (a["end"] - a["beg"])).otherwise(a["beg"] - b["beg"])
        return F.when(x < 0, -1).when(x > 0, 1).otherwise(0)

    free = lambda done, s: ~F.exists(done, lambda d: (s["end"] > d["beg"]) & (s["beg"] < d["end"]))
    greedy = lambda own: F.aggregate(F.array_sort(own, order), no_spans(), lambda done, s: F.when(free(done, s), F.concat(done, F.array(s))).otherwise(done))
    chosen = lambda own: F.when(F.size(own) <= 1, own).otherwise(F.array_sort(greedy(own), lambda a, b: a["beg"] - b["beg"]))

    def step(now: Column, s: Column) -> tuple[Column, Column]:
        meets = s["beg"] < now["end"]
        grown = F.struct(F.greatest(now["end"], s["end"]).alias("end"), F.concat(now["own"], F.array(s)).alias("own"))
        return F.when(meets, grown).otherwise(F.struct(s["end"].alias("end"), F.array(s).alias("own"))), F.when(meets, F.array().cast(f"array<{SPANS}>")).otherwise(F.array(now["own"]))

    start = F.struct(F.lit(-1).alias("end"), no_spans().alias("own"))
    groups = let(F.array_sort(spans, _by_place), lambda x: fold(x, start, f"struct<end:int,own:{SPANS}>", SPANS, step, lambda now, out: F.concat(out, F.array(now["own"]))))
    return F.when(F.size(spans) <= 1, spans).otherwise(F.flatten(F.transform(groups, chosen)))


def explode_spans(df: DataFrame, spans: Column | str, *keep: str | Column) -> DataFrame:
    """The kept columns and s for every span.

    The outer form, since for the plain one the optimizer adds a filter on the size of spans and pushes it below their own
    definition, where all detectors would run a second time.
    """
    return df.select(*keep, F.explode_outer(spans).alias("s")).where("s is not null")
