"""Benchmark decontamination by SimHash over item-sized windows.

Every window of an item's length (in words) gets a 64-bit SimHash of its five-word shingles; one
multi-index over the fingerprints of all items, whatever their lengths, yields those within the radius; the weighted Jaccard similarity of the
shingles, repeats counted, then decides.  A window is fingerprinted only if it holds as many shingles of
items of its length as a similarity of the threshold needs, which leaves no match out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.llm.common import cut, free
from veil.llm.hamming import MultiIndex

SHINGLE, THRESHOLD = 5, 0.8
#: At a similarity of 0.8 fingerprints differ in 9.7 of 64 bits on average with a deviation of 2.9, and less above it: 19 is three deviations on.
#: Of 5 segments one then differs in 3 of 13 bits at most, which three in four of unlike codes fail in all of them.
RADIUS, SEGMENTS = 19, 5
#: The benchmark is taken in blocks of so many characters; each is one broadcast and one pass over the documents.
BLOCK_CHARS = 8_000_000

_WORDS = regex.compile(r"[\p{L}\p{M}\p{N}]+").findall


def words_of(text: str | None) -> list[str]:
    return _WORDS(text.lower()) if text else []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grams(hashes: np.ndarray, k: int) -> np.ndarray:
    n = len(hashes) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = _mix(out + hashes[j : j + n])
    return out


def _word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 7) or 1


def _fingerprints(grams: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """SimHash of each span of grams, from running sums of their bits."""
    bits = np.unpackbits(grams.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    sums = np.zeros((len(grams) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    ones = (sums[end] - sums[begin]) * 2 > (end - begin)[:, None]
    return np.packbits(ones, axis=1).view(">u8").ravel().astype(np.uint64)


class Benchmark:
    """The index of one block of items: words, shingles, and the fingerprints of all."""

    def __init__(self, items: list[tuple[int, str | None]], shingle: int = SHINGLE, threshold: float = THRESHOLD, radius: int = RADIUS) -> None:
        self.shingle, self.threshold, self.radius = shingle, threshold, radius
        told = [(i, w) for i, t in items if (w := words_of(t))]
        self.place = {w: n for n, w in enumerate(dict.fromkeys(w for _, words in told for w in words), 1)}
        self.hash = np.array([0, *map(_word_hash, self.place)], np.uint64)
        known: dict[int, list[tuple[np.ndarray, int]]] = {}
        self.names, self.counts, codes = [i for i, _ in told], [], []
        for _, words in told:
            k = min(shingle, len(words))
            grams = _grams(np.array(list(map(_word_hash, words)), np.uint64), k)
            known.setdefault(k, []).append((grams, len(words)))
            codes.append(_fingerprints(grams, np.array([0]), np.array([len(grams)])))
            self.counts.append(Counter(_tuples(words, k)))
        self.lengths = np.array([len(w) for _, w in told], np.int64)
        self.index = MultiIndex(np.concatenate([np.empty(0, np.uint64), *codes]), SEGMENTS)
        self.known = {k: self._table(own) for k, own in known.items()}

    @staticmethod
    def _table(own: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shingles, ascending; where each one's lengths begin; lengths of the items that hold it)."""
        grams, length = np.concatenate([g for g, _ in own]), np.repeat([n for _, n in own], [len(g) for g, _ in own])
        order = np.lexsort((length, grams))
        grams, length = grams[order], length[order]
        new = np.r_[True, (np.diff(grams) != 0) | (np.diff(length) != 0)]
        grams, length = grams[new], length[new]
        first = np.flatnonzero(np.r_[True, np.diff(grams) != 0])
        return grams[first], np.r_[first, len(grams)], length

    def matches(self, text: str | None) -> list[tuple[int, int, int, int, float]]:
        """(item, first word, words, distance, similarity): the best window for each item in a whole text."""
        words = words_of(text)
        if not words or not self.place:
            return []
        ids = np.fromiter(map(self.place.get, words, repeat(0)), np.int64, len(words))
        best: dict[int, tuple[float, int, int, int]] = {}
        hashes = None
        names, counts = self.names, self.counts
        for length, k, anchors in [(n, k, a) for k in self.known for n, a in self._anchors(ids, k)]:
            size = min(length, len(words)) - k + 1  # grams of a window
            if size < 1:
                continue
            least = int(np.ceil(self.threshold * (size + length - k + 1) / (1 + self.threshold) - 1e-9))
            if least > size:
                continue
            begin = self._windows(anchors, size, least, len(words) - k + 1 - size)
            if not len(begin):
                continue
            if hashes is None:
                hashes = np.fromiter(map(_word_hash, words), np.uint64, len(words))
            for part in np.split(begin, np.flatnonzero(np.diff(begin) > 4 * size) + 1):
                first = int(part[0])
                grams = _grams(hashes[first : int(part[-1]) + size + k - 1], k)
                which, places, distances = self.index.within(_fingerprints(grams, part - first, part - first + size), self.radius)
                own = self.lengths[places] == length
                which, places, distances = which[own], places[own], distances[own]
                for w in np.unique(which).tolist():
                    at = int(part[w])
                    window = Counter(_tuples(words[at : at + size + k - 1], k))
                    for p, d in zip(places[which == w].tolist(), distances[which == w].tolist(), strict=True):
                        shared = sum((window & counts[p]).values())
                        similarity = shared / (size + counts[p].total() - shared)
                        if similarity >= self.threshold and (names[p] not in best or (similarity, -at) > (best[names[p]][0], -best[names[p]][1])):
                            best[names[p]] = (similarity, at, size + k - 1, d)
        return [(i, at, n, d, s) for i, (s, at, n, d) in sorted(best.items())]

    def _anchors(self, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each length of items the places of the document's k-word shingles that such items hold."""
        n = len(ids) - k + 1
        if n < 1:
            return
        inside = np.r_[0, np.cumsum(ids > 0)]
        at = np.flatnonzero(inside[k:] - inside[:-k] == k)
        if not len(at):
            return
        value = np.zeros(len(at), np.uint64)
        for j in range(k):
            value = _mix(value + self.hash[ids[at + j]])
        known, start, lengths = self.known[k]
        found = np.minimum(np.searchsorted(known, value), len(known) - 1)
        held = known[found] == value
        at, found = at[held], found[held]
        if not len(at):
            return
        many = start[found + 1] - start[found]
        end = np.cumsum(many)
        length = lengths[np.repeat(start[found] - (end - many), many) + np.arange(int(end[-1]))]
        place = np.repeat(at, many)
        for x in np.unique(length).tolist():
            yield x, place[length == x]

    @staticmethod
    def _windows(anchors: np.ndarray, size: int, least: int, last: int) -> np.ndarray:
        """Starts, 0 to last, of windows of `size` grams with at least `least` anchors."""
        near = np.unique((anchors[:, None] - np.arange(size)).ravel()) if len(anchors) * size < 1 << 22 else np.arange(last + 1)
        near = near[(near >= 0) & (near <= last)]
        held = np.searchsorted(anchors, near + size) - np.searchsorted(anchors, near)
        return near[held >= least]


def _tuples(words: list[str], k: int) -> list[tuple[str, ...]]:
    return list(zip(*(words[j:] for j in range(k)), strict=False))


def blocks(benchmark: DataFrame, id_col: str, text_col: str, chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str | None]]]:
    """The items in blocks of bounded size, fetched one partition at a time."""
    held, size = [], 0
    for i, t in benchmark.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).toLocalIterator():
        held.append((i, t))
        size += len(t or "")
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, item, first_word, n_words, distance, similarity): for each document and item found in it, the best window.

    Words are lower-cased runs of letters, marks and digits.  An item of fewer than five words is one shingle; a
    document shorter than an item is one window.  Null and blank texts, on either side, match nothing;
    repeated rows each give theirs; no benchmark or no documents gives no rows.  One narrow pass over the
    documents for each block of the benchmark: nothing of the documents is shuffled, and what is broadcast has the size of a block.
    """
    given = docs.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).cast("string").alias(free([id_col], "text")[0]))
    schema = f"`{id_col}` long, `{item_col}` long, first_word long, n_words int, distance int, similarity double"
    names = [id_col, item_col, "first_word", "n_words", "distance", "similarity"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]

    def scan(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(i.as_py(), *m) for i, t in zip(b.column(0), b.column(1), strict=True) for m in shared.value.matches(t.as_py())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        return run

    out, several = None, False
    for block in blocks(benchmark, item_col, item_text, chars):
        shared = docs.sparkSession.sparkContext.broadcast(Benchmark(block))
        part = given.mapInArrow(scan(shared), schema)
        if several := several or sum(len(t or "") for _, t in block) >= chars:  # there may be more: this block is done with before the next one is made
            part = cut(part)
            shared.unpersist()
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], schema)
    best = F.max_by(F.struct("first_word", "n_words", "distance", "similarity"), F.struct("similarity", -F.col("first_word"))).alias("m")
    return out.groupBy(id_col, item_col).agg(best).select(id_col, item_col, "m.*")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", chars: int = BLOCK_CHARS) -> DataFrame:
    """docs, all columns, without the rows in which an item is found.

    A benchmark of one block filters in one narrow pass.  One of more blocks takes a pass for each, which notes the rows to drop by hashes of
    their texts, and drops them in a join at the end, so no two blocks are held at once.
    """
    kept, (text, digest) = docs.columns, free(docs.columns, "text", "digest")
    taken = iter(blocks(benchmark, item_col, item_text, chars))
    block, more = next(taken, None), next(taken, None)
    if block is None:
        return docs
    own = F.col(f"`{text_col}`").cast("string")

    def scan(shared, found: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hit = pa.array([bool(shared.value.matches(t.as_py())) for t in b.column(b.num_columns - 1)], pa.bool_())
                yield b.select(range(b.num_columns - 1)).filter(hit if found else pc.invert(hit))

        return run

    if more is None:
        shared = docs.sparkSession.sparkContext.broadcast(Benchmark(block))
        return docs.select(*(F.col(f"`{c}`") for c in kept), own.alias(text)).mapInArrow(scan(shared, False), docs.schema)
    named, gone = docs.select(F.sha2(own.cast("binary"), 256).alias(digest), own.alias(text)), None
    for part in chain([block, more], taken):
        shared = docs.sparkSession.sparkContext.broadcast(Benchmark(part))
        hits = cut(named.mapInArrow(scan(shared, True), f"`{digest}` string").distinct())
        shared.unpersist()
        gone = hits if gone is None else gone.unionByName(hits)
    marked = docs.withColumn(digest, F.sha2(own.cast("binary"), 256))
    return marked.join(gone.distinct(), digest, "left_anti").select(*(F.col(f"`{c}`") for c in kept))
