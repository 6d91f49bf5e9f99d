"""Exact substring dedup: bytes under a long string that starts anywhere else are removed.

The suffixes of a corpus do not fit into one array, so they are dealt to groups first.  The anchor of a window of `length` bytes is
its gram of least hash; equal windows have equal anchors at equal places, so a group holds the windows
of one anchor, as runs of windows that follow one another.  Runs whose anchor occurs once drop out,
and runs alike from end to end (by 81 bits of their bytes' digest and 64 of the anchor's) are collapsed to one member and its count.  Anchors with
very many different runs are counted window by window, by 128-bit digests.  Within every other group the suffixes are
sorted: prefix polynomial hashes give any substring's hash, a binary search over them the common extension of two suffixes, so a comparison
in the mergesort takes logarithmic time.  Neighbours that agree over the whole length are repeats; their bytes are
compared once more, in case hashes collided.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.llm.common import cut, partitions, written

LENGTH = 200
#: Texts are hashed in pieces of so many bytes.
PIECE = 1 << 20
#: Contexts that are sorted at a time, unless one group has more.
BATCH = 4000
#: Different runs of one anchor that are sorted; the windows of more than that are counted, which no one task has to do.
HOT = 1000
#: Where a run's place has the windows, the first of them, and what it has room for of the second half of the digest.
FIRST, MARK = 16, 47

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_size(length: int) -> int:
    """Bytes of an anchor; what is left of a window has at most 250 places for it."""
    return max(1, length * 8 // 25, length - 250)


class _Powers:
    """Powers of the base and of its inverse modulo 2**64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            with np.errstate(over="ignore"):
                self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)]) for x in (_BASE, inverse))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """H with the polynomial hash of data[i:j] being (H[j] - H[i]) * base**-i."""
    up, _ = _POWERS.to(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=out[1:])
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def runs_of(data: bytes, sizes: list[int], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor in texts that stand one after the other in data.

    (first window, windows, anchor's place after the first, anchor's hash, digest of the run's bytes in two halves), places from data's start.
    """
    n, k = len(data), gram_size(length)
    none = (np.empty(0, np.int64),) * 6
    if n < length:
        return none
    valid = np.zeros(n - length + 2, np.int8)
    end = np.cumsum(sizes)
    begin = end - np.array(sizes, np.int64)
    own = np.flatnonzero(np.array(sizes) >= length)
    valid[begin[own]] += 1
    valid[end[own] - length + 1] -= 1
    valid = np.cumsum(valid[:-1], dtype=np.int8) > 0
    h = prefix_hashes(np.frombuffer(data, np.uint8))
    _, down = _POWERS.to(n + 1)
    gram = _mix((h[k:] - h[:-k]) * down[: n - k + 1])
    low = np.uint64((1 << max(1, (n - 1).bit_length())) - 1)
    least = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
    width, span = length - k + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    anchor = (least & low).astype(np.int64)
    at = np.flatnonzero(valid)
    if not len(at):
        return none
    new = np.r_[True, (np.diff(at) > 1) | (anchor[at[1:]] != anchor[at[:-1]])]
    first = at[new]
    count = np.diff(np.r_[np.flatnonzero(new), len(at)])
    where = anchor[first]
    told = digests(memoryview(data), zip(first.tolist(), (first + count + (length - 1)).tolist(), strict=True))
    return first, count, where - first, gram[where].view(np.int64), told[:, 0], told[:, 1]


def digests(view: memoryview, spans: Iterable[tuple[int, int]]) -> np.ndarray:
    """128-bit digests of the spans' bytes, as two columns."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(view[a:b]) for a, b in spans]), "<i8").reshape(-1, 2)


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[int], bytes]]:
    """(rows, offsets, sizes, data): texts joined up to PIECE bytes; longer ones cut, each window in one piece."""
    names, offsets, sizes, parts, total = [], [], [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - length + 1, 0), PIECE):
            part = t[at : at + PIECE + length - 1]
            if total and total + len(part) > PIECE:
                yield names, offsets, sizes, b"".join(parts)
                names, offsets, sizes, parts, total = [], [], [], [], 0
            names.append(i)
            offsets.append(at)
            sizes.append(len(part))
            parts.append(part)
            total += len(part)
    if parts:
        yield names, offsets, sizes, b"".join(parts)


def _runs(docs: DataFrame, length: int) -> DataFrame:
    """(h, k, id, th, place) of every run; place packs 17 bits more of the digest, first window, windows - 1 and the anchor's place after the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                ids, hashes = part.column(0).to_numpy(), part.column(1).to_numpy()
                for rows, offsets, sizes, data in _pieces(part.column(2).to_pylist(), length):
                    first, count, rel, h, k, k2 = runs_of(data, sizes, length)
                    begin = np.r_[0, np.cumsum(sizes)[:-1]]
                    which = np.searchsorted(begin, first, side="right") - 1
                    place = k2 >> MARK << MARK | (first - begin[which] + np.array(offsets)[which]) << FIRST | (count - 1) << 8 | rel
                    row = np.array(rows, np.int64)[which]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, k, ids[row], hashes[row], place)], ["h", "k", "id", "th", "place"])

    return docs.select("id", "th", "raw").mapInArrow(run, "h long, k long, id long, th long, place long")


def _placed(place: int) -> tuple[int, int, int]:
    """(first window, windows, the anchor's place after the first)."""
    return place >> FIRST & (1 << MARK - FIRST) - 1, (place >> 8 & 255) + 1, place & 255


# -- sorting ----------------------------------------------------------------------------------


class SuffixSorter:
    """Sorts suffixes of one buffer, up to `length` bytes of each, by hash-compared mergesort."""

    def __init__(self, data: bytes, length: int) -> None:
        self.length = length
        self.data = np.frombuffer(data, np.uint8)
        self.prefix = prefix_hashes(self.data)
        self.down = _POWERS.to(len(data) + 1)[1]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common extensions of suffixes a and b, by binary search over prefix hashes."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.length, np.int64)
        while (open_ := low < high).any():
            mid = (low + high + 1) >> 1
            same = (self.prefix[a + mid] - self.prefix[a]) * self.down[a] == (self.prefix[b + mid] - self.prefix[b]) * self.down[b]
            low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
        return low

    def less(self, a: np.ndarray, b: np.ndarray, or_equal: bool) -> np.ndarray:
        n = self.common(a, b)
        whole = n >= self.length
        last = np.minimum(n, self.length - 1)
        return np.where(whole, or_equal, self.data[a + last] < self.data[b + last])

    def sort(self, at: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """The order of suffixes `at` within segments (which are ascending): all runs of one width merge in step."""
        order = np.arange(len(at))
        start = np.searchsorted(segment, segment)
        size = np.searchsorted(segment, segment, side="right") - start
        place = order - start
        width = 1
        while width < size.max(initial=0):
            live = np.flatnonzero(size > width)
            pos, base = place[live], start[live]
            pair = pos // (2 * width) * (2 * width)
            right = pos - pair >= width
            low = np.where(right, pair, np.minimum(pair + width, size[live]))
            high = np.where(right, pair + width, np.minimum(pair + 2 * width, size[live]))
            first = low.copy()
            me = at[order[live]]
            while len(open_ := np.flatnonzero(low < high)):
                mid = (low[open_] + high[open_]) >> 1
                other = at[order[base[open_] + mid]]
                side = right[open_]
                before = np.empty(len(open_), bool)  # whether the other stands before me: equal ones keep their order
                for s in (False, True):
                    if len(x := np.flatnonzero(side == s)):
                        before[x] = self.less(other[x], me[open_[x]], s)
                low[open_] = np.where(before, mid + 1, low[open_])
                high[open_] = np.where(before, high[open_], mid)
            to = base + pair + (pos - pair - np.where(right, width, 0)) + (low - first)
            moved = order.copy()
            moved[to] = order[live]
            order = moved
            width *= 2
        return order

    def repeated(self, at: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """For every suffix whether another of its segment agrees with it over the whole length."""
        order = self.sort(at, segment)
        a, b = at[order[:-1]], at[order[1:]]
        same = np.flatnonzero(segment[order[:-1]] == segment[order[1:]])
        same = same[self.common(a[same], b[same]) >= self.length]
        rows = np.lib.stride_tricks.sliding_window_view(self.data, self.length)
        out = np.zeros(len(at), bool)
        bad = set()
        for lo in range(0, len(same), 1 << 14):
            x = same[lo : lo + (1 << 14)]
            equal = (rows[a[x]] == rows[b[x]]).all(axis=1)
            out[order[x[equal]]] = out[order[x[equal] + 1]] = True
            bad.update(segment[order[x[~equal]]].tolist())
        for s in bad:  # hashes collided: this segment by its bytes
            members = np.flatnonzero(segment == s)
            text = [rows[i].tobytes() for i in at[members].tolist()]
            out[members] = [text.count(t) > 1 for t in text]
        return out


def _partial(length: int):
    """Spans of lone runs (m = 1) whose windows occur in other runs of their group, for rows sorted by group."""

    def spans(t: pa.Table) -> pa.RecordBatch:
        group = np.r_[0, np.cumsum((np.diff(t.column("h").to_numpy()) != 0) | (np.diff(t.column("sub").to_numpy()) != 0))]
        m, ids, hashes, first, rel = (t.column(c).to_numpy() for c in ("m", "id", "th", "first", "rel"))
        content = t.column("content").to_pylist()
        sizes = np.array([len(c) for c in content])
        begin = np.r_[0, np.cumsum(sizes)[:-1]]
        count = sizes - (length - 1)
        owner = np.repeat(np.arange(len(content)), count)
        shift = np.arange(len(owner)) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count)
        key = group[owner] * 512 + (rel[owner] - shift)
        order = np.argsort(key, kind="stable")
        segment = np.unique(key[order], return_inverse=True)[1]
        sorter = SuffixSorter(b"".join(content), length)
        hit = np.zeros(len(owner), bool)
        hit[order] = sorter.repeated((begin[owner] + shift)[order], segment)
        hit &= m[owner] == 1
        at = np.flatnonzero(hit)
        if not len(at):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 4, ["id", "th", "s", "e"])
        new = np.r_[True, np.diff(at) > 1] | np.r_[True, np.diff(owner[at]) != 0]
        last = np.r_[np.flatnonzero(new)[1:] - 1, len(at) - 1]
        o, s, e = owner[at[new]], shift[at[new]], shift[at[last]] + length
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[o], hashes[o], first[o] + s, first[o] + e)], ["id", "th", "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in _ended(batches):
            if b is not None:
                rest = pa.concat_tables([rest, pa.Table.from_batches([b])]) if rest is not None else pa.Table.from_batches([b])
            while rest is not None and rest.num_rows and (b is None or rest.num_rows > BATCH):
                h, sub = rest.column("h").to_numpy(), rest.column("sub").to_numpy()
                edge = np.flatnonzero((np.diff(h) != 0) | (np.diff(sub) != 0)) + 1
                fit = edge[edge <= BATCH]
                cut = int(fit[-1]) if len(fit) else int(edge[0]) if len(edge) else rest.num_rows if b is None else 0
                if b is None and rest.num_rows <= BATCH:
                    cut = rest.num_rows
                if not cut:
                    break
                yield spans(rest.slice(0, cut).combine_chunks())
                rest = rest.slice(cut)

    return run


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _contexts(length: int):
    """Bytes around the anchors of contested runs, twice: windows with half of what is left before the anchor, and the rest.

    Every window holds the bytes next to the anchor on one of its sides, half - on the side named by it; their hash
    parts a frequent anchor's runs into groups that agree on much more than the anchor.
    """
    k = gram_size(length)
    half = (length - k) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                rows = []
                for i, th, t, todo in zip(*(c.to_pylist() for c in b.slice(lo, 64).columns), strict=True):
                    for x in todo:
                        if x["hot"]:
                            continue
                        at, n, rel = _placed(x["place"])
                        a = at + rel  # the anchor
                        left = min(n, rel - half + 1)  # windows that begin at least half before it
                        if left > 0:
                            rows.append((x["h"], xxhash.xxh3_64_intdigest(t[a - half : a]) >> 1, x["m"], i, th, at, rel, t[at : at + left - 1 + length]))
                        skip = max(left, 0)
                        if skip < n:
                            tail = length - k - half
                            rows.append((x["h"], -1 - (xxhash.xxh3_64_intdigest(t[a + k : a + k + tail]) >> 1), x["m"], i, th, at + skip, rel - skip, t[at + skip : at + n - 1 + length]))
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["h", "sub", "m", "id", "th", "first", "rel", "content"])

    return run


def _windows(length: int):
    """(a, b, m, id, th, s): digest and place of every window of hot anchors' runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, th, t, todo in zip(*b.columns, strict=True):
                view = memoryview(t.as_buffer())
                for x in todo.as_py():
                    if not x["hot"]:
                        continue
                    at, n, _ = _placed(x["place"])
                    told = digests(view, ((p, p + length) for p in range(at, at + n)))
                    yield pa.RecordBatch.from_arrays([pa.array(told[:, 0]), pa.array(told[:, 1]), pa.array([x["m"]] * n, pa.int32()), pa.array([i.as_py()] * n, pa.int64()), pa.array([th.as_py()] * n, pa.int64()), pa.array(np.arange(at, at + n))], ["a", "b", "m", "id", "th", "s"])

    return run


def _others(length: int):
    """(id, th, s, e): what the windows of runs cover that are not among the lone ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, th, places, lone in zip(*b.columns, strict=True):
                every = np.unique(np.concatenate([np.arange(at, at + n) for at, n, _ in map(_placed, places.as_py())]))
                s = np.setdiff1d(every, np.array(lone.as_py() or [], np.int64))
                if not len(s):
                    continue
                cut = np.flatnonzero(np.diff(s) > 1)
                first, last = s[np.r_[0, cut + 1]], s[np.r_[cut, len(s) - 1]] + length
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * len(first), pa.int64()), pa.array([th.as_py()] * len(first), pa.int64()), pa.array(first), pa.array(last)], ["id", "th", "s", "e"])

    return run


def repeated_spans(docs: DataFrame, dealt: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, th, s, e): byte spans of the texts (id, th, raw), overlapping and in any order, that are covered by repeated strings.

    Runs are hashed twice, to find the anchors that repeat and to fetch their runs.  What is aggregated is checkpointed, so a join with
    it shuffles both sides and AQE can split a frequent anchor's runs.  The join with a frequent run's copies is written, or else the sorting would share its stage and its skew.
    """
    mark = F.shiftright("place", MARK)
    found = _runs(docs, length)
    differ = (F.min("k") != F.max("k")) | (F.min(mark) != F.max(mark))
    anchors = cut(found.groupBy("h").agg(F.count("*").alias("n"), differ.alias("mixed")).where("n > 1").select("h", "mixed"))
    shared = written(found.join(anchors, "h"), "suffix-runs")
    first = F.shiftright("place", FIRST).bitwiseAND(F.lit((1 << MARK - FIRST) - 1))
    span = (first.alias("s"), (first + F.shiftright("place", 8).bitwiseAND(F.lit(255)) + length).alias("e"))
    alike = shared.where("not mixed").select("id", "th", *span)
    mixed = shared.where("mixed").select("h", "k", mark.alias("mark"), "id", "th", "place")
    members = cut(mixed.groupBy("h", "k", "mark").agg(F.count("*").alias("m"), F.min(F.struct("id", "th", "place")).alias("one")))
    several = written(mixed.join(members.where("m > 1").select("h", "k", "mark"), ["h", "k", "mark"]).select("id", "th", *span), "suffix-copies")
    hot = cut(members.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("h", F.lit(True).alias("hot")))
    some_hot = not hot.isEmpty()
    told = members.join(hot, "h", "left") if some_hot else members.withColumn("hot", F.lit(False))
    own = told.select(F.col("one.id").alias("_id"), F.col("one.th").alias("_th"), F.struct("h", F.least("m", F.lit(2)).cast("int").alias("m"), F.col("one.place").alias("place"), F.coalesce("hot", F.lit(False)).alias("hot")).alias("x"))
    todo = own.groupBy("_id", "_th").agg(F.collect_list("x").alias("todo"))
    texts = dealt.join(todo.hint("shuffle_hash"), (dealt["id"] == todo["_id"]) & (dealt["th"] == todo["_th"])).select("id", "th", "raw", "todo")
    contexts = texts.mapInArrow(_contexts(length), "h long, sub long, m int, id long, th long, first long, rel int, content binary")
    sorted_ = contexts.repartition(partitions(docs.sparkSession), "h", "sub").sortWithinPartitions("h", "sub")
    out = alike.unionByName(several).unionByName(sorted_.mapInArrow(_partial(length), "id long, th long, s long, e long"))
    if some_hot:
        windows = texts.mapInArrow(_windows(length), "a long, b long, m int, id long, th long, s long")
        counted = windows.groupBy("a", "b").agg(F.sum("m").alias("n"), F.min(F.struct("id", "th", "s")).alias("one")).where("n = 1")
        lone = counted.groupBy("one.id", "one.th").agg(F.collect_list("one.s").alias("lone"))
        runs = own.where("x.hot and x.m = 1").groupBy(F.col("_id").alias("id"), F.col("_th").alias("th")).agg(F.collect_list("x.place").alias("places"))
        rest = runs.join(lone.hint("shuffle_hash"), ["id", "th"], "left").select("id", "th", "places", "lone")
        out = out.unionByName(rest.mapInArrow(_others(length), "id long, th long, s long, e long"))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept): every whole text, as bytes, without what a repeated string covers.

    A string of `length` bytes is repeated if it starts anywhere else, in the same text too; strings are judged
    on the input.  Matches never cross texts.  A null text counts as empty; texts shorter than length keep all.  A row is known by its id and
    a hash of its text (one with a null id by two hashes), so rows that share an id but not their text are rows of their own, and copies of one row are repeats of
    one another.  Other columns are ignored; an empty table gives none.  Texts are shuffled once, for both joins that need them.
    """
    given = docs.select(F.col(id_col).cast("bigint").alias("own"), F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b"")).alias("raw"))
    own = given.select("own", F.coalesce("own", F.xxhash64(F.lit(7), "raw")).alias("id"), F.xxhash64(F.lit(5), "raw").alias("th"), "raw")
    dealt = own.repartition(partitions(docs.sparkSession), "id", "th")
    spans = repeated_spans(own, dealt, length).groupBy("id", "th").agg(F.collect_list(F.struct("s", "e")).alias("spans")).withColumnsRenamed({"id": "_id", "th": "_th"})
    both = dealt.join(spans.hint("shuffle_hash"), (dealt["id"] == spans["_id"]) & (dealt["th"] == spans["_th"]), "left").select("own", "raw", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                rows = []
                for i, t, cut in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    kept, at, n = [], 0, 0
                    for s, e in merged((x["s"], x["e"]) for x in cut or ()):
                        kept.append(t[at:s])
                        at, n = e, n + 1
                    rest = b"".join([*kept, t[at:]])
                    rows.append((i, len(t), len(t) - len(rest), n, rest))
                kinds = [pa.int64()] * 4 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], [id_col, "n_bytes", "n_removed", "n_spans", "kept"])

    return both.mapInArrow(run, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept binary")


def merged(spans: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the spans cover."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


#: The same in SQL for windows of 200 bytes, in hexadecimal digits, two a byte.
SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS p FROM d WHERE n >= 200)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY k) AS c FROM w) WHERE c > 1),
m AS (SELECT doc_id, p, sum(CASE WHEN p > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run
      FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM r)),
s AS (SELECT doc_id, min(p) AS s, max(p) + 200 AS e FROM m GROUP BY doc_id, run),
g AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS from_ FROM s),
k AS (SELECT g.doc_id, count(*) AS spans, sum(e - s)::BIGINT AS gone, max(e) AS last, string_agg(substr(h, 2 * from_ + 1, 2 * (s - from_)), '' ORDER BY s) AS kept FROM g JOIN d USING (doc_id) GROUP BY g.doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(k.gone, 0) AS n_removed, coalesce(k.spans, 0) AS n_spans,
       sha256(unhex(coalesce(k.kept || substr(h, 2 * k.last + 1), h))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
