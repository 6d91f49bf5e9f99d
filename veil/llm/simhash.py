"""SimHash near-duplicates: fingerprints, bit-sliced comparison inside buckets, connected components.

Fingerprints of candidates stand in bit planes (one packed word array for each bit), so one word
operation moves 64 comparisons on.  Differing bits are added up in carry-save counters, and a block
of 64 comparisons is given up once all of its distances exceed the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.llm.common import connected_components, cut

#: A bucket with more members than this is split into a grid of cells that are compared apart.
CELL = 4096
#: Words of 64 comparisons that are counted at a time.
WORDS = 4096
#: Differing planes that are added up before hopeless blocks are given up.
STRIDE = 16


def shingle_list(words: list[bytes], k: int) -> list[bytes]:
    """All k-word shingles, repeats included; of fewer words the whole sequence, of none nothing."""
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    return [b" ".join(x) for x in zip(*(words[i:] for i in range(k)), strict=False)]


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space (space and 0x09 to 0x0D)."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def majority(digests: bytes, width: int) -> bytes:
    """The fingerprint of hashes of width bytes each, in a row: a bit is set if over half have it."""
    rows = np.frombuffer(digests, np.uint8).reshape(-1, width)
    if not len(rows):
        return bytes(width)
    ones = np.zeros(width * 8, np.int64)
    for at in range(0, len(rows), 1 << 16):
        ones += np.unpackbits(rows[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(rows)).tobytes()


def fingerprints(df: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): 64-bit SimHash of every whole text over the XXH64 (seed 42) of its k-word shingles.

    A null or blank text has fingerprint 0.  Rows with equal ids each get a row.
    """
    digest = partial(xxhash.xxh64_digest, seed=42)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = b"".join(majority(b"".join(map(digest, shingle_list(words_of(t.as_py()), k))), 8) for t in b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.frombuffer(got, ">u8").astype("u8").view("i8"))], ["id", "fp"])

    got = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return got.mapInArrow(run, "id long, fp long")


def block_keys(fp: Column, radius: int, bits: int = 64) -> Column:
    """Bucket keys that any two fingerprints at most radius bits apart share one of.

    radius + 2 blocks; radius differing bits leave two of them alike at least, so there is a key for every pair of blocks.
    """
    n = radius + 2
    cuts = [bits * i // n for i in range(n + 1)]
    masks = [((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in range(n)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return F.array(*(F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(signed(masks[a] | masks[b])))) for i, (a, b) in enumerate(combinations(range(n), 2))))


def _transpose(fps: np.ndarray) -> np.ndarray:
    """fps: (n, bytes) uint8 -> (bits, words) uint64 planes; lane i is bit i % 64 of word i // 64."""
    n, width = fps.shape
    lanes = -(-n // 64) * 64
    bits = np.zeros((width * 8, lanes), np.uint8)
    bits[:, :n] = np.unpackbits(fps, axis=1).T
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def close_lanes(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows i whose fingerprints left[i] and right[i] are at most radius bits apart, and those distances."""
    lane, distance = counted(_transpose(left) ^ _transpose(right), radius)
    inside = lane < len(left)
    return lane[inside], distance[inside]


def counted(differ: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Lanes of the (bits, words) planes of differing bits with at most radius of them, and how many.

    Each plane is rippled through carry-save counters with one word for each binary digit of the count; every STRIDE planes, words whose
    64 lanes all exceed the radius are dropped.
    """
    bits = len(differ)
    words = np.arange(differ.shape[1])
    digits = [np.zeros(len(words), np.uint64) for _ in range(bits.bit_length())]
    for at in range(0, bits, STRIDE):
        for p in range(at, min(at + STRIDE, bits)):
            carry = differ[p]
            for k, d in enumerate(digits[: (p + 1).bit_length()]):
                digits[k], carry = d ^ carry, d & carry
        live = _exceeds(digits, radius) != np.uint64(0xFFFFFFFFFFFFFFFF)
        if not live.all():
            words, digits, differ = words[live], [d[live] for d in digits], differ[:, live]
        if not len(words):
            return np.empty(0, np.int64), np.empty(0, np.int64)
    planes = [np.unpackbits(d.view(np.uint8), bitorder="little").astype(np.int64) for d in digits]
    distance = sum(x << k for k, x in enumerate(planes))
    near = distance <= radius
    return (words[:, None] * 64 + np.arange(64)).ravel()[near], distance[near]


def _exceeds(digits: list[np.ndarray], radius: int) -> np.ndarray:
    """For every lane whether its count, in bit-sliced digits, is over radius."""
    over, same = np.zeros_like(digits[0]), ~np.zeros_like(digits[0])
    for k in range(len(digits) - 1, -1, -1):
        if radius >> k & 1:
            same = same & digits[k]
        else:
            over, same = over | (same & digits[k]), same & ~digits[k]
    return over


def _forest(a: np.ndarray, b: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Of the links a[i] - b[i], nearest first, those that join two parts: a spanning forest."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    keep = []
    for i in np.argsort(distance, kind="stable").tolist():
        x, y = root(int(a[i])), root(int(b[i]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep.append(i)
    return np.array(keep, np.int64)


def bucket_links(node: np.ndarray, fps: np.ndarray, size: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links inside buckets that lie one after the other; size has each row's bucket size.

    Fingerprints stand in planes once, buckets of about one size together.  Shift d of the planes compares row i with row i + d of its bucket, for
    all of these buckets at once, and many shifts are counted at a time.  In a cell of two
    groups (side 0 and 1) only pairs across are compared; side 2 is a whole bucket.  A spanning forest of the links is
    returned: it joins what the links join, in rows that grow with the bucket and not with its square.
    """
    first = np.flatnonzero(np.r_[True, _bucket_starts(size)])
    place = np.arange(len(size)) - np.repeat(first, size[first])
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0
    for kind in np.unique(np.frexp(size[size > 1])[1]).tolist():
        rows = np.flatnonzero((size > 1) & (np.frexp(size)[1] == kind))
        own_place, own_size, own_side = place[rows], size[rows], side[rows]
        most = int(own_size.max())
        planes = _transpose(fps[rows])
        planes = np.concatenate([planes, np.zeros((len(planes), most // 64 + 2), np.uint64)], axis=1)
        waiting: list[tuple[int, np.ndarray, np.ndarray]] = []
        for d in range(1, most):
            live = np.flatnonzero(own_place + d < own_size)
            live = live[(own_side[live] == 2) | (own_side[live] != own_side[live + d])]
            if len(live):
                words = np.unique(live >> 6)
                waiting.append((d, words, planes[:, words] ^ _shifted(planes, words, d)))
            if waiting and (d == most - 1 or sum(len(w) for _, w, _ in waiting) >= WORDS):
                lane, distance = counted(np.concatenate([x for _, _, x in waiting], axis=1), radius)
                shift = np.repeat([s for s, _, _ in waiting], [len(w) for _, w, _ in waiting])[lane >> 6]
                i = np.concatenate([w for _, w, _ in waiting])[lane >> 6] * 64 + (lane & 63)
                waiting = []
                inside = np.flatnonzero(i < len(rows))
                inside = inside[own_place[i[inside]] + shift[inside] < own_size[i[inside]]]
                i, shift, distance = i[inside], shift[inside], distance[inside]
                across = (own_side[i] == 2) | (own_side[i] != own_side[i + shift])
                if across.any():
                    out.append((node[rows[i[across]]], node[rows[(i + shift)[across]]], distance[across]))
                    held += int(across.sum())
            if held > 1 << 19:
                out, held = [_thin(out)], 0
    return _thin(out) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))


def _bucket_starts(size: np.ndarray) -> np.ndarray:
    """For every row but the first whether a bucket begins there."""
    new, at = np.zeros(len(size), bool), 0
    while at < len(size):
        new[at] = True
        at += int(size[at])
    return new[1:]


def _shifted(planes: np.ndarray, words: np.ndarray, d: int) -> np.ndarray:
    """The given words of the planes as they are d lanes on."""
    at, bit = words + d // 64, np.uint64(d % 64)
    return planes[:, at] >> bit | planes[:, at + 1] << (np.uint64(64) - bit) if bit else planes[:, at]


def _thin(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b, c = (np.concatenate(x) for x in zip(*parts, strict=True))
    keep = _forest(a, b, c)
    return a[keep], b[keep], c[keep]


def links(nodes: DataFrame, radius: int, cell: int = CELL) -> DataFrame:
    """(a, b, distance): a spanning forest, bucket by bucket, of links between nodes at most radius bits apart.

    nodes: node long (distinct), fp binary (all of one width), keys array<long>.  Buckets over `cell`
    members are cut into groups; each pair of groups is a cell of its own, so a hot bucket is spread over many tasks and no pair is left out.
    """
    rows = nodes.select("node", "fp", F.explode(F.array_distinct("keys")).alias("key"))
    counts = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    group = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    placed = (
        rows.join(counts, "key")
        .withColumn("parts", F.ceil(F.col("n") / cell).cast("int"))
        .withColumn("g", group)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("key", F.least("g", "other").alias("x"), F.greatest("g", "other").alias("y"), F.when(F.col("g") == F.col("other"), 2).when(F.col("g") < F.col("other"), 0).otherwise(1).alias("side"), "node", "fp")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in _with_end(batches):
            if b is not None:
                t = pa.Table.from_batches([b])
                rest = t if rest is None else pa.concat_tables([rest, t])
                if rest.num_rows < 20_000:
                    continue
            if rest is None or not rest.num_rows:
                continue
            ids = [rest.column(c).to_numpy() for c in ("key", "x", "y")]
            edge = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in ids])) + 1
            last = rest.num_rows if b is None else int(edge[-1]) if len(edge) else 0
            if not last:
                continue
            starts = np.r_[0, edge[edge < last]]
            sizes = np.diff(np.r_[starts, last])
            now, rest = rest.slice(0, last), rest.slice(last)
            fps = np.frombuffer(b"".join(now.column("fp").to_pylist()), np.uint8).reshape(last, -1)
            got = bucket_links(now.column("node").to_numpy(), fps, np.repeat(sizes, sizes), now.column("side").to_numpy(), radius)
            yield pa.RecordBatch.from_arrays([pa.array(got[0], pa.int64()), pa.array(got[1], pa.int64()), pa.array(got[2].astype("i4"), pa.int32())], ["a", "b", "distance"])

    dealt = placed.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    return dealt.mapInArrow(run, "a long, b long, distance int")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def near_duplicates(df: DataFrame, k: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long, component): documents linked when their fingerprints differ in at most radius bits.

    component is the smallest id reachable over links, the row's own included.  Equal fingerprints are
    collapsed to one class before anything is compared, so thousands of copies cost one comparison.
    Null or blank texts have fingerprint 0 and link like others; rows with equal ids are kept each; a class of
    rows that all have a null id has a null component and links to nothing.  An empty table gives no rows.
    """
    fps = cut(fingerprints(df, k, id_col, text_col))
    classes = fps.groupBy("fp").agg(F.min("id").alias("node"))
    keyed = classes.where("node is not null").select("node", F.to_binary(F.lpad(F.hex("fp"), 16, "0"), F.lit("hex")).alias("fp"), block_keys(F.col("fp"), radius).alias("keys"))
    found = connected_components(links(keyed, radius))
    named = classes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    return fps.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component")


# -- near duplicates on word shingles -----------------------------------------------------------

#: Bands of minima; two texts of similarity 0.8 share one with a probability of 0.9998.
BANDS, ROWS = 16, 4
#: At a similarity of 0.8, fingerprints of 128 bits differ in 19.4 bits on average with a deviation of 4.1: four deviations on.
WIDE_RADIUS = 36
#: Words of a family that are compared in one group of cells, so that their shingle sets fit in memory.
FAMILY_WORDS = 1 << 21
_ODD = np.random.default_rng(7).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(words: list[bytes], k: int) -> tuple[bytes, list[int]]:
    """The 128-bit SimHash of a text's distinct k-word shingles and the keys of its bands of least hashes.

    Distinct, as the similarity that is confirmed is: repeats would draw the SimHashes of two texts of equal sets apart.
    """
    digests = b"".join(map(xxhash.xxh3_128_digest, set(shingle_list(words, k))))
    if not digests:
        return bytes(16), []
    low = np.frombuffer(digests, ">u8")[1::2].astype(np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(low), 1 << 12):
        least = np.minimum(least, (low[None, at : at + (1 << 12)] * _ODD[:, None]).min(axis=1))
    return majority(digests, 16), [xxhash.xxh64_intdigest(b.tobytes(), i) - (1 << 63) for i, b in enumerate(least.reshape(BANDS, ROWS))]


def shingle_set(words: list[bytes], k: int) -> bytes:
    """The distinct hashes of a text's shingles, ascending, as packed 64-bit integers."""
    return np.unique(np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, shingle_list(words, k))), np.uint64)).tobytes()


def exact_links(node: np.ndarray, sets: list[np.ndarray], side: np.ndarray, threshold: float) -> tuple[list[int], list[int]]:
    """Links (a, b) of one cell between sets with a Jaccard similarity of threshold or more: a spanning forest of all of them.

    side as in bucket_links.  Every pair is counted exactly unless confirmed links already join its ends, so a pair that is
    refuted never stands in the way of another.  One set at a time is marked in the cell's vocabulary and counted in many others at once.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    vocabulary, at = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.r_[0, np.cumsum(sizes)]
    mark = np.zeros(len(vocabulary), bool)
    part = np.arange(len(sets))
    right = np.flatnonzero(side == 1)
    a, b = [], []
    for i in np.flatnonzero((side != 1) & (sizes > 0)).tolist():
        todo = np.arange(i + 1, len(sets)) if side[i] == 2 else right
        todo = todo[(part[todo] != part[i]) & (np.minimum(sizes[todo], sizes[i]) >= threshold * np.maximum(sizes[todo], sizes[i]))]
        mark[at[start[i] : start[i + 1]]] = True
        step = 64
        while len(todo):
            now, todo = todo[:step], todo[step:]
            n = sizes[now]
            first = np.r_[0, np.cumsum(n)[:-1]]
            both = np.add.reduceat(mark[at[np.arange(n.sum()) + np.repeat(start[now] - first, n)]], first, dtype=np.int64)
            for j in now[both >= threshold * (sizes[i] + n - both)].tolist():
                if part[j] != part[i]:
                    part[part == part[j]] = part[i]
                    a.append(int(node[i]))
                    b.append(int(node[j]))
            todo = todo[part[todo] != part[i]]
            step = min(2 * step, CELL)
        mark[at[start[i] : start[i + 1]]] = False
    return a, b


def similar_groups(docs: DataFrame, k: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component): the documents of groups of two or more near duplicates; component is the group's smallest id.

    Near duplicates have a Jaccard similarity of threshold or more of their k-word shingles (A-Z lower-cased,
    words at ASCII white space).  A fingerprint of 64 bits within 2 would miss most of those, and blocks of its bits cannot find pairs that far apart,
    so here buckets are bands of least shingle hashes, which SimHashes of 128 bits are compared in (bit-sliced).  Many pairs within
    that radius are less similar than threshold, so what these links join is only a family: inside each family all pairs are held against
    their exact shingle sets, and only confirmed links make groups.  A family over CELL members or FAMILY_WORDS words is cut into a grid of
    cells like a hot bucket.  Texts of equal words are one class; texts without words are one too.  Rows that share an id are one
    document; rows with a null id are in no group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                words = [words_of(t.as_py()) for t in part.column(1)]
                found = [sketch(w, k) for w in words]
                same = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b" ".join(w)) for w in words), ">i8").astype("i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(same[:, 0]), pa.array(same[:, 1]), pa.array([f for f, _ in found], pa.binary()), pa.array([x for _, x in found], pa.list_(pa.int64())), pa.array([len(w) for w in words], pa.int64())], ["id", "c1", "c2", "fp", "keys", "n"])

    given = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    rows = cut(given.mapInArrow(run, "id long, c1 long, c2 long, fp binary, keys array<long>, n long"))
    classes = rows.groupBy("c1", "c2").agg(F.min("id").alias("node"), F.min_by(F.struct("fp", "keys", "n"), "id").alias("x"))
    family = cut(connected_components(links(classes.select("node", "x.fp", "x.keys"), WIDE_RADIUS)).join(classes.select("node", "x.n"), "node").groupBy("node", "component").agg(F.max("n").alias("n")))
    parts = family.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / CELL, F.sum("n") / FAMILY_WORDS)).cast("int").alias("parts"))
    group = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    ends = family.join(parts, "component").select(F.col("node").alias("id"), "component", "parts", group.alias("g"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([shingle_set(words_of(t.as_py()), k) for t in part.column(part.num_columns - 1)], pa.binary())], [*part.schema.names[:-1], "shingles"])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in _with_end(batches):
            if b is not None:
                t = pa.Table.from_batches([b])
                rest = t if rest is None else pa.concat_tables([rest, t])
            if rest is None or not rest.num_rows:
                continue
            ids = [rest.column(c).to_numpy() for c in ("component", "x", "y")]
            edge = [0, *(np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in ids])) + 1).tolist()]
            edge += [rest.num_rows] if b is None else []
            found: tuple[list[int], list[int]] = ([], [])
            for lo, hi in zip(edge, edge[1:], strict=False):
                if hi - lo > 1:
                    cell = rest.slice(lo, hi - lo)
                    packed = [np.frombuffer(x.as_py(), np.uint64) for x in cell.column("shingles")]
                    for out, got in zip(found, exact_links(cell.column("id").to_numpy(), packed, cell.column("side").to_numpy(), threshold), strict=True):
                        out += got
            rest = rest.slice(edge[-1])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "b"])

    known = given.join(ends.hint("shuffle_hash"), "id").select("id", "component", "parts", "g", "text").mapInArrow(sets, "id long, component long, parts int, g int, shingles binary")
    placed = known.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "component", F.least("g", "other").alias("x"), F.greatest("g", "other").alias("y"), F.when(F.col("g") == F.col("other"), 2).when(F.col("g") < F.col("other"), 0).otherwise(1).alias("side"), "id", "shingles"
    )
    dealt = placed.repartition("component", "x", "y").sortWithinPartitions("component", "x", "y")
    parts = connected_components(dealt.mapInArrow(confirm, "a long, b long"))
    named = classes.join(parts, "node", "left").select("c1", "c2", F.coalesce("component", "node").alias("component"))
    grouped = rows.select("id", "c1", "c2").distinct().join(named, ["c1", "c2"])
    others = grouped.where("id <> component")
    return others.select("id", "component").unionByName(others.select(F.col("component").alias("id"), "component").distinct()).withColumnRenamed("id", id_col)


def keep_one(docs: DataFrame, k: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with the document of smallest id of each group of near duplicates and all that are in none."""
    gone = similar_groups(docs, k, threshold, id_col, text_col).where(F.col(id_col) != F.col("component")).select(F.col(id_col).alias("_gone"))
    return docs.join(gone.hint("shuffle_hash"), docs[id_col].cast("bigint") == gone["_gone"], "left_anti")
