"""Byte-level BPE encoding and decoding by a rank file, in two tiers.

Tier one: a minimal perfect hash over the vocabulary resolves a whole pre-token with one probe and
one comparison.  Tier two, for misses: a heap of mergeable pairs over a linked list of bytes, so a
pre-token of n bytes takes O(n log n), however long.  Each worker keeps a bounded memo of resolved pre-tokens before both.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from struct import pack

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
#: Bounds of a worker's memo: entries in each of its two generations, and bytes of a pre-token that it may hold.
MEMO, MEMO_BYTES = 300_000, 48
ID_BITS = 24


class PerfectHash:
    """A minimal perfect hash by hash and displace: n keys in n slots, one small number for each bucket.

    Buckets of about four keys are placed largest first; each tries displacements until its keys
    fall into free slots.  A bucket of one key keeps its slot itself, as -slot - 1.
    """

    def __init__(self, keys: list[bytes]) -> None:
        self.n = len(keys)
        self.buckets = max(1, -(-self.n // 4))
        hashes = [xxhash.xxh64_intdigest(k) for k in keys]
        groups: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, h in enumerate(hashes):
            groups[h % self.buckets].append(i)
        self.displace = [0] * self.buckets
        self.key_at: list[int] = [-1] * self.n
        free = self.n
        for b in sorted(range(self.buckets), key=lambda b: -len(groups[b])):
            group = groups[b]
            if len(group) < 2:
                break
            d = 0
            while True:
                slots = {self._slot(hashes[i], d) for i in group}
                if len(slots) == len(group) and all(self.key_at[s] < 0 for s in slots):
                    break
                d += 1
            self.displace[b] = d
            for i in group:
                self.key_at[self._slot(hashes[i], d)] = i
            free -= len(group)
        holes = iter([s for s, k in enumerate(self.key_at) if k < 0])
        for b, group in enumerate(groups):
            if len(group) == 1:
                s = next(holes)
                self.displace[b], self.key_at[s] = -s - 1, group[0]

    def _slot(self, h: int, d: int) -> int:
        return ((h ^ (d * 0x9E3779B97F4A7C15 & MASK)) * 0xD6E8FEB86659FD93 & MASK) // (1 << 20) % self.n

    def find(self, key: bytes) -> int:
        """The number of the only key that `key` can be; the caller compares."""
        h = xxhash.xxh64_intdigest(key)
        d = self.displace[h % self.buckets]
        return self.key_at[-d - 1 if d < 0 else self._slot(h, d)]


class Codec:
    """Encodes and decodes by a vocabulary of byte strings with ranks; ids are the ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.words, self.ids = list(ranks), list(ranks.values())
        self.hash = PerfectHash(self.words)
        self.text = {i: w for w, i in ranks.items()}
        self.single = [ranks[bytes([i])] for i in range(256)]
        self.pairs: dict[int, int] = {}
        for word, i in ranks.items():
            for cut in range(1, len(word)):
                left, right = ranks.get(word[:cut]), ranks.get(word[cut:])
                if left is not None and right is not None:
                    self.pairs[left << ID_BITS | right] = i
        self.split = regex.compile(pattern).findall
        self.memo = _Memo(self)

    def whole(self, word: bytes) -> int | None:
        """Tier one: the id of a whole pre-token, or None if it is not in the vocabulary."""
        k = self.hash.find(word)
        return self.ids[k] if self.words[k] == word else None

    def merge(self, word: bytes) -> list[int]:
        """Tier two: repeated merging of the adjacent pair of least rank, leftmost first."""
        get, ids = self.pairs.get, [self.single[c] for c in word]
        n = len(ids)
        heap = [(m, i) for i in range(n - 1) if (m := get(ids[i] << ID_BITS | ids[i + 1])) is not None]
        if not heap:
            return ids
        heapify(heap)
        following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            m, i = heappop(heap)
            if ids[i] < 0 or (j := following[i]) >= n or get(ids[i] << ID_BITS | ids[j]) != m:
                continue  # one of the pair has been merged since
            ids[i], ids[j] = m, -1
            following[i] = k = following[j]
            if k < n:
                previous[k] = i
                if (q := get(m << ID_BITS | ids[k])) is not None:
                    heappush(heap, (q, i))
            if (h := previous[i]) >= 0 and (q := get(ids[h] << ID_BITS | m)) is not None:
                heappush(heap, (q, h))
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.text.__getitem__, memoryview(ids).cast("I")))


class _Memo(dict):
    """Resolved pre-tokens; a full memo becomes the older generation, from which those that come again are taken over."""

    def __init__(self, codec: Codec) -> None:
        super().__init__()
        self.codec = codec
        self.older: dict[str, bytes] = {}

    def __missing__(self, token: str) -> bytes:
        if (got := self.older.get(token)) is None:
            word = token.encode("utf-8", "surrogatepass")
            one = self.codec.whole(word)
            ids = [one] if one is not None else self.codec.merge(word)
            got = pack(f"<{len(ids)}I", *ids)
            if len(word) > MEMO_BYTES:
                return got
        if len(self) >= MEMO:
            self.older = dict(self)
            self.clear()
        self[token] = got
        return got


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(maxsize=2)
def codec_of(path: str, pattern: str) -> Codec:
    """Built once in each worker process; path is a vocabulary file that is installed on every machine."""
    return Codec(read_ranks(path), pattern)


def encode_documents(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, ids) of every whole text; ids are packed u32, little-endian.

    The decoded digest is of the bytes that the ids decode to.  A null text counts as empty: no
    tokens.  Repeated rows each get a row, other columns are ignored, an empty table gives none.  The
    plan is one narrow stage: no shuffle, and a lost task is simply run again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path, pattern)
        for b in batches:
            for part in _slices(b):
                n, first, second, kept = [], [], [], []
                for t in part.column(1):
                    ids = codec.encode(t.as_py() or "")
                    n.append(len(ids) // 4)
                    first.append(hashlib.sha256(ids).hexdigest())
                    second.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                    if keep_ids:
                        kept.append(ids)
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(first), pa.array(second)]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * keep_ids, names[: 4 + keep_ids])

    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    schema = "`{}` long, n_tokens long, ids_sha256 string, decoded_sha256 string".format(id_col) + ", ids binary" * keep_ids
    return df.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def _slices(b: pa.RecordBatch, most: int = 256) -> Iterator[pa.RecordBatch]:
    """Pieces of few rows, so that what is held beside a batch stays small."""
    for at in range(0, b.num_rows, most):
        yield b.slice(at, most)
