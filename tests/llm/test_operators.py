"""The corpus operators against brute force, on small tables with awkward rows."""

import collections
import hashlib
import itertools
import math
import os
import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from veil.llm import bpe, decontaminate, hamming, language_id, line_dedup, quality, sharding, simhash, suffix_dedup, token_store, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot string, fp string, h long, spans string, score string"


def table(spark, rows):
    """documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", 1, "z", "w") for i, t in rows], SCHEMA)


AWKWARD = [(0, None), (1, ""), (2, " \n\t "), (3, "a b c"), (4, "a b c"), (4, "a b c"), (None, "null id here"), (5, "x " * 30000), (6, "😀 é\n\n\ná"), (7, "one line\ntwo line\none line\ntwo line")]


@pytest.fixture(scope="module")
def awkward(spark):
    return table(spark, AWKWARD).coalesce(2).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def words(rng, n):
    return " ".join(rng.choice(["the", "cat", "Sat", "on", "mat", "dog", "ran", "far", "é", "x1", "tree", "sun", "sky", "red"]) + rng.choice(["", "", str(rng.randint(0, 60))]) for _ in range(n))


# -- sharding -----------------------------------------------------------------------------------


def jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding(spark, awkward, empty):
    ids = [0, 1, 2, -1, 2**63 - 1, -(2**63), *range(100, 400)]
    rows = sharding.shard(table(spark, [(i, f"t{i}") for i in ids]), 24).collect()
    assert {r.doc_id: (r.shard, r.grown_shard) for r in rows} == {i: (jump(i, 24), jump(i, 25)) for i in ids}
    assert all(r.grown_shard in (r.shard, 24) for r in rows)
    rows = sharding.shard(awkward, 3).collect()
    assert len(rows) == len(AWKWARD)
    for s in range(3):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    want = collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in AWKWARD)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want and {r.law for r in rows} == {"key"}
    assert sharding.shard(empty, 24).count() == 0


def test_sharding_stays_native(awkward):
    assert not any(x in sharding.shard(awkward, 24)._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Arrow", "Pandas"))


# -- BPE ----------------------------------------------------------------------------------------


def test_perfect_hash():
    keys = [bytes([i, j]) for i in range(60) for j in range(50)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.key_at) == list(range(len(keys))) and all(h.find(k) == i for i, k in enumerate(keys))


def test_bpe(spark, awkward, empty, monkeypatch):
    path = P.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rng = random.Random(1)
    texts = [(i, "".join(rng.choices(list("ab'st é日😀.,!?  \n\t0123_") + ["the", "ing", "'ll", "<|endoftext|>", "  "], k=rng.randint(0, 60)))) for i in range(300)] + [(1000, "y" * 20000)]
    got = {r.doc_id: r for r in bpe.encode_documents(table(spark, texts), path, P.PATTERN).collect()}
    for i, t in texts:
        ids = library.encode_ordinary(t)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        assert (bytes(got[i].ids), got[i].n_tokens) == (packed, len(ids))
        assert got[i].ids_sha256 == hashlib.sha256(packed).hexdigest() and got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    monkeypatch.setattr(bpe, "MEMO", 40)  # so that pre-tokens move from generation to generation
    codec = bpe.Codec(bpe.read_ranks(path), P.PATTERN)
    assert all(codec.encode(t) == bytes(got[i].ids) for i, t in texts)
    rows = bpe.encode_documents(awkward, path, P.PATTERN, keep_ids=False).collect()
    assert len(rows) == len(AWKWARD) and all(r.n_tokens == 0 for r in rows if r.doc_id in (0, 1))
    assert bpe.encode_documents(empty, path, P.PATTERN).count() == 0


# -- decontamination ----------------------------------------------------------------------------


def test_decontamination(spark, awkward, empty):
    rng = random.Random(2)
    items = [(i, words(rng, rng.choice([3, 14, 20, 40, 60]))) for i in range(25)] + [(90, None), (91, "")]
    rows = []
    for i in range(150):
        before, after = words(rng, rng.randint(0, 40)), words(rng, rng.randint(0, 40))
        passage = rng.choice(items[:25])[1].split() if rng.random() < 0.5 else []
        for _ in range(rng.choice([0, 0, 1, 2, 5]) if passage else 0):
            passage[rng.randrange(len(passage))] = f"new{rng.randint(0, 99)}"
        rows.append((i, " ".join([before, " ".join(passage).upper() + ".", after])))
    benchmark = spark.createDataFrame(items, "item_id long, text string")

    def similarity(a, b):
        k = min(5, len(b))
        x, y = (collections.Counter(zip(*(w[j:] for j in range(k)), strict=False)) for w in (a, b))
        shared = sum((x & y).values())
        return shared / (x.total() + y.total() - shared) if x.total() else 0

    want = {}
    for d, t in rows:
        w = decontaminate.words_of(t)
        for i, text in items:
            v = decontaminate.words_of(text)
            if v:
                n = min(len(v), len(w))
                best = max((similarity(w[p : p + n], v) for p in range(len(w) - n + 1)), default=0)
                if best >= 0.8:
                    want[d, i] = best
    docs = table(spark, rows)
    for chars in (10**6, 700):
        got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(docs, benchmark, chars=chars).collect()}
        assert got == pytest.approx(want)
    assert len({d for d, _ in want}) > 20
    kept = decontaminate.clean(docs, benchmark, chars=700)
    assert {r.doc_id for r in kept.collect()} == set(range(150)) - {d for d, _ in want} and kept.columns == docs.columns
    assert decontaminate.clean(awkward, benchmark).count() == len(AWKWARD) and decontaminate.leaks(empty, benchmark).count() == 0
    none = benchmark.limit(0)
    assert decontaminate.leaks(docs, none).count() == 0 and decontaminate.clean(docs, none).count() == 150


# -- suffixes -----------------------------------------------------------------------------------


def without_repeats(rows, n):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(t[p : p + n] for _, t in texts for p in range(len(t) - n + 1))
    out = []
    for i, t in texts:
        cut = [False] * len(t)
        for p in range(len(t) - n + 1):
            if seen[t[p : p + n]] > 1:
                cut[p : p + n] = [True] * n
        out.append((i, len(t), sum(cut), sum(c and (k == 0 or not cut[k - 1]) for k, c in enumerate(cut)), bytes(b for b, c in zip(t, cut, strict=True) if not c)))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


@pytest.mark.parametrize("seed", range(4))
def test_suffix_dedup(spark, monkeypatch, seed):
    rng = random.Random(seed)
    n, alphabet = rng.choice([(8, "ab"), (20, "abcdefgh"), (50, " é日a")])
    monkeypatch.setattr(suffix_dedup, "BATCH", rng.choice([3, 40]))
    monkeypatch.setattr(suffix_dedup, "PIECE", rng.choice([64, 1 << 20]))
    monkeypatch.setattr(suffix_dedup, "HOT", (2, 7, 4000)[seed % 3])
    base = ["".join(rng.choices(alphabet, k=rng.randint(0, 150))) for _ in range(20)]
    rows = [(i, "".join(x[(a := rng.randint(0, len(x))) : a + rng.randint(0, 90)] for x in rng.choices(base, k=rng.randint(0, 3))) + "a" * rng.choice([0, 0, 50])) for i in range(90)]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(table(spark, rows), n).collect()), key=key)
    assert got == sorted(without_repeats(rows, n), key=key)


def test_suffix_dedup_edges(awkward, empty):
    rows = [r for r in AWKWARD if r[0] != 5]
    got = suffix_dedup.remove_repeats(awkward.where("doc_id is null or doc_id <> 5"), 5).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=key) == sorted(without_repeats(rows, 5), key=key)
    long = suffix_dedup.remove_repeats(awkward.where("doc_id = 5"), 200).first()
    assert (long.n_removed, long.n_spans) == (60000, 1)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_rows_that_share_an_id_are_their_own(spark):
    rng = random.Random(18)
    shared = "".join(rng.choices("abcdefgh", k=250))
    noise = lambda n: "".join(rng.choices("abcdefghijklmnop", k=n))
    rows = [(None, noise(300) + shared), (None, noise(900)), (None, noise(400)), (7, shared + noise(40)), (7, noise(700)), (8, noise(250)), (8, None), (-(2**63), noise(450) + shared)]
    rows += [(9, rows[5][1]), (5, noise(300))]
    rows += [rows[-1]]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(table(spark, rows)).collect()), key=key)
    want = sorted(without_repeats(rows, 200), key=key)
    assert got == want and sum(r[2] > 0 for r in want) == 7


def test_one_head_before_many_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 30)
    rng = random.Random(19)
    head = "".join(rng.choices("abcdefgh ", k=300))
    rows = [(i, head[rng.randrange(60) :] + "".join(rng.choices("abcdefghijklm", k=rng.randint(0, 200)))) for i in range(120)]
    rows += [(200 + i, head[i:] + rows[i][1][-50:]) for i in range(20)]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(table(spark, rows)).collect()), key=key)
    assert got == sorted(without_repeats(rows, 200), key=key)


def test_sorter_survives_collisions(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_BYTE", np.ones(256, np.uint64))  # now all strings of a length collide
    s = suffix_dedup.SuffixSorter(b"abcdabcdabce", 4)
    assert s.repeated(np.array([0, 4, 8]), np.zeros(3, np.int64)).tolist() == [True, True, False]


# -- SimHash ------------------------------------------------------------------------------------


def test_close_lanes():
    rng = np.random.default_rng(3)
    for width in (8, 16):
        a = rng.integers(0, 256, (1000, width), dtype=np.uint8)
        b = a.copy()
        for i in range(1000):
            for bit in rng.integers(0, width * 8, i % 7):
                b[i, bit // 8] ^= 1 << (bit % 8)
        b[::3] = rng.integers(0, 256, b[::3].shape, dtype=np.uint8)
        d = np.bitwise_count(a ^ b).sum(axis=1)
        for radius in (0, 2, 3, 36):
            lane, distance = simhash.close_lanes(a, b, radius)
            assert sorted(zip(lane.tolist(), distance.tolist(), strict=True)) == [(i, x) for i, x in enumerate(d.tolist()) if x <= radius]


def test_bucket_links(monkeypatch):
    monkeypatch.setattr(simhash, "WORDS", 3)
    rng = np.random.default_rng(20)
    for _ in range(20):
        sizes = rng.choice([1, 2, 3, 5, 40, 150], 12).tolist()
        n = sum(sizes)
        fps = rng.integers(0, 256, (8, 8), dtype=np.uint8)[rng.integers(0, 8, n)]
        fps[np.arange(n), rng.integers(0, 8, n)] ^= np.uint8(1) << rng.integers(0, 8, n, dtype=np.uint8)
        side = np.concatenate([rng.integers(0, 2, k) if rng.random() < 0.4 else np.full(k, 2) for k in sizes])
        a, b, distance = simhash.bucket_links(np.arange(n), fps, np.repeat(sizes, sizes), side, 2)
        assert [int(np.bitwise_count(fps[x] ^ fps[y]).sum()) for x, y in zip(a, b, strict=True)] == distance.tolist()
        want, at = [], 0
        for k in sizes:
            want += [(i, j) for i, j in itertools.combinations(range(at, at + k), 2) if (side[i] == 2 or side[i] != side[j]) and np.bitwise_count(fps[i] ^ fps[j]).sum() <= 2]
            at += k
        parts = []
        for pairs in (zip(a.tolist(), b.tolist(), strict=True), want):
            root = list(range(n))
            for x, y in pairs:
                low, high = sorted((root[x], root[y]))
                root = [low if r == high else r for r in root]
            parts.append(root)
        assert parts[0] == parts[1]


def test_simhash(spark, awkward, empty, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 4)
    rng = random.Random(4)
    base = [words(rng, 40).split() for _ in range(25)]
    rows = []
    for i in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            w[rng.randrange(len(w))] = "Edited"
        rows.append((i, " ".join(w)))
    rows += [r for r in AWKWARD if r[0] is not None and r[0] != 5]
    rows = [(1000 + i if k >= 160 else i, t) for k, (i, t) in enumerate(rows)]

    def fingerprint(t):
        w = (t or "").encode().lower().split()
        hs = [xxhash.xxh64_intdigest(b" ".join(x), 42) for x in (zip(w, w[1:], w[2:], strict=False) if len(w) >= 3 else [w] if w else [])]
        return sum((sum(h >> b & 1 for h in hs) * 2 > len(hs)) << b for b in range(64))

    fps = [(i, fingerprint(t)) for i, t in rows]
    parent = {i: i for i, _ in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, x), (j, y) in itertools.combinations(fps, 2):
        if (x ^ y).bit_count() <= 2 and root(i) != root(j):
            parent[max(root(i), root(j))] = min(root(i), root(j))
    got = sorted((r.doc_id, r.fp % 2**64, r.component) for r in simhash.near_duplicates(table(spark, rows)).collect())
    assert got == sorted((i, x, root(i)) for i, x in fps)
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == len(AWKWARD) and {r.component for r in rows if r.doc_id in (0, 1, 2)} == {0}
    assert simhash.near_duplicates(empty).count() == 0


def test_one_of_each_group(spark, awkward, empty):
    rng = random.Random(6)
    rows, group = [], {}
    for g in range(12):
        w = words(rng, 120).split()
        for _ in range(rng.randint(1, 4)):
            i = len(rows)
            mine = list(w)
            if i % 2:
                mine[rng.randrange(len(mine))] = "Edited"
            rows.append((i, " ".join(mine)))
            group[i] = g
    docs = table(spark, rows)
    kept = simhash.keep_one(docs)
    first = {g: min(i for i in group if group[i] == g) for g in set(group.values())}
    assert {r.doc_id for r in kept.collect()} == set(first.values()) and kept.columns == docs.columns
    assert collections.Counter(r.doc_id for r in simhash.keep_one(awkward).collect()) == collections.Counter([0, 3, None, 5, 6, 7])
    assert simhash.keep_one(empty).count() == 0


def jaccard_groups(rows, k=5, threshold=0.8):
    """The smallest id of each row's group, by all pairs."""
    sets = []
    for _, t in rows:
        w = t.lower().split()
        sets.append(set(zip(*(w[j:] for j in range(k)), strict=False)))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
            parent[max(root(i), root(j))] = min(root(i), root(j))
    return {rows[i][0]: rows[root(i)][0] for i in range(len(rows))}


@pytest.mark.parametrize("cell", [4096, 100])
def test_large_group_of_near_duplicates(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 500):
        w = rows[i - 1][1].split() if i % 9 == 0 else list(base)  # some of them edits of edits
        for at in rng.sample(range(len(w)), 3):
            w[at] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    want = {i for i, g in jaccard_groups(rows).items() if i == g}
    assert {r.doc_id for r in simhash.keep_one(table(spark, rows)).collect()} == want


def test_near_duplicates_of_the_tables(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables here")
    docs = spark.read.parquet(path).select("doc_id", "text")
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    first = {}
    for i, t in rows:  # copies by their words, as texts of under five words have no five-word shingles
        first.setdefault(tuple(t.lower().split()), i)
    groups = jaccard_groups([(i, " ".join(w)) for w, i in first.items() if len(w) >= 5])
    want = {i for w, i in first.items() if len(w) < 5 or groups[i] == i}
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    lost, found = kept - want, {i for i, _ in rows} - kept
    print(f"recall {len(found) / (len(found) + len(lost)):.4f}")
    assert want <= kept and len(found) >= 0.99 * (len(found) + len(lost))


def test_near_duplicates_by_repeated_phrases(spark):
    rng = random.Random(12)
    rows = []
    for g in range(50):
        w, phrase = ([f"w{rng.randrange(10**6)}" for _ in range(n)] for n in (200, 10))
        rows += [(2 * g, " ".join(w + phrase)), (2 * g + 1, " ".join(w + phrase * 20))]
    want = {i for i, g in jaccard_groups(rows).items() if i == g}
    assert {r.doc_id for r in simhash.keep_one(table(spark, rows)).collect()} == want == set(range(0, 100, 2))


# -- search -------------------------------------------------------------------------------------


def test_multi_index():
    rng = np.random.default_rng(5)
    codes = np.unique(rng.integers(0, 2**63, 3000, dtype=np.uint64) & np.uint64(0xFF0FF0FF00FF0FF0))
    for m in (None, 3, 4, 8):
        index = hamming.MultiIndex(codes, m)
        asked = np.array([*codes[:5].tolist(), 0, 2**64 - 1], np.uint64)
        d = np.bitwise_count(codes[None, :] ^ asked[:, None]).astype(int)
        for radius in (0, 3, 6, 19):
            which, at, distance = index.within(asked, radius)
            assert sorted(zip(which.tolist(), at.tolist(), strict=True)) == [(i, j) for i, j in zip(*(x.tolist() for x in np.nonzero(d <= radius)), strict=True)]
            assert (d[which, at] == distance).all()
        for i, code in enumerate(asked.tolist()):
            for k, bound in ((10, 64), (10, 5), (1, 0), (5000, 64)):
                at, distance = index.nearest(code, k, bound)
                kth = min(bound, np.sort(d[i])[min(k, len(codes)) - 1])
                assert sorted(at.tolist()) == np.flatnonzero(d[i] <= kth).tolist() and (np.diff(distance) >= 0).all()
    none = hamming.MultiIndex(np.empty(0, np.uint64))
    assert len(none.nearest(5, 3)[0]) == len(none.within(np.array([5], np.uint64), 3)[0]) == 0


def test_blocks_filter():
    """The index compares the few codes that its blocks list, never all of them."""
    rng = np.random.default_rng(16)
    codes = rng.integers(0, 2**63, 20_000, dtype=np.uint64)
    index = hamming.MultiIndex(codes, decontaminate.SEGMENTS)
    index.within(codes[:50], decontaminate.RADIUS)
    assert index.compared < 0.3 * 50 * len(codes)
    index = hamming.MultiIndex(codes)
    near = codes[:50] ^ np.uint64(0b1001)
    for code in near.tolist():
        index.nearest(code, 1)
    assert index.compared < 0.02 * 50 * len(codes)


def test_decontamination_recall():
    """Of windows of a similarity of 0.8 or more, by their shingles alone, the fingerprints' radius keeps nearly all."""
    rng = random.Random(17)
    kept = []
    for n in (8, 14, 25, 40, 80, 160):
        for _ in range(400):
            item = [f"w{rng.randrange(10**5)}" for _ in range(n)]
            other = list(item)
            for _ in range(rng.randint(0, 1 + n // 25)):
                other[rng.choice([0, n - 1, rng.randrange(n)])] = "new"
            if rng.random() < 0.5:
                shift = rng.randint(0, n // 10)
                other = other[shift:] + [f"x{j}" for j in range(shift)]
            a, b = (collections.Counter(zip(*(w[j:] for j in range(5)), strict=False)) for w in (item, other))
            shared = sum((a & b).values())
            if shared / (a.total() + b.total() - shared) >= 0.8:
                kept.append(bool(decontaminate.Benchmark([(0, " ".join(item))]).matches(" ".join(other))))
    assert len(kept) > 1000 and np.mean(kept) >= 0.999


@pytest.mark.parametrize("classes", [40, 1000])
def test_topk(spark, monkeypatch, classes):
    monkeypatch.setattr(topk, "CLASSES", classes)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(300)]
    rows += [(i, rows[i % 3][1]) for i in range(300, 340)] + [(400, None), (None, rows[0][1]), (450, []), (500, [1.0, None, -1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, rank string")
    code = lambda v: sum(((v[b] or 0) > 0) << b for b in range(len(v)))
    known = {i: code(v) for i, v in rows if i is not None and v is not None}
    want = sorted((q, r + 1, i, d) for q in known if q % 50 == 0 for r, (d, i) in enumerate(sorted(((known[q] ^ c).bit_count(), i) for i, c in known.items())[:10]))
    assert sorted(tuple(r) for r in topk.search(df).collect()) == want
    assert topk.search(df.limit(0)).count() == 0


# -- quality ------------------------------------------------------------------------------------


def test_quality(spark, awkward, empty):
    rng = random.Random(7)
    rows = [(i, words(rng, 60) if i % 3 else " | ".join(words(rng, 1) + "###" for _ in range(60))) for i in range(400)]
    docs = table(spark, rows).withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 3))
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 400, 2)] + [(None, 1), (7, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = quality.score(docs, model, "source", "concat_ws('/', source, lang)").collect()
    assert all(r.keep == (r.doc_id % 3 > 0) for r in got) and all(0 < r.path_quality < 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[0].host_quality < 0.2 < 0.8 < by[1].host_quality
    assert len(quality.score(awkward, model, "source", "lang").collect()) == len(AWKWARD)
    assert quality.score(empty, model, "source", "lang").count() == 0
    blank = quality.train(empty, labels)
    assert quality.score(awkward, blank, "null", "null").count() == len(AWKWARD)


def logit(p):
    return math.log(p / (1 - p))


def test_posteriors_by_hand(spark):
    rng = random.Random(15)
    rows = [(i, words(rng, 30) if rng.random() < 0.6 else "### | | " * rng.randint(1, 20), f"h{i % 7 % 4}", f"p{rng.randint(0, 5)}") for i in range(300)] + [(900, None, None, "p0"), (901, " ", "h0", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    model = quality.train(docs, spark.createDataFrame([(i, int("#" not in t)) for i, t, _, _ in rows[:300]], "doc_id long, quality int"))
    evidence = model.ratio([t for _, t, _, _ in rows]).tolist()
    assert evidence[-2:] == [0, 0] and np.mean([(e > 0) == ("#" not in t) for e, (_, t, _, _) in zip(evidence, rows[:300], strict=False)]) > 0.95
    p = [1 / (1 + math.exp(-(e + logit(model.prior)))) for e in evidence]
    hosts, paths = collections.defaultdict(list), collections.defaultdict(list)
    for (_, _, h, q), x in zip(rows, p, strict=True):
        hosts[h or ""].append(x)
        paths[h or "", q or ""].append(x)
    mean = sum(p) / len(p)

    def weight(groups, toward):
        spread = sum(len(g) * (sum(g) / len(g) - toward(k)) ** 2 for k, g in groups.items())
        noise = mean * (1 - mean)
        between = (spread - len(groups) * noise) / len(p)
        return min(max(noise / between - 1, 1), 1e6) if between > 0 else 1e6

    hw = weight(hosts, lambda _: mean)
    above = lambda k: (sum(hosts[k[0]]) + hw * mean) / (len(hosts[k[0]]) + hw)
    pw = weight(paths, above)
    got = {r.doc_id: r for r in quality.score(docs, model, "host", "path").collect()}
    for (i, _, h, q), e, x in zip(rows, evidence, p, strict=True):
        h, q = h or "", q or ""
        host = (sum(hosts[h]) - x + hw * mean) / (len(hosts[h]) - 1 + hw)
        path = (sum(paths[h, q]) - x + pw * host) / (len(paths[h, q]) - 1 + pw)
        want = (e, host, path, 1 / (1 + math.exp(-(e + logit(path)))))
        assert (got[i].evidence, got[i].host_quality, got[i].path_quality, got[i].quality) == pytest.approx(want, rel=1e-6, abs=1e-9)


# -- token store --------------------------------------------------------------------------------


def test_huffman():
    rng = np.random.default_rng(8)
    for counts in ([], [5], [1, 1], [2**i for i in range(30)], rng.zipf(1.2, 3000).clip(0, 10**9).tolist()):
        c = np.array(counts, np.int64)
        lengths = token_store.code_lengths(c)
        assert lengths.max(initial=0) <= token_store.LIMIT and (len(c) < 2 or sum(0.5 ** lengths[c > 0].astype(float)) == 1)
        ids = rng.choice(np.flatnonzero(c), 5000).astype(np.uint32) if len(c) else np.empty(0, np.uint32)
        offsets, payload = token_store.pack_bits(ids, lengths, token_store.canonical(lengths))
        assert (token_store.unpack_bits(payload, offsets, len(ids), token_store.decoding_table(lengths)) == ids).all()


def test_token_store(spark, awkward, empty, monkeypatch):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = token_store.store_documents(awkward, path).collect()
    start = 0
    ordered = sorted(AWKWARD, key=lambda r: (r[0] is not None, r[0] or 0))
    for r, (i, t) in zip(sorted(rows, key=lambda r: r.start), ordered, strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    assert token_store.store_documents(empty, path).count() == 0


def test_a_store_is_read_by_itself(spark, tmp_path):
    from tokenizers import Tokenizer

    path, out = P.path("word_bpe_49k.json"), str(tmp_path / "store")
    rows = [(i % 50, f"Text {i % 7} of {i}, " * (i % 9)) for i in range(300)] + [(7, None)]
    token_store.write_store(table(spark, rows), path, 2, out)
    library = Tokenizer.from_file(path)
    want = collections.Counter((i, tuple([*library.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in rows)
    got = token_store.read_store(spark.newSession(), out, keep_ids=True).collect()
    assert collections.Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted(i for i, _ in rows)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_word_encoder(name, monkeypatch):
    monkeypatch.setattr(token_store, "MEMO", 500)  # so that words move from generation to generation
    from tokenizers import Tokenizer

    path = P.path(name)
    library, own = Tokenizer.from_file(path), token_store.WordEncoder(path)
    assert own.words == (name == "word_bpe_49k.json")
    rng = random.Random(9)
    stock = list("ab'sté ÉÀ,.;\n\t\x1c\x85\xa0İΣσß1２·日😀-_$<{~/") + ["<|endoftext|>", "'ll", "\u0301", "The", "Öl!", "x."]
    texts = ["".join(rng.choices(stock, k=rng.randint(0, 25))) for _ in range(3000)]
    half = 1500
    coded = [own.encode(x) for x in (pa.array(texts).slice(3, half), pa.array(texts).slice(3 + half))]
    ids, n = (np.concatenate(x) for x in zip(*coded, strict=True))
    at = 0
    for t, size in zip(texts[3:], n.tolist(), strict=True):
        assert ids[at : at + size].tolist() == library.encode(t, add_special_tokens=False).ids
        at += size
    assert [len(x) for x in own.encode(pa.array([], pa.string()))] == [0, 0]


# -- lines --------------------------------------------------------------------------------------


def without_later_passages(rows, w):
    seen, out = set(), []
    for i, t in sorted(rows):
        lines = t.split("\n")
        full = [k for k, x in enumerate(lines) if x.strip()]
        cut = set()
        for p in range(len(full)):
            for n in {1, w}:
                gram = tuple(lines[k] for k in full[p : p + n])
                if len(gram) == n and (n == w or len(gram[0].split()) >= 20 or len(gram[0]) >= 100):
                    if gram in seen:
                        cut.update(range(p, p + n))
                    seen.add(gram)
        gone = {full[p] for p in cut} | {k for p in cut if p + 1 in cut for k in range(full[p], full[p + 1])}
        out.append((i, len(lines) if t else 0, len(gone), sum(p - 1 not in cut for p in cut), "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return out


def some_lines(rng):
    stock = ["a", "b", "c d", "", " ", "\t", "e", "f", "g", "h", "字" * 100, "字" * 99, *(" ".join(f"w{rng.randrange(99)}" for _ in range(n)) for n in (19, 20, 60, 60))]
    rows = [(i, "\n".join(rng.choice(stock) for _ in range(rng.randint(0, 12)))) for i in range(80)]
    return [*rows, (100, stock[-1]), (101, stock[-1]), (102, f"x\n\n{stock[-2]}\n\n{stock[-1]}\n\ny"), *((i, "one paragraph\n\nanother\n\n") for i in (103, 104, 105))]


@pytest.mark.parametrize("window", [1, 2, 3])
def test_line_dedup(spark, window):
    rows = some_lines(random.Random(window))
    got = line_dedup.dedup_lines(table(spark, rows), window=window)
    assert sorted((r.doc_id, r.n_lines, r.n_removed, r.n_runs, r.text) for r in got.collect()) == without_later_passages(rows, window)
    assert not any(x in got._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Arrow", "Pandas"))


def test_line_dedup_as_sql(spark, tmp_path):
    import duckdb

    rows = [*some_lines(random.Random(13)), (200, None), (201, "")]
    docs = table(spark, rows)
    docs.write.parquet(str(tmp_path / "d"))
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    got = line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.col("text").cast("binary"), 256))
    assert sorted(map(tuple, got.collect())) == sorted(duckdb.sql(line_dedup.SQL).fetchall())


def test_line_dedup_edges(awkward, empty):
    found = line_dedup.dedup_lines(awkward)
    rows = found.collect()
    assert len(rows) == len(AWKWARD) and found.columns == [*awkward.columns, "n_lines", "n_removed", "n_runs"]
    by = {r.doc_id: r for r in rows}
    assert by[0].text is None and by[0].n_lines == 0 and by[7].text == "one line\ntwo line" and by[6].text == "😀 é\n\n\ná"
    assert line_dedup.dedup_lines(empty).count() == 0


# -- columns of other names ---------------------------------------------------------------------

CLASHING = ["_hash", "_key", "_runs", "_id", "_th", "_text_", "_text", "_gone", "id", "th", "runs", "n_lines", "lang_pred", "score", "h", "x", "component", "_name", "spans", "_spans", "raw", "todo"]


@pytest.fixture(scope="module")
def clashing(awkward):
    return awkward.select("doc_id", "text", "lang", "source", "n_chars", *(F.lit(c).alias(c) for c in CLASHING))


@pytest.mark.parametrize("name", ["language_id", "line_dedup", "near_dedup", "decontamination"])
def test_stages_leave_other_columns_alone(spark, clashing, tmp_path, name):
    import corpus_pipeline

    spark.createDataFrame([(0, "one two three four five six")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = dict(corpus_pipeline.STAGES)[name](spark, clashing, str(tmp_path))
    assert out.columns == clashing.columns
    rows = out.collect()
    assert rows and all(r[c] == c for r in rows for c in CLASHING)


def test_operators_pass_over_other_columns(spark, clashing):
    n = len(AWKWARD)
    model = quality.train(clashing, spark.createDataFrame([(3, 1)], "doc_id long, quality int"))
    assert sharding.shard(clashing, 3).count() == quality.score(clashing, model, "source", "lang").count() == simhash.near_duplicates(clashing).count() == n
    assert suffix_dedup.remove_repeats(clashing).count() == bpe.encode_documents(clashing, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == n
    assert token_store.store_documents(clashing, P.path("word_bpe_49k.json")).count() == line_dedup.dedup_lines(clashing).count() == n
    found = language_id.identify(clashing, language_id.train(clashing))
    assert found.count() == n and found.columns.count("score") == 1


# -- languages ----------------------------------------------------------------------------------


def test_language_id(spark, awkward, empty):
    rng = random.Random(10)
    stock = {"en": "the and of with shing tion was".split(), "de": "der und schön über keit für".split(), "fr": "le été que eaux dans ê".split()}
    rows = []
    for i in range(300):
        lang = rng.choice(list(stock))
        rows.append((i, " ".join(rng.choice(stock[lang]) + rng.choice(["", "a", "e"]) for _ in range(rng.randint(2, 40))), lang))
    docs = spark.createDataFrame([*rows, (900, None, "en"), (901, "text", None)], "doc_id long, text string, lang string")
    model = language_id.train(docs, per_language=40)
    assert model.languages == ["de", "en", "fr"] and model.centroids.shape[1] <= 12
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].lang_pred == got[i].lang for i in held]) > 0.95
    assert (got[900].lang_pred, got[900].score) == ("und", 0) and got[901].lang_pred in stock
    rows = language_id.identify(awkward, model, keep=["doc_id"]).collect()
    assert len(rows) == len(AWKWARD) and {r.doc_id for r in rows if r.lang_pred == "und"} == {0, 1, 2}
    kept = language_id.identify(awkward, model, reject=True, drop_rejected=True)
    assert not {r.doc_id for r in kept.collect()} & {0, 1, 2}
    assert language_id.identify(empty, model).count() == 0
    none = language_id.train(empty)
    assert {r.lang_pred for r in language_id.identify(awkward, none).collect()} == {"und"}


def test_language_vectors_by_hand(spark):
    texts = {1: "Der Hund, der Hund!", 2: "the dog\nthe cat", 3: "le chien é", 4: "dog 12 hund", 6: "日本 x"}
    docs = spark.createDataFrame([(i, t, ("en", "de", "fr")[i % 3]) for i, t in texts.items()], "doc_id long, text string, lang string")
    model = language_id.train(docs)

    def grams(text):
        kept = "".join(c if c.isalpha() else " " for c in text.lower())
        data = f" {' '.join(kept.split())} ".encode()
        out = collections.Counter()
        for n in range(1, 5):
            for at in range(len(data) - n + 1):
                code = 0
                for b in data[at : at + n]:
                    code = (code * 257 + b) % 2**32
                out[((code + n * 0x9E3779B1) * 0x85EBCA6B % 2**32) >> 19] += 1
        return out

    learned = [grams(t) for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5]
    seen = collections.Counter(g for x in learned for g in x)

    def vector(text):
        x = {g: math.log1p(n) * (math.log((1 + len(learned)) / (1 + seen[g])) + 1) for g, n in grams(text).items()}
        length = math.sqrt(sum(v * v for v in x.values()))
        return {g: v / length for g, v in x.items()}

    given = [*texts.values(), "ein Hund", "cats and dogs", "deux chiens"]
    pred, score = model.predict(given)
    for t, p, s in zip(given, pred, score.tolist(), strict=True):
        cosines = [sum(v * model.centroids[g, k] for g, v in vector(t).items()) for k in range(model.centroids.shape[1])]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert p == model.languages[model.owner[best]] and s == pytest.approx(min(cosines[best], 1), abs=1e-5)


def test_language_sample(spark):
    rows = [(i * 7919 - 5000, ("a", "b", "c", "d")[min(i % 11, 3)]) for i in range(3000)] + [(5, "rare"), (6, "rare")]
    df = spark.createDataFrame(rows, "id long, lang string")
    hashes = {r.id: r.v for r in df.select("id", F.shiftrightunsigned(F.xxhash64("id"), 1).alias("v")).collect()}
    for per, most in ((20, 4000), (100, 130), (20, 3), (5000, 4000)):
        by = collections.defaultdict(list)
        for i, lang in rows:
            by[lang].append((hashes[i], i))
        ranked = sorted((r, lang, i) for lang, own in by.items() for r, (_, i) in enumerate(sorted(own)[:per]))
        assert {r.id for r in language_id.sample(df, per, most).collect()} == {i for _, _, i in ranked[:most]}


def test_foreign_texts_are_rejected(spark):
    stock = {
        "en": "the and of with is that for was his not this have from they which one you were all her would there their said when who more".split(),
        "de": "der die und das ist nicht ein sie mit sich auf dem war für auch eine als werden noch über schön keit".split(),
    }
    rng = random.Random(14)
    rows = [(i, " ".join(rng.choice(stock[("en", "de")[i % 2]]) for _ in range(rng.choice([1, 5, 20, 60, 300]))), ("en", "de")[i % 2]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    foreign = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. " * 2,
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. " * 2,
        "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。" * 5,
        " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(60)),
    ]
    model = language_id.train(docs)
    given = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(foreign)], "doc_id long, text string"))
    kept = language_id.identify(given, model, reject=True, drop_rejected=True)
    assert {r.doc_id for r in kept.collect()} == set(range(600))
