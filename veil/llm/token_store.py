"""Token ids in a binary format: canonical length-limited Huffman codes in independent blocks.

The ids of a corpus are counted, package-merge gives every id a code of at most LIMIT bits, and canonical
order makes the lengths alone the codebook.  A file of the format is one chunk of documents in ascending id order:

    magic "VHF1"; u32 documents, null ids, ids, block size, blocks, payload bytes
    i64 document ids; u32 ids of each document; u64 bit offset of each block (the checkpoints); payload

A store is a folder of chunks, with the codebook and each part's first place beside them, so it can be read by itself at any time.

Blocks are decoded apart by table: one lookup of LIMIT bits gives an id and its code's length, for
all blocks of a chunk in step.  Spark writes chunks as binary rows, so its commit protocol makes a lost
or repeated task harmless and any store that Spark reaches can hold them.
"""

from __future__ import annotations

import functools
import hashlib
import json
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.llm.common import delete, partitions, shared_path

MAGIC, HEAD = b"VHF1", struct.Struct("<4s6I")
#: Longest code; ids in a block; ids after which a chunk is closed.
LIMIT, BLOCK, CHUNK = 18, 512, 1 << 20
#: Words in each of the memo's two generations, and the longest that it takes.
MEMO, MEMO_CHARS = 400_000, 48


# -- the code ---------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most limit bits by package-merge; 0 for ids that do not occur."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols do not fit into {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    row, levels = np.empty(0), []
    for _ in range(limit):
        packages = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weight, packages])
        rank = np.argsort(both, kind="stable")
        row = both[rank]
        levels.append(rank >= len(weight))
    take = 2 * len(weight) - 2
    for is_package in reversed(levels):
        packed = int(is_package[:take].sum())
        out[order[: take - packed]] += 1
        take = 2 * packed
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The codes, numbered by length and then by id."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code, last = 0, 0
    for n in range(1, int(lengths.max(initial=0)) + 1):
        same = order[lengths[order] == n]
        code <<= n - last
        codes[same] = code + np.arange(len(same), dtype=np.uint32)
        code, last = code + len(same), n
    return codes


def decoding_table(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """For any `limit` bits that follow: the id they begin with and its code's length."""
    codes = canonical(lengths)
    ids, size = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.uint8)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    spans = 1 << (limit - lengths[order].astype(np.int64))
    begin = codes[order].astype(np.int64) << (limit - lengths[order].astype(np.int64))
    fill = np.repeat(order, spans)
    if len(order):
        first = int(begin[0])
        ids[first : first + len(fill)] = fill
        size[first : first + len(fill)] = lengths[fill]
    return ids, size


def pack_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, bytes]:
    """(bit offset of each block, payload)."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    begin = end - size
    total = int(end[-1]) if len(end) else 0
    word = (codes[ids].astype(np.uint64) << (32 - size - (begin & 7)).astype(np.uint64)).astype(np.uint32)
    out = np.zeros(total // 8 + 5)
    for k in range(4):
        out += np.bincount((begin >> 3) + k, ((word >> np.uint32(24 - 8 * k)) & np.uint32(255)).astype(np.float64), minlength=len(out))
    return begin[::block].astype(np.uint64), out.astype(np.uint8).tobytes()[: -(-total // 8)]


def unpack_bits(payload: bytes, offsets: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray], block: int = BLOCK, limit: int = LIMIT) -> np.ndarray:
    """The n ids; every block is a lane, and all lanes take a symbol at each step."""
    out = np.zeros((len(offsets), block), np.uint32)
    if not n:
        return out.ravel()
    data = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
    window = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    at, (ids, size) = offsets.astype(np.int64), table
    last = n - (len(offsets) - 1) * block
    for k in range(block):
        if k == last:
            at = at[:-1]
        if not len(at):
            break
        key = (window[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(32 - limit)
        out[: len(at), k] = ids[key]
        at = at + size[key]
    return out.ravel()[:n]


def write_chunk(doc_ids: list[int | None], parts: list[np.ndarray], lengths: np.ndarray, codes: np.ndarray) -> bytes:
    ids = np.concatenate(parts) if parts else np.empty(0, np.uint32)
    offsets, payload = pack_bits(ids, lengths, codes)
    nulls = sum(i is None for i in doc_ids)
    head = HEAD.pack(MAGIC, len(doc_ids), nulls, len(ids), BLOCK, len(offsets), len(payload))
    return b"".join([head, np.array([i or 0 for i in doc_ids], "<i8").tobytes(), np.array([len(p) for p in parts], "<u4").tobytes(), offsets.astype("<u8").tobytes(), payload])


def read_chunk(blob: bytes, table: tuple[np.ndarray, np.ndarray], limit: int = LIMIT) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, ids of each document, all ids)."""
    magic, docs, nulls, n, block, blocks, size = HEAD.unpack_from(blob)
    if magic != MAGIC:
        raise ValueError("not a chunk of token ids")
    at = HEAD.size
    doc_ids = np.frombuffer(blob, "<i8", docs, at).tolist()
    doc_ids[:nulls] = [None] * nulls
    sizes = np.frombuffer(blob, "<u4", docs, at := at + 8 * docs)
    offsets = np.frombuffer(blob, "<u8", blocks, at := at + 4 * docs)
    at += 8 * blocks
    return doc_ids, sizes, unpack_bits(blob[at : at + size], offsets, n, table, block, limit)


# -- the tokenizer ----------------------------------------------------------------------------

#: Lower-case words whose way through the tokenizer is only the byte alphabet, and words that are such a one in any case and then
#: ASCII signs, which are a token of their own to it (but for the apostrophe, which also begins endings).
_STEM = regex.compile(r"[a-zß-öø-ÿ]+").fullmatch
_PLAIN = r"^(?P<stem>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<mark>[!-&(-/:-@\[-`{-~]*)$"
#: How a tokenizers file says that it lower-cases, drops white space and parts letters, digits and other signs.
_LOWER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def parts_words(settings: dict) -> bool:
    """Whether a tokenizers file is of the kind that texts may be cut at spaces for and plain words given to its model."""
    model, added = settings["model"], settings.get("added_tokens") or []
    return (
        settings.get("normalizer") == _LOWER
        and settings.get("pre_tokenizer") == {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]}
        and not any(settings.get(k) for k in ("truncation", "padding"))
        and model["type"] == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        and not any(t["lstrip"] or t["rstrip"] or t["normalized"] or regex.search(r"\s|^\p{L}*$", t["content"]) for t in added)
    )


def gathered(flat: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists number at[0], at[1], ... of those that lie in flat one after the other, again so, and their sizes."""
    begin, n = (np.cumsum(size) - size)[at], size[at]
    end = np.cumsum(n)
    return flat[np.repeat(begin - (end - n), n) + np.arange(int(end[-1]) if len(end) else 0)], n


class WordEncoder(dict):
    """Ids of texts by a tokenizers file, through a bounded memo of words if the file parts words.

    Tokens then never reach over a space or line feed: a batch of texts is cut there, its distinct words are looked up once each, and what
    the memo lacks goes to the library: lower-case letters to its model, all else to its whole pipeline.  With any other file the library gets whole texts.
    A full memo becomes the older generation, from which words that come again are taken over.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        self.older: dict[str, bytes] = {}
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, "rb") as f:
            raw = f.read()
        self.digest = hashlib.sha256(raw).hexdigest()
        self.words = parts_words(json.loads(raw))
        self.library = Tokenizer.from_str(raw.decode())
        self.size = self.library.get_vocab_size(True)
        self.kind, self.code = (np.uint16, "H") if self.size <= 1 << 16 else (np.uint32, "I")
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        self.alphabet = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.tokenize = self.library.model.tokenize

    def __missing__(self, piece: str) -> bytes:
        got = self.older.get(piece)
        if got is None:
            if not piece:
                got = b""
            elif _STEM(piece):
                letters = piece if piece.isascii() else "".join(map(self.alphabet.__getitem__, piece.encode()))
                got = array(self.code, [t.id for t in self.tokenize(letters)]).tobytes()
            else:
                got = self._ids(piece)
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.older = dict(self)
                self.clear()
            self[piece] = got
        return got

    def _ids(self, text: str) -> bytes:
        return array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other; how many each has)."""
        width = np.dtype(self.kind).itemsize
        if not self.words:
            own = [self._ids(t or "") for t in texts.to_pylist()]
            return np.frombuffer(b"".join(own), self.kind), np.fromiter(map(len, own), np.int64, len(own)) // width
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        told = cut.flatten().dictionary_encode()
        plain = pc.extract_regex(told.dictionary, _PLAIN)
        pieces = pc.coalesce(pc.utf8_lower(pc.struct_field(plain, "stem")), told.dictionary).dictionary_encode()
        marks = pc.fill_null(pc.struct_field(plain, "mark"), "").dictionary_encode()
        words = [x.to_numpy(zero_copy_only=False) for x in (marks.dictionary, pieces.dictionary)]
        known = [*map(self.__getitem__, chain(*words))]
        flat, size = np.frombuffer(b"".join(known), self.kind), np.fromiter(map(len, known), np.int64, len(known)) // width
        both = np.stack([pieces.indices.to_numpy().astype(np.int64) + len(words[0]), marks.indices.to_numpy().astype(np.int64)], axis=1)
        flat, size = gathered(flat, size, both.ravel())
        ids, n = gathered(flat, size.reshape(-1, 2).sum(axis=1), told.indices.to_numpy())
        ends = np.r_[0, np.cumsum(n)][cut.offsets.to_numpy().astype(np.int64) - cut.offsets[0].as_py()]
        return ids, np.diff(ends)


def _text_slices(b: pa.RecordBatch, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch (id, text) with at most so many bytes of text, or one row."""
    size = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for i, n in enumerate(size.tolist()):
        if held and held + n > most:
            yield b.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < b.num_rows:
        yield b.slice(at)


@functools.lru_cache(maxsize=2)
def encoder_of(path: str) -> WordEncoder:
    return WordEncoder(path)


# -- tables -----------------------------------------------------------------------------------


def encode_words(df: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tie, ids, counts): every whole text's ids and the end id, packed as the encoder's integers, and a hash of them.

    Each task ends with a row of its own, where only counts is set: packed pairs of an id and how often the task wrote it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        width, total = np.dtype(encoder.kind).itemsize, np.zeros(max(encoder.size, end_id + 1), np.int64)
        names = ["id", "tie", "ids", "counts"]
        for b in batches:
            for part in _text_slices(b):
                ids, n = encoder.encode(pc.fill_null(part.column(1), ""))
                ids = np.insert(ids, np.cumsum(n), np.array(end_id, encoder.kind))
                total += np.bincount(ids, minlength=len(total))
                ends = np.r_[0, np.cumsum(n + 1)] * width
                packed = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
                tie = pa.array([xxhash.xxh3_64_intdigest(x.as_buffer()) - (1 << 63) for x in packed], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), tie, packed, pa.nulls(len(n), pa.binary())], names)
        used = np.flatnonzero(total)
        blob = np.stack([used, total[used]], axis=1).astype("<i8").tobytes()
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in (pa.int64(), pa.int64(), pa.binary())), pa.array([blob], pa.binary())], names)

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, tie long, ids binary, counts binary")


def id_counts(counts: DataFrame, size: int) -> np.ndarray:
    """Counts of all ids over the whole table from what the tasks counted: at most one row for each id of the vocabulary reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                pairs = np.frombuffer(x.as_py(), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["token", "n"])

    out = np.zeros(size, np.int64)
    for token, n in counts.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n")).collect():
        out[token] = n
    return out


def write_store(df: DataFrame, tokenizer: str, end_id: int, out: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes all texts to the folder `out` in the format: chunks, the parts' first places, and the codebook with what else a reader needs.

    The encoded rows stand for a while in the shared folder, since they are coded only once all are counted; they are range-partitioned by
    id (equal ids by a hash, so that a frequent one takes several parts) and sorted, and a partition's chunks carry its number, theirs and how many ids of the partition come before.
    """
    spark = df.sparkSession
    encoder = encoder_of(tokenizer)
    kind = encoder.kind
    held = shared_path(spark, "token-ids")
    encode_words(df, tokenizer, end_id, id_col, text_col).write.option("compression", "zstd").parquet(held)
    try:
        given = spark.read.parquet(held)
        lengths = code_lengths(id_counts(given.where("counts is not null").select("counts"), max(encoder.size, end_id + 1)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes, part = canonical(lengths), TaskContext.get().partitionId()
            ids: list[int | None] = []
            arrays: list[np.ndarray] = []
            held_ids, before, chunk = 0, 0, 0

            def close() -> pa.RecordBatch:
                blob = write_chunk(ids, arrays, lengths, codes)
                return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([chunk], pa.int32()), pa.array([before], pa.int64()), pa.array([held_ids], pa.int64()), pa.array([blob], pa.binary())], ["part", "chunk", "before", "n", "blob"])

            for b in batches:
                for i, x in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                    ids.append(i)
                    arrays.append(np.frombuffer(x.as_py(), kind).astype(np.uint32))
                    held_ids += len(arrays[-1])
                    if held_ids >= CHUNK:
                        yield close()
                        before, chunk, held_ids, ids, arrays = before + held_ids, chunk + 1, 0, [], []
            if ids:
                yield close()

        order = [F.col("id").asc_nulls_first(), F.col("tie")]
        ordered = given.where("ids is not null").select("id", "tie", "ids").repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order, "ids")
        ordered.mapInArrow(run, "part int, chunk int, before long, n long, blob binary").write.option("compression", "none").parquet(f"{out}/chunks")
    finally:
        delete(spark, held)
    starts, total = [], 0
    for part, n in spark.read.parquet(f"{out}/chunks").groupBy("part").agg(F.sum("n")).orderBy("part").collect():  # one row for each partition of the sort
        starts.append((part, total))
        total += n
    spark.createDataFrame(starts, "part int, start long").coalesce(1).write.parquet(f"{out}/parts")
    head = (bytearray(lengths.tobytes()), LIMIT, BLOCK, end_id, encoder.digest, total)
    spark.createDataFrame([head], "lengths binary, code_limit int, block int, end_id int, tokenizer_sha256 string, n_ids long").coalesce(1).write.parquet(f"{out}/codebook")


def read_store(spark: SparkSession, out: str, id_col: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32[, ids]) of each document, from the files alone: start counts the ids of all documents before it.

    ids, if kept, are packed little-endian unsigned 32-bit integers.
    """
    head = spark.read.parquet(f"{out}/codebook").first()
    lengths, limit = np.frombuffer(bytes(head["lengths"]), np.uint8), head["code_limit"]
    starts = {r["part"]: r["start"] for r in spark.read.parquet(f"{out}/parts").collect()}
    names = [id_col, "start", "n_tokens", "ids_crc32", *["ids"] * keep_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table(lengths, limit)
        for b in batches:
            for part, before, blob in zip(*(b.column(k) for k in range(3)), strict=True):
                doc_ids, sizes, ids = read_chunk(blob.as_py(), table, limit)
                end = np.cumsum(sizes.astype(np.int64))
                begin, view = end - sizes, memoryview(ids.astype("<u4").tobytes())
                own = [view[4 * s : 4 * e] for s, e in zip(begin.tolist(), end.tolist(), strict=True)]
                columns = [pa.array(doc_ids, pa.int64()), pa.array(begin + (starts[part.as_py()] + before.as_py())), pa.array(sizes.astype("i8")), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array([bytes(x) for x in own], pa.binary())] * keep_ids, names)

    schema = f"`{id_col}` long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids
    return spark.read.parquet(f"{out}/chunks").select("part", "before", "blob").mapInArrow(run, schema)


def store_documents(df: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the store to the shared folder and reads every document back from it.

    A null text counts as empty and holds the end id alone; null ids come first; equal ids stand side by side in the
    order of a hash of their ids; other columns are ignored; an empty table writes no chunk and gives no rows.
    """
    spark = df.sparkSession
    out = shared_path(spark, "token-store")
    write_store(df, tokenizer, end_id, out, id_col, text_col)
    return read_store(spark, out, id_col)
