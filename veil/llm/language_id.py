"""Language identification by nearest centroid.

A text's vector holds its hashed byte n-grams (1 to 4 bytes of the lower-cased text with runs of
anything but letters made one space), log TF times IDF, normalised.  Each language has several centroids, found by
spherical k-means over its training texts; the language of the most similar centroid by cosine
wins.  A text whose cosine to every centroid is below the model's floor for texts of its length is rejected.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veil.llm.common import cut, free

UNKNOWN = "und"
DIMENSIONS = 1 << 13
SIZES = (1, 2, 3, 4)
#: Training takes at most so many texts of each language, those first in a fixed shuffle of the ids, and in all.
PER_LANGUAGE, MOST_ROWS = 500, 4000
CLUSTERS = 4
#: Texts are counted in pieces of so many bytes, so a very long one needs no more memory.
PIECE = 1 << 20
#: Bins of n-gram counts by powers of two, the pieces of training texts that fill them (characters), and what makes a floor of their cosines.
BINS = 20
PIECES = [1 << i for i in range(3, 13)]
QUANTILE, RARE, MARGIN, LEAST = 0.02, 0.001, 0.8, 200
#: Texts in bins under this (255 n-grams, about 60 characters) tell too little, so only the rarest cosines of pieces make their floor.
SHORT = 8

_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # (DIMENSIONS, languages * clusters)
    owner: np.ndarray  # language of each centroid
    floors: np.ndarray  # of each bin of n-gram counts

    def vectors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Vectors, and the bin of each text's number of n-grams."""
        rows = np.zeros((len(texts), DIMENSIONS), np.float32)
        for i, t in enumerate(texts):
            if t and _LETTER.search(t):
                rows[i] = counts(t)
        return _weigh(rows, self.idf), np.minimum(np.log2(rows.sum(axis=1) + 1).astype(np.int64), BINS - 1)

    def predict(self, texts: list[str | None], reject: bool = False) -> tuple[list[str], np.ndarray]:
        if not self.languages or not texts:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        vectors, size = self.vectors(texts)
        cosine = vectors @ self.centroids
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(texts)), best], 0, 1).astype(float)
        none = [not (t and _LETTER.search(t)) for t in texts]
        score[none] = 0
        out = [UNKNOWN if n or (reject and s < f) else self.languages[self.owner[k]] for n, s, k, f in zip(none, score, best, self.floors[size], strict=True)]
        return out, score


def counts(text: str) -> np.ndarray:
    """Hashed n-gram counts of a whole text."""
    data = np.frombuffer((" " + _OTHER.sub(" ", text.lower()).strip() + " ").encode("utf-8", "surrogatepass"), np.uint8)
    out = np.zeros(DIMENSIONS, np.int64)
    for at in range(0, max(1, len(data) - 1), PIECE):
        piece = data[at : at + PIECE + max(SIZES) - 1].astype(np.uint32)
        code = np.zeros(len(piece), np.uint32)
        for n in SIZES:
            if len(piece) < n:
                break
            code = code[: len(piece) - n + 1] * np.uint32(257) + piece[n - 1 :]
            own = code[: min(len(code), PIECE)]
            out += np.bincount(((own + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)) >> np.uint32(19), minlength=DIMENSIONS)
    return out


def _weigh(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    rows = np.log1p(rows) * idf
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from far-apart first centroids."""
    picked = [int((x @ x.mean(axis=0)).argmax())]
    while len(picked) < min(k, len(x)):
        picked.append(int((x @ x[picked].T).max(axis=1).argmin()))
    c = x[picked]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        c = np.stack([x[near == j].sum(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def held_out(id_col: Column) -> Column:
    """True where crc32 of the id as text is divisible by 5: never learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def sample(rows: DataFrame, per_language: int, most_rows: int) -> DataFrame:
    """The ids, most_rows at most, of rows (id, lang): the first per_language of each language in the order of a hash of the id, first ranks first.

    Counts by language and power of the hash, which merge before any shuffle, give each language the last power it needs,
    so no task ranks more than a few rows over per_language, however many there are.  Of over most_rows languages only the first by name can be
    among the ranks that are kept, so what is broadcast is bounded.
    """
    keyed = rows.withColumn("v", F.shiftrightunsigned(F.xxhash64("id"), 1)).withColumn("power", F.floor(F.log2(F.col("v").cast("double") + 1) * 16).cast("int"))
    counted = keyed.groupBy("lang", "power").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("power")) - F.col("n")
    last = counted.select("lang", "power", before.alias("before")).where(F.col("before") < per_language).groupBy("lang").agg(F.max("power").alias("last")).orderBy("lang").limit(most_rows)
    few = keyed.join(F.broadcast(last), "lang").where("power <= last").withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("v", "id")))
    return few.where(F.col("r") <= per_language).orderBy("r", "lang", "id").limit(most_rows).select("id").distinct()


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, clusters: int = CLUSTERS, most_rows: int = MOST_ROWS) -> Model:
    """Learns from rows that are not held out and have text and language: at most per_language of each, most_rows in all.

    sample() chooses them, in a way that does not depend on partitions; texts are fetched for the chosen ids alone, whose
    number, and so the broadcast and what comes to the driver (16 KB a row, and packed), is bounded whatever the table's size.
    """
    usable = df.where(~held_out(F.col(id_col)) & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    texts = usable.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    picked = texts.join(F.broadcast(cut(sample(texts.select("id", "lang"), per_language, most_rows))), "id", "left_semi")
    rows = _features(picked)
    rows.sort()
    if not rows:
        return Model([], np.zeros(DIMENSIONS, np.float32), np.zeros((DIMENSIONS, 0), np.float32), np.zeros(0, np.int64), np.zeros(BINS))
    x, seen = np.empty((len(rows), DIMENSIONS), np.float32), np.zeros(DIMENSIONS, np.int64)  # one matrix, weighed in place
    for i, (_, _, packed) in enumerate(rows):
        x[i] = np.frombuffer(zlib.decompress(packed), np.uint16)
        seen += x[i] > 0
    idf = np.log((1 + len(rows)) / (1 + seen)).astype(np.float32) + 1
    np.log1p(x, out=x)
    x *= idf
    for i in range(len(x)):
        x[i] /= max(np.linalg.norm(x[i]), 1e-9)
    lang = np.array([r[1] for r in rows])
    names = sorted(set(lang.tolist()))
    groups = [_cluster(x[lang == n], clusters) for n in names]
    centroids = np.concatenate(groups).T.astype(np.float32)
    model = Model(names, idf, centroids, np.repeat(np.arange(len(names)), [len(g) for g in groups]), np.zeros(BINS))
    model.floors = np.minimum(_floors(picked, model), MARGIN * np.quantile((x @ model.centroids).max(axis=1), RARE))
    return model


def _floors(picked: DataFrame, model: Model) -> np.ndarray:
    """For each power of two of n-grams, MARGIN of a low quantile of the cosines of pieces of the training texts with so many.

    Pieces are taken from the start and the middle of each text, so that short texts are held to what short pieces score and long ones to
    what long ones do; train() lets no floor be over MARGIN of what nearly all whole texts score.  A bin of under LEAST pieces has the floor of the next shorter one that has as many.
    """
    shared = picked.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for t in b.column(1).to_pylist():
                sizes = [n for n in PIECES if n < len(t)]
                texts = [x for x in [t, *(t[:n] for n in sizes), *(t[len(t) // 2 :][:n] for n in sizes)] if _LETTER.search(x)]
                if texts:
                    vectors, size = m.vectors(texts)
                    yield pa.RecordBatch.from_arrays([pa.array(size.astype("i4")), pa.array((vectors @ m.centroids).max(axis=1).astype("f8"))], ["size", "score"])

    rows = picked.mapInArrow(run, "size int, score double").groupBy("size").agg(F.count("*").alias("n"), F.percentile("score", F.array(F.lit(RARE), F.lit(QUANTILE))).alias("low")).collect()
    known = {r["size"]: MARGIN * r["low"][int(r["size"] >= SHORT)] for r in rows if r["n"] >= LEAST}
    out = np.zeros(BINS)
    for i in range(1, BINS):
        out[i] = known.get(i, out[i - 1])
    return out


def _features(picked: DataFrame) -> list[tuple[int, str, bytes]]:
    """Training rows as (id, language, counts up to 65535, packed): a bounded number of rows of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(i, c, zlib.compress(np.minimum(counts(t), 65535).astype(np.uint16).tobytes(), 1)) for i, t, c in zip(*(x.to_pylist() for x in b.columns), strict=True) if _LETTER.search(t)]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*got, strict=True)], ["id", "lang", "counts"])

    return [tuple(r) for r in picked.mapInArrow(run, "id long, lang string, counts binary").collect()]


def identify(df: DataFrame, model: Model, text_col: str = "text", reject: bool = False, keep: list[str] | None = None, drop_rejected: bool = False, told: bool = True) -> DataFrame:
    """df (or its columns `keep`) with lang_pred and score, one narrow stage.

    `und` with score 0 for a null text or one with no letter, and with reject=True also below the
    model's floor for the text's length (drop_rejected leaves those rows out).  Columns of df by these two names are replaced; told=False adds and replaces none.  Repeated rows stay; an empty table gives none.
    """
    kept = [c for c in (keep or df.columns) if not told or c not in ("lang_pred", "score")]
    given = df.select(*(F.col(f"`{c}`") for c in kept), F.col(text_col).cast("string").alias(free(kept, "text")[0]))
    context = df.sparkSession.sparkContext
    shared = context.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                lang, score = m.predict(part.column(part.num_columns - 1).to_pylist(), reject)
                new = [pa.array(lang, pa.string()), pa.array(score, pa.float64())] if told else []
                out = pa.RecordBatch.from_arrays([*part.columns[:-1], *new], [*part.schema.names[:-1], *["lang_pred", "score"][: len(new)]])
                yield out.filter(pa.array([x != UNKNOWN for x in lang])) if drop_rejected else out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1]) + ", lang_pred string, score double" * told
    return given.mapInArrow(run, schema)
