"""Quality scores by hierarchical empirical Bayes.

A logistic model, learned from labelled rows, gives each document's evidence from statistics and hashed byte n-grams of its whole text.  Hosts and paths get
posteriors from the evidence of all their documents: a path is shrunk toward its host and a host toward the
corpus, the more the fewer documents it has and the less such groups differ.  A document's score combines
its own likelihood ratio with its path's posterior, its own part taken out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.llm.common import cut
from veil.llm.language_id import counts as gram_counts

#: Labelled rows that the document model is fitted on at most: those first in a fixed shuffle of the ids.
MOST_ROWS = 6000
#: Bins of hashed n-grams, and what their weights are shrunk by against those of the statistics.
GRAMS, GRAM_RIDGE = 512, 30.0
#: Bounds of a group's prior weight, in documents.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1e6

_MARKS = str.maketrans("", "", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 \n\t\r.,;:!?'\"()-")


def statistics(text: str | None) -> list[float]:
    """Shares and logarithms that tell prose from tables, symbols and repetition, over the whole text."""
    text = text or ""
    words = text.split()
    n, c = max(len(words), 1), max(len(text), 1)
    ascii_rest = [x for x in text.translate(_MARKS) if not x.isalpha()]
    lines = text.split("\n")
    repeats = n - len(set(words))
    pairs = len(words) - 1 - len(set(zip(words, words[1:], strict=False))) if len(words) > 1 else 0
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    bare = sum(not any(map(str.isalpha, w)) for w in words)
    return [
        1.0, np.log1p(len(words)), len(ascii_rest) / c, len(set(ascii_rest)) / 10, repeats / n, pairs / n, same / n, upper / n, bare / n,
        np.log(c / n), (len(lines) - len(set(lines))) / len(lines), sum(map(str.isdigit, text)) / c, text.count("|") / n, text.count("!") / n,
    ]


def features(text: str | None) -> np.ndarray:
    """The statistics, and the text's hashed n-grams of 1 to 4 bytes as logarithms of counts, normalised."""
    grams = np.log1p(gram_counts(text or "").reshape(-1, GRAMS).sum(axis=0))
    return np.r_[statistics(text), grams / max(np.linalg.norm(grams), 1e-9)].astype(np.float32)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    prior: float

    def ratio(self, texts: list[str | None]) -> np.ndarray:
        """Log likelihood ratios of good to bad, at most 12 either way; 0 for texts without a word."""
        x = (np.array([features(t) for t in texts], float).reshape(len(texts), len(self.mean)) - self.mean) / self.scale
        blank = np.array([not (t and t.split()) for t in texts])
        return np.where(blank, 0.0, np.clip(x @ self.weight - _logit(self.prior), -12, 12))


def _logit(p: float) -> float:
    return float(np.log(p) - np.log1p(-p))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> Model:
    """Ridge logistic regression by Newton steps on standardised columns."""
    prior = float((y.sum() + 1) / (len(y) + 2))
    mean, scale = (x.mean(axis=0), x.std(axis=0)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    mean[0], scale[0] = 0.0, 1.0
    scale[scale < 1e-9] = 1.0
    z = (x - mean) / scale
    w = np.zeros(x.shape[1])
    w[0] = _logit(prior)
    penalty = np.full(x.shape[1], ridge)
    penalty[-GRAMS:] *= GRAM_RIDGE
    penalty[0] = 1e-6
    for _ in range(rounds if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return Model(mean, scale, w, prior)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = MOST_ROWS) -> Model:
    """Fits on at most most_rows labelled documents, their whole texts; ids whose crc32 5 divides are held out."""
    usable = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    learned = usable.where(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0)
    chosen = learned.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(most_rows)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([features(t.as_py()).tobytes() for t in b.column(2)], pa.binary())], ["id", "y", "x"])

    got = sorted((i, y, bytes(x)) for i, y, x in rows.select("id", "y", "text").mapInArrow(run, "id long, y int, x binary").collect())
    x = np.frombuffer(b"".join(x for _, _, x in got), np.float32).reshape(-1, len(features("")))
    return fit(x.astype(float), np.array([y for _, y, _ in got], float))


def score(docs: DataFrame, model: Model, host: str, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, evidence, host_quality, path_quality, quality, keep) of every document.

    host and path are SQL expressions over docs; null is a group of its own, and a path belongs to its
    host.  evidence is the document model's log likelihood ratio, 0 for a null or blank text, whose quality
    is its path's posterior; keep is quality of 0.5 or more.  Repeated rows each count and get a row; an empty table gives none.
    Groups are summed before the shuffle and joined as one row against many, so a host with a third of all
    rows is no single task's.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(shared.value.ratio(part.column(3).to_pylist()))], ["id", "host", "path", "evidence"])

    key = lambda e: F.coalesce(F.expr(e).cast("string"), F.lit(""))
    given = docs.select(F.col(id_col).cast("bigint").alias("id"), key(host).alias("host"), key(path).alias("path"), F.col(text_col).cast("string").alias("text"))
    rows = cut(given.mapInArrow(run, "id long, host string, path string, evidence double"))
    prior = _logit(model.prior)
    p = 1 / (1 + F.exp(-(F.col("evidence") + prior)))
    rows = rows.withColumn("p", p)
    paths = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    whole = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s")).first()
    if not whole["n"]:
        return rows.select(F.col("id").alias(id_col), "evidence", F.col("p").alias("host_quality"), F.col("p").alias("path_quality"), F.col("p").alias("quality"), F.lit(True).alias("keep"))
    mean = min(max(whole["s"] / whole["n"], 1e-6), 1 - 1e-6)
    host_weight = _prior_weight(hosts, "hn", "hs", F.lit(mean), mean)
    tree = paths.join(hosts, "host")
    path_weight = _prior_weight(tree, "n", "s", (F.col("hs") + host_weight * mean) / (F.col("hn") + host_weight), mean)
    own = F.col("p")
    theta_host = (F.col("hs") - own + host_weight * mean) / (F.col("hn") - 1 + host_weight)
    theta_path = (F.col("s") - own + path_weight * F.col("host_quality")) / (F.col("n") - 1 + path_weight)
    bound = lambda c: F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    out = rows.join(tree, ["host", "path"]).withColumn("host_quality", bound(theta_host)).withColumn("path_quality", bound(theta_path))
    odds = F.col("evidence") + F.ln(F.col("path_quality") / (1 - F.col("path_quality")))
    out = out.withColumn("quality", 1 / (1 + F.exp(-odds)))
    return out.select(F.col("id").alias(id_col), "evidence", "host_quality", "path_quality", "quality", (F.col("quality") >= 0.5).alias("keep"))


def _prior_weight(groups: DataFrame, n: str, s: str, toward, mean: float) -> float:
    """How many documents the level above counts for, by the method of moments over all groups."""
    rate = F.col(s) / F.col(n)
    row = groups.agg(F.sum(F.col(n) * F.pow(rate - toward, 2)).alias("q"), F.count("*").alias("g"), F.sum(n).alias("n")).first()
    noise = mean * (1 - mean)
    between = (row["q"] - row["g"] * noise) / max(row["n"], 1)
    return float(min(max(noise / between - 1, LEAST_WEIGHT), MOST_WEIGHT)) if between > 0 else MOST_WEIGHT
