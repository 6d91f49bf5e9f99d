"""The registered queries: one for each operator, over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.llm import bpe, decontaminate, language_id, line_dedup, quality, sharding, simhash, suffix_dedup, token_store, topk
from veil.llm.common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents in shards 0 to 23 by the law `key`: doc_id and the shard count decide."""
    return sharding.shard(table(spark, sf_dir, "documents"), 24)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every whole text, and what they decode to, as digests."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in a document, with its best window; five-word shingles, similarity 0.8 or more."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text without the bytes under 200-byte strings that start anywhere else, as digests."""
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=200)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors, by Hamming distance of sign codes, of every vector whose id 50 divides."""
    return topk.search(table(spark, sf_dir, "embeddings"), k=10, every=50)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: 3-word shingles, links at 2 or fewer differing bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document: its own evidence with its source's and its source and language's posteriors."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")), host="source", path="concat_ws('/', source, lang)")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and CRC as read back from the Huffman-coded store."""
    return token_store.store_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document without later repeated passages (two lines with content or more, or a long one), as a digest."""
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every whole text, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.train(docs), keep=["doc_id"])
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_bpe": op2_bpe,
    "op3_decontamination": op3_decontamination,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_topk": op5_topk,
    "op6_simhash": op6_simhash,
    "op7_quality": op7_quality,
    "op8_token_store": op8_token_store,
    "op9_line_dedup": op9_line_dedup,
    "op10_language_id": op10_language_id,
}
ORACLES: dict[str, str] = {"op1_sharding": sharding.SQL, "op4_suffix_dedup": suffix_dedup.SQL, "op5_topk": topk.SQL, "op9_line_dedup": line_dedup.SQL}
