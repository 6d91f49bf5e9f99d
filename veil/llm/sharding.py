"""Sharding by jump consistent hashing (Lamping and Veach), in SQL expressions only.

The key alone and the number of shards decide a row's shard: no ring table is kept, and one more
shard takes a 1/(n+1) share of the rows and takes them only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value of the published algorithm: the multiplier of its 64-bit linear congruential generator.
MULTIPLIER = 2862933555777941757
TWO_64 = 18446744073709551616
TWO_33 = 8589934592
TWO_31 = 2147483648
#: Rows of a shard are numbered within so many slices of the ids; a prime, so ids in steps spread evenly.
SLICES = 1009


def jump_hash(key: Column, n: int) -> Column:
    """The shard, 0 to n-1, of a 64-bit integer key (null counts as 0).

    Long arithmetic would overflow, so the generator's state is an unsigned decimal.  A step moves
    at least one shard on, so n steps are enough; a finished row skips the rest.
    """
    k = F.coalesce(key.cast("bigint"), F.lit(0))
    start = F.when(k < 0, k.cast("decimal(20,0)") + F.lit(str(TWO_64)).cast("decimal(20,0)")).otherwise(k.cast("decimal(20,0)")).cast("decimal(20,0)")

    def step(s: Column) -> Column:
        state = ((s["k"] * F.lit(MULTIPLIER).cast("decimal(19,0)") + F.lit(1).cast("decimal(1,0)")) % F.lit(str(TWO_64)).cast("decimal(20,0)")).cast("decimal(20,0)")
        top = lambda x: F.floor(x / F.lit(TWO_33).cast("decimal(10,0)")).cast("double")
        to = lambda x: F.floor((s["j"] + 1).cast("double") * (F.lit(float(TWO_31)) / (top(x) + F.lit(1.0)))).cast("bigint")
        return F.transform(F.array(state), lambda x: F.struct(x.alias("k"), s["j"].alias("b"), to(x).alias("j")))[0]

    first = F.struct(start.alias("k"), F.lit(-1).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("j"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), first, lambda s, _: F.when(s["j"] >= n, s).otherwise(step(s)), lambda s: s["b"]).cast("int")


def shard(df: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 8 (a null text has none), text_crc32 the unsigned CRC-32 of
    those bytes, slot the row's gapless number in its shard from 0, grown_shard the shard if there
    were n + 1.  Slots follow (id modulo 1009, id, size, CRC), nulls first: a window numbers
    each slice of a shard, and one count for each slice (n * 1009 rows at most, so it is broadcast)
    shifts it; no task ever holds a whole shard.  The text itself is never shuffled.  A null id has key 0; equal ids
    share a shard and have slots of their own; other columns are ignored.
    """
    key = F.col(id_col).cast("bigint")
    slice_ = F.coalesce(F.pmod(key, F.lit(SLICES)), F.lit(0)).cast("int")
    raw = F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b""))
    rows = df.select(
        key.alias(id_col), (F.octet_length(raw) + 8).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"), F.lit("key").alias("law"),
        jump_hash(key, n).alias("shard"), slice_.alias("_slice"), jump_hash(key, n + 1).alias("grown_shard"),
    )
    counts = df.select(jump_hash(key, n).alias("shard"), slice_.alias("_slice")).groupBy("shard", "_slice").count()
    before = F.sum("count").over(_window("shard", "_slice").rowsBetween(-(2**31), -1))
    offsets = counts.select("shard", "_slice", F.coalesce(before, F.lit(0)).alias("_before"))
    number = F.row_number().over(_window(["shard", "_slice"], id_col, "size", "text_crc32"))
    slots = rows.withColumn("_number", number).join(F.broadcast(offsets), ["shard", "_slice"])
    return slots.select(id_col, "size", "text_crc32", "law", "shard", (F.col("_before") + F.col("_number") - 1).cast("bigint").alias("slot"), "grown_shard")


def _window(by, *order):
    from pyspark.sql import Window

    return Window.partitionBy(by).orderBy(*(F.col(c).asc_nulls_first() for c in order))


#: The same in SQL for 24 shards: the jumps step by step, and CRC-32 byte by byte from its polynomial.
SQL = f"""
WITH RECURSIVE t AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i::BIGINT, range(0, 8)), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS c FROM range(0, 256) r(i))),
d AS (SELECT doc_id, octet_length(raw) + 8 AS size,
  xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(raw)), lambda k: ('0x' || substr(h, 2 * k + 1, 2))::BIGINT)), lambda a, b: xor(t[xor(a, b) % 256 + 1], a // 256))) AS crc
  FROM (SELECT doc_id, encode(coalesce(text, '')) AS raw, hex(encode(coalesce(text, ''))) AS h FROM documents), t),
j AS (SELECT DISTINCT doc_id, n, (coalesce(doc_id, 0)::HUGEINT + {TWO_64}) % {TWO_64} AS key, -1::BIGINT AS b, 0::BIGINT AS j FROM documents, (VALUES (24), (25)) v(n)
  UNION ALL SELECT doc_id, n, key, j, floor((j + 1)::DOUBLE * ({TWO_31}::DOUBLE / (key // {TWO_33} + 1)::DOUBLE))::BIGINT
  FROM (SELECT doc_id, n, (key * {MULTIPLIER} + 1) % {TWO_64} AS key, j FROM j WHERE j < n)),
s AS (SELECT doc_id, max(b) FILTER (n = 24) AS shard, max(b) FILTER (n = 25) AS grown FROM j WHERE j >= n GROUP BY doc_id)
SELECT d.doc_id, d.size, d.crc AS text_crc32, 'key' AS law, s.shard::INT AS shard,
       row_number() OVER (PARTITION BY s.shard ORDER BY coalesce((d.doc_id % {SLICES} + {SLICES}) % {SLICES}, 0), d.doc_id NULLS FIRST, d.size, d.crc) - 1 AS slot, s.grown::INT AS grown_shard
FROM d JOIN s ON d.doc_id IS NOT DISTINCT FROM s.doc_id
"""
