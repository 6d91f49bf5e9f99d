"""Exact top-k search over binary codes by incremental multi-index hashing.

Vectors become 64-bit sign codes; equal codes are one class with its k smallest ids.  Classes and the
queries' codes are dealt to blocks, and each cell (a block of classes, a block of queries) is searched by its own
multi-index, growing segment radii until the k-th verified distance is provably covered.  A query is searched in its own
block first; the k-th distance there bounds it in all others, which return only what is no farther.  The
cells' lists, k entries a query at most, are merged by rank.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veil.llm.common import cut, partitions
from veil.llm.hamming import MultiIndex

BITS = 64
#: Classes and query codes of one cell; both bound a task's memory, whatever the table's size.
CLASSES, QUERIES = 1 << 16, 1 << 16


def sign_codes(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, code): bit i tells whether the components i, i + 64, ... add up to more than 0.

    Of 64 components these are their signs; of more, the sums fold the vector into 64 signs, which is a coarser code.  Null components count as 0, missing ones too; a null vector has no code and no row.
    """

    def run(batches):
        for b in batches:
            codes = []
            for v in b.column(1):
                x = np.array([y or 0.0 for y in v.as_py()], np.float64)
                x = np.pad(x, (0, -len(x) % BITS or (0 if len(x) else BITS))).reshape(-1, BITS).sum(axis=0)
                codes.append(np.packbits(x > 0, bitorder="little").view("<i8")[0])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes, pa.int64())], ["id", "code"])

    given = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    return given.mapInArrow(run, "id long, code long")


def search(df: DataFrame, k: int = 10, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, distance): the k nearest rows, from 1, of every row whose id `every` divides.

    Distances are Hamming distances of the codes; ties go to the smaller id; the query itself is one of the rows.  A table
    of fewer than k rows gives them all.  Rows without id or vector are neither found nor asked; repeated
    ids count as rows of their own; an empty table gives none.
    """
    codes = cut(sign_codes(df, id_col, vector_col))
    nth = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    classes = codes.withColumn("r", nth).where(F.col("r") <= k).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    asked = codes.where(F.col("id") % every == 0)
    queries = cut(asked.select(F.col("code").alias("code")).distinct())  # an alias, or else both sides of a cell have the same column
    row_blocks = -(-codes.select("code").distinct().count() // CLASSES) or 1
    parts = partitions(df.sparkSession)
    query_blocks = max(-(-queries.count() // QUERIES), -(-parts // row_blocks))  # a cell for every partition at least

    def placed(x: DataFrame, own: str, blocks: int) -> DataFrame:
        return x.withColumn(own, F.pmod(F.xxhash64("code"), F.lit(blocks)).cast("int"))

    def everywhere(other: str, others: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other)

    def searched(rows: DataFrame, wanted: DataFrame) -> DataFrame:
        """Lists of the cells; given numbers of partitions keep them apart, where small ones would be coalesced into one task."""
        left, right = (x.repartition(parts, "x", "y").groupBy("x", "y") for x in (rows, wanted))
        return left.cogroup(right).applyInPandas(cell, "code long, distance long, id long")

    def cell(rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(rows) and len(wanted):
            index = MultiIndex(rows["code"].to_numpy(np.int64).view(np.uint64))
            ids = rows["ids"].to_numpy()
            for code, bound in zip(wanted["code"].to_numpy(np.int64), wanted["bound"].tolist(), strict=True):
                at, distance = index.nearest(int(np.uint64(code.view(np.uint64))), k, bound)
                near = sorted((int(d), int(i)) for p, d in zip(at, distance, strict=True) for i in ids[p])[:k]
                found += [(int(code), d, i) for d, i in near]
        return pd.DataFrame(found, columns=["code", "distance", "id"]).astype("int64")

    left = placed(classes, "x", row_blocks).select("*", everywhere("y", query_blocks))
    right = placed(placed(queries, "x", row_blocks), "salt", row_blocks * query_blocks).withColumn("y", (F.col("salt") / row_blocks).cast("int")).drop("salt")
    lists = searched(left, right.withColumn("bound", F.lit(BITS)))
    if row_blocks > 1:
        lists = cut(lists)
        kth = lists.groupBy("code").agg(F.when(F.count("*") >= k, F.max("distance")).otherwise(BITS).cast("int").alias("bound"))
        others = right.withColumnRenamed("x", "own").join(kth, "code").select("code", "bound", "y", "own", everywhere("x", row_blocks)).where("x <> own").drop("own")
        lists = lists.unionByName(searched(left, others))
    best = F.row_number().over(Window.partitionBy("code").orderBy("distance", "id"))
    merged = lists.withColumn("rank", best).where(F.col("rank") <= k)
    return asked.withColumnRenamed("id", "query_id").join(merged, "code").select("query_id", "rank", F.col("id").alias(id_col), F.col("distance").cast("int").alias("distance"))


SQL = """
WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0),
d AS (SELECT q.query_id, v.vec_id,
             list_sum(list_transform(list_zip(q.e, v.embedding), lambda z: CASE WHEN (z[1] > 0) <> (z[2] > 0) THEN 1 ELSE 0 END))::INT AS distance
      FROM q, embeddings v),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank FROM d)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""
