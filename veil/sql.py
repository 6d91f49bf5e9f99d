"""The engine in SQL: scalar functions and a table function for LATERAL joins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from veil.functions import model

#: SQL text of functions that Spark evaluates itself.
_NATIVE = {
    "veil_digest_modulo(value STRING, modulus BIGINT) RETURNS BIGINT": "aggregate(transform(sequence(1, 25, 8), i -> CAST(conv(substring(md5(CAST(value AS BINARY)), i, 8), 16, 10) AS BIGINT)), 0L, (r, c) -> (r * (4294967296L % modulus) + c) % modulus)",
    "veil_placeholder(kind STRING, value STRING) RETURNS STRING": (
        "concat(CASE WHEN kind = 'markdown_url' OR lower(value) RLIKE '^(https?://|ftp://|www[.])' OR contains(lower(value), 'sharepoint.com/')"
        " OR (startswith(replace(lower(value), ' ', ''), '[') AND contains(replace(lower(value), ' ', ''), '](') AND contains(replace(lower(value), ' ', ''), '://'))"
        " THEN 'URL' ELSE upper(kind) END, '-', lpad(CAST(veil_digest_modulo(concat(kind, ':', value), 10000) AS STRING), 4, '0'))"
    ),
}


class DetectPii:
    """SELECT * FROM docs, LATERAL detect_pii(text, 'en_US')"""

    def eval(self, text: str, locale: str) -> Iterator[tuple]:
        for s in model.detect(text, locale or "en_US"):
            yield s.beg, s.end, s.kind, s.text, model.placeholder(s.kind, s.text)


def register(spark: SparkSession) -> None:
    """veil_placeholder and veil_digest_modulo (native), veil_scrub(text, locale) and the table function detect_pii(text, locale)."""
    for head, body in _NATIVE.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")

    @F.pandas_udf("string")
    def veil_scrub(text: pd.Series, locale: pd.Series) -> pd.Series:
        return pd.Series([model.scrub(t, x or "en_US") for t, x in zip(text, locale, strict=True)], dtype=object)

    spark.udf.register("veil_scrub", veil_scrub)
    spark.udtf.register("detect_pii", F.udtf(DetectPii, returnType="beg int, end int, type string, text string, replacement string"))
