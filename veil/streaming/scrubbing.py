"""Scrubbing streams: the plan is stateless and narrow, so it runs on a stream as it does on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from veil.operators.spans import explode_spans
from veil.plans.scrub import findings, scrub, with_spans


def read_stream(spark: SparkSession, path: str, schema: StructType | str, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def scrub_to(stream: DataFrame, out: str, checkpoint: str, locale: str = "en_US", **options) -> StreamingQuery:
    """Scrubbed rows to Parquet, exactly once: the checkpoint and the file sink's log make a restart go on where it stopped."""
    return scrub(stream, locale, **options).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).outputMode("append").trigger(availableNow=True).start()


def counts_by_window(stream: DataFrame, time_col: str, id_col: str = "doc_id", text_col: str = "text", locale: str = "en_US", detectors: list[str] | None = None, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(window, type, n): how much of each type arrived in each window of event time; state is dropped once the watermark has passed."""
    timed = with_spans(stream.withWatermark(time_col, late), locale, detectors, text_col=text_col)
    each = explode_spans(timed, "spans", time_col)
    return each.groupBy(F.window(time_col, window).alias("window"), F.col("s.type").alias("type")).agg(F.count("*").alias("n"))


__all__ = ["counts_by_window", "findings", "read_stream", "scrub_to"]
