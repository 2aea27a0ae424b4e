"""The stateless feature operators on streams.

Normalizers, calendar parts and causal cuts are column expressions, so they run
unchanged under ``readStream``.  Counts per window need a watermark; late rows
beyond it are left out, as in any append-mode aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.normalize import Normalizer, normalized


def read_folder(spark: SparkSession, folder: str, like: DataFrame, files_a_batch: int = 16) -> DataFrame:
    """New Parquet files of a folder as a stream with the columns of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def normalize_stream(stream: DataFrame, plan: dict[str, list[Normalizer]], keep: list[str]) -> DataFrame:
    return normalized(stream, plan, keep)


def degree_windows(stream: DataFrame, key: str, time: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``(key, start, n)``: events of each key in tumbling windows."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"))
    return w.select(key, F.col("w.start").alias("start"), "n")
