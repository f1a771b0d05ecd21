"""Text sources: AMF logs, packet summaries, dumps, and stored metric samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from authsignal.schemas import METRIC_SAMPLE
from authsignal.sources.captures import path_below


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their file (its path below ``path``); ``seq`` keeps the order within a file.

    The order is the position of the line's partition and of the line in it, which follows the
    file as long as the files are read in place (no shuffle before this point).
    """
    return spark.read.option("recursiveFileLookup", True).text(path).select(
        path_below(path).alias("source"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").alias("line"),
    )


def read_metric_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRIC_SAMPLE).json(path)
