"""Writers. Every one is distributed: nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from authsignal.config import ATTACKS, REAL_FEATURES, TRAINING_FEATURES
from authsignal.operators.features import FEATURE_COLUMNS
from authsignal.operators.metrics import exposition_files
from authsignal.schemas import TRAINING


def write_features(rows: DataFrame, path: str, fmt: str = "csv") -> None:
    """Feature table in its fixed column order."""
    front = [c for c in ("label", "window_id") if c in rows.columns]
    columns = front + [c for c in FEATURE_COLUMNS if c != "w"]
    writer = rows.select(*columns).write.mode("errorifexists")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """A stored feature table; the header decides whether it has a label and a window id."""
    header = spark.read.option("header", True).csv(path).columns
    types = {"capture": "string", "label": "string", "window_id": "string", **dict.fromkeys(REAL_FEATURES, "double")}
    types |= dict.fromkeys(("t_start", "t_end", "duration"), "double") | dict.fromkeys(("suci_unencrypted", "rand_repeat", "is_active"), "int")
    schema = ", ".join(f"`{name}` {types.get(name, 'bigint')}" for name in header)
    return spark.read.schema(schema).option("header", True).csv(path)


def write_training(rows: DataFrame, path: str) -> None:
    """Training set with its fixed columns; anything else is dropped."""
    rows.select("label", *TRAINING_FEATURES).write.option("header", True).csv(path)


def read_training(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRAINING).option("header", True).csv(path)


def write_report(detections: DataFrame, path: str) -> None:
    """Detection report: one nested JSON document per capture, and a header document."""
    detections.write.json(f"{path}/results")
    detections.agg(
        F.current_timestamp().alias("timestamp"),
        F.coalesce(F.avg("response_time"), F.lit(0.0)).alias("avg_response_time"),
        F.count("*").alias("captures"),
    ).write.json(f"{path}/summary")


def read_report(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The documents of a detection report, with the types of the rows that were written."""
    return spark.read.schema(schema).json(f"{path}/results")


def response_report(events: DataFrame) -> DataFrame:
    """Header of the response report: total and a map of responses per attack class."""
    per_class = [F.struct(F.lit(a).alias("key"), F.count_if(F.col("attack_type") == a).alias("value")) for a in ATTACKS]
    return events.agg(
        F.count("*").alias("total_mitigations"), F.map_from_entries(F.array(*per_class)).alias("summary")
    )


def write_response_report(events: DataFrame, blocked: DataFrame, path: str) -> None:
    """Response report: header, events and block lists as JSON documents."""
    response_report(events).write.json(f"{path}/summary")
    events.write.json(f"{path}/events")
    blocked.write.json(f"{path}/blocked")


def write_exposition(metric_rows: DataFrame, path: str) -> None:
    """Metric text files that are one valid exposition, read in the order of their names."""
    exposition_files(metric_rows).select("value").write.text(path)


def write_event_log(lines: DataFrame, path: str) -> None:
    lines.write.mode("append").json(path)


def write_evidence(sections: DataFrame, path: str) -> None:
    """Evidence lines, one folder per section."""
    sections.write.partitionBy("section").json(path)
