"""Packet tables: reading, discovery of captures, and the capture clock."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from authsignal.config import ScaleLimits
from authsignal.functions.skew import attach_by_key
from authsignal.schemas import MANIFEST, PACKET


def read_packets(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Decoded packets with the declared schema (``parquet``, ``json`` or ``orc``)."""
    return spark.read.schema(PACKET).format(fmt).load(path)


def discover(spark: SparkSession, folder: str, suffix: str = ".parquet") -> DataFrame:
    """One row per packet of every capture file below ``folder``; the path below it is the capture."""
    found = (
        spark.read.schema(PACKET)
        .option("pathGlobFilter", f"*{suffix}")
        .option("recursiveFileLookup", True)
        .parquet(folder)
    )
    if found.isEmpty():
        raise FileNotFoundError(f"no {suffix} captures in {folder}")
    name = F.regexp_replace(path_below(folder), f"{suffix.replace('.', '[.]')}$", "")
    return found.withColumn("capture", F.coalesce(F.col("capture"), name))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("header", True).csv(path)


def path_below(folder: str) -> Column:
    """The path of a row's file below the folder that was read, so equal names in two folders differ."""
    scheme = r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/]*)?"
    root = re.sub(scheme, "", folder).rstrip("/") + "/"
    path = F.regexp_replace(F.col("_metadata.file_path"), scheme, "")
    below = F.substring(path, F.lit(len(root) + 1), F.length(path))
    return F.when(F.startswith(path, F.lit(root)), below).otherwise(F.col("_metadata.file_name"))


def missing_captures(packets: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest rows without a single packet."""
    present = packets.select("capture").distinct()
    return manifest.join(present, "capture", "left_anti")


def label_windows(windows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Label and manifest position for every window of a listed capture.

    The join runs on windows, which are already one row per (capture, window), so a capture with
    very many packets is no heavier here than any other of the same length.
    """
    return windows.drop("label").join(manifest.select("capture", "label", "pos"), "capture")


def label_packets(packets: DataFrame, manifest: DataFrame, limits: ScaleLimits = ScaleLimits()) -> DataFrame:
    """Packets of listed captures with their label.

    The facts hold every capture, so one that is very large is split even if it isn't listed.
    """
    counts = packets.groupBy("capture").agg(F.count("*").alias("n_rows"))
    listed = manifest.select("capture", "label", F.lit(True).alias("listed"))
    facts = counts.join(listed, "capture", "left")
    return attach_by_key(packets, facts, "capture", "n_rows", "frame_no", limits).where("listed").drop("listed")


def capture_duration(packets: DataFrame, unreadable_us: int = 0) -> DataFrame:
    """Length of each capture: the relative time of its last frame."""
    return packets.groupBy("capture").agg(
        F.coalesce(F.max_by("rel_us", "frame_no"), F.lit(unreadable_us)).cast("bigint").alias("capture_us"),
        F.max("frame_no").alias("last_frame"),
        F.count("*").alias("n_rows"),
    )


def with_capture_length(
    packets: DataFrame, unreadable_us: int = 0, limits: ScaleLimits = ScaleLimits()
) -> DataFrame:
    """Add ``capture_us`` and ``last_frame`` to packets that carry only ``rel_us``."""
    if {"capture_us", "last_frame"} <= set(packets.columns):
        return packets
    facts = capture_duration(packets, unreadable_us)
    return attach_by_key(packets, facts, "capture", "n_rows", "frame_no", limits)


def clock_facts(frames: DataFrame) -> DataFrame:
    """Per capture of frames stamped with ``ts_us``: first and last instant, last frame and row count."""
    return frames.groupBy("capture").agg(
        F.min("ts_us").alias("_t0"),
        F.max_by("ts_us", "frame_no").alias("_t1"),
        F.max("frame_no").alias("last_frame"),
        F.count("*").alias("n_rows"),
    )


def stamped_duration(frames: DataFrame) -> DataFrame:
    """Length of each capture straight from wall-clock stamps: one aggregation, no join."""
    return clock_facts(frames).select("capture", (F.col("_t1") - F.col("_t0")).alias("capture_us"), "last_frame", "n_rows")


def with_capture_clock(frames: DataFrame, limits: ScaleLimits = ScaleLimits()) -> DataFrame:
    """Add ``rel_us``, ``capture_us`` and ``last_frame`` to frames stamped with ``ts_us`` only."""
    timed = attach_by_key(frames, clock_facts(frames), "capture", "n_rows", "frame_no", limits)
    return (
        timed.withColumn("rel_us", F.col("ts_us") - F.col("_t0"))
        .withColumn("capture_us", F.col("_t1") - F.col("_t0"))
        .drop("_t0", "_t1")
    )
