"""From labelled captures to a trained model, and its evaluation."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from authsignal.config import DetectorConfig, ScaleLimits
from authsignal.functions.shared import written
from authsignal.operators import forest
from authsignal.operators.augment import oversample
from authsignal.operators.features import Layout, window_features
from authsignal.operators.rules import offline_class, simple_class, weighted_class, with_weighted_scores
from authsignal.operators.windows import window_ids, window_totals
from authsignal.sources.captures import capture_duration, label_windows

ORDER = ["capture", "w"]


def labelled_features(
    packets: DataFrame, manifest: DataFrame, cfg: DetectorConfig = DetectorConfig(), limits: ScaleLimits = ScaleLimits()
) -> DataFrame:
    """Sliding windows of the listed captures with label and running window id."""
    windows = label_windows(window_features(packets, cfg, Layout.sliding(cfg), limits), manifest)
    return window_ids(windows, totals=window_totals(capture_duration(packets), manifest, cfg))


def training_set(labelled: DataFrame, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """Oversampled training set, written once to the shared folder: a few hundred rows.

    The labelled windows are read several times on the way, so they are stored first; the packets
    behind them are read once.
    """
    return written(oversample(written(labelled, "windows"), ORDER, cfg), "training")


def train(labelled: DataFrame, trees: int = 200, cfg: DetectorConfig = DetectorConfig()) -> PipelineModel:
    return forest.fit(training_set(labelled, cfg), trees, cfg)


def held_out(capture: str = "capture", parts: int = 5) -> Column:
    """Captures kept for testing: about one in ``parts``, whole captures, by their name alone."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(capture), F.lit(""))), 1, 8), 16, 10).cast("bigint") % parts == 0


def with_all_predictions(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Simple, weighted, forest and hybrid verdicts side by side on labelled windows."""
    scored = with_weighted_scores(forest.predict(model, rows))
    return (
        scored.withColumn("simple", simple_class())
        .withColumn("weighted", weighted_class())
        .withColumn("forest", F.col("model_class"))
        .withColumn("hybrid", offline_class(otherwise=F.col("model_class")))
    )
