"""Online detection: which captures are attacks, why, and what to do about them."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authsignal.config import MODEL_FEATURES, SCORE_ORDER, DetectorConfig
from authsignal.operators import forest
from authsignal.operators.respond import online_actions
from authsignal.operators.rules import gated, online_class, score_share, weighted_class, with_weighted_scores
from authsignal.operators.windows import apply_overrides, capture_verdict_inputs


def capture_features(packets: DataFrame, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """One row per capture: best window with the whole-capture overrides applied."""
    rows = apply_overrides(capture_verdict_inputs(packets, cfg), cfg)
    return rows.withColumn("capture_seconds", F.bround(F.col("capture_us") / F.lit(float(cfg.unit_us)), 2))


def with_response_time(rows: DataFrame, timings: DataFrame | None) -> DataFrame:
    """Add the measured ``response_time`` in seconds, null where nothing was measured.

    ``timings`` has one row per capture: when its detection began and when the response was out
    (``detected_from_us``, ``responded_us``).
    """
    if timings is None:
        return rows.withColumn("response_time", F.lit(None).cast("double"))
    seconds = F.bround((F.col("responded_us") - F.col("detected_from_us")) / F.lit(1e6), 2)
    own = timings.select(F.col("capture").alias("_timed"), seconds.alias("response_time"))
    return rows.join(own, F.col("capture").eqNullSafe(F.col("_timed")), "left").drop("_timed")


def decide(
    rows: DataFrame,
    cfg: DetectorConfig,
    fallback_class: str,
    fallback_confidence: str,
    method: str,
) -> DataFrame:
    """Rules first; the rest takes the fallback verdict of ``method``, subject to the confidence gate."""
    left = gated(F.col(fallback_class), F.col(fallback_confidence), cfg)
    ruled = online_class(cfg, otherwise=F.lit(None).cast("string")).isNotNull()
    confidence = F.when(ruled, F.lit(1.0)).otherwise(F.bround(fallback_confidence, 3))
    return rows.withColumns(
        {
            "prediction": online_class(cfg, otherwise=left),
            "confidence": confidence,
            "method": F.when(ruled, "rule").otherwise(method),
        }
    ).withColumn("actions", online_actions(F.col("prediction"), cfg))


def detect(
    packets: DataFrame,
    model: PipelineModel,
    cfg: DetectorConfig = DetectorConfig(),
    timings: DataFrame | None = None,
) -> DataFrame:
    """Hybrid detection over all captures in one plan: rules, else forest with the gate."""
    scored = forest.predict(model, with_response_time(capture_features(packets, cfg), timings))
    return decide(scored, cfg, "model_class", "model_confidence", "rf")


def with_score_share(rows: DataFrame) -> DataFrame:
    """Weighted class and its share of all weighted scores."""
    return (
        with_weighted_scores(rows)
        .withColumns({"weighted_class": weighted_class(), "score_share": score_share()})
        .drop(*[f"score_{name}" for name in SCORE_ORDER])
    )


def detect_without_model(
    packets: DataFrame,
    cfg: DetectorConfig = DetectorConfig(),
    timings: DataFrame | None = None,
) -> DataFrame:
    """Detection where no model is trained yet: weighted rules stand in for the forest."""
    rows = with_score_share(with_response_time(capture_features(packets, cfg), timings))
    return decide(rows, cfg, "weighted_class", "score_share", "weighted")


def result_rows(detections: DataFrame, timestamp=None) -> DataFrame:
    """Result row per capture with its features nested, as written to the report."""
    return detections.select(
        (timestamp if timestamp is not None else F.current_timestamp()).alias("timestamp"),
        "capture",
        "prediction",
        "confidence",
        "method",
        "actions",
        "response_time",
        "capture_seconds",
        F.struct(*MODEL_FEATURES).alias("features"),
    )
