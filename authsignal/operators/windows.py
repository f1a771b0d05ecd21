"""Choosing and numbering windows, and slicing packets by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from authsignal.config import DetectorConfig
from authsignal.functions.columns import floor_div
from authsignal.operators.features import (
    COUNTERS,
    SEEN,
    Layout,
    derive,
    panes,
    rand_repeats,
)
from authsignal.operators.rules import window_score


ENDLESS_US = 1 << 60  # a length beyond all packets, where the real one is applied later


def time_slice(packets: DataFrame, t0_us: int, t1_us: int, extra: Column | None = None) -> DataFrame:
    """Packets with ``t0 <= rel < t1``, and ``extra`` if given."""
    inside = (F.col("rel_us") >= t0_us) & (F.col("rel_us") < t1_us)
    return packets.where(inside if extra is None else inside & extra)


def capture_verdict_inputs(packets: DataFrame, cfg: DetectorConfig) -> DataFrame:
    """Per capture: the best tumbling window and the whole-capture evidence, in one aggregation.

    A tumbling window is a single pane, so the best window and the overrides are both reductions
    of the pane rows by capture. A capture whose windows are all empty reports its first one.

    Packets that carry only ``rel_us`` need no length joined onto them: it is worked out from the
    panes, one row per capture and window, and panes beyond it are left out there.
    """
    layout = Layout.tumbling(cfg)
    if "capture_us" in packets.columns:
        rows = panes(packets, cfg, layout)
    else:
        packets = packets.withColumns({"capture_us": F.lit(ENDLESS_US), "last_frame": F.lit(None).cast("long")})
        rows = panes(packets, cfg, layout, last_row="max(struct(frame_no, rel_us))")
        length = F.max("last_row").over(W.partitionBy("capture"))["rel_us"]
        rows = rows.withColumn("capture_us", F.coalesce(length, F.lit(cfg.window_us)).cast("bigint"))
    rows = rows.selectExpr("*", "cast(null_seen AND watched_seen AS int) AS suci_unencrypted")
    rows = rows.select("*", window_score().alias("score"))
    per_capture = rows.groupBy("capture").agg(
        F.expr(
            f"max_by(struct(pane AS w, score, {', '.join(COUNTERS + SEEN)}), "
            f"if(pane < {layout.n_windows}, struct(score, -pane AS earliest), NULL)) AS best"
        ),
        F.expr("max(capture_us) AS capture_us"),
        F.expr("sum(all_failures) AS all_failures"),
        F.expr("bool_or(any_abort) AS any_abort"),
        F.expr("bool_or(any_rogue) AS any_rogue"),
    )
    chosen = per_capture.selectExpr(
        "capture",
        "capture_us",
        "all_failures",
        "any_abort",
        "any_rogue",
        *[f"coalesce(best.{name}, 0L) AS {name}" for name in ("w", "score", *COUNTERS)],
        *[f"coalesce(best.{name}, false) AS {name}" for name in SEEN],
    )
    repeated = rand_repeats(packets, layout).selectExpr("capture AS _capture", "w AS _w")
    same = F.col("capture").eqNullSafe(F.col("_capture")) & (F.col("w") == F.col("_w"))
    chosen = chosen.join(repeated, same, "left").selectExpr("*", "cast(_w IS NOT NULL AS int) AS rand_repeat")
    return derive(chosen.drop("_capture", "_w"), cfg, layout)


def best_window(feature_rows: DataFrame) -> DataFrame:
    """Most suspicious window per capture of a feature table; the earliest wins ties."""
    scored = feature_rows.withColumn("score", window_score())
    row = F.struct(*scored.columns)
    return (
        scored.groupBy("capture")
        .agg(F.max_by(row, F.struct("score", (-F.col("t_start")).alias("earliest"))).alias("best"))
        .select("best.*")
    )


def apply_overrides(rows: DataFrame, cfg: DetectorConfig) -> DataFrame:
    """Whole-capture evidence written over the features of the chosen window."""
    return rows.withColumns(
        {
            "sctp_abort": F.expr("if(any_abort, 1L, sctp_abort)"),
            "auth_failures": F.greatest("auth_failures", "all_failures"),
            "ng_setup_req": F.expr(f"if(any_rogue, {cfg.rogue_sentinel}L, ng_setup_req)"),
        }
    )


def window_totals(durations: DataFrame, manifest: DataFrame, cfg: DetectorConfig) -> DataFrame:
    """Number of sliding windows (capture, pos, n) of each listed capture, from its length alone."""
    n = F.expr(Layout.sliding(cfg).n_windows).cast("bigint")
    return durations.select("capture", n.alias("n")).join(manifest.select("capture", "pos"), "capture")


def window_ids(labelled_windows: DataFrame, bucket: int = 1_000, totals: DataFrame | None = None) -> DataFrame:
    """Running window number over captures in manifest order, then time: ``<label>_w<n>``.

    ``totals`` (capture, pos, n) saves counting the windows. Positions are cut into buckets. Windows before a bucket come from a running sum over one row
    per bucket; inside a bucket a running sum over its captures gives the rest. The window table
    itself is never sorted in one task.
    """
    if totals is None:
        totals = labelled_windows.groupBy("capture", "pos").agg(F.count("*").alias("n"))
    counts = totals.withColumn("bucket", floor_div(F.col("pos"), bucket))
    region = floor_div(F.col("bucket"), bucket)
    totals = counts.groupBy("bucket").agg(F.sum("n").alias("n")).withColumn("region", region)
    regions = totals.groupBy("region").agg(F.sum("n").alias("n"))
    earlier_regions = regions.select(
        "region",
        (F.sum("n").over(W.orderBy("region")) - F.col("n")).alias("region_offset"),
    )
    earlier_buckets = totals.select(
        "bucket",
        "region",
        (F.sum("n").over(W.partitionBy("region").orderBy("bucket")) - F.col("n")).alias("bucket_offset"),
    )
    offsets = (
        counts.withColumn(
            "inner_offset",
            F.sum("n").over(W.partitionBy("bucket").orderBy("pos", "capture")) - F.col("n"),
        )
        .join(earlier_buckets, "bucket")
        .join(earlier_regions, "region")
        .select("capture", (F.col("region_offset") + F.col("bucket_offset") + F.col("inner_offset")).alias("offset"))
    )
    number = F.col("offset") + F.col("w")
    return (
        labelled_windows.join(offsets, "capture")
        .withColumn("window_no", number)
        .withColumn("window_id", F.concat("label", F.lit("_w"), number.cast("string")))
        .drop("offset")
    )
