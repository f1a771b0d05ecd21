"""Structured Streaming forms of the window features, rules, overrides, rate limit and alerts.

Event time is the packet's wall-clock ``ts``: the watermark is shared by all captures, so
capture-relative time cannot drive it. Stream windows are therefore aligned to the clock, not to
the start of a capture, and empty windows are not emitted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from authsignal.config import DetectorConfig, ScaleLimits
from authsignal.operators.features import COUNTERS, conditions, null_scheme, rate_columns, rogue_setup, watched
from authsignal.operators.forest import predict
from authsignal.operators.metrics import event_log
from authsignal.operators.rules import online_class
from authsignal.schemas import PACKET


def packet_stream(spark: SparkSession, folder: str, late: str = "1 minute", files_per_batch: int | None = None) -> DataFrame:
    """Packets arriving as parquet files, with the bound for late data."""
    reader = spark.readStream.schema(PACKET)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder).withWatermark("ts", late)


def window_features(
    packets: DataFrame,
    cfg: DetectorConfig = DetectorConfig(),
    size: str = "30 seconds",
    step: str = "10 seconds",
    seconds: float = 30.0,
) -> DataFrame:
    """Counts, flags and rates per capture and clock window, combined before the shuffle.

    Streams cannot count distinct values, so packets are first counted per RAND value and then
    per window; both steps use the same watermark.
    """
    tests = conditions(cfg)
    flags = {"null_seen": null_scheme(cfg), "watched_seen": watched(cfg), "any_rogue": rogue_setup(cfg)}
    per_value = packets.groupBy(F.window("ts", size, step).alias("span"), "capture", "rand").agg(
        *[F.expr(f"count_if({tests[name]}) AS {name}") for name in COUNTERS],
        *[F.expr(f"bool_or({test}) AS {name}") for name, test in flags.items()],
    )
    per_window = per_value.groupBy("span", "capture").agg(
        *[F.sum(name).alias(name) for name in COUNTERS],
        *[F.expr(f"bool_or({name}) AS {name}") for name in flags],
        F.expr("bool_or(rand IS NOT NULL AND rand <> '' AND total_packets > 1) AS repeated"),
    )
    rows = per_window.selectExpr(
        "capture",
        "span.start AS t_start",
        "span.end AS t_end",
        "window_time(span) AS closed_at",
        *COUNTERS,
        "any_rogue",
        "cast(null_seen AND watched_seen AS int) AS suci_unencrypted",
        "cast(repeated AS int) AS rand_repeat",
        f"{seconds}D AS duration",
        f"cast(total_packets > {cfg.active_packets} AS int) AS is_active",
    )
    return rate_columns(rows)


def score_windows(
    windows: DataFrame, cfg: DetectorConfig = DetectorConfig(), model: PipelineModel | None = None
) -> DataFrame:
    """Online rules on stream windows; with a model, the windows no rule decides are predicted."""
    rows = windows.withColumn(
        "ng_setup_req", F.expr(f"if(any_rogue, {cfg.rogue_sentinel}L, ng_setup_req)")
    )
    if model is None:
        return rows.withColumn("prediction", online_class(cfg))
    scored = predict(model, rows)
    sure = F.when(F.col("model_confidence") < cfg.confidence_gate, F.lit("unknown")).otherwise(F.col("model_class"))
    return scored.withColumn("prediction", online_class(cfg, otherwise=sure))


def running_overrides(packets: DataFrame, cfg: DetectorConfig = DetectorConfig(), keep: str = "1 day") -> DataFrame:
    """Whole-capture evidence so far, per capture and stretch of ``keep``; write in update mode.

    A stretch is forgotten once the watermark has passed it, so the state is bounded by what arrives
    in ``keep``; a capture that goes on for longer has a row for each stretch.
    """
    tests = conditions(cfg)
    return packets.groupBy("capture", F.window("ts", keep).alias("stretch")).agg(
        F.expr(f"count_if({tests['auth_failures']}) AS all_failures"),
        F.expr(f"bool_or({tests['sctp_abort']}) AS any_abort"),
        F.expr(f"bool_or({rogue_setup(cfg)}) AS any_rogue"),
    )


# a row of the limiter: who, when and what, then what was known of it before the batch
WHO, WHEN, COUNTS = ["unnamed", "subscriber"], "at_us", ["attempts", "failures"]


def _counted(rows: np.ndarray) -> np.ndarray:
    """One column per subscriber and instant, in that order, with the other entries added up."""
    rows = rows[:, np.lexsort(rows[2::-1])]
    first = np.flatnonzero(np.append(True, (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)))
    return np.vstack([rows[:3, first], np.add.reduceat(rows[3:], first, axis=1)])


def _limiter(cfg: DetectorConfig) -> Callable:
    """State per (group of subscribers, time shard): the counts of every instant in the shard and the one before.

    Groups are worked through as arrays: what a call costs is shared by all subscribers of the group.
    """
    width = cfg.rate_window_seconds * 1_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        shard = int(key[1])
        # every arriving batch shrinks to one row per subscriber and instant before the next one is read
        parts = [_counted(b[[*WHO, WHEN, *COUNTS]].to_numpy(dtype="int64").T) for b in batches]
        parts = [np.vstack([part, np.zeros((3, part.shape[1]), dtype="int64")]) for part in parts]
        if state.exists:
            known = np.frombuffer(state.get[0], dtype="<i8").reshape(5, -1)
            parts.append(np.vstack([known, known[3:], np.ones((1, known.shape[1]), dtype="int64")]))
        rows = _counted(np.hstack(parts))
        state.update((np.ascontiguousarray(rows[:5], dtype="<i8").tobytes(),))
        state.setTimeoutTimestamp(max((shard + 2) * width // 1000, state.getCurrentWatermarkMs() + 1))
        # all subscribers on one line, three windows apart, so that no window reaches the one before
        person = np.append(0, np.cumsum((rows[:2, 1:] != rows[:2, :-1]).any(axis=0)))
        line = person * 3 * width + rows[2] - (shard - 2) * width
        own = np.flatnonzero(rows[2] // width == shard)
        since = np.searchsorted(line, line[own] - width, side="left")
        running = np.pad(rows[3:7].cumsum(axis=1), ((0, 0), (1, 0)))
        windows = running[:, own + 1] - running[:, since]
        changed = (rows[7, own] == 0) | (windows[:2] != windows[2:]).any(axis=0)
        if changed.any():
            unnamed, subscriber, at_us = rows[:3, own[changed]]
            attempts, failures = windows[:2, changed]
            yield pd.DataFrame(
                {
                    "subscriber": pd.arrays.IntegerArray(subscriber, unnamed == 1) if unnamed.any() else subscriber,
                    "at_us": at_us,
                    "attempts": attempts,
                    "failures": failures,
                    "over_limit": attempts > cfg.max_attempts,
                    "blocked": failures >= cfg.block_failures,
                }
            )

    return step


def rate_limiter(packets: DataFrame, cfg: DetectorConfig = DetectorConfig(), limits: ScaleLimits = ScaleLimits()) -> DataFrame:
    """Attempts and failures of a subscriber in the window up to each instant, as they arrive.

    Time is cut into shards as long as the window, each packet also going to the next shard as
    context. One busy subscriber is so spread over groups. Subscribers are dealt to
    ``limits.rate_groups`` groups by hash, and the state of a group is bounded by the instants that its
    subscribers have in two windows.

    The rows are changes: a late packet makes every instant whose window it falls into appear again
    with new counts. The last row of a (subscriber, instant) is the valid one; ``commits.latest``
    picks it from a committed table.
    """
    tests = conditions(cfg)
    width = cfg.rate_window_seconds * 1_000_000
    shards = (
        packets.where(f"{tests['auth_requests']} OR {tests['auth_failures']}")
        .selectExpr(
            f"cast(pmod(xxhash64(subscriber), {limits.rate_groups}) AS int) AS part",
            "cast(subscriber IS NULL AS bigint) AS unnamed",
            "coalesce(subscriber, 0L) AS subscriber",
            "ts",
            "unix_micros(ts) AS at_us",
            f"cast({tests['auth_requests']} AS bigint) AS attempts",
            f"cast({tests['auth_failures']} AS bigint) AS failures",
        )
        .selectExpr("*", f"explode(array(at_us div {width}, at_us div {width} + 1)) AS shard")
        .select("part", "shard", "unnamed", "subscriber", "ts", "at_us", "attempts", "failures")
    )
    return shards.groupBy("part", "shard").applyInPandasWithState(
        _limiter(cfg),
        outputStructType="subscriber long, at_us long, attempts long, failures long, over_limit boolean, blocked boolean",
        stateStructType="counts binary",
        outputMode="append",
        timeoutConf=GroupStateTimeout.EventTimeTimeout,
    )


def alerts(scored: DataFrame) -> DataFrame:
    """One alert per capture and class for as long as the watermark waits for late packets."""
    attacks = scored.where("prediction NOT IN ('normal', 'model')").select("capture", "prediction", "closed_at")
    return attacks.dropDuplicatesWithinWatermark(["capture", "prediction"])


def alert_sink(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write alerts as JSON and as log lines. A batch that is replayed replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{folder}/json/batch={number}")
        lines = event_log(batch.withColumnRenamed("closed_at", "logged_at"))
        lines.select("line").write.mode("overwrite").text(f"{folder}/log/batch={number}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
