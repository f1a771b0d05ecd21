"""Response planning. A plan is data: nothing here touches a network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from authsignal.config import ATTACKS, UNKNOWN, DetectorConfig
from authsignal.functions.columns import carries, filled, first_match
from authsignal.operators.features import rogue_setup

# ---- fixed values: actions of the online detector per class ----
ONLINE_ACTIONS = {
    "brute_force": ("rate_limiting", "attacker_ue_blocked", "alert_generated"),
    "supi_harvest": ("null_scheme_rejected", "suci_encryption_enforced", "alert_generated"),
    "bidding_down": ("null_integrity_blocked", "null_ciphering_blocked", "alert_generated"),
    "replay": ("sqn_strict_mode", "rand_replay_detection", "alert_generated"),
    "false_bs": ("rogue_gnb_disconnected", "ip_flagged", "alert_generated"),
}

# ---- fixed values: responder plan per class: technique, target, actions ----
RESPONDER_PLAN = {
    "brute_force": (
        "FGT1110.001",
        "imsi-001010000000099",
        ("rate_limiting_enforced", "attacker_ue_blocked", "security_alert_generated"),
    ),
    "supi_harvest": (
        "FGT5019",
        "suci-0-001-01-0000-0-0-0000000003",
        ("null_scheme_rejection_enforced", "udm_encryption_policy_verified", "suci_exposure_alert_generated"),
    ),
    "bidding_down": (
        "FGT5004",
        "ue-null-security-capabilities",
        ("null_integrity_blocked", "null_ciphering_blocked", "security_policy_enforced", "mismatch_auto_reject_enabled"),
    ),
    "replay": (
        "FGT1040",
        "amf-authentication-handler",
        ("sqn_strict_validation_enabled", "rand_replay_detection_active", "sctp_abort_triggered", "auth_sequence_incremented"),
    ),
    "false_bs": (
        "FGT1588.501",
        "10.10.0.50 (TAC=99)",
        ("unauthorized_ip_flagged", "ngsetup_policy_enforced", "gnb_auth_verification_enabled"),
    ),
}
ROGUE_ACTIVE, ROGUE_INACTIVE = "rogue_gnb_terminated", "rogue_gnb_not_active"


def _texts(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def online_actions(prediction: Column, cfg: DetectorConfig = DetectorConfig()) -> Column:
    """Action list for a class; anything without a plan needs no action."""
    rules = [(prediction == name, _texts(actions)) for name, actions in ONLINE_ACTIONS.items()]
    rules.append((prediction == UNKNOWN, _texts([cfg.unknown_action])))
    return first_match(rules, _texts(["no_action"]))


def response_plan(detections: DataFrame, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    return detections.withColumn("actions", online_actions(F.col("prediction"), cfg))


def plan_table(spark: SparkSession) -> DataFrame:
    """The responder plan as a table: one row per attack class."""
    rows = [(name, technique, target, list(actions)) for name, (technique, target, actions) in RESPONDER_PLAN.items()]
    return spark.createDataFrame(rows, "attack_type string, technique string, target string, actions array<string>")


def rogue_actions(active: Column) -> Column:
    """Actions against a rogue base station, led by whether it was seen active."""
    first = F.when(active, F.lit(ROGUE_ACTIVE)).otherwise(F.lit(ROGUE_INACTIVE))
    return F.concat(F.array(first), _texts(RESPONDER_PLAN["false_bs"][2]))


def responder_plan(detections: DataFrame) -> DataFrame:
    """Full plan per detected attack: technique, target, actions. The plan table has five rows."""
    plan = plan_table(detections.sparkSession)
    planned = detections.join(F.broadcast(plan), detections.prediction == plan.attack_type)
    if "any_rogue" in detections.columns:
        planned = planned.withColumn(
            "actions",
            F.when(F.col("attack_type") == "false_bs", rogue_actions(F.col("any_rogue"))).otherwise(F.col("actions")),
        )
    return planned


def response_events(planned: DataFrame, timestamp: Column | None = None) -> DataFrame:
    """One event per planned response; success is recorded, not measured."""
    return planned.select(
        "capture",
        (timestamp if timestamp is not None else F.current_timestamp()).alias("timestamp"),
        "attack_type",
        "actions",
        "target",
        F.lit(True).alias("success"),
    )


def response_summary(planned: DataFrame) -> DataFrame:
    """Responses per attack class with zeros kept, and a done mark."""
    classes = planned.sparkSession.createDataFrame([(name,) for name in ATTACKS], "attack_type string")
    counts = planned.groupBy("attack_type").agg(F.count("*").alias("n"))
    merged = counts.unionByName(classes.withColumn("n", F.lit(0).cast("bigint")))
    return (
        merged.where(F.col("attack_type").isin(*ATTACKS))
        .groupBy("attack_type")
        .agg(F.sum("n").alias("responses"))
        .withColumn("done", F.col("responses") > 0)
    )


def block_list(packets: DataFrame, detections: DataFrame, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """Distinct subscribers and base stations to block, from what the flagged captures contain.

    Subscribers come from failed authentications in brute-force captures, base stations from
    unlisted set-ups in false-base-station captures. Both are reduced to distinct values before
    they meet the detections, so no hot capture reaches a join.
    """
    subscribers = packets.where(carries("nas_msg_types", cfg.auth_failure) & filled("subscriber")).select(
        "capture", F.lit("brute_force").alias("prediction"), F.lit("imsi").alias("kind"),
        F.concat(F.lit("imsi-00101"), F.lpad(F.col("subscriber").cast("string"), 10, "0")).alias("identity"),
    )
    stations = packets.where(rogue_setup(cfg)).select(
        "capture", F.lit("false_bs").alias("prediction"), F.lit("gnb").alias("kind"), F.trim("src_ip").alias("identity")
    )
    seen = subscribers.unionByName(stations).distinct()
    flagged = detections.select("capture", "prediction")
    return seen.join(flagged, ["capture", "prediction"], "left_semi").select("kind", "identity").distinct()


def rate_limits(packets: DataFrame, cfg: DetectorConfig = DetectorConfig(), time: str | None = None) -> DataFrame:
    """Attempts and failures of a subscriber in the window up to each instant, and the decision.

    A packet adds to the running count when it happens and takes itself back one microsecond after
    the window has passed it, so a plain running sum gives the rolling count in linear time, also
    where one subscriber floods a window. Time is cut into buckets as long as the window: whatever
    happened in a bucket is still counted when the next one opens, and is taken back during it. A
    busy subscriber is so split over time, and packets of one instant merge before the shuffle.
    """
    if time is None:
        time = "ts_us" if "ts_us" in packets.columns else "unix_micros(ts)"
    width = cfg.rate_window_us
    attempt = f"coalesce(array_contains(nas_msg_types, {cfg.auth_request}), false)"
    failure = f"coalesce(array_contains(nas_msg_types, {cfg.auth_failure}), false)"
    steps = (
        packets.where(f"{attempt} OR {failure}")
        .selectExpr(
            "subscriber",
            f"{time} AS at",
            f"{time} div {width} AS home",
            f"cast({attempt} AS bigint) AS a",
            f"cast({failure} AS bigint) AS f",
        )
        .selectExpr(
            "subscriber",
            "home",
            "inline(array("
            "struct(home AS bucket, at AS at_us, a AS attempts, f AS failures, true AS own),"
            f"struct(home + 1 AS bucket, (home + 1) * {width} AS at_us, a AS attempts, f AS failures, false AS own),"
            f"struct((at + {width} + 1) div {width} AS bucket, at + {width} + 1 AS at_us, -a AS attempts, -f AS failures, false AS own)))",
        )
        # what the last microsecond of a bucket would take back lies past the next bucket
        .where("bucket <= home + 1")
        .groupBy("subscriber", "bucket", "at_us")
        .agg(F.sum("attempts").alias("attempts"), F.sum("failures").alias("failures"), F.max("own").alias("own"))
    )
    running = W.partitionBy("subscriber", "bucket").orderBy("at_us").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        steps.withColumn("attempts", F.sum("attempts").over(running))
        .withColumn("failures", F.sum("failures").over(running))
        .where("own")
        .selectExpr(
            "subscriber",
            "at_us",
            "attempts",
            "failures",
            f"attempts > {cfg.max_attempts} AS over_limit",
            f"failures >= {cfg.block_failures} AS blocked",
        )
    )


def mean_response(detections: DataFrame) -> DataFrame:
    """Captures and mean response time; no capture gives zero."""
    return detections.agg(
        F.count("*").alias("captures"),
        F.bround(F.coalesce(F.avg("response_time"), F.lit(0.0)), 4).alias("mean_response"),
    )
