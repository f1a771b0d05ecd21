"""Row filters and projections over packets and feature rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from authsignal.config import MODEL_FEATURES, DetectorConfig
from authsignal.functions.columns import carries, filled
from authsignal.operators.features import null_scheme, rogue_setup, watched


def with_message(packets: DataFrame, *codes: int) -> DataFrame:
    """Packets carrying any of the message types."""
    return packets.where(F.arrays_overlap("nas_msg_types", F.array(*[F.lit(code) for code in codes])))


def ng_setups(packets: DataFrame, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    return packets.where(carries("ngap_procedures", cfg.ng_setup))


def aborts(packets: DataFrame, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    return packets.where(carries("sctp_chunk_types", cfg.sctp_abort))


def null_schemes(packets: DataFrame, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """Packets using the null protection scheme, by field or by dissected text."""
    return packets.where(null_scheme(cfg))


def watched_packets(packets: DataFrame, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    return packets.where(watched(cfg))


def with_protocol(packets: DataFrame, pattern: str = "ngap|sctp") -> DataFrame:
    """Packets whose protocol name matches a pattern in any case."""
    return packets.where(F.col("protocol").rlike(f"(?i){pattern}"))


def field_values(packets: DataFrame, field: str) -> DataFrame:
    """Non-empty values of one field, as text."""
    return packets.where(filled(field)).select(
        "capture", "frame_no", F.lit(field).alias("field"), F.col(field).cast("string").alias("value")
    )


def rogue_sources(packets: DataFrame, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """Distinct senders of set-up messages that are not on the allow list."""
    return (
        packets.where(rogue_setup(cfg))
        .groupBy("capture", F.trim("src_ip").alias("src_ip"))
        .agg(F.count("*").alias("setups"))
    )


def message_counts(packets: DataFrame, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """Packets per watched message type and capture; a packet counts once per type."""
    codes = [cfg.auth_request, cfg.auth_failure, cfg.reg_request, cfg.reg_reject, cfg.sec_mode_cmd]
    kept = F.array_intersect("nas_msg_types", F.array(*[F.lit(code) for code in codes]))
    return (
        packets.select("capture", F.explode(kept).alias("message_type"))
        .groupBy("capture", "message_type")
        .agg(F.count("*").alias("packets"))
    )


def model_vector(rows: DataFrame, *keep: str) -> DataFrame:
    """The fifteen model features in their fixed order."""
    return rows.select(*keep, *MODEL_FEATURES)


def last_n(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """Last ``n`` rows of each group. Each task keeps at most ``n`` rows per group before the shuffle."""
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.col(order).desc()))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def first_n(rows: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """First ``n`` rows of each group, with their place in ``seq``."""
    rank = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return rows.withColumn("seq", rank).where(F.col("seq") <= n)
