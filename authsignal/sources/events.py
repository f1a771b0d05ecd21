"""Adapter from the test tables: ``events`` rows become packets, log lines and metric samples.

One day of event time counts as ten seconds of packet time.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from authsignal.config import LABELS, DetectorConfig, ScaleLimits
from authsignal.functions.shared import new_path
from authsignal.sources.captures import with_capture_clock

ADAPTER = replace(DetectorConfig(), unit_us=8_640_000_000, active_packets=10)


def events(spark: SparkSession, folder: str) -> DataFrame:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/events.parquet")


CAPTURE_NAME = "concat(cast(user_id AS string), '-', cast(datediff(ts, DATE'2024-01-01') div 6 AS string))"
CAPTURE = f"{CAPTURE_NAME} AS capture"

FRAME_COLUMNS = (
    CAPTURE,
    "event_id AS frame_no",
    "unix_micros(cast(ts AS timestamp)) AS ts_us",
    "concat('10.10.0.', cast(30 + event_id % 25 AS string)) AS src_ip",
    "'10.10.0.12' AS dst_ip",
    "CASE event_id % 4 WHEN 0 THEN 'SCTP' WHEN 1 THEN 'NGAP' WHEN 2 THEN 'NGAP/NAS-5GS' ELSE 'HTTP2' END AS protocol",
    # every eleventh packet bundles the same message twice and must still count once
    "array_repeat({code}, if(event_id % 11 = 0, 2, 1)) AS nas_msg_types",
    "array_repeat(21, if(event_id % 97 = 0, 1, 0)) AS ngap_procedures",
    "array(if(event_id % 401 = 0, 6, 0)) AS sctp_chunk_types",
    "CASE WHEN event_id % 53 = 0 THEN 0 WHEN event_id % 7 = 0 THEN 1 END AS prot_scheme_id",
    "CASE WHEN event_type = 'click' THEN get_json_object(props, '$.k') END AS rand",
    "cast(64 + event_id % 512 AS int) AS length",
    "concat({base}, {setup}, if(event_id % 401 = 0, ', ABORT', ''), if(event_id % 53 = 0, ', Protection scheme Id: NULL scheme (0)', '')) AS info",
    "user_id AS subscriber",
)
CODE = (
    "CASE event_type WHEN 'click' THEN 86 WHEN 'error' THEN 89 WHEN 'signup' THEN 65 WHEN 'purchase' THEN 93 "
    "ELSE if(event_id % 5 = 0, 68, 103) END"
)
BASE = (
    "CASE event_type WHEN 'click' THEN 'DownlinkNASTransport, Authentication request' "
    "WHEN 'error' THEN 'UplinkNASTransport, Authentication failure (MAC failure)' "
    "WHEN 'signup' THEN 'InitialUEMessage, Registration request' "
    "WHEN 'purchase' THEN 'DownlinkNASTransport, Security mode command' "
    "ELSE if(event_id % 5 = 0, 'DownlinkNASTransport, Registration reject (UE security capabilities mismatch)', 'UplinkNASTransport') END"
)
SETUP = (
    "CASE WHEN event_id % 97 <> 0 THEN '' WHEN event_id % 5 = 0 THEN ', NGSetupFailure' "
    "WHEN event_id % 2 = 0 THEN ', NGSetupResponse' ELSE ', NGSetupRequest' END"
)


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """Packets stamped with wall-clock time only; the capture clock is not attached yet."""
    columns = [c.format(code=CODE, base=BASE, setup=SETUP) for c in FRAME_COLUMNS]
    return events(spark, folder).selectExpr(*columns)


def capture_files(spark: SparkSession, folder: str) -> str:
    """Packets without a capture name, as files in seven folders, and their path."""
    path = new_path(spark, "captures")
    frames(spark, folder).withColumn("folder", F.col("frame_no") % 7).drop("capture").write.partitionBy("folder").parquet(path)
    return path


def packet_stream(spark: SparkSession, folder: str, late: str, files_per_batch: int | None = None) -> DataFrame:
    """The same packets as a stream of event files, with their event time."""
    # as a pattern, the table may be one file or a folder of files
    return _packet_stream(spark, folder, f"{folder}/events.[p]arquet", late, files_per_batch)


def _packet_stream(spark: SparkSession, folder: str, files: str, late: str, files_per_batch: int | None) -> DataFrame:
    columns = [c.format(code=CODE, base=BASE, setup=SETUP) for c in FRAME_COLUMNS]
    reader = spark.readStream.schema(events(spark, folder).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(files).selectExpr("cast(ts AS timestamp) AS ts", *columns).withWatermark("ts", late)


def shuffled_packet_stream(spark: SparkSession, folder: str, late: str, parts: int = 3) -> DataFrame:
    """The packets as a stream of several micro-batches, each of which covers the whole time."""
    path = new_path(spark, "event-files")
    rows, files = events(spark, folder), []
    for part in range(parts):
        rows.where(F.col("event_id") % parts == part).write.parquet(f"{path}/{part}")
        files.append(len(spark.read.parquet(f"{path}/{part}").inputFiles()))
    # however many files a part has, it is one micro-batch
    return _packet_stream(spark, folder, f"{path}/*", late, max(files))


def timings(spark: SparkSession, folder: str) -> DataFrame:
    """When the detection of each capture began and when the response was out, from its events."""
    return frames(spark, folder).groupBy("capture").agg(
        F.max("ts_us").alias("detected_from_us"),
        (F.max("ts_us") + F.count("*") * 1_000_000 + F.sum(F.col("frame_no") % 100) * 10_000).alias("responded_us"),
    )


def packets(spark: SparkSession, folder: str, limits: ScaleLimits = ScaleLimits()) -> DataFrame:
    return with_capture_clock(frames(spark, folder), limits)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One listed capture per customer: capture, label and position."""
    key = F.col("c_custkey")
    labels = F.array(*[F.lit(label) for label in LABELS])
    return spark.read.parquet(f"{folder}/customer.parquet").select(
        F.concat(key.cast("string"), F.lit("-"), (key % 5).cast("string")).alias("capture"),
        F.element_at(labels, (key % 6 + 1).cast("int")).alias("label"),
        key.alias("pos"),
    )


SUCI = (
    "if(event_id % 53 = 0, concat('suci-0-001-01-0000-0-0-', lpad(cast(user_id AS string), 10, '0')), "
    "concat('suci-0-001-01-0000-1-1-', md5(cast(user_id AS string))))"
)
ADDRESS = "concat('10.10.0.', cast(30 + event_id % 25 AS string))"
MESSAGE = (
    f"CASE WHEN event_id % 97 = 0 THEN concat('gNB-N2 accepted[', {ADDRESS}, ']:38412 in ng-path module') "
    f"WHEN event_id % 193 = 0 THEN concat('gNB-N2[', {ADDRESS}, '] connection refused!!!') "
    f"WHEN event_type = 'error' THEN concat('[', {SUCI}, '] Authentication failure [MAC failure]') "
    f"WHEN event_type = 'view' THEN concat('[', {SUCI}, '] Registration reject [23]') "
    f"WHEN event_type = 'purchase' THEN concat('[', {SUCI}, '] Authentication reject') "
    "WHEN event_type = 'signup' THEN concat('UE SUPI[imsi-00101', lpad(cast(user_id AS string), 10, '0'), '] DNN[internet] S_NSSAI[SST:1 SD:0x1]') "
    f"ELSE concat('[', {SUCI}, '] Unknown UE by SUCI') END"
)


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """AMF log lines, one per event, with terminal colours and without a year.

    Every 31st is a continuation line without any of that, and every 59th belongs to a capture that
    has no packets.
    """
    line = (
        f"if(event_id % 31 = 0, concat('  continued: ', {MESSAGE}), "
        "concat('\x1b[32m', date_format(ts, 'MM/dd HH:mm:ss.SSS'), '\x1b[0m: [\x1b[33m', if(event_type = 'signup', 'gmm', 'amf'), "
        "'\x1b[0m] \x1b[1;36m', if(event_type IN ('error', 'view', 'purchase'), 'WARNING', 'INFO'), '\x1b[0m: ', "
        f"{MESSAGE}, ' (context.c:', cast(100 + event_id % 900 AS string), ')')) AS line"
    )
    return events(spark, folder).selectExpr(
        f"if(event_id % 59 = 0, concat('log-', cast(user_id AS string)), {CAPTURE_NAME}) AS capture",
        "concat('amf-', cast(user_id % 10 AS string)) AS source", "event_id AS seq", line
    )


def log_files(spark: SparkSession, folder: str) -> str:
    """The log lines as text files, a folder for each source and day in it, and their path."""
    path = new_path(spark, "logs")
    day = events(spark, folder).select(F.col("event_id").alias("seq"), F.to_date("ts").alias("day"))
    rows = log_lines(spark, folder).join(day, "seq").repartition("source", "day").sortWithinPartitions("source", "day", "seq")
    rows.select("source", "day", "line").write.partitionBy("source", "day").text(path)
    return path


def log_lines_over_new_year(spark: SparkSession, folder: str) -> DataFrame:
    """The log lines, all fifteen days earlier: from the middle of December to the middle of January."""
    moved = "date_format(ts - INTERVAL 15 DAYS, 'MM/dd HH:mm:ss.SSS')"
    line = (
        f"if(event_id % 31 = 0, concat('  continued: ', {MESSAGE}), "
        f"concat({moved}, ': [amf] INFO: ', {MESSAGE}, ' (context.c:', cast(100 + event_id % 900 AS string), ')')) AS line"
    )
    return events(spark, folder).selectExpr("concat('amf-', cast(user_id % 10 AS string)) AS source", "event_id AS seq", line)


def summary_lines(packets: DataFrame, unit_us: int) -> DataFrame:
    """Packet-summary text lines: ``no time src → dst proto len info``."""
    return packets.selectExpr(
        "capture",
        "frame_no AS seq",
        f"concat(lpad(cast(frame_no AS string), 8, ' '), '   ', format_string('%.6f', rel_us / {float(unit_us)}D), '   ', "
        "src_ip, ' → ', dst_ip, '   ', protocol, ' ', cast(length AS string), ' ', info) AS line",
    )


def metric_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Counter samples; one of the six counters never reports."""
    return events(spark, folder).selectExpr(
        "CASE event_type WHEN 'signup' THEN 'reg_init_req' WHEN 'purchase' THEN 'reg_init_succ' WHEN 'view' THEN 'reg_init_fail' "
        "WHEN 'click' THEN 'auth_req' ELSE 'auth_fail' END AS name",
        "map('instance', concat('amf-', cast(user_id % 10 AS string))) AS labels",
        "CASE WHEN event_id % 3 <> 0 THEN value END AS value",
        "cast(ts AS timestamp) AS ts",
        CAPTURE,
    )
