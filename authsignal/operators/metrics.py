"""Metric rows, text exposition, counters and dashboard bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from authsignal.config import CLASS_CODES, CLASS_TEXT, COUNTER_NAMES
from authsignal.functions.columns import first_match

# ---- fixed values: metric names and help texts ----
METRIC_HELP = {
    "detection_prediction": "Attack type detected",
    "detection_confidence": "Detection confidence score",
    "detection_response_time": "Response time in seconds",
    "mitigation_applied": "Mitigation applied",
    "pipeline_total_captures": "Total captures processed",
    "pipeline_avg_response_time": "Average response time",
}


def class_code(prediction: Column) -> Column:
    """Number of a class; classes without one give -1."""
    return first_match([(prediction == name, F.lit(code)) for name, code in CLASS_CODES.items()], F.lit(-1))


def class_text(code: Column) -> Column:
    return first_match([(code == number, text) for number, text in CLASS_TEXT.items()], "Unknown")


def metric_rows(detections: DataFrame) -> DataFrame:
    """Four gauges per detection."""
    capture = F.create_map(F.lit("capture"), F.col("capture"))
    attack = F.create_map(F.lit("capture"), F.col("capture"), F.lit("attack"), F.col("prediction"))
    gauges = F.array(
        F.struct(F.lit("detection_prediction").alias("name"), capture.alias("labels"), class_code(F.col("prediction")).cast("double").alias("value")),
        F.struct(F.lit("detection_confidence").alias("name"), capture.alias("labels"), F.col("confidence").cast("double").alias("value")),
        F.struct(F.lit("detection_response_time").alias("name"), capture.alias("labels"), F.col("response_time").cast("double").alias("value")),
        F.struct(F.lit("mitigation_applied").alias("name"), attack.alias("labels"), F.lit(1.0).alias("value")),
    )
    return detections.select("capture", F.explode(gauges).alias("m")).select("capture", "m.name", "m.labels", "m.value")


def label_text(labels: Column) -> Column:
    """Labels as ``key="value"`` pairs in their written order; a null value is an empty one."""

    def escaped(value: Column) -> Column:
        for raw, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
            value = F.replace(value, F.lit(raw), F.lit(shown))
        return F.coalesce(value, F.lit(""))

    pairs = F.transform(F.map_entries(labels), lambda e: F.concat(e["key"], F.lit('="'), escaped(e["value"]), F.lit('"')))
    return F.array_join(pairs, ",")


def _shown(value: Column) -> Column:
    """The number in full, as the text format writes it."""
    return (
        F.when(F.isnan(value), "NaN")
        .when(F.abs(value) == float("inf"), F.when(value > 0, "+Inf").otherwise("-Inf"))
        .otherwise(F.regexp_replace(value.cast("string"), "[.]0$", ""))
    )


def _with_lines(rows: DataFrame) -> DataFrame:
    """Samples that have a value, with their label text (``series``), HELP, TYPE and sample line.

    Rows without ``labels``, as the summary's, have none.
    """
    if "labels" not in rows.columns:
        rows = rows.withColumn("labels", F.create_map().cast("map<string,string>"))
    help_text = first_match([(F.col("name") == name, text) for name, text in METRIC_HELP.items()], "")
    series = label_text(F.col("labels"))
    braced = F.when(F.size("labels") > 0, F.concat(F.lit("{"), series, F.lit("}"))).otherwise(F.lit(""))
    return rows.where(F.col("value").isNotNull()).withColumns(
        {
            "series": series,
            "help_line": F.concat(F.lit("# HELP "), "name", F.lit(" "), help_text),
            "type_line": F.concat(F.lit("# TYPE "), "name", F.lit(" gauge")),
            "sample_line": F.concat("name", braced, F.lit(" "), _shown(F.col("value"))),
        }
    )


def exposition(rows: DataFrame) -> DataFrame:
    """Text exposition sample by sample: each with its HELP, TYPE and value line, in ``part`` order."""
    keys = [c for c in ("capture",) if c in rows.columns]
    lines = F.array("help_line", "type_line", "sample_line")
    return _with_lines(rows).select(*keys, "name", F.posexplode(lines).alias("part", "value"))


def exposition_files(rows: DataFrame) -> DataFrame:
    """One exposition over any number of files: lines (name, series, part, value), each header once.

    The samples are dealt by ranges of (family, series) and sorted, so a family lies in one file or
    in files that follow each other, and only its first sample brings the header. That sample is
    known from a table with one row per family, which is as short as the list of metric names. Of
    several samples of one series, which a parser refuses, the one with the largest value is exposed.
    """
    series = _with_lines(rows).groupBy("name", "series").agg(
        *[F.max_by(line, "value").alias(line) for line in ("help_line", "type_line", "sample_line")]
    )
    first = series.groupBy(F.col("name").alias("family")).agg(F.min("series").alias("first_series"))
    marked = series.join(first, F.col("name") == F.col("family"))
    ordered = marked.repartitionByRange("name", "series").sortWithinPartitions("name", "series")
    header = F.when(F.col("series") == F.col("first_series"), F.array("help_line", "type_line")).otherwise(F.array().cast("array<string>"))
    lines = F.transform(F.concat(header, F.array("sample_line")), lambda line: F.struct(F.when(line.startswith("# HELP "), 0).when(line.startswith("# TYPE "), 1).otherwise(2).alias("part"), line.alias("value")))
    return ordered.select("name", "series", F.inline(lines))


def metric_summary(detections: DataFrame) -> DataFrame:
    """Total captures and mean response time as two gauges without labels."""
    whole = detections.agg(
        F.count("*").cast("double").alias("total"),
        F.bround(F.coalesce(F.avg("response_time"), F.lit(0.0)), 4).alias("mean"),
    )
    return whole.select(
        F.explode(
            F.array(
                F.struct(F.lit("pipeline_total_captures").alias("name"), F.col("total").alias("value")),
                F.struct(F.lit("pipeline_avg_response_time").alias("name"), F.col("mean").alias("value")),
            )
        ).alias("m")
    ).select("m.name", "m.value")


def latest(samples: DataFrame, *keys: str) -> DataFrame:
    """Last non-null value per key; a series has one value per instant."""
    return samples.where(F.col("value").isNotNull()).groupBy(*keys).agg(
        F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts")
    )


def latest_counters(samples: DataFrame) -> DataFrame:
    """Latest value of each of the six counters; one that never reported is 0.0."""
    found = latest(samples.where(F.col("name").isin(*COUNTER_NAMES)), "name").select("name", "value")
    names = samples.sparkSession.createDataFrame([(n,) for n in COUNTER_NAMES], "name string")
    return F.broadcast(names).join(found, "name", "left").select("name", F.coalesce("value", F.lit(0.0)).alias("value"))


def counter_delta(samples: DataFrame, started: Column, ended: Column) -> DataFrame:
    """Counter values before and after a run and their difference; a missing value counts as 0.0."""
    known = samples.where(F.col("name").isin(*COUNTER_NAMES) & F.col("value").isNotNull() & (F.col("ts") < ended))
    early = F.col("ts") < started
    found = known.groupBy("name").agg(
        F.max_by(F.when(early, F.col("value")), F.when(early, F.col("ts"))).alias("before"),
        F.max_by("value", "ts").alias("after"),
    )
    names = samples.sparkSession.createDataFrame([(n,) for n in COUNTER_NAMES], "name string")
    filled = F.broadcast(names).join(found, "name", "left").select(
        "name",
        F.coalesce("before", F.lit(0.0)).alias("before"),
        F.coalesce("after", F.lit(0.0)).alias("after"),
    )
    return filled.withColumn("delta", F.col("after") - F.col("before"))


def bands(detections: DataFrame) -> DataFrame:
    """Dashboard bands of confidence and response time, and the class text."""
    confidence, seconds = F.col("confidence"), F.col("response_time")
    return detections.select(
        "capture",
        first_match([(confidence < 0.65, "red"), (confidence < 0.85, "yellow")], "green").alias("confidence_band"),
        first_match([(seconds.isNull(), None), (seconds < 30, "green"), (seconds < 60, "yellow")], "red").alias("time_band"),
        class_text(class_code(F.col("prediction"))).alias("class_text"),
    )


def result_table(detections: DataFrame) -> DataFrame:
    """Summary table: capture, class, method, confidence, time."""
    return detections.select(
        "capture",
        F.col("prediction").alias("detected"),
        "method",
        F.bround("confidence", 2).alias("confidence"),
        F.bround("response_time", 1).alias("seconds"),
    )


def event_log(detections: DataFrame) -> DataFrame:
    """Log lines of a detection: ``[time] [LEVEL] message``."""
    attack = F.col("prediction") != "normal"
    level = F.when(attack, "ALERT").otherwise("INFO")
    message = F.when(attack, F.concat(F.lit("ATTACK DETECTED: "), F.upper("prediction"))).otherwise("Normal traffic")
    return detections.select(
        "capture",
        level.alias("level"),
        F.concat(F.lit("["), F.date_format("logged_at", "yyyy-MM-dd HH:mm:ss"), F.lit("] ["), level, F.lit("] "), message).alias("line"),
    )
