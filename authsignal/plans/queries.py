"""Queries over the test tables, one per operator: ``(spark, folder) -> DataFrame``."""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from authsignal.config import LABELS, MODEL_FEATURES, TRAINING_FEATURES
from authsignal.functions.shared import new_path, written
from authsignal.operators import augment, evaluate, evidence, filters, forest, logtime, metrics, respond, rules, windows
from authsignal.operators.features import (
    FEATURE_COLUMNS,
    Layout,
    rand_repeats,
    rate_columns,
    sliding_features,
    tumbling_features,
)
from authsignal.plans import detection, training
from authsignal.sources import captures, sinks, tails
from authsignal.sources import events as ev
from authsignal.streaming import captures as stream_captures
from authsignal.streaming import commits, jobs

CFG = ev.ADAPTER
KEY = ("capture", "w")
SINCE = "2024-01-10 00:00:00"
STARTED, ENDED = "2024-01-16 00:00:00", "2024-01-26 00:00:00"
YEAR = 2024
TREES = 200
STREAM = replace(CFG, unit_us=1_000_000, rate_window_seconds=CFG.rate_window_us // 1_000_000)
LATE, SPAN, STEP, STRETCH, EVER = "1 day", "3 days", "1 day", "10 days", "1000 days"
GAP_SECONDS = 6 * 86_400  # a capture of the test tables has ended when none of its packets came for so long


def _since(text: str):
    return F.lit(text).cast("timestamp")


def _sliding(spark, folder) -> DataFrame:
    return sliding_features(ev.packets(spark, folder), CFG)


def _labelled(spark, folder) -> DataFrame:
    """Sliding windows labelled by the simple rules."""
    return _sliding(spark, folder).withColumn("label", rules.simple_class())


def _stored(spark, folder) -> DataFrame:
    """Labelled windows written once, for work that reads them several times."""
    return written(_labelled(spark, folder), "windows")


def _judged(spark, folder) -> DataFrame:
    """Labels from the simple rules, predictions from the weighted rules."""
    return rules.with_weighted_scores(_labelled(spark, folder)).withColumn("prediction", rules.weighted_class())


def _truth(spark, folder) -> DataFrame:
    """Labels from the offline rules, with the plain and weighted verdicts beside them."""
    rows = rules.with_weighted_scores(_sliding(spark, folder))
    return (
        rows.withColumn("label", rules.offline_class(otherwise="normal"))
        .withColumn("simple", rules.simple_class())
        .withColumn("weighted", rules.weighted_class())
    )


def _detections(spark, folder) -> DataFrame:
    return detection.detect_without_model(ev.packets(spark, folder), CFG, timings=ev.timings(spark, folder))


def _parsed(spark, folder) -> DataFrame:
    return evidence.parse_amf(ev.log_lines(spark, folder), YEAR)


def _timed(spark, folder) -> DataFrame:
    """Parsed lines, those without a stamp with the time of the line they continue."""
    return logtime.with_line_times(_parsed(spark, folder), first_year=YEAR, block=1_000)


# ---- scans ----
def scan_packets(spark, folder):
    return ev.frames(spark, folder).select(
        "capture",
        "frame_no",
        "ts_us",
        "src_ip",
        "dst_ip",
        "protocol",
        F.array_join(F.col("nas_msg_types").cast("array<string>"), ",").alias("nas_types"),
        F.array_join(F.col("ngap_procedures").cast("array<string>"), ",").alias("procedures"),
        F.array_join(F.col("sctp_chunk_types").cast("array<string>"), ",").alias("chunks"),
        "prot_scheme_id",
        "rand",
        "length",
        "info",
    )


def labelled_packets(spark, folder):
    rows = captures.label_packets(ev.frames(spark, folder), ev.manifest(spark, folder))
    return rows.select("capture", "frame_no", "label")


def missing_captures(spark, folder):
    return captures.missing_captures(ev.frames(spark, folder), ev.manifest(spark, folder)).select("capture", "label", "pos")


def log_parse(spark, folder):
    return _parsed(spark, folder).select(
        "capture", "source", "seq", F.unix_micros("ts").alias("ts_us"), "stamp", "module", "level", "message", "place", "parsed"
    )


def summary_parse(spark, folder):
    lines = ev.summary_lines(ev.packets(spark, folder), 1_000_000)
    return evidence.parse_summary(lines).select(
        "capture", "frame_no", "seconds", "src_ip", "dst_ip", "protocol", "length", "info"
    )


def metric_latest(spark, folder):
    return metrics.latest_counters(ev.metric_samples(spark, folder))


def metric_last_per_capture(spark, folder):
    return metrics.latest(ev.metric_samples(spark, folder), "capture", "name").select(
        "capture", "name", "value", F.unix_micros("ts").alias("ts_us")
    )


# ---- filters and projections ----
def time_slice(spark, folder):
    rows = windows.time_slice(
        ev.packets(spark, folder), 10 * CFG.unit_us, 40 * CFG.unit_us, F.col("protocol") == "NGAP"
    )
    return rows.select("capture", "frame_no", "rel_us")


def message_type_counts(spark, folder):
    return filters.message_counts(ev.frames(spark, folder), CFG)


def message_packets(spark, folder):
    rows = filters.with_message(ev.frames(spark, folder), CFG.auth_request, CFG.reg_reject)
    return rows.select("capture", "frame_no", F.element_at("nas_msg_types", 1).alias("message_type"))


def ng_setup_packets(spark, folder):
    return filters.ng_setups(ev.frames(spark, folder), CFG).select("capture", "frame_no", "src_ip")


def abort_packets(spark, folder):
    return filters.aborts(ev.frames(spark, folder), CFG).select("capture", "frame_no", "ts_us")


def null_scheme_packets(spark, folder):
    return filters.null_schemes(ev.frames(spark, folder), CFG).select("capture", "frame_no", "info")


def watched_packets(spark, folder):
    return filters.watched_packets(ev.frames(spark, folder), CFG).select("capture", "frame_no", "src_ip", "dst_ip")


def protocol_counts(spark, folder):
    return filters.with_protocol(ev.frames(spark, folder)).groupBy("capture", "protocol").agg(F.count("*").alias("packets"))


def field_values(spark, folder):
    frames = ev.frames(spark, folder)
    rows = filters.field_values(frames, "src_ip")
    for field in ("rand", "prot_scheme_id"):
        rows = rows.unionByName(filters.field_values(frames, field))
    return rows


def log_keyword_since(spark, folder):
    words = {"mac_failures": "MAC failure", "auth_rejects": "Authentication reject", "refusals": "refused"}
    return evidence.keyword_counts(_timed(spark, folder), words, _since(SINCE), "source")


def feature_projection(spark, folder):
    return filters.model_vector(_sliding(spark, folder), *KEY)


def rogue_sources(spark, folder):
    return filters.rogue_sources(ev.frames(spark, folder), CFG)


def log_tail_n(spark, folder):
    return filters.last_n(_parsed(spark, folder), "source", "seq", 10).select("source", "rank", "seq", "message")


def log_tail_files(spark, folder):
    """The last ten matching lines of each source of stored logs, read from the ends of the files."""
    rows = tails.read_tails(spark, ev.log_files(spark, folder), 10, "reject")
    lines = rows.select(F.regexp_replace("source", "^source=", "").alias("source"), "rank", "line")
    return evidence.parse_amf(lines, YEAR).select("source", "rank", "message")


def trim_per_class(spark, folder):
    rows = filters.first_n(_labelled(spark, folder), "label", training.ORDER, CFG.per_class)
    return rows.select("label", "seq", *KEY, "total_packets")


# ---- windows and features ----
def sliding(spark, folder):
    return _sliding(spark, folder)


def tumbling(spark, folder):
    return tumbling_features(ev.packets(spark, folder), CFG)


def short_capture_features(spark, folder):
    return _sliding(spark, folder).where(F.col("duration") < CFG.window_seconds)


def window_ids(spark, folder):
    rows = training.labelled_features(ev.packets(spark, folder), ev.manifest(spark, folder), CFG)
    return rows.select("capture", "w", "label", "window_no", "window_id")


def best_window(spark, folder):
    rows = windows.best_window(tumbling_features(ev.packets(spark, folder), CFG))
    return rows.select("capture", "t_start", "score", *MODEL_FEATURES)


def rand_repeat_windows(spark, folder):
    return rand_repeats(ev.packets(spark, folder), Layout.sliding(CFG))


def rate_features(spark, folder):
    rows = _sliding(spark, folder).drop("auth_rate", "reg_rate", "reject_rate", "auth_success_rate")
    return rate_columns(rows).select(*KEY, "auth_rate", "reg_rate", "reject_rate", "auth_success_rate")


def active_windows(spark, folder):
    return _sliding(spark, folder).where("is_active = 1").select(*KEY, "total_packets", "is_active")


def capture_duration(spark, folder):
    return captures.stamped_duration(ev.frames(spark, folder)).select("capture", "capture_us", "n_rows")


def capture_overrides(spark, folder):
    rows = windows.capture_verdict_inputs(ev.packets(spark, folder), CFG)
    after = windows.apply_overrides(
        rows.withColumns(
            {
                "window_abort": F.col("sctp_abort"),
                "window_failures": F.col("auth_failures"),
                "window_setups": F.col("ng_setup_req"),
            }
        ),
        CFG,
    )
    return after.select(
        "capture", "window_abort", "window_failures", "window_setups", "sctp_abort", "auth_failures", "ng_setup_req"
    )


def windows_per_label(spark, folder):
    return augment.windows_per_label(_labelled(spark, folder))


def smote_readiness(spark, folder):
    return augment.oversample_readiness(_labelled(spark, folder), CFG)


def class_distribution(spark, folder):
    return augment.class_distribution(_labelled(spark, folder)).orderBy(F.desc("n"), "label")


# ---- rules and model ----
def online_rules(spark, folder):
    rows = detection.capture_features(ev.packets(spark, folder), CFG)
    return rows.select("capture", "t_start", *MODEL_FEATURES, rules.online_class(CFG).alias("prediction"))


def online_detection(spark, folder):
    rows = detection.capture_features(ev.packets(spark, folder), CFG)
    verdict = rows.withColumn("prediction", rules.online_class(CFG))
    ruled = F.col("prediction") != "model"
    return verdict.select(
        "capture",
        "prediction",
        F.when(ruled, F.lit(1.0)).alias("confidence"),
        F.when(ruled, "rule").otherwise("model").alias("method"),
        F.array_join(respond.online_actions(F.col("prediction"), CFG), ",").alias("actions"),
        "capture_seconds",
        "t_start",
        "score",
    )


def simple_rules(spark, folder):
    return _sliding(spark, folder).select(*KEY, rules.simple_class().alias("prediction"))


def weighted_scores(spark, folder):
    rows = rules.with_weighted_scores(_sliding(spark, folder))
    return rows.select(*KEY, *[F.col(f"score_{name}") for name in LABELS])


def weighted_rules(spark, folder):
    rows = rules.with_weighted_scores(_sliding(spark, folder))
    return rows.select(*KEY, rules.weighted_class().alias("prediction"))


def offline_rules(spark, folder):
    return _sliding(spark, folder).select(*KEY, rules.offline_class().alias("prediction"))


def confidence_gate(spark, folder):
    return _detections(spark, folder).select("capture", "prediction", "confidence", "method")


def zscore_features(spark, folder):
    rows = _stored(spark, folder)
    scores = forest.zscores(rows, rows, list(KEY))
    return scores.select(*KEY, *[F.bround(f"z_{f}", 6).alias(f"z_{f}") for f in MODEL_FEATURES])


def class_weights(spark, folder):
    return augment.class_weights(_stored(spark, folder))


def stratified_folds(spark, folder):
    trimmed = filters.first_n(_labelled(spark, folder), "label", training.ORDER, CFG.per_class)
    return augment.stratified_folds(trimmed).select("label", "seq", *KEY, "fold")


def _detected(spark, folder) -> DataFrame:
    """Train and detect on one packet table: its clock is attached once for both."""
    packets = ev.packets(spark, folder)
    labelled = sliding_features(packets, CFG).withColumn("label", rules.simple_class())
    model = training.train(labelled, TREES, CFG)
    return detection.detect(packets, model, CFG, timings=ev.timings(spark, folder))


def rf_train_predict(spark, folder):
    return _detected(spark, folder).select("capture", "prediction", "confidence", "method", "response_time")


def rf_rule_rows(spark, folder):
    """The captures that the rules decide although a forest is there."""
    rows = _detected(spark, folder).where(F.col("method") == "rule")
    return rows.select("capture", "prediction", "confidence", "method", "response_time")


def rf_checks(spark, folder):
    """How many captures there are, and how many break a rule that any forest must keep."""
    rows = _detected(spark, folder)
    sure, ruled = F.col("model_confidence"), F.col("method") == "rule"
    # the highest of at most six class probabilities
    return rows.agg(
        F.count("*").alias("captures"),
        F.count_if(~ruled).alias("left_to_forest"),
        F.count_if(sure.isNull() | (sure < 1 / len(LABELS) - 1e-9) | (sure > 1 + 1e-9)).alias("bad_confidence"),
        F.count_if(~ruled & ((F.col("prediction") == "unknown") != (sure < CFG.confidence_gate))).alias("bad_gate"),
        F.count_if(~ruled & (F.col("confidence") != F.bround(sure, 3))).alias("bad_rounding"),
    )


def rf_node_checks(spark, folder):
    """Splits below the floor, and windows whose scores differ when worked out from the table of nodes."""
    labelled = _stored(spark, folder)
    model = training.train(labelled, TREES, CFG)
    nodes = forest.nodes(model)
    scored = forest.table_probabilities(model, model.transform(labelled))
    apart = F.zip_with(vector_to_array("probability"), "table_probability", lambda a, b: F.abs(a - b))
    splits = nodes.agg(F.count_if(F.col("feature").isNotNull() & (F.col("n_rows") < forest.LEAST_SPLIT)).alias("small_splits"))
    judged = scored.agg(F.count("*").alias("windows"), F.count_if(~(F.array_max(apart) < 1e-9)).alias("different"))
    return judged.join(F.broadcast(splits), F.lit(True)).select("windows", "different", "small_splits")  # one row each


def rf_fold_checks(spark, folder):
    """Rows, classes and wrongly repeated rows of each fold of the cross-validation."""
    judged = forest.fold_predictions(training.training_set(_labelled(spark, folder), CFG), TREES, cfg=CFG)
    known = F.col("predicted").isin(*LABELS)
    return judged.groupBy("fold").agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("label").alias("n_classes"),
        (F.count("*") - F.count_distinct("label", "seq")).alias("repeated"),
        F.count_if(~known | F.col("predicted").isNull()).alias("unknown_class"),
        (F.avg((F.col("label") == F.col("predicted")).cast("double")) > 0.5).alias("better_than_half"),
    )


def _held_out(spark, folder) -> tuple[DataFrame, DataFrame]:
    """A forest trained on the other captures, and all verdicts on the captures kept for testing."""
    labelled = _stored(spark, folder)
    train = labelled.where(~training.held_out())
    truth = labelled.where(training.held_out()).withColumn("label", rules.offline_class(otherwise="normal"))
    return train, training.with_all_predictions(training.train(train, TREES, CFG), truth)


def offline_hybrid(spark, folder):
    return _held_out(spark, folder)[1].select(*KEY, "label", "simple", "weighted", "forest", "hybrid")


def hybrid_rule_rows(spark, folder):
    """The held-out windows that the offline rules decide."""
    rows = offline_hybrid(spark, folder).join(_sliding(spark, folder), list(KEY))
    ruled = rules.offline_class(otherwise="model") != "model"
    return rows.where(ruled).select(*KEY, "label", "simple", "weighted", "hybrid")


def rf_importances(spark, folder):
    return forest.importances(training.train(_labelled(spark, folder), TREES, CFG))


def rf_importance_checks(spark, folder):
    whole = F.sum("importance")
    return rf_importances(spark, folder).agg(
        F.count("*").alias("features"), (F.min("importance") >= 0).alias("none_negative"), ((whole > 0) & (whole <= 1 + 1e-9)).alias("share_of_one")
    )


def rf_cv(spark, folder):
    return forest.cross_validate(training.training_set(_labelled(spark, folder), CFG), TREES, cfg=CFG)


def method_accuracy(spark, folder):
    """Accuracy of all four methods on captures the forest has not seen, and of its cross-validation."""
    train, judged = _held_out(spark, folder)
    summary = evaluate.method_summary(judged, {name: name for name in ("simple", "weighted", "forest", "hybrid")})
    rows = training.training_set(train, CFG)
    folds = forest.cross_validate(rows, TREES, cfg=CFG).select(
        F.lit("forest, 5 folds").alias("method"),
        F.lit(rows.count()).alias("n_rows"),
        F.lit(None).cast("bigint").alias("n_correct"),
        F.bround("mean_accuracy", 6).alias("accuracy"),
    )
    return summary.unionByName(folds)


def held_out_rules(spark, folder):
    """The lines of ``method_accuracy`` that don't depend on a forest."""
    labelled = _truth(spark, folder).where(training.held_out())
    return evaluate.method_summary(labelled, {"simple": "simple", "weighted": "weighted"})


def forest_report(spark, folder):
    """Report per class on held-out captures, for the forest and for the hybrid."""
    judged = written(_held_out(spark, folder)[1], "judged")
    reports = [
        evaluate.classification_report(judged.withColumn("prediction", F.col(name))).withColumn("method", F.lit(name))
        for name in ("forest", "hybrid")
    ]
    return reports[0].unionByName(reports[1])


def forest_confusion(spark, folder):
    judged = written(_held_out(spark, folder)[1], "judged")
    pairs = [
        evaluate.confusion_matrix(judged.withColumn("prediction", F.col(name))).withColumn("method", F.lit(name))
        for name in ("forest", "hybrid")
    ]
    return pairs[0].unionByName(pairs[1])


# ---- evaluation ----
def accuracy_simple(spark, folder):
    rows = _truth(spark, folder).withColumn("prediction", F.col("simple"))
    return evaluate.accuracy(rows, "simple")


def accuracy_weighted(spark, folder):
    return evaluate.accuracy(_judged(spark, folder), "weighted")


def classification_report(spark, folder):
    return evaluate.classification_report(_judged(spark, folder))


def confusion_matrix(spark, folder):
    return evaluate.confusion_matrix(_judged(spark, folder), LABELS)


def confusion_pairs(spark, folder):
    return evaluate.confusion_matrix(_judged(spark, folder))


def method_summary(spark, folder):
    return evaluate.method_summary(_truth(spark, folder), {"simple": "simple", "weighted": "weighted"})


# ---- training set ----
def class_partition(spark, folder):
    return augment.class_partition(_labelled(spark, folder))


def smote_k(spark, folder):
    return augment.neighbour_count(_stored(spark, folder), CFG)


def class_knn(spark, folder):
    rows = _stored(spark, folder)
    near = augment.class_knn(augment.small_classes(rows, training.ORDER, CFG), rows, CFG)
    return near.select("label", "seq", "nn_seq", "nn_rank", F.bround("distance2", 6).alias("distance2"))


def smote_rows(spark, folder):
    rows = _stored(spark, folder)
    made = augment.interpolated(augment.small_classes(rows, training.ORDER, CFG), rows, CFG)
    return made.select("label", "i", *TRAINING_FEATURES)


def noise_rows(spark, folder):
    first = filters.first_n(_labelled(spark, folder), "label", training.ORDER, 1)
    return augment.noisy(first, CFG).select("label", "i", *TRAINING_FEATURES)


def augmented_counts(spark, folder):
    return augment.class_distribution(training.training_set(_labelled(spark, folder), CFG))


def training_order(spark, folder):
    """Place of each trimmed training row in the seeded order of writing: some hundred rows."""
    trimmed = filters.first_n(_labelled(spark, folder), "label", training.ORDER, CFG.per_class)
    place = F.row_number().over(W.orderBy(augment.shuffle_key(CFG), "label", "seq"))
    return trimmed.select("label", "seq", *KEY, place.alias("place"))


# ---- responses ----
def response_plan(spark, folder):
    return _detections(spark, folder).select("capture", "prediction", F.array_join("actions", ",").alias("actions"))


def _planned(spark, folder):
    return respond.responder_plan(_detections(spark, folder).drop("actions"))


def responder_plan(spark, folder):
    plan = respond.responder_plan(_detections(spark, folder).drop("actions", "any_rogue"))
    return plan.select("capture", "attack_type", "technique", "target", F.array_join("actions", ",").alias("actions"))


def response_events(spark, folder):
    rows = respond.response_events(_planned(spark, folder), _since(ENDED))
    return rows.select(
        "capture",
        F.unix_micros("timestamp").alias("at_us"),
        "attack_type",
        F.array_join("actions", ",").alias("actions"),
        "target",
        "success",
    )


def rogue_response(spark, folder):
    rows = detection.capture_features(ev.packets(spark, folder), CFG)
    return rows.select(
        "capture", "any_rogue", F.array_join(respond.rogue_actions(F.col("any_rogue")), ",").alias("actions")
    )


def response_summary(spark, folder):
    return respond.response_summary(_planned(spark, folder))


def block_list(spark, folder):
    return respond.block_list(ev.frames(spark, folder), _detections(spark, folder), CFG)


def recent_failures(spark, folder):
    return evidence.recent_failures(_parsed(spark, folder), "source", "seq")


def recent_rejects(spark, folder):
    return evidence.recent_lines(_parsed(spark, folder), r"Registration reject \[23\]", "source", "seq")


def recent_null_schemes(spark, folder):
    return evidence.recent_lines(_parsed(spark, folder), r"suci-\d+-\d+-\d+-\d+-0-", "source", "seq")


def rate_limit(spark, folder):
    return respond.rate_limits(ev.frames(spark, folder), CFG)


def mean_response(spark, folder):
    return respond.mean_response(_detections(spark, folder))


# ---- metrics ----
def class_codes(spark, folder):
    rows = _detections(spark, folder)
    return rows.select("capture", "prediction", metrics.class_code(F.col("prediction")).alias("code"))


def metric_rows(spark, folder):
    rows = metrics.metric_rows(_detections(spark, folder))
    return rows.select("capture", "name", metrics.label_text(F.col("labels")).alias("labels"), "value")


def metric_exposition(spark, folder):
    return metrics.exposition(metrics.metric_rows(_detections(spark, folder))).select("capture", "name", "part", "value")


def metric_files(spark, folder):
    """The exposition of all captures as it is written: every header once."""
    return metrics.exposition_files(metrics.metric_rows(_detections(spark, folder)))


def metric_summary_exposition(spark, folder):
    return metrics.exposition(metrics.metric_summary(_detections(spark, folder)))


def metric_summary(spark, folder):
    return metrics.metric_summary(_detections(spark, folder))


def counter_delta(spark, folder):
    rows = metrics.counter_delta(ev.metric_samples(spark, folder), _since(STARTED), _since(ENDED))
    return rows.select("name", "before", "after", F.bround("delta", 6).alias("delta"))


def metric_bands(spark, folder):
    return metrics.bands(_detections(spark, folder))


def result_table(spark, folder):
    return metrics.result_table(_detections(spark, folder))


def event_log_lines(spark, folder):
    rows = _detections(spark, folder).withColumn("logged_at", _since(ENDED))
    return metrics.event_log(rows)


# ---- files written and read back ----
def discovered_packets(spark, folder):
    """Packets of the capture files found in each folder; their path is the capture's name."""
    found = captures.discover(spark, ev.capture_files(spark, folder))
    return found.groupBy(F.regexp_extract("capture", "^folder=([0-9]+)/[^/]+$", 1).alias("folder")).agg(
        F.count("*").alias("packets"), F.sum("frame_no").alias("frames"), F.count_if(F.endswith("capture", F.lit(".parquet"))).alias("with_suffix")
    )


def feature_file(spark, folder):
    path = new_path(spark, "features")
    sinks.write_features(_sliding(spark, folder), path)
    return sinks.read_features(spark, path)


def training_file(spark, folder):
    path = new_path(spark, "training-file")
    sinks.write_training(filters.first_n(_labelled(spark, folder), "label", training.ORDER, CFG.per_class), path)
    return sinks.read_training(spark, path)


def report_file(spark, folder):
    """The nested report documents, read back."""
    path = new_path(spark, "report")
    rows = detection.result_rows(_detections(spark, folder), _since(ENDED))
    sinks.write_report(rows, path)
    back = sinks.read_report(spark, path, rows.schema)
    return back.select(
        F.unix_micros("timestamp").alias("at_us"), "capture", "prediction", "confidence", "method",
        F.array_join("actions", ",").alias("actions"), "response_time", "capture_seconds",
        *[F.col(f"features.{name}").alias(name) for name in MODEL_FEATURES],
    )


# ---- log and capture evidence ----
def log_identifiers(spark, folder):
    rows = evidence.with_identifiers(_parsed(spark, folder))
    return rows.select("source", "seq", "suci", "scheme", "imsi", "cause", "gnb_ip")


def log_times(spark, folder):
    """The time of every line, its own or that of the line it continues."""
    return _timed(spark, folder).select("source", "seq", F.unix_micros("ts").alias("ts_us"), "year", "carried")


def log_new_year(spark, folder):
    """Times of a log across New Year: only the year of its first line is given."""
    parsed = evidence.parse_amf(ev.log_lines_over_new_year(spark, folder), YEAR)
    rows = logtime.with_line_times(parsed, first_year=YEAR - 1, block=100)
    return rows.select("source", "seq", F.unix_micros("ts").alias("ts_us"), "year", "carried")


def log_matches_since(spark, folder):
    rows = evidence.matching(_timed(spark, folder), "(?i)security|reject|algorithm", _since(SINCE))
    return rows.select("source", "seq", "message")


def keyword_occurrences(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    words = {"n_the": "the", "n_la": "la", "n_en": "en"}
    return evidence.keyword_occurrences(documents, "text", words, "lang")


def evidence_auth_failures(spark, folder):
    return evidence.failure_evidence(ev.frames(spark, folder), _parsed(spark, folder), CFG)


def evidence_rejects(spark, folder):
    return evidence.reject_evidence(ev.frames(spark, folder), _parsed(spark, folder))


def evidence_null_scheme(spark, folder):
    return evidence.null_scheme_evidence(ev.frames(spark, folder), CFG)


def evidence_rogue(spark, folder):
    return evidence.rogue_evidence(ev.frames(spark, folder), _parsed(spark, folder), CFG.rogue_address)


def evidence_abort(spark, folder):
    frames = ev.frames(spark, folder).withColumn("challenge", F.when(F.col("rand").isNotNull(), F.md5(F.col("rand"))))
    return evidence.abort_evidence(frames, "challenge")


def evidence_sections(spark, folder):
    return evidence.evidence_sections(ev.frames(spark, folder), _parsed(spark, folder))


def last_registrations(spark, folder):
    rows = evidence.last_registrations(_parsed(spark, folder), "source", "seq")
    return rows.select("source", "rank", "seq", "message")


def evidence_since(spark, folder):
    """The verdicts that rest on the log alone, from a time on."""
    frames, parsed, since = ev.frames(spark, folder), _timed(spark, folder), _since(SINCE)
    guessing = evidence.failure_evidence(frames, parsed, CFG, since).select("capture", "log_failures", "log_rejects")
    rogue = evidence.rogue_evidence(frames, parsed, CFG.rogue_address, since).select("capture", "refused", "accepted")
    return guessing.join(rogue, "capture")


# ---- streams: event files as they arrive, all that is there, then what the watermark closes ----
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def _streamed(df: DataFrame, name: str, mode: str = "append", several_states: bool = False) -> DataFrame:
    """Run a stream over what is there into a committed table in the shared folder, and read that."""
    spark = df.sparkSession
    out, log = new_path(spark, name), new_path(spark, f"{name}-log")
    before = spark.conf.get(STATE_STORE, None)
    if several_states:
        stream_captures.state_store(spark)
    try:
        query = commits.committed_sink(df, out, log, mode)
        query.awaitTermination()
    finally:
        if several_states:
            spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)
    if query.exception():
        raise query.exception()
    return commits.read_committed(spark, out, df.schema)


def _stream_windows(spark, folder) -> DataFrame:
    packets = ev.packet_stream(spark, folder, LATE)
    return jobs.window_features(packets, CFG, SPAN, STEP, float(CFG.window_seconds))


def stream_windows(spark, folder):
    rows = _streamed(_stream_windows(spark, folder), "stream-windows")
    return rows.select(
        "capture",
        F.unix_micros("t_start").alias("start_us"),
        *[F.col(name) for name in ("total_packets", "auth_requests", "auth_failures", "reg_requests", "reg_rejects")],
        "suci_unencrypted",
        "rand_repeat",
    )


def _overrides(packets: DataFrame) -> DataFrame:
    rows = _streamed(jobs.running_overrides(packets, CFG, STRETCH), "stream-overrides", "update")
    rows = rows.select("capture", F.unix_micros("stretch.start").alias("start_us"), "all_failures", "any_abort", "any_rogue", commits.COMMITTED)
    return commits.latest(rows, "capture", "start_us")


def stream_overrides(spark, folder):
    return _overrides(ev.packet_stream(spark, folder, LATE))


def stream_overrides_updated(spark, folder):
    """The same over several micro-batches, each of which changes rows of the one before."""
    return _overrides(ev.shuffled_packet_stream(spark, folder, EVER))


def _limits(packets: DataFrame) -> DataFrame:
    return commits.latest(_streamed(jobs.rate_limiter(packets, STREAM), "stream-limits"), "subscriber", "at_us")


def stream_rate_limit(spark, folder):
    return _limits(ev.packet_stream(spark, folder, LATE))


def stream_rate_limit_late(spark, folder):
    """Packets out of order over several micro-batches: decisions already out are corrected."""
    return _limits(ev.shuffled_packet_stream(spark, folder, EVER))


def stream_alerts(spark, folder):
    scored = jobs.score_windows(_stream_windows(spark, folder), CFG)
    return _streamed(jobs.alerts(scored), "stream-alerts").select("capture", "prediction")


def stream_sliding_features(spark, folder):
    """Feature windows on each capture's own time line: those that later packets or its end have settled."""
    rows = stream_captures.sliding_windows(ev.packet_stream(spark, folder, LATE), CFG, GAP_SECONDS)
    return _streamed(rows, "stream-sliding", several_states=True).select(*FEATURE_COLUMNS)


def stream_verdicts(spark, folder):
    """One verdict for each capture that has ended."""
    finished = stream_captures.finished_captures(ev.packet_stream(spark, folder, LATE), CFG, GAP_SECONDS)
    rows = _streamed(stream_captures.verdicts(finished, CFG), "stream-verdicts", several_states=True)
    return rows.select("capture", "prediction", "confidence", "method", F.array_join("actions", ",").alias("actions"), "capture_seconds", "t_start", "score")


QUERIES = {
    "scan_packets": scan_packets,
    "labelled_packets": labelled_packets,
    "missing_captures": missing_captures,
    "log_parse": log_parse,
    "summary_parse": summary_parse,
    "metric_latest": metric_latest,
    "metric_last_per_capture": metric_last_per_capture,
    "time_slice": time_slice,
    "message_type_counts": message_type_counts,
    "message_packets": message_packets,
    "ng_setup_packets": ng_setup_packets,
    "abort_packets": abort_packets,
    "null_scheme_packets": null_scheme_packets,
    "watched_packets": watched_packets,
    "protocol_counts": protocol_counts,
    "field_values": field_values,
    "log_keyword_since": log_keyword_since,
    "feature_projection": feature_projection,
    "rogue_sources": rogue_sources,
    "log_tail_n": log_tail_n,
    "log_tail_files": log_tail_files,
    "trim_per_class": trim_per_class,
    "sliding_features": sliding,
    "tumbling_features": tumbling,
    "short_capture_features": short_capture_features,
    "window_ids": window_ids,
    "best_window": best_window,
    "rand_repeat_windows": rand_repeat_windows,
    "rate_features": rate_features,
    "active_windows": active_windows,
    "capture_duration": capture_duration,
    "capture_overrides": capture_overrides,
    "windows_per_label": windows_per_label,
    "smote_readiness": smote_readiness,
    "class_distribution": class_distribution,
    "online_rules": online_rules,
    "online_detection": online_detection,
    "simple_rules": simple_rules,
    "weighted_scores": weighted_scores,
    "weighted_rules": weighted_rules,
    "offline_rules": offline_rules,
    "confidence_gate": confidence_gate,
    "zscore_features": zscore_features,
    "class_weights": class_weights,
    "stratified_folds": stratified_folds,
    "rf_train_predict": rf_train_predict,
    "rf_rule_rows": rf_rule_rows,
    "rf_checks": rf_checks,
    "rf_node_checks": rf_node_checks,
    "rf_fold_checks": rf_fold_checks,
    "rf_importance_checks": rf_importance_checks,
    "hybrid_rule_rows": hybrid_rule_rows,
    "held_out_rules": held_out_rules,
    "forest_report": forest_report,
    "forest_confusion": forest_confusion,
    "confusion_pairs": confusion_pairs,
    "training_order": training_order,
    "recent_rejects": recent_rejects,
    "recent_null_schemes": recent_null_schemes,
    "metric_summary_exposition": metric_summary_exposition,
    "evidence_since": evidence_since,
    "stream_windows": stream_windows,
    "stream_overrides": stream_overrides,
    "stream_rate_limit": stream_rate_limit,
    "stream_alerts": stream_alerts,
    "stream_overrides_updated": stream_overrides_updated,
    "stream_rate_limit_late": stream_rate_limit_late,
    "stream_sliding_features": stream_sliding_features,
    "stream_verdicts": stream_verdicts,
    "offline_hybrid": offline_hybrid,
    "rf_importances": rf_importances,
    "rf_cv": rf_cv,
    "method_accuracy": method_accuracy,
    "accuracy_simple": accuracy_simple,
    "accuracy_weighted": accuracy_weighted,
    "classification_report": classification_report,
    "confusion_matrix": confusion_matrix,
    "method_summary": method_summary,
    "class_partition": class_partition,
    "smote_k": smote_k,
    "class_knn": class_knn,
    "smote_rows": smote_rows,
    "noise_rows": noise_rows,
    "augmented_counts": augmented_counts,
    "response_plan": response_plan,
    "responder_plan": responder_plan,
    "response_events": response_events,
    "rogue_response": rogue_response,
    "response_summary": response_summary,
    "block_list": block_list,
    "recent_failures": recent_failures,
    "rate_limit": rate_limit,
    "mean_response": mean_response,
    "class_codes": class_codes,
    "metric_rows": metric_rows,
    "metric_exposition": metric_exposition,
    "metric_files": metric_files,
    "metric_summary": metric_summary,
    "counter_delta": counter_delta,
    "metric_bands": metric_bands,
    "result_table": result_table,
    "event_log_lines": event_log_lines,
    "discovered_packets": discovered_packets,
    "feature_file": feature_file,
    "training_file": training_file,
    "report_file": report_file,
    "log_identifiers": log_identifiers,
    "log_matches_since": log_matches_since,
    "log_times": log_times,
    "log_new_year": log_new_year,
    "keyword_occurrences": keyword_occurrences,
    "evidence_auth_failures": evidence_auth_failures,
    "evidence_rejects": evidence_rejects,
    "evidence_null_scheme": evidence_null_scheme,
    "evidence_rogue": evidence_rogue,
    "evidence_abort": evidence_abort,
    "evidence_sections": evidence_sections,
    "last_registrations": last_registrations,
}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Which captures are attacks, and why: hybrid detection with nested features."""
    return detection.result_rows(_detected(spark, folder), F.lit("2024-02-01").cast("timestamp"))
