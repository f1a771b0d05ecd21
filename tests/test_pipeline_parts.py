import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from authsignal.config import BINARY_FEATURES, INTEGER_FEATURES, LABELS, TRAINING_FEATURES, DetectorConfig, ScaleLimits
from authsignal.functions.shared import release, shared_folder, written
from authsignal.functions.skew import attach_by_key
from authsignal.operators import augment, evaluate, filters, forest, metrics, respond
from authsignal.operators.features import sliding_features, tumbling_features
from authsignal.plans import detection, training
from authsignal.plans.queries import QUERIES
from authsignal.schemas import PACKET
from authsignal.sources import captures, events, logs, sinks
from tests.conftest import SMALL
from tests.packets import packet, table

CFG = DetectorConfig()


@pytest.fixture(scope="module")
def traffic(spark):
    """Three kinds of captures, a few minutes each."""
    rows = []
    for n in range(4):
        for i in range(40):
            rows.append(packet(f"calm{n}", i, i * 3 + n, nas=[[65], [86], [93], []][i % 4]))
        for i in range(40):
            rows.append(packet(f"guess{n}", i, i * 3 + n, nas=[[86], [89]][i % 2]))
        for i in range(40):
            rows.append(packet(f"down{n}", i, i * 3 + n, nas=[[65], [68], [93]][i % 3]))
    return table(spark, rows)


@pytest.fixture(scope="module")
def manifest(spark):
    kinds = {"calm": "normal", "guess": "brute_force", "down": "bidding_down"}
    rows = [(f"{k}{n}", label, i * 10 + n) for i, (k, label) in enumerate(kinds.items()) for n in range(4)]
    return spark.createDataFrame(rows + [("absent", "replay", 99)], captures.MANIFEST)


@pytest.fixture(scope="module")
def labelled(traffic, manifest):
    return training.labelled_features(traffic, manifest, CFG).cache()


def test_window_numbers_run_on_over_captures(labelled):
    rows = labelled.select("pos", "w", "window_no", "window_id", "label").collect()
    ordered = sorted(rows, key=lambda r: (r.pos, r.w))
    assert [r.window_no for r in ordered] == list(range(len(ordered)))
    assert all(r.window_id == f"{r.label}_w{r.window_no}" for r in ordered)


def test_missing_captures(traffic, manifest):
    assert [r.capture for r in captures.missing_captures(traffic, manifest).collect()] == ["absent"]


def test_training_set(labelled):
    rows = training.training_set(labelled.where("label <> 'bidding_down' OR w < 3"), CFG)
    counts = {r.label: r.n for r in augment.class_distribution(rows).collect()}
    assert counts == dict.fromkeys(counts, 100) and set(counts) == {"normal", "brute_force", "bidding_down"}
    bounds = labelled.groupBy("label").agg(
        *[F.min(f).alias(f"lo_{f}") for f in TRAINING_FEATURES], *[F.max(f).alias(f"hi_{f}") for f in TRAINING_FEATURES]
    )
    outside = " OR ".join(f"{f} < lo_{f} OR {f} > hi_{f}" for f in TRAINING_FEATURES)
    assert rows.join(bounds, "label").where(outside).count() == 0
    again = training.training_set(labelled.where("label <> 'bidding_down' OR w < 3"), CFG)
    assert rows.exceptAll(again).count() == 0


def test_single_row_class_is_filled_with_noise(labelled):
    one = labelled.where("label = 'normal'").orderBy("window_no").limit(1)
    rest = labelled.where("label <> 'normal'")
    rows = training.training_set(one.unionByName(rest), CFG).where("label = 'normal'")
    base = one.first()
    assert rows.count() == 100
    for r in rows.collect():
        for f in TRAINING_FEATURES:
            if f in BINARY_FEATURES or base[f] == 0:
                assert r[f] == base[f]
            else:
                slack = 0.5 if f in INTEGER_FEATURES else 0.0001
                assert base[f] * 0.85 - slack <= r[f] <= base[f] * 1.15 + slack


def test_folds_are_even(labelled):
    rows = augment.stratified_folds(training.training_set(labelled, CFG))
    assert {r.n for r in rows.groupBy("label", "fold").agg(F.count("*").alias("n")).collect()} == {20}


def test_forest_and_detection(traffic, labelled):
    model = training.train(labelled, 10, CFG)
    scored = model.transform(labelled)
    from pyspark.ml.functions import vector_to_array

    total = scored.select(F.aggregate(vector_to_array("probability"), F.lit(0.0), lambda a, b: a + b).alias("s"))
    assert total.where(F.abs(F.col("s") - 1) > 1e-9).count() == 0
    found = {r.capture: r for r in detection.detect(traffic, model, CFG).collect()}
    assert len(found) == 12
    assert all(found[f"guess{n}"].prediction == "brute_force" and found[f"guess{n}"].method == "rule" for n in range(4))
    assert all(found[f"down{n}"].prediction == "bidding_down" for n in range(4))
    calm = [found[f"calm{n}"] for n in range(4)]
    assert all(r.method == "rf" and r.prediction in ("normal", "unknown") for r in calm)
    assert forest.importances(model).count() == 5
    rows = training.with_all_predictions(model, labelled)
    summary = {r.method: r.accuracy for r in evaluate.method_summary(rows, {m: m for m in ("simple", "weighted", "forest", "hybrid")}).collect()}
    assert set(summary) == {"simple", "weighted", "forest", "hybrid"} and summary["forest"] > 0.9


def test_report_handles_absent_classes(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "a")], "label string, prediction string")
    got = {r.name: r for r in evaluate.classification_report(rows).collect()}
    assert (got["a"].precision, got["a"].recall, got["a"].f1, got["a"].support) == (0.5, 0.5, 0.5, 2)
    assert (got["b"].precision, got["b"].recall, got["b"].support) == (0.0, 0.0, 0)
    assert (got["c"].precision, got["c"].recall, got["c"].f1) == (0.0, 0.0, 0.0)
    assert got["macro avg"].f1 == 0.166667 and got["weighted avg"].f1 == 0.333333


def test_confusion_of_occurring_and_of_given_classes(spark):
    rows = spark.createDataFrame([("replay", "unknown"), ("replay", "replay"), ("own", "replay")], "label string, prediction string")
    pairs = {tuple(r) for r in evaluate.confusion_matrix(rows).collect()}
    assert pairs == {("replay", "unknown", 1), ("replay", "replay", 1), ("own", "replay", 1)}
    got = {r.label: r.asDict() for r in evaluate.confusion_matrix(rows, LABELS).collect()}
    assert got["replay"]["pred_replay"] == 1 and got["replay"]["pred_other"] == 1
    assert got["own"]["pred_replay"] == 1 and got["own"]["pred_other"] == 0


def test_rate_limits_against_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = [
        packet("c", i, round(rng.uniform(0, 400), 1), nas=[rng.choice([86, 89, 65])]) for i in range(300)
    ]
    edges = (0, 59.999999, 60, 60.000001, 119.999999, 120, 120.000001, 179.999999, 180, 240)
    rows += [packet("c", 300 + 3 * i, s, nas=[86]) for i, s in enumerate(edges)]
    packets = table(spark, rows).withColumns(
        {"subscriber": F.pmod("frame_no", F.lit(3)), "ts_us": F.col("rel_us")}
    )
    got = {(r.subscriber, r.at_us): (r.attempts, r.failures, r.over_limit, r.blocked) for r in respond.rate_limits(packets).collect()}
    want = {}
    for r in rows:
        if r[7][0] == 65:
            continue
        mine = [x for x in rows if x[1] % 3 == r[1] % 3 and r[3] - 60_000_000 <= x[3] <= r[3]]
        attempts, failures = sum(x[7][0] == 86 for x in mine), sum(x[7][0] == 89 for x in mine)
        want[(r[1] % 3, r[3])] = (attempts, failures, attempts > 5, failures >= 3)
    assert got == want


def test_rogue_plan_and_summary(spark):
    rows = spark.createDataFrame(
        [("x", "false_bs", True), ("y", "false_bs", False), ("z", "normal", False)], "capture string, prediction string, any_rogue boolean"
    )
    planned = respond.responder_plan(rows)
    first = {r.capture: r.actions[0] for r in planned.collect()}
    assert first == {"x": "rogue_gnb_terminated", "y": "rogue_gnb_not_active"}
    summary = {r.attack_type: (r.responses, r.done) for r in respond.response_summary(planned).collect()}
    assert summary["false_bs"] == (2, True) and summary["replay"] == (0, False) and len(summary) == 5
    report = sinks.response_report(respond.response_events(planned)).first()
    assert report.total_mitigations == 2 and report.summary["false_bs"] == 2 and report.summary["replay"] == 0


def test_empty_detections_have_zero_mean(spark):
    rows = spark.createDataFrame([], "response_time double")
    assert tuple(respond.mean_response(rows).first()) == (0, 0.0)


def test_counter_defaults(spark):
    rows = spark.createDataFrame([("auth_req", None, 3.0, None)], "name string, labels map<string,string>, value double, ts timestamp")
    rows = rows.withColumn("ts", F.lit("2026-01-01").cast("timestamp"))
    got = {r.name: r.value for r in metrics.latest_counters(rows).collect()}
    assert got["auth_req"] == 3.0 and got["auth_fail"] == 0.0 and len(got) == 6


def test_csv_roundtrip(labelled, spark, tmp_path):
    rows = training.training_set(labelled, CFG)
    sinks.write_training(rows, str(tmp_path / "training"))
    back = sinks.read_training(spark, str(tmp_path / "training"))
    assert back.columns == ["label", *TRAINING_FEATURES] and back.count() == rows.count()
    assert back.exceptAll(rows.select(back.columns)).count() == 0
    sinks.write_features(labelled, str(tmp_path / "features"))
    head = next(Path(tmp_path / "features").glob("*.csv")).read_text().splitlines()[0]
    assert head.startswith("label,window_id,capture,t_start,t_end,total_packets,auth_requests") and head.endswith("is_active")


def parsed_exposition(lines):
    """Samples per family; fails as a text parser does on headers or series that come twice or late."""
    families, series, current = {}, set(), None
    for line in lines:
        if line.startswith("# HELP "):
            current = line.split(" ")[2]
            assert current not in families
            families[current] = None
        elif line.startswith("# TYPE "):
            assert line.split(" ")[2] == current and families[current] is None
            families[current] = 0
        else:
            key, value = line.rsplit(" ", 1)
            assert key.split("{")[0] == current and families[current] is not None and key not in series
            series.add(key)
            float(value)
            families[current] += 1
    return families


def test_exposition_over_many_files(spark, tmp_path):
    rows = spark.range(400).selectExpr(
        "concat('c', id) AS capture", "concat('family', id % 3) AS name", "map('capture', concat('c', id)) AS labels", "id * 1e-9 AS value"
    )
    rows = rows.unionByName(rows.where("capture = 'c7'"))
    rows.sparkSession.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_exposition(rows, str(tmp_path / "files"))
    finally:
        rows.sparkSession.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(Path(tmp_path / "files").glob("*.txt"))
    assert len(files) > 1
    lines = [line for f in files for line in f.read_text().splitlines()]
    assert parsed_exposition(lines) == {"family0": 134, "family1": 133, "family2": 133}
    assert float(next(line for line in lines if 'capture="c3"' in line).split(" ")[-1]) == 3 * 1e-9


def test_report_json(traffic, tmp_path):
    rows = detection.detect_without_model(traffic, CFG)
    sinks.write_report(detection.result_rows(rows), str(tmp_path / "report"))
    docs = [json.loads(line) for f in Path(tmp_path / "report" / "results").glob("*.json") for line in f.read_text().splitlines()]
    assert len(docs) == 12 and set(docs[0]["features"]) >= {"total_packets", "rand_repeat"} and isinstance(docs[0]["actions"], list)
    head = [json.loads(line) for f in Path(tmp_path / "report" / "summary").glob("*.json") for line in f.read_text().splitlines()]
    assert head[0]["captures"] == 12
    sinks.write_exposition(metrics.metric_rows(rows), str(tmp_path / "metrics"))
    lines = [line for f in sorted(Path(tmp_path / "metrics").glob("*.txt")) for line in f.read_text().splitlines()]
    assert 'mitigation_applied{capture="guess0",attack="brute_force"} 1' in lines
    at = next(k for k, line in enumerate(lines) if line.startswith('detection_prediction{capture="calm0"} '))
    assert lines[at - 2 : at] == ["# HELP detection_prediction Attack type detected", "# TYPE detection_prediction gauge"]
    assert parsed_exposition(lines) == {name: 12 for name in ("detection_prediction", "detection_confidence", "mitigation_applied")}


def test_discovery(spark, traffic, tmp_path):
    for name in ("calm0", "down1"):
        part = traffic.where(F.col("capture") == name).withColumn("capture", F.lit(None).cast("string"))
        part.coalesce(1).write.parquet(str(tmp_path / "raw" / name))
        file = next((tmp_path / "raw" / name).glob("*.parquet"))
        (tmp_path / "captures").mkdir(exist_ok=True)
        (tmp_path / "captures" / f"{name}.parquet").write_bytes(file.read_bytes())
    (tmp_path / "captures" / "notes.txt").write_text("not a capture")
    found = captures.discover(spark, str(tmp_path / "captures"))
    assert {r.capture for r in found.select("capture").distinct().collect()} == {"calm0", "down1"}
    assert captures.read_packets(spark, str(tmp_path / "captures" / "calm0.parquet")).schema == PACKET
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "notes.txt").write_text("x")
    with pytest.raises(FileNotFoundError):
        captures.discover(spark, str(tmp_path / "empty")).count()


def test_text_sources(spark, tmp_path):
    (tmp_path / "amf.log").write_text("one\ntwo\nthree\n")
    rows = logs.read_lines(spark, str(tmp_path / "amf.log")).orderBy("seq").collect()
    assert [r.line for r in rows] == ["one", "two", "three"] and rows[0].source == "amf.log"
    (tmp_path / "samples.json").write_text('{"name": "auth_req", "labels": {"instance": "a"}, "value": 2.0, "ts": "2026-01-01T00:00:00Z"}\n')
    assert logs.read_metric_samples(spark, str(tmp_path / "samples.json")).first().labels == {"instance": "a"}


class Elsewhere:
    """Stands for a session of a cluster."""

    def __init__(self, spark, master, folder):
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: folder)})
        self.sparkContext = type("Context", (), {"master": master, "getCheckpointDir": staticmethod(lambda: None)})


def test_shared_folder_is_the_clusters_own(spark):
    assert shared_folder(Elsewhere(spark, "spark://host:7077", "hdfs://store/shared/")) == "hdfs://store/shared"
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]", "k8s://https://host"):
        with pytest.raises(RuntimeError):
            shared_folder(Elsewhere(spark, master, None))
    assert shared_folder(spark)


def test_written_tables_can_be_released(spark):
    table = written(spark.range(10).toDF("n"), "ten")
    folder = Path(table.inputFiles()[0].split(":", 1)[1]).parent
    assert table.count() == 10 and folder.exists()
    release(spark, table)
    assert not folder.exists()


def test_null_captures_are_kept(spark):
    rows = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "capture string, frame_no long")
    facts = rows.groupBy("capture").agg(F.count("*").alias("n_rows"), F.max("frame_no").alias("last"))
    for limits in (ScaleLimits(), ScaleLimits(broadcast_bytes=0), ScaleLimits(broadcast_bytes=0, hot_rows=1, hot_keys=8)):
        got = attach_by_key(rows, facts, "capture", "n_rows", "frame_no", limits).select("capture", "frame_no", "last").collect()
        assert sorted(tuple(r)[1:] for r in got) == [(1, 1), (2, 3), (3, 3)]


def test_seventh_class_and_unlabelled_rows(labelled):
    extra = labelled.withColumn("label", F.when(F.col("capture") == "calm0", "custom").otherwise(F.col("label")))
    assert {r.label: r.n for r in augment.class_distribution(training.training_set(extra, CFG)).collect()}["custom"] == CFG.per_class
    assert "custom" in {r.label for r in forest.weighted_training(extra).select("label").distinct().collect()}
    with pytest.raises(ValueError):
        forest.fit(extra.withColumn("label", F.when(F.col("label") == "custom", None).otherwise(F.col("label"))), 2, CFG)


def test_same_file_name_in_two_folders(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / "logs" / name).mkdir(parents=True)
        (tmp_path / "logs" / name / "amf.log").write_text(f"{name}\n")
    rows = logs.read_lines(spark, str(tmp_path / "logs")).collect()
    assert {(r.source, r.line) for r in rows} == {("one/amf.log", "one"), ("two/amf.log", "two")}


def test_exposition_of_odd_values(spark):
    rows = spark.createDataFrame(
        [("a", "g", {"k": 'q"\\\n'}, 1.5), ("a", "g", {"k": None}, 2.0), ("a", "g", {}, None), ("a", "g", {}, float("nan"))],
        "capture string, name string, labels map<string,string>, value double",
    )
    got = [r.value for r in metrics.exposition(rows).where("part = 2").collect()]
    assert got == ['g{k="q\\"\\\\\\n"} 1.5', 'g{k=""} 2', "g NaN"]


def test_other_writers(spark, tmp_path):
    events = spark.createDataFrame([("c", "replay", ["x"])], "capture string, attack_type string, actions array<string>")
    blocked = spark.createDataFrame([("imsi", "imsi-1")], "kind string, identity string")
    sinks.write_response_report(events, blocked, str(tmp_path / "responses"))
    assert spark.read.json(str(tmp_path / "responses" / "summary")).first().total_mitigations == 1
    assert spark.read.json(str(tmp_path / "responses" / "blocked")).first().identity == "imsi-1"
    lines = spark.createDataFrame([("c", "INFO", "[x] [INFO] y")], "capture string, level string, line string")
    for _ in range(2):
        sinks.write_event_log(lines, str(tmp_path / "events"))
    assert spark.read.json(str(tmp_path / "events")).count() == 2
    sections = spark.createDataFrame([("c", "log", 1, "x"), ("c", "packets", 2, "y")], "capture string, section string, seq long, line string")
    sinks.write_evidence(sections, str(tmp_path / "evidence"))
    assert {p.name for p in (tmp_path / "evidence").glob("section=*")} == {"section=log", "section=packets"}


def test_packet_tables_feed_limits_and_block_list(spark):
    rows = [packet("g", i, i, nas=[89], subscriber=7) for i in range(4)] + [packet("g", 9, 200, nas=[86], subscriber=7)]
    packets = table(spark, rows)
    last = respond.rate_limits(packets).orderBy(F.desc("failures")).first()
    assert (last.subscriber, last.failures, last.blocked) == (7, 4, True)
    flagged = spark.createDataFrame([("g", "brute_force")], "capture string, prediction string")
    assert [tuple(r) for r in respond.block_list(packets, flagged).collect()] == [("imsi", "imsi-001010000000007")]


def test_text_only_null_scheme_counts_everywhere(spark):
    rows = table(spark, [packet("t", 0, 0, info="Protection scheme Id: NULL scheme (0)", src="10.10.0.41"), packet("t", 1, 40)])
    assert filters.null_schemes(rows).count() == 1
    assert tumbling_features(rows).where("suci_unencrypted = 1").count() == 1


def test_scans_of_a_plan(spark):
    """``events`` is read once for the length of captures, and once on the packet side of the block list."""
    plan = QUERIES["capture_duration"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
    packets = events.frames(spark, SMALL)
    flagged = spark.createDataFrame([("g", "brute_force")], "capture string, prediction string")
    plan = respond.block_list(packets, flagged)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 2


def test_stored_labels_match_windows(traffic, labelled):
    assert labelled.count() == sliding_features(traffic, CFG).count()
