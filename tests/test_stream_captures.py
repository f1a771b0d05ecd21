"""Capture-relative windows and verdicts on a stream, against the batch operators."""

import random

import pytest
from pyspark.sql import functions as F

from authsignal.config import DetectorConfig, ScaleLimits
from authsignal.operators.features import FEATURE_COLUMNS, Layout, sliding_features, tumbling_features
from authsignal.operators.windows import best_window
from authsignal.plans import detection, training
from authsignal.streaming import captures, commits, jobs
from tests.packets import packet, table

CFG = DetectorConfig()


def drawn():
    """Captures of all lengths, packets out of order by a few seconds, then a packet that ends them all."""
    draw = random.Random(4)
    rows = []
    for c, length in enumerate([0, 5, 12, 29.999999, 30, 60, 61, 65, 90, 119.5, 200, 33]):
        times = sorted({0, length, *(round(draw.uniform(0, length), 6) for _ in range(25))}) if length else [0]
        times = [t for t in times if not 100 < t < 160]
        start = 7 * c + 0.5
        for k, t in enumerate([*times, times[-1]]):
            nas = draw.choice([[], [86], [86, 86], [89], [65], [68], [93]]) if c % 3 else draw.choice([[], [86], [65]])
            extra = {"scheme": 0} if draw.random() < 0.03 else {}
            src = draw.choice(["10.10.0.30"] * 30 + ["10.10.0.41", "10.10.0.50"])
            ngap, sctp = draw.choice([[]] * 20 + [[21]]), draw.choice([[]] * 40 + [[6]])
            rows.append((start + t, f"c{c}", k, t, dict(nas=nas, ngap=ngap, sctp=sctp, rand=draw.choice([None, "", "a", "b", str(k)]), src=src, **extra)))
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("captures") / "packets")
    rows = sorted(drawn(), key=lambda r: (r[0] + random.Random(f"{r[1]}{r[2]}").uniform(0, 8)))
    third = len(rows) // 3 + 1
    for k in range(3):
        part = [packet(c, n, at, **fields) for at, c, n, _, fields in rows[k * third : (k + 1) * third]]
        table(spark, part).coalesce(1).write.mode("append").parquet(path)
    table(spark, [packet("end", 0, 4_000)]).coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.fixture(scope="module")
def batch(spark):
    return table(spark, [packet(c, n, t, **fields) for _, c, n, t, fields in drawn()])


def run(spark, stream, tmp_path, name, mode="append"):
    query = commits.committed_sink(stream, str(tmp_path / name), str(tmp_path / f"{name}-log"), mode)
    query.awaitTermination(600)
    assert query.exception() is None
    return commits.read_committed(spark, str(tmp_path / name), stream.schema)


@pytest.fixture(autouse=True, scope="module")
def store(spark):
    captures.state_store(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_sliding_windows_equal_batch(spark, folder, batch, tmp_path):
    stream = captures.sliding_windows(jobs.packet_stream(spark, folder, "20 seconds", files_per_batch=1), CFG, 250)
    got = run(spark, stream, tmp_path, "sliding").select(*FEATURE_COLUMNS)
    want = sliding_features(batch, CFG)
    left, right = sorted(map(tuple, got.collect())), sorted(map(tuple, want.collect()))
    assert left == right and len({r[0] for r in right}) == 12
    assert any(r.rand_repeat for r in want.collect()) and any(r.total_packets == 0 for r in want.collect())


def test_verdicts_equal_batch(spark, folder, batch, tmp_path):
    stream = captures.finished_captures(jobs.packet_stream(spark, folder, "20 seconds", files_per_batch=1), CFG, 250)
    rows = captures.verdicts(stream, CFG)
    got = {r.capture: r for r in run(spark, rows, tmp_path, "verdicts").collect()}
    want = {r.capture: r for r in detection.detect_without_model(batch, CFG).collect()}
    assert set(got) == set(want)
    best = {r.capture: r for r in best_window(tumbling_features(batch, CFG)).collect()}
    for capture, row in want.items():
        for name in ("prediction", "confidence", "method", "actions", "capture_seconds", "w", "score", "total_packets", "rand_repeat", "any_rogue"):
            assert got[capture][name] == row[name], (capture, name)
        assert got[capture].t_start == best[capture].t_start
    assert len({r.prediction for r in want.values()}) > 2


def test_verdicts_with_a_model(spark, folder, batch, tmp_path):
    labelled = sliding_features(batch, CFG).selectExpr("*", "if(auth_failures > 0, 'brute_force', if(reg_requests > 2, 'replay', 'normal')) AS label")
    model = training.train(labelled, 5, CFG)
    stream = captures.finished_captures(jobs.packet_stream(spark, folder, "20 seconds", files_per_batch=1), CFG, 250)
    got = {r.capture: (r.prediction, r.confidence, r.method) for r in run(spark, captures.verdicts(stream, CFG, model), tmp_path, "model").collect()}
    want = {r.capture: (r.prediction, r.confidence, r.method) for r in detection.detect(batch, model, CFG).collect()}
    assert got == want and {m for _, _, m in got.values()} == {"rule", "rf"}


def test_fold_keeps_one_window(spark):
    """State doesn't grow with the capture."""
    fold = captures.Fold(Layout.sliding(CFG), None, {}, {})
    out = [row for second in range(5_000) for row in fold.add(second * 1_000_000, 1, None)]
    assert len(out) == (4_999 - 30) // 10 + 1 and all(row[2] == 30 for row in out)
    oldest = fold.next_w * CFG.step_us // Layout.sliding(CFG).pane_us
    assert sum(pane >= oldest for pane in fold.panes) <= 4 and len(fold.marked) <= 3


def test_replayed_and_half_written_batches_change_nothing(spark, tmp_path):
    folder = str(tmp_path / "table")
    rows = lambda value: spark.createDataFrame([("a", value), ("b", value)], "key string, value long")
    schema = rows(0).schema
    assert commits.read_committed(spark, folder, schema).collect() == []
    assert commits.write_batch(rows(1), 0, folder)
    assert not commits.write_batch(rows(99), 0, folder)
    rows(7).write.parquet(f"{folder}/data/batch-1-stopped")  # written, never committed
    (tmp_path / "table" / "commits" / ".batch-1-stopped").write_text("1 batch-1-stopped\n")
    assert commits.write_batch(rows(3).where("key = 'b'"), 10, folder)
    read = commits.read_committed(spark, folder, schema)
    assert sorted(map(tuple, read.collect())) == [("a", 1, 0), ("b", 1, 0), ("b", 3, 10)]
    assert sorted(map(tuple, commits.latest(read, "key").collect())) == [("a", 1), ("b", 3)]


def test_captures_share_a_bounded_number_of_groups(spark, tmp_path):
    packets = [packet(name, i, 1 + i * 7, nas=[86], rand=str(i % 2)) for name in [None, *(f"c{k}" for k in range(30))] for i in range(12)]
    folder = str(tmp_path / "packets")
    table(spark, packets).coalesce(1).write.parquet(folder)
    table(spark, [packet("end", 0, 90_000)]).coalesce(1).write.mode("append").parquet(folder)
    stream = captures.sliding_windows(jobs.packet_stream(spark, folder, "20 seconds", 1), CFG, 250, ScaleLimits(capture_groups=4))
    captures.state_store(spark)
    try:
        query = commits.committed_sink(stream, str(tmp_path / "out"), str(tmp_path / "log"))
        query.awaitTermination(300)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert query.exception() is None
    operators = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    # a state and a timer, with its index, for each group
    assert 0 < max(o["numRowsTotal"] for o in operators) <= 3 * 4
    got = commits.read_committed(spark, str(tmp_path / "out"), stream.schema).where("capture IS NULL OR capture <> 'end'")
    per_capture = {r.capture: (r.n, r.total) for r in got.groupBy("capture").agg(F.count("*").alias("n"), F.sum("total_packets").alias("total")).collect()}
    assert len(per_capture) == 31 and len(set(per_capture.values())) == 1
