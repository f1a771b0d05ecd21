import pytest
from pyspark.sql import functions as F

from authsignal.config import DetectorConfig, ScaleLimits
from authsignal.operators.respond import rate_limits
from authsignal.schemas import PACKET
from authsignal.sources import events as ev
from authsignal.streaming import commits, jobs
from tests.packets import packet, table

CFG = DetectorConfig()


@pytest.fixture(scope="module")
def stream_folder(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("stream") / "packets")
    rows = [
        *[packet("a", i, 1 + i * 2, nas=[86], rand=str(i % 3), subscriber=7) for i in range(10)],
        *[packet("a", 20 + i, 22 + i, nas=[89], subscriber=7) for i in range(6)],
        packet("b", 0, 3, scheme=0),
        packet("b", 1, 4, src="10.10.0.41"),
        packet("b", 2, 50, sctp=[6]),
        packet("c", 0, 5, ngap=[21], src="10.10.0.50"),
        packet("c", 1, 200),
        packet("end", 0, 3_000),
    ]
    packets = table(spark, rows)
    # the packet that closes all windows arrives last
    packets.where("capture <> 'end'").coalesce(1).write.parquet(folder)
    packets.where("capture = 'end'").coalesce(1).write.mode("append").parquet(folder)
    return folder


def run(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        query.awaitTermination(300)
        assert query.exception() is None
    finally:
        query.stop()
    return df.sparkSession.table(name)


def batch_windows(spark, folder):
    """The same clock windows, counted in batch with a distinct count."""
    packets = spark.read.schema(PACKET).parquet(folder)
    return packets.groupBy(F.window("ts", "30 seconds", "10 seconds").alias("s"), "capture").agg(
        F.count("*").alias("total_packets"),
        F.count_if(F.array_contains("nas_msg_types", 86)).alias("auth_requests"),
        F.count_if(F.array_contains("nas_msg_types", 89)).alias("auth_failures"),
        (F.count("rand") > F.count_distinct("rand")).cast("int").alias("rand_repeat"),
    )


def test_stream_windows_equal_batch_on_closed_windows(spark, stream_folder):
    got = run(jobs.window_features(jobs.packet_stream(spark, stream_folder), CFG), "windows")
    columns = ["capture", "start", "total_packets", "auth_requests", "auth_failures", "rand_repeat"]
    left = {tuple(r) for r in got.selectExpr("capture", "unix_micros(t_start)", *columns[2:]).collect()}
    closed = batch_windows(spark, stream_folder).where("capture <> 'end'")
    right = {tuple(r) for r in closed.selectExpr("capture", "unix_micros(s.start)", *columns[2:]).collect()}
    assert left == right and len(right) > 10
    assert any(r[-1] == 1 for r in right)


def test_stream_scores_and_alerts(spark, stream_folder, tmp_path):
    windows = jobs.window_features(jobs.packet_stream(spark, stream_folder), CFG)
    got = run(jobs.score_windows(windows, CFG), "scored")
    verdicts = {(r.capture, r.prediction) for r in got.collect()}
    assert {("a", "brute_force"), ("b", "supi_harvest"), ("b", "replay"), ("c", "false_bs")} <= verdicts
    windows = jobs.window_features(jobs.packet_stream(spark, stream_folder), CFG)
    query = jobs.alert_sink(jobs.alerts(jobs.score_windows(windows, CFG)), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(300)
    query.stop()
    rows = [(r.capture, r.prediction) for r in spark.read.json(str(tmp_path / "out" / "json")).collect()]
    assert len(rows) == len(set(rows))
    assert {("a", "brute_force"), ("b", "supi_harvest"), ("b", "replay"), ("c", "false_bs")} <= set(rows)
    lines = [r.value for r in spark.read.text(str(tmp_path / "out" / "log")).collect()]
    assert len(lines) == len(rows) and all("] [ALERT] ATTACK DETECTED: " in line for line in lines)


def test_running_overrides(spark, stream_folder):
    got = run(jobs.running_overrides(jobs.packet_stream(spark, stream_folder), CFG), "overrides", "complete")
    rows = {r.capture: r for r in got.collect()}
    assert rows["a"].all_failures == 6 and rows["b"].any_abort and rows["c"].any_rogue and not rows["a"].any_rogue


def test_rate_limiter_equals_batch(spark, stream_folder):
    packets = jobs.packet_stream(spark, stream_folder)
    got = {tuple(r) for r in run(jobs.rate_limiter(packets, CFG), "limits").collect()}
    batch = spark.read.schema(PACKET).parquet(stream_folder)
    want = {tuple(r) for r in rate_limits(batch, CFG).collect()}
    assert got == want and any(r[4] for r in want) and any(r[5] for r in want)


def test_rate_limiter_deals_subscribers_to_a_bounded_number_of_groups(spark, tmp_path):
    many = [9_007_199_254_740_993 + k for k in range(40)]  # neither null ids nor such large ones may be rounded
    rows = [packet("a", 100 * s + i, 1 + i * 7, nas=[86 if i % 3 else 89], subscriber=who) for s, who in enumerate([None, 0, *many]) for i in range(9)]
    packets, folder = table(spark, rows), str(tmp_path / "packets")
    for part in range(3):  # packets of every instant come late
        packets.where(F.col("frame_no") % 3 == part).coalesce(1).write.mode("append").parquet(folder)
    rows = jobs.rate_limiter(jobs.packet_stream(spark, folder, "1 day", 1), CFG, ScaleLimits(rate_groups=4))
    query = commits.committed_sink(rows, str(tmp_path / "out"), str(tmp_path / "log"))
    query.awaitTermination(300)
    assert query.exception() is None and query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4 * 3
    got = commits.latest(commits.read_committed(spark, str(tmp_path / "out"), rows.schema), "subscriber", "at_us")
    want = {tuple(r) for r in rate_limits(spark.read.schema(PACKET).parquet(folder), CFG).collect()}
    assert {tuple(r) for r in got.collect()} == want and len(want) == 42 * 9


def test_shuffled_events_are_three_batches_however_many_files(spark, tmp_path):
    rows = spark.range(0, 400, 1, 8).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "id % 7 AS user_id", "'click' AS event_type", "1D AS value", "'{}' AS props"
    )
    rows.write.parquet(str(tmp_path / "events.parquet"))
    seen = []
    stream = ev.shuffled_packet_stream(spark, str(tmp_path), "1 day").writeStream.foreachBatch(lambda batch, _: seen.append(batch.count()))
    query = stream.option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    batches = [n for n in seen if n]
    assert query.exception() is None and len(batches) == 3 and sum(batches) == 400
