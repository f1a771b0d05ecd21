import pytest
from pyspark.sql import functions as F

from authsignal.config import DetectorConfig, ScaleLimits
from authsignal.operators.features import Layout, panes, sliding_features, tumbling_features, window_features
from authsignal.operators.windows import best_window, capture_verdict_inputs, apply_overrides, time_slice
from authsignal.plans.detection import capture_features
from authsignal.operators.rules import online_class
from authsignal.sources.captures import capture_duration, with_capture_clock, with_capture_length
from tests.packets import packet, table

CFG = DetectorConfig()


@pytest.fixture(scope="module")
def cases(spark):
    rows = [
        *[packet("long65", i, s) for i, s in enumerate((0, 29.999999, 30, 65))],
        *[packet("exact60", i, s) for i, s in enumerate((0, 30, 60))],
        *[packet("short12", i, s) for i, s in enumerate((0, 5, 12))],
        packet("single", 0, 0, nas=[86]),
        packet("gap", 0, 0),
        packet("gap", 1, 95),
        packet("bundled", 0, 0, nas=[65, 65]),
        packet("bundled", 1, 40),
        packet("together", 0, 1, scheme=0),
        packet("together", 1, 2, src="10.10.0.41"),
        packet("together", 2, 40),
        packet("twice", 0, 1, nas=[86], rand="ab"),
        packet("twice", 1, 9, nas=[86], rand="ab"),
        packet("twice", 2, 40),
        packet("across", 0, 1, nas=[86], rand="ab"),
        packet("across", 1, 25, nas=[86], rand="ab"),
        packet("across", 2, 55, nas=[86], rand="ab"),
        packet("across", 3, 70),
        packet("once", 0, 1, rand="ab"),
        packet("once", 1, 2, rand="cd"),
        packet("once", 2, 40),
        packet("unordered", 0, 0),
        packet("unordered", 1, 45),
        packet("unordered", 2, 41),
    ]
    return table(spark, rows)


def by_window(rows, capture):
    found = rows.where(F.col("capture") == capture).orderBy("w").collect()
    return {int(r.t_start): r for r in found}


def test_sliding_bounds(cases):
    rows = sliding_features(cases, CFG).cache()
    got = by_window(rows, "long65")
    assert {t: r.total_packets for t, r in got.items()} == {0: 2, 10: 2, 20: 2, 30: 1}
    assert {t: r.total_packets for t, r in by_window(rows, "exact60").items()} == {0: 1, 10: 1, 20: 1, 30: 1}
    short = by_window(rows, "short12")
    assert list(short) == [0] and short[0].total_packets == 2 and short[0].duration == 12.0 and short[0].t_end == 12.0


def test_empty_windows_are_emitted(cases):
    rows = by_window(sliding_features(cases, CFG), "gap")
    assert sorted(rows) == [0, 10, 20, 30, 40, 50, 60]
    assert [rows[t].total_packets for t in sorted(rows)] == [1, 0, 0, 0, 0, 0, 0]
    assert rows[10].auth_rate == 0.0 and rows[10].suci_unencrypted == 0


def test_tumbling_bounds(cases):
    rows = tumbling_features(cases, CFG).cache()
    assert {t: r.total_packets for t, r in by_window(rows, "exact60").items()} == {0: 1, 30: 1}
    assert {t: r.total_packets for t, r in by_window(rows, "long65").items()} == {0: 2, 30: 1, 60: 1}
    single = by_window(rows, "single")
    assert list(single) == [0] and single[0].total_packets == 1 and single[0].duration == 30.0
    assert single[0].auth_rate == 0.0333


def test_zero_length_capture_is_guarded(cases):
    row = by_window(sliding_features(cases, CFG), "single")[0]
    assert (row.total_packets, row.duration, row.auth_rate) == (0, 0.0, 0.0)


def test_bundled_message_counts_once(cases):
    assert by_window(sliding_features(cases, CFG), "bundled")[0].reg_requests == 1


def test_null_scheme_and_watched_address_in_different_packets(cases):
    assert by_window(sliding_features(cases, CFG), "together")[0].suci_unencrypted == 1


def test_repeated_rand(cases):
    rows = sliding_features(cases, CFG).cache()
    flags = lambda c: {t: r.rand_repeat for t, r in by_window(rows, c).items()}
    assert flags("twice") == {0: 1, 10: 0}
    # 1 and 25 meet in [0, 30); 25 and 55 meet in no window of 30 seconds that starts on a step
    assert flags("across") == {0: 1, 10: 0, 20: 0, 30: 0, 40: 0}
    assert set(flags("once").values()) == {0}


def test_rand_repeat_against_brute_force(spark):
    import random

    rng = random.Random(5)
    rows, frame = [], 0
    for c in range(12):
        length = rng.choice([8, 31, 70, 140])
        times = sorted(rng.uniform(0, length) for _ in range(40))
        for s in times:
            rows.append(packet(f"c{c}", frame, round(s, 6), nas=[86], rand=rng.choice(["a", "b", "c", None, "d", "e"])))
            frame += 1
    got = {(r.capture, int(r.t_start)): (r.total_packets, r.rand_repeat) for r in sliding_features(table(spark, rows), CFG).collect()}
    want = {}
    for c in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == c]
        last = max(mine, key=lambda r: r[1])[3]
        starts = [0] if last < 30_000_000 else range(0, (last - 30_000_000) // 10_000_000 * 10 + 1, 10)
        for t in starts:
            end = last if last < 30_000_000 else (t + 30) * 1_000_000
            inside = [r for r in mine if t * 1_000_000 <= r[3] < end]
            rands = [r[11] for r in inside if r[11]]
            want[(c, t)] = (len(inside), int(len(rands) != len(set(rands))))
    assert got == want


def test_duration_is_the_last_row(cases):
    got = {r.capture: r.capture_us for r in capture_duration(cases).collect()}
    assert got["unordered"] == 41_000_000 and got["single"] == 0


def test_every_packet_is_in_at_most_three_windows(cases):
    n = sliding_features(cases, CFG).agg(F.sum("total_packets")).first()[0]
    assert n <= 3 * cases.count()


def test_tumbling_totals_match_packets(cases):
    totals = {r.capture: r.n for r in tumbling_features(cases, CFG).groupBy("capture").agg(F.sum("total_packets").alias("n")).collect()}
    lengths = {r.capture: r.capture_us for r in capture_duration(cases).collect()}
    for capture, n in totals.items():
        bound = 30_000_000 * max(1, -(-lengths[capture] // 30_000_000))
        assert n == cases.where((F.col("capture") == capture) & (F.col("rel_us") < bound)).count()


def test_row_order_does_not_matter(cases):
    a = sliding_features(cases, CFG).orderBy("capture", "w").collect()
    b = sliding_features(cases.orderBy(F.rand(3)).repartition(7), CFG).orderBy("capture", "w").collect()
    assert a == b


def test_earliest_window_wins_ties(spark):
    rows = [packet("tie", i, s) for i, s in enumerate((1, 2, 31, 32, 65))]
    packets = table(spark, rows)
    assert capture_verdict_inputs(packets, CFG).first().t_start == 0.0
    assert best_window(tumbling_features(packets, CFG)).first().t_start == 0.0


def test_overrides(spark):
    rows = [
        *[packet("spread", i, s, nas=[89]) for i, s in enumerate((1, 2, 31, 32, 61))],
        packet("spread", 9, 62),
        packet("rogue", 0, 1, ngap=[21], src="10.10.0.50"),
        packet("rogue", 1, 35),
        packet("answered", 0, 1, ngap=[21], src="10.10.0.30"),
        packet("answered", 1, 2, ngap=[21], src="10.10.0.12"),
        packet("answered", 2, 35),
        *[packet("late", i, i, nas=[86]) for i in range(20)],
        packet("late", 30, 60, sctp=[6]),
        packet("aborts", 0, 1, sctp=[6]),
        packet("aborts", 1, 2, sctp=[6]),
        packet("aborts", 2, 40),
    ]
    got = {
        r.capture: r
        for r in capture_features(table(spark, rows), CFG).withColumn("prediction", online_class(CFG)).collect()
    }
    assert got["spread"].auth_failures == 5 and got["spread"].prediction == "brute_force"
    assert got["rogue"].ng_setup_req == 99 and got["rogue"].prediction == "false_bs"
    assert got["answered"].ng_setup_req == 2 and got["answered"].prediction == "model"
    assert got["late"].prediction == "replay" and got["late"].sctp_abort == 1
    assert got["aborts"].sctp_abort == 1 and got["aborts"].prediction == "replay"


def test_unreadable_duration_defaults_to_one_window(spark):
    rows = [packet("x", 0, 1), packet("x", 1, 2)]
    packets = table(spark, rows).withColumn("rel_us", F.when(F.col("frame_no") == 1, None).otherwise(F.col("rel_us")))
    assert with_capture_length(packets, unreadable_us=CFG.window_us).first().capture_us == 30_000_000


def test_long_capture_grid_comes_in_blocks(spark):
    rows = [packet("long", 0, 0), packet("long", 1, 1_000)]
    small = ScaleLimits(span_block=7)
    got = window_features(table(spark, rows), CFG, Layout.sliding(CFG), small)
    assert got.count() == (1_000 - 30) // 10 + 1 and got.select("w").distinct().count() == got.count()


def test_salted_join_gives_the_same_rows(spark, cases):
    stamped = cases.withColumn("ts_us", F.unix_micros("ts")).drop("rel_us")
    plain = with_capture_clock(stamped)
    salted = with_capture_clock(stamped, ScaleLimits(broadcast_bytes=0, hot_rows=1, hot_keys=8))
    joined = with_capture_clock(stamped, ScaleLimits(broadcast_bytes=0))
    key = lambda df: sorted((r.capture, r.frame_no, r.rel_us, r.capture_us, r.last_frame) for r in df.collect())
    assert key(plain) == key(salted) == key(joined) and plain.count() == cases.count()
    assert "_salt" in salted._jdf.queryExecution().toString()


def test_time_slice_is_half_open(cases):
    got = time_slice(cases.where("capture = 'exact60'"), 0, 30_000_000).collect()
    assert [r.rel_us for r in got] == [0]
    # one of "single", two of "twice", and of "across" those at 1 and 25 seconds
    assert time_slice(cases, 0, 30_000_000, F.array_contains("nas_msg_types", 86)).count() == 5


def test_plans_have_no_nested_loops_or_python(cases):
    for layout in (Layout.sliding(CFG), Layout.tumbling(CFG)):
        plan = window_features(cases, CFG, layout)._jdf.queryExecution().executedPlan().toString()
        for node in ("BroadcastNestedLoopJoin", "CartesianProduct", "ArrowEvalPython", "BatchEvalPython"):
            assert node not in plan
    plan = panes(with_capture_length(cases), CFG, Layout.sliding(CFG))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "partial_count" in plan


def test_overlap_percent():
    assert CFG.overlap_percent == 66


def test_detection_joins_no_clock_onto_packets(spark):
    """The plan of a bare packet table has no join but the one of RAND windows, on rows of one per window."""
    from authsignal.plans.detection import capture_features

    packets = table(spark, [packet("a", k, k * 7.5, nas=[89], rand=str(k % 2)) for k in range(17)])
    df = capture_features(packets, CFG)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
    # the last packet stands at the end of the fourth window and is in none of them
    row = df.first()
    assert (row.capture_us, row.total_packets, row.all_failures, row.rand_repeat) == (120_000_000, 4, 17, 1)
