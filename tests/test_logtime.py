"""Times of log lines against a plain loop."""

import random
import re
from datetime import datetime, timedelta

import pytest

from authsignal.operators import evidence as ev
from authsignal.operators.logtime import with_line_times

LINE = "source string, seq long, stamp string, message string"


def loop(rows, first_year):
    """The same by reading each source from its first line to the last."""
    out = {}
    for source in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == source), key=lambda r: r[1])
        year, last, found = first_year, None, []
        for _, seq, stamp, *_ in own:
            try:
                at = datetime.strptime("2000/" + stamp + "000", "%Y/%m/%d %H:%M:%S.%f") if stamp else None
            except ValueError:
                at = None
            if at and last:
                year += (last[0] - at > timedelta(days=183)) - (at - last[0] > timedelta(days=183))
            if at:
                last = (at, stamp)
            found.append((seq, last, year, at is None))
        first = next((f for f in found if f[1]), None)
        for seq, stamped, of, missing in found:
            stamped = stamped or (first and first[1])
            if not stamped:
                out[source, seq] = (None, None, False)
                continue
            try:
                ts = datetime.strptime(f"{of}/{stamped[1]}000", "%Y/%m/%d %H:%M:%S.%f")
            except ValueError:
                ts = None
            out[source, seq] = (ts, of, missing)
    return out


def check(spark, rows, block, first_year=2023):
    df = spark.createDataFrame([(*r, "m") for r in rows], LINE)
    got = {(r.source, r.seq): (r.ts, r.year, r.carried) for r in with_line_times(df, first_year=first_year, block=block).collect()}
    assert got == loop(rows, first_year)
    return got


@pytest.mark.parametrize("block", [1, 3, 7, 1_000])
def test_times_equal_a_loop(spark, block):
    draw = random.Random(block)
    rows = []
    for source in ("a", "b", None, "none"):
        at = datetime(2023, 10, 1)
        for seq in range(-20, 60):
            at += timedelta(days=draw.choice([0, 1, 9, 25]), hours=draw.choice([0, 5, -30]))
            stamp = None if source == "none" or draw.random() < 0.4 else at.strftime("%m/%d %H:%M:%S.%f")[:-3]
            rows.append((source, seq * 2, draw.choice([stamp] * 8 + ["13/45 00:00:00.000"]) if stamp else None))
    got = check(spark, rows, block)
    years = {year for (source, _), (_, year, _) in got.items() if source == "a"}
    assert len(years) >= 3 or block == 1_000


def test_late_lines_around_new_year(spark):
    stamps = ["12/31 23:59:59.000", "01/01 00:00:01.000", None, "12/31 23:59:59.500", None, "01/01 00:00:02.000"]
    got = check(spark, [("s", k, stamp) for k, stamp in enumerate(stamps)], 2)
    assert [got["s", k][1] for k in range(6)] == [2023, 2024, 2024, 2023, 2023, 2024]


def test_odd_lines(spark):
    assert with_line_times(spark.createDataFrame([], LINE)).collect() == []
    got = check(spark, [("s", 0, None), ("s", 1, None), ("s", 2, "02/29 10:00:00.000"), ("s", 3, None)], 2)
    assert got["s", 3] == (None, 2023, True)
    assert check(spark, [("s", 5, "02/29 10:00:00.000")], 2, 2024)["s", 5][0] == datetime(2024, 2, 29, 10)


def test_no_line_of_any_format_is_lost(spark):
    lines = lambda *texts: spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "seq long, line string")
    amf = "03/04 05:06:07.089: [gmm] INFO: one\x01two\x01 (gmm.c:7)"
    got = ev.parse_amf(lines(amf, "broken \x01 line", "\x01"), 2025).orderBy("seq").collect()
    assert [(r.parsed, r.message) for r in got] == [(True, "one\x01two\x01"), (False, "broken \x01 line"), (False, "\x01")]
    sim = ev.parse_simulator(lines("[2025-03-04 05:06:07.089] [ran] [info] set-up", "banner")).orderBy("seq").collect()
    assert [(r.parsed, r.message) for r in sim] == [(True, "set-up"), (False, "banner")]
    summary = ev.parse_summary(lines("  7  1.5 10.0.0.1 → 10.0.0.2  NGAP 90 a\x01b", "[frame dropped]", "")).orderBy("seq").collect()
    assert [(r.parsed, r.frame_no, r.info) for r in summary] == [(True, 7, "a\x01b"), (False, None, "[frame dropped]"), (False, None, "")]
    dump = ev.parse_dump(lines("01:02:03.000456 IP 172.16.0.3.38412 > 172.16.0.2.9999: sctp (1) [ABORT]", "tcpdump: listening")).orderBy("seq").collect()
    assert [(r.parsed, r.chunk, r.rest) for r in dump] == [(True, "ABORT", None), (False, None, "tcpdump: listening")]


def test_plan_sorts_no_source_in_one_task(spark):
    """Windows over lines lie within a block; windows over whole sources see one row per block."""
    df = spark.createDataFrame([("s", k, None, "m") for k in range(9)], LINE)
    plan = with_line_times(df, block=3)._jdf.queryExecution().optimizedPlan().toString()
    windows = re.findall(r"windowspecdefinition\((.*?), specifiedwindowframe", plan)
    of_lines = [w for w in windows if re.search(r"seq#\d+L ASC", w)]
    of_blocks = [w for w in windows if w not in of_lines]
    assert of_lines and all(re.match(r"source#\d+, _block#\d+L, seq#", w) for w in of_lines)
    assert of_blocks and all(re.match(r"source#\d+, _block#\d+L ASC", w) for w in of_blocks)
