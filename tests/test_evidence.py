import pytest
from pyspark.sql import functions as F

from authsignal.operators import evidence as ev
from tests.packets import packet, table

SUCI = "suci-0-901-70-0000-2-7-0a1b2c3d"
GREEN, OFF, YELLOW, WARN, INFO = "\x1b[32m", "\x1b[0m", "\x1b[33m", "\x1b[1;36m", "\x1b[1;32m"


def amf(stamp, module, level, colour, message, place="handler.c:77"):
    return f"{GREEN}{stamp}{OFF}: [{YELLOW}{module}{OFF}] {colour}{level}{OFF}: {message} (../lib/core/{place})"


REJECTS = [amf(f"06/15 01:02:{s}", "amf", "WARNING", WARN, f"[{SUCI}] Registration reject [23]") for s in ("10.100", "20.200", "30.300", "40.400")]
BASE_STATION = [
    amf("07/01 12:00:00.001", "amf", "INFO", INFO, "gNB-N2 accepted[172.16.5.9]:40000 in path module"),
    amf("07/01 12:00:00.002", "amf", "INFO", INFO, "gNB-N2[172.16.5.9] streams : 4"),
    amf("07/01 12:30:00.500", "amf", "INFO", INFO, "gNB-N2[172.16.5.9] connection refused!!!"),
]
SUPI = [
    amf("07/02 08:00:00.000", "amf", "INFO", INFO, "[suci-0-901-70-0000-0-0-0000000042] Unknown UE by SUCI"),
    amf("07/02 08:00:01.250", "gmm", "INFO", INFO, "UE SUPI[imsi-901700000000042] DNN[test] S_NSSAI[SST:2 SD:0x3]"),
]
OTHER = ["a banner with MAC failure", "", amf("02/29 10:00:00.000", "amf", "INFO", INFO, "no such day")]
LINES = "capture string, source string, seq long, line string"


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [("cap", "amf", i, line) for i, line in enumerate(REJECTS + BASE_STATION + SUPI + OTHER)]
    return ev.parse_amf(spark.createDataFrame(rows, LINES), 2026)


def test_amf_lines(parsed):
    rows = parsed.orderBy("seq").collect()
    assert len(rows) == 12
    first = rows[0]
    assert (first.stamp, first.module, first.level, first.place) == ("06/15 01:02:10.100", "amf", "WARNING", "../lib/core/handler.c:77")
    assert first.message == f"[{SUCI}] Registration reject [23]" and first.ts.year == 2026 and first.ts.microsecond == 100_000
    assert rows[8].module == "gmm"
    # lines of another shape stay, without a time; so does a stamp that is no day of its year
    assert [(r.parsed, r.ts, r.message) for r in rows[9:]] == [
        (False, None, "a banner with MAC failure"), (False, None, ""), (True, None, "no such day"),
    ]


def test_year_by_line(spark):
    rows = [("c", "s", 1, amf("12/31 23:59:59.999", "amf", "INFO", INFO, "x")), ("c", "s", 2, amf("02/29 00:00:00.000", "amf", "INFO", INFO, "y"))]
    table = spark.createDataFrame(rows, LINES)
    got = ev.parse_amf(table, F.when(F.col("seq") == 1, 2023).otherwise(2024)).orderBy("seq").collect()
    assert [r.ts.year for r in got] == [2023, 2024]


def test_overlong_numbers_are_null(spark):
    text = f"    {'9' * 30}   2.5   172.16.0.1 → 172.16.0.2   NGAP {'8' * 30} x"
    row = ev.parse_summary(spark.createDataFrame([(text,)], "line string")).first()
    assert (row.frame_no, row.seconds, row.length) == (None, 2.5, None)


def test_log_only_captures_keep_their_verdict(spark, parsed):
    packets = table(spark, [packet("quiet", 0, 0), packet(None, 1, 0)])
    for rows in (ev.failure_evidence(packets, parsed), ev.rogue_evidence(packets, parsed, "172.16.5.9"), ev.reject_evidence(packets, parsed)):
        got = {r.capture: r.detected for r in rows.collect()}
        assert got == {"cap": True, "quiet": False, None: False}
    late = ev.rogue_evidence(packets, parsed, "172.16.5.9", F.lit("2026-07-01 12:30:00").cast("timestamp")).where("capture = 'cap'").first()
    assert late.refused and not late.accepted


def test_sections(spark, parsed):
    packets = table(spark, [packet("cap", 1, 0, info="NGSetupRequest"), packet("cap", 2, 0, info="Protection scheme Id: NULL scheme (0)", scheme=0)])
    got = ev.evidence_sections(packets, parsed).groupBy("section").count().collect()
    assert {r.section: r["count"] for r in got} == {"packets": 1, "scheme_lines": 1, "scheme_values": 1, "log": 6, "base_station": 3}


def test_identifiers(parsed):
    rows = ev.with_identifiers(parsed).orderBy("seq").collect()
    assert (rows[0].suci, rows[0].scheme, rows[0].cause, rows[0].gnb_ip) == (SUCI, 2, 23, None)
    assert [r.gnb_ip for r in rows[4:7]] == ["172.16.5.9"] * 3
    assert rows[7].scheme == 0 and rows[8].imsi == "imsi-901700000000042"


def test_other_formats(spark):
    def lines(*text):
        return spark.createDataFrame([(t,) for t in text], "line string")

    sim = ev.parse_simulator(lines("[2025-03-04 05:06:07.089] [ran] [info] set-up answered", "banner")).where("parsed").collect()
    assert len(sim) == 1 and (sim[0].module, sim[0].level, sim[0].message) == ("ran", "info", "set-up answered")
    text = "   17   9.125000   172.16.0.2 → 172.16.0.3   NGAP/NAS-5GS 240 SACK (Ack=5, Arwnd=4096) , UplinkNASTransport, Registration reject (illegal device)"
    s = ev.parse_summary(lines(text)).first()
    assert (s.frame_no, s.seconds, s.src_ip, s.dst_ip, s.protocol, s.length) == (17, 9.125, "172.16.0.2", "172.16.0.3", "NGAP/NAS-5GS", 240)
    assert s.info.endswith("device)")
    d = ev.parse_dump(lines("01:02:03.000456 IP 172.16.0.3.38412 > 172.16.0.2.9999: sctp (1) [ABORT]")).first()
    assert (d.time, d.src_ip, d.src_port, d.dst_ip, d.dst_port, d.chunk) == ("01:02:03.000456", "172.16.0.3", 38412, "172.16.0.2", 9999, "ABORT")


def test_verdicts(spark, parsed):
    reject = "DownlinkNASTransport, Registration reject (illegal device)"
    packets = table(
        spark,
        [
            packet("cap", 1, 0, info="NGSetupRequest", src="172.16.5.9"),
            packet("cap", 2, 1, info="NGSetupResponse"),
            packet("cap", 3, 2, info="DownlinkNASTransport, Authentication request", rand="01:23:45:67:89:AB:CD:EF:01:23:45:67:89:AB:CD:EF"),
            packet("cap", 4, 3, info="ABORT", rand="00" * 16),
            *[packet("cap", 5 + i, 4 + i, info=reject) for i in range(3)],
            packet("cap", 9, 9, info="Protection scheme Id: NULL scheme (0)", scheme=0),
            packet("cap", 10, 10, scheme=1),
            packet("cap", 11, 11, scheme=1, nas=[89]),
            packet("quiet", 0, 0),
        ],
    )
    got = {r.capture: r for r in ev.reject_evidence(packets, parsed).collect()}
    assert (got["cap"].packet_rejects, got["cap"].log_rejects, got["cap"].detected) == (3, 4, True)
    assert (got["quiet"].packet_rejects, got["quiet"].log_rejects, got["quiet"].detected) == (0, 0, False)
    got = {r.capture: r for r in ev.rogue_evidence(packets, parsed, "172.16.5.9").collect()}
    r = got["cap"]
    assert (r.setup_response, r.setup_failure, r.auth_seen, r.refused, r.accepted, r.detected) == (True, False, True, True, True, True)
    assert not got["quiet"].detected
    r = {r.capture: r for r in ev.null_scheme_evidence(packets).collect()}["cap"]
    assert (r.text_hits, r.field_hits, r.schemes_seen, r.detected) == (1, 1, 3, True)
    r = {r.capture: r for r in ev.abort_evidence(packets).collect()}["cap"]
    assert r.abort_seen and r.first_rand == "0123456789abcdef0123456789abcdef"
    r = {r.capture: r for r in ev.failure_evidence(packets, parsed).collect()}["cap"]
    assert (r.failure_packets, r.log_failures, r.detected) == (1, 1, True)


def test_occurrences_may_exceed_lines(spark):
    texts = spark.createDataFrame([("a", "Reject reject, rejected"), ("a", None), ("b", "none")], "k string, text string")
    got = {r.k: r.n for r in ev.keyword_occurrences(texts, "text", {"n": "reject"}, "k").collect()}
    assert got == {"a": 3, "b": 0}


def test_recent_failures_look_at_the_last_lines_only(spark):
    lines = [(1, "s", f"x Authentication failure [MAC failure] {i}") for i in range(30)]
    rows = [(i, "s", m if i % 2 else "Authentication reject") for i, (_, _, m) in enumerate(lines)]
    table = spark.createDataFrame(rows, "seq long, source string, message string")
    r = ev.recent_failures(table, "source", "seq", 20).first()
    assert (r.failures, r.lines) == (10, 20)
    tail = ev.last_registrations(table.withColumn("message", F.lit("UE SUPI[...]")), "source", "seq", 2).orderBy("rank").collect()
    assert [r.seq for r in tail] == [29, 28]


def test_keyword_since(parsed):
    since = F.lit("2026-06-15 01:02:20.200").cast("timestamp")
    got = ev.keyword_counts(parsed, {"n": "Registration reject"}, since, "source").first()
    assert got.n == 3
