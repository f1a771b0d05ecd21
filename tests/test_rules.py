import pytest
from pyspark.sql import functions as F

from authsignal.config import DetectorConfig, SCORE_ORDER
from authsignal.operators import rules
from authsignal.operators.features import rate_columns
from authsignal.operators.respond import online_actions
from authsignal.plans.detection import decide

NAMES = (
    "suci_unencrypted reg_rejects sec_mode_cmds auth_failures sctp_abort ng_setup_req rand_repeat "
    "auth_requests auth_rate auth_success_rate reject_rate"
).split()

# ---- fixed values: published feature rows of six captures ----
GOLDEN = [
    ("normal", 315, 2, 2, 0, 2, 0, 0, 45.0, 0.0444, 0.0444, 0.0, 1.0, 0),
    ("brute_force", 2156, 28, 28, 0, 8, 0, 0, 400.37, 0.0699, 0.0699, 0.0, 1.0, 0),
    ("supi_harvest", 339, 3, 3, 0, 3, 0, 1, 32.29, 0.0929, 0.0929, 0.0, 1.0, 0),
    ("bidding_down", 290, 2, 6, 4, 2, 0, 0, 33.44, 0.0598, 0.1794, 0.6667, 0.0, 0),
    ("replay", 208, 1, 1, 0, 1, 0, 0, 40.4, 0.0248, 0.0248, 0.0, 1.0, 0),
    ("false_bs", 529, 3, 3, 0, 3, 2, 0, 85.43, 0.0351, 0.0351, 0.0, 1.0, 0),
]
GOLDEN_NAMES = (
    "label total_packets auth_requests reg_requests reg_rejects sec_mode_cmds ng_setup_req suci_unencrypted "
    "duration auth_rate reg_rate reject_rate auth_success_rate rand_repeat"
).split()
RATES = ["auth_rate", "reg_rate", "reject_rate", "auth_success_rate"]


@pytest.fixture(scope="module")
def golden(spark):
    return spark.createDataFrame(GOLDEN, GOLDEN_NAMES).withColumns(
        {"auth_failures": F.lit(0).cast("bigint"), "sctp_abort": F.lit(0).cast("bigint")}
    )


def test_rates_of_published_rows(golden):
    again = rate_columns(golden.drop(*RATES)).select("label", *RATES).collect()
    assert {tuple(r) for r in again} == {(g[0], *g[9:13]) for g in GOLDEN}


def test_rules_on_published_rows(golden):
    want = ["normal", "normal", "supi_harvest", "bidding_down", "normal", "false_bs"]
    rows = rules.with_weighted_scores(golden).select(
        "label", rules.simple_class().alias("simple"), rules.weighted_class().alias("weighted")
    )
    got = {r.label: r for r in rows.collect()}
    assert [got[g[0]].simple for g in GOLDEN] == want
    assert [got[g[0]].weighted for g in GOLDEN] == want


def one(spark, **values):
    row = {n: values.get(n, 0.0 if "rate" in n else 0) for n in NAMES}
    row["auth_success_rate"] = values.get("auth_success_rate", 1.0)
    return spark.createDataFrame([tuple(row[n] for n in NAMES)], NAMES)


@pytest.mark.parametrize(
    "values, online, simple, offline",
    [
        ({"suci_unencrypted": 1, "reg_rejects": 1, "sec_mode_cmds": 1}, "supi_harvest", "supi_harvest", "supi_harvest"),
        ({"reg_rejects": 1, "sec_mode_cmds": 1, "auth_failures": 9}, "bidding_down", "bidding_down", "bidding_down"),
        ({"auth_failures": 5}, "brute_force", "brute_force", "brute_force"),
        ({"auth_failures": 4}, "model", "brute_force", "brute_force"),
        ({"sctp_abort": 1}, "replay", "replay", "replay"),
        ({"sctp_abort": 2}, "replay", "normal", "model"),
        ({"rand_repeat": 1}, "model", "replay", "model"),
        ({"ng_setup_req": 99}, "false_bs", "false_bs", "model"),
        ({"ng_setup_req": 1}, "model", "false_bs", "model"),
        ({"ng_setup_req": 1, "reg_rejects": 1}, "model", "normal", "model"),
        ({"auth_rate": 0.04, "auth_success_rate": 0.4}, "model", "brute_force", "model"),
        ({"auth_rate": 0.03, "auth_success_rate": 0.4}, "model", "normal", "model"),
        ({}, "model", "normal", "model"),
    ],
)
def test_first_match_rules(spark, values, online, simple, offline):
    row = one(spark, **values).select(
        rules.online_class().alias("a"), rules.simple_class().alias("b"), rules.offline_class().alias("c")
    ).first()
    assert tuple(row) == (online, simple, offline)


# what each row scores, worked out by hand from the list of weighted conditions: classes left out have none
SCORED = [
    ({}, {"normal": 7}, "normal"),
    ({"auth_failures": 1}, {"brute_force": 10, "normal": 7}, "brute_force"),
    ({"auth_rate": 0.031}, {"brute_force": 3, "normal": 7}, "normal"),
    ({"auth_rate": 0.03}, {"normal": 7}, "normal"),
    ({"auth_success_rate": 0.4, "auth_requests": 1}, {"brute_force": 5, "normal": 4}, "brute_force"),
    ({"auth_requests": 1}, {"brute_force": 2, "normal": 7}, "normal"),
    ({"suci_unencrypted": 1}, {"supi_harvest": 10, "normal": 5}, "supi_harvest"),
    ({"reg_rejects": 1}, {"bidding_down": 5, "normal": 4}, "bidding_down"),
    ({"reg_rejects": 1, "sec_mode_cmds": 1}, {"bidding_down": 9, "normal": 4}, "bidding_down"),
    ({"reject_rate": 0.3}, {"bidding_down": 2, "normal": 5}, "normal"),
    ({"ng_setup_req": 1}, {"false_bs": 6, "normal": 5}, "false_bs"),
    ({"ng_setup_req": 1, "auth_requests": 1}, {"false_bs": 9, "brute_force": 2, "normal": 5}, "false_bs"),
    ({"rand_repeat": 1}, {"replay": 10, "normal": 5}, "replay"),
    ({"sctp_abort": 1}, {"replay": 10, "normal": 7}, "replay"),
    # ties go to the class that comes first
    ({"auth_failures": 1, "suci_unencrypted": 1}, {"brute_force": 10, "supi_harvest": 10, "normal": 5}, "brute_force"),
    ({"suci_unencrypted": 1, "rand_repeat": 1}, {"supi_harvest": 10, "replay": 10, "normal": 5}, "supi_harvest"),
]


@pytest.mark.parametrize("values, scores, best", SCORED)
def test_weighted_scores(spark, values, scores, best):
    row = rules.with_weighted_scores(one(spark, **values)).withColumn("best", rules.weighted_class()).first()
    assert {name: row[f"score_{name}"] for name in SCORE_ORDER} == {name: scores.get(name, 0) for name in SCORE_ORDER}
    assert row.best == best


def test_confidence_gate(spark):
    rows = one(spark).crossJoin(spark.createDataFrame([(0.65, "normal"), (0.6499, "normal"), (0.9, "replay")], "conf double, guess string"))
    got = [(r.prediction, r.confidence, r.method) for r in decide(rows, DetectorConfig(), "guess", "conf", "rf").orderBy("conf").collect()]
    assert got == [("unknown", 0.65, "rf"), ("normal", 0.65, "rf"), ("replay", 0.9, "rf")]


def test_unknown_takes_no_action_unless_asked(spark):
    rows = spark.createDataFrame([("unknown",), ("normal",), ("replay",)], "p string")
    actions = {r.p: r.a for r in rows.select("p", online_actions(F.col("p")).alias("a")).collect()}
    assert actions["unknown"] == ["no_action"] and actions["normal"] == ["no_action"]
    assert actions["replay"] == ["sqn_strict_mode", "rand_replay_detection", "alert_generated"]
    asked = rows.select("p", online_actions(F.col("p"), DetectorConfig(unknown_action="operator_alert")).alias("a"))
    assert {r.p: r.a for r in asked.collect()}["unknown"] == ["operator_alert"]
