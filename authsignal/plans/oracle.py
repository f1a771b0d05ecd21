"""SQL each query is checked against, written independently of the Spark plans.

Windows are formed by a plain range join here, and every text is built from the event columns
rather than parsed, so the two sides share no logic.
"""

from __future__ import annotations

from authsignal.config import MODEL_FEATURES, REAL_FEATURES, TRAINING_FEATURES

U = 8_640_000_000
SIZE, STEP = 30 * U, 10 * U

# name -> (tables it builds on, body)
TABLES: dict[str, tuple[tuple[str, ...], str]] = {}


def table(name: str, deps: str, body: str) -> None:
    TABLES[name] = (tuple(deps.split()), body)


def query(deps: str, final: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in TABLES[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for dep in deps.split():
        visit(dep)
    if not order:
        return final
    return "WITH " + ",\n".join(f"{name} AS ({TABLES[name][1]})" for name in order) + "\n" + final


table(
    "frames",
    "",
    """
SELECT user_id::VARCHAR || '-' || (date_diff('day', DATE '2024-01-01', ts::DATE) // 6)::VARCHAR AS capture,
       event_id AS frame_no, epoch_us(ts) AS ts_us, ts, event_id, user_id, event_type, value,
       '10.10.0.' || (30 + event_id % 25)::VARCHAR AS src_ip, '10.10.0.12' AS dst_ip,
       CASE event_id % 4 WHEN 0 THEN 'SCTP' WHEN 1 THEN 'NGAP' WHEN 2 THEN 'NGAP/NAS-5GS' ELSE 'HTTP2' END AS protocol,
       CASE WHEN event_type = 'click' THEN 86 WHEN event_type = 'error' THEN 89 WHEN event_type = 'signup' THEN 65
            WHEN event_type = 'purchase' THEN 93 WHEN event_id % 5 = 0 THEN 68 ELSE 103 END AS nas,
       event_id % 97 = 0 AS setup, event_id % 401 = 0 AS abort,
       CASE WHEN event_id % 53 = 0 THEN 0 WHEN event_id % 7 = 0 THEN 1 END AS scheme,
       CASE WHEN event_type = 'click' THEN regexp_extract(props, '"k": (\\d+)', 1) END AS rand,
       (64 + event_id % 512)::INTEGER AS length,
       (CASE WHEN event_type = 'click' THEN 'DownlinkNASTransport, Authentication request'
             WHEN event_type = 'error' THEN 'UplinkNASTransport, Authentication failure (MAC failure)'
             WHEN event_type = 'signup' THEN 'InitialUEMessage, Registration request'
             WHEN event_type = 'purchase' THEN 'DownlinkNASTransport, Security mode command'
             WHEN event_id % 5 = 0 THEN 'DownlinkNASTransport, Registration reject (UE security capabilities mismatch)'
             ELSE 'UplinkNASTransport' END)
       || (CASE WHEN event_id % 97 <> 0 THEN '' WHEN event_id % 5 = 0 THEN ', NGSetupFailure'
                WHEN event_id % 2 = 0 THEN ', NGSetupResponse' ELSE ', NGSetupRequest' END)
       || (CASE WHEN event_id % 401 = 0 THEN ', ABORT' ELSE '' END)
       || (CASE WHEN event_id % 53 = 0 THEN ', Protection scheme Id: NULL scheme (0)' ELSE '' END) AS info
FROM events""",
)
table(
    "caps",
    "frames",
    "SELECT capture, min(ts_us) AS t0, max_by(ts_us, frame_no) - min(ts_us) AS dur, count(*) AS n_rows FROM frames GROUP BY capture",
)
table("packets", "frames caps", "SELECT f.*, f.ts_us - c.t0 AS rel, c.dur FROM frames f JOIN caps c USING (capture)")
table(
    "manifest",
    "",
    """
SELECT c_custkey::VARCHAR || '-' || (c_custkey % 5)::VARCHAR AS capture,
       (['normal', 'brute_force', 'supi_harvest', 'bidding_down', 'replay', 'false_bs'])[c_custkey % 6 + 1] AS label,
       c_custkey AS pos
FROM customer""",
)
table(
    "logs",
    "frames",
    """
SELECT * EXCLUDE (capture, ts), 'amf-' || (user_id % 10)::VARCHAR AS source, event_id AS seq, event_id % 31 <> 0 AS parsed,
       CASE WHEN event_id % 59 = 0 THEN 'log-' || user_id::VARCHAR ELSE capture END AS capture,
       CASE WHEN event_id % 31 <> 0 THEN ts END AS ts,
       CASE WHEN event_type = 'signup' THEN 'gmm' ELSE 'amf' END AS module,
       CASE WHEN event_type IN ('error', 'view', 'purchase') THEN 'WARNING' ELSE 'INFO' END AS level,
       CASE WHEN event_id % 31 = 0 THEN '  continued: ' ELSE '' END || CASE WHEN event_id % 97 = 0 THEN 'gNB-N2 accepted[' || src_ip || ']:38412 in ng-path module'
            WHEN event_id % 193 = 0 THEN 'gNB-N2[' || src_ip || '] connection refused!!!'
            WHEN event_type = 'error' THEN '[' || suci || '] Authentication failure [MAC failure]'
            WHEN event_type = 'view' THEN '[' || suci || '] Registration reject [23]'
            WHEN event_type = 'purchase' THEN '[' || suci || '] Authentication reject'
            WHEN event_type = 'signup' THEN 'UE SUPI[imsi-00101' || lpad(user_id::VARCHAR, 10, '0') || '] DNN[internet] S_NSSAI[SST:1 SD:0x1]'
            ELSE '[' || suci || '] Unknown UE by SUCI' END AS message
FROM (SELECT *, CASE WHEN event_id % 53 = 0 THEN 'suci-0-001-01-0000-0-0-' || lpad(user_id::VARCHAR, 10, '0')
                     ELSE 'suci-0-001-01-0000-1-1-' || md5(user_id::VARCHAR) END AS suci FROM frames)""",
)

table(
    "timed_logs",
    "logs",
    """
SELECT * EXCLUDE (ts), ts IS NULL AND event_time IS NOT NULL AS carried, event_time AS ts
FROM (SELECT *, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY source ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                         first_value(own IGNORE NULLS) OVER (PARTITION BY source ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS event_time
      FROM (SELECT *, date_trunc('millisecond', ts) AS own FROM logs))""",
)

COUNTS = """
       count(frame_no)::BIGINT AS total_packets,
       (count(*) FILTER (WHERE nas = 86))::BIGINT AS auth_requests,
       (count(*) FILTER (WHERE nas = 89))::BIGINT AS auth_failures,
       (count(*) FILTER (WHERE nas = 65))::BIGINT AS reg_requests,
       (count(*) FILTER (WHERE nas = 68))::BIGINT AS reg_rejects,
       (count(*) FILTER (WHERE nas = 93))::BIGINT AS sec_mode_cmds,
       (count(*) FILTER (WHERE setup))::BIGINT AS ng_setup_req,
       (count(*) FILTER (WHERE abort))::BIGINT AS sctp_abort,
       (coalesce(bool_or(scheme = 0), false) AND coalesce(bool_or(src_ip = '10.10.0.41' OR dst_ip = '10.10.0.41'), false))::INTEGER AS suci_unencrypted,
       (count(rand) > count(DISTINCT rand))::INTEGER AS rand_repeat"""
RATES = """
       round_even(auth_requests / safe, 4) AS auth_rate,
       round_even(reg_requests / safe, 4) AS reg_rate,
       round_even(reg_rejects / greatest(reg_requests, 1), 4) AS reject_rate,
       round_even(greatest(auth_requests - reg_rejects, 0) / greatest(auth_requests, 1), 4) AS auth_success_rate,
       (total_packets > 10)::INTEGER AS is_active"""


def windows(grid: str, upper: str) -> str:
    return f"""
SELECT g.capture, g.w, any_value(g.dur) AS dur, {COUNTS}
FROM (SELECT capture, dur, unnest({grid}) AS w FROM caps) g
LEFT JOIN packets p ON p.capture = g.capture AND p.rel >= g.w * {{step}} AND p.rel < {upper}
GROUP BY g.capture, g.w"""


table(
    "sliding_counts",
    "caps packets",
    windows(
        f"CASE WHEN dur < {SIZE} THEN [0::BIGINT] ELSE range(0, (dur - {SIZE}) // {STEP} + 1) END",
        f"CASE WHEN g.dur < {SIZE} THEN g.dur ELSE g.w * {STEP} + {SIZE} END",
    ).format(step=STEP),
)
table(
    "sliding",
    "sliding_counts",
    f"""
SELECT *, round_even(w * 10.0::DOUBLE, 1) AS t_start, round_even(w * 10.0::DOUBLE + duration, 1) AS t_end, {RATES}
FROM (SELECT *, CASE WHEN duration > 0 THEN duration ELSE 1.0 END AS safe
      FROM (SELECT *, CASE WHEN dur < {SIZE} THEN dur / {U}.0::DOUBLE ELSE 30.0::DOUBLE END AS duration FROM sliding_counts))""",
)
table(
    "tumbling_counts",
    "caps packets",
    windows(
        f"range(0, greatest(1, (dur + {SIZE} - 1) // {SIZE}))", f"(g.w + 1) * {SIZE}"
    ).format(step=SIZE),
)
table(
    "tumbling",
    "tumbling_counts",
    f"""
SELECT *, w * 30.0::DOUBLE AS t_start, (w + 1) * 30.0::DOUBLE AS t_end, {RATES},
       100 * suci_unencrypted + 50 * auth_failures + 50 * sctp_abort + 30 * reg_rejects + 20 * sec_mode_cmds
       + 15 * ng_setup_req + 2 * auth_requests + total_packets AS score
FROM (SELECT *, 30.0::DOUBLE AS duration, 30.0::DOUBLE AS safe FROM tumbling_counts)""",
)
DAY_MS = 86_400_000
# what the watermark of a stream, a day behind the newest packet, has passed; a capture ends six days after its last packet
table("mark", "frames", f"SELECT max(ts_us) // 1000 - {DAY_MS} AS ms FROM frames")
table("ready_packets", "packets mark", "SELECT p.* FROM packets p, mark WHERE ts_us <= ms * 1000")
table(
    "ready_caps",
    "ready_packets packets mark",
    f"""
SELECT capture, max(rel) AS dur, max(ts_us) // 1000 + 6 * {DAY_MS} <= any_value(ms) AND count(*) = any_value(n) AS finished
FROM ready_packets JOIN (SELECT capture, count(*) AS n FROM packets GROUP BY capture) USING (capture), mark GROUP BY capture""",
)
table("settled_caps", "ready_caps", f"SELECT capture, dur FROM ready_caps WHERE dur >= {SIZE} OR finished")
table(
    "settled_counts",
    "settled_caps ready_packets",
    TABLES["sliding_counts"][1].replace("FROM caps", "FROM settled_caps").replace("packets p ON", "ready_packets p ON"),
)
table("settled_sliding", "settled_counts", TABLES["sliding"][1].replace("FROM sliding_counts", "FROM settled_counts"))
table(
    "best",
    "tumbling",
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY capture ORDER BY score DESC, t_start) AS rn FROM tumbling) WHERE rn = 1",
)
table(
    "evidence",
    "packets",
    """
SELECT capture, any_value(dur) AS capture_us, count(*) FILTER (WHERE nas = 89) AS all_failures, bool_or(abort) AS any_abort,
       bool_or(setup AND src_ip NOT IN ('10.10.0.30', '10.10.0.12')) AS any_rogue
FROM packets GROUP BY capture""",
)
table(
    "features",
    "best evidence",
    f"""
SELECT b.* EXCLUDE (sctp_abort, auth_failures, ng_setup_req),
       b.sctp_abort AS window_abort, b.auth_failures AS window_failures, b.ng_setup_req AS window_setups,
       CASE WHEN e.any_abort THEN 1 ELSE b.sctp_abort END::BIGINT AS sctp_abort,
       greatest(b.auth_failures, e.all_failures)::BIGINT AS auth_failures,
       CASE WHEN e.any_rogue THEN 99 ELSE b.ng_setup_req END::BIGINT AS ng_setup_req,
       e.any_rogue, round_even(e.capture_us / {U}.0::DOUBLE, 2) AS capture_seconds
FROM best b JOIN evidence e USING (capture)""",
)

# ---- fixed values: the rule sets, their thresholds and class names ----
ONLINE = """CASE WHEN suci_unencrypted = 1 THEN 'supi_harvest' WHEN reg_rejects >= 1 AND sec_mode_cmds >= 1 THEN 'bidding_down'
       WHEN auth_failures >= 5 THEN 'brute_force' WHEN sctp_abort >= 1 THEN 'replay' WHEN ng_setup_req = 99 THEN 'false_bs' ELSE 'model' END"""
SIMPLE = """CASE WHEN suci_unencrypted = 1 THEN 'supi_harvest' WHEN reg_rejects >= 1 AND sec_mode_cmds >= 1 THEN 'bidding_down'
       WHEN ng_setup_req >= 1 AND reg_rejects = 0 AND suci_unencrypted = 0 THEN 'false_bs'
       WHEN rand_repeat = 1 OR sctp_abort = 1 THEN 'replay'
       WHEN auth_failures > 0 OR (auth_rate > 0.03 AND auth_success_rate < 0.5) THEN 'brute_force' ELSE 'normal' END"""


def offline(rest: str) -> str:
    return f"""CASE WHEN suci_unencrypted = 1 THEN 'supi_harvest' WHEN reg_rejects >= 1 AND sec_mode_cmds >= 1 THEN 'bidding_down'
       WHEN auth_failures > 0 THEN 'brute_force' WHEN sctp_abort = 1 THEN 'replay' ELSE '{rest}' END"""


# ---- fixed values: weighted conditions in tenths ----
SCORES = """
       10 * (auth_failures > 0)::INTEGER + 3 * (auth_rate > 0.03)::INTEGER + 3 * (auth_success_rate < 0.5 AND auth_requests >= 1)::INTEGER
       + 2 * (reg_rejects = 0 AND auth_requests >= 1 AND suci_unencrypted = 0)::INTEGER AS score_brute_force,
       10 * (suci_unencrypted = 1)::INTEGER AS score_supi_harvest,
       5 * (reg_rejects >= 1)::INTEGER + 4 * (sec_mode_cmds >= 1 AND reg_rejects >= 1)::INTEGER + 2 * (reject_rate >= 0.3)::INTEGER AS score_bidding_down,
       6 * (ng_setup_req >= 1 AND reg_rejects = 0)::INTEGER + 3 * (ng_setup_req >= 1 AND auth_requests >= 1)::INTEGER AS score_false_bs,
       10 * (rand_repeat = 1 OR sctp_abort = 1)::INTEGER AS score_replay,
       2 * (suci_unencrypted = 0 AND rand_repeat = 0)::INTEGER + 3 * (reg_rejects = 0 AND auth_success_rate >= 0.8)::INTEGER
       + 2 * (reject_rate = 0 AND ng_setup_req = 0)::INTEGER AS score_normal"""
TOP = "greatest(score_brute_force, score_supi_harvest, score_bidding_down, score_false_bs, score_replay, score_normal)"
WEIGHTED = f"""CASE {TOP} WHEN score_brute_force THEN 'brute_force' WHEN score_supi_harvest THEN 'supi_harvest'
       WHEN score_bidding_down THEN 'bidding_down' WHEN score_false_bs THEN 'false_bs' WHEN score_replay THEN 'replay' ELSE 'normal' END"""

table("scored", "sliding", f"SELECT *, {SCORES} FROM sliding")
table(
    "judged",
    "scored",
    f"SELECT *, {SIMPLE} AS label, {WEIGHTED} AS prediction, {offline('normal')} AS truth FROM scored",
)
table("capture_scores", "features", f"SELECT *, {SCORES} FROM features")
table(
    "timings",
    "frames",
    "SELECT capture, round_even((count(*) * 100 + sum(event_id % 100)) / 100.0::DOUBLE, 2) AS response_time FROM frames GROUP BY capture",
)
table(
    "detections",
    "capture_scores timings",
    f"""
SELECT *, CASE WHEN rule <> 'model' THEN rule WHEN share < 0.65 THEN 'unknown' ELSE weighted END AS prediction,
       CASE WHEN rule <> 'model' THEN 'rule' ELSE 'weighted' END AS method,
       CASE WHEN rule <> 'model' THEN 1.0::DOUBLE ELSE round_even(share, 3) END AS confidence
FROM (SELECT *, {ONLINE} AS rule, {WEIGHTED} AS weighted,
             CASE WHEN total > 0 THEN {TOP} / total ELSE 0.0 END AS share
      FROM (SELECT *, score_brute_force + score_supi_harvest + score_bidding_down + score_false_bs + score_replay + score_normal AS total
            FROM capture_scores JOIN timings USING (capture)))""",
)


def online_actions(column: str) -> str:
    return f"""CASE {column} WHEN 'brute_force' THEN 'rate_limiting,attacker_ue_blocked,alert_generated'
       WHEN 'supi_harvest' THEN 'null_scheme_rejected,suci_encryption_enforced,alert_generated'
       WHEN 'bidding_down' THEN 'null_integrity_blocked,null_ciphering_blocked,alert_generated'
       WHEN 'replay' THEN 'sqn_strict_mode,rand_replay_detection,alert_generated'
       WHEN 'false_bs' THEN 'rogue_gnb_disconnected,ip_flagged,alert_generated' ELSE 'no_action' END"""


table(
    "plan",
    "",
    """
SELECT * FROM (VALUES
 ('brute_force', 'FGT1110.001', 'imsi-001010000000099', 'rate_limiting_enforced,attacker_ue_blocked,security_alert_generated'),
 ('supi_harvest', 'FGT5019', 'suci-0-001-01-0000-0-0-0000000003', 'null_scheme_rejection_enforced,udm_encryption_policy_verified,suci_exposure_alert_generated'),
 ('bidding_down', 'FGT5004', 'ue-null-security-capabilities', 'null_integrity_blocked,null_ciphering_blocked,security_policy_enforced,mismatch_auto_reject_enabled'),
 ('replay', 'FGT1040', 'amf-authentication-handler', 'sqn_strict_validation_enabled,rand_replay_detection_active,sctp_abort_triggered,auth_sequence_incremented'),
 ('false_bs', 'FGT1588.501', '10.10.0.50 (TAC=99)', 'unauthorized_ip_flagged,ngsetup_policy_enforced,gnb_auth_verification_enabled')
) AS t(attack_type, technique, target, actions)""",
)
table("per_label", "judged", "SELECT label, count(*) AS n FROM judged GROUP BY label")
table("smallest", "per_label", "SELECT greatest(1, least(5, min(n) - 1))::BIGINT AS k FROM per_label WHERE n >= 2")
table("numbered", "judged", "SELECT *, row_number() OVER (PARTITION BY label ORDER BY capture, w) AS seq FROM judged")
table("small", "numbered per_label", "SELECT x.*, c.n FROM numbered x JOIN per_label c USING (label) WHERE c.n < 100")
DISTANCE = " + ".join(f"(a.{f}::DOUBLE - b.{f}::DOUBLE) * (a.{f}::DOUBLE - b.{f}::DOUBLE)" for f in TRAINING_FEATURES)
table(
    "knn",
    "small smallest",
    f"""
SELECT label, seq, nn_seq, nn_rank, distance2
FROM (SELECT *, row_number() OVER (PARTITION BY label, seq ORDER BY distance2, nn_seq) AS nn_rank
      FROM (SELECT a.label, a.seq, b.seq AS nn_seq, 0.0::DOUBLE + {DISTANCE} AS distance2
            FROM small a JOIN small b ON a.label = b.label AND a.seq <> b.seq))
WHERE nn_rank <= (SELECT k FROM smallest)""",
)


def draw(what: str) -> str:
    return f"('0x' || substr(md5('42|' || label || '|' || i::VARCHAR || '|{what}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


def restored(name: str, value: str) -> str:
    if name in ("suci_unencrypted", "rand_repeat", "is_active"):
        return f"round_even({value}, 0)::BIGINT AS {name}"
    if name in ("duration", "auth_rate", "reg_rate", "reject_rate", "auth_success_rate"):
        return f"round_even({value}, 4) AS {name}"
    return f"greatest(0, round_even({value}, 0)::BIGINT) AS {name}"


table(
    "made",
    "small smallest knn",
    f"""
SELECT d.label, d.i, {", ".join(restored(f, f"(x.{f}::DOUBLE + d.u * (y.{f}::DOUBLE - x.{f}::DOUBLE))") for f in TRAINING_FEATURES)}
FROM (SELECT label, i, floor({draw("row")} * n)::INTEGER + 1 AS seq,
             floor({draw("neighbour")} * (SELECT k FROM smallest))::INTEGER + 1 AS nn_rank, {draw("gap")} AS u
      FROM (SELECT label, n, unnest(range(0, 100 - n)) AS i FROM per_label WHERE n >= 2 AND n < 100)) d
JOIN knn USING (label, seq, nn_rank)
JOIN small x ON x.label = d.label AND x.seq = d.seq
JOIN small y ON y.label = d.label AND y.seq = knn.nn_seq""",
)


def noise_column(name: str) -> str:
    if name in ("suci_unencrypted", "rand_repeat", "is_active"):
        return f"{name}::BIGINT AS {name}"
    factor = f"(0.85::DOUBLE + 0.3::DOUBLE * {draw(name)})"
    return restored(name, f"(CASE WHEN {name} = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, {name}::DOUBLE * {factor}) END)")


MODEL = ", ".join(MODEL_FEATURES)
TRAIN = ", ".join(TRAINING_FEATURES)
ALL = (
    "capture, w, t_start, t_end, total_packets, auth_requests, auth_failures, reg_requests, reg_rejects, sec_mode_cmds, "
    "ng_setup_req, suci_unencrypted, duration, auth_rate, reg_rate, reject_rate, auth_success_rate, rand_repeat, sctp_abort, is_active"
)

table(
    "scores_by_class",
    "judged",
    """
SELECT name, support, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
FROM (SELECT name, support, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
             CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall
      FROM (SELECT c.name, count(*) FILTER (WHERE j.label = c.name) AS support, count(*) FILTER (WHERE j.prediction = c.name) AS predicted,
                   count(*) FILTER (WHERE j.label = c.name AND j.prediction = c.name) AS tp
            FROM (SELECT label AS name FROM judged UNION SELECT prediction FROM judged) c
            JOIN judged j ON j.label = c.name OR j.prediction = c.name GROUP BY c.name))""",
)
table(
    "samples",
    "frames",
    """
SELECT capture, ts, CASE event_type WHEN 'signup' THEN 'reg_init_req' WHEN 'purchase' THEN 'reg_init_succ' WHEN 'view' THEN 'reg_init_fail'
       WHEN 'click' THEN 'auth_req' ELSE 'auth_fail' END AS name, CASE WHEN event_id % 3 <> 0 THEN value END AS value
FROM frames""",
)
table(
    "counter_names",
    "",
    "SELECT unnest(['reg_init_req', 'reg_init_succ', 'reg_init_fail', 'auth_req', 'auth_reject', 'auth_fail']) AS name",
)
CODE = """CASE prediction WHEN 'normal' THEN 0 WHEN 'brute_force' THEN 1 WHEN 'supi_harvest' THEN 2 WHEN 'bidding_down' THEN 3
       WHEN 'replay' THEN 4 WHEN 'false_bs' THEN 5 ELSE -1 END"""
# ---- fixed values: metric names and help texts ----
table(
    "gauges",
    "detections",
    f"""
SELECT capture, 'detection_prediction' AS name, 'Attack type detected' AS help, 'capture="' || capture || '"' AS labels, ({CODE})::DOUBLE AS value FROM detections
UNION ALL SELECT capture, 'detection_confidence', 'Detection confidence score', 'capture="' || capture || '"', confidence FROM detections
UNION ALL SELECT capture, 'detection_response_time', 'Response time in seconds', 'capture="' || capture || '"', response_time FROM detections
UNION ALL SELECT capture, 'mitigation_applied', 'Mitigation applied', 'capture="' || capture || '",attack="' || prediction || '"', 1.0 FROM detections""",
)
SINCE = "TIMESTAMP '2024-01-10 00:00:00'"
SHOWN = "regexp_replace(value::VARCHAR, '[.]0$', '')"
RESPONDER = "FROM detections d JOIN plan p ON p.attack_type = d.prediction"
RESPONDER_ACTIONS = """CASE WHEN p.attack_type <> 'false_bs' THEN p.actions
       WHEN d.any_rogue THEN 'rogue_gnb_terminated,' || p.actions ELSE 'rogue_gnb_not_active,' || p.actions END"""


def occurrences(text: str, word: str) -> str:
    return f"((length({text}) - length(replace({text}, '{word}', ''))) // {len(word)})"


DAY = 86_400_000_000
HELD_OUT = "('0x' || substr(md5(capture), 1, 8))::BIGINT % 5 = 0"
# clock windows of three days, one each day, that the watermark (a day behind the last event) has passed
table(
    "stream_windows",
    "frames",
    f"""
SELECT capture, start_us, {COUNTS}, bool_or(setup AND src_ip NOT IN ('10.10.0.30', '10.10.0.12')) AS any_rogue
FROM (SELECT *, unnest([ts_us // {DAY} * {DAY}, (ts_us // {DAY} - 1) * {DAY}, (ts_us // {DAY} - 2) * {DAY}]) AS start_us FROM frames)
WHERE start_us + {3 * DAY} <= (SELECT max(ts_us) FROM frames) // 1000 * 1000 - {DAY}
GROUP BY capture, start_us""",
)

ORACLE: dict[str, str] = {
    "scan_packets": query(
        "frames",
        """SELECT capture, frame_no, ts_us, src_ip, dst_ip, protocol,
       CASE WHEN event_id % 11 = 0 THEN nas || ',' || nas ELSE nas::VARCHAR END AS nas_types,
       CASE WHEN setup THEN '21' ELSE '' END AS procedures, CASE WHEN abort THEN '6' ELSE '0' END AS chunks,
       scheme AS prot_scheme_id, rand, length, info FROM frames""",
    ),
    "labelled_packets": query("frames manifest", "SELECT capture, frame_no, label FROM frames JOIN manifest USING (capture)"),
    "missing_captures": query(
        "frames manifest", "SELECT capture, label, pos FROM manifest WHERE capture NOT IN (SELECT capture FROM frames)"
    ),
    "log_parse": query(
        "logs",
        """SELECT capture, source, seq, epoch_us(ts) // 1000 * 1000 AS ts_us, strftime(ts, '%m/%d %H:%M:%S.%g') AS stamp,
       CASE WHEN parsed THEN module END AS module, CASE WHEN parsed THEN level END AS level, message,
       CASE WHEN parsed THEN 'context.c:' || (event_id % 900 + 100)::VARCHAR END AS place, parsed FROM logs""",
    ),
    "summary_parse": query(
        "packets", "SELECT capture, frame_no, rel / 1000000.0::DOUBLE AS seconds, src_ip, dst_ip, protocol, length, info FROM packets"
    ),
    "metric_latest": query(
        "samples counter_names",
        """SELECT name, coalesce(value, 0.0) AS value FROM counter_names
LEFT JOIN (SELECT name, max_by(value, ts) AS value FROM samples WHERE value IS NOT NULL GROUP BY name) USING (name)""",
    ),
    "metric_last_per_capture": query(
        "samples",
        "SELECT capture, name, max_by(value, ts) AS value, epoch_us(max(ts)) AS ts_us FROM samples WHERE value IS NOT NULL GROUP BY capture, name",
    ),
    "time_slice": query(
        "packets",
        f"SELECT capture, frame_no, rel AS rel_us FROM packets WHERE rel >= {10 * U} AND rel < {40 * U} AND protocol = 'NGAP'",
    ),
    "message_type_counts": query(
        "frames",
        "SELECT capture, nas AS message_type, count(*) AS packets FROM frames WHERE nas IN (86, 89, 65, 68, 93) GROUP BY capture, nas",
    ),
    "message_packets": query("frames", "SELECT capture, frame_no, nas AS message_type FROM frames WHERE nas IN (86, 68)"),
    "ng_setup_packets": query("frames", "SELECT capture, frame_no, src_ip FROM frames WHERE setup"),
    "abort_packets": query("frames", "SELECT capture, frame_no, ts_us FROM frames WHERE abort"),
    "null_scheme_packets": query("frames", "SELECT capture, frame_no, info FROM frames WHERE scheme = 0"),
    "watched_packets": query(
        "frames", "SELECT capture, frame_no, src_ip, dst_ip FROM frames WHERE '10.10.0.41' IN (src_ip, dst_ip)"
    ),
    "protocol_counts": query(
        "frames",
        "SELECT capture, protocol, count(*) AS packets FROM frames WHERE regexp_matches(lower(protocol), 'ngap|sctp') GROUP BY capture, protocol",
    ),
    "field_values": query(
        "frames",
        """SELECT capture, frame_no, 'src_ip' AS field, src_ip AS value FROM frames
UNION ALL SELECT capture, frame_no, 'rand', rand FROM frames WHERE rand <> ''
UNION ALL SELECT capture, frame_no, 'prot_scheme_id', scheme::VARCHAR FROM frames WHERE scheme IS NOT NULL""",
    ),
    "log_keyword_since": query(
        "timed_logs",
        f"""SELECT source, count(*) FILTER (WHERE contains(message, 'MAC failure')) AS mac_failures,
       count(*) FILTER (WHERE contains(message, 'Authentication reject')) AS auth_rejects,
       count(*) FILTER (WHERE contains(message, 'refused')) AS refusals
FROM timed_logs WHERE ts >= {SINCE} GROUP BY source""",
    ),
    "feature_projection": query("sliding", f"SELECT capture, w, {MODEL} FROM sliding"),
    "rogue_sources": query(
        "frames",
        "SELECT capture, src_ip, count(*) AS setups FROM frames WHERE setup AND src_ip NOT IN ('10.10.0.30', '10.10.0.12') GROUP BY capture, src_ip",
    ),
    "log_tail_files": query(
        "logs",
        """SELECT source, rank::INTEGER AS rank, message
FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY seq DESC) AS rank FROM logs WHERE contains(message, 'reject')) WHERE rank <= 10""",
    ),
    "log_tail_n": query(
        "logs",
        """SELECT source, rank, seq, message FROM (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY seq DESC))::INTEGER AS rank FROM logs)
WHERE rank <= 10""",
    ),
    "trim_per_class": query("numbered", "SELECT label, seq::INTEGER AS seq, capture, w, total_packets FROM numbered WHERE seq <= 100"),
    "sliding_features": query("sliding", f"SELECT {ALL} FROM sliding"),
    "tumbling_features": query("tumbling", f"SELECT {ALL} FROM tumbling"),
    "short_capture_features": query("sliding", f"SELECT {ALL} FROM sliding WHERE duration < 30"),
    "window_ids": query(
        "sliding manifest",
        """SELECT capture, w, label, window_no, label || '_w' || window_no AS window_id
FROM (SELECT s.capture, s.w, m.label, row_number() OVER (ORDER BY m.pos, m.capture, s.w) - 1 AS window_no
      FROM sliding s JOIN manifest m USING (capture))""",
    ),
    "best_window": query("best", f"SELECT capture, t_start, score::BIGINT AS score, {MODEL} FROM best"),
    "rand_repeat_windows": query("sliding", "SELECT capture, w FROM sliding WHERE rand_repeat = 1"),
    "rate_features": query("sliding", "SELECT capture, w, auth_rate, reg_rate, reject_rate, auth_success_rate FROM sliding"),
    "active_windows": query("sliding", "SELECT capture, w, total_packets, is_active FROM sliding WHERE total_packets > 10"),
    "capture_duration": query("caps", "SELECT capture, dur AS capture_us, n_rows FROM caps"),
    "capture_overrides": query(
        "features",
        "SELECT capture, window_abort, window_failures, window_setups, sctp_abort, auth_failures, ng_setup_req FROM features",
    ),
    "windows_per_label": query("per_label", "SELECT label, n AS windows FROM per_label UNION ALL SELECT 'TOTAL', sum(n)::BIGINT FROM per_label"),
    "smote_readiness": query("per_label", "SELECT label, n, CASE WHEN n >= 3 THEN 'OK' ELSE 'need 3+' END AS status FROM per_label"),
    "class_distribution": query("per_label", "SELECT label, n FROM per_label ORDER BY n DESC, label"),
    "online_rules": query("features", f"SELECT capture, t_start, {MODEL}, {ONLINE} AS prediction FROM features"),
    "online_detection": query(
        "features",
        f"""SELECT capture, prediction, CASE WHEN prediction <> 'model' THEN 1.0::DOUBLE END AS confidence,
       CASE WHEN prediction <> 'model' THEN 'rule' ELSE 'model' END AS method, {online_actions("prediction")} AS actions, capture_seconds, t_start, score
FROM (SELECT *, {ONLINE} AS prediction FROM features)""",
    ),
    "simple_rules": query("sliding", f"SELECT capture, w, {SIMPLE} AS prediction FROM sliding"),
    "weighted_scores": query(
        "scored",
        "SELECT capture, w, score_normal, score_brute_force, score_supi_harvest, score_bidding_down, score_replay, score_false_bs FROM scored",
    ),
    "weighted_rules": query("scored", f"SELECT capture, w, {WEIGHTED} AS prediction FROM scored"),
    "offline_rules": query("sliding", f"SELECT capture, w, {offline('model')} AS prediction FROM sliding"),
    "confidence_gate": query("detections", "SELECT capture, prediction, confidence, method FROM detections"),
    "zscore_features": query(
        "sliding",
        "SELECT capture, w, "
        + ", ".join(
            f"round_even(({f} - avg({f}) OVER ()) / coalesce(nullif(stddev_pop({f}) OVER (), 0), 1.0), 6) AS z_{f}" for f in MODEL_FEATURES
        )
        + " FROM sliding",
    ),
    "class_weights": query(
        "per_label",
        "SELECT label, n, round_even((SELECT sum(n) FROM per_label) / (SELECT count(*) FROM per_label) / n, 6) AS weight FROM per_label",
    ),
    "stratified_folds": query(
        "numbered", "SELECT label, seq::INTEGER AS seq, capture, w, ((seq - 1) % 5)::INTEGER AS fold FROM numbered WHERE seq <= 100"
    ),
    "accuracy_simple": query(
        "judged",
        """SELECT 'simple' AS method, count(*) AS n_rows, count(*) FILTER (WHERE truth = label) AS n_correct,
       round_even(avg((truth = label)::INTEGER), 6) AS accuracy FROM judged""",
    ),
    "accuracy_weighted": query(
        "judged",
        """SELECT 'weighted' AS method, count(*) AS n_rows, count(*) FILTER (WHERE label = prediction) AS n_correct,
       round_even(avg((label = prediction)::INTEGER), 6) AS accuracy FROM judged""",
    ),
    "classification_report": query(
        "scores_by_class",
        """SELECT name, round_even(precision, 6) AS precision, round_even(recall, 6) AS recall, round_even(f1, 6) AS f1, support FROM scores_by_class
UNION ALL SELECT 'macro avg', round_even(avg(precision), 6), round_even(avg(recall), 6), round_even(avg(f1), 6), sum(support)::BIGINT FROM scores_by_class
UNION ALL SELECT 'weighted avg', round_even(sum(precision * support) / sum(support), 6), round_even(sum(recall * support) / sum(support), 6),
       round_even(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM scores_by_class""",
    ),
    "confusion_matrix": query(
        "judged",
        "SELECT label, "
        + ", ".join(
            f"count(*) FILTER (WHERE prediction = '{c}') AS pred_{c}"
            for c in ("bidding_down", "brute_force", "false_bs", "normal", "replay", "supi_harvest")
        )
        + ", 0::BIGINT AS pred_other"
        + " FROM judged GROUP BY label",
    ),
    "confusion_pairs": query("judged", "SELECT label, prediction, count(*) AS n FROM judged GROUP BY label, prediction"),
    "held_out_rules": query(
        "judged",
        f"""SELECT 'simple' AS method, count(*) AS n_rows, count(*) FILTER (WHERE truth = label) AS n_correct,
       round_even(avg((truth = label)::INTEGER), 6) AS accuracy FROM judged WHERE {HELD_OUT}
UNION ALL SELECT 'weighted', count(*), count(*) FILTER (WHERE truth = prediction), round_even(avg((truth = prediction)::INTEGER), 6)
FROM judged WHERE {HELD_OUT}""",
    ),
    "hybrid_rule_rows": query(
        "judged",
        f"""SELECT capture, w, truth AS label, label AS simple, prediction AS weighted, rule AS hybrid
FROM (SELECT *, {offline('model')} AS rule FROM judged) WHERE rule <> 'model' AND {HELD_OUT}""",
    ),
    "rf_rule_rows": query(
        "detections", "SELECT capture, prediction, confidence, method, response_time FROM detections WHERE method = 'rule'"
    ),
    "rf_checks": query(
        "detections",
        """SELECT count(*) AS captures, count(*) FILTER (WHERE method <> 'rule') AS left_to_forest, 0::BIGINT AS bad_confidence,
       0::BIGINT AS bad_gate, 0::BIGINT AS bad_rounding FROM detections""",
    ),
    "rf_node_checks": query("sliding", "SELECT count(*) AS windows, 0::BIGINT AS different, 0::BIGINT AS small_splits FROM sliding"),
    "rf_fold_checks": query(
        "judged",
        """SELECT fold::INTEGER AS fold, classes * 20 AS n_rows, classes AS n_classes, 0::BIGINT AS repeated, 0::BIGINT AS unknown_class, true AS better_than_half
FROM (SELECT count(DISTINCT label) AS classes FROM judged), (SELECT unnest(range(5)) AS fold)""",
    ),
    "rf_importance_checks": query("", "SELECT 5::BIGINT AS features, true AS none_negative, true AS share_of_one"),
    "training_order": query(
        "numbered",
        f"""SELECT label, seq::INTEGER AS seq, capture, w, (row_number() OVER (ORDER BY key, label, seq))::INTEGER AS place
FROM (SELECT *, {draw('order').replace('i::VARCHAR', 'seq::VARCHAR')} AS key FROM numbered WHERE seq <= 100)""",
    ),
    "recent_rejects": query(
        "logs",
        """SELECT source, count(*) AS lines, max(seq) AS newest
FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY seq DESC) AS rn FROM logs WHERE contains(message, 'Registration reject [23]'))
WHERE rn <= 5 GROUP BY source""",
    ),
    "recent_null_schemes": query(
        "logs",
        """SELECT source, count(*) AS lines, max(seq) AS newest
FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY seq DESC) AS rn FROM logs WHERE contains(message, 'suci-0-001-01-0000-0-'))
WHERE rn <= 5 GROUP BY source""",
    ),
    "stream_windows": query(
        "stream_windows",
        """SELECT capture, start_us, total_packets, auth_requests, auth_failures, reg_requests, reg_rejects, suci_unencrypted, rand_repeat
FROM stream_windows""",
    ),
    "stream_alerts": query(
        "stream_windows",
        f"""SELECT DISTINCT capture, prediction FROM (SELECT *, {ONLINE} AS prediction
FROM (SELECT * EXCLUDE (ng_setup_req), CASE WHEN any_rogue THEN 99 ELSE ng_setup_req END AS ng_setup_req FROM stream_windows))
WHERE prediction <> 'model'""",
    ),
    "stream_sliding_features": query("settled_sliding", f"SELECT {ALL} FROM settled_sliding"),
    "stream_verdicts": query(
        "detections ready_caps",
        f"""SELECT capture, prediction, confidence, method, {online_actions("prediction")} AS actions, capture_seconds, t_start, score
FROM detections JOIN (SELECT capture FROM ready_caps WHERE finished) USING (capture)""",
    ),
    "stream_overrides": query(
        "frames",
        f"""SELECT capture, ts_us // {10 * DAY} * {10 * DAY} AS start_us, count(*) FILTER (WHERE nas = 89) AS all_failures, bool_or(abort) AS any_abort,
       bool_or(setup AND src_ip NOT IN ('10.10.0.30', '10.10.0.12')) AS any_rogue FROM frames GROUP BY ALL""",
    ),
    "method_summary": query(
        "judged",
        """SELECT 'simple' AS method, count(*) AS n_rows, count(*) FILTER (WHERE truth = label) AS n_correct,
       round_even(avg((truth = label)::INTEGER), 6) AS accuracy FROM judged
UNION ALL SELECT 'weighted', count(*), count(*) FILTER (WHERE truth = prediction), round_even(avg((truth = prediction)::INTEGER), 6) FROM judged""",
    ),
    "class_partition": query("per_label", "SELECT label, n, CASE WHEN n >= 2 THEN 'interpolate' ELSE 'noise' END AS route FROM per_label"),
    "smote_k": query("smallest", "SELECT k FROM smallest"),
    "class_knn": query(
        "knn",
        "SELECT label, seq::INTEGER AS seq, nn_seq::INTEGER AS nn_seq, nn_rank::INTEGER AS nn_rank, round_even(distance2, 6) AS distance2 FROM knn",
    ),
    "smote_rows": query("made", f"SELECT label, i, {TRAIN} FROM made"),
    "noise_rows": query(
        "numbered",
        f"SELECT label, i, {', '.join(noise_column(f) for f in TRAINING_FEATURES)} "
        "FROM (SELECT *, unnest(range(0, 100)) AS i FROM numbered WHERE seq = 1)",
    ),
    "augmented_counts": query("per_label", "SELECT label, 100::BIGINT AS n FROM per_label"),
    "response_plan": query("detections", f"SELECT capture, prediction, {online_actions('prediction')} AS actions FROM detections"),
    "responder_plan": query("detections plan", f"SELECT d.capture, p.attack_type, p.technique, p.target, p.actions {RESPONDER}"),
    "response_events": query(
        "detections plan",
        f"SELECT d.capture, epoch_us(TIMESTAMP '2024-01-26 00:00:00') AS at_us, p.attack_type, {RESPONDER_ACTIONS} AS actions, p.target, true AS success {RESPONDER}",
    ),
    "rogue_response": query(
        "features",
        """SELECT capture, any_rogue, CASE WHEN any_rogue THEN 'rogue_gnb_terminated' ELSE 'rogue_gnb_not_active' END
       || ',unauthorized_ip_flagged,ngsetup_policy_enforced,gnb_auth_verification_enabled' AS actions FROM features""",
    ),
    "response_summary": query(
        "detections plan",
        """SELECT p.attack_type, count(d.capture) AS responses, count(d.capture) > 0 AS done
FROM plan p LEFT JOIN detections d ON d.prediction = p.attack_type GROUP BY p.attack_type""",
    ),
    "block_list": query(
        "frames detections",
        """SELECT DISTINCT 'imsi' AS kind, 'imsi-00101' || lpad(f.user_id::VARCHAR, 10, '0') AS identity
FROM frames f JOIN detections d USING (capture) WHERE d.prediction = 'brute_force' AND f.nas = 89
UNION SELECT DISTINCT 'gnb', f.src_ip FROM frames f JOIN detections d USING (capture)
WHERE d.prediction = 'false_bs' AND f.setup AND f.src_ip NOT IN ('10.10.0.30', '10.10.0.12')""",
    ),
    "recent_failures": query(
        "logs",
        """SELECT source, count(*) FILTER (WHERE contains(message, 'MAC failure')) AS failures, count(*) AS lines
FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY seq DESC) AS rn FROM logs
      WHERE contains(message, 'MAC failure') OR contains(message, 'Authentication reject')) WHERE rn <= 20 GROUP BY source""",
    ),
    "rate_limit": query(
        "frames",
        f"""SELECT DISTINCT subscriber, at_us, attempts, failures, attempts > 5 AS over_limit, failures >= 3 AS blocked
FROM (SELECT user_id AS subscriber, ts_us AS at_us, count(*) FILTER (WHERE nas = 86) OVER w AS attempts,
             count(*) FILTER (WHERE nas = 89) OVER w AS failures
      FROM frames WHERE nas IN (86, 89)
      WINDOW w AS (PARTITION BY user_id ORDER BY ts_us RANGE BETWEEN {60 * U} PRECEDING AND CURRENT ROW))""",
    ),
    "mean_response": query(
        "detections", "SELECT count(*) AS captures, round_even(coalesce(avg(response_time), 0.0), 4) AS mean_response FROM detections"
    ),
    "class_codes": query("detections", f"SELECT capture, prediction, {CODE} AS code FROM detections"),
    "metric_rows": query("gauges", "SELECT capture, name, labels, value FROM gauges"),
    "metric_exposition": query(
        "gauges",
        f"""SELECT capture, name, 0 AS part, '# HELP ' || name || ' ' || help AS value FROM gauges
UNION ALL SELECT capture, name, 1, '# TYPE ' || name || ' gauge' FROM gauges
UNION ALL SELECT capture, name, 2, name || '{{' || labels || '}} ' || {SHOWN} FROM gauges""",
    ),
    "metric_files": query(
        "gauges",
        f"""SELECT name, labels AS series, 2 AS part, name || '{{' || labels || '}} ' || {SHOWN} AS value FROM gauges
UNION ALL SELECT name, min(labels), 0, '# HELP ' || name || ' ' || any_value(help) FROM gauges GROUP BY name
UNION ALL SELECT name, min(labels), 1, '# TYPE ' || name || ' gauge' FROM gauges GROUP BY name""",
    ),
    "metric_summary_exposition": query(
        "detections",
        f"""SELECT name, part, CASE part WHEN 0 THEN '# HELP ' || name || ' ' || help WHEN 1 THEN '# TYPE ' || name || ' gauge' ELSE name || ' ' || {SHOWN} END AS value
FROM (SELECT 'pipeline_total_captures' AS name, 'Total captures processed' AS help, count(*)::DOUBLE AS value FROM detections
      UNION ALL SELECT 'pipeline_avg_response_time', 'Average response time', round_even(coalesce(avg(response_time), 0.0), 4) FROM detections)
CROSS JOIN (SELECT unnest([0, 1, 2]) AS part)""",
    ),
    "metric_summary": query(
        "detections",
        """SELECT 'pipeline_total_captures' AS name, count(*)::DOUBLE AS value FROM detections
UNION ALL SELECT 'pipeline_avg_response_time', round_even(coalesce(avg(response_time), 0.0), 4) FROM detections""",
    ),
    "counter_delta": query(
        "samples counter_names",
        """SELECT name, coalesce(b, 0.0) AS before, coalesce(a, 0.0) AS after, round_even(coalesce(a, 0.0) - coalesce(b, 0.0), 6) AS delta
FROM counter_names LEFT JOIN (
  SELECT name, max_by(value, ts) FILTER (WHERE ts < TIMESTAMP '2024-01-16 00:00:00') AS b, max_by(value, ts) AS a
  FROM samples WHERE value IS NOT NULL AND ts < TIMESTAMP '2024-01-26 00:00:00' GROUP BY name) USING (name)""",
    ),
    "metric_bands": query(
        "detections",
        f"""SELECT capture, CASE WHEN confidence < 0.65 THEN 'red' WHEN confidence < 0.85 THEN 'yellow' ELSE 'green' END AS confidence_band,
       CASE WHEN response_time < 30 THEN 'green' WHEN response_time < 60 THEN 'yellow' ELSE 'red' END AS time_band,
       CASE {CODE} WHEN 0 THEN 'Normal' WHEN 1 THEN 'Brute Force' WHEN 2 THEN 'SUPI Harvest' WHEN 3 THEN 'Bidding Down' WHEN 4 THEN 'Replay'
            WHEN 5 THEN 'False BS' ELSE 'Unknown' END AS class_text FROM detections""",
    ),
    "result_table": query(
        "detections",
        """SELECT capture, prediction AS detected, method, round_even(confidence, 2) AS confidence, round_even(response_time, 1) AS seconds FROM detections""",
    ),
    "event_log_lines": query(
        "detections",
        """SELECT capture, level, '[2024-01-26 00:00:00] [' || level || '] ' || message AS line
FROM (SELECT capture, CASE WHEN prediction <> 'normal' THEN 'ALERT' ELSE 'INFO' END AS level,
             CASE WHEN prediction <> 'normal' THEN 'ATTACK DETECTED: ' || upper(prediction) ELSE 'Normal traffic' END AS message FROM detections)""",
    ),
    "log_identifiers": query(
        "logs",
        """SELECT source, seq, CASE WHEN m THEN suci END AS suci, CASE WHEN m THEN (event_id % 53 <> 0)::INTEGER END AS scheme,
       CASE WHEN NOT g AND event_type = 'signup' THEN 'imsi-00101' || lpad(user_id::VARCHAR, 10, '0') END AS imsi,
       CASE WHEN m AND event_type = 'view' THEN 23 END AS cause, CASE WHEN g THEN src_ip END AS gnb_ip
FROM (SELECT *, g AS is_gnb, NOT g AND event_type <> 'signup' AS m
      FROM (SELECT *, event_id % 97 = 0 OR event_id % 193 = 0 AS g FROM logs))""",
    ),
    "discovered_packets": query(
        "", "SELECT (event_id % 7)::VARCHAR AS folder, count(*) AS packets, sum(event_id)::BIGINT AS frames, 0::BIGINT AS with_suffix FROM events GROUP BY 1"
    ),
    "feature_file": query("sliding", f"SELECT {ALL.replace(' w,', '')} FROM sliding"),
    "training_file": query(
        "numbered",
        f"SELECT label, {', '.join(f"{f}::{'DOUBLE' if f in REAL_FEATURES else 'BIGINT'} AS {f}" for f in TRAINING_FEATURES)} FROM numbered WHERE seq <= 100",
    ),
    "report_file": query(
        "detections",
        f"""SELECT epoch_us(TIMESTAMP '2024-01-26 00:00:00') AS at_us, capture, prediction, confidence, method, {online_actions("prediction")} AS actions,
       response_time, capture_seconds, {MODEL} FROM detections""",
    ),
    "log_times": query(
        "timed_logs", "SELECT source, seq, epoch_us(ts) AS ts_us, year(ts)::INTEGER AS year, carried FROM timed_logs"
    ),
    "log_new_year": query(
        "timed_logs",
        """SELECT source, seq, epoch_us(ts - INTERVAL 15 DAY) AS ts_us, year(ts - INTERVAL 15 DAY)::INTEGER AS year, carried FROM timed_logs""",
    ),
    "log_matches_since": query(
        "timed_logs",
        f"SELECT source, seq, message FROM timed_logs WHERE ts >= {SINCE} AND regexp_matches(lower(message), 'security|reject|algorithm')",
    ),
    "keyword_occurrences": query(
        "",
        "SELECT lang, "
        + ", ".join(f"sum({occurrences('lower(text)', w)})::BIGINT AS n_{w}" for w in ("the", "la", "en"))
        + " FROM documents GROUP BY lang",
    ),
    "evidence_auth_failures": query(
        "frames logs",
        """SELECT capture, coalesce(packets, 0) AS packets, coalesce(sctp_packets, 0) AS sctp_packets, coalesce(failure_packets, 0) AS failure_packets,
       coalesce(log_failures, 0) AS log_failures, coalesce(log_rejects, 0) AS log_rejects, coalesce(log_failures, 0) > 0 AS detected
FROM (SELECT capture, count(*) AS packets, count(*) FILTER (WHERE protocol <> 'HTTP2') AS sctp_packets,
             count(*) FILTER (WHERE nas = 89) AS failure_packets FROM frames GROUP BY capture)
FULL JOIN (SELECT capture, count(*) FILTER (WHERE contains(message, 'MAC failure')) AS log_failures,
                  count(*) FILTER (WHERE contains(message, 'Authentication reject')) AS log_rejects FROM logs GROUP BY capture) USING (capture)""",
    ),
    "evidence_rejects": query(
        "frames logs",
        """SELECT capture, packet_rejects, log_rejects, packet_rejects + log_rejects > 0 AS detected
FROM (SELECT capture, coalesce(p.n, 0) AS packet_rejects, coalesce(l.n, 0) AS log_rejects
      FROM (SELECT capture, count(*) FILTER (WHERE contains(info, 'Registration reject')) AS n FROM frames GROUP BY capture) p
      FULL JOIN (SELECT capture, count(*) FILTER (WHERE contains(message, ' reject')) AS n FROM logs GROUP BY capture) l USING (capture))""",
    ),
    "evidence_since": query(
        "frames timed_logs",
        f"""SELECT capture, coalesce(log_failures, 0) AS log_failures, coalesce(log_rejects, 0) AS log_rejects,
       coalesce(refused, false) AS refused, coalesce(accepted, false) AS accepted
FROM (SELECT DISTINCT capture FROM frames)
FULL JOIN (SELECT capture, count(*) FILTER (WHERE contains(message, 'MAC failure')) AS log_failures,
                  count(*) FILTER (WHERE contains(message, 'Authentication reject')) AS log_rejects, bool_or(contains(message, 'refused')) AS refused,
                  bool_or(contains(message, 'accepted') AND src_ip = '10.10.0.50') AS accepted FROM timed_logs WHERE ts >= {SINCE} GROUP BY capture) USING (capture)""",
    ),
    "evidence_null_scheme": query(
        "frames",
        """SELECT capture, count(*) FILTER (WHERE scheme = 0) AS text_hits, count(*) FILTER (WHERE scheme = 0) AS field_hits,
       count(scheme) AS schemes_seen, count(*) FILTER (WHERE scheme = 0) > 0 AS detected FROM frames GROUP BY capture""",
    ),
    "evidence_rogue": query(
        "frames logs",
        """SELECT *, refused OR accepted AS detected
FROM (SELECT capture, coalesce(setup_response, false) AS setup_response, coalesce(setup_failure, false) AS setup_failure,
             coalesce(auth_seen, false) AS auth_seen, coalesce(refused, false) AS refused, coalesce(accepted, false) AS accepted
      FROM (SELECT capture, bool_or(contains(info, 'NGSetupResponse')) AS setup_response, bool_or(contains(info, 'NGSetupFailure')) AS setup_failure,
                   bool_or(nas IN (86, 89)) AS auth_seen FROM frames GROUP BY capture)
      FULL JOIN (SELECT capture, bool_or(contains(message, 'refused')) AS refused,
                        bool_or(contains(message, 'accepted') AND src_ip = '10.10.0.50') AS accepted FROM logs GROUP BY capture) USING (capture))""",
    ),
    "evidence_abort": query(
        "frames",
        """SELECT capture, bool_or(abort) AS abort_seen, md5(min_by(rand, frame_no) FILTER (WHERE rand IS NOT NULL)) AS first_rand, count(*) AS packets
FROM frames GROUP BY capture""",
    ),
    "evidence_sections": query(
        "frames logs",
        """SELECT capture, 'packets' AS section, frame_no AS seq, info AS line FROM frames WHERE setup OR abort OR nas IN (68, 93)
UNION ALL SELECT capture, 'scheme_lines', frame_no, info FROM frames WHERE scheme = 0
UNION ALL SELECT capture, 'scheme_values', frame_no, scheme::VARCHAR FROM frames WHERE scheme IS NOT NULL
UNION ALL SELECT capture, 'base_station', seq, message FROM logs WHERE event_id % 97 = 0 OR event_id % 193 = 0
UNION ALL SELECT capture, 'log', seq, message FROM logs WHERE regexp_matches(lower(message), 'security|reject|refused|accepted')""",
    ),
    "last_registrations": query(
        "logs",
        """SELECT source, rank, seq, message
FROM (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY seq DESC))::INTEGER AS rank FROM logs WHERE contains(message, 'SUPI'))
WHERE rank <= 4""",
    ),
}
ORACLE["stream_rate_limit"] = ORACLE["stream_rate_limit_late"] = ORACLE["rate_limit"]
ORACLE["stream_overrides_updated"] = ORACLE["stream_overrides"]
