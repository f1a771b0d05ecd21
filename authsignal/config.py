"""Parameters of the detector and the fixed values of its domain."""

from __future__ import annotations

from dataclasses import dataclass

# ---- fixed values: class names, in the order used for score ties and reports ----
NORMAL = "normal"
UNKNOWN = "unknown"
LABELS = ("normal", "brute_force", "supi_harvest", "bidding_down", "replay", "false_bs")
SCORE_ORDER = ("brute_force", "supi_harvest", "bidding_down", "false_bs", "replay", "normal")
ATTACKS = ("brute_force", "supi_harvest", "bidding_down", "replay", "false_bs")
CLASS_CODES = {
    "normal": 0,
    "brute_force": 1,
    "supi_harvest": 2,
    "bidding_down": 3,
    "replay": 4,
    "false_bs": 5,
}
CLASS_TEXT = {
    0: "Normal",
    1: "Brute Force",
    2: "SUPI Harvest",
    3: "Bidding Down",
    4: "Replay",
    5: "False BS",
    -1: "Unknown",
}

# ---- fixed values: feature names, model order and training-set order ----
MODEL_FEATURES = (
    "total_packets",
    "auth_requests",
    "reg_requests",
    "reg_rejects",
    "sec_mode_cmds",
    "ng_setup_req",
    "suci_unencrypted",
    "duration",
    "auth_rate",
    "reg_rate",
    "reject_rate",
    "auth_success_rate",
    "rand_repeat",
    "auth_failures",
    "sctp_abort",
)
TRAINING_FEATURES = (
    "total_packets",
    "auth_requests",
    "reg_requests",
    "reg_rejects",
    "auth_failures",
    "sctp_abort",
    "sec_mode_cmds",
    "ng_setup_req",
    "suci_unencrypted",
    "duration",
    "auth_rate",
    "reg_rate",
    "reject_rate",
    "auth_success_rate",
    "rand_repeat",
    "is_active",
)
BINARY_FEATURES = ("suci_unencrypted", "rand_repeat", "is_active")
INTEGER_FEATURES = (
    "total_packets",
    "auth_requests",
    "reg_requests",
    "reg_rejects",
    "auth_failures",
    "sctp_abort",
    "sec_mode_cmds",
    "ng_setup_req",
)
REAL_FEATURES = ("duration", "auth_rate", "reg_rate", "reject_rate", "auth_success_rate")

# ---- fixed values: weights of the window score ----
SCORE_WEIGHTS = {
    "suci_unencrypted": 100,
    "auth_failures": 50,
    "sctp_abort": 50,
    "reg_rejects": 30,
    "sec_mode_cmds": 20,
    "ng_setup_req": 15,
    "auth_requests": 2,
    "total_packets": 1,
}

# ---- fixed values: counters read before and after a run ----
COUNTER_NAMES = (
    "reg_init_req",
    "reg_init_succ",
    "reg_init_fail",
    "auth_req",
    "auth_reject",
    "auth_fail",
)


@dataclass(frozen=True)
class DetectorConfig:
    """Thresholds, protocol codes and address lists; every one can be overridden."""

    # window layout; ``unit_us`` is how many microseconds of packet time make one second
    window_seconds: int = 30
    step_seconds: int = 10
    unit_us: int = 1_000_000

    # protocol codes
    auth_request: int = 0x56
    auth_failure: int = 0x59
    reg_request: int = 0x41
    reg_reject: int = 0x44
    sec_mode_cmd: int = 0x5D
    ng_setup: int = 21
    sctp_abort: int = 6
    null_scheme: int = 0

    # address lists
    setup_allow_list: tuple[str, ...] = ("10.10.0.30", "10.10.0.12")
    watch_list: tuple[str, ...] = ("10.10.0.41",)
    rogue_address: str = "10.10.0.50"

    # thresholds
    active_packets: int = 50
    rogue_sentinel: int = 99
    online_failures: int = 5
    confidence_gate: float = 0.65
    oversample_ready: int = 3
    max_attempts: int = 5
    block_failures: int = 3
    rate_window_seconds: int = 60

    # training set
    per_class: int = 100
    neighbours: int = 5
    noise: float = 0.15
    seed: int = 42

    # parity keeps "no_action" for captures the model is unsure about
    unknown_action: str = "no_action"

    @property
    def window_us(self) -> int:
        return self.window_seconds * self.unit_us

    @property
    def step_us(self) -> int:
        return self.step_seconds * self.unit_us

    @property
    def rate_window_us(self) -> int:
        return self.rate_window_seconds * self.unit_us

    @property
    def overlap_percent(self) -> int:
        return int((1 - self.step_seconds / self.window_seconds) * 100)


@dataclass(frozen=True)
class ScaleLimits:
    """Bounds that decide between a broadcast, a plain join and a salted join."""

    # a one-row-per-key table is broadcast only up to this many bytes, measured while it is written
    broadcast_bytes: int = 32 << 20
    # a key is hot once it holds more than this many rows ...
    hot_rows: int = 5_000_000
    # ... and more than one part in this many of all rows, so hot keys stay below this count
    hot_keys: int = 10_000
    # windows generated by one row of a span table
    span_block: int = 4_096
    # groups of subscribers that the rate limiter keeps on a stream, for each stretch of time
    rate_groups: int = 1_024
    # groups of captures whose windows are kept together on a stream
    capture_groups: int = 1_024
