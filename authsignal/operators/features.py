"""Window features in one pass over the packets.

Packets are first reduced to panes (the greatest common divisor of window size and step), with
map-side combining, and only the panes are spread over the windows they belong to. No packet is
ever copied, no range join is needed and a capture of any size leaves at most one row per pane.
The pane holding the last frame of a capture also emits the whole window grid with zero counts,
so empty windows appear without a second scan or a join.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import gcd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authsignal.config import DetectorConfig, ScaleLimits
from authsignal.sources.captures import with_capture_length

COUNTERS = (
    "total_packets",
    "auth_requests",
    "auth_failures",
    "reg_requests",
    "reg_rejects",
    "sec_mode_cmds",
    "ng_setup_req",
    "sctp_abort",
)
SEEN = ("null_seen", "watched_seen")


@dataclass(frozen=True)
class Layout:
    """How windows lie on the time line of a capture; its members are SQL expressions."""

    size_us: int
    step_us: int
    whole_short: bool  # a capture shorter than one window becomes a single window of its own length

    @classmethod
    def sliding(cls, cfg: DetectorConfig) -> "Layout":
        return cls(cfg.window_us, cfg.step_us, True)

    @classmethod
    def tumbling(cls, cfg: DetectorConfig) -> "Layout":
        return cls(cfg.window_us, cfg.window_us, False)

    @property
    def pane_us(self) -> int:
        return gcd(self.size_us, self.step_us)

    @property
    def pane(self) -> str:
        return f"rel_us div {self.pane_us}"

    @property
    def counted(self) -> str:
        """Packets that can count at all; a short capture excludes its own last instant."""
        return f"(capture_us >= {self.size_us} OR rel_us < capture_us)" if self.whole_short else "true"

    @property
    def n_windows(self) -> str:
        if self.whole_short:
            return f"if(capture_us < {self.size_us}, 1L, (capture_us - {self.size_us}) div {self.step_us} + 1)"
        return f"greatest(1L, (capture_us + {self.size_us - 1}) div {self.size_us})"

    def first_window(self, pane: str) -> str:
        """First window that holds a whole pane."""
        return f"greatest(0L, (({pane} + 1) * {self.pane_us} + {self.step_us - self.size_us - 1}) div {self.step_us})"

    def last_window(self, pane: str) -> str:
        return f"({pane} * {self.pane_us}) div {self.step_us}"


def _carries(array: str, code: int) -> str:
    """A multi-valued packet field holds a code; a packet matches once, however often."""
    return f"coalesce(array_contains({array}, {code}), false)"


def conditions(cfg: DetectorConfig) -> dict[str, str]:
    """What each counter counts; shared by batch windows, overrides and streams."""
    return {
        "total_packets": "true",
        "auth_requests": _carries("nas_msg_types", cfg.auth_request),
        "auth_failures": _carries("nas_msg_types", cfg.auth_failure),
        "reg_requests": _carries("nas_msg_types", cfg.reg_request),
        "reg_rejects": _carries("nas_msg_types", cfg.reg_reject),
        "sec_mode_cmds": _carries("nas_msg_types", cfg.sec_mode_cmd),
        "ng_setup_req": _carries("ngap_procedures", cfg.ng_setup),
        "sctp_abort": _carries("sctp_chunk_types", cfg.sctp_abort),
    }


def _listed(column: str, values: tuple[str, ...]) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})" if values else "false"


def null_scheme_field(cfg: DetectorConfig) -> str:
    return f"coalesce(prot_scheme_id = {cfg.null_scheme}, false)"


def null_scheme(cfg: DetectorConfig) -> str:
    """The null protection scheme, by field or by dissected text: one condition for all operators."""
    return f"({null_scheme_field(cfg)} OR coalesce(info ILIKE '%null scheme%', false))"


def watched(cfg: DetectorConfig) -> str:
    return f"(coalesce({_listed('src_ip', cfg.watch_list)}, false) OR coalesce({_listed('dst_ip', cfg.watch_list)}, false))"


def rogue_setup(cfg: DetectorConfig) -> str:
    """A set-up message whose sender is known and not on the allow list."""
    unlisted = f"coalesce(trim(src_ip) <> '' AND NOT {_listed('trim(src_ip)', cfg.setup_allow_list)}, false)"
    return f"({_carries('ngap_procedures', cfg.ng_setup)} AND {unlisted})"


def panes(packets: DataFrame, cfg: DetectorConfig, layout: Layout, **more: str) -> DataFrame:
    """One row per (capture, pane): counts inside windows, whole-capture evidence, and ``more`` aggregates."""
    tests = conditions(cfg)
    keep = layout.counted
    aggregates = {
        **{name: f"count_if({keep} AND {tests[name]})" for name in COUNTERS},
        "null_seen": f"bool_or({keep} AND {null_scheme(cfg)})",
        "watched_seen": f"bool_or({keep} AND {watched(cfg)})",
        "all_failures": f"count_if({tests['auth_failures']})",
        "any_abort": f"bool_or({tests['sctp_abort']})",
        "any_rogue": f"bool_or({rogue_setup(cfg)})",
        "capture_us": "max(capture_us)",
        "has_last": "bool_or(frame_no = last_frame)",
        **more,
    }
    return packets.groupBy("capture", F.expr(f"{layout.pane} AS pane")).agg(
        *[F.expr(f"{expression} AS {name}") for name, expression in aggregates.items()]
    )


def rand_repeats(packets: DataFrame, layout: Layout) -> DataFrame:
    """(capture, window) pairs in which some RAND value occurs more than once.

    A value counts once per pane after pre-aggregation. Only values met again within one window
    are expanded, so the many unique values never are.
    """
    seen = (
        packets.where(f"rand IS NOT NULL AND rand <> '' AND {layout.counted}")
        .groupBy("capture", "rand", F.expr(f"{layout.pane} AS pane"))
        .agg(F.expr("count(*) AS n"), F.expr("max(capture_us) AS capture_us"))
    )
    latest = layout.last_window("if(n > 1, pane, earlier)")
    return (
        seen.selectExpr("*", "lag(pane) OVER (PARTITION BY capture, rand ORDER BY pane) AS earlier")
        .where("n > 1 OR earlier IS NOT NULL")
        .selectExpr(
            "capture", f"{layout.first_window('pane')} AS lo", f"least({latest}, {layout.n_windows} - 1) AS hi"
        )
        .where("lo <= hi")
        .selectExpr("capture", "explode(sequence(lo, hi)) AS w")
        .distinct()
    )


def _spread(pane_rows: DataFrame, layout: Layout, limits: ScaleLimits) -> DataFrame:
    """Pane rows repeated for their windows, plus the empty grid from each capture's last pane.

    The grid comes in blocks, so no single row ever holds the window list of a very long capture.
    """
    size = limits.span_block
    return (
        pane_rows.selectExpr(
            "*", f"explode(if(has_last, sequence(-1L, ({layout.n_windows} - 1) div {size}), array(-1L))) AS block"
        )
        .selectExpr(
            "*",
            "block < 0 AS own",
            f"if(block < 0, {layout.first_window('pane')}, block * {size}) AS lo",
            f"least(if(block < 0, {layout.last_window('pane')}, block * {size} + {size - 1}), {layout.n_windows} - 1) AS hi",
        )
        .where("lo <= hi")
        .selectExpr("*", "explode(sequence(lo, hi)) AS w")
    )


def window_counts(
    packets: DataFrame, cfg: DetectorConfig, layout: Layout, limits: ScaleLimits = ScaleLimits()
) -> DataFrame:
    """Raw counts per (capture, w); every window of the grid is present, also empty ones."""
    packets = with_capture_length(packets, limits=limits)
    counted = _spread(panes(packets, cfg, layout), layout, limits).selectExpr(
        "capture",
        "w",
        "capture_us",
        *[f"if(own, {c}, 0L) AS {c}" for c in COUNTERS],
        *[f"own AND {c} AS {c}" for c in SEEN],
        "0 AS rand_repeat",
    )
    repeats = rand_repeats(packets, layout).selectExpr(
        "capture",
        "w",
        "cast(NULL AS bigint) AS capture_us",
        *[f"0L AS {c}" for c in COUNTERS],
        *[f"false AS {c}" for c in SEEN],
        "1 AS rand_repeat",
    )
    totals = ["max(capture_us) AS capture_us", *[f"sum({c}) AS {c}" for c in COUNTERS]]
    totals += [f"bool_or({c}) AS {c}" for c in SEEN] + ["max(rand_repeat) AS rand_repeat"]
    return counted.union(repeats).groupBy("capture", "w").agg(*[F.expr(t) for t in totals])


# ---- fixed formulas of the rates: four places, half to even, guarded denominators ----
RATES = {
    "auth_rate": "bround(cast(auth_requests AS double) / if(duration > 0, duration, 1.0D), 4)",
    "reg_rate": "bround(cast(reg_requests AS double) / if(duration > 0, duration, 1.0D), 4)",
    "reject_rate": "bround(cast(reg_rejects AS double) / greatest(reg_requests, 1L), 4)",
    "auth_success_rate": "bround(cast(greatest(auth_requests - reg_rejects, 0L) AS double) / greatest(auth_requests, 1L), 4)",
}


def rate_columns(rows: DataFrame) -> DataFrame:
    """The four rates of a feature row from its counts and duration; a zero duration counts as one second."""
    return rows.selectExpr("*", *[f"{formula} AS {name}" for name, formula in RATES.items()])


def derive(counts: DataFrame, cfg: DetectorConfig, layout: Layout) -> DataFrame:
    """Rates, flags and window bounds from raw counts; pure projection."""
    unit = float(cfg.unit_us)
    duration = f"{layout.size_us / unit}D"
    if layout.whole_short:
        duration = f"if(capture_us < {layout.size_us}, capture_us / {unit}D, {duration})"
    start = f"w * {layout.step_us / unit}D"
    bounded = counts.selectExpr(
        "*",
        f"{duration} AS duration",
        f"bround({start}, 1) AS t_start",
        "cast(null_seen AND watched_seen AS int) AS suci_unencrypted",
        f"cast(total_packets > {cfg.active_packets} AS int) AS is_active",
    )
    return rate_columns(bounded).selectExpr("*", f"bround({start} + duration, 1) AS t_end")


FEATURE_COLUMNS = (
    "capture",
    "w",
    "t_start",
    "t_end",
    *COUNTERS[:-1],
    "suci_unencrypted",
    "duration",
    "auth_rate",
    "reg_rate",
    "reject_rate",
    "auth_success_rate",
    "rand_repeat",
    "sctp_abort",
    "is_active",
)


def window_features(
    packets: DataFrame, cfg: DetectorConfig, layout: Layout, limits: ScaleLimits = ScaleLimits()
) -> DataFrame:
    """The feature table: one row per window, all counts, rates and flags."""
    return derive(window_counts(packets, cfg, layout, limits), cfg, layout).select(*FEATURE_COLUMNS)


def sliding_features(packets: DataFrame, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    return window_features(packets, cfg, Layout.sliding(cfg))


def tumbling_features(packets: DataFrame, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    return window_features(packets, cfg, Layout.tumbling(cfg))
