"""Windows that lie on a capture's own time line, and verdicts when a capture ends, on a stream.

A capture starts with its first packet, so its windows can be laid once that packet is certain:
packets wait until the watermark has passed them and are then taken in time order. A window is out
as soon as a later packet shows that the capture outlasts it; what remains comes when no packet has
arrived for ``gap``. State per capture is the packets still waiting, the panes and RAND values of
one window, and one row of totals, so it doesn't grow with the length of the capture. Captures are
dealt to ``ScaleLimits.capture_groups`` groups by hash: a group has one state, read and written once a
call, and one timer, so what a call costs is shared by its captures. All packets of a group in one
micro-batch meet in one task, in batches; ``packet_stream`` bounds them by files.

The length of a capture is the time of its last packet. Packets that arrive after their capture has
ended start a new one of that name.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from authsignal.config import SCORE_WEIGHTS, DetectorConfig, ScaleLimits
from authsignal.operators import forest
from authsignal.operators.features import (
    COUNTERS,
    FEATURE_COLUMNS,
    SEEN,
    Layout,
    conditions,
    derive,
    null_scheme,
    rogue_setup,
    watched,
)
from authsignal.operators.windows import apply_overrides
from authsignal.plans.detection import decide, with_score_share

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROGUE = "rogue"
BITS = (*COUNTERS, *SEEN, ROGUE)  # what is true of a packet, one bit each
PANE = (*COUNTERS, *SEEN)
WINDOW = (
    "capture string, w long, capture_us long, " + ", ".join(f"{c} long" for c in COUNTERS) + ", "
    + ", ".join(f"{c} boolean" for c in SEEN) + ", rand_repeat int, all_failures long, any_abort boolean, any_rogue boolean, score long"
)


def state_store(spark: SparkSession) -> None:
    """The only store that keeps several states and timers per key; set it before the stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class Fold:
    """The totals of one capture and the window it is in; plain data, filled in time order."""

    def __init__(self, layout: Layout, clock: tuple | None, panes: dict[int, list[int]], rands: dict[str, int]):
        self.layout, self.panes, self.rands = layout, panes, rands
        fields = clock or (None, None, [], 0, [], 0, False, False, None)
        self.t0, self.last_us, self.pending, self.next_w, self.marked, self.failures, self.abort, self.rogue, self.best = fields
        self.pending, self.marked = [tuple(p) for p in self.pending], set(self.marked)

    def clock(self) -> tuple | None:
        return None if self.t0 is None else (self.t0, self.last_us, self.pending, self.next_w, sorted(self.marked), self.failures, self.abort, self.rogue, self.best)

    def add(self, us: int, flags: int, rand: str | None) -> Iterator[list[int]]:
        """Take a packet; packets of the latest instant stay pending, as a short capture leaves its last one out."""
        if self.t0 is None:
            self.t0 = self.last_us = us
        if us > self.last_us:
            self.settle()
            self.last_us = us
            while self.next_w * self.layout.step_us + self.layout.size_us <= us - self.t0:
                yield self.window()
        self.failures += flags >> BITS.index("auth_failures") & 1
        self.abort = self.abort or bool(flags >> BITS.index("sctp_abort") & 1)
        self.rogue = self.rogue or bool(flags >> BITS.index(ROGUE) & 1)
        self.pending.append((flags, rand))

    def settle(self) -> None:
        """Count the pending packets in their pane."""
        pane, lay = (self.last_us - self.t0) // self.layout.pane_us, self.layout
        for flags, rand in self.pending:
            counts = self.panes.setdefault(pane, [0] * len(PANE))
            for k in range(len(PANE)):
                counts[k] += flags >> k & 1
            if rand:
                earlier = self.rands.get(rand)
                if earlier is not None:
                    last = earlier * lay.pane_us // lay.step_us
                    self.marked.update(range(max(self.first(pane), self.next_w), last + 1))
                self.rands[rand] = pane
        self.pending = []

    def first(self, pane: int) -> int:
        """First window that holds the whole pane."""
        return max(0, -(-((pane + 1) * self.layout.pane_us - self.layout.size_us) // self.layout.step_us))

    def window(self, length: int | None = None) -> list[int]:
        """The next window's row; what no later window needs is forgotten."""
        w, lay = self.next_w, self.layout
        low = w * lay.step_us // lay.pane_us
        own = [counts for pane, counts in self.panes.items() if low <= pane < low + lay.size_us // lay.pane_us]
        sums = [sum(column) for column in zip(*own)] if own else [0] * len(PANE)
        row = [w, length if length is not None else self.last_us - self.t0, *sums, int(w in self.marked)]
        self.next_w += 1
        self.marked.discard(w)
        return row

    def rest(self) -> Iterator[list[int]]:
        """The windows that only the end of the capture settles."""
        length, lay = self.last_us - self.t0, self.layout
        if lay.whole_short:
            if length < lay.size_us:
                yield self.window(length)
            return
        count = max(1, -(-length // lay.size_us))
        if length < count * lay.size_us:
            self.settle()
        while self.next_w < count:
            yield self.window(length)

    def keep_best(self, row: list[int]) -> None:
        score = self.score(row)
        if self.best is None or score > self.best[0]:
            self.best = [score, *row]

    @staticmethod
    def score(row: list[int]) -> int:
        counts = dict(zip(PANE, row[2:]))
        counts["suci_unencrypted"] = int(counts["null_seen"] > 0 and counts["watched_seen"] > 0)
        return sum(weight * counts[name] for name, weight in SCORE_WEIGHTS.items())


class CaptureProcessor(StatefulProcessor):
    """Feeds the packets of a group's captures to their :class:`Fold`; emits all windows, or the best one at the end.

    The state of a group is one value: for each capture that has not ended its clock, panes, RAND values,
    waiting packets and the time at which it is due without further packets, as plain data.
    """

    def __init__(self, layout: Layout, gap_ms: int, verdicts: bool):
        self.layout, self.gap_ms, self.verdicts = layout, gap_ms, verdicts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.captures = handle.getValueState("captures", "held binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        fresh: dict[str | None, list] = {}
        for part in rows:
            for capture, us, frame, flags, rand in zip(*(part[name].tolist() for name in ("capture", "at_us", "frame_no", "flags", "rand"))):
                packet = (us, frame, flags, rand if isinstance(rand, str) else None)
                fresh.setdefault(capture if isinstance(capture, str) else None, []).append(packet)
        yield from self.advance(fresh, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self.advance({}, timerValues.getCurrentWatermarkInMs())

    def advance(self, fresh: dict[str | None, list], watermark: int) -> Iterator[pd.DataFrame]:
        """Take the captures further that have new packets or are due."""
        stored = self.captures.get()
        held = pickle.loads(stored[0]) if stored else {}
        out: list[tuple] = []
        for capture in {**dict.fromkeys(c for c, state in held.items() if state[-1] <= watermark), **dict.fromkeys(fresh)}:
            state = self.step(capture, held.pop(capture, (None, {}, {}, [], 0)), fresh.get(capture, []), watermark, out)
            if state:
                held[capture] = state
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held:
            self.captures.update((pickle.dumps(held),))
            self.handle.registerTimer(min(state[-1] for state in held.values()))
        else:
            self.captures.clear()
        if out:
            names = ["capture", "w", "capture_us", *PANE, "rand_repeat", "all_failures", "any_abort", "any_rogue", "score"]
            yield pd.DataFrame(out, columns=names)

    def step(self, capture: str | None, state: tuple, fresh: list, watermark: int, out: list[tuple]) -> tuple | None:
        """Take what the watermark has passed; end the capture if nothing came for the gap. The new state, or None."""
        clock, panes, rands, waiting, _ = state
        rows = sorted([*waiting, *fresh], key=lambda r: (r[0], r[1]))
        ready = [r for r in rows if r[0] <= watermark * 1000]
        late = rows[len(ready) :]
        fold = Fold(self.layout, clock, panes, rands)
        found = [row for us, _, flags, rand in ready for row in fold.add(us, flags, rand)]
        ended = fold.t0 is not None and not late and watermark >= fold.last_us // 1000 + self.gap_ms
        if ended:
            found += fold.rest()
        if self.verdicts:
            for row in found:
                fold.keep_best(row)
            found = [fold.best[1:]] if ended else []
        length = fold.last_us - fold.t0 if self.verdicts and found else None
        out += self.table(capture, found, fold, length)
        if ended:
            return None
        oldest = fold.next_w * self.layout.step_us // self.layout.pane_us
        due = late[0][0] // 1000 + 1 if late else fold.last_us // 1000 + self.gap_ms
        panes = {pane: counts for pane, counts in fold.panes.items() if pane >= oldest}
        rands = {rand: pane for rand, pane in fold.rands.items() if pane >= oldest}
        return (fold.clock(), panes, rands, late, due)

    def table(self, capture: str | None, found: list[list[int]], fold: Fold, length: int | None) -> list[tuple]:
        rows = []
        for row in found:
            counts = row[2 : 2 + len(COUNTERS)]
            seen = [bool(v) for v in row[2 + len(COUNTERS) : 2 + len(PANE)]]
            whole = [fold.failures, fold.abort, fold.rogue, Fold.score(row)]
            rows.append((capture, row[0], row[1] if length is None else length, *counts, *seen, row[-1], *whole))
        return rows


def marked(packets: DataFrame, cfg: DetectorConfig) -> DataFrame:
    """Packets as the processor needs them: instant, frame and one bit for everything that is true of it."""
    tests = {**conditions(cfg), "null_seen": null_scheme(cfg), "watched_seen": watched(cfg), ROGUE: rogue_setup(cfg)}
    flags = " + ".join(f"if({tests[name]}, {1 << k}L, 0L)" for k, name in enumerate(BITS))
    return packets.selectExpr("capture", "ts", "unix_micros(ts) AS at_us", "frame_no", f"{flags} AS flags", "nullif(rand, '') AS rand")


def _processed(packets: DataFrame, cfg: DetectorConfig, layout: Layout, gap_seconds: int, verdicts: bool, limits: ScaleLimits) -> DataFrame:
    part = F.expr(f"cast(pmod(xxhash64(capture), {limits.capture_groups}) AS int)")
    return marked(packets, cfg).withColumn("part", part).groupBy("part").transformWithStateInPandas(
        CaptureProcessor(layout, gap_seconds * 1000, verdicts), outputStructType=WINDOW, outputMode="append", timeMode="eventtime"
    )


def sliding_windows(
    packets: DataFrame, cfg: DetectorConfig = DetectorConfig(), gap_seconds: int = 300, limits: ScaleLimits = ScaleLimits()
) -> DataFrame:
    """The sliding feature windows of each capture, empty ones and those of short captures included."""
    layout = Layout.sliding(cfg)
    return derive(_processed(packets, cfg, layout, gap_seconds, False, limits), cfg, layout).select(*FEATURE_COLUMNS)


def finished_captures(
    packets: DataFrame, cfg: DetectorConfig = DetectorConfig(), gap_seconds: int = 300, limits: ScaleLimits = ScaleLimits()
) -> DataFrame:
    """One row per capture that has ended: its best window with the whole-capture overrides."""
    layout = Layout.tumbling(cfg)
    rows = derive(_processed(packets, cfg, layout, gap_seconds, True, limits), cfg, layout)
    return apply_overrides(rows, cfg).withColumn("capture_seconds", F.bround(F.col("capture_us") / F.lit(float(cfg.unit_us)), 2))


def verdicts(finished: DataFrame, cfg: DetectorConfig = DetectorConfig(), model: PipelineModel | None = None) -> DataFrame:
    """Rules first; the rest is left to a fitted model, or to the weighted rules where there is none."""
    if model is None:
        return decide(with_score_share(finished), cfg, "weighted_class", "score_share", "weighted")
    return decide(forest.predict(model, finished), cfg, "model_class", "model_confidence", "rf")
