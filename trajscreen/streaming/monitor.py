"""Online monitoring of runs with Structured Streaming: causal scores, first alarms, running maxima."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trajscreen.functions.workers import carried

carried(__name__)

OUT = "sim bigint, frame int, detector string, score double, late boolean"
STATE = "nodes array<int>, frame int, late bigint, last binary, before binary, past binary, frames array<int>, speeds binary, constvel_on array<int>, constvel binary, causal_on array<int>, causal binary, waits int, waiting array<int>, places binary"
MAD = 1.4826
LEAST_LEVELS, LEVEL_GAP = 3, 3  # as detect.calibrated_causal


def nearest_rank(ordered: np.ndarray, centre: np.ndarray, rank: int) -> np.ndarray:
    """The rank-th smallest (from 0) distance to its centre in each row of sorted values. The rank + 1 nearest values of a row
    are neighbours: their first place is found by halving."""
    low, high = np.zeros(len(ordered), int), np.full(len(ordered), ordered.shape[1] - 1 - rank)
    at = lambda i: np.take_along_axis(ordered, i[:, None], 1)[:, 0]
    while (low < high).any():
        mid = (low + high) // 2
        right = at(mid + rank) - centre >= centre - at(mid)
        low, high = np.where(right | (low >= high), low, mid + 1), np.where(right, mid, high)
    width = lambda i: np.maximum(centre - at(i), at(i + rank) - centre)
    return np.minimum(width(low), width(np.maximum(low - 1, 0)))


def middle_and_spread(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Median and median distance to it of each row of sorted values."""
    ranks = (ordered.shape[1] - 1) // 2, ordered.shape[1] // 2
    centre = (ordered[:, ranks[0]] + ordered[:, ranks[1]]) / 2
    return centre, (nearest_rank(ordered, centre, ranks[0]) + nearest_rank(ordered, centre, ranks[1])) / 2


def _table(columns: int = 0, rows: int = 0) -> np.ndarray:
    return np.zeros((rows, columns))


@dataclass
class Run:
    """What is held of a run: the places of its last two frames, the sorted speeds of frames that may be looked back on,
    those of the few frames since, the raw scores on calibration frames by detector, and the rows of a frame not yet complete."""

    nodes: list[int] = field(default_factory=list)
    frame: int = -1
    late: int = 0
    last: np.ndarray = field(default_factory=lambda: _table(3))
    before: np.ndarray = field(default_factory=lambda: _table(3))
    past: np.ndarray = field(default_factory=_table)
    frames: list[int] = field(default_factory=list)
    speeds: np.ndarray = field(default_factory=_table)
    levels: dict[str, tuple[list[int], np.ndarray]] = field(default_factory=dict)
    waits: int = -1
    waiting: list[int] = field(default_factory=list)
    places: np.ndarray = field(default_factory=lambda: _table(3))

    @classmethod
    def read(cls, state: tuple) -> Run:
        nodes, frame, late, last, before, past, frames, speeds, on1, of1, on2, of2, waits, waiting, places = state
        n = max(len(nodes), 1)
        matrix = lambda b, *shape: np.frombuffer(bytes(b)).reshape(*shape)
        ints = lambda a: [int(x) for x in a]
        levels = {d: (ints(on), matrix(of, n, -1) if len(on) else _table(rows=n)) for d, on, of in (("constvel", on1, of1), ("velocity_causal", on2, of2))}
        wide = lambda b: matrix(b, n, -1) if len(b) else _table(rows=n)
        return cls(ints(nodes), frame, late, matrix(last, -1, 3), matrix(before, -1, 3), wide(past), ints(frames), wide(speeds), levels, waits, ints(waiting), matrix(places, -1, 3))

    def state(self) -> tuple:
        packed = lambda a: np.ascontiguousarray(a, float).tobytes()
        (on1, of1), (on2, of2) = (self.levels.get(d, ([], _table())) for d in ("constvel", "velocity_causal"))
        return self.nodes, self.frame, self.late, packed(self.last), packed(self.before), packed(self.past), self.frames, packed(self.speeds), on1, packed(of1), on2, packed(of2), self.waits, self.waiting, packed(self.places)

    def restart(self, nodes: list[int]) -> None:
        self.nodes, self.before, self.frames, self.levels = nodes, _table(3), [], {}
        self.past, self.speeds = _table(rows=len(nodes)), _table(rows=len(nodes))

    def advance(self, f: int, nodes: list[int], now: np.ndarray, gap: int, least: int, k: int, calib: Sequence[int] | None) -> list[tuple[str, float]]:
        """(detector, score) of the frame f, which then is the last one."""
        out = []
        if nodes != self.nodes:
            if self.nodes and set(nodes) < set(self.nodes):  # rows were lost: the frame is passed over, the history stays
                self.frame, self.last, self.before = f, _table(3), _table(3)
                return out
            self.restart(nodes)
        elif f == self.frame + 1 and len(self.last):
            speed = np.linalg.norm(now - self.last, axis=1)
            raw = {"constvel": np.linalg.norm(now - (2 * self.last - self.before), axis=1)} if len(self.before) else {}
            self.frames, self.speeds = [*self.frames, f], np.column_stack([self.speeds, speed])
            ready = np.array(self.frames) <= max(f - gap, least)
            if ready.any():
                self.past = np.sort(np.column_stack([self.past, self.speeds[:, ready]]), axis=1, kind="stable")
                self.frames, self.speeds = [g for g, r in zip(self.frames, ready, strict=True) if not r], self.speeds[:, ~ready]
            if f >= least and self.past.shape[1]:
                centre, spread = middle_and_spread(self.past)
                raw["velocity_causal"] = np.abs(speed - centre) / (MAD * spread + 1e-9)
            top = lambda s: float(np.mean(np.sort(s)[::-1][:k]))
            for d, s in raw.items():
                out.append((d, top(s)))
                if calib is None:
                    continue
                on, of = self.levels.get(d, ([], _table(rows=len(nodes))))
                n = sum(g < f - LEVEL_GAP for g in on)
                if n >= LEAST_LEVELS:
                    level = np.median(of[:, :n], axis=1)
                    out.append((f"{d}_calibrated", top(s / (level + np.median(level) + 1e-12))))
                if f in calib:
                    self.levels[d] = [*on, f], np.column_stack([of, s])
            self.before = self.last
        else:
            self.before = _table(3)
        self.last, self.frame = now, f
        return out


def monitor(stream: DataFrame, gap: int = 4, least: int = 5, k: int = 5, idle_ms: int | None = None, calib: Sequence[int] | None = None, delay: str | None = None) -> DataFrame:
    """Frame scores of detectors constvel and velocity_causal from a stream (sim, frame, node, x, y, z, ts) of plate nodes; with
    calib (calibration frames) also of constvel_calibrated and velocity_causal_calibrated: scores over the median of the node's
    scores on calibration frames before t - 3 plus the plate's median of those, once there are three such frames.

    State of a run: `Run`. Medians are exact over all past frames, so a run in progress holds a double for each node and past
    frame, in sorted order; a frame's medians are found in place by halving.
    A frame is scored once it is complete: when it has all nodes of the frame before it (a mesh keeps its nodes), or when a
    later one of the run has come. Till then its rows wait, so it may be split over batches. A frame at or before the last
    scored one is late: counted, reported without scores and dropped. A frame that lacks nodes isn't compared, nor is the next one
    with it; one with new nodes starts the run's history anew. Equal to the batch scores for frames whose past has no
    look-ahead: t >= least, and t >= 29 for calibrated ones on every tenth frame from 5 on.

    Ends of runs: with delay, a watermark on ts, rows older than it are dropped by Spark, and a run is over when the watermark has
    passed its newest ts by idle_ms (0 if not given): a frame that still waits is scored as it is and the state is dropped.
    Without delay, idle_ms is the time in which a run sends nothing; Spark looks for such runs in batches without data, so an
    availableNow trigger then never ends (unless spark.sql.streaming.noDataMicroBatches.enabled is false).
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, rows = Run.read(state.get) if state.exists else Run(), []

        def scored(f: int, nodes: list[int], now: np.ndarray) -> None:
            rows.extend((key[0], f, d, s, False) for d, s in run.advance(f, nodes, now, gap, least, k, calib))

        if state.hasTimedOut:
            if len(run.waiting):
                scored(run.waits, run.waiting, run.places)
            state.remove()
            yield pd.DataFrame(rows, columns=["sim", "frame", "detector", "score", "late"])
            return
        new = pd.concat(list(batches))
        seen = new["seen"].max()
        new = new[["frame", "node", "x", "y", "z"]]
        if len(run.waiting):
            held = pd.DataFrame(run.places, columns=["x", "y", "z"]).assign(frame=run.waits, node=run.waiting)
            new = pd.concat([held[new.columns], new])
        newest, run.waits, run.waiting, run.places = new["frame"].max(), -1, [], _table(3)
        for f, part in new.groupby("frame"):
            if f <= run.frame:
                run.late += len(part)
                rows.append((key[0], int(f), "late", None, True))
                continue
            part = part.drop_duplicates("node").sort_values("node")
            now, own = part[["x", "y", "z"]].to_numpy(float), [int(n) for n in part["node"]]
            if f == newest and run.nodes != own:
                run.waits, run.waiting, run.places = int(f), own, now
            else:
                scored(int(f), own, now)
        state.update(run.state())
        if delay is not None:
            state.setTimeoutTimestamp(int(max(seen + (idle_ms or 0), state.getCurrentWatermarkMs())) + 1)
        elif idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(rows, columns=["sim", "frame", "detector", "score", "late"])

    timeout = GroupStateTimeout.EventTimeTimeout if delay is not None else GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    timed = stream if delay is None else stream.withWatermark("ts", delay)
    timed = timed.withColumn("seen", F.unix_millis("ts") if "ts" in stream.columns else F.lit(0).cast("bigint"))
    return timed.groupBy("sim").applyInPandasWithState(step, OUT, STATE, "append", timeout)


def first_alarms(scores: DataFrame, thresholds: DataFrame, time: str = "ts") -> DataFrame:
    """The first alarm of each (sim, detector), once for good: the earliest by time of the micro-batch that brings the first.
    thresholds: a static table (detector, threshold)."""
    over = scores.join(thresholds, "detector").where(F.col("score") > F.col("threshold")).drop("threshold")
    columns = over.columns

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        if not state.exists:
            state.update((True,))
            yield rows.sort_values(time).head(1)[columns]

    return over.groupBy("sim", "detector").applyInPandasWithState(step, over.schema, "raised boolean", "append", GroupStateTimeout.NoTimeout)


def running_maxima(scores: DataFrame) -> DataFrame:
    """(sim, detector, run_max, frames) so far, for update or complete mode."""
    return scores.groupBy("sim", "detector").agg(F.max("score").alias("run_max"), F.count(F.lit(1)).alias("frames"))
