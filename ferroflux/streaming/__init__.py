"""Live statistics over streams: parsed records, bounded state, ranges with hysteresis.

A micro-batch reaches a state function in shuffle order, so every stateful
operator sorts by ``seq`` within its key first.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ingest import accepted, long_form, parse, scaled
from ..schema import AXES, RETAIN, STRIDE, WINDOW


def live_records(lines: DataFrame, sensor: int | None = None) -> DataFrame:
    """Accepted records of a stream of lines, a row per sensor and axis."""
    return long_form(accepted(parse(lines, sensor)))


def retain(rows: DataFrame, key: str = "session", cap: int = RETAIN) -> DataFrame:
    """(key, n, first_seq, last_seq, total) of the at most ``cap`` latest rows that each key holds, after each batch.

    ``rows`` has key, seq, v. Rows lie in a ring of ``cap`` places: a batch writes as many
    places as it has rows, whatever the state holds. Within a batch rows come in
    order of seq, batches in order of arrival. Needs the RocksDB state store.
    """
    schema = f"{key} string, n long, first_seq long, last_seq long, total double"
    return rows.groupBy(key).transformWithStateInPandas(Ring(key, cap), schema, "Update", "none")


class Ring(StatefulProcessor):
    """The latest rows of a key: how many came, their total, and a place for each of the last ``cap``."""

    def __init__(self, key: str, cap: int) -> None:
        self.key, self.cap = key, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "came long, total double")
        self.ring = handle.getMapState("ring", "place long", "seq long, v double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        came, total = self.sums.get() if self.sums.exists() else (0, 0.0)
        new = pd.concat(list(rows)).sort_values("seq")
        for seq, v in zip(new["seq"].tolist(), new["v"].tolist()):
            place = (came % self.cap,)
            if came >= self.cap:
                total -= self.ring.getValue(place)[1]
            self.ring.updateValue(place, (seq, v))
            came, total = came + 1, total + v
        self.sums.update((came, total))
        n = min(came, self.cap)
        ends = [self.ring.getValue((i % self.cap,))[0] for i in (came - n, came - 1)]
        yield pd.DataFrame({self.key: [key[0]], "n": [n], "first_seq": [ends[0]], "last_seq": [ends[1]], "total": [float(total)]})

    def close(self) -> None:
        pass


def stream_windows(rows: DataFrame, size: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """(session, win_start, vs): count windows of a stream (session, seq, v), seq counting from 0 without gaps.

    A window comes out once a row beyond its end is there, as in the batch
    operator; the state holds fewer than size + stride rows and what came early.
    """

    def cut(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, seq, v = state.get if state.exists else (0, [], [])
        new = pd.concat(list(frames))
        held = dict(zip(list(seq) + new["seq"].tolist(), list(v) + new["v"].tolist()))
        out = []
        while all(i in held for i in range(start, start + size + 1)):
            out.append((k[0], start, [held[i] for i in range(start, start + size)]))
            start += stride
            held = {i: x for i, x in held.items() if i >= start}
        state.update((start, list(held), list(held.values())))
        yield pd.DataFrame(out, columns=["session", "win_start", "vs"])

    return rows.groupBy("session").applyInPandasWithState(cut, "session string, win_start long, vs array<double>", "start long, seq array<long>, v array<double>", "append", GroupStateTimeout.NoTimeout)


def fold_range(current: tuple[float, float], wanted: list[tuple[float, float, float, float]]) -> tuple[float, float]:
    """The axis range after the sensors' wishes (ymin, ymax, spread, pad) in turn.

    It changes only if a wish lies outside it or it is over three times as wide as needed.
    """
    low, high = current
    for ymin, ymax, spread, pad in wanted:
        if ymin < low or ymax > high or high - low > 3 * (spread + 2 * pad):
            low, high = ymin, ymax
    return low, high


def wish(points: np.ndarray, calibration: bool = False) -> tuple[float, float, float, float] | None:
    """(ymin, ymax, spread, pad) that the latest points (rows of X, Y, Z) of a sensor ask for; None if they ask for nothing."""
    if len(points) <= 5:
        return None
    v = points.ravel()
    kept = v[np.abs(v - v.mean()) < 3 * v.std()]
    if not len(kept):
        return None
    outer, inner = (300.0, 50.0) if calibration else (150.0, 20.0)
    low, high = float(kept.min()), float(kept.max())
    pad = max(20.0, 0.2 * (high - low))
    return max(-outer, min(-inner, low - pad)), min(outer, max(inner, high + pad)), high - low, pad


class LiveRange(StatefulProcessor):
    """The latest records of a session in a ring, and the axis range folded over its sensors batch by batch."""

    def __init__(self, calibration: bool, last: int) -> None:
        self.calibration, self.last = calibration, last

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.range = handle.getValueState("range", "came long, low double, high double")
        self.ring = handle.getMapState("ring", "place long", "values array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        first = 300.0 if self.calibration else 150.0
        came, low, high = self.range.get() if self.range.exists() else (0, -first, first)
        new = pd.concat(list(rows)).sort_values("seq")
        # Of a batch longer than the ring only its end is left in it.
        for k, values in enumerate(new["flat"].tolist()[-self.last :], start=came + max(0, len(new) - self.last)):
            self.ring.updateValue((k % self.last,), ([float(x) for x in values],))
        came += len(new)
        held = np.array([list(v[0]) for v in self.ring.values()]).reshape(min(came, self.last), -1, 3)
        wishes = [w for w in (wish(held[:, s], self.calibration) for s in range(held.shape[1])) if w]
        low, high = fold_range((low, high), wishes)
        self.range.update((came, low, high))
        yield pd.DataFrame({"session": [key[0]], "records": [came], "last_seq": [int(new["seq"].iloc[-1])], "ymin": [low], "ymax": [high]})

    def close(self) -> None:
        pass


def live_range(lines: DataFrame, sensor: int | None = None, calibration: bool = False, last: int = 100) -> DataFrame:
    """(session, records, last_seq, ymin, ymax) after each batch of a stream of lines (session, seq, value).

    One stream from lines to the range that a live view shows: accepted records, the latest
    ``last`` of each session as state, a wish of each sensor, and the fold that holds on
    to the range. A batch writes a place of the ring for each of its records. Comments, blank
    and broken lines pass without effect. Needs the RocksDB state store.
    """
    rows = accepted(parse(lines, sensor))
    flat = F.flatten(F.transform("raw", lambda r: F.array(*[scaled(r[a]) for a in AXES])))
    schema = "session string, records long, last_seq long, ymin double, ymax double"
    return rows.select("session", "seq", flat.alias("flat")).groupBy("session").transformWithStateInPandas(LiveRange(calibration, last), schema, "Update", "none")


def start(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, every: str = "50 milliseconds", mode: str = "update"):
    """Start a query that hands each micro-batch to ``each``."""
    return stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def run_for(query, duration: float = 0) -> None:
    """Wait ``duration`` seconds, or without limit if 0, then stop."""
    query.awaitTermination(duration) if duration else query.awaitTermination()
    query.stop()


def within(records: DataFrame, duration: float = 0) -> DataFrame:
    """Replayed records up to ``duration`` seconds; 0 keeps all."""
    return records.filter(F.col("t_s") <= duration) if duration else records


def banner(elapsed, duration: int = 0):
    """ "12s" or "12/60s"."""
    whole = F.floor(elapsed).cast("long").cast("string")
    return F.concat(whole, F.lit(f"/{duration}s" if duration else "s"))


def received(lines: DataFrame, by: str = "session") -> DataFrame:
    """(by, lines, received, message): whether any line but comments and blanks came in, valid or not, and what a live view says."""
    text = F.trim("value")
    data = (text != "") & ~F.startswith(text, F.lit("#"))
    out = lines.groupBy(by).agg(F.count_if(data).alias("lines"))
    out = out.withColumn("received", F.col("lines") > 0)
    return out.withColumn("message", F.when(F.col("received"), F.lit("receiving data")).otherwise(F.lit("waiting for data")))


def poll_interval(points: int, interval_ms: int = 50, slow_ms: int = 500, many: int = 300) -> str:
    """The trigger interval for a live view of so many points: beyond ``many`` of them it backs off."""
    return f"{slow_ms if points > many else interval_ms} milliseconds"


class LiveQuery:
    """A live view whose poll backs off, once, when it shows many points.

    A query's trigger is fixed when it starts. ``each`` gets every micro-batch and returns the
    number of points now shown; when ``poll_interval`` tells another interval for that, the query
    is stopped after its batch and goes on from its checkpoint, so no batch is lost or repeated.
    """

    def __init__(self, stream: Callable[[], DataFrame], each: Callable[[DataFrame, int], int], checkpoint: str, mode: str = "update") -> None:
        self.stream, self.each, self.checkpoint, self.mode = stream, each, checkpoint, mode
        self.points, self.intervals = 0, []
        self._go()

    def _batch(self, rows: DataFrame, number: int) -> None:
        self.points = max(self.points, self.each(rows, number) or 0)

    def _go(self) -> None:
        self.intervals.append(poll_interval(self.points))
        self.query = start(self.stream(), self._batch, self.checkpoint, self.intervals[-1], self.mode)

    def run(self, duration: float = 0, step: float = 0.2) -> None:
        """Until ``duration`` seconds are over (0: until the query ends), then stop. A failed query raises."""
        end = time.monotonic() + duration
        while not duration or time.monotonic() < end:
            if self.query.awaitTermination(step):
                return
            if poll_interval(self.points) != self.intervals[-1] and not self.query.status["isTriggerActive"]:
                self.query.stop()
                self._go()
        self.query.stop()
