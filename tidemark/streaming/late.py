"""Late corrections by ordered state and event-time timers, so that neither Arrow chunks nor micro-batches nor files change the outcome."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

HELD = "user_id long, event_type string, known long, value double, last long"
PENDING = "ts long, event_id long, user_id long, event_type string, known long, value double"
#: Users of neighbouring ids share a state, 2 ** SHARED of them: a call of the state store then serves many keys, and its rows stay few however many users there are.
SHARED = 6
OUT = "user_id long, event_id long, outcome string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def outcome(held: tuple | None, known: int, value: float) -> str:
    """What becomes of a value: inserted, skipped where it says what is held, corrected, or out_of_order where it was known no later than what is held."""
    if held is None:
        return "inserted"
    if abs(held[1] - value) < 1e-9:
        return "skipped"
    return "corrected" if known > held[0] else "out_of_order"


class Corrections(StatefulProcessor):
    """Holds rows until the watermark has passed their time, then counts them key by key (user and type) in order of time and event_id.

    State, of a few users together: the rows still open; by key the value held and the time of the last row counted. One timer stands at the
    earliest open row, or earlier, where a key without open rows is to be forgotten: horizon_ms after its last one counted.
    """

    def __init__(self, horizon_ms: int):
        self.horizon_ms = horizon_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", PENDING)
        self.held = handle.getListState("held", HELD)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        new = []
        for chunk in rows:
            kinds = [(int, "ts"), (int, "event_id"), (int, "user_id"), (lambda x: x, "event_type"), (int, "known"), (float, "value")]
            new += zip(*[map(f, chunk[c].tolist()) for f, c in kinds], strict=True)
        self.open.appendList(new)
        first, timers = min(r[0] for r in new) // 1000, list(self.handle.listTimers())
        if not timers or first < min(timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        closed = timerValues.getCurrentWatermarkInMs()
        rows = sorted((tuple(r) for r in self.open.get()), key=lambda r: r[:2])
        held = {(user, kind): (known, value, last) for user, kind, known, value, last in self.held.get()}
        due, later = [r for r in rows if r[0] // 1000 < closed], [r for r in rows if r[0] // 1000 >= closed]
        out = []
        for ts, event_id, user, kind, known, value in due:
            before = held.get((user, kind))
            what = outcome(before, known, value)
            held[user, kind] = (*((known, value) if what in ("inserted", "corrected") else before[:2]), ts)
            out.append((user, event_id, what))
        waiting = {r[2:4] for r in later}
        ends = {k: h[2] // 1000 + self.horizon_ms for k, h in held.items() if k not in waiting}
        held = {k: h for k, h in held.items() if ends.get(k, closed) >= closed}
        for state, kept in ((self.open, later), (self.held, [(*k, *h) for k, h in held.items()])):
            state.put(kept) if kept else state.clear()
        wake = [r[0] // 1000 for r in later[:1]] + [e for k, e in ends.items() if k in held]
        if wake:
            self.handle.registerTimer(min(wake))
        if out:
            yield pd.DataFrame(out, columns=["user_id", "event_id", "outcome"])

    def close(self) -> None:
        pass


def corrections(stream: DataFrame, horizon_days: int = 90) -> DataFrame:
    """(user_id, event_id, outcome) of a stream (user_id, event_type, event_id, ts, known, value) with a watermark on ts: what becomes of each value per user and type.

    A row counts once the watermark has passed its ts, in order of ts and event_id, however the rows came. Rows later than the watermark are dropped
    by it. A key silent for horizon_days is forgotten. Needs the RocksDB state store (run_to_end sets it).
    """
    micros = "unix_micros({})".format
    s = stream.selectExpr(f"shiftright(user_id, {SHARED}) AS users", "user_id", "event_type", "ts AS at", f"{micros('ts')} AS ts", "event_id", f"{micros('known')} AS known", "value")
    return s.groupBy("users").transformWithStateInPandas(Corrections(horizon_days * 86_400_000), OUT, "Append", "EventTime")
