"""Deduplicated alerts as a stream: the state of each (hotspot_id, severity) is what is left of its alerts so far.

Alerts count in the order of their time and `seq`, not of their arrival: those at or after the watermark are held, and folded into the
settled state once the watermark has passed them; each update shows the fold of both. So the last update of a key equals the batch fold
(`operators.alerts.deduplicated`) whatever way the rows are cut into micro-batches, as long as none is later than `lateness`; later ones
are dropped. With `idle`, a key without alerts for so long ends: a timer gives a last row with `closed` and lets the state go; an alert
after that begins anew. State lies in the state store, so that a restarted query goes on where it was.

Cases: an unknown risk is below all others, an unknown acknowledgement is none; rows without time are dropped (they have no place in
the order); equal times go by seq; repeated rows change nothing.

Of the held alerts only those stay in the state, and are read back, that the fold can still come to (`needed`): a few, however many arrive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

ALERT = "id string, risk_score double, is_acknowledged boolean, at_us long, seq long"
OUT = "hotspot_id string, severity string, id string, risk_score double, is_acknowledged boolean, at_us long, seq long, closed boolean"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Alert = tuple  # id, risk, acknowledged, time in microseconds, seq


def folded(now: Alert | None, later: list[Alert]) -> Alert | None:
    """The state after some later alerts, in order."""
    for new in later:
        if now is None or (new[2] and not now[2]):
            now = new
        elif new[1] > now[1]:
            now = (new[0], new[1], now[2] or new[2], *new[3:])
    return now


FIELDS = [f.split()[0] for f in ALERT.split(", ")]


def needed(alerts: pd.DataFrame) -> pd.DataFrame:
    """Those of a key's held alerts (columns FIELDS) that its fold can still come to, whatever arrives later: the first acknowledged one and the gravest from it
    on; of those before it such as no later one exceeds, since an acknowledged one may yet come in between."""
    rows = alerts.sort_values(["at_us", "seq", "id"], kind="stable", ignore_index=True)
    if len(rows) < 2:
        return rows
    risk, known = rows.risk_score.to_numpy(), rows.is_acknowledged.to_numpy(dtype=bool)
    first = int(known.argmax()) if known.any() else len(rows)
    keep = risk >= np.maximum.accumulate(risk[::-1])[::-1]
    keep[first:] = False
    if first < len(rows):
        keep[[first, first + int(risk[first:].argmax())]] = True
    return rows[keep]


class AlertState(StatefulProcessor):
    """settled: the fold up to the watermark; held: alerts not yet passed by it, as far as they are `needed`."""

    def __init__(self, idle_ms: int | None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", ALERT)
        self.held = handle.getListState("held", ALERT)
        self.newest = handle.getValueState("newest", "at_us long")

    def _settle(self, held: list[Alert], watermark_ms: int, latest: int | None = None) -> Alert | None:
        """latest: the time of the newest alert, held or not. Folds what the watermark has passed; returns the fold of everything. Sets the timer for the next to settle, or for the end."""
        held.sort(key=lambda a: (a[3], a[4], a[0]))
        passed = [a for a in held if a[3] < watermark_ms * 1000]
        rest = held[len(passed) :]
        now = tuple(self.settled.get()) if self.settled.exists() else None
        now = folded(now, passed)
        if now is not None and passed:
            self.settled.update(now)
        if rest:
            self.held.put(rest)
        else:
            self.held.clear()
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        known = [latest] if latest is not None else []
        newest = max([a[3] for a in held] + known + ([self.newest.get()[0]] if self.newest.exists() else []), default=None)
        if newest is not None:
            self.newest.update((newest,))
        if rest:
            self.handle.registerTimer(rest[0][3] // 1000 + 1)
        elif self.idle_ms is not None and newest is not None:
            self.handle.registerTimer(newest // 1000 + self.idle_ms)
        return folded(now, rest)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        held = [tuple(a) for a in self.held.get()] if self.held.exists() else []
        latest = None
        for frame in rows:
            new = frame.loc[frame.at_us >= watermark * 1000, FIELDS]
            if new.empty:
                continue
            latest = max(latest or 0, int(new.at_us.max()))
            new = new.assign(risk_score=new.risk_score.astype(float).fillna(float("-inf")), is_acknowledged=new.is_acknowledged.astype(bool))
            few = needed(pd.concat([pd.DataFrame(held, columns=FIELDS), needed(new)]) if held else new)
            held = [(None if pd.isna(i) else i, float(r), bool(a), int(t), int(s)) for i, r, a, t, s in few.itertuples(index=False)]
        now = self._settle(held, watermark, latest)
        if now is not None:
            yield self._row(key, now, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [tuple(a) for a in self.held.get()] if self.held.exists() else []
        watermark = timerValues.getCurrentWatermarkInMs()
        now = self._settle(held, watermark)
        if self.idle_ms is not None and now is not None and watermark >= self.newest.get()[0] // 1000 + self.idle_ms:
            for state in (self.settled, self.held, self.newest):
                state.clear()
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            yield self._row(key, now, True)

    def _row(self, key: tuple, now: Alert, closed: bool) -> pd.DataFrame:
        risk = None if now[1] == float("-inf") else now[1]
        return pd.DataFrame([(*key, now[0], risk, now[2], now[3], now[4], closed)], columns=[f.split()[0] for f in OUT.split(", ")])

    def close(self) -> None:
        pass


def alert_state(alerts: DataFrame, time: str = "at", lateness: str = "2 days", idle_ms: int | None = None) -> DataFrame:
    """Updates of deduplicated alerts. alerts: a stream with hotspot_id, severity, id, risk_score, is_acknowledged, seq and an event time.
    The session must keep its streaming state in RocksDB (STORE)."""
    at_us = F.unix_micros(F.col(time)).alias("at_us")
    rows = alerts.where(F.col(time).isNotNull()).withWatermark(time, lateness)
    rows = rows.select("hotspot_id", "severity", "id", F.col("risk_score").cast("double").alias("risk_score"), F.coalesce("is_acknowledged", F.lit(False)).alias("is_acknowledged"), at_us, F.col("seq").cast("long").alias("seq"), time)
    return rows.groupBy("hotspot_id", "severity").transformWithStateInPandas(AlertState(idle_ms), StructType.fromDDL(OUT), "Update", "EventTime")
