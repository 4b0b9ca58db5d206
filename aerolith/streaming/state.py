"""The last rows of each key, exactly, on a stream that isn't in order: keyed state with timers."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from aerolith.operators import sequences

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROW = "ts timestamp, event_id long, value double"
OUT = "station long, ts timestamp, event_id long, value double, recent_mean double, trend double"


class LastRows(StatefulProcessor):
    """Holds a row back until the watermark has passed it, so that all rows before it are known; then it and the k rows before it make its values."""

    def __init__(self, k: int, horizon: int, clip: float):
        self.k, self.horizon, self.clip = k, horizon, clip

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ROW)
        self.last = handle.getListState("last", ROW)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        for batch in rows:
            new = [(t.to_pydatetime(), int(i), None if pd.isna(v) else float(v)) for t, i, v in zip(batch["ts"], batch["event_id"], batch["value"], strict=True)]
            new = [r for r in new if millis(r[0]) > mark]  # a row that the watermark has passed comes too late
            for r in new:
                self.waiting.appendValue(r)
                self.handle.registerTimer(millis(r[0]))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        held = sorted(self.waiting.get(), key=lambda r: (r[0], r[1]))
        due, rest = [r for r in held if millis(r[0]) <= until], [r for r in held if millis(r[0]) > until]
        if not due:
            return
        last, out = [tuple(r) for r in self.last.get()], []
        for t, i, v in map(tuple, due):
            last = [*last, (t, i, v)][-(self.k + 1) :]
            known = [x for _, _, x in last[-self.k :] if x is not None]
            first = last[0][2] if len(last) > self.k else None
            slope = None if first is None or v is None else max(-self.clip, min(self.clip, (v - first) / self.k))
            out.append((key[0], t, i, v, math.fsum(known) / len(known) if known else None, None if slope is None else v + self.horizon * slope))
        self.last.put(last)
        self.waiting.put(rest) if rest else self.waiting.clear()
        yield pd.DataFrame(out, columns=["station", "ts", "event_id", "value", "recent_mean", "trend"])

    def close(self) -> None:
        pass


def millis(t) -> int:
    """Of a session in UTC; rounded up, so that a timer never fires before its row's time has passed."""
    return math.ceil(pd.Timestamp(t, tz="UTC").value / 1e6) if pd.Timestamp(t).tzinfo is None else math.ceil(pd.Timestamp(t).value / 1e6)


def last_rows(df: DataFrame, k: int, horizon: int = 1, clip: float = 1.0, late: str = "1 day") -> DataFrame:
    """station, ts, event_id, value, recent_mean (of the last k rows, its own included) and trend (the value moved on by the clipped slope over k rows).

    df: station, ts, event_id, value. On a batch these are windows. On a stream each station's state holds k + 1 rows and
    those that the watermark hasn't passed; rows come out once, in order of (ts, event_id), when it has, and rows later
    than late are dropped. A restart goes on from the checkpoint. Streams need RocksDB as state store, and UTC sessions.
    """
    if not df.isStreaming:
        rows = sequences.forecasts(df, ["station"], ["ts", "event_id"], "value", k, horizon, clip)
        return rows.select("station", "ts", "event_id", "value", "recent_mean", "trend")
    spark = df.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKSDB:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")
    rows = df.selectExpr("CAST(station AS long) AS station", "ts", "CAST(event_id AS long) AS event_id", "CAST(value AS double) AS value").withWatermark("ts", late)
    return rows.groupBy("station").transformWithStateInPandas(LastRows(k, horizon, clip), OUT, "Append", "EventTime")
