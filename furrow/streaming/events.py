"""Event-time windows and the recursive forecast as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def with_event_time(events: DataFrame, column: str = "ts", delay: str = "1 hour") -> DataFrame:
    """A watermark needs a timestamp with time zone semantics, so the column is cast."""
    return events.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def window_counts(events: DataFrame, *, column: str = "ts", width: str = "1 day", slide: str | None = None, by: tuple[str, ...] = (), value: str = "value") -> DataFrame:
    w = F.window(column, width, slide) if slide else F.window(column, width)
    return events.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, *, column: str = "ts", gap: str = "30 minutes", by: str = "user_id") -> DataFrame:
    return events.groupBy(F.session_window(column, gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def recursive_lag_stream(rows: DataFrame, *, region: str = "region", year: str = "year", y: str = "y", weight: float = 1.0, fallback: float = 0.0) -> DataFrame:
    """Per region, in order of year: an observed y becomes the state, a row without y is predicted from it.

    The state is the last value only, so it never grows. Years of a region must arrive in order between
    batches; within a batch they are sorted.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(year)
        out = []
        for t, v in zip(rows[year], rows[y]):
            if pd.isna(v):
                v = max(0.0, weight * (fallback if last is None else last))
                out.append((key[0], int(t), float(v)))
            last = float(v)
        state.update((last,))
        yield pd.DataFrame(out, columns=[region, year, "y_pred"])

    kind = rows.schema[region].dataType.simpleString()
    return rows.groupBy(region).applyInPandasWithState(step, f"{region} {kind}, {year} int, y_pred double", "last double", "append", GroupStateTimeout.NoTimeout)


class _Spells(StatefulProcessor):
    """Keeps a key's open spells; each ends by a timer once ``gap_ms`` of event time have passed without another event."""

    def __init__(self, by: str, column: str, value: str, gap_ms: int):
        self.by, self.column, self.value, self.gap = by, column, value, gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "first long, last long, n long, total double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        spells = list(self.open.get()) if self.open.exists() else []
        for s in spells:
            self.handle.deleteTimer(s[1] + self.gap)
        for pdf in rows:
            ms = pdf[self.column].astype("datetime64[ms]").astype("int64")
            spells += [(t, t, 1, v) for t, v in zip(ms.tolist(), pdf[self.value].astype(float).tolist())]
        merged: list[tuple] = []
        for s in sorted(spells):
            if merged and s[0] < merged[-1][1] + self.gap:
                first, last, n, total = merged[-1]
                merged[-1] = (first, max(last, s[1]), n + s[2], total + s[3])
            else:
                merged.append(tuple(s))
        self.open.put(merged)
        for s in merged:
            self.handle.registerTimer(s[1] + self.gap)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, spells = expiredTimerInfo.getExpiryTimeInMs(), list(self.open.get())
        ended, rest = [s for s in spells if s[1] + self.gap <= at], [tuple(s) for s in spells if s[1] + self.gap > at]
        if rest:
            self.open.put(rest)
        else:
            self.open.clear()
        time = lambda k: [pd.Timestamp(s[k], unit="ms") for s in ended]
        yield pd.DataFrame({self.by: [key[0]] * len(ended), "start": time(0), "end": time(1), "n": [s[2] for s in ended], "total": [s[3] for s in ended]})

    def close(self) -> None:
        pass


def spells(events: DataFrame, *, column: str = "ts", by: str = "user_id", value: str = "value", gap_minutes: int = 30) -> DataFrame:
    """(by, start, end, n, total): a row when a key has been silent for ``gap_minutes`` of event time, by a timer of its state.

    ``events`` has a watermark. State is four numbers per open spell and goes when its row is emitted. An event behind the watermark is dropped before it gets here and
    counted by :func:`late_rows`. Needs the RocksDB state store.
    """
    kind = events.schema[by].dataType.simpleString()
    return events.select(by, column, value).groupBy(by).transformWithStateInPandas(_Spells(by, column, value, 60_000 * gap_minutes), f"{by} {kind}, start timestamp, end timestamp, n long, total double", "Append", "EventTime")


def late_rows(query) -> int:
    """Rows that a streaming query's stateful steps have dropped behind the watermark so far (as far as its progress is kept)."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
