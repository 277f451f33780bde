"""Trading sessions of a tick stream: what a session has seen is state of its ticker, and is gone when the market closes.

A session is a ticker on a trading day. Its state (counts, the last price, and
which anomalies it has told already) begins with its first tick inside market
hours. An event-time timer at the close tells the session's summary and clears
the state, so the next day starts anew and nothing grows from day to day. After a
restart the state comes back from the checkpoint.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from panelforge.operators.ops import anomaly

# Fixed values.
ZONE, OPENS, CLOSES = "Asia/Seoul", "09:00", "15:30"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SESSION = "day date, closes timestamp, ticks long, found long, last double, last_ts timestamp"
EVENTS = "ticker long, day date, kind string, trigger string, ts timestamp, price double, ticks long, found long"


def in_session(ticks: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """ticks(ts, ...) inside market hours of a trading day, with day and closes.

    calendar(date, open) says which days trade; of days that it doesn't have, and
    without it, Saturdays and Sundays don't. It has a row for each day.
    """
    local = F.from_utc_timestamp("ts", ZONE)
    clock = F.date_format(local, "HH:mm")
    rows = ticks.withColumn("day", F.to_date(local)).filter((clock >= OPENS) & (clock < CLOSES))
    usual = F.weekday("day") < 5
    if calendar is None:
        rows = rows.filter(usual)
    else:
        rows = rows.join(F.broadcast(calendar.select(F.col("date").alias("day"), "open")), "day", "left").filter(F.coalesce("open", usual)).drop("open")
    hours, minutes = map(int, CLOSES.split(":"))
    closes = F.to_utc_timestamp(F.col("day").cast("timestamp") + F.expr(f"INTERVAL {60 * hours + minutes} MINUTES"), ZONE)
    return rows.withColumn("closes", closes)


class Session(StatefulProcessor):
    """Events of a ticker's sessions: each anomaly once for its trigger and minute, and the summary at the close."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", SESSION)
        self.told = handle.getMapState("told", "key string", "ts timestamp")

    def _closed(self, ticker: int) -> tuple:
        day, _, ticks, found, last, last_ts = self.session.get()
        self.session.clear()
        self.told.clear()
        return ticker, day, "closed", None, last_ts, last, ticks, found

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        (ticker,), out = key, []
        batch = pd.concat(rows).sort_values("ts")
        held = self.session.get() if self.session.exists() else None
        for r in batch.itertuples(index=False):
            if held is None or held[0] != r.day:
                if held is not None:  # the next day's ticks came before the timer of the close
                    self.session.update(held)
                    out.append(self._closed(ticker))
                held = (r.day, r.closes.to_pydatetime(), 0, 0, None, None)
                self.handle.registerTimer(int(r.closes.timestamp() * 1000))
            day, closes, ticks, found, _, _ = held
            if isinstance(r.trigger, str):
                name = f"{r.trigger}:{r.ts:%H:%M}"
                if not self.told.containsKey((name,)):
                    self.told.updateValue((name,), (r.ts.to_pydatetime(),))
                    found += 1
                    out.append((ticker, day, "anomaly", r.trigger, r.ts, r.price, ticks + 1, found))
            held = (day, closes, ticks + 1, found, float(r.price), r.ts.to_pydatetime())
        self.session.update(held)
        yield _frame(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        (ticker,) = key
        due = expiredTimerInfo.getExpiryTimeInMs()
        # The timer of a day that was closed by the next day's ticks finds another session, or none.
        held = self.session.get() if self.session.exists() else None
        yield _frame([self._closed(ticker)] if held is not None and _millis(held[1]) <= due else [])

    def close(self) -> None:
        pass


def _millis(t: datetime.datetime) -> int:
    return int(pd.Timestamp(t).timestamp() * 1000)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["ticker", "day", "kind", "trigger", "ts", "price", "ticks", "found"])
    return frame.astype({"ts": "datetime64[us]"})


def session_events(ticks: DataFrame, context: DataFrame, calendar: DataFrame | None = None, late: str = "1 minute") -> DataFrame:
    """Events of ticks(ticker, ts, price, volume) against the static context(ticker, reference, usual).

    ticker, day, kind (anomaly or closed), trigger, ts, price, ticks and found: of
    an anomaly its tick and the counts so far, of a close the last tick and the
    day's counts. Ticks out of hours, of days without trade, later than the
    watermark, or of tickers without context give none.
    """
    ticks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)  # the only store for such state
    trigger = anomaly(F.col("price"), F.col("reference"), F.col("volume"), F.col("usual"))
    rows = in_session(ticks.withWatermark("ts", late), calendar).join(context, "ticker").select(F.col("ticker").cast("long").alias("ticker"), "ts", "price", "day", "closes", trigger.alias("trigger"))
    return rows.groupBy("ticker").transformWithStateInPandas(statefulProcessor=Session(), outputStructType=EVENTS, outputMode="Append", timeMode="EventTime")
