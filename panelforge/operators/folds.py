"""Recursions over the bars of many series at once.

A recursion needs a series' own past, not other series: series are dealt by
ticker, sorted, and stepped together, some hundred in one numpy operation for
each bar. A task holds that many series at a time, not its whole share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

#: Series that one step moves together.
TOGETHER = 256

Grid = dict[str, np.ndarray]


def stepped(series: list[pd.DataFrame], inputs: list[str], fold: Callable[[Grid], Grid]) -> pd.DataFrame:
    """The rows of several series, each sorted by date, with the columns that fold makes of (bars, series) grids of the inputs; nan after a series' end."""
    sizes = [len(s) for s in series]
    grid = {c: np.full((max(sizes), len(series)), np.nan) for c in inputs}
    for k, s in enumerate(series):
        for c, cells in grid.items():
            cells[: len(s), k] = s[c].to_numpy(float)
    made = fold(grid)
    return pd.concat(series).assign(**{name: np.concatenate([cells[:size, k] for k, size in enumerate(sizes)]) for name, cells in made.items()})


def fold_series(rows: DataFrame, inputs: list[str], kept: list[str], made: list[str], fold: Callable[[Grid], Grid]) -> DataFrame:
    """ticker, trade_date, the kept columns as they are and those made by fold, doubles, for each row that has a ticker; missing values are nan for fold and null after it."""
    names = ["ticker", "trade_date", *kept]
    columns = list(dict.fromkeys([*names, *inputs]))

    def done(table: pa.Table, begin: np.ndarray) -> Iterator[pa.RecordBatch]:
        given = table.select(inputs).to_pandas()
        out = stepped([given.iloc[a:b] for a, b in zip(begin, [*begin[1:], len(given)])], inputs, fold)
        values = {c: out[c].to_numpy(float) for c in made}
        shown = [*table.select(names).columns, *(pa.array(v, mask=np.isnan(v)) for v in values.values())]
        yield from pa.table(shown, names=[*names, *made]).to_batches(max_chunksize=10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, series, last = [], 0, None  # series: those that begin in what is held
        for batch in batches:  # sorted by ticker: only the last series of a batch may go on
            part = pa.Table.from_batches([batch.filter(batch["ticker"].is_valid())])
            if not part.num_rows:
                continue
            new = _begins(part["ticker"])
            new = new[1:] if part["ticker"][0] == last else new
            last = part["ticker"][-1]
            held.append(part)
            series += len(new)
            if series > TOGETHER:
                table = pa.concat_tables(held)
                begin = _begins(table["ticker"])
                while len(begin) > TOGETHER:
                    yield from done(table.slice(0, begin[TOGETHER]), begin[:TOGETHER])
                    table, begin = table.slice(begin[TOGETHER]), begin[TOGETHER:] - begin[TOGETHER]
                held, series = [table], len(begin)
        if held:
            table = pa.concat_tables(held)
            yield from done(table, _begins(table["ticker"]))

    schema = StructType([*rows.select(*names).schema.fields, *(StructField(c, DoubleType()) for c in made)])
    return rows.select(*columns).repartition("ticker").sortWithinPartitions("ticker", "trade_date").mapInArrow(run, schema)


def _begins(ticker: pa.ChunkedArray) -> np.ndarray:
    """The first row of each series; each row has a ticker."""
    t = ticker.combine_chunks()
    return np.flatnonzero(np.r_[True, pc.not_equal(t.slice(1), t.slice(0, len(t) - 1)).to_numpy(zero_copy_only=False)])


def _smoothed(values: np.ndarray, first: int, n: int, weight: float) -> np.ndarray:
    """Means of n values from row first, then each value weighing in by weight; nan before the seed."""
    out = np.full(values.shape, np.nan)
    if len(values) >= first + n:
        out[first + n - 1] = values[first : first + n].sum(axis=0) / n
        for t in range(first + n, len(values)):
            out[t] = out[t - 1] + weight * (values[t] - out[t - 1])
    return out


def momentum(grid: Grid, rsi: int = 14, fast: int = 12, slow: int = 26, signal: int = 9) -> Grid:
    """rsi and macd of every bar of close: Wilder's strength, and the MACD line less its signal plus the bonus of a crossing.

    The bonus is (signal - age) / signal of the newest upward crossing at most
    signal - 1 bars ago, where both bars of it have a signal.
    """
    close = grid["close"]
    change = np.diff(close, axis=0, prepend=close[:1])
    up, down = (_smoothed(np.maximum(sign * change, 0.0), 1, rsi, 1.0 / rsi) for sign in (1, -1))
    with np.errstate(divide="ignore", invalid="ignore"):
        strength = np.where(down == 0, np.where(up == 0, 50.0, 100.0), 100 - 100 / (1 + up / down))
    line = _smoothed(close, 0, fast, 2.0 / (fast + 1)) - _smoothed(close, 0, slow, 2.0 / (slow + 1))
    mean = _smoothed(line, slow - 1, signal, 2.0 / (signal + 1))
    crossed = np.zeros(close.shape, bool)
    crossed[1:] = (line[:-1] <= mean[:-1]) & (line[1:] > mean[1:])
    bonus = np.zeros(close.shape)
    for age in range(signal):
        newest = np.roll(crossed, age, axis=0)
        newest[:age] = False
        bonus = np.maximum(bonus, newest * (signal - age) / signal)
    return {"rsi": np.where(np.isnan(up), np.nan, strength), "macd": line - mean + bonus}


def ema(grid: Grid, value: str, n: int) -> Grid:
    """ema of every bar: seeded with the mean of the first n values in a row; a missing value after the seed ends the series."""
    v = grid[value]
    out, run, level, seeded = np.full(v.shape, np.nan), np.zeros(v.shape[1], int), np.full(v.shape[1], np.nan), np.zeros(v.shape[1], bool)
    for t, x in enumerate(v):
        run = np.where(np.isnan(x), 0, run + 1)
        first = ~seeded & (run >= n)
        level = level + 2.0 / (n + 1) * (x - level)  # a missing value makes it nan for good
        if first.any():
            level = np.where(first, v[t - n + 1 : t + 1].sum(axis=0) / n, level)
            seeded |= first
        out[t] = np.where(seeded, level, np.nan)
    return {"ema": out}


def newest_rank(grid: Grid, value: str, window: int, least: int) -> Grid:
    """pct of every bar: the percentile of its value among the present ones of the window, ties averaged; nan with fewer than least."""
    v = grid[value]
    below, seen = np.zeros(v.shape), np.zeros(v.shape)
    for age in range(min(window, len(v))):
        then, now = v[: len(v) - age], v[age:]
        below[age:] += (then < now) + 0.5 * (then == now)
        seen[age:] += ~np.isnan(then)
    with np.errstate(invalid="ignore", divide="ignore"):
        return {"pct": np.where((seen >= least) & ~np.isnan(v), (below + 0.5) / seen * 100, np.nan)}
