"""Windows over the bars of many series at once, only where they are asked for.

A sliding window of Spark goes through its frame anew for each bar, row by row. Here
series lie end to end, and one numpy operation moves all asked bars by one bar of
their frames. Sums and deviations take a frame's bars from the oldest on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

#: Bars that a task holds together, at least; a longer series is held whole.
TOGETHER = 65_536
#: Frames that a median sorts together.
SORTED = 16_384


class Bars:
    """Columns of several series end to end, nan where a value is missing; at are the asked rows, bar their numbers from 1."""

    def __init__(self, columns: dict[str, np.ndarray], begin: np.ndarray, at: np.ndarray | None = None):
        self.columns, self.begin = columns, begin
        self.at = np.arange(len(begin)) if at is None else at
        self.bar = self.at - begin[self.at] + 1

    def asked(self, at: np.ndarray) -> Bars:
        return Bars(self.columns, self.begin, at)

    def now(self, name: str) -> np.ndarray:
        return self.columns[name][self.at]

    def lag(self, name: str, bars: int) -> np.ndarray:
        """The value so many bars ago, nan before the first."""
        return np.where(self.bar > bars, self.columns[name][np.maximum(self.at - bars, 0)], np.nan)

    def frame(self, name: str, first: int, last: int = 0) -> Iterator[np.ndarray]:
        for age in range(first, last - 1, -1):
            yield self.lag(name, age)

    def total(self, name: str, first: int, last: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(sum, number) of the present values from first to last bars ago; the sum of none is nan."""
        out, n = np.zeros(len(self.at)), np.zeros(len(self.at))
        for x in self.frame(name, first, last):
            there = ~np.isnan(x)
            out, n = out + np.where(there, x, 0.0), n + there
        return np.where(n > 0, out, np.nan), n

    def mean(self, name: str, first: int, last: int = 0) -> np.ndarray:
        out, n = self.total(name, first, last)
        return divided(out, n)

    def deviation(self, name: str, first: int, last: int = 0) -> np.ndarray:
        """Population deviation of the present values, by updates of mean and squares."""
        n, mean, squares = (np.zeros(len(self.at)) for _ in range(3))
        for x in self.frame(name, first, last):
            there = ~np.isnan(x)
            n = n + there
            off = np.where(there, x - mean, 0.0)
            step = off / np.maximum(n, 1.0)
            mean, squares = mean + step, squares + off * (off - step)
        return np.sqrt(divided(squares, n))

    def top(self, name: str, first: int, last: int = 0) -> np.ndarray:
        out = np.full(len(self.at), np.nan)
        for x in self.frame(name, first, last):
            out = np.fmax(out, x)
        return out

    def median(self, name: str, window: int, least: int) -> np.ndarray:
        out = np.full(len(self.at), np.nan)
        for i in range(0, len(self.at), SORTED):
            v = np.sort(np.stack(list(self.asked(self.at[i : i + SORTED]).frame(name, window - 1)), axis=1), axis=1)  # nan last
            n = (~np.isnan(v)).sum(axis=1)
            half = np.maximum(n - 1, 0) * 0.5
            low, high = (v[np.arange(len(v)), f(half).astype(int)] for f in (np.floor, np.ceil))
            between = (np.ceil(half) - half) * low + (half - np.floor(half)) * high
            out[i : i + SORTED] = np.where(n >= least, np.where(low == high, low, between), np.nan)
        return out

    def least_so_far(self, name: str) -> np.ndarray:
        """The least present value of the series up to each of its bars; all bars are asked."""
        v, edges = self.columns[name], np.flatnonzero(np.r_[self.begin[1:] != self.begin[:-1], True]) + 1
        return np.concatenate([np.fmin.accumulate(part) for part in np.split(v, edges[:-1])]) if len(v) else v

    def grid(self, name: str) -> np.ndarray:
        """A (bars, series) grid, nan after a series' end; all bars are asked."""
        return self._on_grid(self.columns[name])

    def _places(self) -> tuple[np.ndarray, np.ndarray]:
        return self.bar - 1, np.cumsum(self.bar == 1) - 1

    def _on_grid(self, v: np.ndarray) -> np.ndarray:
        row, series = self._places()
        out = np.full((row.max() + 1, series[-1] + 1), np.nan)
        out[row, series] = v
        return out

    def off_grid(self, cells: np.ndarray) -> np.ndarray:
        return cells[self._places()]


def divided(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, nan where b is 0 or either is missing."""
    return np.divide(a, b, out=np.full(np.shape(a), np.nan), where=b != 0)


def _begin(ticker: pa.ChunkedArray) -> np.ndarray:
    """Of each row the first one of its series."""
    t, n = ticker.combine_chunks(), len(ticker)
    differs = pc.not_equal(t.slice(1), t.slice(0, n - 1)).fill_null(True).to_numpy(zero_copy_only=False)
    missing = t.is_null().to_numpy(zero_copy_only=False)
    new = np.r_[True, differs & ~(missing[1:] & missing[:-1])]
    return np.flatnonzero(new)[np.cumsum(new) - 1]


def over_bars(rows: DataFrame, inputs: list[str], made: list[str], fold: Callable[[Bars, Bars], dict[str, np.ndarray]], asked: str | None = None) -> DataFrame:
    """rows(ticker, trade_date, ...) with the columns made, doubles, that fold(all bars, asked bars) gives for the asked ones.

    asked is a boolean column, dropped: only the rows where it is true come out. All of them are read.
    """
    kept = [f for f in rows.schema.fields if f.name != asked]

    def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
        columns = {c: pc.fill_null(table[c].cast(pa.float64()), np.nan).to_numpy() for c in inputs}
        every = Bars(columns, _begin(table["ticker"]))
        at = every.at if asked is None else np.flatnonzero(pc.fill_null(table[asked], False).to_numpy())
        with np.errstate(divide="ignore", invalid="ignore"):
            found = fold(every, every.asked(at))
        shown = table.select([f.name for f in kept])
        shown = shown if asked is None else shown.take(pa.array(at))
        out = pa.table([*shown.columns, *(pa.array(found[c], mask=np.isnan(found[c])) for c in made)], names=[*(f.name for f in kept), *made])
        yield from out.to_batches(max_chunksize=10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, most = [], 0, TOGETHER
        for batch in batches:  # sorted by ticker: only the last series may go on
            held.append(batch)
            size += batch.num_rows
            if size >= most:
                table = pa.Table.from_batches(held)
                whole = int(_begin(table["ticker"])[-1])
                if whole:
                    yield from done(table.slice(0, whole))
                held, size = table.slice(whole).to_batches(), size - whole
                most = max(TOGETHER, 2 * size)
        if size:
            yield from done(pa.Table.from_batches(held))

    return rows.repartition("ticker").sortWithinPartitions("ticker", "trade_date").mapInArrow(run, StructType([*kept, *(StructField(c, DoubleType()) for c in made)]))
