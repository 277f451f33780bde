"""Ranks and quantiles of cross-sections: all columns of one in a single pass.

A window would sort a cross-section's whole rows anew for each rank and keep a
quantile's values as objects. Here its rows are dealt once and only numbers are sorted.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

#: What a cross-section's columns are for a pass: doubles with their presence, or numbers of the values of other types.
Section = dict[str, np.ma.MaskedArray]


def _column(values: pa.ChunkedArray) -> np.ma.MaskedArray:
    missing = values.is_null().to_numpy()
    if pa.types.is_floating(values.type) or pa.types.is_integer(values.type) or pa.types.is_decimal(values.type) or pa.types.is_boolean(values.type):
        held = pc.fill_null(values.cast(pa.float64()), 0.0).to_numpy()
    else:
        held = pc.fill_null(values.combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        missing = np.zeros(len(held), bool)  # a missing value is a group too
    return np.ma.MaskedArray(held, missing)


def over_sections(rows: DataFrame, inputs: list[str], made: list[str], measure: Callable[[Section], dict[str, np.ma.MaskedArray]], *group: str) -> DataFrame:
    """rows without the inputs that begin with __, and with the columns made, doubles, that measure gives for a group's rows at once."""
    kept = [f for f in rows.schema.fields if f.name not in made and not (f.name in inputs and f.name.startswith("__"))]
    names = [f.name for f in kept]

    def run(table: pa.Table) -> pa.Table:
        found = measure({c: _column(table[c]) for c in inputs})
        columns = [pa.array(np.ma.getdata(found[c]).astype(float), mask=np.ma.getmaskarray(found[c])) for c in made]
        return pa.table([table[c] for c in names] + columns, names=[*names, *made])

    return rows.groupBy(*group).applyInArrow(run, StructType([*kept, *(StructField(c, DoubleType()) for c in made)]))


def midranks(values: np.ma.MaskedArray, by: np.ma.MaskedArray | None = None) -> np.ma.MaskedArray:
    """Mid-rank percentiles, by groups of by: ties share their mean rank, missing values stay so and don't count."""
    out = np.ma.masked_all(len(values))
    there = np.flatnonzero(~np.ma.getmaskarray(values))
    if not len(there):
        return out
    v = np.ma.getdata(values)[there].astype(float)
    g = np.zeros(len(v)) if by is None else np.ma.getdata(by)[there]
    order = np.argsort(v, kind="stable") if by is None else np.lexsort((v, g))
    v, g = v[order], g[order]
    new_group = np.r_[True, g[1:] != g[:-1]]
    new_value = new_group | np.r_[True, (v[1:] != v[:-1]) & ~(np.isnan(v[1:]) & np.isnan(v[:-1]))]

    def spread(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row where its run begins and how long that is."""
        first, run = np.flatnonzero(new), np.cumsum(new) - 1
        return first[run], np.diff(np.append(first, len(new)))[run]

    (first, tied), (begin, every) = spread(new_value), spread(new_group)
    out[there[order]] = (first - begin + 1 + (tied - 1) / 2 - 0.5) / every * 100
    return out


def quantiles(values: np.ma.MaskedArray, *points: float) -> list[float | None]:
    """Linear quantiles of the present values; None without any."""
    v = np.sort(np.ma.getdata(values)[~np.ma.getmaskarray(values)])
    if not len(v):
        return [None] * len(points)
    out = []
    for at in ((len(v) - 1) * p for p in points):
        low, high = int(np.floor(at)), int(np.ceil(at))
        out.append(float(v[low] if v[low] == v[high] else (high - at) * v[low] + (at - low) * v[high]))
    return out


def every(value: float | None, size: int) -> np.ma.MaskedArray:
    """The same value, or none, for each row."""
    return np.ma.masked_all(size) if value is None else np.ma.MaskedArray(np.full(size, value), np.zeros(size, bool))


def held(values: np.ma.MaskedArray, low: float, high: float) -> np.ma.MaskedArray:
    """Values held at their quantiles and rounded to 10 digits, halves away from 0."""
    a, b = quantiles(values, low, high)
    if a is None:
        return values
    v = np.maximum(a, np.minimum(b, np.ma.getdata(values)))
    return np.ma.MaskedArray(np.trunc(v * 1e10 + np.copysign(0.5, v)) / 1e10, np.ma.getmaskarray(values))
