"""Embedding whitening by a tiled covariance.

Vectors become whole numbers, and the covariance is that of the distinct ones.
These are dealt into row blocks; each row block is cut into column blocks of
``WIDE`` dimensions, packed in the smallest integer type that holds them. A pair
of column blocks is a tile key: the blocks meet by a join on their row block, are
centred, multiplied, and summed by tile. The tiles of one vector length, which
are as many numbers as a matrix of its dimensions has, are assembled in one task
and decomposed. Vectors of different lengths don't mix: each length is a table of
its own throughout.

Sums by dimension are whole numbers, so centring and deviations are exact.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

#: Dimensions of a column block, rows of a row block, and tiles that a task sums before it hands them on.
WIDE, TALL, HELD_TILES = 32, 2048, 4096
#: Tasks' sums of a tile are first added up in so many parts.
SALTS = 32


def whole(vector: Column, scale: int = 256) -> Column:
    """floor(scale * entry) of each entry as long; null unless all entries are finite numbers."""
    c = F.transform(vector, lambda x: x.cast("double"))
    bad = vector.isNull() | F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(c, lambda x: F.floor(x * float(scale)).cast("long")))


def _rows(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, matrix) of the vectors of each length in a column of long arrays."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.asarray(column.offsets) - column.offsets[0].as_py()
    sizes = np.diff(ends)
    for dim in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == dim)
        yield dim, at, flat[ends[at][:, None] + np.arange(dim)]


def _safe(x: np.ndarray, factor: int) -> np.ndarray:
    """x, as Python's unbounded numbers if sums of products with numbers up to factor could leave a long."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    return x if most * factor * (x.shape[1] + x.shape[0]) < 2**62 else x.astype(object)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, pos, n, total) of a task's rows."""
    count: dict[int, int] = defaultdict(int)
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for dim, _, x in _rows(batch.column(0)):
            count[dim] += len(x)
            total[dim] = total.get(dim, 0) + _safe(x, 1).sum(axis=0).astype(object)
    for dim, s in total.items():
        columns = [pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([count[dim]] * dim, pa.int64()), pa.array([Decimal(int(v)) for v in s], pa.decimal128(38, 0))]
        yield pa.RecordBatch.from_arrays(columns, ["dim", "pos", "n", "total"])


def _packed(x: np.ndarray) -> tuple[bytes, str]:
    low, high = int(x.min()), int(x.max())
    kind = next(k for k in ("int8", "int16", "int32", "int64") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return x.astype(kind).tobytes(), kind


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, rows, col, kind, cells): column blocks of row blocks; rows names the row block."""
    task, made = TaskContext.get().partitionId(), 0
    for batch in batches:
        for dim, _, x in _rows(batch.column(0)):
            for k in range(0, len(x), TALL):
                part, out = x[k : k + TALL], []
                for c in range(0, dim, WIDE):
                    cells, kind = _packed(part[:, c : c + WIDE])
                    out.append((dim, (task << 32) + made, c // WIDE, kind, cells))
                made += 1
                yield pa.RecordBatch.from_pydict(dict(zip(("dim", "rows", "col", "kind", "cells"), map(list, zip(*out)))), pa.schema([("dim", pa.int32()), ("rows", pa.int64()), ("col", pa.int32()), ("kind", pa.string()), ("cells", pa.binary())]))


Fit = dict[int, tuple[int, list[int]]]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n, from the exact n * x - sums."""
    most = n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, sums), default=0)
    x, s = (x.astype(np.int64), np.array(sums, np.int64)) if most < 2**62 else (x.astype(object), np.array(sums, object))
    return ((x * n - s) / n).astype(float)


TILE = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("salt", T.IntegerType()), T.StructField("cells", T.BinaryType())])


def _multiplied(batches: Iterator[pa.RecordBatch], fit: Fit) -> Iterator[pd.DataFrame]:
    """Sums of a task's tiles; a batch's row has two column blocks of one row block."""
    salt = TaskContext.get().partitionId() % SALTS
    sums: dict[tuple[int, int, int], np.ndarray] = {}

    def out() -> pa.RecordBatch:
        columns = list(zip(*[(*k, salt, v.tobytes()) for k, v in sums.items()]))
        sums.clear()
        kinds = [pa.int32()] * 4 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], TILE.names)

    for batch in batches:
        for r in batch.to_pylist():
            n, s = fit[r["dim"]]
            sides = []
            for col, kind, cells in ((r["i"], r["kind"], r["cells"]), (r["j"], r["kind_j"], r["cells_j"])):
                of = s[col * WIDE : (col + 1) * WIDE]
                sides.append(_centred(np.frombuffer(cells, kind).reshape(-1, len(of)), n, of))
            key = (r["dim"], r["i"], r["j"])
            sums[key] = sums.get(key, 0) + sides[0].T @ sides[1]
            if len(sums) >= HELD_TILES:
                yield out()
    if sums:
        yield out()


def _added(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(c) for c in rows["cells"])
    return pd.DataFrame([(*key[:3], 0, total.tobytes())], columns=TILE.names)


def _decomposed(key: tuple, tiles: pd.DataFrame, n: int, components: int) -> pd.DataFrame:
    """Eigenvectors of the covariance, by falling eigenvalue, over the root of theirs."""
    (dim,) = key
    v = np.zeros((dim, dim))
    for i, j, cells in zip(tiles["i"], tiles["j"], tiles["cells"]):
        a, b = slice(i * WIDE, min(dim, (i + 1) * WIDE)), slice(j * WIDE, min(dim, (j + 1) * WIDE))
        v[a, b] = np.frombuffer(cells).reshape(a.stop - a.start, -1) / n
        v[b, a] = v[a, b].T
    values, vectors = np.linalg.eigh(v)
    least = values[-1] * dim * np.finfo(float).eps
    out = []
    for k in range(1, min(components, dim) + 1):
        if values[-k] > least:
            out.append((dim, k, values[-k] / np.trace(v), vectors[:, -k] / np.sqrt(values[-k])))
    return pd.DataFrame(out, columns=["dim", "component", "explained", "axis"])


Axes = dict[int, list[tuple[int, float, list[float]]]]


def _identity(batches: Iterator[pa.RecordBatch], fit: Fit, axes: Axes) -> Iterator[pa.RecordBatch]:
    """(dim, i, j, product, left, right): sums over a task's rows of the whitened components and their products."""
    sums: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for dim, _, x in _rows(batch.column(0)):
            if axes.get(dim):
                y = _centred(x, *fit[dim]) @ np.array([a for _, _, a in axes[dim]]).T
                old = sums.get(dim, [0, 0])
                sums[dim] = [old[0] + y.T @ y, old[1] + y.sum(axis=0)]
    for dim, (products, total) in sums.items():
        i, j = (k.ravel() for k in np.indices(products.shape))
        columns = [pa.array(np.full(len(i), dim), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(products.ravel()), pa.array(total[i]), pa.array(total[j])]
        yield pa.RecordBatch.from_arrays(columns, ["dim", "i", "j", "product", "left", "right"])


def _fitted(distinct: DataFrame, components: int, scratch: Scratch) -> tuple[Fit, Axes, dict[int, float]]:
    """Of each length: the number of vectors and their sums, the components, and how far these are from white."""
    sums = distinct.mapInArrow(_sums, "dim int, pos int, n long, total decimal(38,0)").groupBy("dim", "pos").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    by_dim = sums.groupBy("dim").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "total"))).alias("sums")).collect()
    fit: Fit = {r.dim: (r.n, [int(s.total) for s in r.sums]) for r in by_dim}

    blocks = scratch.table(distinct.mapInArrow(_blocks, "dim int, rows long, col int, kind string, cells binary"))
    others = blocks.select("dim", "rows", F.col("col").alias("j"), F.col("kind").alias("kind_j"), F.col("cells").alias("cells_j"))
    pairs = blocks.withColumnRenamed("col", "i").join(others, ["dim", "rows"]).filter("i <= j")
    tiles = pairs.mapInArrow(lambda b: _multiplied(b, fit), TILE)
    for salt in (F.col("salt"), F.lit(0).alias("salt")):
        tiles = tiles.select("dim", "i", "j", salt, "cells").groupBy("dim", "i", "j", "salt").applyInPandas(_added, TILE)
    found = tiles.groupBy("dim").applyInPandas(lambda key, t: _decomposed(key, t, fit[key[0]][0], components), "dim int, component int, explained double, axis array<double>")
    axes: Axes = defaultdict(list)
    for r in found.orderBy("dim", "component").collect():
        axes[r.dim].append((r.component, r.explained, r.axis))

    products = distinct.mapInArrow(lambda b: _identity(b, fit, axes), "dim int, i int, j int, product double, left double, right double")
    products = products.groupBy("dim", "i", "j").agg(*[F.sum(c).alias(c) for c in ("product", "left", "right")])
    error: dict[int, float] = defaultdict(float)
    for r in products.collect():
        n = fit[r.dim][0]
        error[r.dim] = max(error[r.dim], abs(r.product / n - r.left / n * r.right / n - (r.i == r.j)))
    return fit, axes, error


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n * x - sums)^2 of each row, exact.

    It is n^2 A - 2 n B + C with A the row's squares and B its product with the
    sums, which are cut in two so that long products of them suffice.
    """
    high, low = [s >> 24 for s in sums], [s & (2**24 - 1) for s in sums]
    most = max(2**24, *map(abs, high), abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    x = _safe(x, most)
    kind = x.dtype
    a = (x * x).sum(axis=1).astype(object)
    b = (x @ np.array(high, kind)).astype(object) * 2**24 + (x @ np.array(low, kind)).astype(object)
    return (a * (n * n) - b * (2 * n) + sum(s * s for s in sums)).tolist()


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, components: int = 4) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component.

    Rows whose vector is null or has a null or non-finite entry are dropped;
    entries become floor(scale * entry). Distinct vectors are fitted, all rows
    are whitened, repeated ones alike. Components are numbered from 1 by falling
    eigenvalue; those without variance have no rows, so that neither a single
    distinct vector nor an empty one has any. Each length of vectors is whitened
    by itself. A deviation beyond a long is null. ids may have any type and be
    null or repeated. What comes to the driver are the sums by dimension and the
    components of each length.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), whole(F.col(vector_col), scale).alias("x")).filter("x IS NOT NULL")
    with Scratch(vectors.sparkSession) as scratch:
        fit, axes, error = _fitted(scratch.table(rows.select("x").distinct()), components, scratch)

    schema = T.StructType(
        [rows.schema["vec_id"], T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType())]
        + [T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, x in _rows(batch.column(1)):
                if not axes.get(dim):
                    continue
                (n, s), k = fit[dim], len(axes[dim])
                y = _centred(x, n, s) @ np.array([a for _, _, a in axes[dim]]).T
                deviation = [d if d < 2**63 else None for d in deviations(x, n, s)]
                again = pa.array(np.repeat(np.arange(len(at)), k))
                numbers, shares = zip(*[(c, e) for c, e, _ in axes[dim]])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at)).take(again), pa.array(list(numbers) * len(at), pa.int32()), pa.array(np.full(len(again), n)),
                        pa.array(deviation, pa.int64()).take(again), pa.array(y.ravel()), pa.array(list(shares) * len(at)), pa.array(np.full(len(again), error[dim])),
                    ],
                    schema.names,
                )

    return rows.mapInArrow(run, schema)
