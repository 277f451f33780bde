"""Approximate nearest neighbours by largest inner product, on shifted Hilbert curves.

A vector x becomes the unit vector (x / M, sqrt(1 - |x|^2 / M^2)), with M the
largest norm, and a query q becomes (q / |q|, 0): the nearer these two lie, the
larger their inner product. Each of several curves projects the points to a few
random directions, shifts them, and orders them by their places on a Hilbert
curve. Spark range-partitions the orderings, a running count in each range and
the sums of the ranges before it give every point its place, and a query looks at
the candidates at most ``window`` places away on any curve. Candidates are dealt
to blocks of places; a query goes to the blocks that its window touches, and the
best of all blocks are merged.

The window is fitted: for a bounded sample of queries all rows are searched in
blocks, and the window is the distance in places, on the curve where they are
nearest, within which the wanted share of true neighbours lies. So the recall
holds for whatever data, and the work depends on them: vectors with near
neighbours need a small window, and independent directions of many dimensions, in
which no ordering keeps neighbours together, one that grows with the table.

Equal vectors are one point with its smallest ids, so groups of copies of any
size cost no more than one row, and ties among them are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, bounded_broadcast


@dataclass(frozen=True)
class Settings:
    """sample: queries whose true neighbours the window is fitted to, of each length of vectors. block: candidates
    of a block. queries: of those that meet a block, about as many as are compared at once."""

    curves: int = 8
    axes: int = 6
    bits: int = 10
    recall: float = 0.96
    sample: int = 256
    block: int = 4096
    queries: int = 4096
    seed: int = 5


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of cells(n, axes), whose numbers have the given bits; bits * axes at most 63."""
    x = cells.astype(np.int64).T.copy()
    one = 1 << (bits - 1)
    while one > 1:  # undo the rotations, from the largest cubes on
        low = one - 1
        for row in x:
            far = (row & one) > 0
            swapped = np.where(far, 0, (x[0] ^ row) & low)
            x[0] ^= np.where(far, low, swapped)
            row ^= swapped
        one >>= 1
    for a, b in zip(x[:-1], x[1:]):  # Gray code
        b ^= a
    flips, one = np.zeros(x.shape[1], np.int64), 1 << (bits - 1)
    while one > 1:
        flips ^= np.where((x[-1] & one) > 0, one - 1, 0)
        one >>= 1
    x ^= flips
    place = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for row in x:
            place = place << 1 | row >> bit & 1
    return place


def curve_keys(points: np.ndarray, s: Settings) -> np.ndarray:
    """Places (n, curves) of unit vectors; projections and shifts depend on the seed and the length only."""
    rng = np.random.default_rng([s.seed, points.shape[1]])
    out = np.empty((len(points), s.curves), np.int64)
    for c in range(s.curves):
        frame = np.linalg.qr(rng.normal(size=(points.shape[1], min(s.axes, points.shape[1]))))[0]
        spread = np.clip((points @ frame + 1) / 4 + rng.random(frame.shape[1]) / 2, 0, 1 - 2.0**-53)
        out[:, c] = hilbert(np.floor(spread * (1 << s.bits)), s.bits)
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner product of each row of a with that of b, summed the same way wherever the rows stand."""
    with np.errstate(over="ignore", invalid="ignore"):
        return (a * b).sum(axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a column of equally long lists, as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _by_length(batch: pa.RecordBatch, lengths: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column(lengths).to_numpy(zero_copy_only=False)
    for dim in np.unique(dims).tolist():
        yield dim, batch.take(pa.array(np.flatnonzero(dims == dim)))


POINT = "dim int, class long, asks boolean, curve int, key long"


def _points(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """Each class's place on each curve as a candidate, and once more as a query if it has one."""
    for batch in batches:
        for dim, rows in _by_length(batch, "dim"):
            x, ids = _matrix(rows.column("vector")), rows.column("class").to_numpy()
            norm, most = np.sqrt(products(x, x)), rows.column("most").to_numpy()
            asks = np.flatnonzero(rows.column("asked").to_numpy(zero_copy_only=False))
            with np.errstate(all="ignore"):
                lift = np.sqrt(np.maximum(0, 1 - (norm / most) ** 2))
                points = np.concatenate([np.column_stack([x / most[:, None], lift]), np.column_stack([x[asks] / norm[asks, None], np.zeros(len(asks))])])
            points = np.nan_to_num(points, posinf=0, neginf=0)  # squares out of a double's range
            keys, n = curve_keys(points, s), s.curves
            who, asking = np.concatenate([ids, ids[asks]]), np.arange(len(points)) >= len(x)
            columns = [np.full(keys.size, dim, np.int32), np.repeat(who, n), np.repeat(asking, n), np.tile(np.arange(n, dtype=np.int32), len(points)), keys.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["dim", "class", "asks", "curve", "key"])


def _named(least: pa.Array) -> list:
    """Ids that sort, null last."""
    return [float("inf") if i is None else i for i in least.to_pylist()]


FOUND = "dim int, query long, class long, least long, score double"


def _best(q: np.ndarray, asking: np.ndarray, x: np.ndarray, who: np.ndarray, least: list, near: np.ndarray | None, k: int) -> list[tuple]:
    """The k best classes for each query among x, by score and then by smallest id: (query, class, least, score).

    near masks the pairs that count. A matrix product chooses, with room for its
    rounding; the scores that decide are sums by row.
    """
    out = []
    approximate = np.nan_to_num(q @ x.T)
    use = asking[:, None] != who[None, :]
    if near is not None:
        use &= near
    approximate[~use] = -np.inf
    room = q.shape[1] * 1e-15 * np.sqrt(products(q, q)) * np.sqrt(products(x, x).max(initial=0))
    room[~np.isfinite(room)] = np.inf  # squares out of a double's range: all pairs are compared by row
    cut = approximate.min(axis=1) if len(who) <= k else np.partition(approximate, len(who) - k, axis=1)[:, len(who) - k]
    for r in range(len(q)):
        some = np.flatnonzero((approximate[r] >= cut[r] - room[r]) & use[r])
        score = products(np.broadcast_to(q[r], (len(some), q.shape[1])), x[some])
        order = sorted(range(len(some)), key=lambda i: (-score[i], least[some[i]]))[:k]
        out += [(asking[r], who[some[i]], least[some[i]], score[i]) for i in order]
    return out


def _found(dim: int, rows: list[tuple]) -> pa.RecordBatch:
    query, who, low, score = zip(*rows) if rows else ((),) * 4
    low = [None if i == float("inf") else i for i in low]
    columns = [pa.array([dim] * len(rows), pa.int32()), pa.array(query, pa.int64()), pa.array(who, pa.int64()), pa.array(low, pa.int64()), pa.array(score, pa.float64())]
    return pa.RecordBatch.from_arrays(columns, ["dim", "query", "class", "least", "score"])


def _searched(batches: Iterator[pa.RecordBatch], sample: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[pa.RecordBatch]:
    """The best of each batch for the sampled queries, over all rows."""
    for batch in batches:
        for dim, rows in _by_length(batch, "dim"):
            if dim in sample:
                asking, q = sample[dim]
                yield _found(dim, _best(q, asking, _matrix(rows.column("vector")), rows.column("class").to_numpy(), _named(rows.column("least")), None, k))


def _block(queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    """The best of a block of candidates for the queries whose windows touch it."""
    dim = queries.column("dim")[0].as_py() if len(queries) else 0
    rows = []
    if len(queries) and len(candidates):
        x, who, least, place = _matrix(candidates.column("vector")), candidates.column("class").to_numpy(), _named(candidates.column("least")), candidates.column("place").to_numpy()
        for at in range(0, len(queries), 512):
            some = queries.slice(at, 512)
            first = some.column("place").to_numpy()[:, None] - some.column("window").to_numpy()[:, None]
            last = some.column("place").to_numpy()[:, None] + some.column("window").to_numpy()[:, None]
            rows += _best(_matrix(some.column("vector")), some.column("class").to_numpy(), x, who, least, (place >= first) & (place < last), k)
    return pa.Table.from_batches([_found(dim, rows)])


def top_classes(found: DataFrame, k: int) -> DataFrame:
    """Of each query's rows(query, class, least, score) the k best, each class once."""
    once = found.groupBy("dim", "query", "class").agg(F.max("score").alias("score"), F.min("least").alias("least"))
    order = Window.partitionBy("dim", "query").orderBy(F.desc("score"), F.col("least").asc_nulls_last(), "class")
    return once.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k).drop("nth")


def places(points: DataFrame, scratch: Scratch) -> DataFrame:
    """points with place: the number of candidates before them on their curve."""
    order = ["dim", "curve", "key", "class", "asks"]
    dealt = scratch.table(points.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    counts = dealt.groupBy("dim", "curve", "range").agg(F.count_if(~F.col("asks")).alias("held"))
    before = Window.partitionBy("dim", "curve").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("dim", "curve", "range", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("dim", "curve", "range").orderBy("key", "class", "asks").rowsBetween(Window.unboundedPreceding, -1)
    counted = dealt.withColumn("inside", F.coalesce(F.sum((~F.col("asks")).cast("long")).over(inside), F.lit(0)))
    # A row for each range of a curve.
    return counted.join(F.broadcast(counts), ["dim", "curve", "range"]).select("dim", "curve", "class", "asks", (F.col("before") + F.col("inside")).alias("place"))


def fitted_window(truth: DataFrame, placed: DataFrame, k: int, recall: float) -> DataFrame:
    """(dim, window): within which the wanted share of the sampled queries' true neighbours lies on some curve."""
    of = truth.select("dim", "query", "class")
    asked = placed.filter("asks").select("dim", "curve", F.col("class").alias("query"), F.col("place").alias("at"))
    near = placed.filter(~F.col("asks")).select("dim", "curve", "class", "place")
    away = asked.join(F.broadcast(of), ["dim", "query"]).join(near, ["dim", "curve", "class"])
    # The candidates from place - window to place + window - 1 are those at most so many steps from the query.
    steps = F.when(F.col("place") >= F.col("at"), F.col("place") - F.col("at") + 1).otherwise(F.col("at") - F.col("place"))
    nearest = away.groupBy("dim", "query", "class").agg(F.min(steps).alias("steps"))
    return nearest.groupBy("dim").agg(F.greatest(F.ceil(F.percentile("steps", F.lit(recall))), F.lit(4 * k)).cast("long").alias("window"))


def search(
    vectors: DataFrame,
    queries: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    settings: Settings = Settings(),
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest that each query finds among all rows but its own.

    queries: a condition on rows of vectors; null is no. Nearest is the largest
    inner product, in double precision, then the smaller id, null ids last.
    Vectors that are null, zero, or hold null or non-finite entries take no part.
    Only vectors of the same length are compared. Repeated rows are rows of their
    own: each of them is found, and each query finds its repeats. With at most 4 k
    candidates all are looked at. An empty table gives an empty result. ids are
    longs.
    """
    s = settings
    with Scratch(vectors.sparkSession) as scratch:
        x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
        rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.coalesce(queries, F.lit(False)).alias("asks"), x.alias("vector"), F.col(vector_col).alias("kept"))
        whole = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("vector", lambda c: c != 0)
        rows = rows.filter(whole).withColumns({"dim": F.size("vector"), "hash": F.xxhash64("kept")})
        # A class is a vector: with its smallest ids, one more than are asked for, as a query isn't its own neighbour.
        first = Window.partitionBy("hash", "kept").orderBy(F.col("vec_id").asc_nulls_last())
        members = rows.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= k + 1)
        classes = members.groupBy("hash", "kept").agg(
            F.first("dim").alias("dim"), F.min("vec_id").alias("least"),
            F.transform(F.sort_array(F.collect_list(F.struct("nth", "vec_id"))), lambda m: m["vec_id"]).alias("members"),
        ).withColumnRenamed("kept", "vector")
        asked = rows.filter("asks").select("hash", F.col("kept").alias("vector")).distinct().withColumn("asked", F.lit(True))
        classes = classes.join(asked, ["hash", "vector"], "left").fillna(False, ["asked"]).withColumn("class", F.monotonically_increasing_id())
        classes = scratch.table(classes)
        norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))
        by_dim = classes.groupBy("dim").agg(F.max(norm).alias("most"), F.count_if("asked").alias("n_asked"), F.count(F.lit(1)).alias("n"))
        by_dim = bounded_broadcast(scratch.table(by_dim), 100_000)  # a row for each length
        points = classes.join(by_dim, "dim").select("dim", "class", "vector", "most", "asked")
        placed = scratch.table(places(points.mapInArrow(lambda b: _points(b, s), POINT), scratch))

        order = Window.partitionBy("dim").orderBy("hash", "class")
        sampled: dict[int, tuple[list, list]] = {}
        for r in classes.filter("asked").withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= s.sample).select("dim", "class", "vector").collect():
            ids, held = sampled.setdefault(r.dim, ([], []))
            ids.append(r["class"]), held.append(r.vector)
        sample = {dim: (np.array(ids), np.array(held, float)) for dim, (ids, held) in sampled.items()}
        every = classes.select("dim", "class", "least", "vector").mapInArrow(lambda b: _searched(b, sample, k), FOUND)
        truth = scratch.table(top_classes(every, k))
        window = scratch.table(fitted_window(truth, placed, k, s.recall))

        # A query meets the blocks of its window; if many do, they are dealt to parts and the block goes to each of them.
        meet = F.ceil((2 * F.col("window") + s.block) * F.col("n_asked") / F.col("n") / s.queries).cast("int")
        fit = by_dim.join(F.broadcast(window), "dim").select("dim", "window", "n", F.greatest(meet, F.lit(1)).alias("parts"))
        at = placed.join(F.broadcast(fit), "dim").join(classes.select("class", "vector", "least"), "class")
        blocks = F.sequence(
            F.greatest(F.floor((F.col("place") - F.col("window")) / s.block), F.lit(0)), F.least(F.floor((F.col("place") + F.col("window")) / s.block), F.floor((F.col("n") - 1) / s.block))
        )
        cell = ["dim", "curve", "block", "part"]
        mine = F.pmod(F.xxhash64("class"), F.col("parts")).cast("int").alias("part")
        asking = at.filter("asks").select("dim", "curve", F.explode(blocks).alias("block"), mine, "class", "vector", "place", "window")
        held = at.filter(~F.col("asks")).select("dim", "curve", F.floor(F.col("place") / s.block).alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "class", "vector", "place", "least")
        held = held.toDF(*held.columns)
        met = asking.groupBy(*cell).cogroup(held.groupBy(*cell)).applyInArrow(lambda q, c: _block(q, c, k), FOUND)
        best = top_classes(met, k).join(classes.select("class", "members"), "class")
        by_query = best.select("query", "score", F.explode("members").alias("vec_id")).withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))).filter(F.col("nth") <= k)

        # Nearest first: entries sort by falling score, then by id with nulls last. A class's own rows are added to what it finds.
        entry = lambda score, vec_id: F.struct((-score + 0.0).alias("far"), vec_id.isNull().alias("unnamed"), vec_id.alias("vec_id"))
        others = by_query.groupBy("query").agg(F.collect_list(entry(F.col("score"), F.col("vec_id"))).alias("others"))
        own = classes.filter("asked").mapInArrow(_own, T.StructType([classes.schema[c] for c in ("class", "hash", "vector", "members")] + [T.StructField("own", T.DoubleType())]))
        result = own.join(others, own["class"] == others["query"], "left").select("hash", "vector", "members", "own", F.coalesce("others", F.array().cast(others.schema["others"].dataType)).alias("others"))
        kept = Scratch(vectors.sparkSession).table(result)
    asking = rows.filter("asks").select("hash", F.col("kept").alias("vector"), F.col("vec_id").alias("query_id")).join(kept, ["hash", "vector"])
    place = F.coalesce(F.array_position("members", F.col("query_id")), F.when(F.col("query_id").isNull(), F.lit(0)))
    rest = F.filter("members", lambda m, i: (place == 0) | (i != place - 1))
    ranked = F.slice(F.sort_array(F.concat("others", F.transform(rest, lambda m: entry(F.col("own"), m)))), 1, k)
    return asking.select("query_id", F.posexplode(ranked).alias("at", "found")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("found.vec_id").alias("vec_id"), (-F.col("found.far") + 0.0).alias("score"))


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each class's product with itself."""
    for batch in batches:
        for _, rows in _by_length(batch, "dim"):
            x = _matrix(rows.column("vector"))
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("class", "hash", "vector", "members")), pa.array(products(x, x))], ["class", "hash", "vector", "members", "own"])
