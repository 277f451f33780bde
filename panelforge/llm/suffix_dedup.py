"""Removal of repeated long strings by a distributed difference-cover suffix sort.

Every byte covered by a ``LENGTH``-byte string that also starts elsewhere is
removed. The work is dealt by content, without loss:

1. *Anchors.* Each window of LENGTH bytes has an anchor: of the ``GRAM``-byte
   strings inside it the one with the smallest hash, the leftmost of ties. Equal
   windows have equal anchors at equal places, so windows can only repeat within
   the rows of one anchor string. The windows of one anchor form a *context*.
2. *Whole contexts.* A context that occurs twice repeats in all its windows;
   anchor strings with a single row don't repeat at all.
3. *Suffix sort.* Where an anchor has different contexts, one of each is kept,
   and their windows are sorted as suffixes: the slice of the suffix array that
   belongs to these anchors. Positions in two of three residue classes are
   sampled; their triples are sorted and named, names are sorted in triples
   again until a name covers the length, and the remaining positions are merged
   in by their first characters and the rank that follows. Characters are 8 bytes.
4. *Adjacent prefixes.* Neighbours in the merged order are compared byte by byte
   over LENGTH; a window repeats exactly if it equals a neighbour.

An anchor with more than ``GIANT`` different contexts is not sorted in one task:
its windows are dealt one by one, by a digest of their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, by_row, materialize

LENGTH = 200
GRAM = 100
#: Starts of windows that are handled together, a bound on memory for long texts.
CHUNK = 1 << 20
#: One row in HINT is looked at for what is frequent, at most HOT contexts and HOT anchor strings. Rows of a context
#: seen to repeat are spread anywhere, for their verdict is known; other rows of a frequent anchor string are dealt
#: by context too. This only steers the partitioning: results don't depend on it.
HINT, HOT, HOT_LEAST, SALTS = 64, 10_000, 20, 64
GIANT = 50_000
#: Bytes of contexts that one suffix sort takes.
SLICE_BYTES = 1_500_000

U = np.uint64
P = U(0x9E3779B97F4A7C15)
P_INVERSE = U(pow(int(P), -1, 1 << 64))


def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = CHUNK + LENGTH
    return np.cumprod(np.r_[U(1), np.full(n, P)]), np.cumprod(np.r_[U(1), np.full(n, P_INVERSE)])


def anchors_of(raw: bytes, powers: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash of the anchor string, first start, number of starts) of the contexts of a text, in stretches."""
    data = np.frombuffer(raw, np.uint8)
    for at in range(0, len(data) - LENGTH + 1, CHUNK):
        part = data[at : at + CHUNK + LENGTH - 1]
        n = len(part) - GRAM + 1
        up, down = powers
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + U(1)) * up[: len(part)], out=sums[1:])
        h = (sums[GRAM:] - sums[:n]) * down[:n]
        h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
        h ^= h >> U(32)
        # Hash and place in one number, so that a sliding minimum gives the leftmost of the smallest.
        low = (h & ~U((1 << 21) - 1)) | np.arange(n, dtype=np.uint64)
        span, width = LENGTH - GRAM + 1, 1
        while width * 2 <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if span > width:
            low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
        place = (low & U((1 << 21) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        yield h[place[first]].view(np.int64), first + at, np.diff(np.r_[first, len(place)])


def _anchor_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    powers = _powers()
    digest = xxhash.xxh3_64_intdigest
    for pdf in batches:
        out = []
        for key, text in zip(pdf["key"], pdf["text"]):
            raw = text.encode("utf-8", "replace")
            for gram, first, n in anchors_of(raw, powers):
                stops = (first + n + LENGTH - 1).tolist()
                context = np.array([digest(raw[a:b]) for a, b in zip(first.tolist(), stops)], np.uint64).view(np.int64)
                out.append((gram, context, np.full(len(gram), key), first * 128 + n))
        if out:
            yield pd.DataFrame(dict(zip(("gram", "context", "key", "span"), map(np.concatenate, zip(*out)))))


def text_key(text: Column, seed: int = 0) -> Column:
    return F.xxhash64(F.lit(seed), text, F.octet_length(text))


def with_keys(docs: DataFrame, columns: list[Column], text: Column) -> DataFrame:
    """columns, text and key, one number for each different text.

    Texts whose numbers collide (their 128-bit digests differ) get a number of
    the next seed, and all are looked at again, until none collide.
    """
    out, seed = docs.select(*columns, text.alias("text")).withColumn("key", text_key(F.col("text"))), 0
    while True:
        digest = F.md5("text")
        collided = out.groupBy("key").agg(F.min(digest).alias("low"), F.max(digest).alias("high")).filter("low <> high").select("key", F.lit(True).alias("collided"))
        collided = materialize(collided)
        if collided.isEmpty():
            return out
        seed += 1
        out = out.join(bounded_broadcast(collided, 100_000), "key", "left").withColumn("key", F.when(F.col("collided"), text_key(F.col("text"), seed)).otherwise(F.col("key"))).drop("collided")


def anchors(texts: DataFrame) -> DataFrame:
    """(gram, context, key, span) of texts(key, text); span is first start * 128 + number of starts."""
    return texts.mapInPandas(_anchor_rows, "gram long, context long, key long, span long")


def judged(texts: DataFrame, row_id: Column) -> DataFrame:
    """Anchor rows that may repeat: n rows have their context; ``stands`` for it among several of the anchor string."""
    seen = materialize(
        anchors(texts.filter(F.pmod(row_id, F.lit(HINT)) == 0).select("key", "text"))
        .groupBy("gram", "context").agg(F.count(F.lit(1)).alias("count"), F.min(F.struct("key", "span")).alias("one"))
    )
    # Of a frequent context two rows were seen at least, so it repeats; one of its rows stands for all in the groups.
    frequent = materialize(seen.filter(F.col("count") >= max(2, HOT_LEAST)).orderBy(F.desc("count"), "gram", "context").limit(HOT))
    known = F.broadcast(frequent.select("gram", "context", F.lit(True).alias("known")))  # HOT rows at most
    varied = seen.join(known, ["gram", "context"], "left_anti").groupBy("gram").agg(F.sum("count").alias("count"))
    varied = varied.filter(F.col("count") >= HOT_LEAST).orderBy(F.desc("count"), "gram").limit(HOT)
    hot = F.broadcast(varied.select("gram", F.lit(True).alias("hot")))  # HOT rows at most
    rows = anchors(texts.select("key", "text")).join(known, ["gram", "context"], "left")
    # A stand-in's span is below 0; rows of a known context have a salt below 0. So no further column is shuffled.
    stand_ins = frequent.select("gram", "context", "one.key", (-F.col("one.span")).alias("span"), F.lit(None).cast("boolean").alias("known"))
    by_context = F.when(F.col("hot"), F.pmod("context", F.lit(SALTS)) + 1).otherwise(F.lit(0))
    anywhere = -1 - F.pmod(F.xxhash64("key", "span"), F.lit(4096))
    dealt = (
        rows.unionByName(stand_ins).join(hot, "gram", "left")
        .withColumn("salt", F.when(F.col("known"), anywhere).otherwise(by_context)).drop("hot", "known").repartition("gram", "salt")
    )
    same = Window.partitionBy("gram", "salt", "context")
    group = Window.partitionBy("gram", "salt")
    several = (F.min("context").over(group) != F.max("context").over(group)) | (F.col("salt") > 0)
    known_row = F.col("salt") < 0
    count = F.count(F.lit(1)).over(same) + F.max(F.when(F.col("span") < 0, 1).otherwise(0)).over(same)
    return (
        dealt.withColumn("nth", F.row_number().over(same.orderBy("key", "span")))
        .withColumn("n", F.when(known_row, F.lit(2)).otherwise(count))
        .withColumn("stands", ~known_row & several & (F.col("nth") == 1))
        .filter("n > 1 OR stands")
        .select("gram", "key", F.abs("span").alias("span"), "n", "stands")
    )


def _context_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for key, text, rows in zip(pdf["key"], pdf["text"], pdf["rows"]):
            raw = text.encode("utf-8", "replace")
            for r in rows:
                first, n = divmod(r["span"], 128)
                out.append((r["gram"], key, r["span"], r["n"] == 1, raw[first : first + n + LENGTH - 1]))
        if out:
            yield pd.DataFrame(out, columns=["gram", "key", "span", "lone", "bytes"])


def _names(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Dense ranks of rows whose sorted order is given; equal keys share a rank."""
    change = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        change[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(change)
    return out


def _named(*keys: np.ndarray) -> np.ndarray:
    return _names(np.lexsort(keys[::-1]), *keys)


def repeated_starts(contexts: list[bytes]) -> list[np.ndarray]:
    """For each context which of its windows equal another window of the list, by difference-cover suffix sort."""
    step = 24  # three characters of 8 bytes
    sizes = np.array([len(c) for c in contexts])
    room = -(-sizes // step) * step
    base = np.cumsum(room) - room
    flat = np.zeros(int(room.sum()) + 2 * LENGTH + 64, np.uint8)
    for b, c in zip(base.tolist(), contexts):
        flat[b : b + len(c)] = np.frombuffer(c, np.uint8)
    n = int(room.sum()) + LENGTH + 48
    char = np.zeros(n, np.uint64)
    for i in range(8):
        char = char << U(8) | flat[i : i + n]
    counts = sizes - LENGTH + 1
    starts = np.repeat(base, counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)

    # Sort and name the triples of sampled positions; then triples of names, until a name covers LENGTH bytes.
    inside = n - LENGTH
    cover = np.flatnonzero(np.arange(inside) // 8 % 3 > 0)
    rank = np.zeros(n + 2 * LENGTH, np.int64)
    rank[cover] = _named(char[cover], char[cover + 8], char[cover + 16]) + 1
    covered = step
    while covered < LENGTH:
        rank[cover] = _named(rank[cover], rank[cover + covered], rank[cover + 2 * covered]) + 1
        covered *= 3

    # Merge the remaining suffixes: by the character before a sampled position, or the two before.
    kind = starts // 8 % 3
    zero, one, two = (starts[kind == k] for k in range(3))
    sampled = np.concatenate([one, two])
    sampled = sampled[np.argsort(rank[sampled], kind="stable")]
    a = np.concatenate([zero, one])
    first = _named(char[a], rank[a + 8])
    b = np.concatenate([zero, two])
    second = _named(char[b], char[b + 8], rank[b + 16])
    order = np.argsort(first[: len(zero)], kind="stable")
    place = np.searchsorted(np.sort(first[len(zero) :]), first[: len(zero)][order]) + np.searchsorted(np.sort(second[len(zero) :]), second[: len(zero)][order])
    merged = np.insert(sampled, np.minimum(np.maximum.accumulate(place), len(sampled)), zero[order]) if len(zero) else sampled

    # Adjacent prefixes, byte by byte.
    i, j = merged[:-1], merged[1:]
    for at in range(0, LENGTH, 8):
        equal = char[i + at] == char[j + at]
        i, j = i[equal], j[equal]
    repeats = np.zeros(n, bool)
    repeats[i] = repeats[j] = True
    return np.split(repeats[starts], np.cumsum(counts)[:-1])


def _runs(key: int, span: int, repeats: np.ndarray) -> list[tuple[int, int, int]]:
    edges = np.flatnonzero(np.diff(np.r_[False, repeats, False]))
    first = span // 128
    return [(key, first + a, first + b) for a, b in edges.reshape(-1, 2).tolist()]


def _sorted_slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by gram; whole groups are sorted together, SLICE_BYTES at a time."""
    held: list[tuple] = []
    size, gram = 0, None

    def done() -> list[tuple[int, int, int]]:
        distinct: dict[bytes, int] = {}
        for row in held:
            distinct.setdefault(row[3], len(distinct))
        found = repeated_starts(list(distinct))
        return [x for key, span, lone, context in held if lone for x in _runs(key, span, found[distinct[context]])]

    for pdf in batches:
        out = []
        for g, *row in zip(pdf["gram"], pdf["key"], pdf["span"], pdf["lone"], pdf["bytes"]):
            if g != gram and size >= SLICE_BYTES:
                out += done()
                held, size = [], 0
            gram = g
            held.append(tuple(row))
            size += len(row[3])
        if out:
            yield pd.DataFrame(out, columns=["key", "first", "stop"])
    if held:
        yield pd.DataFrame(done(), columns=["key", "first", "stop"])


def _window_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for key, span, context in zip(pdf["key"], pdf["span"], pdf["bytes"]):
            first, n = divmod(span, 128)
            out += [(sha256(context[i : i + LENGTH]).digest(), key, first + i) for i in range(n)]
        if out:
            yield pd.DataFrame(out, columns=["window", "key", "first"])


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(key, spans) of the texts(doc_id, text, key) with repeats: array of (first, stop) starts of windows that repeat."""
    rows = materialize(judged(texts, F.xxhash64("doc_id", "text")))
    first = F.floor(F.col("span") / 128)
    whole = rows.filter("n > 1").select("key", first.alias("first"), (first + F.pmod("span", F.lit(128))).alias("stop"))

    stands = rows.filter("stands")
    asked = stands.groupBy("key").agg(F.collect_list(F.struct("gram", "span", "n")).alias("rows"))
    one_each = texts.groupBy("key").agg(F.min("text").alias("text"))
    contexts = one_each.join(asked, "key").mapInPandas(_context_rows, "gram long, key long, span long, lone boolean, bytes binary")
    giant = materialize(stands.groupBy("gram").count().filter(F.col("count") > GIANT).select("gram"))
    has_giant = not giant.isEmpty()
    usual = contexts.join(giant, "gram", "left_anti") if has_giant else contexts
    parts = [whole, usual.repartition("gram").sortWithinPartitions("gram").mapInPandas(_sorted_slices, "key long, first long, stop long")]
    if has_giant:
        windows = materialize(contexts.join(giant, "gram", "left_semi").mapInPandas(_window_rows, "window binary, key long, first long").distinct())
        twice = windows.groupBy("window").count().filter("count > 1").select("window")
        parts.append(windows.join(twice, "window").select("key", "first", (F.col("first") + 1).alias("stop")))
    spans = parts[0]
    for p in parts[1:]:
        spans = spans.unionByName(p)
    return spans.groupBy("key").agg(F.collect_set(F.struct("first", "stop")).alias("spans"))


def _kept(raw: bytes, spans) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes outside all repeated strings, and the maximal removed runs."""
    if spans is None or not len(spans):
        return raw, []
    runs: list[list[int]] = []
    for first, stop in sorted((s["first"], s["stop"] - 1 + LENGTH) for s in spans):
        if runs and first <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], stop)
        else:
            runs.append([first, stop])
    edges = [0, *[x for r in runs for x in r], len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])), [tuple(r) for r in runs]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary), removed.

    Texts are UTF-8 bytes; matches never cross documents. Every byte that a
    200-byte string covers which also starts elsewhere, in this or another row,
    is removed; strings are judged on the input. So copies of a text of 200
    bytes or more lose all of it, each of them. A null or empty text has no
    bytes; texts under 200 bytes lose none. removed holds the runs (first, stop).
    """
    rows = with_keys(docs, [F.col(id_col).alias("doc_id")], F.coalesce(F.col(text_col), F.lit("")))
    spans = repeated_spans(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, spans in zip(pdf["text"], pdf["spans"]):
                raw = text.encode("utf-8", "replace")
                kept, runs = _kept(raw, spans)
                out.append((len(raw), len(raw) - len(kept), len(runs), sha256(kept).hexdigest(), kept, [{"first": a, "stop": b} for a, b in runs]))
            yield pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "removed"])

    schema = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, removed array<struct<first:long,stop:long>>"
    made = by_row(rows, run, schema)(F.struct("text", "spans")).alias("made")
    return rows.join(spans, "key", "left").select("doc_id", made).select("doc_id", "made.*")


def removal_digests(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
