"""Packing token sequences into fixed-length rows: best fit decreasing.

Documents longer than a row are split losslessly: full rows are written at
once, and only the rest is packed. Rests are placed longest first into the open
row with the least room that still holds them. That row is found in a segment
tree over room sizes: a leaf for each room size tells whether a row with it is
open, inner nodes whether any is below, so the search climbs and descends in
logarithmic time.

Rows are dealt to shards by a hash of id and text, in a number that follows the
input's size, and are ordered inside a shard, so results don't depend on how
the input was partitioned. A shard is packed in pools of a bounded number of
tokens; a pool's last rows are its only extra padding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens of a pool, and bytes of text that a shard should hold.
POOL_TOKENS, SHARD_BYTES = 4_000_000, 64_000_000


def byte_tokens(text: str) -> np.ndarray:
    """UTF-8 bytes as ids 3 to 258; 0 is padding, 1 and 2 are free for marks."""
    return np.frombuffer(text.encode("utf-8", "replace"), np.uint8).astype(np.uint16) + np.uint16(3)


class RoomTree:
    """Which room sizes, 0 to most, are open; find(size) gives the least open one of at least size."""

    def __init__(self, most: int):
        self.leaves = 1
        while self.leaves <= most:
            self.leaves *= 2
        self.open = [0] * (2 * self.leaves)

    def add(self, room: int, change: int) -> None:
        i = room + self.leaves
        while i:
            self.open[i] += change
            i //= 2

    def find(self, size: int) -> int:
        i = size + self.leaves
        if self.open[i]:
            return size
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return -1


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of positions of sizes, none over length; ties keep their order, and of rows
    with equal room the first is filled. Zero sizes are in no row."""
    tree, rows, open_rows = RoomTree(length), [], {}
    for i in sorted((i for i, n in enumerate(sizes) if n), key=lambda i: (-sizes[i], i)):
        room = tree.find(sizes[i])
        if room < 0:
            row, room = len(rows), length
            rows.append([])
        else:
            row = heappop(open_rows[room])
            tree.add(room, -1)
        rows[row].append(i)
        left = room - sizes[i]
        if left:
            heappush(open_rows.setdefault(left, []), row)
            tree.add(left, 1)
    return rows


def _write(pieces: list[tuple], length: int) -> tuple:
    """One packed row of (doc_id, part, ids): the matrix row, ends of segments, and positions that restart at 0."""
    ids, positions = np.zeros(length, np.uint16 if pieces[0][2].dtype == np.uint16 else np.int32), np.zeros(length, np.int32)
    ends, at = [0], 0
    for _, _, x in pieces:
        ids[at : at + len(x)] = x
        positions[at : at + len(x)] = np.arange(len(x))
        at += len(x)
        ends.append(at)
    return ids.tobytes(), ends, positions.astype(np.uint16 if length < 65536 else np.int32).tobytes(), [p[0] for p in pieces], [p[1] for p in pieces], at


def pack(
    docs: DataFrame,
    length: int = 2048,
    tokens: Callable[[str], np.ndarray] = byte_tokens,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int | None = None,
) -> DataFrame:
    """Packed rows: shard, row, ids, cu_seqlens, positions, doc_ids, parts, n_tokens.

    ids is a row of the token matrix (length little-endian numbers, 0 after the
    last token), cu_seqlens the cumulative segment lengths from 0, positions the
    position ids, which restart with each segment, doc_ids and parts the document
    and the part of it in each segment: joining a document's parts in order gives
    its tokens back. tokens may be any tokenizer, such as ``WordBpe.ids``. A null or empty text has no tokens and is in no row.
    Repeated rows are packed as often as they occur. shards: by default one for
    each SHARD_BYTES of text.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if shards is None:
        total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
        shards = max(1, -(-total // SHARD_BYTES))
    kind = dict(rows.dtypes)["doc_id"]
    dealt = (
        rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int"))
        .repartitionById(shards, "shard").sortWithinPartitions("shard", "doc_id", "text")
        .withColumn("doc_id", F.col("doc_id").cast("string"))  # a long beside a null would become a double in pandas
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, count, pool, size = None, 0, [], 0
        out: list[tuple] = []

        def close() -> None:
            nonlocal count, pool, size
            for row in best_fit_decreasing([len(p[2]) for p in pool], length):
                out.append((shard, count, *_write([pool[i] for i in row], length)))
                count += 1
            pool, size = [], 0

        def frame() -> pd.DataFrame:
            f = pd.DataFrame(out, columns=["shard", "row", "ids", "cu_seqlens", "positions", "doc_ids", "parts", "n_tokens"])
            out.clear()
            return f

        for pdf in batches:
            for row_id, text, s in zip(pdf["doc_id"], pdf["text"], pdf["shard"]):
                if s != shard:
                    close()
                    shard, count = s, 0
                ids = tokens(text)
                whole = len(ids) // length
                for part in range(whole):
                    out.append((shard, count, *_write([(row_id, part, ids[part * length : (part + 1) * length])], length)))
                    count += 1
                    if len(out) >= 2000:
                        yield frame()
                rest = ids[whole * length :]
                if len(rest):
                    pool.append((row_id, whole, rest.copy()))
                    size += len(rest)
                    if size >= POOL_TOKENS:
                        close()
                if len(out) >= 2000:
                    yield frame()
        close()
        if out:
            yield frame()

    schema = "shard int, row int, ids binary, cu_seqlens array<int>, positions binary, doc_ids array<string>, parts array<int>, n_tokens int"
    return dealt.mapInPandas(run, schema).withColumn("doc_ids", F.col("doc_ids").cast(f"array<{kind}>"))


def write_packed(packed: DataFrame, path: str) -> None:
    """Write the rows of ``pack`` as Parquet, a folder for each shard: a row of the id matrix, its segments and positions."""
    packed.write.partitionBy("shard").mode("overwrite").parquet(path)
