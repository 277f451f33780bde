"""N-gram Jaccard self-join by a MinHash LSH forest with exact verification.

Documents are sets of hashed word n-grams. A set's signature is a ring of
``trees * floor`` MinHash values. Its path in tree t is the stretch of
``deepest`` values that begins at ``t * floor``: beginnings of up to ``floor``
values are independent between trees, longer ones borrow values of the next
trees and only steer. A pair of similarity s shares a beginning of length d in
one of T trees with probability ``1 - (1 - s^d)^T``; ``floor`` is the longest
length at which that reaches the target recall for pairs at the threshold.

1. Equal sets are one *set row* with a weight, so copies cost nothing.
2. *Tries.* All paths are sorted by (tree, path), dealt by range, so that a trie
   is a stretch of sorted rows and a node a stretch of equal beginnings. A crowded
   node reaches over several tasks, none of which gets more than its range.
3. *Shortening.* In each trie sets are matched at the longest beginnings first.
   In a node some sets lead: one ties all sets of the node to it whose sketches are
   near and settles those that are very near. A settled set is spoken for by its
   leader and goes no further in this tree; all others are matched again at a
   shorter beginning, until the floor, where the target recall is met. What the
   leaders of a node that several tasks share have in common is found by
   comparing these leaders in blocks.
4. Connected components of the ties hold all candidates of a document together.
   They are cut into blocks of a bounded number of documents and n-grams. Each
   pair of blocks is one bounded unit of work: its sets are intersected exactly,
   and only counts and one link for each document leave it.
5. Classes are the connected components of verified links.

No pair of documents is ever emitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_row, materialize

#: Values of a signature that two sets of a node are compared by.
SKETCH = 128
#: Sets that are matched together in one node, at most; the leaders of more are compared in blocks.
PIECE = 2048
#: Documents and n-grams of a block, on average at most. Two blocks are intersected in one unit of work.
BLOCK, BLOCK_GRAMS = 1024, 1_000_000
#: Differing values of a sketch up to which a leader settles a set: at the deepest level, half way, and at the floor.
SETTLES = (6, 5, 5)


def depth_for(threshold: float, trees: int, deepest: int, recall: float) -> int:
    """The longest prefix at which pairs at the threshold are still found with the recall."""
    for depth in range(deepest, 0, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    return 1


def levels(floor: int, deepest: int) -> list[tuple[int, int]]:
    """(length, differences that settle) of the beginnings that are matched, longest first; the last is the floor."""
    if deepest <= floor:
        return [(floor, SETTLES[-1])]
    return list(zip((deepest, (deepest + floor) // 2, floor), SETTLES)) if deepest > floor + 1 else [(deepest, SETTLES[0]), (floor, SETTLES[-1])]


def reach(threshold: float, recall: float) -> int:
    """Differing values of a sketch up to which a set is tied to a leader.

    Linked sets differ in more than ``apart`` values with a hundredth of the chance that the recall leaves.
    Either of two linked sets is at most sum(SETTLES) differences from the one that speaks for it, so
    by the triangle inequality these two are within reach of each other.
    """
    missed, apart = 0.0, SKETCH
    while apart > 0:
        missed += comb(SKETCH, apart) * (1 - threshold) ** apart * threshold ** (SKETCH - apart)
        if missed > (1 - recall) / 100:
            break
        apart -= 1
    return min(SKETCH, apart + 2 * sum(SETTLES))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, n: int, known: dict) -> np.ndarray:
    """Distinct hashed n-grams of the words, sorted; a shorter text is one n-gram, one without words none."""
    words = text.encode("utf-8", "replace").split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.array([known[w] for w in words], np.uint64)
    size = min(n, len(h))
    out = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k])
    return np.unique(out)


def signature(grams: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest value of each hash function over the set, in pieces so that long texts stay bounded."""
    best = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 4096):
        best = np.minimum(best, (grams[at : at + 4096, None] * a + b).min(0))
    return best


def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return rng.integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, count, dtype=np.uint64)


def paths_of(values: np.ndarray, trees: int, floor: int, deepest: int) -> np.ndarray:
    """A row of 8 + deepest - floor bytes for each tree: a hash of the first floor values, then a byte of each further one."""
    at = np.arange(trees) * floor
    top = np.zeros(trees, np.uint64)
    for d in range(floor):
        top = _mix(top * np.uint64(31) + values[at + d])
    further = [(values[(at + d) % (trees * floor)] & np.uint64(255)).astype(np.uint8) for d in range(floor, deepest)]
    return np.column_stack([top.astype(">u8").view(np.uint8).reshape(trees, 8), *further])


def signed(docs: DataFrame, n: int, trees: int, floor: int, deepest: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, set_id, grams, paths, sketch) of each row; set_id is null for a text without words."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = _WordHash()
        a, b = _functions(max(trees * floor, SKETCH))
        for texts in batches:
            ids, sizes, paths, sketches = [], [], [], []
            for text in texts:
                grams = shingles(text or "", n, known)
                sizes.append(len(grams))
                if not len(grams):
                    ids.append(None), paths.append(None), sketches.append(None)
                    continue
                ids.append(blake2b(grams.tobytes(), digest_size=16).digest())
                values = _mix(signature(grams, a, b))
                paths.append(paths_of(values, trees, floor, deepest).tobytes())
                sketches.append((values[:SKETCH] & np.uint64(255)).astype(np.uint8).tobytes())
            yield pd.DataFrame({"set_id": ids, "grams": sizes, "paths": paths, "sketch": sketches})

    made = by_row(rows, run, "set_id binary, grams int, paths binary, sketch binary")
    return rows.select("doc_id", "text_key", made("text").alias("made")).select("doc_id", "text_key", "made.*")


# The tries


def _by_path(rows: DataFrame) -> DataFrame:
    """Rows in the order of the tries. Ranges are cut at (tree, path, set_id), so they also cut through crowded nodes."""
    return rows.repartitionByRange("tree", "path", "set_id").sortWithinPartitions("tree", "path", "set_id")


def _accompanied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of sorted paths those that share their node at the floor with a neighbour, and the first and last of a range."""
    held, with_last = None, True
    for pdf in batches:
        if held is not None:
            pdf = pd.concat([held, pdf], ignore_index=True)
        if not len(pdf):
            continue
        top = [(t, p[:8]) for t, p in zip(pdf["tree"], pdf["path"])]
        same = np.fromiter((x == y for x, y in zip(top, top[1:])), bool, len(top) - 1)
        keep = np.r_[with_last, same] | np.r_[same, True]
        held, with_last = pdf.iloc[-1:], bool(np.r_[with_last, same][-1])
        yield pdf[:-1][keep[:-1]]
    if held is not None:
        yield held


def _lead(sketches: np.ndarray, live: np.ndarray, settles: int, far: int, group: np.ndarray, ties: list) -> np.ndarray:
    """Positions that stay: each leads those after it that are left, or is settled by one before it. Ties join groups."""
    stay, left = [], live
    while len(left):
        lead, left = left[0], left[1:]
        stay.append(lead)
        if not len(left):
            break
        apart = (sketches[left] != sketches[lead]).sum(1)
        near = left[apart <= far]
        new, first = np.unique(group[near], return_index=True)
        for g, k in zip(new, first):
            if g != group[lead]:
                ties.append((int(near[k]), int(lead)))
                group[group == g] = group[lead]
        left = left[apart > settles]
    return np.array(stay)


def matched(paths: list[bytes], sketches: np.ndarray, steps: list[tuple[int, int]], far: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(ties, leaders) of the sorted members of one node at the floor: the longest common beginnings are matched first."""
    floor = steps[-1][0]
    group, ties, live = np.arange(len(paths)), [], np.arange(len(paths))
    rest = np.frombuffer(b"".join(p[8:] for p in paths), np.uint8).reshape(len(paths), -1)
    for length, settles in steps:
        mine = rest[live, : length - floor]
        cuts = np.flatnonzero((mine[1:] != mine[:-1]).any(1)) + 1 if length > floor else []
        live = np.concatenate([part if len(part) == 1 else _lead(sketches, part, settles, far, group, ties) for part in np.split(live, cuts)])
    return ties, live


NODE = "a binary, b binary, tree int, top binary, piece long, sketch binary"


def _tied(batches: Iterator[pd.DataFrame], steps: list[tuple[int, int]], far: int) -> Iterator[pd.DataFrame]:
    """Ties (a, b) of sorted paths with sketches; and, without b, the leaders of pieces whose node may go on elsewhere."""
    task = TaskContext.get().partitionId() << 32
    node, open_at_start, pieces = None, True, 0
    ids, paths, sketches = [], [], []

    def done(more: bool) -> list[tuple]:
        nonlocal pieces
        pieces += 1
        values = np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, SKETCH)
        ties, leaders = matched(paths, values, steps, far) if len(ids) > 1 else ([], np.arange(len(ids)))
        out = [(ids[a], ids[b], None, None, None, None) for a, b in ties]
        if more or open_at_start:
            out += [(ids[k], None, *node, task + pieces, sketches[k]) for k in leaders]
        return out

    for pdf in batches:
        out = []
        for tree, path, set_id, sketch in zip(pdf["tree"], pdf["path"], pdf["set_id"], pdf["sketch"]):
            here = (tree, path[:8])
            if node != here or len(ids) >= PIECE:
                if ids:
                    out += done(node == here)
                open_at_start = node is None or node == here
                node, ids, paths, sketches = here, [], [], []
            ids.append(set_id), paths.append(path), sketches.append(sketch)
        if out:
            yield pd.DataFrame(out, columns=["a", "b", "tree", "top", "piece", "sketch"])
    if ids:
        yield pd.DataFrame(done(True), columns=["a", "b", "tree", "top", "piece", "sketch"])


def _tied_leaders(batches: Iterator[pd.DataFrame], far: int) -> Iterator[pd.DataFrame]:
    """Ties between two blocks of leaders of one node; rows of one (tree, top, i, j) follow each other."""
    unit, ids, blocks, sketches = None, [], [], []

    def done() -> list[tuple]:
        values, block = np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, SKETCH), np.array(blocks)
        group, ties = np.arange(len(ids)), []
        others = np.flatnonzero(block == unit[3])
        for lead in np.flatnonzero(block == unit[2]):
            if (group[others] == group[lead]).all():
                continue
            near = others[(values[others] != values[lead]).sum(1) <= far]
            new, first = np.unique(group[near], return_index=True)
            for g, k in zip(new, first):
                if g != group[lead]:
                    ties.append((ids[near[k]], ids[lead]))
                    group[group == g] = group[lead]
        return ties

    for pdf in batches:
        out = []
        for set_id, tree, top, block, i, j, sketch in zip(*(pdf[c] for c in ("a", "tree", "top", "block", "i", "j", "sketch"))):
            if unit != (tree, top, i, j):
                if ids:
                    out += done()
                unit, ids, blocks, sketches = (tree, top, i, j), [], [], []
            ids.append(set_id), blocks.append(block), sketches.append(sketch)
        if out:
            yield pd.DataFrame(out, columns=["a", "b"])
    if ids and (out := done()):
        yield pd.DataFrame(out, columns=["a", "b"])


def candidate_ties(sets: DataFrame, n_sets: int, trees: int, floor: int, deepest: int, threshold: float, recall: float, scratch: Scratch) -> DataFrame:
    """(a, b): ties of n_sets sets(set_id, paths, sketch) whose components hold every linked pair, with the recall; read from scratch."""
    width, far, steps = 8 + deepest - floor, reach(threshold, recall), levels(floor, deepest)
    trie = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.substring("paths", t * width + 1, F.lit(width)))
    every = sets.select("set_id", F.posexplode(trie).alias("tree", "path"))
    most = trees * n_sets
    shared = scratch.table(_by_path(every).mapInPandas(_accompanied, "set_id binary, tree int, path binary"), most)
    sketched = scratch.table(shared.join(sets.select("set_id", "sketch"), "set_id"), most)
    found = scratch.table(_by_path(sketched).mapInPandas(lambda b: _tied(b, steps, far), NODE), most)

    open_ = found.filter("b IS NULL").drop("b")
    sized = open_.groupBy("tree", "top").agg(F.count(F.lit(1)).alias("leaders"), F.count_distinct("piece").alias("pieces")).filter("pieces > 1")
    sized = scratch.table(sized.select("tree", "top", F.ceil(F.col("leaders") / PIECE).cast("int").alias("blocks")), n_sets)
    units = (
        open_.join(sized, ["tree", "top"])
        .withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("a", "tree", "top", "block", "sketch", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    )
    units = units.repartition("tree", "top", "i", "j").sortWithinPartitions("tree", "top", "i", "j", "a")
    between = units.mapInPandas(lambda b: _tied_leaders(b, far), "a binary, b binary")
    return found.filter("b IS NOT NULL").select("a", "b").union(between)


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, root) of the graph with edges (a, b): the smallest node that each reaches.

    Alternates large-star and small-star steps; the edges of each round are a
    table of their own, and the tables of the round before are deleted. A star is
    one row for each edge, however large it is; both sides of a join are written
    before it, so Spark can split a hot star. most: edges, at most, where that is known. It ends when the large star moves no
    edge and no node has two smaller neighbours: then every component is a star.
    """
    spark = edges.sparkSession
    held = Scratch(spark)
    edges = held.table(edges.filter("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), most)
    rows = 2 * edges.count()  # no step makes more edges, or nodes, than this
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        work = Scratch(spark)
        least = work.table(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), rows)
        # Large star: neighbours above a node move to its smallest neighbour.
        moves = both.filter("b > a").join(least, "a").selectExpr("b AS a", "m AS b", "m <> a AS moved")
        large = work.table(moves.groupBy("a", "b").agg(F.max("moved").alias("moved")), rows)
        # Small star: a node and its smaller neighbours move to the smallest of these.
        low = work.table(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("smaller"), F.max("moved").alias("moved")), rows)
        if low.filter("moved OR smaller > 1").isEmpty():
            found = materialize(edges.selectExpr("a AS node", "b AS root").union(edges.selectExpr("b AS node", "b AS root").distinct()), rows)
            work.drop(), held.drop()
            return found
        small = large.select("a", "b").join(low.select("a", "m"), "a").filter("b <> m").selectExpr("b AS a", "m AS b")
        after = Scratch(spark)
        edges = after.table(small.union(low.selectExpr("a", "m AS b")).distinct(), rows)
        work.drop(), held.drop()
        held = after


# Verification


def _links(sets: list[np.ndarray], weights: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Weighted link counts, and for each set the smallest position that links inside the unit lead to.

    left and right are positions of the two blocks. n-grams that only one set has can't be shared and are left out.
    """
    every, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = counts[inverse] > 1
    column = (np.cumsum(counts > 1) - 1)[inverse[shared]]
    of, width = of[shared], int((counts > 1).sum())
    size = np.array([len(s) for s in sets], np.int64)
    starts = np.searchsorted(of, np.arange(len(sets) + 1))
    linked, label = np.zeros(len(sets), np.int64), np.arange(len(sets))
    scale = 1_000_000
    least = int(round(threshold * scale))
    tile = 256

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros((len(a), len(b)), np.float32)
        # Columns in stretches, so that the dense tiles stay bounded for long texts.
        for c in range(0, width, 16384):
            dense = []
            for rows in (a, b):
                m = np.zeros((len(rows), min(16384, width - c)), np.float32)
                for k, r in enumerate(rows):
                    cols = column[starts[r] : starts[r + 1]]
                    m[k, cols[(cols >= c) & (cols < c + 16384)] - c] = 1
                dense.append(m)
            out += dense[0] @ dense[1].T
        return out

    for i in range(0, len(left), tile):
        a = left[i : i + tile]
        for j in range(i if same else 0, len(right), tile):
            b = right[j : j + tile]
            both = common(a, b).astype(np.int64)
            hit = both * scale >= least * (size[a][:, None] + size[b][None, :] - both)
            if same and i == j:
                hit &= ~np.eye(len(a), dtype=bool)
            linked[a] += hit @ weights[b]
            if not (same and i == j):
                linked[b] += hit.T @ weights[a]
            # Every hit joins two labels; as a group grows together few different pairs of labels are left.
            x, y = np.nonzero(hit)
            for pair in np.unique(label[a[x]] * len(sets) + label[b[y]]).tolist():
                p, q = (int(label[k]) for k in divmod(pair, len(sets)))
                if p != q:
                    label[label == max(p, q)] = min(p, q)
    return linked, label


def jaccard_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 5,
    threshold: float = 0.8,
    trees: int = 32,
    deepest: int = 12,
    recall: float = 0.99999,
) -> DataFrame:
    """One row for each row of docs: doc_id, class_id, class_size, n_links, grams.

    Two rows are linked if the Jaccard similarity of their sets of word n-grams
    is at least the threshold; n_links counts a row's linked rows, class_id is
    the smallest doc_id that links lead to, and class_size its number of rows.
    Words are separated by ASCII white space. A text of fewer than n words is one
    n-gram. A null, empty or blank text has no n-grams and no links: it is a
    class of its own (class_id is its id, class_size 1). Rows with null ids are
    linked too, but name a class only where all its ids are null. Repeated rows
    are linked to each other.
    """
    floor = depth_for(threshold, trees, deepest, recall)
    rows = materialize(signed(docs, n, trees, floor, deepest, id_col, text_col))
    sets = materialize(
        rows.filter("set_id IS NOT NULL").groupBy("set_id").agg(
            F.count(F.lit(1)).alias("weight"), F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "text_key")).alias("of"),
            F.min("grams").alias("grams"), F.min("paths").alias("paths"), F.min("sketch").alias("sketch"),
        ),
        rows.count(),
    )
    n_sets = sets.count()
    with Scratch(docs.sparkSession) as scratch:
        member = components(candidate_ties(sets, n_sets, trees, floor, deepest, threshold, recall, scratch), trees * n_sets)

    sized = member.join(sets.select(F.col("set_id").alias("node"), "weight", "of", "grams"), "node")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("grams") / BLOCK_GRAMS)).cast("int")
    placed = materialize(sized, n_sets).join(materialize(sized.groupBy("root").agg(blocks.alias("blocks")), n_sets), "root")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # The text of one row of each set of a component. Ids may be null or repeat, so the text's hash is matched as well.
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    shipped = (
        placed.join(texts, F.col("of.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("of.text_key") == F.col("text_key")))
        .select(F.col("node").alias("set_id"), "weight", "root", "block", "text", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("set_id", "weight", "root", "block", "text", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    )
    parts = shipped.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "set_id")
    found = materialize(parts.mapInPandas(lambda b: _verified(b, n, threshold), "set_id binary, linked long, first binary"))
    classes = components(found.filter("set_id <> first").selectExpr("set_id AS a", "first AS b"), found.count())

    linked = found.groupBy("set_id").agg(F.sum("linked").alias("linked"))
    by_set = materialize(
        sets.select("set_id", "weight", "first_id").join(linked, "set_id", "left")
        .join(classes.withColumnRenamed("node", "set_id"), "set_id", "left")
        .withColumn("root", F.coalesce("root", "set_id")),
        n_sets,
    )
    by_class = materialize(by_set.groupBy("root").agg(F.min("first_id").alias("class_id"), F.sum("weight").alias("class_size")), n_sets)
    # Materialized, so that both sides of the last join are dealt for it alone and Spark can split a hot set's rows.
    by_set = materialize(
        by_set.join(by_class, "root").select("set_id", "class_id", "class_size", (F.col("weight") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")),
        n_sets,
    )
    return rows.select("doc_id", "set_id", "grams").join(by_set, "set_id", "left").select(
        "doc_id",
        F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        "grams",
    )


def _verified(batches: Iterator[pd.DataFrame], n: int, threshold: float) -> Iterator[pd.DataFrame]:
    """Units of work, one after the other: rows of one (root, i, j) follow each other."""
    known = _WordHash()
    unit, rows = None, []

    def done() -> pd.DataFrame:
        seen: dict[bytes, tuple] = {}
        for set_id, weight, block, grams in rows:  # of rows with the same id, the one whose set it is
            if blake2b(grams.tobytes(), digest_size=16).digest() == set_id:
                seen[set_id] = (weight, block, grams)
        ids = list(seen)
        block = np.array([seen[x][1] for x in ids])
        left, right = np.flatnonzero(block == unit[1]), np.flatnonzero(block == unit[2])
        linked, label = _links([seen[x][2] for x in ids], np.array([seen[x][0] for x in ids]), left, right, unit[1] == unit[2], threshold)
        return pd.DataFrame({"set_id": ids, "linked": linked, "first": [ids[k] for k in label]})

    for pdf in batches:
        out = []
        for set_id, weight, root, block, text, i, j in zip(pdf["set_id"], pdf["weight"], pdf["root"], pdf["block"], pdf["text"], pdf["i"], pdf["j"]):
            if unit != (root, i, j):
                if len(rows) > 0:
                    out.append(done())
                unit, rows = (root, i, j), []
            rows.append((set_id, weight, block, shingles(text or "", n, known)))
        if out:
            yield pd.concat(out)
    if rows:
        yield done()


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of docs that name their class, one for each class, with all their columns.

    ids should be distinct (deduplicate first); rows that share the naming id all stay.
    """
    kept = jaccard_classes(docs, id_col, text_col, **settings).filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["__id"]), "left_semi").select(*docs.columns)
