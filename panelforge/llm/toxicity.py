"""Toxicity: a factorization machine over hashed terms.

The score of a text is ``sigmoid(b + sum w_j + sum_{j<k} <v_j, v_k>)`` over the
distinct hashed terms it contains, so a pair of terms can weigh more, or less,
than its two terms alone.

Learning uses a bounded sample of labelled rows (``Settings.sample``), chosen by
a hash of the id. Spark hashes the terms, counts them over the sample and keeps
the ``Settings.features`` buckets with the largest chi-square. A word that tells
something only beside another would not be among them, so pairs of near words
are counted too, and both words of the ``Settings.pairs`` pairs with the largest
chi-square are kept. The driver gets only these buckets and fits the machine
with Adagrad. Scoring reads every whole text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_row, materialize

# Bytes that are part of a term: letters of ASCII, lower-cased, and all of other characters.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


#: Files that the sample is written in, at most.
SAMPLE_FILES = 24


@dataclass(frozen=True)
class Settings:
    """sample: labelled rows learned from, at most. least: documents of the sample that a bucket must occur in.
    pairs: pairs of words at most ``window`` apart whose words are kept, out of the ``candidates`` pairs
    that the most documents with label 1 have."""

    sample: int = 12_000
    bits: int = 20
    features: int = 1024
    least: int = 6
    pairs: int = 128
    window: int = 3
    candidates: int = 50_000
    factors: int = 6
    epochs: int = 30
    batch: int = 128
    rate: float = 0.1
    l1: float = 2e-4
    l2: float = 1e-4
    seed: int = 7


@dataclass(frozen=True)
class Model:
    buckets: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray
    bits: int

    def score(self, rows: list[list[int]]) -> np.ndarray:
        """rows: for each text the positions of its known buckets."""
        n = np.array([len(r) for r in rows])
        flat = np.fromiter((i for r in rows for i in r), np.int64, int(n.sum()))
        of = np.repeat(np.arange(len(rows)), n)
        z = self.bias + np.bincount(of, self.weight[flat], len(rows))
        for v in self.factor.T:
            s = np.bincount(of, v[flat], len(rows))
            z += 0.5 * (s * s - np.bincount(of, v[flat] ** 2, len(rows)))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def words(text: str) -> set[bytes]:
    return set(text.encode("utf-8", "replace").translate(TERM_BYTES).split())


#: Besides a word, its beginnings of so many bytes are terms, so that unseen forms of a learned stem count.
STEMS = range(4, 10)


def buckets_of(word: bytes, bits: int) -> list[int]:
    """Hashed terms of a word: itself, marked by a space at its end, and its stems."""
    mask = (1 << bits) - 1
    return [zlib.crc32(word + b" ") & mask, *(zlib.crc32(word[:k]) & mask for k in STEMS if k <= len(word))]


def pairs_of(text: str, bits: int, window: int) -> np.ndarray:
    """Distinct pairs of different words at most window apart, as small bucket << bits | large bucket."""
    mask = (1 << bits) - 1
    at = np.array([zlib.crc32(w + b" ") & mask for w in text.encode("utf-8", "replace").translate(TERM_BYTES).split()], np.int64)
    near = [(np.minimum(x, y) << bits) | np.maximum(x, y) for k in range(1, min(window + 1, len(at))) for x, y in [(at[:-k], at[k:])]]
    pairs = np.unique(np.concatenate(near)) if near else np.empty(0, np.int64)
    return pairs[pairs >> bits != pairs & mask]


def chi_square(n: float, p: float) -> Column:
    """Of the columns df and pos, documents and those with label 1, out of n documents with p of label 1."""
    a, b = F.col("pos"), F.col("df") - F.col("pos")
    return n * F.pow(a * (n - p - b) - b * (p - a), 2) / (p * (n - p + 1e-9) * F.col("df") * (n - F.col("df") + 1e-9))


def telling_pairs(sample: DataFrame, n: float, p: float, s: Settings) -> set[int]:
    """Buckets of the words of the s.pairs pairs with the largest chi-square in sample(text, toxic)."""

    def counted(wanted: np.ndarray | None):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = [pairs_of(t, s.bits, s.window) for t in pdf["text"]]
                rows = rows if wanted is None else [r[np.isin(r, wanted)] for r in rows]
                yield pd.DataFrame({"pair": np.concatenate([*rows, np.empty(0, np.int64)]), "toxic": np.repeat(pdf["toxic"].to_numpy(), [len(r) for r in rows])})

        return lambda df: df.mapInPandas(run, "pair long, toxic int")

    often = counted(None)(sample.filter("toxic = 1")).groupBy("pair").count().filter(F.col("count") >= s.least).orderBy(F.desc("count"), "pair").limit(s.candidates)
    wanted = np.sort(np.array([r.pair for r in often.collect()], np.int64))  # s.candidates numbers at most
    best = (
        counted(wanted)(sample).groupBy("pair").agg(F.count(F.lit(1)).alias("df"), F.sum("toxic").alias("pos"))
        .filter(F.col("pos") * n > F.col("df") * p).orderBy(chi_square(n, p).desc(), "pair").limit(s.pairs)
    )
    return {b for r in best.collect() for b in (r.pair >> s.bits, r.pair & ((1 << s.bits) - 1))}


def held_out(row_id: Column) -> Column:
    """The rows never learned from: crc32 of the id as text is divisible by 5. A null id counts as an empty text."""
    return F.crc32(F.coalesce(row_id.cast("string"), F.lit(""))) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, text, toxic) of at most settings.sample labelled ids outside the held-out fold."""
    ids = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(settings.sample)
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(ids), "doc_id")  # at most settings.sample rows of two numbers


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from labelled documents; with no usable label the model scores everything by its bias, 0.5 at most."""
    bits = settings.bits

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [np.unique(np.array([b for w in words(x) for b in buckets_of(w, bits)], np.int32)) for x in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "text": pdf["text"], "buckets": rows})

    sample = labelled_sample(docs, labels, settings)
    kinds = [sample.schema["doc_id"], T.StructField("toxic", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("buckets", T.ArrayType(T.IntegerType()))]
    # Copies count once: of equal sets of terms the smallest id is learned from.
    rows = sample.mapInPandas(hashed, T.StructType(kinds))
    rows = rows.groupBy(F.xxhash64("buckets").alias("same")).agg(F.min_by(F.struct("doc_id", "toxic", "text", "buckets"), F.struct("doc_id", "text")).alias("r")).select("r.*")
    rows = materialize(rows.coalesce(SAMPLE_FILES))
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("p")).first()
    if whole.n == 0 or whole.p == 0:
        return Model(np.empty(0, np.int64), -4.0 if whole.n else 0.0, np.empty(0), np.empty((0, settings.factors)), bits)
    n, p = float(whole.n), float(whole.p)
    best = (
        rows.select(F.explode("buckets").alias("bucket"), "toxic")
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("df"), F.sum("toxic").alias("pos"))
        .filter(F.col("df") >= settings.least)
        .orderBy(chi_square(n, p).desc(), "bucket")
        .limit(settings.features)
    )
    found = {r.bucket for r in best.select("bucket").collect()} | telling_pairs(rows, n, p, settings)
    buckets = np.array(sorted(found), np.int64)
    chosen = F.array(*[F.lit(int(x)) for x in buckets]) if len(buckets) else F.array().cast("array<int>")
    data = rows.select("doc_id", "toxic", F.array_intersect("buckets", chosen).alias("b")).orderBy("doc_id").collect()
    return _learn([np.searchsorted(buckets, r.b) for r in data], np.array([r.toxic for r in data], float), buckets, settings)


def _learn(rows: list[np.ndarray], y: np.ndarray, buckets: np.ndarray, s: Settings) -> Model:
    rng = np.random.default_rng(s.seed)
    m = len(buckets)
    w, v = np.zeros(m), rng.normal(0, 0.05, (m, s.factors))
    b, gb, gw, gv = float(np.log(y.mean() / (1 - y.mean() + 1e-9))), 1e-6, np.full(m, 1e-6), np.full((m, s.factors), 1e-6)
    for _ in range(s.epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), s.batch):
            part = order[at : at + s.batch]
            n = np.array([len(rows[i]) for i in part])
            flat = np.concatenate([rows[i] for i in part]).astype(np.int64)
            of = np.repeat(np.arange(len(part)), n)
            sums = np.zeros((len(part), s.factors))
            np.add.at(sums, of, v[flat])
            squares = np.zeros_like(sums)
            np.add.at(squares, of, v[flat] ** 2)
            z = b + np.bincount(of, w[flat], len(part)) + 0.5 * (sums**2 - squares).sum(1)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
            gb += g.sum() ** 2
            b -= s.rate * g.sum() / np.sqrt(gb)
            seen, of_seen = np.unique(flat, return_inverse=True)
            dw = np.bincount(of_seen, g[of], len(seen))
            dv = np.zeros((len(seen), s.factors))
            np.add.at(dv, of_seen, g[of][:, None] * (sums[of] - v[flat]))
            dv += s.l2 * v[seen]
            gw[seen] += dw**2
            gv[seen] += dv**2
            step = s.rate / np.sqrt(gw[seen])
            w[seen] -= step * dw
            w[seen] = np.sign(w[seen]) * np.maximum(np.abs(w[seen]) - step * s.l1, 0)
            v[seen] -= s.rate * dv / np.sqrt(gv[seen])
    return Model(buckets, b, w, v, s.bits)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score_col, 0 to 1, of every whole text.

    A null text is scored like an empty one, by the bias. Equal texts get equal
    scores. Other columns pass through; a column named score_col is replaced.
    """
    base = docs.drop(score_col)
    shared = base.sparkSession.sparkContext.broadcast(model)  # settings.features rows at most

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        place = {int(x): i for i, x in enumerate(m.buckets)}
        known: dict[bytes, tuple[int, ...]] = {}

        def look(word: bytes) -> tuple[int, ...]:
            if len(known) > 80_000:
                known.clear()
            known[word] = at = tuple(place[b] for b in buckets_of(word, m.bits) if b in place)
            return at

        for texts in batches:
            rows = []
            for text in texts:
                rows.append(sorted({i for w in words(text or "") for i in (known[w] if w in known else look(w))}))
            yield pd.DataFrame({"score": m.score(rows)})

    return base.withColumn(score_col, by_row(base, run, "score double")(F.col(text_col))["score"])


def toxicity_scores(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; 1 is predicted from a score of 0.5."""
    model = fit(docs, labels, settings)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
