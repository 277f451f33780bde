"""Divergence of sources, whitening and nearest neighbours against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from panelforge.llm import divergence, nearest, queries, whitening
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.compare import assert_same, connect
from tests.llm import fixtures

SF = "/root/testdata/sf0.01"


# Divergence of sources


def brute_audit(rows, least=10, top=10):
    """rows of (lang, source, text); the contract word by word, in Python's numbers."""
    rows = [tuple(x or "" for x in r) for r in rows]
    texts = [(lang, source, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        here = [t for t in texts if t[0] == lang]
        docs = Counter(w for _, _, words in here for w in set(words))
        kept = sorted(w for w, n in docs.items() if n >= least)
        counts = defaultdict(Counter)
        for _, source, words in here:
            counts[source].update(w for w in words if docs[w] >= least)

        def shares(c):
            n = sum(c.values())
            return [1 + 10**9 * (c[w] + 2) // (n + 2 * len(kept)) for w in kept]

        p, q = {s: shares(c) for s, c in counts.items()}, shares(sum(counts.values(), Counter()))
        f = lambda a, b: (a - b) * (a - b) // (a + b)
        for s in counts:
            pairs = [(o, sum(map(f, p[s], p[o]))) for o in counts if o != s]
            terms = [(w, f(a, b)) for w, a, b in zip(kept, p[s], q) if counts[s][w] > 0 and a > b]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, w, v, i + 1) for i, (w, v) in enumerate(found[:most])]
    return sorted(out)


def audited(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def test_divergence_like_sql(spark):
    assert_same(queries.op11_source_divergence(spark, SF), connect(SF), divergence.oracle_sql())


def test_divergence_of_many_sources(spark):
    """Several blocks of groups and slices of terms; terms of all sources, of half, of a few and of one."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(700):
        source = f"s{i % 300:03d}"
        words = [f"all{chr(97 + k)}" for k in rng.integers(0, 20, 12)] + [f"half{chr(97 + i % 2)}"] * int(rng.integers(1, 4)) + [f"few{chr(97 + k)}" for k in rng.integers(0, 26, 2)]
        rows.append(("en", source, " ".join(words + (["Lone"] * 3 if i % 300 == 7 else []))))
    rows += [("en", "s007", "lone LONE lone")] * 12 + [("fr", "only", "mot mot")] * 10 + [("", "", ""), ("de", "a", "zwei"), ("de", "b", "")]
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    want = brute_audit(rows)
    for small in (100_000, 0):  # groups broadcast, or joined by a shuffle
        assert audited(divergence.audit(df, per_slice=8, small=small, per_piece=50)) == want


def test_divergence_of_awkward_rows(spark):
    docs = fixtures.docs(spark)
    rows = [(r.lang, r.source, r.text) for r in docs.collect()]
    assert audited(divergence.audit(docs, least=3)) == brute_audit(rows, least=3)
    assert divergence.audit(docs.limit(0)).collect() == []


def test_shares_beyond_a_long(spark):
    """The product of a count and the unit needs more than 64 bits."""
    big = 9 * 10**15
    r = spark.createDataFrame([(big, big * 3, 5)], "n long, total long, kept long").select(divergence.share(F.col("n"), F.col("total"), F.col("kept")).alias("p")).first()
    assert r.p == 1 + 10**9 * (big + 2) // (big * 3 + 10)


# Vectors

#: Names that the operators use inside.
CLASHING = ("x", "dim", "n", "component", "class", "hash", "vector", "asks", "of", "members", "kept", "own", "others", "query", "score", "rank")
VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))] + [T.StructField(c, T.StringType()) for c in CLASHING])
BIG = 2**53 + 1


def vectors():
    rng = np.random.default_rng(8)
    v = [[float(np.float32(x)) for x in rng.normal(size=5)] for _ in range(60)]
    out = [(i, x) for i, x in enumerate(v)]
    out += [(100 + i, v[3]) for i in range(40)] + [(20, v[20]), (20, v[20]), (None, v[3]), (None, v[4]), (BIG, v[5]), (160, [0.0] * 5)]
    out += [(200, None), (201, []), (220, [1.0, None, 0.0, 0.0, 0.0]), (240, [float("nan")] * 5), (260, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (280, [1.0, 2.0]), (300, [-1.5, 0.25]), (301, [0.5, 0.5]), (320, [2.0])]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, x, *("z" * len(CLASHING))) for i, x in rows], VECTORS).repartition(3)


def usable(x, zero=True):
    return x is not None and all(c is not None and np.isfinite(c) for c in x) and (zero or any(x))


def check_whitened(rows, given, components=4):
    by_row = defaultdict(list)
    for r in rows:
        by_row[r.component].append(r)
    for dim in sorted({len(x) for _, x in given if usable(x)}):
        own = [(i, [int(c) for c in np.floor(256 * np.array(x, float))]) for i, x in given if usable(x) and len(x) == dim]
        fit = sorted({tuple(x) for _, x in own})
        n, sums = len(fit), [sum(c) for c in zip(*fit)]
        if n < 2 or not dim:
            continue
        centred = np.array([[n * c - s for c, s in zip(x, sums)] for x in fit], float) / n
        value, vector = np.linalg.eigh(centred.T @ centred / n)
        for k in range(1, min(components, dim) + 1):
            got = sorted((r for r in by_row[k] if r.n == n), key=lambda r: (str(r.vec_id), r.deviation, r.whitened))
            y = {tuple(x): float((np.array([n * c - s for c, s in zip(x, sums)], float) / n) @ vector[:, -k] / value[-k] ** 0.5) for _, x in own}
            best = []
            for sign in (1, -1):
                want = sorted(((str(i), sum((n * c - s) ** 2 for c, s in zip(x, sums)), sign * y[tuple(x)]) for i, x in own))
                best.append(len(want) == len(got) and all(str(g.vec_id) == i and g.deviation == d and abs(g.whitened - w) < 1e-9 for g, (i, d, w) in zip(got, want)))
            assert any(best)
            assert all(abs(g.explained / (value[-k] / value.sum()) - 1) < 1e-9 and g.identity_error < 1e-9 for g in got)


def test_whitening_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = queries.op12_embedding_whitening(spark, SF).collect()
    assert len(rows) == 4 * df.count()
    check_whitened(rows, [(r.vec_id, r.embedding) for r in df.collect()])


def test_whitening_of_awkward_rows(spark):
    given = vectors()
    rows = whitening.whitened(frame(spark, given)).collect()
    check_whitened(rows, given)
    assert BIG in {r.vec_id for r in rows} and sum(r.vec_id is None for r in rows) == 8
    # Three vectors of length 2; one of length 1, whose only component has no variance.
    assert sorted(Counter(r.n for r in rows).items()) == [(3, 6), (len({tuple(x) for _, x in given if usable(x) and len(x) == 5}), 4 * sum(usable(x) and len(x) == 5 for _, x in given))]
    assert whitening.whitened(frame(spark, [])).collect() == []


def test_whitening_with_many_tiles(spark):
    rng = np.random.default_rng(1)
    given = [(i, [float(c) for c in x]) for i, x in enumerate(rng.normal(size=(300, 70)) @ rng.normal(size=(70, 70)))]
    df = spark.createDataFrame(given, "vec_id long, embedding array<double>").repartition(4)
    check_whitened(whitening.whitened(df).collect(), given)


def test_whitening_of_large_numbers(spark):
    """Deviations are exact beyond 64 bits on the way, and null where the result is."""
    given = [(i, [float(c) * 2.0**30 for c in (i, i % 3, 1)]) for i in range(6)]
    rows = whitening.whitened(spark.createDataFrame(given, "vec_id long, embedding array<double>")).collect()
    sums = [sum(int(256 * x[k]) for _, x in given) for k in range(3)]
    true = {i: sum((6 * int(256 * c) - s) ** 2 for c, s in zip(x, sums)) for i, x in given}
    assert len(rows) == 12 and all(r.deviation == (true[r.vec_id] if true[r.vec_id] < 2**63 else None) for r in rows)
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<double>")
    assert {r.vec_id for r in whitening.whitened(huge).collect()} == {1, 2, 3}


@pytest.mark.parametrize("bits,axes", [(1, 1), (3, 2), (2, 4), (5, 1), (2, 3)])
def test_hilbert_steps(bits, axes):
    """Every cell has a place of its own, and neighbours in order are neighbouring cells."""
    cells = np.indices((1 << bits,) * axes).reshape(axes, -1).T
    place = nearest.hilbert(cells, bits)
    assert sorted(place) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def brute_nearest(given, k=20):
    use = [(i, np.array(x, float)) for i, x in given if usable(x, zero=False)]
    out = []
    for at, (q, x) in enumerate(use):
        if q is not None and q % 20 == 0:
            found = sorted((-round(float((x * y).sum()), 12), i is None, i or 0) for j, (i, y) in enumerate(use) if j != at and len(y) == len(x))[:k]
            out += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(found)]
    return sorted(out, key=str)


def test_neighbours_of_awkward_rows(spark):
    """All candidates are within the least window here: results are exact."""
    given = vectors()
    got = nearest.search(frame(spark, given), F.col("vec_id") % 20 == 0).collect()
    assert sorted([(r.query_id, r["rank"], r.vec_id, round(r.score, 12)) for r in got], key=str) == brute_nearest(given)
    assert nearest.search(frame(spark, []), F.col("vec_id") % 20 == 0).collect() == []
    assert nearest.search(frame(spark, [(20, [1.0, 2.0])]), F.col("vec_id") % 20 == 0).collect() == []
    extreme = [(0, [1e300, 1e300]), (20, [1e-300, 1e-310]), (40, [1.0, -1.0])]
    rows = nearest.search(spark.createDataFrame(extreme, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    assert Counter(r.query_id for r in rows) == {0: 2, 20: 2, 40: 2}


def recall(rows, x, ids, queries, k=20):
    got = defaultdict(list)
    for r in rows:
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    hits = 0
    for at in queries:
        s = x @ x[at]
        s[at] = -np.inf
        best = np.lexsort((ids, -s))[:k]
        mine = sorted(got[ids[at]])
        assert [m[0] for m in mine] == list(range(1, k + 1)) and ids[at] not in [m[1] for m in mine]
        assert all(abs(score - s[np.flatnonzero(ids == i)[0]]) < 1e-12 for _, i, score in mine)
        hits += len({m[1] for m in mine} & set(ids[best]))
    return hits / (k * len(queries))


def test_recall_of_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    x, ids = np.stack(df.embedding.to_numpy()).astype(float), df.vec_id.to_numpy()
    rows = queries.op13_hilbert_neighbours(spark, "/root/testdata/sf0.1").collect()
    assert recall(rows, x, ids, np.flatnonzero(ids % 20 == 0)) >= 0.9


def test_recall_of_clusters_and_norms(spark):
    """Near neighbours, norms from 0.1 to 10, copies; small blocks, many parts: windows reach over several of them."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 6000)] + 0.3 * rng.normal(size=(6000, 16))
    x *= np.exp(rng.uniform(-1, 1, 6000))[:, None]
    x[1000:1400] = x[20]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(6)
    small = nearest.Settings(block=200, queries=50)
    rows = nearest.search(df, F.col("vec_id") % 20 == 0, settings=small).collect()
    ids = np.arange(6000)
    assert recall(rows, x, ids, np.flatnonzero(ids % 20 == 0)) >= 0.9
    twins = [r.vec_id for r in sorted((r for r in rows if r.query_id == 1200), key=lambda r: r["rank"])]
    far = x @ x[1200] > x[1200] @ x[1200] + 1e-9
    assert far.sum() >= 20 or twins[far.sum() :] == [20, *range(1000, 1040)][: 20 - far.sum()]
