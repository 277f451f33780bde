"""Exact dedup, mixing and secrets against their SQL, on the tables and on awkward rows."""

import duckdb
import pytest
from panelforge.llm import exact_dedup, mixing, queries, secrets
from pyspark.sql import functions as F

from tests.compare import assert_same, connect
from tests.llm import fixtures

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name])


def small(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    return con


def test_secrets_of_awkward_rows(spark):
    assert_same(secrets.secret_digests(fixtures.docs(spark)), small(fixtures.rows()), secrets.oracle_sql())


def test_secrets_of_a_text_with_many(spark):
    """Time follows the number of matches: 100,000 in one text take seconds."""
    import time

    token = "0123456789abcdef0123456789abcdef"
    text = " ".join([token] * 100_000) + ' é password = "hunter2hunter2" 0f0f'
    docs = spark.createDataFrame([(1, text), (2, token + " " + token), (3, None)], "doc_id long, text string")
    began = time.time()
    rows = {r.doc_id: r for r in secrets.secret_digests(docs).collect()}
    assert time.time() - began < 60
    assert rows[1].n_hex == 100_000 and rows[2].n_hex == 2 and rows[3].spans == ""
    spans = [s for s in rows[1].spans.split(",") if s.startswith("hex:")]
    assert spans == [f"hex:{33 * i}:{33 * i + 32}" for i in range(100_000)]
    assert f"assign:{33 * 100_000 + 2}:{33 * 100_000 + 28}" in rows[1].spans


def test_mixing_of_awkward_rows(spark):
    assert_same(mixing.mix_sources(fixtures.docs(spark)), small(fixtures.rows()), mixing.oracle_sql())


def test_mixing_comes_near_targets_and_repeats_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plan = mixing.mix_sources(docs)
    by = plan.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most"), F.max("copies").alias("copies")).collect()
    assert all(abs(r.taken - r.target) <= r.most / 2 + 1 and r.copies <= 2 for r in by)
    assert mixing.mixed(docs).count() == plan.agg(F.sum("copies")).first()[0]
    assert mixing.mixed(docs).columns == docs.columns


@pytest.mark.parametrize("bins", [1, 4])
def test_mixing_with_few_bins(spark, bins):
    assert_same(mixing.mix_sources(fixtures.docs(spark), bins=bins), small(fixtures.rows()), mixing.oracle_sql())


def test_targets_are_water_filled(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 1000), (None, 50)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes, (5, 2, 1), 1.5, 2.0).collect()}
    # a and null stop at 200 and 100; the other 2925 are shared 2 to 1.
    assert got == {"a": 200.0, None: 100.0, "b": pytest.approx(1950.0), "c": pytest.approx(975.0)}


def brute_dedup(rows):
    import hashlib
    import re

    groups, out = {}, []
    for i, t, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    used = set()
    for i, t, *_ in rows:
        n = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        ids = [x for x in groups[n] if x is not None]
        keep = min(ids) if ids else None
        first = i == keep and (n, keep) not in used
        if first:
            used.add((n, keep))
        out.append((i, keep, len(groups[n]), first, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [lambda c: F.sha2(c, 256), lambda c: F.substring(F.sha2(c, 256), 1, 1)], ids=["sha256", "colliding"])
def test_dedup_compares_content(spark, digest):
    got = exact_dedup.exact_dedup(fixtures.docs(spark), digest=digest).collect()
    assert sorted(map(tuple, got), key=str) == brute_dedup(fixtures.rows())


def test_deduplicate_keeps_one_row_with_all_columns(spark):
    docs = fixtures.docs(spark)
    kept = exact_dedup.deduplicate(docs)
    rows = kept.collect()
    assert kept.columns == docs.columns and len(rows) == sum(r[3] for r in brute_dedup(fixtures.rows()))
    assert all(r[n] == "z" for r in rows for n in docs.columns[5:])


def test_trigram_queries():
    by = {r.kind: secrets.trigram_query(r.pattern) for r in secrets.BASE + secrets.ADDED}
    assert by["hex"] == [] and frozenset({"aki"}) in by["access"]
    assert all(any(t in "api_key" or t in "apikey" for t in clause) for clause in by["assign"])


def test_empty_tables(spark):
    empty = fixtures.docs(spark, []).limit(0)
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert mixing.mix_sources(empty).count() == 0 and mixing.mixed(empty).count() == 0
    assert secrets.secret_digests(empty).count() == 0
