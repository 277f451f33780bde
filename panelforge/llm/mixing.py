"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

DataFrame functions only. Every document gets the exponential key
``-ln(u) / quality``; the smallest keys of a source are a weighted sample
without replacement. ``u`` comes from a digest of seed, id and text, so reruns
agree however the rows are partitioned.

A source may hold a third of all rows, so no source is sorted whole. Keys are
mapped to ``bins`` intervals by ``key / (1 + key)``: at any quality from 0.25 to 1
none holds more than 3 / bins of a source. Sizes are summed by (source, bin), and
prefix sums over these few rows tell which one bin of a source its budget ends
in. That bin is cut into ``bins`` in the same way, and only the keys of the one of
these that the budget ends in are sorted, without texts: they give the source's
cut, the last (key, id) that is taken. Every document then compares itself with
the cut of its source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, materialize, text_or_empty

#: Words are runs of anything but these.
WORD = r"[^\x20\x09-\x0D]+"
#: Letters and marks of any script.
LETTERS = r"[^\p{L}\p{M}]+"


def quality_weight(text: Column) -> Column:
    """0.25 to 1: more for texts with a larger share of letters, of whatever script."""
    letters = F.length(F.regexp_replace(text, LETTERS, ""))
    return F.lit(0.25) + F.lit(0.75) * letters / F.greatest(F.length(text), F.lit(1))


def unit_interval(*parts: Column) -> Column:
    """A number in (0, 1) from a digest of the parts: 48 bits of MD5."""
    digest = F.md5(F.concat_ws("|", *parts))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(2.0**48)


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Targets of sources(source, source_size) by water filling; a row for each source.

    Sources by code point, null last, weigh ``weights``, repeating, and share
    ``share`` times the sum of all sizes. A target stops at ``most`` times its
    source's size and the excess is shared by weight again. The level at which
    that ends has a closed form over sources ordered by cap / weight.
    """
    every = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    table = F.array(*[F.lit(float(w)) for w in weights])
    return (
        sizes.withColumn("weight", F.element_at(table, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
        .withColumn("cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.lit(float(share)) * F.sum("source_size").over(every))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        # The level is that of the first source which it does not fill to the cap.
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"])
        .withColumn("target", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))))
        .select("source", "source_size", F.round("target", 6).alias("target"))
    )


def keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, *more: Column) -> DataFrame:
    """doc_id, source, size and key of each row of docs, and more."""
    text = text_or_empty(text_col)
    u = unit_interval(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text))
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), (-F.log(u) / quality_weight(text)).alias("key"), *more,
    )


def cuts(rows: DataFrame, weights: tuple[float, ...], share: float, most: float, bins: int) -> DataFrame:
    """For each source of rows(doc_id, source, size, key): of, source_size, target, epochs, and its cut.

    Rows whose (key, doc_id) is below (cut_key, cut_id) are taken once more; of
    rows equal to it, ``ties`` of them. cut_key is null where none is.
    """
    place = F.col("key") / (1 + F.col("key")) * bins
    rows, n = rows.withColumn("bin", F.floor(place).cast("int")), rows.count()
    by_bin = materialize(rows.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")), n)
    targets = source_targets(by_bin.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, share, most)
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    targets = targets.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))

    order = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = by_bin.withColumn("before", F.coalesce(F.sum("bin_size").over(order), F.lit(0)))
    edges = materialize(
        sums.alias("s")
        .join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
        .groupBy(F.col("t.source").alias("of"), "source_size", "target", "epochs", "rest")
        .agg(F.max(F.when(F.col("before") < F.col("rest"), F.struct("bin", "before"))).alias("edge")),
        n,
    )
    inside = rows.join(edges, F.col("source").eqNullSafe(F.col("of")) & (F.col("bin") == F.col("edge.bin")))
    inside = materialize(inside.select("of", "rest", "edge", "key", "doc_id", "size", F.floor((place - F.col("bin")) * bins).cast("int").alias("part")), n)

    order = Window.partitionBy("of").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = inside.groupBy("of", "rest", "edge", "part").agg(F.sum("size").alias("part_size"))
    parts = parts.withColumn("start", F.col("edge.before") + F.coalesce(F.sum("part_size").over(order), F.lit(0)))
    ends = materialize(parts.filter(F.col("start") < F.col("rest")).groupBy(F.col("of").alias("by")).agg(F.max(F.struct("part", "start")).alias("end")), n)
    key_order = Window.partitionBy("by").orderBy("key", F.col("doc_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    summed = inside.join(ends, F.col("of").eqNullSafe(F.col("by")) & (F.col("part") == F.col("end.part")))
    summed = summed.withColumn("sum", F.col("end.start") + F.coalesce(F.sum("size").over(key_order), F.lit(0)))
    fits = (F.col("sum") < F.col("rest")) & (F.col("sum") + F.col("size") / 2 <= F.col("rest"))
    at = summed.groupBy("by", "end", "key", "doc_id").agg(F.count_if(fits).alias("ties"))
    last = at.groupBy("by", "end").agg(F.max(F.when(F.col("ties") > 0, F.struct("key", "doc_id", "ties"))).alias("cut"))
    # Where no row fits, the cut is the beginning of the part.
    begin = (F.col("edge.bin") + F.col("end.part") / F.lit(bins)) / F.lit(bins)
    return edges.join(last, F.col("of").eqNullSafe(F.col("by")), "left").select(
        "of", "source_size", "target", "epochs", F.coalesce("cut.key", begin / (1 - begin)).alias("cut_key"), F.col("cut.doc_id").alias("cut_id"), F.coalesce("cut.ties", F.lit(0)).alias("ties")
    )


def planned(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
    bins: int = 4096,
    small: int = 100_000,
    carry: bool = False,
) -> DataFrame:
    """doc_id, source, size, source_size, target and copies of each row of docs; with carry also row, all its columns."""
    # Numbers only: texts are read once for them, and once more where rows are carried.
    slim = materialize(keyed(docs, id_col, text_col, source_col, seed))
    plan = bounded_broadcast(materialize(cuts(slim, weights, share, most, bins), slim.count()), small)
    rows = keyed(docs, id_col, text_col, source_col, seed, F.struct(*docs.columns).alias("row")) if carry else slim
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("of")))
    at_cut = (F.col("key") == F.col("cut_key")) & F.col("doc_id").eqNullSafe(F.col("cut_id")) & (F.col("ties") > 0)
    below = (F.col("key") < F.col("cut_key")) | ((F.col("key") == F.col("cut_key")) & (F.coalesce(F.col("doc_id") < F.col("cut_id"), F.col("doc_id").isNull() & F.col("cut_id").isNotNull())))
    usual = joined.filter(~F.coalesce(at_cut, F.lit(False))).withColumn("extra", F.coalesce(below, F.lit(False)).cast("int"))
    # Usually one row of each source; more only if a row is repeated with its id.
    tied = joined.filter(at_cut).withColumn("nth", F.row_number().over(Window.partitionBy("source").orderBy("size")))
    tied = tied.withColumn("extra", (F.col("nth") <= F.col("ties")).cast("int")).drop("nth")
    both = usual.unionByName(tied).withColumn("copies", F.col("epochs") + F.col("extra"))
    return both.select("doc_id", "source", "size", "source_size", "target", "copies", *(["row"] if carry else []))


def mix_sources(docs: DataFrame, **settings) -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, target, taken, source and copies.

    size is the number of words, 0 for a null or empty text. A source's target
    covers ``floor(target / source_size)`` complete epochs of all its documents;
    the rest goes to documents in key order while at least half of a document
    fits, so a source ends within half a document of its target. taken counts
    words with repeats. A null source is a source of its own. A source without
    words has target 0. Identical rows tie: their order is arbitrary but the
    rows returned are the same. An empty input gives an empty result. Settings
    are those of ``planned``.
    """
    return planned(docs, **settings).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies"
    )


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: rows of docs, with all their columns, as often as they are taken."""
    rows = planned(docs, carry=True, **settings).filter("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def oracle_sql(weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> str:
    cases = " ".join(f"WHEN {i} THEN {w}.0" for i, w in enumerate(weights))
    return rf"""
WITH t AS (
  SELECT doc_id, source, coalesce(text, '') AS text FROM documents
), d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    -ln((CAST('0x' || substr(md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(text)), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0::DOUBLE)
      / (0.25 + 0.75 * length(regexp_replace(text, '[^\p{{L}}\p{{M}}]+', '', 'g'))::DOUBLE / greatest(length(text), 1)) AS key
  FROM t
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(weights)} {cases} END::DOUBLE AS weight,
    {most}::DOUBLE * source_size AS cap, {share}::DOUBLE * sum(source_size) OVER () AS total FROM s
), r AS (
  SELECT *, cap / weight AS ratio FROM w
), l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM r
), v AS (
  SELECT (SELECT lev FROM l WHERE lev <= ratio ORDER BY ratio LIMIT 1) AS level
), g AS (
  SELECT source, source_size, round(CASE WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END, 6) AS target FROM l, v
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM g
), c AS (
  SELECT d.doc_id, d.size, d.source, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * (epochs + CASE WHEN before < rest AND before + size / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken, source,
  CAST(epochs + CASE WHEN before < rest AND before + size / 2.0 <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM c
"""
