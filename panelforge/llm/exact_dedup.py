"""Exact deduplication that survives hot groups: local, salted and global combining.

DataFrame functions only. The stages:

1. *local and salted*: rows are grouped by (digest, content, salt). Spark's
   partial aggregation removes repeats inside each input partition before the
   shuffle, and the salt spreads what is left of a hot group.
2. *global*: the salt winners, a few rows for each content, meet by digest and
   are grouped by (digest, content).

Both stages group by the whole content, so a digest collision cannot merge two
texts. The per-digest table then knows how many different contents a digest
has. With one, the digest alone identifies the content for the final join and
no text moves again; documents of a digest with several contents are joined by
digest and content.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

#: A single space is left as it is, so that the usual text needs no replacement.
WHITESPACE_RUN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalized(text: Column) -> Column:
    """Each run of spaces and control white space becomes one space."""
    return F.regexp_replace(text, WHITESPACE_RUN, " ")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 16,
    digest: Callable[[Column], Column] = lambda c: F.sha2(c, 256),
) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after white-space runs are collapsed. Of equal
    texts the smallest id stays. A null text counts as empty; empty texts are
    equal to each other. A null id is larger than any other: keep_id is null only
    where a whole group has null ids. Rows that repeat both id and text get the
    same values, but only one of them is kept. Other columns of docs are ignored.
    An empty input gives an empty result.
    """
    content = normalized(text_or_empty(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), content.alias("content")).withColumn("digest", digest(F.col("content")))

    salted = (
        rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
        .groupBy("digest", "content", "salt")
        .agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    )
    groups = (
        salted.repartition("digest")
        .groupBy("digest", "content")
        .agg(F.min("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    )
    per_digest = materialize(
        groups.groupBy("digest").agg(
            F.count(F.lit(1)).alias("contents"), F.min("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")
        )
    )
    collided = per_digest.filter("contents > 1").select("digest")
    one = per_digest.filter("contents = 1").drop("contents")
    joined = rows.select("doc_id", "digest", F.sha2("content", 256).alias("text_sha256")).join(one, "digest")
    if not collided.isEmpty():
        several = rows.join(collided, "digest", "left_semi").join(groups, ["digest", "content"])
        joined = joined.unionByName(several.withColumn("text_sha256", F.sha2("content", 256)).drop("content"))

    # Rows repeated with their id: number them, in partitions dealt by id and text, so that a hot text is spread.
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    number = F.row_number().over(Window.partitionBy("doc_id", "text_sha256").orderBy("group_size"))
    return joined.repartition("doc_id", "text_sha256").select(
        "doc_id", "keep_id", "group_size", (stays & (number == 1)).alias("kept"), "text_sha256"
    )


def row_key(row_id: Column, sha: Column) -> Column:
    return F.concat_ws("|", F.coalesce(row_id.cast("string"), F.lit("null")), sha)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Rows are matched by id and text, so ids may repeat with different texts.
    """
    kept = exact_dedup(docs, id_col, text_col).filter("kept").select(row_key(F.col("doc_id"), F.col("text_sha256")).alias("key"))
    # The row goes through as one struct, so its columns may have any names.
    keyed = docs.select(F.struct(*docs.columns).alias("row"), row_key(F.col(id_col), F.sha2(normalized(text_or_empty(text_col)), 256)).alias("key"))
    number = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    return keyed.join(kept, "key", "left_semi").withColumn("nth", number).filter("nth = 1").select("row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS content FROM documents
), g AS (
  SELECT content, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY content
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.content) AS text_sha256
FROM d JOIN g ON d.content = g.content
"""
