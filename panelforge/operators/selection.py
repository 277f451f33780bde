"""Top-k selection: sleeves with quotas, disjoint buckets, pools and arms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = ("short", "mid", "long")


def select_sleeves(scored: DataFrame, quota: dict[str, int], *group: str) -> DataFrame:
    """Per sleeve the best quota rows, then what is missing from all leftovers; adds rank within the group.

    Order is score descending, ticker ascending; null scores are skipped.
    """
    order = [F.desc("score"), F.asc("ticker")]
    limit = reduce(lambda c, kv: c.when(F.col("sleeve") == kv[0], kv[1]), quota.items(), F.when(F.lit(False), 0)).otherwise(0)
    every = Window.partitionBy(*group)
    # Leftovers fill at most the sum of the quotas: a row further down than its sleeve's quota and that can't be picked.
    out = scored.filter("score IS NOT NULL").withColumn("__r", F.row_number().over(Window.partitionBy(*group, "sleeve").orderBy(*order))).filter(F.col("__r") <= max(quota.values()) + sum(quota.values()))
    out = out.withColumn("__taken", F.col("__r") <= limit)
    out = out.withColumn("__short", sum(quota.values()) - F.sum(F.col("__taken").cast("int")).over(every))
    out = out.withColumn("__l", F.row_number().over(Window.partitionBy(*group, "__taken").orderBy(*order)))
    out = out.filter(F.col("__taken") | (F.col("__l") <= F.col("__short")))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).drop("__r", "__taken", "__short", "__l")


def disjoint_buckets(scored: dict[str, DataFrame], quota: dict[str, int], *group: str) -> DataFrame:
    """Buckets are filled in order; a ticker taken by one isn't open to the next."""
    used, out = None, None
    for bucket, rows in scored.items():
        if used is not None:
            rows = rows.join(used, [*group, "ticker"], "left_anti")
        picked = select_sleeves(rows, quota, *group)
        keys = picked.select(*group, "ticker")
        used = keys if used is None else used.union(keys)
        out = picked if out is None else out.unionByName(picked)
    return out


def disjoint_top(scored: DataFrame, n: int, order: list[Column], *group: str) -> DataFrame:
    """Top n of each bucket in turn from one table with a bucket column, without tickers already taken."""
    used, out = None, None
    for bucket in BUCKETS:
        rows = scored.filter(F.col("bucket") == bucket)
        if used is not None:
            rows = rows.join(used, [*group, "ticker"], "left_anti")
        picked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= n)
        keys = picked.select(*group, "ticker")
        used = keys if used is None else used.union(keys)
        out = picked if out is None else out.unionByName(picked)
    return out


def screens_union(scored: DataFrame, keys: list[str], n: int, *group: str) -> DataFrame:
    """Rows among the top n of their sleeve by any of the keys (descending, null last), ties by score and ticker."""
    hits = None
    for key in keys:
        w = Window.partitionBy(*group, "sleeve").orderBy(F.desc_nulls_last(key), F.desc("score"), "ticker")
        one = scored.filter(F.col(key).isNotNull() & F.col("score").isNotNull()).withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).select(*group, "ticker")
        hits = one if hits is None else hits.union(one)
    return scored.join(hits.distinct(), [*group, "ticker"], "left_semi")


def reserve_swap(picked: DataFrame, pool: DataFrame, k: int, *group: str) -> DataFrame:
    """The weakest k picks give way to the best k of the pool that aren't picked; fewer if the pool is short.

    picked and pool: group, ticker, score.
    """
    free = pool.join(picked.select(*group, "ticker"), [*group, "ticker"], "left_anti")
    best = free.withColumn("__p", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), "ticker"))).filter(F.col("__p") <= k)
    worst = picked.withColumn("__p", F.row_number().over(Window.partitionBy(*group).orderBy("score", F.desc("ticker"))))
    leaving = worst.join(best.select(*group, "__p"), [*group, "__p"], "left_semi").select(*group, "ticker")
    stays = picked.join(leaving, [*group, "ticker"], "left_anti")
    room = worst.select(*group, "__p")
    coming = best.join(room, [*group, "__p"], "left_semi").drop("__p")
    return stays.withColumn("origin", F.lit("kept")).unionByName(coming.withColumn("origin", F.lit("reserve")))


def backfilled_by_favourite(scored: DataFrame, n: int, *group: str) -> DataFrame:
    """Each ticker goes to its favourite bucket (short before mid before long on ties); top n of each, the rest filled
    from the best leftovers of all. scored: group, ticker, short, mid, long."""
    fav = F.when((F.col("short") >= F.col("mid")) & (F.col("short") >= F.col("long")), "short").when(F.col("mid") >= F.col("long"), "mid").otherwise("long")
    rows = scored.withColumn("bucket", fav).withColumn("score", F.greatest("short", "mid", "long"))
    own = rows.withColumn("r", F.row_number().over(Window.partitionBy(*group, "bucket").orderBy(F.desc("score"), "ticker")))
    first = own.filter(F.col("r") <= n).withColumn("filled", F.lit(False))
    missing = n * len(BUCKETS) - F.count(F.lit(1)).over(Window.partitionBy(*group))
    short = first.select(*group, missing.alias("missing")).distinct()
    rest = own.filter(F.col("r") > n).withColumn("l", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), "ticker")))
    fill = rest.join(short, list(group)).filter(F.col("l") <= F.col("missing")).withColumn("filled", F.lit(True))
    cols = [*group, "ticker", "bucket", "score", "filled"]
    return first.select(*cols).unionByName(fill.select(*cols))
