"""Selections against each other: paired legs, reserve arms, gates' cuts, blends and selector sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.lineage import few


def pooled_recall(picks: DataFrame, winners: DataFrame) -> DataFrame:
    """leg, sel_day, horizon, hits, winners of picks(leg, sel_day, ticker): every leg is held against every winner."""
    total = winners.groupBy("sel_day", "horizon").agg(F.count(F.lit(1)).alias("winners")).join(few(picks.select("leg").distinct()))  # a row for each leg
    hits = winners.select("sel_day", "horizon", "ticker").join(picks.select("leg", "sel_day", "ticker"), ["sel_day", "ticker"]).groupBy("leg", "sel_day", "horizon").agg(F.count(F.lit(1)).alias("hits"))
    return total.join(hits, ["leg", "sel_day", "horizon"], "left").select("leg", "sel_day", "horizon", F.coalesce("hits", F.lit(0)).alias("hits"), "winners")


def paired_legs(recall: DataFrame, base: str, other: str) -> DataFrame:
    """horizon, periods, pooled recall of both legs, and mean and interval of the difference over the same periods."""
    of = lambda leg, c: F.sum(F.when(F.col("leg") == leg, F.col(c)))
    months = recall.groupBy("sel_day", "horizon").agg(*[of(leg, c).alias(f"{c}_{i}") for i, leg in enumerate((base, other)) for c in ("hits", "winners")])
    months = months.withColumn("lift", F.col("hits_1") / F.col("winners_1") - F.col("hits_0") / F.col("winners_0"))
    return months.groupBy("horizon").agg(
        F.count("lift").alias("periods"), (F.sum("hits_0") / F.sum("winners_0")).alias("base_recall"), (F.sum("hits_1") / F.sum("winners_1")).alias("leg_recall"),
        F.avg("lift").alias("lift"), F.percentile("lift", 0.05).alias("low"), F.percentile("lift", 0.95).alias("high"),
    )


def gate_cuts(before: DataFrame, after: DataFrame, winners: DataFrame) -> DataFrame:
    """Picks that a gate cut and that became winners, with their returns: what the gate missed. An observation, no verdict."""
    cut = before.join(after, ["sel_day", "ticker"], "left_anti").select("sel_day", "ticker")
    return winners.join(cut, ["sel_day", "ticker"], "left_semi")


def reserve_arm(base: DataFrame, reserve: DataFrame, k: int) -> DataFrame:
    """sel_day, ticker: the best k of reserve that base lacks replace as many of the worst of base; both have a score."""
    best = Window.partitionBy("sel_day").orderBy(F.desc("score"), "ticker")
    added = reserve.join(base, ["sel_day", "ticker"], "left_anti").withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).select("sel_day", "ticker")
    counts = added.groupBy("sel_day").agg(F.count(F.lit(1)).alias("k"))
    worst = Window.partitionBy("sel_day").orderBy("score", "ticker")
    kept = base.withColumn("r", F.row_number().over(worst)).join(counts, "sel_day", "left").filter(F.col("r") > F.coalesce("k", F.lit(0)))
    return kept.select("sel_day", "ticker").union(added)


def lift_over_random(picks: DataFrame, winners: DataFrame, universe: DataFrame, *by: str) -> DataFrame:
    """by..., sel_day, selected, recall, random, lift: recall of the distinct winners of any horizon against picking blindly."""
    won = winners.select("sel_day", "ticker").distinct()
    total = won.groupBy("sel_day").agg(F.count(F.lit(1)).alias("winners"))
    size = universe.groupBy("sel_day").agg(F.count(F.lit(1)).alias("size"))
    hit = picks.join(won.withColumn("hit", F.lit(1)), ["sel_day", "ticker"], "left").groupBy(*by, "sel_day").agg(F.count(F.lit(1)).alias("selected"), F.count("hit").alias("hits"))
    out = hit.join(total, "sel_day").join(size, "sel_day")
    recall, blind = F.col("hits") / F.col("winners"), F.col("selected") / F.col("size")
    return out.select(*by, "sel_day", "selected", recall.alias("recall"), blind.alias("random"), (recall - blind).alias("lift"))


def share_at_most(value: str, *group: str) -> Column:
    """Percent of the group's values at or below each value; 50 where it is missing."""
    w = Window.partitionBy(*group, F.col(value).isNull()).orderBy(value)
    return F.when(F.col(value).isNull(), F.lit(50.0)).otherwise(F.cume_dist().over(w) * 100)


def correlation_report(rho: DataFrame, scope: str, limit: float) -> DataFrame:
    """scope, periods, mean, low, high and failed: the periods (sel_day) whose correlation exceeds the limit either way."""
    beyond = F.array_sort(F.collect_list(F.when(F.abs("rho") > limit, F.col("sel_day"))))  # a number for each period
    return rho.groupBy(scope).agg(
        F.count("rho").alias("periods"), F.avg("rho").alias("mean"), F.percentile("rho", 0.05).alias("low"), F.percentile("rho", 0.95).alias("high"), F.array_join(beyond.cast("array<string>"), ",").alias("failed")
    )
