"""Gates, verdicts and small rules over metric columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def failures(*checks: tuple[str, Column]) -> Column:
    """Names of the checks that don't hold; an unknown value doesn't hold."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks]))


def interval_verdict(low: Column, high: Column) -> Column:
    """excludes zero above, below, or not."""
    return F.when(low > 0, "above").when(high < 0, "below").otherwise("spans")


def accumulate_worst(states: DataFrame, order: tuple[str, ...], *group: str) -> DataFrame:
    """The worst state of each group; order goes from worst to best, unknown states are best."""
    place = reduce(lambda c, i: c.when(F.col("state") == order[i], F.lit(i)), range(len(order)), F.when(F.lit(False), -1)).otherwise(len(order))
    return states.groupBy(*group).agg(F.min_by("state", F.struct(place, "state")).alias("state"))


def badge(tier0_top: Column, tier1_top: Column) -> Column:
    return F.when(tier0_top & tier1_top, "consensus").when(tier1_top, "panel").when(tier0_top, "factor").otherwise("none")


def top_tier(place: Column, total: Column, share: float = 0.3) -> Column:
    return place <= F.ceil(F.lit(share) * total)


def favourite(short: Column, mid: Column, long: Column) -> Column:
    """The largest; on ties short before mid before long."""
    return F.when((short >= mid) & (short >= long), "short").when(mid >= long, "mid").otherwise("long")


def debate_verdict(rejects: Column, passes: Column, total: Column) -> Column:
    """Two rejections reject, more than half passes pass, else conditional."""
    return F.when(rejects >= 2, "reject").when(passes * 2 > total, "pass").otherwise("conditional")


def brake(action: Column, votes: Column, least: int) -> Column:
    """An action needs its least number of votes, else it is only watched."""
    return F.when(votes >= least, action).otherwise("watch")


def nudge(weight: Column, correlation: Column, step: float = 0.05, least: float = 0.1) -> Column:
    """A weight moved by the sign of a correlation that is large enough, held inside 0 to 1."""
    moved = weight + F.when(F.abs(correlation) >= least, F.signum(correlation) * step).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), moved))


def token_cost(prompt: Column, completion: Column, prompt_price: Column, completion_price: Column, rate: float) -> Column:
    """Cost of a call from prices for a million tokens and an exchange rate."""
    return F.round((prompt * prompt_price + completion * completion_price) / 1_000_000 * rate, 4)


def trade_cost(before: Column, after: Column, buy: float = 0.00015, sell: float = 0.00245, ignore: float = 0.01) -> Column:
    """Cost of a change of exposure: selling is dearer, changes under the limit are free."""
    change = after - before
    return F.when(F.abs(change) < ignore, F.lit(0.0)).when(change > 0, change * buy).otherwise(-change * sell)


def correlations(rows: DataFrame, names: list[str], *group: str) -> DataFrame:
    """left, right, rho, n of each pair of columns over rows that have both, in one pass."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    aggs = []
    for a, b in pairs:
        ok = both(a, b)
        rho = F.round(F.corr(F.when(ok, F.col(a)), F.when(ok, F.col(b))), 6)
        aggs.append(F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), rho.alias("rho"), F.count_if(ok).alias("n")))
    out = rows.groupBy(*group).agg(F.array(*aggs).alias("pairs"))
    return out.select(*group, F.explode("pairs").alias("p")).select(*group, "p.*")


def fairness(rows: DataFrame, key: str, per_key: int, order: list[Column], limit: int) -> DataFrame:
    """At most per_key rows of each key, then the first of all."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= per_key).drop("__r").orderBy(*order).limit(limit)


def cover_hash(rows: DataFrame, value: str, *group: str) -> DataFrame:
    """sha256 over the sorted distinct values, each ended by a NUL, for each group."""
    parts = F.transform(F.sort_array(F.collect_set(F.col(value).cast("string"))), lambda t: F.concat(t, F.lit("\0")))
    return rows.groupBy(*group).agg(F.sha2(F.array_join(parts, ""), 256).alias("hash"))
