"""Forward returns with halts and delistings, and how selections did against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.sections import every, over_sections, quantiles

# Fixed values.
ENTRY_OFFSET, ENTRY_GAP, LOOKAHEAD = 1, 5, 5
COST, DELISTED = 0.004, -1.0


def around(prices: DataFrame, asked: DataFrame, at: str, with_prices: bool = False) -> DataFrame:
    """asked(ticker, at, ...) with last, the (day, close) at or before its day, and next, that of the first day after it.

    Both sides are sorted together by ticker and day, so no row is repeated. With
    with_prices the prices come out as well, as rows that have __price and, as
    next, the price after it.
    """
    both = asked.unionByName(prices.select("ticker", F.struct("day", "close").alias("__price")), allowMissingColumns=True)
    is_asked = F.col("__price").isNull()
    both = both.withColumns({"__asked": is_asked, "__day": F.when(is_asked, F.col(at)).otherwise(F.col("__price.day"))})
    # Both ways the frame grows by a row at a time; one that ends with the partition is gone through anew for each row.
    ahead = Window.partitionBy("ticker").orderBy(F.col("__day").asc_nulls_first(), "__asked").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("ticker").orderBy(F.col("__day").desc_nulls_last(), F.desc("__asked")).rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("last", F.last("__price", ignorenulls=True).over(ahead)).withColumn("next", F.last("__price", ignorenulls=True).over(back))
    return both.drop("__asked", "__day") if with_prices else both.filter("__asked").drop("__asked", "__day", "__price")


def at_or_before(both: DataFrame, at: str) -> DataFrame:
    """The asked rows of a table that has prices as well, as around gives them: last is the price at or before the row's day, next the one after that.

    Without a price so early both are missing. The table isn't dealt by ticker
    again, and a price's row is sorted without the asked rows' columns.
    """
    price, asked = F.col("__price"), [c for c in both.columns if c not in ("ticker", "__price", "last", "next")]
    seen = F.struct(price["day"].alias("day"), price["close"].alias("close"), F.col("next.day").alias("next_day"), F.col("next.close").alias("next_close"))
    rows = both.select("ticker", F.coalesce(price["day"], F.col(at)).alias("__day"), F.when(price.isNull(), F.struct(*asked)).alias("__row"), F.when(price.isNotNull(), seen).alias("__seen"))
    ahead = Window.partitionBy("ticker").orderBy(F.col("__day").asc_nulls_first(), F.col("__row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("__seen", F.last("__seen", ignorenulls=True).over(ahead)).filter("__row IS NOT NULL")
    of = lambda day, close: F.when(F.col(f"__seen.{day}").isNotNull(), F.struct(F.col(f"__seen.{day}").alias("day"), F.col(f"__seen.{close}").alias("close")))
    return found.select("ticker", "__row.*", of("day", "close").alias("last"), of("next_day", "next_close").alias("next"))


def entries(prices: DataFrame, picks: DataFrame, with_prices: bool = False) -> DataFrame:
    """picks(sel_day, ticker) with used and p0: the first price of the days sel_day + 1 to sel_day + 6. with_prices as in around."""
    found = around(prices, picks.select("sel_day", "ticker"), "sel_day", with_prices)
    near = F.col("next.day") <= F.col("sel_day") + ENTRY_OFFSET + ENTRY_GAP
    return found.select("sel_day", "ticker", F.when(near, F.col("next.day")).alias("used"), F.when(near, F.col("next.close")).alias("p0"), *(["__price", "next"] if with_prices else []))


def forward_returns(panel: DataFrame, days: DataFrame, picks: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """picks(sel_day, ticker) x horizons with ret and status.

    Entry is the first price of the days sel_day + 1 to sel_day + 6, the target
    horizon days later. Without a price on the target day, the last one before
    it counts: gap if the ticker trades again, delisted if not. Without any,
    the next one; without that either, a total loss if enough of the market is
    seen after the target, else insufficient.
    """
    prices = panel.join(days, "trade_date").select("ticker", "day", "close")
    last_day = days.agg(F.max("day").alias("last_day"))
    # The prices stay among the rows, once each with the one after it: the target is looked up where the entry was.
    each = F.when(F.col("__price").isNull(), F.array(*map(F.lit, horizons))).otherwise(F.array(F.lit(None).cast("int")))
    used = entries(prices, picks, with_prices=True).withColumn("horizon", F.explode(each)).withColumn("target", F.col("used") + F.col("horizon"))
    found = at_or_before(used, "target").join(F.broadcast(last_day))  # a single row
    at = F.when(F.col("last.day") == F.col("target"), F.col("last.close"))
    before = F.when(F.col("last.day") > F.col("used"), F.col("last.close"))
    late = F.col("sel_day") + ENTRY_OFFSET > F.col("last_day")
    status = (
        F.when(late, "insufficient").when(F.col("used").isNull(), "absent").when(F.col("target") > F.col("last_day"), "insufficient")
        .when(at.isNotNull(), "ok").when(F.col("next").isNotNull(), "gap").when(before.isNotNull(), "delisted")
        .when(F.col("target") + LOOKAHEAD > F.col("last_day"), "insufficient").otherwise("delisted")
    )
    price = F.coalesce(at, before, F.col("next.close"))
    ret = F.when(F.col("status").isin("ok", "gap", "delisted"), F.coalesce(price / F.col("p0") - 1, F.lit(DELISTED)))
    return found.withColumn("status", status).select("sel_day", "ticker", "horizon", F.round(ret, 8).alias("ret"), "status")


def lead_time(panel: DataFrame, days: DataFrame, picks: DataFrame, horizon: int, threshold: float) -> DataFrame:
    """sel_day, ticker, lead: days from entry to the first close at least threshold above it, inside the horizon.

    An entry asks for the prices of the days of its horizon by ticker and day.
    """
    prices = panel.join(days, "trade_date").select("ticker", "day", "close")
    used = entries(prices, picks)
    asked = used.filter("used IS NOT NULL").select("sel_day", "ticker", "used", "p0", F.explode(F.sequence(F.col("used") + 1, F.col("used") + horizon)).alias("day"))
    gain = F.col("close") / F.col("p0") - 1
    reached = asked.join(prices, ["ticker", "day"]).filter((gain >= threshold) & (gain > 0)).groupBy("sel_day", "ticker").agg(F.min(F.col("day") - F.col("used")).alias("lead"))
    return used.select("sel_day", "ticker").join(reached, ["sel_day", "ticker"], "left")


def winners(returns: DataFrame, q: float = 0.9, least: int = 10) -> DataFrame:
    """Rows with a positive return of at least the quantile of their sel_day and horizon; none of small cross-sections."""
    cut = lambda s: {"cut": every(quantiles(s["ret"], q)[0], len(s["ret"])), "n": every(len(s["ret"]), len(s["ret"]))}
    out = over_sections(returns.filter("ret IS NOT NULL").select("sel_day", "horizon", "ticker", "ret"), ["ret"], ["cut", "n"], cut, "sel_day", "horizon")
    return out.filter((F.col("n") >= least) & (F.col("ret") >= F.col("cut")) & (F.col("ret") > 0)).select("sel_day", "horizon", "ticker", "ret")


def decile_spread(joined: DataFrame, *group: str, cost: float = COST) -> DataFrame:
    """Mean return of the best tenth by score less that of the worst, net of cost; groups of ten at least."""
    every = Window.partitionBy(*group)
    rows = joined.filter("score IS NOT NULL AND ret IS NOT NULL").withColumn("n", F.count(F.lit(1)).over(every)).filter("n >= 10")
    rows = rows.withColumn("k", F.floor(F.col("n") / 10))
    rows = rows.withColumn("top", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), "ticker")))
    rows = rows.withColumn("low", F.row_number().over(Window.partitionBy(*group).orderBy("score", F.desc("ticker"))))
    mean = lambda c: F.avg(F.when(F.col(c) <= F.col("k"), F.col("ret")))
    return rows.groupBy(*group).agg(F.round(mean("top") - mean("low") - cost, 6).alias("spread"), F.count(F.lit(1)).alias("n"))


def information_ratio(values: Column, sample: bool = False) -> Column:
    """Mean over deviation; without spread infinite with the mean's sign, or 0."""
    sigma, mean = (F.stddev_samp if sample else F.stddev_pop)(values), F.avg(values)
    return F.when(sigma > 0, mean / sigma).when(mean > 0, F.lit(float("inf"))).when(mean < 0, F.lit(float("-inf"))).otherwise(F.lit(0.0))
