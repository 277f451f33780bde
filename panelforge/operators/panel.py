"""The market panel: one row for each instrument and period, with bar numbers and point-in-time slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def weekly_panel(lineitem: DataFrame) -> DataFrame:
    """trade_date, ticker, close, high, volume, trdval, flow: a bar for each supplier and ISO week with trades.

    Bars without a positive close are dropped; high falls back to close. Values
    are rounded so that later ties don't depend on the order of summation.
    """
    price = F.try_divide(F.col("l_extendedprice"), F.col("l_quantity"))
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice"))
    return (
        lineitem.groupBy(F.date_trunc("week", "l_shipdate").cast("date").alias("trade_date"), F.col("l_suppkey").alias("ticker"))
        .agg(
            F.round(F.try_divide(F.sum("l_extendedprice"), F.sum("l_quantity")), 9).alias("close"),
            F.round(F.max(price), 9).alias("high"),
            F.sum("l_quantity").alias("volume"),
            F.round(F.sum("l_extendedprice"), 2).alias("trdval"),
            F.round(F.sum(signed), 2).alias("flow"),
        )
        .filter("close > 0")
        .withColumn("high", F.coalesce(F.when(F.col("high") > 0, F.col("high")), F.col("close")))
    )


def with_bars(panel: DataFrame) -> DataFrame:
    """Adds bar (1, 2, ... within the ticker) and list_shrs (running volume)."""
    w = Window.partitionBy("ticker").orderBy("trade_date")
    return panel.withColumn("bar", F.row_number().over(w)).withColumn("list_shrs", F.sum("volume").over(w))


def market_days(panel: DataFrame) -> DataFrame:
    """trade_date and day, its number among all dates of the market."""
    dates = panel.select("trade_date").distinct()
    return dates.withColumn("day", F.row_number().over(Window.orderBy("trade_date")))


def meta(supplier: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """ticker, name, mktcap, sector, market of each instrument."""
    places = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    return supplier.join(places, supplier["s_nationkey"] == places["n_nationkey"]).select(
        F.col("s_suppkey").alias("ticker"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("mktcap"),
        F.col("n_name").alias("sector"), F.col("r_name").alias("market"),
    )


def last_before(bars: DataFrame, date: str) -> DataFrame:
    """The last row of each ticker strictly before a date: the selection bar."""
    w = Window.partitionBy("ticker").orderBy(F.desc("trade_date"))
    return bars.filter(F.col("trade_date") < F.lit(date).cast("date")).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def marked_last(bars: DataFrame, date: str) -> DataFrame:
    """The rows strictly before a date with asked: whether a row is the last one of its ticker."""
    following = F.lead("trade_date").over(Window.partitionBy("ticker").orderBy("trade_date"))
    return bars.filter(F.col("trade_date") < F.lit(date).cast("date")).withColumn("asked", following.isNull())


def universe(instruments: DataFrame, floor: float, words: tuple[str, ...], suffixes: tuple[str, ...]) -> DataFrame:
    """Instruments of at least floor market value whose name has none of the words and no suffix, largest first."""
    name = F.upper("name")
    bad = name.rlike("|".join(words)) if words else F.lit(False)
    for s in suffixes:
        bad = bad | name.endswith(s)
    return instruments.filter((F.col("mktcap") >= floor) & ~bad).orderBy(F.desc("mktcap"), "ticker")


def signed_flow(bars: DataFrame, markets_present: DataFrame, instruments: DataFrame, date: str, window: int = 60) -> DataFrame:
    """ticker, flow_sum, failed: a market without data failed (null), a ticker without rows has 0."""
    w = Window.partitionBy("ticker").orderBy("trade_date").rowsBetween(-(window - 1), 0)
    sums = last_before(bars.withColumn("flow_sum", F.round(F.sum("flow").over(w), 2)), date).select("ticker", "flow_sum")
    out = instruments.join(sums, "ticker", "left").join(markets_present.withColumn("ok", F.lit(True)), "market", "left")
    return out.select("ticker", F.when(F.col("ok"), F.coalesce("flow_sum", F.lit(0.0))).alias("flow_sum"), F.col("ok").isNull().alias("failed"))


PANEL_SQL = """
WITH panel AS (
  SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS trade_date, l_suppkey AS ticker,
    round(sum(l_extendedprice) / sum(l_quantity), 9) AS close, round(max(l_extendedprice / l_quantity), 9) AS high,
    sum(l_quantity) AS volume, round(sum(l_extendedprice), 2) AS trdval,
    round(sum(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END), 2) AS flow
  FROM lineitem GROUP BY 1, 2
), bars AS (
  SELECT *, row_number() OVER w AS bar, sum(volume) OVER w AS list_shrs FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY trade_date)
), meta AS (
  SELECT s_suppkey AS ticker, s_name AS name, s_acctbal AS mktcap, n_name AS sector, r_name AS market
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""
