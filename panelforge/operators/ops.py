"""Operational analytics: rules, votes, performance, cost and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
PRICE_MOVE, VOLUME_RATIO, EPSILON = 0.05, 3.0, 1e-9
STOP, TRAIL = 0.15, 0.12
HOLD_DAYS = {"short": 30, "mid": 90, "long": 365}
RISK_FREE = 0.035

#: First matching rule wins: (pattern, severity, reason). The rules are a parameter of classify.
NEWS_RULES = (
    (r"bankrupt|insolven|delist", "critical", "solvency"),
    (r"fraud|embezzl|lawsuit", "critical", "legal"),
    (r"licen[sc]e|copyright", "warning", "license"),
    (r"password|secret|token", "warning", "security"),
    (r"acquisition|merger", "info", "deal"),
    (r"idiot|trash|stupid", "info", "tone"),
)


def classify(text: Column, rules: tuple[tuple[str, str, str], ...] = NEWS_RULES) -> Column:
    """struct(severity, reason) of the first rule whose pattern occurs; null without one."""
    low = F.lower(text)
    out = None
    for pattern, severity, reason in rules:
        value = F.struct(F.lit(severity).alias("severity"), F.lit(reason).alias("reason"))
        out = F.when(low.rlike(pattern), value) if out is None else out.when(low.rlike(pattern), value)
    return out


def anomaly(price: Column, reference: Column, volume: Column, usual: Column) -> Column:
    """price_spike or price_drop before volume_surge; null otherwise or without a reference."""
    move = F.when(reference > 0, price / reference - 1)
    ratio = F.when(usual > 0, volume / usual)
    return F.when(move >= PRICE_MOVE - EPSILON, "price_spike").when(move <= -PRICE_MOVE + EPSILON, "price_drop").when(ratio >= VOLUME_RATIO, "volume_surge")


def exit_signal(bucket: Column, entry: Column, price: Column, peak: Column, target: Column, held_days: Column) -> Column:
    """target, then stop, then trailing stop, then time."""
    limit = F.coalesce(*[F.when(bucket == b, F.lit(d)) for b, d in HOLD_DAYS.items()])
    return (
        F.when(price >= target, "target").when(price <= entry * (1 - STOP), "stop")
        .when((peak > entry) & (price <= peak * (1 - TRAIL)), "trailing").when(held_days >= limit, "time")
    )


def decision(alpha: Column, sharpe: Column, mdd: Column) -> Column:
    """Three conditions: all pass, some pass, none."""
    passed = (alpha >= 0).cast("int") + (sharpe >= 0.5).cast("int") + (mdd >= -0.15).cast("int")
    return F.when(passed == 3, "pass").when(passed > 0, "watch").otherwise("fail")


def curve(returns: DataFrame, key: str, order: str, value: str = "r") -> DataFrame:
    """Compounded curve, running peak and drawdown of each key."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = returns.withColumn("equity", F.exp(F.sum(F.log1p(value)).over(w)))
    return out.withColumn("drawdown", F.col("equity") / F.greatest(F.lit(1.0), F.max("equity").over(w)) - 1)


def statistics(curved: DataFrame, key: str, order: str, per_year: float, value: str = "r", risk_free: float = RISK_FREE) -> DataFrame:
    """total, cagr, mdd, sharpe, calmar and win_rate of each key from its curve."""
    years = F.count(F.lit(1)) / F.lit(per_year)
    out = curved.groupBy(key).agg(
        (F.max_by("equity", order) - 1).alias("total"), (F.pow(F.max_by("equity", order), 1 / years) - 1).alias("cagr"), F.min("drawdown").alias("mdd"),
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("sigma"), F.avg(F.when(F.col(value) > 0, 1.0).otherwise(0.0)).alias("win_rate"),
    )
    sharpe = F.when(F.col("sigma") > 0, (F.col("mean") - risk_free / per_year) / F.col("sigma") * F.sqrt(F.lit(per_year))).otherwise(0.0)
    return out.withColumn("sharpe", sharpe).withColumn("calmar", F.when(F.col("mdd") < 0, F.col("cagr") / -F.col("mdd")).otherwise(0.0)).drop("mean", "sigma")


def run_lengths(rows: DataFrame, key: str, order: str, flag: str) -> DataFrame:
    """Length of the run of true flags that ends at each row: column streak."""
    w = Window.partitionBy(key).orderBy(order)
    breaks = F.sum(F.when(F.col(flag), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("__island", breaks)
    return out.withColumn("streak", F.sum(F.when(F.col(flag), 1).otherwise(0)).over(Window.partitionBy(key, "__island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))).drop("__island")


def longest_prefix(codes: DataFrame, prefixes: DataFrame, longest: int) -> DataFrame:
    """codes(code) with label, prefix of the longest matching prefix, null without one.

    Each code offers its own beginnings, so the match is an equi-join.
    """
    offers = codes.select("code", F.explode(F.sequence(F.lit(1), F.least(F.length("code"), F.lit(longest)))).alias("n")).withColumn("prefix", F.substring("code", F.lit(1), F.col("n")))
    best = offers.join(prefixes, "prefix").groupBy("code").agg(F.max_by(F.struct("label", "prefix"), "n").alias("b"))
    return codes.join(best, "code", "left").select("code", F.col("b.label").alias("label"), F.col("b.prefix").alias("prefix"))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, time: str, value: str, within: str | None = None) -> DataFrame:
    """left with the value of right's last row of the key at or before left's time; older than ``within`` counts as none.

    Both sides are sorted together by key and time, so nothing is joined and no row is repeated.
    """
    a = left.select(F.col(key), F.col(at).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).cast("timestamp").alias("__seen"), F.lit(None).cast(dict(right.dtypes)[value]).alias("__v"))
    b = right.select(F.col(key), F.col(time).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.col(time).cast("timestamp").alias("__seen"), F.col(value).alias("__v"))
    w = Window.partitionBy(key).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("__side") == 0, F.struct("__seen", "__v")), ignorenulls=True).over(w)
    out = a.unionByName(b).withColumn("__l", last).filter("__side = 1")
    got = F.col("__l.__v") if within is None else F.when(F.col("__t") - F.expr(f"INTERVAL {within}") <= F.col("__l.__seen"), F.col("__l.__v"))
    return out.select("__row.*", got.alias(value))


def board_vote(stocks: DataFrame, board: DataFrame, n: int, share: float) -> DataFrame:
    """ticker, votes, mean: members score linearly and vote for their top n; a share of votes elects.

    board: member, factor, weight. stocks: ticker, factor, value.
    """
    size = board.agg(F.count_distinct("member").alias("members"))
    scores = stocks.join(F.broadcast(board), "factor").groupBy("member", "ticker").agg(F.round(F.sum(F.col("weight") * F.col("value")), 8).alias("score"))  # a row for each member and factor
    ballots = scores.withColumn("r", F.row_number().over(Window.partitionBy("member").orderBy(F.desc("score"), "ticker")))
    counted = ballots.groupBy("ticker").agg(F.count_if(F.col("r") <= n).alias("votes"), F.round(F.avg("score"), 6).alias("mean"))
    return counted.join(F.broadcast(size)).filter(F.col("votes") >= share * F.col("members")).select("ticker", "votes", "mean")
