"""Point-in-time features of a panel, all by windows over the bars of a ticker."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelforge.operators import folds
from panelforge.operators.rolling import Bars, divided, over_bars

# Fixed values.
SKIP = 21
LOOKBACKS = {"short": (20, 60), "mid": (63, 126), "long": (126, 252)}
HIGH_WINDOW, SPIKE_WINDOW, ADV_WINDOW, ADV_LEAST = 252, 5, 60, 30
SPLIT_RATIO, SPLIT_TOLERANCE, EXTREME = 1.5, 0.15, 3.0


def by_ticker() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("trade_date")


def back(first: int, last: int = 0) -> WindowSpec:
    """Rows from first to last bars ago, both included."""
    return by_ticker().rowsBetween(-first, -last)


def daily_return(close: str = "close") -> Column:
    before = F.lag(close, 1).over(by_ticker())
    return F.when(before > 0, F.col(close) / before - 1)


def trailing_return(bars: int, close: str = "close") -> Column:
    before = F.lag(close, bars).over(by_ticker())
    return F.when(before > 0, F.col(close) / before - 1)


def trend(lookback: int, skip: int = SKIP) -> Column:
    """Return over the lookback, skipping the newest bars, per deviation of its daily returns; needs column ret."""
    cumulative = F.lag("close", skip).over(by_ticker()) / F.lag("close", skip + lookback).over(by_ticker()) - 1
    sigma = F.stddev_pop("ret").over(back(skip + lookback - 1, skip))
    return F.when((F.col("bar") >= lookback + skip + 1) & (sigma > 0), cumulative / sigma)


def high_proximity(window: int = HIGH_WINDOW) -> Column:
    return F.col("close") / F.max(F.when(F.col("high") > 0, F.col("high"))).over(back(window - 1))


def adv(window: int = ADV_WINDOW, least: int = ADV_LEAST) -> Column:
    """Median traded value of the window; null with fewer than least bars."""
    w = back(window - 1)
    return F.when(F.count("trdval").over(w) >= least, F.percentile("trdval", 0.5).over(w))


def volume_surge(fast: int = 5, slow: int = 60, value: str = "trdval") -> Column:
    full = F.count(value).over(back(slow - 1)) >= slow
    return F.when(full, F.try_divide(F.avg(value).over(back(fast - 1)), F.avg(value).over(back(slow - 1))) - 1)


def issuance(lookback: int) -> Column:
    before = F.lag("list_shrs", lookback).over(by_ticker())
    return F.when(before > 0, F.col("list_shrs") / before - 1)


def split_flags(lookback: int) -> tuple[Column, Column]:
    """(split-like, extreme) jumps of the share count inside the lookback, from columns jump and px.

    A jump is split-like if shares and price move by inverse factors.
    """
    split = F.when((F.col("jump") >= SPLIT_RATIO) & (F.abs(F.col("jump") * F.col("px") - 1) <= SPLIT_TOLERANCE), 1).otherwise(0)
    extreme = F.when(F.col("jump") >= EXTREME, 1).otherwise(0)
    w = back(lookback - 1)
    return F.max(split).over(w) == 1, F.max(extreme).over(w) == 1


#: Columns that factors reads and gives.
FACTOR_INPUTS = ["close", "high", "trdval", "flow", "list_shrs"]
FACTORS = ["ret", "jump", "px", *(f"trend_{b}_{i}" for b in LOOKBACKS for i in (0, 1)), "high_prox", "ret5", "adv60", "surge", "flow60", "issue_3m", "issue_12m", "split", "extreme"]


def factors(bars: Bars, asked: Bars) -> dict[str, np.ndarray]:
    """The daily return ret and every factor that scoring uses, of the asked bars: what daily_return, trend and the others above are."""
    own = bars.columns
    before = bars.lag("close", 1)
    own["ret"] = np.where(before > 0, own["close"] / before - 1, np.nan)
    own["jump"], own["px"] = divided(own["list_shrs"], bars.lag("list_shrs", 1)), divided(own["close"], before)
    own["split"] = ((own["jump"] >= SPLIT_RATIO) & (np.abs(own["jump"] * own["px"] - 1) <= SPLIT_TOLERANCE)).astype(float)
    own["extreme"] = (own["jump"] >= EXTREME).astype(float)
    own["up"] = np.where(own["high"] > 0, own["high"], np.nan)

    def since(name: str, n: int) -> np.ndarray:
        then = asked.lag(name, n)
        return np.where(then > 0, asked.now(name) / then - 1, np.nan)

    def trend_of(lookback: int) -> np.ndarray:
        sigma = asked.deviation("ret", SKIP + lookback - 1, SKIP)
        cumulative = asked.lag("close", SKIP) / asked.lag("close", SKIP + lookback) - 1
        return np.where((asked.bar >= lookback + SKIP + 1) & (sigma > 0), cumulative / sigma, np.nan)

    slow, n = asked.total("trdval", 59)
    return {
        **{c: asked.now(c) for c in ("ret", "jump", "px")}, **{f"trend_{b}_{i}": trend_of(k) for b, pair in LOOKBACKS.items() for i, k in enumerate(pair)},
        "high_prox": asked.now("close") / asked.top("up", HIGH_WINDOW - 1), "ret5": since("close", SPIKE_WINDOW), "adv60": asked.median("trdval", ADV_WINDOW, ADV_LEAST),
        "surge": np.where(n >= 60, divided(asked.mean("trdval", 4), slow / 60) - 1, np.nan), "flow60": asked.total("flow", ADV_WINDOW - 1)[0],
        "issue_3m": since("list_shrs", 63), "issue_12m": since("list_shrs", 252), "split": asked.top("split", 251), "extreme": asked.top("extreme", 251),
    }


def from_mean(asked: Bars) -> np.ndarray:
    """Distance of the close from its yearly mean."""
    return np.where(asked.bar >= 52, asked.now("close") / asked.mean("close", 51) - 1, np.nan)


def halves(asked: Bars) -> dict[str, np.ndarray]:
    """earnings, the growth of traded value over half a year, and quality, the distance of the close from its yearly mean."""
    grown = asked.total("trdval", 25)[0] / asked.total("trdval", 51, 26)[0] - 1
    return {"earnings": np.where(asked.bar >= 52, grown, np.nan), "quality": from_mean(asked)}


def factor_bars(bars: DataFrame, asked: str | None = None, more: Callable[[Bars, Bars], dict[str, np.ndarray]] | None = None, made: tuple[str, ...] = ()) -> DataFrame:
    """bars with the daily return ret and every factor that scoring uses, and the columns made by more; only where asked holds, if given."""
    fold = lambda every, some: factors(every, some) | (more(every, some) if more else {})
    out = over_bars(bars, FACTOR_INPUTS, [*FACTORS, *made], fold, asked)
    mean = (F.col("issue_3m") + F.col("issue_12m")) / 2
    out = out.withColumns({"split_like": F.col("split") == 1, "extreme": F.col("extreme") == 1}).drop("split")
    return out.withColumn("net_issuance", F.when(~F.col("split_like") & ~F.col("extreme"), -mean))


def price_signals() -> dict[str, Column]:
    """Legacy signals: distance from MA60, volume MA5/MA60 - 1, deviation of the last 59 returns, momentum proxy."""
    ma60 = F.avg("close").over(back(59))
    full = F.col("bar") >= 60
    return {
        "trend_ma": F.when(full, F.col("close") / ma60 - 1),
        "vol_ratio": volume_surge(5, 60, "volume"),
        "sigma59": F.when(full, F.stddev_pop("ret").over(back(58))),
        "momentum_proxy": F.when(F.col("bar") >= 61, (F.col("close") / ma60 - 1) * F.lit(0.5)),
    }


def sma(n: int, value: str = "close") -> Column:
    return F.when(F.col("bar") >= n, F.avg(value).over(back(n - 1)))


def chart_columns() -> dict[str, Column]:
    """Chart indicators that need no recursion; needs columns bar and ret."""
    ma20, ma60, ma120 = sma(20), sma(60), sma(120)
    aligned = sum(((a > b).cast("int") for a, b in ((F.col("close"), ma20), (ma20, ma60), (ma60, ma120))), F.lit(0))
    high20 = F.max("high").over(back(20, 1))
    breakout = F.when(F.col("bar") >= 21, F.when(F.col("close") > high20, F.lit(1.0)).otherwise(F.col("close") / high20))
    heavy = F.col("trdval") > 1.5 * F.avg("trdval").over(back(60, 1))
    s20, s60 = F.stddev_pop("ret").over(back(19)), F.stddev_pop("ret").over(back(59))
    return {
        "ma20": ma20,
        "ma60": ma60,
        "ma120": ma120,
        "alignment": F.when(F.col("bar") >= 120, aligned),
        "donchian": breakout,
        "confirmed": F.when(F.col("bar") >= 61, breakout * F.when(heavy, F.lit(1.0)).otherwise(F.lit(0.5))),
        "atr_contraction": F.when((F.col("bar") >= 61) & (s60 > 0), 1 - s20 / s60),
    }


#: Sub-indicators of every bar that chart gives, and what of it else is read.
CHART = ("ma20", "ma60", "ma120", "alignment", "donchian", "confirmed", "atr_contraction", "composite", "recency", "rsi", "macd")


def chart(bars: Bars, asked: Bars) -> dict[str, np.ndarray]:
    """chart_columns, bollinger's composite, golden_cross's recency and the folds' rsi and macd of the asked bars; needs ret."""
    own = bars.columns
    nan = np.nan

    def after(b: Bars, n: int, value: np.ndarray) -> np.ndarray:
        return np.where(b.bar >= n, value, nan)

    # What looks back at indicators of earlier bars needs them of all.
    mid = after(bars, 20, bars.mean("close", 19))
    sigma = after(bars, 20, bars.deviation("close", 19))
    own["bandwidth"] = np.where(sigma > 0, 4.0 * sigma / mid, nan)
    own["pct_b"] = np.where(sigma > 0, (own["close"] - (mid - 2.0 * sigma)) / (4.0 * sigma), nan)
    own["composite"] = (own["pct_b"] + np.fmax(0.0, np.fmin(1.0, own["bandwidth"] / bars.least_so_far("bandwidth") - 1))) / 2
    own["gap"] = mid - after(bars, 60, bars.mean("close", 59))
    own["crossed"] = np.where((own["gap"] > 0) & (bars.lag("gap", 1) <= 0), bars.bar.astype(float), nan)
    turns = folds.momentum({"close": bars.grid("close")})

    close, recent = asked.now("close"), asked.top("crossed", 19)
    ma20, ma60, ma120 = (after(asked, n, asked.mean("close", n - 1)) for n in (20, 60, 120))
    aligned = (close > ma20).astype(float) + (ma20 > ma60) + (ma60 > ma120)
    high20 = asked.top("high", 20, 1)
    breakout = after(asked, 21, np.where(close > high20, 1.0, close / high20))
    heavy = np.where(asked.now("trdval") > 1.5 * asked.mean("trdval", 60, 1), 1.0, 0.5)
    s20, s60 = asked.deviation("ret", 19), asked.deviation("ret", 59)
    age = np.where(np.isnan(recent), 0.0, (20 - (asked.bar - recent)) / 20.0)
    return {
        "ma20": ma20, "ma60": ma60, "ma120": ma120, "alignment": after(asked, 120, aligned), "donchian": breakout, "confirmed": after(asked, 61, breakout * heavy),
        "atr_contraction": np.where((asked.bar >= 61) & (s60 > 0), 1 - s20 / s60, nan), "composite": asked.now("composite"), "recency": np.where(np.isnan(asked.now("gap")), nan, age),
        **{c: bars.off_grid(cells)[asked.at] for c, cells in turns.items()},
    }


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    """pct_b, bandwidth and their composite: mean of pct_b and the bandwidth's excess over its minimum so far, 0 to 1."""
    mid, sigma = sma(n), F.when(F.col("bar") >= n, F.stddev_pop("close").over(back(n - 1)))
    out = bars.withColumn("mid", mid).withColumn("sigma", sigma)
    out = out.withColumn("pct_b", F.when(F.col("sigma") > 0, (F.col("close") - (F.col("mid") - k * F.col("sigma"))) / (2 * k * F.col("sigma"))))
    out = out.withColumn("bandwidth", F.when(F.col("sigma") > 0, 2 * k * F.col("sigma") / F.col("mid")))
    least = F.min("bandwidth").over(by_ticker().rowsBetween(Window.unboundedPreceding, 0))
    grow = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("bandwidth") / least - 1))
    return out.withColumn("composite", (F.col("pct_b") + grow) / 2)


def golden_cross(bars: DataFrame, window: int = 20) -> DataFrame:
    """recency: how new the last upward crossing of MA20 over MA60 in the window is, (window - age) / window, else 0."""
    out = bars.withColumn("gap", sma(20) - sma(60))
    cross = (F.col("gap") > 0) & (F.lag("gap", 1).over(by_ticker()) <= 0)
    newest = F.max(F.when(cross, F.col("bar"))).over(back(window - 1))
    return out.withColumn("cross", cross).withColumn("recency", F.when(F.col("gap").isNotNull(), F.coalesce((window - (F.col("bar") - newest)) / F.lit(float(window)), F.lit(0.0))))


def rolling_indicators() -> dict[str, Column]:
    """Indicators of the backtests: sample deviations, simple-mean RSI; needs columns ret and bar."""
    change = F.col("close") - F.lag("close", 1).over(by_ticker())
    return {
        **{f"ma{n}": sma(n) for n in (5, 10, 20, 60, 120, 200)},
        **{f"ret{n}": trailing_return(n) for n in (5, 10, 20, 60)},
        "vol20": F.when(F.col("bar") >= 21, F.stddev_samp("ret").over(back(19)) * F.lit(252**0.5 * 100)),
        "vol_ratio20": F.when(F.col("bar") >= 20, F.col("volume") / F.avg("volume").over(back(19))),
        "change": change,
    }


def simple_rsi(n: int = 14) -> Column:
    """From the column change: mean gains against mean losses of n bars."""
    up = F.avg(F.greatest(F.col("change"), F.lit(0.0))).over(back(n - 1))
    down = F.avg(F.greatest(-F.col("change"), F.lit(0.0))).over(back(n - 1))
    return F.when(F.col("bar") > n, F.when(down == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + up / down)))


def rolling_rank(bars: DataFrame, value: str, window: int, least: int, undated: bool = False) -> DataFrame:
    """bars with pct: the percentile of the newest value among the window, ties averaged. A ticker has a date once.

    All columns of bars go through the fold. Rows without a date come first in
    their series and count there; they come out only if undated.
    """
    rest = [c for c in bars.columns if c not in ("ticker", "trade_date")]
    ranked = folds.fold_series(bars, [value], rest, ["pct"], lambda grid: folds.newest_rank(grid, value, window, least))
    return ranked if undated else ranked.filter("trade_date IS NOT NULL")


def ema(bars: DataFrame, n: int, value: str = "close") -> DataFrame:
    """ticker, ema: seeded with the mean of the first n values; a fold over the ticker's own values."""
    alpha = 2.0 / (n + 1)
    series = bars.groupBy("ticker").agg(F.transform(F.array_sort(F.collect_list(F.struct("trade_date", value))), lambda x: x[value]).alias("v"))
    seed = F.aggregate(F.slice("v", 1, n), F.lit(0.0), lambda a, x: a + x) / n
    rest = F.slice("v", n + 1, F.greatest(F.size("v") - n, F.lit(0)))
    return series.select("ticker", F.when(F.size("v") >= n, F.aggregate(rest, seed, lambda a, x: a + alpha * (x - a))).alias("ema"))


def wilder_rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """ticker, rsi: gains and losses smoothed by (n - 1) / n from the mean of the first n."""
    series = bars.groupBy("ticker").agg(F.transform(F.array_sort(F.collect_list(F.struct("trade_date", "close"))), lambda x: x["close"]).alias("v"))
    series = series.filter(F.size("v") > n).withColumn("d", F.zip_with(F.slice("v", 2, F.size("v") - 1), F.slice("v", 1, F.size("v") - 1), lambda a, b: a - b))

    def smooth(sign: int) -> Column:
        part = F.transform("d", lambda x: F.greatest(sign * x, F.lit(0.0)))
        seed = F.aggregate(F.slice(part, 1, n), F.lit(0.0), lambda a, x: a + x) / n
        return F.aggregate(F.slice(part, n + 1, F.greatest(F.size("d") - n, F.lit(0))), seed, lambda a, x: (a * (n - 1) + x) / n)

    both = series.select("ticker", smooth(1).alias("up"), smooth(-1).alias("down"))
    rsi = F.when((F.col("up") == 0) & (F.col("down") == 0), F.lit(50.0)).when(F.col("down") == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + F.col("up") / F.col("down")))
    return both.select("ticker", rsi.alias("rsi"))


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """ticker, hist: the last difference of the fast and slow EMA less its own EMA, plus a bonus for a crossing.

    The bonus is (signal - age) / signal for the line's newest crossing above its
    EMA, age bars ago, inside the last ``signal`` bars. One fold over each ticker's
    values, with a few numbers of state.
    """
    series = bars.groupBy("ticker").agg(F.transform(F.array_sort(F.collect_list(F.struct("trade_date", "close"))), lambda x: x["close"]).alias("v"))
    mean = lambda n: F.aggregate(F.slice("v", 1, n), F.lit(0.0), lambda a, x: a + x) / n
    step = lambda a, x, n: a + 2.0 / (n + 1) * (x - a)
    f0 = F.aggregate(F.slice("v", fast + 1, slow - fast), mean(fast), lambda a, x: step(a, x, fast))
    out = series.filter(F.size("v") >= slow + signal).withColumn("f0", f0).withColumn("s0", mean(slow))

    def state(f: Column, s: Column, seen: Column, total: Column, line: Column, ema: Column, age: Column) -> Column:
        return F.struct(f.alias("f"), s.alias("s"), seen.alias("seen"), total.alias("total"), line.alias("line"), ema.alias("ema"), age.alias("age"))

    def after(a: Column, x: Column) -> Column:
        f, s = step(a["f"], x, fast), step(a["s"], x, slow)
        line, seen = f - s, a["seen"] + 1
        total = a["total"] + F.when(seen <= signal, line).otherwise(0.0)
        ema = F.when(seen > signal, step(a["ema"], line, signal)).when(seen == signal, total / signal)
        crossed = (a["line"] <= a["ema"]) & (line > ema)
        return state(f, s, seen, total, line, ema, F.when(crossed, 0).otherwise(a["age"] + 1))

    first = F.col("f0") - F.col("s0")
    begin = state(F.col("f0"), F.col("s0"), F.lit(1), first, first, F.lit(None).cast("double"), F.lit(signal))
    out = out.withColumn("end", F.aggregate(F.slice("v", slow + 1, F.size("v") - slow), begin, after))
    bonus = F.greatest(F.lit(0.0), (signal - F.col("end.age")) / F.lit(float(signal)))
    return out.select("ticker", (F.col("end.line") - F.col("end.ema") + bonus).alias("hist"))


def ema_series(bars: DataFrame, n: int, value: str = "close") -> DataFrame:
    """ticker, trade_date, ema of every bar: seeded with the mean of the first n values in a row, null before.

    A missing value after the seed ends the series.
    """
    return folds.fold_series(bars, [value], [], ["ema"], lambda grid: folds.ema(grid, value, n))


def sector_momentum(bars: DataFrame, instruments: DataFrame, date: str, lag: int = 21, window: int = 126, fraction: float = 0.30, least: int = 3) -> DataFrame:
    """sector, momentum, place, leading: lagged return averaged over sectors of at least three; the best share leads."""
    out = bars.withColumn("m", F.lag("close", lag).over(by_ticker()) / F.lag("close", lag + window).over(by_ticker()) - 1)
    w = Window.partitionBy("ticker").orderBy(F.desc("trade_date"))
    last = out.filter(F.col("trade_date") < F.lit(date).cast("date")).withColumn("n", F.row_number().over(w)).filter("n = 1 AND m IS NOT NULL")
    sectors = last.join(instruments, "ticker").groupBy("sector").agg(F.round(F.avg("m"), 8).alias("momentum"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    every = Window.partitionBy(F.lit(1))
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("momentum"), "sector"))
    lead = F.greatest(F.lit(1), F.ceil(F.lit(fraction) * F.count(F.lit(1)).over(every)))
    return sectors.select("sector", "momentum", place.alias("place"), (place <= lead).alias("leading"))
