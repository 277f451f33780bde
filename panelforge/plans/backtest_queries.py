"""Queries of the path-dependent backtests."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions.lineage import settle
from panelforge.operators import backtest as B
from panelforge.operators import panel as P
from panelforge.plans.common import Registry, bars_of, rounded
from panelforge.plans.factor_queries import RET

register = Registry()


@register(P.PANEL_SQL + f""", r AS (SELECT *, {RET} AS ret, {', '.join(f'CASE WHEN bar >= {n} THEN avg(close) OVER (PARTITION BY ticker ORDER BY trade_date ROWS {n - 1} PRECEDING) END AS ma{n}' for n in (20, 60, 200))}, close / lag(close, 20) OVER w - 1 AS mom FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY trade_date)),
v AS (SELECT *, (close > ma20)::INT + (close > ma60)::INT + (close > ma200)::INT + (ma20 > ma60)::INT + (mom > 0.01)::INT AS bull, (close <= ma20)::INT + (close <= ma60)::INT + (close <= ma200)::INT + (ma20 <= ma60)::INT + (mom < -0.01)::INT AS bear FROM r)
SELECT ticker, trade_date, CASE WHEN bull >= 4 THEN 'bull' WHEN bear >= 4 THEN 'bear' ELSE 'sideways' END AS regime FROM v WHERE bar >= 200""")
def regime_label(spark, sf_dir):
    bars = bars_of(spark, sf_dir)
    named = bars.withColumns({f"ma{n}": B.sma(n) for n in (20, 60, 200)}).withColumn("mom_20", B.trailing_return(20))
    return named.filter("bar >= 200").select("ticker", "trade_date", B.regime().alias("regime"))


#: Mean traded value of 60 bars that an instrument needs to count for the regime, scaled to the driver's tables.
REGIME_FLOOR = 20_000.0


@register(P.PANEL_SQL + f""", m AS (SELECT trade_date, ticker, bar, close, close / lag(close, 120) OVER w - 1 AS r120, CASE WHEN bar >= 120 THEN avg(close) OVER (PARTITION BY ticker ORDER BY trade_date ROWS 119 PRECEDING) END AS ma120,
  CASE WHEN bar >= 60 THEN avg(trdval) OVER (PARTITION BY ticker ORDER BY trade_date ROWS 59 PRECEDING) END AS adv FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY trade_date)),
g AS (SELECT trade_date, round(list_sort(list(r120) FILTER (r120 IS NOT NULL AND adv >= {REGIME_FLOOR}))[count(*) FILTER (r120 IS NOT NULL AND adv >= {REGIME_FLOOR}) // 2 + 1], 6) AS med,
  round(avg(CASE WHEN r120 IS NOT NULL AND adv >= {REGIME_FLOOR} THEN CASE WHEN close >= ma120 THEN 1.0 ELSE 0.0 END END), 6) AS breadth FROM m GROUP BY trade_date)
SELECT trade_date, med, breadth, CASE WHEN med > 0 AND breadth > 0.5 THEN 'bull' WHEN med < 0 AND breadth < 0.5 THEN 'bear' ELSE 'recovery' END AS label FROM g""")
def market_regime(spark, sf_dir):
    """Label of every date by the upper median of the half-year returns and the share above their average; recovery without any."""
    m = bars_of(spark, sf_dir).withColumns({"r120": B.trailing_return(120), "ma120": B.sma(120), "adv": F.when(F.col("bar") >= 60, F.avg("trdval").over(B.back(59)))})
    return B.market_regime(m, REGIME_FLOOR).select("trade_date", F.round("med", 6).alias("med"), F.round("breadth", 6).alias("breadth"), "label")


def _back(expression: str, n: int) -> str:
    return f"CASE WHEN bar >= {n} THEN {expression} OVER (PARTITION BY ticker ORDER BY trade_date ROWS {n - 1} PRECEDING) END"


#: Signals, warnings, and what each bar asks for: what depends on no exposure before it.
ASKED_SQL = P.PANEL_SQL.replace("WITH", "WITH RECURSIVE", 1) + f""", r AS (SELECT *, {RET} AS ret, close - lag(close) OVER w AS change FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY trade_date)),
q AS (SELECT *, {', '.join(f'{_back("avg(close)", n)} AS ma{n}' for n in (20, 60, 200))}, {', '.join(f'close / lag(close, {n}) OVER w - 1 AS mom_{n}' for n in (5, 10, 20, 60))},
  avg(greatest(change, 0)) OVER (PARTITION BY ticker ORDER BY trade_date ROWS 13 PRECEDING) AS up, avg(greatest(-change, 0)) OVER (PARTITION BY ticker ORDER BY trade_date ROWS 13 PRECEDING) AS down,
  coalesce(CASE WHEN bar >= 21 THEN round(stddev_samp(ret) OVER (PARTITION BY ticker ORDER BY trade_date ROWS 19 PRECEDING), 12) END, 0.0) AS vol20,
  {_back('volume / avg(volume)', 20)} AS vol_ratio FROM r WINDOW w AS (PARTITION BY ticker ORDER BY trade_date)),
k AS (SELECT a.ticker, a.bar, CASE WHEN count(*) >= 60 THEN (sum(CASE WHEN b.vol20 < a.vol20 THEN 1.0 WHEN b.vol20 = a.vol20 THEN 0.5 ELSE 0 END) + 0.5) / count(*) * 100 END AS vol_pct
  FROM q a JOIN q b ON a.ticker = b.ticker AND b.bar BETWEEN a.bar - 251 AND a.bar GROUP BY ALL),
v AS (SELECT q.*, vol_pct, CASE WHEN bar > 14 THEN CASE WHEN down = 0 THEN 100.0 ELSE 100 - 100 / (1 + up / down) END END AS rsi,
  coalesce(CASE WHEN (close > ma20)::INT + (close > ma60)::INT + (close > ma200)::INT + (ma20 > ma60)::INT + (mom_20 > 0.01)::INT >= 4 THEN 'bull'
    WHEN (close <= ma20)::INT + (close <= ma60)::INT + (close <= ma200)::INT + (ma20 <= ma60)::INT + (mom_20 < -0.01)::INT >= 4 THEN 'bear' END, 'sideways') AS regime
  FROM q JOIN k USING (ticker, bar)),
s AS (SELECT *, coalesce(vol_pct, 50.0) AS vol, coalesce(ma20, close) AS a20, coalesce(ma60, close) AS a60, coalesce(mom_5, 0.0) AS m5, coalesce(mom_10, 0.0) AS m10, coalesce(mom_60, 0.0) AS m60,
  coalesce(vol_ratio, 1.0) AS ratio, coalesce(lag(rsi, 5) OVER (PARTITION BY ticker ORDER BY trade_date) - rsi, 0.0) AS drop FROM v),
w AS (SELECT *, round(least(1.0, 0.0::DOUBLE {' '.join(f'+ CASE WHEN {c} THEN {x}::DOUBLE ELSE 0.0 END' for c, x in (
    ('close < a20', 0.08), ('close < a60', 0.08), ('a20 < a60', 0.08), ('m5 < -0.03', 0.10), ('m10 < -0.05', 0.10), ('m5 < 0 AND m60 > 0.05', 0.05), ('vol > 75', 0.10), ('vol > 90', 0.10),
    ('ratio > 1.5', 0.08), ('ratio > 2.0', 0.07), ('drop > 15', 0.10), ('drop > 10 AND drop <= 15', 0.05)))}), 9) AS warning FROM s),
e AS (SELECT *, round(avg(warning) OVER (PARTITION BY ticker ORDER BY trade_date ROWS 2 PRECEDING), 9) AS mean,
  bar - coalesce(max(CASE WHEN coalesce(ret, 0) >= -0.005 THEN bar END) OVER (PARTITION BY ticker ORDER BY trade_date), 0) AS streak FROM w),
a AS (SELECT ticker, trade_date, bar, regime, coalesce(ret, 0.0) AS ret, vol, rsi, mean, warning,
  CASE WHEN ret < -0.06 THEN 0.10 WHEN streak >= 5 AND ret < -0.015 THEN 0.25 END::DOUBLE AS shock FROM e)"""
#: The recursion: first the level, then the target under it, then the exposure. Fixed values as in ExposureRules.
FOLD_SQL = """, f AS (
  SELECT ticker, CAST(0 AS BIGINT) AS bar, CAST(NULL AS DATE) AS trade_date, '' AS regime, 0.0::DOUBLE AS level, 1.0::DOUBLE AS exposure, 1.0::DOUBLE AS value, 1.0::DOUBLE AS peak, 4 AS rung, 0 AS days, 0.0::DOUBLE AS shock_vol FROM a WHERE bar = 1
  UNION ALL
  SELECT ticker, bar, trade_date, regime, level, CASE WHEN shock IS NOT NULL THEN shock ELSE least(1.0, greatest(0.05, greatest(exposure - 0.50, least(exposure + 0.30, target)))) END, value, peak,
    CASE WHEN shock IS NOT NULL THEN 0 WHEN climbs THEN rung + 1 ELSE rung END, CASE WHEN climbs THEN 0 ELSE days END, CASE WHEN shock IS NOT NULL THEN vol ELSE shock_vol END
  FROM (SELECT *, CASE WHEN climbs THEN greatest(cap, [0.40, 0.70, 0.90, 1.0][rung + 1]::DOUBLE) WHEN rung < 4 AND NOT eased THEN least(cap, 0.20) ELSE cap END AS target
  FROM (SELECT * EXCLUDE (cap), CASE WHEN value / peak - 1 < -0.25 THEN least(cap, 0.25) WHEN value / peak - 1 < -0.18 THEN least(cap, 0.50) ELSE cap END AS cap,
    shock IS NULL AND rung < 4 AND eased AND days >= CASE regime WHEN 'bull' THEN 2 WHEN 'sideways' THEN 3 ELSE 6 END AS climbs
  FROM (SELECT * EXCLUDE (cap, days), CASE WHEN rsi < 22 AND regime <> 'bear' THEN least(cap * 1.15::DOUBLE, 1.0) ELSE cap END AS cap, days + CASE WHEN shock IS NULL AND rung < 4 AND eased THEN 1 ELSE 0 END AS days
  FROM (SELECT *, least(CASE regime WHEN 'bull' THEN 1.0 WHEN 'sideways' THEN 0.95 ELSE CASE WHEN vol > 90 THEN 0.45 ELSE 0.70 END END, CASE WHEN level >= 0.75 THEN 0.25 WHEN level >= 0.60 THEN 0.55 WHEN level >= 0.50 THEN 0.80 ELSE 1.0 END)::DOUBLE AS cap,
    (shock_vol - vol) / greatest(shock_vol, 1.0) > CASE WHEN regime = 'bull' THEN 0.05 ELSE 0.15 END AS eased
  FROM (SELECT a.*, round(CASE WHEN a.bar < 3 THEN 0.0 WHEN mean >= 0.45 AND warning >= 0.35 THEN mean WHEN mean < 0.30 THEN greatest(0.0, level - 0.30) WHEN mean < 0.40 THEN greatest(0.0, level - 0.12) ELSE level END::DOUBLE, 9) AS level,
    exposure, value * (1 + exposure * greatest(ret, -0.99)) AS value, greatest(peak, value * (1 + exposure * greatest(ret, -0.99))) AS peak, rung, days, shock_vol
  FROM f JOIN a ON a.ticker = f.ticker AND a.bar = f.bar + 1))))))"""


@register(ASKED_SQL + FOLD_SQL + " SELECT ticker, trade_date, regime, round(level, 6) AS level, round(exposure, 6) AS exposure, round(ln(value), 6) AS log_value FROM f WHERE bar > 0")
def crisis_exposure(spark, sf_dir):
    path = B.exposure_path(B.signal_bars(bars_of(spark, sf_dir))).withColumn("log_value", F.log("value"))
    return path.select("ticker", "trade_date", "regime", *rounded("level", "exposure", "log_value"))


@register()
def portfolio_backtest(spark, sf_dir):
    """Quarterly top five by half-year return, in four scenarios of stops, with exposure from the market's median series."""
    bars = settle(bars_of(spark, sf_dir))
    ranked = bars.withColumn("m", B.trailing_return(26)).filter("m IS NOT NULL")
    days = ranked.groupBy(F.date_trunc("quarter", "trade_date").alias("q")).agg(F.min("trade_date").alias("trade_date"))
    w = B.Window.partitionBy("trade_date").orderBy(F.desc("m"), "ticker")
    top = ranked.join(days.select("trade_date"), "trade_date").withColumn("r", F.row_number().over(w)).filter("r <= 5").select("trade_date", "ticker")
    scenarios = spark.createDataFrame([(f"stop{s:g}_take{t:g}", s, t) for s in (0.15, 0.5) for t in (0.3, 9.0)], "scenario string, stop_loss double, take_profit double")
    picks = top.withColumn("scenario", F.explode(F.array(*[F.lit(f"stop{s:g}_take{t:g}") for s in (0.15, 0.5) for t in (0.3, 9.0)])))
    market = bars.groupBy("trade_date").agg(F.percentile("close", 0.5).alias("close"), F.sum("volume").alias("volume"))
    market = P.with_bars(market.withColumn("ticker", F.lit(0).cast("long")))
    exposure = B.exposure_path(B.signal_bars(market)).select("trade_date", "exposure")
    return B.simulate(bars.select("trade_date", "ticker", "close"), picks, exposure, scenarios)


@register()
def backtest_years(spark, sf_dir):
    return B.annual(portfolio_backtest(spark, sf_dir)).select("scenario", "year", F.round("ret", 6).alias("ret"), F.round("worst", 6).alias("worst"))
