"""Queries of the panel, its features and cross-sectional ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.functions import scalar as S
from panelforge.operators import features as X
from panelforge.operators import panel as P
from panelforge.plans.common import SELECTION, Registry, bars_of, meta_of, rounded
from panelforge.sources.tables import read_table

register = Registry()
P_SQL = P.PANEL_SQL
#: The newest bar of each ticker before the selection date, from the CTE f.
LAST = f"SELECT * FROM f WHERE trade_date < DATE '{SELECTION}' QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY trade_date DESC) = 1"
RET = "CASE WHEN lag(close) OVER w > 0 THEN close / lag(close) OVER w - 1 END"


@register(P_SQL + " SELECT trade_date, ticker, close, high, volume, trdval, flow FROM panel WHERE close > 0")
def panel_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.weekly_panel(read_table(spark, sf_dir, "lineitem"))


@register(P_SQL + ", d AS (SELECT DISTINCT trade_date FROM panel) SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS day FROM d")
def bar_index(spark, sf_dir):
    return P.market_days(bars_of(spark, sf_dir))


@register(P_SQL + """ SELECT ticker, name, mktcap, sector, market FROM meta
  WHERE mktcap >= 500 AND NOT regexp_matches(upper(name), '0013|0042') AND NOT upper(name) LIKE '%7'""")
def universe_filter(spark, sf_dir):
    return P.universe(meta_of(spark, sf_dir), 500, ("0013", "0042"), ("7",))


@register(P_SQL + f""", f AS (SELECT *, round(sum(flow) OVER (PARTITION BY ticker ORDER BY trade_date ROWS 59 PRECEDING), 2) AS flow_sum FROM bars), l AS ({LAST})
 SELECT m.ticker, CASE WHEN m.market <> 'AFRICA' THEN coalesce(l.flow_sum, 0.0) END AS flow_sum, m.market = 'AFRICA' AS failed FROM meta m LEFT JOIN l ON m.ticker = l.ticker""")
def foreign_flow(spark, sf_dir):
    instruments = meta_of(spark, sf_dir)
    present = instruments.select("market").distinct().filter("market <> 'AFRICA'")
    return P.signed_flow(bars_of(spark, sf_dir), present, instruments, SELECTION)


def at_selection(spark, sf_dir, more=None, made: tuple[str, ...] = ()) -> DataFrame:
    """The selection bars with their factors, and the columns made by more."""
    return X.factor_bars(P.marked_last(bars_of(spark, sf_dir), SELECTION), "asked", more, made)


def factors_at_selection(spark, sf_dir) -> DataFrame:
    return at_selection(spark, sf_dir)


def _trend_sql(n: int, skip: int = 21) -> str:
    frame = f"(PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN {skip + n - 1} PRECEDING AND {skip} PRECEDING)"
    return f"CASE WHEN bar >= {n + skip + 1} AND stddev_pop(ret) OVER {frame} > 0 THEN (lag(close, {skip}) OVER w / lag(close, {skip + n}) OVER w - 1) / stddev_pop(ret) OVER {frame} END"


TREND_COLUMNS = {f"trend_{b}_{i}": n for b, pair in X.LOOKBACKS.items() for i, n in enumerate(pair)}
FACTOR_SQL = P_SQL + f""", r AS (SELECT *, {RET} AS ret FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY trade_date)),
j AS (SELECT *, list_shrs / nullif(lag(list_shrs) OVER w, 0) AS jump, close / nullif(lag(close) OVER w, 0) AS px FROM r WINDOW w AS (PARTITION BY ticker ORDER BY trade_date)),
f0 AS (SELECT *, {', '.join(f'{_trend_sql(n)} AS {c}' for c, n in TREND_COLUMNS.items())},
  close / max(high) OVER (PARTITION BY ticker ORDER BY trade_date ROWS 251 PRECEDING) AS high_prox,
  close / lag(close, 5) OVER w - 1 AS ret5,
  CASE WHEN count(*) OVER (PARTITION BY ticker ORDER BY trade_date ROWS 59 PRECEDING) >= 30 THEN median(trdval) OVER (PARTITION BY ticker ORDER BY trade_date ROWS 59 PRECEDING) END AS adv60,
  CASE WHEN bar >= 60 THEN avg(trdval) OVER (PARTITION BY ticker ORDER BY trade_date ROWS 4 PRECEDING) / avg(trdval) OVER (PARTITION BY ticker ORDER BY trade_date ROWS 59 PRECEDING) - 1 END AS surge,
  sum(flow) OVER (PARTITION BY ticker ORDER BY trade_date ROWS 59 PRECEDING) AS flow60,
  list_shrs / lag(list_shrs, 63) OVER w - 1 AS issue_3m, list_shrs / lag(list_shrs, 252) OVER w - 1 AS issue_12m,
  coalesce(max(CASE WHEN jump >= 1.5 AND abs(jump * px - 1) <= 0.15 THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY trade_date ROWS 251 PRECEDING), 0) = 1 AS split_like,
  coalesce(max(CASE WHEN jump >= 3.0 THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY trade_date ROWS 251 PRECEDING), 0) = 1 AS extreme
  FROM j WINDOW w AS (PARTITION BY ticker ORDER BY trade_date)),
f AS (SELECT *, CASE WHEN NOT split_like AND NOT extreme THEN -(issue_3m + issue_12m) / 2 END AS net_issuance FROM f0),
l AS ({LAST})"""


@register(FACTOR_SQL + f" SELECT ticker, round(ret, 6) AS ret, round(ret5, 6) AS ret5, {', '.join(f'round({c}, 6) AS {c}' for c in TREND_COLUMNS)} FROM l")
def returns_trend(spark, sf_dir):
    return factors_at_selection(spark, sf_dir).select("ticker", *rounded("ret", "ret5", *TREND_COLUMNS))


@register(FACTOR_SQL + " SELECT ticker, round(adv60, 6) AS adv60, coalesce(adv60 >= 60000, false) AS liquid, round(adv60 / CASE WHEN m.mktcap > 0 THEN m.mktcap END, 6) AS turnover60 FROM l JOIN meta m USING (ticker)")
def adv60_liquidity(spark, sf_dir):
    rows = factors_at_selection(spark, sf_dir).join(meta_of(spark, sf_dir), "ticker")
    return rows.select("ticker", *rounded("adv60"), F.coalesce(F.col("adv60") >= 60000, F.lit(False)).alias("liquid"), F.round(F.col("adv60") / F.when(F.col("mktcap") > 0, F.col("mktcap")), 6).alias("turnover60"))


@register(FACTOR_SQL + " SELECT ticker, round(high_prox, 6) AS high_prox, round(surge, 6) AS surge FROM l")
def high_proximity_surge(spark, sf_dir):
    return factors_at_selection(spark, sf_dir).select("ticker", *rounded("high_prox", "surge"))


@register(FACTOR_SQL + " SELECT ticker, round(issue_3m, 6) AS issue_3m, round(issue_12m, 6) AS issue_12m, split_like, extreme, round(net_issuance, 6) AS net_issuance FROM l")
def issuance_split(spark, sf_dir):
    return factors_at_selection(spark, sf_dir).select("ticker", *rounded("issue_3m", "issue_12m", "net_issuance"), "split_like", "extreme")


LEGACY_SQL = P_SQL + f""", r AS (SELECT *, {RET} AS ret FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY trade_date)),
f AS (SELECT *, CASE WHEN bar >= 60 THEN close / avg(close) OVER w60 - 1 END AS trend_ma,
  CASE WHEN bar >= 60 THEN avg(volume) OVER (PARTITION BY ticker ORDER BY trade_date ROWS 4 PRECEDING) / avg(volume) OVER w60 - 1 END AS vol_ratio,
  CASE WHEN bar >= 60 THEN stddev_pop(ret) OVER (PARTITION BY ticker ORDER BY trade_date ROWS 58 PRECEDING) END AS sigma59,
  CASE WHEN bar >= 61 THEN (close / avg(close) OVER w60 - 1) * 0.5 END AS momentum_proxy,
  sum(flow) OVER w60 AS flow60
  FROM r WINDOW w60 AS (PARTITION BY ticker ORDER BY trade_date ROWS 59 PRECEDING)), l AS ({LAST})"""


def legacy_at_selection(spark, sf_dir) -> DataFrame:
    bars = bars_of(spark, sf_dir).withColumn("ret", X.daily_return()).withColumns(X.price_signals()).withColumn("flow60", F.sum("flow").over(X.back(59)))
    return P.last_before(bars, SELECTION)


@register(LEGACY_SQL + " SELECT ticker, round(trend_ma, 6) AS trend_ma, round(vol_ratio, 6) AS vol_ratio, round(sigma59, 6) AS sigma59, round(momentum_proxy, 6) AS momentum_proxy FROM l")
def price_signals(spark, sf_dir):
    return legacy_at_selection(spark, sf_dir).select("ticker", *rounded("trend_ma", "vol_ratio", "sigma59", "momentum_proxy"))


CHART = "ma20", "ma60", "ma120", "donchian", "confirmed", "atr_contraction"


@register(P_SQL + f""", r AS (SELECT *, {RET} AS ret FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY trade_date)),
m AS (SELECT *, {', '.join(f'CASE WHEN bar >= {n} THEN avg(close) OVER (PARTITION BY ticker ORDER BY trade_date ROWS {n - 1} PRECEDING) END AS ma{n}' for n in (20, 60, 120))},
  max(high) OVER (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS h20,
  avg(trdval) OVER (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS t60,
  stddev_pop(ret) OVER (PARTITION BY ticker ORDER BY trade_date ROWS 19 PRECEDING) AS s20, stddev_pop(ret) OVER (PARTITION BY ticker ORDER BY trade_date ROWS 59 PRECEDING) AS s60 FROM r),
f AS (SELECT *, CASE WHEN bar >= 120 THEN (close > ma20)::INT + (ma20 > ma60)::INT + (ma60 > ma120)::INT END AS alignment,
  CASE WHEN bar >= 21 THEN CASE WHEN close > h20 THEN 1.0 ELSE close / h20 END END AS donchian FROM m), l AS ({LAST})
SELECT ticker, round(ma20, 6) AS ma20, round(ma60, 6) AS ma60, round(ma120, 6) AS ma120, alignment, round(donchian, 6) AS donchian,
  round(CASE WHEN bar >= 61 THEN donchian * CASE WHEN trdval > 1.5 * t60 THEN 1.0 ELSE 0.5 END END, 6) AS confirmed,
  round(CASE WHEN bar >= 61 AND s60 > 0 THEN 1 - s20 / s60 END, 6) AS atr_contraction FROM l""")
def chart_breakouts(spark, sf_dir):
    bars = bars_of(spark, sf_dir).withColumn("ret", X.daily_return()).withColumns(X.chart_columns())
    return P.last_before(bars, SELECTION).select("ticker", "alignment", *rounded(*CHART))


@register(P_SQL + f""", m AS (SELECT *, CASE WHEN bar >= 20 THEN avg(close) OVER w20 END AS mid, CASE WHEN bar >= 20 THEN stddev_pop(close) OVER w20 END AS sigma
  FROM bars WINDOW w20 AS (PARTITION BY ticker ORDER BY trade_date ROWS 19 PRECEDING)),
b AS (SELECT *, CASE WHEN sigma > 0 THEN (close - (mid - 2 * sigma)) / (4 * sigma) END AS pct_b, CASE WHEN sigma > 0 THEN 4 * sigma / mid END AS bandwidth FROM m),
f AS (SELECT *, (pct_b + greatest(0.0, least(1.0, bandwidth / min(bandwidth) OVER (PARTITION BY ticker ORDER BY trade_date) - 1))) / 2 AS composite FROM b), l AS ({LAST})
SELECT ticker, round(pct_b, 6) AS pct_b, round(bandwidth, 6) AS bandwidth, round(composite, 6) AS composite FROM l""")
def bollinger(spark, sf_dir):
    return P.last_before(X.bollinger(bars_of(spark, sf_dir)), SELECTION).select("ticker", *rounded("pct_b", "bandwidth", "composite"))


@register(P_SQL + f""", g AS (SELECT *, CASE WHEN bar >= 60 THEN avg(close) OVER (PARTITION BY ticker ORDER BY trade_date ROWS 19 PRECEDING) - avg(close) OVER (PARTITION BY ticker ORDER BY trade_date ROWS 59 PRECEDING) END AS gap FROM bars),
c AS (SELECT *, coalesce(gap > 0 AND lag(gap) OVER (PARTITION BY ticker ORDER BY trade_date) <= 0, false) AS crossed FROM g),
f AS (SELECT *, max(CASE WHEN crossed THEN bar END) OVER (PARTITION BY ticker ORDER BY trade_date ROWS 19 PRECEDING) AS newest FROM c), l AS ({LAST})
SELECT ticker, crossed, CASE WHEN gap IS NOT NULL THEN round(coalesce((20 - (bar - newest)) / 20.0::DOUBLE, 0.0::DOUBLE), 6) END AS recency FROM l""")
def ma_cross_recency(spark, sf_dir):
    rows = P.last_before(X.golden_cross(bars_of(spark, sf_dir)), SELECTION)
    return rows.select("ticker", F.coalesce("cross", F.lit(False)).alias("crossed"), *rounded("recency"))


@register(P_SQL + f""", r AS (SELECT *, {RET} AS ret, close - lag(close) OVER w AS change FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY trade_date)),
f AS (SELECT *, {', '.join(f'CASE WHEN bar >= {n} THEN avg(close) OVER (PARTITION BY ticker ORDER BY trade_date ROWS {n - 1} PRECEDING) END AS ma{n}' for n in (5, 10, 200))},
  {', '.join(f'close / lag(close, {n}) OVER w - 1 AS ret{n}' for n in (5, 10, 20, 60))},
  CASE WHEN bar >= 21 THEN stddev_samp(ret) OVER (PARTITION BY ticker ORDER BY trade_date ROWS 19 PRECEDING) * sqrt(252.0) * 100 END AS vol20,
  CASE WHEN bar >= 20 THEN volume / avg(volume) OVER (PARTITION BY ticker ORDER BY trade_date ROWS 19 PRECEDING) END AS vol_ratio20,
  avg(greatest(change, 0)) OVER (PARTITION BY ticker ORDER BY trade_date ROWS 13 PRECEDING) AS up, avg(greatest(-change, 0)) OVER (PARTITION BY ticker ORDER BY trade_date ROWS 13 PRECEDING) AS down
  FROM r WINDOW w AS (PARTITION BY ticker ORDER BY trade_date)), l AS ({LAST})
SELECT ticker, {', '.join(f'round({c}, 6) AS {c}' for c in ('ma5', 'ma10', 'ma200', 'ret5', 'ret10', 'ret20', 'ret60', 'vol20', 'vol_ratio20'))},
  round(CASE WHEN bar > 14 THEN CASE WHEN down = 0 THEN 100.0 ELSE 100 - 100 / (1 + up / down) END END, 6) AS rsi14 FROM l""")
def rolling_indicators(spark, sf_dir):
    bars = bars_of(spark, sf_dir).withColumn("ret", X.daily_return()).withColumns(X.rolling_indicators())
    bars = bars.withColumn("rsi14", X.simple_rsi())
    return P.last_before(bars, SELECTION).select("ticker", *rounded("ma5", "ma10", "ma200", "ret5", "ret10", "ret20", "ret60", "vol20", "vol_ratio20", "rsi14"))


@register(P_SQL + f""", n AS (SELECT a.ticker, a.trade_date, a.bar, count(*) AS n, sum(CASE WHEN b.volume < a.volume THEN 1.0 WHEN b.volume = a.volume THEN 0.5 ELSE 0 END) AS below
  FROM bars a JOIN bars b ON a.ticker = b.ticker AND b.bar BETWEEN a.bar - 251 AND a.bar GROUP BY ALL),
f AS (SELECT *, CASE WHEN n >= 60 THEN round((below + 0.5) / n * 100, 6) END AS pct FROM n), l AS ({LAST})
SELECT ticker, pct FROM l""")
def rolling_volume_pct(spark, sf_dir):
    bars = bars_of(spark, sf_dir).filter(F.col("trade_date") < F.lit(SELECTION).cast("date"))
    return P.last_before(X.rolling_rank(bars.select("ticker", "trade_date", "volume"), "volume", 252, 60), SELECTION).select("ticker", *rounded("pct"))


@register(P_SQL + f""", u AS (SELECT *, CASE WHEN volume > lag(volume) OVER (PARTITION BY ticker ORDER BY trade_date) THEN 1.0 ELSE 0.0 END AS up FROM bars),
f AS (SELECT *, CASE WHEN bar >= 5 THEN avg(up) OVER (PARTITION BY ticker ORDER BY trade_date ROWS 3 PRECEDING) END AS vol_trend FROM u), l AS ({LAST})
SELECT ticker, round(vol_trend, 6) AS vol_trend FROM l""")
def volume_trend(spark, sf_dir):
    bars = bars_of(spark, sf_dir).withColumn("up", F.when(F.col("volume") > F.lag("volume", 1).over(X.by_ticker()), 1.0).otherwise(0.0))
    bars = bars.withColumn("vol_trend", F.when(F.col("bar") >= 5, F.avg("up").over(X.back(3))))
    return P.last_before(bars, SELECTION).select("ticker", *rounded("vol_trend"))


SERIES = P_SQL + ", s AS (SELECT ticker, list(close ORDER BY trade_date) AS v FROM bars GROUP BY ticker)"


def _ema_sql(n: int) -> str:
    return f"list_reduce(v[{n + 1}:], lambda a, x: a + {2.0 / (n + 1)!r}::DOUBLE * (x - a), list_sum(v[1:{n}]) / {n})"


@register(SERIES + f" SELECT ticker, CASE WHEN len(v) >= 12 THEN round({_ema_sql(12)}, 6) END AS ema12, CASE WHEN len(v) >= 26 THEN round({_ema_sql(26)}, 6) END AS ema26 FROM s")
def ema_pair(spark, sf_dir):
    bars = bars_of(spark, sf_dir)
    a, b = (X.ema(bars, n).withColumnRenamed("ema", f"ema{n}") for n in (12, 26))
    return a.join(b, "ticker").select("ticker", *rounded("ema12", "ema26"))


@register(SERIES + """, d AS (SELECT ticker, list_transform(range(2, len(v) + 1), lambda i: v[i] - v[i - 1]) AS d FROM s WHERE len(v) > 14),
g AS (SELECT ticker, list_transform(d, lambda x: greatest(x, 0.0)) AS u, list_transform(d, lambda x: greatest(-x, 0.0)) AS w FROM d),
e AS (SELECT ticker, list_reduce(u[15:], lambda a, x: (a * 13 + x) / 14, list_sum(u[1:14]) / 14) AS up, list_reduce(w[15:], lambda a, x: (a * 13 + x) / 14, list_sum(w[1:14]) / 14) AS down FROM g)
SELECT ticker, round(CASE WHEN up = 0 AND down = 0 THEN 50.0 WHEN down = 0 THEN 100.0 ELSE 100 - 100 / (1 + up / down) END, 6) AS rsi FROM e""")
def wilder_rsi(spark, sf_dir):
    return X.wilder_rsi(bars_of(spark, sf_dir)).select("ticker", *rounded("rsi"))


@register(P_SQL + """, x AS (SELECT ticker, bar, close, max(bar) OVER (PARTITION BY ticker) AS n FROM bars),
w AS (SELECT a.ticker, a.bar, b.close, b.bar AS i, p.span FROM x a JOIN x b ON a.ticker = b.ticker AND b.bar <= a.bar CROSS JOIN (VALUES (12), (26)) p(span) WHERE a.bar >= 26 AND a.n >= 35),
e AS (SELECT ticker, bar, span, sum(CASE WHEN i <= span THEN close / span * pow(1 - 2.0 / (span + 1), bar - span) ELSE close * 2.0 / (span + 1) * pow(1 - 2.0 / (span + 1), bar - i) END) AS ema FROM w GROUP BY ALL),
m AS (SELECT ticker, bar, max(CASE WHEN span = 12 THEN ema END) - max(CASE WHEN span = 26 THEN ema END) AS line FROM e GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY bar) AS k, count(*) OVER (PARTITION BY ticker) AS n FROM m),
g AS (SELECT a.ticker, a.k, a.n, any_value(a.line) AS line, sum(CASE WHEN b.k <= 9 THEN b.line / 9 * pow(0.8, a.k - 9) ELSE b.line * 0.2 * pow(0.8, a.k - b.k) END) AS sig FROM q a JOIN q b ON a.ticker = b.ticker AND b.k <= a.k WHERE a.k >= 9 AND a.k >= a.n - 9 GROUP BY ALL),
h AS (SELECT ticker, k, n, line - sig AS hist, lag(line) OVER w <= lag(sig) OVER w AND line > sig AS crossed FROM g WINDOW w AS (PARTITION BY ticker ORDER BY k))
SELECT ticker, round(max(CASE WHEN k = n THEN hist END) + coalesce(max(CASE WHEN crossed THEN (9 - (n - k)) / 9.0::DOUBLE END), 0), 6) AS hist FROM h GROUP BY ticker""")
def macd_histogram(spark, sf_dir):
    return X.macd(bars_of(spark, sf_dir)).select("ticker", *rounded("hist"))


@register(P_SQL + """, x AS (SELECT ticker, trade_date, bar, close FROM bars), w AS (SELECT a.ticker, a.trade_date, a.bar, b.close, b.bar AS i FROM x a JOIN x b ON a.ticker = b.ticker AND b.bar <= a.bar)
SELECT ticker, trade_date, CASE WHEN bar >= 26 THEN round(sum(CASE WHEN i <= 26 THEN close / 26 * pow(25.0 / 27, bar - 26) ELSE close * 2.0 / 27 * pow(25.0 / 27, bar - i) END), 6) END AS ema FROM w GROUP BY ticker, trade_date, bar""")
def ema_series(spark, sf_dir):
    return X.ema_series(bars_of(spark, sf_dir), 26).select("ticker", "trade_date", *rounded("ema"))


@register(P_SQL + f""", f AS (SELECT *, lag(close, 21) OVER w / lag(close, 147) OVER w - 1 AS m FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY trade_date)), l AS ({LAST}),
s AS (SELECT sector, round(avg(m), 8) AS momentum, count(*) AS n FROM l JOIN meta USING (ticker) WHERE m IS NOT NULL GROUP BY sector HAVING count(*) >= 3)
SELECT sector, momentum, row_number() OVER (ORDER BY momentum DESC, sector) AS place, row_number() OVER (ORDER BY momentum DESC, sector) <= greatest(1, ceil(0.3 * count(*) OVER ())) AS leading FROM s""")
def sector_leaders(spark, sf_dir):
    return X.sector_momentum(bars_of(spark, sf_dir), meta_of(spark, sf_dir), SELECTION)


def _midrank_sql(value: str, *group: str) -> str:
    part = ", ".join([*group, f"({value}) IS NULL"])
    tied = ", ".join([*group, f"({value})"])
    return f"CASE WHEN ({value}) IS NOT NULL THEN (rank() OVER (PARTITION BY {part} ORDER BY {value}) + (count(*) OVER (PARTITION BY {tied}) - 1) / 2.0 - 0.5) / count(*) OVER (PARTITION BY {part}) * 100 END"


@register(P_SQL + f""", v AS (SELECT ticker, sector, market, CASE WHEN mktcap > 0 THEN round(mktcap / 500) END AS v FROM meta)
SELECT ticker, round({_midrank_sql('v')}, 6) AS whole, round({_midrank_sql('v', 'sector')}, 6) AS in_sector, round({_midrank_sql('v', 'market')}, 6) AS in_market FROM v""".replace("PARTITION BY (v)", "PARTITION BY (v)"))
def midrank(spark, sf_dir):
    rows = meta_of(spark, sf_dir).withColumn("v", F.when(F.col("mktcap") > 0, F.round(F.col("mktcap") / 500)))
    ranks = {"whole": S.midrank(F.col("v")), "in_sector": S.midrank(F.col("v"), "sector"), "in_market": S.midrank(F.col("v"), "market")}
    return rows.withColumns(ranks).select("ticker", *rounded(*ranks))


@register(P_SQL + f""", q AS (SELECT *, quantile_cont(mktcap, 0.05) OVER (PARTITION BY market) AS lo, quantile_cont(mktcap, 0.95) OVER (PARTITION BY market) AS hi, count(*) OVER (PARTITION BY market) AS n FROM meta),
z AS (SELECT *, round(CASE WHEN n >= 2 THEN greatest(lo, least(hi, mktcap)) ELSE mktcap END, 8) AS w FROM q)
SELECT ticker, w, round({_midrank_sql('w', 'market')}, 6) AS rank, round(sign(mktcap) * ln(1 + abs(mktcap)), 6) AS slog FROM z""")
def winsor_rank(spark, sf_dir):
    rows = meta_of(spark, sf_dir).withColumn("w", F.round(S.winsorize(F.col("mktcap"), 0.05, 0.95, "market"), 8))
    return rows.select("ticker", "w", F.round(S.midrank(F.col("w"), "market"), 6).alias("rank"), F.round(S.signed_log(F.col("mktcap")), 6).alias("slog"))


@register(P_SQL + """, z AS (SELECT *, (mktcap - avg(mktcap) OVER w) / CASE WHEN stddev_pop(mktcap) OVER w = 0 THEN 1e-9 ELSE stddev_pop(mktcap) OVER w END AS z,
  CASE WHEN stddev_samp(mktcap) OVER w > 0 THEN (mktcap - avg(mktcap) OVER w) / stddev_samp(mktcap) OVER w ELSE 0 END AS zs FROM meta WINDOW w AS (PARTITION BY market))
SELECT ticker, round(greatest(0.0, least(100.0, (z + 3) / 6 * 100)), 6) AS score, round(greatest(0.0, least(100.0, (-z + 3) / 6 * 100)), 6) AS inverted, round(zs, 6) AS z_sample FROM z""")
def zscore_0_100(spark, sf_dir):
    w = Window.partitionBy("market")
    sigma = F.stddev_samp("mktcap").over(w)
    sample = F.when(sigma > 0, (F.col("mktcap") - F.avg("mktcap").over(w)) / sigma).otherwise(0.0)
    return meta_of(spark, sf_dir).select(
        "ticker", F.round(S.z_to_score(F.col("mktcap"), "market"), 6).alias("score"),
        F.round(S.z_to_score(F.col("mktcap"), "market", inverted=True), 6).alias("inverted"), F.round(sample, 6).alias("z_sample"),
    )


@register(P_SQL + f""", c AS (SELECT *, quantile_cont(CASE WHEN mktcap > 0 THEN mktcap END, 0.8) OVER () AS hi, quantile_cont(CASE WHEN mktcap > 0 THEN mktcap END, 0.4) OVER () AS lo, ln(CASE WHEN mktcap > 0 THEN mktcap END) AS lm FROM meta)
SELECT ticker, CASE WHEN mktcap >= hi THEN 'large' WHEN mktcap >= lo THEN 'mid' ELSE 'small' END AS tier, round({_midrank_sql('lm')}, 6) AS size_rank FROM c""")
def size_tiers(spark, sf_dir):
    from panelforge.operators.scoring import size_tier

    positive = F.when(F.col("mktcap") > 0, F.col("mktcap"))
    instruments = meta_of(spark, sf_dir)
    cuts = instruments.agg(F.percentile(positive, F.array(F.lit(0.8), F.lit(0.4))).alias("cuts"))
    rows = instruments.join(F.broadcast(cuts)).withColumn("lm", F.ln(positive))  # a single row
    return rows.select("ticker", size_tier(F.col("mktcap"), F.col("cuts")[0], F.col("cuts")[1]).alias("tier"), F.round(S.midrank(F.col("lm")), 6).alias("size_rank"))
