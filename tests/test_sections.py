"""Cross-sections and windows in one pass, against Spark's own windows."""

import datetime
import random

import pytest
from panelforge.functions import ranks
from panelforge.functions.scalar import midrank
from panelforge.functions.sections import every, held, midranks, over_sections, quantiles
from panelforge.operators import features as X
from panelforge.operators import forward as Z
from panelforge.operators import harvest as H
from panelforge.operators import panel as P
from panelforge.operators import scoring as G
from panelforge.plans import selection_queries as L
from pyspark.sql import Window
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def same(got, want, keys):
    a, b = (d.orderBy(*keys).collect() for d in (got, want))
    assert len(a) == len(b) > 0
    for x, y in zip(a, b):
        assert {k: v for k, v in x.asDict().items()} == {k: v if v is None or not isinstance(v, float) else pytest.approx(v, rel=1e-12, abs=1e-12) for k, v in y.asDict().items()}


def panel(spark, series):
    rng, rows = random.Random(2), []
    for k, n in series.items():
        shares = 0.0
        for i in range(n):
            close, shares = round(rng.uniform(1, 9), 2), shares + rng.choice([1.0, 2.0, 900.0])
            high = rng.choice([close + 1, close, -1.0])
            rows.append((k, datetime.date(2000, 1, 1) + datetime.timedelta(i), close, high, rng.choice([None, 5.0, rng.random()]), rng.uniform(-1, 1), shares))
    df = spark.createDataFrame(rows, "ticker string, trade_date date, close double, high double, trdval double, flow double, list_shrs double")
    return df.withColumn("bar", F.row_number().over(X.by_ticker())).repartition(3)


def test_factors_as_windows(spark):
    """Every factor as its window gives it: series of all lengths, over several batches, values missing, a ticker missing."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        bars = panel(spark, {"a": 1, "b": 40, "c": 330, None: 290, "d": 70, "e": 280}).withColumn("ret", X.daily_return())
        windows = {"ret5": X.trailing_return(5), "adv60": X.adv(), "surge": X.volume_surge(), "flow60": F.sum("flow").over(X.back(59)), "high_prox": X.high_proximity(), "issue_12m": X.issuance(252), "trend_short_0": X.trend(20), "trend_long_1": X.trend(252)}
        charts = {"composite": "composite", "recency": "recency"} | {c: c for c in X.chart_columns()}
        jumps = {"jump": F.try_divide("list_shrs", F.lag("list_shrs", 1).over(X.by_ticker())), "px": F.try_divide("close", F.lag("close", 1).over(X.by_ticker()))}
        old = X.golden_cross(X.bollinger(bars.withColumns(windows).withColumns(X.chart_columns()))).withColumns(jumps)
        old = old.withColumns(dict(zip(("split_like", "extreme"), X.split_flags(252)))).withColumn("alignment", F.col("alignment").cast("double"))
        shown = ["ticker", "trade_date", *windows, *charts, "split_like", "extreme"]
        new = X.factor_bars(bars.drop("ret"), None, X.chart, X.CHART)
        same(new.select(*shown), old.select(*shown), ["ticker", "trade_date"])
        asked = X.factor_bars(bars.drop("ret").withColumn("asked", F.col("bar") % 7 == 0), "asked", X.chart, X.CHART)
        same(asked.select(*shown), old.filter("bar % 7 = 0").select(*shown), ["ticker", "trade_date"])
        assert "Window" not in plan(X.factor_bars(bars.drop("ret", "bar")))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ranks_as_windows(spark):
    rng = random.Random(3)
    rows = [(s, i, rng.choice("xyz"), rng.choice([None, float(rng.randrange(9)), rng.random(), float("nan") if s == 2 else -0.0])) for s in (1, 2, 3) for i in range(60)] + [(4, 1, None, None), (5, 1, None, 2.0)]
    df = spark.createDataFrame(rows, "sel int, ticker int, sector string, v double")
    w = Window.partitionBy("sel")
    want = df.withColumns({"r": midrank(F.col("v"), "sel"), "in_sector": midrank(F.col("v"), "sel", "sector"), "q": F.percentile("v", 0.4).over(w)})
    got = over_sections(df, ["v", "sector"], ["r", "in_sector", "q"], lambda s: {"r": midranks(s["v"]), "in_sector": midranks(s["v"], s["sector"]), "q": every(quantiles(s["v"], 0.4)[0], len(s["v"]))}, "sel")
    same(got.drop("v"), want.drop("v"), ["sel", "ticker"])
    fine = df.filter("sel <> 2")
    want = fine.withColumn("r", G.rank_of(F.col("v"), "sel"))
    same(over_sections(fine, ["v"], ["r"], lambda s: {"r": midranks(held(s["v"], 0.01, 0.99))}, "sel").select("sel", "ticker", "r"), want.select("sel", "ticker", "r"), ["sel", "ticker"])


def test_no_windows_over_a_cross_section(spark):
    """Ranks of a cross-section sort numbers, not its rows, and no frame goes on to the end of a series."""
    stocks = L.stocks_at(spark, SF).localCheckpoint()
    assert "Window" not in plan(G.bpp_scores(stocks, "long", L.FLOOR, with_issuance=True))
    prices = spark.createDataFrame([(1, d, float(d)) for d in range(1, 30, 3)], "ticker int, day int, close double")
    picks = spark.createDataFrame([(1, 1), (4, 1), (6, 1), (28, 1), (40, 1), (5, 2), (None, 1)], "sel_day int, ticker int")
    found = Z.around(prices, picks, "sel_day")
    assert "unboundedfollowing" not in plan(found).lower().replace(" ", "")
    shown = {(r.sel_day, r.ticker): (r["last"] and r["last"].day, r["next"] and r["next"].day) for r in found.collect()}
    assert shown == {(1, 1): (1, 4), (4, 1): (4, 7), (6, 1): (4, 7), (28, 1): (28, None), (40, 1): (28, None), (5, 2): (None, None), (None, 1): (None, 1)}


def test_last_rows_of_selection_days(spark):
    bars = P.with_bars(P.weekly_panel(spark.read.parquet(f"{SF}/lineitem.parquet")))
    days = P.market_days(bars)
    sels = spark.createDataFrame([(d,) for d in (1, 30, 31, 200)], "sel_day int")
    marked = H.marked_days(bars, days, sels).filter("asked").join(sels, (F.col("day") <= F.col("sel_day")) & (F.col("sel_day") < F.col("until"))).select("sel_day", "ticker", "day")
    want = bars.join(days, "trade_date").join(sels, F.col("day") <= F.col("sel_day")).groupBy("sel_day", "ticker").agg(F.max("day").alias("day"))
    assert sorted(map(tuple, marked.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("p", (0.0, 0.05, 0.5, 1.0))
def test_global_quantile(spark, p):
    df = spark.createDataFrame([(float(i % 37),) for i in range(500)] + [(None,)], "v double").repartition(5)
    assert ranks.global_quantile(df, "v", p).collect() == df.agg(F.percentile("v", p).alias("v")).collect()
    assert ranks.global_quantile(df.filter("v > 99"), "v", p).collect()[0].v is None


def test_forward_returns_deal_prices_once(spark):
    """Entry and target looked up one after the other give what two lookups of their own give, also without a ticker, close or entry, and for repeated picks."""
    rng = random.Random(9)
    days = spark.createDataFrame([(d,) for d in range(1, 61)], "day int").withColumn("trade_date", F.expr("date_add(DATE '2024-01-01', day * 7)"))
    rows = [(t, d, None if rng.random() < 0.05 else 50 + rng.random()) for t in (None, *range(15)) for d in range(1, 40 + (t or 0)) if rng.random() < 0.25 + (t or 0) / 20]
    panel = spark.createDataFrame(rows, "ticker long, day int, close double").join(days, "day").drop("day").repartition(3)
    picks = spark.createDataFrame([(s, t) for s in (*range(1, 70, 3), 1, None) for t in (None, *range(17))], "sel_day int, ticker long")
    got = Z.forward_returns(panel, days, picks, (0, 4, 13))
    assert plan(got).count("Exchange hashpartitioning(ticker") == 1

    prices, end = panel.join(days, "trade_date").select("ticker", "day", "close"), 60
    used = Z.entries(prices, picks).withColumn("horizon", F.explode(F.array(F.lit(0), F.lit(4), F.lit(13)))).withColumn("target", F.col("used") + F.col("horizon"))
    want = []
    for r in Z.around(prices, used, "target").collect():
        at = r.last.close if r.last and r.last.day == r.target else None
        before = r.last.close if r.last and r.used is not None and r.last.day > r.used else None
        if r.sel_day is not None and r.sel_day + 1 > end:
            status = "insufficient"
        elif r.used is None:
            status = "absent"
        elif r.target > end:
            status = "insufficient"
        else:
            status = "ok" if at is not None else "gap" if r.next else "delisted" if before is not None else "insufficient" if r.target + Z.LOOKAHEAD > end else "delisted"
        price = at if at is not None else before if before is not None else r.next.close if r.next else None
        ret = None if status in ("absent", "insufficient") else round(price / r.p0 - 1, 8) if price is not None and r.p0 is not None else -1.0
        want.append((r.sel_day, r.ticker, r.horizon, ret, status))
    key = lambda r: repr((r[0], r[1], r[2], r[4], None if r[3] is None else f"{r[3]:.6f}"))
    assert sorted(map(key, got.collect())) == sorted(map(key, want)) and {r.status for r in got.collect()} == {"ok", "gap", "delisted", "absent", "insufficient"}
