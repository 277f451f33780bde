import datetime
import math

import pytest
from panelforge.functions import scalar as S
from panelforge.operators import features as X
from panelforge.operators import forward as Z
from panelforge.operators import ops as O
from panelforge.operators import panel as P
from panelforge.operators import scoring as G
from panelforge.operators import selection as T
from pyspark.sql import functions as F


def column(spark, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def values(df, name="x"):
    return [r[name] for r in df.orderBy("i").collect()]


@pytest.mark.parametrize(
    "given, expected",
    [([10, 20, 30, 40], [12.5, 37.5, 62.5, 87.5]), ([10, None, 30], [25, None, 75]), ([5, 5, 10], [100 / 3, 100 / 3, 250 / 3]), ([42], [50])],
)
def test_midrank(spark, given, expected):
    got = values(column(spark, [None if v is None else float(v) for v in given]).withColumn("x", S.midrank(F.col("v"))))
    assert got == [None if e is None else pytest.approx(e) for e in expected]


def test_winsorize(spark):
    got = values(column(spark, [*map(float, range(1, 10)), 1000.0]).withColumn("x", S.winsorize(F.col("v"), 0.01, 0.99)))
    assert max(got) == pytest.approx(910.81) and min(got) == pytest.approx(1.09)


def test_row_mean_skips_nulls(spark):
    df = spark.createDataFrame([(0, 1.0, None), (1, None, None), (2, 1.0, 3.0)], "i int, a double, b double")
    assert values(df.withColumn("x", S.row_mean(F.col("a"), F.col("b")))) == [1.0, None, 2.0]


def test_parsers(spark):
    df = column(spark, ["1,234", "-", "N/A", "(1,234)", "12.5", ""], "string")
    assert values(df.withColumn("x", S.parse_number(F.col("v"))))[:3] == [1234.0, 0.0, 0.0]
    assert values(df.withColumn("x", S.parse_amount(F.col("v")))) == [1234.0, None, None, -1234.0, 12.5, None]


def test_strip_html(spark):
    assert values(column(spark, ["<p>a &amp; b</p> &lt;c&gt;"], "string").withColumn("x", S.strip_html(F.col("v")))) == ["a & b <c>"]


def bars(spark, closes, ticker=1, **extra):
    day = datetime.date(2024, 1, 1)
    rows = [(day + datetime.timedelta(i), ticker, float(c), float(c), 1.0, 5e9, 0.0) for i, c in enumerate(closes)]
    return P.with_bars(spark.createDataFrame(rows, "trade_date date, ticker long, close double, high double, volume double, trdval double, flow double"))


def last(df, name):
    return df.orderBy(F.desc("trade_date")).first()[name]


def test_trend(spark):
    up = bars(spark, [100, 101, 100, 102]).withColumn("ret", X.daily_return()).withColumn("x", X.trend(3, 0))
    assert last(up, "x") == pytest.approx(1.609, abs=2e-3)
    flat = bars(spark, [100] * 4).withColumn("ret", X.daily_return()).withColumn("x", X.trend(3, 0))
    assert last(flat, "x") is None


def test_high_proximity_and_adv(spark):
    assert last(bars(spark, [10, 20, 15]).withColumn("x", X.high_proximity()), "x") == 0.75
    assert last(bars(spark, [1] * 29).withColumn("x", X.adv()), "x") is None
    assert last(bars(spark, [1] * 30).withColumn("x", X.adv()), "x") == 5e9


def test_recursive_indicators(spark):
    assert X.ema(bars(spark, [1, 2, 3, 4, 5]), 5).first()["ema"] == 3.0
    assert X.wilder_rsi(bars(spark, range(1, 20))).first()["rsi"] == 100.0
    assert X.wilder_rsi(bars(spark, range(20, 1, -1))).first()["rsi"] == 0.0
    assert X.macd(bars(spark, [5] * 40)).first()["hist"] == pytest.approx(0.0)


def test_donchian_excludes_the_current_bar(spark):
    def donchian(closes):
        b = bars(spark, closes).withColumn("ret", X.daily_return())
        return last(b.withColumns(X.chart_columns()), "donchian")

    assert donchian([100] * 20 + [101]) == 1.0
    assert donchian([100] * 20 + [80]) == pytest.approx(0.8)


def test_scores(spark):
    one = column(spark, [80.0, 80.0, 30.0]).withColumn("t", F.element_at(F.array(F.lit(70.0), F.lit(40.0), F.lit(70.0)), F.col("i") + 1))
    assert values(one.withColumn("x", G.volume_bonus(F.col("v"), F.col("t"), "short"))) == [6.0, 0.0, 0.0]
    assert values(one.withColumn("x", G.volume_bonus(F.col("v"), F.col("t"), "long"))) == [0.0, 0.0, 0.0]
    missing = spark.createDataFrame([(0, 50.0, False), (1, None, False), (2, None, True)], "i int, v double, f boolean")
    assert values(missing.withColumn("x", G.fill_missing(F.col("v"), F.col("f")))) == [50.0, 50.0, 5.0]


def test_size_cuts(spark):
    cuts = column(spark, [float(v) for v in range(1, 11)]).agg(F.percentile("v", F.array(F.lit(0.8), F.lit(0.4))).alias("c")).first()["c"]
    assert cuts == [pytest.approx(8.2), pytest.approx(4.6)]


def test_sleeves_fill_shortfall(spark):
    rows = [(1, "large", 9.0), (2, "large", 8.0), (3, "large", 7.0), (4, "small", 1.0), (5, "mid", None)]
    got = T.select_sleeves(spark.createDataFrame(rows, "ticker int, sleeve string, score double"), {"large": 1, "mid": 1, "small": 1})
    assert sorted(r.ticker for r in got.collect()) == [1, 2, 4]


def market(spark, series):
    day = datetime.date(2024, 1, 1)
    rows = [(day + datetime.timedelta(i), t, float(c)) for t, closes in series.items() for i, c in enumerate(closes) if c is not None]
    panel = spark.createDataFrame(rows, "trade_date date, ticker string, close double")
    return panel, P.market_days(panel)


@pytest.mark.parametrize(
    "closes, horizon, expected",
    [
        ([100, 100, 105, 108, 110, 111], 3, ("ok", 0.1)),
        ([100, None, None, 100, 110, 130], 2, ("ok", 0.3)),
        ([100, 100, None, 100, None, 120, 121], 3, ("gap", 0.0)),
        ([100, 100, None, 100, None, None, None], 3, ("delisted", 0.0)),
        ([100, 100, *[None] * 10], 3, ("delisted", -1.0)),
        ([100, 100, None, None, None, None], 3, ("insufficient", None)),
        ([100, *[None] * 9], 3, ("absent", None)),
    ],
)
def test_forward_return(spark, closes, horizon, expected):
    panel, days = market(spark, {"a": closes, "m": [1] * len(closes)})
    r = Z.forward_returns(panel, days, spark.createDataFrame([(1, "a")], "sel_day int, ticker string"), (horizon,)).first()
    assert (r.status, r.ret) == (expected[0], None if expected[1] is None else pytest.approx(expected[1]))


def test_decile_spread(spark):
    rows = spark.createDataFrame([(1, f"t{i:02}", float(i), i / 100) for i in range(20)], "g int, ticker string, score double, ret double")
    assert Z.decile_spread(rows, "g").first()["spread"] == pytest.approx(0.176)


def test_longest_prefix(spark):
    rules = spark.createDataFrame([("26", "chips"), ("282", "batteries"), ("701", "unresolved")], "prefix string, label string")
    codes = spark.createDataFrame([("26110",), ("282",), ("70113",), ("999",)], "code string")
    assert {r.code: r.label for r in O.longest_prefix(codes, rules, 4).collect()} == {"26110": "chips", "282": "batteries", "70113": "unresolved", "999": None}


def test_anomaly(spark):
    rows = spark.createDataFrame([(0, 105000.0, 1e6), (1, 95000.0, 1e6), (2, 100000.0, 3e6), (3, 101000.0, 1e6)], "i int, p double, v double")
    got = values(rows.withColumn("x", O.anomaly(F.col("p"), F.lit(100000.0), F.col("v"), F.lit(1e6))))
    assert got == ["price_spike", "price_drop", "volume_surge", None]


def test_as_of_bound(spark):
    t = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    left = spark.createDataFrame([("a", t(5)), ("a", t(60)), ("b", t(5))], "k string, at timestamp")
    right = spark.createDataFrame([("a", t(1), 1.0), ("a", t(4), 2.0), ("a", t(6), 3.0)], "k string, ts timestamp, v double")
    got = {(r.k, r["at"]): r.v for r in O.as_of(left, right, "k", "at", "ts", "v", "1 DAY").collect()}
    assert got == {("a", t(5)): 2.0, ("a", t(60)): None, ("b", t(5)): None}


def test_information_ratio_without_spread(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.5), (2, 0.1), (2, 0.3)], "g int, v double")
    got = {r.g: r.x for r in df.groupBy("g").agg(Z.information_ratio(F.col("v")).alias("x")).collect()}
    assert got[1] == math.inf and got[2] == pytest.approx(2.0)
