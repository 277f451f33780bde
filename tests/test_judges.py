"""Panels, judges, statement scopes and grids, on small cases."""

import datetime

from panelforge.operators import backtest as B
from panelforge.operators import judges as J
from panelforge.operators import reports as R
from pyspark.sql import functions as F

VOTES = "ticker string, persona int, weight double, short double, mid double, long double"


def test_boundary_is_a_window_around_the_last_place(spark):
    scores = spark.createDataFrame([(f"t{i:02d}", float(100 - i), float(i)) for i in range(1, 31)], "ticker string, mid double, long double")
    got = sorted(r.ticker for r in J.boundary(scores, ("mid",), 2).collect())
    assert got == ["t09", "t10", "t11", "t12"]
    both = {r.ticker for r in J.boundary(scores, ("mid", "long"), 2).collect()}
    assert both == {*got, "t22", "t21", "t20", "t19"}


def test_debate_targets(spark):
    """Thirty tickers in order; three panels that differ, one of them only in a timeframe that isn't its best."""
    rows = [(f"t{i:02d}", p, 1.0, float(100 - i), 0.0, 0.0) for i in range(1, 31) for p in (1, 2)]
    spread = {"t28": (60.0, 84.0), "t29": (70.0, 72.0)}
    rows = [(t, p, w, spread[t][p - 1] if t in spread else s, m, x) for t, p, w, s, m, x in rows]
    got = {r.ticker for r in J.debate_targets(spark.createDataFrame(rows, VOTES), "short", window=1).collect()}
    assert got == {"t10", "t11", "t28", "t29"}  # a fifth of thirty would be six, but only two panels differ


def test_weights_and_ties(spark):
    votes = spark.createDataFrame([("a", 1, 3.0, 10.0, 5.0, 0.0), ("a", 2, 1.0, 30.0, 5.0, 60.0), ("b", 1, 0.0, 9.0, 9.0, 9.0)], VOTES)
    got = {r.ticker: (r.short, r.mid, r.long) for r in J.weighted(votes).collect()}
    assert got == {"a": (15.0, 5.0, 15.0), "b": (0.0, 0.0, 0.0)}
    assert J.weighted(votes).filter("ticker = 'a'").select(J.best_frame(J.FRAMES).alias("f")).first().f == "short"


def test_judges_disagree(spark):
    first = spark.createDataFrame([("same", 50.0, 40.0, 30.0), ("frame", 50.0, 40.0, 30.0), ("gap", 50.0, 40.0, 30.0), ("edge", 50.0, 40.0, 30.0), ("alone", 1.0, 1.0, 1.0)], "ticker string, short double, mid double, long double")
    second = spark.createDataFrame([("same", 55.0, 40.0, 30.0), ("frame", 39.0, 40.0, 30.0), ("gap", 66.0, 40.0, 30.0), ("edge", 65.0, 40.0, 30.0)], "ticker string, short double, mid double, long double")
    got = {r.ticker: (r.second_frame, r.gap, r.differ) for r in J.disagreement(first, second).collect()}
    assert got == {"same": ("short", 5.0, False), "frame": ("mid", 11.0, True), "gap": ("short", 16.0, True), "edge": ("short", 15.0, False)}


def test_preferred_scope(spark):
    lines = spark.createDataFrame([(1, "OFS", "a"), (1, "CFS", "b"), (1, "CFS", "c"), (2, "OFS", "d"), (3, "X", "e"), (4, None, "f")], "corp int, scope string, line string")
    assert sorted(r.line for r in R.preferred_scope(lines, ("CFS", "OFS"), "corp").collect()) == ["b", "c", "d"]


def test_grid_issues(spark):
    cells = spark.createDataFrame([("c1", "r1", 5, True), ("c1", "r2", 1, None), ("c2", "r1", 5, False)], "config string, regime string, n int, ok boolean")
    grid = R.grid_issues(cells, spark.createDataFrame([("c1",), ("c2",)], "config string"), spark.createDataFrame([("r1",), ("r2",)], "regime string"), (("few", F.col("n") >= 2), ("bad", F.col("ok"))))
    assert sorted((r.config, r.regime, r.issue, r.reasons) for r in grid.collect()) == [("c1", "r2", "invalid", "few,bad"), ("c2", "r1", "invalid", "bad"), ("c2", "r2", "missing", "")]


def test_months_of_an_exposure(spark):
    d = datetime.date
    rows = [(1, d(2024, 1, 3), "bull", 0.1, 1.0, 5.0), (1, d(2024, 1, 30), "bear", 0.3, 0.5, 4.0), (1, d(2024, 2, 1), "bull", 0.0, 0.7, 6.0)]
    path = spark.createDataFrame(rows, "ticker long, trade_date date, regime string, level double, exposure double, value double")
    got = sorted((r.month.month, r.last_value, r.position, r.most_level, r.last_regime) for r in B.months(path, "value").collect())
    assert got == [(1, 4.0, 0.75, 0.3, "bear"), (2, 6.0, 0.7, 0.0, "bull")]
