"""Folds over many series, the chart composite, staged buckets and verdicts, against plain versions."""

import datetime
import random

import numpy as np
import pandas as pd
import pytest
from panelforge.functions import lineage
from panelforge.operators import folds
from panelforge.operators import harvest as H
from pyspark.sql import functions as F


def plain_rsi(v, n=14):
    d = [b - a for a, b in zip(v, v[1:])]
    up, down = (sum(max(s * x, 0) for x in d[:n]) / n for s in (1, -1))
    for x in d[n:]:
        up, down = (up * (n - 1) + max(x, 0)) / n, (down * (n - 1) + max(-x, 0)) / n
    return 50.0 if up == down == 0 else 100.0 if down == 0 else 100 - 100 / (1 + up / down)


def test_folds_of_many_series(spark, monkeypatch):
    """Series of all lengths, more than are stepped together; each as if it were alone."""
    rng = random.Random(1)
    series = {k: [100 + rng.random() for _ in range(rng.randrange(1, 60))] for k in range(40)} | {98: [5.0] * 30, 99: [float(i) for i in range(1, 50)]}
    rows = [(k, datetime.datetime(2024, 1, 1) + datetime.timedelta(i), v) for k, s in series.items() for i, v in enumerate(s)]
    df = spark.createDataFrame(rows, "ticker long, trade_date timestamp, close double").repartition(3)
    got = {k: [] for k in series}
    for r in folds.fold_series(df, ["close"], [], ["rsi", "macd"], folds.momentum).orderBy("ticker", "trade_date").collect():
        got[r.ticker].append(r)
    for k, s in series.items():
        assert [r.rsi is None for r in got[k]] == [i < 14 for i in range(len(s))]
        assert all(r.rsi == pytest.approx(plain_rsi(s[: i + 1])) for i, r in enumerate(got[k]) if i >= 14)
        assert [r.macd is None for r in got[k]] == [i < 33 for i in range(len(s))]
    alone = folds.stepped([pd.DataFrame({"close": series[k]}) for k in series], ["close"], folds.momentum)
    monkeypatch.setattr(folds, "TOGETHER", 3)
    assert len(alone) == len(rows) and folds.fold_series(df.limit(0), ["close"], [], ["rsi"], folds.momentum).count() == 0


def scored(spark, rows):
    return spark.createDataFrame(rows, "sel int, bucket string, ticker string, sleeve string, score double")


def test_order_of_buckets_is_data(spark):
    """Two periods with opposite orders: the ticker that is best everywhere goes to the first stage of each."""
    rows = [(s, b, t, "large", v) for s in (1, 2) for b in ("short", "mid", "long") for t, v in (("best", 9.0), ("next", 5.0), ("third", 3.0), ("none", None))]
    labels = spark.createDataFrame([(1, "bear"), (2, "bull")], "sel int, label string")
    picked = H.staged_buckets(scored(spark, rows), H.regime_stages(labels), {"large": 1, "mid": 0, "small": 0}, "sel").collect()
    assert {(r.sel, r.bucket): r.ticker for r in picked} == {(1, "short"): "best", (1, "mid"): "next", (1, "long"): "third", (2, "long"): "best", (2, "mid"): "next", (2, "short"): "third"}


def test_pooled_top_of_each_size(spark):
    rows = [(1, b, f"{b}{i}", "large", 10.0 - i) for b in ("short", "mid", "long") for i in range(5)]
    top = H.pooled_top(scored(spark, rows), (3, 7), "sel").groupBy("n").agg(F.array_sort(F.collect_list("ticker")).alias("t")).collect()
    assert {r.n: r.t for r in top} == {3: ["long0", "mid0", "short0"], 7: ["long0", "long1", "long2", "mid0", "mid1", "short0", "short1"]}


def test_left_out_scores_are_means_of_the_others(spark):
    rng = np.random.default_rng(0)
    ranks = rng.random((20, 3)) * 100
    df = spark.createDataFrame([(1, f"t{i}", *map(float, r)) for i, r in enumerate(ranks)], "sel int, ticker string, a double, b double, c double")
    got = {(r.dropped, r.ticker): r.score for r in H.left_out(df, ["a", "b", "c"]).collect()}
    assert len(got) == 80
    for i, r in enumerate(ranks):
        assert got[None, f"t{i}"] == pytest.approx(r.mean(), abs=1e-8) and got["b", f"t{i}"] == pytest.approx((r[0] + r[2]) / 2, abs=1e-8)


def samples(spark, values):
    return spark.createDataFrame([(i, "short", s, f, v) for (s, f), vs in values.items() for i, v in enumerate(vs)], "sel int, bucket string, scope string, factor string, rho double")


def test_kill_switch_states(spark):
    quiet = {(s, f): [0.1, 0.2, None] for s in H.SCOPES for f in ("trend", "full", "size")}
    states = lambda v: {(r.scope, r.factor): r.state for r in H.kill_switch(samples(spark, v)).collect()}
    got = states(quiet)
    assert len(got) == 20 and got["mid", "full"] == "quiet" and got["mid", "size"] == "reported" and got["large", "flow"] == "off" and got["large", "surge"] == "not applicable"
    assert states(quiet | {("large", "trend"): [-0.6, -0.5]})["large", "trend"] == "fired"  # the mean, either way
    assert states(quiet | {("large", "full"): [0.1, 0.1, 0.6]})["large", "full"] == "fired"  # the interval's upper end
    assert states(quiet | {("large", "size"): [0.9, 0.9]})["large", "size"] == "reported"  # never binding
    assert states(quiet | {("small", "trend"): [None, None]})["small", "trend"] == "blocked"


def test_verdicts(spark):
    def of(v, fails):
        return H.verdict(H.kill_switch(samples(spark, v)), spark.createDataFrame([(fails,)], "fails string")).first()

    quiet = {(s, f): [0.1, 0.2] for s in H.SCOPES for f in ("trend", "full")}
    assert of(quiet, "").decision == "SELECTOR_GATE_PASS" and of(quiet, "lift,ic").asDict() == {"decision": "SELECTOR_GATE_FAIL", "appendix": False, "reasons": "lift,ic"}
    blocked = of(quiet | {("mid", "trend"): [None]}, "")
    assert blocked.asDict() == {"decision": "KILLSWITCH_BLOCKED", "appendix": True, "reasons": "mid/trend"}
    assert of(quiet | {("mid", "trend"): [None], ("large", "full"): [0.7, 0.8]}, "").decision == "KILLSWITCH_FIRED"


def test_gate_falls_back_to_the_mean(spark):
    rows = [(0.01, 0.02, 0.4), (-0.01, 0.2, 0.4), (None, 0.06, 0.4), (None, 0.04, 0.4), (0.01, 0.02, 0.2), (0.01, 0.02, float("inf")), (0.01, 0.02, None)]
    df = spark.createDataFrame(rows, "low double, lift double, ir double")
    got = [r.f for r in df.select(F.array_join(H.gate(F.col("low"), F.col("lift"), F.col("ir")), ",").alias("f")).collect()]
    assert got == ["", "lift", "", "lift", "ic", "ic", "ic"]


def test_reserve_takes_the_place_of_the_worst(spark):
    df = lambda rows: spark.createDataFrame([(1, t, s) for t, s in rows], "sel int, ticker string, score double")
    base, reserve = df([("a", 9.0), ("b", 2.0), ("c", 1.0), ("d", 1.0)]), df([("a", 99.0), ("x", 50.0), ("y", 40.0), ("z", 30.0)])
    assert sorted(r.ticker for r in H.with_reserve(base, reserve, 2, "sel").collect()) == ["a", "b", "x", "y"]
    assert sorted(r.ticker for r in H.with_reserve(base, df([("a", 1.0)]), 2, "sel").collect()) == ["a", "b", "c", "d"]


def test_blend_needs_a_score_and_a_bull(spark):
    rows = [(1, "short", "a", 1.0, 5.0), (1, "short", "b", 2.0, None), (1, "short", "c", None, 9.0), (1, "short", "d", 3.0, 1.0), (2, "short", "a", 1.0, 5.0)]
    df = spark.createDataFrame(rows, "sel int, bucket string, ticker string, score double, earnings double")
    labels = spark.createDataFrame([(1, "bull"), (2, "bear")], "sel int, label string")
    got = {(r.sel, r.ticker): r.score for r in H.earnings_blended(df, labels).collect()}
    assert got[1, "a"] == pytest.approx(0.5 * 100 / 3 + 50, abs=1e-6) and got[1, "b"] == pytest.approx(0.5 * 200 / 3 + 25, abs=1e-6) and got[1, "c"] is None
    assert got[1, "d"] == pytest.approx(50 + 25, abs=1e-6) and got[2, "a"] == 1.0


def test_period_without_winners_is_left_out(spark):
    picks = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "sel int, ticker string")
    won = spark.createDataFrame([(1, 4, "a", 0.1), (1, 13, "a", 0.2), (1, 4, "z", 0.3)], "sel_day int, horizon int, ticker string, ret double")
    universe = spark.createDataFrame([(s, t) for s in (1, 2) for t in "abcz"], "sel int, ticker string")
    (r,) = H.recalls(picks, won, universe).collect()
    assert (r.sel, r.selected, r.hits, r.winners, r.recall, r.random, r.lift) == (1, 2, 1, 2, 0.5, 0.5, 0.0)
    # One with winners counts for every leg, also for those that pick nothing in it.
    legs = picks.filter("sel = 2").withColumn("leg", F.lit("x")).union(picks.filter("sel = 1").withColumn("leg", F.lit("y")))
    got = {r.leg: (r.selected, r.recall, r.random) for r in H.recalls(legs, won, universe, "leg").collect()}
    assert got == {"x": (0, 0.0, 0.0), "y": (2, 0.5, 0.5)}


def test_funnel_counts_by_horizon_and_size(spark):
    picks = spark.createDataFrame([("a", 1, "short", "p"), ("a", 1, "mid", "q"), ("a", 1, "long", "r"), ("b", 2, "short", "p")], "leg string, sel int, bucket string, ticker string")
    won = spark.createDataFrame([(1, 4, "p", 0.1), (1, 13, "p", 0.1), (1, 13, "r", 0.1), (1, 26, "r", 0.1), (1, 26, "z", 0.2)], "sel_day int, horizon int, ticker string, ret double")
    universe = spark.createDataFrame([(1, "p", "large"), (1, "q", "mid"), (1, "r", "small"), (1, "z", "mid"), (2, "p", "large")], "sel int, ticker string, tier string")
    horizons = {"short": 4, "mid": 13, "long": 26}
    counts = H.funnel(picks, won, universe, horizons)
    got = {r.leg: r for r in counts.collect()}
    a = got["a"]
    assert (a.selected, a["size"], a.num, a.den, a.lm_num, a.lm_den) == (3, 4, 2, 3, 1, 2)
    assert [(a[f"num_{b}"], a[f"den_{b}"]) for b in horizons] == [(1, 1), (0, 2), (1, 2)]
    assert (got["b"].selected, got["b"].num, got["b"].den) == (0, 0, 3)
    ics = spark.createDataFrame([("a", 1, 0.5)], "leg string, sel int, ic double")
    pooled = {r.leg: r for r in H.pooled(counts, ics, horizons).collect()}
    assert pooled["a"].overall == pytest.approx(2 / 3) and pooled["a"].largemid == 0.5 and pooled["a"].random == 0.75 and pooled["a"].recall_low is None and pooled["a"].ic_ir is None
    lift = H.marginal(counts, H.pooled(counts, ics, horizons), "b", "a").first()
    assert lift.lift == pytest.approx(2 / 3) and lift.d_overall == pytest.approx(0.6667) and lift.d_ic_mean is None


@pytest.mark.parametrize(
    "low,ir,mean,proven,want",
    [(0.1, 0.1, 0.2, True, "EXPLORATORY_LIFT"), (0.1, 0.1, 0.2, False, "BLOCKED"), (0.1, 0.1, -0.6, True, "NOT_ORTHOGONAL"), (-0.1, 0.1, 0.2, True, "EXPLORATORY_NO_LIFT"), (0.1, -0.1, 0.2, True, "EXPLORATORY_NO_LIFT"), (None, 0.1, 0.2, True, "EXPLORATORY_NO_LIFT"), (0.1, 0.1, None, True, "NOT_ORTHOGONAL")],
)
def test_marginal_verdicts(spark, low, ir, mean, proven, want):
    rho = {(s, "size"): [mean if s == "mid" else 0.1] for s in H.SCOPES}
    lift = spark.createDataFrame([(low, ir)], "lift_low double, d_ic_ir double")
    got = H.marginal_verdict(H.overlap_report(samples(spark, rho), ("size",)), lift, proven).first()
    assert got.verdict == want and got.raw == ("MARGINAL_LIFT" if want == "EXPLORATORY_LIFT" or not proven else "NO_MARGINAL_LIFT")


def sectors(spark, rows):
    return spark.createDataFrame(rows, "sel int, ticker int, sector string, m double")


def test_leading_sectors_are_the_best_share(spark):
    rows = [(1, i, s, v) for i, (s, v) in enumerate([("a", 3.0)] * 3 + [("b", 2.0)] * 3 + [("c", 1.0)] * 3 + [("d", 0.5)] * 3 + [("few", 9.0)] * 2)] + [(2, 0, "a", 1.0), (2, 1, "a", 1.0), (2, 2, "a", None)]
    got = {(r.sel, r.sector) for r in H.leading_sectors(sectors(spark, rows)).collect()}
    assert got == {(1, "a"), (1, "b")}  # 30 % of four, rounded up; two rows are too few


def test_arms_of_a_hypothesis(spark):
    stocks = sectors(spark, [(1, 1, "a", 1.0), (1, 2, "b", 1.0), (1, 3, "a", None), (2, 4, "b", 1.0)])
    leading = spark.createDataFrame([(1, "a")], "sel int, sector string")
    scored = spark.createDataFrame([(1, "short", 1, "a", "large", 5.0), (1, "short", 2, "b", "large", 9.0), (1, "short", 3, "a", "large", None)], "sel int, bucket string, ticker int, sector string, sleeve string, score double")
    assert {r.ticker: r.score for r in H.tilted(scored, leading).collect()} == {1: 15.0, 2: 9.0, 3: None}
    gate = H.gated(stocks, leading)
    # A period without a hypothesis isn't gated.
    assert sorted((r.sel, r.ticker) for r in gate.collect()) == [(1, 1), (1, 3), (2, 4)]
    picks = spark.createDataFrame([("mirror", 1, 1, "a"), ("mirror", 1, 2, "b"), ("gate", 1, 1, "a"), ("gate", 2, 4, "b"), ("gate", 2, 5, "b")], "arm string, sel int, ticker int, sector string")
    facts = {(r.arm, r.sel): r for r in H.arm_facts(picks, stocks, gate, 2, "gate").collect()}
    assert (facts["mirror", 1].status, facts["mirror", 1].sectors, facts["mirror", 1].gate_eligible) == ("logged", "a=1,b=1", None)
    assert (facts["gate", 1].status, facts["gate", 1].gate_eligible, facts["gate", 1].cut) == ("incomplete_run", 2, 1) and facts["gate", 2].status == "logged"
    assert facts["mirror", 1].universe_hash == facts["gate", 1].universe_hash != facts["gate", 2].universe_hash and facts["gate", 1].universe_size == 3
    won = spark.createDataFrame([(1, 4, 2, 0.25), (1, 13, 2, 0.5), (1, 13, 1, 0.9), (2, 4, 4, 0.1)], "sel_day int, horizon int, ticker int, ret double")
    assert {(r.sel, r.horizon): (r.cut_winners, r.mean_return, r.listed) for r in H.cut_winners(stocks, gate, won).collect()} == {(1, 4): (1, 0.25, "2:0.2500"), (1, 13): (1, 0.5, "2:0.5000")}


def test_listed_returns_are_rounded_as_by_the_sql(spark):
    """Halves in decimal text that are a little less as doubles."""
    import duckdb

    stocks = spark.createDataFrame([(1, i) for i in range(1, 5)], "sel int, ticker int")
    rets = [0.75245, 2.99685, 0.5, 0.00005]
    won = spark.createDataFrame([(1, 4, i + 1, r) for i, r in enumerate(rets)], "sel_day int, horizon int, ticker int, ret double")
    (got,) = H.cut_winners(stocks, stocks.limit(0), won).collect()
    want = [duckdb.execute("SELECT CAST(CAST(round(?::DOUBLE, 4) AS DECIMAL(20, 4)) AS VARCHAR)", [r]).fetchone()[0] for r in rets]
    assert got.listed == ",".join(f"{i + 1}:{w}" for i, w in enumerate(want)) and got.listed.startswith("1:0.7524,2:2.9968,")


def test_blocks_against_plain_ranks(spark):
    rng = np.random.default_rng(7)
    n = 30
    score, ret, trend = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)
    tiers = ["large"] * 10 + ["mid"] * 4 + ["small"] * 16
    columns = "sel int, bucket string, ticker int, eligible boolean, score double, rank_trend double, rank_flow double, rank_earnings double, rank_quality double"
    scored = spark.createDataFrame([(1, "short", i, True, float(score[i]), float(trend[i]), 50.0, None, float(score[i])) for i in range(n)] + [(1, "short", 99, False, 9.0, 9.0, 9.0, 9.0, 9.0)], columns)
    returns = spark.createDataFrame([(1, 4, i, float(ret[i])) for i in range(n)] + [(1, 4, 99, 9.0)], "sel_day int, horizon int, ticker int, ret double")
    universe = spark.createDataFrame([(1, i, t) for i, t in enumerate(tiers)] + [(1, 99, "large")], "sel int, ticker int, tier string")
    got = {r.block: r.value for r in H.harvest_blocks(scored, returns, universe, {"short": 4}).collect()}

    def spearman(a, b):
        return np.corrcoef(np.argsort(np.argsort(a)), np.argsort(np.argsort(b)))[0, 1]

    top = score >= np.quantile(score, 2 / 3)
    large = np.array(tiers) == "large"
    order = np.argsort(-score)
    want = {"ic": spearman(score, ret), "quality": spearman(score, ret), "trend": spearman(trend, ret), "top_tercile": spearman(score[top], ret[top]), "large": spearman(score[large], ret[large])}
    want["spread"] = ret[order[:3]].mean() - ret[order[-3:]].mean() - 0.004
    # Four of a tier are too few, a factor without values or without spread has no block.
    assert set(got) == set(want) and all(got[b] == pytest.approx(v, abs=1e-6) for b, v in want.items())


def test_ends_of_an_interval_are_rounded_as_by_the_sql(spark):
    import duckdb

    (r,) = spark.createDataFrame([(0.75245,), (0.75245,)], "v double").agg(*H.interval("v")).collect()
    assert [r.low, r.high] == [duckdb.execute("SELECT round(0.75245::DOUBLE, 4)").fetchone()[0]] * 2 == [0.7524, 0.7524]


def test_equal_values_in_many_partitions_have_no_correlation(spark):
    rows = spark.range(0, 2718, 1, 7).selectExpr("50.0D AS same", "cast(id * 37 % 101 AS double) AS y", "cast(id AS double) AS z")
    got = rows.agg(*[H.correlation(a, b).alias(f"{a}_{b}") for a, b in (("same", "y"), ("y", "same"), ("y", "z"))]).first()
    assert got.same_y is None and got.y_same is None and -1 < got.y_z < 1


@pytest.mark.parametrize("name,unread", [("chart_pairs", ("returns_of", "plain_scores")), ("chart_left_out", ("plain_scores",)), ("chart_kill_switch", ("returns_of",)), ("shadow_arms", ("returns_of",)), ("gate_cut_winners", ("plain_scores", "shadow"))])
def test_what_is_not_read_is_not_computed(spark, monkeypatch, name, unread):
    from panelforge.plans import harvest_queries as HQ

    def no(*_):
        raise AssertionError("computed")

    for f in unread:
        monkeypatch.setattr(HQ, f, no)
    HQ.register.queries[name](spark, "/root/testdata/sf0.001")


def test_gate_leaves_stocks_where_they_are(spark, monkeypatch):
    """A table of leading sectors is sent to the stocks while it is small, else both are dealt; the same stocks pass."""
    stocks = spark.createDataFrame([(s, None if i == 9 else f"x{i % 4}", i) for s in (1, 2, None) for i in range(10)], "sel int, sector string, ticker int")
    leading = spark.createDataFrame([(1, "x1"), (1, "x3"), (1, None), (3, "x1")], "sel int, sector string")
    small = H.gated(stocks, leading)
    monkeypatch.setattr(lineage.few, "__defaults__", (0,))
    large = H.gated(stocks, leading)
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(small) == rows(large) == sorted(map(repr, stocks.filter("sel IS NULL OR sel = 2 OR sector IN ('x1', 'x3')").collect()))
    hints = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast")
    assert (hints(small), hints(large)) == (2, 0)
