"""Queries of the point-in-time evaluation: forward returns, winners, metrics, gates and arms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.functions.lineage import settle
from panelforge.functions.scalar import midrank
from panelforge.operators import features as X
from panelforge.operators import forward as Z
from panelforge.operators import harvest as H
from panelforge.operators import panel as P
from panelforge.operators.rolling import over_bars
from panelforge.plans.common import Registry, bars_of, meta_of
from panelforge.plans.factor_queries import _midrank_sql

register = Registry()
HORIZONS = (4, 13, 26)

#: Selection days: the last day before every third month. Score: the close against its yearly mean.
BASE_SQL = P.PANEL_SQL + """,
dates AS (SELECT DISTINCT trade_date FROM panel), days AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS day FROM dates),
months AS (SELECT DISTINCT date_trunc('quarter', trade_date) AS month FROM dates), sels AS (SELECT max(day) AS sel_day FROM months JOIN days ON days.trade_date < months.month GROUP BY month),
px AS (SELECT ticker, day, close FROM panel JOIN days USING (trade_date)),
sc AS (SELECT ticker, trade_date, bar, close / avg(close) OVER (PARTITION BY ticker ORDER BY trade_date ROWS 51 PRECEDING) - 1 AS s FROM bars),
score AS (SELECT sel_day, ticker, round(CASE WHEN bar >= 52 THEN s END, 8) AS score FROM (SELECT sel_day, sc.*, row_number() OVER (PARTITION BY sel_day, ticker ORDER BY d.day DESC) AS n FROM sels JOIN days d ON d.day <= sels.sel_day JOIN sc ON sc.trade_date = d.trade_date) WHERE n = 1)"""
FORWARD_SQL = BASE_SQL + f""",
lastd AS (SELECT max(day) AS last_day FROM days), want AS (SELECT sel_day, ticker, h AS horizon, last_day FROM score, (VALUES {', '.join(f'({h})' for h in HORIZONS)}) v(h), lastd),
ent AS (SELECT w.*, min(CASE WHEN p.day BETWEEN sel_day + 1 AND sel_day + 6 THEN p.day END) AS used, arg_min(p.close, p.day) FILTER (p.day BETWEEN sel_day + 1 AND sel_day + 6) AS p0 FROM want w LEFT JOIN px p USING (ticker) GROUP BY ALL),
tgt AS (SELECT *, used + horizon AS target FROM ent),
aft AS (SELECT t.*, max(CASE WHEN p.day = target THEN p.close END) AS att, arg_max(p.close, p.day) FILTER (p.day > used AND p.day <= target) AS bef, arg_min(p.close, p.day) FILTER (p.day > target) AS nxt FROM tgt t LEFT JOIN px p USING (ticker) GROUP BY ALL),
st AS (SELECT *, CASE WHEN sel_day + 1 > last_day THEN 'insufficient' WHEN used IS NULL THEN 'absent' WHEN target > last_day THEN 'insufficient' WHEN att IS NOT NULL THEN 'ok' WHEN nxt IS NOT NULL THEN 'gap' WHEN bef IS NOT NULL THEN 'delisted'
  WHEN target + 5 > last_day THEN 'insufficient' ELSE 'delisted' END AS status FROM aft),
fwd AS (SELECT sel_day, ticker, horizon, round(CASE WHEN status IN ('ok', 'gap', 'delisted') THEN coalesce(coalesce(att, bef, nxt) / p0 - 1, -1.0) END, 8) AS ret, status FROM st),
win AS (SELECT * FROM fwd WHERE ret IS NOT NULL QUALIFY count(*) OVER (PARTITION BY sel_day, horizon) >= 10 AND ret >= quantile_cont(ret, 0.9) OVER (PARTITION BY sel_day, horizon) AND ret > 0)"""


def selection_days(days: DataFrame) -> DataFrame:
    """sel_day of each quarter: the last market day strictly before it."""
    last = days.groupBy(F.date_trunc("quarter", "trade_date").alias("quarter")).agg(F.max("day").alias("last"))
    return last.select(F.lag("last", 1).over(Window.orderBy("quarter")).alias("sel_day")).filter("sel_day IS NOT NULL")  # a row a quarter


def base(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bars, days, score): score is sel_day, ticker, score from each ticker's last bar up to the selection day."""
    bars = settle(bars_of(spark, sf_dir))
    days = settle(P.market_days(bars))
    sels = selection_days(days)
    # The last bar up to each selection day: bars become intervals [day, next day), so no row is repeated.
    marked = H.marked_days(bars, days, sels).select("ticker", "trade_date", "day", "until", "asked", "close")
    spans = over_bars(marked, ["close"], ["s"], lambda _, asked: {"s": X.from_mean(asked)}, "asked")
    score = spans.join(F.broadcast(sels), (F.col("day") <= F.col("sel_day")) & (F.col("sel_day") < F.col("until")))  # at most a row a quarter
    return bars, days, score.select("sel_day", "ticker", F.round("s", 8).alias("score"))


def forward(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    bars, days, score = base(spark, sf_dir)
    score = settle(score)
    return score, settle(Z.forward_returns(bars, days, score, HORIZONS))


@register(FORWARD_SQL + " SELECT sel_day, ticker, horizon, round(ret, 6) AS ret, status FROM fwd")
def forward_return_status(spark, sf_dir):
    return forward(spark, sf_dir)[1].withColumn("ret", F.round("ret", 6))


@register(FORWARD_SQL + " SELECT horizon, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'gap') AS gap, count(*) FILTER (status = 'delisted') AS delisted, count(*) FILTER (status = 'insufficient') AS insufficient, count(*) FILTER (status = 'absent') AS absent FROM fwd GROUP BY horizon")
def status_counts(spark, sf_dir):
    states = ["ok", "gap", "delisted", "insufficient", "absent"]
    return forward(spark, sf_dir)[1].groupBy("horizon").agg(*[F.count_if(F.col("status") == s).alias(s) for s in states])


@register(FORWARD_SQL + " SELECT sel_day, horizon, ticker, round(ret, 6) AS ret FROM win")
def winners_decile(spark, sf_dir):
    return Z.winners(forward(spark, sf_dir)[1]).withColumn("ret", F.round("ret", 6))


PICKS_SQL = FORWARD_SQL + ", pick AS (SELECT sel_day, ticker, score FROM score WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sel_day ORDER BY score DESC, ticker) <= 10)"


def top_picks(score: DataFrame, n: int = 10) -> DataFrame:
    w = Window.partitionBy("sel_day").orderBy(F.desc("score"), "ticker")
    return score.filter("score IS NOT NULL").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n).drop("r")


@register(PICKS_SQL + """ SELECT w.horizon, count(p.ticker) AS hits, count(*) AS winners, round(count(p.ticker) / count(*), 6) AS recall FROM win w LEFT JOIN pick p ON p.sel_day = w.sel_day AND p.ticker = w.ticker GROUP BY w.horizon""")
def recall_by_horizon(spark, sf_dir):
    score, returns = forward(spark, sf_dir)
    picks = top_picks(score).select("sel_day", "ticker", F.lit(1).alias("hit"))
    joined = Z.winners(returns).join(picks, ["sel_day", "ticker"], "left")
    return joined.groupBy("horizon").agg(F.count("hit").alias("hits"), F.count(F.lit(1)).alias("winners"), F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("recall"))


IC_SQL = FORWARD_SQL + f""", both_ AS (SELECT f.sel_day, horizon, s.score, f.ret FROM fwd f JOIN score s ON s.sel_day = f.sel_day AND s.ticker = f.ticker WHERE f.ret IS NOT NULL AND s.score IS NOT NULL),
rk AS (SELECT *, {_midrank_sql('score', 'sel_day', 'horizon')} AS a, {_midrank_sql('ret', 'sel_day', 'horizon')} AS b FROM both_),
ic AS (SELECT sel_day, horizon, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(corr(a, b), 8) END AS ic FROM rk GROUP BY ALL)"""


def monthly_ic(spark, sf_dir) -> DataFrame:
    score, returns = forward(spark, sf_dir)
    both = returns.filter("ret IS NOT NULL").join(score.filter("score IS NOT NULL"), ["sel_day", "ticker"])
    ranked = both.withColumns({"a": midrank(F.col("score"), "sel_day", "horizon"), "b": midrank(F.col("ret"), "sel_day", "horizon")})
    return ranked.groupBy("sel_day", "horizon").agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= 3, F.round(F.corr("a", "b"), 8)).alias("ic"))


@register(IC_SQL + " SELECT sel_day, horizon, n, round(ic, 6) AS ic FROM ic")
def rank_ic(spark, sf_dir):
    return monthly_ic(spark, sf_dir).withColumn("ic", F.round("ic", 6))


@register(IC_SQL + """ SELECT horizon, round(avg(ic), 6) AS mean_ic, round(avg(ic) / stddev_pop(ic), 6) AS ir, round(avg(ic) / stddev_samp(ic), 6) AS ir_sample, round(avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive,
  round(median(ic), 6) AS median_ic, round(quantile_cont(ic, 0.05), 4) AS low, round(quantile_cont(ic, 0.95), 4) AS high, round(quantile_cont(ic, 0.05 / 3), 6) AS adjusted_low FROM ic WHERE ic IS NOT NULL GROUP BY horizon""")
def ic_summary(spark, sf_dir):
    ic = F.col("ic")
    return monthly_ic(spark, sf_dir).filter("ic IS NOT NULL").groupBy("horizon").agg(
        F.round(F.avg(ic), 6).alias("mean_ic"), F.round(Z.information_ratio(ic), 6).alias("ir"), F.round(Z.information_ratio(ic, True), 6).alias("ir_sample"),
        F.round(F.avg(F.when(ic > 0, 1.0).otherwise(0.0)), 6).alias("positive"), F.round(F.percentile(ic, 0.5), 6).alias("median_ic"),
        F.round(F.percentile(ic, 0.05), 4).alias("low"), F.round(F.percentile(ic, 0.95), 4).alias("high"), F.round(F.percentile(ic, 0.05 / 3), 6).alias("adjusted_low"),
    )


@register(IC_SQL + " SELECT sel_day, horizon, round(avg(ic) OVER (PARTITION BY horizon ORDER BY sel_day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS prior_ic FROM ic")
def expanding_prior_ic(spark, sf_dir):
    w = Window.partitionBy("horizon").orderBy("sel_day").rowsBetween(Window.unboundedPreceding, -1)
    return monthly_ic(spark, sf_dir).select("sel_day", "horizon", F.round(F.avg("ic").over(w), 6).alias("prior_ic"))


@register(IC_SQL + """, dd AS (SELECT f.sel_day, horizon, f.ticker, s.score, f.ret, count(*) OVER w AS n, row_number() OVER (w ORDER BY s.score DESC, f.ticker) AS top, row_number() OVER (w ORDER BY s.score, f.ticker DESC) AS low FROM fwd f JOIN score s ON s.sel_day = f.sel_day AND s.ticker = f.ticker
  WHERE f.ret IS NOT NULL AND s.score IS NOT NULL WINDOW w AS (PARTITION BY f.sel_day, horizon))
SELECT sel_day, horizon, round(avg(CASE WHEN top <= n // 10 THEN ret END) - avg(CASE WHEN low <= n // 10 THEN ret END) - 0.004, 6) AS spread, count(*) AS n FROM dd WHERE n >= 10 GROUP BY ALL""")
def decile_spread(spark, sf_dir):
    score, returns = forward(spark, sf_dir)
    return Z.decile_spread(returns.join(score, ["sel_day", "ticker"]), "sel_day", "horizon")


@register(PICKS_SQL + """, en AS (SELECT k.sel_day, k.ticker, min(CASE WHEN p.day BETWEEN k.sel_day + 1 AND k.sel_day + 6 THEN p.day END) AS used, arg_min(p.close, p.day) FILTER (p.day BETWEEN k.sel_day + 1 AND k.sel_day + 6) AS p0 FROM pick k JOIN px p USING (ticker) GROUP BY ALL)
SELECT sel_day, ticker, min(CASE WHEN p.day > used AND p.day <= used + 26 AND p.close / p0 - 1 >= 0.1 THEN p.day - used END) AS lead FROM en JOIN px p USING (ticker) GROUP BY ALL""")
def lead_time(spark, sf_dir):
    bars, days, score = base(spark, sf_dir)
    return Z.lead_time(bars, days, top_picks(score).select("sel_day", "ticker"), 26, 0.1)


@register(PICKS_SQL + """, pr AS (SELECT sel_day, row_number() OVER (ORDER BY sel_day) AS i FROM (SELECT DISTINCT sel_day FROM pick))
SELECT a.sel_day, count(b.ticker) AS repeated, round(1 - count(b.ticker) / count(*), 6) AS churn, round(count(b.ticker) / (20.0 - count(b.ticker)), 6) AS jaccard
FROM (SELECT pick.*, i FROM pick JOIN pr USING (sel_day)) a LEFT JOIN (SELECT pick.*, i FROM pick JOIN pr USING (sel_day)) b ON b.ticker = a.ticker AND b.i = a.i - 1 WHERE a.i > 1 GROUP BY a.sel_day""")
def selection_churn(spark, sf_dir):
    _, _, score = base(spark, sf_dir)
    picks = settle(top_picks(score).withColumn("i", F.dense_rank().over(Window.orderBy("sel_day"))))  # ten rows a quarter
    before = picks.select("ticker", (F.col("i") + 1).alias("i"), F.lit(1).alias("again"))
    return picks.filter("i > 1").join(before, ["ticker", "i"], "left").groupBy("sel_day").agg(
        F.count("again").alias("repeated"), F.round(1 - F.count("again") / F.count(F.lit(1)), 6).alias("churn"),
        F.round(F.count("again") / (20.0 - F.count("again")), 6).alias("jaccard"),
    )


@register(PICKS_SQL + """, sv AS (SELECT f.sel_day, f.horizon, f.ticker, f.ret, m.market, f.ret - avg(f.ret) OVER (PARTITION BY f.sel_day, f.horizon, m.market) AS excess, f.ret - avg(f.ret) OVER (PARTITION BY f.sel_day, f.horizon) AS eqw FROM fwd f JOIN meta m USING (ticker) WHERE f.ret IS NOT NULL)
SELECT sv.horizon, round(avg(ret), 6) AS basket, round(avg(eqw), 6) AS eqw_excess, round(avg(excess), 6) AS sleeve_excess, round(avg(ret) - 0.004, 6) AS net FROM sv JOIN pick p ON p.sel_day = sv.sel_day AND p.ticker = sv.ticker GROUP BY sv.horizon""")
def selection_performance(spark, sf_dir):
    score, returns = forward(spark, sf_dir)
    rows = returns.filter("ret IS NOT NULL").join(meta_of(spark, sf_dir).select("ticker", "market"), "ticker")
    rows = rows.withColumn("excess", F.col("ret") - F.avg("ret").over(Window.partitionBy("sel_day", "horizon", "market")))
    rows = rows.withColumn("eqw", F.col("ret") - F.avg("ret").over(Window.partitionBy("sel_day", "horizon")))
    picked = rows.join(top_picks(score).select("sel_day", "ticker"), ["sel_day", "ticker"])
    return picked.groupBy("horizon").agg(
        F.round(F.avg("ret"), 6).alias("basket"), F.round(F.avg("eqw"), 6).alias("eqw_excess"), F.round(F.avg("excess"), 6).alias("sleeve_excess"), F.round(F.avg("ret") - Z.COST, 6).alias("net")
    )


#: Two arms: the best ten by score, and the best ten among the larger half of instruments.
ARMS_SQL = PICKS_SQL + """, big AS (SELECT ticker FROM meta QUALIFY mktcap >= median(mktcap) OVER ()),
arm AS (SELECT sel_day, ticker FROM score WHERE score IS NOT NULL AND ticker IN (SELECT ticker FROM big) QUALIFY row_number() OVER (PARTITION BY sel_day ORDER BY score DESC, ticker) <= 10),
al AS (SELECT f.sel_day, f.horizon, avg(f.ret) FILTER (f.ticker IN (SELECT ticker FROM pick p WHERE p.sel_day = f.sel_day)) AS base_ret, avg(f.ret) FILTER (f.ticker IN (SELECT ticker FROM arm a WHERE a.sel_day = f.sel_day)) AS arm_ret FROM fwd f WHERE f.ret IS NOT NULL GROUP BY ALL),
lift AS (SELECT *, round(arm_ret - base_ret, 8) AS lift FROM al WHERE arm_ret IS NOT NULL AND base_ret IS NOT NULL)"""


def arm_lifts(spark, sf_dir) -> DataFrame:
    score, returns = forward(spark, sf_dir)
    instruments = meta_of(spark, sf_dir)
    big = instruments.join(F.broadcast(instruments.agg(F.percentile("mktcap", 0.5).alias("m")))).filter("mktcap >= m").select("ticker")  # a single row
    base_picks = top_picks(score).select("sel_day", "ticker", F.lit(1).alias("in_base"))
    arm_picks = top_picks(score.join(big, "ticker", "left_semi")).select("sel_day", "ticker", F.lit(1).alias("in_arm"))
    rows = returns.filter("ret IS NOT NULL").join(base_picks, ["sel_day", "ticker"], "left").join(arm_picks, ["sel_day", "ticker"], "left")
    means = rows.groupBy("sel_day", "horizon").agg(F.avg(F.when(F.col("in_base") == 1, F.col("ret"))).alias("base_ret"), F.avg(F.when(F.col("in_arm") == 1, F.col("ret"))).alias("arm_ret"))
    return means.filter("base_ret IS NOT NULL AND arm_ret IS NOT NULL").withColumn("lift", F.round(F.col("arm_ret") - F.col("base_ret"), 8))


@register(ARMS_SQL + """ SELECT horizon, count(*) AS periods, round(avg(lift), 6) AS lift, round(quantile_cont(lift, 0.05), 4) AS low, round(quantile_cont(lift, 0.95), 4) AS high,
 CASE WHEN count(*) < 6 THEN 'insufficient' WHEN quantile_cont(lift, 0.05) > 0 THEN 'pass' WHEN quantile_cont(lift, 0.95) < 0 THEN 'fail' ELSE 'inconclusive' END AS verdict FROM lift GROUP BY horizon""")
def paired_lift(spark, sf_dir):
    low, high = F.percentile("lift", 0.05), F.percentile("lift", 0.95)
    verdict = F.when(F.count(F.lit(1)) < 6, "insufficient").when(low > 0, "pass").when(high < 0, "fail").otherwise("inconclusive")
    return arm_lifts(spark, sf_dir).groupBy("horizon").agg(
        F.count(F.lit(1)).alias("periods"), F.round(F.avg("lift"), 6).alias("lift"), F.round(low, 4).alias("low"), F.round(high, 4).alias("high"), verdict.alias("verdict")
    )


@register(ARMS_SQL + " SELECT horizon, round(regr_intercept(arm_ret, base_ret), 5) AS alpha, round(regr_slope(arm_ret, base_ret), 5) AS beta, min(base_ret) < 0 AND max(base_ret) > 0 AS brackets_zero FROM lift GROUP BY horizon")
def ols_beta(spark, sf_dir):
    return arm_lifts(spark, sf_dir).groupBy("horizon").agg(
        F.round(F.regr_intercept("arm_ret", "base_ret"), 5).alias("alpha"), F.round(F.regr_slope("arm_ret", "base_ret"), 5).alias("beta"),
        ((F.min("base_ret") < 0) & (F.max("base_ret") > 0)).alias("brackets_zero"),
    )


@register(PICKS_SQL + """ SELECT horizon, count(*) AS missed, count(*) FILTER (s.score >= 0.7) AS trending, count(*) FILTER (s.score IS NULL) AS unscored FROM win w LEFT JOIN score s ON s.sel_day = w.sel_day AND s.ticker = w.ticker
WHERE NOT EXISTS (SELECT 1 FROM pick p WHERE p.sel_day = w.sel_day AND p.ticker = w.ticker) GROUP BY horizon""")
def missed_winners(spark, sf_dir):
    score, returns = forward(spark, sf_dir)
    missed = Z.winners(returns).join(top_picks(score), ["sel_day", "ticker"], "left_anti").join(score, ["sel_day", "ticker"], "left")
    return missed.groupBy("horizon").agg(F.count(F.lit(1)).alias("missed"), F.count_if(F.col("score") >= 0.7).alias("trending"), F.count_if(F.col("score").isNull()).alias("unscored"))


@register(FORWARD_SQL + """, rw AS (SELECT s.sel_day, m.market, s.score, m.mktcap FROM score s JOIN meta m USING (ticker) WHERE s.score IS NOT NULL AND m.mktcap > 0)
SELECT sel_day, market, count(*) AS n, round(corr(score, ln(mktcap)), 6) AS rho FROM rw GROUP BY GROUPING SETS ((sel_day), (sel_day, market)) HAVING count(*) >= 3""")
def orthogonality_scopes(spark, sf_dir):
    _, _, score = base(spark, sf_dir)
    rows = score.filter("score IS NOT NULL").join(meta_of(spark, sf_dir).filter("mktcap > 0"), "ticker")
    return rows.groupingSets([["sel_day"], ["sel_day", "market"]], "sel_day", "market").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("score", F.ln("mktcap")), 6).alias("rho")).filter("n >= 3")


@register(FORWARD_SQL + """, sd AS (SELECT DISTINCT sel_day FROM fwd), RECURSIVE_KEPT AS (SELECT 1)
SELECT sel_day FROM (SELECT list_reduce(list_prepend([-1000::BIGINT], list_transform(list(sel_day ORDER BY sel_day), lambda x: [x::BIGINT])), lambda a, x: CASE WHEN x[1] >= a[-1] + 26 THEN list_concat(a, x) ELSE a END) AS kept FROM sd), unnest(kept) t(sel_day) WHERE sel_day > 0""".replace(", RECURSIVE_KEPT AS (SELECT 1)", ""))
def nonoverlap_decimate(spark, sf_dir):
    """Periods kept greedily so that their horizons don't overlap: a fold over the sorted selection days."""
    _, days, _ = base(spark, sf_dir)
    listed = selection_days(days).agg(F.array_sort(F.collect_set("sel_day")).alias("d"))  # a number for each quarter
    kept = F.aggregate("d", F.expr("CAST(array() AS array<int>)"), lambda a, x: F.when((F.size(a) == 0) | (x >= F.element_at(F.concat(F.array(F.lit(-1000)), a), -1) + 26), F.concat(a, F.array(x))).otherwise(a))
    return listed.select(F.explode(kept).alias("sel_day"))


@register("""WITH v AS (SELECT o_orderpriority AS arm, round(o_totalprice / 1000, 2) AS v FROM orders), c AS (SELECT arm, v, count(*) AS n FROM v GROUP BY ALL)
SELECT arm, round(sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n), 6) AS tie_fraction FROM c GROUP BY arm""")
def tie_fraction(spark, sf_dir):
    from panelforge.sources.tables import read_table

    v = read_table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("arm"), F.round(F.col("o_totalprice") / 1000, 2).alias("v")).groupBy("arm", "v").agg(F.count(F.lit(1)).alias("n"))
    return v.groupBy("arm").agg(F.round(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("tie_fraction"))


@register("""WITH p AS (SELECT date_trunc('quarter', o_orderdate) AS period, o_custkey, o_orderstatus, o_orderpriority FROM orders),
f AS (SELECT period, count(DISTINCT o_custkey) AS tickers, bool_and(o_orderstatus <> 'P') AS all_final, bool_or(o_orderpriority = '1-URGENT') AS any_urgent, count(*) FILTER (o_orderstatus = 'F') AS final, count(*) AS n FROM p GROUP BY period)
SELECT CAST(period AS DATE) AS period, tickers, all_final, any_urgent, CASE WHEN n = 0 THEN 'missing' WHEN final = n THEN 'complete' WHEN final > 0.3 * n THEN 'partial' ELSE 'anomaly' END AS coverage FROM f""")
def coverage_facts(spark, sf_dir):
    from panelforge.sources.tables import read_table

    p = read_table(spark, sf_dir, "orders").withColumn("period", F.date_trunc("quarter", "o_orderdate").cast("date"))
    f = p.groupBy("period").agg(
        F.count_distinct("o_custkey").alias("tickers"), F.bool_and(F.col("o_orderstatus") != "P").alias("all_final"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("any_urgent"),
        F.count_if(F.col("o_orderstatus") == "F").alias("final"), F.count(F.lit(1)).alias("n"),
    )
    state = F.when(F.col("n") == 0, "missing").when(F.col("final") == F.col("n"), "complete").when(F.col("final") > 0.3 * F.col("n"), "partial").otherwise("anomaly")
    return f.select("period", "tickers", "all_final", "any_urgent", state.alias("coverage"))
