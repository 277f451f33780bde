"""Queries of report blocks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelforge.functions.lineage import settle
from panelforge.functions.ranks import global_quantile
from panelforge.functions.scalar import midrank
from panelforge.operators import forward as Z
from panelforge.operators import reports as R
from panelforge.plans.common import Registry, meta_of
from panelforge.plans.evaluation_queries import HORIZONS, PICKS_SQL, base, forward, selection_days, top_picks
from panelforge.plans.factor_queries import _midrank_sql
from panelforge.sources.tables import read_table

register = Registry()

RANKS_SQL = PICKS_SQL + f""", fx AS (SELECT s.sel_day, s.ticker, s.score, m.mktcap, CASE WHEN m.mktcap > 0 THEN m.mktcap END AS cap FROM score s JOIN meta m USING (ticker)),
fr AS (SELECT sel_day, ticker, {_midrank_sql('score', 'sel_day')} AS a, {_midrank_sql('cap', 'sel_day')} AS b, {_midrank_sql('mktcap % 97', 'sel_day')} AS c FROM fx)"""


def factor_ranks(spark, sf_dir, score):
    rows = score.join(meta_of(spark, sf_dir), "ticker").withColumn("cap", F.when(F.col("mktcap") > 0, F.col("mktcap"))).withColumn("odd", F.col("mktcap") % 97)
    return rows.select("sel_day", "ticker", *[midrank(F.col(c), "sel_day").alias(n) for n, c in (("a", "score"), ("b", "cap"), ("c", "odd"))])


@register(RANKS_SQL + """, lg AS (SELECT sel_day, ticker, d AS dropped, round(((CASE WHEN d <> 'a' THEN coalesce(a, 0) ELSE 0 END) + (CASE WHEN d <> 'b' THEN coalesce(b, 0) ELSE 0 END) + (CASE WHEN d <> 'c' THEN coalesce(c, 0) ELSE 0 END))
  / nullif((a IS NOT NULL AND d <> 'a')::INT + (b IS NOT NULL AND d <> 'b')::INT + (c IS NOT NULL AND d <> 'c')::INT, 0), 8) AS s FROM fr, (VALUES ('none'), ('a'), ('b'), ('c')) v(d)),
tp AS (SELECT * FROM lg WHERE s IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sel_day, dropped ORDER BY s DESC, ticker) <= 10)
SELECT t.dropped, count(w.ticker) AS hits FROM tp t LEFT JOIN win w ON w.sel_day = t.sel_day AND w.ticker = t.ticker AND w.horizon = 13 GROUP BY t.dropped""")
def factor_ablation(spark, sf_dir):
    score, returns = forward(spark, sf_dir)
    winners = Z.winners(returns).filter("horizon = 13")
    hits = R.ablation(settle(factor_ranks(spark, sf_dir, score)), ["a", "b", "c"], winners, 10, "sel_day")
    return hits.groupBy("dropped").agg(F.sum("hits").alias("hits"))


@register(RANKS_SQL + """, rs AS (SELECT sel_day, ticker FROM fr WHERE b IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sel_day ORDER BY b DESC, ticker) <= 20),
ms AS (SELECT w.sel_day, w.ticker FROM win w WHERE w.horizon = 13 AND NOT EXISTS (SELECT 1 FROM pick p WHERE p.sel_day = w.sel_day AND p.ticker = w.ticker))
SELECT ms.sel_day, count(*) AS missed, count(rs.ticker) AS recovered, round(count(rs.ticker) / (count(*) * (SELECT count(*) FROM rs r2 WHERE r2.sel_day = ms.sel_day) / 100.0), 6) AS ratio FROM ms LEFT JOIN rs ON rs.sel_day = ms.sel_day AND rs.ticker = ms.ticker GROUP BY ms.sel_day""")
def reserve_recovery(spark, sf_dir):
    score, returns = forward(spark, sf_dir)
    w = Window.partitionBy("sel_day").orderBy(F.desc("b"), "ticker")
    reserve = factor_ranks(spark, sf_dir, score).filter("b IS NOT NULL").withColumn("r", F.row_number().over(w)).filter("r <= 20").select("sel_day", "ticker")
    missed = Z.winners(returns).filter("horizon = 13").join(top_picks(score), ["sel_day", "ticker"], "left_anti").select("sel_day", "ticker")
    return R.recovery(missed, reserve, F.lit(100.0), "sel_day")


@register(PICKS_SQL + """, thin AS (SELECT quantile_cont(trdval, 0.05) AS floor FROM panel), g AS (SELECT f.*, p.trdval AS at_pick FROM fwd f JOIN days d ON d.day = f.sel_day LEFT JOIN panel p ON p.ticker = f.ticker AND p.trade_date = d.trade_date WHERE f.status = 'gap')
SELECT horizon, count(*) AS gaps, count(*) FILTER (at_pick >= floor) AS usable, count(*) FILTER (at_pick IS NULL) AS untraded FROM g, thin GROUP BY horizon""")
def thin_gaps(spark, sf_dir):
    bars, days, score = base(spark, sf_dir)
    returns = settle(Z.forward_returns(bars, days, settle(score), HORIZONS))
    asked = days.join(selection_days(days).withColumnRenamed("sel_day", "day"), "day")  # a row for each period
    at = bars.join(F.broadcast(asked), "trade_date").select("ticker", F.col("day").alias("sel_day"), F.col("trdval").alias("at_pick"))
    floor = global_quantile(bars, "trdval", 0.05).withColumnRenamed("trdval", "floor")
    g = returns.filter("status = 'gap'").join(at, ["ticker", "sel_day"], "left").join(F.broadcast(floor))  # a single row
    return g.groupBy("horizon").agg(F.count(F.lit(1)).alias("gaps"), F.count_if(F.col("at_pick") >= F.col("floor")).alias("usable"), F.count_if(F.col("at_pick").isNull()).alias("untraded"))


@register("""WITH c AS (SELECT c_mktsegment AS config, CAST(o_orderstatus AS VARCHAR) AS regime, round(avg(o_totalprice), 6) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
l AS (SELECT c.config, c.regime, round(c.value - b.value, 6) AS lift FROM c JOIN c b ON b.regime = c.regime AND b.config = 'BUILDING' WHERE c.config <> 'BUILDING')
SELECT config, count(*) FILTER (lift > 0) AS wins, count(*) AS regimes, arg_max(regime, {'l': lift, 'r': regime}) AS best, arg_min(regime, {'l': lift, 'r': regime}) AS worst, bool_and(lift >= 0) AND bool_or(lift > 0) AS adopt FROM l GROUP BY config""")
def config_adjudication(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").join(read_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    cells = o.groupBy(F.col("c_mktsegment").alias("config"), F.col("o_orderstatus").alias("regime")).agg(F.round(F.avg("o_totalprice"), 6).alias("value"))
    return R.adjudicate(cells, "BUILDING")


@register("""WITH p AS (SELECT o_custkey AS period, count(*) AS n, max(o_orderdate) AS last, count(DISTINCT o_orderstatus) AS states, sum(o_totalprice) AS total FROM orders GROUP BY 1)
SELECT period, CASE WHEN n < 5 THEN 'too_few' WHEN last < TIMESTAMP '2000-06-01' THEN 'stale' WHEN states < 2 THEN 'one_regime' WHEN total < 1000000 THEN 'small' ELSE 'eligible' END AS reason FROM p""")
def eligibility_reasons(spark, sf_dir):
    p = read_table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("period")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("last"), F.count_distinct("o_orderstatus").alias("states"), F.sum("o_totalprice").alias("total"))
    steps = (("too_few", F.col("n") < 5), ("stale", F.col("last") < F.lit("2000-06-01").cast("timestamp")), ("one_regime", F.col("states") < 2), ("small", F.col("total") < 1_000_000))
    return p.select("period", R.reason(*steps).alias("reason"))


@register("""WITH v AS (SELECT event_type AS persona, least(100.0, greatest(0.0, value)) AS conviction, CAST(json_extract(props, '$.k') AS DOUBLE) / 100 - 0.5 AS ret FROM events)
SELECT persona, count(*) FILTER (conviction >= 50) AS calls, round(avg(CASE WHEN conviction >= 50 THEN (ret > 0)::INT END), 6) AS hit_rate, round(sum(conviction * ret) / sum(conviction), 6) AS weighted FROM v GROUP BY persona""")
def reflection_metrics(spark, sf_dir):
    v = read_table(spark, sf_dir, "events").select(F.col("event_type").alias("persona"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("value"))).alias("conviction"), (F.get_json_object("props", "$.k").cast("double") / 100 - 0.5).alias("ret"))
    return R.reflection(v)


@register("""WITH y AS (SELECT c_nationkey AS corp, year(o_orderdate) AS y, round(sum(o_totalprice), 2) AS revenue, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -o_totalprice / 4 END), 2) AS income, round(sum(c_acctbal), 2) AS equity, round(count(*) * 1000.0::DOUBLE, 2) AS debt FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
b AS (SELECT *, lag(revenue) OVER (PARTITION BY corp ORDER BY y) AS before FROM y),
p AS (SELECT corp, y, CASE WHEN equity > 0 THEN income / equity END AS a, CASE WHEN equity > 0 THEN -debt / equity END AS b, CASE WHEN revenue > 0 THEN income / revenue END AS c, CASE WHEN before > 0 THEN revenue / before - 1 END AS d FROM b),
n AS (SELECT *, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT + (d IS NOT NULL)::INT AS metrics FROM p)
SELECT corp, y, metrics, round(CASE WHEN metrics >= 3 THEN (coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) + coalesce(d, 0)) / metrics ELSE 0.0 END, 6) AS quality FROM n""")
def quality_scores(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").join(read_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    y = o.groupBy(F.col("c_nationkey").alias("corp"), F.year("o_orderdate").alias("y")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.round(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(-F.col("o_totalprice") / 4)), 2).alias("income"),
        F.round(F.sum("c_acctbal"), 2).alias("equity"), F.round(F.count(F.lit(1)) * 1000.0, 2).alias("debt"),
    )
    y = y.withColumn("before", F.lag("revenue", 1).over(Window.partitionBy("corp").orderBy("y")))
    q, n = R.quality(*(F.col(c) for c in ("revenue", "income", "equity", "debt", "before")))
    return y.select("corp", "y", n.alias("metrics"), F.round(q, 6).alias("quality"))


ALIASES = [("purchase", "sales", 1), ("view", "sales", 2), ("click", "visits", 1), ("signup", "visits", 2)]


@register(f"""WITH a(name, account, priority) AS (VALUES {', '.join(map(str, ALIASES))}), l AS (SELECT user_id, event_type AS name, round(sum(value), 4) AS v FROM events GROUP BY ALL)
SELECT user_id, account, arg_min(v, priority) AS v FROM l JOIN a USING (name) GROUP BY ALL""")
def account_aliases(spark, sf_dir):
    lines = read_table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 4).alias("v"))
    return R.first_alias(lines, spark.createDataFrame(ALIASES, "name string, account string, priority int"), "user_id", "event_type", "v")


@register("""WITH p AS (SELECT CAST(o_orderdate AS DATE) AS date, o_custkey AS ticker, round(0.3 * row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey) / 10, 8) AS weight, o_totalprice AS value FROM orders),
t AS (SELECT date, sum(weight) AS weight, sum(value) AS value FROM p GROUP BY date)
SELECT date, ticker, false AS is_cash, round(weight, 6) AS weight, round(value, 2) AS value FROM p UNION ALL SELECT date, NULL, false, 1.0, round(value, 2) FROM t UNION ALL SELECT date, NULL, true, round(round(1 - weight, 8), 6), 0.0 FROM t WHERE round(1 - weight, 8) > 0""")
def portfolio_snapshot(spark, sf_dir):
    return snapshots(read_table(spark, sf_dir, "orders"))


def snapshots(orders):
    o = orders.withColumn("date", F.to_date("o_orderdate"))
    w = Window.partitionBy("date").orderBy("o_orderkey")
    p = o.select("date", F.col("o_custkey").alias("ticker"), F.round(0.3 * F.row_number().over(w) / 10, 8).alias("weight"), F.col("o_totalprice").alias("value"))
    return R.snapshot_rows(p).select("date", "ticker", "is_cash", F.round("weight", 6).alias("weight"), F.round("value", 2).alias("value"))


@register("""WITH f AS (SELECT DISTINCT o_custkey AS ticker FROM orders WHERE o_totalprice > 450000), i AS (SELECT DISTINCT o_custkey AS ticker FROM orders WHERE o_totalprice BETWEEN 440000 AND 450000)
SELECT ticker, 'fresh' AS origin FROM f UNION ALL SELECT ticker, 'incumbent' FROM i WHERE ticker NOT IN (SELECT ticker FROM f)""")
def incumbent_merge(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    pick = lambda rule: o.filter(rule).select(F.col("o_custkey").alias("ticker")).distinct()
    return R.fresh_and_incumbents(pick("o_totalprice > 450000"), pick("o_totalprice BETWEEN 440000 AND 450000"), "ticker")


@register("""WITH m AS (SELECT event_type AS series, date_trunc('day', ts) AS d, arg_max(value, {'t': ts, 'e': event_id}) AS last FROM events GROUP BY ALL)
SELECT series, CAST(d AS DATE) AS d, round(last, 6) AS last, round(last - lag(last) OVER (PARTITION BY series ORDER BY d), 6) AS change, round(last - first_value(last) OVER (PARTITION BY series ORDER BY d), 6) AS rebased FROM m""")
def period_difference(spark, sf_dir):
    m = read_table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series"), F.to_date("ts").alias("d")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("last"))
    w = Window.partitionBy("series").orderBy("d")
    return m.select("series", "d", F.round("last", 6).alias("last"), F.round(F.col("last") - F.lag("last", 1).over(w), 6).alias("change"), F.round(F.col("last") - F.first("last").over(w), 6).alias("rebased"))


@register("""WITH m AS (SELECT o_orderpriority AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY ALL)
SELECT a.series, a.month, a.v, round(a.v / nullif(b.v, 0) - 1, 6) AS yoy FROM m a LEFT JOIN m b ON b.series = a.series AND b.month = CAST(a.month - INTERVAL 12 MONTH AS DATE)""")
def yoy_month(spark, sf_dir):
    m = read_table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series"), F.date_trunc("month", "o_orderdate").cast("date").alias("month")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    before = m.select("series", F.add_months("month", 12).alias("month"), F.col("v").alias("b"))
    return m.join(before, ["series", "month"], "left").select("series", "month", "v", F.round(F.col("v") / F.nullif("b", F.lit(0.0)) - 1, 6).alias("yoy"))


@register("""WITH p AS (SELECT user_id, CAST(ts AS DATE) AS session, event_type AS slot, event_id FROM events) SELECT user_id, session, slot, event_id FROM p QUALIFY row_number() OVER (PARTITION BY user_id, session ORDER BY CASE slot WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 ELSE 3 END, event_id) = 1""")
def session_history(spark, sf_dir):
    place = F.when(F.col("slot") == "purchase", 0).when(F.col("slot") == "signup", 1).when(F.col("slot") == "click", 2).otherwise(3)
    p = read_table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("session"), F.col("event_type").alias("slot"), "event_id")
    return p.withColumn("r", F.row_number().over(Window.partitionBy("user_id", "session").orderBy(place, "event_id"))).filter("r = 1").drop("r")


@register("""WITH t AS (SELECT TIMESTAMP '2024-01-20' AS now), g AS (SELECT user_id, count(*) FILTER (event_type = 'signup' AND ts >= now - INTERVAL 48 HOUR AND ts <= now) AS raised, count(DISTINCT user_id % 2) AS admins, max(ts) FILTER (event_type = 'purchase' AND ts <= now) AS last, any_value(now) AS now FROM events, t GROUP BY user_id)
SELECT user_id, raised, raised > 0 AS blocked, coalesce(last < now - INTERVAL 24 HOUR, true) AS expired, raised = 0 AND coalesce(last >= now - INTERVAL 7 DAY, false) AS allowed FROM g""")
def approval_gates(spark, sf_dir):
    now = F.lit("2024-01-20").cast("timestamp")
    hours = lambda h: now - F.expr(f"INTERVAL {h} HOURS")
    g = read_table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if((F.col("event_type") == "signup") & (F.col("ts") >= hours(48)) & (F.col("ts") <= now)).alias("raised"),
        F.max(F.when((F.col("event_type") == "purchase") & (F.col("ts") <= now), F.col("ts"))).alias("last"),
    )
    return g.select(
        "user_id", "raised", (F.col("raised") > 0).alias("blocked"), F.coalesce(F.col("last") < hours(24), F.lit(True)).alias("expired"),
        ((F.col("raised") == 0) & F.coalesce(F.col("last") >= hours(168), F.lit(False))).alias("allowed"),
    )
