"""Queries of panels and judges, of statements with a fallback, of grids of cells, and of the months of an exposure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators import backtest as B
from panelforge.operators import judges as J
from panelforge.operators import reports as R
from panelforge.plans import backtest_queries as K
from panelforge.plans.common import Registry, bars_of, rounded
from panelforge.sources.tables import read_table

register = Registry()

# A user is a ticker, an event a panel member's vote; its three scores come from the event's value and property.
VOTES_SQL = """WITH v AS (SELECT user_id AS ticker, event_id AS persona, CASE event_type WHEN 'purchase' THEN 1.5 WHEN 'signup' THEN 1.5 ELSE 1.0 END::DOUBLE AS weight,
  least(100.0, greatest(0.0, value))::DOUBLE AS short, CAST(json_extract(props, '$.k') AS DOUBLE) AS mid, CAST(event_id % 100 AS DOUBLE) AS long FROM events),
w AS (SELECT ticker, round(sum(weight * short) / sum(weight), 8) AS short, round(sum(weight * mid) / sum(weight), 8) AS mid, round(sum(weight * long) / sum(weight), 8) AS long FROM v GROUP BY ticker)"""


def votes(spark, sf_dir) -> DataFrame:
    weight = F.when(F.col("event_type").isin("purchase", "signup"), 1.5).otherwise(1.0)
    short = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("value")))
    return read_table(spark, sf_dir, "events").select(
        F.col("user_id").alias("ticker"), F.col("event_id").alias("persona"), weight.alias("weight"), short.alias("short"), F.get_json_object("props", "$.k").cast("double").alias("mid"), (F.col("event_id") % 100).cast("double").alias("long")
    )


def _targets_sql(track: str) -> str:
    frames = J.ACTIVE[track]
    best = "CASE " + " ".join(f"WHEN {f} = greatest({', '.join(frames)}) THEN '{f}'" for f in frames) + " END"
    near = " UNION ".join(f"SELECT ticker FROM (SELECT ticker, row_number() OVER (ORDER BY {f} DESC, ticker) AS p FROM w) WHERE p BETWEEN {J.PLACE - J.WINDOW + 1} AND {J.PLACE + J.WINDOW}" for f in frames)
    return f"""SELECT '{track}' AS track, ticker FROM (({near}) UNION (SELECT ticker FROM (SELECT ticker, s, row_number() OVER (ORDER BY s DESC, ticker) AS p, count(*) OVER () AS n
  FROM (SELECT ticker, round(stddev_pop(CASE b {' '.join(f"WHEN '{f}' THEN v.{f}" for f in frames)} END), 8) AS s FROM v JOIN (SELECT ticker, {best} AS b FROM w) USING (ticker) GROUP BY ticker)) WHERE s > 0 AND p <= ceil(n * {J.TOP_SHARE})))"""


@register(VOTES_SQL + " " + " UNION ALL ".join(map(_targets_sql, J.ACTIVE)))
def debate_targets(spark, sf_dir):
    panel = votes(spark, sf_dir)
    out = [J.debate_targets(panel, track).select(F.lit(track).alias("track"), "ticker") for track in J.ACTIVE]
    return out[0].unionByName(out[1])


_BEST = "CASE WHEN {0}short >= {0}mid AND {0}short >= {0}long THEN 'short' WHEN {0}mid >= {0}long THEN 'mid' ELSE 'long' END".format
_JUDGE = "(SELECT ticker, {0} FROM v WHERE persona % 2 = {1} GROUP BY ticker)".format
_MEANS = ", ".join(f"round(sum(weight * {f}) / sum(weight), 8) AS {f}" for f in J.FRAMES)


@register(VOTES_SQL + f""", j AS (SELECT a.ticker, {_BEST('a.')} AS first_frame, {_BEST('b.')} AS second_frame, a.short AS s1, a.mid AS m1, a.long AS l1, b.short AS s2, b.mid AS m2, b.long AS l2 FROM {_JUDGE(_MEANS, 0)} a JOIN {_JUDGE(_MEANS, 1)} b USING (ticker)),
g AS (SELECT *, round(CASE first_frame WHEN 'short' THEN abs(s1 - s2) WHEN 'mid' THEN abs(m1 - m2) ELSE abs(l1 - l2) END, 8) AS gap FROM j)
SELECT ticker, first_frame, second_frame, gap, first_frame <> second_frame OR gap > {J.DELTA} AS differ FROM g""")
def judge_disagreement(spark, sf_dir):
    """Two judges: the means of the even and of the odd votes."""
    panel = votes(spark, sf_dir)
    judge = lambda k: J.weighted(panel.filter(F.col("persona") % 2 == k))
    return J.disagreement(judge(0), judge(1))


@register(VOTES_SQL + " " + " UNION ".join(f"SELECT ticker FROM (SELECT ticker, row_number() OVER (ORDER BY {f} DESC, ticker) AS p FROM w) WHERE p BETWEEN {J.PLACE - J.JUDGE_WINDOW + 1} AND {J.PLACE + J.JUDGE_WINDOW}" for f in J.ACTIVE["midlong"]))
def judge_boundary(spark, sf_dir):
    """The tickers that a second judge scores as well, of the longer track."""
    return J.boundary(J.weighted(votes(spark, sf_dir)), J.ACTIVE["midlong"], J.JUDGE_WINDOW)


SCOPE_SQL = """WITH s AS (SELECT l_suppkey AS corp, year(l_shipdate) AS year, CASE l_returnflag WHEN 'R' THEN 'CFS' WHEN 'A' THEN 'OFS' END AS scope, l_orderkey % 3 AS account, l_extendedprice AS amount FROM lineitem)"""


@register(SCOPE_SQL + """, b AS (SELECT corp, year, min(scope) AS scope FROM s WHERE scope IS NOT NULL AND account <> 0 GROUP BY ALL)
SELECT corp, year, scope, count(*) AS lines, round(sum(amount), 2) AS amount FROM s JOIN b USING (corp, year, scope) WHERE account <> 0 GROUP BY ALL""")
def statement_fallback(spark, sf_dir):
    """Of each company and year the consolidated statement's lines, else the separate one's; some lines have no account."""
    scope = F.when(F.col("l_returnflag") == "R", "CFS").when(F.col("l_returnflag") == "A", "OFS")
    lines = read_table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("corp"), F.year("l_shipdate").alias("year"), scope.alias("scope"), (F.col("l_orderkey") % 3).alias("account"), F.col("l_extendedprice").alias("amount")).filter("account <> 0")
    return R.preferred_scope(lines, ("CFS", "OFS"), "corp", "year").groupBy("corp", "year", "scope").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum("amount"), 2).alias("amount"))


@register("""WITH c AS (SELECT c_mktsegment AS config, strftime(o_orderdate, '%Y-%m') AS regime, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f, bool_or(o_orderpriority = '1-URGENT') AS urgent FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
g AS (SELECT config, regime FROM (SELECT DISTINCT config FROM c) CROSS JOIN (SELECT DISTINCT regime FROM c)),
i AS (SELECT config, regime, n IS NULL AS missing, array_to_string(list_filter([CASE WHEN n < 20 THEN 'too few' END, CASE WHEN f > n / 2 THEN 'mostly final' END, CASE WHEN NOT urgent THEN 'nothing urgent' END], lambda x: x IS NOT NULL), ',') AS reasons FROM g LEFT JOIN c USING (config, regime))
SELECT config, regime, CASE WHEN missing THEN 'missing' ELSE 'invalid' END AS issue, CASE WHEN missing THEN '' ELSE reasons END AS reasons FROM i WHERE missing OR reasons <> ''""")
def grid_issues(spark, sf_dir):
    """What a grid of market segments and months lacks, and which of its cells break a rule."""
    o = read_table(spark, sf_dir, "orders").join(read_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    cells = o.groupBy(F.col("c_mktsegment").alias("config"), F.date_format("o_orderdate", "yyyy-MM").alias("regime")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("urgent")
    )
    rules = (("too few", F.col("n") >= 20), ("mostly final", F.col("f") <= F.col("n") / 2), ("nothing urgent", F.col("urgent")))
    return R.grid_issues(cells, cells.select("config").distinct(), cells.select("regime").distinct(), rules)


@register(K.ASKED_SQL + K.FOLD_SQL + """ SELECT ticker, CAST(date_trunc('month', trade_date) AS DATE) AS month, round(arg_max(ln(value), trade_date), 6) AS last_value, round(avg(exposure), 6) AS position, round(max(level), 6) AS most_level, arg_max(regime, trade_date) AS last_regime FROM f WHERE bar > 0 GROUP BY ALL""")
def exposure_months(spark, sf_dir):
    """The monthly table: a series' last value (its logarithm), mean exposure, highest warning and last regime."""
    path = B.exposure_path(B.signal_bars(bars_of(spark, sf_dir))).withColumn("log_value", F.log("value"))
    return B.months(path, "log_value").select("ticker", "month", *rounded("last_value", "position", "most_level"), "last_regime")
