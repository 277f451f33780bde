"""Queries of audits: schedules, unfinished periods, share histories, probes and extracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.operators import audits as O
from panelforge.plans.common import Registry
from panelforge.sources.tables import read_table

register = Registry()


@register("""WITH l AS (SELECT user_id, CASE WHEN event_type IN ('view', 'click') THEN 'kr' ELSE 'us' END AS market, max(ts) AS ts FROM events GROUP BY ALL),
s AS (SELECT user_id, market, CAST(ts AS DATE) AS d, isodow(ts) AS w, CASE WHEN market = 'us' THEN 'daily' WHEN hour(ts) < 12 THEN 'am' ELSE 'pm' END AS slot FROM l),
n AS (SELECT user_id, market, slot, CASE slot WHEN 'am' THEN CAST(d AS TIMESTAMP) + INTERVAL 505 MINUTE WHEN 'pm' THEN CAST(d + CASE w WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS TIMESTAMP) + INTERVAL 140 MINUTE ELSE CAST(d + CASE w WHEN 6 THEN 3 WHEN 7 THEN 2 ELSE 1 END AS TIMESTAMP) - INTERVAL 45 MINUTE END AS due FROM s)
SELECT user_id, market, slot, due, TIMESTAMP '2024-01-29' > due + INTERVAL 12 HOUR AS stale FROM n""")
def snapshot_staleness(spark, sf_dir):
    market = F.when(F.col("event_type").isin("view", "click"), "kr").otherwise("us")
    s = read_table(spark, sf_dir, "events").groupBy("user_id", market.alias("market")).agg(F.max("ts").alias("ts"))
    s = s.withColumn("slot", F.when(F.col("market") == "us", "daily").when(F.hour("ts") < 12, "am").otherwise("pm")).withColumn("due", O.next_schedule(F.to_date("ts"), F.col("slot")))
    return s.select("user_id", "market", "slot", "due", (F.lit("2024-01-29").cast("timestamp") > F.col("due") + F.expr("INTERVAL 12 HOURS")).alias("stale"))


@register("""WITH r AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, min(o_orderdate) AS created, count(*) FILTER (o_orderstatus IN ('O', 'P')) AS open_jobs, count(*) FILTER (o_orderstatus = 'F') AS done_jobs FROM orders GROUP BY 1), t AS (SELECT max(o_orderdate) AS now FROM orders)
SELECT period, open_jobs, done_jobs, open_jobs > 0 AND created > now - INTERVAL 60 DAY AND period <> CAST(date_trunc('month', now) AS DATE) AS orphan FROM r, t""")
def orphan_periods(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders")
    r = orders.groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("period")).agg(
        F.min("o_orderdate").alias("created"), F.count_if(F.col("o_orderstatus").isin("O", "P")).alias("open_jobs"), F.count_if(F.col("o_orderstatus") == "F").alias("done_jobs")
    )
    r = r.join(F.broadcast(orders.agg(F.max("o_orderdate").alias("now"))))  # a single row
    orphan = (F.col("open_jobs") > 0) & (F.col("created") > F.col("now") - F.expr("INTERVAL 60 DAYS")) & (F.col("period") != F.date_trunc("month", "now").cast("date"))
    return r.select("period", "open_jobs", "done_jobs", orphan.alias("orphan"))


@register("""WITH y AS (SELECT o_custkey AS k, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL), g AS (SELECT k, min(n) FILTER (y IN (1995, 1996)) AS lo, max(n) FILTER (y IN (1995, 1996)) AS hi, max(n) FILTER (y = 1997) AS eff FROM y GROUP BY k)
SELECT k, CASE WHEN lo IS NULL THEN 'no_history' WHEN lo <> hi THEN 'not_flat' WHEN eff IS NULL THEN 'no_effective' WHEN eff = hi THEN 'unchanged' WHEN eff < hi THEN 'decrease' ELSE 'proven' END AS state FROM g""")
def share_history(spark, sf_dir):
    y = read_table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    before = F.when(F.col("y").isin(1995, 1996), F.col("n"))
    g = y.groupBy("k").agg(F.min(before).alias("lo"), F.max(before).alias("hi"), F.max(F.when(F.col("y") == 1997, F.col("n"))).alias("eff"))
    lo, hi, eff = F.col("lo"), F.col("hi"), F.col("eff")
    return g.select("k", F.when(lo.isNull(), "no_history").when(lo != hi, "not_flat").when(eff.isNull(), "no_effective").when(eff == hi, "unchanged").when(eff < hi, "decrease").otherwise("proven").alias("state"))


@register("""WITH m AS (SELECT c_nationkey AS artifact, c_mktsegment AS market, min(o_orderdate) AS old, max(o_orderdate) AS recent, CASE WHEN count(*) FILTER (o_orderstatus = 'P') > 20 THEN 2 WHEN count(*) FILTER (o_orderstatus = 'P') > 1 THEN 1 ELSE 0 END AS status FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT artifact, CASE WHEN bool_and(old <= TIMESTAMP '1995-12-01' AND recent >= TIMESTAMP '2000-12-01') THEN max(status) ELSE 9 END AS exit_status, count(*) AS markets FROM m GROUP BY artifact""")
def survivorship_status(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").join(read_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    partial = F.count_if(F.col("o_orderstatus") == "P")
    m = o.groupBy(F.col("c_nationkey").alias("artifact"), F.col("c_mktsegment").alias("market")).agg(F.min("o_orderdate").alias("old"), F.max("o_orderdate").alias("recent"), F.when(partial > 20, 2).when(partial > 1, 1).otherwise(0).alias("status"))
    brackets = F.bool_and((F.col("old") <= F.lit("1995-12-01").cast("timestamp")) & (F.col("recent") >= F.lit("2000-12-01").cast("timestamp")))
    return m.groupBy("artifact").agg(F.when(brackets, F.max("status")).otherwise(9).alias("exit_status"), F.count(F.lit(1)).alias("markets"))


@register("""SELECT c_custkey AS k, coalesce(CAST(to_json(list({'o': o_orderkey, 's': o_orderstatus} ORDER BY o_orderkey) FILTER (o_orderkey IS NOT NULL)) AS VARCHAR), '[]') AS candidates FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def extract_envelopes(spark, sf_dir):
    """One JSON document for each customer with all its orders; a customer's orders are the bound of a row."""
    rows = F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("o"), F.col("o_orderstatus").alias("s"))))
    o = read_table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.to_json(rows).alias("j"))
    return read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).join(o, "k", "left").select("k", F.coalesce("j", F.lit("[]")).alias("candidates"))
