"""Queries of extracts: documents made of a table's rows, read again under their rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.lineage import settle
from panelforge.operators import extracts as O
from panelforge.plans.common import Registry
from panelforge.sources.tables import read_table

register = Registry()

#: A week is a period, an order's priority its arm; a customer of the week's ten largest is a pick. An arm with an
#: order in progress counts as logged even if it has fewer than ten.
WEEKS_SQL = f"""WITH o AS (SELECT date_trunc('week', o_orderdate)::DATE AS week, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 0 WHEN '2' THEN 1 WHEN '3' THEN 2 ELSE 3 END AS a, o_custkey AS k, max(o_totalprice) AS price, bool_or(o_orderstatus = 'P') AS going FROM orders GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY week, a ORDER BY price DESC, k) AS i FROM o), t AS (SELECT * FROM r WHERE i <= 10),
m AS (SELECT week, a, count(*) AS n, count(*) = 10 OR bool_or(going) AS logged, row_number() OVER (PARTITION BY week ORDER BY a) - 1 AS place FROM t GROUP BY week, a),
b AS (SELECT week, min(CASE WHEN logged AND n < 10 THEN place END) AS place, arg_min(n, place) FILTER (logged AND n < 10) AS n FROM m GROUP BY week),
names AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{arm}')" for i, arm in enumerate(O.ARMS))}) v(a, arm))"""


def documents(spark, sf_dir) -> DataFrame:
    """doc, json: an extract for each week."""
    first = F.substring("o_orderpriority", 1, 1)
    arm = F.when(first == "1", 0).when(first == "2", 1).when(first == "3", 2).otherwise(3)
    week = F.date_trunc("week", "o_orderdate").cast("date")
    orders = read_table(spark, sf_dir, "orders").groupBy(week.alias("week"), arm.alias("a"), F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("price"), F.bool_or(F.col("o_orderstatus") == "P").alias("going"))
    top = orders.withColumn("i", F.row_number().over(Window.partitionBy("week", "a").orderBy(F.desc("price"), "k"))).filter("i <= 10")
    sector = F.element_at(F.array(*map(F.lit, O.SECTORS)), (F.col("k") % len(O.SECTORS) + 1).cast("int"))
    pick = F.struct(
        "i", F.lpad(F.col("k").cast("string"), 6, "0").alias("ticker"), F.lit("short").alias("assigned_timeframe"), F.lit("primary").alias("assigned_by"), F.round(F.col("price") / 1000, 2).alias("weighted_score"), sector.alias("sector"),
    )
    arms = top.groupBy("week", "a").agg(F.array_sort(F.collect_list(pick)).alias("selected"), ((F.count(F.lit(1)) == 10) | F.bool_or("going")).alias("logged"))
    view = F.struct(F.lit("manual_pre_registered").alias("source"), F.array(F.lit(O.SECTORS[0])).alias("leadingSectors"), F.date_sub("week", 7).cast("string").alias("asOf"))
    row = F.struct(
        "a", F.element_at(F.array(*map(F.lit, O.ARMS)), F.col("a") + 1).alias("arm"), F.lit("short").alias("track"), F.when(F.col("logged"), "logged").otherwise("incomplete_run").alias("status"), F.col("week").cast("string").alias("run_date"),
        view.alias("sector_view"), F.lit(None).cast("string").alias("counterfactual_cut"), "selected",
    )
    key = F.concat(F.lit("s:"), F.col("week").cast("string"))
    weeks = arms.groupBy("week").agg(F.array_sort(F.collect_list(row)).alias("arms"))
    return weeks.select(key.alias("doc"), F.to_json(F.array(F.struct(key.alias("period_key"), "arms")), {"ignoreNullFields": "false"}).alias("json"))


def read(spark, sf_dir) -> O.Levels:
    return O.arm_extracts(settle(documents(spark, sf_dir)), settle=settle)


@register(WEEKS_SQL + " SELECT 's:' || CAST(week AS VARCHAR) AS doc, '$[0].arms[' || place || '].selected' AS path, 'short has ' || n || ' picks, expected 10' AS problem FROM b WHERE place IS NOT NULL")
def arm_extract_problems(spark, sf_dir):
    return read(spark, sf_dir).problems


@register(WEEKS_SQL + f""" SELECT 's:' || CAST(t.week AS VARCHAR) AS period_key, arm, 'short' AS timeframe, CAST(i - 1 AS INT) AS place, lpad(CAST(k AS VARCHAR), 6, '0') AS ticker, round(price / 1000, 2) AS weighted_score, {list(O.SECTORS)}[k % {len(O.SECTORS)} + 1] AS sector,
  t.week AS selection_date, DATE '1970-01-01' + CAST(t.week - DATE '1970-01-01' - 7 AS INT) AS sector_as_of FROM t JOIN b USING (week) JOIN names USING (a) WHERE b.place IS NULL""")
def arm_extract_picks(spark, sf_dir):
    """Picks of the weeks without a problem, with what their period says."""
    tables = read(spark, sf_dir).tables
    of = tables["periods"].select("doc", "period_key", "selection_date", "sector_as_of")
    return tables["picks"].join(of, ["doc", "period_key"]).select("period_key", "arm", "timeframe", "place", "ticker", "weighted_score", "sector", "selection_date", "sector_as_of")
