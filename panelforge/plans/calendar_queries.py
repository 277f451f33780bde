"""Queries of business-day arithmetic."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from panelforge.operators import calendar as K
from panelforge.plans.common import Registry
from panelforge.sources.tables import read_table

register = Registry()
FIRST, LAST = datetime.date(1991, 1, 1), datetime.date(2003, 12, 31)
#: The calendar's own entries: the first of a month is closed, its first Saturday open.
OPENS_SQL = f"""WITH c AS (SELECT CAST(d AS DATE) AS d FROM generate_series(DATE '{FIRST}', DATE '{LAST}', INTERVAL 1 DAY) t(d)),
o AS (SELECT d FROM c WHERE CASE WHEN day(d) = 1 THEN false WHEN isodow(d) = 6 AND day(d) <= 7 THEN true ELSE isodow(d) < 6 END), l AS (SELECT list(d ORDER BY d) AS days FROM o)"""


def calendar(spark):
    every = spark.range((LAST - FIRST).days + 1).select(F.date_add(F.lit(FIRST), F.col("id").cast("int")).alias("date"))
    first, saturday = F.dayofmonth("date") == 1, (F.weekday("date") == 5) & (F.dayofmonth("date") <= 7)
    return K.business_calendar(spark, FIRST, LAST, every.filter(first | saturday).select("date", (~first).alias("open")))


@register(OPENS_SQL + """, s AS (SELECT l_orderkey AS o_orderkey, max(l_shipdate)::DATE AS shipped FROM lineitem GROUP BY 1),
x AS (SELECT o_orderkey, o_orderdate::DATE AS day, shipped, o_orderkey % 7 AS n, days FROM orders LEFT JOIN s USING (o_orderkey), l)
SELECT o_orderkey, CASE WHEN n = 0 THEN day ELSE list_filter(days, lambda d: d > day)[n] END AS due, list_filter(days, lambda d: d < day)[-3] AS notice,
  CASE WHEN shipped IS NOT NULL THEN CASE WHEN day > shipped THEN 0 ELSE len(list_filter(days, lambda d: d >= day AND d <= shipped)) END END::INT AS open_days FROM x""")
def business_days(spark, sf_dir):
    """Of each order the day some business days ahead, three back, and the business days until its last shipment."""
    shipped = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").cast("date").alias("shipped"))
    rows = read_table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day")).join(shipped, "o_orderkey", "left")
    days = calendar(spark)
    rows = K.add_business_days(rows, days, "day", (F.col("o_orderkey") % 7).cast("int"), "due")
    rows = K.add_business_days(rows, days, "day", -3, "notice")
    return K.business_days_between(rows, days, "day", "shipped", "open_days").select("o_orderkey", "due", "notice", F.col("open_days").cast("int").alias("open_days"))
