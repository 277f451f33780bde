"""Business days by a calendar of running counts: adding is an equi-join on a number, counting a difference."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def business_calendar(spark: SparkSession, first: datetime.date, last: datetime.date, entries: DataFrame | None = None) -> DataFrame:
    """date, open, days (business days up to the date, itself included) of every date from first to last.

    entries(date, open) decide the dates that they have; of the others Saturdays
    and Sundays are closed. The calendar has a row for each day of its years.
    """
    days = spark.range((last - first).days + 1).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("date"))
    usual = F.weekday("date") < 5
    if entries is None:
        days = days.withColumn("open", usual)
    else:
        known = entries.groupBy("date").agg(F.bool_and("open").alias("known"))
        days = days.join(known, "date", "left").select("date", F.coalesce("known", usual).alias("open"))
    return days.withColumn("days", F.sum(F.col("open").cast("int")).over(Window.orderBy("date")))


def _at(rows: DataFrame, calendar: DataFrame, date: str, name: str) -> DataFrame:
    """rows with the calendar's row of a date as the struct name."""
    known = calendar.select(F.col("date").alias("__date"), F.struct("open", "days").alias(name))
    return rows.join(F.broadcast(known), F.col(date) == F.col("__date"), "left").drop("__date")  # a row a day


def add_business_days(rows: DataFrame, calendar: DataFrame, start: str, days: Column | int, name: str) -> DataFrame:
    """rows with name: the date so many business days after start, or before it if days is negative, which isn't counted itself.

    0 days give start, also where it is closed. Null where a date is null or
    outside of the calendar.
    """
    step = days if isinstance(days, Column) else F.lit(days)
    held = _at(rows, calendar, start, "__start")
    # Ahead, the days-th open date after start; back, the one so many before the open dates that precede start.
    nth = F.when(step > 0, F.col("__start.days") + step).otherwise(F.col("__start.days") - F.col("__start.open").cast("int") + step + 1)
    opens = calendar.filter("open").select(F.col("days").alias("__nth"), F.col("date").alias("__to"))
    out = held.withColumn("__wanted", nth).join(F.broadcast(opens), F.col("__wanted") == F.col("__nth"), "left")  # a row a business day
    return out.withColumn(name, F.when(step == 0, F.col(start)).otherwise(F.col("__to"))).drop("__start", "__wanted", "__nth", "__to")


def business_days_between(rows: DataFrame, calendar: DataFrame, start: str, end: str, name: str) -> DataFrame:
    """rows with name: the business days from start to end, both counted; 0 if start is later."""
    held = _at(_at(rows, calendar, start, "__from"), calendar, end, "__to")
    inside = F.col("__to.days") - F.col("__from.days") + F.col("__from.open").cast("int")
    return held.withColumn(name, F.when(F.col(start) > F.col(end), 0).otherwise(inside)).drop("__from", "__to")
