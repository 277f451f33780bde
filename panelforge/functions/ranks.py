"""Ranks over a whole table that no single task sorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.lineage import settle


def global_rank(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """df with its row number by order, from 1, as column name, and the number of rows as n.

    Rows are dealt by ranges of the order. A range's numbers begin after the rows of
    the ranges before it, of which there are as many as partitions.
    """
    dealt = settle(df.drop("n").repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    counts = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__rows"))
    every = Window.orderBy("__range")
    counts = counts.withColumn("__before", F.sum("__rows").over(every) - F.col("__rows")).withColumn("n", F.sum("__rows").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    ranked = dealt.join(F.broadcast(counts), "__range")  # a row for each partition
    return ranked.withColumn(name, F.col("__before") + inside).drop("__range", "__rows", "__before")


def global_quantile(df: DataFrame, value: str, p: float) -> DataFrame:
    """A single row with the linear quantile of the column's present values, as value, without a task that holds them all."""
    ranked = global_rank(df.filter(F.col(value).isNotNull()).select(value), "__r", value)
    at = (F.col("n") - 1) * F.lit(p)
    placed = lambda f: F.max(F.when(F.col("__r") == f(at) + 1, F.col(value)))
    ends = ranked.agg(placed(F.floor).alias("low"), placed(F.ceil).alias("high"), F.max(at).alias("at"))
    between = (F.ceil("at") - F.col("at")) * F.col("low") + (F.col("at") - F.floor("at")) * F.col("high")
    return ends.select(F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(between).alias(value))
