"""Writers: replacing a month, insert-or-ignore, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Only the partitions that df has are overwritten: a month is replaced whole, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def insert_ignore(new: DataFrame, existing: DataFrame, *keys: str) -> DataFrame:
    """The rows of new to append: one for each key that existing doesn't have."""
    return new.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti")


def upsert(base: DataFrame, overlay: DataFrame, *keys: str) -> DataFrame:
    """base with the rows of overlay in place of those with the same key."""
    return base.join(overlay.select(*keys), list(keys), "left_anti").unionByName(overlay)


def carry_forward(table: DataFrame, month: str, bucket: str) -> DataFrame:
    """Rows of the bucket in the latest month before, for tickers that the month doesn't have yet."""
    day = F.lit(month).cast("date")
    before = table.filter((F.col("month") < day) & (F.col("bucket") == bucket))
    last = before.agg(F.max("month").alias("month"))
    there = table.filter(F.col("month") == day).select("ticker")
    return before.join(F.broadcast(last), "month").join(there, "ticker", "left_anti").withColumn("month", day).select(*table.columns)


def validated(df: DataFrame, rule: Column, message: str) -> DataFrame:
    """df, failing when read if a row breaks the rule."""
    return df.filter(F.when(rule, F.lit(True)).otherwise(F.raise_error(F.lit(message))))


def json_report(df: DataFrame, *group: str) -> DataFrame:
    """One JSON document for each group, rows sorted, NaN and infinities as null."""
    safe = [F.when(F.isnan(c) | F.col(c).isin(float("inf"), float("-inf")), None).otherwise(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in group]
    rows = df.select(*group, F.struct(*safe).alias("r"))
    return rows.groupBy(*group).agg(F.to_json(F.sort_array(F.collect_list("r"))).alias("report"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
