"""Readers: tables by folder, with the formats the engine's feeds come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SNAPSHOT = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in ("ISU_CD", "ISU_NM", "TDD_CLSPRC", "TDD_HGPRC", "ACC_TRDVOL", "ACC_TRDVAL", "MKTCAP", "LIST_SHRS", "MKT_NM")
    ]
)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Daily snapshots as JSON lines in folders trade_date=...: strict, numeric text, rows without a close dropped."""
    number = lambda c: F.regexp_replace(F.trim(c), ",", "").try_cast("double")
    rows = spark.read.schema(SNAPSHOT).option("mode", "FAILFAST").json(path)
    close = number(F.col("TDD_CLSPRC"))
    high = number(F.col("TDD_HGPRC"))
    return rows.filter(close > 0).select(
        F.col("trade_date").cast("date").alias("trade_date"), F.col("ISU_CD").alias("ticker"), F.col("ISU_NM").alias("name"), F.col("MKT_NM").alias("market"),
        close.alias("close"), F.coalesce(F.when(high > 0, high), close).alias("high"), number(F.col("ACC_TRDVOL")).alias("volume"),
        number(F.col("ACC_TRDVAL")).alias("trdval"), number(F.col("MKTCAP")).alias("mktcap"), number(F.col("LIST_SHRS")).alias("list_shrs"),
    ).dropDuplicates(["trade_date", "ticker"])


def read_envelope(spark: SparkSession, path: str, rows_field: str, schema: T.StructType) -> DataFrame:
    """Rows inside a JSON envelope: the field must be there and be an array, else the read fails."""
    outer = T.StructType([T.StructField(rows_field, T.ArrayType(schema))])
    docs = spark.read.schema(outer).option("multiLine", True).option("mode", "FAILFAST").json(path)
    checked = docs.select(F.when(F.col(rows_field).isNull(), F.raise_error(F.lit(f"no {rows_field}"))).otherwise(F.col(rows_field)).alias("rows"))
    return checked.select(F.explode("rows").alias("r")).select("r.*")


def read_corp_codes(spark: SparkSession, path: str) -> DataFrame:
    """Company codes from XML: rows without a ticker are dropped."""
    schema = "corp_code string, corp_name string, stock_code string, modify_date string"
    rows = spark.read.schema(schema).option("rowTag", "list").xml(path)
    return rows.withColumn("stock_code", F.trim("stock_code")).filter("stock_code <> ''")


def with_retry(call, attempts: int = 4, base_seconds: float = 1.0, retry_on: tuple = (IOError,), sleep=None):
    """call() until it succeeds, with doubled pauses; the last failure is raised."""
    import time

    for n in range(attempts):
        try:
            return call()
        except retry_on:
            if n == attempts - 1:
                raise
            (sleep or time.sleep)(base_seconds * 2**n)
