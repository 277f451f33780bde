"""Read-through landing: only what isn't there yet is fetched.

A cell is a market and a day. Its rows land as a partition that is replaced whole,
then the cell is noted, also one without rows, so that a holiday isn't asked for
again. A cell that failed isn't noted: the next run asks again. A run that dies in
between leaves partitions without a note, which are fetched and replaced again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

CELL = "market string, bas_dd string"


def noted(spark: SparkSession, root: str) -> DataFrame:
    """market, bas_dd, n of the cells that have landed."""
    schema = f"{CELL}, n long"
    try:
        return spark.read.schema(schema).parquet(f"{root}/cells")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def land(asked: DataFrame, root: str, fetch: Callable[[DataFrame], DataFrame]) -> int:
    """Fetch the cells of asked(market, bas_dd) that haven't landed, and give their number.

    fetch takes the missing cells and gives rows with market, bas_dd and status,
    among them one row with a null ISU_CD for each cell, as ``market_snapshots``
    does with cells_too.
    """
    spark = asked.sparkSession
    missing = asked.select("market", "bas_dd").distinct().join(noted(spark, root).select("market", "bas_dd"), ["market", "bas_dd"], "left_anti")
    n = missing.count()
    if not n:
        return 0
    staged = f"{root}/staged"
    fetch(missing).write.mode("overwrite").parquet(staged)  # fetched once, read twice
    rows = spark.read.parquet(staged)
    good = rows.filter("ISU_CD IS NULL AND status = 'ok'").select("market", "bas_dd")
    kept = rows.filter("ISU_CD IS NOT NULL").join(good, ["market", "bas_dd"], "left_semi")
    kept.drop("status").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("market", "bas_dd").parquet(f"{root}/rows")
    counts = kept.groupBy("market", "bas_dd").agg(F.count(F.lit(1)).alias("n"))
    good.join(counts, ["market", "bas_dd"], "left").select("market", "bas_dd", F.coalesce("n", F.lit(0)).alias("n")).write.mode("append").parquet(f"{root}/cells")
    return n


def snapshots(url: str, **options: str) -> Callable[[DataFrame], DataFrame]:
    """A fetch of missing cells from the source ``market_snapshots``. A list of cells is as long as the days of the markets."""

    def fetch(missing: DataFrame) -> DataFrame:
        cells = ",".join(sorted(f"{r.market}:{r.bas_dd}" for r in missing.collect()))
        return missing.sparkSession.read.format("market_snapshots").options(url=url, cells=cells, cells_too="true", skip_failed="true", **options).load()

    return fetch


def landed(spark: SparkSession, root: str, asked: DataFrame) -> DataFrame:
    """The landed rows of the asked cells; partitions of other cells aren't read."""
    cells = asked.select("market", "bas_dd").distinct().join(noted(spark, root).filter("n > 0").select("market", "bas_dd"), ["market", "bas_dd"], "left_semi")
    schema = reduce(lambda a, f: f"{a}, {f} string", ("ISU_CD", "ISU_NM", "TDD_CLSPRC", "TDD_HGPRC", "ACC_TRDVOL", "ACC_TRDVAL", "MKTCAP", "LIST_SHRS", "MKT_NM"), CELL)
    if cells.isEmpty():
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/rows").join(F.broadcast(cells), ["market", "bas_dd"])  # a row a cell
