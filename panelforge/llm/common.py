"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions.lineage import settle


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of ids and numbers that a written file has at least, where the table is larger.
FILE_ROWS = 50_000


def gathered(df: DataFrame, rows: int | None) -> DataFrame:
    """df in as many partitions as a table of at most so many rows needs, and not in more than it has: small tables aren't written in as many files as there are shuffle partitions."""
    return df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))


def materialize(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cut the lineage of df with a reliable checkpoint in the shared folder; rows: the most it can have, where that is known."""
    return settle(gathered(df, rows))


class Scratch:
    """Parquet tables in the shared folder of checkpoints, for steps between two jobs; drop() deletes them.

    Unlike a checkpoint's, their size is known to Spark, and small files are read together.
    As a context it drops them at its end, also after an error.
    """

    def __init__(self, spark: SparkSession):
        shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        self.spark = spark
        self.folder = f"{shared or tempfile.mkdtemp(prefix='panelforge-scratch-')}/scratch-{spark.sparkContext.applicationId}-{uuid4()}"
        self.count = 0

    def table(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """df, written and read again; rows: the most it can have, where that is known."""
        self.count += 1
        path = f"{self.folder}/{self.count}"
        gathered(df, rows).write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        self.drop()

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


#: Bytes of texts that go to Python at once, at most: a worker holds them as Arrow, as strings, and with what is made of them.
BATCH_BYTES = 16 << 20


def by_row(docs: DataFrame, run: Callable[[Iterator[pd.Series]], Iterator[pd.DataFrame]], made: str) -> Callable[..., Column]:
    """A function of a column of docs that gives a struct of the columns made; run gets series of it and yields a row for each value, in order.

    Only that column goes to Python: ids and other columns stay in Spark, and keep
    their values whatever types they have. The session's batches are held under BATCH_BYTES.
    """
    spark, name = docs.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))

    def work(values: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return run(values)

    return F.pandas_udf(work, made)


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark df for broadcast if it has at most max_rows rows; else leave the join to shuffle.

    df should be materialized: its rows are counted here.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def unused(name: str, columns: list[str]) -> str:
    """name, with underscores after it until no column (of any case) has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
