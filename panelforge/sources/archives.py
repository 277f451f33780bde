"""Members of zip archives as rows, and company codes inside of them."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORP_CODES = "list array<struct<corp_code:string,corp_name:string,stock_code:string,corp_cls:string,modify_date:string>>"
#: The market of each company class.
MARKETS = {"Y": "KOSPI", "K": "KOSDAQ", "N": "KONEX"}


def zip_members(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, member, content of each member of the archives under path whose name matches; folders have no row.

    A task holds one archive and one member at a time. A file that is no archive fails the job.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = pa.schema([("path", pa.string()), ("member", pa.string()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as archive:
                    for member in archive.infolist():
                        if not member.is_dir() and fnmatchcase(member.filename, pattern):
                            yield pa.RecordBatch.from_pydict({"path": [name.as_py()], "member": [member.filename], "content": [archive.read(member)]}, schema)

    return files.mapInArrow(run, "path string, member string, content binary")


def read_corp_codes(spark: SparkSession, path: str, markets: DataFrame | None = None, member: str = "CORPCODE.xml") -> DataFrame:
    """ticker, corp_code, corp_name, market of the listed companies in archived XML.

    The market is that of the company's class or, without a known one, that of
    markets(ticker, market); companies without a ticker or a market are left out.
    """
    text = zip_members(spark, path, member).select(F.decode("content", "UTF-8").alias("xml"))
    rows = text.select(F.explode(F.from_xml("xml", CORP_CODES, {"mode": "FAILFAST"})["list"]).alias("c")).select(*[F.trim(F.coalesce(F.col(f"c.{c}"), F.lit(""))).alias(c) for c in ("stock_code", "corp_code", "corp_name", "corp_cls")])
    named = F.create_map(*[F.lit(x) for pair in MARKETS.items() for x in pair])
    rows = rows.filter("stock_code <> ''").select(F.col("stock_code").alias("ticker"), "corp_code", "corp_name", F.try_element_at(named, F.col("corp_cls")).alias("market"))
    if markets is not None:
        rows = rows.join(markets.select("ticker", F.col("market").alias("listed")), "ticker", "left").withColumn("market", F.coalesce("market", "listed")).drop("listed")
    return rows.filter("market IS NOT NULL")
