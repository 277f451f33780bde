"""Tick streams with Structured Streaming: latest per key, detection, dedup and an insert-or-ignore sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from panelforge.operators.ops import anomaly

TICK = T.StructType(
    [
        T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
    ]
)
#: Most keys that a feed takes at once.
MOST_KEYS = 41


def read_ticks(spark: SparkSession, folder: str) -> DataFrame:
    """ticker, ts, price, volume from Parquet files as they arrive."""
    rows = spark.readStream.schema(TICK).parquet(folder)
    return rows.select(F.col("user_id").alias("ticker"), "ts", F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("volume")).filter("price > 0")


def parse_frames(lines: DataFrame, day: str, fields: int = 4) -> DataFrame:
    """Ticks of text frames ``kind|tr|count|a^b^c...``: one for each group of fields (ticker, HHMMSS, price, volume)."""
    parts = F.split(F.element_at(F.split("value", r"\|"), -1), r"\^")
    starts = F.sequence(F.lit(0), F.greatest(F.size(parts) - fields, F.lit(0)), F.lit(fields))
    records = F.transform(starts, lambda i: F.slice(parts, i + 1, fields))
    r = lines.select(F.explode(records).alias("r")).filter(F.size("r") == fields)
    at = F.try_to_timestamp(F.concat(F.lit(f"{day} "), F.col("r")[1]), F.lit("yyyy-MM-dd HHmmss"))
    out = r.select(F.col("r")[0].alias("ticker"), at.alias("ts"), F.col("r")[2].try_cast("double").alias("price"), F.col("r")[3].try_cast("double").alias("volume"))
    return out.filter("ts IS NOT NULL AND price > 0")


def latest(ticks: DataFrame, every: str = "20 seconds", late: str = "1 minute") -> DataFrame:
    """The last tick of each ticker and flush window."""
    return ticks.withWatermark("ts", late).groupBy(F.window("ts", every), "ticker").agg(F.max_by(F.struct("price", "volume", "ts"), "ts").alias("t")).select("ticker", "t.price", "t.volume", "t.ts", "window")


def detect(ticks: DataFrame, context: DataFrame, late: str = "1 minute") -> DataFrame:
    """Anomalies against the static context(ticker, reference, usual), one for each ticker, trigger and minute."""
    found = ticks.join(context, "ticker").withColumn("trigger", anomaly(F.col("price"), F.col("reference"), F.col("volume"), F.col("usual"))).filter("trigger IS NOT NULL")
    key = F.concat_ws(":", F.col("ticker").cast("string"), "trigger", F.date_format("ts", "yyyy-MM-dd'T'HH:mm"))
    return found.withColumn("dedup_key", key).withWatermark("ts", late).dropDuplicatesWithinWatermark(["dedup_key"]).select("dedup_key", "ticker", "trigger", "ts", "price")


def subscription(holdings: DataFrame, shortlist: DataFrame, most: int = MOST_KEYS) -> DataFrame:
    """Tickers to subscribe to: holdings first, then the shortlist, each once."""
    both = holdings.select("ticker", F.lit(0).alias("p")).unionByName(shortlist.select("ticker", F.lit(1).alias("p")))
    return both.groupBy("ticker").agg(F.min("p").alias("p")).orderBy("p", "ticker").limit(most).select("ticker")


def write_once(anomalies: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append anomalies whose key isn't stored yet, in folders by hour; a repeated micro-batch adds nothing.

    A key holds its minute, so only the folders of the batch's hours are read again.
    """
    spark = anomalies.sparkSession
    dealt = anomalies.withColumn("hour", F.date_format("ts", "yyyyMMddHH"))

    def add(batch: DataFrame, _: int) -> None:
        batch = batch.dropDuplicates(["dedup_key"]).persist()
        hours = [r.hour for r in batch.select("hour").distinct().collect()]  # those of one micro-batch
        stored = spark.read.schema("dedup_key string, hour string").parquet(path).filter(F.col("hour").isin(hours))
        batch.join(stored.select("dedup_key"), "dedup_key", "left_anti").write.mode("append").partitionBy("hour").parquet(path)
        batch.unpersist()

    spark.createDataFrame([], dealt.schema).write.mode("append").partitionBy("hour").parquet(path)
    writer = dealt.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="20 seconds")).start()
