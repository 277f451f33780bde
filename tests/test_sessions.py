"""Sessions over two days with a restart in between."""

import datetime

from panelforge.streaming import sessions
from pyspark.sql import functions as F

TICK = "ticker long, ts timestamp, price double, volume double"


def at(day, clock):
    """UTC of a time in Seoul."""
    return datetime.datetime.fromisoformat(f"2024-01-{day:02d} {clock}") - datetime.timedelta(hours=9)


def test_in_session(spark):
    rows = [(1, at(8, "08:59:59"), 1.0, 1.0), (2, at(8, "09:00:00"), 1.0, 1.0), (3, at(8, "15:29:59"), 1.0, 1.0), (4, at(8, "15:30:00"), 1.0, 1.0), (5, at(6, "10:00:00"), 1.0, 1.0), (6, at(9, "10:00:00"), 1.0, 1.0), (7, at(13, "10:00:00"), 1.0, 1.0)]
    ticks = spark.createDataFrame(rows, TICK)
    calendar = spark.createDataFrame([(datetime.date(2024, 1, 6), True), (datetime.date(2024, 1, 9), False)], "date date, open boolean")
    assert sorted(r.ticker for r in sessions.in_session(ticks).collect()) == [2, 3, 6]
    got = {r.ticker: r for r in sessions.in_session(ticks, calendar).collect()}
    assert sorted(got) == [2, 3, 5] and got[3].day == datetime.date(2024, 1, 8) and got[3].closes == at(8, "15:30:00")


def test_two_days_and_a_restart(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    context = spark.createDataFrame([(1, 100.0, 1.0), (2, 100.0, 2.0)], "ticker long, reference double, usual double")

    def feed(*rows):
        spark.createDataFrame(list(rows), TICK).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(TICK).option("maxFilesPerTrigger", 1).parquet(source)
        events = sessions.session_events(stream, context)
        q = events.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        assert q.awaitTermination(300) and q.exception() is None
        rows = spark.read.parquet(out).collect()
        return sorted((r.ticker, r.day.day, r.kind, r.trigger or "", r.price, r.ticks, r.found) for r in rows)

    feed((1, at(8, "08:00:00"), 150.0, 1.0), (1, at(8, "09:00:10"), 106.0, 1.0), (1, at(8, "09:00:40"), 107.0, 1.0), (1, at(8, "09:01:00"), 106.0, 1.0), (2, at(8, "09:00:00"), 100.0, 7.0), (3, at(8, "09:00:00"), 500.0, 1.0))
    first = [(1, 8, "anomaly", "price_spike", 106.0, 1, 1), (1, 8, "anomaly", "price_spike", 106.0, 3, 2), (2, 8, "anomaly", "volume_surge", 100.0, 1, 1)]
    assert run() == first  # the open day's state is in the checkpoint only

    # After the restart the session goes on: what it has told isn't told again, and its counts go on.
    feed((1, at(8, "09:01:30"), 108.0, 1.0), (1, at(8, "09:02:30"), 94.0, 1.0))
    second = [*first, (1, 8, "anomaly", "price_drop", 94.0, 5, 3)]
    assert run() == sorted(second)

    # The next day closes both sessions and starts anew: the same minute's trigger is told again.
    feed((1, at(9, "09:01:10"), 106.0, 1.0))
    third = sorted([*second, (1, 8, "closed", "", 94.0, 5, 3), (2, 8, "closed", "", 100.0, 1, 1), (1, 9, "anomaly", "price_spike", 106.0, 1, 1)])
    assert run() == third

    # A tick of a closed day is late; the close of the second day clears its state as well.
    feed((2, at(8, "10:00:00"), 150.0, 1.0), (1, at(9, "16:00:00"), 150.0, 1.0))
    assert run() == sorted([*third, (1, 9, "closed", "", 106.0, 1, 1)])


def test_anomalies_are_those_of_the_batch_rule(spark):
    ticks = spark.createDataFrame([(1, at(8, "10:00:00"), 105.0, 1.0)], TICK)
    context = spark.createDataFrame([(1, 100.0, 1.0)], "ticker long, reference double, usual double")
    rows = sessions.in_session(ticks).join(context, "ticker").select(sessions.anomaly(F.col("price"), F.col("reference"), F.col("volume"), F.col("usual")).alias("t"))
    assert rows.first().t == "price_spike"
