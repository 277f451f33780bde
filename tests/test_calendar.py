"""Business days against walking day by day."""

import datetime

from panelforge.operators import calendar as K
from pyspark.sql import functions as F

D = datetime.date
ENTRIES = [(D(2024, 1, 1), False), (D(2024, 1, 6), True), (D(2024, 2, 9), False), (D(2024, 2, 12), False), (D(2024, 2, 12), False)]


def is_open(d):
    return dict(ENTRIES).get(d, d.weekday() < 5)


def walked(d, n):
    while n:
        d += datetime.timedelta(1 if n > 0 else -1)
        n -= (1 if n > 0 else -1) * is_open(d)
    return d


def test_business_days_like_walking(spark):
    cal = K.business_calendar(spark, D(2023, 11, 1), D(2024, 4, 30), spark.createDataFrame(ENTRIES, "date date, open boolean")).cache()
    assert {r.date: r.open for r in cal.collect()} == {d: is_open(d) for d in (D(2023, 11, 1) + datetime.timedelta(i) for i in range(182))}
    days = [D(2023, 12, 20) + datetime.timedelta(i) for i in range(70)]
    rows = spark.createDataFrame([(d, n, d + datetime.timedelta(n)) for d in days for n in (-12, -5, -1, 0, 1, 2, 9)], "day date, n int, until date")
    out = K.business_days_between(K.add_business_days(rows, cal, "day", F.col("n"), "moved"), cal, "day", "until", "between").collect()
    assert len(out) == 490
    for r in out:
        assert r.moved == walked(r.day, r.n)
        assert r.between == sum(is_open(r.day + datetime.timedelta(i)) for i in range((r.until - r.day).days + 1))


def test_weekdays_without_entries_and_dates_outside(spark):
    cal = K.business_calendar(spark, D(2024, 1, 1), D(2024, 1, 31))
    rows = spark.createDataFrame([(D(2024, 1, 5),), (D(2024, 1, 31),), (D(2025, 1, 1),), (None,)], "day date")
    out = {r.day: r.moved for r in K.add_business_days(rows, cal, "day", 1, "moved").collect()}
    assert out == {D(2024, 1, 5): D(2024, 1, 8), D(2024, 1, 31): None, D(2025, 1, 1): None, None: None}
