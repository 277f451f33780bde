"""Rules of audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def next_schedule(day: Column, slot: Column) -> Column:
    """When the next snapshot is due, in UTC: the afternoon of a morning's day, the next business day, or the next session's morning."""
    weekday = F.weekday(day)  # 0 is Monday
    business = F.when(weekday == 4, 3).when(weekday == 5, 2).otherwise(1)
    session = F.when(weekday == 5, 3).when(weekday == 6, 2).otherwise(1)
    at = lambda days, minutes: F.date_add(day, days).cast("timestamp") + F.expr(f"INTERVAL {minutes} MINUTES")
    return F.when(slot == "am", at(F.lit(0), 505)).when(slot == "pm", at(business, 140)).otherwise(at(session, -45))


def strict_json(rows: DataFrame, column: str, schema: str, checks: dict[str, str]) -> DataFrame:
    """rows with column's JSON as columns of the schema. A text that doesn't parse, or a row that
    breaks a check (message: SQL condition), fails the job: nothing is dropped or guessed."""
    parsed = rows.withColumn("__json", F.from_json(column, schema, {"mode": "FAILFAST"})).select(*rows.drop(column).columns, "__json.*")
    held = F.coalesce(*[F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.raise_error(F.lit(message)).cast("boolean")) for message, rule in checks.items()], F.lit(True))
    return parsed.filter(held)
