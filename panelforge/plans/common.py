"""What the registered queries share: tables, the panel at one selection date, and rounding at the surface."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators import panel as P
from panelforge.sources.tables import read_table

SELECTION = "2001-06-01"
DIGITS = 6


def bars_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.with_bars(P.weekly_panel(read_table(spark, sf_dir, "lineitem")))


def meta_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.meta(*(read_table(spark, sf_dir, t) for t in ("supplier", "nation", "region")))


def rounded(*names: str, digits: int = DIGITS) -> list[Column]:
    return [F.round(n, digits).alias(n) for n in names]


class Registry:
    """Queries and their DuckDB SQL, added by a decorator."""

    def __init__(self):
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql is not None:
                self.oracles[f.__name__] = sql
            return f

        return add
