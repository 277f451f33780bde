"""Runs of several tables, written whole or not at all.

The tables of a run are staged, read again and checked; then one manifest is
renamed into place, which commits all of them at once. Readers go by manifests, so
what a writer left behind before its rename is never seen. A run that is written
again under its id with the same content changes nothing; with other content it is
refused.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class RunError(ValueError):
    """A run breaks a check, or isn't the one that its id stands for."""


@dataclass(frozen=True)
class Check:
    """broken gives the rows of the tables, by name, that break the rule."""

    name: str
    broken: Callable[[dict[str, DataFrame]], DataFrame]


def matches(table: str, keys: list[str], other: str) -> Check:
    """Every row of table has a row of other with its keys."""
    return Check(f"{table} without {other}", lambda t: t[table].join(t[other], keys, "left_anti"))


def unique(table: str, keys: list[str]) -> Check:
    return Check(f"{table} repeats", lambda t: t[table].groupBy(*keys).count().filter("count > 1"))


def counted(table: str, group: list[str], n: int) -> Check:
    """Every group of table has n rows."""
    return Check(f"{table} has not {n}", lambda t: t[table].groupBy(*group).count().filter(F.col("count") != n))


def holds(table: str, rule: str) -> Check:
    return Check(f"{table}: {rule}", lambda t: t[table].filter(~F.coalesce(F.expr(rule), F.lit(False))))


def content_hash(df: DataFrame) -> str:
    """Of the rows as a multiset: their number and sums of two hashes, whatever order or partitions they come in."""
    row = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    wide = lambda c: F.sum(c.cast("decimal(38,0)"))
    digest = F.sha2(row, 256)
    half = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)")
    r = df.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(wide(half(at)), F.lit(0)).alias(f"h{at}") for at in (1, 16, 31)]).first()
    return f"{r.n}-{r.h1}-{r.h16}-{r.h31}"


class RunStore:
    """Runs under a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        jvm = spark._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(root).toUri(), spark._jsc.hadoopConfiguration())

    def _manifests(self, period: str) -> list[str]:
        folder = self.path(f"{self.root}/manifests/{period}")
        if not self.fs.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(folder) if s.getPath().getName().endswith(".json"))

    def manifest(self, period: str, run_id: str | None = None) -> dict | None:
        """Of a run, or of the period's newest one; null if there is none."""
        names = [f"{run_id}.json"] if run_id else self._manifests(period)
        found = []
        for name in names:
            path = f"{self.root}/manifests/{period}/{name}"
            if self.fs.exists(self.path(path)):
                found.append(json.loads("".join(r.value for r in self.spark.read.text(path, wholetext=True).collect())))
        return max(found, key=lambda m: (m["number"], m["run_id"]), default=None)

    def write(self, period: str, run_id: str, tables: dict[str, DataFrame], checks: list[Check]) -> bool:
        """Whether the run was written: false if it is there already with the same content."""
        attempt = f"{self.root}/staged/{period}/{run_id}/{uuid4().hex}"
        staged = {}
        for name, df in tables.items():
            df.write.parquet(f"{attempt}/{name}")
            staged[name] = self.spark.read.schema(df.schema).parquet(f"{attempt}/{name}")
        for check in checks:
            row = check.broken(staged).first()
            if row is not None:
                self.fs.delete(self.path(attempt), True)
                raise RunError(f"{check.name}: {row.asDict()}")
        hashes = {name: content_hash(df) for name, df in staged.items()}
        there = self.manifest(period, run_id)
        newest = self.manifest(period)
        if there is None:
            made = {"run_id": run_id, "period": period, "number": 1 + (newest["number"] if newest else 0), "folder": attempt, "hashes": hashes}
            there = self._commit(period, run_id, made)
        if there["folder"] == attempt:
            return True
        self.fs.delete(self.path(attempt), True)
        if there["hashes"] != hashes:
            raise RunError(f"run {run_id} of {period} has other content")
        return False

    def _commit(self, period: str, run_id: str, made: dict) -> dict:
        """The manifest that holds afterwards: this one, or that of a writer that was first."""
        final = f"{self.root}/manifests/{period}/{run_id}.json"
        temporary = self.path(f"{final}.{uuid4().hex}.tmp")
        out = self.fs.create(temporary)
        out.write(bytearray(json.dumps(made).encode()))
        out.close()
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark._sc._gateway.new_array(rename, 0)
        try:
            self.context.rename(temporary, self.path(final), options)
        except Py4JJavaError:
            self.fs.delete(temporary, False)
            there = self.manifest(period, run_id)
            if there is None:
                raise
            return there
        return made

    def read(self, period: str, table: str, run_id: str | None = None) -> DataFrame:
        """A table of a committed run, the period's newest by default."""
        found = self.manifest(period, run_id)
        if found is None:
            raise RunError(f"no run {run_id or ''} of {period}")
        return self.spark.read.parquet(f"{found['folder']}/{table}")

    def clean(self, period: str) -> int:
        """Delete what writers of the period left without a commit, and give the number of attempts. No writer may be at work."""
        committed = {self.manifest(period, name[:-5])["folder"] for name in self._manifests(period)}
        base, gone = self.path(f"{self.root}/staged/{period}"), 0
        for run in self.fs.listStatus(base) if self.fs.exists(base) else []:
            for attempt in self.fs.listStatus(run.getPath()):
                if not any(attempt.getPath().toString().endswith(f[len(self.root) :]) for f in committed):
                    gone += self.fs.delete(attempt.getPath(), True)
        return gone
