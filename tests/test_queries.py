"""Every query of the catalog against its DuckDB SQL on the smallest tables."""

import pytest
from panelforge.plans import catalog

from tests.compare import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, con, name):
    assert_same(catalog.QUERIES[name](spark, SF), con, catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_regimes_of_every_date(spark):
    from panelforge.plans.common import bars_of

    sf = "/root/testdata/sf0.01"
    counts = bars_of(spark, sf).filter("bar > 120").groupBy("trade_date").count().collect()
    rows = {r.trade_date: r for r in catalog.QUERIES["market_regime"](spark, sf).collect()}
    assert set(rows) == {r.trade_date for r in bars_of(spark, sf).select("trade_date").distinct().collect()}
    assert {r["count"] % 2 for r in counts} == {0, 1} and {r.label for r in rows.values() if r.med is None} == {"recovery"}


def test_rollups_read_all_rows(spark):
    from pyspark.sql import functions as F

    events, orders = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("events", "orders"))
    streaks = catalog.QUERIES["admin_streak"](spark, SF)
    assert streaks.count() == events.select("user_id", F.to_date("ts")).distinct().count()
    states = catalog.QUERIES["worst_of_rollup"](spark, SF)
    assert states.count() == orders.select("o_custkey").distinct().count() and states.select("state").distinct().count() > 1
    low = orders.filter("o_orderstatus = 'P' AND o_totalprice <= 400000").selectExpr("o_custkey AS arm")
    assert low.count() > 0 and low.join(states.filter("state = 'fail'"), "arm", "left_anti").isEmpty()


def test_snapshots_and_carried_rows_of_all_dates(spark):
    import datetime

    from panelforge.plans.operations_queries import carried
    from pyspark.sql import functions as F

    orders = spark.read.parquet(f"{SF}/orders.parquet")
    dates = catalog.QUERIES["portfolio_snapshot"](spark, SF).select("date").distinct()
    assert dates.count() == orders.select(F.to_date("o_orderdate")).distinct().count()
    assert catalog.QUERIES["carry_forward"](spark, SF).count() > 0
    old = spark.createDataFrame([(datetime.datetime(1999, 3, 5), 8), (datetime.datetime(1998, 3, 5), 6)], "o_orderdate timestamp, o_custkey long")
    assert [r.ticker for r in carried(old).collect()] == [8]


def entry_without(modules: tuple, code: str):
    """Runs code after an import of the entry, in a process where the modules can't be found."""
    import subprocess
    import sys
    from pathlib import Path

    block = f"""
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name in {modules!r}:
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
"""
    return subprocess.run([sys.executable, "-c", block + code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True)


def test_entry_works_without_the_optional_parts():
    code = "assert 'bpp_short_topk' in e.queries() and not any(n.startswith('op1_') or n == 'pipeline' for n in e.queries())"
    for missing in (("panelforge.llm", "corpus_pipeline"), ("panelforge.llm",)):
        assert entry_without(missing, code).returncode == 0


def test_entry_needs_the_libraries_of_parts_that_are_there():
    from importlib.util import find_spec

    if find_spec("panelforge.llm"):
        done = entry_without(("xxhash",), "")
        assert done.returncode and "xxhash" in done.stderr


def test_entry_lets_errors_inside_of_parts_through():
    from importlib.util import find_spec

    if find_spec("panelforge.llm"):
        done = entry_without(("panelforge.llm.common",), "")
        assert done.returncode and "panelforge.llm.common" in done.stderr
