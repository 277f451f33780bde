"""HTTP sources with throttling and failures, landing, archives, and runs that are whole or not there."""

import json
import os
import subprocess
import sys
import threading
import urllib.parse
import zipfile
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

import pytest
from panelforge.sources import archives, landing, market_api, runs
from panelforge.streaming import ticks
from pyspark.sql import functions as F


class Service:
    """A service whose answers are a function of path, parameters and the number of the request for them."""

    def __init__(self, answer):
        seen, lock = Counter(), threading.Lock()

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                url = urllib.parse.urlparse(self.path)
                with lock:
                    seen[self.path] += 1
                    n = seen[self.path]
                status, body = answer(url.path, dict(urllib.parse.parse_qsl(url.query)), n, self.headers.get("AUTH_KEY"))
                self.send_response(status)
                self.end_headers()
                self.wfile.write(body if isinstance(body, bytes) else json.dumps(body).encode())

            def log_message(self, *_):
                pass

        self.seen, self.server = seen, ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_port}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()


@pytest.fixture
def service():
    made = []

    def start(answer):
        made.append(Service(answer))
        return made[-1]

    yield start
    for s in made:
        s.server.shutdown()


def row(code, close):
    return {"ISU_CD": code, "ISU_NM": f"n{code}", "TDD_CLSPRC": close, "MKT_NM": "KOSPI", "MKTCAP": 5}


def market(path, params, n, key):
    """The second of January is throttled twice, the third sends broken text once, the fourth is a holiday, the fifth never works."""
    day = params["basDd"][-2:]
    if key != "k":
        return 401, {}
    if day == "02" and n <= 2:
        return (429, 503)[n - 1], b"busy"
    if day == "03" and n == 1:
        return 200, b"<html>"
    if day == "04":
        return 200, {}
    if day == "05":
        return 503, b""
    if day == "06":
        return 200, {"OutBlock_1": {"a": 1}}
    return 200, {"OutBlock_1": [row(f"{path[1:]}{day}{i}", f"1,{i}00") for i in range(2)]}


def load(spark, url, **options):
    spark.dataSource.register(market_api.MarketSnapshots)
    return spark.read.format("market_snapshots").options(url=url, **{"key": "k", "pause": "0.01", **options}).load()


def test_snapshots_are_retried_by_cell(spark, service):
    s = service(market)
    df = load(spark, s.url, markets="KOSPI,KOSDAQ", dates="20240102,20240103,20240104,20240108")
    assert df.rdd.getNumPartitions() == 8
    rows = df.collect()
    assert Counter((r.market, r.bas_dd) for r in rows) == {(m, f"202401{d}"): 2 for m in ("KOSPI", "KOSDAQ") for d in ("02", "03", "08")}
    assert {(r.TDD_CLSPRC, r.MKTCAP, r.TDD_HGPRC) for r in rows} == {("1,000", "5", None), ("1,100", "5", None)}
    assert s.seen["/KOSPI?basDd=20240102"] == 3 and s.seen["/KOSPI?basDd=20240103"] == 2 and s.seen["/KOSPI?basDd=20240108"] == 1


@pytest.mark.parametrize("options,message", [({"dates": "20240105"}, "attempts failed"), ({"dates": "20240108", "key": "wrong", "skip_failed": "true"}, "401"), ({"dates": "20240106", "skip_failed": "true"}, "list of objects")])
def test_what_another_attempt_cannot_mend_fails_the_job(spark, service, options, message):
    s = service(market)
    with pytest.raises(Exception, match=message):
        load(spark, s.url, markets="KOSPI", **options).collect()


def test_a_failed_cell_may_count_as_a_holiday(spark, service):
    s = service(market)
    rows = load(spark, s.url, markets="KOSPI", dates="20240104,20240105,20240108", skip_failed="true", cells_too="true").collect()
    assert {r.bas_dd: r.status for r in rows if r.ISU_CD is None} == {"20240104": "ok", "20240105": "failed", "20240108": "ok"}
    assert sum(r.ISU_CD is not None for r in rows) == 2 and s.seen["/KOSPI?basDd=20240105"] == 4
    assert load(spark, s.url, markets="", dates="").collect() == []


def test_landing_fetches_each_cell_once(spark, service, tmp_path):
    s, root = service(market), str(tmp_path)
    spark.dataSource.register(market_api.MarketSnapshots)
    fetch = landing.snapshots(s.url, key="k", pause="0.01")
    asked = lambda *days: spark.createDataFrame([("KOSPI", f"202401{d}") for d in days], landing.CELL)
    assert landing.landed(spark, root, asked("08")).collect() == []
    assert landing.land(asked("04", "05", "08", "08"), root, fetch) == 3
    first = s.seen.copy()
    # The holiday and the day with rows are known; only the failed one is asked for again.
    assert landing.land(asked("04", "08"), root, fetch) == 0 and s.seen == first
    assert landing.land(asked("04", "05", "08", "09"), root, fetch) == 2
    again = s.seen - first
    assert set(again) == {"/KOSPI?basDd=20240105", "/KOSPI?basDd=20240109"}
    got = landing.landed(spark, root, asked("04", "05", "08"))
    assert Counter(r.bas_dd for r in got.collect()) == {"20240108": 2}
    assert {(r.bas_dd, r.n) for r in landing.noted(spark, root).collect()} == {("20240104", 0), ("20240108", 2), ("20240109", 2)}


def test_rows_without_a_note_are_replaced(spark, tmp_path):
    """A run that died after its rows landed, before its cells were noted."""
    root = str(tmp_path)
    asked = spark.createDataFrame([("KOSPI", "20240108")], landing.CELL)

    def fetch(close):
        fields = [f for f in market_api.FIELDS]
        rows = [("KOSPI", "20240108", "ok", *[code if f == "ISU_CD" else close for f in fields]) for code in ("a", None)]
        return lambda missing: spark.createDataFrame(rows, "market string, bas_dd string, status string, " + ", ".join(f"{f} string" for f in fields))

    fetch("1")(asked).filter("ISU_CD IS NOT NULL").drop("status").write.partitionBy("market", "bas_dd").parquet(f"{root}/rows")
    assert landing.landed(spark, root, asked).collect() == []
    assert landing.land(asked, root, fetch("2")) == 1
    assert [(r.ISU_CD, r.TDD_CLSPRC) for r in landing.landed(spark, root, asked).collect()] == [("a", "2")]


def test_frames_stream_by_number(spark, service, tmp_path):
    frames = [f"0|H0|001|T{i % 3}^0900{i:02d}^{100 + i}^7" for i in range(25)]
    state = {"upto": 12, "done": []}

    def feed(path, params, n, key):
        if path == "/latest":
            return 200, {"seq": state["upto"]}
        if path == "/done":
            state["done"].append(int(params["seq"]))
            return 200, {}
        if params["first"] == "10" and n == 1:
            return 503, b""
        return 200, {"frames": frames[int(params["first"]) : int(params["last"])]}

    s = service(feed)
    spark.dataSource.register(market_api.TickFrames)

    def run():
        lines = spark.readStream.format("tick_frames").options(url=s.url, stretch="5", pause="0.01").load()
        q = ticks.parse_frames(lines, "2024-01-08").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(once=True).start()
        assert q.awaitTermination(120)
        return spark.read.parquet(f"{tmp_path}/out").collect()

    assert len(run()) == 12
    state["upto"] = 25  # a restart goes on after what is stored
    rows = run()
    assert sorted(r.price for r in rows) == [100.0 + i for i in range(25)] and {r.ticker for r in rows} == {"T0", "T1", "T2"}


XML = "<?xml version='1.0' encoding='UTF-8'?><result>{}</result>"


def company(**c):
    return "<list>" + "".join(f"<{k}>{v}</{k}>" for k, v in c.items()) + "</list>"


def test_archives_of_company_codes(spark, tmp_path):
    listed = [company(corp_code="1", corp_name="하나", stock_code=" 000010 ", modify_date="20240101"), company(corp_code="2", corp_name="b", stock_code=" "), company(corp_code="3", corp_name="c", stock_code="000030", corp_cls="K"), company(corp_code="4", corp_name="d", stock_code="000040", corp_cls="E")]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("CORPCODE.xml", XML.format("".join(listed)))
        z.writestr("notes/readme.txt", "x")
        z.writestr("empty/", "")
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("CORPCODE.xml", XML.format(company(corp_code="5", corp_name="e", stock_code="000050", corp_cls="Y")))
    members = archives.zip_members(spark, str(tmp_path)).collect()
    assert sorted((r.path[-5:], r.member) for r in members) == [("a.zip", "CORPCODE.xml"), ("a.zip", "notes/readme.txt"), ("b.zip", "CORPCODE.xml")]
    assert [bytes(r.content) for r in members if r.member == "notes/readme.txt"] == [b"x"]
    markets = spark.createDataFrame([("000010", "KOSPI"), ("000030", "KONEX")], "ticker string, market string")
    got = {(r.ticker, r.corp_code, r.corp_name, r.market) for r in archives.read_corp_codes(spark, str(tmp_path), markets).collect()}
    assert got == {("000010", "1", "하나", "KOSPI"), ("000030", "3", "c", "KOSDAQ"), ("000050", "5", "e", "KOSPI")}
    assert {r.ticker for r in archives.read_corp_codes(spark, str(tmp_path)).collect()} == {"000030", "000050"}
    (tmp_path / "c.zip").write_bytes(b"no archive")
    with pytest.raises(Exception, match="BadZipFile"):
        archives.zip_members(spark, str(tmp_path)).collect()


def tables(spark, picks=2, value=1.0):
    arms = spark.createDataFrame([("base",), ("tilt",)], "arm string")
    rows = spark.createDataFrame([(a, f"t{i}", value + i) for a in ("base", "tilt") for i in range(picks)], "arm string, ticker string, score double")
    return {"arms": arms, "picks": rows}


CHECKS = [runs.unique("arms", ["arm"]), runs.unique("picks", ["arm", "ticker"]), runs.matches("picks", ["arm"], "arms"), runs.matches("arms", ["arm"], "picks"), runs.counted("picks", ["arm"], 2), runs.holds("picks", "score >= 0")]


def shown(store, **which):
    return sorted((r.arm, r.ticker, r.score) for r in store.read("2024-01", "picks", **which).collect())


def test_runs_are_written_once(spark, tmp_path):
    store = runs.RunStore(spark, str(tmp_path))
    with pytest.raises(runs.RunError, match="no run"):
        store.read("2024-01", "picks")
    assert store.write("2024-01", "r1", tables(spark), CHECKS) is True
    again = {k: v.repartition(3) for k, v in tables(spark).items()}
    assert store.write("2024-01", "r1", again, CHECKS) is False  # the same rows in another order
    with pytest.raises(runs.RunError, match="other content"):
        store.write("2024-01", "r1", tables(spark, value=5.0), CHECKS)
    assert store.write("2024-01", "r2", tables(spark, value=7.0), CHECKS) is True
    assert shown(store)[0] == ("base", "t0", 7.0) and shown(store, run_id="r1")[0] == ("base", "t0", 1.0)
    assert store.clean("2024-01") == 0 and store.manifest("2024-02") is None


@pytest.mark.parametrize("change,message", [
    (lambda t: t | {"arms": t["arms"].union(t["arms"])}, "arms repeats"), (lambda t: t | {"arms": t["arms"].filter("arm = 'base'")}, "picks without arms"), (lambda t: t | {"picks": t["picks"].filter("arm = 'base'")}, "arms without picks"),
    (lambda t: t | {"picks": t["picks"].filter("NOT (arm = 'tilt' AND ticker = 't1')")}, "has not 2"), (lambda t: t | {"picks": t["picks"].withColumn("score", F.lit(None).cast("double"))}, "score >= 0"),
])
def test_a_run_that_breaks_a_check_isnt_there(spark, tmp_path, change, message):
    store = runs.RunStore(spark, str(tmp_path))
    store.write("2024-01", "r1", tables(spark), CHECKS)
    with pytest.raises(runs.RunError, match=message):
        store.write("2024-01", "r2", change(tables(spark, value=3.0)), CHECKS)
    assert shown(store)[0] == ("base", "t0", 1.0) and store.clean("2024-01") == 0


def test_a_writer_that_dies_between_tables_leaves_the_old_run(spark, tmp_path):
    store = runs.RunStore(spark, str(tmp_path))
    store.write("2024-01", "r1", tables(spark), CHECKS)
    code = f"""
import os
from pyspark.sql import DataFrame, SparkSession
from panelforge.sources import runs
from tests.test_sources import CHECKS, tables
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
t = tables(spark, value=9.0)
class Deadly:
    schema = t["picks"].schema
    @property
    def write(self):
        os._exit(7)
runs.RunStore(spark, {str(tmp_path)!r}).write("2024-01", "r2", {{"arms": t["arms"], "picks": Deadly()}}, CHECKS)
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], env=os.environ, capture_output=True, text=True, timeout=200)
    assert done.returncode == 7, done.stderr[-2000:]
    assert list((tmp_path / "staged/2024-01/r2").iterdir())  # it had begun
    assert shown(store) == sorted((a, f"t{i}", 1.0 + i) for a in ("base", "tilt") for i in range(2)) and store.manifest("2024-01", "r2") is None
    assert store.clean("2024-01") == 1
    assert store.write("2024-01", "r2", tables(spark, value=9.0), CHECKS) is True and shown(store)[0] == ("base", "t0", 9.0)


def test_of_two_writers_the_first_rename_counts(spark, tmp_path):
    store = runs.RunStore(spark, str(tmp_path))
    store.write("2024-01", "r1", tables(spark), CHECKS)
    first = store.manifest("2024-01", "r1")
    assert store._commit("2024-01", "r1", first | {"folder": "elsewhere"}) == first
