"""Data sources over HTTP: daily snapshots in partitions of (market, date), and a stream of tick frames by sequence number.

    spark.dataSource.register(MarketSnapshots)
    spark.read.format("market_snapshots").options(url=..., markets="KOSPI,KOSDAQ", dates="20240102,20240103").load()

    spark.dataSource.register(TickFrames)
    spark.readStream.format("tick_frames").option("url", ...).load()
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Columns of a snapshot's row, all text as the service sends them.
FIELDS = ("ISU_CD", "ISU_NM", "TDD_CLSPRC", "TDD_HGPRC", "ACC_TRDVOL", "ACC_TRDVAL", "MKTCAP", "LIST_SHRS", "MKT_NM")
#: Statuses that another attempt may mend.
TRANSIENT = (429, 500, 502, 503, 504)
ROWS = "OutBlock_1"


class TransientError(RuntimeError):
    """All attempts failed in a way that a later one may mend."""


def get_json(url: str, params: dict[str, str], key: str = "", attempts: int = 4, pause: float = 1.0, timeout: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> object:
    """The JSON of a GET. Throttling, server errors, lost connections and text that isn't JSON are tried again after
    doubled pauses; other statuses, such as a refused key, fail at once."""
    request = urllib.request.Request(f"{url}?{urllib.parse.urlencode(params)}", headers={"AUTH_KEY": key})
    last: Exception | None = None
    for n in range(attempts):
        if n:
            sleep(pause * 2 ** (n - 1))
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as e:
            if e.code not in TRANSIENT:
                raise
            last = e
        except (OSError, ValueError) as e:
            last = e
    raise TransientError(f"{url} {params}: {attempts} attempts failed, the last with {last}")


def rows_of(payload: object) -> list[dict]:
    """The rows of an envelope: a list of objects; a missing or empty one is a day without trade."""
    if not isinstance(payload, dict):
        raise ValueError(f"must be an object, is {type(payload).__name__}")
    rows = payload.get(ROWS) or []
    if not isinstance(rows, list) or any(not isinstance(r, dict) for r in rows):
        raise ValueError(f"{ROWS} must be a list of objects")
    return rows


@dataclass
class Cell(InputPartition):
    market: str
    date: str


class MarketSnapshots(DataSource):
    """Options: url, markets and dates (comma-separated), or cells (market:date, comma-separated), key, attempts, pause,
    skip_failed, cells_too.

    Each (market, date) is a partition, fetched by one task. With skip_failed a cell whose attempts all fail counts as a
    day without rows; a refused key fails the job all the same. With cells_too each cell has one more row, without
    ISU_CD, whose status is ok or failed.
    """

    @classmethod
    def name(cls) -> str:
        return "market_snapshots"

    def schema(self) -> str:
        return "market string, bas_dd string, status string, " + ", ".join(f"{f} string" for f in FIELDS)

    def reader(self, schema) -> DataSourceReader:
        return SnapshotReader(self.options)


class SnapshotReader(DataSourceReader):
    def __init__(self, options):
        o = {k.lower(): v for k, v in options.items()}
        self.url, self.key = o["url"], o.get("key", "")
        self.attempts, self.pause = int(o.get("attempts", 4)), float(o.get("pause", 1.0))
        self.skip, self.cells_too = o.get("skip_failed", "false") == "true", o.get("cells_too", "false") == "true"
        listed = lambda name: [x for x in o.get(name, "").split(",") if x]
        self.cells = [Cell(*c.split(":")) for c in listed("cells")] + [Cell(m, d) for m in listed("markets") for d in listed("dates")]

    def partitions(self) -> list[Cell]:
        return self.cells

    def read(self, cell: Cell) -> Iterator[tuple]:
        if not isinstance(cell, Cell):  # no cells were asked for
            return
        status, rows = "ok", []
        try:
            rows = rows_of(get_json(f"{self.url}/{cell.market}", {"basDd": cell.date}, self.key, self.attempts, self.pause))
        except TransientError:
            if not self.skip:
                raise
            status = "failed"
        for r in rows:
            yield (cell.market, cell.date, status, *(None if r.get(f) is None else str(r[f]) for f in FIELDS))
        if self.cells_too:
            yield (cell.market, cell.date, status, *[None] * len(FIELDS))


@dataclass
class Stretch(InputPartition):
    first: int
    last: int


class TickFrames(DataSource):
    """Options: url, stretch (frames to a partition), attempts, pause.

    The service numbers its frames: ``/latest`` gives the next number, ``/frames`` those of a range, and ``/done`` is
    told up to where a batch is stored. Columns: seq and value, the frame's text, as ``streaming.ticks.parse_frames`` takes it.
    """

    @classmethod
    def name(cls) -> str:
        return "tick_frames"

    def schema(self) -> str:
        return "seq long, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FrameReader(self.options)


class FrameReader(DataSourceStreamReader):
    def __init__(self, options):
        o = {k.lower(): v for k, v in options.items()}
        self.url, self.stretch = o["url"], int(o.get("stretch", 1000))
        self.attempts, self.pause = int(o.get("attempts", 4)), float(o.get("pause", 1.0))

    def _get(self, path: str, **params) -> dict:
        return get_json(f"{self.url}/{path}", {k: str(v) for k, v in params.items()}, attempts=self.attempts, pause=self.pause)

    def initialOffset(self) -> dict:
        return {"seq": 0}

    def latestOffset(self) -> dict:
        return {"seq": int(self._get("latest")["seq"])}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        return [Stretch(a, min(a + self.stretch, end["seq"])) for a in range(start["seq"], end["seq"], self.stretch)]

    def read(self, part: Stretch) -> Iterator[tuple]:
        frames = self._get("frames", first=part.first, last=part.last)["frames"]
        if len(frames) != part.last - part.first:
            raise ValueError(f"{len(frames)} frames for {part}")
        for i, text in enumerate(frames):
            yield part.first + i, text

    def commit(self, end: dict) -> None:
        self._get("done", seq=end["seq"])
