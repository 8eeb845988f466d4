"""A stream of log rows pulled from a log service: offsets per log group, a look-back on the first poll, pages, replay after failures."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "log_group string, log_stream string, timestamp long, event_id string, message string"
_ARROW = pa.schema([("log_group", pa.string()), ("log_stream", pa.string()), ("timestamp", pa.int64()), ("event_id", pa.string()), ("message", pa.string())])
#: How far the first poll looks back, and how many rows a page has at most.
LOOK_BACK_S, PAGE_ROWS = 300, 10_000


class LogClient(Protocol):
    """A log service. Its methods run in Python workers, so it must be picklable."""

    def groups(self) -> list[str]: ...

    def page(self, group: str, after_ms: int, until_ms: int, pattern: str | None, token: str | None, limit: int) -> tuple[list[dict], str | None]:
        """Rows (log_stream, timestamp, event_id, message) with after_ms < timestamp <= until_ms, at most limit, and a token for the next page or None."""


@dataclass
class Range(InputPartition):
    group: str
    after_ms: int
    until_ms: int


class _Reader(DataSourceStreamReader):
    def __init__(self, client: LogClient, options: dict):
        self.client, self.pattern = client, options.get("pattern")
        self.groups = json.loads(options["groups"]) if "groups" in options else None
        self.look_back_ms = int(1000 * float(options.get("lookback", LOOK_BACK_S)))
        self.late_ms = int(1000 * float(options.get("lateness", 0)))
        self.limit = int(options.get("page", PAGE_ROWS))
        self.began = int(options["now"]) if "now" in options else None

    def _now(self) -> int:
        now = getattr(self.client, "now_ms", None)
        return now() if now else int(1000 * time.time())

    def _names(self) -> list[str]:
        return self.groups if self.groups is not None else sorted(self.client.groups())

    def initialOffset(self) -> dict:
        start = (self.began or self._now()) - self.look_back_ms
        return {"start": start, "until": {g: start for g in self._names()}}

    def latestOffset(self) -> dict:
        """All groups up to now, less the time that rows may come late. A clock that goes back moves nothing back, see partitions()."""
        return {"until": {g: self._now() - self.late_ms for g in self._names()}}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        """A range per group, without its start, so that what one poll ends with the next one doesn't read again. A new group starts where the others did."""
        low = min(start["until"].values(), default=0)
        return [Range(g, start["until"].get(g, low), until) for g, until in end["until"].items() if until > start["until"].get(g, low)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        token = None
        while True:
            rows, token = self.client.page(part.group, part.after_ms, part.until_ms, self.pattern, token, self.limit)
            if rows:
                full = [{"log_group": part.group, "event_id": None, **r} for r in rows]
                yield pa.RecordBatch.from_pylist([r | {"event_id": r["event_id"] or f"{r['log_stream']}-{r['timestamp']}"} for r in full], _ARROW)
            if token is None:
                return

    def commit(self, end: dict) -> None:
        """Nothing to do: the checkpoint keeps the offsets, and a batch that failed is read again by its own."""


def log_source(client: LogClient, name: str = "logs") -> type[DataSource]:
    """A data source over a client; register it by spark.dataSource.register, then spark.readStream.format(name).

    Options: groups (JSON list; all of the client's else), pattern, lookback (seconds before the first poll, 300), lateness (seconds that rows may come late,
    0), page (rows of a page), now (milliseconds that the first poll takes for now). A poll reads all pages of its range. Offsets advance with
    the checkpoint, on success or when there is nothing; a batch that failed is read again from the offsets it had.
    """

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _Reader(client, self.options)

    return Source
