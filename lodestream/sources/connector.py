"""A polled source as a streaming data source: ``spark.readStream.format("lodestream_poll")``.

Options: ``path`` of a JSON-lines file that a connector's poll leaves, ``id`` and ``watermark``
fields.  The offset is the watermark, the latest ids and the ids of its poll, so a restart goes on where it was and a poll can be
read again;
the first poll of a source is its baseline and brings nothing unless ``backlog`` is true.
Rows: id, watermark, record (JSON text).
"""

from __future__ import annotations

import json
import os
import subprocess
import threading
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from .taps import RECENT


def field_of(record: object, path: str) -> str | None:
    for step in path.split("."):
        if not isinstance(record, dict) or step not in record:
            return None
        record = record[step]
    return record if isinstance(record, str) else json.dumps(record)


def order_of(mark: str) -> tuple:
    try:
        return 0, float(mark), mark
    except ValueError:
        return 1, 0.0, mark


def fresh(records: list, offset: dict, id_field: str, mark_field: str | None) -> tuple[list[tuple[str, str, str]], dict]:
    """The rows a poll brings, oldest first, and the offset after it."""
    recent, mark = list(offset["recent"]), offset["watermark"]
    rows: dict[str, tuple[str, str, str]] = {}
    for r in records:
        ident = field_of(r, id_field)
        if ident is None or ident in recent or ident in rows:
            continue
        own = (field_of(r, mark_field) or "") if mark_field else ""
        if mark_field and mark and own != mark and not order_of(own) > order_of(mark):
            continue
        rows[ident] = (ident, own, json.dumps(r))
    found = sorted(rows.values(), key=lambda x: (*order_of(x[1]), x[0]))
    if found and mark_field:
        mark = max((mark, found[-1][1]), key=lambda m: (m != "", *order_of(m)))
    return found, {"watermark": mark, "recent": [*recent, *(x[0] for x in found)][-RECENT:], "poll": [x[0] for x in found]}


def exec_events(name: str, command: list[str], token: str = "", params: dict[str, str] | None = None, allow: bool = False, timeout: float | None = None) -> Iterator[dict]:
    """The partial events that a connector's command prints as JSON lines; other lines are passed over.  Refuses unless allowed.

    Token and parameters are in its environment.
    """
    if not allow:
        raise PermissionError("commands are off; pass allow=True to run them")
    env = {**os.environ, "LODESTREAM_CONNECTOR": name, "LODESTREAM_CONNECTOR_TOKEN": token, **{f"LODESTREAM_PARAM_{k.upper()}": v for k, v in (params or {}).items()}}
    with subprocess.Popen(command, env=env, stdin=subprocess.DEVNULL, stdout=subprocess.PIPE, text=True) as running:
        stop = threading.Timer(timeout, running.kill) if timeout else None
        if stop:
            stop.start()
        try:
            for line in running.stdout:
                try:
                    event = json.loads(line)
                except ValueError:
                    continue
                if isinstance(event, dict) and isinstance(event.get("subject"), str):
                    yield {**event, "source": f"connector:{name}"}
        finally:
            if stop:
                stop.cancel()


def restart_wait(tries: int, brought: bool) -> int:
    """Seconds before a command that ended is started again: doubling to a minute, anew after one that brought something."""
    return 2 if brought else min(2 ** (tries + 1), 60)


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options

    def _records(self) -> list:
        with open(self.options["path"]) as f:
            return [json.loads(line) for line in f if line.strip()]

    def _fields(self) -> tuple[str, str | None]:
        return self.options.get("id", "id"), self.options.get("watermark")

    def initialOffset(self) -> dict:
        start = {"watermark": "", "recent": [], "poll": []}
        return start if self.options.get("backlog", "false") == "true" else fresh(self._records(), start, *self._fields())[1]

    def read(self, start: dict):
        rows, end = fresh(self._records(), start, *self._fields())
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict):
        known = set(end["poll"])  # all that the poll brought, however many
        return iter([r for r in fresh(self._records(), start, *self._fields())[0] if r[0] in known])


class PollSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lodestream_poll"

    def schema(self) -> str:
        return "id string, watermark string, record string"

    def simpleStreamReader(self, schema):
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PollSource)
