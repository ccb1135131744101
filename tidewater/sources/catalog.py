"""Streams, views, queries and connectors of an engine."""

from __future__ import annotations

import enum
import json
import threading
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from tidewater.errors import RunError
from tidewater.sources.connectors import Connector


class Status(enum.Enum):
    CREATING = "CREATING"
    RUNNING = "RUNNING"
    RESUMING = "RESUMING"
    ABORTED = "ABORTED"
    PAUSED = "PAUSED"
    TERMINATED = "TERMINATED"


@dataclass
class Stream:
    """A log of rows at ``path``; ``schema`` is None where rows are free JSON."""

    name: str
    path: str
    format: str = "parquet"
    schema: T.StructType | None = None
    event_time: str | None = "_ts"
    owned: bool = True
    options: dict[str, Any] = field(default_factory=dict)
    frame: Any = None


@dataclass
class View:
    name: str
    path: str
    keys: list[str]
    query: str
    schema: T.StructType
    complete: bool = False


@dataclass
class Query:
    """A continuous query: what it runs, its handles, oldest stage first."""

    name: str
    sql: str
    kind: str
    sources: list[str]
    sink: str
    start: Any = None
    handles: list[Any] = field(default_factory=list)
    wanted: Status = Status.CREATING

    @property
    def status(self) -> Status:
        if self.wanted in (Status.PAUSED, Status.TERMINATED, Status.CREATING, Status.RESUMING):
            return self.wanted
        if any(h.exception() is not None for h in self.handles):
            return Status.ABORTED
        return Status.RUNNING

    def counts(self) -> dict[str, int]:
        done = [p for h in self.handles for p in h.recentProgress]
        return {"input_rows": sum(int(p["numInputRows"]) for p in done), "batches": len(done), "errors": sum(h.exception() is not None for h in self.handles)}


class Catalog:
    """Names of each kind; names may be prefixed by a namespace."""

    def __init__(self, namespace: str = ""):
        self.namespace, self.lock = namespace, threading.RLock()
        self.streams: dict[str, Stream] = {}
        self.views: dict[str, View] = {}
        self.queries: dict[str, Query] = {}
        self.connectors: dict[str, Any] = {}

    def full(self, name: str) -> str:
        return self.namespace + name

    def kind(self, what: str) -> dict[str, Any]:
        return {"STREAM": self.streams, "VIEW": self.views, "QUERY": self.queries, "CONNECTOR": self.connectors}[what.rstrip("S") if what != "QUERIES" else "QUERY"]

    def add(self, what: str, name: str, x: Any) -> Any:
        with self.lock:
            if self.full(name) in self.kind(what) or what in ("STREAM", "VIEW") and (self.full(name) in self.streams or self.full(name) in self.views):
                raise RunError(f"{name} exists")
            self.kind(what)[self.full(name)] = x
        return x

    def get(self, what: str, name: str) -> Any:
        if self.full(name) not in self.kind(what):
            raise RunError(f"no {what.lower()} {name}")
        return self.kind(what)[self.full(name)]

    def has(self, what: str, name: str) -> bool:
        return self.full(name) in self.kind(what)

    def drop(self, what: str, name: str) -> Any:
        self.get(what, name)
        return self.kind(what).pop(self.full(name))

    def users(self, name: str) -> list[str]:
        """Queries not terminated that read or write ``name``."""
        return [q.name for q in self.queries.values() if q.status is not Status.TERMINATED and (name in q.sources or name == q.sink)]


class Store:
    """A catalog as numbered JSON files in a folder; the last one counts. Frames and push queries end with their engine."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark._jvm
        self.at = jvm.org.apache.hadoop.fs.Path
        self.path, self.copy, self.conf = path, jvm.org.apache.commons.io.IOUtils, spark._jsc.hadoopConfiguration()
        self.fs = self.at(path).getFileSystem(self.conf)

    def _versions(self) -> list[str]:
        if not self.fs.exists(self.at(self.path)):
            return []
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self.at(self.path)) if f.getPath().getName().endswith(".json"))

    def save(self, c: Catalog) -> None:
        old = self._versions()
        number = int(old[-1][:-5]) + 1 if old else 0
        shown = lambda x, names: {n: getattr(x, n) for n in names}
        schema = lambda x: x.schema.json() if x.schema else None
        data = {
            "streams": {k: shown(x, ("name", "path", "format", "event_time", "owned", "options")) | {"schema": schema(x)} for k, x in c.streams.items() if x.frame is None and not k.startswith(f"{c.namespace}_push_")},
            "views": {k: shown(x, ("name", "path", "keys", "query", "complete")) | {"schema": schema(x)} for k, x in c.views.items()},
            "queries": {k: shown(x, ("name", "sql", "kind", "sources", "sink")) | {"status": x.status.value} for k, x in c.queries.items() if x.kind != "push"},
            "connectors": {k: shown(x, ("name", "side", "kind", "stream", "format", "options", "status")) for k, x in c.connectors.items()},
        }
        tmp = f"{self.path}/{number:09d}.tmp"
        out = self.fs.create(self.at(tmp), True)
        self.copy.write(json.dumps(data), out, "UTF-8")
        out.close()
        self.fs.rename(self.at(tmp), self.at(f"{self.path}/{number:09d}.json"))
        for f in old:
            self.fs.delete(self.at(f"{self.path}/{f}"), False)

    def load(self, c: Catalog) -> None:
        found = self._versions()
        if not found:
            return
        stream = self.fs.open(self.at(f"{self.path}/{found[-1]}"))
        data = json.loads(self.copy.toString(stream, "UTF-8"))
        stream.close()
        schema = lambda x: T.StructType.fromJson(json.loads(x["schema"])) if x["schema"] else None
        c.streams = {k: Stream(**x | {"schema": schema(x)}) for k, x in data["streams"].items()}
        c.views = {k: View(**x | {"schema": schema(x)}) for k, x in data["views"].items()}
        c.connectors = {k: Connector(**x) for k, x in data["connectors"].items()}
        for k, x in data["queries"].items():
            status = Status(x.pop("status"))
            c.queries[k] = Query(**x, wanted=status if status in (Status.PAUSED, Status.TERMINATED) else Status.RESUMING)
