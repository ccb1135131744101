"""Fluent API over streams and tables: host-language closures in place of SQL.

    stream(df, ts="ts").filter(...).group_by("k").time_windowed_by(Tumbling("10 seconds")).count()

Closures get and give Columns where that is enough; ``map_batches`` and
``aggregate`` take Arrow-batched pandas functions for the rest. Everything returns
plain frames, so batch and streaming sources work alike.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewater.operators.joins import band, latest, lookup, streaming_lookup


@dataclass(frozen=True)
class Tumbling:
    size: str


@dataclass(frozen=True)
class Hopping:
    size: str
    step: str


@dataclass(frozen=True)
class Session:
    gap: str


@dataclass(frozen=True)
class JoinWindows:
    """How far before and after a row its partners may lie, in milliseconds."""

    before_ms: int
    after_ms: int


@dataclass(frozen=True)
class Stream:
    """Rows with an event time ``ts``."""

    df: DataFrame
    ts: str | None = None

    def filter(self, keep: Callable[[DataFrame], Column] | Column | str) -> Stream:
        return Stream(self.df.where(keep(self.df) if callable(keep) and not isinstance(keep, Column) else keep), self.ts)

    def map(self, **columns: Column) -> Stream:
        """New or replaced columns."""
        return Stream(self.df.withColumns(columns), self.ts)

    def select(self, *columns: Column | str) -> Stream:
        out = self.df.select(*columns)
        return Stream(out, self.ts if self.ts in out.columns else None)

    def map_batches(self, f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> Stream:
        """Any function of batches of rows; may give none or many rows for each."""
        out = self.df.mapInPandas(f, schema)
        return Stream(out, self.ts if self.ts in out.columns else None)

    def group_by(self, *keys: Column | str) -> Grouped:
        return Grouped(self, keys)

    def join_stream(self, other: Stream, windows: JoinWindows, on: Column | None = None, how: str = "inner") -> Stream:
        """Pairs within the windows that fulfil ``on``; the names of both sides must differ."""
        streaming = self.df.isStreaming or other.df.isStreaming
        out = band(self.df, other.df, self.ts, other.ts, on, how, windows.before_ms * 1000, windows.after_ms * 1000, streaming)
        return Stream(out, self.ts)

    def join_table(self, table: Table, on: list[str], how: str = "inner") -> Stream:
        """Each row with the table's row of its key."""
        clash = [c for c in table.df.columns if c in self.df.columns and c not in on]
        return Stream(self.df.join(table.df.drop(*clash), on, how), self.ts)

    def join_changes(self, changes: Stream, on: list[str]) -> Stream:
        """Each row with the last change of its key as known at its time; names but the keys must differ. Inner, of streams and of bounded frames."""
        streaming = self.df.isStreaming or changes.df.isStreaming
        f = streaming_lookup if streaming else lookup
        return Stream(f(self.df, changes.df, on, self.ts, changes.ts), self.ts)

    def table(self, *keys: str) -> Table:
        """The last row of each key."""
        return Table(latest(self.df, list(keys), self.ts), list(keys))

    def union(self, other: Stream) -> Stream:
        return Stream(self.df.unionByName(other.df), self.ts)

    def distinct(self) -> Stream:
        return Stream(self.df.distinct(), self.ts)

    def to(self, format: str, mode: str = "append", trigger: dict | None = None, **options: str) -> StreamingQuery | None:
        """Write to a sink: a query for a streaming source, at once for a bounded one."""
        if not self.df.isStreaming:
            self.df.write.format(format).mode(mode if format != "noop" else "overwrite").options(**options).save()
            return None
        return self.df.writeStream.format(format).outputMode(mode).options(**options).trigger(**(trigger or {"availableNow": True})).start()


@dataclass(frozen=True)
class Table:
    """One row for each key."""

    df: DataFrame
    keys: list[str]

    def to_stream(self, ts: str | None = None) -> Stream:
        return Stream(self.df, ts)

    def filter(self, keep: Column | str) -> Table:
        return Table(self.df.where(keep), self.keys)

    def map(self, **columns: Column) -> Table:
        return Table(self.df.withColumns(columns), self.keys)


@dataclass(frozen=True)
class Grouped:
    stream: Stream
    keys: tuple[Any, ...]
    windows: Tumbling | Hopping | Session | None = None

    def time_windowed_by(self, windows: Tumbling | Hopping) -> Grouped:
        return Grouped(self.stream, self.keys, windows)

    def session_windowed_by(self, windows: Session) -> Grouped:
        return Grouped(self.stream, self.keys, windows)

    def _by(self) -> list[Any]:
        w, ts = self.windows, self.stream.ts
        if w is None:
            return list(self.keys)
        if ts is None:
            raise ValueError("a window needs an event time")
        at = F.session_window(ts, w.gap) if isinstance(w, Session) else F.window(ts, w.size, w.step if isinstance(w, Hopping) else None)
        return [at.alias("window_"), *self.keys]

    def agg(self, **aggregates: Column) -> Table:
        """Built-in aggregates, combined map-side; windows add window_start and window_end."""
        out = self.stream.df.groupBy(*self._by()).agg(*[c.alias(n) for n, c in aggregates.items()])
        return self._shown(out)

    def count(self) -> Table:
        return self.agg(count=F.count(F.lit(1)))

    def aggregate(self, init: Any, step: Callable[[Any, Any], Any], finish: Callable[[Any], Any], kind: str, name: str = "value") -> Table:
        """A fold over the rows of each group in the order of the event time.

        Rows of a group come to one task; use ``agg`` where built-in aggregates suffice.
        """
        by, df = self._by(), self.stream.df
        ts = self.stream.ts
        if df.isStreaming:
            return self._folded(init, step, finish, kind, name)
        keyed = df
        names = []
        for i, k in enumerate(by):
            n = k if isinstance(k, str) else f"key_{i}"
            keyed = keyed if isinstance(k, str) else keyed.withColumn(n, k)
            names.append(n)
        kinds = {f.name: f.dataType.simpleString() for f in keyed.schema}

        def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            acc = init
            for row in (pdf.sort_values(ts, kind="stable") if ts else pdf).itertuples(index=False):
                acc = step(acc, row)
            return pd.DataFrame([[*key, finish(acc)]], columns=[*names, name])

        schema = ", ".join([f"`{n}` {kinds[n]}" for n in names] + [f"`{name}` {kind}"])
        return self._shown(keyed.groupBy(*names).applyInPandas(fold, schema).withColumnRenamed("key_0", "window_") if self.windows else keyed.groupBy(*names).applyInPandas(fold, schema))

    def _folded(self, init: Any, step: Callable, finish: Callable, kind: str, name: str) -> Table:
        """The fold over an unbounded stream: the accumulator of each key is kept in the state store; output mode update."""
        if self.windows is not None:
            raise ValueError("a windowed fold over a stream: use agg, or window the keys")
        keys = list(self.keys)
        kinds = {f.name: f.dataType.simpleString() for f in self.stream.df.schema}

        def fold(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
            acc = pickle.loads(state.get[0]) if state.exists else init
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    acc = step(acc, row)
            state.update((pickle.dumps(acc),))
            yield pd.DataFrame([[*key, finish(acc)]], columns=[*keys, name])

        schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [f"`{name}` {kind}"])
        out = self.stream.df.groupBy(*keys).applyInPandasWithState(fold, schema, "acc binary", "update", "NoTimeout")
        return Table(out, keys)

    def process(self, processor: Any, schema: str, mode: str = "append", time: str = "none", initial: Any = None) -> Stream:
        """Any stateful operator, with value, list and map states and timers: a StatefulProcessor, run by Spark's transformWithStateInPandas (needs the RocksDB state store)."""
        out = self.stream.df.groupBy(*self.keys).transformWithStateInPandas(processor, schema, mode, time, initial)
        return Stream(out, self.stream.ts if self.stream.ts in out.columns else None)

    def _shown(self, out: DataFrame) -> Table:
        if self.windows is None:
            return Table(out, [c for c in out.columns if c in self.keys])
        w = self.windows
        end = F.col("window_.end")
        if isinstance(w, Session):
            end = end - F.expr(f"INTERVAL {w.gap}")
        if isinstance(w, Hopping):
            out = out.where(F.unix_micros(F.col("window_.start").cast("timestamp")) >= 0)
        out = out.withColumns({"window_start": F.col("window_.start"), "window_end": end}).drop("window_")
        return Table(out, [*[k for k in self.keys if isinstance(k, str)], "window_start", "window_end"])


def stream(df: DataFrame, ts: str | None = None, lateness: str = "24 hours") -> Stream:
    """A frame as a stream; an unbounded one gets its watermark."""
    if df.isStreaming and ts:
        df = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    return Stream(df, ts)
