"""The engine: one entry for every statement, in batch and as continuous queries.

Streams are folders of files that any number of writers append to. A SELECT reads
them as they stand (bounded), EMIT CHANGES, CREATE STREAM AS, INSERT ... SELECT and
CREATE VIEW run as Structured Streaming queries with checkpoints. Each micro-batch
goes to a folder named by its number, so a batch that is repeated after a failure
replaces itself. A join under an aggregate runs as two queries with the joined
rows between them, each with the output mode it needs.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import tempfile
import uuid
from collections import deque
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.errors import BindError, PlanError, RunError
from tidewater.plans import validate
from tidewater.plans.lower import Lowering, declared
from tidewater.plans.parser import Expr, Item, Select, Source, Statement, parse
from tidewater.sources.catalog import Catalog, Query, Status, Store, Stream, View
from tidewater.sources.connectors import Connector, connector, read, records, write

#: A view's log of changes is compacted after so many batches.
COMPACT = 20


class Engine:
    """``root`` is a folder in shared storage; ``trigger`` is that of writeStream.

    An engine with a ``name`` keeps its catalog there: one that is opened later under
    the same root and name has its streams, views, queries and connectors, and
    ``recover`` starts what was running, from checkpoints.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, compat: bool = False, trigger: dict | None = None, lateness: str = "24 hours", namespace: str = "", name: str | None = None):
        self.spark, self.compat, self.lateness = spark, compat, lateness
        self.root = (root or spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tidewater-")).rstrip("/") + f"/engine-{name or uuid.uuid4().hex[:8]}"
        self.trigger = trigger or {"availableNow": True}
        #: (subscription, time, deliveries) of late acknowledgements, for the metric tables.
        self.acked: deque[tuple] = deque(maxlen=10_000)
        self.catalog = Catalog(namespace)
        self.store = Store(spark, f"{self.root}/catalog") if name else None
        if self.store:
            self.store.load(self.catalog)
            for q in self.catalog.queries.values():
                self._prepare(q)

    def _save(self) -> None:
        if self.store:
            self.store.save(self.catalog)

    def recover(self) -> list[Query]:
        """Starts the connectors and queries of an earlier engine that had neither been paused nor terminated."""
        found = [q for q in self.catalog.queries.values() if q.wanted is Status.RESUMING]
        for q in found:
            q.start()
        for c in self.catalog.connectors.values():
            if c.status != "PAUSED":
                self._attach(c)
        self._save()
        return found

    # streams

    def register(self, name: str, path: str, event_time: str | None = None, format: str = "parquet") -> Stream:
        """A folder or file that exists, as a stream."""
        schema = self.spark.read.format(format).load(path).schema
        out = self.catalog.add("STREAM", name, Stream(name, path, format, schema, event_time, owned=False))
        self._save()
        return out

    def register_frame(self, name: str, df: DataFrame, event_time: str | None = None) -> Stream:
        """Any frame as a stream, for batch statements."""
        return self.catalog.add("STREAM", name, Stream(name, "", "frame", df.schema, event_time, owned=False, frame=df))

    def _open(self, name: str) -> tuple[DataFrame, str | None]:
        if self.catalog.has("VIEW", name):
            return self.view(name), None
        s = self.catalog.get("STREAM", name)
        if s.frame is not None:
            return s.frame, s.event_time
        if s.owned:
            df = self._owned(s, self.spark.read)
        else:
            df = self.spark.read.format(s.format).schema(s.schema).load(s.path)
        keep = s.options.get("DURATION")
        if keep and s.event_time:
            df = df.where(F.col(s.event_time) >= F.current_timestamp() - F.make_dt_interval(secs=F.lit(keep / 1000).cast("decimal(18,6)")))
        return df, s.event_time

    def _owned(self, s: Stream, reader) -> DataFrame:
        schema = s.schema
        if schema is None:
            schema = self._inferred(s)
            return reader.format("json").schema(schema).option("recursiveFileLookup", "true").load(s.path)
        return reader.format("parquet").schema(schema).option("recursiveFileLookup", "true").load(s.path)

    def _inferred(self, s: Stream) -> T.StructType:
        """The fields that a stream of free JSON has shown so far: those that its writers have noted, or else what its files show."""
        noted = f"{s.path}/_schema"
        if self._exists(noted):
            found = [T.StructType.fromJson(json.loads(r[0])) for r in self.spark.read.text(f"{noted}/*").distinct().collect()]  # a row for each set of fields
        else:
            found = [self.spark.read.option("recursiveFileLookup", "true").json(s.path).schema] if self._exists(s.path) else []
        fields: dict[str, T.DataType] = {}
        for f in sorted((f for x in found for f in x if f.name != "_ts"), key=lambda f: f.name):
            fields[f.name] = _common(fields[f.name], f.dataType) if f.name in fields else f.dataType
        return T.StructType([*[T.StructField(n, t) for n, t in fields.items()], T.StructField("_ts", T.TimestampType())])

    def _note(self, s: Stream, schema: T.StructType) -> None:
        """Notes the fields of rows that are written to a stream of free JSON, so that readers need not look through it."""
        noted, text = f"{s.path}/_schema", schema.json()
        path = f"{noted}/{hashlib.md5(text.encode()).hexdigest()}"
        if not self._exists(noted) and not self._bare(s.path):
            self._note_at(f"{noted}/before", self._inferred(s))
        if not self._exists(f"{path}/_SUCCESS"):
            self._note_at(path, schema)

    def _note_at(self, path: str, schema: T.StructType) -> None:
        self.spark.createDataFrame([(schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    def _bare(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return not self._exists(path) or not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(p)

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def _mkdirs(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(p)

    def _open_stream(self, name: str) -> tuple[DataFrame, str | None]:
        if self.catalog.has("VIEW", name):
            raise PlanError(f"{name} is a view: a continuous query reads streams")
        s = self.catalog.get("STREAM", name)
        if s.frame is not None:
            df = s.frame
            if not df.isStreaming:
                raise PlanError(f"{name} is a bounded frame")
        elif s.owned:
            df = self._owned(s, self.spark.readStream)
        else:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(s.path)
            reader = self.spark.readStream.format(s.format).schema(s.schema)
            if path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile():  # only folders stream
                df = reader.option("pathGlobFilter", path.getName()).load(path.getParent().toString())
            else:
                df = reader.load(s.path)
        if s.event_time:
            if isinstance(df.schema[s.event_time].dataType, T.TimestampNTZType):
                df = df.withColumn(s.event_time, F.col(s.event_time).cast("timestamp"))
            df = df.withWatermark(s.event_time, self.lateness)
        return df, s.event_time

    def append(self, name: str, df: DataFrame, compression: str | None = None) -> None:
        """Append rows; ``_ts`` is now where they have none. ``compression`` is none, gzip or zstd (snappy, of declared columns, unless given)."""
        if compression not in (None, "none", "gzip", "zstd"):
            raise RunError(f"no compression {compression}")
        s = self.catalog.get("STREAM", name)
        if not s.owned:
            raise RunError(f"{name} isn't this engine's")
        if "_ts" not in df.columns:
            df = df.withColumn("_ts", F.current_timestamp())
        path = f"{s.path}/rows-{uuid.uuid4().hex}"
        if s.schema is None:
            self._note(s, df.schema)
            df.write.option("compression", compression or "none").json(path)
        else:
            df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in s.schema]).write.option("compression", compression or "snappy").parquet(path)

    def read_range(self, name: str, start=None, end=None, key=None) -> DataFrame:
        """A bounded read by event time, both ends included, and by equality of columns."""
        df, ts = self._open(name)
        if start is not None:
            df = df.where(F.col(ts) >= F.lit(start))
        if end is not None:
            df = df.where(F.col(ts) <= F.lit(end))
        for k, v in (key or {}).items():
            df = df.where(F.col(k).eqNullSafe(F.lit(v)))
        return df

    def read_shard(self, name: str, shard: int, shards: int, by: list[str], start=None, end=None) -> DataFrame:
        """The rows of one of ``shards`` shards, into which the columns ``by`` deal a stream by hash; each row is in exactly one."""
        if not 0 <= shard < shards:
            raise RunError(f"no shard {shard} of {shards}")
        return self.read_range(name, start, end).where(F.pmod(F.xxhash64(*by), F.lit(shards)) == shard)

    def trim(self, name: str, before) -> None:
        """Rows before a time are gone for readers, and from the files of an owned stream."""
        s = self.catalog.get("STREAM", name)
        if not s.owned or s.schema is None or self.catalog.users(name):
            raise RunError(f"{name} can't be trimmed")
        kept = f"{s.path}-{uuid.uuid4().hex[:8]}"
        self._open(name)[0].where(F.col(s.event_time) >= F.lit(before)).write.parquet(kept)
        old, s.path = s.path, kept
        self._save()
        self._delete(old)

    # statements

    def execute(self, sql: str) -> Any:
        """A DataFrame for SELECT, SHOW and EXPLAIN, a Query for continuous ones, else None."""
        s = parse(sql)
        if isinstance(s, Select) and not s.emit:
            return Lowering(self._open, self.compat).select(s)
        try:
            if isinstance(s, Select):
                return self._push(s, sql)
            validate.statement(s)
            return getattr(self, f"_{s.kind}")(s, sql)
        finally:
            if isinstance(s, Select) or s.kind not in ("show", "explain", "insert", "insert_raw"):
                self._save()

    def sql(self, sql: str) -> DataFrame:
        out = self.execute(sql)
        if not isinstance(out, DataFrame):
            raise PlanError("the statement gives no rows")
        return out

    def _explain(self, s: Statement, sql: str) -> DataFrame:
        q = s.inner if isinstance(s.inner, Select) else s.inner.select
        if q is None:
            raise PlanError("nothing to explain")
        return self.spark.createDataFrame([(line,) for line in Lowering(self._open, self.compat).explain(q).split("\n")], "plan string")

    def _create_stream(self, s: Statement, sql: str):
        path = f"{self.root}/streams/{self.catalog.full(s.name)}"
        if s.select:
            return self._derive(s, sql, path)
        schema = None
        if s.columns:
            fields = [declared(c, t) for c, t in s.columns]
            schema = T.StructType([*fields, T.StructField("_ts", T.TimestampType())])
        self._mkdirs(path)
        self.catalog.add("STREAM", s.name, Stream(s.name, path, schema=schema, options=s.options))

    def _derive(self, s: Statement, sql: str, path: str) -> Query:
        schema = self._schema(s.select)
        if "_ts" not in schema.names:
            schema = T.StructType([*schema, T.StructField("_ts", T.TimestampType())])
        self._mkdirs(path)
        self.catalog.add("STREAM", s.name, Stream(s.name, path, schema=schema, options=s.options))
        return self._start(s.select, sql, "stream", s.name, self._to_stream(s.name))

    def _schema(self, q: Select) -> T.StructType:
        df, _ = Lowering(self._open_stream, self.compat, streaming=not self._two_steps(q)).timed(q) if not self._two_steps(q) else Lowering(self._open, self.compat).timed(q)
        return df.schema

    def _to_stream(self, name: str):
        def put(df: DataFrame, batch: int, query: str) -> None:
            s = self.catalog.get("STREAM", name)
            if "_ts" not in df.columns:
                df = df.withColumn("_ts", F.col("window_end").cast("timestamp") if "window_end" in df.columns else F.current_timestamp())
            path = f"{s.path}/{query}-{batch:012d}"
            if s.schema is None:
                self._note(s, df.schema)
                return df.write.mode("overwrite").json(path)
            df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in s.schema]).write.mode("overwrite").parquet(path)

        return put

    def _create_view(self, s: Statement, sql: str) -> Query:
        q = s.select
        shown = {i.name for i in q.items}
        keys = [i.name for i in q.items if i.expr.op == "column"]
        if len(keys) < len(q.group):
            raise PlanError("a view must select the columns it groups by, so that its rows can be told apart")
        schema = self._schema(q)
        keys += [c for c in ("window_start", "window_end") if c in schema.names and c not in shown]
        v = View(s.name, f"{self.root}/views/{self.catalog.full(s.name)}", keys, "", schema, q.source.kind == "window" and q.source.window == "SESSION")
        self.catalog.add("VIEW", s.name, v)
        v.query = f"view_{s.name}"
        return self._start(q, sql, "view", s.name, self._to_view(v), v.query)

    def _to_view(self, v: View):
        def put(df: DataFrame, batch: int, query: str) -> None:
            if v.complete:
                # sessions have no update mode: the whole result, beside the last one, which readers may still use
                df.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{v.path}/{batch:012d}")
                for f in self._folders(v.path)[:-2]:
                    self._delete(f)
                return
            df.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{v.path}/{batch:012d}")
            if batch and batch % COMPACT == 0:
                self._compact(v, batch)

        return put

    def _folders(self, path: str) -> list[str]:
        if not self._exists(path):
            return []
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        found = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(p)
        names = [f.getPath().getName() for f in found]
        done = [n for n in names if self._exists(f"{path}/{n}/_SUCCESS")]
        bases = [n for n in done if n.endswith("-base")]
        base = max(bases, default="")
        return [f"{path}/{n}" for n in sorted(done) if n == base or "-base" not in n and n > base]

    def _compact(self, v: View, batch: int) -> None:
        """One folder for all batches up to this one; readers switch when it is complete.

        What the last folder of this kind stands for goes now: readers that still use
        it have listed it a whole round of batches ago.
        """
        old = self._folders(v.path)
        self._latest(v, old).write.mode("overwrite").parquet(f"{v.path}/{batch:012d}-base")
        p = self.spark._jvm.org.apache.hadoop.fs.Path(v.path)
        names = [f.getPath().getName() for f in p.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(p)]
        kept = {f.rpartition("/")[2] for f in old} | {f"{batch:012d}-base"}
        for n in names:
            if n not in kept:
                self._delete(f"{v.path}/{n}")

    def _latest(self, v: View, folders: list[str]) -> DataFrame:
        log = self.spark.read.schema(T.StructType([*v.schema, T.StructField("_batch", T.IntegerType())])).parquet(*folders)
        rest = [c for c in log.columns if c not in v.keys]
        return log.groupBy(*[F.col(f"`{k}`") for k in v.keys]).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), "_batch").alias("x")).select(*[F.col(f"`{k}`") for k in v.keys], *[F.col("x").getField(c).alias(c) for c in rest]).select(*[F.col(f"`{c}`") for c in log.columns])

    def view(self, name: str) -> DataFrame:
        """The view as it stands."""
        v = self.catalog.get("VIEW", name)
        folders = self._folders(v.path)
        if not folders:
            return self.spark.createDataFrame([], v.schema)
        if v.complete:
            return self.spark.read.schema(v.schema).parquet(folders[-1])
        return self._latest(v, folders).drop("_batch")

    def _insert(self, s: Statement, sql: str) -> None:
        stream = self.catalog.get("STREAM", s.name)
        low = Lowering(self._open, self.compat)
        one = self.spark.range(1)
        from tidewater.plans.lower import relation

        r = relation(one, None, None)
        declared = {f.name: f.dataType for f in stream.schema} if stream.schema else None
        cols = []
        for (c, _), e in zip(s.columns, s.values, strict=True):
            if declared is not None and c not in declared:
                raise BindError(f"{s.name} has no column {c}")
            x = low.expr(e, r)[0]
            cols.append((x.cast(declared[c]) if declared else x).alias(c))
        self.append(s.name, r.df.select(*cols))

    def _insert_raw(self, s: Statement, sql: str) -> None:
        """A JSON object becomes a row; any other bytes are stored beside and no SELECT sees them."""
        stream = self.catalog.get("STREAM", s.name)
        text = s.values.args[0].value
        try:
            value = json.loads(text)
        except (TypeError, ValueError):
            value = None
        if not isinstance(value, dict):
            if s.values.value == "JSONB":
                raise BindError("not a JSON object")
            self.spark.createDataFrame([(bytearray(str(text).encode()), datetime.datetime.now(datetime.UTC))], "raw binary, _ts timestamp").write.parquet(f"{self.root}/raw/{s.name}/{uuid.uuid4().hex}")
            return
        if stream.schema is not None:
            unknown = value.keys() - set(stream.schema.names)
            if unknown:
                raise BindError(f"{s.name} has no column {sorted(unknown)[0]}")
            body = T.StructType([f for f in stream.schema if f.name != "_ts"])
            df = self.spark.createDataFrame([(json.dumps(value),)], "j string").select(F.from_json("j", body).alias("x")).select("x.*")
        else:
            df = self.spark.createDataFrame([(json.dumps(value),)], "j string")
            df = df.select(F.from_json("j", df.select(F.schema_of_json(F.lit(json.dumps(value)))).first()[0]).alias("x")).select("x.*")
        self.append(s.name, df)

    def _insert_select(self, s: Statement, sql: str) -> Query:
        self.catalog.get("STREAM", s.name)
        if s.name in sources(s.select.source):
            raise PlanError(f"{s.name} can't be its own source")
        return self._start(s.select, sql, "insert", s.name, self._to_stream(s.name))

    # continuous queries

    def _push(self, q: Select, sql: str) -> Query:
        """EMIT CHANGES: the changes go to a stream that only this query's reader knows."""
        name = f"_push_{uuid.uuid4().hex[:8]}"
        schema = self._schema(q)
        if "_ts" not in schema.names:
            schema = T.StructType([*schema, T.StructField("_ts", T.TimestampType())])
        path = f"{self.root}/streams/{name}"
        self._mkdirs(path)
        self.catalog.add("STREAM", name, Stream(name, path, schema=schema))
        return self._start(q, sql, "push", name, self._to_stream(name))

    def changes(self, q: Query) -> DataFrame:
        """What a push query or a derived stream has emitted."""
        return self._open(q.sink)[0].drop("_ts")

    def _two_steps(self, q: Select) -> bool:
        return q.source.kind == "join" and is_aggregate(q)

    def _start(self, q: Select, sql: str, kind: str, sink: str, put, name: str | None = None) -> Query:
        name = name or f"q_{uuid.uuid4().hex[:8]}"
        query = Query(name, sql, kind, sources(q.source), sink)
        self.catalog.add("QUERY", name, query)
        self._ready(query, q, put)
        query.start()
        return query

    def _prepare(self, query: Query) -> None:
        """What a query of an earlier engine does when it starts."""
        s = parse(query.sql)
        put = self._to_view(self.catalog.get("VIEW", query.sink)) if query.kind == "view" else self._to_stream(query.sink)
        self._ready(query, s if isinstance(s, Select) else s.select, put)

    def _ready(self, query: Query, q: Select, put) -> None:
        name = query.name
        work = f"{self.root}/checkpoints/{name}"

        def run() -> None:
            query.handles = []
            plan = q
            if self._two_steps(q):
                plan = self._joined_first(q, query, work)
            df, _ = Lowering(self._open_stream, self.compat, streaming=True).timed(plan)
            session = plan.source.kind == "window" and plan.source.window == "SESSION"
            mode = "append" if not is_aggregate(plan) else "complete" if session else "update"
            writer = df.writeStream.outputMode(mode).foreachBatch(lambda b, i: put(b, i, name)).option("checkpointLocation", f"{work}/main").queryName(f"{self.root.rpartition('/')[2]}-{name}")
            query.handles.append(writer.trigger(**self.trigger).start())
            query.wanted = Status.RUNNING

        query.start = run

    def _joined_first(self, q: Select, query: Query, work: str) -> Select:
        """Starts the join as a query of its own and gives the SELECT over its rows."""
        low = Lowering(self._open_stream, self.compat, streaming=True)
        r = low.source(q.source)
        df = r.df.where(low.expr(q.where, r)[0]) if q.where else r.df
        shown = [f for f in r.fields]
        clash = {f.name for f in shown if sum(g.name == f.name for g in shown) > 1}
        names = {f.own: f"{f.owner}.{f.name}" if f.name in clash else f.name for f in shown}
        path, hidden = f"{work}/joined", f"_joined_{query.name}"
        rows = df.select(*[F.col(o).alias(n) for o, n in names.items()], *([F.col(r.ts).alias("_ts")] if "_ts" not in names.values() else []))
        self._mkdirs(path)
        if not self.catalog.has("STREAM", hidden):
            self.catalog.add("STREAM", hidden, Stream(hidden, path, schema=rows.schema))
        writer = rows.writeStream.outputMode("append").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{path}/b-{i:012d}")).option("checkpointLocation", f"{work}/join")
        handle = writer.trigger(**self.trigger).start()
        query.handles.append(handle)
        if self.trigger.get("availableNow") or self.trigger.get("once"):
            handle.awaitTermination()

        def renamed(e: Expr) -> Expr:
            if e.op == "column":
                return Expr("column", value=(None, names[r.find(*e.value).own]), text=e.text)
            return Expr(e.op, [renamed(a) if isinstance(a, Expr) else a for a in e.args], e.value, e.text)

        items = [Item(renamed(i.expr), i.name) for i in q.items]
        return Select(items, Source("stream", name=hidden), None, [renamed(g) for g in q.group or []], renamed(q.having) if q.having else None)

    def wait(self, q: Query | None = None, timeout: float | None = None) -> None:
        for x in [q] if q else list(self.catalog.queries.values()):
            for h in x.handles:
                h.awaitTermination(timeout) if timeout else h.awaitTermination()

    def _terminate(self, s: Statement, sql: str) -> None:
        for q in list(self.catalog.queries.values()) if s.what == "ALL" else [self.catalog.get("QUERY", s.name)]:
            for h in q.handles:
                h.stop()
            q.wanted = Status.TERMINATED

    def _pause(self, s: Statement, sql: str) -> None:
        if s.what == "CONNECTOR":
            return self._halt(self.catalog.get("CONNECTOR", s.name), "PAUSED")
        q = self.catalog.get("QUERY", s.name)
        if q.status not in (Status.RUNNING, Status.ABORTED):
            raise RunError(f"{s.name} isn't running")
        for h in q.handles:
            h.stop()
        q.wanted = Status.PAUSED

    def _resume(self, s: Statement, sql: str) -> None:
        """Starts again from the checkpoint, with the state it holds."""
        if s.what == "CONNECTOR":
            return self._attach(self.catalog.get("CONNECTOR", s.name))
        q = self.catalog.get("QUERY", s.name)
        if q.status not in (Status.PAUSED, Status.ABORTED):
            raise RunError(f"{s.name} isn't paused")
        q.wanted = Status.RESUMING
        q.start()

    def refresh(self, q: Query) -> Query:
        """Runs a bounded continuous query again over what arrived since."""
        self.wait(q)
        q.start()
        self.wait(q)
        return q

    def _drop(self, s: Statement, sql: str) -> None:
        if s.flag and not self.catalog.has(s.what, s.name):
            return
        x = self.catalog.get(s.what, s.name)
        if s.what == "STREAM" and (used := self.catalog.users(s.name)):
            raise RunError(f"{s.name} is used by {used[0]}")
        if s.what == "QUERY" and x.status is not Status.TERMINATED:
            raise RunError(f"{s.name} must be terminated first")
        if s.what == "VIEW":
            if self.catalog.queries[x.query].status is not Status.TERMINATED if x.query in self.catalog.queries else False:
                raise RunError(f"the query of {s.name} must be terminated first")
        if s.what == "CONNECTOR":
            self._halt(x, "DELETED")
        self.catalog.drop(s.what, s.name)
        if s.what in ("STREAM", "VIEW") and getattr(x, "owned", True) and x.path:
            self._delete(x.path)

    def _show(self, s: Statement, sql: str) -> DataFrame:
        c = self.catalog
        if s.what == "STREAMS":
            return self.spark.createDataFrame([(x.name, x.schema.simpleString() if x.schema else "", int(x.options.get("REPLICATE", 1))) for x in c.streams.values() if not x.name.startswith("_")], "name string, schema string, replicas int")
        if s.what == "VIEWS":
            return self.spark.createDataFrame([(x.name, x.query, x.schema.simpleString()) for x in c.views.values()], "name string, query string, schema string")
        if s.what == "QUERIES":
            return self.spark.createDataFrame([(x.name, x.kind, x.status.value, x.sql) for x in c.queries.values()], "name string, kind string, status string, sql string")
        state = lambda x: "ABORTED" if any(h.exception() is not None for h in x.handles) else x.status
        return self.spark.createDataFrame([(x.name, x.side, x.kind, x.stream, state(x)) for x in c.connectors.values()], "name string, side string, kind string, stream string, status string")

    def _create_connector(self, s: Statement, sql: str) -> None:
        if s.flag and self.catalog.has("CONNECTOR", s.name):
            return
        stream = s.options.get("stream", s.name)
        c = self.catalog.add("CONNECTOR", s.name, connector(s.name, s.what, s.target, str(stream), s.options))
        self._attach(c)

    def _attach(self, c: Connector) -> None:
        """Starts a connector: a source that is read in place becomes a frame, others copy from their checkpoint on."""
        c.status = "RUNNING"
        if c.copies:
            try:
                self._copy(c)
            except (AnalysisException, RunError):  # no such stream yet, or the store's package is absent: drain tells
                c.status = "ABORTED"
        elif not self.catalog.has("STREAM", c.stream):
            self.register_frame(c.stream, read(self.spark, c), "timestamp" if c.format == "rate" else None)

    def _halt(self, c: Connector, status: str) -> None:
        for h in c.handles:
            h.stop()
        c.handles, c.status = [], status

    def _copy(self, c: Connector) -> None:
        stream = self.catalog.get("STREAM", c.stream)
        if c.side == "SINK":
            df, put = self._open_stream(c.stream)[0].drop("_ts"), lambda b, i: write(b, c)
        else:
            if not stream.owned or stream.schema is None:
                raise RunError(f"{c.stream} has no declared columns")
            body = T.StructType([f for f in stream.schema if f.name != "_ts"])
            copy = self._to_stream(c.stream)
            df, put = records(read(self.spark, c, body), c, body), lambda b, i: copy(b, i, f"connector_{c.name}")
        writer = df.writeStream.foreachBatch(put).option("checkpointLocation", f"{self.root}/checkpoints/connector_{c.name}")
        c.handles = [writer.trigger(**self.trigger).start()]

    def drain(self, name: str) -> None:
        """Waits until a connector has copied all there is; an error of its store is raised."""
        c = self.catalog.get("CONNECTOR", name)
        if c.status not in ("RUNNING", "ABORTED"):
            raise RunError(f"{name} is {c.status}")
        for h in c.handles:
            h.awaitTermination() if self.trigger.get("availableNow") or self.trigger.get("once") else h.processAllAvailable()
        if not any(h.isActive for h in c.handles):
            self._copy(c)
            c.status = "RUNNING"
            c.handles[0].processAllAvailable() if c.handles[0].isActive else c.handles[0].awaitTermination()

    def alter_connector(self, name: str, **options: str) -> None:
        """New options for a connector, which goes on from where it stopped."""
        c = self.catalog.get("CONNECTOR", name)
        self._halt(c, c.status)
        c.options |= {k: str(v) for k, v in options.items()}
        if c.status != "PAUSED":
            self._attach(c)
        self._save()

    def metrics(self) -> DataFrame:
        """Rows, batches and errors of each query."""
        rows = [(q.name, q.status.value, *q.counts().values()) for q in self.catalog.queries.values()]
        return self.spark.createDataFrame(rows, "query string, status string, input_rows long, batches long, errors long")

    def latencies(self) -> DataFrame:
        """Quantiles of batch durations of each query, in ms."""
        rows = [(q.name, int(p["batchDuration"])) for q in self.catalog.queries.values() for h in q.handles for p in h.recentProgress]
        df = self.spark.createDataFrame(rows, "query string, ms long")
        return df.groupBy("query").agg(*[F.percentile_approx("ms", p).alias(f"p{int(p * 100)}") for p in (0.5, 0.75, 0.95, 0.99)])


def _common(a: T.DataType, b: T.DataType) -> T.DataType:
    """A type that holds values of both: of numbers a floating one, else text."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    return (T.LongType() if isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType) else T.DoubleType()) if isinstance(a, T.NumericType) and isinstance(b, T.NumericType) else T.StringType()


def sources(s: Source) -> list[str]:
    """The streams that a relation reads."""
    if s.kind == "stream":
        return [s.name]
    if s.kind == "query":
        return sources(s.query.source)
    return sources(s.left) + (sources(s.right) if s.right else [])


def is_aggregate(q: Select) -> bool:
    return q.group is not None or any(x.op == "aggregate" for i in q.items for x in i.expr.walk())
