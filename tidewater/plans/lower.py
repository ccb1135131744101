"""Names, types and lowering: a SELECT to a DataFrame, batch or stream alike.

Every column of every relation gets a name of its own, so no join or derived table
can clash; the outer projection gives the names of the statement back. Catalyst
sees plain projections, filters, joins and aggregates.
"""

from __future__ import annotations

import datetime
import itertools
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidewater.errors import BindError, PlanError
from tidewater.functions import scalar
from tidewater.functions.aggregates import aggregate
from tidewater.functions.sliding import BUCKET_US, sliding_step
from tidewater.operators.joins import band, micros, over_interval
from tidewater.plans.parser import Expr, Select, Source
from tidewater.plans.validate import select as validate

TYPES = {
    "INTEGER": T.LongType(), "FLOAT": T.DoubleType(), "BOOLEAN": T.BooleanType(), "BYTEA": T.BinaryType(), "STRING": T.StringType(),
    "DATE": T.DateType(), "TIME": T.LongType(), "TIMESTAMP": T.TimestampType(), "INTERVAL": T.DayTimeIntervalType(), "JSONB": T.VariantType(), "NUMERIC": T.DecimalType(38, 18),
}

_ids = itertools.count()


def spark_type(name: str) -> T.DataType:
    """The Spark type of a declared one."""
    return T.ArrayType(spark_type(name[:-2])) if name.endswith("[]") else TYPES[name]


def declared(name: str, kind: str) -> T.StructField:
    return T.StructField(name, spark_type(kind), metadata=scalar.TIME_COLUMN if kind == "TIME" else None)


def type_of(f: T.StructField) -> T.DataType:
    return scalar.TimeOfDay() if f.metadata.get("kind") == "TIME" else f.dataType


@dataclass
class Field:
    owner: str | None
    name: str
    own: str
    hidden: bool = False


@dataclass
class Relation:
    df: DataFrame
    fields: list[Field]
    ts: str | None = None
    window: tuple[str, tuple[int, ...]] | None = None
    tree: list[str] = field(default_factory=list)

    def find(self, owner: str | None, name: str) -> Field:
        hits = [f for f in self.fields if f.name == name and (owner is None or f.owner == owner)]
        hits = hits or [f for f in self.fields if f.name.lower() == name.lower() and (owner is None or (f.owner or "").lower() == owner.lower())]
        if not hits:
            raise BindError(f"no column {owner + '.' if owner else ''}{name}")
        if len(hits) > 1:
            raise BindError(f"{name} is ambiguous: " + ", ".join(f"{f.owner}.{f.name}" for f in hits))
        return hits[0]


def relation(df: DataFrame, owner: str | None, ts: str | None) -> Relation:
    fields = [Field(owner, c, f"c{next(_ids)}", c.startswith("_")) for c in df.columns]
    df = df.select(*[F.col(f"`{f.name}`").alias(f.own) for f in fields])
    at = next((f.own for f in fields if f.name == ts), None)
    return Relation(df, fields, at)


class Lowering:
    """Lowers statements against ``open_``: stream name to (DataFrame, event-time column)."""

    def __init__(self, open_: Callable[[str], tuple[DataFrame, str | None]], compat: bool = False, streaming: bool = False):
        self.open, self.compat, self.streaming = open_, compat, streaming

    # relations

    def source(self, s: Source) -> Relation:
        if s.kind == "stream":
            df, ts = self.open(s.name)
            out = relation(df, s.alias or s.name, ts)
            out.tree = [f"StreamScan({s.name})" + (f" AS {s.alias}" if s.alias else "")]
            return out
        if s.kind == "query":
            df, ts, tree = self._select(s.query)
            out = relation(df, s.alias, ts)
            out.tree = ["Derived" + (f" AS {s.alias}" if s.alias else ""), *["  " + x for x in tree]]
            return out
        if s.kind == "window":
            out = self.source(s.left)
            if out.window:
                raise PlanError("a window of a window")
            if out.ts is None:
                raise BindError("a window needs an event time")
            out.window = (s.window, s.sizes)
            if s.alias:
                out.fields = [Field(s.alias, f.name, f.own, f.hidden) for f in out.fields]
            out.tree = [f"Window({s.window} {', '.join(str(x) + ' ms' for x in s.sizes)})", *["  " + x for x in out.tree]]
            return out
        return self.join(s)

    def join(self, s: Source) -> Relation:
        a, b = self.source(s.left), self.source(s.right)
        if (a.window or b.window) and self.streaming:
            raise PlanError("a stream's window can't be joined")
        owners = {f.owner for f in a.fields} & {f.owner for f in b.fields} - {None}
        if owners:
            raise BindError(f"{owners.pop()} stands on both sides; give one an alias")
        joined = Relation(a.df, a.fields + b.fields, window=a.window or b.window)
        on = None
        shared = None
        if s.natural:
            shared = [f.name for f in a.fields if not f.hidden and f.name != "_ts" and any(g.name == f.name and not g.hidden for g in b.fields)]
        elif s.using:
            shared = s.using
        for n in shared or []:
            x, y = F.col(a.find(None, n).own), F.col(b.find(None, n).own)
            e = x.eqNullSafe(y) if self.compat else x == y
            on = e if on is None else on & e
        if s.on:
            joined.df = a.df.crossJoin(b.df)  # both sides in one frame so that types are known; it never runs
            on = self.expr(s.on, joined)[0]
        how = "inner" if s.how == "cross" else s.how
        if s.within_ms is not None:
            if a.ts is None or b.ts is None:
                raise BindError("WITHIN needs an event time on both sides")
            us = s.within_ms * 1000
            df = band(a.df, b.df, a.ts, b.ts, on, how, us, us, self.streaming)
        elif on is None:
            df = a.df.crossJoin(b.df)
        else:
            df = a.df.join(b.df, on, how)
        ts = a.ts or b.ts
        if a.ts and b.ts and not self.streaming:
            ts = f"c{next(_ids)}"
            df = df.withColumn(ts, F.greatest(a.ts, b.ts))
        joined.df, joined.ts = df, ts
        text = "NATURAL" if s.natural else f"USING({', '.join(s.using)})" if s.using else f"ON {s.on.text}" if s.on else ""
        joined.tree = [" ".join(x for x in (f"Join({s.how})", text, f"WITHIN {s.within_ms} ms" if s.within_ms is not None else "") if x), *["  " + x for x in a.tree + b.tree]]
        return joined

    # expressions

    def expr(self, e: Expr, r: Relation, swap: dict[str, str] | None = None, types: bool = True) -> tuple[Column, T.DataType]:
        """(column, type) of ``e``; ``swap`` maps aggregates, by their printed form, to columns."""
        kind = lambda c: type_of(r.df.select(c.alias("x")).schema[0]) if types else T.NullType()
        go = lambda x: self.expr(x, r, swap, types)
        if swap and e.op == "aggregate":
            c = F.col(swap[printed(e)])
            return c, kind(c)
        if e.op == "column":
            c = F.col(r.find(*e.value).own)
            return c, kind(c)
        if e.op == "literal":
            c = F.lit(e.value)
            if isinstance(e.value, int) and not isinstance(e.value, bool):
                c = c.cast("bigint")
            if isinstance(e.value, str):
                c.literal_text = e.value
            return c, {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}.get(type(e.value), T.NullType())
        if e.op == "interval":
            return F.make_dt_interval(secs=F.lit(e.value / 1000).cast("decimal(18,6)")), T.DayTimeIntervalType()
        if e.op == "date":
            return F.lit(datetime.date.fromisoformat(e.value)), T.DateType()
        if e.op == "timestamp":
            t = datetime.datetime.fromisoformat(e.value)
            return F.lit(t if t.tzinfo else t.replace(tzinfo=datetime.UTC)), T.TimestampType()
        if e.op == "time":
            t = datetime.time.fromisoformat(e.value)
            return F.lit(((t.hour * 60 + t.minute) * 60 + t.second) * 1_000_000 + t.microsecond).cast("bigint"), scalar.TimeOfDay()
        if e.op == "array":
            c = F.array(*[go(a)[0] for a in e.args])
            return c, kind(c)
        if e.op == "not":
            return ~go(e.args[0])[0], T.BooleanType()
        if e.op == "between":
            x, lo, hi = (go(a)[0] for a in e.args)
            return scalar.between(x, lo, hi, e.value["symmetric"]), T.BooleanType()
        if e.op == "cast":
            x, t = go(e.args[0])
            to = scalar.TimeOfDay() if e.value == "TIME" else spark_type(e.value)
            return scalar.cast(x, t, to, self.compat), to
        if e.op in ("index", "slice"):
            x, _ = go(e.args[0])
            if e.op == "index":
                c = F.get(x, F.lit(e.value))
            else:
                first, last = e.value
                first = max(first or 0, 0)
                c = F.slice(x, first + 1, F.greatest((F.lit(last) if last is not None else F.size(x) - 1) - first + 1, F.lit(0)))
            return c, kind(c)
        if e.op == "binary":
            return self._binary(e, go, kind)
        if e.op == "call":
            return self._call(e, go, kind)
        raise BindError(f"{e.text or e.op} can't stand here")

    def _binary(self, e: Expr, go, kind) -> tuple[Column, T.DataType]:
        op = e.value
        if op in ("->", "->>", "#>", "#>>"):
            return self._json(e, go)
        (a, _), (b, _) = go(e.args[0]), go(e.args[1])
        if op in ("AND", "OR"):
            return scalar.both(op, a, b, self.compat), T.BooleanType()
        if op in ("=", "<>"):
            c = scalar.equal(a, b, self.compat)
            return (c if op == "=" else ~c), T.BooleanType()
        if op in ("<", ">", "<=", ">="):
            return scalar.ordered(op, a, b, self.compat), T.BooleanType()
        c = {"+": a + b, "-": a - b, "*": a * b}[op]
        return c, kind(c)

    def _json(self, e: Expr, go) -> tuple[Column, T.DataType]:
        x, t = go(e.args[0])
        if e.value.startswith("#"):
            if e.args[1].op != "array" or any(a.op != "literal" for a in e.args[1].args):
                raise BindError(f"the path of {e.value} must be constant")
            keys = [a.value for a in e.args[1].args]
        else:
            if e.args[1].op != "literal":
                raise BindError(f"the field of {e.value} must be constant")
            keys = [e.args[1].value]
        as_text = e.value.endswith(">>")
        path = "$" + "".join(f"[{k}]" if isinstance(k, int) else f"['{k}']" for k in keys)
        if isinstance(t, T.StringType) and as_text:
            return F.get_json_object(x, path), T.StringType()
        if isinstance(t, T.StringType):
            x = F.try_parse_json(x)
        elif not isinstance(t, T.VariantType):
            x = F.to_variant_object(x)
        return F.try_variant_get(x, path, "string" if as_text else "variant"), T.StringType() if as_text else T.VariantType()

    def _call(self, e: Expr, go, kind) -> tuple[Column, T.DataType]:
        args = [go(a) for a in e.args]
        if e.value in scalar.TESTS:
            return scalar.type_test(e.value, *args[0]), T.BooleanType()
        if e.value == "TO_STR":
            x = scalar.cast(*args[0], T.StringType(), self.compat)
            return F.coalesce(x, F.lit("NULL")) if self.compat else x, T.StringType()
        if e.value in scalar.MATH and isinstance(args[0][1], (T.StringType, T.BooleanType, T.ArrayType)):
            raise BindError(f"{e.value} takes a number")
        if e.value in scalar.ARRAY and not isinstance(args[0][1], (T.ArrayType, T.NullType)):
            raise BindError(f"{e.value} takes an array")
        c = scalar.FUNCTIONS[e.value][1](*[a for a, _ in args])
        if e.value == "ARRAY_MIN" and self.compat:  # null is the least value
            c = F.get(F.sort_array(args[0][0]), F.lit(0))
        return c, kind(c)

    # SELECT

    def select(self, q: Select) -> DataFrame:
        return self.timed(q)[0].drop("_ts")

    def timed(self, q: Select) -> tuple[DataFrame, str | None]:
        """The result with its event time, which is in the hidden column _ts unless the statement selects it."""
        validate(q)
        return self._select(q)[:2]

    def explain(self, q: Select) -> str:
        validate(q)
        return "\n".join(self._select(q)[2])

    def _select(self, q: Select) -> tuple[DataFrame, str | None, list[str]]:
        """(result, its event-time column, logical tree)"""
        r = self.source(q.source)
        indent = lambda head: [head, *["  " + x for x in r.tree]]
        if q.where:
            r.df = r.df.where(self.expr(q.where, r)[0])
            r.tree = indent(f"Filter({q.where.text})")
        found: dict[str, Expr] = {}
        for e in [*(i.expr for i in q.items), *([q.having] if q.having else [])]:
            for x in e.walk():
                if x.op == "aggregate":
                    found.setdefault(printed(x), x)
        if q.group is None and not found:
            return self._project(q, r, None, indent)
        return self._aggregate(q, r, found, indent)

    def _project(self, q: Select, r: Relation, swap, indent, extra: list[Column] = ()) -> tuple[DataFrame, str | None, list[str]]:
        cols, names, at = [], [], None
        for i in q.items:
            if i.expr.op == "star":
                picked = [f for f in r.fields if (i.expr.value is None and not f.hidden or i.expr.value == f.owner and not f.hidden)]
                if not picked:
                    raise BindError(f"no stream {i.expr.value}")
                for f in picked:
                    clash = sum(g.name == f.name for g in picked) > 1
                    cols.append(F.col(f.own))
                    names.append(f"{f.owner}.{f.name}" if clash and f.owner else f.name)
                    at = names[-1] if f.own == r.ts else at
            else:
                c, kind = self.expr(i.expr, r, swap)
                cols.append(c.alias("t", metadata=scalar.TIME_COLUMN) if isinstance(kind, scalar.TimeOfDay) else c)
                names.append(i.name)
                if i.expr.op == "column" and r.find(*i.expr.value).own == r.ts:
                    at = i.name
        clash = {n for n in names if names.count(n) > 1}
        for k, i in enumerate(q.items if len(q.items) == len(names) else []):
            if names[k] in clash and i.expr.op == "column" and i.alias is None:
                names[k] = f"{r.find(*i.expr.value).owner}.{names[k]}"
        if len(set(names)) < len(names):
            raise BindError("two columns of the result have one name")
        out = r.df.select(*[c.alias(n) for c, n in zip(cols, names, strict=True)], *extra)
        if at is None and r.ts and swap is None and not extra:
            # the event time goes along, hidden, so that what is derived can be windowed
            out, at = r.df.select(*[c.alias(n) for c, n in zip(cols, names, strict=True)], F.col(r.ts).alias("_ts")), "_ts"
        return out, at, indent(f"Project({', '.join(names)})")

    def _aggregate(self, q: Select, r: Relation, found: dict[str, Expr], indent) -> tuple[DataFrame, str | None, list[str]]:
        keys = [r.find(*g.value) for g in q.group or []]
        own = [F.col(f.own) for f in keys]
        swap = {p: f"a{next(_ids)}" for p in found}
        args = lambda x: [x.args[0], x.args[1].value] if x.value.startswith("TOPK") else x.args
        calls = {p: partial(aggregate, x.value, [self.expr(a, r)[0] if isinstance(a, Expr) else a for a in args(x)], self.compat) for p, x in found.items()}
        build = {p: c() for p, c in calls.items()}
        kind, sizes = r.window or ("", ())
        head = f"Reduce(keys: {', '.join(f.name for f in keys)}; aggregates: {', '.join(found)}" + (f"; {kind} {sizes})" if kind else ")")
        tree = indent(head)
        if kind == "SLIDING":
            if self.streaming:
                df = self._sliding(r, [f.own for f in keys], found, build, swap, sizes[0])
            else:
                df = over_interval(r.df, own, r.ts, sizes[0] * 1000, {swap[p]: c for p, c in calls.items()})
            df = df.withColumns({"window_start": F.col(r.ts) - F.make_dt_interval(secs=F.lit(sizes[0] / 1000).cast("decimal(18,6)")), "window_end": F.col(r.ts)})
        else:
            if kind == "TUMBLE":
                own = [F.window(r.ts, f"{sizes[0]} milliseconds").alias("window_"), *own]
            elif kind == "HOP":
                own = [F.window(r.ts, f"{sizes[0]} milliseconds", f"{sizes[1]} milliseconds").alias("window_"), *own]
            elif kind == "SESSION":
                own = [F.session_window(r.ts, f"{sizes[0]} milliseconds").alias("window_"), *own]
            df = self._grouped(r, own, keys, found, build, swap, kind)
            if kind:
                end = F.col("window_.end")
                if kind == "SESSION":
                    end = end - F.make_dt_interval(secs=F.lit(sizes[0] / 1000).cast("decimal(18,6)"))
                if kind == "HOP":
                    df = df.where(micros(F.col("window_.start")) >= 0)
                df = df.withColumns({"window_start": F.col("window_.start"), "window_end": end})
        fields = keys + ([Field(None, "window_start", "window_start"), Field(None, "window_end", "window_end")] if kind else [])
        out = Relation(df, fields, None, tree=tree)
        if q.having:
            out.df = out.df.where(self.expr(q.having, out, swap)[0])
            out.tree = [f"Filter({q.having.text})", *["  " + x for x in out.tree]]
        named = {i.name for i in q.items}
        extra = [F.col(c) for c in ("window_start", "window_end") if kind and c not in named]
        df, _, tree = self._project(q, out, swap, lambda h: [h, *["  " + x for x in out.tree]], extra)
        return df, ("window_end" if kind and "window_end" in df.columns else None), tree

    def _sliding(self, r: Relation, own: list[str], found, build, swap, size_ms: int) -> DataFrame:
        """SLIDING over a stream: each row once, with the aggregates over what has arrived of its interval. The rows of an interval and the lateness are state."""
        if self.compat:
            raise PlanError("SLIDING over a stream has standard aggregates only")
        names = [f"k{i}" for i in range(len(own))] or ["k0"]
        keyed = r.df.select(*[c.alias(n) for c, n in zip([F.col(o) for o in own] or [F.lit(0)], names, strict=True)], micros(F.col(r.ts)).alias("t"), F.col(r.ts).alias("at"), *[(self.expr(x.args[0], r)[0] if x.args else F.lit(1)).alias(f"x{i}") for i, x in enumerate(found.values())])
        calls = [(x.value, x.args[1].value if x.value.startswith("TOPK") else 0, keyed.schema[f"x{i}"].dataType) for i, x in enumerate(found.values())]
        values = [F.col(f"x{i}").cast("string").alias(f"x{i}") for i in range(len(calls))]
        results = r.df.groupBy().agg(*[build[p].alias(swap[p]) for p in found]).schema
        kinds = [*[f"`{n}` {keyed.schema[n].dataType.simpleString()}" for n in names], "t long", *[f"`{f.name}` {f.dataType.simpleString()}" for f in results]]
        width = size_ms * 1000
        bucket = max(width, BUCKET_US)
        step = sliding_step(calls, width, bucket, [*names, "t", *results.names])
        # each row is in its bucket and, if a row there can see it, in the next one
        start, after = F.col("t") - F.pmod("t", F.lit(bucket)), F.col("t") + width
        place = lambda b, is_own: F.struct(b.alias("b"), F.lit(is_own).alias("own"))
        both = F.array(place(start, True), place(start + bucket, False))
        dealt = keyed.where("t is not null").withColumn("place", F.explode(F.when(after >= start + bucket, both).otherwise(F.slice(both, 1, 1))))
        # The column of the watermark goes along, so that states can end by it. Late rows have their results too, over what is kept: no row counts as late here.
        at = F.greatest("at", F.lit("2262-01-01").cast("timestamp")).alias("at", metadata={"spark.watermarkDelayMs": 0})
        out = dealt.select(*names, F.col("place.b").alias("b"), "t", "place.own", at, *values).groupBy(*names, "b").applyInPandasWithState(step, ", ".join(kinds), "rows binary", "update", "EventTimeTimeout")
        return out.select(*[F.col(n).alias(o) for n, o in zip(names, own, strict=False)], F.timestamp_micros("t").alias(r.ts), *results.names)

    def _grouped(self, r: Relation, own: list[Column], keys: list[Field], found, build, swap, kind: str) -> DataFrame:
        """Grouped aggregates. In batch a TOPK ranks first: Catalyst keeps k rows a group on each side of the shuffle, so no group is gathered."""
        tops = [] if self.streaming or kind == "SESSION" else [p for p, x in found.items() if x.value.startswith("TOPK")]
        rest = [build[p].alias(swap[p]) for p in found if p not in tops]
        out = r.df.groupBy(*own).agg(*rest, F.count(F.lit(1)).alias("n_")) if rest or not tops else None
        names = [*(["window_"] if kind else []), *[f.own for f in keys]]
        for p in tops:
            x, k = self.expr(found[p].args[0], r)[0], found[p].args[1].value
            v = f"v{next(_ids)}"
            df = r.df.select(*own, x.alias(v))
            if found[p].value == "TOPKDISTINCT":
                df = df.distinct()
            w = Window.partitionBy(*[F.col(n) for n in names]).orderBy(F.col(v).desc_nulls_last())
            ranked = df.withColumn("rank_", F.row_number().over(w)).where(F.col("rank_") <= max(k, 1))
            value = F.slice(F.sort_array(F.collect_list(v), asc=False), 1, k)
            part = ranked.groupBy(*names).agg(value.alias(swap[p]))
            if out is None:
                out = part
                continue
            other = {n: f"o{next(_ids)}" for n in names}
            part = part.select(*[F.col(n).alias(o) for n, o in other.items()], swap[p])
            on = [F.col(n).eqNullSafe(F.col(o)) for n, o in other.items()]
            out = (out.join(part, on) if on else out.crossJoin(part)).drop(*other.values())
        return out


def printed(e: Expr) -> str:
    """A form in which equal expressions are equal."""
    if e.op == "column":
        return ".".join(x for x in e.value if x)
    inner = ", ".join(printed(a) for a in e.args)
    return f"{e.value}({inner or '*'})" if e.op in ("aggregate", "call") else f"{e.op}:{e.value}({inner})"
