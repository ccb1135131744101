"""Virtual metric tables and the admin prompt over them."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.errors import ParseError

#: Minutes over which throughput is averaged.
APPEND_MINUTES, READ_MINUTES = (1, 5, 10), (15, 30, 60)
_PROGRESS = "query string, sink string, source string, at timestamp, input_rows long, ms long, failed int"


def progress(engine) -> DataFrame:
    """A row for each batch of each query that Spark still remembers."""
    rows = []
    for q in engine.catalog.queries.values():
        for h in q.handles:
            failed = int(h.exception() is not None)
            for p in h.recentProgress:
                at = datetime.datetime.fromisoformat(p["timestamp"].replace("Z", "+00:00"))
                rows += [(q.name, q.sink, s, at, int(p["numInputRows"]), int(p["batchDuration"]), failed) for s in q.sources]
    return engine.spark.createDataFrame(rows, _PROGRESS)


def _rates(df: DataFrame, by: str, minutes: tuple[int, ...]) -> DataFrame:
    recent = lambda m: F.col("at") >= F.current_timestamp() - F.expr(f"INTERVAL {m} MINUTES")
    return df.groupBy(F.col(by).alias("name")).agg(*[(F.coalesce(F.sum(F.when(recent(m), F.col("input_rows"))), F.lit(0)) / (60 * m)).alias(f"throughput_{m}min") for m in minutes])


def tables(engine) -> dict[str, DataFrame]:
    """The metric tables by name."""
    p = progress(engine)
    streams = [(s.name, int(s.options.get("REPLICATE", 1))) for s in engine.catalog.streams.values() if not s.name.startswith("_")]
    quantiles = [F.percentile_approx("ms", x / 100).alias(f"p{x}") for x in (50, 75, 90, 95, 99)]
    return {
        "streams": engine.spark.createDataFrame(streams, "name string, replication_property int"),
        "append_throughput": _rates(p, "sink", APPEND_MINUTES),
        "read_throughput": _rates(p, "source", READ_MINUTES),
        "append_totals": p.groupBy(F.col("sink").alias("name")).agg(F.sum("input_rows").alias("total"), F.max("failed").alias("failed")),
        "append_latency": p.groupBy(F.col("sink").alias("name")).agg(*quantiles),
        "query_latency": p.groupBy(F.col("query").alias("name")).agg(*quantiles),
        "subscription_throughput": _rates(engine.spark.createDataFrame(list(engine.acked), "subscription string, at timestamp, input_rows long"), "subscription", READ_MINUTES),
    }


def admin(engine, text: str) -> DataFrame:
    """``show tables``, ``describe t`` or any SELECT over the metric tables."""
    known, text = tables(engine), text.strip().rstrip(";")
    if re.fullmatch(r"(?i)show\s+tables", text):
        return engine.spark.createDataFrame([(n,) for n in known], "name string")
    if m := re.fullmatch(r"(?i)describe\s+(\w+)", text):
        if m[1] not in known:
            raise ParseError(f"no table {m[1]}")
        return engine.spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in known[m[1]].schema], "name string, type string")
    if not re.match(r"(?i)select\b", text):
        raise ParseError("expected show tables, describe or select")
    return engine.spark.sql(re.sub(r"(?i)\b(from|join)\s+(\w+)\b", lambda x: f"{x[1]} {{{x[2]}}}" + ("" if re.match(r"(?i)\s+(?:as\b|(?!left|right|full|inner|cross|join|on|where|group|order|limit|having)\w)", text[x.end() :]) else f" AS {x[2]}") if x[2] in known else x[0], text), **known)
