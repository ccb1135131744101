"""Kinds of connectors as Spark formats and options."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.errors import BindError

_JDBC = {"mysql": ("jdbc:mysql", "com.mysql.cj.jdbc.Driver", 3306), "postgresql": ("jdbc:postgresql", "org.postgresql.Driver", 5432), "sqlserver": ("jdbc:sqlserver", "com.microsoft.sqlserver.jdbc.SQLServerDriver", 1433)}
SOURCES = (*_JDBC, "mongodb", "generator", "kafka", "file")
SINKS = ("mysql", "postgresql", "mongodb", "blackhole", "elasticsearch", "kafka", "file")


@dataclass
class Connector:
    """A source or sink: a Spark format, its options and whether it streams."""

    name: str
    side: str
    kind: str
    stream: str
    format: str
    options: dict[str, str]
    status: str = "CREATED"
    handles: list[Any] = field(default_factory=list)

    @property
    def streams(self) -> bool:
        return self.format in ("rate", "kafka", "json", "parquet", "csv")

    @property
    def copies(self) -> bool:
        """Does it copy rows from or to its stream? The other sources are read in place."""
        return self.side == "SINK" or self.format not in ("rate", "jdbc")


def connector(name: str, side: str, kind: str, stream: str, options: dict) -> Connector:
    """Checks the kind and translates its options."""
    kind = kind.lower()
    if kind not in (SOURCES if side == "SOURCE" else SINKS):
        raise BindError(f"no {side.lower()} connector {kind}")
    o = {k.lower(): str(v) for k, v in options.items() if k.lower() != "stream"}
    if kind in _JDBC:
        scheme, driver, port = _JDBC[kind]
        sep = ";databaseName=" if kind == "sqlserver" else "/"
        url = f"{scheme}://{o.pop('host', 'localhost')}:{o.pop('port', port)}{sep}{o.pop('database', '')}"
        out = {"url": url, "driver": driver, "dbtable": o.pop("table", stream)}
        out |= {k: o.pop(k) for k in ("user", "password") if k in o}
        # reads are split over executors where a column to split by is given
        out |= {"partitionColumn": o.pop("partition_column"), "lowerBound": o.pop("lower", "0"), "upperBound": o.pop("upper", "1000000"), "numPartitions": o.pop("partitions", "16")} if "partition_column" in o else {}
        return Connector(name, side, kind, stream, "jdbc", out | o)
    if kind == "generator":
        return Connector(name, side, kind, stream, "rate", {"rowsPerSecond": o.get("rate", "10")})
    if kind == "blackhole":
        return Connector(name, side, kind, stream, "noop", {})
    if kind == "kafka":
        topic = o.pop("topic", stream)
        out = {"kafka.bootstrap.servers": o.pop("servers", "localhost:9092"), "subscribe" if side == "SOURCE" else "topic": topic}
        return Connector(name, side, kind, stream, "kafka", out | o)
    if kind == "file":
        return Connector(name, side, kind, stream, o.pop("format", "json"), o)
    return Connector(name, side, kind, stream, {"mongodb": "mongodb", "elasticsearch": "org.elasticsearch.spark.sql"}[kind], o)


def read(spark: SparkSession, c: Connector, schema=None) -> DataFrame:
    reader = spark.readStream if c.streams else spark.read
    if schema is not None and c.format not in ("rate", "kafka", "jdbc"):
        reader = reader.schema(schema)
    return reader.format(c.format).options(**c.options).load()


def records(df: DataFrame, c: Connector, schema) -> DataFrame:
    """The rows of a source: those of Kafka are JSON objects in the message's value."""
    if c.format != "kafka":
        return df
    row = F.from_json(F.col("value").cast("string"), schema)
    return df.select(row.alias("row_"), F.col("timestamp").alias("_ts")).where("row_ is not null").select("row_.*", "_ts")


def write(df: DataFrame, c: Connector) -> None:
    """One batch; a retried batch may be written twice where the store has no keys."""
    if c.format == "kafka":
        df = df.select(F.to_json(F.struct("*")).alias("value"))
    df.write.format(c.format).options(**c.options).mode("append").save()
