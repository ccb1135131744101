"""Shared folder, written intermediates, key hashing and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one the session names in ``spark.checkpoint.dir``; only where
    that is unset (tests on one machine) is a temporary folder made and set.
    """
    now = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not now:
        now = tempfile.mkdtemp(prefix="tidewater-")
        spark.sparkContext.setCheckpointDir(now)
        now = spark.sparkContext.getCheckpointDir()
    return now.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tidewater/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: what is read back survives the loss of any executor.
    """
    spark = df.sparkSession
    path = path or scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def place(df: DataFrame) -> Column:
    """A number for each row of ``df``, a table: the same at each of its scans.

    It follows from the splits of the files. How they are cut depends on the cores
    registered at the time of the scan, which change as executors come and go,
    unless the session says for how many: from the first use on it does. A frame
    whose rows may be dealt anew at each scan is refused.
    """
    spark = df.sparkSession
    if other := set(_nodes(df._jdf.queryExecution().optimizedPlan())) - {"Project", "Filter", "LogicalRelation"}:
        raise ValueError(f"the rows of this frame ({', '.join(sorted(other))}) have no places that last: write it to a table")
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):
        spark.conf.set("spark.sql.files.minPartitionNum", str(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    return F.monotonically_increasing_id()


def _nodes(plan) -> list[str]:
    return [plan.nodeName(), *(n for i in range(plan.children().size()) for n in _nodes(plan.children().apply(i)))]


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files whose frames are gone."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text (null: empty), as two longs."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("k1"), F.xxhash64(F.lit("second"), t).alias("k2")]


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores appended until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of ``edges`` (a, b: any orderable type).

    Rounds of large-star and small-star, each written to the shared folder,
    until only stars are left. Returns (node, root), root being the
    least node of the component; the root itself included; nodes without an edge to another
    one are absent. A star's centre is never gathered in one task: every round is a
    minimum per node (combined map-side) and a join that may be split.
    """
    e = written(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    while True:
        # large star: each node's larger neighbours go to the least of the neighbourhood
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"), name)
        # small star: smaller neighbours and the node itself go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        j = large.join(least, "u")
        e = written(j.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(j.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), name)
        # done when every node but a root has one edge, and that to a root
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("n")).unionAll(e.select(F.col("v").alias("node"), F.lit(None).cast("int").alias("n")))
        ends = ends.groupBy("node").agg(F.count("n").alias("n"), F.count("*").alias("c"))
        if ends.where("n > 1 or n = 1 and c > 1").isEmpty():
            roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
