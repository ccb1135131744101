"""Multisets as changelogs: rows with a count ``_diff``; and iteration to a fixpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIFF, TIME = "_diff", "_time"


def changes(df: DataFrame, diff: int = 1) -> DataFrame:
    return df.withColumn(DIFF, F.lit(diff).cast("long"))


def consolidate(log: DataFrame) -> DataFrame:
    """One row for each different row with its total count, those of zero left out."""
    cols = [c for c in log.columns if c != DIFF]
    return log.groupBy(*cols).agg(F.sum(DIFF).alias(DIFF)).where(F.col(DIFF) != 0)


def rows(log: DataFrame) -> DataFrame:
    """The multiset itself: each row as often as its count says."""
    out = consolidate(log).where(F.col(DIFF) > 0)
    return out.withColumn(DIFF, F.explode(F.array_repeat(F.lit(1), F.col(DIFF).cast("int")))).drop(DIFF)


def distinct(log: DataFrame) -> DataFrame:
    """Each row with a positive count once."""
    return consolidate(log).where(F.col(DIFF) > 0).withColumn(DIFF, F.lit(1).cast("long"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def negate(log: DataFrame) -> DataFrame:
    return log.withColumn(DIFF, -F.col(DIFF))


def join(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Bilinear join: the count of a pair is the product of the counts."""
    other = "_diff_right"
    out = a.join(b.withColumnRenamed(DIFF, other), on)
    return consolidate(out.withColumn(DIFF, F.col(DIFF) * F.col(other)).drop(other))


def reduce(log: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """Aggregates of a changelog's rows: the new rows, as a changelog."""
    return changes(rows(log).groupBy(*keys).agg(*[v.alias(k) for k, v in aggregates.items()]))


def difference(new: DataFrame, old: DataFrame) -> DataFrame:
    """What turns ``old`` into ``new``: the retractions and additions of an update."""
    return consolidate(new.unionByName(negate(old)))


def expiring(df: DataFrame, ts: str, until: Column) -> DataFrame:
    """A changelog in time: each row comes at ``ts`` and is taken back at ``until``."""
    at = F.explode(F.array(F.struct(F.col(ts).alias("t"), F.lit(1).cast("long").alias("d")), F.struct(until.alias("t"), F.lit(-1).cast("long").alias("d"))))
    return df.withColumn(DIFF, at).withColumns({TIME: F.col(f"{DIFF}.t"), DIFF: F.col(f"{DIFF}.d")})


def for_interval(df: DataFrame, ts: str, interval: Column) -> DataFrame:
    """Each row counts from its time on, for ``interval``."""
    return expiring(df, ts, F.col(ts) + interval)


def for_window(df: DataFrame, ts: str, size: str, step: str | None = None) -> DataFrame:
    """Each row counts in each of its windows (column window_start) from its time to the window's end."""
    windowed = df.withColumn("window_", F.window(ts, size, step))
    windowed = windowed.withColumns({"window_start": F.col("window_.start"), "until_": F.col("window_.end")}).drop("window_")
    return expiring(windowed, ts, F.col("until_")).drop("until_")


def advance(log: DataFrame, frontier: Column) -> DataFrame:
    """The state when the frontier has come to a time: what changes up to it add up to."""
    return consolidate(log.where(F.col(TIME) <= frontier).drop(TIME))


def between(log: DataFrame, after: Column, frontier: Column) -> DataFrame:
    """The changes of the state while the frontier moves from one time to another."""
    return consolidate(log.where((F.col(TIME) > after) & (F.col(TIME) <= frontier)).drop(TIME))


def iterate(seed: DataFrame, step: Callable[[DataFrame], DataFrame], cut: Callable[[DataFrame], DataFrame] | None = None, rounds: int = 10_000) -> DataFrame:
    """The least set that holds ``seed`` and is closed under ``step``, semi-naively: only new rows are stepped.

    ``cut`` cuts the lineage of each round (by default a reliable checkpoint in
    the session's checkpoint folder).
    """
    cut = cut or _checkpointed
    known = cut(seed.distinct())
    fresh = known
    for _ in range(rounds):
        fresh = cut(step(fresh).distinct().join(known, known.columns, "left_anti").select(known.columns))
        if fresh.isEmpty():
            return known
        known = cut(known.unionByName(fresh))
    raise RuntimeError(f"no fixpoint in {rounds} rounds")


def _checkpointed(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        import tempfile

        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tidewater-"))
    return df.checkpoint()


def reachability(edges: DataFrame) -> DataFrame:
    """(src, dst) pairs joined by a path; edges has src, dst."""
    return iterate(edges.select("src", "dst"), lambda f: f.withColumnRenamed("dst", "mid").join(edges.select(F.col("src").alias("mid"), F.col("dst")), "mid").select("src", "dst"))
