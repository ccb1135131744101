"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. New rows are
digested, pre-aggregated to one row a digest, anti-joined with the index
(bucket by bucket, without moving the index) and appended to it.

Defined cases: a null text counts as empty; a null doc_id sorts after every
other one; of rows that repeat both text and least doc_id exactly one stays; an
empty table gives an empty result; further columns are left alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import SPACE_RUN, place, scratch, unused, written


def normalised(text: Column) -> Column:
    """``text`` with each run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sha binary, doc_id, seq): seq tells rows of one doc_id apart."""
    return docs.select(F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("sha"), F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("seq"))


#: A new index has at least MIN_BUCKETS buckets, and so many that each gets about BUCKET_ROWS rows of its first batch.
MIN_BUCKETS, BUCKET_ROWS = 64, 1_000_000


def buckets_for(rows: DataFrame) -> int:
    return max(MIN_BUCKETS, -(-rows.count() // BUCKET_ROWS))


class DigestIndex:
    """Digests seen so far, at ``path`` (a folder in shared storage), in buckets by digest.

    The index says in how many: opened again, in a later session, it has those of its
    files, and another number is an error. ``close`` takes the table out of the session's catalog; the files stay.
    """

    COLUMNS = "sha BINARY, doc_id BIGINT, seq BIGINT, batch STRING"

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        known = self._known()
        if known and buckets and known != buckets:
            raise ValueError(f"the index at {path} has {known} buckets, not {buckets}")
        self.buckets = known or buckets or MIN_BUCKETS
        if not known:
            spark.createDataFrame([(self.buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/_layout")
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.table} ({self.COLUMNS}) USING parquet CLUSTERED BY (sha) SORTED BY (sha) INTO {self.buckets} BUCKETS LOCATION '{path}'")

    def _known(self) -> int | None:
        """The number of buckets that an index at ``path`` was made with; None where there is none."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_layout/_SUCCESS")
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return None
        return self.spark.read.parquet(f"{self.path}/_layout").first()[0]

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, digested: DataFrame, batch: str) -> DataFrame:
        """Append the digests that the index lacks; returns the rows that this added.

        Safe to repeat: a batch that is already in the index adds nothing.
        """
        first = digested.groupBy("sha").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "seq")).alias("m"))
        fresh = first.select("sha", F.col("m.doc_id").alias("doc_id"), F.col("m.seq").alias("seq"), F.lit(batch).alias("batch"))
        # written, as Catalyst would push the join below the aggregate: to all copies
        fresh = written(fresh, "firsts").join(self.read().select("sha").hint("merge"), "sha", "left_anti")
        # each bucket is written by one task, to one file: the bucket of a row is this hash
        fresh = fresh.repartitionById(self.buckets, F.pmod(F.hash("sha"), F.lit(self.buckets)))
        fresh.select("sha", "doc_id", "seq", "batch").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)
        return self.read().where(F.col("batch") == batch)


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str = "0") -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256, seq.

    ``kept`` is false too for a text that an earlier batch put into ``index``.
    """
    spark = docs.sparkSession
    rows = written(digests(docs), "digested")
    own = index or DigestIndex(spark, scratch(spark, "digests"), buckets_for(rows))
    own.add(rows, batch)
    sizes = rows.groupBy("sha").agg(F.count("*").alias("group_size"))
    known = written(own.read().select("sha", F.col("doc_id").alias("keep_id"), F.col("seq").alias("keep_seq"), "batch").join(sizes, "sha"), "keepers")
    if index is None:
        own.close()
    return rows.join(known, "sha").select(
        "doc_id", "keep_id", "group_size",
        ((F.col("batch") == batch) & (F.col("seq") == F.col("keep_seq"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), "seq",
    )


def stage(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that exact deduplication keeps, with its columns.

    ``docs`` is read twice and must come from files.
    """
    seq, sha = unused(docs, "seq"), unused(docs, "sha")
    best = docs.select(F.unhex(F.sha2(normalised(F.col("text")), 256)).alias(sha), F.col("doc_id"), place(docs).alias(seq))
    drop = _dropped(best, sha, seq)
    return docs.withColumn(seq, place(docs)).join(drop, seq, "left_anti").select(docs.columns)


def _dropped(rows: DataFrame, sha: str, seq: str) -> DataFrame:
    spark = rows.sparkSession
    rows = written(rows.select(F.col(sha).alias("sha"), "doc_id", F.col(seq).alias("seq")), "digested")
    index = DigestIndex(spark, scratch(spark, "digests"), buckets_for(rows))
    index.add(rows, "0")
    keep = index.read().select("seq")
    drop = written(rows.select("seq").join(keep, "seq", "left_anti").select(F.col("seq").alias(seq)), "dropped")
    index.close()
    return drop
