"""Files in shared storage: attempts under temporary names, commit by manifest, deterministic range shards."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import unused, written

#: Keys looked at to place shard bounds: those of the least hashes, about so many.
SAMPLED = 100_000

MANIFEST = "shard long, part long, tmp string, name string, records long, units long, bytes long, sha256 string"


def opened(uri: str):
    """(filesystem, path) for a URI or an absolute path, for any store that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def temporary(uri: str) -> str:
    """A temporary name for this attempt; attempts never share one."""
    return f"{uri}/.attempt-{uuid.uuid4().hex}"


def sharded(df: DataFrame, key: str, weight: Column, target: int, least: int = 1) -> tuple[DataFrame, int, str]:
    """``df`` dealt to shards, each a range of ``key`` (an integer; null first) of about ``target`` units.

    Returns the frame with the shard's column (shard i is in partition i), the
    number of shards and the column's name. The bounds come from the keys with
    the least hashes, so they depend on the rows alone, not on their order.
    """
    n, total = df.agg(F.count(key), F.sum(weight)).first()
    shards = max(least, -(-int(total or 0) // target))
    rate = max(1, -(-int(n or 0) // SAMPLED))
    picked = df.where(F.pmod(F.xxhash64(F.lit("shard"), key), F.lit(rate)) == 0) if rate > 1 else df
    rows = picked.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(weight).alias("w")).orderBy(key).collect()
    cuts, seen, all_ = [], 0.0, float(sum(r[1] for r in rows)) or 1.0
    for r in rows:
        if seen >= all_ * (len(cuts) + 1) / shards and len(cuts) < shards - 1:
            cuts.append(r[0])
        seen += r[1]
    shard = unused(df, "shard_")
    if not cuts:
        return df.withColumn(shard, F.lit(0)).repartitionById(1, shard), 1, shard
    bounds = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << b) for b in range(len(cuts).bit_length() - 1, -1, -1)])
    at = F.aggregate(steps, F.lit(0), lambda a, s: F.when((a + s <= len(cuts)) & (F.get(bounds, a + s - 1) <= F.col(key)), a + s).otherwise(a))
    return df.withColumn(shard, at).repartitionById(len(cuts) + 1, shard), len(cuts) + 1, shard


def commit(attempts: DataFrame, uri: str, kind: str) -> DataFrame:
    """Give the attempts their final names, then write the manifest.

    ``attempts`` (columns MANIFEST) lists what the tasks that succeeded wrote.
    Renaming may be repeated: a file that is already in place stays. A reader
    that goes by the manifest never sees a part of the output.
    """
    attempts = written(attempts, "attempts")

    def move(batches):
        fs, top = opened(uri)
        for pdf in batches:
            for tmp, name in zip(pdf["tmp"], pdf["name"], strict=True):
                from pyarrow.fs import FileType

                t = opened(tmp)[1]
                if fs.get_file_info(t).type != FileType.NotFound:
                    fs.move(t, f"{top}/{name}")
                elif fs.get_file_info(f"{top}/{name}").type == FileType.NotFound:
                    raise FileNotFoundError(f"{top}/{name}")
            yield pdf

    done = written(attempts.mapInPandas(move, attempts.schema), "manifest", f"{uri}/_manifest")
    files, records, size = done.agg(F.count("*"), F.sum("records"), F.sum("bytes")).first()
    fs, top = opened(uri)
    with fs.open_output_stream(f"{top}/_COMMITTED.tmp") as f:
        f.write(json.dumps({"kind": kind, "files": files, "records": records or 0, "bytes": size or 0}).encode())
    fs.move(f"{top}/_COMMITTED.tmp", f"{top}/_COMMITTED")
    return done


def committed(spark, uri: str) -> DataFrame:
    """The manifest of a committed output; an error if there is none."""
    from pyarrow.fs import FileType

    fs, top = opened(uri)
    if fs.get_file_info(f"{top}/_COMMITTED").type == FileType.NotFound:
        raise FileNotFoundError(f"{uri} has no committed output")
    return spark.read.schema(MANIFEST).parquet(f"{uri}/_manifest")


def manifest_rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in MANIFEST.split(", ")])
