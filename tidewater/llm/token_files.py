"""Token ids in directly addressable code files.

Ids are split into chunks of 8 bits. Level 0 has the lowest chunk of every id
and a bitmap that says which ids go on in the next level, which has only those.
A directory of ranks (set bits before every 512th bit) finds an id's place in
the next level, so any token, or any run of tokens, is read without decoding
what stands before it. A file also lists its documents and their first tokens.

Files hold ranges of doc_id in ascending order, are written under temporary
names and committed by a manifest.

Defined cases: a null text is empty (the end id alone); a null doc_id sorts
first; rows with one doc_id follow one another, ordered by text; an empty table
makes no file and an empty result; further columns are left alone; a document
longer than a file's bound has a file to itself.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.common import scratch
from tidewater.llm.files import MANIFEST, commit, committed, manifest_rows, opened, sharded, temporary
from tidewater.llm.tokenize import encoder

MAGIC, BLOCK = b"TWDAC001", 512
#: Bytes of text for each shard, and ids for each file.
SHARD_BYTES, FILE_IDS = 48 << 20, 8 << 20
#: Tasks that read files, at most; shards whose sums are added up together.
READERS, TOGETHER = 4096, 1024
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def encode(ids: np.ndarray) -> bytes:
    """The code of an array of unsigned 32-bit ids."""
    rest, parts, n_levels = np.ascontiguousarray(ids, np.uint32), [], 0
    while True:
        low, more = (rest & 255).astype(np.uint8), rest > 255
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint64) if len(more) else np.zeros(0, np.uint64)
        ranks = np.concatenate([[0], np.cumsum(ones)]).astype("<u8")
        parts += [struct.pack("<Q", len(low)), low.tobytes(), bits.tobytes(), ranks.tobytes()]
        n_levels += 1
        if not more.any():
            return struct.pack("<QQ", len(ids), n_levels) + b"".join(parts)
        rest = rest[more] >> 8


class Code:
    """Random access to the ids of a code; nothing is decoded that isn't asked for."""

    def __init__(self, data: bytes | memoryview, at: int = 0):
        self.n, n_levels = struct.unpack_from("<QQ", data, at)
        at += 16
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", data, at)
            n_bits, n_ranks = -(-n // 8), -(-n // BLOCK) + 1
            low = np.frombuffer(data, np.uint8, n, at + 8)
            bits = np.frombuffer(data, np.uint8, n_bits, at + 8 + n)
            ranks = np.frombuffer(data, "<u8", n_ranks, at + 8 + n + n_bits)
            self.levels.append((low, bits, ranks))
            at += 8 + n + n_bits + 8 * n_ranks
        self.end = at

    def _rank(self, level: int, i: int) -> int:
        _, bits, ranks = self.levels[level]
        b = i // BLOCK
        return int(ranks[b]) + int(np.unpackbits(bits[b * BLOCK // 8 : -(-i // 8)], bitorder="little")[: i - b * BLOCK].sum())

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop."""
        out = np.zeros(stop - start, np.uint32)
        places = np.arange(stop - start)
        for level, (low, bits, _) in enumerate(self.levels):
            if start == stop:
                break
            out[places] |= low[start:stop].astype(np.uint32) << np.uint32(8 * level)
            first = start // 8
            on = np.unpackbits(bits[first : -(-stop // 8)], bitorder="little")[start - 8 * first : stop - 8 * first].astype(bool)
            if not on.any():
                break
            places = places[on]
            start = self._rank(level, start)
            stop = start + int(on.sum())
        return out

    def __getitem__(self, i: int) -> int:
        return int(self.read(i, i + 1)[0])


def pack(doc_ids: list[int | None], blobs: list[bytes]) -> bytes:
    """A file: magic, the number of documents, their ids with null flags, their first tokens, the code."""
    starts = np.concatenate([[0], np.cumsum([len(b) // 4 for b in blobs])]).astype("<u8")
    ids = np.array([x or 0 for x in doc_ids], "<i8")
    null = np.array([x is None for x in doc_ids], np.uint8)
    return MAGIC + struct.pack("<Q", len(doc_ids)) + ids.tobytes() + null.tobytes() + starts.tobytes() + encode(np.frombuffer(b"".join(blobs), "<u4"))


def unpack(data: bytes) -> tuple[list[int | None], np.ndarray, Code]:
    """(doc_ids, starts, code) of a file."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    (n,) = struct.unpack_from("<Q", data, 8)
    ids = np.frombuffer(data, "<i8", n, 16)
    null = np.frombuffer(data, np.uint8, n, 16 + 8 * n)
    starts = np.frombuffer(data, "<u8", n + 1, 16 + 9 * n)
    return [None if z else int(x) for x, z in zip(ids, null, strict=True)], starts.astype(np.int64), Code(data, 16 + 9 * n + 8 * (n + 1))


def write(docs: DataFrame, uri: str, tokenizer: str, end_id: int, kind: str = "byte") -> DataFrame:
    """Encode (doc_id, text) of ``docs`` into committed files at ``uri``; returns the manifest."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows, _, shard = sharded(docs.select("doc_id", text.alias("text")), "doc_id", F.octet_length("text"), SHARD_BYTES)
    rows = rows.sortWithinPartitions(shard, "doc_id", "text").select(F.col(shard).alias("shard"), "doc_id", "text")
    end = np.array([end_id], "<u4").tobytes()

    def put(batches):
        encode_all, fs, made = encoder(tokenizer, kind), opened(uri)[0], []
        ids, blobs, size, now, part = [], [], 0, None, 0

        def roll():
            data, tmp = pack(ids, blobs), temporary(uri)
            with fs.open_output_stream(opened(tmp)[1]) as f:
                f.write(data)
            made.append((now, part, tmp, f"tokens-{now:06d}-{part:05d}.dac", len(ids), size, len(data), hashlib.sha256(data).hexdigest()))

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                b = batch.slice(i, 256)
                for s, d, blob in zip(b["shard"].to_pylist(), b["doc_id"].to_pylist(), encode_all(b["text"].to_pylist()), strict=True):
                    n = len(blob) // 4 + 1
                    if ids and (s != now or size + n > FILE_IDS):
                        roll()
                        part = part + 1 if s == now else 0
                        ids, blobs, size = [], [], 0
                    now = s
                    ids.append(d)
                    blobs.append(blob + end)
                    size += n
        if ids:
            roll()
        yield pa.RecordBatch.from_pandas(manifest_rows(made))

    fs, top = opened(uri)
    fs.create_dir(top, recursive=True)
    return commit(rows.mapInArrow(put, MANIFEST), uri, "tokens")


def _placed(files: DataFrame) -> DataFrame:
    """``files`` (shard, part, units, ...) with ``before``: the ids of all files that stand before each.

    Sums of sums: by file within a shard, by shard within a run of TOGETHER, by run.
    """
    before = lambda units, *by: F.coalesce(F.sum(units).over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = files.groupBy("shard").agg(F.sum("units").alias("u1")).withColumn("run", F.floor(F.col("shard") / TOGETHER))
    runs = shards.groupBy("run").agg(F.sum("u1").alias("u2")).select("run", before("u2", "run").alias("b2"))
    shards = shards.withColumn("b1", before("u1", "run", "shard")).join(runs, "run").select("shard", "b1", "b2")
    files = files.withColumn("b0", before("units", "shard", "part")).join(shards, "shard")
    return files.withColumn("before", F.col("b0") + F.col("b1") + F.col("b2")).drop("b0", "b1", "b2")


def read(spark: SparkSession, uri: str) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, read from the files that the manifest lists."""
    listed = _placed(committed(spark, uri).select("shard", "part", "name", "units")).select("name", "before")
    listed = listed.repartition(min(max(1, listed.count()), READERS))

    def get(batches):
        fs, top = opened(uri)
        for batch in batches:
            for name, first in zip(batch["name"].to_pylist(), batch["before"].to_pylist(), strict=True):
                with fs.open_input_stream(f"{top}/{name}") as f:
                    ids, starts, code = unpack(f.read())
                raw = memoryview(code.read(0, code.n).astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), starts[1:].tolist(), strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts[:-1] + first), pa.array(np.diff(starts)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return listed.mapInArrow(get, RESULT)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, kind: str = "byte") -> DataFrame:
    uri = scratch(docs.sparkSession, "tokens")
    write(docs, uri, tokenizer, end_id, kind)
    return read(docs.sparkSession, uri)
