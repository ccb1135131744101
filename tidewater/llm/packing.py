"""Cost-balanced packing of token sequences.

A document is cut into whole sequences and a remainder. Remainders are packed
in descending order: each goes to the sequence of the lowest estimated cost
(linear plus quadratic in the piece's length) among those with enough room left;
where none has, a new sequence is opened. Pieces are dealt by hash to groups of
bounded size, packed independently.

Defined cases: a null text is empty (the end id alone); rows that repeat, or
share a doc_id, are documents of their own; ties in length are broken by place
in the table; an empty table gives an empty result; further columns are left alone.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import written
from tidewater.llm.tokenize import encoder

ROOM = 2048
LINEAR, QUADRATIC = 1.0, 1.0 / ROOM
#: Pieces packed together.
GROUP = 30_000
PIECES = "row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
RESULT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, kind: str = "word", room: int = ROOM) -> DataFrame:
    """One row a piece: row (of ``docs``), doc_id, start, length, ids_crc32, doc_tokens."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        encode_all = encoder(tokenizer, kind)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                b, out = batch.slice(i, 256), []
                for r, d, blob in zip(b["row"].to_pylist(), b["doc_id"].to_pylist(), encode_all(b["text"].to_pylist()), strict=True):
                    blob += end
                    n = len(blob) // 4
                    out += [(r, d, s, min(room, n - s), zlib.crc32(blob[4 * s : 4 * (s + room)]), n) for s in range(0, n, room)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return own.mapInArrow(cut, PIECES)


def pack(lengths: np.ndarray, room: int = ROOM) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) for pieces of the given lengths, which are packed in descending order."""
    lengths = np.asarray(lengths, np.int64)
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    n_full = int((lengths == room).sum())
    sequence[order[:n_full]] = np.arange(n_full)
    # heaps[r]: (cost, sequence) of those with r left; tree: the least of each range of r
    half = 1 << room.bit_length()
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(half)]
    none = (float("inf"), -1, 0)
    tree = [none] * (2 * half)

    def update(r: int) -> None:
        i = half + r
        tree[i] = (*heaps[r][0], r) if heaps[r] else none
        while i > 1:
            i >>= 1
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a <= b else b

    count = -(-int(lengths[order[n_full:]].sum()) // room)
    heaps[room] = [(0.0, n_full + k) for k in range(count)]
    update(room)
    count += n_full
    for i in order[n_full:]:
        n = int(lengths[i])
        lo, hi, best = half + n, 2 * half, none
        while lo < hi:
            if lo & 1:
                best = min(best, tree[lo])
                lo += 1
            if hi & 1:
                hi -= 1
                best = min(best, tree[hi])
            lo >>= 1
            hi >>= 1
        cost, k, r = best
        if k < 0:
            cost, k, r, count = 0.0, count, room, count + 1
        else:
            heapq.heappop(heaps[r])
            update(r)
        sequence[i], offset[i] = k, room - r
        heapq.heappush(heaps[r - n], (cost + LINEAR * n + QUADRATIC * n * n, k))
        update(r - n)
    return sequence, offset


def packing(docs: DataFrame, tokenizer: str, end_id: int = 1, kind: str = "word", room: int = ROOM) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cut = written(pieces(docs, tokenizer, end_id, kind, room), "pieces")
    groups = max(1, -(-cut.count() // GROUP))
    dealt = cut.withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("group_", F.pmod(F.xxhash64(F.lit("pack"), "row", "start"), F.lit(groups)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "start"], ignore_index=True)
        sequence, offset = pack(pdf["length"].to_numpy(), room)
        pdf["sequence_id"], pdf["offset"] = (pdf["group_"].iloc[0] << 32) + sequence, offset
        return pdf[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    # the id travels as text: pandas would make a column with nulls a float
    return dealt.groupBy("group_").applyInPandas(one, RESULT.replace("doc_id long", "doc_id string")).withColumn("doc_id", F.col("doc_id").cast("long"))
