"""Deterministic sharded WARC writer and its reader.

Records are sorted by page_id within shards that are ranges of page_id; a file
rolls over by compressed size; every header and digest is made anew from the
row, so the same rows give the same bytes. Files are written under temporary
names and committed by a manifest. Of records with equal payloads of at least
``MIN_REVISIT`` bytes the one with the least page_id is the response and the
others are revisits that refer to it.

Defined cases: a null html is an empty payload, a null url an empty target; a
null page_id sorts first and never is the one that others refer to unless all
are null; of rows with one page_id and payload the first is the response and the others
revisit it; an empty table makes no file and an empty result; further columns
are left alone; payloads of any length stream through one record at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import scratch, written
from tidewater.llm.files import MANIFEST, commit, committed, manifest_rows, opened, sharded, temporary

MIN_REVISIT = 100
#: Bytes of payload for each shard; compressed bytes at which a file rolls over.
SHARD_BYTES, FILE_BYTES, LEVEL = 32 << 20, 16 << 20, 6
#: Tasks that read files, at most.
READERS = 4096
DATE = "2024-01-01T00:00:00Z"
URN = "urn:tidewater:page:"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as a gzip member of its own."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def info(name: str) -> bytes:
    return member([("WARC-Type", "warcinfo"), ("WARC-Date", DATE), ("WARC-Record-ID", f"<urn:tidewater:file:{name}>"), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{URN}{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~-._")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{URN}{'' if refers_to is None else refers_to}>")]
    return member(headers, block)


def members(stream, size: int = 1 << 20):
    """The decompressed members of a gzip file, one after another."""
    z, out, data = zlib.decompressobj(31), [], b""
    while data := data or stream.read(size):
        out.append(z.decompress(data))
        data = b""
        if z.eof:
            data = z.unused_data
            yield b"".join(out)
            z, out = zlib.decompressobj(31), []
    if any(out):
        raise ValueError("the file ends inside a record")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of a record; an error if its length or block digest is wrong."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    if headers.get("WARC-Block-Digest", d := "sha256:" + hashlib.sha256(block).hexdigest()) != d:
        raise ValueError("a record's digest is wrong")
    return headers, block


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the rows that revisit another page_id."""
    text = F.coalesce(F.col("html"), F.lit(""))
    own = written(pages.select("page_id", F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).alias("n")).where(F.col("n") >= MIN_REVISIT), "payloads")
    first = own.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("c")).where("c > 1 and refers_to is not null").select("digest", "refers_to")
    return written(own.join(written(first, "first"), "digest").where("page_id is null or page_id <> refers_to").select("page_id", "digest", "refers_to"), "revisits")


def write(pages: DataFrame, uri: str) -> DataFrame:
    """Write (page_id, url, html) of ``pages`` as committed WARC files at ``uri``; returns the manifest.

    The marks of revisits travel to the shard of their page, before its record,
    so payloads are moved once.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    digest = F.unhex(F.sha2(html, 256))
    rows = pages.select("page_id", F.lit(1).alias("kind"), digest.alias("digest"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.lit(None).cast("long").alias("refers_to"))
    marks = revisits(pages).distinct().select("page_id", F.lit(0).alias("kind"), "digest", F.lit("").alias("url"), F.lit("").alias("html"), "refers_to")
    rows, _, shard = sharded(rows.unionByName(marks), "page_id", F.octet_length("html") + 64, SHARD_BYTES)
    rows = rows.sortWithinPartitions(shard, "page_id", "kind", "digest", "url").select(F.col(shard).alias("shard"), "page_id", "kind", "digest", "url", "html", "refers_to")

    def put(batches):
        fs, made = opened(uri)[0], []
        now, part, out, tmp, name, size, records, payload_bytes, sha = None, 0, None, "", "", 0, 0, 0, None
        page, known, seen = object(), {}, set()

        def close():
            if out is not None:
                out.close()
                made.append((now, part, tmp, name, records, payload_bytes, size, sha.hexdigest()))

        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                b = batch.slice(i, 64)
                for s, p, kind, d, url, text, ref in zip(*(b[c].to_pylist() for c in ("shard", "page_id", "kind", "digest", "url", "html", "refers_to")), strict=True):
                    if p != page or s != now:
                        page, known, seen = p, {}, set()
                    if out is None or s != now or size >= FILE_BYTES:
                        close()
                        part = part + 1 if s == now else 0
                        now, tmp, name = s, temporary(uri), f"pages-{s:06d}-{part:05d}.warc.gz"
                        out, sha, records, payload_bytes = fs.open_output_stream(opened(tmp)[1], compression=None), hashlib.sha256(), 0, 0
                        out.write(data := info(name))
                        sha.update(data)
                        size = len(data)
                    if kind == 0:
                        known[d] = ref
                        continue
                    payload = text.encode()
                    again = len(payload) >= MIN_REVISIT and (d in known or d in seen)
                    data = record(p, url, payload, d.hex(), known.get(d, p) if again else None, again)
                    seen.add(d)
                    out.write(data)
                    sha.update(data)
                    size, records, payload_bytes = size + len(data), records + 1, payload_bytes + len(payload)
        close()
        yield pa.RecordBatch.from_pandas(manifest_rows(made))

    fs, top = opened(uri)
    fs.create_dir(top, recursive=True)
    return commit(rows.mapInArrow(put, MANIFEST), uri, "warc")


def read(spark: SparkSession, uri: str) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's digest is that of the payload read; a revisit has its digest in
    its header and its length in the HTTP header that it repeats.
    """
    listed = committed(spark, uri).select("name")
    listed = listed.repartition(min(max(1, listed.count()), READERS))

    def get(batches):
        fs, top = opened(uri)
        for batch in batches:
            for name in batch["name"].to_pylist():
                out = []
                with fs.open_input_stream(f"{top}/{name}", compression=None) as f:
                    for raw in members(f):
                        headers, block = parse(raw)
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        n, digest = int(http.rpartition(b": ")[2]), headers["WARC-Payload-Digest"].removeprefix("sha256:")
                        if headers["WARC-Type"] == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"a payload in {name} differs from its digest")
                        ids = [headers[k].strip("<>").removeprefix(URN) if k in headers else "" for k in ("WARC-Record-ID", "WARC-Refers-To")]
                        out.append((int(ids[0]) if ids[0] else None, n, digest, headers["WARC-Type"], int(ids[1]) if ids[1] else None))
                if out:
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in RESULT.split(", ")])

    return listed.mapInArrow(get, RESULT)


def round_trip(pages: DataFrame) -> DataFrame:
    uri = scratch(pages.sparkSession, "warc")
    write(pages, uri)
    return read(pages.sparkSession, uri)
