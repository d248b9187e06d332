"""Deterministic, sharded WARC archives.

Records are dealt out by ranges of their key and written in key order, one gzip
member each, into files that roll once their compressed size passes a limit.
Digests, record ids and headers are made anew from the payload, so equal input
gives equal bytes whoever writes them. A file appears under its final name only
when whole; the manifest, written last, names the files that count.

Of records with equal payloads of at least ``min_revisit_bytes`` the one with
the smallest key is a response and the others are revisits that refer to it.
The first is found by a map-side combined minimum per digest; keys and digests,
not payloads, are joined with it, and payloads move once, to their range.

Nulls and odd rows: a null payload is empty, a null url gives no target URI; rows
without a key are archived in full under an id made of url, payload and their
number among equal rows, refer to nothing and are referred to by nothing; rows
that repeat a key are kept, the first of them (by url) stands for the key; an
empty table gives an empty manifest; further columns, of any name, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardlens.llm import shared

MANIFEST = "part int, seq int, path string, records long, bytes long, sha256 string"
#: Compressed bytes at which a file is full.
ROLL_BYTES = 16 << 20
#: Fixed: regenerated archives carry one date, so their bytes do not depend on when they were made.
EPOCH = "1970-01-01T00:00:00Z"
#: Bytes of a file that go to the decompressor at once.
FEED_BYTES = 1 << 14
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(key: int | str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'record:{key}')}"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def make_record(key: int | None, url: str | None, payload: bytes, refers_to: int | None, nth: int = 0) -> bytes:
    """One record, uncompressed. A revisit keeps the HTTP head (with the payload's length) and drops the payload.

    Without a key, the ``nth`` of equal rows is named by its url and payload.
    """
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    name = key if key is not None else f"{nth}:{url}:{hashlib.sha256(payload).hexdigest()}"
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{record_id(name)}>"), ("WARC-Date", EPOCH)]
    if url is not None:
        head.append(("WARC-Target-URI", "".join(url.split())))
    head += [("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}")]
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<{record_id(refers_to)}>"), ("WARC-Profile", PROFILE), ("X-Refers-To-Key", str(refers_to))]
    if key is not None:
        head.append(("X-Key", str(key)))
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def members(raw: bytes) -> Iterator[bytes]:
    """The decompressed gzip members of a file, one by one."""
    view, at = memoryview(raw), 0
    while at < len(view):
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            part = view[at : at + FEED_BYTES]
            if not len(part):
                raise ValueError("truncated record")
            out.append(z.decompress(part))
            at += len(part)
        at -= len(z.unused_data)
        yield b"".join(out)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record; its block digest is verified."""
    head, rest = raw.split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if f"sha1:{base32_sha1(block)}" != headers["WARC-Block-Digest"]:
        raise ValueError(f"block digest differs in {headers['WARC-Record-ID']}")
    return headers, block


def mark_revisits(pages: DataFrame, *, key: str = "page_id", payload: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """(k, digest, first): the keys whose payload (SHA-256 ``digest``) a smaller key holds too, with the smallest."""
    body = F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "UTF-8")
    rows = pages.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.sha2(body, 256).alias("digest"), F.length(body).alias("n"))
    rows = rows.where(F.col("n") >= min_revisit_bytes).select("k", "digest")
    firsts = rows.groupBy("digest").agg(F.min("k").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    return rows.join(firsts.select("digest", "first"), "digest").where("first < k").select("k", "digest", "first")


def write_warc(pages: DataFrame, out_dir: str, *, key: str = "page_id", url: str = "url", payload: str = "html", min_revisit_bytes: int = 0, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Archive ``pages`` below ``out_dir``; returns the manifest (one row per file, written last)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        part, attempt, seq = task.partitionId(), task.taskAttemptId(), 0
        held: list[bytes] = []
        size = 0
        last: tuple | None = None
        seen: set[str] = set()
        nth = 0

        def roll() -> pa.RecordBatch:
            nonlocal held, size, seq
            data = b"".join(held)
            path = f"{out_dir}/part-{part:06d}-{seq:06d}.warc.gz"
            shared.write_bytes(path, data, str(attempt))
            row = {"part": part, "seq": seq, "path": path, "records": len(held), "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}
            held, size, seq = [], 0, seq + 1
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_pylist([row], pa.schema(list(zip(row, kinds, strict=True))))

        marks: dict[str, int] = {}
        for batch in batches:
            for i in range(len(batch)):
                k, digest, first, u, body = (batch.column(j)[i].as_py() for j in range(5))
                row = (k,) if k is not None else (k, u, body)
                nth = nth + 1 if row == last else 0
                if row != last:
                    marks, seen, last = {}, set(), row
                if digest is not None:
                    marks[digest] = first
                    continue
                data = (body or "").encode("utf-8", "replace")
                same = hashlib.sha256(data).hexdigest()
                first = marks.get(same)
                # A repeated key is a repeated row: all but its first refer to it.
                if first is None and k is not None and same in seen and len(data) >= min_revisit_bytes:
                    first = k
                seen.add(same)
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                held.append(z.compress(make_record(k, u, data, first, nth)) + z.flush())
                size += len(held[-1])
                if size >= roll_bytes:
                    yield roll()
        if held:
            yield roll()

    # Marks travel to their records' range and come before them, so payloads are dealt out once.
    marks = mark_revisits(pages, key=key, payload=payload, min_revisit_bytes=min_revisit_bytes)
    # Rows without a key spread by what they hold.
    spread = F.when(F.col("k").isNull(), F.xxhash64("url", "payload")).otherwise(F.lit(0).cast("long"))
    marks = marks.select("k", "digest", "first", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("payload"))
    records = pages.select(F.col(key).cast("long").alias("k"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("first"), F.col(url).cast("string").alias("url"), F.col(payload).cast("string").alias("payload"))
    ordered = records.unionByName(marks).withColumn("spread", spread).repartitionByRange("k", "spread").sortWithinPartitions("k", "spread", F.col("digest").asc_nulls_last(), "url", "payload")
    ordered = ordered.drop("spread")
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{out_dir}/manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{out_dir}/manifest")


RECORD = "key long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def read_warc(manifest: DataFrame, *, with_payload: bool = False) -> DataFrame:
    """One row per record of the manifest's files; a file that differs from its manifest row is an error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"] + ["payload"] * with_payload
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * with_payload
        for batch in batches:
            for path, sha in zip(batch.column("path").to_pylist(), batch.column("sha256").to_pylist(), strict=True):
                raw = shared.read_bytes(path)
                if hashlib.sha256(raw).hexdigest() != sha:
                    raise ValueError(f"{path} is not the file that the manifest names")
                cols: list[list] = [[] for _ in names]
                for record in members(raw):
                    h, block = parse_record(record)
                    http, body = block.split(b"\r\n\r\n", 1)
                    n = int(http.rsplit(b": ", 1)[1])
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if h["WARC-Type"] == "response" and (len(body) != n or base32_sha1(body) != digest):
                        raise ValueError(f"payload of {h['WARC-Record-ID']} differs from its digest")
                    back = h.get("X-Refers-To-Key")
                    row = [int(h["X-Key"]) if "X-Key" in h else None, h.get("WARC-Target-URI"), h["WARC-Type"], int(back) if back else None, n, digest] + [body] * with_payload
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    files = manifest.count()  # one row per file
    spread = manifest.repartition(max(1, min(files, 4096)), "path")
    return spread.mapInArrow(read, RECORD + ", payload binary" * with_payload)
