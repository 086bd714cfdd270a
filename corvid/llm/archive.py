"""WARC archives with an index: write the index first, then read selected records by coalesced byte ranges.

Each record is a gzip member of its own, so a record is one byte range of one file. The index has a row per record with file,
offset, length, URL and digest; a reader sorts the ranges it wants, joins those that lie close together and reads each once.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import SLICE_BYTES, fresh_dir, release, saved, slices, utf8, workspace

#: Payloads from this size on are written once; bytes of an archive file; bytes between two ranges that are read all the same,
#: and most bytes of one read.
REVISIT_BYTES, FILE_BYTES, GAP_BYTES, READ_BYTES = 1000, 256 << 20, 64 << 10, 8 << 20
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_id(page_id: int | None, digest: str, kind: str) -> str:
    """Made of what the record is, so a revisit can name its response's record without meeting it."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id} {digest} {kind}')}>"


def _url(url: str | None, page_id: int | None) -> str:
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in url) if url else f"urn:page:{page_id}"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A WARC/1.1 record: a response with its payload, or a revisit that names the response it repeats."""
    target, revisit = _url(url, page_id), refers_to is not None
    kind = "revisit" if revisit else "response"
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(page_id, digest, kind)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("X-Page-Id", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(len(payload))),
    ]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, digest, "response")), ("X-Refers-To-Page-Id", str(refers_to))]
    else:
        block += payload
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's header fields and its payload (what follows the HTTP header in its block)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _gzip(data: bytes) -> bytes:
    out = zlib.compressobj(6, zlib.DEFLATED, 31)
    return out.compress(data) + out.flush()


INDEX = "page_id bigint, url string, digest string, record_type string, refers_to bigint, file string, offset bigint, length bigint"


def refers(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, digest, n, refers_to) of the payloads that a larger page_id has too; only digests and sizes move."""
    body = F.coalesce("html", F.lit(""))
    with workspace():
        light = saved(pages.select("page_id", F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).alias("n")).filter(F.col("n") >= least), "digests")
        last = saved(light.groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").drop("copies"), "repeated")
        return saved(light.join(last, ["digest", "n"]).filter("page_id < refers_to").select("page_id", "digest", "n", "refers_to").distinct(), "refers", keep=True)


def write(pages: DataFrame, least: int = REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write every page as a record and return the index, itself a written table.

    Null html counts as empty. A retried task writes files of another name, and the index names only those of the attempt that
    counted. Rows that repeat a page_id are records of their own, each a revisit only of what it equals; a row without page_id is
    always a response. Payloads of any size are one record. Columns other than page_id, url and html are ignored, whatever their
    names. An empty table gives an empty index.
    """
    folder = fresh_dir(pages.sparkSession, "warc")
    pages = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    known = refers(pages, least)
    body = F.coalesce("html", F.lit(""))
    rows = pages.withColumns({"digest": F.sha1(body.cast("binary")), "n": F.octet_length(body)}).join(known, ["page_id", "digest", "n"], "left")

    def run(batches):
        store, path = _open(folder)
        task = TaskContext.get()
        number, out, at, name = 0, None, 0, ""
        try:
            for batch in batches:
                for part in slices(batch, "html"):
                    index = []
                    for page, url, payload, ref in zip(part.column("page_id").to_pylist(), part.column("url").to_pylist(), utf8(part.column("html")), part.column("refers_to").to_pylist(), strict=True):
                        if out is None or at >= file_bytes:
                            if out is not None:
                                out.close()
                            store.create_dir(path, recursive=True)
                            name = f"part-{task.partitionId():05}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}-{number:04}.warc.gz"
                            out, at, number = store.open_output_stream(f"{path}/{name}", compression=None), 0, number + 1
                        data = _gzip(record(page, url, payload, ref))
                        out.write(data)
                        index.append((page, url, hashlib.sha1(payload).hexdigest(), "response" if ref is None else "revisit", ref, f"{folder}/{name}", at, len(data)))
                        at += len(data)
                    yield _batch(index, INDEX)
        finally:
            if out is not None:
                out.close()

    index = saved(rows.mapInArrow(run, INDEX), "warc-index")
    release(known)
    return index


def _open(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pa.fs.LocalFileSystem(), uri)


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [f.split() for f in ddl.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def coalesce(ranges: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> list[tuple[int, int, list[int]]]:
    """Sorted (offset, length) ranges, joined where ``gap`` bytes at most lie between them, up to ``most`` bytes a read: (offset, length, which)."""
    out: list[tuple[int, int, list[int]]] = []
    for i, (offset, length) in enumerate(ranges):
        if out and offset - (out[-1][0] + out[-1][1]) <= gap and offset + length - out[-1][0] <= most:
            start, n, which = out[-1]
            which.append(i)
            out[-1] = (start, max(n, offset + length - start), which)
        else:
            out.append((offset, length, [i]))
    return out


RECORDS = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


def read(selected: DataFrame, payload: bool = True, gap: int = GAP_BYTES, most: int = READ_BYTES) -> DataFrame:
    """The records that index rows name. Each payload is checked against its digest; a revisit has none (null).

    Rows are range-sorted by file and offset, so neighbouring records are read by one task in one read of at most ``most`` bytes
    (or one record, where that is longer); what a batch of payloads holds is bounded in bytes.
    """

    def fetch(store, file: str, rows: list[tuple]):
        with store.open_input_file(_open(file)[1]) as source:
            for start, n, which in coalesce([(o, m) for o, m, _ in rows], gap, most):
                data = source.read_at(n, start)
                for i in which:
                    offset, length, digest = rows[i]
                    fields, body = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                    kind = fields["WARC-Type"]
                    got = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    size = int(fields["X-Payload-Length"])
                    if kind == "response":
                        size, got = len(body), hashlib.sha1(body).hexdigest()
                    if got != digest:
                        raise ValueError(f"{file} at {offset}: the payload's digest is not the index's")
                    page, url, ref = fields["X-Page-Id"], fields["WARC-Target-URI"], fields.get("X-Refers-To-Page-Id")
                    yield (int(page) if page else None, url, kind, int(ref) if ref else None, size, got, body if payload and kind == "response" else None)

    def run(batches):
        for batch in batches:
            rows = pd.DataFrame({c: batch.column(c).to_pylist() for c in ("file", "offset", "length", "digest")})
            for file, group in rows.groupby("file", sort=False):
                held, n = [], 0
                for row in fetch(_open(file)[0], file, list(zip(group["offset"].tolist(), group["length"].tolist(), group["digest"].tolist(), strict=True))):
                    held.append(row)
                    n += len(row[-1] or b"")
                    if n >= SLICE_BYTES or len(held) == 1000:
                        yield _batch(held, RECORDS)
                        held, n = [], 0
                if held:
                    yield _batch(held, RECORDS)

    wanted = selected.select("file", "offset", "length", "digest")
    return wanted.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset").mapInArrow(run, RECORDS)
