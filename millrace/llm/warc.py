"""WARC archives: a writer with one gzip member per record, and a sequential reader that inflates step by step.

Files are written and read through pyarrow's file systems, so that any shared store with a URI serves. A task writes under a name
of its own and renames when complete; a task that is run again replaces its file by the same records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RECORD = "file string, offset long, record_id string, record_type string, refers_to string, target_uri string, payload_bytes long, payload_digest string, payload binary, block_ok boolean, payload_ok boolean, error string"
CHUNK = 1 << 16


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(record_id: str, kind: str, uri: str | None, payload: bytes, refers_to: str | None = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One gzip member. A revisit holds the HTTP header only; its payload's digest and length stand in the record's header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    clean = "".join(c for c in uri or "" if c >= " ")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}", f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + gz.flush()


def members(stream, chunk: int = CHUNK) -> Iterator[tuple[int, bytes, str | None]]:
    """(offset, content, error) of each gzip member, holding one member and one chunk at a time. A broken member ends the file."""
    at, buf = 0, b""
    while True:
        z, out, start, used, problem = zlib.decompressobj(31), [], at, 0, None
        if not buf:
            buf = stream.read(chunk)
            if not buf:
                return
        while True:
            try:
                out.append(z.decompress(buf))
            except zlib.error as e:
                problem = f"gzip: {e}"
                break
            used += len(buf) - len(z.unused_data)
            buf = z.unused_data
            if z.eof:
                break
            buf = stream.read(chunk)
            if not buf:
                problem = "gzip: member is cut off"
                break
        at = start + used
        yield start, b"".join(out), problem
        if problem:
            return


def parse(content: bytes) -> dict:
    """A record's fields, framed by Content-Length; block_ok and payload_ok say whether the stated digests hold."""
    head, sep, rest = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        return {"error": "no WARC header"}
    h = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    try:
        n = int(h["content-length"])
    except (KeyError, ValueError):
        return {"error": "no Content-Length"}
    block = rest[:n]
    error = None if len(block) == n and rest[n : n + 4] == b"\r\n\r\n" else "framing: Content-Length does not end at the record's end"
    kind = h.get("warc-type")
    said = h.get("warc-payload-digest", "").removeprefix("sha1:")
    out = {"record_id": h.get("warc-record-id", "").strip("<>"), "record_type": kind, "target_uri": h.get("warc-target-uri"), "refers_to": h["warc-refers-to"].strip("<>") if "warc-refers-to" in h else None}
    out |= {"block_ok": h.get("warc-block-digest", "").removeprefix("sha1:") == digest(block), "error": error}
    if kind == "revisit":
        return out | {"payload": None, "payload_bytes": int(h.get("x-payload-length", -1)), "payload_digest": said, "payload_ok": None}
    payload = block.partition(b"\r\n\r\n")[2] if h.get("content-type", "").startswith("application/http") else block
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest(payload), "payload_ok": said == digest(payload)}


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r.get("payload") or b"") + 200
        if size >= most:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def write(records: DataFrame, folder: str) -> DataFrame:
    """Writes records (record_id, record_type, refers_to, target_uri, payload binary) to folder; one row (file, records, bytes) per archive.

    Each partition makes one archive; a null payload is empty, a null target address is left blank. The result is stored.
    """

    def task(batches):
        from pyspark import TaskContext

        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        own, n, size = f"{root}/.{name}.{uuid.uuid4().hex}", 0, 0
        with fs.open_output_stream(own, compression=None) as out:
            for b in batches:
                cols = [b.column(x) for x in ("record_id", "record_type", "target_uri", "payload", "refers_to")]
                for i in range(b.num_rows):
                    rid, kind, uri, payload, ref = (c[i].as_py() for c in cols)
                    data = record(rid, kind, uri, payload or b"", ref)
                    out.write(data)
                    n, size = n + 1, size + len(data)
        if n:
            fs.move(own, f"{root}/{name}")
            yield pa.RecordBatch.from_pylist([{"file": f"{folder}/{name}", "records": n, "bytes": size}])
        else:
            fs.delete_file(own)

    made = records.select("record_id", "record_type", "refers_to", "target_uri", "payload").mapInArrow(task, "file string, records long, bytes long")
    return common.stored(made, "warc-manifest")


def read(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Reads the archives named in column file, one after another in a task, record by record; columns as in RECORD."""
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("block_ok", pa.bool_()), ("payload_ok", pa.bool_()), ("error", pa.string())])

    def records(batches):
        for b in batches:
            for file in b.column("file").to_pylist():
                fs, path = _open(file)
                with fs.open_input_stream(path, compression=None) as stream:
                    for offset, content, problem in members(stream):
                        yield {"file": file, "offset": offset, **(parse(content) if problem is None else {"error": problem})}

    n = max(1, min(files.count(), 100_000))
    return files.select("file").repartition(n).mapInArrow(lambda it: _batches(records(it), schema), RECORD)


def archive_pages(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes a record per page (page_id, url, html) to archives in folder and returns the manifest.

    The payload is html in UTF-8; null html is empty. Of pages with equal payloads of at least least_bytes bytes the one with the
    smallest page_id is a response and the others revisit it; a null page_id counts as the largest; rows that repeat the smallest page_id
    are responses too. Equality is that of SHA-1 and length. Payloads that occur once, which is most, never leave their partition if the
    table of repeated ones is small enough to broadcast.
    """
    p = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumns({"sha": F.sha1("payload"), "n": F.octet_length("payload")})
    first = p.where(F.col("n") >= least_bytes).groupBy("sha", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("sha", "n", "first")
    first = common.checked_broadcast(common.stored(first, "warc-copies"), 80)
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("null")))
    j = p.join(first, ["sha", "n"], "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return write(j.select(urn(F.col("page_id")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, urn(F.col("first"))).alias("refers_to"), F.col("url").alias("target_uri"), "payload"), folder)
