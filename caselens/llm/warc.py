"""WARC archives with segmented records and chunked transfer framing.

Writing: each page is a record whose block is an HTTP message with a chunked
body. A block longer than ``segment_bytes`` is cut: the first part keeps its
type, the others are ``continuation`` records that name the first one's id and
their number, and the last one states the total length. Pages with equal payloads
are one ``response``, that of the least page_id, and ``revisit`` records of it.
Every record is a gzip member of its own. A task writes files under names of its
own and returns them; a file counts only once it is in the manifest, which Spark
commits, so what a lost or repeated task left behind is never read.

Reading: whole records are decoded where they are parsed. Only segments are
shuffled, by the id of their origin; each group is one payload. They are put in
order of their number, their total length is verified and the chunks decoded.

Edge cases: a null payload is empty, and equal payloads include empty ones; a
null ``page_id`` is never the referred record unless all of its group are null,
and then each is a response; rows with the same page_id and payload are all of
its type; a null url is written empty; a record with a segment missing or a wrong
total length is returned with ``complete`` false; an empty table makes an archive
without files; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import scratch_path, staged

DATE = "2026-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
FILE_BYTES, SEGMENT_BYTES, CHUNK_BYTES = 32 << 20, 16 << 10, 4 << 10
RECORD = "page_id long, record_type string, origin string, number int, total long, block binary, payload_bytes long, payload_digest string, refers_to long, complete boolean"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing of ``payload``."""
    parts = [b"%x\r\n%s\r\n" % (len(c), c) for c in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if not n:
            return b"".join(out)
        chunk = body[end + 2 : end + 2 + n]
        if len(chunk) < n or body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("broken chunk")
        out.append(chunk)
        at = end + 4 + n


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _one(headers: dict[str, object], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    return gzip.compress(f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n", 3, mtime=0)


def records(name: str, page_id: int | None, url: str, payload: bytes, refers_to: int | None, first_url: str, segment_bytes: int) -> Iterator[bytes]:
    """The gzip members of one page; ``name`` is unique to it. A revisit names the
    response by target and date, and its page by a field of our own."""
    safe = lambda u: "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in u)
    own = {
        "WARC-Type": "revisit" if refers_to is not None else "response", "WARC-Record-ID": f"<{name}>", "WARC-Date": DATE, "WARC-Target-URI": safe(url),
        "WARC-Page-ID": page_id, "WARC-Payload-Digest": "sha1:" + digest32(payload), "Content-Type": "application/http; msgtype=response",
    }
    if refers_to is not None:
        first = {"WARC-Refers-To-Target-URI": safe(first_url), "WARC-Refers-To-Date": DATE, "WARC-Refers-To-Page-ID": refers_to}
        yield _one(own | first | {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}, HTTP)
        return
    block = HTTP + chunked(payload)
    if len(block) <= segment_bytes:
        yield _one(own, block)
        return
    starts = range(0, len(block), segment_bytes)
    for k, at in enumerate(starts, 1):
        more = {"WARC-Segment-Number": k} | ({"WARC-Segment-Total-Length": len(block)} if k == len(starts) else {})
        if k > 1:
            more = {"WARC-Type": "continuation", "WARC-Record-ID": f"<{name}:{k}>", "WARC-Date": own["WARC-Date"], "WARC-Segment-Origin-ID": f"<{name}>"} | more
        yield _one(own | more if k == 1 else more, block[at : at + segment_bytes])


def write_archives(pages: DataFrame, path: str | None = None, segment_bytes: int = SEGMENT_BYTES, file_bytes: int = FILE_BYTES) -> str:
    """Write the archives and their manifest under one folder of a file system
    that the executors share; return its path."""
    path = path or scratch_path(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    groups = rows.groupBy("digest").agg(F.min("page_id").alias("least"), F.min_by("url", "page_id").alias("first_url"), F.count("*").alias("n"))
    groups = groups.where("n > 1").select(F.col("digest").alias("__digest"), "least", "first_url")
    typed = rows.join(groups, F.col("digest") == F.col("__digest"), "left").withColumn("refers_to", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("least")), F.col("least")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(f"{base}/files", recursive=True)
        out, name, held, n = None, "", 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"file": [name], "bytes": [held], "records": [n]})

        for batch in batches:
            for page_id, url, html, refers_to, first_url in zip(*(batch.column(i) for i in range(5))):
                if out is None:
                    name, held, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/files/{name}", compression=None)
                for member in records(f"urn:uuid:{uuid.uuid4()}", page_id.as_py(), url.as_py() or "", html.as_py().encode(), refers_to.as_py(), first_url.as_py() or "", segment_bytes):
                    out.write(member)
                    held, n = held + len(member), n + 1
                if held >= file_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    typed.select("page_id", "url", "html", "refers_to", "first_url").mapInArrow(run, "file string, bytes long, records long").write.parquet(f"{path}/manifest")
    return path


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of a stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            k, _, v = line.decode().partition(":")
            headers[k.strip().lower()] = v.strip()
        n = int(headers["content-length"])
        block = stream.read(n)
        if len(block) < n:
            raise ValueError("record cut short")
        yield headers, block


def _row(headers: dict[str, str], block: bytes) -> dict[str, object]:
    number = lambda k: int(headers[k]) if headers.get(k, "") != "" else None
    row: dict[str, object] = {
        "page_id": number("warc-page-id"), "record_type": headers["warc-type"], "number": number("warc-segment-number"), "total": number("warc-segment-total-length"),
        "payload_digest": headers.get("warc-payload-digest", "").removeprefix("sha1:"),
    }
    if row["number"] is not None:
        return row | {"origin": headers.get("warc-segment-origin-id", headers["warc-record-id"]), "block": block}
    if row["record_type"] == "revisit":
        return row | {"refers_to": int(headers["warc-refers-to-page-id"]), "complete": True}
    return row | _decoded(block, str(row["payload_digest"]))


def _decoded(block: bytes, digest: str) -> dict[str, object]:
    try:
        payload = payload_of(block)
    except ValueError:
        return {"complete": False}
    own = digest32(payload)
    return {"payload_bytes": len(payload), "payload_digest": own, "complete": own == digest}


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the manifest's files; segments keep their block."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{base}/files/{name}", compression=None, buffer_size=1 << 20) as raw:
                    held: list[dict[str, object]] = []
                    for headers, block in parse(gzip.GzipFile(fileobj=raw)):
                        held.append(_row(headers, block))
                        if len(held) == 256:
                            yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in held], k) for c, k in zip(names, kinds)], names=names)
                            held = []
                    yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in held], k) for c, k in zip(names, kinds)], names=names)

    files = spark.read.schema("file string, bytes long, records long").parquet(f"{path}/manifest").select("file")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(n, "file").mapInArrow(run, RECORD)


def reassemble(parts: DataFrame) -> DataFrame:
    """page_id, record_type, payload_bytes, payload_digest, complete of each origin's segments."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("number", kind="stable")
        first, last = rows.iloc[0], rows.iloc[-1]
        block = b"".join(rows["block"])
        whole = rows["number"].tolist() == list(range(1, len(rows) + 1)) and not pd.isna(last["total"]) and int(last["total"]) == len(block)
        got = _decoded(block, first["payload_digest"]) if whole else {"complete": False}
        return pd.DataFrame(
            {
                "page_id": pd.array([first["page_id"]], "Int64"), "record_type": [first["record_type"]], "payload_bytes": pd.array([got.get("payload_bytes", pd.NA)], "Int64"),
                "payload_digest": [got.get("payload_digest", first["payload_digest"])], "complete": [got["complete"]],
            }
        )

    return parts.groupBy("origin").applyInPandas(one, "page_id long, record_type string, payload_bytes long, payload_digest string, complete boolean")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, complete of
    every archived page. A revisit has the length of the response with its digest."""
    rows = staged(read_records(spark, path), "warc-records")
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "complete"]
    parts = reassemble(rows.where("number IS NOT NULL")).withColumn("refers_to", F.lit(None).cast("long"))
    whole = rows.where("number IS NULL AND record_type = 'response'").select(*out).unionByName(parts.select(*out))
    whole = staged(whole, "warc-responses")
    known = whole.where("complete").groupBy(F.col("payload_digest").alias("__digest")).agg(F.max("payload_bytes").alias("__bytes"))
    visits = rows.where("record_type = 'revisit'").join(known, F.col("payload_digest") == F.col("__digest"), "left")
    visits = visits.withColumn("payload_bytes", F.col("__bytes")).withColumn("complete", F.col("__bytes").isNotNull())
    return whole.select(*out).union(visits.select(*out))
