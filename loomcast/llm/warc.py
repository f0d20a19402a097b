"""WARC archives: index first, then coalesced sorted range reads.

Writing: every file begins with a warcinfo record.  Equal payloads are found by digest and length, the row with the
largest id becomes the ``response`` and the others ``revisit`` it.  Every task
writes archives of its own (one gzip member per record) straight to the shared
folder, and what Spark carries is the index: file, offset, length, url, digest.
A retried task writes new files, and only files named by the index count.

Reading: the wanted index rows are ranged by (file, offset), a task for about
``task_bytes`` of records, and sorted; records that lie near each other in a file
are fetched by one read, and every record is checked against its digest.

A url is written as it is, but for line breaks, which a header cannot hold and
which are percent-encoded there; what is read back takes it from the index.

Defined cases: a null payload is empty; null ids and urls stay null; rows that
repeat the largest id of a group are all responses, each with a record id of its
own; very long payloads are one record; an empty table gives no records; extra
columns are ignored.
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

from loomcast.llm import _shared

INDEX = "file string, offset bigint, length bigint, url string, digest string, page_id bigint"
_INDEX = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("page_id", pa.int64())])
RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload string"
_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                     ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.string())])
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    """A header value without line breaks."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(
    record_id: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None, revisit: bool, date: str
) -> tuple[bytes, str]:
    """(record bytes, payload digest)."""
    digest = digest_of(payload)
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", _line(url)))
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Date", date), ("X-Refers-To-Page", str(refers_to))]
        if refers_url is not None:
            head.append(("WARC-Refers-To-Target-URI", _line(refers_url)))
        body = _HTTP % len(payload)
    else:
        body = _HTTP % len(payload) + payload
    return _framed([*head, ("Content-Type", "application/http; msgtype=response")], body), digest


def _framed(head: list[tuple[str, str]], body: bytes) -> bytes:
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*head, ("Content-Length", str(len(body)))]) + "\r\n"
    return text.encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def _urn() -> str:
    return f"<urn:uuid:{uuid.uuid4()}>"


def _info(name: str, date: str) -> bytes:
    head = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", _urn()), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
    return _framed(head, b"software: loomcast\r\nformat: WARC File Format 1.1\r\n")


def parse(raw: bytes) -> dict:
    """Fields of a record; raises where the stored payload does not fit its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    h = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[: int(h["Content-Length"])]
    payload = body.partition(b"\r\n\r\n")[2]
    revisit = h["WARC-Type"] == "revisit"
    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (digest_of(payload) != digest or len(payload) != int(h["X-Payload-Length"])):
        raise ValueError(f"record {h['WARC-Record-ID']} does not fit its digest")
    number = lambda k: int(h[k]) if k in h else None
    return {"page_id": number("X-Page-Id"), "url": h.get("WARC-Target-URI"), "payload_bytes": int(h["X-Payload-Length"]), "payload_digest": digest,
            "record_type": h["WARC-Type"], "refers_to": number("X-Refers-To-Page"), "payload": None if revisit else payload.decode("utf-8", "surrogatepass")}


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _writer(folder: str, date: str, file_bytes: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _filesystem(folder)
        system.create_dir(base, recursive=True)
        out, name, at = None, "", 0

        def member(raw: bytes) -> int:
            z = zlib.compressobj(level, zlib.DEFLATED, 31)
            data = z.compress(raw) + z.flush()
            out.write(data)
            return len(data)

        try:
            for batch in batches:
                rows = []
                page, url, html, refers, refers_url, revisit = batch.columns
                for i in range(batch.num_rows):
                    if out is None or at >= file_bytes:
                        if out:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{base}/{name}", compression=None)
                        at += member(_info(name, date))
                    raw, digest = record(_urn(), page[i].as_py(), url[i].as_py(), html[i].as_buffer().to_pybytes() if html[i].is_valid else b"",
                                         refers[i].as_py(), refers_url[i].as_py(), bool(revisit[i].as_py()), date)
                    size = member(raw)
                    rows.append((name, at, size, url[i].as_py(), digest, page[i].as_py()))
                    at += size
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 6, _INDEX, strict=True)], schema=_INDEX)
        finally:
            if out:
                out.close()

    return run


def plan_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Add ``refers_to``, ``refers_url`` and ``revisit`` to (page_id, url, html)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("_d"), F.octet_length(html).alias("_n"))
    groups = (
        keyed.where(F.col("_n") >= min_bytes).groupBy("_d", "_n")
        .agg(F.max("page_id").alias("_keep"), F.max_by("url", "page_id").alias("_u"), F.count(F.lit(1)).alias("_c")).where("_c > 1").drop("_c")
    )
    revisit = F.coalesce(F.col("page_id") < F.col("_keep"), F.col("page_id").isNull() & F.col("_keep").isNotNull())
    return keyed.join(groups, ["_d", "_n"], "left").select(
        "page_id", "url", "html", F.when(revisit, F.col("_keep")).alias("refers_to"), F.when(revisit, F.col("_u")).alias("refers_url"), revisit.alias("revisit")
    )


def write_archives(
    pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", file_bytes: int = 1 << 30, level: int = 6,
    id_col: str = "page_id", url: str = "url", html: str = "html",
) -> DataFrame:
    """Write one record per row below ``folder``; returns the index (itself written there first)."""
    spark = pages.sparkSession
    _shared.ship(spark)
    source = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{html}`").cast("string").alias("html"))
    index = plan_revisits(source, min_bytes).mapInArrow(_writer(f"{folder}/records", date, file_bytes, level), INDEX)
    index.write.option("compression", "zstd").parquet(f"{folder}/index")
    return spark.read.schema(index.schema).parquet(f"{folder}/index")


def _reader(folder: str, gap: int, most: int, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _filesystem(folder)
        name, source = None, None
        for batch in batches:
            files, offsets, lengths, urls = (batch.column(i).to_pylist() for i in range(4))
            i = 0
            while i < len(files):
                j, end = i, offsets[i] + lengths[i]
                while j + 1 < len(files) and files[j + 1] == files[i] and offsets[j + 1] - end <= gap and offsets[j + 1] + lengths[j + 1] - offsets[i] <= most:
                    j += 1
                    end = offsets[j] + lengths[j]
                if files[i] != name:
                    if source:
                        source.close()
                    name, source = files[i], system.open_input_file(f"{base}/{files[i]}")
                raw = source.read_at(end - offsets[i], offsets[i])
                rows = []
                for k in range(i, j + 1):
                    at = offsets[k] - offsets[i]
                    got = parse(zlib.decompress(raw[at : at + lengths[k]], 31)) | {"url": urls[k]}
                    if not payloads:
                        got["payload"] = None
                    rows.append(got)
                yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)
                i = j + 1
        if source:
            source.close()

    return run


def read_archives(index: DataFrame, folder: str, gap: int = 64 << 10, most: int = 8 << 20, payloads: bool = True, task_bytes: int = 16 << 20) -> DataFrame:
    """Records of the index rows (any subset of an index)."""
    _shared.ship(index.sparkSession)
    size = index.agg(F.coalesce(F.sum("length"), F.lit(0))).head()[0]
    wanted = index.select("file", "offset", "length", "url").repartitionByRange(max(1, -(-size // task_bytes)), "file", "offset").sortWithinPartitions("file", "offset")
    return wanted.mapInArrow(_reader(f"{folder}/records", gap, most, payloads), RECORD)


def query(spark, sf_dir):
    folder = _shared.scratch(spark, "warc")
    index = write_archives(_shared.table(spark, sf_dir, "pages"), folder)
    return read_archives(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
