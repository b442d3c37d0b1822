"""WARC archives with an index first: write records, keep an index row for each, read by byte ranges.

Writing: every task writes gzip archives (one member a record) straight into the shared folder under
a name of its own and gives an index row for each record: archive, offset, length, URL, digest. The
index is committed as Parquet by Spark; an archive that no committed row names is a leftover of a lost
or repeated attempt and is never read. Reading: index rows, chosen by any filter, are put in order by
(archive, offset); neighbouring ranges become one read of bounded size.

Records with equal payloads: the one with the smallest page id is a response, the others are revisits
that name it and carry no payload. Equal means same SHA-1 and same number of bytes. Payloads of
fewer than ``min_bytes`` are always responses. Rows that repeat the smallest page id are all
responses. A null page id is only a response if its payload has no other id. Null html is an empty
payload; a null URL is left out. Other columns of the pages are not looked at.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.llm.common import columns
from trialspark.session import scratch_path

ARCHIVE_BYTES = 256 << 20  # an archive is closed when it has this many bytes
READ_BYTES = 8 << 20  # of one ranged read
GAP_BYTES = 64 << 10  # unwanted bytes that a read may carry between two records
INDEX = "archive string, offset long, length long, url string, digest string, page_id long, record_type string"
PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def filesystem(uri: str):
    """The file system and the path in it; executors must reach it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record(kind: str, page_id, url, digest: str, payload: bytes, refers_to) -> bytes:
    """One WARC/1.1 record, not compressed."""
    if kind == "response":
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    else:
        block = b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=chr(37) + '!#$&()*+,/:;=?@[]~')}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        head += [f"X-Refers-To-Page-Id: {refers_to}"] if refers_to is not None else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("ascii") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The page columns of one record; a response's digest and length are checked against its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("ascii").split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
    payload = None
    if fields["WARC-Type"] == "response":
        payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"payload of record {fields['WARC-Record-ID']} doesn't match its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "page_id": number("X-Page-Id"),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": number("X-Refers-To-Page-Id"),
        "url": fields.get("WARC-Target-URI"),
        "payload": payload,
    }


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, sha1, record_type, refers_to``. The smallest id per payload is pre-aggregated; the join
    back is on the digest, where a payload with very many copies is split by Spark's skew handling."""
    base = columns(pages, page_id=id_col, url=url_col, html=html_col).select(
        "page_id", "url", F.coalesce("html", F.lit("")).alias("html")
    )
    base = base.withColumn("sha1", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    firsts = base.groupBy(F.col("sha1").alias("sha1"), F.col("size").alias("size")).agg(F.min("page_id").alias("first"))
    own = F.col("first").isNull() | F.col("page_id").eqNullSafe(F.col("first")) | (F.col("size") < min_bytes)
    return base.join(firsts, ["sha1", "size"]).select(
        "page_id",
        "url",
        "html",
        "sha1",
        F.when(own, "response").otherwise("revisit").alias("record_type"),
        F.when(~own, F.col("first")).alias("refers_to"),
    )


def write_archives(marked: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the records and the committed index; returns the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        system, root = filesystem(folder)
        try:
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    if out is not None and at >= archive_bytes:
                        out.close()
                        out = None
                    if out is None:
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{root}/{name}", compression=None)
                    digest = base64.b32encode(bytes.fromhex(r["sha1"])).decode()
                    raw = record(r["record_type"], r["page_id"], r["url"], digest, r["html"].encode("utf-8"), r["refers_to"])
                    member = gzip.compress(raw, 5, mtime=0)
                    out.write(member)
                    rows.append((name, at, len(member), r["url"], digest, r["page_id"], r["record_type"]))
                    at += len(member)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) if k not in (1, 2, 5) else pa.array(c, pa.int64()) for k, c in enumerate(zip(*rows))], names=[c.split()[0] for c in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    spark = marked.sparkSession
    system, root = filesystem(folder)
    system.create_dir(root, recursive=True)
    index = os.path.join(folder, "index")
    marked.mapInArrow(run, INDEX).write.mode("overwrite").parquet(index)
    return spark.read.parquet(index)


def read_records(selected: DataFrame, folder: str, read_bytes: int = READ_BYTES, gap_bytes: int = GAP_BYTES) -> DataFrame:
    """The records of the selected index rows. Rows are range-partitioned by place, so neighbours meet in one task and
    a large archive is shared by several; a task holds one read of about ``read_bytes`` at a time."""
    parts = int(selected.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = selected.select("archive", "offset", "length").repartitionByRange(parts, "archive", "offset").sortWithinPartitions("archive", "offset")

    def ranges(batches):
        """Lists of index rows that one read covers."""
        held: list[tuple[str, int, int]] = []
        for batch in batches:
            for place in zip(*(batch.column(i).to_pylist() for i in range(3))):
                archive, offset, length = place
                if held and not (archive == held[0][0] and offset - (held[-1][1] + held[-1][2]) <= gap_bytes and offset + length - held[0][1] <= read_bytes):
                    yield held
                    held = []
                held.append(place)
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in PAGE.split(", ")])
        system, root = filesystem(folder)
        name, source = None, None
        for held in ranges(batches):
            if held[0][0] != name:
                if source is not None:
                    source.close()
                name = held[0][0]
                source = system.open_input_file(f"{root}/{name}")
            start = held[0][1]
            data = source.read_at(held[-1][1] + held[-1][2] - start, start)
            yield pa.RecordBatch.from_pylist([parse(gzip.decompress(data[o - start : o - start + n])) for _, o, n in held], schema=schema)
        if source is not None:
            source.close()

    return places.mapInArrow(run, PAGE)


def archive_and_read(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write all pages, then read all records back by the index. The archives stay in ``folder`` (a new one in
    the shared folder by default) for whoever reads them; delete them when they are of no more use."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    index = write_archives(mark_revisits(pages, id_col, url_col, html_col, min_bytes), folder)
    return read_records(index, folder)
