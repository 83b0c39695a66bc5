"""WARC archives that Spark tasks write, their index, and reads of byte ranges.

Each task writes gzip members, one per record, to a file of its own below a shared folder, and returns one index
row per record: file, offset, length, URL and payload digest. Readers take index rows in file order, join
ranges that lie close together, and read each joined range once. A task that runs again writes a new file;
the index holds the rows of the attempt that counted.

Files are opened through ``pyarrow.fs`` by URI, so local, HDFS and object store folders serve alike.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP = 64 << 10  # bytes between ranges that are read along with them
RANGE = 8 << 20  # most bytes of a joined range, unless one record is longer
FILE = 1 << 30  # a file is closed when it has reached this size
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "key string, url string, digest string, record_type string, path string, offset long, length long"
RECORDS = "key string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary"


def _open(path: str):
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, key: str, url: str, digest: str, size: int, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One record as a gzip member."""
    block = HTTP + payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{key}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Bytes: {size}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a gzip member."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    if first != "WARC/1.1" or not rest.endswith(b"\r\n\r\n") or len(rest) - 4 != int(fields["Content-Length"]):
        raise OSError("not a whole WARC record")
    return fields, rest[:-4].partition(b"\r\n\r\n")[2]


def _page(urn: str) -> str:
    return urn.removeprefix("<urn:page:").removesuffix(">")


def decide(pages: DataFrame, key: str, url: str, payload: str, least_bytes: int = 0) -> DataFrame:
    """Key, url, payload, ``kind``, ``size``, ``sha`` and ``refers_to`` of each page.

    Of equal payloads of ``least_bytes`` and more the smallest key is the response and the others revisit it.
    The smallest key is found with partial aggregates; pages meet it in one join by digest and size, whose hot
    digests adaptive execution splits. A repeated smallest key is a response each time; pages without key revisit a keyed
    one, and are responses where no keyed page has their payload. Null payload: no bytes.
    """
    rows = pages.select(
        F.col(key).alias("key"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload")
    )
    rows = rows.withColumns({"sha": F.sha1("payload"), "size": F.octet_length("payload")})
    first = rows.where(F.col("size") >= least_bytes).groupBy("sha", "size").agg(F.min("key").alias("first"))
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("key"))
    return rows.join(first, ["sha", "size"], "left").select(
        F.col("key").cast("string").alias("key"),
        "url",
        "sha",
        "size",
        F.when(revisit, "revisit").otherwise("response").alias("kind"),
        F.when(revisit, F.col("first").cast("string")).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_archives(pages: DataFrame, key: str, url: str, payload: str, folder: str, least_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write a record per page below ``folder``; the index, read back from ``folder/index``."""
    target = f"{folder}/archives"

    def run(batches):
        out = path = None
        at = 0
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if out is None or at >= FILE:
                    if out is not None:
                        out.close()
                    path, at = f"{target}/{uuid.uuid4().hex}.warc.gz", 0
                    system, inner = _open(path)
                    system.create_dir(inner.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(inner, compression=None)
                digest = base64.b32encode(bytes.fromhex(row["sha"])).decode()
                name = "null" if row["key"] is None else row["key"]
                member = record(row["kind"], name, row["url"], digest, row["size"], row["payload"] or b"", row["refers_to"], date)
                out.write(member)
                rows.append((row["key"], row["url"], digest, row["kind"], path, at, len(member)))
                at += len(member)
            if rows:
                columns = list(zip(*rows))
                types = [pa.string()] * 5 + [pa.int64()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[f.split()[0] for f in INDEX.split(", ")])
        if out is not None:
            out.close()

    decide(pages, key, url, payload, least_bytes).mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return pages.sparkSession.read.parquet(f"{folder}/index")


def _ranges(rows: list[dict]):
    """Runs of index rows, in file order, that one read serves."""
    run: list[dict] = []
    for row in rows:
        if run and (
            row["path"] != run[0]["path"]
            or row["offset"] > run[-1]["offset"] + run[-1]["length"] + GAP
            or row["offset"] + row["length"] - run[0]["offset"] > RANGE
        ):
            yield run
            run = []
        run.append(row)
    if run:
        yield run


def read_records(index: DataFrame) -> DataFrame:
    """The records of index rows (any selection of them): ``RECORDS``.

    Rows are dealt by ranges of file and offset, so each task reads neighbouring bytes of few files. A response whose
    payload does not have the digest of its index row fails the job.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for group in _ranges(batch.to_pylist()):
                system, inner = _open(group[0]["path"])
                start, end = group[0]["offset"], group[-1]["offset"] + group[-1]["length"]
                with system.open_input_file(inner) as file:
                    data = file.read_at(end - start, start)
                for row in group:
                    at = row["offset"] - start
                    fields, payload = parse(data[at : at + row["length"]])
                    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                    size = len(payload) if kind == "response" else int(fields["X-Payload-Bytes"])
                    if digest != row["digest"] or kind == "response" and base32_sha1(payload) != digest:
                        raise OSError(f"record at {row['path']}:{row['offset']} is not the one in the index")
                    refers = _page(fields["WARC-Refers-To"]) if kind == "revisit" else None
                    key = None if row["key"] is None else _page(fields["WARC-Record-ID"])
                    rows.append((key, fields["WARC-Target-URI"], size, digest, kind, refers, payload if kind == "response" else None))
            if rows:
                columns = list(zip(*rows))
                types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[f.split()[0] for f in RECORDS.split(", ")])

    return index.repartitionByRange("path", "offset").sortWithinPartitions("path", "offset").mapInArrow(run, RECORDS)
