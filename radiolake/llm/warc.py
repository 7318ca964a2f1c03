"""WARC archives with revisit resolution.

`write_crawl` writes every row as a response record and returns the headers of the records with
their place. `resolve` shuffles those headers, never payloads, by payload digest and joins every
record to the one that stays. `write_deduplicated` copies the archives record by record with fresh
headers; a record whose payload stands elsewhere becomes a revisit without payload. `read_archives`
reads what the archives say. A record is one gzip member, so archives are read and written one
record at a time. Files carry names of their own in each attempt of a task, and only those that the
committed table of headers names count.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.llm.common import BATCH_ROWS, bounded, keep, new_dir

SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value
DATE = "1970-01-01T00:00:00Z"   # of records whose source has no date
PLACE = "path string, at long, size long"
HEADERS = f"page_id long, url string, payload_bytes long, payload_digest string, {PLACE}"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def record_id(path: str, at: int) -> str:
    """Of the record at that place of the crawl: places are unique, page ids need not be."""
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{path}#{at}')}>"


def _value(text: str) -> str:
    """A header value in one line."""
    return "".join(c if c > "\x1f" and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One gzip member; fields without a value are left out."""
    lines = ["WARC/1.1", *(f"{k}: {_value(str(v))}" for k, v in fields if v is not None),
             f"Content-Length: {len(block)}", "", ""]
    data = "\r\n".join(lines).encode("utf-8") + block + b"\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(stream) -> Iterator[tuple[int, bytes]]:
    """(place, record) of an archive, one gzip member after the other."""
    at, data = 0, b""
    while True:
        z, parts, used = zlib.decompressobj(31), [], 0
        while not z.eof:
            data = data or stream.read(1 << 18)
            if not data:
                if used:
                    raise ValueError("the archive ends within a record")
                return
            parts.append(z.decompress(data))
            used += len(data) - len(z.unused_data)
            data = z.unused_data
        yield at, b"".join(parts)
        at += used


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    return fields, rest[:int(fields["Content-Length"])]


class Archive:
    """A file that is written record by record; it is opened by the first one."""

    def __init__(self, folder: str, name: str):
        self.path = f"{folder}/{name}-{uuid.uuid4().hex}.warc.gz"
        self.at, self.out = 0, None

    def add(self, fields: list[tuple[str, object]], block: bytes) -> tuple[int, int]:
        if self.out is None:
            system, own = fs.FileSystem.from_uri(self.path)
            system.create_dir(own.rsplit("/", 1)[0], recursive=True)
            self.out = system.open_output_stream(own)
            self.add([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(self.path, 0)),
                      ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")],
                     b"format: WARC File Format 1.1\r\n")
        data = record(fields, block)
        self.out.write(data)
        at = self.at
        self.at += len(data)
        return at, len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def _response(own_id: str, page: int | None, url: str | None, payload: bytes, code: str,
              date: str) -> tuple[list[tuple[str, object]], bytes]:
    return [("WARC-Type", "response"), ("WARC-Record-ID", own_id), ("WARC-Date", date),
            ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{code}"),
            ("X-Page-Id", page), ("X-Payload-Bytes", len(payload)),
            ("Content-Type", "application/http; msgtype=response")], (
        HTTP.format(len(payload)).encode("ascii") + payload)


def write_crawl(pages: DataFrame, folder: str, date: str = DATE) -> DataFrame:
    """Every row (page_id, url, html) as a response record; returns the records' headers.

    A null html is an empty payload; a null page_id or url is left out of the header.
    """
    def write(batches):
        from pyspark import TaskContext
        archive = Archive(folder, f"crawl-{TaskContext.get().partitionId():06d}")
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                part, rows = batch.slice(start, BATCH_ROWS), []
                for page, url, html in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    payload = (html or "").encode("utf-8")
                    code = digest(payload)
                    at, size = archive.add(*_response(record_id(archive.path, archive.at), page,
                                                      url, payload, code, date))
                    rows.append((page, url, len(payload), code, archive.path, at, size))
                yield _batch(rows, HEADERS_ARROW)
        archive.close()

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"),
                        F.col("html").cast("string"))
    return keep(bounded(rows).mapInArrow(write, HEADERS), "crawl")


HEADERS_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()),
                           ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                           ("path", pa.string()), ("at", pa.int64()), ("size", pa.int64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in
                                       zip(cols, schema, strict=True)], schema=schema)


def resolve(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """headers and `first`: the record that their payload is kept in, null for that one itself.

    Of records with equal payloads of at least min_bytes, the one with the largest page_id keeps
    it (null counts as the smallest; of rows that repeat a page_id the last place in the crawl).
    The one for each digest is found with partial aggregation, so a digest of a third of all
    records moves as one row a task; the join back is split by the engine where a digest is hot.
    """
    place = F.struct("page_id", "path", "at", "url")
    large = headers.where(F.col("payload_bytes") >= min_bytes)
    first = large.groupBy("payload_digest").agg(F.max(place).alias("first"))
    out = headers.join(first, "payload_digest", "left")
    own = ((F.col("first.path") == F.col("path")) & (F.col("first.at") == F.col("at"))
           | (F.col("payload_bytes") < min_bytes))
    return out.withColumn("first", F.when(own, None).otherwise(F.col("first")))


def write_deduplicated(resolved: DataFrame, folder: str, date: str = DATE) -> DataFrame:
    """Copies the crawl's archives, one task an archive, with fresh headers; returns the paths."""
    def copy(table: pa.Table) -> pa.Table:
        path = table["path"][0].as_py()
        todo = {r["at"]: r for r in table.to_pylist()}
        archive = Archive(folder, "deduplicated")
        system, own = fs.FileSystem.from_uri(path)
        with system.open_input_stream(own) as stream:
            for at, data in members(stream):
                row = todo.get(at)
                if row is None:
                    continue
                first, own_id = row["first"], record_id(path, at)
                if first is None:
                    payload = parse(data)[1].partition(b"\r\n\r\n")[2]
                    archive.add(*_response(own_id, row["page_id"], row["url"], payload,
                                           row["payload_digest"], date))
                else:
                    archive.add(
                        [("WARC-Type", "revisit"), ("WARC-Record-ID", own_id),
                         ("WARC-Date", date), ("WARC-Target-URI", row["url"]),
                         ("WARC-Profile", PROFILE),
                         ("WARC-Refers-To", record_id(first["path"], first["at"])),
                         ("WARC-Refers-To-Target-URI", first["url"]),
                         ("WARC-Refers-To-Date", date),
                         ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"),
                         ("X-Page-Id", row["page_id"]),
                         ("X-Refers-To-Page-Id", first["page_id"]),
                         ("X-Payload-Bytes", row["payload_bytes"])], b"")
        archive.close()
        return pa.table({"path": [archive.path], "n_records": [len(todo)]})

    cols = resolved.select("path", "at", "page_id", "url", "payload_bytes", "payload_digest",
                           "first")
    # an archive is a task's work, however short its list of headers is
    n = max(1, resolved.select("path").distinct().count())
    return keep(cols.repartition(n, "path").groupBy("path").applyInArrow(
        copy, "path string, n_records long"), "deduplicated")


PAGES = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()),
                   ("payload_digest", pa.string()), ("record_type", pa.string()),
                   ("refers_to", pa.int64()), ("url", pa.string()), ("record_id", pa.string()),
                   ("refers_to_id", pa.string())])


def read_archives(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """Every response and revisit record of the archives in column `path`.

    Size and digest of a response are those of the payload as it is read.
    """
    n = max(1, paths.count())

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, own = fs.FileSystem.from_uri(path)
                rows = []
                with system.open_input_stream(own) as stream:
                    for _, data in members(stream):
                        fields, block = parse(data)
                        kind = fields["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        size, code = (int(fields["X-Payload-Bytes"]),
                                      fields["WARC-Payload-Digest"].removeprefix("sha1:"))
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            size, code = len(payload), digest(payload)
                        page, to = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
                        rows.append((int(page) if page else None, size, code, kind,
                                     int(to) if to else None, fields.get("WARC-Target-URI"),
                                     fields["WARC-Record-ID"], fields.get("WARC-Refers-To")))
                        if len(rows) == BATCH_ROWS:
                            yield _batch(rows, PAGES)
                            rows = []
                yield _batch(rows, PAGES)

    ddl = ("page_id long, payload_bytes long, payload_digest string, record_type string, "
           "refers_to long, url string, record_id string, refers_to_id string")
    return paths.select("path").repartition(n).mapInArrow(read, ddl)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Crawl archives, deduplicated archives, and what the latter say, one row a page.

    An empty table gives no archive and an empty result.
    """
    spark = pages.sparkSession
    headers = write_crawl(pages, new_dir(spark, "crawl-archives"))
    paths = write_deduplicated(resolve(headers, min_bytes), new_dir(spark, "archives"))
    return read_archives(spark, paths)
