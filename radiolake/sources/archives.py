"""File heads and archive entries by range reads, each entry inflated as a stream of its own task.

Two Python data sources: `file_heads` gives the first bytes of every file, `zip_entries` the central
directory of every archive, one row an entry. Neither reads what it does not give. The entries are an
ordinary table: filter it, then hand it to `entry_lines` or `entry_placemarks`.
"""

from __future__ import annotations

import json
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualTo, Filter, In,
                                    InputPartition, StringContains, StringEndsWith,
                                    StringStartsWith)

HEAD = 262_144          # bytes of a file's head
FILES = 64              # files of one reading task
CHUNK = 1 << 20         # packed bytes inflated at a time
BATCH = 4 << 20         # characters of one batch of lines
PLACEMARK_END = b"</Placemark>"


def plain_path(c: Column) -> Column:
    """A path as these sources write it, from one as Spark gives it (percent codes, file:///)."""
    return F.regexp_replace(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), "^file:/+", "/")


def _list(patterns: Sequence[str]) -> list[tuple[str, int]]:
    """(path, size) of the files that paths, folders and patterns with * or ? name, in order."""
    found: dict[str, int] = {}
    for pattern in patterns:
        scheme, system, own = _open(pattern)
        wild = re.search(r"[*?]", own)
        root = own[:wild.start()].rpartition("/")[0] if wild else own
        info = system.get_file_info(root)
        if info.type == fs.FileType.File:
            found[scheme + info.path] = info.size
            continue
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(pattern)
        parts = re.escape(own).replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
        for x in system.get_file_info(fs.FileSelector(root, recursive=True)):
            name = x.path.rpartition("/")[2]
            if x.type == fs.FileType.File and not name.startswith(("_", ".")) and (
                    not wild or re.fullmatch(parts + "(/.*)?", x.path)):
                found[scheme + x.path] = x.size
    return sorted(found.items())


def _open(path: str) -> tuple[str, fs.FileSystem, str]:
    """(scheme to put back, file system, path there)."""
    scheme = re.match(r"(?!file:)[a-z0-9]+://[^/]*", path)
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if scheme is None:
        return "", fs.LocalFileSystem(), path
    system, own = fs.FileSystem.from_uri(path)
    return scheme.group(), system, own


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        super().__init__(files)


class _Reader(DataSourceReader):
    """Lists files on the driver, keeps those the filters on `path` allow, and deals them out."""

    def __init__(self, options: dict):
        self.patterns = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.together = int(options.get("files", FILES))
        self.wanted: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            known = isinstance(f, (EqualTo, In, StringContains, StringEndsWith, StringStartsWith))
            if known and f.attribute == ("path",):
                self.wanted.append(f)
            else:
                yield f

    def _allowed(self, path: str) -> bool:
        tests = {EqualTo: lambda v: path == v, In: lambda v: path in v,
                 StringContains: lambda v: v in path, StringEndsWith: path.endswith,
                 StringStartsWith: path.startswith}
        return all(tests[type(f)](f.value) for f in self.wanted)

    def partitions(self) -> list[InputPartition]:
        files = [x for x in _list(self.patterns) if self._allowed(x[0])]
        return [Files(files[k:k + self.together])
                for k in range(0, len(files), self.together)] or [Files([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path, size in partition.value:
            yield from self.rows(path, size)


class _HeadReader(_Reader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.most = int(options.get("bytes", HEAD))

    def rows(self, path: str, size: int) -> Iterator[tuple]:
        _, system, own = _open(path)
        with system.open_input_file(own) as f:
            yield path, size, f.read_at(min(self.most, size), 0)


class FileHeads(DataSource):
    """path, size and the first bytes (option `bytes`) of every file of option `path` or `paths`."""

    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return "path string, size long, head binary"

    def reader(self, schema) -> DataSourceReader:
        return _HeadReader(self.options)


ENTRIES = ("path string, entry string, kind string, offset long, packed long, size long, "
           "method int, crc long, reason string")
# What the names of readable entries end with.
KINDS = {".csv": "lines", ".txt": "lines", ".kml": "kml"}


def _why_not(x: zipfile.ZipInfo) -> str | None:
    if x.is_dir():
        return "a folder"
    if x.flag_bits & 1:
        return "encrypted"
    if x.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        return f"packed by method {x.compress_type}"
    return None if _kind(x.filename) else "no text, CSV or KML file"


def _kind(name: str) -> str | None:
    return next((k for end, k in KINDS.items() if name.lower().endswith(end)), None)


class _ZipReader(_Reader):
    def rows(self, path: str, size: int) -> Iterator[tuple]:
        _, system, own = _open(path)
        with system.open_input_file(own) as f:
            try:
                entries = zipfile.ZipFile(f).infolist()  # reads the end of the file only
            except (zipfile.BadZipFile, pa.ArrowInvalid):  # the latter where a file is too short
                yield path, None, None, None, None, size, None, None, "no readable archive"
                return
            for x in entries:
                why = _why_not(x)
                yield (path, x.filename, None if why else _kind(x.filename), x.header_offset,
                       x.compress_size, x.file_size, x.compress_type, x.CRC, why)


class ZipEntries(DataSource):
    """The entries of every archive, with their place in it; entries that are not read have a
    reason and no kind. An archive is a task."""

    @classmethod
    def name(cls) -> str:
        return "zip_entries"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema) -> DataSourceReader:
        return _ZipReader({"files": "1", **self.options})


def _source(spark: SparkSession, source: type[DataSource], paths: Sequence[str]) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
    return spark.read.format(source.name()).option("paths", json.dumps(list(paths))).load()


def file_heads(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return _source(spark, FileHeads, paths)


def zip_entries(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return _source(spark, ZipEntries, paths)


def _inflate(path: str, offset: int, packed: int, method: int, crc: int) -> Iterator[bytes]:
    """The bytes of an entry, piece by piece; fails if they are not those that were packed."""
    _, system, own = _open(path)
    with system.open_input_file(own) as f:
        names = struct.unpack("<HH", f.read_at(30, offset)[26:])  # lengths of name and extra field
        at, end = offset + 30 + sum(names), offset + 30 + sum(names) + packed
        unpack, check = zlib.decompressobj(-15), 0
        while at < end:
            data = f.read_at(min(CHUNK, end - at), at)
            if not data:
                break
            at += len(data)
            while data:
                if method == zipfile.ZIP_STORED:
                    out, data = data, b""
                else:
                    out = unpack.decompress(data, CHUNK * 4)
                    data = unpack.unconsumed_tail
                check = zlib.crc32(out, check)
                if out:
                    yield out
        if method != zipfile.ZIP_STORED:
            out = unpack.flush()
            check = zlib.crc32(out, check)
            yield out
    if check != crc:
        raise ValueError(f"{path}: the entry at {offset} is damaged")


def _pieces(data: Iterator[bytes], end: bytes) -> Iterator[list[bytes]]:
    """What stands before each `end`, and the rest, in batches of bounded size."""
    left = b""
    for part in data:
        *whole, left = (left + part).split(end)
        if whole:
            yield whole
    if left:
        yield [left]


def _each(entries: DataFrame, kind: str, row: str, make) -> DataFrame:
    """make(stream of an entry's bytes) -> lists of strings; an entry is a task."""
    own = entries.where(F.col("kind") == kind).select(
        "path", "entry", "offset", "packed", "method", "crc")
    n = max(1, own.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                name = f"{x['path']}!{x['entry']}"
                for rows in make(_inflate(x["path"], x["offset"], x["packed"], x["method"],
                                          x["crc"])):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(rows), pa.string()), pa.array(rows, pa.string())],
                        ["path", row])

    return own.repartition(n).mapInArrow(read, f"path string, {row} string")


def _text(data: bytes) -> str:
    return data.decode("utf-8", errors="replace")


def entry_lines(entries: DataFrame) -> DataFrame:
    """(path!entry, value) of the lines of every text entry, without their line ends."""
    def make(data: Iterator[bytes]) -> Iterator[list[str]]:
        first = True
        for rows in _pieces(data, b"\n"):
            if first:
                rows[0], first = rows[0].removeprefix(b"\xef\xbb\xbf"), False
            yield [_text(x.removesuffix(b"\r")) for x in rows]

    return _each(entries, "lines", "value", make)


def entry_heads(entries: DataFrame, most: int = HEAD) -> DataFrame:
    """(path!entry, value) of the whole lines in the first bytes of every text entry."""
    def make(data: Iterator[bytes]) -> Iterator[list[str]]:
        head = b""
        for part in data:
            head += part
            if len(head) >= most:
                yield head_lines(head[:most], whole=False)
                return
        yield head_lines(head, whole=True)

    return _each(entries, "lines", "value", make)


def head_lines(head: bytes, whole: bool) -> list[str]:
    """The lines of a head; one that is cut off is left out."""
    rows = head.removeprefix(b"\xef\xbb\xbf").split(b"\n")
    return [_text(x.removesuffix(b"\r")) for x in (rows if whole else rows[:-1])]


def head_rows(spark: SparkSession, plain: Sequence[str], zips: Sequence[str]) -> DataFrame:
    """Text lines (path, value) of the heads of plain files and of archive entries."""
    parts = []
    if plain:
        text = F.decode("head", "UTF-8")
        rows = F.split(F.regexp_replace(text, "^\ufeff", ""), "\r?\n")
        # the last line of a longer file's head is cut off
        whole = F.when(F.col("size") > F.octet_length("head"),
                       F.slice(rows, F.lit(1), F.size(rows) - 1)).otherwise(rows)
        parts.append(file_heads(spark, plain).select("path", F.explode(whole).alias("value")))
    if zips:
        parts.append(entry_heads(zip_entries(spark, zips)))
    if not parts:
        raise ValueError("no files are named")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def entry_placemarks(entries: DataFrame) -> DataFrame:
    """(path!entry, body) of every placemark of the map entries: no document is held whole."""
    def make(data: Iterator[bytes]) -> Iterator[list[str]]:
        for rows in _pieces(data, PLACEMARK_END):
            bodies = [re.split(r"<Placemark\b[^>]*>", _text(x), maxsplit=1) for x in rows]
            yield [x[1] for x in bodies if len(x) == 2]

    return _each(entries, "kml", "body", make)


def write_archives(lines: DataFrame, folder: str, end: str = ".zip") -> DataFrame:
    """Packs (archive, entry, at, value) lines: one zip a name in `archive`, one entry a name in
    `entry`, its lines in the order of `at`. Returns the paths.

    An archive is written by one task, entry after entry, under a name of its own for each attempt;
    the returned paths are those of the attempts that counted.
    """
    from uuid import uuid4

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme, system, own = _open(folder)
        system.create_dir(own, recursive=True)
        out = archive = stream = entry = None

        def close() -> None:
            if stream is not None:
                stream.close()
        for batch in batches:
            for x in batch.to_pylist():
                if out is None or x["archive"] != archive:
                    if out is not None:
                        close()
                        out.close()
                        sink.close()
                        yield _path(scheme + name)
                    archive, entry, stream = x["archive"], None, None
                    name = f"{own}/{archive}-{uuid4().hex}{end}"
                    sink = system.open_output_stream(name)
                    out = zipfile.ZipFile(_Sink(sink), "w", zipfile.ZIP_DEFLATED)
                if x["entry"] != entry:
                    close()
                    entry = x["entry"]
                    stream = out.open(entry, "w", force_zip64=True)
                stream.write(x["value"].encode("utf-8") + b"\n")
        if out is not None:
            close()
            out.close()
            sink.close()
            yield _path(scheme + name)

    rows = lines.select("archive", "entry", "at", "value").repartition("archive")
    return rows.sortWithinPartitions("archive", "entry", "at").mapInArrow(write, "path string")


def _path(name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name])], ["path"])


class _Sink:
    """A stream that zipfile may write to but not seek in."""

    def __init__(self, out):
        self.out = out

    def write(self, data: bytes) -> int:
        self.out.write(data)
        return len(data)

    def flush(self) -> None:
        self.out.flush()
