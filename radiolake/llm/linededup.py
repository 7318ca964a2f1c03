"""Repeated lines over all documents, found by two Bloom filters and confirmed exactly.

A key is a line, stripped of ASCII white space at both ends and with A-Z lowered. Every task keeps
two Bloom filters of the keys' hashes: those seen once and those seen twice. Filters merge like
counters that stop at two (a bit that two tasks set once is set twice), so the merged second filter
misses no key of two documents. Its bits go to every task; only keys found in it move: they are
counted exactly, and where they are repeated often enough all documents but one lose their lines.
The filters have a bit budget: what goes beyond it makes more keys suspected, none is missed.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from radiolake.llm.common import bounded, keep

BLANK = b" \t\n\x0b\x0c\r"
LOG_SEGMENT = 18   # bits of a part of a filter that merges on its own (32 kB)
LOG_MOST = 29      # bits of a whole filter at most: 64 MB
BITS_A_KEY = 16    # of the filters, as long as they fit
FAN_IN = 256       # partial filters that one merging task takes of a segment
HOT = 1000         # keys with so small a part of all suspected places are joined by broadcast


def _chars(key: bytes, least: int) -> bool:
    """Whether a key has so many code points, of one to four bytes each."""
    n = len(key)
    return n >= least and (n >= 4 * least or key.isascii() or len(key.decode("utf-8")) >= least)


def long_keys(text: bytes | None, min_chars: int) -> Iterator[tuple[int, bytes]]:
    """(line number, key) of the lines whose key is long enough."""
    for k, line in enumerate((text or b"").lower().split(b"\n")):  # bytes: only A-Z are lowered
        if len(line) >= min_chars and _chars(key := line.strip(BLANK), min_chars):
            yield k, key


def _keys(rows: list[bytes | None], min_chars: int) -> list[dict[int, bytes]]:
    """The distinct long keys of each row by their hashes."""
    digest = xxhash.xxh3_64_intdigest
    return [{digest(key): key for _, key in long_keys(text, min_chars)} for text in rows]


def _flat(keys: list[dict[int, bytes]]) -> np.ndarray:
    return np.fromiter((h for own in keys for h in own), np.uint64, sum(map(len, keys)))


def _bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


class Bits:
    """A Bloom filter with two places for a 64-bit hash: its halves, cut to the filter's size."""

    def __init__(self, log_bits: int, data: np.ndarray | None = None):
        self.mask = np.uint64((1 << log_bits) - 1)
        self.data = np.zeros(1 << (log_bits - 3), np.uint8) if data is None else data

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return h & self.mask, (h >> np.uint64(32)) & self.mask

    def add(self, h: np.ndarray) -> None:
        for place in self._places(h):
            np.bitwise_or.at(self.data, place >> np.uint64(3),
                             np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for place in self._places(h):
            bit = (place & np.uint64(7)).astype(np.uint8)
            found &= (self.data[place >> np.uint64(3)] >> bit & 1).astype(bool)
        return found


PARTS = "segment int, part int, once binary, twice binary"


def _parts(once: np.ndarray, twice: np.ndarray, part: int) -> pa.RecordBatch:
    """The segments that hold a bit, packed."""
    size = min(len(once), 1 << (LOG_SEGMENT - 3))
    rows = [(k, part, zlib.compress(a.tobytes(), 1), zlib.compress(b.tobytes(), 1))
            for k, (a, b) in enumerate(zip(once.reshape(-1, size), twice.reshape(-1, size),
                                           strict=True)) if a.any()]
    cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                                      ["segment", "part", "once", "twice"])


def _merge(table: pa.Table) -> pa.Table:
    """One segment of several tasks: what two have seen once has been seen twice."""
    once = twice = None
    for a, b in zip(table["once"].to_pylist(), table["twice"].to_pylist(), strict=True):
        a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
        if once is None:
            once, twice = a.copy(), b.copy()
        else:
            twice |= b | (once & a)
            once |= a
    return pa.table({"segment": table["segment"][:1], "part": table["part"][:1],
                     "once": [zlib.compress(once.tobytes(), 1)],
                     "twice": [zlib.compress(twice.tobytes(), 1)]},
                    schema=pa.schema([("segment", pa.int32()), ("part", pa.int32()),
                                      ("once", pa.binary()), ("twice", pa.binary())]))


def log_bits(n_keys: int) -> int:
    """Size of a filter for so many keys, as a power of two within the bounds."""
    return min(max(math.ceil(math.log2(max(n_keys, 1) * BITS_A_KEY)), 13), LOG_MOST)


def seen_twice(texts: DataFrame, min_chars: int, size: int) -> Bits:
    """The filter of keys that two rows of `texts` (one column, text) hold, at most 64 MB.

    A row counts a key once. Keys of a single row are in it only by chance.
    """
    def build(batches):
        once, twice = Bits(size), Bits(size)
        for batch in batches:
            keys = _keys(_bytes(batch.column(0)), min_chars)
            own, times = np.unique(_flat(keys), return_counts=True)
            twice.add(own[(times > 1) | once.has(own)])
            once.add(own)
        yield _parts(once.data, twice.data, TaskContext.get().partitionId())

    parts = keep(bounded(texts).mapInArrow(build, PARTS), "line-filters")
    n = 1 + (parts.select(F.max("part").alias("n")).first()["n"] or 0)
    while True:
        parts = parts.groupBy("segment", F.floor(F.col("part") / FAN_IN).cast("int").alias("g"))
        n = math.ceil(n / FAN_IN)
        parts = parts.applyInArrow(_merge, PARTS)
        if n <= 1:
            break
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
    whole = Bits(size)
    step = min(len(whole.data), 1 << (LOG_SEGMENT - 3))
    for row in parts.select("segment", "twice").collect():  # bounded by the filter's size
        at = row["segment"] * step
        whole.data[at:at + step] = np.frombuffer(zlib.decompress(row["twice"]), np.uint8)
    return whole


def _digest(key: bytes) -> bytes:
    return blake2b(key, digest_size=16).digest()


def suspects(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """Every row with its id, text, number of lines and the digests of its suspected keys, kept.

    The number `row` names a row, ids may repeat.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(x) >= min_chars)
    n_keys = rows.select(F.sum(F.size(lines)).alias("n")).first()["n"] or 0
    size = log_bits(max(n_keys, 0))
    twice = seen_twice(rows.select("text"), min_chars, size)
    shared = spark.sparkContext.broadcast(twice.data)

    def probe(batches):
        seen = Bits(size, shared.value)
        for batch in batches:
            texts = _bytes(batch.column(1))
            keys = _keys(texts, min_chars)
            hit = iter(seen.has(_flat(keys)).tolist())
            keys = [sorted(_digest(key) for key in own.values() if next(hit)) for own in keys]
            count = [(t or b"").count(b"\n") + 1 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(count, pa.int64()),
                 pa.array(keys, pa.list_(pa.binary()))], ["id", "text", "n_lines", "keys"])

    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType),
                           *T.StructType.fromDDL("text string, n_lines long, "
                                                 "keys array<binary>").fields])
    return keep(bounded(rows).mapInArrow(probe, schema)
                .withColumn("row", F.monotonically_increasing_id()), "line-suspects")


def dropped_keys(places: DataFrame, min_docs: int) -> DataFrame:
    """(row, key) of the places (row, id, key) whose row loses that key's lines."""
    counts = keep(places.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("last"))
                  .where(F.col("n") >= min_docs), "repeated-lines")
    total = places.count()
    # a key with a thousandth of all places would crowd one task: there are a thousand at most
    hot = F.col("n") * HOT >= total
    frequent = counts.where(hot).select("key", F.lit(True).alias("hot"), F.col("last").alias("l"))
    marked = places.join(F.broadcast(frequent), "key", "left")
    stays = F.col("id").eqNullSafe(F.col("last"))
    out = marked.where("hot").withColumn("last", F.col("l")).where(~stays)
    rest = marked.where("hot is null").join(counts.where(~hot).select("key", "last"), "key")
    return out.select("row", "key").unionByName(rest.where(~stays).select("row", "key"))


def drop_repeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Per row: id, n_lines (before), n_dropped, text (the lines that stay, joined by line ends).

    Keys of min_chars code points or more in min_docs rows or more stay with the largest id that
    holds them (a null id counts as the smallest; every row of that id keeps its lines), all their
    lines there, and go elsewhere. Rows that repeat an id count as documents of their own. A null
    or empty text is one empty line, which is too short to be a key. An empty table gives an empty
    result; other columns are not read.
    """
    rows = suspects(df, id_col, text_col, min_chars)
    places = rows.select("row", "id", F.explode("keys").alias("key"))
    gone = dropped_keys(places, min_docs).groupBy("row").agg(
        F.collect_list("key").alias("gone"))  # at most the keys of that row's text

    def cut(batches):
        for batch in batches:
            kept, n_dropped = [], []
            for text, gone in zip(_bytes(batch.column(3)), batch.column(4).to_pylist(),
                                  strict=True):
                gone, lines = set(gone or ()), text.split(b"\n")
                drop = {k for k, key in long_keys(text, min_chars)
                        if _digest(key) in gone} if gone else ()
                kept.append(b"\n".join(x for k, x in enumerate(lines) if k not in drop))
                n_dropped.append(len(drop))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n_dropped, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())],
                ["id", "n_lines", "n_dropped", "text"])

    out = T.StructType([T.StructField("id", df.schema[id_col].dataType),
                        *T.StructType.fromDDL("n_lines long, n_dropped long, text string").fields])
    held = rows.where(F.size("keys") > 0).join(gone, "row", "left")
    cutting = bounded(held.select("id", "row", "n_lines", "text", "gone")).mapInArrow(cut, out)
    clean = rows.where(F.size("keys") == 0).select(
        "id", "n_lines", F.lit(0).cast("long").alias("n_dropped"),
        F.coalesce("text", F.lit("")).alias("text"))
    return cutting.unionByName(clean)
