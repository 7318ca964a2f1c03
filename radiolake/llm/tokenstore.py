"""Token ids in binary shards with a minimal perfect hash index for keyed access.

A shard is a file of raw little-endian ids (16 or 32 bits), documents in ascending key order, and
an index file: a minimal perfect hash over the shard's keys, and by its slots a stored fingerprint,
the offset and the length. A document is found in constant time: hash, slot, fingerprint, one read.
The hash is built from bit arrays level by level: a key that hits a bit alone owns it, the others
go on to the next level; the slot is the number of owned bits before it.

Files get names of their own in every attempt of a task; those in the manifest, which Spark commits,
count, so a task that ran twice or was lost leaves no trace in what is read.
"""

from __future__ import annotations

import bisect
import io
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from radiolake.llm.common import BATCH_ROWS, bounded, crc32, keep, new_dir, texts
from radiolake.llm.tokens import encoder

GAMMA = 2.0        # bits of a level for each key that is left
LEVELS = 40        # keys left after so many levels stand in a table of their own
MAX_SHARDS = 1_000_000  # of a manifest whose key ranges a lookup broadcasts (some 50 MB)
MANIFEST = ("shard int, path string, n_docs long, n_tokens long, first_key string, "
            "last_key string, width int")


def key_hashes(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, fingerprint) of keys: two independent halves of 128 bits."""
    digests = [xxhash.xxh3_128_intdigest(k) for k in keys]
    low = np.array([d & 0xFFFFFFFFFFFFFFFF for d in digests], np.uint64)
    high = np.array([d >> 96 for d in digests], np.uint32)
    return low, high


def _place(h: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where the keys fall among the bits of a level (the finaliser of splitmix64)."""
    x = h + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit hashes; `slot` maps each to 0..n-1."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.base, at = [], 0
        self.rank = []
        for bits in levels:
            # owned bits before each block of 64
            ones = np.unpackbits(bits).reshape(-1, 64).sum(axis=1)
            self.rank.append(at + np.concatenate([[0], np.cumsum(ones)]))
            at += int(ones.sum())
        self.size = at + len(rest)
        self.first_rest = at

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        levels, left = [], np.unique(hashes)
        while len(left) and len(levels) < LEVELS:
            size = max(64, -(-int(GAMMA * len(left)) // 64) * 64)
            at = _place(left, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone))
            left = left[~alone[at]]
        return cls(levels, np.sort(left))

    def slot(self, hashes: np.ndarray) -> np.ndarray:
        """Slots; a hash that was not built in gets any slot or -1."""
        out = np.full(len(hashes), -1, np.int64)
        todo = np.arange(len(hashes))
        for level, bits in enumerate(self.levels):
            if not len(todo):
                break
            at = _place(hashes[todo], level, len(bits) * 8)
            owned = (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            hit = at[owned]
            block = hit >> 6
            # owned bits of the own block up to the own one
            words = np.unpackbits(bits).reshape(-1, 64)[block] if len(hit) else np.zeros((0, 64))
            before = (words * (np.arange(64) < (hit & 63)[:, None])).sum(axis=1)
            out[todo[owned]] = self.rank[level][block] + before
            todo = todo[~owned]
        if len(todo) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, hashes[todo]), len(self.rest) - 1)
            same = self.rest[at] == hashes[todo]
            out[todo[same]] = self.first_rest + at[same]
        return out


class Index:
    """The index of one shard, in memory or in its file."""

    def __init__(self, keys: list[str], lengths: np.ndarray):
        """keys in document order; lengths in ids."""
        h, mark = key_hashes(keys)
        self.hash = PerfectHash.build(h)
        slots = self.hash.slot(h)
        offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        self.mark = np.zeros(self.hash.size, np.uint32)
        self.offset = np.zeros(self.hash.size, np.int64)
        self.length = np.zeros(self.hash.size, np.int64)
        self.mark[slots], self.offset[slots], self.length[slots] = mark, offsets, lengths
        self.keys = keys

    def find(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, offset, length) of keys; the fingerprint tells strangers apart."""
        h, mark = key_hashes(keys)
        slots = self.hash.slot(h)
        safe = np.maximum(slots, 0)
        if not len(self.mark):
            return np.zeros(len(keys), bool), safe, safe
        return (slots >= 0) & (self.mark[safe] == mark), self.offset[safe], self.length[safe]

    def dump(self) -> bytes:
        out = io.BytesIO()
        raw = [k.encode("utf-8") for k in self.keys]
        np.savez(out, mark=self.mark, offset=self.offset, length=self.length, rest=self.hash.rest,
                 keys=np.frombuffer(b"".join(raw), np.uint8),
                 ends=np.cumsum([len(r) for r in raw]).astype(np.int64),
                 **{f"level{k}": b for k, b in enumerate(self.hash.levels)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Index:
        got = np.load(io.BytesIO(data))
        index = cls.__new__(cls)
        n = sum(name.startswith("level") for name in got.files)
        index.hash = PerfectHash([got[f"level{k}"] for k in range(n)], got["rest"])
        index.mark, index.offset, index.length = got["mark"], got["offset"], got["length"]
        ends, raw = got["ends"].tolist(), got["keys"].tobytes()
        index.keys = [raw[a:b].decode("utf-8") for a, b in zip([0, *ends], ends, strict=False)]
        return index


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def doc_key(doc: str | None, nth: int) -> str:
    """Key of the nth document of that id (from 0), so that repeated ids stay apart."""
    return ("\x00" if doc is None else doc) + (f"\x00{nth}" if nth else "")


def write(df: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id",
          text_col: str = "text", end_id: int = 2) -> DataFrame:
    """Encode every row, write shards in ascending id order under path, return the manifest.

    Null ids come first; rows of one id follow in the order of their texts. A null text is its
    end id alone. The manifest has a row for each shard that holds documents.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    rows = rows.select(F.col("id").cast("string").alias("id"), "text")

    def shard(batches):
        from pyspark import TaskContext
        number = TaskContext.get().partitionId()
        codec = encoder(tokenizer)
        width = 2 if codec.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        name = f"{path}/{number:06d}-{uuid.uuid4().hex}"
        system, own = _open(path)
        system.create_dir(own, recursive=True)
        keys, lengths = [], []
        last, nth = object(), 0
        out = None
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                out = out or _open(name + ".ids")[0].open_output_stream(_open(name + ".ids")[1])
                codes = codec.encode(texts(part.column(1)))
                for doc, data in zip(part.column(0).to_pylist(), codes, strict=True):
                    ids = np.append(np.frombuffer(data, "<u4"), np.uint32(end_id))
                    nth = nth + 1 if doc == last else 0
                    last = doc
                    keys.append(doc_key(doc, nth))
                    lengths.append(len(ids))
                    out.write(ids.astype(f"<u{width}").tobytes())
        if out is None:
            return
        out.close()
        with system.open_output_stream(_open(name + ".idx")[1]) as index:
            index.write(Index(keys, np.array(lengths, np.int64)).dump())
        yield pa.RecordBatch.from_pydict({
            "shard": pa.array([number], pa.int32()), "path": [name], "n_docs": [len(keys)],
            "n_tokens": [sum(lengths)], "first_key": [keys[0]], "last_key": [keys[-1]],
            "width": pa.array([width], pa.int32())})

    return keep(bounded(rows).mapInArrow(shard, MANIFEST), "manifest")


def _with_base(manifest: DataFrame) -> DataFrame:
    """The ids before each shard: a running sum over one row for each shard."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read(manifest: DataFrame, id_type: str = "long") -> DataFrame:
    """Every document of the store: doc_id, start, n_tokens, ids_crc32, found over the index."""
    n = max(1, manifest.count())

    def documents(batches):
        for batch in batches:
            for row in batch.to_pylist():
                system, own = _open(row["path"])
                with system.open_input_stream(own + ".idx") as f:
                    index = Index.load(f.read())
                with system.open_input_file(own + ".ids") as payload:
                    for at in range(0, len(index.keys), BATCH_ROWS):
                        yield _looked_up(index, payload, index.keys[at:at + BATCH_ROWS],
                                         row["width"], row["base"])

    found = (_with_base(manifest).repartition(n).select("path", "width", "base")
             .mapInArrow(documents, "key string, start long, n_tokens long, ids_crc32 long"))
    doc = F.split_part("key", F.lit("\x00"), F.lit(1))
    # a null id has the empty text before its mark
    doc = F.when(F.col("key").startswith("\x00"), None).otherwise(doc)
    return found.select(doc.cast(id_type).alias("doc_id"), "start", "n_tokens", "ids_crc32")


def _looked_up(index: Index, payload, keys: list[str], width: int, base: int) -> pa.RecordBatch:
    ok, offset, length = index.find(keys)
    out = []
    for k in np.flatnonzero(ok).tolist():
        raw = payload.read_at(int(length[k]) * width, int(offset[k]) * width)
        ids = np.frombuffer(raw, f"<u{width}").astype("<u4")
        out.append((keys[k], base + int(offset[k]), len(ids), crc32(ids.tobytes())))
    cols = list(zip(*out, strict=True)) if out else [(), (), (), ()]
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])],
        ["key", "start", "n_tokens", "ids_crc32"])


def lookup(spark: SparkSession, manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """Keyed access for a column `doc_id` of whole-number ids: doc_id, ids of those found.

    The key ranges of the shards are broadcast, one short row for each shard, up to MAX_SHARDS;
    keys are dealt to their shard, each shard's index is read once for its keys.
    """
    if manifest.count() > MAX_SHARDS:
        raise ValueError("too many shards to broadcast their ranges")
    rows = manifest.orderBy("shard").select("first_key", "path", "width").collect()
    ranges = spark.sparkContext.broadcast(
        ([int(r["first_key"].split("\x00")[0] or -(1 << 63)) for r in rows],
         [(r["path"], r["width"]) for r in rows]))

    def deal(batches):
        for batch in batches:
            ids = [k for k in batch.column(0).to_pylist() if k is not None]
            firsts, _ = ranges.value
            at = [bisect.bisect_right(firsts, k) - 1 for k in ids]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(at, pa.int32())], ["doc_id", "at"])

    def fetch(table: pa.Table) -> pa.Table:
        path, width = ranges.value[1][table["at"][0].as_py()]
        system, own = _open(path)
        with system.open_input_stream(own + ".idx") as f:
            index = Index.load(f.read())
        ids = table["doc_id"].to_pylist()
        ok, offset, length = index.find([doc_key(str(k), 0) for k in ids])
        with system.open_input_file(own + ".ids") as payload:
            got = [np.frombuffer(payload.read_at(int(length[k]) * width, int(offset[k]) * width),
                                 f"<u{width}").astype(np.int64) for k in np.flatnonzero(ok)]
        return pa.table({"doc_id": pa.array([ids[k] for k in np.flatnonzero(ok)], pa.int64()),
                         "ids": pa.array(got, pa.list_(pa.int64()))})

    dealt = keys.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().mapInArrow(
        deal, "doc_id long, at int").where("at >= 0")
    return dealt.groupBy("at").applyInArrow(fetch, "doc_id long, ids array<long>")


def round_trip(df: DataFrame, tokenizer: str) -> DataFrame:
    """Write the rows to a new folder of the shared one and read them back."""
    kind = df.schema["doc_id"].dataType.simpleString()
    manifest = write(df, new_dir(df.sparkSession, "tokens"), tokenizer)
    return read(manifest, kind)
