"""Best-fit packing of token sequences by hierarchical residual rounds.

Every round deals its items into groups of bounded size, packs each group by best fit (longest
first) and emits the bins that are nearly full. The others become items of the next round, as long
as they are filled, so bins of several groups merge; the groups of a round follow from how many
bins are left. The rounds end with one group, or when merging no longer pays: bins over half full
that no other fits are not carried on.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiolake.llm.common import crc32, keep, map_batches, texts, with_id
from radiolake.llm.tokens import encoder

GROUP = 40_000   # items of a group: what one task holds
SLACK = 8        # a bin with so much room or less is nearly full


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(bin of each item, its offset there, fill of each bin); items in the order given.

    The bins are kept by their room; the tightest that takes an item is the lowest set bit of an
    integer of `capacity` bits, so an item costs the same whatever the number of bins.
    """
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    fill: list[int] = []
    bins, offsets = [], []
    for n in lengths.tolist():
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins.append(b)
        offsets.append(fill[b])
        fill[b] += n
        left = room - n
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return np.array(bins, np.int64), np.array(offsets, np.int64), fill


def _round(items: DataFrame, n_groups: int, capacity: int) -> DataFrame:
    """(key, length) -> key, length, bin, offset, fill; bins are unique over all groups."""
    def pack(table: pa.Table) -> pa.Table:
        # longest first; the key decides ties, so a task run again packs alike
        table = table.sort_by([("length", "descending"), ("key", "ascending")])
        bins, offsets, fill = best_fit(table["length"].to_numpy(), capacity)
        group = table["group"][0].as_py()
        return pa.table({"key": table["key"], "length": table["length"],
                         "bin": pa.array(bins + (group << 32)), "offset": pa.array(offsets),
                         "fill": pa.array(np.array(fill, np.int64)[bins])})

    group = F.pmod(F.xxhash64("key"), F.lit(n_groups))
    return (items.select("key", F.col("length").cast("long").alias("length"),
                         group.cast("long").alias("group"))
            .groupBy("group").applyInArrow(
                pack, "key long, length long, bin long, offset long, fill long"))


def pack(items: DataFrame, capacity: int, group: int = GROUP, slack: int = SLACK) -> DataFrame:
    """(key long, length 1..capacity) -> key, sequence_id, offset; keys are unique.

    Sequence ids carry the round in their upper bits. An empty table gives an empty result.
    """
    spark = items.sparkSession
    left, n = items.select("key", "length"), items.count()
    levels, before = [], math.inf
    while True:
        n_groups = max(1, -(-n // group))
        packed = keep(_round(left, n_groups, capacity), "packed")
        levels.append(packed)
        if n_groups == 1:
            break
        under = packed.where(F.col("fill") < capacity - slack)
        left = under.groupBy("bin").agg(F.max("fill").alias("length")).select(
            F.col("bin").alias("key"), "length")
        n = left.count()
        # a round that leaves nearly as many bins as it got has nothing more to merge
        if n == 0 or n > 0.98 * before:
            break
        before = n
    out = None
    for depth, packed in reversed(list(enumerate(levels))):
        number = F.col("bin") + F.lit(depth << 56)
        own = packed.select("key", "bin", "offset", number.alias("sequence_id"))
        if out is None:
            out = own.select("key", "sequence_id", "offset")
        else:
            # bins that went on lie somewhere in a bin of a later round
            up = out.select(F.col("key").alias("bin"), F.col("sequence_id").alias("s"),
                            F.col("offset").alias("o"))
            out = own.join(up, "bin", "left").select(
                "key", F.coalesce("s", "sequence_id").alias("sequence_id"),
                (F.col("offset") + F.coalesce("o", F.lit(0))).alias("offset"))
        if depth:
            out = keep(out, "placed")
    return out if out is not None else spark.createDataFrame(
        [], "key long, sequence_id long, offset long")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: only the first may be shorter than the capacity."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
           capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32 (and ids, if asked for)."""
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        end = np.array([end_id], "<u4").tobytes()
        rows, number, start, length, crc, ids = [], [], [], [], [], []
        for k, data in enumerate(encoder(tokenizer).encode(texts(batch.column(1)))):
            data += end
            for p, (at, n) in enumerate(cut(len(data) // 4, capacity)):
                part = data[4 * at:4 * (at + n)]
                rows.append(k)
                number.append(p)
                start.append(at)
                length.append(n)
                crc.append(crc32(part))
                if with_ids:
                    ids.append(np.frombuffer(part, "<u4").astype(np.int32))
        cols = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()),
                pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                pa.array(crc, pa.int64())]
        names = ["id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            cols.append(pa.array(ids, pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(cols, names)

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, one, with_id(
        df, id_col, "piece int, start long, length long, ids_crc32 long"
                    + (", ids array<int>" if with_ids else "")))


def pack_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A null or empty text is its end id alone. Repeated ids are packed like any other row. Full
    pieces are sequences of their own. `sequences` puts the ids together.
    """
    cols = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    # the key is fixed once it is written; ids may repeat, so it cannot be made of them
    all_pieces = keep(pieces(df, tokenizer, id_col, text_col, capacity, end_id, with_ids)
                      .withColumn("key", F.monotonically_increasing_id()), "pieces")
    whole = all_pieces.where(F.col("length") == capacity)
    rest = all_pieces.where(F.col("length") < capacity)
    placed = rest.join(pack(rest.select("key", "length"), capacity), "key")
    full = whole.withColumn("sequence_id", -1 - F.col("key")).withColumn(
        "offset", F.lit(0).cast("long"))
    names = [*cols, "sequence_id", "offset"]
    return placed.select(names).unionByName(full.select(names))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (of its pieces in order) from pieces that were packed with their ids."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(
        F.struct("offset", "ids"))).alias("parts"))  # at most `capacity` ids
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"))
