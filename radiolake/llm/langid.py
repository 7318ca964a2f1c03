"""Language identification by prediction by partial matching with frozen statistics.

Every language has a context tree of bytes up to `order`; the code length of a byte is that of
PPM with escape method C and no exclusion: in the longest context seen in training, count / (total
+ distinct), or the escape distinct / (total + distinct) and the next shorter context, down to
eight bits. The statistics are frozen, so a byte's code length depends on its last `order` bytes
only, and the trees of all languages lie in flat tables that numpy walks for whole batches. A text
is taken for the language whose tree codes it shortest.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from radiolake.llm.common import map_batches, with_id

UNKNOWN = "und"
START = b"\n"     # what stands before a text, `order` times
SLICE = 1 << 20   # bytes scored at once
# Bits are whole multiples of 2^-16, so that sums do not depend on the order of addition.
UNIT = 1 << 16
LETTER = re.compile(r"[^\W\d_]")


class Trees:
    """The context trees of several languages, one level per context length."""

    def __init__(self, counts: dict[str, dict[int, int]], order: int = 3):
        """counts: of each language, how often each gram of order + 1 bytes (packed) occurs."""
        self.order, self.languages = order, sorted(counts)
        n = len(self.languages)
        if not n:
            return  # nothing was learned, so nothing can be coded
        grams = [np.fromiter(counts[x].keys(), np.int64, len(counts[x])) for x in self.languages]
        times = [np.fromiter(counts[x].values(), np.int64, len(counts[x]))
                 for x in self.languages]
        used = np.unique(np.concatenate([np.array(list(START), np.int64), *[g & 255 for g in grams],
                                         *[g >> (8 * order) & 255 for g in grams]]))
        # symbols: the bytes seen in training; all others share the last, which no tree holds
        self.symbol = np.full(256, len(used), np.int32)
        self.symbol[used] = np.arange(len(used))
        self.width = len(used) + 1
        self.child: list[np.ndarray] = []   # (id of the gram without its last byte, byte) -> id
        self.cost: list[np.ndarray] = []    # (id, language) -> bits
        self.escape: list[np.ndarray] = []  # (id of the context, language) -> bits
        packed, ids = np.zeros(1, np.int64), np.zeros(1, np.int32)
        # level k: grams of k bytes of context and one more
        for k in range(order + 1):
            mask = (1 << (8 * (k + 1))) - 1
            # every substring, so that each gram can be reached over its context, the first of
            # a text too; only a gram that ends at a byte of a text is counted
            level = np.unique(np.concatenate([g >> (8 * j) & mask for g in grams
                                              for j in range(order + 1 - k)]))
            parent = ids[np.searchsorted(packed, level >> 8)]
            count = np.zeros((len(level), n))
            for x in range(n):
                own, back = np.unique(grams[x] & mask, return_inverse=True)
                total = np.bincount(back, times[x], len(own))
                count[np.searchsorted(level, own), x] = total
            size = np.zeros((len(packed), n))
            kinds = np.zeros((len(packed), n))
            np.add.at(size, parent, count)
            np.add.at(kinds, parent, count > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(size > 0, -np.log2(kinds / (size + kinds)), 0.0)
                found = -np.log2(count / (size + kinds)[parent])
            if k:
                lower = self._ids(level & (mask >> 8), k)
                below = np.where(lower[:, None] >= 0, self.cost[-1][lower], 0.0)
            else:
                below = np.full((len(level), n), 8.0)
            self.escape.append(escape)
            self.cost.append(np.where(count > 0, found, escape[parent] + below))
            table = np.full(len(packed) * self.width, -1, np.int32)
            table[parent * self.width + self.symbol[level & 255]] = np.arange(len(level))
            self.child.append(table)
            packed, ids = level, np.arange(len(level), dtype=np.int32)
        self.cost = [np.round(x * UNIT).astype(np.int32) for x in self.cost]
        self.escape = [np.round(x * UNIT).astype(np.int32) for x in self.escape]

    def _ids(self, grams: np.ndarray, n: int) -> np.ndarray:
        """Ids of packed grams of n bytes."""
        at = np.zeros(len(grams), np.int32)
        for k in range(n):
            byte = self.symbol[grams >> (8 * (n - 1 - k)) & 255]
            at = np.where(at >= 0, self.child[k][np.maximum(at, 0) * self.width + byte], -1)
        return at

    def bits(self, data: np.ndarray) -> np.ndarray:
        """(byte, language) -> code length in units, for all bytes after the first `order`."""
        sym, order = self.symbol[data], self.order
        # reach[k]: id of the k + 1 bytes that end at each place, -1 if they are in no tree
        reach = [self.child[0][sym]]
        for k in range(1, order + 1):
            before = reach[-1][:-1]
            got = self.child[k][np.maximum(before, 0) * self.width + sym[k:]]
            reach.append(np.where(before >= 0, got, -1))
        top = reach[order]
        out = self.cost[order][top]
        todo = np.flatnonzero(top < 0)
        out[todo] = 0
        k = order
        while len(todo):
            at = todo + order  # places in data
            context = reach[k - 1][at - k] if k else np.zeros(len(at), np.int32)
            seen = context >= 0
            out[todo[seen]] += self.escape[k][context[seen]]
            if k == 0:
                out[todo] += 8 * UNIT
                break
            k -= 1
            found = reach[k][at - k]
            done = found >= 0
            out[todo[done]] += self.cost[k][found[done]]
            todo = todo[~done]
        return out

    def lengths(self, rows: list[bytes]) -> np.ndarray:
        """(row, language) -> code length in bits of each whole row."""
        pad = START * self.order
        sums = np.zeros((len(rows), len(self.languages)), np.int64)
        waiting: list[int] = []
        size = 0
        for k, row in enumerate(rows):
            if len(row) > SLICE:
                data = np.frombuffer(pad + row, np.uint8)
                for at in range(0, len(row), SLICE):
                    part = data[at:at + SLICE + self.order]
                    sums[k] += self.bits(part).sum(axis=0, dtype=np.int64)
            elif row:
                waiting.append(k)
                size += len(row)
                if size > SLICE:
                    self._together(rows, waiting, sums)
                    waiting, size = [], 0
        self._together(rows, waiting, sums)
        return sums / UNIT

    def _together(self, rows: list[bytes], which: list[int], sums: np.ndarray) -> None:
        if not which:
            return
        pad = START * self.order
        data = np.frombuffer(pad + pad.join(rows[k] for k in which), np.uint8)
        bits = self.bits(data)
        sizes = np.array([len(rows[k]) for k in which])
        starts = np.concatenate([[0], np.cumsum(sizes[:-1] + self.order)])
        # bytes of a row, then the start bytes of the next one, which count for nothing
        edges = np.stack([starts, starts + sizes], axis=1).ravel()
        run = np.concatenate([np.zeros((1, bits.shape[1]), np.int64),
                              np.cumsum(bits, axis=0, dtype=np.int64)])
        sums[which] += run[edges[1::2]] - run[edges[::2]]


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = 3,
          rows_per_language: int = 2000) -> Trees:
    """Trees of every non-null language of df.

    A language learns from `rows_per_language` whole texts at most, each once however often it is
    repeated: those with the smallest hashes, so they are the same on every run; fewer are all taken.
    """
    rows = df.select(F.col(lang_col).cast("string").alias("lang"),
                     F.col(text_col).cast("string").alias("text"))
    rows = rows.where("lang is not null and text is not null and text <> ''")
    # hashes decide, so that texts do not move; a hash that two texts share brings in both
    part = F.xxhash64("text", F.lit("sample"))
    hashes = rows.select("lang", part.alias("h")).distinct()
    # the smallest of each bucket first: no task orders a language whole
    buckets = Window.partitionBy("lang", F.pmod("h", F.lit(64))).orderBy("h")
    few = hashes.withColumn("k", F.row_number().over(buckets)).where(
        F.col("k") <= rows_per_language)
    taken = few.withColumn("k", F.row_number().over(
        Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= rows_per_language)
    sample = rows.withColumn("h", part).join(F.broadcast(taken.drop("k")), ["lang", "h"]).select(
        "lang", "text").distinct()
    width = order + 1

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, grams, times = [], [], []
        names = np.array(batch.column(0).to_pylist(), dtype=object)
        raw = batch.column(1).cast(pa.binary()).to_pylist()
        for lang in dict.fromkeys(names):
            packed = []
            for k in np.flatnonzero(names == lang):
                data = np.frombuffer(START * order + raw[k], np.uint8).astype(np.int64)
                gram = np.zeros(len(data) - order, np.int64)
                for b in range(width):
                    gram = gram << 8 | data[b:len(data) - order + b]
                packed.append(gram)
            own, n = np.unique(np.concatenate(packed), return_counts=True)
            langs += [lang] * len(own)
            grams.append(own)
            times.append(n)
        if not grams:
            return None
        return pa.RecordBatch.from_arrays(
            [pa.array(langs), pa.array(np.concatenate(grams)), pa.array(np.concatenate(times))],
            ["lang", "gram", "n"])

    table = (map_batches(sample.select("lang", "text"), count, "lang string, gram long, n long")
             .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    counts: dict[str, dict[int, int]] = {}
    # bounded by the sample: a gram of four bytes for each byte of it at most
    for lang, own in table.toPandas().groupby("lang"):
        counts[lang] = dict(zip(own["gram"], own["n"], strict=True))
    return Trees(counts, order)


def predict(df: DataFrame, trees: Trees, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score, bits_per_byte (of the language taken).

    The score is the posterior of the language under equal priors. A null text or one without a
    letter is `und` with score 0 and null bits; so is every text if nothing was learned. Ties go
    to the first language by name.
    """
    shared = df.sparkSession.sparkContext.broadcast(trees)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        rows = batch.column(1).to_pylist()
        real = [bool(x) and LETTER.search(x) is not None for x in rows]
        raw = [x.encode("utf-8") if ok else b"" for x, ok in zip(rows, real, strict=True)]
        langs, scores, rates = [], [], []
        if model.languages:
            lengths = model.lengths(raw)
            best = lengths.argmin(axis=1)
            least = lengths.min(axis=1)
            share = 1 / np.exp2(np.maximum(least[:, None] - lengths, -1000)).sum(axis=1)
        for k, ok in enumerate(real):
            ok = ok and bool(model.languages)
            langs.append(model.languages[best[k]] if ok else UNKNOWN)
            scores.append(float(share[k]) if ok else 0.0)
            rates.append(float(least[k]) / len(raw[k]) if ok else None)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
             pa.array(rates, pa.float64())], ["id", "lang_pred", "score", "bits_per_byte"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, one, with_id(
        df, id_col, "lang_pred string, score double, bits_per_byte double"))


def learning_rows(id_col: str = "doc_id") -> Column:
    """Rows that the model may learn from: those whose id's crc32 is not 2 modulo 4."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2
