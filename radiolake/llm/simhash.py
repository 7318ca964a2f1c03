"""Near-duplicates by SimHash: fingerprints, meet-in-the-middle ball hashing, components.

Two fingerprints at distance 2h or less have a word at distance h or less from both of them. Every
distinct fingerprint emits all words within h (the ball); fingerprints meet on equal words. The
members of one ball are all within 2h of each other, so a chain through them holds every link: a
ball gives members - 1 pairs, never all pairs, and has at most as many members as the ball words.
Rows with equal fingerprints count once, so a group of a million copies is one fingerprint.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from radiolake.llm.common import keep, map_batches, texts, with_id

SEED = 42
BITS = 64
BLOCK = 1 << 16  # hashes whose bits are counted at once


def fingerprint(text: str, shingle: int = 3) -> int:
    """Majority bits of the XXH64 of all word shingles, as a signed long.

    A-Z are lowered; words are runs of anything but ASCII white space. Fewer words than a shingle
    make one shingle; a text without words has fingerprint zero.
    """
    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    digest, seed = xxhash.xxh64_intdigest, SEED
    hashes = np.array([digest(g, seed) for g in grams], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at:at + BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = 3) -> DataFrame:
    """One row (id, fp) per row; a null text has no words."""
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(t, shingle) for t in texts(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())],
                                          ["id", "fp"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, one, with_id(df, id_col, "fp long"))


def ball(fp: Column, half: int) -> Column:
    """All words within `half` bits of fp, fp first."""
    masks = [0] + [sum(1 << b for b in bits) for k in range(1, half + 1)
                   for bits in combinations(range(BITS), k)]
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    return F.transform(F.array(*[F.lit(m).cast("long") for m in signed]),
                       lambda m: fp.bitwiseXOR(m))


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Verified pairs (a, b) of distinct fingerprints that connect all that are within radius."""
    if radius % 2 or radius < 2:
        raise ValueError("meeting in the middle needs an even radius")
    variants = fps.select("fp", F.explode(ball(F.col("fp"), radius // 2)).alias("word"))
    chain = Window.partitionBy("word").orderBy("fp")
    pairs = (variants.withColumn("a", F.lag("fp").over(chain)).where("a is not null")
             .select("a", F.col("fp").alias("b")).distinct())
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the smallest node.

    Each round takes the smallest label around every node and then the label of that label, so
    the rounds grow with the logarithm of a component's diameter. A round ends in a table in the
    shared folder, so a lost executor costs one round.
    """
    edges = keep(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = keep(edges.groupBy("a").agg(F.min("b").alias("m"))
                  .select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        near = (edges.join(labels.select(F.col("node").alias("b"), "root"), "b")
                .groupBy("a").agg(F.min("root").alias("m")))
        lower = (labels.join(near, labels["node"] == near["a"])
                 .select("node", F.col("root").alias("was"), F.least("root", "m").alias("root")))
        lower = keep(lower, "lower")
        jump = lower.select(F.col("node").alias("root"), F.col("root").alias("next"))
        after = keep(lower.join(jump, "root", "left")
                     .select("node", "was", F.coalesce("next", "root").alias("root")), "labels")
        labels = after.select("node", "root")
        if after.where("root <> was").isEmpty():
            return labels


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 3, radius: int = 2) -> DataFrame:
    """Per row: id, fp (long) and component (smallest id reachable over links, itself included).

    Null and empty texts have fingerprint zero and link like any other. Repeated ids stay as rows
    of their own. A null id links but never names a component unless all its ids are null. An
    empty table gives an empty result. Other columns are not read.
    """
    rows = keep(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    classes = keep(rows.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    roots = components(links(classes.select("fp"), radius))
    named = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component"))
    names = named.join(smallest, "root").select("fp", "component")
    return rows.join(names, "fp").select("id", "fp", "component")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
