"""Approximate nearest neighbours by inner product: query-aware collision counting.

Vectors are laid on the unit sphere (scaled by the largest norm, with one more coordinate that
fills up the rest), where the largest inner product is the smallest distance. A block of the index
holds, for each of `projections` random directions, its vectors sorted by their projection. A
query opens a window around its own projection in every sorted array; the windows grow step by
step (virtual rehashing: wider windows hold the narrower ones, so only their ends are counted
anew). Vectors inside at least half of the windows are verified by their true inner product. A
block is done when a vector as near as the k-th best found would have come up with probability
`certainty`; windows that cover everything verify everything, so nothing is capped.
"""

from __future__ import annotations

import io
import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from radiolake.llm.common import keep, new_dir

BLOCK = 16_384      # vectors of an index block
QUERIES = 1_024     # queries of a task
FIRST = 0.7         # half-width of the first windows, in distances on the unit sphere
GROWTH = 1.12       # of the windows from step to step
SHIFT = 1e4         # more than any window reaches
SEED = 42


def usable(vec: str) -> Column:
    """Not null, not empty, finite throughout and not zero."""
    v = F.col(vec)
    return (v.isNotNull() & (F.size(v) > 0)
            & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
            & F.exists(v, lambda x: x != 0))


def directions(dim: int, projections: int) -> np.ndarray:
    """Random vectors as columns, orthogonal within each set of `dim` of them, of length
    sqrt(dim): two vectors at distance d project to places some N(0, d * d) apart."""
    rng = np.random.default_rng(SEED)
    sets = [np.linalg.qr(rng.standard_normal((dim, dim)))[0]
            for _ in range(-(-projections // dim))]
    return np.concatenate(sets, axis=1)[:, :projections] * math.sqrt(dim)


class Block:
    """Distinct vectors of a block, the smallest ids of each, and the sorted projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, scale: float, k: int,
                 projections: int):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        # how many vectors an id has at most
        self.most = np.unique(ids, return_counts=True)[1].max(initial=1)
        self.vectors, group = np.unique(vectors, axis=0, return_inverse=True)
        group = group.ravel()
        # of equal vectors only the k + 1 smallest ids can be among the k nearest
        by_group = np.argsort(group, kind="stable")
        rank = np.arange(len(ids)) - np.searchsorted(group[by_group], group[by_group])
        few = by_group[rank <= k]
        self.owner, self.ids = group[few], ids[few]
        self.first = np.searchsorted(self.owner, np.arange(len(self.vectors) + 1))
        unit = self.vectors / scale
        last = np.sqrt(np.maximum(0.0, 1.0 - (unit * unit).sum(axis=1)))
        spots = np.column_stack([unit, last]) @ directions(unit.shape[1] + 1, projections)
        self.order = np.argsort(spots, axis=0, kind="stable").T.astype(np.int32).copy()
        # all sorted arrays in one, SHIFT apart, so that one search finds a place in each
        self.sorted = (np.take_along_axis(spots.T, self.order, axis=1)
                       + SHIFT * np.arange(projections)[:, None]).ravel()

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{k: getattr(self, k) for k in self.PARTS})
        return out.getvalue()

    PARTS = ("vectors", "owner", "ids", "first", "order", "sorted", "most")

    @classmethod
    def load(cls, data: bytes) -> Block:
        got, block = np.load(io.BytesIO(data)), cls.__new__(cls)
        for k in cls.PARTS:
            setattr(block, k, got[k])
        return block

    def nearest(self, own: int, query: np.ndarray, scale: float, k: int,
                certainty: float) -> tuple[list[int], list[float]]:
        """Ids and scores of the k largest inner products found; ties to the smaller id."""
        n, m = len(self.vectors), len(self.order)
        norm = float(np.sqrt((query * query).sum()))
        spot = np.append(query / norm, 0.0) @ directions_of(len(query) + 1, m)
        need = -(-m // 2)
        # so many vectors hold k ids and the query's own, however they share them
        wide = (k + 1) * int(self.most)
        counts = np.zeros(n, np.int64)
        scores = np.full(n, -np.inf)
        spot = spot + SHIFT * np.arange(m)
        lo = hi = np.searchsorted(self.sorted, spot)
        flat, half = self.order.ravel(), FIRST
        while True:
            new_lo = np.searchsorted(self.sorted, spot - half, "left")
            new_hi = np.searchsorted(self.sorted, spot + half, "right")
            ends = [part for a, b, c, d in zip(new_lo.tolist(), lo.tolist(), hi.tolist(),
                                               new_hi.tolist(), strict=True)
                    for part in (flat[a:b], flat[c:d])]
            counts += np.bincount(np.concatenate(ends), minlength=n)
            lo, hi = new_lo, new_hi
            fresh = np.flatnonzero((counts >= need) & (scores == -np.inf))
            if len(fresh):
                scores[fresh] = (self.vectors[fresh] * query).sum(axis=1)
            everything = bool((hi - lo == n).all())
            found = np.flatnonzero(scores > -np.inf)
            if len(found) >= wide or everything:
                last = min(len(found), wide)
                kth = np.partition(scores[found], -last)[-last]
                away = math.sqrt(max(0.0, 2 - 2 * float(kth) / (norm * scale)))
                if everything or away == 0 or chance(half / away, m, need) >= certainty:
                    break
            half *= GROWTH
        best = found[scores[found] >= kth]
        ids = np.concatenate([self.ids[self.first[b]:self.first[b + 1]] for b in best])
        own_scores = np.repeat(scores[best], self.first[best + 1] - self.first[best])
        ids, own_scores = ids[ids != own], own_scores[ids != own]
        top = np.lexsort((ids, -own_scores))
        top = top[np.sort(np.unique(ids[top], return_index=True)[1])][:k]  # an id's best vector
        return ids[top].tolist(), own_scores[top].tolist()


_DIRECTIONS: dict[tuple[int, int], np.ndarray] = {}


def directions_of(dim: int, projections: int) -> np.ndarray:
    """The directions, made once in each worker."""
    if (dim, projections) not in _DIRECTIONS:
        _DIRECTIONS[dim, projections] = directions(dim, projections)
    return _DIRECTIONS[dim, projections]


NORMAL = NormalDist()


def chance(width: float, m: int, need: int) -> float:
    """That at least `need` of m windows of half-width `width` distances hold a vector."""
    p = 2 * NORMAL.cdf(width) - 1
    spread = math.sqrt(m * p * (1 - p))
    return 1.0 if spread == 0 else 1 - NORMAL.cdf((need - 0.5 - m * p) / spread)


def build(rows: DataFrame, k: int, projections: int) -> DataFrame:
    """(id, vec double array) -> dim, block, path, scale: one index file for each block."""
    folder = new_dir(rows.sparkSession, "index")
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    sized = rows.withColumn("dim", F.size("vec"))
    scales = sized.groupBy("dim").agg(F.sqrt(F.max(norm)).alias("scale"),
                                      F.count("*").alias("n"))
    blocks = (F.col("n") / BLOCK).cast("long") + 1

    def write(table: pa.Table) -> pa.Table:
        dim, block, scale = (table[c][0].as_py() for c in ("dim", "block", "scale"))
        vectors = table["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        made = Block(table["id"].to_numpy(), vectors.reshape(-1, dim), scale, k, projections)
        path = f"{folder}/{dim}-{block}.npz"
        system, own = fs.FileSystem.from_uri(path)
        system.create_dir(own.rsplit("/", 1)[0], recursive=True)
        # every attempt writes the same bytes, and the name appears when they are complete
        draft = f"{own}.{np.random.default_rng().integers(1 << 62)}"
        with system.open_output_stream(draft) as out:
            out.write(made.dump())
        system.move(draft, own)
        return pa.table({"dim": pa.array([dim], pa.int32()), "block": [block], "path": [path],
                         "scale": [scale]})

    dealt = (sized.join(scales, "dim").withColumn("n_blocks", blocks)
             .select("dim", F.expr("pmod(xxhash64(id), n_blocks)").alias("block"), "scale", "id",
                     "vec"))
    return keep(dealt.groupBy("dim", "block").applyInArrow(
        write, "dim int, block long, path string, scale double"), "index")


def search(df: DataFrame, queries: Column, id_col: str = "vec_id", vec_col: str = "embedding",
           k: int = 20, projections: int = 64, certainty: float = 0.9) -> DataFrame:
    """Of each row that `queries` selects: query_id, rank, vec_id, score of its k nearest others.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do
    null ids; vectors of another length are no candidates. Equal scores go to the smaller id. An
    id on several rows is one candidate, by its best vector; as a query it asks with the smallest
    of them in the order of arrays. Every block of the index meets the query set in blocks of its
    own.
    """
    rows = df.where(usable(vec_col) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"),
        F.col(vec_col).cast("array<double>").alias("vec")).distinct()
    index = build(rows, k, projections)
    asked = df.where(queries & usable(vec_col)).select(
        F.col(id_col).cast("long").alias("id"),
        F.col(vec_col).cast("array<double>").alias("vec")).groupBy("id").agg(
        F.min("vec").alias("vec"))
    n = max(1, -(-asked.count() // QUERIES))
    meets = (asked.withColumn("dim", F.size("vec"))
             .withColumn("part", F.expr(f"pmod(xxhash64(id), {n})")).join(index, "dim"))

    def look(table: pa.Table) -> pa.Table:
        path, scale = table["path"][0].as_py(), table["scale"][0].as_py()
        system, own = fs.FileSystem.from_uri(path)
        with system.open_input_stream(own) as f:
            block = Block.load(f.read())
        asked_ids, ids, scores = [], [], []
        vectors = table["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        vectors = vectors.reshape(table.num_rows, -1)
        for query, vec in zip(table["id"].to_pylist(), vectors, strict=True):
            got, near = block.nearest(query, vec, scale, k, certainty)
            asked_ids += [query] * len(got)
            ids += got
            scores += near
        return pa.table({"query_id": pa.array(asked_ids, pa.int64()),
                         "vec_id": pa.array(ids, pa.int64()),
                         "score": pa.array(scores, pa.float64())})

    # a block and a part of the queries are a task's work, however few bytes they are
    found = meets.repartition(n * max(1, index.count()), "path", "part").groupBy(
        "path", "part").applyInArrow(
        look, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # an id that repeats may come from several blocks
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
