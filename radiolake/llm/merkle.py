"""Merkle manifest of a dataset: a tree of three children a node, each row a leaf.

The leaves of a group (a source) stand in the order of their ids. Every run of three nodes becomes
their hash until one is left, and the groups' last nodes are hashed the same way into the root. A
task builds whole subtrees of 3**height nodes, so a tree of any size is built in a few rounds, and a
group of any size is spread over tasks. Every parent keeps copies of its hash state before each
child slot: to fold a changed child in, the state of its slot goes on with the new digest and the
siblings to the right of it, nothing to the left is hashed again. A hash state of the library lives
in its task only, so a task makes those above its subtree anew, once, from the digests on the path.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from radiolake.llm.common import keep

ARITY = 3
HEIGHT = 8  # levels that one task builds: subtrees of 6,561 nodes
NODES = "g string, idx long, digest string, n long"


class Parent:
    """The hash of up to three digests, with its states before each child slot."""
    __slots__ = ("children", "states", "digest")

    def __init__(self, children: list[str]):
        self.children = children
        self.states = []
        state = sha256()
        for child in children:
            self.states.append(state.copy())
            state.update(child.encode("ascii"))
        self.digest = state.hexdigest()

    def fold(self, slot: int, digest: str) -> str:
        """The parent's digest if the child of that slot were this one."""
        state = self.states[slot].copy()
        state.update("".join([digest, *self.children[slot + 1:]]).encode("ascii"))
        return state.hexdigest()

    def siblings(self, slot: int) -> str:
        return "".join(self.children[:slot] + self.children[slot + 1:])


def levels(digests: list[str], height: int | None) -> list[list[Parent]]:
    """Parents by level, upwards: `height` levels of them, or until one node is left."""
    out, nodes = [], digests
    while len(out) < height if height is not None else len(nodes) > 1:
        out.append([Parent(nodes[k:k + ARITY]) for k in range(0, len(nodes), ARITY)])
        nodes = [p.digest for p in out[-1]]
    return out


def path(tree: list[list[Parent]], leaf: int) -> list[tuple[Parent, int]]:
    """The parents above a leaf, each with the slot that is folded into it."""
    out = []
    for row in tree:
        leaf, slot = divmod(leaf, ARITY)
        out.append((row[leaf], slot))
    return out


def subtree(rows: pd.DataFrame, height: int) -> list[list[Parent]]:
    """The parents above the nodes of one chunk, sorted by their place.

    The chunks of a group with more nodes than one task takes have all their levels.
    """
    whole = int(rows["n"].iloc[0]) <= ARITY ** height
    return levels(rows["digest"].tolist(), None if whole else height)


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """rows with idx (place in its group by `order`, from 0) and n (rows of the group), kept.

    The table is sorted over all tasks and rows are counted by task and group, so no task holds
    a group as such. Equal rows of `order` lie next to each other.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = F.monotonically_increasing_id()
    ordered = keep(rows.repartitionByRange(parts, group, *order)
                   .sortWithinPartitions(group, *order).withColumn("at", at), name)
    part = F.shiftright("at", 33).alias("part")
    runs = ordered.groupBy(group, part).agg(F.min("at").alias("first"), F.count("*").alias("own"))
    # a group has as many rows here as there are tasks
    before = Window.partitionBy(group).orderBy("part")
    whole = Window.partitionBy(group)
    runs = runs.select(group, "part", "first", F.sum("own").over(whole).alias("n"),
                       (F.sum("own").over(before) - F.col("own")).alias("before"))
    return (ordered.withColumn("part", F.shiftright("at", 33)).join(runs, [group, "part"])
            .withColumn("idx", F.col("at") - F.col("first") + F.col("before"))
            .drop("at", "part", "first", "before"))


def _chunk(height: int) -> Column:
    return F.floor(F.col("idx") / ARITY ** height).cast("long").alias("chunk")


def climb(nodes: DataFrame, height: int) -> DataFrame:
    """The next round's nodes (g, idx, digest, n): the root of every subtree of that height."""
    def up(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        tree = subtree(rows, height)
        top = tree[-1][0].digest if tree else rows["digest"].iloc[0]
        return pd.DataFrame({"g": [key[0]], "idx": [key[1]], "digest": [top],
                             "n": [-(-int(rows["n"].iloc[0]) // ARITY ** height)]})

    return nodes.groupBy("g", _chunk(height)).applyInPandas(up, NODES)


def subtrees(leaves: DataFrame, height: int, name: str) -> list[DataFrame]:
    """The rounds of nodes from the leaves to a single node for each group."""
    rounds = [leaves]
    while True:
        rounds.append(keep(climb(rounds[-1].select("g", "idx", "digest", "n"), height), name))
        if rounds[-1].where("n > 1").isEmpty():
            return rounds
        # groups that are done go on as they are: a lone node is its own root


STEP = "slot int, children array<string>"
PATHS = f"g string, idx long, path array<struct<{STEP}>>"


def descend(nodes: DataFrame, above: DataFrame, height: int) -> DataFrame:
    """(g, idx, path) of a round's nodes; `above` has the paths of the next round's nodes.

    A path is a node's steps to the root: its slot and all children of that parent.
    """
    def down(key: tuple, rows: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        tree = subtree(rows, height)
        top = _steps(upper)
        own = [[{"slot": s, "children": p.children} for p, s in path(tree, k)]
               for k in range(len(rows))]
        return pd.DataFrame({"g": rows["g"], "idx": rows["idx"], "path": [x + top for x in own]})

    return nodes.select("g", "idx", "digest", "n").groupBy("g", _chunk(height)).cogroup(
        above.select("g", F.col("idx").alias("chunk"), "path").groupBy("g", "chunk")
    ).applyInPandas(down, PATHS)


def _steps(upper: pd.DataFrame) -> list[dict]:
    return [{"slot": int(s["slot"]), "children": list(s["children"])}
            for s in upper["path"].iloc[0]] if len(upper) else []


def proofs(leaves: DataFrame, above: DataFrame, height: int,
           id_type: T.DataType) -> DataFrame:
    """Digests, proofs and folded roots of the leaves (g, idx, n, id, digest, changed)."""
    def fold(key: tuple, rows: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        tree = subtree(rows, height)
        top = [(Parent(s["children"]), s["slot"]) for s in _steps(upper)]
        above = "".join(p.siblings(s) for p, s in top).encode("ascii")
        proof, folded = [], []
        for k, digest in enumerate(rows["changed"]):
            siblings = sha256()
            for parent, slot in path(tree, k):
                siblings.update(parent.siblings(slot).encode("ascii"))
                digest = parent.fold(slot, digest)
            siblings.update(above)
            for parent, slot in top:
                digest = parent.fold(slot, digest)
            proof.append(siblings.hexdigest())
            folded.append(digest)
        return pd.DataFrame({"id": rows["id"], "leaf": rows["digest"],
                             "subroot": upper["subroot"].iloc[0], "proof_sha256": proof,
                             "folded_root": folded})

    out = T.StructType([T.StructField("id", id_type),
                        *T.StructType.fromDDL("leaf string, subroot string, proof_sha256 string, "
                                              "folded_root string").fields])
    return leaves.groupBy("g", _chunk(height)).cogroup(
        above.select("g", F.col("idx").alias("chunk"), "path", "subroot").groupBy("g", "chunk")
    ).applyInPandas(fold, out)


def leaf(df: DataFrame, columns: list[str], instead: dict[str, Column] | None = None) -> Column:
    """The digest of a row: each column as `-` if null, else its length in bytes, `:`, its value."""
    parts = []
    for c in columns:
        value = (instead or {}).get(c, F.col(f"`{c}`")).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value),
                                F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def manifest(df: DataFrame, columns: list[str], id_col: str = "doc_id",
             group_col: str = "source", instead: dict[str, Column] | None = None,
             height: int = HEIGHT) -> DataFrame:
    """Per row: id, leaf, subroot (of its group), root, proof_sha256, folded_root, verified.

    Leaves are digests of `columns`. proof_sha256 is the hash of the leaf's siblings on its way to
    the root. `instead` names columns whose present values may differ from the recorded ones: the
    row's leaf with these is folded up with the recorded siblings, and verified says whether that
    gives the root. Groups follow one another by their UTF-8 bytes, the null group first. Rows of
    one id (or of none, they come first) follow by their leaves. A single row is its own root. An
    empty table gives an empty result; other columns are not read.
    """
    # a group that is never null and sorts as asked
    group = F.coalesce(F.concat(F.lit("="), F.col(f"`{group_col}`").cast("string")), F.lit(""))
    rows = keep(df.select(F.col(f"`{id_col}`").alias("id"), group.alias("g"),
                          leaf(df, columns).alias("digest"),
                          leaf(df, columns, instead).alias("changed")), "merkle-rows")
    leaves = keep(numbered(rows, "g", ["id", "digest", "changed"], "merkle-sorted"),
                  "merkle-leaves")
    rounds = subtrees(leaves, height, "merkle-nodes")
    subroots = rounds[-1].select(F.col("g").alias("source"), F.col("digest").alias("subroot"))
    tops = numbered(subroots.select(F.lit("").alias("g"), "source", "subroot",
                                    F.col("subroot").alias("digest")), "g", ["source"],
                    "merkle-subroots")
    tops = keep(tops, "merkle-groups")
    upper = subtrees(tops, height, "merkle-tops")
    root = upper[-1].first()
    # down again: paths of the top nodes, of the groups, of the groups' subtrees
    paths = upper[-1].select("g", "idx", F.array().cast(f"array<struct<{STEP}>>").alias("path"))
    for nodes in reversed(upper[:-1]):
        paths = keep(descend(nodes, paths, height), "merkle-paths")
    paths = (tops.join(paths, ["g", "idx"]).select(
        F.col("source").alias("g"), F.lit(0).cast("long").alias("idx"), "path"))
    for nodes in reversed(rounds[1:-1]):
        paths = keep(descend(nodes, paths, height), "merkle-paths")
    paths = paths.join(subroots, paths["g"] == subroots["source"]).drop("source")
    found = proofs(leaves, paths, height, df.schema[id_col].dataType)
    known = F.lit(root["digest"] if root else None).cast("string")
    return found.select("id", "leaf", "subroot", known.alias("root"), "proof_sha256",
                        "folded_root", (F.col("folded_root") == known).alias("verified"))
