"""A Merkle manifest of a dataset whose changed leaves are versions of a persistent tree.

Rows are leaves: the SHA-256 of their fields, each written with its length. The leaves of a tree (one per value
of ``tree``) stand in the order of ``doc_id``; runs of ``arity`` nodes become the hash of their hashes until one
node, the subroot, remains, and the subroots in the order of their trees end in the root in the same way.

``arity ** levels`` consecutive leaves are an aligned block: what a task builds at once, whatever the size of
the tree. The roots of all blocks are the leaves of the next stage, so a tree of any size is a few grouped
passes, each ``arity ** levels`` times smaller. Going down again, every node gets its path, the siblings left and
right of it at each level up to the root, from its block and the path of the block's own node above.

A changed leaf never rebuilds anything. It makes a version that shares all nodes of the tree but those on its
path: only these are hashed again, first the ancestors inside the leaf's block, then, along the path that came
down from the upper stages, those above it. What the version's root differs by is seen against the true root.

Defined cases: a missing field is written ``-``, so it differs from an empty one; a missing tree is one of its
own, the first; missing ids come first, equal ids in the order of their leaves; equal rows are leaves of their
own; a single leaf is its own subroot; no rows give no rows. Other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.llm.ranks import positions
from lotwise.session import via_table

ARITY = 8
LEVELS = 3


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(fields: Sequence[Column]) -> Column:
    """The hash of a row: each field as its length in bytes, a colon and its value, ``-`` if it is missing."""
    values = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v), F.lit(":"), v), F.lit("-")) for v in values]), 256)


class Block:
    """Consecutive nodes of one tree and the levels above them that belong to the same block.

    ``total`` is the size of the whole tree: where a tree ends inside the block, so do the levels.
    """

    def __init__(self, nodes: list[str], total: int, arity: int, levels: int):
        self.arity, self.levels = arity, [nodes]
        while total > 1 and len(self.levels) <= levels:
            below = self.levels[-1]
            self.levels.append([digest("".join(below[i : i + arity])) for i in range(0, len(below), arity)])
            total = -(-total // arity)

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def paths(self, above: list[str]) -> list[list[str]]:
        """For every node of the lowest level the siblings left and right of it, level by level, then ``above``.
        Nodes with the same parent share the rest of their paths."""
        paths = [above]
        for nodes in reversed(self.levels[:-1]):
            paths = [
                ["".join(nodes[i - i % self.arity : i]), "".join(nodes[i + 1 : i - i % self.arity + self.arity]), *paths[i // self.arity]]
                for i in range(len(nodes))
            ]
        return paths


def version_root(leaf: str, path: list[str]) -> str:
    """The root of the version that ``leaf`` makes: its ancestors are copied, all siblings shared."""
    for left, right in zip(path[0::2], path[1::2]):
        leaf = digest(left + leaf + right)
    return leaf


def _nodes(table: pa.Table, arity: int, levels: int) -> tuple[pa.Table, Block]:
    table = table.sort_by("pos")
    nodes = [x.hex() for x in table.column("node").to_pylist()]
    return table, Block(nodes, table.column("total")[0].as_py(), arity, levels)


def _parents(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    size = arity**levels

    def build(table: pa.Table) -> pa.Table:
        table, block = _nodes(table, arity, levels)
        return pa.table(
            {
                "t": table.column("t").slice(0, 1),
                "pos": [table.column("pos")[0].as_py() // size],
                "total": [-(-table.column("total")[0].as_py() // size)],
                "node": [bytes.fromhex(block.root)],
            }
        )

    blocks = nodes.select("t", "pos", "total", "node").groupBy("t", F.expr(f"pos div {size}"))
    return blocks.applyInArrow(build, "t string, pos bigint, total bigint, node binary")


def _stages(nodes: DataFrame, arity: int, levels: int) -> list[DataFrame]:
    """``nodes`` and the nodes of every further stage; the last has a node per tree."""
    stages = [nodes]
    while (stages[-1].agg(F.max("total")).first()[0] or 0) > 1:
        stages.append(via_table(_parents(stages[-1], arity, levels), "nodes"))
    return stages


def _meet(nodes: DataFrame, above: DataFrame, arity: int, levels: int, work, schema: str) -> DataFrame:
    """Calls ``work(table, block, paths, row)`` for the nodes of every block and the row of its own node above."""
    size = arity**levels

    def build(below: pa.Table, over: pa.Table) -> pa.Table:
        row = over.to_pylist()[0]
        below, block = _nodes(below, arity, levels)
        return work(below, block.paths(row["path"]), row)

    left = nodes.withColumn("block", F.expr(f"pos div {size}")).groupBy("t", "block")
    return left.cogroup(above.withColumnRenamed("pos", "block").groupBy("t", "block")).applyInArrow(build, schema)


_ABOVE = "t string, pos bigint, subroot string, path array<string>"


def _descend(stages: list[DataFrame], above: DataFrame, arity: int, levels: int) -> DataFrame:
    """The rows that stand above the blocks of the first stage, from those above its trees."""

    def work(table: pa.Table, paths: list[list[str]], row: dict) -> pa.Table:
        n = table.num_rows
        return pa.table(
            {
                "t": table.column("t"),
                "pos": table.column("pos"),
                "subroot": pa.array([row["subroot"]] * n, pa.string()),
                "path": pa.array(paths, pa.list_(pa.string())),
            }
        )

    for nodes in reversed(stages[1:-1]):
        above = via_table(_meet(nodes, above, arity, levels, work, _ABOVE), "above")
    return above


def manifest(
    docs: DataFrame,
    fields: Sequence[str],
    changed: Sequence[Column],
    where: Column,
    doc_id: str = "doc_id",
    tree: str = "lang",
    arity: int = ARITY,
    levels: int = LEVELS,
    proofs: bool = False,
) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``, a row per row of ``docs``.

    ``fields`` are the columns of a leaf, ``changed`` their values in the version that rows with ``where`` make.
    The proof is the text of all siblings, level by level from the leaf to the root, left to right;
    ``proofs=True`` adds it in full. ``verified``: the version still has the root of the tree.
    """
    name = F.col(f"`{tree}`").cast("string")
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), name), F.lit("")).alias("t"),  # a missing tree sorts first
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.unhex(leaf([F.col(f"`{f}`") for f in fields])).alias("node"),
        F.when(where, F.unhex(leaf(changed))).alias("version"),
    )
    leaves = via_table(positions(rows, "t", ["doc_id", "node"]), "leaves")
    stages = _stages(leaves, arity, levels)
    tops = positions(stages[-1].select(F.lit("").alias("t"), F.col("t").alias("name"), "node"), "t", ["name"])
    top_stages = _stages(via_table(tops, "tops"), arity, levels)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    schema += ", proof string" if proofs else ""
    last = top_stages[-1].first()
    if last is None:
        return docs.sparkSession.createDataFrame([], schema)
    root = last["node"].hex()

    def place(table: pa.Table, paths: list[list[str]], row: dict) -> pa.Table:
        return pa.table(
            {
                "t": table.column("name"),
                "pos": pa.array([0] * table.num_rows, pa.int64()),
                "subroot": [x.hex() for x in table.column("node").to_pylist()],
                "path": pa.array(paths, pa.list_(pa.string())),
            }
        )

    start = docs.sparkSession.createDataFrame([("", 0, root, [])], _ABOVE)
    subroots = via_table(
        _meet(top_stages[0], _descend(top_stages, start, arity, levels), arity, levels, place, _ABOVE), "subroots"
    )

    def prove(table: pa.Table, paths: list[list[str]], row: dict) -> pa.Table:
        own = [x.hex() for x in table.column("node").to_pylist()]
        versions = [x.hex() if x is not None else o for x, o in zip(table.column("version").to_pylist(), own)]
        folded = [version_root(x, p) for x, p in zip(versions, paths)]
        texts = ["".join(p) for p in paths]
        n = table.num_rows
        return pa.table(
            {
                "doc_id": table.column("doc_id"),
                "leaf": own,
                "subroot": pa.array([row["subroot"]] * n, pa.string()),
                "root": pa.array([root] * n, pa.string()),
                "proof_sha256": [digest(x) for x in texts],
                "folded_root": folded,
                "verified": [x == root for x in folded],
                **({"proof": texts} if proofs else {}),
            }
        )

    return _meet(leaves, _descend(stages, subroots, arity, levels), arity, levels, prove, schema)
