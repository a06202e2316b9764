"""Merkle manifest of a dataset, with a witness for every row.

Leaves are digests of rows. The leaves of a group, in their order, are the ground level
of a tree: runs of ``arity`` consecutive nodes become their parent, until one node, the
group's subroot, remains. The subroots, in the order of their groups, give the root the
same way.

Trees grow by appending. A node that joins an open run learns its left siblings at once,
and every later sibling extends the witnesses of those before it; all leaves below a node
share its part of their witness. A tree is cut into aligned blocks of ``arity ** levels``
leaves that tasks append on their own; the roots of the blocks are appended to a next,
smaller tree, and so on. No task holds more than one block, however large a group is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import bounded_batches, widened, written


@dataclass(frozen=True)
class Shape:
    """Children of a node, and levels of a block; the root does not depend on the levels."""

    arity: int = 3
    levels: int = 8

    @property
    def span(self) -> int:
        return self.arity**self.levels


def joined_digest(text: str) -> str:
    """Lower-case hex SHA-256 of a text."""
    return hashlib.sha256(text.encode()).hexdigest()


# -- one block, appended leaf by leaf -----------------------------------------------------


class Node:
    """A node with what is known of its witness: siblings to its left and, so far, to its right."""

    __slots__ = ("digest", "left", "right", "up")

    def __init__(self, digest: str):
        self.digest, self.left, self.right, self.up = digest, "", "", None

    def path(self) -> str:
        """``left>right;`` of each level from this node to the top; digests as hex text."""
        node, steps = self, []
        while node.up is not None:
            steps.append(f"{node.left}>{node.right};")
            node = node.up
        return "".join(steps)


class Appender:
    """A growing tree: per level the nodes of the run still open."""

    def __init__(self, arity: int):
        self.arity = arity
        self.open: list[list[Node]] = []
        self.count: list[int] = []

    def append(self, digest: str) -> Node:
        node = Node(digest)
        self._place(0, node)
        return node

    def _place(self, level: int, node: Node) -> None:
        while True:
            if level == len(self.open):
                self.open.append([])
                self.count.append(0)
            run = self.open[level]
            node.left = "".join(n.digest for n in run)
            for earlier in run:
                earlier.right += node.digest
            run.append(node)
            self.count[level] += 1
            if len(run) < self.arity:
                return
            node = self._close(level)
            level += 1

    def _close(self, level: int) -> Node:
        run, self.open[level] = self.open[level], []
        parent = Node(joined_digest("".join(n.digest for n in run)))
        for node in run:
            node.up = parent
        return parent

    def finish(self, levels: int | None) -> Node:
        """Closes the open runs and returns the top: after so many levels, or where one node remains."""
        level = 0
        while level != levels and (levels is not None or self.count[level] > 1):
            if self.open[level]:
                self._place(level + 1, self._close(level))
            level += 1
        return self.open[level][0]


# -- positions ----------------------------------------------------------------------------


def ranked(rows: DataFrame, tree: str, order: list[Column]) -> DataFrame:
    """Adds pos (0, 1, ... in each tree by ``order``) and n (rows of the tree); null is a tree of its own.

    Range partitions are sorted and numbered, and their counts per tree are added up, so a
    tree may spread over all tasks. Rows alike in ``order`` come in any order.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(tree).asc_nulls_first(), *order]
    # equal rows are told apart by their place, so that copies of one row fill several ranges
    numbered = rows.withColumn("_tie", F.monotonically_increasing_id())
    dealt = numbered.repartitionByRange(parts, *keys, F.col("_tie")).sortWithinPartitions(*keys, F.col("_tie"))
    held = written(dealt.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "ranked")
    held = held.withColumn("_part", F.shiftright("_at", 33))
    counts = held.groupBy("_part", F.col(tree).alias("_tree")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("_tree")
    running = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = counts.select(
        F.col("_part").alias("_p"), "_tree", "_first",
        (F.sum("_n").over(running) - F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias("n"))
    found = held.join(offsets, (F.col("_part") == F.col("_p")) & F.col(tree).eqNullSafe(F.col("_tree")))
    return found.withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop(
        "_at", "_part", "_p", "_tree", "_first", "_before")


# -- blocks of all trees --------------------------------------------------------------------


def _by_block(rows: DataFrame) -> DataFrame:
    """Rows of one block side by side, in order; no two blocks need share a task."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "tree", "block").sortWithinPartitions("tree", "block", "pos")


def _blocks(batches: Iterator[pa.RecordBatch], wide: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of each block; the first two columns are the key."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(wide))):
            if row[:2] != key:
                if held:
                    yield key, held
                key, held = row[:2], []
            held.append(row)
    if held:
        yield key, held


def block_roots(nodes: DataFrame, shape: Shape) -> DataFrame:
    """The next level of trees: (tree, pos, digest, n) with a node for each block of (tree, pos, digest, n)."""
    rows = nodes.select("tree", F.floor(F.col("pos") / shape.span).cast("bigint").alias("block"), "pos", "digest", "n")
    schema = nodes.select("tree", "pos", "digest", "n").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        out: list[tuple] = []

        def made(first: pa.RecordBatch) -> pa.Schema:
            return pa.schema([("tree", first.schema.field(0).type), ("pos", pa.int64()), ("digest", pa.binary()), ("n", pa.int64())])

        def watched():
            nonlocal kinds
            for batch in batches:
                kinds = kinds or made(batch)
                yield batch

        for (tree, block), held in _blocks(watched(), 5):
            grown, n = Appender(shape.arity), held[0][4]
            for row in held:
                grown.append(row[3].hex())
            top = grown.finish(None if n <= shape.span else shape.levels)
            out.append((tree, block, bytes.fromhex(top.digest), -(-n // shape.span)))
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)

    return _by_block(rows).mapInArrow(run, schema)


def witnessed(nodes: DataFrame, above: DataFrame, shape: Shape) -> DataFrame:
    """(tree, pos, digest, path, subroot, root, kept) of the nodes (tree, pos, digest, n, kept).

    ``above`` holds (tree, pos, path, subroot, root) of the node of each block. It travels as
    the first row of its block, so neither side is broadcast or repeated.
    """
    kept = nodes.schema["kept"].dataType
    own = nodes.select("tree", F.floor(F.col("pos") / shape.span).cast("bigint").alias("block"), "pos", "digest", "n",
                       *[F.lit(None).cast("string").alias(c) for c in ("path", "subroot", "root")], "kept")
    marks = above.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("bigint").alias("pos"),
                         F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("bigint").alias("n"),
                         "path", "subroot", "root", F.lit(None).cast(kept).alias("kept"))
    schema = own.select("tree", "pos", "digest", "path", "subroot", "root", "kept").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: pa.Schema | None = None

        def watched():
            nonlocal kinds
            for batch in batches:
                if kinds is None:
                    kinds = pa.schema([batch.schema.field(i) for i in (0, 2, 3, 5, 6, 7, 8)])
                yield batch

        for (tree, _), held in _blocks(watched(), 9):
            (*_, rest, subroot, root, _), rows = held[0], held[1:]
            grown = Appender(shape.arity)
            leaves = [grown.append(row[3].hex()) for row in rows]
            grown.finish(None if rows[0][4] <= shape.span else shape.levels)
            for start in range(0, len(rows), 2000):
                part = [(tree, row[2], row[3], leaf.path() + rest, subroot, root, row[8])
                        for row, leaf in zip(rows[start : start + 2000], leaves[start : start + 2000])]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*part), kinds)], schema=kinds)

    return _by_block(own.unionByName(marks)).mapInArrow(run, schema)


def _most(nodes: DataFrame) -> int:
    return nodes.agg(F.max("n")).first()[0] or 0


def _levels(nodes: DataFrame, shape: Shape) -> list[DataFrame]:
    """The nodes, their block roots, the roots of blocks of those, ... until each tree has one node."""
    held = [nodes]
    while _most(held[-1]) > 1:
        held.append(written(block_roots(held[-1], shape), "block-roots"))
    return held


def _descend(held: list[DataFrame], above: DataFrame, shape: Shape) -> DataFrame:
    """Witnesses of the first of ``_levels``, from those of the tops."""
    for depth in range(len(held) - 2, 0, -1):
        inner = held[depth].withColumn("kept", F.lit(None).cast("string"))
        above = written(witnessed(inner, above, shape), "witnesses")
    if len(held) == 1:  # every tree is its own top
        return held[0].join(above.select(F.col("tree").alias("_t"), "path", "subroot", "root"), F.col("tree").eqNullSafe(F.col("_t"))).select(
            "tree", "pos", "digest", "path", "subroot", "root", "kept")
    return witnessed(held[0], above, shape)


def row_digest(fields: list[str | Column]) -> Column:
    """SHA-256 over the fields: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    parts = []
    for field in fields:
        text = (F.col(f"`{field}`") if isinstance(field, str) else field).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def manifest(
    rows: DataFrame, leaf: Column, group: str = "source", order: str = "doc_id",
    keep: dict[str, Column] | None = None, shape: Shape = Shape(),
) -> DataFrame:
    """A witness for each row: the ``order`` column, leaf, subroot, root, witness and the kept columns.

    ``leaf`` is the hex digest of a row. The rows of a group come by ``order``, null first,
    then by leaf; groups by their UTF-8 bytes, null first. ``witness`` holds ``left>right;``
    of each level from the leaf to the root, digests as hex text; a node without siblings
    has ``>;``. Repeated rows are leaves of their own. An empty table gives no rows.
    """
    bounded_batches(rows.sparkSession)
    keep = keep or {}
    carried = F.struct(F.col(f"`{order}`").alias("order"), *[c.alias(f"k{i}") for i, c in enumerate(keep.values())])
    leaves = written(rows.select(
        F.col(f"`{group}`").cast("string").alias("tree"), F.unhex(leaf).alias("digest"), carried.alias("kept")), "leaves")
    placed = written(ranked(leaves, "tree", [F.col("kept.order").asc_nulls_first(), F.col("digest")]), "placed")
    levels = _levels(placed, shape)
    tops = levels[-1].select(F.lit(0).alias("tree"), F.col("digest"), F.struct(F.col("tree").alias("name")).alias("kept"))
    forest = _levels(written(ranked(tops, "tree", [F.col("kept.name").asc_nulls_first()]), "subroots"), shape)
    summit = forest[-1].select(
        "tree", "pos", F.lit("").alias("path"), F.lit(None).cast("string").alias("subroot"), F.lower(F.hex("digest")).alias("root"))
    named = written(_descend(forest, summit, shape).select(
        F.col("kept.name").alias("tree"), F.lit(0).cast("bigint").alias("pos"), "path",
        F.lower(F.hex("digest")).alias("subroot"), "root"), "subroot-witnesses")
    found = _descend(levels, named, shape)
    return found.select(
        F.col("kept.order").alias(order), F.lower(F.hex("digest")).alias("leaf"), "subroot", "root", F.col("path").alias("witness"),
        *[F.col(f"kept.k{i}").alias(name) for i, name in enumerate(keep)])


def proof_text(path: str) -> str:
    """The siblings of a witness, level by level, left to right."""
    return path.replace(">", "").replace(";", "")


def folded(leaf: str, path: str) -> str:
    """The root that a leaf and a witness give."""
    for step in path.split(";")[:-1]:
        left, right = step.split(">")
        leaf = joined_digest(left + leaf + right)
    return leaf


def checked(rows: DataFrame, leaf: str = "leaf", witness: str = "witness", root: str = "root") -> DataFrame:
    """All columns but the witness, with proof_sha256, folded_root (from ``leaf``) and verified.

    Null leaves or witnesses fold to null and are not verified. Columns of ``rows`` with an
    added name are replaced.
    """
    added = ["proof_sha256", "folded_root", "verified"]
    own = [c for c in rows.columns if c not in (witness, *added)]
    picked = rows.select(*[F.col(f"`{c}`") for c in own], F.col(f"`{witness}`").alias("_witness"))
    at = own.index(leaf), own.index(root), len(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                made = []
                for own_leaf, own_root, path in zip(*(part.column(i).to_pylist() for i in at)):
                    if own_leaf is None or path is None:
                        made.append((None, None, False))
                        continue
                    top = folded(own_leaf, path)
                    made.append((joined_digest(proof_text(path)), top, top == own_root))
                columns = [pa.array(list(c), t) for c, t in zip(zip(*made), (pa.string(), pa.string(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], names=[*own, *added])

    return picked.mapInArrow(run, widened(picked.drop("_witness").schema, "proof_sha256 string, folded_root string, verified boolean"))
