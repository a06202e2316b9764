"""Links between nodes that share a bucket key, without producing all pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import packed

#: (payloads of some nodes, payloads of others) -> which of them are linked.
Linked = Callable[[list | np.ndarray, list | np.ndarray], np.ndarray]
EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])
#: Bits of the filter of wanted nodes or keys: 4 MB, whatever the input.
FILTER_BITS = 1 << 25
#: Bits of one row of the filter.
ROW_BITS = 1 << 15


def spots(node: int | np.ndarray) -> tuple:
    """Two places of a node in the filter, from different bits of its number."""
    return node & (FILTER_BITS - 1), (node >> 30) & (FILTER_BITS - 1)


def bit_filter(nodes: DataFrame) -> np.ndarray:
    """Fixed-size filter of the nodes (column node): those outside are not wanted for sure."""
    number = F.col("node")
    both = F.array(number.bitwiseAND(F.lit(FILTER_BITS - 1)), F.shiftright(number, 30).bitwiseAND(F.lit(FILTER_BITS - 1)))
    placed = nodes.select(F.explode(both).alias("spot")).select(
        F.shiftright("spot", 15).alias("at"), F.col("spot").bitwiseAND(F.lit(ROW_BITS - 1)).alias("bit"))
    rows = placed.groupBy("at").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = np.zeros((FILTER_BITS // ROW_BITS, ROW_BITS // 8), np.uint8)
    for r in rows:
        out[r["at"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.ravel()


def passing(wanted: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Which nodes pass the filter."""
    found = np.ones(len(nodes), bool)
    for spot in spots(nodes):
        found &= (wanted[spot >> 3] >> (spot & 7).astype(np.uint8) & 1).astype(bool)
    return found


def star_edges(linked: np.ndarray, nodes: np.ndarray) -> list[tuple[int, int]]:
    """Each node of a component tied to the component's first: a linear number of edges."""
    left = np.ones(len(nodes), bool)
    edges = []
    for root in range(len(nodes)):
        if not left[root]:
            continue
        left[root] = False
        front = linked[root] & left
        while front.any():
            left &= ~front
            edges += [(int(nodes[root]), int(nodes[i])) for i in np.flatnonzero(front)]
            front = linked[front].any(0) & left
    return edges


def _run_edges(nodes: np.ndarray, parts: np.ndarray, payload, linked: Linked, inside: bool) -> list:
    """Edges within one run; between its two chunks only, unless ``inside``."""
    if inside:
        found = linked(payload, payload)
        return star_edges(found | found.T, nodes)
    one = parts == parts[0]
    if one.all():
        return []
    a, b = np.flatnonzero(one), np.flatnonzero(~one)
    pick = (lambda at: payload[at]) if isinstance(payload, np.ndarray) else (lambda at: [payload[i] for i in at])
    found = np.zeros((len(nodes), len(nodes)), bool)
    across = linked(pick(a), pick(b))
    found[np.ix_(a, b)] = across
    found[np.ix_(b, a)] = across.T
    return star_edges(found, nodes)


def bucket_links(rows: DataFrame, linked: Linked, limit: int, numeric: bool) -> DataFrame:
    """(u, v): node links found in shared buckets; components are those of all linked pairs.

    ``rows`` has key (long), node (long) and payload (long if ``numeric``, else binary
    of int64), a node at most once per key. Keys of one row leave first. A key of more
    than ``limit`` rows is cut into chunks by node hash and each pair of chunks is
    compared by a task of its own, so no key is ever whole in one task and every pair
    is still compared. A run returns a star per component, not its pairs.
    """
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / limit).cast("int")
    part = F.when(chunks == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("node"), chunks)).cast("int")
    others = F.transform(F.sequence(F.lit(0), chunks - 1), lambda x: F.struct(
        F.least(F.col("part"), x).alias("lo"), F.greatest(F.col("part"), x).alias("hi")))
    dealt = (
        rows.join(counts, "key").withColumn("part", part)
        .select("key", F.explode(others).alias("pair"), "part", "node", "payload")
        .select("key", "pair.lo", "pair.hi", "part", "node", "payload")
    )
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_runs = dealt.repartition(n, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            cuts = _cuts(table)
            yield from _emit(_all_edges(table, cuts[:-1], linked, numeric))
            rest = table.slice(int(cuts[-2])).combine_chunks() if len(cuts) > 1 else None
        if rest is not None:
            yield from _emit(_all_edges(rest, _cuts(rest), linked, numeric))

    return sorted_runs.mapInArrow(scan, "u bigint, v bigint")


def _cuts(table: pa.Table) -> np.ndarray:
    """Where runs of equal (key, lo, hi) begin, and the end."""
    if not table.num_rows:
        return np.zeros(1, np.int64)
    new = np.ones(table.num_rows, bool)
    same = np.ones(table.num_rows - 1, bool)
    for name in ("key", "lo", "hi"):
        values = table.column(name).to_numpy()
        same &= values[1:] == values[:-1]
    new[1:] = ~same
    return np.append(np.flatnonzero(new), table.num_rows)


def _all_edges(table: pa.Table, cuts: np.ndarray, linked: Linked, numeric: bool) -> list[tuple[int, int]]:
    if len(cuts) < 2:
        return []
    nodes, parts = table.column("node").to_numpy(), table.column("part").to_numpy()
    lo, hi = table.column("lo").to_numpy(), table.column("hi").to_numpy()
    if numeric:
        payload = table.column("payload").to_numpy()
    else:
        payload = [np.frombuffer(x, np.int64) for x in table.column("payload").slice(0, int(cuts[-1])).to_pylist()]
    edges: list[tuple[int, int]] = []
    sizes = np.diff(cuts)
    if numeric:
        twins = cuts[:-1][(sizes == 2) & (lo[cuts[:-1]] == hi[cuts[:-1]])]
        good = linked.pairs(payload[twins], payload[twins + 1])
        edges += list(zip(nodes[twins][good].tolist(), nodes[twins + 1][good].tolist()))
    for start, size in zip(cuts[:-1], sizes):
        inside = lo[start] == hi[start]
        if size < 2 or (numeric and size == 2 and inside):
            continue
        at = slice(int(start), int(start + size))
        edges += _run_edges(nodes[at], parts[at], payload[at], linked, bool(inside))
    return edges


def _emit(edges: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    if edges:
        unique = np.unique(np.array(edges, np.int64), axis=0)
        yield packed([unique[:, 0], unique[:, 1]], EDGES)
