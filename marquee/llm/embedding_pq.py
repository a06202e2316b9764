"""Near-duplicate vectors by product quantisation.

Unit vectors are filed under their nearest coarse centroid; the residual is coded per
subspace. A query scans the lists it may have a partner in, estimates distances by
table lookup (query subspace to code centroid, asymmetric), and what may be near enough
is compared by exact cosine in double precision.

Probes: two partners in different cells lie on either side of the bisector of the two
centroids, so the distances of both from it add up to at most their own distance t, and one
of the two is within t / 2 of it. That one finds the link: each vector probes all lists whose
bisector is within t / 2, and a link counts for both its ends in the list whose centroid is
nearer to the middle of the pair. So no partner is missed and none is counted twice.
Codes: an estimate differs from the true distance by at most the stored error of the
code, so what this cut drops is no partner.

The index is fitted on a bounded sample; every vector is indexed and queried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from marquee.llm.buckets import star_edges
from marquee.llm.common import hashed_sample, written
from marquee.operators.clusters import duplicate_clusters

#: Slack of the safe cuts for rounding.
SLACK = 1e-6


@dataclass(frozen=True)
class Quantiser:
    """``sample``: most vectors the centroids are fitted on, those with the smallest hash.

    Coarse lists: the square root of the number of distinct vectors, 16 to ``lists``.
    """

    cosine: float = 0.95
    sample: int = 16_384
    lists: int = 1024
    subspaces: int = 8
    codes: int = 64
    rounds: int = 8
    block: int = 1024


@dataclass
class Index:
    """Fitted centroids: at most ``sample`` vectors' worth, whatever the input."""

    coarse: np.ndarray
    books: list[np.ndarray]
    spans: list[slice]


def usable() -> F.Column:
    """Vectors of finite numbers, not all zero."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def unit(rows: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled first so that squares neither overflow nor vanish."""
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0)


def fitted_centroids(points: np.ndarray, count: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's algorithm from random points; an empty cell keeps its centroid."""
    start = np.random.default_rng(seed).permutation(len(points))[: min(count, len(points))]
    centres = points[start].copy()
    for _ in range(rounds):
        own = np.concatenate([squared(points[i : i + 4096], centres).argmin(1) for i in range(0, len(points), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        n = np.bincount(own, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def fit(points: np.ndarray, how: Quantiser, total: int) -> Index:
    """Coarse centroids and residual code books of unit vectors, for ``total`` vectors."""
    lists = min(how.lists, max(16, int(total**0.5)))
    coarse = fitted_centroids(points, lists, how.rounds, 1)
    rest = points - coarse[squared(points, coarse).argmin(1)]
    edges = np.linspace(0, points.shape[1], min(how.subspaces, points.shape[1]) + 1).astype(int)
    spans = [slice(int(a), int(b)) for a, b in zip(edges[:-1], edges[1:])]
    return Index(coarse, [fitted_centroids(rest[:, s], how.codes, how.rounds, i) for i, s in enumerate(spans)], spans)


def coded(index: Index, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of residuals, and how far each is from what its codes say."""
    codes = np.stack([squared(rest[:, s], b).argmin(1) for s, b in zip(index.spans, index.books)], 1).astype(np.uint8)
    again = np.concatenate([b[codes[:, i]] for i, b in enumerate(index.books)], 1)
    return codes, np.linalg.norm(rest - again, axis=1)


def probed(index: Index, points: np.ndarray, reach: float) -> np.ndarray:
    """(point, list): lists whose cell begins within ``reach`` of the point."""
    far = squared(points, index.coarse)
    own = far.argmin(1)
    apart = np.sqrt(squared(index.coarse, index.coarse))[own]
    beyond = (far - far[np.arange(len(points)), own][:, None]) / (2 * np.maximum(apart, 1e-12))
    return (beyond <= reach + SLACK) | (apart < 1e-9)


def near(index: Index, centre: np.ndarray, queries: np.ndarray, items: np.ndarray, codes: np.ndarray,
         error: np.ndarray, reach: float, cosine: float) -> np.ndarray:
    """Exact links (queries x items) of one list: table lookups, then cosine of what is left.

    The lookups of an item are rows of a table, so each is one copy of memory for all queries.
    """
    rest = queries - centre
    guess = np.zeros((len(items), len(queries)))
    looked = np.empty_like(guess)
    for i, (s, book) in enumerate(zip(index.spans, index.books)):
        guess += np.take(squared(book, rest[:, s]), codes[:, i], axis=0, out=looked, mode="clip")
    maybe = guess <= ((reach + error + SLACK) ** 2)[:, None]
    found = np.zeros((len(queries), len(items)), bool)
    x, q = np.nonzero(maybe)
    for at in range(0, len(q), 1 << 16):
        a, b = q[at : at + (1 << 16)], x[at : at + (1 << 16)]
        found[a, b] = np.einsum("ij,ij->i", queries[a], items[b]) >= cosine
    return found


def counted_here(index: Index, here: int, home: np.ndarray, guests: np.ndarray, items: np.ndarray,
                 a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of a guest (a, of list ``home``) and an item (b, of this list) have their middle nearer to this centroid.

    Equal distances go to the smaller list. The sums of a pair run in the same order from
    either side, so the two lists never both claim it and never both leave it.
    """
    out = np.empty(len(home), bool)
    norms = (index.coarse * index.coarse).sum(1)
    for at in range(0, len(home), 1 << 16):
        part = slice(at, at + (1 << 16))
        lo, hi = np.minimum(home[part], here), np.maximum(home[part], here)
        along = ((guests[a[part]] + items[b[part]]) * (index.coarse[lo] - index.coarse[hi])).sum(1)
        out[part] = np.where(along >= norms[lo] - norms[hi], lo, hi) == here
    return out


LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("n", pa.int64())])


def _vectors(column: pa.Array, kind: type) -> np.ndarray:
    return np.stack([np.frombuffer(x, kind) for x in column.to_pylist()]).astype(np.float64)


def vector_links(nodes: DataFrame, index: Index, how: Quantiser, kind: type) -> DataFrame:
    """(u, v, n) from nodes (node, copies, vec as bytes of ``kind``).

    Rows with null v carry n, copies linked to u that were found in one block; rows with v are
    edges, a star per component of a block. Lists are cut into blocks of items and of
    queries by counts, so a list with any share of the vectors is spread over tasks.
    """
    reach = float(np.sqrt(2 - 2 * how.cosine))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes_, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            raw = batch.column(2)
            points = unit(_vectors(raw, kind))
            for start in range(0, len(points), 2048):
                part = points[start : start + 2048]
                own = squared(part, index.coarse).argmin(1)
                q, lists = np.nonzero(probed(index, part, reach / 2))
                at = np.concatenate((np.arange(len(part)), q)) + start
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate((own, lists)).astype(np.int64)),
                     pa.array(np.concatenate((own, own[q])).astype(np.int64)),
                     pa.array(np.concatenate((np.zeros(len(part), bool), np.ones(len(q), bool)))),
                     pa.array(nodes_[at]), pa.array(copies[at]), raw.take(pa.array(at))],
                    names=["list", "home", "asks", "node", "copies", "vec"])

    filed = written(nodes.mapInArrow(
        file, "list bigint, home bigint, asks boolean, node bigint, copies bigint, vec binary"), "lists")
    sizes = filed.groupBy("list").agg(
        F.ceil(F.count_if(~F.col("asks")) / how.block).cast("int").alias("item_blocks"),
        F.ceil(F.count_if("asks") / how.block).cast("int").alias("query_blocks"),
    ).where("item_blocks > 0 and query_blocks > 0")
    own = F.when(F.col("asks"), F.pmod(F.xxhash64("node"), F.col("query_blocks"))).otherwise(
        F.pmod(F.xxhash64("node"), F.col("item_blocks"))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("asks"), F.col("item_blocks")).otherwise(F.col("query_blocks")) - 1)
    blocked = filed.join(sizes, "list").withColumn("own", own).withColumn("other", F.explode(others)).select(
        "list", F.when(F.col("asks"), F.col("other")).otherwise(F.col("own")).alias("items"),
        F.when(F.col("asks"), F.col("own")).otherwise(F.col("other")).alias("queries"), "home", "asks", "node", "copies", "vec")

    def compare(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        points = unit(_vectors(table.column("vec"), kind))
        q, x = np.flatnonzero(asks), np.flatnonzero(~asks)
        if not len(q) or not len(x):
            return pa.Table.from_batches([], LINKS)
        here, home = table.column("list")[0].as_py(), table.column("home").to_numpy()
        items = points[x]
        codes, error = coded(index, items - index.coarse[here])
        us, vs, ns = [], [], []
        back = np.zeros(len(x), np.int64)
        for start in range(0, len(q), 512):
            part = q[start : start + 512]
            found = near(index, index.coarse[here], points[part], items, codes, error, reach, how.cosine)
            linked = found & (node[part][:, None] != node[x][None, :])
            # a pair within the list is asked for from both ends, any other from one
            guest = home[part] != here
            a, b = np.nonzero(linked & guest[:, None])
            linked[a, b] = counted_here(index, here, home[part][a], points[part], items, a, b)
            back += copies[part][guest] @ linked[guest]
            total = linked @ copies[x]
            hit = total > 0
            us += node[part][hit].tolist()
            vs += [None] * int(hit.sum())
            ns += total[hit].tolist()
            for u, v in _forest(linked, node[part], node[x]):
                us.append(u)
                vs.append(v)
                ns.append(0)
        met = back > 0
        us += node[x][met].tolist()
        vs += [None] * int(met.sum())
        ns += back[met].tolist()
        return pa.table([pa.array(us, pa.int64()), pa.array(vs, pa.int64()), pa.array(ns, pa.int64())], schema=LINKS)

    return blocked.groupBy("list", "items", "queries").applyInArrow(compare, "u bigint, v bigint, n bigint")


def _forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Star edges of the components of a bipartite block."""
    a, b = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
    if not len(a):
        return []
    both = np.zeros((len(a) + len(b),) * 2, bool)
    both[: len(a), len(a) :] = linked[np.ix_(a, b)]
    both |= both.T
    return [(u, v) for u, v in star_edges(both, np.concatenate((left[a], right[b]))) if u != v]


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", how: Quantiser = Quantiser()) -> DataFrame:
    """(id, n_links, component_id, kept) for each row.

    Vectors link at cosine >= ``how.cosine``; those that are null, empty, zero or hold
    null or non-finite components link with nothing and are their own component. Equal
    vectors are one node with a count, so a group of copies costs one row, but each
    copy counts as a link. Vectors of different lengths never link. Repeated rows are
    copies of each other. Null ids are passed over when the smallest id is sought.
    """
    rows = vectors.select(F.col(f"`{vec_id}`").alias("id"), F.col(f"`{embedding}`").cast("array<double>").alias("v"))
    kinds = rows.where(usable()).select(F.size("v").alias("dim")).distinct()
    dims = [r["dim"] for r in kinds.orderBy("dim").collect()]  # one row per vector length
    flat = F.transform("v", lambda x: x + F.lit(0.0))  # -0.0 equals 0.0
    named = rows.select("id", F.when(usable(), flat).alias("v"))
    distinct = written(named.where("v is not null").groupBy("v").agg(
        F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")).withColumn(
        "node", F.monotonically_increasing_id()), "vectors")
    kind = np.float32 if vectors.schema[embedding].dataType == ArrayType(FloatType()) else np.float64
    parts = [_links_of(distinct.where(F.size("v") == dim), how, kind) for dim in dims]
    if parts:
        links = parts[0]
        for more in parts[1:]:
            links = links.unionByName(more)
        links = written(links, "links")
    else:
        links = distinct.select(F.col("node").alias("u"), F.col("node").alias("v"), F.col("copies").alias("n")).limit(0)
    grouped = duplicate_clusters(links.where("v is not null"), "u", "v").withColumnRenamed("id", "node")
    rooted = distinct.join(grouped, "node", "left").withColumn("root", F.coalesce("cluster", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    counts = links.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("linked"))
    classes = rooted.join(least, "root").join(counts, "node", "left").select(
        F.col("v").alias("_v"), "component_id", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    joined = named.join(classes, F.col("v") == F.col("_v"), "left")
    component = F.when(F.col("v").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return joined.select(
        F.col("id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _links_of(nodes: DataFrame, how: Quantiser, kind: type) -> DataFrame:
    """Links among distinct vectors of one length."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = [np.array(x, kind).tobytes() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vecs, pa.binary())],
                                             names=["node", "copies", "vec"])

    packed_nodes = nodes.select("node", "copies", "v").mapInArrow(pack, "node bigint, copies bigint, vec binary")
    sample = hashed_sample(packed_nodes, how.sample, "vec", "node").select("vec").toArrow()
    index = fit(unit(_vectors(sample.column("vec"), kind)), how, nodes.count())
    return vector_links(packed_nodes, index, how, kind)
