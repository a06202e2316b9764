"""Connected components of duplicate pairs, of a whole table or kept up batch by batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.session import cut_lineage, read_or_empty

#: Folders of stored clusters, so also the most values that the driver reads to choose folders.
BUCKETS = 256
STORED = "id bigint, cluster bigint, version bigint, bucket int"


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node hangs on its smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.join(least, "u").where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where(F.col("u") != F.col("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, hang on the smallest."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return moved.unionByName(own).where(F.col("u") != F.col("v")).distinct()


def _signature(edges: DataFrame):
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
    ).first()
    return row["n"], row["h"]


def duplicate_clusters(pairs: DataFrame, a: str = "id_a", b: str = "id_b") -> DataFrame:
    """(id, cluster) for every id in a pair; the cluster is its smallest id.

    Alternates the two star steps until nothing changes. Only the smallest
    neighbour of a node is ever aggregated, never its list of neighbours, so a
    cluster may hold any share of the rows. Each round ends in a reliable
    checkpoint; the driver sees a count and a hash.
    """
    edges = cut_lineage(
        pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u") != F.col("v")).distinct()
    )
    state = _signature(edges)
    while True:
        edges = cut_lineage(_small_star(_large_star(edges)))
        fresh = _signature(edges)
        if fresh == state:
            break
        state = fresh
    leaves = edges.select(F.col("u").alias("id"), F.col("v").alias("cluster"))
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("cluster")).distinct()
    return leaves.unionByName(roots)


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(BUCKETS)).cast("int")


def _in_buckets_of(keys: DataFrame, key: str, path: str) -> DataFrame:
    """The stored rows of the folders that can hold the keys; no other folder is read."""
    wanted = [r["b"] for r in keys.select(_bucket(key).alias("b")).distinct().collect()]  # at most BUCKETS
    return read_or_empty(keys.sparkSession, path, STORED).where(F.col("bucket").isin(wanted))


def stored_clusters_of(ids: DataFrame, path: str) -> DataFrame:
    """(id, cluster) of the given distinct ids, as far as they are stored."""
    rows = _in_buckets_of(ids, "id", f"{path}/by_id").join(ids.select("id"), "id", "left_semi")
    return rows.groupBy("id").agg(F.max_by("cluster", "version").alias("cluster"))


def add_pairs(pairs: DataFrame, path: str, version: int, a: str = "id_a", b: str = "id_b") -> None:
    """Stored clusters after further pairs; clusters that no pair touches are not read.

    The ends of the new pairs are replaced by their stored clusters, components are found
    among those alone, and only ids whose cluster changed are written: appended, once by id
    and once by cluster, the newest version of an id being valid. A cluster that joined a
    smaller one never returns, so its old members need no tombstones. Versions rise from one
    writer; a version run again, also after it ended between its two writes, changes nothing.
    Pairs with a null or of an id with itself are no pairs.
    """
    edges = pairs.select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v"))
    edges = cut_lineage(edges.where("u <> v").distinct())
    ends = edges.select(F.col("u").alias("id")).union(edges.select("v")).distinct()
    found = cut_lineage(
        ends.join(stored_clusters_of(ends, path), "id", "left")
        .select("id", F.coalesce("cluster", "id").alias("at"), F.col("cluster").isNull().alias("fresh"))
    )
    u = found.select(F.col("id").alias("u"), F.col("at").alias("id_a"))
    v = found.select(F.col("id").alias("v"), F.col("at").alias("id_b"))
    links = edges.join(u, "u").join(v, "v").select("id_a", "id_b").where("id_a <> id_b").distinct()
    joined = duplicate_clusters(links).select(F.col("id").alias("old"), F.col("cluster").alias("new"))
    moved = cut_lineage(joined.where("old <> new"))
    members = _in_buckets_of(moved, "old", f"{path}/by_cluster").join(moved, F.col("cluster") == F.col("old"))
    added = found.where("fresh").join(joined, F.col("id") == F.col("old"), "left")
    changed = members.select("id", F.col("new").alias("cluster")).unionByName(
        added.select("id", F.coalesce("new", "id").alias("cluster"))
    )
    rows = cut_lineage(changed.distinct().withColumn("version", F.lit(version).cast("bigint")))
    for key, name in (("cluster", "by_cluster"), ("id", "by_id")):
        out = rows.withColumn("bucket", _bucket(key)).repartition("bucket", F.pmod("id", F.lit(16)))
        out.write.mode("append").partitionBy("bucket").parquet(f"{path}/{name}")


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(id, cluster) of every stored id."""
    rows = read_or_empty(spark, f"{path}/by_id", STORED)
    return rows.groupBy("id").agg(F.max_by("cluster", "version").alias("cluster"))
