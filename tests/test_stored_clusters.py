"""Clusters kept up by new pairs equal a run over all pairs so far."""

import random

from marquee.operators import clusters as C
from marquee.session import job_folder


def brute(pairs):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in pairs:
        if u is not None and v is not None and u != v:
            lo, hi = sorted((top(u), top(v)))
            root[hi] = lo
    return {x: top(x) for x in root}


def pairs_of(spark, rows):
    return spark.createDataFrame(rows, "id_a bigint, id_b bigint")


def stored(spark, path):
    rows = C.read_clusters(spark, path).collect()
    assert len({r["id"] for r in rows}) == len(rows)
    return {r["id"]: r["cluster"] for r in rows}


def test_batches_equal_a_full_run(spark):
    rng, path, seen = random.Random(5), job_folder(spark, "clusters"), []
    batches = [[(rng.randrange(90), rng.randrange(90)) for _ in range(n)] for n in (25, 20, 25)]
    batches[1] += [(None, 3), (4, None), (7, 7), *batches[0][:3]]
    for version, batch in enumerate(batches):
        seen += batch
        C.add_pairs(pairs_of(spark, batch), path, version)
        assert stored(spark, path) == brute(seen)
    C.add_pairs(pairs_of(spark, batches[2]), path, 2)  # run again
    C.add_pairs(pairs_of(spark, []), path, 3)
    assert stored(spark, path) == brute(seen)


def test_a_batch_that_ended_between_its_writes_is_healed(spark):
    path = job_folder(spark, "clusters")
    C.add_pairs(pairs_of(spark, [(5, 6), (8, 9)]), path, 0)
    half = spark.createDataFrame([(i, 5, 1, 0) for i in (8, 9)], C.STORED).drop("bucket").withColumn("bucket", C._bucket("cluster"))
    half.write.mode("append").partitionBy("bucket").parquet(f"{path}/by_cluster")
    C.add_pairs(pairs_of(spark, [(6, 9)]), path, 1)
    C.add_pairs(pairs_of(spark, [(1, 8)]), path, 2)
    assert stored(spark, path) == dict.fromkeys((1, 5, 6, 8, 9), 1)


def test_folders_of_other_ids_are_not_read(spark, capsys):
    path = job_folder(spark, "clusters")
    C.add_pairs(pairs_of(spark, [(2 * i, 2 * i + 1) for i in range(200)]), path, 0)
    ids = spark.createDataFrame([(7,)], "id bigint")
    found = C.stored_clusters_of(ids, path)
    assert [tuple(r) for r in found.collect()] == [(7, 6)]
    found.explain("formatted")
    assert "bucket" in capsys.readouterr().out.split("PartitionFilters")[1].split("\n")[0]
