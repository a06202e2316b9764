"""Merkle manifests against a plain tree."""

import hashlib

import pytest
from pyspark.sql import functions as F

from marquee.llm import merkle_manifest as mm
from marquee.llm.merkle_manifest import Appender, Shape, folded, manifest, row_digest

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(digests, arity=3):
    """(top, witness of each) by whole levels."""
    paths, spots, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        runs = [level[i : i + arity] for i in range(0, len(level), arity)]
        for path, spot in zip(paths, spots):
            run, at = runs[spot // arity], spot % arity
            path.append(f"{''.join(run[:at])}>{''.join(run[at + 1:])};")
        spots = [s // arity for s in spots]
        level = [h(*r) for r in runs]
    return level[0], ["".join(p) for p in paths]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 28, 81, 100])
def test_appending_equals_whole_levels(n):
    digests = [h(str(i)) for i in range(n)]
    tree = Appender(3)
    leaves = [tree.append(d) for d in digests]
    top, paths = plain_tree(digests)
    assert tree.finish(None).digest == top and [x.path() for x in leaves] == paths


def plain_manifest(rows):
    leaf = {i: h(*["-" if r[f] is None else f"{len(str(r[f]).encode())}:{r[f]}" for f in FIELDS]) for i, r in enumerate(rows)}
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(r["source"], []).append(i)
    for members in groups.values():
        members.sort(key=lambda i: (rows[i]["doc_id"] is not None, rows[i]["doc_id"] or 0, leaf[i]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([leaf[i] for i in groups[s]]) for s in names}
    root, upper = plain_tree([trees[s][0] for s in names])
    out = []
    for s, above in zip(names, upper):
        for i, path in zip(groups[s], trees[s][1]):
            out.append((rows[i]["doc_id"], leaf[i], trees[s][0], root, path + above))
    return sorted(out, key=repr)


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_manifest_equals_plain_tree_at_any_block_size(spark, make_docs, odd_docs, levels):
    rows = [(i * 7 % 500, f"text {i}\n{'é' * (i % 5)}", "en", f"s{i % 9 if i % 3 else 0}") for i in range(300)]
    docs = make_docs(rows).unionByName(odd_docs).repartition(5)
    found = manifest(docs, row_digest(FIELDS), shape=Shape(levels=levels)).collect()
    got = sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["witness"]) for r in found), key=repr)
    assert got == plain_manifest(docs.collect())
    assert all(folded(r["leaf"], r["witness"]) == r["root"] for r in found)


def test_equal_rows_fill_one_tree(spark, make_docs):
    docs = make_docs([(1, "same", "en", "a")] * 40)
    found = manifest(docs, row_digest(FIELDS), shape=Shape(levels=2)).collect()
    assert len(found) == 40 and sorted(r["witness"] for r in found) == sorted(plain_tree([found[0]["leaf"]] * 40)[1])


def test_one_row_and_no_rows(spark, make_docs, no_docs):
    assert manifest(no_docs, row_digest(FIELDS)).count() == 0
    (one,) = manifest(make_docs([(None, None)]), row_digest(FIELDS)).collect()
    assert one["leaf"] == one["subroot"] == one["root"] and one["witness"] == ""


def test_tampering_is_seen(spark, make_docs):
    docs = make_docs([(i, f"a{i}\nb", "en", "x") for i in range(20)])
    found = manifest(docs, row_digest(FIELDS), keep={"root2": F.lit("kept")})
    bad = found.withColumn("leaf", F.when(F.col("doc_id") == 3, F.sha2(F.lit("x"), 256)).otherwise(F.col("leaf")))
    rows = mm.checked(bad.withColumn("verified", F.lit(7))).collect()
    assert {r["doc_id"] for r in rows if not r["verified"]} == {3} and {r["root2"] for r in rows} == {"kept"}
    lost = mm.checked(found.withColumn("witness", F.lit(None).cast("string"))).collect()
    assert all(r["folded_root"] is None and r["verified"] is False for r in lost)
