"""Many terms in one walk over a text, against one test per term."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marquee import fixed_values as V
from marquee.functions import text as X
from marquee.operators import categorize as C


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text("ab c.|é😀", max_size=4), max_size=12), st.lists(st.text("ab c.|é😀", max_size=12), min_size=1, max_size=20))
def test_terms_equal_contains(spark, terms, texts):
    rows = spark.createDataFrame([(t,) for t in [*texts, "", None]], "t string")
    found = rows.select("t", X.terms_in(F.col("t"), terms).alias("found")).collect()
    for r in found:
        expected = None if r["t"] is None else {t for t in terms if t in r["t"]}
        assert (None if r["found"] is None else set(r["found"])) == expected
        assert r["found"] is None or len(set(r["found"])) == len(r["found"])


def test_overlapping_and_nested_terms(spark):
    rows = spark.createDataFrame([("startup artist party",), ("ART",), ("x" * 200_000 + "opera",)], "t string")
    terms = ["art", "artist", "start", "startup", "tup a", "party", "opera"]
    found = [sorted(r["f"]) for r in rows.select(X.terms_in(F.col("t"), terms).alias("f")).collect()]
    assert found == [["art", "artist", "party", "start", "startup", "tup a"], [], ["opera"]]


def test_categories_with_repeated_and_no_keywords(spark, make_listings):
    rows = make_listings([{"id": 1, "title": "Jazz night"}, {"id": 2}])
    twice = C.classify(rows.drop("category"), keywords={"A": ["night"], "B": ["jazz", "JAZZ"]}, venues={}, priorities={})
    assert [r["category"] for r in twice.orderBy("id").collect()] == ["B", "Other"]
    none = C.classify_multi(rows, keywords={"A": []}).orderBy("id")
    assert [r["categories"] for r in none.collect()] == [["Other"], ["Other"]]
    assert C.classify(rows.limit(0), keywords=V.CATEGORY_KEYWORDS).count() == 0
