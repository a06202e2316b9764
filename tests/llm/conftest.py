import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text, lang, source) with an extra column that clashes with operator names."""

    def make(rows):
        full = [(*r, *[None] * (4 - len(r)), None if r[1] is None else len(r[1]), "x") for r in rows]
        return spark.createDataFrame(
            full, "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string")

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls everywhere, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"wort{i % 977} über" for i in range(60_000))
    prose = "the quick brown fox jumps over the lazy dog and runs far away from the old mill by the river"
    return make_docs([
        (1, None, None, None), (2, "", "en", "a"), (None, "a b c", "en", None), (3, " \n\t ", "de", "b"),
        (4, prose, "en", "a"), (4, prose, "en", "a"), (5, prose, "en", "a"), (6, long, "de", "b"),
        (None, None, None, None), (7, "▁  日本語 🙂 \x00 x", "ja", "c"), (8, "!!! ??? 123", None, "c"),
    ])


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
