"""Toxicity against plain matching, planted lexicons and held-out labels."""

import re

import pytest
from pyspark.sql import functions as F

from marquee.llm import queries, toxicity
from marquee.llm.common import fold

MIDDLE = "/root/testdata/sf0.01"


def test_folding():
    assert toxicity.fold_text("Yоu 1D10T, st@pid!!  tra$h #42") == " you 1d1ot stapid trash 42 "
    assert toxicity.fold_text("ｉｄｉｏｔ i\u200bdi\u0335ot ıdiot") == " idiot idiot idiot "
    assert toxicity.fold_text(None) == toxicity.fold_text(" \n") == toxicity.fold_text("!!") == " "


def slow_hits(folded, lexicon):
    """Every term at every word, spelling by spelling."""
    out, padded = {}, folded
    for at in [m.start() for m in re.finditer(" ", folded)][:-1]:
        best = 0.0
        for term, weight in lexicon.terms.items():
            pattern = "".join(f"[{c}1]" if c in "il" and sum(x in "il" for x in term[:i]) < 4 else re.escape(c) for i, c in enumerate(term))
            if re.match(pattern, padded[at:]):
                best = max(best, weight)
        if best:
            out[at] = best
    spared = set()
    for phrase in lexicon.exceptions:
        for m in re.finditer(f"(?={re.escape(phrase)})", folded):
            spared |= {m.start() + i for i, c in enumerate(phrase[:-1]) if c == " "}
    return {at: w for at, w in out.items() if at not in spared}


def test_matcher_equals_plain_matching():
    lexicon = toxicity.Lexicon({" idiot": 2.0, " idiotic": 5.0, " clown ": 3.0, " scum": 1.0}, [" clown fish ", " class clown "])
    matcher = toxicity.Matcher(lexicon)
    for text in ["an idiot, idiotic; 1d10ts", "clown fish and clown", "clown", "the class clown fish clown", "c1own scumbag clowns",
                 "miscum", "", "IDIOT idiot", "clown clown fish"]:
        folded = toxicity.fold_text(text)
        assert matcher.hits(folded) == slow_hits(folded, lexicon), text
    assert toxicity.Matcher(toxicity.Lexicon({})).hits(" clown ") == {}


def test_odd_rows_and_no_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 0), (None, 1), (5, None), (99, 1)], "doc_id bigint, toxic int")
    for lexicon in (toxicity.learn_lexicon(odd_docs, labels), toxicity.learn_lexicon(no_docs, labels)):
        assert lexicon.terms == {}
        rows = toxicity.score_texts(odd_docs.withColumn("score", F.lit("x")), lexicon).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in rows)
    assert toxicity.score_texts(no_docs, toxicity.Lexicon({" a": 1.0})).count() == 0


def test_lexicon_is_learned_with_its_exceptions(spark, make_docs):
    """Words beginning with 'zorg' are toxic; 'zorgon' alone is harmless; one look-alike spelling is found."""
    import random

    rng = random.Random(1)
    plain = ["".join(rng.choice("abcdefghkmn") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        words = rng.choices(plain, k=40)
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(40)] = "zorg" + rng.choice(["a", "uk", "ets", "on"])
        elif i % 7 == 0:
            words[rng.randrange(40)] = "zorgon"
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(1000, " ".join(plain[:20] + ["zοrgа", "Z0RGUK"] + plain[20:30])), (1001, " ".join(plain[:20] + ["zorgon"])), (1002, None)]
    docs = make_docs(rows)
    lexicon = toxicity.learn_lexicon(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert list(lexicon.terms) == [" zorg"] and " zorgon " in lexicon.exceptions
    found = {r["doc_id"]: r["predicted"] for r in toxicity.score_texts(docs, lexicon).collect()}
    wrong = [i for i, toxic in labels if found[i] != toxic]
    assert len(wrong) <= 3 and (found[1000], found[1001], found[1002]) == (1, 0, 0)


def test_query_does_not_depend_on_partitions_and_beats_chance(spark):
    got = queries.op11_toxicity(spark, MIDDLE).collect()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    held = {r["doc_id"] for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").where(fold("doc_id", 5) == 0).collect()}
    assert {r["doc_id"] for r in got if r["held_out"]} == held and len(got) == 1000
    known = [(r, labels[r["doc_id"]]) for r in got if r["doc_id"] in labels]
    assert sum(r["predicted"] for r, toxic in known if not toxic) == 0
    toxic, clean = ([r["score"] for r, t in known if t == k] for k in (1, 0))
    better = sum((a > b) + (a == b) / 2 for a in toxic for b in clean) / len(toxic) / len(clean)
    assert better > 0.75
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text").repartition(7, "text")
    again = toxicity.score_texts(docs, toxicity.learn_lexicon(docs.where(fold("doc_id", 5) != 0), spark.read.parquet(f"{MIDDLE}/labels.parquet")))
    assert {r["doc_id"]: r["score"] for r in got} == pytest.approx({r["doc_id"]: r["score"] for r in again.collect()}, abs=1e-12)
