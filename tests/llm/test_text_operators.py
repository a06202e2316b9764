"""Rules, language ID, segmentation and chat formatting against brute force and round trips."""

import random
from collections import Counter

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from marquee.llm import chat, compression_rules, language_id, queries, sentencepiece_nbest
from marquee.llm.common import fold

FOLDER = "/root/testdata/sf0.001"
DOCUMENTS = f"{FOLDER}/documents.parquet"


def texts_of(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(DOCUMENTS).select("doc_id", "text").collect()}


# -- compression rules


def slow_repeats(words, width=8):
    windows = Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1))
    hit = {j for i in range(len(words) - width + 1) if windows[tuple(words[i : i + width])] > 1 for j in range(i, i + width)}
    return len(hit)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b"]), max_size=60))
def test_repeated_words_equal_counting(words):
    assert compression_rules.repeated_words(words) == slow_repeats(words)


def test_rules_query_equals_brute_force(spark):
    import re

    press, rules = zstandard.ZstdCompressor(level=3), compression_rules.CompressionRules()
    texts = texts_of(spark)
    rows = queries.op8_compression_rules(spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert r["n_words"] == len(words) and r["word_chars"] == sum(map(len, words))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in text)
        assert r["n_dup_lines"] == len(lines) - len(set(lines)) and r["n_repeat_words"] == slow_repeats(words)
        bad = len(words) < 20 or 100 * r["n_repeat_words"] > 30 * len(words)
        assert r["base_failed"] == bad
        data = text.encode()
        band = rules.band(len(data))
        ratio = len(data) / len(press.compress(data)) if data else 0.0
        assert r["zstd_ratio"] == pytest.approx(ratio)
        pieces = [data[i : i + 4096] for i in range(0, len(data), 4096)] if len(data) >= 8192 else []
        odd = [not 1.3 <= len(p) / len(press.compress(p)) <= 4.0 for p in pieces if len(p) >= 2048]
        inside = not data or band.least <= ratio <= band.most and sum(odd) <= 0.25 * len(odd)
        assert r["kept"] == (not bad and inside)


def test_rules_reject_repetition_and_noise(spark, make_docs):
    noise = "".join(random.Random(1).choice("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/") for _ in range(9000))
    noise = " ".join(noise[i : i + 100] for i in range(0, 9000, 100))
    loop = " ".join(f"{'spam' * 3}{i % 3} eggs" for i in range(300))
    found = {r["doc_id"]: r for r in compression_rules.compression_rules(make_docs([(1, noise), (2, loop)])).collect()}
    assert not found[1]["in_band"] and not found[2]["in_band"]


def test_rules_on_odd_rows(odd_docs, no_docs):
    rows = compression_rules.compression_rules(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r["kept"] in (True, False) for r in rows)
    assert all(r["base_failed"] for r in rows if r["n_words"] < 20)
    assert compression_rules.compression_rules(no_docs).count() == 0


# -- language ID


def slow_grams(text):
    out, letters = Counter(), "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else (c if c.isalpha() else " ") for c in text)
    for word in letters.split():
        padded = f" {word} "
        out.update(word)
        for n in (2, 3):
            out.update(padded[i : i + n] for i in range(len(padded) - n + 1) if padded[i : i + n].strip())
    return out


def packed_gram(g):
    value = 0
    for c in g:
        value = value << 21 | (0 if c == " " else ord(c))
    return value | (1 << 63 if len(g) > 1 and g[0] == " " else 0)


def slow_language(text, profiles):
    counts = {packed_gram(g): n for g, n in slow_grams(text).items()}
    if not counts:
        return "und"
    top = sorted(counts, key=lambda g: (-counts[g], g))[: language_id.PROFILE]
    far = {
        lang: sum(abs(place.get(g, 10**9) - i) if g in place else language_id.PROFILE for i, g in enumerate(top))
        for lang, place in profiles.items()
    }
    return min(sorted(far), key=far.get)


def test_language_equals_brute_force(spark):
    docs = spark.read.parquet(DOCUMENTS).withColumn("f", fold("doc_id", 4))
    counts = {}
    rows = docs.collect()
    for r in rows:
        if r["f"] != 2 and r["lang"] is not None:
            counts.setdefault(r["lang"], Counter()).update({packed_gram(g): n for g, n in slow_grams(r["text"]).items()})
    profiles = {
        lang: {g: i for i, g in enumerate(sorted(c, key=lambda g: (-c[g], g if g < 1 << 63 else g - (1 << 64)))[: language_id.PROFILE])}
        for lang, c in counts.items()
    }
    found = {r["doc_id"]: r for r in queries.op5_language_id(spark, FOLDER).collect()}
    assert len(found) == len(rows)
    for r in rows:
        assert found[r["doc_id"]]["lang_pred"] == slow_language(r["text"], profiles)
        assert found[r["doc_id"]]["held_out"] == (r["f"] == 2)


def test_language_of_held_out_documents(spark):
    found = queries.op5_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in found]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_on_odd_rows(spark, odd_docs, no_docs):
    profiles = language_id.learn_profiles(odd_docs)
    rows = language_id.identify(odd_docs, profiles).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["lang_pred"] == by_id[2]["lang_pred"] == by_id[8]["lang_pred"] == "und" and by_id[8]["score"] == 0
    assert by_id[4]["lang_pred"] == "en" and by_id[6]["lang_pred"] == "de"
    assert language_id.identify(no_docs, profiles).count() == 0
    none = language_id.learn_profiles(no_docs)
    assert {r["lang_pred"] for r in language_id.identify(odd_docs, none).collect()} == {"und"}


# -- segmentation


@pytest.fixture(scope="module")
def lattice():
    return sentencepiece_nbest.Lattice.load(sentencepiece_nbest.MODEL)


def slow_paths(lattice, text):
    def walk(end):
        if end == 0:
            yield 0.0, ()
        for start, ids, score in lattice.arcs_to(text, end) if end else ():
            for before, own in walk(start):
                yield before + score, own + ids

    return sorted(walk(len(text)), key=lambda x: -x[0])


@pytest.mark.parametrize("text", ["hello wor", "a\n b", "ün▁x", "  xy z", "の世 x", "1234567", "A$$$ en", "\x00\x7f", "tttttt"])
def test_n_best_equal_all_paths(lattice, text):
    every = slow_paths(lattice, "".join(lattice.chunks(text)))[:6]
    score, ids, others = lattice.encode(text, 6)
    found = [tuple(ids.tolist())] + [tuple(sentencepiece_nbest.edited(ids, e).tolist()) for _, e in others]
    assert [s for s, _ in every] == pytest.approx([score] + [s for s, _ in others])
    assert len(set(found)) == len(found) and all(lattice.decode(np.array(x)) == text for x in found)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_any_text_comes_back(text):
    held = sentencepiece_nbest.Lattice.load(sentencepiece_nbest.MODEL)
    score, ids, others = held.encode(text, 4)
    assert held.decode(ids) == text
    assert all(held.decode(sentencepiece_nbest.edited(ids, e)) == text for _, e in others)
    assert [s for s, _ in others] == sorted((s for s, _ in others), reverse=True)


def test_ids_mean_the_same_to_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_nbest.MODEL)
    rows = queries.op9_sentencepiece_nbest(spark, FOLDER)
    texts = texts_of(spark)
    decoded = {r["doc_id"]: r["text"] for r in sentencepiece_nbest.decode_ids(rows, sentencepiece_nbest.MODEL).collect()}
    assert decoded == texts
    for r in rows.collect():
        assert r["round_trip"] and r["n_pieces"] == len(r["ids"]) and len(r["others"]) <= 3
        assert model.decode(r["ids"]) == texts[r["doc_id"]]


def test_segmentation_of_odd_rows(odd_docs, no_docs):
    rows = sentencepiece_nbest.encode_texts(odd_docs, sentencepiece_nbest.MODEL).collect()
    assert len(rows) == odd_docs.count()
    assert all(r["ids"] is None and r["round_trip"] is None for r in rows if r["doc_id"] == 1)
    assert all(r["round_trip"] for r in rows if r["round_trip"] is not None)
    assert [list(r["ids"]) for r in rows if r["doc_id"] == 2] == [[]]
    assert sentencepiece_nbest.encode_texts(no_docs, sentencepiece_nbest.MODEL).count() == 0


def test_a_long_chunk_without_spaces(lattice):
    text = "abcdefghij" * 2000
    _, ids, others = lattice.encode(text, 3)
    assert lattice.decode(ids) == text and len(others) == 2


# -- chat


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*"<>/s[]INSTEDROL\\ a\n", "</s>", "[INST]", "<<SYS>>"]), max_size=30).map("".join))
def test_escapes_come_back(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROL)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", ""]),
                          st.lists(st.sampled_from([*chat.CONTROL, "<", "\\", " ", "x"]), max_size=6).map("".join)), min_size=1, max_size=9))
def test_turns_come_back(turns):
    out, spans, rewrites = chat.rendered(chat.render, turns, block=2)
    assert not rewrites and chat.parse(out) == turns
    assert [chat.unescape(out[s.text_start : s.text_end]) for s in spans] == [t for _, t in turns]


def test_blocks_equal_full_prefixes():
    turns = [(("user", "assistant")[i % 2], f"turn {i} </s>") for i in range(100)]
    assert chat.rendered(chat.render, turns, block=7)[:2] == chat.locate(chat.render, turns)


def test_a_template_that_rewrites_history_is_found():
    def forgetful(turns):  # thoughts stay only in the last turn
        return "".join(f"<{r}>{t if i == len(turns) - 1 else t.split('|')[-1]}</{r}>" for i, (r, t) in enumerate(turns))

    turns = [("user", "hi"), ("assistant", "hm|yes"), ("user", "so"), ("assistant", "eh|no")]
    assert chat.rendered(forgetful, turns)[2]
    assert chat.rendered(forgetful, turns * 30)[2]


def test_a_template_that_looks_far_back_is_rendered_in_full():
    def counting(turns):
        return "".join(f"{i}:{r}:{t};" for i, (r, t) in enumerate(turns))

    turns = [("user", f"t{i}") for i in range(50)]
    out, spans, rewrites = chat.rendered(counting, turns, block=8)
    assert not rewrites and out == counting(turns) and [out[s.text_start : s.text_end] for s in spans] == [t for _, t in turns]


def test_conversations_on_odd_rows(spark):
    kinds = "conv_id bigint, turn int, role string, text string, spans string"
    rows = spark.createDataFrame([
        (1, 0, "user", None, "x"), (1, 1, "assistant", "b", "x"), (1, 1, "assistant", "b", "x"), (None, None, None, "lost", "x"),
        (2, None, "tool", "[INST]" * 5000, "x")], kinds)
    found = {r["conv_id"]: r for r in chat.format_conversations(rows).collect()}
    assert chat.parse(found[1]["formatted"]) == [("user", ""), ("assistant", "b"), ("assistant", "b")]
    assert chat.parse(found[None]["formatted"]) == [("", "lost")]
    assert chat.parse(found[2]["formatted"]) == [("tool", "[INST]" * 5000)]
    assert chat.format_conversations(spark.createDataFrame([], kinds)).count() == 0
    assert {r["n_turns"] for r in chat.digests(chat.format_conversations(rows)).collect()} == {1, 3}
