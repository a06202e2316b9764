"""Dedup, mixing, classifiers, language model and pipeline against brute force."""

import base64
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from marquee.llm import (
    common, cotraining, embedding_pq, hmm_lm, mixing, near_texts, queries, shared_runs, simhash, substring_dedup,
)
from marquee.llm.common import fold

FOLDER = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"


class Groups:
    def __init__(self):
        self.up = {}

    def find(self, a):
        self.up.setdefault(a, a)
        while self.up[a] != a:
            self.up[a] = a = self.up[self.up[a]]
        return a

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


# -- SimHash


def slow_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    groups = Groups()
    kinds = sorted(set(prints.values()))
    for i, a in enumerate(kinds):
        groups.find(a)
        for b in kinds[:i]:
            if (a ^ b).bit_count() <= 3:
                groups.join(a, b)
    least = {}
    for doc, p in prints.items():
        root = groups.find(p)
        least[root] = min(least.get(root, doc), doc)
    return {doc: least[groups.find(p)] for doc, p in prints.items()}


def test_simhash_query_equals_brute_force(spark):
    prints = {r["doc_id"]: slow_print(r["text"]) for r in documents(spark, MIDDLE).collect()}
    found = queries.op6_simhash_golay(spark, MIDDLE).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in found} == {d: f"{p:016x}" for d, p in prints.items()}
    assert {r["doc_id"]: r["component_id"] for r in found} == slow_components(prints)


def test_golay_code_decodes_three_errors():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 2000).astype(np.uint32)
    index = simhash.codeword_index(words)
    fixed = words ^ simhash._error_of_syndrome()[simhash._syndrome(words)]
    assert (simhash._syndrome(fixed) == 0).all() and (np.bitwise_count(words ^ fixed) <= 3).all()
    assert ((fixed >> 11) == index).all() and len(np.unique(simhash.codeword_index(np.arange(1 << 23, dtype=np.uint32)))) == 4096


def test_prints_within_three_bits_share_a_key():
    rng = np.random.default_rng(1)
    a = rng.integers(-(1 << 63), 1 << 63, 3000)
    flips = np.zeros(3000, np.uint64)
    for _ in range(3):
        flips |= np.where(rng.random(3000) < 0.8, np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64), np.uint64(0))
    b = (a.view(np.uint64) ^ flips).view(np.int64)
    keys = []
    for prints in (a, b):
        rows, values = simhash.fuzzy_keys(prints)
        held = defaultdict(set)
        for r, v in zip(rows.tolist(), values.tolist()):
            held[r].add(v)
        keys.append(held)
    assert all(keys[0][i] & keys[1][i] for i in range(3000))


def test_a_hot_key_is_cut_into_chunks_and_stays_whole(spark, monkeypatch):
    base = 0x0123456789ABCDEF
    prints = {i: base ^ (1 << (i % 60)) ^ (1 << ((i * 7 + 1) % 60)) for i in range(120)}
    rows = spark.createDataFrame([(p,) for p in sorted(set(prints.values()))], "print bigint")
    links = simhash.print_links(rows, chunk=16).collect()
    groups = Groups()
    for p in set(prints.values()):
        groups.find(p)
    for u, v in links:
        assert (u ^ v).bit_count() <= 60  # star edges join components, not always pairs
        groups.join(u, v)
    want = slow_components({p: p for p in set(prints.values())})
    assert {p: groups.find(p) for p in want} == want


def test_only_shared_keys_move(spark):
    rng = np.random.default_rng(2)
    alone = rng.integers(-(1 << 63), 1 << 63, 3000)
    near = alone[:200] ^ (1 << rng.integers(0, 62, 200))
    rows = spark.createDataFrame([(int(p),) for p in np.concatenate((alone, near))], "print bigint")
    moved = simhash.shared_keys(rows).collect()
    every = defaultdict(set)
    for r, k in zip(*simhash.fuzzy_keys(np.concatenate((alone, near)))):
        every[int(k)].add(int(r))
    shared = sum(len(x) for x in every.values() if len(x) > 1)
    assert shared <= len(moved) <= 1.1 * shared < 0.2 * sum(map(len, every.values()))
    assert {(p, q) for p, q in zip(alone[:200].tolist(), near.tolist())} <= {
        pair for u, v in simhash.print_links(rows).collect() for pair in ((u, v), (v, u))}


def test_one_of_each_group_stays(odd_docs, no_docs):
    kept = simhash.one_of_each(odd_docs).collect()
    assert [r["doc_id"] for r in kept if r["text"] and r["text"].startswith("the quick")] == [4]
    assert len([r for r in kept if not (r["text"] or "").split()]) == 1  # texts without words are one group
    assert simhash.one_of_each(odd_docs).columns == odd_docs.columns and simhash.one_of_each(no_docs).count() == 0


def test_simhash_on_odd_rows(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r["component_id"] for r in rows if r["print"] == 0} == {1}
    assert simhash.near_duplicates(no_docs).count() == 0


# -- passages


def slow_lines(texts, how=substring_dedup.Passages()):
    """doc -> (start, end) of the lines that repeat an earlier passage."""
    paras, seen = [], {}
    for doc, text in sorted(texts.items()):
        data, at = (text or "").encode(), 0
        for line in data.split(b"\n"):
            words = line.lower().split()
            if len(words) >= how.min_words:
                paras.append((doc, (at, min(at + len(line) + 1, len(data))), seen.setdefault(tuple(words), len(seen))))
            at += len(line) + 1
    sets = [{w[i : i + 5] for i in range(max(1, len(w) - 4))} for w in seen]
    groups, holders = Groups(), defaultdict(list)
    shared = Counter()
    for i, s in enumerate(sets):
        groups.find(i)
        for g in s:
            for j in holders[g]:
                shared[j, i] += 1
            holders[g].append(i)
    for (i, j), n in shared.items():
        if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n) - 1e-9:
            groups.join(i, j)
    first, out = set(), defaultdict(list)
    for doc, span, p in paras:
        root = groups.find(p)
        if root in first:
            out[doc].append(span)
        first.add(root)
    return out


def slow_runs(texts, how=shared_runs.Runs()):
    """doc -> (start, end) of blocks in a row that came before, of enough words."""
    told, out = set(), defaultdict(list)
    for doc, text in sorted(texts.items()):
        run = []
        for row in [*zip(*shared_runs.blocks([(text or "").encode()], how.window)), None]:
            if row is not None and int(row[5]) in told:
                run.append(row)
                continue
            if sum(int(r[4]) for r in run) >= how.min_words:
                out[doc].append((int(run[0][2]), int(run[-1][3])))
            run = []
            if row is not None:
                told.add(int(row[5]))
    return out


def slow_cut(texts):
    """doc -> (text without the spans, the spans)."""
    lines, runs, out = slow_lines(texts), slow_runs(texts), {}
    for doc, text in texts.items():
        merged = []
        for a, b in sorted(lines.get(doc, []) + runs.get(doc, [])):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        data, kept, done = (text or "").encode(), b"", 0
        for a, b in merged:
            kept, done = kept + data[done:a], b
        out[doc] = ((kept + data[done:]).decode(), [(a, b - a) for a, b in merged])
    return out


def long_runs(texts, n=50):
    """Documents that hold a run of n words that another document holds."""
    holders = defaultdict(set)
    for doc, text in texts.items():
        words = (text or "").encode().lower().split()
        for i in range(len(words) - n + 1):
            holders[hash(tuple(words[i : i + n]))].add(doc)
    return {d for own in holders.values() if len(own) > 1 for d in own}


def test_passages_equal_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in documents(spark, MIDDLE).collect()}
    want = slow_cut(texts)
    found = queries.op4_paragraph_dedup(spark, MIDDLE).collect()
    assert len(found) == len(texts)
    spans = {r["doc_id"]: [(x["at"], x["size"]) for x in r["removed"]] for r in found}
    # bands miss a similar pair with a chance of 0.005
    assert sum(spans[d] != want[d][1] for d in texts) <= 0.005 * sum(1 for d in texts if want[d][1])
    assert all(r["text"] == want[r["doc_id"]][0] for r in found if spans[r["doc_id"]] == want[r["doc_id"]][1])
    assert all(r["n_removed"] == len(r["removed"]) for r in found)
    assert len(long_runs(texts)) > 100 and not long_runs({r["doc_id"]: r["text"] for r in found})


def test_runs_inside_lines_are_cut_and_the_rest_stays(spark, make_docs):
    """60 words in the middle of lines of 600, cut otherwise into lines, and in other case."""
    rng = np.random.default_rng(8)
    words = lambda n: ["".join(rng.choice(list("abcdefghij"), 7)) for _ in range(n)]
    passage = words(60)
    around = [(words(270), words(270)) for _ in range(4)]
    shown = [" ".join(passage), " ".join(passage), "\n".join(" ".join(passage[i : i + 7]) for i in range(0, 60, 7)), " ".join(passage).upper()]
    texts = {i: f"{' '.join(a)} {p} {' '.join(b)}" for i, ((a, b), p) in enumerate(zip(around, shown))}
    texts[9] = " ".join(words(300))
    rows = {r["doc_id"]: r for r in substring_dedup.drop_repeats(make_docs(list(texts.items()))).collect()}
    assert rows[0]["text"] == texts[0] and rows[9]["text"] == texts[9]
    for i in (1, 2, 3):
        left = rows[i]["text"].split()
        a, b = around[i]
        assert left[:270] == a and left[-270:] == b and len(left) <= 540 + 2 * shared_runs.Runs().window
    assert not long_runs({i: r["text"] for i, r in rows.items()}, 26)


def test_blocks_do_not_depend_on_their_neighbours():
    rng = np.random.default_rng(9)
    texts = [b"", b"one", *[b" ".join(b"%d" % rng.integers(0, 50) for _ in range(rng.integers(1, 200))) for _ in range(40)], b" \n ", b"x " * 100]
    together = list(zip(*shared_runs.blocks(texts, 12)))
    apart = [(i, *row[1:]) for i, t in enumerate(texts) for row in zip(*shared_runs.blocks([t], 12))]
    assert [tuple(map(int, r)) for r in together] == [tuple(map(int, r)) for r in apart]
    assert all(int(r[4]) <= 14 for r in together)  # a window and the two words that follow
    for i, number, start, end, n, _ in together:
        assert len(texts[i][start:end].split()) == n


def test_first_places_of_blocks_and_what_moves_for_them(spark, monkeypatch):
    """Ids that are null or have several texts, rows alike in both, blocks that repeat in their text."""
    rng = np.random.default_rng(11)
    word = lambda: f"w{rng.integers(0, 1 << 40)}"
    shared = [" ".join(word() for _ in range(60)) for _ in range(3)]
    docs = []
    for i in range(40):
        body = " ".join(word() for _ in range(80))
        twice = f" {shared[2]} {shared[2]}" if i % 11 == 3 else ""
        docs.append((None if i % 7 == 0 else i // 2, f"{body} {shared[i % 2]}{twice}"))
    docs += [docs[19], docs[0]]
    tables = {}

    def kept(df, name, *parts):
        tables[name] = common.written(df, name, *parts)
        return tables[name]

    monkeypatch.setattr(shared_runs, "written", kept)
    rows = spark.createDataFrame(docs, "_id bigint, text string").withColumn("_th", F.xxhash64("text"))
    runs = shared_runs.shared_runs(rows)
    found = {tuple(r) for r in runs.collect()}
    blocks = defaultdict(list)
    for r in tables["blocks"].collect():
        blocks[r["key"]].append((r["_id"] is None, r["_id"] or 0, r["_th"], r["spot"] >> 9, r["span"], r["spot"] & 255))
    lanes = defaultdict(dict)
    for places in blocks.values():
        for place in places:
            if len(places) > 1 and place[:4] != min(places)[:4]:
                lanes[place[:3]][place[3]] = place[4:]
    want = set()
    for (none, id_, th), lane in lanes.items():
        for start in lane:
            if start - 1 not in lane:
                end = start
                while end + 1 in lane:
                    end += 1
                if sum(lane[i][1] for i in range(start, end + 1)) >= 16:
                    want.add((None if none else id_, th, lane[start][0] >> 32, lane[end][0] & 0xFFFFFFFF))
    assert found == want and len(want) >= 30
    # of all blocks no place moves, only the first id of a key
    plan = runs._jdf.queryExecution().optimizedPlan().toString()
    assert "named_struct" not in plan and "struct(none" not in plan


def test_a_task_tells_the_bands_of_a_line_once(spark):
    line = "the same line of more than ten words that every document has"
    docs = spark.createDataFrame([(i, f"{line}\n{line}\n" + f"w{i} " * 12) for i in range(50)], "doc_id bigint, text string").coalesce(1)
    rows = substring_dedup.paragraph_table(docs, "doc_id", "text", substring_dedup.Passages()).collect()
    assert len(rows) == 150 and len({r["para"] for r in rows}) == 51
    assert sum(r["b0"] is not None for r in rows) == 51


def test_planted_passages_go_and_clean_text_stays(spark, make_docs):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    passage = [word() for _ in range(60)]
    edited = [*passage[:30], "other", *passage[31:]]
    own = [" ".join(word() for _ in range(40)) for _ in range(6)]
    docs = make_docs([(1, f"{own[0]}\n{' '.join(passage)}"), (2, f"{own[1]}\n{' '.join(edited)}\n{own[2]}"),
                      (3, f"{' '.join(passage).upper()}\n{own[3]}"), (4, own[4]), (5, own[5])])
    found = {r["doc_id"]: r for r in substring_dedup.drop_repeats(docs).collect()}
    assert [found[i]["n_removed"] for i in range(1, 6)] == [0, 1, 1, 0, 0] and found[3]["text"] == own[3]
    assert found[2]["text"] == f"{own[1]}\n{own[2]}" and found[4]["text"] == own[4]


def test_bands_reach_the_recall():
    assert 1 - (1 - 0.8**3) ** substring_dedup.tuned_bands(0.8, 3, 0.995) >= 0.995


def test_one_paragraph_in_most_documents(spark, make_docs):
    line = " ".join(f"w{i}" for i in range(60))
    variants = [line.replace("w30", f"v{i}") for i in range(300)]
    docs = make_docs([(i, f"{v}\nshort line") for i, v in enumerate(variants)])
    found = substring_dedup.drop_repeats(docs, how=substring_dedup.Passages(chunk=16)).collect()
    assert sum(r["n_removed"] for r in found) == 299 and [r["doc_id"] for r in found if not r["n_removed"]] == [0]


def test_passages_on_odd_rows(odd_docs, no_docs):
    rows = substring_dedup.drop_repeats(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert [r["n_removed"] for r in rows if r["doc_id"] in (4, 5)] == [0, 0, 1]
    assert [r["text"] for r in rows if r["doc_id"] == 1] == [None] and [r["text"] for r in rows if r["doc_id"] == 2] == [""]
    assert substring_dedup.drop_repeats(no_docs).count() == 0


# -- languages of the pipeline


def test_gibberish_and_unlearned_languages_go_at_every_length(spark, make_docs):
    docs = documents(spark, MIDDLE).select("doc_id", "text", "lang", "source", "n_chars")
    rng = np.random.default_rng(4)
    noise = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 11))) for _ in range(n))
    russian, greek = "Съешь же ещё этих мягких французских булок, да выпей чаю. ", "Ξεσκεπάζω την ψυχοφθόρα βδελυγμία. "
    bad = [noise(n) for n in (20, 60, 200, 2000)] + [base64.b64encode(rng.bytes(n)).decode() for n in (300, 3000)]
    bad += [x * n for x in (russian, greek) for n in (1, 6, 60)] + ["!!! 123"]
    good = ["The weather was nice and we walked along the river.", "Das Wetter war schön und wir gingen am Fluss entlang.",
            "Il faisait beau et nous avons marché le long de la rivière."]
    added = make_docs([(-1 - i, x) for i, x in enumerate(bad)] + [(-101 - i, x) for i, x in enumerate(good)]).select(docs.columns)
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs.unionByName(added), MIDDLE).collect()}
    assert [i for i in kept if i < 0 and i > -100] == [] and {-101, -102, -103} <= kept
    assert len([i for i in kept if i >= 0]) == docs.count()


# -- near duplicates of the pipeline


def slow_similar(texts):
    """Smallest document of each group of texts whose five-word shingles are alike to 0.8."""
    sets, holders, groups = {}, defaultdict(list), Groups()
    for d, text in texts.items():
        words = text.encode().lower().split()
        sets[d] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
        groups.find(d)
        for x in sets[d]:
            holders[x].append(d)
    both = Counter((a, b) for own in holders.values() for i, b in enumerate(own) for a in own[:i])
    for (a, b), n in both.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            groups.join(a, b)
    return sorted({groups.find(d) for d in sets})


def test_one_of_each_group_of_similar_texts_stays(spark):
    kept = [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, documents(spark, MIDDLE), MIDDLE).collect()]
    assert sorted(kept) == slow_similar({r["doc_id"]: r["text"] for r in documents(spark, MIDDLE).collect()})


def test_fingerprints_alone_find_similar_texts(make_docs):
    words = [f"w{i}" for i in range(900)]
    docs = {1: words, 2: [*words[:-1], "last"], 3: words[300:], 4: [f"v{i}" for i in range(900)]}
    prints = {d: simhash.fingerprint(simhash.shingle_hashes(" ".join(x).encode(), 5)) for d, x in docs.items()}
    assert (prints[1] ^ prints[2]).bit_count() <= 3 < (prints[1] ^ prints[3]).bit_count()
    rows = make_docs([(d, " ".join(x), "en", "a") for d, x in docs.items()])
    # one band of 4,000 values, which only equal texts share
    blind = substring_dedup.Passages(rows=4000, recall=0.0)
    found = near_texts.similar_texts(rows, how=blind).collect()
    assert dict(found) == {1: 1, 2: 1, 3: 3, 4: 4}


# -- vectors


def slow_links(vectors, cosine=0.95):
    good = {i: np.array(v, float) for i, v in vectors if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    return {i: [j for j, w in good.items() if j != i and len(v) == len(w)
                and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= cosine] for i, v in good.items()}


def check_vectors(vectors, found):
    links, groups = slow_links(vectors), Groups()
    for i, others in links.items():
        groups.find(i)
        for j in others:
            groups.join(i, j)
    for r in found:
        i = r["vec_id"]
        assert r["n_links"] == len(links.get(i, [])) and r["component_id"] == groups.find(i) and r["kept"] == (groups.find(i) == i)


def test_vector_query_finds_all_links(spark):
    rows = spark.read.parquet(f"{MIDDLE}/embeddings.parquet").collect()
    check_vectors([(r["vec_id"], r["embedding"]) for r in rows], queries.op7_embedding_pq(spark, MIDDLE).collect())


@pytest.mark.parametrize("block", [8, 1024])
def test_groups_of_near_vectors(spark, block):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(40):
        centre = rng.normal(size=16)
        rows += [(len(rows) + j, (centre + 0.12 * rng.normal(size=16)).astype(np.float32).tolist()) for j in range(10)]
    rows += [(len(rows) + j, rows[0][1]) for j in range(30)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    found = embedding_pq.near_vectors(df, how=embedding_pq.Quantiser(block=block)).collect()
    want = slow_links(rows)
    assert sum(r["n_links"] for r in found) >= 0.99 * sum(map(len, want.values()))
    check_vectors(rows, found)


def test_steps_straight_toward_the_next_centroid(spark):
    """64 dimensions: partners across the border by nearly their whole distance."""
    rng = np.random.default_rng(6)
    points = embedding_pq.unit(rng.normal(size=(16, 64)).repeat(60, 0) + 0.5 * rng.normal(size=(960, 64)))
    centres = embedding_pq.fit(points, embedding_pq.Quantiser(), 2 * len(points)).coarse
    far = embedding_pq.squared(points, centres)
    one, two = (centres[far.argsort(1)[:, i]] for i in (0, 1))
    gap = two - one
    side = gap - (gap * points).sum(1)[:, None] * points
    moved = 0.951 * points + math.sqrt(1 - 0.951**2) * embedding_pq.unit(side)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate((points, moved)))]
    check_vectors(rows, embedding_pq.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect())


def test_vectors_ask_few_lists(spark, monkeypatch):
    """A link across a border is found from the end nearer to it; asking from both ends needs most lists."""
    rng = np.random.default_rng(8)
    points = rng.normal(size=(600, 64))
    vectors = np.concatenate((points, points + 0.25 * rng.normal(size=(600, 64))))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    filed = []

    def counted(df, name, *parts):
        out = common.written(df, name, *parts)
        if name == "lists":
            filed.append(out.where("asks").count())
        return out

    monkeypatch.setattr(embedding_pq, "written", counted)
    check_vectors(rows, embedding_pq.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect())
    assert len(filed) == 1 and len(rows) <= filed[0] < 15 * len(rows)


def test_vectors_on_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [1.0, None]),
            (8, [inf, 1.0]), (9, [1.0, 2.0]), (10, [1.0, 2.0, 3.0]), (11, [-0.0, 1.0]), (12, [0.0, 1.0]), (13, [1e200, 2e200])]
    kinds = "vec_id bigint, embedding array<double>"
    found = embedding_pq.near_vectors(spark.createDataFrame(rows, kinds)).collect()
    by_id = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found}
    assert by_id[1] == (3, 1, True) and by_id[13] == (3, 1, False) and by_id[12] == (1, 11, False)
    assert all(by_id[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 10))
    assert embedding_pq.near_vectors(spark.createDataFrame([], kinds)).count() == 0
    lost = spark.createDataFrame([(None, [1.0, 0.0]), (None, None), (4, [1.0, 0.0])], kinds)
    assert sorted((r["vec_id"] is None, r["n_links"], r["component_id"] or 0) for r in embedding_pq.near_vectors(lost).collect()) == [
        (False, 1, 4), (True, 0, 0), (True, 1, 4)]


# -- mixing


def slow_targets(sizes, weights=(3.0, 1.0, 2.0), share=1.5, cap=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, free, target = share * sum(sizes.values()), set(names), {}
    while free:
        level = (budget - sum(target.values())) / sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * level > cap * sizes[s]}
        if not above:
            return target | {s: weight[s] * level for s in free}
        target |= {s: cap * sizes[s] for s in above}
        free -= above
    return target


def test_mix_meets_its_targets(spark):
    words = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in documents(spark, MIDDLE).collect()}
    source = {r["doc_id"]: r["source"] for r in documents(spark, MIDDLE).collect()}
    rows = queries.op2_entropy_mixing(spark, MIDDLE).collect()
    sizes = Counter()
    for d, n in words.items():
        sizes[source[d]] += n
    want, got = slow_targets(dict(sizes)), Counter()
    assert len(rows) == len(words)
    for r in rows:
        s = source[r["doc_id"]]
        assert r["size"] == words[r["doc_id"]] and r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 2 * r["size"]
        got[s] += r["taken"]
    assert all(abs(got[s] - want[s]) <= 0.01 * want[s] for s in want)
    again = {r["doc_id"]: r["taken"] for r in queries.op2_entropy_mixing(spark, MIDDLE).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}


def test_rates_are_the_entropy_balancing_tilt(spark):
    rows = queries.op2_entropy_mixing(spark, MIDDLE).join(documents(spark, MIDDLE).select("doc_id", "source"), "doc_id").collect()
    by_source = defaultdict(list)
    for r in rows:
        by_source[r["source"]].append(r)
    for own in by_source.values():
        size = np.array([r["size"] for r in own], float)
        target, total = own[0]["target"], own[0]["source_size"]
        if target >= 2 * total:
            continue
        x = np.sqrt(size / size.mean())
        lo, hi = -60.0, 60.0
        for _ in range(200):
            lam = (lo + hi) / 2
            lo, hi = (lam, hi) if (size * np.minimum(2, np.exp(lam * x))).sum() < target else (lo, lam)
        assert np.allclose([r["rate"] for r in own], np.minimum(2, np.exp(lam * x)), atol=1e-4)


def test_mix_on_odd_rows(odd_docs, no_docs):
    rows = mixing.mix_sources(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["copies"] <= 2 for r in rows)
    assert all(r["copies"] == 1 for r in rows if r["size"] == 0)
    assert len({r["copies"] for r in rows if r["doc_id"] == 4}) == 1
    assert mixing.mix_sources(no_docs).count() == 0 and mixing.take_copies(no_docs).count() == 0
    taken = mixing.take_copies(odd_docs)
    assert taken.columns == odd_docs.columns and taken.count() == sum(r["copies"] for r in rows)


def test_a_source_with_most_rows_and_one_without_words(spark, make_docs):
    docs = make_docs([(i, " ".join(["w"] * (1 + i % 50)), "en", "hot" if i % 3 else f"s{i % 7}") for i in range(3000)] + [(9999, "", "en", "void")])
    rows = mixing.mix_sources(docs).collect()
    sizes, got = Counter(), Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        got[r["source"]] += r["size"] * r["copies"]
    want = slow_targets(dict(sizes))
    assert all(abs(got[s] - want[s]) <= 0.01 * want[s] + 1 for s in want)


# -- language model


def test_forward_and_counts_equal_the_plain_recursion():
    rng = np.random.default_rng(0)
    k, c = 4, 30
    hmm = hmm_lm.Hmm(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(c), k).T)
    texts = [rng.integers(0, c, n).astype(np.uint16) for n in (1, 5, 17, 16, 40, 3, 33)]
    total, starts, moves, emits = [], np.zeros(k), np.zeros((k, k)), np.zeros((c, k))
    for s in texts:
        n = len(s)
        a, b = np.zeros((n, k)), np.ones((n, k))
        a[0] = hmm.start * hmm.emit[s[0]]
        for t in range(1, n):
            a[t] = a[t - 1] @ hmm.move * hmm.emit[s[t]]
        for t in range(n - 2, -1, -1):
            b[t] = hmm.move @ (hmm.emit[s[t + 1]] * b[t + 1])
        p = a[-1].sum()
        total.append(np.log10(p))
        starts += a[0] * b[0] / p
        for t in range(n - 1):
            moves += a[t][:, None] * hmm.move * (hmm.emit[s[t + 1]] * b[t + 1])[None] / p
        np.add.at(emits, s.astype(int), a * b / p)
    for length in (4, 8, 64):
        seg = hmm_lm.Segments(texts, length)
        x, y, z, score = hmm_lm.expected_counts(hmm, seg)
        assert np.allclose(x, starts) and np.allclose(y, moves) and np.allclose(z, emits)
        assert np.allclose(hmm_lm.forward_scores(hmm, seg), total) and score == pytest.approx(sum(total))


def test_base_scores_equal_counting(spark):
    rows = documents(spark, FOLDER).withColumn("f", fold("doc_id", 7)).collect()
    toks = {r["doc_id"]: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"])), None] for r in rows}
    counts = Counter(t for r in rows if r["f"] != 2 for t in toks[r["doc_id"]])
    n, v = sum(counts.values()), len(counts)
    found = queries.op10_hmm_scores(spark, FOLDER).collect()
    assert len(found) == len(rows)
    for r in found:
        own = toks[r["doc_id"]]
        assert r["n_tokens"] == len(own) and r["n_known"] == sum(counts[t] > 0 for t in own) and r["train_tokens"] == n
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own))


def test_the_model_beats_the_base(spark):
    rows = queries.op10_hmm_scores(spark, MIDDLE).where("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_whole_scores_equal_a_plain_recursion(spark, make_docs, monkeypatch):
    """Frequent and joined words, texts of one and of many segments: step by step in plain Python."""
    docs = make_docs([(i, " ".join(f"W{(i * j * j) % 60}x{j % 3}" for j in range(1, 10 + 9 * i))) for i in range(25)] + [(99, None)])
    held = docs.withColumn("held", F.col("doc_id") % 5 == 1)
    shape = hmm_lm.Shape(own_classes=6, shared_classes=10, frequent=12, segment=16, neighbours=4, states=3)
    made = []
    real = hmm_lm.trained
    monkeypatch.setattr(hmm_lm, "trained", lambda *a: made.append(real(*a)) or made[-1])
    got = {r["doc_id"]: r for r in hmm_lm.score_texts(held, flag="held", shape=shape).collect()}
    texts = {r["doc_id"]: [*(r["text"] or "").lower().split(), " "] for r in docs.collect()}
    counts = Counter(w for d, t in texts.items() if d % 5 != 1 for w in t)
    own = hmm_lm.most_frequent(spark.createDataFrame([(w.encode(), n) for w, n in counts.items()], "word binary, n bigint"), [6])[0]
    kind = {w: list(own).index(w.encode()) if w.encode() in own else hmm_lm.shared_class(w.encode(), shape) for t in texts.values() for w in t}
    total, distinct = Counter(), Counter()
    for w, n in counts.items():
        total[kind[w]] += n
        distinct[kind[w]] += 1
    (hmm,) = made
    assert hmm.start.sum() == pytest.approx(1) and hmm.move.sum(1) == pytest.approx(1) and hmm.emit.sum(0) == pytest.approx(1)
    for d, t in texts.items():
        log, state = 0.0, None
        for w in t:
            state = hmm.start if state is None else state @ hmm.move
            state = state * hmm.emit[kind[w]]
            log += math.log10(state.sum())
            state = state / state.sum()
            if kind[w] >= 6:
                log += math.log10((counts[w] + 1) / (total[kind[w]] + distinct[kind[w]] + 1))
        assert got[d]["score"] == pytest.approx(log, rel=1e-9), d
        n, v = sum(counts.values()), len(counts)
        assert got[d]["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
        assert (got[d]["n_known"], got[d]["train_tokens"]) == (sum(counts[w] > 0 for w in t), n)


def test_the_states_part_before_training_ends(spark):
    """Held-out classes: the latent model clearly beats the class unigram."""
    shape = hmm_lm.Shape()
    docs = documents(spark, MIDDLE).select("doc_id", "text", (fold("doc_id", 7) == 2).alias("held"))
    v = hmm_lm.learn_vocabulary(hmm_lm.word_counts(docs.where("not held")).cache(), shape)
    texts = hmm_lm.encoded(docs, "doc_id", "text", ["held"], v).cache()
    hmm = hmm_lm.trained(texts.where("not held"), v, shape)
    latent = sum(r["latent"] for r in hmm_lm.class_scores(texts.where("held"), hmm, shape).collect())
    seen = np.concatenate([np.frombuffer(r["classes"], np.uint16) for r in texts.where("held").select("classes").collect()])
    unigram = np.log10((v.class_total + shape.smooth) / (v.class_total + shape.smooth).sum())[seen].sum()
    assert latent > unigram + 0.2 * len(seen)


def test_an_early_plateau_is_no_standstill():
    shape = hmm_lm.Shape()
    rising = [-3.0 + 1e-6 * 2**i for i in range(20)]
    assert not any(hmm_lm.standstill(rising[:n], shape) for n in range(21))
    assert hmm_lm.standstill([*rising, rising[-1] + 1e-5], shape) and hmm_lm.standstill([-3.0] * shape.least_rounds, shape)
    assert not hmm_lm.standstill([-3.0] * (shape.least_rounds - 1), shape)


def test_rare_words_are_joined_alike(spark, make_docs):
    docs = make_docs([(i, " ".join(f"w{(i * j) % 40}" for j in range(1, 30))) for i in range(30)])
    sizes = [hmm_lm.Shape(own_classes=4, shared_classes=8, frequent=f, iterations=2, segment=8, neighbours=3) for f in (4, 10_000)]
    few, all_ = (sorted((r["doc_id"], round(r["score"], 6), round(r["base_score"], 6), r["n_known"])
                        for r in hmm_lm.score_texts(docs, shape=s).collect()) for s in sizes)
    assert few == all_


def test_language_model_on_odd_rows(odd_docs, no_docs):
    rows = hmm_lm.score_texts(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(math.isfinite(r["score"]) and r["score"] <= 0 for r in rows)
    assert [r["n_tokens"] for r in rows if r["doc_id"] == 1] == [1]
    assert hmm_lm.score_texts(no_docs).count() == 0


# -- classifier


def test_quality_of_held_out_labels(spark):
    from pyspark.sql import functions as F

    docs, labels = documents(spark, MIDDLE), spark.read.parquet(f"{MIDDLE}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    found = cotraining.quality_scores(docs, labels.where(~held)).join(labels.where(held), "doc_id").collect()
    good = [r["kept"] for r in found if r["quality"] == 1]
    bad = [r["kept"] for r in found if r["quality"] == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.3


def test_views_exchange_sure_labels(spark):
    docs, labels = documents(spark, MIDDLE), spark.read.parquet(f"{MIDDLE}/labels.parquet")
    rows = cotraining.features(docs, "doc_id", "text", ["source", "lang"])
    rows = rows.cache()
    marks = rows.join(labels, rows["_id"] == labels["doc_id"]).selectExpr("row", "quality as label")
    *_, report = cotraining.co_trained(rows, marks, cotraining.CoTraining(rounds=2, grow=30))
    assert report["labelled"] == labels.count() and len(report["pseudo"]) == 2 and min(report["pseudo"]) > 0
    rows.unpersist()


def test_classifier_on_odd_rows(spark, odd_docs, no_docs):
    marks = spark.createDataFrame([(4, 1, None), (6, 0, 1), (None, 1, 1), (8, None, 0), (4, 1, 0)], "doc_id bigint, quality int, toxic int")
    rows = cotraining.quality_scores(odd_docs, marks).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["kept"] for r in cotraining.quality_scores(odd_docs, marks.limit(0)).collect())
    assert cotraining.quality_scores(no_docs, marks).count() == 0


# -- pipeline


def test_pipeline_equals_its_parts(spark):
    kept, texts = documents(spark, FOLDER), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in kept.collect()}
        kept = stage(spark, kept, FOLDER).cache()
        after = [(r["doc_id"], r["text"]) for r in kept.collect()]
        assert sorted(kept.columns) == sorted(documents(spark, FOLDER).columns)
        if name == "language":
            assert dict(after) == before  # all documents are prose in a known language
        elif name == "near_duplicates":
            assert sorted(d for d, _ in after) == slow_similar(before)
        elif name == "passages":
            assert dict(after) == {d: text for d, (text, _) in slow_cut(before).items()}
        else:
            copies = Counter(d for d, _ in after)
            assert max(copies.values()) <= 2 and set(copies) <= set(before)
        texts = Counter(after)
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter({d: sum(n for (i, _), n in texts.items() if i == d) for d, _ in texts})
    assert all(r["round_trip"] for r in rows)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, odd_docs, no_docs, name, stage):
    rows = stage(spark, odd_docs, FOLDER).collect()
    assert len(rows) > 0
    assert stage(spark, no_docs, FOLDER).count() == 0


def test_job_tables_are_written_with_zstandard(spark):
    name = common.written(spark.range(10), "codec").inputFiles()[0].removeprefix("file:").replace("///", "/")
    assert pq.ParquetFile(name).metadata.row_group(0).column(0).compression == "ZSTD"
