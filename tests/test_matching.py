"""Duplicate rules against a direct all-pairs computation on small tables."""

import random
import re
from datetime import datetime, timedelta
from difflib import SequenceMatcher
from math import atan2, cos, radians, sin, sqrt

from pyspark.sql import functions as F

from marquee.operators import matching as M
from marquee.operators import merging as E
from marquee.operators.clusters import duplicate_clusters
from marquee.operators.names import similar_names


def ratio(a, b):
    return SequenceMatcher(None, a.lower(), b.lower()).ratio() if a and b else 0.0


def title_of(r):
    bare = (r.get("title") or "").lower().replace('"', "").replace("'", "")
    return " ".join(re.sub(r"[^\w\s]", " ", bare).split())


def venue_of(r):
    v = (r.get("venue_name") or "").lower()
    for s in (" - los angeles", " los angeles", " la", " theater", " theatre", " museum", " gallery",
              " center", " centre"):
        v = v.removesuffix(s)
    return " ".join(v.split())


def km(a, b):
    p = [a.get("latitude"), a.get("longitude"), b.get("latitude"), b.get("longitude")]
    if not all(p):
        return None
    la, lo, lb, lp = map(radians, p)
    h = sin((lb - la) / 2) ** 2 + cos(la) * cos(lb) * sin((lp - lo) / 2) ** 2
    return 6371.0 * 2 * atan2(sqrt(h), sqrt(1 - h))


def rule(a, b):
    """Name of the first rule that makes (incoming a, stored b) one listing.

    Over tables a shared URL counts within a day only, where both have a start.
    """
    sa, sb = a.get("event_date"), b.get("event_date")
    gap = abs((sa - sb).total_seconds()) / 3600 if sa and sb else None
    ta, tb, va, vb = title_of(a), title_of(b), venue_of(a), venue_of(b)
    ua, ub = (a.get("url") or "").strip(), (b.get("url") or "").strip()
    t = ratio(ta, tb)
    near = gap is None or gap <= 24
    if ua and ua == ub and near and ((gap is not None and gap < 1) or not a["title"] or not b["title"] or t >= 0.5):
        return "url"
    if gap is None or gap > 24:
        return None
    if a["source"] == b["source"]:
        exact = ta and ta == tb and gap < 1 and va and va == vb
        return "exact_same_source" if exact else None
    v, d = ratio(va, vb), km(a, b)
    if t >= 0.85 and not (d is not None and d > 1.0):
        return "title"
    if t >= 0.7 and v >= 0.8:
        return "title_venue"
    x, y = sorted((ta, tb), key=len)
    if v >= 0.95 and len(x) >= 4 and y.startswith(x + " at "):
        return "venue_prefix_title"
    if gap <= 3 and v >= 0.85 and t >= 0.45:
        return "venue_date"
    if gap <= 3 and t >= 0.45 and d is not None and d <= 0.15:
        return "geo_date"
    return None


TITLES = ["Jazz Night", "Jazz Nights", "Comedy Hour", "Comedy Hours Live", "TAUK", "TAUK at The Hall", "Open Mic",
          "Wine Wednesday", "Wino Wednesdays", "Yoga", "Yoga!", "", "Art Walk Opening", "Opening Art Walk", "Big Jazz Brunch", "Comedy Power Hour", "Run", "Runs"]
VENUES = ["The Hall", "The Hall LA", "Grand Gallery", "Grand Galery", "Pier", "Piers", "", "Old Town Theater", "Old Towne Theatre"]


def random_rows(n, seed, first_id=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        spot = rng.choice([(34.01, -118.49), (34.0109, -118.49), (34.03, -118.41), (None, None), (0.0, 0.0)])
        start = datetime(2026, 3, 1) + timedelta(minutes=30 * rng.randrange(0, 70))
        rows.append({
            "id": first_id + i, "title": rng.choice(TITLES), "venue_name": rng.choice(VENUES),
            "source": rng.choice(["a", "b", "c"]), "url": rng.choice(["", "", "http://x/1", "http://x/2 ", f"http://x/{i}"]),
            "event_date": None if rng.random() < 0.05 else start,
            "end_date": start + timedelta(days=rng.choice([1, 3, 9])) if rng.random() < 0.3 else None,
            "latitude": spot[0], "longitude": spot[1],
        })
    return rows


def test_candidates_miss_no_pair(make_listings):
    left, right = random_rows(70, 1, 1000), random_rows(90, 2)
    night = {"event_date": datetime(2026, 6, 1, 20), "venue_name": "The Hall", "url": ""}
    left += [{**night, "id": 2000, "title": "Same Show", "source": "a"}, {**night, "id": 2001, "title": "MOTH", "source": "a"}]
    right += [{**night, "id": 3000, "title": "same show!", "source": "a"},
              {**night, "id": 3001, "title": "Moth at the Hall by the Sea", "source": "b"}]
    a = M.representatives(M.match_facts(make_listings(left)))
    b = M.representatives(M.match_facts(make_listings(right)))
    got = {(r.a_id, r.b_id): r.match_method for r in M.score_pairs(M.candidates(a, b)).where("is_dup").collect()}
    kept_a, kept_b = ({r.id for r in side.collect()} for side in (a, b))
    want = {(x["id"], y["id"]): rule(x, y) for x in left for y in right
            if x["id"] in kept_a and y["id"] in kept_b and rule(x, y)}
    assert len(set(want.values())) >= 6
    assert got == want


def test_best_match_equals_scan(make_listings):
    left, right = random_rows(60, 3, 1000), random_rows(80, 4)
    got = {r.id: (r.match_id, r.match_method) for r in M.best_match(make_listings(left), make_listings(right)).collect()}
    floor = datetime(1900, 1, 1)
    ordered = sorted(right, key=lambda r: (r["event_date"] or floor, r["id"]))

    def scan(x):
        for y in ordered:
            ux, uy = (x["url"] or "").strip(), (y["url"] or "").strip()
            if not ux or ux != uy:
                continue
            gap = abs((x["event_date"] - y["event_date"]).total_seconds()) if x["event_date"] and y["event_date"] else None
            if gap is not None and gap >= 86400:
                continue
            alike = not x["title"] or not y["title"] or ratio(title_of(y), title_of(x)) >= 0.5
            if (gap is not None and gap < 3600) or alike:
                return y["id"], "url"
        long = lambda r: r["event_date"] and r["end_date"] and (r["end_date"] - r["event_date"]).days >= 2
        if long(x) and title_of(x):
            for y in ordered:
                if (long(y) and y["source"] == x["source"] and title_of(y) == title_of(x)
                        and venue_of(x) in ("", venue_of(y))
                        and y["event_date"] <= x["end_date"] and x["event_date"] <= y["end_date"]):
                    return y["id"], "multiday_overlap"
        for y in ordered:
            if x["event_date"] and y["event_date"] and rule(x, y):
                return y["id"], rule(x, y)
        return None

    want = {x["id"]: scan(x) for x in left if scan(x)}
    assert len(want) > 20
    assert got == want


def test_split_keys_lose_no_pair(spark):
    """Crowded keys are split by further shared fragments; the pairs stay those of all pairs."""
    rng = random.Random(8)
    words = ["jazz", "night", "wine", "tasting", "open", "mic", "market", "live", "party"]
    names = {" ".join(rng.choice(words) for _ in range(rng.randrange(1, 7))) for _ in range(120)}
    names = sorted(names | {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(60)})
    df = spark.createDataFrame([(n,) for n in names], "name string")
    want = {(x, y) for x in names for y in names if ratio(x, y) >= 0.85}
    got = [(r.a_name, r.b_name) for r in similar_names(df, df, 0.85, [], pairs_per_key=4).collect()]
    assert len(want) > len(names) and len(got) == len(set(got)) and set(got) == want


def test_first_overlap_equals_scan(make_listings):
    rng = random.Random(11)

    def spans(n, first_id, step):
        rows = []
        for i in range(n):
            start = datetime(2026, 1, 1) + timedelta(hours=rng.randrange(0, 9000), microseconds=rng.choice([0, 7]))
            rows.append({
                "id": first_id + i * step, "title": rng.choice(["Fair", "Show", ""]), "source": rng.choice(["a", "b"]),
                "venue_name": rng.choice(["", None, "Pier", "Hall"]), "event_date": rng.choice([start, start, start, None]),
                "end_date": rng.choice([start + timedelta(days=rng.choice([1, 2, 3, 40])), start, None])})
        return rows

    left, right = spans(600, 1, 1), spans(300, 9000, -1)
    right += [{**right[0], "id": 9500}, {**right[0], "id": 8000}]  # alike but for the id
    facts = [M.match_facts(make_listings(rows)) for rows in (left, right)]
    pairs = {}
    for r in M.dup_by_overlap(*facts).collect():
        pairs.setdefault(r.a_id, []).append((r.b_start, r.b_id))
    want = {a: min(found)[1] for a, found in pairs.items()}
    got = [(r.a_id, r.b_id) for r in M.first_overlap(*facts).collect()]
    assert len(want) > 10 and len(got) == len(want) and dict(got) == want
    assert M.first_overlap(facts[0].limit(0), facts[1]).count() == M.first_overlap(facts[0], facts[1].limit(0)).count() == 0


def test_similar_names_equals_all_pairs(spark):
    rng = random.Random(5)
    names = sorted({"".join(rng.choice("abc ") for _ in range(rng.randrange(1, 14))).strip() or "a" for _ in range(150)})
    df = spark.createDataFrame([(n,) for n in names], "name string")
    for threshold in (0.8, 0.85):
        got = {(r.a_name, r.b_name) for r in similar_names(df, df, threshold, []).collect()}
        assert got == {(x, y) for x in names for y in names if ratio(x, y) >= threshold}


def components(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in pairs:
        x, y = find(x), find(y)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def test_copies_join_the_same_cluster_with_few_pairs(make_listings):
    rows = random_rows(40, 6)
    for copy in range(30):
        rows.append({**rows[0], "id": 500 + copy})
        rows.append({**rows[3], "id": 600 + copy, "url": "", "venue_name": ""})
    pairs = [(r.id_a, r.id_b) for r in M.duplicate_pairs(make_listings(rows)).collect()]
    full = [(y["id"], x["id"]) for x in rows for y in rows if x["id"] > y["id"] and rule(x, y)]
    assert components(pairs) == components(full)
    assert len(pairs) < len(full)
    clusters = {r.id: r.cluster for r in duplicate_clusters(M.duplicate_pairs(make_listings(rows))).collect()}
    assert clusters == components(full)


def test_spans_listed_twice_in_a_batch_are_one(make_listings):
    show = {"title": "Long Show", "venue_name": "Pier", "source": "a"}
    rows = [
        {**show, "id": 1, "url": "u1", "event_date": datetime(2026, 1, 1), "end_date": datetime(2026, 2, 1)},
        {**show, "id": 2, "url": "u2", "event_date": datetime(2026, 1, 4), "end_date": datetime(2026, 2, 3)},
        {**show, "id": 3, "url": "u3", "event_date": datetime(2026, 3, 4), "end_date": datetime(2026, 3, 9)},
        {**show, "id": 4, "url": "u4", "event_date": datetime(2026, 3, 8), "end_date": datetime(2026, 3, 12), "venue_name": ""},
        {**show, "id": 5, "url": "u5", "event_date": datetime(2026, 1, 9), "end_date": datetime(2026, 1, 20), "venue_name": "Loft"},
    ]
    pairs = {(r.id_a, r.id_b) for r in M.duplicate_pairs(make_listings(rows)).collect()}
    assert pairs == {(1, 2), (3, 4)}
    done = E.upsert_batch(make_listings(rows), make_listings([]), "2026-01-01")
    assert done["inserted"].count() == 3


def test_one_key_with_half_the_rows(make_listings):
    day = datetime(2026, 5, 1, 20)
    stored = [{"id": i, "title": f"Show {i}" if i % 2 else "Gala", "venue_name": "Pier", "source": "a",
               "event_date": day + timedelta(days=i % 2 * i), "url": "http://x/all" if i % 2 == 0 else f"u{i}"} for i in range(1, 401)]
    batch = [{"id": 1000 + i, "title": "Gala", "venue_name": "Pier", "source": "b", "event_date": day,
              "url": "http://x/all", "description": f"d{i}"} for i in range(200)]
    got = M.best_match(make_listings(batch), make_listings(stored)).collect()
    assert {(r.match_id, r.match_method) for r in got} == {(2, "url")} and len(got) == 200


def test_clusters_of_chain_star_and_ring(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(200, i) for i in range(201, 260)]
    ring = [(300, 301), (301, 302), (302, 300)]
    df = spark.createDataFrame(chain + star + ring, "id_a bigint, id_b bigint")
    got = {r.id: r.cluster for r in duplicate_clusters(df).collect()}
    assert got == components(chain + star + ring)


def test_upsert_merges_inserts_and_collapses(make_listings):
    day = datetime(2026, 5, 1, 20)
    stored = make_listings([
        {"id": 1, "title": "Jazz Night", "venue_name": "Pier", "source": "a", "event_date": day, "url": "u1", "price": 10.0},
        {"id": 2, "title": "Quiz", "venue_name": "Bar", "source": "Shore Hotel", "event_date": day, "url": "u2"},
    ])
    batch = make_listings([
        {"id": 10, "title": "Jazz Night", "venue_name": "Pier", "source": "b", "event_date": day, "price_note": "Sold out"},
        {"id": 11, "title": "New Thing", "venue_name": "Loft", "source": "b", "event_date": day, "url": "n"},
        {"id": 12, "title": "New Thing", "venue_name": "Loft", "source": "c", "event_date": day},
        {"id": 13, "title": "Quiz", "venue_name": "Bar", "source": "b", "event_date": day, "url": "u3"},
    ])
    done = E.upsert_batch(batch, stored, "2026-04-01")
    table = {r.id: r for r in done["table"].collect()}
    assert sorted(table) == [1, 2, 3]
    assert table[1].price is None and table[1].price_note == "Sold out" and table[1].source == "a"
    assert table[2].source == "b" and table[2].url == "u3"
    assert table[3].title == "New Thing"
    out = {r.id: (r.listing_id, r.was_duplicate) for r in done["outcomes"].collect()}
    assert out == {10: (1, True), 11: (3, False), 12: (3, True), 13: (2, True)}


def test_prune_keeps_past_and_silent_sources(make_listings, spark):
    stored = make_listings([
        {"id": 1, "source": "a", "event_date": datetime(2026, 5, 1)}, {"id": 2, "source": "a", "event_date": datetime(2026, 5, 1)},
        {"id": 3, "source": "a", "event_date": datetime(2026, 3, 1)}, {"id": 4, "source": "b", "event_date": datetime(2026, 5, 1)},
    ])
    touched = spark.createDataFrame([(1,)], "id bigint")
    productive = spark.createDataFrame([("a",)], "source string")
    kept = E.prune_stale(stored, touched, productive, "2026-04-01")
    assert sorted(r.id for r in kept.collect()) == [1, 3, 4]


def test_costly_bound_stays_out_of_the_join(spark):
    names = spark.createDataFrame([("a quiet evening",), ("a quiet evenings",)], "name string")
    found = similar_names(names, names, 0.85, [])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and "array_intersect" in line]
    assert found.count() == 4


def test_wide_slots_and_cells_lose_no_pair(spark):
    pick = random.Random(5)
    first = datetime(1969, 12, 30)
    rows = []
    for i in range(400):
        moment = first + timedelta(seconds=pick.choice([0, 1, 10799, 10800, 43200]) + 10800 * pick.randrange(30))
        lat, lng = pick.choice([0.0, 34.0, -34.0, 89.99]), pick.choice([-118.0, 0.0, 118.0])
        rows.append((i, moment, lat + pick.uniform(-0.004, 0.004), lng + pick.uniform(-0.004, 0.004)))
    df = spark.createDataFrame(rows, "id bigint, start timestamp_ntz, lat double, lng double")

    def apart(a, b):
        return km(*({"latitude": x[2], "longitude": x[3]} for x in (a, b)))

    close = [(a, b) for a in rows for b in rows if abs(a[1] - b[1]) <= timedelta(hours=3)]
    found = {tuple(r) for r in M.geo_time_pairs(df, df).select("a_id", "b_id").collect()}
    assert {(a[0], b[0]) for a, b in close if apart(a, b) <= 0.149} <= found <= {(a[0], b[0]) for a, b in close if apart(a, b) <= 0.151}
    banded = [tuple(r) for r in M.band_join(df, df, 3).select("a_id", "b_id").collect()]
    assert sorted(banded) == sorted((a[0], b[0]) for a, b in close)
    # a row stands in few slots
    assert df.select(M._around(F.col("start"), 10800, 4)).count() <= 2 * len(rows)


def test_every_row_of_a_group_of_copies_is_paired(make_listings):
    """Copies, also under one id, are pairs of their own; an id may stand for unlike rows."""
    from collections import Counter
    from types import SimpleNamespace

    from marquee.plans import load_plans

    left, right = random_rows(25, 21, 1000), random_rows(30, 22)
    show = {"title": "Jazz Night", "venue_name": "Pier", "url": "http://x/9", "event_date": datetime(2026, 3, 1, 20)}
    left += [{**show, "id": 2000 + i, "source": "a"} for i in (0, 1, 1)] + [{**show, "id": 2001, "source": "b", "url": ""}]
    right += [{**show, "id": 3000 + i, "source": "a"} for i in (0, 1, 2)] + [{**left[3], "id": 3002}, {**left[3], "id": 3003}]
    tables = [make_listings(rows) for rows in (left, right)]
    want = Counter((x["id"], y["id"], rule(x, y)) for x in left for y in right if rule(x, y))
    assert want[2001, 3000, "url"] == 2 and sum(n for (a, b, _), n in want.items() if a >= 2000 and b >= 3000) >= 12
    plans = load_plans().PLANS
    for name, views in (("j5_score_pairs", ("spaced_incoming", "spaced")), ("j5_exact_methods", ("incoming", "listings"))):
        got = Counter(tuple(r) for r in plans[name](SimpleNamespace(**dict(zip(views, tables)))).collect())
        if name == "j5_score_pairs":
            assert got == want
        else:
            assert got[2001, 3000, "url"] == 2 and all(n == want[k] for k, n in got.items())


def test_tables_of_a_join_are_not_sent_whole(make_listings):
    """A stored table looks small to the planner, which would send it to the driver and all executors."""
    facts = M.match_facts(make_listings(random_rows(30, 23)))
    reps = M.representatives(facts)
    for found in (M.candidates(reps, reps), M.members(facts, reps), M.dup_by_url(reps, reps), M.geo_time_pairs(reps, reps)):
        joins = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]
        assert "SortMergeJoin" in joins[0]  # the one on top
