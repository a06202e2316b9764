"""Facts as of a moment against a direct search, and the versions that changes write."""

import random
from datetime import datetime, timedelta

from marquee.operators import history as H
from marquee.operators import listings as L
from marquee.session import job_folder

VERSION = "event_id bigint, valid_from timestamp_ntz, gone boolean, source string, category string"
CLICK = "id bigint, event_id bigint, created_at timestamp_ntz, source string, category string, interaction_type string"
NEW_YEAR = datetime(2026, 1, 1)


def test_facts_at_equal_a_search(spark):
    rng = random.Random(3)

    def moment():
        at = NEW_YEAR + timedelta(days=rng.randrange(0, 200), microseconds=rng.choice([0, 0, 5]))
        return None if rng.random() < 0.05 else at

    ids = [None, 1, 1, 1, 2, 3, 4]  # one listing is hot
    versions = [(rng.choice(ids), moment(), rng.random() < 0.2, rng.choice(["a", "b"]), rng.choice(["Music", None])) for _ in range(120)]
    clicks = [(i, rng.choice([*ids, 99]), moment(), "old", "old", "click") for i in range(400)]
    clicks += clicks[:5]  # repeated rows
    key = lambda v: (v[1], v[2], v[3], v[4] is not None, v[4] or "")

    def search(event_id, at):
        known = [v for v in versions if None not in (event_id, at, v[1]) and v[0] == event_id and v[1] <= at]
        best = max(known, key=key) if known else None
        return (best[3], best[4]) if best and not best[2] else (None, None)

    want = sorted((c[0], str(search(c[1], c[2]))) for c in clicks)
    out = H.facts_at(spark.createDataFrame(clicks, CLICK), spark.createDataFrame(versions, VERSION), block_days=9)
    assert sorted(out.columns) == sorted(["id", "event_id", "created_at", "source", "category", "interaction_type"])
    assert sorted((r.id, str((r.source, r.category))) for r in out.collect()) == want
    bare = H.facts_at(spark.createDataFrame(clicks, CLICK), spark.createDataFrame([], VERSION))
    assert bare.where("source is null and category is null").count() == len(clicks)
    assert H.facts_at(spark.createDataFrame([], CLICK), spark.createDataFrame(versions, VERSION)).count() == 0


def test_a_click_keeps_the_category_it_had(spark, make_listings):
    first = make_listings([{"id": i, "category": c, "created_at": NEW_YEAR} for i, c in enumerate(["Music", "Art", None])])
    moved = spark.createDataFrame([(0, "Tech"), (1, "Art")], "id bigint, category string")
    second = L.set_category(first, moved, "2026-02-01 00:00:00")
    third = L.delete(second, spark.createDataFrame([(1,)], "id bigint"))
    path = job_folder(spark, "versions")
    H.append_versions(H.opened(first, first["created_at"]), path)
    H.append_versions(H.changed(first, second, "2026-02-01 00:00:00"), path)
    H.append_versions(H.changed(second, third, "2026-03-01 00:00:00"), path)
    stored = H.read_versions(spark, path)
    # listing 1 took the category it had: no version for that
    assert sorted((r.event_id, r.valid_from.month, r.gone) for r in stored.collect()) == [
        (0, 1, False), (0, 2, False), (1, 1, False), (1, 3, True), (2, 1, False)]
    clicks = [(10 * m + e, e, datetime(2026, m, 1), None, None, "click") for e in range(3) for m in (1, 2, 3)]
    got = {r.id: r.category for r in H.facts_at(spark.createDataFrame(clicks, CLICK), stored).collect()}
    assert got == {10: "Music", 20: "Tech", 30: "Tech", 11: "Art", 21: "Art", 31: None, 12: None, 22: None, 32: None}
