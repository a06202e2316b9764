"""Faceted, calendar, geographic and phrase search over listings."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee import fixed_values as V
from marquee.functions import text as X
from marquee.functions.dates import day, moment, ntz
from marquee.operators.listings import in_months, page

START, END = "event_date", "end_date"


def _on_days(first: date, after: date) -> Column:
    """Starts on a day in [first, after); a plain range, so scans can skip."""
    return (F.col(START) >= ntz(first)) & (F.col(START) < ntz(after))


def active_on(target: date, as_of) -> Column:
    """starts that day, or spans it and began within 90 days of now."""
    one = timedelta(days=1)
    today = moment(as_of).date()
    spans = (
        (F.col(START) >= ntz(today - timedelta(days=90)))
        & (F.col(START) < ntz(target + one))
        & F.coalesce(F.col(END) >= ntz(target), F.lit(False))
    )
    return _on_days(target, target + one) | spans


def date_predicate(kind: str | None, as_of, specific: str | None = None) -> Column:
    """calendar filter by name; unknown names mean upcoming."""
    today = moment(as_of).date()
    one = timedelta(days=1)
    sunday = today + timedelta(days=(6 - today.weekday()) % 7)
    if kind == "today":
        return active_on(today, as_of)
    if kind == "tomorrow":
        return active_on(today + one, as_of)
    if kind == "today_tomorrow":
        return _on_days(today, today + 2 * one)
    if kind == "this_week":
        return _on_days(today, sunday + 7 * one)
    if kind == "this_weekend":
        saturday = today + timedelta(days=(5 - today.weekday()) % 7)
        late_sunday = sunday + 7 * one
        return _on_days(saturday, saturday + one) | _on_days(late_sunday, late_sunday + one)
    if kind == "this_month":
        first = today.replace(day=1)
        return _on_days(first, (first + timedelta(days=32)).replace(day=1))
    if kind == "specific_date" and specific:
        try:
            chosen = datetime.strptime(specific, "%Y-%m-%d").date()
        except ValueError:
            pass
        else:
            return _on_days(chosen, chosen + one)
    return F.col(START) >= ntz(today)


def date_bounds(kind: str | None, as_of, specific: str | None = None) -> tuple[date, date | None]:
    """Days [first, after) outside of which ``date_predicate`` accepts no start."""
    today, one = moment(as_of).date(), timedelta(days=1)
    sunday = today + timedelta(days=(6 - today.weekday()) % 7)
    first = today.replace(day=1)
    known = {
        "today": (today - 90 * one, today + one),
        "tomorrow": (today - 90 * one, today + 2 * one),
        "today_tomorrow": (today, today + 2 * one),
        "this_week": (today, sunday + 7 * one),
        "this_weekend": (today, sunday + 8 * one),
        "this_month": (first, (first + timedelta(days=32)).replace(day=1)),
    }
    if kind == "specific_date" and specific:
        try:
            chosen = datetime.strptime(specific, "%Y-%m-%d").date()
        except ValueError:
            return today, None
        return chosen, chosen + one
    return known.get(kind, (today, None))


def by_date(df: DataFrame, kind: str | None, as_of, specific: str | None = None) -> DataFrame:
    """F2 applied to a table: months first, then the filter itself."""
    return in_months(df, *date_bounds(kind, as_of, specific)).where(date_predicate(kind, as_of, specific))


def calendar_window(kind: str, as_of) -> tuple[datetime | None, datetime | None]:
    """[start, end) of a named window; unknown names are unbounded."""
    now = moment(as_of)
    today = now.replace(hour=0, minute=0, second=0, microsecond=0)
    month = today.replace(day=1)

    def months_on(n: int) -> datetime:
        index = month.month - 1 + n
        return month.replace(year=month.year + index // 12, month=index % 12 + 1)

    def days_on(n: int) -> datetime:
        return today + timedelta(days=n)

    if kind == "today":
        return today, days_on(1)
    if kind == "tomorrow":
        return days_on(1), days_on(2)
    if kind == "this_week":
        return today, days_on((6 - now.weekday()) % 7 + 1)
    if kind == "this_weekend":
        ahead = (5 - now.weekday()) % 7
        if ahead == 0 and now.hour >= 12:
            ahead = 7
        return days_on(ahead), days_on(ahead + 2)
    if kind == "this_month":
        return today, months_on(1)
    if kind == "next_month":
        return months_on(1), months_on(2)
    if kind == "upcoming":
        return today, None
    return None, None


def between_dates(start=None, end=None) -> Column:
    """start at or after one moment and before another."""
    hit = F.lit(True)
    if start is not None:
        hit = hit & (F.col(START) >= ntz(start))
    if end is not None:
        hit = hit & (F.col(START) < ntz(end))
    return hit


def in_calendar_window(df: DataFrame, kind: str, as_of) -> DataFrame:
    """F3 applied to a table."""
    window = calendar_window(kind, as_of)
    return in_months(df, *window).where(between_dates(*window))


def date_range(df: DataFrame, first, last) -> DataFrame:
    """closed range, by start."""
    return page(in_months(df, first, last).where(F.col(START).between(ntz(first), ntz(last))))


def upcoming(df: DataFrame, as_of, limit: int = 100) -> DataFrame:
    """F8: the next listings from now on."""
    return page(in_months(df, as_of).where(F.col(START) >= ntz(as_of)), limit)


def by_category(df: DataFrame, category: str) -> DataFrame:
    """F17."""
    return page(df.where(F.col("category") == category))


def in_region(region: str | None) -> Column:
    """a missing region counts as westside."""
    if not region:
        return F.lit(True)
    if region == "westside":
        return F.col("region").isNull() | (F.col("region") == "westside")
    return F.col("region") == region


def time_of_day(buckets: list[str] | None) -> Column:
    """start hour in the named buckets; unknown names are ignored."""
    hours = [h for b in buckets or [] for h in V.TIME_OF_DAY_HOURS.get(b, [])]
    return F.hour(START).isin(hours) if hours else F.lit(True)


def in_bounds(bbox, allowlist: list[str] | None = None) -> Column:
    """box test that missing coordinates pass, or a venue let in by name."""
    south, north, west, east = bbox
    boxed = F.lit(True)
    if south is not None and north is not None:
        boxed = boxed & (F.col("latitude").isNull() | F.col("latitude").between(south, north))
    if west is not None and east is not None:
        boxed = boxed & (F.col("longitude").isNull() | F.col("longitude").between(west, east))
    let_in = X.any_term(F.lower(X.text_or_empty("venue_name")), allowlist or [])
    return boxed | let_in


TEXT_FIELDS = ["title", "description", "venue_name"]


def phrase_match(q: str | None, fields: list[str] = TEXT_FIELDS) -> Column:
    """the words of the query stand next to each other in one field.

    An absent query filters nothing; one without words matches nothing.
    """
    if not q:
        return F.lit(True)
    phrase = F.concat(F.lit(" "), F.array_join(X.words(F.lit(q)), " "), F.lit(" "))
    hit = F.lit(False)
    for name in fields:
        body = F.concat(F.lit(" "), F.array_join(X.words(name), " "), F.lit(" "))
        hit = hit | F.contains(body, phrase)
    return hit & (F.size(X.words(F.lit(q))) > 0)


def clean_params(
    limit=None, days=None, date_filter=None, times_of_day=None, region=None
) -> dict[str, object]:
    """clamp numbers, drop unknown names."""
    kinds = {"today", "tomorrow", "today_tomorrow", "this_week", "this_weekend", "this_month",
             "specific_date", "upcoming"}
    return {
        "limit": max(1, min(int(limit), 5000)) if limit is not None else None,
        "days": max(1, min(int(days), 365)) if days is not None else None,
        "date_filter": date_filter if date_filter in kinds else "upcoming",
        "times_of_day": [b for b in times_of_day or [] if b in V.TIME_OF_DAY_HOURS],
        "region": region if region in ("westside", "beyond") else None,
    }


def search(
    df: DataFrame,
    q: str | None = None,
    date_filter: str | None = None,
    specific_date: str | None = None,
    start=None,
    end=None,
    categories: list[str] | None = None,
    sources: list[str] | None = None,
    venues: list[str] | None = None,
    bbox=None,
    is_free: bool | None = None,
    times_of_day: list[str] | None = None,
    region: str | None = None,
    limit: int | None = 100,
    offset: int = 0,
    as_of=None,
) -> DataFrame:
    """all given filters together, one page by start."""
    hit = in_region(region)
    if date_filter:
        df = in_months(df, *date_bounds(date_filter, as_of, specific_date))
        hit = hit & date_predicate(date_filter, as_of, specific_date)
    else:
        df = in_months(df, start, end)
        hit = hit & between_dates(start, end)
    for name, chosen in (("category", categories), ("source", sources), ("venue_name", venues)):
        if chosen:
            hit = hit & F.col(name).isin(chosen)
    if is_free is not None:
        hit = hit & (F.col("is_free") == is_free)
    if bbox is not None:
        hit = hit & in_bounds(bbox, V.VENUE_ALLOWLIST)
    hit = hit & time_of_day(times_of_day) & phrase_match(q)
    return page(df.where(hit), limit, offset)


def preset(df: DataFrame, name: str, as_of, **more) -> DataFrame:
    """F16: a named bundle of filters."""
    return search(df, as_of=as_of, **{"date_filter": "upcoming", **V.PRESETS[name], **more})


def drop_past(df: DataFrame, as_of) -> DataFrame:
    """finished listings leave."""
    return df.where(F.coalesce(END, START) >= ntz(as_of))


def drop_inactive(df: DataFrame, status: str = "status", mode: str | None = None,
                  in_stock: str | None = None) -> DataFrame:
    """cancelled, postponed, virtual and out-of-stock rows leave."""
    kept = ~F.lower(X.text_or_empty(status)).rlike("cancel|postponed")
    if mode:
        kept = kept & (F.lower(X.text_or_empty(mode)) != "virtual")
    if in_stock:
        kept = kept & F.coalesce(F.col(in_stock), F.lit(True))
    return df.where(kept)


def clamp_display_date(df: DataFrame, kind: str, as_of) -> DataFrame:
    """a span that began earlier shows as the day asked for, then re-sorted."""
    if kind not in ("today", "tomorrow"):
        return df
    target = moment(as_of).date() + timedelta(days=kind == "tomorrow")
    shown = F.when(F.col(END).isNotNull(), F.greatest(F.col(START), ntz(target))).otherwise(
        F.col(START)
    )
    return df.withColumn(START, shown).orderBy(F.col(START).asc_nulls_last(), "id")


def map_points(df: DataFrame) -> DataFrame:
    """rows that can be put on a map."""
    return df.where((F.col("latitude") != 0) & (F.col("longitude") != 0)).select(
        "id", "title", "venue_name", "latitude", "longitude", "event_date", "category", "url"
    )


def missing_coords(df: DataFrame) -> DataFrame:
    """rows without coordinates, by source."""
    return (
        df.where(F.col("latitude").isNull() | F.col("longitude").isNull())
        .select("id", "title", "venue_name", "address", "source")
        .orderBy("source", "id")
    )


def is_hero_image() -> Column:
    """a real picture, not the logo of the source."""
    img = F.trim(X.text_or_empty("image_url"))
    logo = F.trim(X.text_or_empty("source_logo_url"))
    return (img != "") & (img != logo) & ~img.startswith("/static/logos/")


def in_targets(df: DataFrame, column: str, terms: list[str]) -> DataFrame:
    """the name contains one of a fixed list of terms."""
    return df.where(X.any_term(F.lower(X.text_or_empty(column)), [t.lower() for t in terms]))


def in_target_set(df: DataFrame, column: str, targets: DataFrame) -> DataFrame:
    """the name, trimmed and lower-cased, is in a candidate table (column ``name``)."""
    key = F.lower(F.trim(X.text_or_empty(column)))
    wanted = targets.select(F.lower("name").alias("__key"))
    return df.withColumn("__key", key).join(wanted, "__key", "left_semi").drop("__key")


def date_bucket(as_of, start: str = START) -> Column:
    """struct(ord, label) of the group a start belongs to."""
    today = moment(as_of).date()
    ahead = F.date_diff(F.to_date(start), day(today))
    week = 6 - today.weekday()

    def bucket(n: int, label: str) -> Column:
        return F.struct(F.lit(n).alias("ord"), F.lit(label).alias("label"))

    return (
        F.when(F.col(start).isNull(), bucket(99, "Date TBA"))
        .when(ahead <= 0, bucket(0, "Today"))
        .when(ahead == 1, bucket(1, "Tomorrow"))
        .when(ahead <= week, bucket(2, "This Week"))
        .when(ahead <= week + 7, bucket(3, "Next Week"))
        .otherwise(bucket(4, "Later"))
    )


def date_buckets(df: DataFrame, as_of) -> DataFrame:
    """Listings with their group, in group order."""
    bucketed = df.withColumn("__b", date_bucket(as_of))
    return (
        bucketed.withColumn("bucket_ord", F.col("__b.ord"))
        .withColumn("bucket", F.col("__b.label"))
        .drop("__b")
        .orderBy("bucket_ord", "event_date", "id")
    )
