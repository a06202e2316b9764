"""Operators that follow rows in order.

Positions are integers. Running state over a key is computed in two levels:
inside blocks of positions, then over one summary row per block. A key that
holds a large share of all rows is thus spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee import fixed_values as V
from marquee.functions import text as X

BLOCK = 100_000


def _with_block(df: DataFrame, order: str, block: int) -> DataFrame:
    return df.withColumn("__block", F.floor(F.col(order) / block))


def carry_forward(
    df: DataFrame, keys: list[str], order: str, header: str, out: str, block: int = BLOCK
) -> DataFrame:
    """Each row takes the last non-null header at or above it."""
    rows = _with_block(df, order, block)
    known = F.when(F.col(header).isNotNull(), F.col(order))
    tails = rows.groupBy(*keys, "__block").agg(F.max_by(header, known).alias("__tail"))
    above = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(
        *keys, "__block", F.last("__tail", ignorenulls=True).over(above).alias("__carried")
    )
    inside = Window.partitionBy(*keys, "__block").orderBy(order)
    return (
        rows.withColumn("__local", F.last(header, ignorenulls=True).over(inside))
        .join(carried, [*keys, "__block"])
        .withColumn(out, F.coalesce("__local", "__carried"))
        .drop("__block", "__local", "__carried")
    )


def running_count(
    df: DataFrame, keys: list[str], order: str, flag: Column, out: str, block: int = BLOCK
) -> DataFrame:
    """Rows at or above this one for which the flag holds."""
    rows = _with_block(df, order, block).withColumn("__flag", F.coalesce(flag, F.lit(False)).cast("int"))
    totals = rows.groupBy(*keys, "__block").agg(F.sum("__flag").alias("__n"))
    above = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        *keys, "__block", F.coalesce(F.sum("__n").over(above), F.lit(0)).alias("__before")
    )
    inside = Window.partitionBy(*keys, "__block").orderBy(order)
    return (
        rows.withColumn("__local", F.sum("__flag").over(inside))
        .join(before, [*keys, "__block"])
        .withColumn(out, F.col("__local") + F.col("__before"))
        .drop("__block", "__flag", "__local", "__before")
    )


def segment(
    df: DataFrame, keys: list[str], order: str, is_heading: Column, text: str, link: str,
    block: int = BLOCK,
) -> DataFrame:
    """One row per heading with the text below it and the first link.

    Rows above the first heading belong to nothing and leave.
    """
    rows = running_count(
        df.withColumn("__head", F.coalesce(is_heading, F.lit(False))),
        keys, order, F.col("__head"), "segment", block,
    ).where(F.col("segment") > 0)
    part = F.when(~F.col("__head") & (X.text_or_empty(text) != ""), F.struct(order, text))
    linked = F.when(X.text_or_empty(link) != "", F.col(order))
    return rows.groupBy(*keys, "segment").agg(
        F.max(F.when(F.col("__head"), F.col(text))).alias("title"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(part)), lambda p: p[text]), " "
        ).alias("body"),
        F.min_by(link, linked).alias("link"),
    )


_MONTH_NAMES = [
    "january", "february", "march", "april", "may", "june", "july", "august", "september",
    "october", "november", "december",
]


def day_pairs(text) -> Column:
    """Distinct (month, day) of prose where days inherit the month before them."""
    months = "|".join(_MONTH_NAMES)
    found = F.transform(
        F.regexp_extract_all(
            F.lower(X.text_or_empty(text)),
            F.lit(rf"\b({months}|\d{{1,2}}(?:st|nd|rd|th))\b"),
            F.lit(1),
        ),
        lambda s: s,
    )
    numbered = F.array(*[F.lit(m) for m in _MONTH_NAMES])
    empty = F.array().cast("array<struct<month:int,day:int>>")
    start = F.struct(F.lit(0).alias("month"), empty.alias("pairs"))

    def step(acc: Column, token: Column) -> Column:
        month = F.array_position(numbered, token).cast("int")
        day = F.regexp_extract(token, r"^(\d+)", 1).try_cast("int")
        pair = F.struct(acc["month"].alias("month"), day.alias("day"))
        usable = (month == 0) & (acc["month"] > 0) & day.between(1, 31)
        return F.struct(
            F.when(month > 0, month).otherwise(acc["month"]).alias("month"),
            F.when(usable, F.array_append(acc["pairs"], pair)).otherwise(acc["pairs"]).alias("pairs"),
        )

    return F.array_distinct(F.aggregate(found, start, step)["pairs"])


def expand_day_tokens(df: DataFrame, text: str) -> DataFrame:
    """One row per (month, day) the text names."""
    return df.select("*", F.explode(day_pairs(text)).alias("__p")).select(
        *df.columns, F.col("__p.month").alias("month"), F.col("__p.day").alias("day")
    )


def _ranked(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows per key. Spark cuts each task to k rows per key before the shuffle."""
    ranked = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("__rn") <= k).drop("__rn")


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The earliest arrival per key."""
    return _ranked(df, keys, [F.asc(c) for c in order], 1)


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest arrival per key."""
    return _ranked(df, keys, [F.desc(c) for c in order], 1)


def cap_per_group(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """At most k rows per key, earliest first."""
    return _ranked(df, keys, [F.asc(c) for c in order], k)


def regroup(df: DataFrame, key: list[str], order: str, text: str) -> DataFrame:
    """Fragments of one item put together in page order.

    The first fragment that is a weekday gives the weekday, the first other one
    the title, the rest the description. Items without both leave.
    """
    names = F.array(*[F.lit(d) for d in V.WEEKDAYS])
    cleaned = df.withColumn("__t", X.squeeze(text)).where(F.col("__t") != "")
    items = cleaned.groupBy(*key).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(order, "__t"))), lambda p: p["__t"]
        ).alias("__parts"),
        F.min(order).alias("__first"),
    )
    is_day = lambda p: F.array_contains(names, F.lower(p))
    days, rest = F.filter("__parts", is_day), F.filter("__parts", lambda p: ~is_day(p))
    return (
        items.where((F.size(days) > 0) & (F.size(rest) > 0))
        .select(
            *key,
            F.col("__first").alias("first_pos"),
            (F.array_position(names, F.lower(F.get(days, F.lit(0)))) - 1).cast("int").alias("weekday"),
            F.get(rest, F.lit(0)).alias("title"),
            F.array_join(F.slice(rest, 2, F.greatest(F.size(rest) - 1, F.lit(0))), " ").alias("description"),
        )
    )
