"""Categories from keywords, rules and dictionaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee import fixed_values as V
from marquee.functions import text as X
from marquee.operators.listings import set_category
from marquee.operators.staging import staged
from marquee.session import small_table

MAX_DIMENSION_ROWS = 20_000


def keyword_dimension(spark, keywords: Mapping[str, Sequence[str]] = V.CATEGORY_KEYWORDS) -> DataFrame:
    """The keyword dictionary as rows (ord, category, keyword)."""
    rows = [(i, c, k) for i, (c, ks) in enumerate(keywords.items()) for k in ks]
    return small_table(spark, rows, "ord int, category string, keyword string")


def keyword_mapping(dimension: DataFrame) -> dict[str, list[str]]:
    """An edited dimension back as the dictionary the classifier takes.

    The dimension becomes plan literals, so its size is checked.
    """
    rows = dimension.orderBy("ord", "keyword").take(MAX_DIMENSION_ROWS + 1)
    if len(rows) > MAX_DIMENSION_ROWS:
        raise ValueError(f"keyword dimension has more than {MAX_DIMENSION_ROWS} rows")
    mapping: dict[str, list[str]] = {}
    for row in rows:
        mapping.setdefault(row["category"], []).append(row["keyword"])
    return mapping


def with_keyword(dimension: DataFrame, category: str, keyword: str) -> DataFrame:
    """One more keyword, unless the category has it in any letter case."""
    one = dimension.sparkSession.range(1)
    added = one.select(F.lit(category).alias("category"), F.lit(keyword.lower()).alias("keyword"))
    held = dimension.select("category", F.lower("keyword").alias("keyword"))
    fresh = added.join(held, ["category", "keyword"], "left_anti")
    order = dimension.agg(
        F.coalesce(
            F.max(F.when(F.col("category") == category, F.col("ord"))), F.max("ord") + 1, F.lit(0)
        ).alias("ord"),
        F.lit(category).alias("category"),
    )
    return dimension.unionByName(fresh.join(order, "category").select("ord", "category", "keyword"))


def _searched() -> Column:
    return F.lower(
        F.concat_ws(" ", *[X.text_or_empty(c) for c in ("title", "description", "venue_name")])
    )


def _with_hits(df: DataFrame, keywords: Mapping[str, Sequence[str]]) -> DataFrame:
    """Adds the lower-cased venue and, per keyword found in the texts, the places of its categories.

    The texts are walked once for all keywords. A keyword that a category lists twice counts twice.
    """
    places: dict[str, list[int]] = {}
    for order, terms in enumerate(keywords.values()):
        for term in terms:
            places.setdefault(term.lower(), []).append(order)
    texts = staged(df, {"__text": _searched(), "__venue": F.lower(X.text_or_empty("venue_name"))})
    found = staged(texts, {"__found": X.terms_in(F.col("__text"), places)}).drop("__text")
    if not places:
        return found.withColumn("__hits", F.array().cast("array<int>")).drop("__found")
    lookup = F.create_map(*[x for t, ps in places.items() for x in (F.lit(t), F.array(*map(F.lit, ps)))])
    hits = F.flatten(F.transform("__found", lambda t: F.element_at(lookup, t)))
    return staged(found, {"__hits": hits}).drop("__found")


def _hits(order: int) -> Column:
    """How many keywords of the category at this place the texts contain."""
    return F.size(F.filter("__hits", lambda place: place == order))


def category_scores(
    keywords: Mapping[str, Sequence[str]] = V.CATEGORY_KEYWORDS,
    venues: Mapping[str, Sequence[str]] = V.CATEGORY_VENUES,
    priorities: Mapping[str, float] = V.CATEGORY_PRIORITY,
) -> Column:
    """Array of (score, minus order, category), one per category."""
    scored = []
    for order, category in enumerate(keywords):
        raw = _hits(order).cast("double")
        if category in venues:
            raw = raw + F.when(X.any_term(F.col("__venue"), venues[category]), 5.0).otherwise(0.0)
        scored.append(
            F.struct(
                (raw * F.lit(priorities.get(category, 1.0))).alias("score"),
                F.lit(-order).alias("order"),
                F.lit(category).alias("category"),
            )
        )
    return F.array(*scored)


def classify(
    df: DataFrame, column: str = "category", keywords: Mapping[str, Sequence[str]] = V.CATEGORY_KEYWORDS, **dimensions
) -> DataFrame:
    """Category with the highest weighted score, first listed on ties, else Other.

    Row-local: no join and no shuffle.
    """
    scored = staged(_with_hits(df, keywords), {"__best": F.array_max(category_scores(keywords, **dimensions))})
    best = F.col("__best")
    chosen = F.when(best["score"] > 0, best["category"]).otherwise(F.lit("Other"))
    return scored.withColumn(column, chosen).drop("__venue", "__hits", "__best")


def classify_multi(
    df: DataFrame,
    threshold: int = 2,
    column: str = "categories",
    keywords: Mapping[str, Sequence[str]] = V.CATEGORY_KEYWORDS,
) -> DataFrame:
    """Every category with enough hits, in dictionary order, else [Other]."""
    named = F.array(
        *[F.when(_hits(order) >= threshold, F.lit(c)) for order, c in enumerate(keywords)]
    )
    found = staged(_with_hits(df, keywords), {"__found": F.array_compact(named)})
    chosen = F.when(F.size("__found") > 0, F.col("__found")).otherwise(F.array(F.lit("Other")))
    return found.withColumn(column, chosen).drop("__venue", "__hits", "__found")


def reclassify(df: DataFrame, **dimensions) -> DataFrame:
    """C4: (id, category, new_category, changed) for every row."""
    fresh = classify(df, "new_category", **dimensions).select("id", "category", "new_category")
    return fresh.withColumn("changed", ~F.col("category").eqNullSafe(F.col("new_category")))


def reclassify_retired(
    df: DataFrame, as_of, retired: Sequence[str] = tuple(V.RETIRED_CATEGORIES), **dimensions
) -> DataFrame:
    """Rows in a retired category get a new one; the others stay as they are."""
    return set_category(df, retired_changes(df, retired, **dimensions), as_of)


def retired_changes(
    df: DataFrame, retired: Sequence[str] = tuple(V.RETIRED_CATEGORIES), **dimensions
) -> DataFrame:
    """The (id, category) changes a reclassification makes."""
    moved = df.where(F.col("category").isin(list(retired)))
    return classify(moved, **dimensions).select("id", "category")


def reclass_counts(changes: DataFrame) -> DataFrame:
    """Rows moved per new category."""
    return changes.groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy("category")


def rule_category(
    df: DataFrame, text: str, rules: Sequence[tuple[str, str]], default: str,
    column: str = "category",
) -> DataFrame:
    """Category of the first rule whose keyword the text contains."""
    low = F.lower(X.text_or_empty(text))
    chosen = F.lit(default)
    for keyword, category in reversed(list(rules)):
        chosen = F.when(low.contains(keyword), F.lit(category)).otherwise(chosen)
    return df.withColumn(column, chosen)


def category_tags(spark: SparkSession) -> DataFrame:
    """The shipped dictionary (tag, category)."""
    return small_table(spark, list(V.CATEGORY_TAGS.items()), "tag string, category string")


def map_category(
    df: DataFrame, raw: str, dimension: DataFrame, default: str = "Other", column: str = "category"
) -> DataFrame:
    """Category of an exact tag (dimension columns tag, category)."""
    named = dimension.select(F.lower("tag").alias("__tag"), F.col("category").alias("__category"))
    joined = df.withColumn("__tag", F.lower(X.text_or_empty(raw))).join(named, "__tag", "left")
    chosen = F.coalesce("__category", F.lit(default))
    return joined.withColumn(column, chosen).drop(*{"__tag", "__category"} - {column})
