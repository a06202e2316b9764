"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Each document gets a rate r, the expected number of its copies. Among all rates of
a source that use its target of words, those closest to one copy each in relative
entropy are wanted: minimise sum b (r log r - r + 1) subject to sum r * size = target
and r <= cap, where b = size ** (1 - tilt) * mean ** tilt weighs a document. The dual
is convex in one variable per source and its solution an exponential tilt,
r = min(cap, exp(lambda * x)) with x = (size / mean) ** tilt. Newton steps on the dual
are one distributed aggregation each; a bracket per source keeps them safe where the
cap bends the curve. ``tilt`` 1 weighs documents alike, 0 weighs words alike.

Rates depend on source and size only, so the steps run over (source, size) counts.
Rates are then rounded to whole copies by carrying the error from the larger sizes
to the smaller: what a bin takes too much or too little the next bins make good.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import WORD, written
from marquee.session import cut_lineage

#: Rates and sums of rates are whole multiples of 2 ** -20, so sums do not depend on their order.
GRID = 1 << 20


@dataclass(frozen=True)
class Mix:
    """Weights repeat over the sources by code point, null last."""

    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    share: float = 1.5
    cap: int = 2
    tilt: float = 0.5
    bins: int = 256
    tolerance: float = 1e-6
    most_steps: int = 80


def sized(docs: DataFrame, text: str = "text") -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sources: DataFrame, mix: Mix) -> DataFrame:
    """Sources (source, source_size) with number, weight and target: the shared level, capped and reshared.

    Sources sorted by cap / weight are capped up to some point; the level of the
    others is what is left over their weights. One row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in mix.weights])
    weighed = (
        sources.withColumn("_no", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(weights, F.pmod("_no", F.lit(len(mix.weights))).cast("int") + 1))
        .withColumn("most", mix.cap * F.col("source_size").cast("double"))
    )
    rising = Window.orderBy(F.col("most") / F.col("weight"), "_no")
    before, after = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    budget = mix.share * F.sum("source_size").over(everything)
    level = (budget - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    leveled = weighed.withColumn("_level", level)
    free = F.when(F.col("most") > F.col("weight") * F.col("_level"), F.col("_level"))
    found = leveled.withColumn("_free", free)
    # the first source that stays below its cap fixes the level of all that follow it
    chosen = F.min(F.when(F.col("_free").isNotNull(), F.struct(
        (F.col("most") / F.col("weight")).alias("r"), F.col("_no").alias("n"), F.col("_free").alias("level")
    ))).over(everything)["level"]
    target = F.least(F.col("most"), F.col("weight") * F.coalesce(chosen, F.lit(float("inf"))))
    return found.select(F.col("_no").alias("no"), *sources.columns, "weight", target.alias("target"))


def _on_grid(x: Column) -> Column:
    return F.round(x * GRID).cast("bigint")


def _rate(mix: Mix, multiplier: Column, x: Column) -> Column:
    """exp(lambda x) up to the cap, on the grid."""
    return F.least(F.lit(mix.cap * GRID).cast("bigint"), _on_grid(F.exp(F.least(multiplier * x, F.lit(5.0)))))


def solve_multipliers(counts: DataFrame, targets: DataFrame, mix: Mix) -> DataFrame:
    """(no, lambda) for each source: Newton on the dual, all sources at once.

    ``counts`` has no, size, x, n; ``targets`` has no, source_size, target. A source
    whose target is its cap, or that has no words, needs no tilt beyond the bracket.
    The driver sees one number per step, the largest relative gap.
    """
    top = F.lit(60.0)
    state = cut_lineage(targets.select(
        "no", "target", F.lit(0.0).alias("lam"), F.lit(-60.0).alias("lo"), top.alias("hi"), F.lit(1.0).alias("gap")))
    for _ in range(mix.most_steps):
        rate = _rate(mix, F.col("lam"), F.col("x"))
        moved = (
            counts.join(state, "no")
            .groupBy("no", "target", "lam", "lo", "hi")
            .agg(
                F.sum((rate * F.col("size") * F.col("n")).cast("decimal(38,0)")).alias("got"),
                F.sum(F.when(rate < mix.cap * GRID, F.round(rate * F.col("size") * F.col("n") * F.col("x")))
                      .otherwise(0).cast("decimal(38,0)")).alias("slope"),
            )
            .withColumn("got", F.col("got").cast("double") / GRID)
            .withColumn("slope", F.col("slope").cast("double") / GRID)
        )
        over = F.col("got") > F.col("target")
        low, high = F.when(over, F.col("lo")).otherwise(F.col("lam")), F.when(over, F.col("lam")).otherwise(F.col("hi"))
        middle = (F.col("lo") + F.col("hi")) / 2
        stepped = (
            moved.withColumn("lo", low).withColumn("hi", high)
            .withColumn("newton", F.round(F.try_divide(F.col("lam") * F.col("slope") - F.col("got") + F.col("target"),
                                                       F.col("slope")), 12))
            .withColumn("gap", F.abs(F.col("got") - F.col("target")) / F.greatest(F.col("target"), F.lit(1.0)))
        )
        inside = (F.col("newton") > F.col("lo")) & (F.col("newton") < F.col("hi"))
        done = F.col("gap") <= mix.tolerance
        state = cut_lineage(stepped.select(
            "no", "target",
            F.when(done, F.col("lam")).when(inside, F.col("newton")).otherwise(middle).alias("lam"),
            "lo", "hi", F.when(F.col("hi") - F.col("lo") < 1e-9, F.lit(0.0)).otherwise(F.col("gap")).alias("gap")))
        worst = state.agg(F.max("gap")).first()[0]
        if worst is None or worst <= mix.tolerance:
            break
    return state.select("no", "lam")


def _rounding(bins: DataFrame) -> DataFrame:
    """(no, octave, bin) of the bins that take one copy more.

    ``bins`` has per source at most 64 octaves times the hash bins, each with its words
    and the words its fractional rates stand for. They are walked from the largest
    sizes down; a bin is taken when more than half of it is owed.
    """
    item = F.struct((-F.col("octave")).alias("o"), F.col("bin").alias("b"), F.col("words").alias("w"), F.col("owed").alias("e"))
    lists = bins.groupBy("no").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def step(state: Column, x: Column) -> Column:
        due = state["due"] + x["e"]
        take = 2 * due > x["w"] * GRID
        return F.struct(
            (due - F.when(take, x["w"] * GRID).otherwise(0)).alias("due"),
            F.when(take, F.concat(state["taken"], F.array(F.struct(x["o"].alias("o"), x["b"].alias("b"))))).otherwise(state["taken"]).alias("taken"),
        )

    start = F.struct(F.lit(0).cast("bigint").alias("due"), F.expr("cast(array() as array<struct<o:int,b:int>>)").alias("taken"))
    taken = F.aggregate("items", start, step)["taken"]
    return lists.select("no", F.explode(taken).alias("t")).select(
        "no", (-F.col("t.o")).alias("octave"), F.col("t.b").alias("bin"), F.lit(1).alias("extra"))


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", mix: Mix = Mix()) -> DataFrame:
    """(id, source, size, source_size, target, rate, copies) for each row.

    Words, sizes and targets count all rows; a null text has size 0 and its source
    counts all the same; the null source is a source of its own. ``copies`` is 0 to the
    cap. A text of size 0 has rate 1 and one copy; it takes no words. Rows alike in id
    and text get the same copies, as do reruns. Without rows the result is empty.
    """
    base = written(docs.select(
        F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{source}`").alias("_source"), sized(docs, text).alias("size"),
        F.pmod(F.xxhash64(F.col(f"`{doc_id}`").cast("string"), F.col(f"`{text}`")), F.lit(mix.bins)).cast("int").alias("bin")), "mix")
    histogram = base.groupBy("_source", "size").agg(F.count(F.lit(1)).alias("n"))
    sums = histogram.groupBy(F.col("_source").alias("source")).agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    numbered = cut_lineage(source_targets(sums, mix))
    mean = F.col("source_size") / F.col("docs")
    x = F.when(F.col("size") > 0, F.round(F.pow(F.col("size") / mean, F.lit(mix.tilt)), 9)).otherwise(F.lit(0.0))

    def tagged(df: DataFrame) -> DataFrame:
        return df.join(numbered, df["_source"].eqNullSafe(numbered["source"])).withColumn("x", x)

    counts = cut_lineage(tagged(histogram).where("size > 0").select("no", "size", "x", "n"))
    solved = numbered.join(solve_multipliers(counts, numbered, mix), "no", "left").withColumn("lam", F.coalesce("lam", F.lit(0.0)))
    octave = F.when(F.col("size") > 0, F.floor(F.log2("size"))).otherwise(0).cast("int")
    full = F.col("target") >= mix.cap * F.col("source_size")
    rate = F.when(F.col("size") == 0, F.lit(GRID)).when(full, F.lit(mix.cap * GRID)).otherwise(_rate(mix, F.col("lam"), F.col("x")))
    rated = base.join(solved, base["_source"].eqNullSafe(solved["source"])).withColumn("x", x).select(
        "_id", "_source", "size", "source_size", "target", "no", "bin", octave.alias("octave"), rate.cast("bigint").alias("rate"))
    part = F.pmod("rate", F.lit(GRID))
    bins = rated.where((F.col("size") > 0) & (part > 0)).groupBy("no", "octave", "bin").agg(
        F.sum("size").alias("words"), F.sum(F.col("size") * part).alias("owed"))
    extra = _rounding(bins)
    rounded = rated.join(extra, ["no", "octave", "bin"], "left")
    more = F.when((F.col("size") > 0) & (part > 0), F.coalesce("extra", F.lit(0))).otherwise(0)
    return rounded.select(
        F.col("_id").alias(doc_id), F.col("_source").alias(source), "size", "source_size", "target",
        (F.col("rate") / GRID).alias("rate"), (F.floor(F.col("rate") / GRID) + more).cast("bigint").alias("copies"))


def take_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", mix: Mix = Mix()) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it; 0 copies drop a row.

    Rows alike in id, text and source fare alike.
    """
    key = [F.col(f"`{doc_id}`").alias("_k0"), F.xxhash64(F.col(f"`{text}`")).alias("_k1"), F.col(f"`{source}`").alias("_k2")]
    mixed = mix_sources(docs.select(F.struct(*key).alias("_key"), F.col(f"`{text}`").alias("_t"), F.col(f"`{source}`").alias("_s")),
                        "_key", "_t", "_s", mix)
    copies = mixed.where("copies > 0").groupBy("_key").agg(F.max("copies").alias("_copies")).select("_key.*", "_copies")
    own = docs.columns
    joined = docs.withColumn("_h", F.xxhash64(F.col(f"`{text}`"))).join(
        copies, F.col(f"`{doc_id}`").eqNullSafe(F.col("_k0")) & (F.col("_h") == F.col("_k1"))
        & F.col(f"`{source}`").eqNullSafe(F.col("_k2")))
    again = joined.withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return again.select([F.col(f"`{c}`") for c in own])
