"""Exact percentiles of groups of any size: ranges of values are narrowed by counts until few values are left in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.plans.lineage import cut

BINS = 1024
BOUND = 1 << 16


def _halves(x: Column) -> tuple[Column, Column]:
    """A double as the sum of two of half its digits."""
    wide = x * 134217729.0
    high = wide - (wide - x)
    return high, x - high


def _between(low: Column, high: Column, at: Column) -> Column:
    """The value at the place ``at`` between two neighbours, ``low * (1 - share) + high * share``.

    The first product is not rounded before it is added, as in the compiled SQL of the oracles (a fused multiply-add): what it loses is
    worked out from halves and added last. Values too large to be halved are taken as they come.
    """
    share = at - F.floor(at)
    rest, z = 1 - share, high * share
    p = low * rest
    (a, b), (c, d) = _halves(low), _halves(rest)
    lost = ((a * c - p) + a * d + b * c) + b * d
    s = p + z
    back = s - p
    fused = s + (((p - (s - back)) + (z - back)) + lost)
    return F.when(low == high, low).when(F.greatest(F.abs(low), F.abs(high)) < 1e290, fused).otherwise(p + z)


def percentiles(df: DataFrame, keys: list[str], value: str, qs: list[float], bins: int = BINS, bound: int = BOUND) -> DataFrame:
    """``(*keys, n, p)``: the percentiles ``qs`` of each group's finite values, in a straight line between the two nearest values.

    Where no group has more than ``bound`` values one aggregate does it. Else each rank asked for has a range of values; a round
    counts it in ``bins`` equal parts and keeps the part with the rank, until that holds ``bound`` values at most or only one
    distinct value. So a task sees at most ``bins`` counts or ``bound`` values of a rank. Keys are not null; a group without a finite value has no row.
    """
    v = df.select(*keys, F.col(value).cast("double").alias("v")).where(F.abs("v") < float("inf"))
    sizes = v.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    if (sizes.agg(F.max("n")).first()[0] or 0) <= bound:
        own = v.groupBy(*keys).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("v")).alias("vs"))
        place = lambda q: F.lit(q) * (F.col("n") - 1)
        value_at = lambda i: F.get("vs", i.cast("int"))
        return own.select(*keys, "n", F.array(*(_between(value_at(F.floor(place(q))), value_at(F.ceil(place(q))), place(q)) for q in qs)).alias("p"))
    at = [F.lit(q) * (F.col("n") - 1) for q in qs]
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(a), F.ceil(a)) for a in at))))
    ranges = cut(sizes.select(*keys, "n", F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("skip"), F.col("n").alias("left"), "lo", "hi"))
    wide, inside = (F.col("left") > bound) & (F.col("lo") < F.col("hi")), F.col("v").between(F.col("lo"), F.col("hi"))
    of = [*keys, "lo", "hi"]
    share = F.try_divide(F.col("v") / 2 - F.col("lo") / 2, F.col("hi") / 2 - F.col("lo") / 2)
    part = F.when(F.col("v") == F.col("hi"), bins - 1).when(F.col("v") == F.col("lo"), 0).otherwise(F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins), F.lit(bins - 1)))
    while not ranges.where(wide).isEmpty():
        counts = v.join(ranges.where(wide).select(*of).distinct(), keys).where(inside).groupBy(*of, part.cast("int").alias("part")).agg(F.count("*").alias("c"), F.min("v").alias("lo2"), F.max("v").alias("hi2"))
        before = counts.withColumn("before", F.sum("c").over(Window.partitionBy(*of).orderBy("part")) - F.col("c"))
        place = F.col("rank") - F.col("skip") - F.col("before")
        next_ = ranges.where(wide).join(before, of).where((place >= 0) & (place < F.col("c")))
        ranges = cut(ranges.where(~wide).unionByName(next_.select(*keys, "n", "rank", (F.col("skip") + F.col("before")).alias("skip"), F.col("c").alias("left"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"))))
    upto = F.sum("c").over(Window.partitionBy(*keys, "rank").orderBy("v"))
    tied = v.join(ranges.where("lo < hi"), keys).where(inside).groupBy(*keys, "n", "rank", "skip", "v").agg(F.count("*").alias("c")).withColumn("upto", upto)
    place = F.col("rank") - F.col("skip")
    found = tied.where((place < F.col("upto")) & (place >= F.col("upto") - F.col("c"))).select(*keys, "n", "rank", F.col("v").alias("x"))
    values = ranges.where("lo = hi").select(*keys, "n", "rank", F.col("lo").alias("x")).unionByName(found)
    by_rank = values.groupBy(*keys, "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("m"))
    low, high = (lambda a: F.element_at("m", F.floor(a))), (lambda a: F.element_at("m", F.ceil(a)))
    return by_rank.select(*keys, "n", F.array(*(_between(low(a), high(a), a) for a in at)).alias("p"))
