"""Exact quantiles without a task that sees all values: nested histograms narrow down the ranks that are asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cut import rounds

#: Distinct values of a bucket that are put in order at once, and buckets of a level.
FEW, BUCKETS = 10_000, 4096
#: Buckets of the first level for each doubling of a value.
PER_DOUBLING = 64
#: The smallest double.
TINY = 2.0**-1074


def _first(value: Column) -> Column:
    """A bucket that grows with the value: its logarithm, mirrored for negative ones."""
    size = (F.floor(F.log2(F.greatest(F.abs(value), F.lit(TINY))) * PER_DOUBLING) + 1075 * PER_DOUBLING).cast("long")
    return F.when(value == 0, F.lit(0).cast("long")).when(value < 0, -size - 1).otherwise(size + 1)


def _ranks(quantiles: dict[str, float]) -> Column:
    """A row for each quantile and each of the two ranks (from 0) between which it lies."""
    at = [F.struct(F.lit(name).alias("name"), (F.col("total") - 1).cast("double").alias("last"), F.lit(q).alias("q")) for name, q in quantiles.items()]
    both = F.transform(F.array(*at), lambda x: F.struct(x["name"].alias("name"), (x["last"] * x["q"]).alias("place")))
    return F.flatten(F.transform(both, lambda x: F.array(*(F.struct(x["name"].alias("name"), x["place"].alias("place"), f(x["place"]).cast("long").alias("rank")) for f in (F.floor, F.ceil)))))


_holds = "within < upto AND within >= upto - n"


def exact_quantiles(rows: DataFrame, value: str, quantiles: dict[str, float], *keys: str, few: int = FEW, weight: str | None = None) -> DataFrame:
    """keys and a column for each of quantiles (name: share): exact, with linear interpolation between ranks, of each group's values.

    Equal values are counted first, so that a frequent value is one row. Of a group's histogram by logarithm the buckets that hold the
    ranks are found by running sums, and only their values are counted again, in buckets of equal width, until few distinct values
    are left, which are put in order. A column weight holds how often a row counts (a whole number, above 0). So a task sees at most as many rows of a group as there are buckets, or few. Nulls and NaN don't
    count; a group of them alone, and without keys an empty table, has nulls.
    """
    number = F.col(f"`{value}`").cast("double")
    # one column for the keys, whose missing parts are equal to each other
    key = F.struct(F.lit(0).alias("one"), *(F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys))).alias("k")
    with rounds(rows.sparkSession) as cut:
        times = F.col(f"`{weight}`").cast("long") if weight else F.lit(1).cast("long")
        each = rows.select(key, F.when(~F.isnan(number), number + 0.0).alias("v"), times.alias("times"))
        counts = cut(each.groupBy("k", "v").agg(F.sum(F.when(F.col("v").isNotNull(), F.col("times")).otherwise(0)).alias("n")))
        # a group without a value keeps one row, so that it is seen
        totals = counts.groupBy("k").agg(F.sum("n").alias("total"))
        asked = totals.where("total > 0").withColumn("r", F.explode(_ranks(quantiles))).select("k", "r.name", "r.place", "r.rank").distinct()
        # the values of the buckets in question, each of which is a group of its own at the next level; ranks count within it
        own, level = ["k"], counts.where("n > 0").select("k", "v", "n", _first(F.col("v")).alias("b"))
        state, found = cut(asked.withColumn("within", F.col("rank"))), None
        while True:
            hist = level.groupBy(*own, "b").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"), F.min("v").alias("low"), F.max("v").alias("high"))
            span = hist.withColumn("upto", F.sum("n").over(W.partitionBy(*own).orderBy("b")))
            hit = cut(span.join(state, own).where(_holds).withColumn("within", F.col("within") - (F.col("upto") - F.col("n"))).drop("upto", "n"))
            small = (F.col("kinds") <= few) | (F.col("low") == F.col("high"))
            done, more = hit.where(small), hit.where(~small)
            order = F.sum("n").over(W.partitionBy(*own, "b").orderBy("v"))
            values = level.join(done.select(*own, "b").distinct(), [*own, "b"], "left_semi").withColumn("upto", order)
            at = cut(values.join(done, [*own, "b"]).where(_holds).select("k", "name", "place", "rank", "v"))
            found = at if found is None else found.union(at)
            if more.isEmpty():
                break
            step = f"b{len(own)}"
            bounds = more.select(*own, "b", "low", "high").distinct()
            width = F.greatest((F.col("high") - F.col("low")) / BUCKETS, F.lit(TINY))
            place = F.least(F.floor((F.col("v") - F.col("low")) / width), F.lit(BUCKETS - 1)).cast("long")
            level = cut(level.join(bounds, [*own, "b"]).select(*own, F.col("b").alias(step), "v", "n", place.alias("b")))
            state = more.select(*own, F.col("b").alias(step), "name", "place", "rank", "within")
            own = [*own, step]
        low, high = F.floor("place"), F.ceil("place")
        one, two = F.max(F.when(F.col("rank") == low, F.col("v"))), F.max(F.when(F.col("rank") == high, F.col("v")))
        place = F.max("place")
        between = F.when(place == F.floor(place), one).otherwise((F.ceil(place) - place) * one + (place - F.floor(place)) * two)
        wide = found.groupBy("k", "name").agg(between.alias("v")).groupBy("k").pivot("name", list(quantiles)).agg(F.max("v"))
        every = totals.select("k") if keys else rows.sparkSession.range(1).select(F.struct(F.lit(0).alias("one")).alias("k"))
        return cut(every.join(wide, "k", "left").select(*(F.col(f"k.k{i}").alias(name) for i, name in enumerate(keys)), *quantiles))
