"""Zonal sums of pixels, correlations, quantile groups, presence by rings, and ordered hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ratios import rank_quartile, ratio
from .cut import rounds


def zonal_sums(pixels: DataFrame, urban: list[int], city: list[int]) -> DataFrame:
    """zone, pop, urban_pop, city_pop, pixels and shares, from (zone, pop, class); zone 0 is outside, negative population is none."""
    pop = F.greatest(F.col("pop"), F.lit(0.0))
    sums = pixels.where("zone <> 0").groupBy("zone").agg(
        F.sum(pop).alias("pop"),
        F.sum(F.when(F.col("class").isin(urban), pop).otherwise(0.0)).alias("urban_pop"),
        F.sum(F.when(F.col("class").isin(city), pop).otherwise(0.0)).alias("city_pop"),
        F.count("*").alias("pixels"),
    )
    return sums.withColumns({"urban_share": ratio(F.col("urban_pop"), F.col("pop")), "city_share": ratio(F.col("city_pop"), F.col("pop"))})


def correlations(rows: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """r_xy, r_xz, r_yz and the partial correlation of x and y given z, null where z explains one of them fully."""
    r = rows.agg(F.corr(x, y).alias("r_xy"), F.corr(x, z).alias("r_xz"), F.corr(y, z).alias("r_yz"))
    left = F.greatest(F.lit(0.0), (1 - F.col("r_xz") * F.col("r_xz")) * (1 - F.col("r_yz") * F.col("r_yz")))
    partial = F.try_divide(F.col("r_xy") - F.col("r_xz") * F.col("r_yz"), F.sqrt(left))
    return r.withColumn("r_xy_z", partial)


def ranked(rows: DataFrame, *by: str) -> DataFrame:
    """rows with rank (from 1, in the order of columns that tell all rows apart) and rows, their number.

    Rows are dealt to ranges and ranked within each; what the ranges before hold is added. So no task sees all rows.
    """
    with rounds(rows.sparkSession) as cut:
        dealt = cut(rows.repartitionByRange(*by).withColumn("range", F.spark_partition_id()))
        counts = dealt.groupBy("range").agg(F.count("*").alias("n"))
        # one row a range
        before = counts.select("range", (F.sum("n").over(W.orderBy("range")) - F.col("n")).alias("before"), F.sum("n").over(W.partitionBy()).alias("rows"))
        within = F.row_number().over(W.partitionBy("range").orderBy(*by))
        return cut(dealt.withColumn("within", within).join(F.broadcast(before), "range").withColumn("rank", F.col("before") + F.col("within")).drop("range", "within", "before"))


def quartile_means(zones: DataFrame, key: str, by: str, *values: str) -> DataFrame:
    """Means of values in the quarters of a rank by a column (ties by key)."""
    grouped = ranked(zones, by, key).withColumn("quarter", rank_quartile(F.col("rank"), F.col("rows")))
    return grouped.groupBy("quarter").agg(F.count("*").alias("n"), *(F.avg(v).alias(v) for v in values))


def ring_table(presence: DataFrame, keys: list[str], ring: str, rings: list[int], value: str = "population") -> DataFrame:
    """One column r<i> per ring, 0 where there is none, with total, local share (ring of the smallest number) and outside share."""
    wide = presence.where(F.col(ring).isin(rings)).groupBy(*keys).pivot(ring, rings).agg(F.sum(value))
    named = wide.select(*keys, *(F.coalesce(F.col(f"`{r}`"), F.lit(0.0)).alias(f"r{r}") for r in rings))
    total = sum((F.col(f"r{r}") for r in rings[1:]), F.col(f"r{rings[0]}"))
    return named.withColumn("total", total).withColumn("local_share", ratio(F.col(f"r{rings[0]}"), F.col("total"))).withColumn("outside_share", 1 - F.col("local_share"))


def day_night(presence: DataFrame, keys: list[str], floor: float = 10.0) -> DataFrame:
    """day, night and their ratio for keys that have both, neither below the suppression floor."""
    wide = presence.groupBy(*keys).agg(F.sum(F.when(F.col("timezone") == 0, F.col("population"))).alias("day"), F.sum(F.when(F.col("timezone") == 1, F.col("population"))).alias("night"))
    return wide.where((F.col("day") >= floor) & (F.col("night") >= floor)).withColumn("day_night", F.col("day") / F.col("night"))


def forward_fill(sheet: DataFrame, outer: str, inner: str, block: str, order: str = "row_idx", ranges: int | None = None) -> DataFrame:
    """Fills two levels of an ordered sheet downwards: outer_filled to the next outer, inner_filled to the next inner or outer; section
    counts the outers so far.

    block is the column that tells sheets apart, order one that tells their rows apart. Sheets are dealt to ranges of rows and filled
    within each; a range leaves one row that says what it hands on, and gets what the ranges before it in its sheet have left. So no
    task sees a whole sheet.
    """
    with rounds(sheet.sparkSession) as cut:
        by = (F.col(block), F.col(order))
        dealt = cut((sheet.repartitionByRange(ranges, *by) if ranges else sheet.repartitionByRange(*by)).withColumn("__range", F.spark_partition_id()))
        down = W.partitionBy(block, "__range").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
        within = W.partitionBy(block, "__range", "__own").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
        filled = dealt.withColumns({"__own": F.count(outer).over(down), "__outer": F.last(outer, ignorenulls=True).over(down)}).withColumn("__inner", F.last(inner, ignorenulls=True).over(within))
        # the last row of a range: its sections, its last outer, and its last inner unless an outer came after it
        last = F.max_by(F.struct("__own", "__outer", "__inner"), F.col(order))
        ends = filled.groupBy(block, "__range").agg(last.alias("e"))
        before = W.partitionBy(block).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
        news = F.when((F.col("e.__own") > 0) | F.col("e.__inner").isNotNull(), F.struct(F.col("e.__inner").alias("i")))
        # one row a range
        carried = ends.select(
            F.col(block).alias("__block"), F.col("__range").alias("__at"), F.coalesce(F.sum("e.__own").over(before), F.lit(0)).alias("__sections"), F.last("e.__outer", ignorenulls=True).over(before).alias("__outer_in"), F.last(news, ignorenulls=True).over(before)["i"].alias("__inner_in")
        )
        whole = filled.join(carried, F.col(block).eqNullSafe(F.col("__block")) & (F.col("__range") == F.col("__at")))
        inner_filled = F.when(F.col("__own") > 0, F.col("__inner")).otherwise(F.coalesce("__inner", "__inner_in"))
        return cut(whole.select(*(F.col(f"`{c}`") for c in sheet.columns), (F.col("__sections") + F.col("__own")).alias("section"), F.coalesce("__outer", "__outer_in").alias("outer_filled"), inner_filled.alias("inner_filled")))


def best_per_key(rows: DataFrame, key: str, value: str, tie: str) -> DataFrame:
    """The row with the largest value of each key; ties by the larger tie column. One aggregation, no sort."""
    rest = [c for c in rows.columns if c not in (key, value, tie)]
    best = F.max(F.struct(value, tie, *rest)).alias("b")
    return rows.groupBy(key).agg(best).select(key, "b.*")
