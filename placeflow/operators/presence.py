"""Presence of people by where they come from, by hour and kind of day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ratios import ratio
from .zones import day_night

# fixed values: codes of the presence tables
FROM_AREA = {0: "same_city", 1: "same_pref", 2: "same_region", 3: "other_region"}
DAYFLAG = {0: "holiday", 1: "weekday", 2: "all_days"}
TIMEZONE = {0: "daytime", 1: "night", 2: "all_day"}


def label(code: Column, names: dict[int, str]) -> Column:
    """The name of a code, null for others."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), F.coalesce(code.cast("int"), F.lit(-1)))


def presence_self_containment(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, one column per origin (0 if absent), total, sc (share of locals) and far_share (from beyond the prefecture)."""
    wide = rows.groupBy(*keys).pivot("from_area", list(FROM_AREA)).agg(F.sum("population"))
    named = wide.select(*keys, *(F.coalesce(F.col(f"`{k}`"), F.lit(0.0)).alias(v) for k, v in FROM_AREA.items()))
    total = F.col("same_city") + F.col("same_pref") + F.col("same_region") + F.col("other_region")
    return named.withColumn("total", total).withColumns({"sc": ratio(F.col("same_city"), F.col("total")), "far_share": ratio(F.col("same_region") + F.col("other_region"), F.col("total"))})


def slice_of(rows: DataFrame, **values: int) -> DataFrame:
    """Rows of one year, month, dayflag or timezone."""
    for column, value in values.items():
        rows = rows.where(F.col(column) == value)
    return rows


def day_night_in_box(rows: DataFrame, centres: DataFrame, key: str, box: tuple[float, float, float, float], floor: float = 10.0) -> DataFrame:
    """key, day, night, day_night, lon_center, lat_center of cells whose centre lies in (lon_min, lon_max, lat_min, lat_max)."""
    west, east, south, north = box
    inside = centres.where(F.col("lon_center").between(west, east) & F.col("lat_center").between(south, north))
    return day_night(rows, [key], floor).join(inside.select(key, "lon_center", "lat_center"), key)


def largest(rows: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    """The k rows with the largest values; ties by the smaller tie column."""
    return rows.orderBy(F.desc(by), tie).limit(k)


def signatures(rows: DataFrame, key: str, cut: float = 0.585, floor: float = 100.0) -> DataFrame:
    """key, volume, work, leis, sig of cells with at least `floor` people.

    work is log2 of weekday day to weekday night, leis log2 of holiday day to weekday day; cells that lack one of the three, or have
    none there, are left out. sig: office where work is above the cut, else leisure where leis is, else residential where work is
    below its negative, else mixed. The order of these tests is this library's own.
    """
    pick = lambda flag, zone: F.sum(F.when((F.col("dayflag") == flag) & (F.col("timezone") == zone), F.col("population")))
    wide = rows.groupBy(key).agg(pick(1, 0).alias("day"), pick(1, 1).alias("night"), pick(0, 0).alias("free"), F.sum("population").alias("volume"))
    axes = wide.where((F.col("day") > 0) & (F.col("night") > 0) & (F.col("free") > 0) & (F.col("volume") >= floor)).withColumns({"work": F.log2(F.col("day") / F.col("night")), "leis": F.log2(F.col("free") / F.col("day"))})
    sig = F.when(F.col("work") > cut, "office").when(F.col("leis") > cut, "leisure").when(F.col("work") < -cut, "residential").otherwise("mixed")
    return axes.select(key, "volume", "work", "leis", sig.alias("sig"))
