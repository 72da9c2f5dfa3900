"""Robustness checks of cell diversity: all scenarios of a check run as one grouped job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.grid import half_extents, shift_degrees
from ..functions.ratios import bin_label
from .diversity import category_counts, cell_metrics

BINS = ([10.0, 20.0, 40.0, 80.0, 160.0, 320.0, 1e9], ["10-19", "20-39", "40-79", "80-159", "160-319", "320+"])


def source_mix(points: DataFrame, missing: str = "(none)") -> DataFrame:
    """city, src, n, share: per cent of a city's points by the data set of their first source."""
    counts = points.groupBy("city", F.coalesce("src", F.lit(missing)).alias("src")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.bround(100 * F.col("n") / F.sum("n").over(W.partitionBy("city")), 1))


def source_mix_wide(mix: DataFrame, cities: list[str]) -> DataFrame:
    return mix.groupBy("src").pivot("city", cities).agg(F.first("share")).na.fill(0.0)


def first_source(sources: Column) -> Column:
    return F.try_element_at(sources, F.lit(1))["dataset"]


def provider_counts(points: DataFrame) -> DataFrame:
    """dataset, n over all sources of all points; points without sources don't count."""
    return points.select(F.explode("sources").alias("s")).groupBy(F.col("s.dataset").alias("dataset")).agg(F.count("*").alias("n"))


def taxonomy_coverage(points: DataFrame, columns: list[str]) -> DataFrame:
    """column, present, pct: how many rows have a value."""
    n = F.count("*")
    wide = points.agg(*(F.count(c).alias(c) for c in columns), n.alias("__n"))
    return wide.unpivot("__n", columns, "column", "present").select("column", "present", F.round(100.0 * F.col("present") / F.col("__n"), 1).alias("pct"))


def top_categories(points: DataFrame, k: int = 20) -> DataFrame:
    """The k most frequent categories; ties by name."""
    return points.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(k)


def distinct_prefixes(points: DataFrame, column: str, separator: str = ".") -> DataFrame:
    part = F.split_part(F.col(column), F.lit(separator), F.lit(1))
    return points.agg(F.count_distinct(column).alias("n_values"), F.count_distinct(part).alias("n_prefixes"))


def within_boxes(points: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Points of each scenario (city, scenario, lat_min, lat_max, lon_min, lon_max); a point may lie in several.

    Scenarios are a handful per city, so they are broadcast; the box is part of the join's condition.
    """
    p, s = points.alias("p"), F.broadcast(scenarios).alias("s")
    inside = F.expr("p.city = s.city AND p.lat BETWEEN s.lat_min AND s.lat_max AND p.lon BETWEEN s.lon_min AND s.lon_max")
    return p.join(s, inside).select("s.scenario", "p.*")


def shifted_boxes(centres: DataFrame, shift_km: float, area_km2: float, width_deg: float) -> DataFrame:
    """scenario and box of each city's centre, and of the same moved to the four sides."""
    moves = F.explode(F.array(*(F.struct(F.lit(name).alias("scenario"), F.lit(n * shift_km).alias("north"), F.lit(e * shift_km).alias("east")) for name, n, e in (("centre", 0.0, 0.0), ("east", 0.0, 1.0), ("north", 1.0, 0.0), ("south", -1.0, 0.0), ("west", 0.0, -1.0)))))
    rows = centres.select("city", "lat", "lon", moves.alias("m")).withColumn("half", half_extents(F.col("lat"), area_km2, width_deg)).withColumn("by", shift_degrees(F.col("lat"), F.col("m.north"), F.col("m.east")))
    lat, lon = F.col("lat") + F.col("by.d_lat"), F.col("lon") + F.col("by.d_lon")
    return rows.select("city", F.col("m.scenario").alias("scenario"), (lat - F.col("half.half_lat")).alias("lat_min"), (lat + F.col("half.half_lat")).alias("lat_max"), (lon - F.col("half.half_lon")).alias("lon_min"), (lon + F.col("half.half_lon")).alias("lon_max"))


def scenario_cells(points: DataFrame, scenarios: DataFrame, min_support: float = 10) -> DataFrame:
    """Cell metrics of every city and scenario in one job."""
    inside = within_boxes(points, scenarios)
    return cell_metrics(category_counts(inside, "city", "scenario"), "city", "scenario", min_support=min_support)


def shift_medians(cells: DataFrame, metric: str = "cat_hill_q2") -> DataFrame:
    """city, scenario, cells, median and the city's rank in the scenario (1: most diverse; ties by name)."""
    m = cells.groupBy("city", "scenario").agg(F.count("*").alias("cells"), F.round(F.median(metric), 6).alias("median"))
    return m.withColumn("rank", F.row_number().over(W.partitionBy("scenario").orderBy(F.desc("median"), "city")))


def bins_by_city(bins: DataFrame, cities: list[str]) -> DataFrame:
    """bin, and for each city its median and number of cells: the result of density_bins laid out by city; null where a city has no cells."""
    wide = bins.groupBy("bin").pivot("city", cities).agg(F.max("median").alias("median"), F.max("cells").alias("cells"))
    return wide.select("bin", *(F.col(f"`{c}_{v}`") for c in cities for v in ("median", "cells")))


def density_bins(cells: DataFrame, metric: str = "cat_hill_q2", closed: str = "left") -> DataFrame:
    """city, bin, cells, median of a metric among cells with similar numbers of points."""
    binned = cells.withColumn("bin", bin_label(F.col("poi_count"), *BINS, closed=closed)).where("bin IS NOT NULL")
    return binned.groupBy("city", "bin").agg(F.count("*").alias("cells"), F.median(metric).alias("median"))


def threshold_sensitivity(counts: DataFrame, thresholds: list[float], metric: str = "cat_hill_q2") -> DataFrame:
    """city, threshold, cells, median: cell metrics are made once, thresholds only filter them."""
    cells = cell_metrics(counts, "city", min_support=min(thresholds))
    rows = cells.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).where(F.col("poi_count") >= F.col("threshold"))
    return rows.groupBy("city", "threshold").agg(F.count("*").alias("cells"), F.median(metric).alias("median"))


def resolution_sweep(points: DataFrame, cell_of: dict[str, Column], min_support: float = 10) -> DataFrame:
    """city, resolution and a summary of cells, for several ways to make cells of one set of points, in one job."""
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("resolution"), cell.alias("cell")) for name, cell in cell_of.items())))
    rows = points.select("city", "category", each.alias("e")).select("city", "category", "e.resolution", "e.cell")
    cells = cell_metrics(category_counts(rows, "city", "resolution"), "city", "resolution", min_support=min_support)
    return cells.groupBy("city", "resolution").agg(F.count("*").alias("cells"), F.median("poi_count").alias("median_poi"), F.median("cat_hill_q2").alias("median_hill_q2"))
