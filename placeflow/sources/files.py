"""Readers and writers for the shapes of files that the analyses take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def points_in_box(spark: SparkSession, path: str, box: tuple[float, float, float, float], **options: str) -> DataFrame:
    """Points of a partitioned Parquet set whose bbox corner lies in (ymin, xmin, ymax, xmax) and that have a category; the box reaches the scan."""
    ymin, xmin, ymax, xmax = box
    rows = spark.read.options(**options).parquet(path)
    inside = F.col("bbox.xmin").between(xmin, xmax) & F.col("bbox.ymin").between(ymin, ymax)
    return rows.where(inside & F.col("taxonomy").isNotNull() & (F.size("taxonomy.hierarchy") > 0))


def named_csv(spark: SparkSession, path: str, schema: str, names: list[str]) -> DataFrame:
    """A CSV with header whose columns are renamed by position."""
    return spark.read.csv(path, header=True, schema=schema).toDF(*names)


def od_csv(spark: SparkSession, path: str, schema: str, names: list[str], where: str, columns: list[str]) -> DataFrame:
    """The columns of rows that fit a condition, as in a flow table of which one category of workplace counts; splits are filtered as they are read."""
    return named_csv(spark, path, schema, names).where(where).select(*columns)


def tracks(spark: SparkSession, path: str) -> DataFrame:
    """lat, lon, time of the track points of GPX files."""
    rows = spark.read.format("xml").option("rowTag", "trkpt").schema("_lat double, _lon double, time string").load(path)
    return rows.select(F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), "time")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def timed_share(points: DataFrame) -> DataFrame:
    """points, and the share of them that have a time; 0 of none."""
    timed = F.when(F.coalesce(F.col("time"), F.lit("")) != "", 1.0).otherwise(0.0)
    return points.agg(F.count("*").alias("points"), F.coalesce(F.avg(timed), F.lit(0.0)).alias("timed"))
