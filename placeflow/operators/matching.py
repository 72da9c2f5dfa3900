"""Territories of a census and polygons of a map, matched one to one by names in which letters were lost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import ascii_name, base_name, qualifier, qualifier_fits, wildcard_fits
from .cut import rounds


def census_keys(census: DataFrame) -> DataFrame:
    """census (name, area) with base and area_ascii, twin (others have the base too) and key: the base, for twins base@area."""
    named = census.withColumns({"base": ascii_name(F.col("name")), "area_ascii": F.coalesce(ascii_name(F.col("area")), F.lit(""))})
    twin = F.count("*").over(W.partitionBy("base")) > 1
    return named.withColumn("twin", twin).withColumn("key", F.when(F.col("twin"), F.concat("base", F.lit("@"), "area_ascii")).otherwise(F.col("base")))


def polygon_names(polygons: DataFrame, name: str = "name") -> DataFrame:
    """polygons with base and qual: the name outside and inside brackets, ? for lost letters."""
    return polygons.withColumns({"base": base_name(F.col(name)), "qual": qualifier(F.col(name))})


def without_prefix(polygons: DataFrame, column: str, prefix: str = "9") -> DataFrame:
    """Polygons whose code does not begin so; those without a code stay."""
    return polygons.where(F.coalesce(~F.col(column).cast("string").startswith(prefix), F.lit(True)))


class MatchError(ValueError):
    """A match that is not one to one: what is ambiguous, or territories without a polygon."""


def match(polygons: DataFrame, census: DataFrame, strict: bool = False) -> DataFrame:
    """polygon_id, key, stage of the polygons that got a territory; polygons has polygon_id and name, census name and area.

    Stage 1: full names without twins; of several polygons that ask for a territory the smallest id gets it. Stage 2: twins by the
    qualifier, which begins the area's name, where one polygon fits one twin only. Stage 3: names with lost letters. A polygon that
    only one free territory fits claims it, unless another such polygon claims it too; what is settled is taken out, so that others
    may have one left, until nothing more is. The order of rows plays no part. strict raises MatchError where a qualifier or a name
    with lost letters fits several territories or rivals, or a territory is left without a polygon.
    """
    with rounds(polygons.sparkSession) as cut:
        p = cut(polygon_names(polygons).where("base <> ''").select("polygon_id", "base", "qual"))
        c = cut(census_keys(census).where("base <> ''").select("key", "base", "area_ascii", "twin"))
        plain = p.where(~F.col("base").contains("?")).join(c.where(~F.col("twin")), "base").groupBy("key").agg(F.min("polygon_id").alias("polygon_id"))
        done = cut(plain.select("polygon_id", "key", F.lit(1).alias("stage")))
        rest = p.join(done, "polygon_id", "left_anti")
        twins = cut(candidates(rest, c.where("twin")).where(qualifier_fits(F.col("qual"), F.col("area_ascii"))).select("polygon_id", "key"))
        alone = cut(_alone(twins).select("polygon_id", "key", F.lit(2).alias("stage")))
        if strict:
            _refuse(twins.join(alone, "polygon_id", "left_anti"), "qualifiers fit several twins")
        done = cut(done.union(alone))
        free = p.where(F.col("base").contains("?")).join(done, "polygon_id", "left_anti")
        pairs = cut(candidates(free, c.join(done, "key", "left_anti")).select("polygon_id", "key"))
        while True:
            single = pairs.groupBy("polygon_id").agg(F.count("*").alias("n"), F.min("key").alias("key")).where("n = 1")
            fresh = cut(single.groupBy("key").agg(F.count("*").alias("n"), F.min("polygon_id").alias("polygon_id")).where("n = 1").select("polygon_id", "key", F.lit(3).alias("stage")))
            if fresh.isEmpty():
                break
            done = done.union(fresh)
            pairs = cut(pairs.join(fresh, "polygon_id", "left_anti").join(fresh, "key", "left_anti").select("polygon_id", "key"))
        if strict:
            _refuse(pairs, "names fit several territories, or several names one")
            _refuse(c.join(done, "key", "left_anti").select(F.lit("").alias("polygon_id"), "key"), "territories are left without a polygon")
        return cut(done)


def _refuse(pairs: DataFrame, what: str) -> None:
    found = pairs.orderBy("polygon_id", "key").limit(10).collect()
    if found:
        raise MatchError(f"{what}: " + ", ".join(f"{r['polygon_id']} {r['key']}".strip() for r in found))


def candidates(polygons: DataFrame, census: DataFrame) -> DataFrame:
    """Columns of both (census' base is left out) where a polygon's base, with ? for any one letter, fits a territory's.

    A name is cut where letters are lost, and its longest piece must stand at its place in a territory's name of the same length: that
    is an equal-value join. Territories give a row for each length and place of a piece that occurs among the polygons, not for each
    way of losing letters. What the piece finds is verified.
    """
    part = F.aggregate(
        F.split("base", r"\?"),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("begin"), F.lit("").alias("piece")),
        lambda best, x: F.struct((best["at"] + F.length(x) + 1).alias("at"), F.when(F.length(x) > F.length(best["piece"]), best["at"]).otherwise(best["begin"]).alias("begin"), F.when(F.length(x) > F.length(best["piece"]), x).otherwise(best["piece"]).alias("piece")),
    )
    keyed = polygons.withColumn("__best", part).withColumns({"__size": F.length("base"), "__begin": F.col("__best.begin"), "__piece": F.col("__best.piece")}).drop("__best")
    shapes = keyed.select("__size", "__begin", F.length("__piece").alias("__length")).distinct()
    named = census.withColumn("__size", F.length("base")).join(shapes, "__size").withColumn("__piece", F.expr("substring(base, __begin + 1, __length)")).withColumnRenamed("base", "__name")
    met = keyed.join(named.drop("__length"), ["__size", "__begin", "__piece"])
    return met.where(wildcard_fits(F.col("base"), F.col("__name"))).drop("__size", "__begin", "__piece", "__name")


def _alone(pairs: DataFrame) -> DataFrame:
    """Pairs whose polygon and key are in no other pair."""
    n = {"p": F.count("*").over(W.partitionBy("polygon_id")), "k": F.count("*").over(W.partitionBy("key"))}
    return pairs.withColumns(n).where("p = 1 AND k = 1").select("polygon_id", "key")


def audit(matched: DataFrame, polygons: DataFrame, census: DataFrame) -> DataFrame:
    """problem, id: territories without a polygon and polygons without a territory."""
    keys = census_keys(census).select("key").join(matched, "key", "left_anti").select(F.lit("territory").alias("problem"), F.col("key").alias("id"))
    shapes = polygons.select("polygon_id").join(matched, "polygon_id", "left_anti").select(F.lit("polygon").alias("problem"), F.col("polygon_id").cast("string").alias("id"))
    return keys.union(shapes)
