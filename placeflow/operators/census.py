"""Daily migrants from a census sheet whose rows form a hierarchy, and shares by where they go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import level_of
from ..functions.ratios import number, ratio
from .quantiles import exact_quantiles
from .zones import forward_fill

# fixed values: the sheet's rows for both sexes, and those for kinds of settlement
BOTH_SEXES, URBAN, OTHER = "с", "Градска", "Остала"
COUNTS = ("total", "same_municipality", "other_municipality_same_area", "other_area", "abroad")


def read_territories(sheet: DataFrame, level: str = "municipality") -> DataFrame:
    """sheet, row_idx, name, level, area, city, the five COUNTS and single_settlement of each territory of a sheet.

    sheet has sheet, row_idx and c0 (name), c1 (sex), c2 to c6 (counts) as text. A row of an area opens one, a row of a city opens
    one until the next area; both do so whatever their sex. Rows for both sexes are territories; an empty count is 0, and a row with
    a count that is no number is left out. Rows for kinds of settlement belong to the territory before them, unless that was left
    out. single_settlement: there are urban settlements and no others. level is 'municipality', or 'all' with a column level. Rows of a
    sheet are filled downwards in ranges, so a long sheet is many tasks.
    """
    name, sex = F.trim("c0"), F.trim("c1")
    rows = sheet.withColumns({"name": name, "sex": sex}).where("name <> ''")
    rows = rows.withColumn("settlement", F.col("name").isin(URBAN, OTHER)).withColumn("kind", F.when(~F.col("settlement"), level_of(F.col("name"))))
    opened = {"opens_area": F.when(F.col("kind") == "area", F.col("name")), "opens_city": F.when(F.col("kind") == "city_aggregate", F.col("name"))}
    rows = forward_fill(rows.withColumns(opened), "opens_area", "opens_city", "sheet").drop("opens_area", "opens_city", "section").withColumnsRenamed({"outer_filled": "area", "inner_filled": "city"})
    both = F.coalesce(F.col("sex") == BOTH_SEXES, F.lit(False))
    opens = ~F.col("settlement") & both
    rows = forward_fill(rows.where(both).withColumn("first", F.when(opens, 1)), "first", "first", "sheet").withColumnRenamed("section", "territory")
    values = {c: F.when(F.col(f"c{i + 2}").isNull(), 0.0).otherwise(number(F.col(f"c{i + 2}"))) for i, c in enumerate(COUNTS)}
    rows = rows.withColumns(values)
    head = lambda c: F.max(F.when(opens, F.col(c))).alias(c)  # noqa: E731  one row of a group opens it
    kinds = F.collect_set(F.when(F.col("settlement"), F.col("name")))
    found = rows.where("territory > 0").groupBy("sheet", "territory").agg(*(head(c) for c in ("row_idx", "name", "kind", "area", "city", *COUNTS)), kinds.alias("kinds"))
    sound = found.where(" AND ".join(f"{c} IS NOT NULL" for c in COUNTS))
    single = (F.size("kinds") == 1) & F.array_contains("kinds", URBAN)
    city = F.when(F.col("kind") == "municipality", F.col("city")).alias("city")
    out = sound.select("sheet", "row_idx", "name", F.col("kind").alias("level"), "area", city, *COUNTS, single.alias("single_settlement"))
    return out.where("level = 'municipality'").drop("level") if level == "municipality" else out


def add_self_containment(rows: DataFrame, single: tuple[str, ...] = ()) -> DataFrame:
    """rows and rbsc (share that stays), leakage, share_other_area, share_abroad; null without migrants. Also key (area / name) if
    there is an area, and single_settlement by name if it is not there."""
    total = F.col("total")
    rbsc = ratio(F.col("same_municipality"), total)
    out = rows.withColumns({"rbsc": rbsc, "leakage": 1.0 - rbsc, "share_other_area": ratio(F.col("other_area"), total), "share_abroad": ratio(F.col("abroad"), total)})
    if "single_settlement" not in out.columns:
        out = out.withColumn("single_settlement", F.col("name").isin(*single))
    return out.withColumn("key", composite_key(F.col("area"), F.col("name"))) if "area" in out.columns else out


def composite_key(area: Column, name: Column) -> Column:
    return F.concat(F.coalesce(area, F.lit("")), F.lit(" / "), name)


def reconcile(territories: DataFrame) -> DataFrame:
    """sheet, column, whole (the first row of country level), parts (sum of municipalities), difference; from read_territories(level='all')."""
    whole = territories.where("level = 'country_or_macroregion'").groupBy("sheet").agg(F.min(F.struct("row_idx", *COUNTS)).alias("w"))
    parts = territories.where("level = 'municipality'").groupBy("sheet").agg(*(F.sum(c).alias(c) for c in COUNTS))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"w.{c}").alias("whole"), F.col(c).alias("parts")) for c in COUNTS)))
    return whole.join(parts, "sheet").select("sheet", pairs.alias("p")).select("sheet", "p.*", (F.col("p.parts") - F.col("p.whole")).alias("difference"))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """All rows whose keys another row has too."""
    return rows.withColumn("__n", F.count("*").over(W.partitionBy(*keys))).where("__n > 1").drop("__n")


def gaps(work: DataFrame, study: DataFrame, key: str = "key") -> DataFrame:
    """key, rbsc_work, rbsc_study, gap for every key of work."""
    s = study.select(key, F.col("rbsc").alias("rbsc_study"))
    return work.select(key, F.col("rbsc").alias("rbsc_work")).join(s, key, "left").withColumn("gap", F.col("rbsc_study") - F.col("rbsc_work"))


def gap_summary(found: DataFrame, quantile: float = 0.97) -> DataFrame:
    """gap_mean, gap_median, scale (exact quantile of the gaps' size) and the correlation of both shares."""
    sums = found.agg(F.avg("gap").alias("gap_mean"), F.corr("rbsc_work", "rbsc_study").alias("r"))
    median = exact_quantiles(found, "gap", {"gap_median": 0.5})
    scale = exact_quantiles(found.select(F.abs("gap").alias("size")), "size", {"scale": quantile})
    one = lambda row: row.withColumn("one", F.lit(1))  # noqa: E731  each is one row
    return one(sums).join(one(median), "one").join(one(scale), "one").select("gap_mean", "gap_median", "scale", "r")
