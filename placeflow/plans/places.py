"""Queries on points, grids, presence and names, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grid, names, ratios
from ..operators import checks, diversity, presence
from ._tables import read, rounded

CITIES = 4
TYPES = ['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD']


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with a hierarchy of categories and a list of sources; size 1 has neither."""
    rows = read(spark, sf_dir, "part").where("p_size IS NOT NULL")
    none = F.col("p_size") == 1
    source = lambda c: F.struct(F.col(c).alias("dataset"))
    sources = F.when(none, F.array().cast("array<struct<dataset:string>>")).when(F.col("p_size") % 2 == 0, F.array(source("p_brand"))).otherwise(F.array(source("p_type"), source("p_brand")))
    return rows.select("p_partkey", "p_size", F.when(~none, F.array("p_type", "p_brand", "p_name")).alias("hierarchy"), sources.alias("sources"))


def taxonomy_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories at levels 1, 2 and 9, of which the last is deeper than any hierarchy."""
    rows = _tagged(spark, sf_dir)
    return rows.select("p_partkey", *(diversity.taxonomy_level(F.col("hierarchy"), n).alias(f"level{n}") for n in (1, 2, 9)))


def first_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tagged(spark, sf_dir).select(F.col("p_size").alias("city"), checks.first_source(F.col("sources")).alias("src"))
    return checks.source_mix(rows).select("city", "src", "n", "share")


def source_mix_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tagged(spark, sf_dir).select((F.col("p_size") % 3).cast("string").alias("city"), checks.first_source(F.col("sources")).alias("src"))
    return checks.source_mix_wide(checks.source_mix(rows), ["0", "1", "2"])


def provider_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.provider_counts(_tagged(spark, sf_dir))


def category_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.distinct_prefixes(read(spark, sf_dir, "part").where("p_name IS NOT NULL"), "p_name", " ")


def compute_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of a table of counts by size and type; sizes with fewer than 40 parts have none."""
    wide = read(spark, sf_dir, "part").groupBy("p_size").pivot("p_type", TYPES).count().na.fill(0)
    named = wide.toDF("p_size", *(f"cat_{c}" for c in wide.columns[1:]))
    return rounded(diversity.compute_all(named, "p_size", min_count=40).withColumn("cat_richness", F.col("cat_richness").cast("double")))


def _geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as points of four cities, which lie a degree apart."""
    city = F.col("user_id") % CITIES
    lat, lon = 34.3005 + city + F.col("event_id") % 180 * 0.001, 132.3505 + F.col("user_id") % 200 * 0.001
    return read(spark, sf_dir, "events").select(F.concat(F.lit("city"), city.cast("string")).alias("city"), lat.alias("lat"), lon.alias("lon"), F.col("event_type").alias("category"))


def _cell(size: float) -> Column:
    return grid.square_cell(F.col("lat"), F.col("lon"), size)


def _scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes around the middle of each city's points."""
    middle = lambda c: ((F.min(c) + F.max(c)) / 2).alias(c)
    return checks.shifted_boxes(_geo(spark, sf_dir).groupBy("city").agg(middle("lat"), middle("lon")), 2.0, 60.0, 0.08)


def shifted_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_scenarios(spark, sf_dir))


def shift_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians and ranks of the cities when their centres move two kilometres."""
    points = _geo(spark, sf_dir).withColumn("cell", _cell(0.02))
    return rounded(checks.shift_medians(checks.scenario_cells(points, _scenarios(spark, sf_dir), 3)))


def resolution_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(checks.resolution_sweep(_geo(spark, sf_dir), {"fine": _cell(0.01), "middle": _cell(0.02), "coarse": _cell(0.05)}, 5))


def density_bins_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins that hold their upper edge instead of the lower one."""
    cells = diversity.cell_diversity(_geo(spark, sf_dir).withColumn("cell", _cell(0.01)), "city", min_support=1)
    return rounded(checks.density_bins(cells, closed="right"))


def density_bins_by_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians and numbers of cells by bin, a pair of columns for each city."""
    cells = diversity.cell_diversity(_geo(spark, sf_dir).withColumn("cell", _cell(0.01)), "city", min_support=1)
    return rounded(checks.bins_by_city(checks.density_bins(cells), [f"city{i}" for i in range(CITIES)]))


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = 34.3005 + F.col("event_id") % 180 * 0.001, 132.3505 + F.col("user_id") % 200 * 0.001
    return read(spark, sf_dir, "events").select(lat.alias("lat"), lon.alias("lon"))


def mesh_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _codes(spark, sf_dir)
    code = F.explode(F.array(*(F.struct(F.lit(n).alias("level"), grid.mesh_code(F.col("lat"), F.col("lon"), n).alias("mesh")) for n in (1, 2))))
    return points.select(code.alias("c")).select("c.*").groupBy("level", "mesh").agg(F.count("*").alias("points"))


def mesh_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box, centre and size of every level-3 cell with events, and the cell that its centre lies in."""
    cells = _codes(spark, sf_dir).select(grid.mesh_code(F.col("lat"), F.col("lon")).alias("mesh")).distinct()
    box, centre = grid.mesh_box(F.col("mesh")), grid.mesh_centre(F.col("mesh"))
    size = grid.cell_size_km(centre["lat"])
    return rounded(cells.select("mesh", box["lat_min"].alias("lat_min"), box["lon_min"].alias("lon_min"), box["lat_max"].alias("lat_max"), box["lon_max"].alias("lon_max"), size["height_km"].alias("height_km"), size["width_km"].alias("width_km"), grid.mesh_code(centre["lat"], centre["lon"]).alias("again")))


def padded_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.col("o_orderkey").cast("string")
    return read(spark, sf_dir, "orders").groupBy(ratios.zero_fill(code, 4).alias("code")).agg(F.count("*").alias("n"))


def size_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    # not rounded: some prices lie on the edge between two roundings
    return read(spark, sf_dir, "orders").select("o_orderkey", ratios.size_threshold(F.col("o_totalprice") / 10).alias("threshold"))


def _presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by zone, kind of day, part of the day and origin; kinds of event beyond the third are origin 3."""
    weekend, hour = F.weekday("ts") >= 5, F.hour("ts")
    kind = F.least(F.length("event_type") % 5, F.lit(3))
    rows = read(spark, sf_dir, "events")
    return rows.select((F.col("user_id") % 25).alias("zone"), F.year("ts").alias("year"), F.month("ts").alias("month"), F.when(weekend, 0).otherwise(1).alias("dayflag"), F.when(hour.between(9, 17), 0).otherwise(1).alias("timezone"), kind.alias("from_area"), F.col("value").alias("population"))


def presence_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(presence.presence_self_containment(_presence(spark, sf_dir), ["year", "month", "dayflag", "timezone", "zone"]))


def presence_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _presence(spark, sf_dir).withColumns({"day": presence.label(F.col("dayflag"), presence.DAYFLAG), "part": presence.label(F.col("timezone"), presence.TIMEZONE), "origin": presence.label(F.col("from_area"), presence.FROM_AREA)})
    return rows.groupBy("day", "part", "origin").agg(F.count("*").alias("n"))


def _centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = read(spark, sf_dir, "events").select((F.col("user_id") % 25).alias("zone")).distinct()
    return zones.select("zone", (132.0 + F.col("zone") * 0.04).alias("lon_center"), (34.0 + F.col("zone") * 0.03).alias("lat_center"))


def _day_night(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = presence.slice_of(_presence(spark, sf_dir), year=2024, month=1, dayflag=1)
    return presence.day_night_in_box(rows, _centres(spark, sf_dir), "zone", (132.15, 132.85, 34.0, 34.62))


def day_night_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_day_night(spark, sf_dir))


def top_day_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(presence.largest(_day_night(spark, sf_dir), "day_night", 5, "zone"))


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of zones by when they are visited, with a place; a lower cut than usual, as events are spread evenly."""
    return rounded(presence.signatures(_presence(spark, sf_dir), "zone", 0.4, 100.0).join(_centres(spark, sf_dir), "zone"))


_NAMES = "Љиљана Њујорк|Џеп (Ниш)|Ариље|Pal?lula (Beogr?d)|Чачак, 2|ŠABAC"


def name_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authored names and those of suppliers: plain letters, the part outside brackets, and the part inside."""
    authored = F.array(*map(F.lit, _NAMES.split("|")))
    made = F.concat(F.lit("Град "), F.col("s_name"), F.lit(" (област)"))
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 7 == 6, made).otherwise(F.element_at(authored, (F.col("s_suppkey") % 7).cast("int") + 1)).alias("name"))
    return rows.select("s_suppkey", "name", names.ascii_name(F.col("name")).alias("plain"), names.base_name(F.col("name")).alias("base"), names.qualifier(F.col("name")).alias("qual"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in SQL}


_TAGGED = """tagged AS (
  SELECT p_partkey, p_size, CASE WHEN p_size <> 1 THEN [p_type, p_brand, p_name] END AS hierarchy,
    CASE WHEN p_size = 1 THEN []::VARCHAR[] WHEN p_size % 2 = 0 THEN [p_brand] ELSE [p_type, p_brand] END AS sources FROM part WHERE p_size IS NOT NULL)"""
_MIX = ", counts AS (SELECT {city} AS city, coalesce(sources[1], '(none)') AS src, count(*) AS n FROM tagged GROUP BY ALL), shares AS (SELECT city, src, n, round_even(100 * n / sum(n) OVER (PARTITION BY city), 1) AS share FROM counts)"
_WIDE = "counts AS (SELECT p_size, p_type AS category, count(*)::DOUBLE AS n FROM part GROUP BY ALL)"
_METRICS = """
shares AS (SELECT *, n / sum(n) OVER (PARTITION BY {keys}) AS p FROM counts),
cells AS (
  SELECT {keys}, sum(n) AS poi_count, count(*) AS cat_richness, -sum(p * ln(p)) AS h, 1 - sum(p * p) AS gs, sum(p * p) AS pp, max(p) AS top, (list('{prefix}' || category ORDER BY n DESC, category))[1] AS dominant_category,
    sum((n = 1)::INT)::DOUBLE AS f1, sum((n = 2)::INT)::DOUBLE AS f2 FROM shares GROUP BY ALL)"""
_GEO = f"""geo AS (
  SELECT 'city' || (user_id % {CITIES}) AS city, 34.3005::DOUBLE + (user_id % {CITIES}) + (event_id % 180) * 0.001::DOUBLE AS lat, 132.3505::DOUBLE + (user_id % 200) * 0.001::DOUBLE AS lon, event_type AS category FROM events)"""
_AT = "concat_ws('_', floor(lat / {size}::DOUBLE)::BIGINT, floor(lon / {size}::DOUBLE)::BIGINT)"
_BOXES = f"""boxes AS (
  SELECT city, scenario, lat + dlat - hlat AS lat_min, lat + dlat + hlat AS lat_max, lon + dlon - 0.04::DOUBLE AS lon_min, lon + dlon + 0.04::DOUBLE AS lon_max FROM (
    SELECT city, scenario, lat, lon, n * 2.0 / 110.574::DOUBLE AS dlat, e * 2.0 / (111.320::DOUBLE * cos(radians(lat))) AS dlon, 60.0::DOUBLE / (0.08::DOUBLE * 111.320::DOUBLE * cos(radians(lat))) / 110.574::DOUBLE / 2 AS hlat
    FROM (SELECT city, (min(lat) + max(lat)) / 2 AS lat, (min(lon) + max(lon)) / 2 AS lon FROM geo GROUP BY city), (VALUES ('centre', 0.0, 0.0), ('east', 0.0, 1.0), ('north', 1.0, 0.0), ('south', -1.0, 0.0), ('west', 0.0, -1.0)) m(scenario, n, e)))"""
_MESH = """e AS (SELECT 34.3005::DOUBLE + (event_id % 180) * 0.001::DOUBLE AS lat, 132.3505::DOUBLE + (user_id % 200) * 0.001::DOUBLE AS lon FROM events),
  a AS (SELECT *, floor(lat * 60 / 40) AS r1, floor(lon) AS c1 FROM e), b AS (SELECT *, lat * 60 - r1 * 40 AS m, (lon - c1) * 60 AS x FROM a),
  c AS (SELECT *, floor(m / 5) AS r2, floor(x / 7.5) AS c2 FROM b), d AS (SELECT *, floor((m - r2 * 5) * 2) AS r3, floor((x - c2 * 7.5) * 60 / 45) AS c3 FROM c)"""
_PRESENCE = """p AS (
  SELECT user_id % 25 AS zone, year(ts)::INT AS year, month(ts)::INT AS month, CASE WHEN isodow(ts) >= 6 THEN 0 ELSE 1 END AS dayflag, CASE WHEN hour(ts) BETWEEN 9 AND 17 THEN 0 ELSE 1 END AS timezone,
    least(length(event_type) % 5, 3) AS from_area, value AS population FROM events)"""
_DAY = """day AS (
  SELECT zone, round(day, 6) AS day, round(night, 6) AS night, round(day / night, 6) AS day_night, 132.0::DOUBLE + zone * 0.04::DOUBLE AS lon_center, 34.0::DOUBLE + zone * 0.03::DOUBLE AS lat_center FROM (
    SELECT zone, sum(CASE WHEN timezone = 0 THEN population END) AS day, sum(CASE WHEN timezone = 1 THEN population END) AS night FROM p WHERE year = 2024 AND month = 1 AND dayflag = 1 GROUP BY 1)
  WHERE day >= 10 AND night >= 10 AND 132.0::DOUBLE + zone * 0.04::DOUBLE BETWEEN 132.15 AND 132.85 AND 34.0::DOUBLE + zone * 0.03::DOUBLE BETWEEN 34.0 AND 34.62)"""

SQL = {
    "taxonomy_levels": f"WITH {_TAGGED} SELECT p_partkey, hierarchy[1] AS level1, hierarchy[2] AS level2, hierarchy[3] AS level9 FROM tagged",
    "first_sources": f"WITH {_TAGGED}{_MIX.format(city='p_size')} SELECT city, src, n, share FROM shares",
    "source_mix_wide": f"""WITH {_TAGGED}{_MIX.format(city='p_size % 3')} SELECT src, {", ".join(f'coalesce(max(share) FILTER (WHERE city = {i}), 0.0) AS "{i}"' for i in range(3))} FROM shares GROUP BY 1""",
    "provider_counts": f"WITH {_TAGGED} SELECT dataset, count(*) AS n FROM (SELECT unnest(sources) AS dataset FROM tagged) GROUP BY 1",
    "category_prefixes": "SELECT count(DISTINCT p_name) AS n_values, count(DISTINCT split_part(p_name, ' ', 1)) AS n_prefixes FROM part",
    "compute_all": f"WITH {_WIDE}, {_METRICS.format(keys='p_size', prefix='cat_')}" + """ SELECT cell, coalesce(poi_count, 0.0) AS poi_count,
      CASE WHEN ok THEN cat_richness::DOUBLE END AS cat_richness, CASE WHEN ok THEN round(h, 6) + 0.0 END AS cat_shannon, CASE WHEN ok THEN round(h / nullif(ln(cat_richness), 0), 6) END AS cat_evenness, CASE WHEN ok THEN round(gs, 6) END AS cat_gini_simpson,
      CASE WHEN ok THEN round(exp(h), 6) END AS cat_hill_q1, CASE WHEN ok THEN round(1 / pp, 6) END AS cat_hill_q2, CASE WHEN ok THEN round(top, 6) END AS top_cat_share, CASE WHEN ok THEN dominant_category END AS dominant_category,
      CASE WHEN NOT ok OR poi_count <= 1 THEN NULL WHEN f1 = 0 THEN 1.0 ELSE round(1 - f1 / poi_count * ((poi_count - 1) * f1 / nullif((poi_count - 1) * f1 + 2 * f2, 0)), 6) END AS sample_coverage, NOT ok AS below_threshold
      FROM (SELECT p.cell, c.*, coalesce(c.poi_count >= 40, false) AS ok FROM (SELECT DISTINCT p_size AS cell FROM part) p LEFT JOIN cells c ON p.cell = c.p_size)""",
    "shifted_boxes": f"WITH {_GEO}, {_BOXES} SELECT city, scenario, round(lat_min, 6) AS lat_min, round(lat_max, 6) AS lat_max, round(lon_min, 6) AS lon_min, round(lon_max, 6) AS lon_max FROM boxes",
    "shift_ranking": f"WITH {_GEO}, {_BOXES}, counts AS (SELECT g.city, scenario, {_AT.format(size=0.02)} AS cell, category, count(*)::DOUBLE AS n FROM geo g JOIN boxes b ON g.city = b.city AND lat BETWEEN lat_min AND lat_max AND lon BETWEEN lon_min AND lon_max GROUP BY ALL), "
    + _METRICS.format(keys="city, scenario, cell", prefix="") + """, m AS (SELECT city, scenario, count(*) AS cells, round(median(1 / pp), 6) AS median FROM cells WHERE poi_count >= 3 GROUP BY ALL)
      SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY median DESC, city)::INT AS rank FROM m""",
    "resolution_sweep": f"WITH {_GEO}, counts AS (" + " UNION ALL ".join(f"SELECT city, '{name}' AS resolution, {_AT.format(size=size)} AS cell, category, count(*)::DOUBLE AS n FROM geo GROUP BY ALL" for name, size in (("fine", 0.01), ("middle", 0.02), ("coarse", 0.05))) + "), "
    + _METRICS.format(keys="city, resolution, cell", prefix="") + " SELECT city, resolution, count(*) AS cells, median(poi_count) AS median_poi, round(median(1 / pp), 6) AS median_hill_q2 FROM cells WHERE poi_count >= 5 GROUP BY ALL",
    "density_bins_right": f"WITH {_GEO}, counts AS (SELECT city, {_AT.format(size=0.01)} AS cell, category, count(*)::DOUBLE AS n FROM geo GROUP BY ALL), " + _METRICS.format(keys="city, cell", prefix="") + """
      SELECT city, CASE WHEN poi_count <= 20 THEN '10-19' WHEN poi_count <= 40 THEN '20-39' WHEN poi_count <= 80 THEN '40-79' WHEN poi_count <= 160 THEN '80-159' WHEN poi_count <= 320 THEN '160-319' ELSE '320+' END AS bin,
      count(*) AS cells, round(median(1 / pp), 6) AS median FROM cells WHERE poi_count > 10 GROUP BY ALL""",
    "density_bins_by_city": f"WITH {_GEO}, counts AS (SELECT city, {_AT.format(size=0.01)} AS cell, category, count(*)::DOUBLE AS n FROM geo GROUP BY ALL), " + _METRICS.format(keys="city, cell", prefix="") + """,
      l AS (SELECT city, CASE WHEN poi_count < 20 THEN '10-19' WHEN poi_count < 40 THEN '20-39' WHEN poi_count < 80 THEN '40-79' WHEN poi_count < 160 THEN '80-159' WHEN poi_count < 320 THEN '160-319' ELSE '320+' END AS bin, 1 / pp AS hill FROM cells WHERE poi_count >= 10)
      SELECT bin, """ + ", ".join(f"round(median(hill) FILTER (WHERE city = 'city{i}'), 6) AS city{i}_median, nullif(count(*) FILTER (WHERE city = 'city{i}'), 0) AS city{i}_cells" for i in range(CITIES)) + " FROM l GROUP BY bin",
    "mesh_levels": f"WITH {_MESH}, l AS (SELECT 1 AS level, concat(r1::BIGINT, (c1 - 100)::BIGINT) AS mesh FROM d UNION ALL SELECT 2, concat(r1::BIGINT, (c1 - 100)::BIGINT, r2::BIGINT, c2::BIGINT) FROM d) SELECT level, mesh, count(*) AS points FROM l GROUP BY ALL",
    "mesh_boxes": f"WITH {_MESH}" + """, k AS (SELECT DISTINCT concat(r1::BIGINT, (c1 - 100)::BIGINT, r2::BIGINT, c2::BIGINT, r3::BIGINT, c3::BIGINT) AS mesh, r1 * 40 / 60.0::DOUBLE + r2 * 5 / 60.0::DOUBLE + r3 / 120.0::DOUBLE AS lat, c1 + c2 * 7.5::DOUBLE / 60 + c3 / 80.0::DOUBLE AS lon FROM d)
      SELECT mesh, round(lat, 6) AS lat_min, round(lon, 6) AS lon_min, round(lat + 1 / 120.0::DOUBLE, 6) AS lat_max, round(lon + 1 / 80.0::DOUBLE, 6) AS lon_max, round(110.574::DOUBLE / 120, 6) AS height_km,
      round(111.320::DOUBLE / 80 * cos(radians(lat + 1 / 240.0::DOUBLE)), 6) AS width_km, mesh AS again FROM k""",
    "padded_codes": "SELECT CASE WHEN length(o_orderkey::VARCHAR) < 4 THEN lpad(o_orderkey::VARCHAR, 4, '0') ELSE o_orderkey::VARCHAR END AS code, count(*) AS n FROM orders GROUP BY 1",
    "size_thresholds": "SELECT o_orderkey, 0.75::DOUBLE + least(1.0::DOUBLE, greatest(0.0::DOUBLE, (o_totalprice / 10 - 3500) / 21500.0::DOUBLE)) * (2.0::DOUBLE / 3 - 0.75::DOUBLE) AS threshold FROM orders",
    "presence_shares": f"WITH {_PRESENCE}, w AS (SELECT year, month, dayflag, timezone, zone, " + ", ".join(f"coalesce(sum(population) FILTER (WHERE from_area = {i}), 0.0) AS {c}" for i, c in presence.FROM_AREA.items()) + """ FROM p GROUP BY ALL), t AS (SELECT *, same_city + same_pref + same_region + other_region AS total FROM w)
      SELECT year, month, dayflag, timezone, zone, round(same_city, 6) AS same_city, round(same_pref, 6) AS same_pref, round(same_region, 6) AS same_region, round(other_region, 6) AS other_region, round(total, 6) AS total,
      round(CASE WHEN total > 0 THEN same_city / total END, 6) AS sc, round(CASE WHEN total > 0 THEN (same_region + other_region) / total END, 6) AS far_share FROM t""",
    "presence_labels": f"WITH {_PRESENCE} SELECT ['holiday', 'weekday'][dayflag + 1] AS day, ['daytime', 'night'][timezone + 1] AS part, ['same_city', 'same_pref', 'same_region', 'other_region'][from_area + 1] AS origin, count(*) AS n FROM p GROUP BY ALL",
    "day_night_box": f"WITH {_PRESENCE}, {_DAY} SELECT zone, day, night, day_night, round(lon_center, 6) AS lon_center, round(lat_center, 6) AS lat_center FROM day",
    "top_day_gain": f"WITH {_PRESENCE}, {_DAY} SELECT zone, day, night, day_night, round(lon_center, 6) AS lon_center, round(lat_center, 6) AS lat_center FROM day ORDER BY day_night DESC, zone LIMIT 5",
    "signatures": f"WITH {_PRESENCE}" + """, w AS (SELECT zone, sum(population) FILTER (WHERE dayflag = 1 AND timezone = 0) AS day, sum(population) FILTER (WHERE dayflag = 1 AND timezone = 1) AS night, sum(population) FILTER (WHERE dayflag = 0 AND timezone = 0) AS free, sum(population) AS volume FROM p GROUP BY 1),
      x AS (SELECT *, log2(day / night) AS work, log2(free / day) AS leis FROM w WHERE day > 0 AND night > 0 AND free > 0 AND volume >= 100)
      SELECT zone, round(volume, 6) AS volume, round(work, 6) AS work, round(leis, 6) AS leis, CASE WHEN work > 0.4 THEN 'office' WHEN leis > 0.4 THEN 'leisure' WHEN work < -0.4 THEN 'residential' ELSE 'mixed' END AS sig,
      round(132.0::DOUBLE + zone * 0.04::DOUBLE, 6) AS lon_center, round(34.0::DOUBLE + zone * 0.03::DOUBLE, 6) AS lat_center FROM x""",
    "name_forms": r"""WITH n AS (SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 6 THEN 'Град ' || s_name || ' (област)' ELSE string_split('""" + _NAMES + """', '|')[s_suppkey % 7 + 1] END AS name FROM supplier)
      SELECT s_suppkey, name, regexp_replace(translate(replace(replace(replace(upper(name), 'Љ', 'LJ'), 'Њ', 'NJ'), 'Џ', 'DZ'), '""" + names.SINGLE_FROM + "', '" + names.SINGLE_TO + r"""'), '[^A-Z]', '', 'g') AS plain,
      regexp_replace(regexp_replace(upper(name), '\([^)]*\)', '', 'g'), '[^A-Z?]', '', 'g') AS base, regexp_replace(regexp_extract(upper(name), '\(([^)]*)\)', 1), '[^A-Z?]', '', 'g') AS qual FROM n""",
}
