"""Queries over the test tables and, for each, the SQL it must agree with. Results are rounded to 6 places on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import mesh_code
from ..operators import checks, diversity, flows, fragments, zones
from ..streaming.presence import presence_by_window
from ._tables import read as _read
from ._tables import rounded as _rounded


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select(F.col("p_size").alias("cell"), F.col("p_type").alias("category"), F.col("p_brand").alias("city"), F.col("p_name").alias("src"))


def cell_dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diversity profile of cells with enough points."""
    return _rounded(diversity.cell_diversity(_points(spark, sf_dir), min_support=10))


def brand_dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with brands as cells, for small tables."""
    return _rounded(diversity.cell_diversity(_points(spark, sf_dir).withColumn("cell", F.col("city")), min_support=5))


def cell_dna_by_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(diversity.cell_diversity(_points(spark, sf_dir), "city", min_support=2))


def dna_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(diversity.summary(diversity.cell_diversity(_points(spark, sf_dir), min_support=1)))


def mono_functional(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = diversity.cell_diversity(_points(spark, sf_dir), min_support=1)
    return _rounded(diversity.mono_functional(cells, 0.25))


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.source_mix(_points(spark, sf_dir))


def density_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = diversity.cell_diversity(_points(spark, sf_dir).withColumn("city", F.lit("all")), "city", min_support=1)
    return _rounded(checks.density_bins(cells))


def threshold_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = diversity.category_counts(_points(spark, sf_dir).withColumn("city", F.lit("all")), "city")
    return _rounded(checks.threshold_sensitivity(counts, [5.0, 20.0, 40.0]))


def taxonomy_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _read(spark, sf_dir, "part").select(F.when(F.col("p_size") > 1, F.col("p_type")).alias("category"), "p_brand")
    return checks.taxonomy_coverage(parts, ["category", "p_brand"])


def top_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.top_categories(_points(spark, sf_dir).withColumn("category", F.col("src")), 20)


def mesh_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points by level-3 mesh code."""
    lat, lon = 34.3005 + F.col("event_id") % 180 * 0.001, 132.3505 + F.col("user_id") % 200 * 0.001
    return _read(spark, sf_dir, "events").select(mesh_code(lat, lon).alias("mesh")).groupBy("mesh").agg(F.count("*").alias("points"))


def _od(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    trips = items.join(_read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.expr("l_orderkey = o_orderkey"))
    return flows.prepare_od(trips, "o_custkey", "l_suppkey", "l_quantity")


def od_unit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(flows.unit_stats(_od(spark, sf_dir)))


def od_cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(flows.find_cores(flows.unit_stats(_od(spark, sf_dir)), 0.98))


def od_best_destination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.best_per_key(_od(spark, sf_dir), "origin", "flow", "dest").select("origin", "dest", "flow")


def od_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(flows.overall_self_containment(flows.unit_stats(_od(spark, sf_dir))))


def _trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' nations to suppliers' nations; nation 3 has no code as origin, nation 7 is a special destination."""
    items = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    home = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    work = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    rows = items.join(orders, F.expr("l_orderkey = o_orderkey")).join(home, F.expr("o_custkey = c_custkey")).join(work, F.expr("l_suppkey = s_suppkey"))
    return rows.select(F.col("o_orderpriority").alias("motive"), F.col("l_quantity").alias("trip_count"), F.expr("nullif(c_nationkey, 3)").alias("o_fa_code"), F.col("s_nationkey").alias("d_fa_code"))


def self_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(flows.self_containment(_trips(spark, sf_dir), [7]))


def self_containment_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the names and regions of areas, of which one is not known."""
    meta = _read(spark, sf_dir, "nation").where("n_nationkey <> 5").select(F.col("n_nationkey").alias("fa_code"), F.col("n_name").alias("fa_name"), F.col("n_regionkey").cast("string").alias("cntr"))
    return _rounded(flows.with_metadata(flows.self_containment(_trips(spark, sf_dir), [7]), meta))


def benchmark_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = flows.self_containment(_trips(spark, sf_dir), [7])
    return _rounded(flows.benchmark_shares(areas, (0.04, 0.05)).toDF("motive", "n_areas", "share_low", "share_high"))


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("zone"), F.col("l_quantity").alias("pop"), F.col("l_linenumber").alias("class"))


def zonal_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(zones.zonal_sums(_pixels(spark, sf_dir), [1, 2], [1]))


def zonal_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(zones.correlations(zones.zonal_sums(_pixels(spark, sf_dir), [1, 2], [1]), "pop", "urban_share", "city_share"))


def quartile_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(zones.quartile_means(zones.zonal_sums(_pixels(spark, sf_dir), [1, 2], [1]), "zone", "urban_share", "pop", "city_share"))


def _presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.hour("ts")
    return _read(spark, sf_dir, "events").select((F.col("user_id") % 25).alias("zone"), F.when(hour.between(9, 17), 0).otherwise(1).alias("timezone"), (F.col("event_id") % 4).cast("int").alias("ring"), F.col("value").alias("population"), "ts")


def presence_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(zones.ring_table(_presence(spark, sf_dir), ["zone", "timezone"], "ring", [0, 1, 2, 3]))


def day_night(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(zones.day_night(_presence(spark, sf_dir), ["zone"]))


def presence_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presence_by_window(_presence(spark, sf_dir), "zone")


def hierarchy_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as rows of a sheet per nation: every seventh opens an outer section, every third an inner one."""
    sheet = _read(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("sheet"), F.col("c_custkey").alias("row_idx"), F.when(F.col("c_custkey") % 7 == 0, F.col("c_name")).alias("area"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("city")
    )
    return zones.forward_fill(sheet, "area", "city", "sheet").select("sheet", "row_idx", "section", "outer_filled", "inner_filled")


def area_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' suppliers on a ring of supplier keys, cut between multiples of five."""
    units = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("unit"), (F.col("s_suppkey") % 40 >= 20).cast("int").alias("fua"))
    edges = units.select(F.col("unit").alias("u"), (F.col("unit") + 1).alias("v")).where("v % 5 <> 0")
    return fragments.fragmentation(fragments.area_components(units, fragments.symmetric(edges, "u", "v")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in SQL}


_CELLS = """
counts AS (SELECT {keys} p_size AS cell, p_type AS category, count(*)::DOUBLE AS n FROM part WHERE p_size IS NOT NULL AND p_type IS NOT NULL GROUP BY ALL),
shares AS (SELECT *, n / sum(n) OVER (PARTITION BY {keys} cell) AS p FROM counts),
cells AS (
  SELECT {keys} cell, sum(n) AS poi_count, count(*) AS cat_richness, -sum(p * ln(p)) AS h, 1 - sum(p * p) AS gs, sum(p * p) AS pp, max(p) AS top,
    (list(category ORDER BY n DESC, category))[1] AS dominant_category,
    sum((n = 1)::INT)::DOUBLE AS f1, sum((n = 2)::INT)::DOUBLE AS f2
  FROM shares GROUP BY ALL)
"""
_COVERAGE = "CASE WHEN poi_count <= 1 THEN NULL WHEN f1 = 0 THEN 1.0 ELSE round(1 - f1 / poi_count * ((poi_count - 1) * f1 / nullif((poi_count - 1) * f1 + 2 * f2, 0)), 6) END"
_ALL = "WITH " + _CELLS.format(keys="")
_OD = """
WITH od AS (
  SELECT o_custkey::VARCHAR AS origin, l_suppkey::VARCHAR AS dest, sum(l_quantity) AS flow FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  GROUP BY ALL HAVING sum(l_quantity) > 0),
o AS (SELECT origin AS unit, sum(flow) AS f, sum(CASE WHEN origin = dest THEN flow ELSE 0 END) AS i FROM od GROUP BY 1),
d AS (SELECT dest AS unit, sum(flow) AS f FROM od GROUP BY 1),
stats AS (
  SELECT unit, coalesce(o.i, 0.0) AS internal, coalesce(o.f, 0.0) AS out_total, coalesce(d.f, 0.0) AS in_total,
    coalesce(o.f, 0.0) - coalesce(o.i, 0.0) AS out_external, coalesce(d.f, 0.0) - coalesce(o.i, 0.0) AS in_external
  FROM o FULL JOIN d USING (unit))
"""
_SC = """
WITH t AS (
  SELECT o_orderpriority AS motive, l_quantity AS n, nullif(c_nationkey, 3) AS o, s_nationkey AS d
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> 7),
dep AS (SELECT o AS fa_code, motive, sum(n) AS departures_res, sum(CASE WHEN o = d THEN n ELSE 0 END) AS internal_trips FROM t WHERE o IS NOT NULL GROUP BY ALL),
arr AS (SELECT d AS fa_code, motive, sum(n) AS arrivals_total, sum(CASE WHEN o = d THEN n ELSE 0 END) AS arrivals_internal FROM t WHERE d IS NOT NULL GROUP BY ALL),
m AS (
  SELECT fa_code, motive, coalesce(departures_res, 0.0) AS departures_res, coalesce(internal_trips, 0.0) AS internal_trips, coalesce(arrivals_total, 0.0) AS arrivals_total,
    coalesce(arrivals_internal, 0.0) AS arrivals_internal FROM dep FULL JOIN arr USING (fa_code, motive)),
sc AS (
  SELECT *, CASE WHEN departures_res > 0 THEN internal_trips / departures_res END AS rbsc, CASE WHEN arrivals_total > 0 THEN arrivals_internal / arrivals_total END AS dbsc FROM m)
"""
_ZONES = """
WITH z AS (
  SELECT l_suppkey AS zone, sum(greatest(l_quantity, 0.0)) AS pop, sum(CASE WHEN l_linenumber IN (1, 2) THEN l_quantity ELSE 0.0 END) AS urban_pop,
    sum(CASE WHEN l_linenumber = 1 THEN l_quantity ELSE 0.0 END) AS city_pop, count(*) AS pixels FROM lineitem WHERE l_suppkey <> 0 GROUP BY 1),
zs AS (SELECT *, urban_pop / pop AS urban_share, city_pop / pop AS city_share FROM z)
"""
_PRESENCE = """
WITH p AS (
  SELECT user_id % 25 AS zone, CASE WHEN hour(ts) BETWEEN 9 AND 17 THEN 0 ELSE 1 END AS timezone, (event_id % 4)::INT AS ring, value AS population, ts FROM events)
"""

_PROFILE = f"""poi_count, cat_richness, round(h, 6) + 0.0 AS cat_shannon, round(h / nullif(ln(cat_richness), 0), 6) AS cat_evenness, round(gs, 6) AS cat_gini_simpson, round(exp(h), 6) AS cat_hill_q1,
  round(1 / pp, 6) AS cat_hill_q2, round(top, 6) AS top_cat_share, dominant_category, {_COVERAGE} AS sample_coverage"""

SQL = {
    "cell_dna": _ALL + f"SELECT cell, {_PROFILE} FROM cells WHERE poi_count >= 10",
    "brand_dna": _ALL.replace("p_size AS cell", "p_brand AS cell").replace("p_size IS NOT NULL", "p_brand IS NOT NULL") + f"SELECT cell, {_PROFILE} FROM cells WHERE poi_count >= 5",
    "cell_dna_by_city": "WITH " + _CELLS.format(keys="city,").replace("SELECT city, p_size", "SELECT p_brand AS city, p_size") + f"SELECT city, cell, {_PROFILE} FROM cells WHERE poi_count >= 2",
    "dna_summary": _ALL + """SELECT count(*) AS cells, median(poi_count) AS median_poi, round(median(exp(h)), 6) AS median_hill_q1, round(median(1 / pp), 6) AS median_hill_q2,
      (SELECT dominant_category FROM cells GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode_dominant FROM cells""",
    "mono_functional": _ALL + f"SELECT cell, {_PROFILE} FROM cells WHERE top >= 0.25",
    "source_mix": """SELECT city, src, n, round_even(100 * n / sum(n) OVER (PARTITION BY city), 1) AS share FROM (
      SELECT p_brand AS city, coalesce(p_name, '(none)') AS src, count(*) AS n FROM part GROUP BY ALL)""",
    "density_bins": _ALL + """SELECT 'all' AS city, CASE WHEN poi_count < 20 THEN '10-19' WHEN poi_count < 40 THEN '20-39' WHEN poi_count < 80 THEN '40-79' WHEN poi_count < 160 THEN '80-159'
      WHEN poi_count < 320 THEN '160-319' ELSE '320+' END AS bin, count(*) AS cells, round(median(1 / pp), 6) AS median FROM cells WHERE poi_count >= 10 GROUP BY ALL""",
    "threshold_sensitivity": _ALL + """SELECT 'all' AS city, t.threshold, count(*) AS cells, round(median(1 / pp), 6) AS median FROM cells
      JOIN (SELECT unnest([5.0, 20.0, 40.0])::DOUBLE AS threshold) t ON poi_count >= t.threshold GROUP BY ALL""",
    "taxonomy_coverage": """SELECT 'category' AS "column", count(CASE WHEN p_size > 1 THEN p_type END) AS present, round(100.0 * count(CASE WHEN p_size > 1 THEN p_type END) / count(*)::DOUBLE, 1) AS pct FROM part
      UNION ALL SELECT 'p_brand', count(p_brand), round(100.0 * count(p_brand) / count(*)::DOUBLE, 1) FROM part""",
    "top_categories": "SELECT p_name AS category, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, category LIMIT 20",
    "mesh_counts": """WITH e AS (SELECT 34.3005::DOUBLE + (event_id % 180) * 0.001::DOUBLE AS lat, 132.3505::DOUBLE + (user_id % 200) * 0.001::DOUBLE AS lon FROM events),
      a AS (SELECT *, floor(lat * 60 / 40) AS r1, floor(lon) AS c1 FROM e), b AS (SELECT *, lat * 60 - r1 * 40 AS m, (lon - c1) * 60 AS x FROM a),
      c AS (SELECT *, floor(m / 5) AS r2, floor(x / 7.5) AS c2 FROM b)
      SELECT concat(r1::BIGINT, (c1 - 100)::BIGINT, r2::BIGINT, c2::BIGINT, floor((m - r2 * 5) * 60 / 30)::BIGINT, floor((x - c2 * 7.5) * 60 / 45)::BIGINT) AS mesh, count(*) AS points FROM c GROUP BY 1""",
    "od_unit_stats": _OD + """SELECT unit, internal, out_total, in_total, out_external, in_external, round(CASE WHEN out_total > 0 THEN internal / out_total END, 6) AS self_containment,
      in_external - out_external AS net_attraction, round(CASE WHEN out_total > 0 THEN in_total / out_total END, 6) AS job_ratio FROM stats""",
    "od_cores": _OD + """SELECT unit, internal, out_total, in_total, out_external, in_external, round(internal / out_total, 6) AS self_containment, in_external - out_external AS net_attraction,
      round(in_total / out_total, 6) AS job_ratio FROM stats WHERE in_external >= (SELECT quantile_cont(in_external, 0.98) FROM stats) AND out_total > 0 AND in_total / out_total >= 1""",
    "area_fragments": """WITH RECURSIVE u AS (SELECT s_suppkey AS unit, (s_suppkey % 40 >= 20)::INT AS fua FROM supplier),
      e AS (SELECT a.unit AS u, b.unit AS v FROM u a JOIN u b ON b.unit = a.unit + 1 AND a.fua = b.fua AND b.unit % 5 <> 0),
      both_ways AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
      seen AS (SELECT unit, unit AS other FROM u UNION SELECT seen.unit, v FROM seen JOIN both_ways ON other = u),
      parts AS (SELECT unit, fua, component FROM u JOIN (SELECT unit, min(other) AS component FROM seen GROUP BY 1) USING (unit))
      SELECT fua, sum(n)::BIGINT AS units, count(*) AS components, max(n) AS main, (sum(n) - max(n))::BIGINT AS cut FROM (SELECT fua, component, count(*) AS n FROM parts GROUP BY ALL) GROUP BY 1""",
    "od_best_destination": _OD + "SELECT origin, dest, flow FROM od QUALIFY row_number() OVER (PARTITION BY origin ORDER BY flow DESC, dest DESC) = 1",
    "od_overall": _OD + "SELECT round(sum(internal) / sum(out_total), 6) AS self_containment, count(*) AS units FROM stats",
    "self_containment": _SC + """SELECT fa_code, motive, departures_res, internal_trips, arrivals_total, arrivals_internal, round(rbsc, 6) AS "RBSC", round(1 - rbsc, 6) AS "LEAK", round(dbsc, 6) AS "DBSC",
      arrivals_total - arrivals_internal AS arrivals_external, round(1 - dbsc, 6) AS nonresident_share FROM sc""",
    "self_containment_meta": _SC + """SELECT fa_code, motive, departures_res, internal_trips, arrivals_total, arrivals_internal, round(rbsc, 6) AS "RBSC", round(1 - rbsc, 6) AS "LEAK", round(dbsc, 6) AS "DBSC",
      arrivals_total - arrivals_internal AS arrivals_external, round(1 - dbsc, 6) AS nonresident_share, n_name AS fa_name, n_regionkey::VARCHAR AS cntr FROM sc LEFT JOIN nation ON fa_code = n_nationkey AND n_nationkey <> 5""",
    "benchmark_shares": _SC + """SELECT motive, count(rbsc) AS n_areas, round(avg(CASE WHEN rbsc >= 0.04 THEN 1.0 ELSE 0.0 END), 6) AS share_low,
      round(avg(CASE WHEN rbsc >= 0.05 THEN 1.0 ELSE 0.0 END), 6) AS share_high FROM sc GROUP BY 1""",
    "zonal_sums": _ZONES + "SELECT zone, pop, urban_pop, city_pop, pixels, round(urban_share, 6) AS urban_share, round(city_share, 6) AS city_share FROM zs",
    "zonal_correlations": _ZONES + """, r AS (SELECT corr(pop, urban_share) AS xy, corr(pop, city_share) AS xz, corr(urban_share, city_share) AS yz FROM zs)
      SELECT round(xy, 6) AS r_xy, round(xz, 6) AS r_xz, round(yz, 6) AS r_yz, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS r_xy_z FROM r""",
    "quartile_means": _ZONES + """, k AS (SELECT *, row_number() OVER (ORDER BY urban_share, zone) AS rn, count(*) OVER () AS total FROM zs)
      SELECT greatest(1, ceil((rn - 1) * 4 / (total - 1)::DOUBLE))::INT AS quarter, count(*) AS n, round(avg(pop), 6) AS pop, round(avg(city_share), 6) AS city_share FROM k GROUP BY 1""",
    "presence_rings": _PRESENCE + """, w AS (SELECT zone, timezone, """ + ", ".join(f"coalesce(sum(population) FILTER (WHERE ring = {i}), 0.0) AS r{i}" for i in range(4)) + """ FROM p GROUP BY ALL)
      SELECT zone, timezone, round(r0, 6) AS r0, round(r1, 6) AS r1, round(r2, 6) AS r2, round(r3, 6) AS r3, round(r0 + r1 + r2 + r3, 6) AS total, round(r0 / (r0 + r1 + r2 + r3), 6) AS local_share, round(1 - r0 / (r0 + r1 + r2 + r3), 6) AS outside_share FROM w""",
    "day_night": _PRESENCE + """, w AS (SELECT zone, sum(CASE WHEN timezone = 0 THEN population END) AS day, sum(CASE WHEN timezone = 1 THEN population END) AS night FROM p GROUP BY 1)
      SELECT zone, round(day, 6) AS day, round(night, 6) AS night, round(day / night, 6) AS day_night FROM w WHERE day >= 10 AND night >= 10""",
    "presence_by_hour": _PRESENCE + "SELECT date_trunc('hour', ts) AS window_start, zone, count(*) AS points FROM p GROUP BY ALL",
    "hierarchy_fill": """WITH s AS (SELECT c_nationkey AS sheet, c_custkey AS row_idx, CASE WHEN c_custkey % 7 = 0 THEN c_name END AS area, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS city FROM customer),
      k AS (SELECT *, count(area) OVER (PARTITION BY sheet ORDER BY row_idx) AS section, last_value(area IGNORE NULLS) OVER (PARTITION BY sheet ORDER BY row_idx) AS outer_filled FROM s)
      SELECT sheet, row_idx, section, outer_filled, last_value(city IGNORE NULLS) OVER (PARTITION BY sheet, section ORDER BY row_idx) AS inner_filled FROM k""",
}
