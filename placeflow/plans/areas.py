"""Queries on delimitation, rules and contiguity, and their SQL. Rounds of an operator are unrolled in SQL, more of them than it takes.

Flows: an order's customer is the origin; its items go as many customers further as their line number's square, less one. So near
customers exchange most, and areas form along the line of customers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import delimitation, flows, fragments, rules
from ..sources.adapters import standardize_od
from ._tables import read, rounded

QUANTILE, MERGE, JOIN, ROUNDS, REPETITIONS = 0.98, 0.10, 0.15, 20, 10


def _trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    both = items.join(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.expr("l_orderkey = o_orderkey"))
    return both.select("o_custkey", (F.col("o_custkey") + F.col("l_linenumber") * F.col("l_linenumber") - 1).alias("to"), "l_quantity")


def _od(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delimitation.staged(flows.prepare_od(_trips(spark, sf_dir), "o_custkey", "to", "l_quantity"))


def _cores(od: DataFrame) -> DataFrame:
    return flows.find_cores(flows.unit_stats(od), QUANTILE)


def _areas(od: DataFrame) -> DataFrame:
    return delimitation.build_areas(od, _cores(od), MERGE, JOIN, ROUNDS)


def od_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows between customers that have orders and get some; codes that begin with 1."""
    return delimitation.clean_units(_od(spark, sf_dir), "^1")


def od_merged_cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    od = _od(spark, sf_dir)
    return delimitation.merge_cores(od, _cores(od), MERGE)


def od_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _areas(_od(spark, sf_dir))


def od_area_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    od = _od(spark, sf_dir)
    return rounded(delimitation.area_summary(od, _areas(od)))


def od_area_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(delimitation.area_sizes(_areas(_od(spark, sf_dir))))


def od_null_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    od = _od(spark, sf_dir)
    return rounded(delimitation.null_model(od, _areas(od), REPETITIONS))


def od_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole run, from cleaning to the excess over random areas."""
    return rounded(delimitation.delimit(_od(spark, sf_dir), ".", QUANTILE, MERGE, JOIN, REPETITIONS)[2])


def od_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of areas where a customer is next to the two on either side."""
    od = _od(spark, sf_dir)
    return fragments.fragmentation(fragments.area_components(_areas(od).where("fua IS NOT NULL"), _adjacent(od)))


def od_cut_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    od = _od(spark, sf_dir)
    return fragments.cut_off(fragments.area_components(_areas(od).where("fua IS NOT NULL"), _adjacent(od)))


def _adjacent(od: DataFrame) -> DataFrame:
    """Each unit beside the next two; quantities are above zero, so flows hold all of them."""
    units = od.select(F.col("origin").cast("long").alias("n")).union(od.select(F.col("dest").cast("long"))).distinct()
    steps = units.select(F.col("n").cast("string").alias("u"), F.explode(F.array((F.col("n") + 1).cast("string"), (F.col("n") + 2).cast("string"))).alias("v"))
    return fragments.symmetric(steps, "u", "v")


def od_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    od = _od(spark, sf_dir)
    cores = _cores(od)
    return fragments.repair(od, delimitation.build_areas(od, cores, MERGE, JOIN, ROUNDS), _adjacent(od), cores, 4)


def grid_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares of a grid that share a corner; squares are where events are."""
    cells = read(spark, sf_dir, "events").select((F.col("event_id") % 180).alias("x"), (F.col("user_id") % 200).alias("y")).distinct()
    ring = F.array(*(F.struct((F.col("x") + dx).cast("double").alias("x"), (F.col("y") + dy).cast("double").alias("y")) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))))
    return fragments.adjacency(cells.select(F.concat_ws("_", F.col("x"), F.col("y")).alias("unit"), ring.alias("corners")))


RULE = rules.Rule(13000.0, 40000.0, 0.16, 0.14)


def _nations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Flows between nations in 100,000ths of all, home markets counted twice; areas of every eighth nation."""
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    rows = (
        items.join(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.expr("l_orderkey = o_orderkey"))
        .join(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.expr("o_custkey = c_custkey"))
        .join(read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.expr("l_suppkey = s_suppkey"))
    )
    sums = rows.groupBy(F.col("c_nationkey").cast("string").alias("origin"), F.col("s_nationkey").cast("string").alias("dest")).agg(F.sum("l_quantity").alias("q"))
    total = sums.agg(F.sum("q").alias("total"))
    near = F.when(F.expr("CAST(origin AS INT) % 8 = CAST(dest AS INT) % 8"), 2.0).otherwise(1.0)
    # the total is one row
    od = sums.withColumn("k", F.lit(1)).join(total.withColumn("k", F.lit(1)), "k").select("origin", "dest", F.round(100000 * near * F.col("q") / F.col("total")).alias("flow"))
    assigned = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("unit"), F.concat(F.lit("A"), (F.col("n_nationkey") % 8).cast("string")).alias("fua"))
    return od, assigned


def area_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of self-containment, the threshold for the size, and whether the area is valid."""
    stats = rules.area_stats(rules.area_flows(*_nations(spark, sf_dir)))
    return rounded(stats.withColumns({"threshold": RULE.threshold(F.col("size")), "valid": RULE.valid()}))


def enforce_merging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.enforce_by_merging(*_nations(spark, sf_dir), RULE, 12)


def enforce_dissolving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.enforce_by_dissolving(*_nations(spark, sf_dir), RULE, 12)


def _adapted(headers: tuple[str, str, str], country: str, motive: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders = read(spark, sf_dir, "orders")
        rows = orders.select(F.concat(F.lit(" "), F.col("o_custkey").cast("string")).alias(headers[0]) if country != "JP" else F.col("o_custkey").alias(headers[0]), F.when(F.col("o_orderkey") % 10 > 0, F.col("o_orderkey") % 97).cast("string").alias(headers[1]), F.when(F.col("o_orderstatus") == "F", F.lit("x")).otherwise(F.round("o_totalprice").cast("long").cast("string")).alias(headers[2]), "o_orderpriority")
        rows = rows.withColumnRenamed("o_orderpriority", "motive") if motive else rows.drop("o_orderpriority")
        return standardize_od(rows, country.lower())

    return query


_ADAPTED = {
    "od_standardize_rs": (("opstina_stanovanja", "opstina_rada", "broj"), "RS", False),
    "od_standardize_gb": (("Middle layer Super Output Areas code", "MSOA of workplace code", "Count"), "GB", False),
    "od_standardize_gb_api": (("usual_residence", "place_of_work", "obs_value"), "GB", True),
    "od_standardize_jp": (("residence_code", "work_school_code", "value"), "JP", True),
    "od_standardize_nl": (("woongemeente", "werkgemeente", "aantal"), "NL", False),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _adapted(*_ADAPTED[name]) if name in _ADAPTED else globals()[name] for name in SQL}


_OD = """
od AS MATERIALIZED (
  SELECT o_custkey::VARCHAR AS origin, (o_custkey + l_linenumber * l_linenumber - 1)::VARCHAR AS dest, sum(l_quantity) AS flow
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL HAVING sum(l_quantity) > 0)"""
_CORES = f""",
ext AS MATERIALIZED (SELECT *, sum(flow) OVER (PARTITION BY origin) AS oe FROM od WHERE origin <> dest),
units AS MATERIALIZED (SELECT DISTINCT unit FROM (SELECT origin AS unit FROM od UNION ALL SELECT dest FROM od)),
inflow AS MATERIALIZED (SELECT dest AS unit, sum(flow) AS inflow FROM ext GROUP BY 1),
stats AS (
  SELECT unit, coalesce(inflow, 0.0) AS in_external, o.f AS out_total, d.f AS in_total FROM units LEFT JOIN inflow USING (unit)
  LEFT JOIN (SELECT origin AS unit, sum(flow) AS f FROM od GROUP BY 1) o USING (unit) LEFT JOIN (SELECT dest AS unit, sum(flow) AS f FROM od GROUP BY 1) d USING (unit)),
cores AS MATERIALIZED (SELECT unit FROM stats WHERE in_external >= (SELECT quantile_cont(in_external, {QUANTILE}) FROM stats) AND in_total / out_total >= 1),
links AS MATERIALIZED (
  SELECT origin AS u, dest AS v FROM ext WHERE origin IN (FROM cores) AND dest IN (FROM cores) AND flow / oe >= {MERGE}
  UNION SELECT dest, origin FROM ext WHERE origin IN (FROM cores) AND dest IN (FROM cores) AND flow / oe >= {MERGE}),
reach AS (SELECT unit, unit AS other FROM cores UNION SELECT reach.unit, links.v FROM reach JOIN links ON other = u),
comp AS (SELECT unit, min(other) AS component FROM reach GROUP BY 1),
heads AS (SELECT component, (list(unit ORDER BY coalesce(inflow, 0.0) DESC, unit DESC))[1] AS fua FROM comp LEFT JOIN inflow USING (unit) GROUP BY 1),
a0 AS MATERIALIZED (SELECT unit, fua FROM comp JOIN heads USING (component))"""
_STEP = """,
a{k} AS MATERIALIZED (
  SELECT * FROM a{j} UNION ALL
  SELECT unit, fua FROM (
    SELECT unit, fua, share FROM (
      SELECT e.origin AS unit, a.fua AS fua, sum(e.flow) / min(e.oe) AS share FROM ext e JOIN a{j} a ON e.dest = a.unit WHERE e.origin NOT IN (SELECT unit FROM a{j}) GROUP BY e.origin, a.fua)
    QUALIFY row_number() OVER (PARTITION BY unit ORDER BY share DESC, fua DESC) = 1)
  WHERE share >= """ + f"{JOIN})"
_AREAS = "WITH RECURSIVE" + _OD + _CORES + "".join(_STEP.format(k=k, j=k - 1) for k in range(1, ROUNDS + 1)) + f""",
areas AS MATERIALIZED (SELECT unit, fua FROM a{ROUNDS}),
summary AS (
  SELECT fua, units, coalesce(departures, 0.0) AS departures, coalesce(internal, 0.0) AS internal FROM (SELECT fua, count(*) AS units FROM areas GROUP BY 1)
  LEFT JOIN (SELECT a.fua, sum(flow) AS departures, sum(CASE WHEN a.fua = b.fua THEN flow ELSE 0.0 END) AS internal FROM od JOIN areas a ON origin = a.unit LEFT JOIN areas b ON dest = b.unit GROUP BY 1) USING (fua))"""
_NULL = f""",
slots AS (
  SELECT fua, unnest(range(hi - n + 1, hi + 1)) AS slot FROM (SELECT fua, n, (sum(n) OVER (ORDER BY n DESC, fua))::BIGINT AS hi FROM (SELECT fua, count(*) AS n FROM areas GROUP BY 1))),
drawn AS (SELECT unit, r AS repetition, row_number() OVER (PARTITION BY r ORDER BY md5(concat_ws('|', '0', r, unit)), unit) AS slot FROM areas, range(1, {REPETITIONS + 1}) t(r)),
label AS MATERIALIZED (SELECT repetition, unit, slots.fua FROM drawn JOIN slots USING (slot)),
chance AS (
  SELECT a.repetition::INT AS repetition, sum(CASE WHEN a.fua = b.fua THEN flow ELSE 0.0 END) / sum(flow) AS sc FROM od JOIN label a ON origin = a.unit
  LEFT JOIN label b ON dest = b.unit AND a.repetition = b.repetition GROUP BY 1)"""
_EDGES = """,
edges AS MATERIALIZED (
  SELECT u::VARCHAR AS u, v::VARCHAR AS v FROM (
    SELECT unit::BIGINT AS u, unit::BIGINT + d AS v FROM units, (VALUES (1), (2)) t(d) UNION SELECT unit::BIGINT + d, unit::BIGINT FROM units, (VALUES (1), (2)) t(d)))"""
#: The units that each unit reaches within its area, and the components that these make.
_PARTS = """,
near{k} AS MATERIALIZED (SELECT u, v FROM edges JOIN {now} x ON u = x.unit JOIN {now} y ON v = y.unit WHERE x.fua = y.fua),
seen{k} AS (SELECT unit, unit AS other FROM {now} UNION SELECT seen{k}.unit, v FROM seen{k} JOIN near{k} ON other = u),
parts{k} AS MATERIALIZED (SELECT unit, fua, component FROM {now} JOIN (SELECT unit, min(other) AS component FROM seen{k} GROUP BY 1) USING (unit)),
main{k} AS MATERIALIZED (
  SELECT fua, component, row_number() OVER (PARTITION BY fua ORDER BY core DESC, n DESC, component) AS rank
  FROM (SELECT fua, component, {core} AS core, count(*) AS n FROM parts{k} GROUP BY ALL))"""
_REPAIR = """,
offers{k} AS (
  SELECT l.fua, l.component, y.fua AS other, sum(coalesce(f.flow, 0.0)) AS flow FROM parts{k} l JOIN main{k} m ON l.fua = m.fua AND l.component = m.component AND m.rank > 1
  JOIN edges e ON l.unit = e.u JOIN {now} y ON e.v = y.unit AND y.fua <> l.fua LEFT JOIN both_ways f ON f.u = e.u AND f.v = e.v GROUP BY ALL),
to{k} AS (SELECT fua, component, other FROM offers{k} QUALIFY row_number() OVER (PARTITION BY fua, component ORDER BY flow DESC, other DESC) = 1),
fixed{k} AS MATERIALIZED (SELECT unit, coalesce(t.other, p.fua) AS fua FROM parts{k} p LEFT JOIN to{k} t ON p.fua = t.fua AND p.component = t.component)"""


def _repair(rounds: int) -> str:
    out, now = """,
both_ways AS MATERIALIZED (SELECT u, v, sum(flow) AS flow FROM (SELECT origin AS u, dest AS v, flow FROM ext UNION ALL SELECT dest, origin, flow FROM ext) GROUP BY ALL)""", "areas"
    for k in range(rounds):
        out += _PARTS.format(k=k, now=now, core="max((unit IN (FROM cores))::INT)") + _REPAIR.format(k=k, now=now)
        now = f"fixed{k}"
    return out


_RULES = f"""
WITH q AS (
  SELECT c_nationkey AS o, s_nationkey AS d, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
od AS MATERIALIZED (SELECT o::VARCHAR AS origin, d::VARCHAR AS dest, round(100000 * (CASE WHEN o % 8 = d % 8 THEN 2.0 ELSE 1.0 END)::DOUBLE * q / (SELECT sum(q) FROM q)) AS flow FROM q),
n0 AS MATERIALIZED (SELECT n_nationkey::VARCHAR AS unit, 'A' || (n_nationkey % 8) AS fua FROM nation)"""
_STATS = f""",
m{{k}} AS MATERIALIZED (SELECT a.fua AS a, b.fua AS b, sum(flow) AS flow FROM od JOIN n{{k}} a ON origin = a.unit JOIN n{{k}} b ON dest = b.unit GROUP BY ALL),
s{{k}} AS MATERIALIZED (
  SELECT *, least(sc_supply, sc_demand) AS sc, residents AS size, {RULE.sc_small} + least(1.0, greatest(0.0, (residents - {RULE.small}) / {RULE.big - RULE.small})) * ({RULE.sc_big} - {RULE.sc_small}) AS threshold FROM (
    SELECT area, sum(o) AS residents, sum(i) AS jobs, sum(s) AS internal, CASE WHEN sum(o) > 0 THEN sum(s) / sum(o) ELSE 0.0 END AS sc_supply, CASE WHEN sum(i) > 0 THEN sum(s) / sum(i) ELSE 0.0 END AS sc_demand
    FROM (SELECT a AS area, flow AS o, 0.0 AS i, CASE WHEN a = b THEN flow ELSE 0.0 END AS s FROM m{{k}} UNION ALL SELECT b, 0.0, flow, 0.0 FROM m{{k}}) GROUP BY 1)),
bad{{k}} AS (SELECT area, CASE WHEN size < {RULE.small} THEN 1.0 + ({RULE.small} - size) / {RULE.small} ELSE threshold - sc END AS deficit FROM s{{k}} WHERE NOT (size >= {RULE.small} AND sc >= threshold)),
w{{k}} AS MATERIALIZED (SELECT area FROM bad{{k}} ORDER BY deficit DESC, area LIMIT 1)"""
_MERGED = """,
t{k} AS MATERIALIZED (
  SELECT target FROM (SELECT CASE WHEN a = area THEN b ELSE a END AS target, flow FROM m{k}, w{k} WHERE (a = area OR b = area) AND a <> b)
  GROUP BY 1 HAVING sum(flow) > 0 ORDER BY sum(flow) DESC, target LIMIT 1),
n{next} AS MATERIALIZED (SELECT unit, CASE WHEN fua = (SELECT area FROM w{k}) THEN coalesce((SELECT target FROM t{k}), fua) ELSE fua END AS fua FROM n{k})"""
_DISSOLVED = """,
l{k} AS (
  SELECT n.unit, x.fua AS target, sum(flow) AS flow FROM n{k} n JOIN (SELECT origin AS unit, dest AS other, flow FROM od UNION ALL SELECT dest, origin, flow FROM od) USING (unit) JOIN n{k} x ON other = x.unit
  WHERE n.fua = (SELECT area FROM w{k}) AND x.fua IN (SELECT area FROM s{k} EXCEPT SELECT area FROM bad{k}) GROUP BY ALL),
t{k} AS (SELECT unit, target FROM l{k} QUALIFY row_number() OVER (PARTITION BY unit ORDER BY flow DESC, target DESC) = 1),
n{next} AS MATERIALIZED (SELECT unit, coalesce(target, fua) AS fua FROM n{k} LEFT JOIN t{k} USING (unit))"""


def _adapted_sql(headers: tuple[str, str, str], country: str, motive: bool) -> str:
    code = "CASE WHEN length(o_custkey::VARCHAR) < 5 THEN lpad(o_custkey::VARCHAR, 5, '0') ELSE o_custkey::VARCHAR END" if country == "JP" else "o_custkey::VARCHAR"
    dest = "(o_orderkey % 97)::VARCHAR"
    dest = f"lpad({dest}, 5, '0')" if country == "JP" else dest
    return f"""SELECT {code} AS "ORIG_CODE", {dest} AS "DEST_CODE", round(o_totalprice)::DOUBLE AS trip_count, {"o_orderpriority" if motive else "'work'"} AS motive
      FROM orders WHERE o_orderkey % 10 > 0 AND o_orderstatus <> 'F' AND round(o_totalprice) > 0"""


SQL = {
    "od_clean": "WITH" + _OD + """, units AS (SELECT origin AS unit FROM od INTERSECT SELECT dest FROM od) SELECT origin, dest, flow FROM od
      WHERE origin IN (SELECT unit FROM units WHERE unit LIKE '1%') AND dest IN (SELECT unit FROM units WHERE unit LIKE '1%')""",
    "od_merged_cores": "WITH RECURSIVE" + _OD + _CORES + " SELECT unit, fua FROM a0",
    "od_areas": _AREAS + " SELECT unit, fua, unit IN (FROM cores) AS is_core FROM units LEFT JOIN areas USING (unit)",
    "od_area_summary": _AREAS + " SELECT *, round(CASE WHEN departures > 0 THEN internal / departures END, 6) AS self_containment FROM summary",
    "od_area_sizes": _AREAS + " SELECT count(*) AS areas, median(n) AS median, max(n) AS largest, min(n) AS smallest FROM (SELECT fua, count(*) AS n FROM areas GROUP BY 1)",
    "od_null_model": _AREAS + _NULL + " SELECT repetition, round(sc, 6) AS self_containment FROM chance",
    "od_excess": (_AREAS + _NULL).replace(_OD, _OD.replace("od AS MATERIALIZED", "raw AS MATERIALIZED") + """,
od AS MATERIALIZED (SELECT * FROM raw WHERE origin IN (SELECT dest FROM raw) AND dest IN (SELECT origin FROM raw) AND origin IN (SELECT origin FROM raw) AND dest IN (SELECT dest FROM raw))""") + """
      SELECT round(sc, 6) AS self_containment, areas, round(c, 6) AS by_chance, round(sc - c, 6) AS excess FROM (SELECT sum(internal) / sum(departures) AS sc, count(*) AS areas FROM summary), (SELECT avg(sc) AS c FROM chance)""",
    "od_contiguity": _AREAS + _EDGES + _PARTS.format(k=0, now="areas", core="0") + """
      SELECT fua, sum(n)::BIGINT AS units, count(*) AS components, max(n) AS main, (sum(n) - max(n))::BIGINT AS cut FROM (SELECT fua, component, count(*) AS n FROM parts0 GROUP BY ALL) GROUP BY 1""",
    "od_cut_off": _AREAS + _EDGES + _PARTS.format(k=0, now="areas", core="0") + " SELECT unit, p.fua FROM parts0 p JOIN main0 m ON p.fua = m.fua AND p.component = m.component WHERE rank > 1",
    "od_repaired": _AREAS + _EDGES + _repair(4) + " SELECT unit, fua FROM fixed3",
    "grid_adjacency": """WITH c AS (SELECT DISTINCT event_id % 180 AS x, user_id % 200 AS y FROM events)
      SELECT concat_ws('_', a.x, a.y) AS u, concat_ws('_', b.x, b.y) AS v FROM c a JOIN c b ON b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 WHERE a.x <> b.x OR a.y <> b.y""",
    "area_stats": _RULES + _STATS.format(k=0) + """ SELECT area, residents, jobs, internal, round(sc_supply, 6) AS sc_supply, round(sc_demand, 6) AS sc_demand, round(sc, 6) AS sc, size, round(threshold, 6) AS threshold,
      area NOT IN (SELECT area FROM bad0) AS valid FROM s0""",
    "enforce_merging": _RULES + "".join(_STATS.format(k=k) + _MERGED.format(k=k, next=k + 1) for k in range(12)) + " SELECT unit, fua FROM n12",
    "enforce_dissolving": _RULES + "".join(_STATS.format(k=k) + _DISSOLVED.format(k=k, next=k + 1) for k in range(12)) + " SELECT unit, fua FROM n12",
    **{name: _adapted_sql(*x) for name, x in _ADAPTED.items()},
}
