"""Queries on the census sheet and on matching it with a map, and their SQL.

The sheet is made of nations and their customers: a row for the whole, one for each nation (an area), one for every third nation's
city, and per customer rows for all, men and women, followed by rows for urban and, but for every fourth, other settlements.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import ascii_name, level_of
from ..operators import census, matching
from ._tables import read, rounded


def _count(i: int) -> Column:
    """Migrants of a customer: those who stay, go within the area, beyond, abroad; single settlements have none that stay."""
    n = F.when((F.col("c_custkey") % 4 == 0) & (F.lit(i) == 0), 0).otherwise((F.col("c_custkey") * (7 + i) + F.col("shift")) % (40 + i) + 1)
    return n.cast("long")


def _sheet(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    people = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.lit(shift).alias("shift"))
    counts = people.select("c_custkey", "c_nationkey", *(_count(i).alias(f"n{i}") for i in range(4))).withColumn("n", F.expr("n0 + n1 + n2 + n3"))
    text = lambda *values: [F.lit(v) if isinstance(v, str) else v.cast("string") for v in values]
    columns = ["row_idx", "c0", "c1", *(f"c{i}" for i in range(2, 7))]

    def rows(frame: DataFrame, order: Column, name: Column, sex: str, *values: Column) -> DataFrame:
        return frame.select(order.cast("long").alias("row_idx"), name.alias("c0"), F.lit(sex).alias("c1"), *text(*values)).toDF(*columns)

    place = (F.col("c_nationkey") + 1).cast("long") * 1_000_000_000
    own = place + 10 * (F.col("c_custkey") + 1)
    values = [F.col(c) for c in ("n", "n0", "n1", "n2", "n3")]
    name = F.concat(F.lit(" Општина "), F.col("c_custkey").cast("string"), F.lit(" "))
    whole = counts.agg(*(F.sum(c).alias(c) for c in ("n", "n0", "n1", "n2", "n3")))
    nations = counts.groupBy("c_nationkey").agg(*(F.sum(c).alias(c) for c in ("n", "n0", "n1", "n2", "n3")))
    bad = F.when(F.col("c_custkey") % 50 == 7, F.lit("-")).otherwise(F.col("n3").cast("string"))
    empty = F.when(F.col("c_custkey") % 10 != 3, F.col("n2"))
    parts = [
        rows(whole, F.lit(1), F.lit("РЕПУБЛИКА"), "с", *values),
        rows(nations, place, F.concat(F.lit("Област "), F.col("c_nationkey").cast("string")), "с", *values),
        rows(nations.where("c_nationkey % 3 = 0"), place + 1, F.concat(F.lit("Град "), F.col("c_nationkey").cast("string")), "с", *values),
        rows(counts, own, name, "с", F.col("n"), F.col("n0"), F.col("n1"), empty, bad),
        rows(counts, own + 1, name, "м", *values),
        rows(counts, own + 2, name, "ж", *values),
        rows(counts, own + 3, F.lit("Градска"), "с", *values),
        rows(counts.where("c_custkey % 4 <> 0"), own + 4, F.lit("Остала"), "с", *values),
        rows(counts.where("c_custkey % 4 = 0"), own + 5, F.lit("Остала"), "м", *values),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out.withColumn("sheet", F.lit(f"sheet{shift}"))


def sheet_territories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return census.read_territories(_sheet(spark, sf_dir), "all")


def sheet_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return census.reconcile(census.read_territories(_sheet(spark, sf_dir), "all"))


def _shares(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    return census.add_self_containment(census.read_territories(_sheet(spark, sf_dir, shift)))


def ring_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_shares(spark, sf_dir).select("name", "key", "single_settlement", "rbsc", "leakage", "share_other_area", "share_abroad"))


def ring_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of a sheet: keys are unique, no city is among municipalities, shares lie in 0 to 1, zeros are the single settlements."""
    rows = _shares(spark, sf_dir)
    repeated = census.duplicates(rows, "key").agg(F.count("*").alias("repeated_keys"))
    off = F.count_if(F.coalesce(F.col("rbsc") == 0, F.lit(False)) != F.col("single_settlement"))
    rest = rows.agg(F.count("*").alias("municipalities"), F.count_if(F.col("name").startswith("Град ")).alias("cities"), F.count_if(~F.col("rbsc").between(0, 1)).alias("beyond"), off.alias("unlike_zeros"), F.count_if(F.col("rbsc") >= 0.25).alias("high"))
    return rest.withColumn("k", F.lit(1)).join(repeated.withColumn("k", F.lit(1)), "k").drop("k")


def study_work_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(census.gaps(_shares(spark, sf_dir), _shares(spark, sf_dir, 11)))


def study_work_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(census.gap_summary(census.gaps(_shares(spark, sf_dir), _shares(spark, sf_dir, 11))))


def name_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sheet(spark, sf_dir).select(level_of(F.trim("c0")).alias("level")).groupBy("level").agg(F.count("*").alias("n"))


def _word(key: Column) -> Column:
    """A name of seven letters for a number: its digits as letters of the alphabet's first half, so that wildcards have something to confuse."""
    return F.translate(F.lpad(key.cast("string"), 7, "0"), "0123456789", "ABCDEFGHIJ")


def _territories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as territories; the last hundredth of numbers shares its names with others, of other areas."""
    rows = read(spark, sf_dir, "customer")
    twin = F.col("c_custkey") % 100 == 99
    return rows.select(_word(F.when(twin, F.col("c_custkey") - 1).otherwise(F.col("c_custkey"))).alias("name"), F.when(twin, F.lit("NISAVSKA")).otherwise(F.lit("BEOGRADSKA")).alias("area"))


def _polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as polygons: every third has lost a letter, every thirtieth two more; twins have a qualifier."""
    key = F.col("c_custkey")
    word = _word(F.when(key % 100 == 99, key - 1).otherwise(key))
    lost = F.when(key % 30 == 0, F.concat(F.substring(word, 1, 5), F.lit("??"))).when(key % 3 == 0, F.concat(F.substring(word, 1, 6), F.lit("?"))).otherwise(word)
    qual = F.when(key % 100 == 99, " (NI?)").when(key % 100 == 98, " (BEOGRAD)").otherwise("")
    return read(spark, sf_dir, "customer").select(key.alias("polygon_id"), F.concat(lost, qual).alias("name"), (key % 13).cast("string").alias("code"))


def name_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match(_polygons(spark, sf_dir), _territories(spark, sf_dir))


def name_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left without a partner, when polygons whose code begins with 9 are left out."""
    polygons = matching.without_prefix(_polygons(spark, sf_dir), "code")
    return matching.audit(matching.match(polygons, _territories(spark, sf_dir)), polygons, _territories(spark, sf_dir))


def twin_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _territories(spark, sf_dir).withColumn("plain", ascii_name(F.col("name")))
    return census.duplicates(rows, "plain").select("plain", "area")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in SQL}


def _territory_sql(name: str, shift: int) -> str:
    n = [f"((c_custkey * {7 + i} + {shift}) % {40 + i} + 1)" for i in range(4)]
    return f"""
{name}_n AS (SELECT c_custkey AS k, c_nationkey AS a, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE {n[0]} END AS n0, {n[1]} AS n1, {n[2]} AS n2, {n[3]} AS n3 FROM customer),
{name}_m AS (SELECT *, n0 + n1 + n2 + n3 AS n FROM {name}_n),
{name} AS (
  SELECT (a + 1)::BIGINT * 1000000000 + 10 * (k + 1) AS row_idx, 'Општина ' || k AS name, 'municipality' AS level, 'Област ' || a AS area, CASE WHEN a % 3 = 0 THEN 'Град ' || a END AS city,
    n::DOUBLE AS total, n0::DOUBLE AS same_municipality, n1::DOUBLE AS other_municipality_same_area, CASE WHEN k % 10 = 3 THEN 0.0 ELSE n2 END::DOUBLE AS other_area, n3::DOUBLE AS abroad, k % 4 = 0 AS single_settlement
  FROM {name}_m WHERE k % 50 <> 7),
{name}_s AS (
  SELECT *, area || ' / ' || name AS key, CASE WHEN total > 0 THEN same_municipality / total END AS rbsc FROM {name})"""


_W, _S = _territory_sql("w", 0), _territory_sql("s", 11)
_SUMS = "sum(n)::DOUBLE AS total, sum(n0)::DOUBLE AS same_municipality, sum(n1)::DOUBLE AS other_municipality_same_area, sum(n2)::DOUBLE AS other_area, sum(n3)::DOUBLE AS abroad"
_ALL = f"""WITH {_W}, every AS (
  SELECT 1::BIGINT AS row_idx, 'РЕПУБЛИКА' AS name, 'country_or_macroregion' AS level, NULL AS area, NULL AS city, {_SUMS}, false AS single_settlement FROM w_m
  UNION ALL SELECT (a + 1)::BIGINT * 1000000000, 'Област ' || a, 'area', 'Област ' || a, NULL, {_SUMS}, false FROM w_m GROUP BY a
  UNION ALL SELECT (a + 1)::BIGINT * 1000000000 + 1, 'Град ' || a, 'city_aggregate', 'Област ' || a, NULL, {_SUMS}, false FROM w_m WHERE a % 3 = 0 GROUP BY a
  UNION ALL SELECT * FROM w)"""
_WORD = "translate(lpad({k}::VARCHAR, 7, '0'), '0123456789', 'ABCDEFGHIJ')"
_TWIN = "CASE WHEN c_custkey % 100 = 99 THEN c_custkey - 1 ELSE c_custkey END"


def _match_sql(where: str) -> str:
    """Stage 3 by patterns' leading letters, unrolled: a polygon with one free territory claims it unless another such polygon does."""
    word = _WORD.format(k=f"({_TWIN})")
    out = f"""
c0 AS (SELECT {word} AS base, CASE WHEN c_custkey % 100 = 99 THEN 'NISAVSKA' ELSE 'BEOGRADSKA' END AS area FROM customer),
c AS MATERIALIZED (SELECT base, area, count(*) OVER (PARTITION BY base) > 1 AS twin, CASE WHEN count(*) OVER (PARTITION BY base) > 1 THEN base || '@' || area ELSE base END AS key FROM c0),
p AS MATERIALIZED (
  SELECT c_custkey AS polygon_id, CASE WHEN c_custkey % 30 = 0 THEN left({word}, 5) || '??' WHEN c_custkey % 3 = 0 THEN left({word}, 6) || '?' ELSE {word} END AS base,
    CASE c_custkey % 100 WHEN 99 THEN 'NI_%' WHEN 98 THEN 'BEOGRAD%' ELSE '' END AS qual FROM customer WHERE {where}),
d1 AS (SELECT min(polygon_id) AS polygon_id, key, 1 AS stage FROM p JOIN c USING (base) WHERE NOT twin AND NOT contains(base, '?') GROUP BY key),
twins AS (
  SELECT polygon_id, key FROM p JOIN c ON twin AND c.base LIKE replace(p.base, '?', '_') AND qual <> '' AND area LIKE qual WHERE polygon_id NOT IN (SELECT polygon_id FROM d1)),
e0 AS MATERIALIZED (
  SELECT * FROM d1 UNION ALL SELECT polygon_id, key, 2 FROM twins QUALIFY count(*) OVER (PARTITION BY polygon_id) = 1 AND count(*) OVER (PARTITION BY key) = 1)"""
    for k in range(1, 7):
        out += f""",
x{k} AS (
  SELECT polygon_id, key FROM p JOIN c ON left(c.base, 5) = left(p.base, 5) AND c.base LIKE replace(p.base, '?', '_')
  WHERE contains(p.base, '?') AND polygon_id NOT IN (SELECT polygon_id FROM e{k - 1}) AND key NOT IN (SELECT key FROM e{k - 1})),
e{k} AS MATERIALIZED (SELECT * FROM e{k - 1} UNION ALL SELECT polygon_id, key, 3 FROM (SELECT * FROM x{k} QUALIFY count(*) OVER (PARTITION BY polygon_id) = 1) QUALIFY count(*) OVER (PARTITION BY key) = 1)"""
    return "WITH" + out


SQL = {
    "sheet_territories": _ALL + " SELECT 'sheet0' AS sheet, * FROM every",
    "sheet_reconcile": _ALL + ", sums AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", sum({c}) FILTER (WHERE level = 'country_or_macroregion') AS whole, sum({c}) FILTER (WHERE level = 'municipality') AS parts FROM every" for c in census.COUNTS) + ") SELECT 'sheet0' AS sheet, *, parts - whole AS difference FROM sums",
    "ring_shares": f"WITH {_W}" + """ SELECT name, key, single_settlement, round(rbsc, 6) AS rbsc, round(1 - rbsc, 6) AS leakage, round(CASE WHEN total > 0 THEN other_area / total END, 6) AS share_other_area,
      round(CASE WHEN total > 0 THEN abroad / total END, 6) AS share_abroad FROM w_s""",
    "ring_control": f"WITH {_W}" + """ SELECT count(*) AS municipalities, count(*) FILTER (WHERE starts_with(name, 'Град ')) AS cities, count(*) FILTER (WHERE NOT rbsc BETWEEN 0 AND 1) AS beyond,
      count(*) FILTER (WHERE (rbsc = 0) <> single_settlement) AS unlike_zeros, count(*) FILTER (WHERE rbsc >= 0.25) AS high, count(*) - count(DISTINCT key) AS repeated_keys FROM w_s""",
    "study_work_gap": f"WITH {_W}, {_S} SELECT key, round(w_s.rbsc, 6) AS rbsc_work, round(s_s.rbsc, 6) AS rbsc_study, round(s_s.rbsc - w_s.rbsc, 6) + 0.0 AS gap FROM w_s LEFT JOIN s_s USING (key)",
    "study_work_summary": f"WITH {_W}, {_S}, g AS (SELECT w_s.rbsc AS a, s_s.rbsc AS b, s_s.rbsc - w_s.rbsc AS gap FROM w_s LEFT JOIN s_s USING (key)) SELECT round(avg(gap), 6) AS gap_mean, round(median(gap), 6) AS gap_median, round(quantile_cont(abs(gap), 0.97), 6) AS scale, round(corr(a, b), 6) AS r FROM g",
    "name_levels": """SELECT 'country_or_macroregion' AS level, 1 AS n UNION ALL SELECT 'area', count(DISTINCT c_nationkey) FROM customer UNION ALL SELECT 'city_aggregate', count(DISTINCT c_nationkey) FROM customer WHERE c_nationkey % 3 = 0
      UNION ALL SELECT 'municipality', 5 * count(*) FROM customer""",
    "name_matching": _match_sql("true") + " SELECT * FROM e6",
    "name_audit": _match_sql("NOT starts_with((c_custkey % 13)::VARCHAR, '9')") + """ SELECT 'territory' AS problem, key AS id FROM c WHERE key NOT IN (SELECT key FROM e6)
      UNION ALL SELECT 'polygon', polygon_id::VARCHAR FROM p WHERE polygon_id NOT IN (SELECT polygon_id FROM e6)""",
    "twin_names": f"SELECT plain, area FROM (SELECT {_WORD.format(k=f'({_TWIN})')} AS plain, CASE WHEN c_custkey % 100 = 99 THEN 'NISAVSKA' ELSE 'BEOGRADSKA' END AS area FROM customer) QUALIFY count(*) OVER (PARTITION BY plain) > 1",
}
