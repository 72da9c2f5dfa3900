"""Functional areas from flows: merged cores, units that join them round by round, and what the areas keep to themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ratios import ratio
from .cut import merged, rounds, side
from .flows import find_cores, unit_stats
from .fragments import area_components, symmetric


def clean_units(od: DataFrame, pattern: str) -> DataFrame:
    """Flows between units that are both an origin and a destination somewhere and whose code fits the pattern."""
    ends = F.array(*(F.struct(F.col(end).alias("unit"), F.lit(end == "origin").alias("sends"), F.lit(end == "dest").alias("gets")) for end in ("origin", "dest")))
    seen = od.select(F.explode(ends).alias("e")).select("e.*").where(F.col("unit").rlike(pattern)).groupBy("unit").agg(F.max("sends").alias("sends"), F.max("gets").alias("gets"))
    with rounds(od.sparkSession) as cut:
        # both ends of flows meet the same table
        units = side(cut(seen.where("sends AND gets").select("unit")))
        return od.join(units.withColumnRenamed("unit", "origin"), "origin", "left_semi").join(units.withColumnRenamed("unit", "dest"), "dest", "left_semi").select("origin", "dest", "flow")


def _shares(od: DataFrame) -> DataFrame:
    """origin, dest, flow, out_external of flows between different units."""
    outside = od.where("origin <> dest")
    return outside.join(merged(outside.groupBy("origin").agg(F.sum("flow").alias("out_external"))), "origin")


def merge_cores(od: DataFrame, cores: DataFrame, share: float = 0.10) -> DataFrame:
    """unit, fua: cores that send at least a share of their outgoing flows to one another, either way, become one group.

    A group is called by the core with the largest inflow from elsewhere; ties go to the larger id.
    """
    with rounds(od.sparkSession) as cut:
        return cut(_merge(_shares(od), cut(cores.select("unit")), share))


def _merge(shares: DataFrame, cores: DataFrame, share: float) -> DataFrame:
    """merge_cores of _shares' flows and a written table of cores."""
    known = side(cores)
    inner = shares.where(F.col("flow") / F.col("out_external") >= share).join(known.withColumnRenamed("unit", "origin"), "origin", "left_semi").join(known.withColumnRenamed("unit", "dest"), "dest", "left_semi")
    links = symmetric(inner, "origin", "dest")
    groups = area_components(cores.select("unit", F.lit(0).alias("fua")), links).select("unit", "component")
    inflow = shares.select(F.col("dest").alias("unit"), "flow").join(known, "unit", "left_semi").groupBy("unit").agg(F.sum("flow").alias("inflow"))
    filled = groups.join(merged(inflow), "unit", "left").select("unit", "component", F.coalesce("inflow", F.lit(0.0)).alias("inflow"))
    heads = filled.groupBy("component").agg(F.max(F.struct("inflow", "unit"))["unit"].alias("fua"))
    return groups.join(merged(heads), "component").select("unit", "fua")


def build_areas(od: DataFrame, cores: DataFrame, merge_share: float = 0.10, join_share: float = 0.15, most_rounds: int = 20) -> DataFrame:
    """unit, fua (null: none), is_core for every unit of od.

    In a round every unit without area whose flows into one area make at least join_share of its outgoing flows joins the area that
    gets most of them (ties: the larger id). Units that have joined stay, and count as their area in the next round. Flows of
    units with an area are not looked at again. Rounds end when nothing joins, or after most_rounds of them.
    """
    every = od.select(F.explode(F.array("origin", "dest")).alias("unit")).distinct()
    with rounds(od.sparkSession) as cut:
        rest, cores = cut(_shares(od)), cut(cores.select("unit"))
        named = fresh = cut(_merge(rest, cores, merge_share))
        # what units without area send into each area; a round adds the flows into units that have just joined, and takes these units out
        sums = None
        for _ in range(most_rounds):
            new = side(fresh)
            origin = new.select(F.col("unit").alias("origin"))
            # flows into areas are in the sums from now on; only flows between units without area are left for the next round
            into = new.select(F.col("unit").alias("dest"), "fua")
            seen = cut(rest.join(origin, "origin", "left_anti").join(into, "dest", "left").select("origin", "dest", "flow", "out_external", "fua"))
            rest = seen.where("fua IS NULL").drop("fua")
            added = seen.where("fua IS NOT NULL").select("origin", "out_external", "fua", "flow")
            if sums is not None:
                added = added.union(sums.join(origin, "origin", "left_anti"))
            sums = cut(added.groupBy("origin", "out_external", "fua").agg(F.sum("flow").alias("flow")))
            best = sums.groupBy("origin").agg(F.max(F.struct((F.col("flow") / F.col("out_external")).alias("share"), "fua")).alias("b")).where(F.col("b.share") >= join_share)
            fresh = cut(best.select(F.col("origin").alias("unit"), F.col("b.fua").alias("fua")))
            if fresh.isEmpty():
                break
            named = named.union(fresh)
        marked = side(cores.select("unit", F.lit(True).alias("is_core")))
        return cut(every.join(merged(named), "unit", "left").join(marked, "unit", "left").select("unit", "fua", F.coalesce("is_core", F.lit(False)).alias("is_core")))


def area_summary(od: DataFrame, assigned: DataFrame) -> DataFrame:
    """fua, units, departures, internal, self_containment of every area; trips to units without an area leave."""
    a, b = assigned.select(F.col("unit").alias("origin"), F.col("fua").alias("of")), assigned.select(F.col("unit").alias("dest"), F.col("fua").alias("df"))
    trips = od.join(merged(a.where("of IS NOT NULL")), "origin").join(merged(b), "dest", "left")
    sums = trips.groupBy(F.col("of").alias("fua")).agg(F.sum("flow").alias("departures"), F.sum(F.when(F.col("of") == F.col("df"), F.col("flow")).otherwise(0.0)).alias("internal"))
    units = assigned.where("fua IS NOT NULL").groupBy("fua").agg(F.count("*").alias("units"))
    filled = units.join(sums, "fua", "full").select("fua", F.coalesce("units", F.lit(0)).alias("units"), F.coalesce("departures", F.lit(0.0)).alias("departures"), F.coalesce("internal", F.lit(0.0)).alias("internal"))
    return filled.withColumn("self_containment", ratio(F.col("internal"), F.col("departures")))


def area_sizes(assigned: DataFrame) -> DataFrame:
    """areas, and the median, largest and smallest number of their units."""
    sizes = assigned.where("fua IS NOT NULL").groupBy("fua").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("areas"), F.median("n").alias("median"), F.max("n").alias("largest"), F.min("n").alias("smallest"))


#: Leading hexadecimal digits of a digest that name its range: 4,096 ranges of nearly equal size.
DIGITS = 3


def null_model(od: DataFrame, assigned: DataFrame, repetitions: int = 60, seed: str = "0") -> DataFrame:
    """repetition, self_containment of areas of the same sizes whose units are drawn at random.

    Units with an area are put in the order of a digest of seed, repetition and unit, and fill the areas' places, largest area first
    (ties: the smaller id). Flows count whose origin has an area. A unit's place is the number of units in ranges of smaller digests,
    of which a repetition has 16 ** DIGITS, and its place in its own range; so no task puts a whole repetition in order.
    """
    placed = assigned.where("fua IS NOT NULL")
    with rounds(od.sparkSession) as cut:
        sizes = placed.groupBy("fua").agg(F.count("*").alias("n"))
        upto = sizes.withColumn("upto", F.sum("n").over(W.orderBy(F.desc("n"), "fua")))
        # an area is known by its last place
        slots = upto.select(F.col("upto").alias("area"), F.explode(F.sequence(F.col("upto") - F.col("n") + 1, F.col("upto"))).alias("slot"))
        # areas may come in few files, but each of their units makes many rows
        drawn = placed.select("unit").repartition("unit").select("unit", F.explode(F.sequence(F.lit(1), F.lit(repetitions))).alias("repetition"))
        digest = F.md5(F.concat_ws("|", F.lit(seed), F.col("repetition").cast("string"), F.col("unit")))
        # a repetition's range as one number, and digests as bytes, whose order is that of their letters: both are quick to sort
        start = F.col("repetition").cast("long") * 16**DIGITS
        dealt = drawn.withColumn("hex", digest).select("unit", "repetition", F.unhex("hex").alias("digest"), (start + F.conv(F.substring("hex", 1, DIGITS), 16, 10).cast("long")).alias("range"))
        held = dealt.groupBy("repetition", "range").agg(F.count("*").alias("n"))
        before = held.select("range", (F.sum("n").over(W.partitionBy("repetition").orderBy("range")) - F.col("n")).alias("before"))
        within = F.row_number().over(W.partitionBy("range").orderBy("digest", "unit"))
        # at most 16 ** DIGITS rows a repetition
        order = dealt.withColumn("within", within).join(F.broadcast(before), "range").withColumn("slot", F.col("before") + F.col("within"))
        # a unit has a row for each repetition, which are dealt out as they are, since sums of single tasks would not make them fewer
        label = order.join(merged(slots), "slot").select("unit", "repetition", "area").repartition("unit")
        # a unit's areas in one row, so that a flow meets those of either end once, not once a repetition
        areas = [F.max(F.when(F.col("repetition") == r, F.col("area"))).alias(f"a{r}") for r in range(1, repetitions + 1)]
        table = cut(label.groupBy("unit").agg(*areas).select("unit", F.array(*(f"a{r}" for r in range(1, repetitions + 1))).alias("areas")))
        a, b = table.toDF("origin", "of"), table.toDF("dest", "df")
        trips = od.join(merged(a), "origin").join(merged(b), "dest", "left").select("flow", F.zip_with("of", "df", lambda x, y: F.coalesce(x == y, F.lit(False))).alias("same"))
        # a flow that leaves the areas stays in none
        inside = [F.sum(F.when(F.coalesce(F.col("same")[r], F.lit(False)), F.col("flow")).otherwise(0.0)).alias(f"s{r}") for r in range(repetitions)]
        sums = cut(trips.agg(F.sum("flow").alias("total"), *inside)).where("total IS NOT NULL")
        return sums.select(F.posexplode(F.array(*(ratio(F.col(f"s{r}"), F.col("total")) for r in range(repetitions)))).alias("at", "self_containment")).select((F.col("at") + 1).alias("repetition"), "self_containment")


def staged(od: DataFrame) -> DataFrame:
    """od as a table of its own, for what reads flows more than once."""
    with rounds(od.sparkSession) as cut:
        return cut(od)


def delimit(od: DataFrame, pattern: str = ".", inflow_quantile: float = 0.95, merge_share: float = 0.10, join_share: float = 0.15, repetitions: int = 60) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole run: assignment, summary by area, and one row with self-containment, its mean over random areas, and the excess."""
    clean = staged(clean_units(od, pattern))
    areas = build_areas(clean, find_cores(unit_stats(clean), inflow_quantile), merge_share, join_share)
    summary = area_summary(clean, areas)
    chance = null_model(clean, areas, repetitions).agg(F.avg("self_containment").alias("by_chance"))
    total = summary.agg(ratio(F.sum("internal"), F.sum("departures")).alias("self_containment"), F.count("*").alias("areas"))
    # one row each
    both = total.withColumn("k", F.lit(1)).join(chance.withColumn("k", F.lit(1)), "k").drop("k")
    return areas, summary, both.withColumn("excess", F.col("self_containment") - F.col("by_chance"))
