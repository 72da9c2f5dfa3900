"""Origin-destination flows: clean pairs, totals of units, self-containment from the residence and the workplace side, cores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions.ratios import at_least_zero, code, number, ratio
from .cut import rounds
from .quantiles import exact_quantiles


def prepare_od(rows: DataFrame, origin: str, dest: str, flow: str) -> DataFrame:
    """origin, dest, flow: trimmed codes, positive numeric flows summed per pair. Rows without a code or a number don't count."""
    raw = rows.select(F.col(origin).alias("origin"), F.col(dest).alias("dest"), number(F.col(flow)).alias("flow"))
    # whole numbers are summed as such and spelt out once a pair, not once a row
    whole = all(isinstance(raw.schema[c].dataType, IntegralType) for c in ("origin", "dest"))
    clean = raw if whole else raw.select(code(F.col("origin")).alias("origin"), code(F.col("dest")).alias("dest"), "flow")
    sums = clean.where("origin IS NOT NULL AND dest IS NOT NULL AND flow > 0").groupBy("origin", "dest").agg(F.sum("flow").alias("flow"))
    return sums.select(code(F.col("origin")).alias("origin"), code(F.col("dest")).alias("dest"), "flow") if whole else sums


def unit_stats(od: DataFrame) -> DataFrame:
    """Totals of every unit that is an origin or a destination, in one aggregation: each flow counts once at either end."""
    same = F.col("origin") == F.col("dest")
    ends = F.array(
        F.struct(F.col("origin").alias("unit"), F.col("flow").alias("away"), F.lit(0.0).alias("here")),
        F.struct(F.col("dest").alias("unit"), F.lit(0.0).alias("away"), F.col("flow").alias("here")),
    )
    rows = od.select(same.alias("same"), F.explode(ends).alias("e")).select("same", "e.*")
    sums = rows.groupBy("unit").agg(
        F.sum(F.when(F.col("same"), F.col("away")).otherwise(0.0)).alias("internal"),
        F.sum("away").alias("out_total"),
        F.sum("here").alias("in_total"),
    )
    external = sums.withColumns({"out_external": F.col("out_total") - F.col("internal"), "in_external": F.col("in_total") - F.col("internal")})
    return external.withColumns({
        "self_containment": ratio(F.col("internal"), F.col("out_total")),
        "net_attraction": F.col("in_external") - F.col("out_external"),
        "job_ratio": ratio(F.col("in_total"), F.col("out_total")),
    })


def find_cores(stats: DataFrame, inflow_quantile: float = 0.85, min_job_ratio: float = 1.0) -> DataFrame:
    """Units whose inflow from elsewhere reaches the exact quantile and that have as many jobs as working residents."""
    with rounds(stats.sparkSession) as cut:
        stats = cut(stats)
        limit = exact_quantiles(stats, "in_external", {"limit": inflow_quantile})
        # what is read by several joins later is written once
        return cut(stats.crossJoin(F.broadcast(limit)).where((F.col("in_external") >= F.col("limit")) & (F.col("job_ratio") >= min_job_ratio)).drop("limit"))


def self_containment(trips: DataFrame, drop_codes: list[str] | None = None) -> DataFrame:
    """Per area and motive: trips of residents, those that stay, arrivals, and the shares RBSC, LEAK, DBSC, nonresident_share.

    Trips to drop_codes don't count; a null destination stays, as a trip that leaves. Rows without motive belong to no group.
    Both sides come from one pass over the trips.
    """
    missing = {"motive", "trip_count", "o_fa_code", "d_fa_code"} - set(trips.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    kept = trips.where("motive IS NOT NULL")
    if drop_codes:
        kept = kept.where(F.col("d_fa_code").isNull() | ~F.col("d_fa_code").isin(drop_codes))
    stays = F.coalesce(F.col("o_fa_code") == F.col("d_fa_code"), F.lit(False))
    n, none = F.col("trip_count").cast("double"), F.lit(0.0)

    def end(area: str, *values: Column) -> Column:
        return F.struct(F.col(area).alias("fa_code"), *(v.alias(c) for v, c in zip(values, ("departures_res", "internal_trips", "arrivals_total", "arrivals_internal"), strict=True)))

    inner = F.when(stays, n).otherwise(0.0)
    rows = kept.select("motive", F.explode(F.array(end("o_fa_code", n, inner, none, none), end("d_fa_code", none, none, n, inner))).alias("e")).select("motive", "e.*")
    sums = rows.where("fa_code IS NOT NULL").groupBy("fa_code", "motive").agg(*(F.sum(c).alias(c) for c in ("departures_res", "internal_trips", "arrivals_total", "arrivals_internal")))
    rbsc = ratio(F.col("internal_trips"), F.col("departures_res"))
    external = at_least_zero(F.col("arrivals_total") - F.col("arrivals_internal"))
    return sums.withColumns({"RBSC": rbsc, "LEAK": 1.0 - rbsc, "DBSC": ratio(F.col("arrivals_internal"), F.col("arrivals_total")), "arrivals_external": external, "nonresident_share": ratio(external, F.col("arrivals_total"))})


def with_metadata(areas: DataFrame, meta: DataFrame) -> DataFrame:
    """areas and the columns of meta (fa_code and what is known of an area); areas that meta lacks stay, with nulls."""
    return areas.join(meta, "fa_code", "left")


def benchmark_shares(areas: DataFrame, thresholds: tuple[float, ...] = (0.66, 0.75), by: tuple[str, ...] = ("motive",)) -> DataFrame:
    """n_areas with an RBSC, and the share of all areas that reach each threshold; areas without RBSC count as failing."""
    passed = [F.avg(F.when(F.col("RBSC") >= t, 1.0).otherwise(0.0)).alias(f"share_ge_{t}") for t in thresholds]
    return areas.groupBy(*(c for c in by if c in areas.columns)).agg(F.count("RBSC").alias("n_areas"), *passed)


def overall_self_containment(stats: DataFrame) -> DataFrame:
    return stats.agg((F.sum("internal") / F.sum("out_total")).alias("self_containment"), F.count("*").alias("units"))
