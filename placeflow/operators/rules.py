"""Areas that must be large and self-contained enough: their statistics, which ones fail, and two ways to repair them.

Flows are summed by pairs of areas once; a step of a repair then works on those sums, as Spark jobs, and changes them by the flows of
the units that it moves. Only the weakest area's id and that of its target come to the driver. Steps follow one another, since each
depends on the one before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ratios import ratio, size_threshold
from .cut import rounds


@dataclass(frozen=True)
class Rule:
    """Working residents that an area has at least, those beyond which self-containment may be sc_big instead of sc_small."""

    small: float = 3500.0
    big: float = 25000.0
    sc_small: float = 0.75
    sc_big: float = 2.0 / 3.0

    def threshold(self, size: Column) -> Column:
        return size_threshold(size, self.small, self.big, self.sc_small, self.sc_big)

    def valid(self) -> Column:
        return (F.col("size") >= self.small) & (F.col("sc") >= self.threshold(F.col("size")))

    def deficit(self) -> Column:
        """How far an area fails; those that are too small fail by more than all others."""
        return F.when(F.col("size") < self.small, 1.0 + (self.small - F.col("size")) / self.small).otherwise(self.threshold(F.col("size")) - F.col("sc"))


def area_flows(od: DataFrame, assigned: DataFrame, counted: bool = False) -> DataFrame:
    """a, b, flow between areas, and with counted n, their number; flows with an end outside every area don't count."""
    placed = assigned.where("fua IS NOT NULL")
    one, two = placed.select(F.col("unit").alias("origin"), F.col("fua").alias("a")), placed.select(F.col("unit").alias("dest"), F.col("fua").alias("b"))
    return od.join(one, "origin").join(two, "dest").groupBy("a", "b").agg(F.sum("flow").alias("flow"), *[F.count("*").alias("n")] * counted)


def area_stats(flows: DataFrame) -> DataFrame:
    """area, residents, jobs, internal, sc_supply, sc_demand, sc (the weaker side; 0 for a side without flows), size, from (a, b, flow)."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("area"), F.col("flow").alias("out"), F.lit(0.0).alias("in")), F.struct(F.col("b").alias("area"), F.lit(0.0).alias("out"), F.col("flow").alias("in"))))
    rows = flows.select((F.col("a") == F.col("b")).alias("same"), ends.alias("e")).select("same", "e.*")
    sums = rows.groupBy("area").agg(F.sum("out").alias("residents"), F.sum("in").alias("jobs"), F.sum(F.when(F.col("same"), F.col("out")).otherwise(0.0)).alias("internal"))
    supply, demand = ratio(F.col("internal"), F.col("residents"), 0.0), ratio(F.col("internal"), F.col("jobs"), 0.0)
    return sums.select("*", supply.alias("sc_supply"), demand.alias("sc_demand"), F.least(supply, demand).alias("sc"), F.col("residents").alias("size"))


def _weakest(stats: DataFrame, rule: Rule) -> str | None:
    """The area that fails most; ties go to the smaller id."""
    worst = stats.where(~rule.valid()).orderBy(rule.deficit().desc(), "area").select("area").first()
    return worst["area"] if worst else None


def enforce_by_merging(od: DataFrame, assigned: DataFrame, rule: Rule = Rule(), most_steps: int = 4000) -> DataFrame:  # noqa: B008
    """unit, fua after the weakest failing area has gone, again and again, into the one that it exchanges most with (ties: the smaller id).

    An area without links is left as it is: it is no longer looked at, nor a target. Areas whose units have no flows inside the
    areas count as having none.
    """
    with rounds(od.sparkSession) as cut:
        named = cut(assigned.where("fua IS NOT NULL").select("unit", "fua"))
        empty = named.select(F.col("fua").alias("a"), F.col("fua").alias("b"), F.lit(0.0).alias("flow")).distinct()
        flows = cut(area_flows(od, named).union(empty).groupBy("a", "b").agg(F.sum("flow").alias("flow")))
        apart: list[str] = []
        moves: list[tuple[str, str]] = []
        for _ in range(most_steps):
            worst = _weakest(area_stats(flows).where(~F.col("area").isin(apart)), rule)
            if worst is None:
                break
            other = F.when(F.col("a") == worst, F.col("b")).otherwise(F.col("a"))
            links = flows.where(((F.col("a") == worst) | (F.col("b") == worst)) & (F.col("a") != F.col("b"))).select(other.alias("to"), "flow").where(~F.col("to").isin(apart))
            best = links.groupBy("to").agg(F.sum("flow").alias("flow")).where("flow > 0").orderBy(F.desc("flow"), "to").first()
            if best is None:
                apart.append(worst)
                continue
            moves.append((worst, best["to"]))
            renamed = [F.when(F.col(c) == worst, best["to"]).otherwise(F.col(c)).alias(c) for c in ("a", "b")]
            flows = cut(flows.select(*renamed, "flow").groupBy("a", "b").agg(F.sum("flow").alias("flow")))
        final: dict[str, str] = {}
        for area, to in reversed(moves):  # each area has moved once at most; later moves carry earlier ones along
            final[area] = final.get(to, to)
        return cut(_renamed(named, final))


def _renamed(named: DataFrame, to: dict[str, str]) -> DataFrame:
    if not to:
        return named
    table = named.sparkSession.createDataFrame(list(to.items()), "fua string, to string")
    return named.join(F.broadcast(table), "fua", "left").select("unit", F.coalesce("to", "fua").alias("fua"))


def enforce_by_dissolving(od: DataFrame, assigned: DataFrame, rule: Rule = Rule(), most_steps: int = 500) -> DataFrame:  # noqa: B008
    """unit, fua after the weakest failing area has been dissolved, again and again: each of its units goes to the valid area that it
    exchanges most with (ties: the larger id), units without such links stay. Ends when none fails, or nothing can move, or after most_steps.
    Sums of areas are kept and changed by the flows of units that move; whole flows (counts of people) are summed without error."""
    with rounds(od.sparkSession) as cut:
        named = cut(assigned.where("fua IS NOT NULL").select("unit", "fua"))
        # each flow at both of its ends: what a step looks up and what it moves
        ends = [od.select(F.col(a).alias("unit"), F.col(b).alias("other"), "flow", F.lit(a == "origin").alias("leaves")) for a, b in (("origin", "dest"), ("dest", "origin"))]
        linked = cut(ends[0].union(ends[1]))
        sums = cut(area_flows(od, named, counted=True))
        for _ in range(most_steps):
            stats = cut(area_stats(sums))
            worst = _weakest(stats, rule)
            if worst is None:
                break
            sound = stats.where(rule.valid()).select(F.col("area").alias("to"))
            links = linked.join(named.where(F.col("fua") == worst).select("unit"), "unit").join(named.select(F.col("unit").alias("other"), F.col("fua").alias("to")), "other").join(sound, "to", "left_semi")
            best = links.groupBy("unit", "to").agg(F.sum("flow").alias("flow")).groupBy("unit").agg(F.max(F.struct("flow", "to"))["to"].alias("to"))
            moves = cut(best)
            if moves.isEmpty():
                break
            now = cut(named.join(moves, "unit", "left").select("unit", F.col("fua").alias("old"), F.coalesce("to", "fua").alias("fua")))
            sums = cut(_moved(sums, linked.join(moves.select("unit"), "unit", "left_semi"), now, moves))
            named = now.select("unit", "fua")
        return cut(named.select("unit", "fua"))


def _moved(sums: DataFrame, linked: DataFrame, now: DataFrame, moves: DataFrame) -> DataFrame:
    """sums (a, b, flow, n) after the units of moves have gone from their old to their new area; linked holds the flows of these units."""
    one = now.select("unit", F.col("old").alias("u0"), F.col("fua").alias("u1"))
    two = now.select(F.col("unit").alias("other"), F.col("old").alias("v0"), F.col("fua").alias("v1"))
    both = linked.join(one, "unit").join(two, "other")
    # a flow between two units that move, or within one, is listed at both ends and counts at its origin
    once = both.join(moves.select(F.col("unit").alias("other"), F.lit(True).alias("twice")), "other", "left").where("leaves OR twice IS NULL")
    end = lambda k, x, y: F.when(F.col("leaves"), F.col(f"{x}{k}")).otherwise(F.col(f"{y}{k}"))
    change = [F.struct(end(k, "u", "v").alias("a"), end(k, "v", "u").alias("b"), (F.col("flow") * sign).alias("flow"), F.lit(sign).cast("long").alias("n")) for k, sign in ((0, -1), (1, 1))]
    deltas = once.select(F.explode(F.array(*change)).alias("c")).select("c.*")
    return sums.union(deltas).groupBy("a", "b").agg(F.sum("flow").alias("flow"), F.sum("n").alias("n")).where("n > 0")
