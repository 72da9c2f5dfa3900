"""Contiguity of areas on an adjacency graph of units: components of each area and what is cut off."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .cut import merged, rounds, side

#: Edges from which a task joins what it has of whole areas, and how many times as many before an area is broken off.
BLOCK, LONGEST = 1 << 19, 4


def symmetric(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Edges both ways, made in one pass."""
    u, v = F.col(a), F.col(b)
    ways = F.array(F.struct(u.alias("u"), v.alias("v")), F.struct(v.alias("u"), u.alias("v")))
    return edges.where(u != v).select(F.explode(ways).alias("e")).select("e.u", "e.v").distinct()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """unit, low: the smallest unit that a unit reaches over the edges (u, v, area) of a block. Edges come area by area."""

    def reached(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = pa.chunked_array([b.column(i) for i in (0, 1) for b in parts])
        units = pc.unique(ends)
        units = units.take(pc.sort_indices(units))
        u, v = np.split(pc.index_in(ends, value_set=units).to_numpy(), 2)
        label = np.arange(len(units))
        while (apart := label[u] != label[v]).any():
            u, v = u[apart], v[apart]
            to = np.arange(len(units))
            np.minimum.at(to, np.maximum(label[u], label[v]), np.minimum(label[u], label[v]))
            while (to[to] != to).any():
                to = to[to]
            label = to[label]
        return pa.RecordBatch.from_arrays([units, units.take(pa.array(label))], ["unit", "low"])

    parts: list[pa.RecordBatch] = []
    held = 0
    for b in batches:
        if not b.num_rows:
            continue
        if held + b.num_rows >= BLOCK:
            # what the batch has of areas before its last one ends a block
            last = pc.index(b.column(2), b.column(2)[-1]).as_py()
            if last or (parts and parts[-1].column(2)[-1] != b.column(2)[0]) or held >= BLOCK * LONGEST:
                if whole := [*parts, b.slice(0, last)] if last else parts:
                    yield reached(whole)
                parts, held, b = [], 0, b.slice(last)
        parts.append(b)
        held += b.num_rows
    if parts:
        yield reached(parts)


def area_components(assigned: DataFrame, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """unit, fua, component: the smallest unit reachable over edges (u, v) within the same area.

    An area's edges meet in a task, which joins them in blocks of whole areas; a large area's are dealt out to several. Where all blocks of every
    unit agree on the smallest, that is the component. Else rounds go on with an edge from each unit to the smallest of each block:
    a round takes the smallest label among neighbours and then that label's own label, so distances double with rounds.
    """
    with rounds(assigned.sparkSession) as cut:
        kind = assigned.schema["unit"].dataType
        a, b = assigned.select(F.col("unit").alias("u"), F.col("fua").alias("fu")), assigned.select(F.col("unit").alias("v"), F.col("fua").alias("fv"))
        inside = edges.join(merged(a), "u").join(merged(b), "v").where("fu = fv").select("u", "v", "fu")
        # rebalancing splits what is too much for a task
        own = inside.hint("rebalance", "fu").sortWithinPartitions("fu").mapInArrow(_joined, StructType([StructField("unit", kind), StructField("low", kind)]))
        links = cut(own)
        lows = links.groupBy("unit").agg(F.min("low").alias("low"), F.max("low").alias("high"))
        found = cut(assigned.join(merged(lows), "unit", "left").select("unit", "fua", F.coalesce("low", "unit").alias("component"), F.coalesce(F.col("low") != F.col("high"), F.lit(False)).alias("apart")))
        label = found.drop("apart")
        if found.where("apart").isEmpty():
            return label
        both = cut(symmetric(links, "unit", "low"))
        for _ in range(most_rounds):
            low = both.join(merged(label.select(F.col("unit").alias("v"), "component")), "v").groupBy("u").agg(F.min("component").alias("low"))
            near = label.join(merged(low.withColumnRenamed("u", "unit")), "unit", "left").select("unit", "fua", F.least("component", F.coalesce("low", "component")).alias("to"), "component")
            jump = near.select(F.col("unit").alias("to"), F.col("to").alias("further"))
            to = F.least("to", F.coalesce("further", "to"))
            moved = cut(near.join(merged(jump), "to", "left").select("unit", "fua", to.alias("component"), (to != F.col("component")).alias("moved")))
            label = moved.drop("moved")
            if moved.where("moved").isEmpty():
                return label
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def fragmentation(components: DataFrame) -> DataFrame:
    """fua, units, components, main (units of the largest), cut (units elsewhere)."""
    sizes = components.groupBy("fua", "component").agg(F.count("*").alias("n"))
    out = sizes.groupBy("fua").agg(F.sum("n").alias("units"), F.count("*").alias("components"), F.max("n").alias("main"))
    return out.withColumn("cut", F.col("units") - F.col("main"))


def main_components(components: DataFrame) -> DataFrame:
    """The units of each area's largest component; ties go to the smaller component."""
    order = W.partitionBy("fua").orderBy(F.desc("n"), "component")
    sizes = components.groupBy("fua", "component").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(order)).where("r = 1")
    return components.join(merged(sizes.select("fua", "component")), ["fua", "component"], "left_semi")


def cut_off(components: DataFrame) -> DataFrame:
    """unit, fua of the units outside their area's main component."""
    return components.join(merged(main_components(components).select("unit")), "unit", "left_anti").select("unit", "fua")


def adjacency(polygons: DataFrame) -> DataFrame:
    """u, v both ways: units whose polygons share a corner. polygons has unit and corners, an array of (x, y) structs.

    Corners meet by an equal-value join on their coordinates, so borders must be drawn with the same corners on both sides.
    """
    points = polygons.select("unit", F.explode("corners").alias("p")).select("unit", "p.x", "p.y").distinct()
    one, two = points.toDF("u", "x", "y"), points.toDF("v", "x", "y")
    return one.join(two, ["x", "y"]).where("u <> v").select("u", "v").distinct()


def repair(od: DataFrame, assigned: DataFrame, edges: DataFrame, cores: DataFrame | None = None, most_rounds: int = 10) -> DataFrame:
    """unit, fua after cut-off components have gone to the adjacent area that they exchange most with; islands stay.

    An area keeps the component that holds a core (the largest of them; ties: the smallest unit), or its largest. Flows count
    between adjacent units, both ways. All components move at once, ties go to the larger area id, and rounds end when nothing moves.
    edges are symmetric.
    """
    both = od.where("origin <> dest").select(F.col("origin").alias("u"), F.col("dest").alias("v"), "flow")
    both = both.union(both.select("v", "u", "flow")).groupBy("u", "v").agg(F.sum("flow").alias("flow"))
    seeds = cores.select("unit", F.lit(1).alias("core")) if cores is not None else assigned.select("unit", F.lit(0).alias("core"))
    with rounds(od.sparkSession) as cut:
        seeds = side(cut(seeds))
        links = cut(edges.select("u", "v").distinct().join(merged(both), ["u", "v"], "left").select("u", "v", F.coalesce("flow", F.lit(0.0)).alias("flow")))
        now = cut(assigned.where("fua IS NOT NULL").select("unit", "fua"))
        for _ in range(most_rounds):
            parts = area_components(now, links.select("u", "v"))
            sizes = parts.join(seeds, "unit", "left").groupBy("fua", "component").agg(F.max(F.coalesce("core", F.lit(0))).alias("core"), F.count("*").alias("n"))
            rank = F.row_number().over(W.partitionBy("fua").orderBy(F.desc("core"), F.desc("n"), "component"))
            loose = cut(parts.join(merged(sizes.withColumn("rank", rank).where("rank > 1").select("fua", "component")), ["fua", "component"], "left_semi"))
            if loose.isEmpty():
                break
            target = now.select(F.col("unit").alias("v"), F.col("fua").alias("other"))
            offers = links.join(side(loose.select(F.col("unit").alias("u"), "fua", "component")), "u").join(merged(target), "v").where("other <> fua")
            best = offers.groupBy("fua", "component", "other").agg(F.sum("flow").alias("flow")).groupBy("fua", "component").agg(F.max(F.struct("flow", "other"))["other"].alias("to"))
            moves = cut(loose.join(merged(best), ["fua", "component"]).select("unit", "to"))
            if moves.isEmpty():
                break
            now = cut(now.join(side(moves), "unit", "left").select("unit", F.coalesce("to", "fua").alias("fua")))
        return cut(now)
