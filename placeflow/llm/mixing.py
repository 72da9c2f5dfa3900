"""Mixing sources to target weights with hash-threshold histograms; DataFrame functions only.

Every document has a fixed 48-bit hash. A source's mix is some whole copies of all its documents and one more copy of those
whose hash lies under the source's threshold. The threshold comes from nested histograms: sizes are summed by source and by the
hash's leading digit, the digit where the running sum meets the budget is found, and only that bucket is summed again by its
next digit. Nothing is sorted, and a larger budget only ever adds documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._stage import stage

#: Bits of a histogram digit and digits of the hash.
DIGIT_BITS, DIGITS = 12, 4
#: Repeating weights of the sources in code-point order.
WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: Column) -> Column:
    """Number of runs of bytes other than 0x20 and 0x09-0x0D; null counts 0."""
    one_space = F.translate(text, "\t\n\x0b\f\r", "     ")
    return F.coalesce(F.size(F.array_remove(F.split(one_space, " "), "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """source, source_size, target from (source, source_size): the total shared by weight, no target above most times its source's size.

    A source is capped if its cap per weight is at most the level that the uncapped ones end at; in order of cap per weight the
    capped sources come first, so the level is found with two running sums. Sources are few: their window is one small partition.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    every = W.partitionBy(F.lit(1))
    by_ratio = W.partitionBy(F.lit(1)).orderBy("ratio", F.col("source").asc_nulls_last())
    below = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    ranked = (
        sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
        .withColumn("ratio", most * F.col("source_size") / F.col("weight"))
        .withColumn("free", F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum(most * F.col("source_size")).over(below), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)))
        .withColumn("level", F.col("free") / F.col("left"))
        .withColumn("meets", F.col("ratio") > F.col("level"))
    )
    end = F.min(F.when(F.col("meets"), F.struct("ratio", "level"))).over(every)["level"]
    target = F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(most * F.col("source_size"), F.col("weight") * F.coalesce(end, F.lit(float("inf")))))
    return ranked.select("source", "source_size", target.cast("double").alias("target"))


def mix_to_weights(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = 3, whole_rows: bool = False) -> DataFrame:
    """doc_id, source (or with whole_rows all columns of docs), size, source_size, target, copies, taken for every row of docs.

    Null or wordless text has size 0 and is taken 0 words, with the copies its hash gives. Rows without a source form a source
    of their own. Rows that share a doc_id share a hash and so a decision. An empty table gives an empty result. Columns other
    than doc_id, text and source are not read, and with whole_rows those named like a new one are replaced. A source whose documents are all empty has target 0.
    """
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(digest, 1, DIGIT_BITS * DIGITS // 4), 16, 10).cast("long")
    size = word_count(F.col("text"))
    sized = stage(docs.select("doc_id", "source", size.alias("size"), h.alias("h")), "mix-sizes")
    goal = stage(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, float(most)), "mix-targets")
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("long")
    # state per source: words still to take beyond what lies under `prefix`, the digits of the threshold found so far
    state = goal.select("source", "source_size", "target", whole.alias("whole"), (F.col("target") - whole * F.col("source_size")).alias("need"), F.lit(0).cast("long").alias("prefix"))
    for level in range(1, DIGITS + 1):
        state = stage(_refine(sized, state, level), f"mix-level{level}")
    own = [c for c in (docs.columns if whole_rows else ("doc_id", "source")) if c not in ("size", "source_size", "target", "copies", "taken")]
    rows = docs.select(*(F.col(f"`{c}`") for c in own), size.alias("size"), h.alias("h")) if whole_rows else sized
    s, d = state.alias("s"), rows.alias("d")
    joined = d.join(s, F.expr("d.source <=> s.source"))
    copies = F.least(F.col("s.whole") + F.when(F.col("d.h") < F.col("s.prefix"), 1).otherwise(0), F.lit(most))
    return joined.select(*(F.col(f"d.`{c}`") for c in own), "d.size", "s.source_size", "s.target", copies.alias("copies"), (copies * F.col("d.size")).alias("taken"))


def _refine(sized: DataFrame, state: DataFrame, level: int) -> DataFrame:
    """One more digit of each source's threshold: sums the boundary bucket by its next digit and steps over the digits that fit."""
    shift = DIGIT_BITS * (DIGITS - level)
    base = 1 << DIGIT_BITS
    inside = F.expr(f"d.source <=> s.source AND shiftright(d.h, {shift + DIGIT_BITS}) = s.prefix") if level > 1 else F.expr("d.source <=> s.source")
    digit = F.shiftright(F.col("d.h"), shift) % base
    sums = sized.alias("d").join(state.select("source", "prefix").alias("s"), inside).groupBy(F.col("d.source").alias("source"), digit.alias("digit")).agg(F.sum("d.size").alias("words"))
    upto = W.partitionBy("source").orderBy("digit")
    ran = sums.withColumn("upto", F.sum("words").over(upto)).alias("r")
    fits = F.col("r.upto") <= F.col("s.need")
    stepped = state.alias("s").join(ran, F.expr("r.source <=> s.source"), "left").groupBy(*(F.col(f"s.{c}") for c in ("source", "source_size", "target", "whole", "need", "prefix"))).agg(
        F.coalesce(F.max(F.when(fits, F.col("r.upto"))), F.lit(0)).alias("took"),
        F.min(F.when(~fits, F.col("r.digit"))).alias("boundary"),
        F.min(F.when(~fits, F.struct("r.digit", "r.words")))["words"].alias("last"),
    )
    # without a bucket that overshoots, the threshold is the end of this range
    digit = F.coalesce(F.col("boundary"), F.lit(base))
    if level == DIGITS:  # what shares all digits goes together, if that comes nearer
        need = F.col("need") - F.col("took")
        digit = F.when(F.col("boundary").isNotNull() & (need > 0) & (F.abs(need - F.col("last")) < need), digit + 1).otherwise(digit)
    return stepped.select("source", "source_size", "target", "whole", (F.col("need") - F.col("took")).alias("need"), (F.col("prefix") * base + digit).alias("prefix"))
