"""Functional diversity of cells from categorised points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

METRICS = ("poi_count", "cat_richness", "cat_shannon", "cat_evenness", "cat_gini_simpson", "cat_hill_q1", "cat_hill_q2", "top_cat_share", "dominant_category")


def category_counts(points: DataFrame, *keys: str) -> DataFrame:
    """keys, cell, category, n: points of each category in each cell; points without a cell or category don't count."""
    sound = points.where(F.col("cell").isNotNull() & F.col("category").isNotNull())
    return sound.groupBy(*keys, "cell", "category").agg(F.count("*").cast("double").alias("n"))


def cell_metrics(counts: DataFrame, *keys: str, min_support: float = 10, below: str = "drop") -> DataFrame:
    """Diversity of each cell of (keys, cell, category, n): richness, Shannon, Pielou evenness, Gini-Simpson, Hill numbers of order 1
    and 2, share and name of the largest category (ties: the smallest name), and the sample coverage of Chao.

    Cells with fewer points than min_support are dropped, or with below='null' kept with null metrics and below_threshold. The
    window and the aggregate share one exchange, so a cell moves once after the counts are made.
    """
    within = W.partitionBy(*keys, "cell")
    p = F.col("n") / F.sum("n").over(within)
    shares = counts.where(F.col("n") > 0).withColumn("p", p)
    h = -F.sum(F.col("p") * F.log("p"))
    n, f1, f2 = F.sum("n"), F.sum(F.when(F.col("n") == 1, 1.0).otherwise(0.0)), F.sum(F.when(F.col("n") == 2, 1.0).otherwise(0.0))
    coverage = F.when(n <= 1, None).when(f1 == 0, 1.0).otherwise(1 - f1 / n * ((n - 1) * f1 / F.nullif((n - 1) * f1 + 2 * f2, F.lit(0.0))))
    out = shares.groupBy(*keys, "cell").agg(
        n.alias("poi_count"),
        F.count("*").alias("cat_richness"),
        h.alias("cat_shannon"),
        (h / F.nullif(F.log(F.count("*").cast("double")), F.lit(0.0))).alias("cat_evenness"),
        (1 - F.sum(F.col("p") * F.col("p"))).alias("cat_gini_simpson"),
        F.exp(h).alias("cat_hill_q1"),
        (1 / F.sum(F.col("p") * F.col("p"))).alias("cat_hill_q2"),
        F.max("p").alias("top_cat_share"),
        F.min(F.struct(-F.col("n"), "category"))["category"].alias("dominant_category"),
        coverage.alias("sample_coverage"),
    )
    if below == "drop":
        return out.where(F.col("poi_count") >= min_support)
    small = F.col("poi_count") < min_support
    kept = (*keys, "cell", "poi_count")
    return out.select(*kept, *(F.when(~small, F.col(c)).alias(c) for c in out.columns if c not in kept), small.alias("below_threshold"))


def cell_diversity(points: DataFrame, *keys: str, min_support: float = 10, below: str = "drop") -> DataFrame:
    return cell_metrics(category_counts(points, *keys), *keys, min_support=min_support, below=below)


def wide_to_counts(wide: DataFrame, cell: str, prefix: str = "cat_") -> DataFrame:
    """cell, category, n from one column of counts per category; zero counts stay, so cells without any point are seen."""
    columns = [c for c in wide.columns if c.startswith(prefix)]
    if not columns:
        raise ValueError(f"no columns begin with {prefix!r}")
    doubles = wide.select(F.col(cell).alias("cell"), *(F.col(c).cast("double").alias(c) for c in columns))
    return doubles.unpivot("cell", columns, "category", "n")


def compute_all(wide: DataFrame, cell: str, prefix: str = "cat_", min_count: float = 10) -> DataFrame:
    """All metrics of a cell-by-category table, null below min_count points; cells without points have poi_count 0."""
    counts = wide_to_counts(wide, cell, prefix)
    metrics = cell_metrics(counts, min_support=min_count, below="null")
    return counts.select("cell").distinct().join(metrics, "cell", "left").na.fill({"poi_count": 0.0, "below_threshold": True})


def summary(cells: DataFrame, *keys: str) -> DataFrame:
    """Number of cells, medians and the most frequent dominant category (ties: the smallest)."""
    return cells.groupBy(*keys).agg(
        F.count("*").alias("cells"),
        F.median("poi_count").alias("median_poi"),
        F.median("cat_hill_q1").alias("median_hill_q1"),
        F.median("cat_hill_q2").alias("median_hill_q2"),
        F.expr("mode() WITHIN GROUP (ORDER BY dominant_category)").alias("mode_dominant"),
    )


def mono_functional(cells: DataFrame, share: float = 0.5) -> DataFrame:
    """Cells in which one category has at least the given share."""
    return cells.where(F.col("top_cat_share") >= share)


def taxonomy_level(hierarchy: Column, level: int) -> Column:
    """The category at a level, or the deepest one there is; null for no hierarchy."""
    return F.when(F.size(hierarchy) > 0, F.try_element_at(hierarchy, F.least(F.lit(level), F.size(hierarchy))))
