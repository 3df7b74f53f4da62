"""Brightness statistics, area shares and histograms per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def luma_profile(df: DataFrame, keys: list[str], value: str, saturated: float = 250) -> DataFrame:
    """Mean, population deviation, exact p05, p50, p95, and the share from ``saturated`` on."""
    v = F.col(value)
    p = F.percentile(v, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    out = df.groupBy(*keys).agg(F.avg(v).alias("mean_luma"), F.stddev_pop(v).alias("std_luma"), p.alias("p"), F.avg((v >= saturated).cast("double")).alias("saturated_ratio"))
    return out.select(*keys, "mean_luma", "std_luma", *(F.col("p")[i].alias(n) for i, n in enumerate(("p05_luma", "p50_luma", "p95_luma"))), "saturated_ratio")


def profile_from_histogram(df: DataFrame, keys: list[str], level: str, count: str) -> DataFrame:
    """The same statistics from (level, count) rows, so pixels needn't be exploded."""
    x, n = F.col(level), F.col(count)
    p = F.percentile(x, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)), n)
    mean = F.sum(x * n) / F.sum(n)
    out = df.groupBy(*keys).agg(mean.alias("mean_luma"), F.sqrt(F.greatest(F.sum(x * x * n) / F.sum(n) - mean * mean, F.lit(0.0))).alias("std_luma"), p.alias("p"))
    return out.select(*keys, "mean_luma", "std_luma", *(F.col("p")[i].alias(c) for i, c in enumerate(("p05_luma", "p50_luma", "p95_luma"))))


def area_ratio(df: DataFrame, keys: list[str], mask: Column) -> DataFrame:
    """Share of rows where the mask holds."""
    return df.groupBy(*keys).agg(F.avg(F.coalesce(mask, F.lit(False)).cast("double")).alias("ratio"))


def mean_or_default(df: DataFrame, keys: list[str], value: Column, least: int = 100, default: float = 0.33) -> DataFrame:
    """Mean of a value, or a constant for groups of fewer than ``least`` rows."""
    return df.groupBy(*keys).agg(F.when(F.count("*") < least, F.lit(default)).otherwise(F.avg(value)).alias("blue_ratio"))


def labels_wide(labels: DataFrame, key: str, prompts: list[str]) -> DataFrame:
    """(key, prompt, ratio) rows as a column ``<prompt>_ratio`` per prompt."""
    wide = labels.groupBy(key).pivot("prompt", prompts).agg(F.first("ratio"))
    return wide.select(key, *(F.col(p).alias(f"{p}_ratio") for p in prompts))


def histogram(df: DataFrame, keys: list[str], level: Column, bins: int = 256) -> DataFrame:
    """Counts and shares of every level 0 to bins - 1 per group, zeros included."""
    counts = df.select(*keys, level.cast("int").alias("bin")).groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    # One row per group and bin by exploding the group's own map of counts: no second shuffle.
    by_group = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"), F.sum("n").alias("total"))
    full = by_group.select(*keys, "m", "total", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    n = F.coalesce(F.try_element_at("m", F.col("bin")), F.lit(0).cast("long"))
    return full.select(*keys, "bin", n.alias("n"), (n / (F.col("total") + F.lit(1e-10))).alias("share"))
