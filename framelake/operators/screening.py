"""Quality checks of frames: thresholds with reasons, and a percentile filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flag(df: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """Adds is_usable and reason_codes (comma-joined, in order). A check on a null doesn't fire."""
    fired = [(code, F.coalesce(condition, F.lit(False))) for code, condition in checks]
    reasons = F.concat_ws(",", *(F.when(condition, code) for code, condition in fired)) if fired else F.lit("")
    return df.withColumn("reason_codes", reasons).withColumn("is_usable", F.col("reason_codes") == "")


def below_percentile(df: DataFrame, column: str, percent: float) -> Column:
    """Whether a value lies below the table's exact percentile; the one-row percentile is a scalar subquery."""
    bound = df.agg(F.percentile(F.col(column), F.lit(percent / 100)).alias("bound"))
    return F.col(column) < bound.scalar()


def pre_qc(
    df: DataFrame, luma_min: float = 20, luma_max: float = 240, fog_max: float = 0.01, sun_max: float = 0.01,
    reflection_max: float = 0.01, mountain_percentile: float | None = None, aoi_cloud_max: float = 0.2,
) -> DataFrame:
    """Flags frames by brightness and area shares; columns that the table lacks aren't checked."""
    has = set(df.columns)
    checks = []
    if "mean_luma" in has:
        checks += [("TOO_DARK", F.col("mean_luma") < luma_min), ("TOO_BRIGHT", F.col("mean_luma") > luma_max)]
    for name, most in (("fog", fog_max), ("sun", sun_max), ("reflection", reflection_max)):
        if f"{name}_ratio" in has:
            checks.append((f"HIGH_{name.upper()}", F.col(f"{name}_ratio") > most))
    if "aoi_cloud_ratio" in has:
        checks.append(("AOI_OBSCURED", F.col("aoi_cloud_ratio") > aoi_cloud_max))
    if mountain_percentile is not None and "mountain_ratio" in has:
        checks.append(("LOW_MOUNTAIN", below_percentile(df, "mountain_ratio", mountain_percentile)))
    return flag(df, checks)
