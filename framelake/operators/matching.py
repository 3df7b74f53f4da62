"""Anchor choice, point matches and their errors, tiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelake.functions.dates import noon_score
from framelake.functions.geometry import project


#: Shares, in millionths, of one range of the join with the closest reference.
SHARE_RANGE = 2000


def best_tier(df: DataFrame, keys: list[str], tiers: list[Column]) -> DataFrame:
    """A group's rows that meet the first condition which any of its rows meets; all rows if none does."""
    tier = F.lit(len(tiers))
    for i, condition in reversed(list(enumerate(tiers))):
        tier = F.when(F.coalesce(condition, F.lit(False)), i).otherwise(tier)
    x = df.withColumn("_tier", tier)
    return x.withColumn("_best", F.min("_tier").over(W.partitionBy(*keys))).filter("_tier = _best").drop("_tier", "_best")


def anchor_scores(df: DataFrame, keys: list[str], order: list[str], blue: str, ts: str, target: float) -> DataFrame:
    """Adds ``score``: half closeness of the blue share to the target's, a fifth closeness to noon, the rest to the group's middle."""
    closeness = F.lit(1.0) - F.least(F.abs(F.coalesce(F.col(blue), F.lit(0.33)) - F.lit(target)) / F.lit(0.2), F.lit(1.0))
    own = W.partitionBy(*keys)
    n = F.count("*").over(own)
    at = F.try_divide((F.row_number().over(own.orderBy(*order)) - 1).cast("double"), (n - 1).cast("double"))
    middle = F.when(n > 1, F.lit(1.0) - F.lit(2.0) * F.abs(at - F.lit(0.5))).otherwise(F.lit(1.0))
    return df.withColumn("score", F.round(F.lit(0.5) * closeness + F.lit(0.2) * noon_score(F.col(ts)) + F.lit(0.3) * middle, 9))


def top_anchors(df: DataFrame, keys: list[str], order: list[str], n: int = 3) -> DataFrame:
    """The n rows of each group with the highest score, the first in order among equals: adds ``anchor_rank`` from 1."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("score").desc(), *order))
    return df.withColumn("anchor_rank", rank).filter(F.col("anchor_rank") <= n)


def closest_reference(df: DataFrame, references: DataFrame, key: str, blue: str) -> DataFrame:
    """For each row the reference with the closest blue share (a difference of 0.2 or more scores 0); the smallest key of equals.

    The closest lies next to the row among the sorted shares, so both neighbours
    decide; for shares all too far the smallest reference key is taken. Shares are
    cut into ranges that are joined each for itself; the last reference before and the
    first one after a range, from a summary of a row per range, join it.
    """
    from framelake.operators.thresholds import nearest_in_time

    # A share is a position on a line like a time: the as-of join applies, in steps of 1e-6.
    at = F.round(F.col(blue) * 1e6).cast("long")
    t = lambda d: d.withColumn("_t", at).withColumn("_g", F.floor(F.col("_t") / F.lit(SHARE_RANGE)).cast("long"))
    rows, refs = t(df).select(key, "_t", "_g"), t(references.filter(F.col(blue).isNotNull())).groupBy("_t", "_g").agg(F.min(key).alias(key))
    ends = refs.groupBy("_g").agg(F.min(F.struct("_t", key)).alias("lo"), F.max(F.struct("_t", key)).alias("hi"))
    # A row per range: shares from 0 to 1 have 500 of them.
    ranges = rows.select("_g").distinct().join(ends, "_g", "full").withColumn("_all", F.lit(0))
    own = W.partitionBy("_all").orderBy("_g")
    before = F.last("hi", ignorenulls=True).over(own.rowsBetween(W.unboundedPreceding, -1))
    after = F.last("lo", ignorenulls=True).over(W.partitionBy("_all").orderBy(F.col("_g").desc()).rowsBetween(W.unboundedPreceding, -1))
    border = ranges.select("_g", F.array(before, after).alias("ends")).select("_g", F.explode("ends").alias("r")).filter("r is not null").select("r._t", "_g", F.col(f"r.{key}").alias(key))
    stamped = lambda d: d.withColumn("_ts", F.timestamp_micros("_t"))
    near = nearest_in_time(stamped(rows), stamped(refs.unionByName(border)), ["_g"], key, key, "_ts")
    least = references.agg(F.min(key).alias("m"))
    return near.select(key, F.when(F.col("gap_us") < 200_000, F.col("nearest")).otherwise(least.scalar()).alias("reference"), F.greatest(F.lit(0.0), F.lit(1.0) - F.col("gap_us") / F.lit(2e5)).alias("score"))


def ratio_matches(df: DataFrame, candidates: DataFrame, key: str, vector: str, ratio: float = 0.7, block: int = 4096) -> DataFrame:
    """Nearest candidate of each row by Euclidean distance, if it is nearer than ``ratio`` times the second one: ``key, match, distance, second``.

    Blocks of either side meet in pairs; the two best of each are merged. A row
    isn't its own candidate; ties go to the smaller key.
    """
    from framelake.operators.thresholds import block_pairs

    kind, of = df.schema[key].dataType.simpleString(), candidates.schema[key].dataType.simpleString()

    def compare(keys, x, names, base) -> pa.Table:
        if not len(keys) or not len(names):
            return pa.table({"k": keys.slice(0, 0), "c": names.slice(0, 0), "d": pa.array([], pa.float64())})
        square = (x * x).sum(axis=1)[:, None] + (base * base).sum(axis=1)[None, :] - 2 * x @ base.T
        distance = np.round(np.sqrt(np.maximum(square, 0)), 6)
        distance[np.array(keys.to_pylist())[:, None] == np.array(names.to_pylist())[None, :]] = np.inf
        two = np.argsort(distance, axis=1, kind="stable")[:, :2]
        at = np.repeat(np.arange(len(keys)), two.shape[1])
        d = distance[at, two.ravel()]
        ok = np.isfinite(d)
        return pa.table({"k": keys.take(pa.array(at[ok])), "c": names.take(pa.array(two.ravel()[ok])), "d": pa.array(d[ok])})

    parts = block_pairs(df, candidates, key, vector, block, compare, f"k {kind}, c {of}, d double")
    two = parts.groupBy("k").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "c"))), 1, 2).alias("m"))
    out = two.filter(F.size("m") == 2).select(F.col("k").alias(key), F.col("m")[0]["c"].alias("match"), F.col("m")[0]["d"].alias("distance"), F.col("m")[1]["d"].alias("second"))
    return out.filter(F.col("distance") < ratio * F.col("second"))


def grid_thin(df: DataFrame, keys: list[str], x: str, y: str, size: float, order: list[str]) -> DataFrame:
    """The point nearest to the centre of each grid cell, the first in order among equals."""
    cx, cy = F.floor(F.col(x) / size), F.floor(F.col(y) / size)
    dx, dy = F.col(x) - (cx + 0.5) * size, F.col(y) - (cy + 0.5) * size
    t = df.withColumn("cell_x", cx).withColumn("cell_y", cy).withColumn("_d", F.round(dx * dx + dy * dy, 6))
    best = W.partitionBy(*keys, "cell_x", "cell_y").orderBy("_d", *order)
    return t.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n", "_d")


def outside_mask(points: DataFrame, mask: DataFrame, keys: list[str], x: str, y: str, width: int, height: int) -> DataFrame:
    """Points whose pixel (coordinates cut to whole numbers and clamped into the image) isn't in the mask (keys, row, col)."""
    clamp = lambda c, n: F.least(F.greatest(F.col(c).cast("int"), F.lit(0)), F.lit(n - 1))
    p = points.withColumn("_col", clamp(x, width)).withColumn("_row", clamp(y, height))
    return p.join(mask.select(*keys, F.col("row").alias("_row"), F.col("col").alias("_col")).distinct(), [*keys, "_row", "_col"], "left_anti").drop("_row", "_col")


def reprojection_rmse(df: DataFrame, keys: list[str], source: tuple[str, str], target: tuple[str, str], h: list[float], inlier: Column | None = None) -> DataFrame:
    """Root mean squared distance of projected points from their targets over inliers; infinite without any."""
    px, py = project(F.col(source[0]), F.col(source[1]), h)
    error = (px - F.col(target[0])) ** 2 + (py - F.col(target[1])) ** 2
    kept = error if inlier is None else F.when(inlier, error)
    return df.groupBy(*keys).agg(F.coalesce(F.sqrt(F.avg(kept)), F.lit(float("inf"))).alias("rmse"), F.count(kept).alias("n_inliers"))


def blend_tiles(df: DataFrame, keys: list[str], score: str, weight: str) -> DataFrame:
    """Weighted mean of overlapping tiles' scores per pixel."""
    return df.groupBy(*keys).agg((F.sum(F.col(score) * F.col(weight)) / F.greatest(F.sum(weight), F.lit(1e-6))).alias("score"))


def middle_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row at position n // 2 of each group."""
    own = W.partitionBy(*keys)
    x = df.withColumn("_n", F.row_number().over(own.orderBy(*order))).withColumn("_c", F.count("*").over(own))
    return x.filter(F.col("_n") == F.floor(F.col("_c") / 2) + 1).drop("_n", "_c")


def pages(df: DataFrame, keys: list[str], order: list[str], size: int = 49) -> DataFrame:
    """Adds ``page`` and ``slot``, both from 0, of each group's rows in order."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("page", F.floor(n / size).cast("int")).withColumn("slot", F.pmod(n, F.lit(size)).cast("int"))


def colour_bins(df: DataFrame, value: str, low: float, high: float, bins: int = 256) -> Column:
    """Position of a value on a colour scale, 0 to bins - 1, clamped; null for null."""
    part = (F.col(value) - F.lit(low)) / F.lit(high - low if high > low else 1.0)
    return F.least(F.greatest(F.floor(part * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
