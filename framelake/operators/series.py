"""Observation series: moving averages, shift segments, isotonic trends, weights, change points, seasons.

Each function works on many series at once, told apart by key columns; a window's
partition is one series.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Weight of a frame by where its threshold is from.
SOURCE_WEIGHTS = {"learned": 1.0, "histogram": 0.5, "nearest": 0.3, "fallback": 0.1}


def mirrored(df: DataFrame, keys: list[str], order: str, value: str, before: int, after: int) -> DataFrame:
    """The series with ``before`` and ``after`` rows mirrored at its ends (d c b a | a b c d | d c b a): adds ``i`` (0 to n - 1 for real rows) and ``n``."""
    own = W.partitionBy(*keys)
    x = df.withColumn("i", F.row_number().over(own.orderBy(order)) - 1).withColumn("n", F.count("*").over(own).cast("int"))
    # A series shorter than the pad is mirrored again and again, with period 2 n.
    turns = F.sequence(-F.ceil((F.lit(before) + F.col("n")) / (2 * F.col("n"))), F.ceil((F.lit(after) + F.col("n")) / (2 * F.col("n"))))
    x = x.withColumn("turn", F.explode(turns)).withColumn("j", F.explode(F.array(F.col("i") + 2 * F.col("n") * F.col("turn"), -1 - F.col("i") + 2 * F.col("n") * F.col("turn"))))
    x = x.filter((F.col("j") >= -before) & (F.col("j") < F.col("n") + after))
    return x.withColumn("i", F.col("j").cast("int")).drop("turn", "j")


def moving_average(df: DataFrame, keys: list[str], order: str, value: str, size: int = 7, name: str = "smooth") -> DataFrame:
    """Centred mean over ``size`` observations (not days), mirrored at the ends; nulls are left out of a mean."""
    before = size // 2
    padded = mirrored(df, keys, order, value, before, size - 1 - before)
    frame = W.partitionBy(*keys).orderBy("i").rowsBetween(-before, size - 1 - before)
    return padded.withColumn(name, F.avg(value).over(frame)).filter("i >= 0 and i < n").drop("i", "n")


def moving_median(df: DataFrame, keys: list[str], order: str, value: str, size: int = 21, name: str = "smooth") -> DataFrame:
    """The same with the exact median."""
    before = size // 2
    padded = mirrored(df, keys, order, value, before, size - 1 - before)
    frame = W.partitionBy(*keys).orderBy("i").rowsBetween(-before, size - 1 - before)
    return padded.withColumn(name, F.percentile(value, F.lit(0.5)).over(frame)).filter("i >= 0 and i < n").drop("i", "n")


def shift_segments(df: DataFrame, keys: list[str], order: list[str], matched: Column, displacement, threshold: float) -> DataFrame:
    """Numbers a series' segments from 0: a new one begins where a matched row lies beyond the threshold from the matched row before.

    ``displacement`` maps the struct of the row before and of this one to a
    distance. Adds ``prev_displacement`` (0 for the first matched row, null for
    unmatched ones) and ``segment_id``; unmatched rows stay in the running segment.
    """
    own = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    ordered = own.orderBy(*order)
    here = F.struct(*[c for c in df.columns])
    x = df.withColumn("_ok", F.coalesce(matched, F.lit(False)))
    x = x.withColumn("_here", F.when(F.col("_ok"), here))
    x = x.withColumn("_before", F.last("_here", ignorenulls=True).over(ordered.rowsBetween(W.unboundedPreceding, -1)))
    gap = F.when(F.col("_ok"), F.when(F.col("_before").isNull(), F.lit(0.0)).otherwise(displacement(F.col("_before"), F.col("_here"))))
    x = x.withColumn("prev_displacement", gap)
    new = F.when(F.coalesce(F.col("prev_displacement") > threshold, F.lit(False)), 1).otherwise(0)
    return x.withColumn("segment_id", F.sum(new).over(ordered.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("_ok", "_here", "_before")


def segment_medians(df: DataFrame, keys: list[str], confirmed: Column, values: list[str]) -> DataFrame:
    """Rows, confirmed rows, and medians of the confirmed ones for each segment."""
    ok = F.coalesce(confirmed, F.lit(False))
    medians = [F.percentile(F.when(ok, F.col(v)), F.lit(0.5)).alias(f"{v}_median") for v in values]
    return df.groupBy(*keys).agg(F.count("*").alias("n_total"), F.count_if(ok).alias("n_confirmed"), *medians)


def falling(y: np.ndarray) -> np.ndarray:
    """The closest non-increasing sequence, by pooling neighbours that rise."""
    level: list[float] = []
    size: list[int] = []
    for v in y.tolist():
        level.append(v)
        size.append(1)
        while len(level) > 1 and level[-2] < level[-1]:
            v, n = level.pop(), size.pop()
            level[-1] = (level[-1] * size[-1] + v * n) / (size[-1] + n)
            size[-1] += n
    return np.repeat(level, size)


def isotonic_falling(df: DataFrame, keys: list[str], order: str, value: str, name: str = "iso") -> DataFrame:
    """Adds the non-increasing least-squares trend of each series (equal weights)."""
    names = df.columns

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by(order)
        return t.append_column(name, pa.array(falling(t.column(value).to_numpy().astype(float))))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.groupBy(*keys).applyInArrow(run, f"{fields}, {name} double").select(*names, name)


def image_weights(df: DataFrame, keys: list[str], order: str, source: str = "threshold_source", f1: str = "fit_f1", ratio: str = "snow_ratio") -> DataFrame:
    """Adds ``weight``: source weight, times F1 (0.5 at least) of learned ones, times a penalty for rising above the falling trend, over the series' mean."""
    x = isotonic_falling(df, keys, order, ratio, "_iso")
    table = F.create_map(*[F.lit(v) for kv in SOURCE_WEIGHTS.items() for v in kv])
    base = F.coalesce(F.try_element_at(table, F.col(source)), F.lit(0.1))
    fit = F.when(F.col(source) == "learned", F.greatest(F.lit(0.5), F.coalesce(F.col(f1), F.lit(0.5)))).otherwise(F.lit(1.0))
    x = x.withColumn("_w", base * fit * F.exp(F.lit(-5.0) * F.greatest(F.lit(0.0), F.col(ratio) - F.col("_iso"))))
    return x.withColumn("weight", F.col("_w") / (F.avg("_w").over(W.partitionBy(*keys)) + F.lit(1e-10))).drop("_w", "_iso")


def daily_weighted(df: DataFrame, keys: list[str], day: Column, y: Column, weight: Column) -> DataFrame:
    """``keys, day, w, wy``: sums of weights and of weighted observations."""
    return df.groupBy(*keys, day.alias("day")).agg(F.sum(weight).alias("w"), F.sum(weight * y).alias("wy"))


def bernoulli_changepoint(daily: DataFrame, keys: list[str], day: str = "day", w: str = "w", wy: str = "wy", min_side: float = 0.05) -> DataFrame:
    """Where a weighted 0/1 series changes its rate: ``keys, n_days, change_day, p_high, p_low, confidence``.

    A change before the k-th observed day (k from 1) splits the days; a side with
    less than ``min_side`` of the weight is skipped; the largest likelihood wins,
    the earliest of equals (to nine digits). With no k left: the first day, both
    rates 0.5, confidence 0. Prefix sums in one window; one shuffle by key.
    """
    own, upto = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("_d").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0.0)
    x = daily.select(*keys, F.col(day).alias("_d"), F.col(w).cast("double").alias("_w"), F.col(wy).cast("double").alias("_wy"))
    x = x.withColumn("_wb", F.coalesce(F.sum("_w").over(upto), zero)).withColumn("_yb", F.coalesce(F.sum("_wy").over(upto), zero))
    x = x.withColumn("_wt", F.sum("_w").over(own)).withColumn("_yt", F.sum("_wy").over(own)).withColumn("_k", F.row_number().over(own.orderBy("_d")) - 1)
    wa, ya = F.col("_wt") - F.col("_wb"), F.col("_yt") - F.col("_yb")
    clip = lambda p: F.least(F.greatest(p, F.lit(1e-10)), F.lit(1 - 1e-10))
    rate = lambda y, w: clip(y / (w + F.lit(1e-10)))
    ll = lambda y, w, p: y * F.log(p) + (w - y) * F.log(F.lit(1.0) - p)
    x = x.withColumn("_ph", rate(F.col("_yb"), F.col("_wb"))).withColumn("_pl", rate(ya, wa)).withColumn("_p0", rate(F.col("_yt"), F.col("_wt")))
    x = x.withColumn("_ll", ll(F.col("_yb"), F.col("_wb"), F.col("_ph")) + ll(ya, wa, F.col("_pl"))).withColumn("_ll0", ll(F.col("_yt"), F.col("_wt"), F.col("_p0")))
    ok = (F.col("_k") >= 1) & (F.col("_wb") >= min_side * F.col("_wt")) & (wa >= min_side * F.col("_wt"))
    best = F.max(F.when(ok, F.struct(F.round("_ll", 9).alias("_r"), (-F.col("_k")).alias("_k"), "_d", "_ph", "_pl", "_ll", "_ll0"))).alias("_b")
    x = x.groupBy(*keys).agg(F.count("*").alias("n_days"), F.min("_d").alias("_first"), best)
    gain = F.col("_b._ll") - F.col("_b._ll0")
    sharp = F.least(F.greatest((F.col("_b._ph") - F.col("_b._pl")) / F.lit(0.5), zero), F.lit(1.0))
    sure = F.least(F.greatest((F.lit(1.0) - F.exp(-gain / F.lit(5.0))) * sharp, zero), F.lit(1.0))
    return x.select(
        *keys, "n_days", F.coalesce("_b._d", "_first").alias("change_day"), F.coalesce("_b._ph", F.lit(0.5)).alias("p_high"),
        F.coalesce("_b._pl", F.lit(0.5)).alias("p_low"), F.coalesce(sure, zero).alias("confidence"),
    )


def melt_doy(points: DataFrame, doy: Column) -> DataFrame:
    """Adds ``doy`` (0 never snow, -1 always, else the change's day of year) and ``status``."""
    never, always = F.col("p_high") < 0.3, F.col("p_low") > 0.7
    out = points.withColumn("doy", F.when(never, 0).when(always, -1).otherwise(doy).cast("int"))
    return out.withColumn("status", F.when(never, "no_snow").when(always, "persistent").otherwise("melt"))


def threshold_phenology(
    df: DataFrame, keys: list[str], doy: str, value: str, size: int = 7, up: float = 0.5, down: float = 0.5, min_range: float = 0.02,
) -> DataFrame:
    """First and last day at or above a share of the smoothed range, and the day of the maximum.

    A range below ``min_range`` gives nulls and the status low_variation. The
    first of equal maxima counts.
    """
    x = moving_average(df, keys, doy, value, size)
    own = W.partitionBy(*keys)
    x = x.withColumn("lo", F.min("smooth").over(own)).withColumn("hi", F.max("smooth").over(own))
    at = lambda share: F.col("smooth") >= F.col("lo") + share * (F.col("hi") - F.col("lo"))
    out = x.groupBy(*keys).agg(
        F.min(F.when(at(up), F.col(doy))).alias("gup_doy"), F.max(F.when(at(down), F.col(doy))).alias("gdown_doy"),
        F.max(F.struct(F.round("smooth", 12).alias("s"), (-F.col(doy)).alias("d"))).alias("m"), F.first("lo").alias("lo"), F.first("hi").alias("hi"),
    )
    ok = F.col("hi") - F.col("lo") >= min_range
    when = lambda c: F.when(ok, c)
    return out.select(
        *keys, when(F.col("gup_doy")).alias("gup_doy"), when(F.col("gdown_doy")).alias("gdown_doy"), when(-F.col("m.d")).alias("gmax_doy"),
        when(F.col("hi")).alias("gmax_value"), F.when(ok, "threshold").otherwise("low_variation").alias("fit_status"),
    )


def sigmoid_phenology(df: DataFrame, keys: list[str], doy: str, value: str, least: int = 20, min_range: float = 0.02, p0: list[float] | None = None) -> DataFrame:
    """Fits a double sigmoid to each series; too few points, too small a range and failed fits have their own status."""
    from framelake.functions.curves import fit_double_sigmoid

    names = ("gup_doy", "gdown_doy", "gmax_doy", "gmax_value", "fit_rmse")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        x, y = (t.column(c).to_numpy(zero_copy_only=False).astype(float) for c in (doy, value))
        ok = np.isfinite(x) & np.isfinite(y)
        nan = dict.fromkeys(names, float("nan"))
        if ok.sum() < least:
            got = nan | {"fit_status": "insufficient_data"}
        elif np.ptp(y[ok]) < min_range:
            got = nan | {"fit_status": "low_variation"}
        else:
            got = fit_double_sigmoid(x[ok], y[ok], 3000, p0)
        return pa.table({k: [v] for k, v in zip(keys, key, strict=True)} | {n: [got[n]] for n in (*names, "fit_status")})

    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, doy, value).groupBy(*keys).applyInArrow(run, f"{fields}, {', '.join(f'{n} double' for n in names)}, fit_status string")


def daily_greenness(df: DataFrame, day: Column, pixel: list[str], value: Column, frame: Column) -> DataFrame:
    """``date, doy, mean_gr, n_images``: the mean over pixels of each pixel's daily maximum, and the day's frames."""
    x = df.select(day.alias("date"), *pixel, value.alias("v"), frame.alias("f"))
    mean = x.groupBy("date", *pixel).agg(F.max("v").alias("v")).groupBy("date").agg(F.avg("v").alias("mean_gr"))
    frames = x.groupBy("date").agg(F.countDistinct("f").alias("n_images"))
    return mean.join(frames, "date").select("date", F.dayofyear("date").alias("doy"), "mean_gr", "n_images")
