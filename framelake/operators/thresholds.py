"""Brightness thresholds: learned from labelled pixels, borrowed from similar or near frames, applied."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Vectors of a block of either side; a task holds two.
BLOCK = 20_000
#: Scores that are held at once, 16 MB in double precision.
SCORES = 1 << 21


def best_f1_threshold(df: DataFrame, keys: list[str], level: Column, positive: Column, low: int = 127, high: int = 255) -> DataFrame:
    """The threshold in [low, high] with the best F1 for level >= threshold; the smallest of equals.

    Works on 256-bin counts: levels below ``low`` only count as totals, so a group
    is at most high - low + 2 rows in its window whatever its size.
    """
    at = F.greatest(F.least(level.cast("int"), F.lit(high)), F.lit(low - 1))
    bins = df.select(*keys, at.alias("bin"), positive.alias("p")).groupBy(*keys, "bin").agg(F.count_if("p").alias("pos"), F.count_if(~F.col("p")).alias("neg"))
    by_group = bins.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", F.struct("pos", "neg")))).alias("m"), F.sum("pos").alias("n_pos"))
    full = by_group.select(*keys, "n_pos", "m", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("bin"))
    got = F.try_element_at("m", F.col("bin"))
    zero = F.lit(0).cast("long")
    full = full.select(*keys, "n_pos", "bin", F.coalesce(got["pos"], zero).alias("pos"), F.coalesce(got["neg"], zero).alias("neg"))
    down = W.partitionBy(*keys).orderBy(F.col("bin").desc())
    swept = full.withColumn("tp", F.sum("pos").over(down)).withColumn("fp", F.sum("neg").over(down))
    precision = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(F.lit(0.0))
    recall = F.when(F.col("n_pos") > 0, F.col("tp") / F.col("n_pos")).otherwise(F.lit(0.0))
    swept = swept.withColumn("prec", precision).withColumn("rec", recall)
    f1 = F.when(F.col("prec") + F.col("rec") > 0, 2 * F.col("prec") * F.col("rec") / (F.col("prec") + F.col("rec"))).otherwise(F.lit(0.0))
    best = F.max(F.struct(F.round(f1, 9).alias("f1"), (-F.col("bin")).alias("low"), "prec", "rec")).alias("b")
    return swept.groupBy(*keys).agg(best).select(*keys, (-F.col("b.low")).alias("threshold"), F.col("b.prec").alias("fit_prec"), F.col("b.rec").alias("fit_rec"), F.col("b.f1").alias("fit_f1"))


def otsu_threshold(df: DataFrame, keys: list[str], level: str, count: str) -> DataFrame:
    """The level that separates a histogram with the largest between-class variance; the smallest of equals."""
    up, all_rows = W.partitionBy(*keys).orderBy(level), W.partitionBy(*keys)
    x = df.withColumn("w", F.sum(count).over(up)).withColumn("m", F.sum(F.col(level) * F.col(count)).over(up))
    x = x.withColumn("tw", F.sum(count).over(all_rows)).withColumn("tm", F.sum(F.col(level) * F.col(count)).over(all_rows))
    rest = F.col("tw") - F.col("w")
    gap = F.col("m") / F.col("w") - (F.col("tm") - F.col("m")) / rest
    x = x.filter((F.col("w") > 0) & (rest > 0)).withColumn("v", F.col("w") * rest * gap * gap)
    return x.groupBy(*keys).agg(F.max(F.struct(F.round("v", 6).alias("v"), (-F.col(level)).alias("l"))).alias("b")).select(*keys, (-F.col("b.l")).alias("threshold"))


def _standard(x: np.ndarray) -> np.ndarray:
    x = x - x.mean(axis=1, keepdims=True)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _matrix(v: pa.Array) -> np.ndarray:
    """Lists of one length as rows; a missing component is NaN."""
    if len(v) and v.value_lengths().unique().to_pylist() != [len(v[0])]:
        raise ValueError("vectors of different lengths")
    return v.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(v), -1) if len(v) else np.empty((0, 0))


def block_pairs(targets: DataFrame, sources: DataFrame, key: str, vector: str, block: int, compare, schema: str) -> DataFrame:
    """compare(targets' keys and vectors, sources' keys and vectors) over pairs of blocks of the two tables.

    Either side is dealt out by a hash of its key, so a task holds two blocks whatever
    the tables' sizes; nothing passes the driver but two counts. compare gives
    a table of the schema's columns.
    """
    parts = [max(1, -(-d.count() // block)) for d in (targets, sources)]
    sides = []
    for n, d in enumerate((targets, sources)):
        own = F.pmod(F.xxhash64(key), F.lit(parts[n])).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.lit(parts[1 - n] - 1)))
        named = d.filter(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"), own.alias("own"), F.lit(n).alias("side"))
        sides.append(named.select("*", other.alias("other")).select("key", "v", "side", *(F.col(c).alias(x) for c, x in zip(("own", "other")[:: 1 - 2 * n], ("a", "b"), strict=True))))

    def run(t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()
        own = [t.filter(pa.array(side == n)).sort_by([("key", "ascending")]) for n in (0, 1)]
        values = [_matrix(o.column("v").combine_chunks()) for o in own]
        return compare(own[0].column("key").combine_chunks(), values[0], own[1].column("key").combine_chunks(), values[1])

    return sides[0].unionByName(sides[1]).groupBy("a", "b").applyInArrow(run, schema)


def best_correlated(targets: DataFrame, sources: DataFrame, key: str, vector: str, block: int = BLOCK) -> DataFrame:
    """For each target its source with the largest Pearson correlation: ``key, source, score``.

    The smallest source key wins ties (to nine digits); a constant vector correlates
    as 1 with everything. Blocks of either side meet in pairs, and the best of all
    pairs is kept. A target without any other source isn't listed.
    """
    kind, of = targets.schema[key].dataType.simpleString(), sources.schema[key].dataType.simpleString()

    def compare(keys, x, names, base) -> pa.Table:
        if not len(keys) or not len(names):
            return pa.table({"key": keys.slice(0, 0), "source": names.slice(0, 0), "score": pa.array([], pa.float64())})
        # Sources are in order of their keys, so those of one key are adjacent.
        first, after = {}, {}
        for n, k in enumerate(names.to_pylist()):
            first.setdefault(k, n)
            after[k] = n + 1
        own = keys.to_pylist()
        x_flat, base_flat = (np.ptp(v, axis=1) == 0 for v in (x, base))
        x, base = _standard(x), _standard(base)
        at, best = np.empty(len(x), np.int64), np.empty(len(x))
        # All scores of two blocks are 3.2 GB; a few rows' are held at a time.
        step = max(1, SCORES // len(base))
        for lo in range(0, len(x), step):
            score = x[lo : lo + step] @ base.T
            np.round(score, 9, out=score)
            score[:, base_flat] = 1
            score[x_flat[lo : lo + step]] = 1
            for n, k in enumerate(own[lo : lo + step]):
                if k in first:
                    score[n, first[k] : after[k]] = -2
            at[lo : lo + step] = score.argmax(axis=1)
            best[lo : lo + step] = score[np.arange(len(score)), at[lo : lo + step]]
        ok = best > -2
        return pa.table({"key": keys.filter(pa.array(ok)), "source": names.take(pa.array(at[ok])), "score": pa.array(best[ok])})

    met = block_pairs(targets, sources, key, vector, block, compare, f"key {kind}, source {of}, score double")
    best = met.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("s"), "source")).alias("b"))
    return best.select(F.col("key").alias(key), F.col("b.source").alias("source"), (-F.col("b.s")).alias("score"))


def nearest_in_time(left: DataFrame, right: DataFrame, by: list[str], left_key: str, right_key: str, ts: str = "ts") -> DataFrame:
    """For each left row the right row of its group nearest in time, before or after: ``left_key, nearest, gap_us``.

    One shuffle by group: the last right row before and the first one after are
    running values over the merged rows, so no pairs are formed. Of equally near
    rows the earlier one, then the one with the smaller key, wins. A null when
    the group has no right row.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    none = F.lit(None)
    a = left.select(*by, us.alias("t"), F.col(left_key).alias("k"), none.cast("struct<t:bigint,k:bigint>").alias("r"))
    b = right.select(*by, us.alias("t"), none.cast("long").alias("k"), F.struct(us.alias("t"), F.col(right_key).cast("long").alias("k")).alias("r"))
    # Rows of the right side with one time: the smallest key stands for all.
    b = b.groupBy(*by, "t").agg(F.min("r").alias("r")).select(*by, "t", none.cast("long").alias("k"), "r")
    merged = a.select(*by, "t", F.col("k").cast("long").alias("k"), "r").unionByName(b)
    order = W.partitionBy(*by).orderBy("t")
    before = F.last("r", ignorenulls=True).over(order.rangeBetween(W.unboundedPreceding, W.currentRow))
    # The first one after is the last one so far in the other direction: a frame that grows is summed up as it goes, one that shrinks isn't.
    back_order = W.partitionBy(*by).orderBy(F.col("t").desc())
    after = F.last("r", ignorenulls=True).over(back_order.rangeBetween(W.unboundedPreceding, W.currentRow))
    found = merged.withColumn("p", before).withColumn("n", after).filter("k is not null")
    back, ahead = F.col("t") - F.col("p.t"), F.col("n.t") - F.col("t")
    use_back = F.col("p").isNotNull() & (F.col("n").isNull() | (back <= ahead))
    return found.select(F.col("k").alias(left_key), F.when(use_back, F.col("p.k")).otherwise(F.col("n.k")).alias("nearest"), F.when(use_back, back).otherwise(ahead).alias("gap_us"))


def cascade(learned: Column, histogram: Column, nearest: Column, fallback: float = 230) -> tuple[Column, Column]:
    """The first threshold that there is, and where it is from."""
    source = F.when(learned.isNotNull(), "learned").when(histogram.isNotNull(), "histogram").when(nearest.isNotNull(), "nearest").otherwise("fallback")
    return F.coalesce(learned, histogram, nearest, F.lit(fallback)), source


def classify_stats(df: DataFrame, keys: list[str], level: Column, threshold: Column, valid: Column, seen: Column) -> DataFrame:
    """Counts of valid pixels, of those at or above the threshold, and of those a mask calls snow; and the share."""
    ok = F.coalesce(valid, F.lit(False))
    snow = ok & F.coalesce(level >= threshold, F.lit(False))
    out = df.groupBy(*keys).agg(F.count_if(ok).alias("n_valid"), F.count_if(snow).alias("n_snow"), F.count_if(ok & F.coalesce(seen, F.lit(False))).alias("n_sam_snow"))
    return out.withColumn("snow_ratio", F.when(F.col("n_valid") > 0, F.col("n_snow") / F.col("n_valid")).otherwise(F.lit(0.0)))
