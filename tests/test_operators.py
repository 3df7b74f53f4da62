"""Operators on small hand-made rows."""

from datetime import date, datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from framelake.functions import curves, dates
from framelake.operators import masks, matching, profiles, screening, series, thresholds
from pyspark.sql import functions as F


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_pre_qc_bounds_nulls_and_absent_columns(spark):
    df = spark.createDataFrame([(1, 20.0, 0.01), (2, 19.9, 0.02), (3, None, None), (4, 240.1, 0.0)], "id int, mean_luma double, fog_ratio double")
    got = rows(screening.pre_qc(df).select("id", "is_usable", "reason_codes"))
    assert got == [(1, True, ""), (2, False, "TOO_DARK,HIGH_FOG"), (3, True, ""), (4, False, "TOO_BRIGHT")]


def test_mountain_percentile(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(11)] + [(99, None)], "id int, mountain_ratio double")
    got = screening.pre_qc(df, mountain_percentile=30).filter("NOT is_usable").select("id").collect()
    assert sorted(r[0] for r in got) == [0, 1, 2]


def test_profile_of_counts_equals_profile_of_values(spark):
    values = [3, 3, 3, 8, 250, 255, 17]
    df = spark.createDataFrame([(1, v) for v in values], "k int, v int")
    counts = df.groupBy("k", "v").agg(F.count("*").alias("n"))
    a, b = profiles.luma_profile(df, ["k"], "v").first(), profiles.profile_from_histogram(counts, ["k"], "v", "n").first()
    assert a["p05_luma"] == pytest.approx(np.percentile(values, 5)) == b["p05_luma"] and b["std_luma"] == pytest.approx(np.std(values)) == a["std_luma"]


def test_histogram_fills_zeros(spark):
    h = profiles.histogram(spark.createDataFrame([("a", 0), ("a", 255), ("a", 255)], "k string, v int"), ["k"], F.col("v")).collect()
    assert len(h) == 256 and {r["bin"]: r["n"] for r in h if r["n"]} == {0: 1, 255: 2}


def test_f1_threshold_of_useless_levels_is_the_lowest(spark):
    df = spark.createDataFrame([(1, 10, True), (1, 20, False)], "k int, v int, p boolean")
    assert rows(thresholds.best_f1_threshold(df, ["k"], F.col("v"), F.col("p"))) == [(1, 127, 0.0, 0.0, 0.0)]


def test_best_correlated_blocks_and_ties(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [2.0, 4.0, 6.0]), (3, [3.0, 2.0, 1.0]), (4, [10.0, 20.0, 30.0])], "k int, v array<double>")
    want = {1: 2, 2: 1, 4: 1}
    for block in (100, 1):
        got = {r["k"]: r["source"] for r in thresholds.best_correlated(df, df, "k", "v", block).collect()}
        assert {k: got[k] for k in want} == want


def test_nearest_in_time(spark):
    t = datetime(2024, 1, 1)
    left = spark.createDataFrame([(1, 0, t), (2, 0, t + timedelta(seconds=6)), (3, 9, t)], "k int, g int, ts timestamp_ntz")
    right = spark.createDataFrame([(7, 0, t - timedelta(seconds=4)), (8, 0, t + timedelta(seconds=4)), (6, 0, t + timedelta(seconds=4))], "k int, g int, ts timestamp_ntz")
    assert rows(thresholds.nearest_in_time(left, right, ["g"], "k", "k").select("k", "nearest").fillna(-1)) == [(1, 7), (2, 6), (3, -1)]


def test_priority_and_sets(spark):
    m = spark.createDataFrame([(1, "b"), (1, "a"), (2, "b"), (3, "zzz")], "px int, prompt string")
    assert rows(masks.resolve_priority(m, ["px"], ["a", "b"])) == [(1, "a"), (2, "b")]


def test_moving_average_mirrors(spark):
    v = [1.0, 5.0, 2.0, 8.0, 3.0]
    df = spark.createDataFrame(list(enumerate(v)), "t int, v double").withColumn("k", F.lit(0))
    for size in (3, 4, 7, 15):
        pad = np.pad(v, (size // 2, size - 1 - size // 2), mode="symmetric")
        want = [pad[i : i + size].mean() for i in range(5)]
        got = [r["smooth"] for r in series.moving_average(df, ["k"], "t", "v", size).orderBy("t").collect()]
        assert got == pytest.approx(want)


def test_shift_segments_inherit_and_begin(spark):
    df = spark.createDataFrame([(1, 0.0, True), (2, 3.0, True), (3, 99.0, False), (4, 20.0, True), (5, 21.0, True)], "t int, v double, ok boolean")
    got = series.shift_segments(df, [], ["t"], F.col("ok"), lambda a, b: F.abs(a["v"] - b["v"]), 5)
    assert rows(got.select("t", "segment_id")) == [(1, 0), (2, 0), (3, 0), (4, 1), (5, 1)]
    assert [r["prev_displacement"] for r in got.orderBy("t").collect()] == [0.0, 3.0, None, 17.0, 1.0]


def test_falling_trend():
    y = np.array([3.0, 4.0, 2.0, 2.5, 0.0])
    iso = series.falling(y)
    assert iso.tolist() == [3.5, 3.5, 2.25, 2.25, 0.0] and iso.mean() == y.mean()


def test_changepoint_of_a_clear_melt(spark):
    days = [(1, date(2024, 3, 1) + timedelta(days=i), 2.0, 2.0 if i < 12 else 0.0) for i in range(30)]
    days += [(2, date(2024, 3, 1) + timedelta(days=i), 1.0, 0.0) for i in range(5)] + [(3, date(2024, 3, 1), 1.0, 1.0)]
    p = series.bernoulli_changepoint(spark.createDataFrame(days, "k int, day date, w double, wy double"), ["k"])
    got = {r["k"]: r for r in series.melt_doy(p, F.dayofyear("change_day")).collect()}
    assert got[1]["doy"] == 73 and got[1]["status"] == "melt" and got[1]["confidence"] > 0.99
    assert got[2]["status"] == "no_snow" and got[3]["p_high"] == 0.5 and got[3]["confidence"] == 0


def test_double_sigmoid_fit_recovers_dates():
    t = np.arange(60, 330, 4.0)
    true = [0.3, 0.15, 0.12, 140, 0.14, 0.08, 260]
    got = curves.fit_double_sigmoid(t, curves.sigmoid_values(t, np.array(true)) + np.random.default_rng(1).normal(0, 0.002, len(t)))
    assert got["fit_status"] == "success" and abs(got["gup_doy"] - 140) < 1 and abs(got["gdown_doy"] - 260) < 1.5
    assert curves.fit_double_sigmoid(t[:5], t[:5])["fit_status"] == "failed" == curves.fit_double_sigmoid(t, 0 * t)["fit_status"]


def test_threshold_phenology_low_variation(spark):
    df = spark.createDataFrame([(1, i, 0.5) for i in range(9)], "k int, doy int, v double")
    r = series.threshold_phenology(df, ["k"], "doy", "v").first()
    assert r["fit_status"] == "low_variation" and r["gup_doy"] is None


def test_names_to_times(spark):
    cases = {
        "MRD_N_NikL_RGB_20240501_0800.jpg": datetime(2024, 5, 1, 8), "mrd_085_eos_vis_20200713_0905_R.JPG": datetime(2020, 7, 13, 9, 5), "cam_2020-04-20_18-05-00.jpg": datetime(2020, 4, 20, 18, 5),
        "cam_2020-04-20_18-05.jpg": datetime(2020, 4, 20, 18, 5), "cam_20200420.jpg": datetime(2020, 4, 20), "cam_20201399_1805.jpg": None, "cam.jpg": None, "": None, None: None, "/a/b/20200420_1805.jpg": datetime(2020, 4, 20, 18, 5),
    }
    df = spark.createDataFrame([(k,) for k in cases], "n string").withColumn("t", dates.name_timestamp(F.col("n")))
    assert {r["n"]: r["t"] for r in df.collect()} == cases == {k: dates.parse_filename(k) for k in cases}
    assert dates.parse_filename("x_7.4.2021.jpg", r"(?P<day>\d+)\.(?P<month>\d+)\.(?P<year>\d+)") == datetime(2021, 4, 7)
    assert dates.parse_filename("x20210407-1530", r"(?P<date>\d{8})-(?P<time>\d{4})") == datetime(2021, 4, 7, 15, 30) and dates.parse_filename("x", "(") is None


def test_grid_thin_and_mask_filter(spark):
    p = spark.createDataFrame([(1, 50.0, 50.0), (2, 40.0, 50.0), (3, 140.0, 20.0)], "id int, x double, y double")
    assert rows(matching.grid_thin(p, [], "x", "y", 100, ["id"]).select("id")) == [(1,), (3,)]
    mask = spark.createDataFrame([(50, 40)], "row int, col int")
    assert rows(matching.outside_mask(p, mask, [], "x", "y", 100, 100).select("id")) == [(1,), (3,)]


def test_top_anchors_prefer_the_best_tier(spark):
    t = datetime(2024, 1, 1, 12)
    df = spark.createDataFrame([(1, i, t, 0.4, i == 3, True) for i in range(5)] + [(2, 9, t, None, False, False)], "s int, id int, ts timestamp_ntz, blue double, ok boolean, usable boolean")
    best = matching.best_tier(df, ["s"], [F.col("ok"), F.col("usable")])
    assert rows(best.select("s", "id")) == [(1, 3), (2, 9)]
    assert matching.top_anchors(matching.anchor_scores(best, ["s"], ["id"], "blue", "ts", 0.4), ["s"], ["id"]).filter("s = 1").first()["score"] == 1.0


def test_streaming_daily_means(spark, tmp_path):
    from framelake.streaming.daily import daily_stream

    day = datetime(2024, 1, 1)
    spark.createDataFrame([(day + timedelta(hours=h), "a", float(h % 24)) for h in range(96)], "ts timestamp_ntz, k string, v double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp_ntz, k string, v double").parquet(str(tmp_path / "in"))
    q = daily_stream(stream, "ts", ["k"], "v").writeStream.format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = spark.table("days").orderBy("day").collect()
    assert len(got) >= 2 and got[0]["mean"] == 11.5 and got[0]["n"] == 24


def test_best_correlated_holds_few_scores(spark):
    """Two blocks of 1,500 vectors have 18 MB of scores; a worker holds a part of them."""
    import tracemalloc

    held = {}
    real = thresholds.block_pairs

    def watched(targets, sources, key, vector, block, compare, schema):
        rng = np.random.default_rng(3)
        x = rng.normal(size=(1500, 8))
        keys = pa.array(np.arange(1500))
        tracemalloc.start()
        got = compare(keys, x, keys, x.copy())
        held["peak"] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        score = np.corrcoef(x)
        np.fill_diagonal(score, -2)
        assert got.column("source").to_pylist() == score.argmax(axis=1).tolist()
        return real(targets, sources, key, vector, block, compare, schema)

    df = spark.createDataFrame([(1, [1.0, 2.0, 4.0]), (1, [1.0, 2.0, 4.0]), (2, [1.0, 2.0, 3.0]), (3, [3.0, 1.0, 2.0])], "k int, v array<double>")
    old, thresholds.SCORES = getattr(thresholds, "SCORES", None), 1 << 16
    thresholds.block_pairs = watched
    try:
        got = {r["k"]: r["source"] for r in thresholds.best_correlated(df, df, "k", "v").collect()}
    finally:
        thresholds.block_pairs, thresholds.SCORES = real, old
    # Rows that repeat a key are not each other's sources.
    assert got == {1: 2, 2: 1, 3: 1} and held["peak"] < 6 << 20
