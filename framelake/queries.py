"""The engine's queries over the test tables, and the DuckDB SQL of each.

``events`` stands for observation series (a user is a pixel, a value its brightness),
``lineitem`` for colour triples and points, ``embeddings`` for histograms and
descriptors, ``documents`` with ``labels`` for scored pixels with a known class.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import curves, dates, geometry, pixels
from framelake.operators import masks, matching, profiles, screening, series, thresholds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TYPES = ["click", "error", "purchase", "signup", "view"]


def query(sql: str | None = None, dates: tuple[str, ...] = ()):
    """Registers a query with its SQL; both give dates and times as ISO text, so that no client's date type matters."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir).withColumns({c: F.col(c).cast("string") for c in dates})

        QUERIES[f.__name__] = run if dates else f
        if sql:
            ORACLE_SQL[f.__name__] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in dates)}) FROM ({sql})" if dates else sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rounded(df: DataFrame, **places: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


def day() -> Column:
    return F.to_date("ts")


# --- screening and profiles


@query("""
WITH e AS (SELECT event_id, value AS luma, (user_id % 13) / CAST(1000 AS DOUBLE) AS fog,
                  CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id % 101) / CAST(8000 AS DOUBLE) END AS sun,
                  (event_id % 7) / CAST(500 AS DOUBLE) AS refl FROM events),
r AS (SELECT event_id, concat_ws(',', CASE WHEN luma < 20 THEN 'TOO_DARK' END, CASE WHEN luma > 240 THEN 'TOO_BRIGHT' END,
             CASE WHEN fog > 0.01 THEN 'HIGH_FOG' END, CASE WHEN sun > 0.01 THEN 'HIGH_SUN' END,
             CASE WHEN refl > 0.01 THEN 'HIGH_REFLECTION' END) AS reason_codes FROM e)
SELECT event_id, reason_codes = '' AS is_usable, reason_codes FROM r
""")
def q_pre_qc(spark, sf_dir):
    share = lambda c, m, n: F.pmod(F.col(c), F.lit(m)) / F.lit(float(n))
    frames = read(spark, sf_dir, "events").select(
        "event_id", F.col("value").alias("mean_luma"), share("user_id", 13, 1000).alias("fog_ratio"),
        F.when(F.pmod("event_id", F.lit(5)) != 0, share("event_id", 101, 8000)).alias("sun_ratio"), share("event_id", 7, 500).alias("reflection_ratio"),
    )
    return screening.pre_qc(frames).select("event_id", "is_usable", "reason_codes")


@query("""
SELECT event_id, value < (SELECT quantile_cont(value, 0.1) FROM events) AS low_mountain FROM events
""")
def q_percentile_filter(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("event_id", screening.below_percentile(e, "value", 10).alias("low_mountain"))


@query("""
SELECT user_id, round(avg(value), 6) AS mean_luma, round(stddev_pop(value), 6) AS std_luma,
       round(quantile_cont(value, 0.05), 6) AS p05_luma, round(quantile_cont(value, 0.5), 6) AS p50_luma,
       round(quantile_cont(value, 0.95), 6) AS p95_luma, round(avg(CASE WHEN value >= 250 THEN 1.0::DOUBLE ELSE 0 END), 6) AS saturated_ratio
FROM events GROUP BY user_id
""")
def q_luma_profile(spark, sf_dir):
    names = ("mean_luma", "std_luma", "p05_luma", "p50_luma", "p95_luma", "saturated_ratio")
    return rounded(profiles.luma_profile(read(spark, sf_dir, "events"), ["user_id"], "value"), **dict.fromkeys(names, 6))


@query("""
SELECT l_suppkey, round(avg(l_quantity), 6) AS mean_luma, round(stddev_pop(l_quantity), 6) AS std_luma,
       round(quantile_cont(l_quantity, 0.05), 6) AS p05_luma, round(quantile_cont(l_quantity, 0.5), 6) AS p50_luma, round(quantile_cont(l_quantity, 0.95), 6) AS p95_luma
FROM lineitem GROUP BY l_suppkey
""")
def q_hist_percentile(spark, sf_dir):
    counts = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.col("l_quantity").cast("int").alias("bin")).agg(F.count("*").alias("n"))
    out = profiles.profile_from_histogram(counts, ["l_suppkey"], "bin", "n")
    return rounded(out, mean_luma=6, std_luma=6, p05_luma=6, p50_luma=6, p95_luma=6)


@query("SELECT l_suppkey, round(avg(CASE WHEN l_quantity >= 45 THEN 1.0::DOUBLE ELSE 0 END), 6) AS ratio FROM lineitem GROUP BY l_suppkey")
def q_saturated_ratio(spark, sf_dir):
    return rounded(profiles.area_ratio(read(spark, sf_dir, "lineitem"), ["l_suppkey"], F.col("l_quantity") >= 45), ratio=6)


def shares(events: DataFrame) -> DataFrame:
    """(user, event type, share of the user's bright events)."""
    bright = events.filter("value > 150")
    total = bright.groupBy("user_id").agg(F.count("*").alias("total"))
    return bright.groupBy("user_id", F.col("event_type").alias("prompt")).agg(F.count("*").alias("n")).join(total, "user_id").select("user_id", "prompt", (F.col("n") / F.col("total")).alias("ratio"))


@query("""
WITH b AS (SELECT * FROM events WHERE value > 150), u AS (SELECT user_id, count(*) AS n_events FROM events GROUP BY user_id),
s AS (SELECT user_id, event_type, count(*) / CAST(sum(count(*)) OVER (PARTITION BY user_id) AS DOUBLE) AS r FROM b GROUP BY user_id, event_type)
SELECT u.user_id, u.n_events, round(max(r) FILTER (event_type = 'click'), 6) AS click_ratio, round(max(r) FILTER (event_type = 'error'), 6) AS error_ratio,
       round(max(r) FILTER (event_type = 'purchase'), 6) AS purchase_ratio, round(max(r) FILTER (event_type = 'signup'), 6) AS signup_ratio,
       round(max(r) FILTER (event_type = 'view'), 6) AS view_ratio
FROM u LEFT JOIN s ON s.user_id = u.user_id GROUP BY u.user_id, u.n_events
""")
def q_label_pivot_join(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    users = e.groupBy("user_id").agg(F.count("*").alias("n_events"))
    return rounded(users.join(profiles.labels_wide(shares(e), "user_id", TYPES), "user_id", "left"), **{f"{t}_ratio": 6 for t in TYPES})


@query("""
SELECT l_suppkey, l_returnflag, l_linestatus, round(CASE WHEN count(*) < 100 THEN 0.33
       ELSE avg(l_discount * 1000 / (l_quantity + l_tax * 100 + l_discount * 1000 + 1e-6)) END, 6) AS blue_ratio
FROM lineitem GROUP BY ALL
""")
def q_blue_ratio(spark, sf_dir):
    share = pixels.blue_share(F.col("l_discount") * 1000, F.col("l_tax") * 100, F.col("l_quantity"))
    return rounded(profiles.mean_or_default(read(spark, sf_dir, "lineitem"), ["l_suppkey", "l_returnflag", "l_linestatus"], share), blue_ratio=6)


def green() -> Column:
    return pixels.greenness(F.col("l_quantity") / 50, F.col("l_tax"), F.col("l_discount"))


GREEN_SQL = "CASE WHEN l_quantity / 50 + l_tax + l_discount > 0 THEN l_tax / (l_quantity / 50 + l_tax + l_discount) ELSE 0 END"


@query(f"""
WITH m AS (SELECT CAST(l_shipdate AS DATE) AS date, l_suppkey, max({GREEN_SQL}) AS v FROM lineitem GROUP BY 1, 2),
f AS (SELECT CAST(l_shipdate AS DATE) AS date, count(DISTINCT l_orderkey) AS n_images FROM lineitem GROUP BY 1)
SELECT m.date, CAST(dayofyear(m.date) AS INTEGER) AS doy, round(avg(v), 6) AS mean_gr, n_images FROM m JOIN f ON m.date = f.date GROUP BY m.date, n_images
""", dates=('date',))
def q_greenness_daily_max(spark, sf_dir):
    out = series.daily_greenness(read(spark, sf_dir, "lineitem"), F.to_date("l_shipdate"), ["l_suppkey"], green(), F.col("l_orderkey"))
    return rounded(out, mean_gr=6)


@query(f"""
SELECT l_orderkey, CAST(min(l_shipdate) AS DATE) AS date, round(avg({GREEN_SQL}), 6) AS mean_gr, CAST(1 AS INTEGER) AS n_images FROM lineitem GROUP BY 1
""", dates=('date',))
def q_greenness_per_obs(spark, sf_dir):
    x = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_date(F.min("l_shipdate")).alias("date"), F.round(F.avg(green()), 6).alias("mean_gr"))
    return x.withColumn("n_images", F.lit(1))


# --- thresholds


def level() -> Column:
    return F.least(F.floor(F.col("n_chars") / 20.0), F.lit(255))


@query("""
WITH g AS (SELECT lang, count(*) AS total FROM documents GROUP BY lang),
h AS (SELECT lang, CAST(least(floor(n_chars / 20.0::DOUBLE), 255) AS INTEGER) AS bin, count(*) AS n FROM documents GROUP BY 1, 2)
SELECT g.lang, CAST(b.bin AS INTEGER) AS bin, coalesce(h.n, 0) AS n, round(coalesce(h.n, 0) / (g.total + 1e-10), 9) AS share
FROM g CROSS JOIN range(256) b(bin) LEFT JOIN h ON h.lang = g.lang AND h.bin = b.bin
""")
def q_histogram_256(spark, sf_dir):
    return rounded(profiles.histogram(read(spark, sf_dir, "documents"), ["lang"], level()), share=9)


@query("""
WITH d AS (SELECT lang, CAST(least(floor(n_chars / 20.0::DOUBLE), 255) AS INTEGER) AS b, quality = 1 AS p FROM documents JOIN labels USING (doc_id)),
t AS (SELECT d.lang, CAST(r.t AS INTEGER) AS t, count(*) FILTER (p AND b >= r.t) AS tp, count(*) FILTER (NOT p AND b >= r.t) AS fp, count(*) FILTER (p) AS n_pos
      FROM d, range(127, 256) r(t) GROUP BY 1, 2),
f AS (SELECT lang, t, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END AS pr, CASE WHEN n_pos > 0 THEN tp / CAST(n_pos AS DOUBLE) ELSE 0 END AS rc FROM t),
s AS (SELECT *, round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END, 9) AS f1 FROM f)
SELECT lang, t AS threshold, round(pr, 6) AS fit_prec, round(rc, 6) AS fit_rec, round(f1, 6) AS fit_f1 FROM s
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY f1 DESC, t) = 1
""")
def q_f1_threshold(spark, sf_dir):
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    out = thresholds.best_f1_threshold(d, ["lang"], level(), F.col("quality") == 1)
    return rounded(out, fit_prec=6, fit_rec=6, fit_f1=6)


@query("""
WITH h AS (SELECT lang, CAST(least(floor(n_chars / 20.0::DOUBLE), 255) AS INTEGER) AS bin, count(*) AS n FROM documents GROUP BY 1, 2),
c AS (SELECT lang, bin, sum(n) OVER w AS w, sum(bin * n) OVER w AS m, sum(n) OVER (PARTITION BY lang) AS tw, sum(bin * n) OVER (PARTITION BY lang) AS tm
      FROM h WINDOW w AS (PARTITION BY lang ORDER BY bin)),
v AS (SELECT lang, bin, round(CAST(w AS DOUBLE) * (tw - w) * pow(m / CAST(w AS DOUBLE) - (tm - m) / CAST(tw - w AS DOUBLE), 2), 6) AS v FROM c WHERE tw > w)
SELECT lang, bin AS threshold FROM v QUALIFY row_number() OVER (PARTITION BY lang ORDER BY v DESC, bin) = 1
""")
def q_otsu_threshold(spark, sf_dir):
    counts = read(spark, sf_dir, "documents").groupBy("lang", level().cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return thresholds.otsu_threshold(counts, ["lang"], "bin", "n")


@query("""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT v.vec_id, l.vec_id AS source, unnest(v.e) AS a, unnest(l.e) AS b FROM v JOIN v l ON v.vec_id <> l.vec_id),
c AS (SELECT vec_id, source, round(corr(a, b), 6) AS score, round(corr(a, b), 9) AS s FROM p GROUP BY 1, 2)
SELECT vec_id, source, score FROM c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, source) = 1
""")
def q_hist_correlation_match(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return rounded(thresholds.best_correlated(e, e, "vec_id", "embedding"), score=6)


@query("""
WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'error'),
p AS (SELECT event_id AS pid, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'purchase')
SELECT e.event_id, p.pid AS nearest, abs(e.t - p.t) AS gap_us FROM e LEFT JOIN p ON p.user_id = e.user_id
QUALIFY row_number() OVER (PARTITION BY e.event_id ORDER BY abs(e.t - p.t), p.t, p.pid) = 1
""")
def q_nearest_in_time(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return thresholds.nearest_in_time(e.filter("event_type = 'error'"), e.filter("event_type = 'purchase'"), ["user_id"], "event_id", "event_id")


@query("""
WITH u AS (SELECT user_id, avg(value) FILTER (event_type = 'purchase' AND value > 250) AS a, avg(value) FILTER (event_type = 'view' AND value > 180) AS b,
                  avg(value) FILTER (event_type = 'click' AND value > 150) AS c FROM events GROUP BY user_id)
SELECT user_id, round(coalesce(a, b, c, 230), 6) AS threshold,
       CASE WHEN a IS NOT NULL THEN 'learned' WHEN b IS NOT NULL THEN 'histogram' WHEN c IS NOT NULL THEN 'nearest' ELSE 'fallback' END AS threshold_source FROM u
""")
def q_threshold_cascade(spark, sf_dir):
    mean = lambda kind, least: F.avg(F.when((F.col("event_type") == kind) & (F.col("value") > least), F.col("value")))
    u = read(spark, sf_dir, "events").groupBy("user_id").agg(mean("purchase", 250).alias("a"), mean("view", 180).alias("b"), mean("click", 150).alias("c"))
    value, source = thresholds.cascade(F.col("a"), F.col("b"), F.col("c"))
    return u.select("user_id", F.round(value, 6).alias("threshold"), source.alias("threshold_source"))


@query("""
WITH t AS (SELECT user_id, avg(value) AS thr FROM events GROUP BY user_id)
SELECT user_id, count(*) FILTER (event_type <> 'error') AS n_valid, count(*) FILTER (event_type <> 'error' AND value >= thr) AS n_snow,
       count(*) FILTER (event_type <> 'error' AND event_type = 'view') AS n_sam_snow,
       round(coalesce(count(*) FILTER (event_type <> 'error' AND value >= thr) / nullif(CAST(count(*) FILTER (event_type <> 'error') AS DOUBLE), 0), 0), 6) AS snow_ratio
FROM events JOIN t USING (user_id) GROUP BY user_id
""")
def q_snow_classify_stats(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    x = e.join(e.groupBy("user_id").agg(F.avg("value").alias("thr")), "user_id")
    return rounded(thresholds.classify_stats(x, ["user_id"], F.col("value"), F.col("thr"), F.col("event_type") != "error", F.col("event_type") == "view"), snow_ratio=6)


# --- masks


def cells(events: DataFrame, kind: str | None = None) -> DataFrame:
    x = events if kind is None else events.filter(F.col("event_type") == kind)
    return x.select("user_id", day().alias("day")).distinct()


@query("""
SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events e
WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND CAST(x.ts AS DATE) = CAST(e.ts AS DATE) AND x.event_type IN ('error', 'signup'))
""", dates=('day',))
def q_valid_mask(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return masks.valid_pixels(cells(e), e.select("user_id", day().alias("day"), F.col("event_type").alias("prompt")), ["user_id", "day"], ["error", "signup"])


@query("""
SELECT user_id, CAST(ts AS DATE) AS day, ['error','purchase','view'][min(list_position(['error','purchase','view'], event_type))] AS prompt
FROM events WHERE event_type IN ('error','purchase','view') GROUP BY 1, 2
""", dates=('day',))
def q_priority_masks(spark, sf_dir):
    m = read(spark, sf_dir, "events").select("user_id", day().alias("day"), F.col("event_type").alias("prompt"))
    return masks.resolve_priority(m, ["user_id", "day"], ["error", "purchase", "view"])


@query("SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type IN ('view', 'click')", dates=('day',))
def q_mask_union(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return masks.union([cells(e, "view"), cells(e, "click")])


@query("SELECT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'view' INTERSECT SELECT user_id, CAST(ts AS DATE) FROM events WHERE event_type = 'click'", dates=('day',))
def q_mask_intersect(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return masks.intersection(cells(e, "view"), cells(e, "click"))


@query("SELECT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'view' EXCEPT SELECT user_id, CAST(ts AS DATE) FROM events WHERE event_type = 'click'", dates=('day',))
def q_mask_except(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return masks.difference(cells(e, "view"), cells(e, "click"))


@query("SELECT l_suppkey, l_linenumber, CAST(min(l_quantity) AS INTEGER) AS top FROM lineitem WHERE l_discount > 0.05 GROUP BY 1, 2")
def q_column_top_pixel(spark, sf_dir):
    m = read(spark, sf_dir, "lineitem").filter("l_discount > 0.05").withColumn("row", F.col("l_quantity").cast("int"))
    return masks.top_pixels(m, ["l_suppkey", "l_linenumber"], "row")


@query("""
SELECT l_suppkey, l_linenumber, CAST(l_quantity AS INTEGER) AS ridge_row, l_tax - l_discount AS least_gradient FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_tax - l_discount, l_quantity) = 1
""")
def q_argmin_column(spark, sf_dir):
    x = read(spark, sf_dir, "lineitem").withColumn("row", F.col("l_quantity").cast("int")).withColumn("gradient", F.col("l_tax") - F.col("l_discount"))
    return masks.steepest_rows(x, ["l_suppkey", "l_linenumber"], "row", "gradient")


@query("""
SELECT l_suppkey, count(*) FILTER (r + g + b >= 535.5 AND greatest(r, g, b) - least(r, g, b) < 30) AS n_rock, count(*) AS n FROM
  (SELECT l_suppkey, l_quantity * 5 AS r, 150 + l_tax * 1000 AS g, 150 + l_discount * 1000 AS b FROM lineitem) GROUP BY l_suppkey
""")
def q_bright_rock(spark, sf_dir):
    rock = pixels.bright_neutral(F.col("l_quantity") * 5, 150 + F.col("l_tax") * 1000, 150 + F.col("l_discount") * 1000)
    return read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_if(rock).alias("n_rock"), F.count("*").alias("n"))


# --- series

SEGMENTS_SQL = """
e AS (SELECT *, event_type <> 'error' AS ok FROM events),
m AS (SELECT event_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS d FROM e WHERE ok),
s AS (SELECT e.event_id, e.user_id, e.ts, e.value, e.ok, CASE WHEN e.ok THEN coalesce(m.d, 0) END AS prev_displacement FROM e LEFT JOIN m USING (event_id)),
g AS (SELECT *, CAST(sum(CASE WHEN prev_displacement > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS segment_id FROM s)
"""


def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", "event_type")
    return series.shift_segments(e, ["user_id"], ["ts", "event_id"], F.col("event_type") != "error", lambda a, b: F.abs(b["value"] - a["value"]), 100)


@query(f"WITH {SEGMENTS_SQL} SELECT event_id, user_id, segment_id, round(prev_displacement, 6) AS prev_displacement FROM g")
def q_shift_segments(spark, sf_dir):
    return rounded(segmented(spark, sf_dir).select("event_id", "user_id", "segment_id", "prev_displacement"), prev_displacement=6)


@query(f"""WITH {SEGMENTS_SQL} SELECT user_id, segment_id, count(*) AS n_total, count(*) FILTER (ok) AS n_confirmed,
round(quantile_cont(value, 0.5) FILTER (ok), 6) AS value_median FROM g GROUP BY 1, 2""")
def q_segment_medians(spark, sf_dir):
    return rounded(series.segment_medians(segmented(spark, sf_dir), ["user_id", "segment_id"], F.col("event_type") != "error", ["value"]), value_median=6)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value of each event type and day."""
    return read(spark, sf_dir, "events").groupBy("event_type", day().alias("day")).agg(F.round(F.avg("value"), 6).alias("v"))


DAILY_SQL = "d AS (SELECT event_type, CAST(ts AS DATE) AS day, round(avg(value), 6) AS v FROM events GROUP BY 1, 2)"
ISO_SQL = """
n AS (SELECT event_type AS k, day, v, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i FROM d),
c AS (SELECT *, sum(v) OVER (PARTITION BY k ORDER BY i) AS s FROM n),
ab AS (SELECT b.k, a.i AS a, b.i AS b, (b.s - a.s + a.v) / (b.i - a.i + 1) AS m FROM c a JOIN c b ON a.k = b.k AND a.i <= b.i),
best AS (SELECT k, a, b, max(m) OVER (PARTITION BY k, a ORDER BY b DESC) AS mx FROM ab),
iso AS (SELECT n.k, n.i, min(best.mx) AS iso FROM n JOIN best ON best.k = n.k AND best.a <= n.i AND best.b = n.i GROUP BY 1, 2)
"""


@query(f"WITH {DAILY_SQL}, {ISO_SQL} SELECT n.k AS event_type, n.day, round(n.v, 6) AS v, round(iso.iso, 6) AS iso FROM n JOIN iso USING (k, i)", dates=('day',))
def q_isotonic(spark, sf_dir):
    return rounded(series.isotonic_falling(daily(spark, sf_dir), ["event_type"], "day", "v"), v=6, iso=6)


@query(f"""
WITH {DAILY_SQL}, {ISO_SQL},
w AS (SELECT n.k, n.day, n.v, (CASE dayofmonth(n.day) % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.3 ELSE 0.1 END)::DOUBLE
        * CASE WHEN dayofmonth(n.day) % 4 = 0 THEN greatest(0.5::DOUBLE, n.v / 100) ELSE 1 END * exp(-5 * greatest(0, n.v - iso.iso)) AS w
      FROM n JOIN iso USING (k, i))
SELECT k AS event_type, day, round(w / (avg(w) OVER (PARTITION BY k) + 1e-10), 6) AS weight FROM w
""", dates=('day',))
def q_image_weights(spark, sf_dir):
    source = F.element_at(F.array(*map(F.lit, ("learned", "histogram", "nearest", "fallback"))), F.pmod(F.dayofmonth("day"), F.lit(4)) + 1)
    x = daily(spark, sf_dir).withColumn("threshold_source", source).withColumn("fit_f1", F.col("v") / 100).withColumn("snow_ratio", F.col("v"))
    return rounded(series.image_weights(x, ["event_type"], "day").select("event_type", "day", "weight"), weight=6)


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = F.when(F.col("event_type") == "purchase", 1.0).when(F.col("event_type") == "view", 0.5).otherwise(0.3)
    return series.daily_weighted(read(spark, sf_dir, "events"), ["user_id"], day(), (F.col("value") >= 40).cast("double"), weight)


W_SQL = """
d AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(w) AS w, sum(w * y) AS wy FROM
  (SELECT user_id, ts, CASE event_type WHEN 'purchase' THEN 1.0::DOUBLE WHEN 'view' THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END AS w, CASE WHEN value >= 40 THEN 1.0::DOUBLE ELSE 0 END AS y FROM events)
  GROUP BY 1, 2)
"""
CHANGE_SQL = f"""
{W_SQL},
p AS (SELECT *, coalesce(sum(w) OVER b, 0) AS wb, coalesce(sum(wy) OVER b, 0) AS yb, sum(w) OVER a AS wt, sum(wy) OVER a AS yt, row_number() OVER (PARTITION BY user_id ORDER BY day) - 1 AS k
      FROM d WINDOW b AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY user_id)),
q AS (SELECT *, least(greatest(yb / (wb + 1e-10), 1e-10), 1 - 1e-10) AS ph, least(greatest((yt - yb) / (wt - wb + 1e-10), 1e-10), 1 - 1e-10) AS pl,
             least(greatest(yt / (wt + 1e-10), 1e-10), 1 - 1e-10) AS p0 FROM p),
l AS (SELECT *, yb * ln(ph) + (wb - yb) * ln(1 - ph) + (yt - yb) * ln(pl) + (wt - wb - yt + yb) * ln(1 - pl) AS ll, yt * ln(p0) + (wt - yt) * ln(1 - p0) AS ll0 FROM q),
z AS (SELECT * FROM l WHERE k >= 1 AND wb >= 0.05 * wt AND wt - wb >= 0.05 * wt QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(ll, 9) DESC, k) = 1),
u AS (SELECT user_id, count(*) AS n_days, min(day) AS first FROM d GROUP BY user_id),
c AS (SELECT u.user_id, u.n_days, coalesce(z.day, u.first) AS change_day, coalesce(ph, 0.5) AS p_high, coalesce(pl, 0.5) AS p_low,
             coalesce(least(greatest((1 - exp(-(ll - ll0) / 5)) * least(greatest((ph - pl) / 0.5, 0), 1), 0), 1), 0) AS confidence FROM u LEFT JOIN z USING (user_id))
"""


@query(f"WITH {W_SQL} SELECT user_id, day, round(w, 6) AS w, round(wy, 6) AS wy FROM d", dates=('day',))
def q_daily_weighted(spark, sf_dir):
    return rounded(weighted(spark, sf_dir), w=6, wy=6)


@query(f"WITH {CHANGE_SQL} SELECT user_id, n_days, change_day, round(p_high, 6) AS p_high, round(p_low, 6) AS p_low, round(confidence, 6) AS confidence FROM c", dates=('change_day',))
def q_changepoint(spark, sf_dir):
    return rounded(series.bernoulli_changepoint(weighted(spark, sf_dir), ["user_id"]), p_high=6, p_low=6, confidence=6)


@query(f"""WITH {CHANGE_SQL} SELECT user_id, CAST(CASE WHEN p_high < 0.3 THEN 0 WHEN p_low > 0.7 THEN -1 ELSE dayofyear(change_day) END AS INTEGER) AS doy,
CASE WHEN p_high < 0.3 THEN 'no_snow' WHEN p_low > 0.7 THEN 'persistent' ELSE 'melt' END AS status, round(confidence, 6) AS confidence FROM c""")
def q_snowmelt_doy(spark, sf_dir):
    out = series.melt_doy(series.bernoulli_changepoint(weighted(spark, sf_dir), ["user_id"]), F.dayofyear("change_day"))
    return rounded(out.select("user_id", "doy", "status", "confidence"), confidence=6)


@query(f"""WITH {CHANGE_SQL}, m AS (SELECT user_id, CASE WHEN p_high < 0.3 THEN 0 WHEN p_low > 0.7 THEN -1 ELSE dayofyear(change_day) END AS doy FROM c)
SELECT CAST(t.t AS INTEGER) AS day_of_year, count(*) FILTER (doy > t.t OR doy = -1) AS n_snow, count(*) AS n FROM m, range(1, 31) t(t) GROUP BY 1""")
def q_model_snow_preview(spark, sf_dir):
    m = series.melt_doy(series.bernoulli_changepoint(weighted(spark, sf_dir), ["user_id"]), F.dayofyear("change_day"))
    x = m.select("doy", F.explode(F.sequence(F.lit(1), F.lit(30))).alias("day_of_year"))
    return x.groupBy("day_of_year").agg(F.count_if((F.col("doy") > F.col("day_of_year")) | (F.col("doy") == -1)).alias("n_snow"), F.count("*").alias("n"))


SMOOTH_SQL = f"""
{DAILY_SQL}, n AS (SELECT event_type AS k, day, CAST(dayofyear(day) AS INTEGER) AS doy, v, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM d),
s AS (SELECT n.k, n.i, avg(x.v) AS smooth FROM n, range(-3, 4) o(o), n x
      WHERE x.k = n.k AND x.i = CASE WHEN n.i + o.o < 0 THEN -1 - n.i - o.o WHEN n.i + o.o >= n.n THEN 2 * n.n - 1 - n.i - o.o ELSE n.i + o.o END GROUP BY 1, 2)
"""


@query(f"WITH {SMOOTH_SQL} SELECT n.k AS event_type, n.day, n.v, round(s.smooth, 6) AS smooth FROM n JOIN s USING (k, i)", dates=('day',))
def q_moving_average(spark, sf_dir):
    return rounded(series.moving_average(daily(spark, sf_dir), ["event_type"], "day", "v"), smooth=6)


@query(f"""WITH {SMOOTH_SQL}, t AS (SELECT n.k, n.doy, round(s.smooth, 12) AS m, smooth, min(smooth) OVER (PARTITION BY n.k) AS lo, max(smooth) OVER (PARTITION BY n.k) AS hi FROM n JOIN s USING (k, i))
SELECT k AS event_type, CAST(min(doy) FILTER (smooth >= lo + 0.5 * (hi - lo)) AS INTEGER) AS gup_doy, CAST(max(doy) FILTER (smooth >= lo + 0.5 * (hi - lo)) AS INTEGER) AS gdown_doy,
       CAST(min(doy) FILTER (m = round(hi, 12)) AS INTEGER) AS gmax_doy, round(max(hi), 6) AS gmax_value, 'threshold' AS fit_status FROM t GROUP BY k""")
def q_threshold_phenology(spark, sf_dir):
    x = daily(spark, sf_dir).withColumn("doy", F.dayofyear("day"))
    return rounded(series.threshold_phenology(x, ["event_type"], "doy", "v"), gmax_value=6)


@query("""
WITH d AS (SELECT DISTINCT CAST(dayofyear(l_shipdate) AS INTEGER) AS doy FROM lineitem)
SELECT doy, round(0.3 + 0.2 / (1 + exp(-0.1::DOUBLE * (doy - 140.0::DOUBLE))) - 0.18 / (1 + exp(-0.08::DOUBLE * (doy - 260.0::DOUBLE))), 6) AS fitted_gr FROM d
""")
def q_double_sigmoid_eval(spark, sf_dir):
    doys = read(spark, sf_dir, "lineitem").select(F.dayofyear("l_shipdate").alias("doy")).distinct()
    return doys.select("doy", F.round(curves.double_sigmoid(F.col("doy"), 0.3, 0.2, 0.1, 140, 0.18, 0.08, 260), 6).alias("fitted_gr"))


@query()
def q_phenology_fit(spark, sf_dir):
    x = read(spark, sf_dir, "lineitem").groupBy("l_linenumber", F.dayofyear("l_shipdate").alias("doy")).agg(F.avg(green()).alias("v"))
    return series.sigmoid_phenology(x, ["l_linenumber"], "doy", "v", min_range=0.0)


@query("""
WITH d AS (SELECT CAST(ts AS DATE) AS day, CAST(hour(ts) AS INTEGER) AS x, CAST(min(value) AS DOUBLE) AS y FROM events GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY day) AS n FROM d),
o AS (SELECT n.day, n.x, n.i, n.n, n.y, n.i + o.o AS j FROM n, range(-2, 3) o(o)),
r AS (SELECT day, x, y, CASE WHEN j < 0 THEN -1 - j WHEN j >= n THEN 2 * n - 1 - j ELSE j END AS j FROM o)
SELECT r.day, r.x, r.y, round(quantile_cont(n.y, 0.5), 6) AS smooth FROM r JOIN n ON n.day = r.day AND n.i = r.j GROUP BY 1, 2, 3
""", dates=('day',))
def q_skyline_median(spark, sf_dir):
    d = read(spark, sf_dir, "events").groupBy(day().alias("day"), F.hour("ts").alias("x")).agg(F.min("value").alias("y"))
    return rounded(series.moving_median(d, ["day"], "x", "y", 5), smooth=6)


# --- anchors, matches, geometry


@query("""
WITH e AS (SELECT event_id, user_id, ts, value / 500 AS blue, event_type <> 'error' AS usable, value > 200 AS matched FROM events),
t AS (SELECT *, min(CASE WHEN matched THEN 0 WHEN usable THEN 1 ELSE 2 END) OVER (PARTITION BY user_id) AS best FROM e),
c AS (SELECT * FROM t WHERE CASE WHEN matched THEN 0 WHEN usable THEN 1 ELSE 2 END = best),
p AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, round(0.5 * (1 - least(abs(blue - 0.5) / 0.2::DOUBLE, 1)) + 0.2 * (1 - least(abs(hour(ts) + minute(ts) / 60.0::DOUBLE - 12) / 6.0::DOUBLE, 1))
        + 0.3 * CASE WHEN n > 1 THEN 1 - 2 * abs(i / CAST(n - 1 AS DOUBLE) - 0.5) ELSE 1 END, 9) AS score FROM p)
SELECT user_id, event_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, ts, event_id) AS INTEGER) AS anchor_rank FROM s
QUALIFY anchor_rank <= 3
""")
def q_anchor_topk(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("blue", F.col("value") / 500)
    c = matching.best_tier(e, ["user_id"], [F.col("value") > 200, F.col("event_type") != "error"])
    scored = matching.anchor_scores(c, ["user_id"], ["ts", "event_id"], "blue", "ts", 0.5)
    return rounded(matching.top_anchors(scored, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "score", "anchor_rank"), score=6)


@query("""
WITH e AS (SELECT event_id, round(value / 500, 6) AS b FROM events WHERE event_type = 'error'), r AS (SELECT event_id AS rid, round(value / 500, 6) AS b FROM events WHERE event_type = 'purchase'),
x AS (SELECT e.event_id, r.rid, r.b AS rb, CAST(abs(round(e.b * 1e6) - round(r.b * 1e6)) AS BIGINT) AS g FROM e, r),
n AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY g, rb, rid) = 1)
SELECT event_id, CASE WHEN g < 200000 THEN rid ELSE (SELECT min(rid) FROM r) END AS reference, round(greatest(0, 1 - g / 2e5), 6) AS score FROM n
""")
def q_closest_reference(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("b", F.round(F.col("value") / 500, 6))
    return rounded(matching.closest_reference(e.filter("event_type = 'error'"), e.filter("event_type = 'purchase'"), "event_id", "b"), score=6)


@query("""
WITH p AS (SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice / 50 AS x, l_quantity * 20 AS y FROM lineitem),
c AS (SELECT *, CAST(floor(x / 100) AS BIGINT) AS cell_x, CAST(floor(y / 100) AS BIGINT) AS cell_y FROM p)
SELECT l_returnflag, cell_x, cell_y, l_orderkey, l_linenumber FROM c
QUALIFY row_number() OVER (PARTITION BY l_returnflag, cell_x, cell_y ORDER BY round((x - (cell_x + 0.5) * 100) * (x - (cell_x + 0.5) * 100) + (y - (cell_y + 0.5) * 100) * (y - (cell_y + 0.5) * 100), 6), l_orderkey, l_linenumber, x) = 1
""")
def q_grid_thin(spark, sf_dir):
    p = read(spark, sf_dir, "lineitem").withColumn("x", F.col("l_extendedprice") / 50).withColumn("y", F.col("l_quantity") * 20)
    return matching.grid_thin(p, ["l_returnflag"], "x", "y", 100, ["l_orderkey", "l_linenumber", "x"]).select("l_returnflag", "cell_x", "cell_y", "l_orderkey", "l_linenumber")


H = [1.01, 0.02, 3.0, -0.01, 0.99, -2.0, 0.00001, 0.00002, 1.0]


@query("""
WITH p AS (SELECT l_suppkey, l_extendedprice / 50 AS x, l_quantity * 20 AS y, l_extendedprice / 50 + l_tax * 100 AS u, l_quantity * 20 + l_discount * 100 AS v FROM lineitem),
q AS (SELECT *, 0.00001::DOUBLE * x + 0.00002::DOUBLE * y + 1.0::DOUBLE AS w FROM p),
e AS (SELECT l_suppkey, v, pow((1.01::DOUBLE * x + 0.02::DOUBLE * y + 3) / w - u, 2) + pow((-0.01::DOUBLE * x + 0.99::DOUBLE * y - 2) / w - v, 2) AS e FROM q)
SELECT l_suppkey, round(sqrt(avg(e) FILTER (v < 900)), 6) AS rmse, count(*) FILTER (v < 900) AS n_inliers FROM e GROUP BY 1
""")
def q_reprojection_rmse(spark, sf_dir):
    p = read(spark, sf_dir, "lineitem").withColumn("x", F.col("l_extendedprice") / 50).withColumn("y", F.col("l_quantity") * 20)
    p = p.withColumn("u", F.col("x") + F.col("l_tax") * 100).withColumn("v", F.col("y") + F.col("l_discount") * 100)
    return rounded(matching.reprojection_rmse(p, ["l_suppkey"], ("x", "y"), ("u", "v"), H, F.col("v") < 900), rmse=6)


@query("""
WITH p AS (SELECT l_suppkey, (l_extendedprice / 50 - 960) / 1920::DOUBLE AS u, (l_quantity * 20 - 540) / 1920::DOUBLE AS v FROM lineitem),
r AS (SELECT *, u * u + v * v AS r FROM p),
d AS (SELECT l_suppkey, u, v, r, (1 + 0.1::DOUBLE * r - 0.02::DOUBLE * r * r + 0.003::DOUBLE * r * r * r) / (1 + 0.01::DOUBLE * r + 0.002::DOUBLE * r * r + 0.0003::DOUBLE * r * r * r) AS k FROM r)
SELECT l_suppkey, round(avg((u * k + 2 * 0.001::DOUBLE * u * v - 0.002::DOUBLE * (r + 2 * u * u)) * 1920 + 960), 6) AS x,
       round(avg((v * k + 0.001::DOUBLE * (r + 2 * v * v) + 2 * -0.002::DOUBLE * u * v) * 1920 + 540), 6) AS y FROM d GROUP BY 1
""")
def q_distort_points(spark, sf_dir):
    x, y = geometry.distort(F.col("l_extendedprice") / 50, F.col("l_quantity") * 20, (0.1, -0.02, 0.003, 0.001, -0.002, 0.01, 0.002, 0.0003), 1920, 1080)
    return read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg(x), 6).alias("x"), F.round(F.avg(y), 6).alias("y"))


@query("""
WITH p AS (SELECT l_suppkey, l_quantity AS dx, l_tax * 100 AS dy, radians(l_discount * 10) AS a, 1 + l_tax / 10 AS s FROM lineitem),
c AS (SELECT p.*, q.x - 960 AS u, q.y - 540 AS v FROM p, (VALUES (0::DOUBLE, 0::DOUBLE), (1920, 0), (0, 1080), (1920, 1080)) q(x, y)),
d AS (SELECT l_suppkey, sqrt(pow(s * (cos(a) * u - sin(a) * v) + dx - u, 2) + pow(s * (sin(a) * u + cos(a) * v) + dy - v, 2)) AS d FROM c)
SELECT l_suppkey, round(max(d), 6) AS displacement FROM d GROUP BY 1
""")
def q_corner_displacement(spark, sf_dir):
    d = geometry.corner_displacement((F.col("l_quantity"), F.col("l_tax") * 100, F.col("l_discount") * 10, 1 + F.col("l_tax") / 10), (0, 0, 0, 1), 1920, 1080)
    return read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.max(d), 6).alias("displacement"))


@query("""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT a.vec_id, b.vec_id AS m, round(list_distance(a.e, b.e), 6) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER w AS n, lead(d) OVER w AS second FROM p WINDOW w AS (PARTITION BY vec_id ORDER BY d, m))
SELECT vec_id, m AS match, d AS distance, second FROM r WHERE n = 1 AND d < 0.95 * second
""")
def q_knn_ratio_match(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return matching.ratio_matches(e, e, "vec_id", "embedding", ratio=0.95)


@query("""
WITH t AS (SELECT l_suppkey AS row, l_linenumber AS col, l_discount * 10 AS s, greatest(l_tax * 10, 0.08) AS w FROM lineitem)
SELECT row, col, round(sum(s * w) / greatest(sum(w), 1e-6), 6) AS score FROM t GROUP BY 1, 2
""")
def q_tile_blend(spark, sf_dir):
    t = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("row"), F.col("l_linenumber").alias("col"), (F.col("l_discount") * 10).alias("s"), F.greatest(F.col("l_tax") * 10, F.lit(0.08)).alias("w"))
    return rounded(matching.blend_tiles(t, ["row", "col"], "s", "w"), score=6)


@query("""
SELECT DISTINCT p_size, array_to_string(list_sort(list_distinct(list_concat(range(0, greatest(p_size * 30 - 512, 0) + 1, 256), [greatest(p_size * 30 - 512, 0)]))), ',') AS origins FROM part
""")
def q_tile_origins(spark, sf_dir):
    origins = geometry.tile_origins(F.col("p_size") * 30, 512, 256)
    return read(spark, sf_dir, "part").select("p_size", F.array_join(origins.cast("array<string>"), ",").alias("origins")).distinct()


# --- dates, hashes, order


@query("""
WITH e AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN strftime(ts, '/a/b/cam_%Y%m%d_%H%M.jpg') WHEN 1 THEN strftime(ts, 'cam_%Y-%m-%d_%H-%M-%S.jpg') WHEN 2 THEN strftime(ts, 'cam_%Y-%m-%d_%H-%M.jpg')
                  WHEN 3 THEN strftime(ts, 'x/cam_%Y%m%d.jpg') WHEN 4 THEN 'cam_20201399_1805.jpg' ELSE 'cam.jpg' END AS name, ts FROM events)
SELECT event_id, name, CASE WHEN event_id % 6 < 3 THEN date_trunc('minute', ts) WHEN event_id % 6 = 3 THEN date_trunc('day', ts) END AS timestamp FROM e
""", dates=('timestamp',))
def q_parse_timestamp(spark, sf_dir):
    kind = F.pmod("event_id", F.lit(6))
    f = lambda p: F.date_format("ts", p)
    name = (
        F.when(kind == 0, f("'/a/b/cam_'yyyyMMdd_HHmm'.jpg'")).when(kind == 1, f("'cam_'yyyy-MM-dd_HH-mm-ss'.jpg'")).when(kind == 2, f("'cam_'yyyy-MM-dd_HH-mm'.jpg'"))
        .when(kind == 3, f("'x/cam_'yyyyMMdd'.jpg'")).when(kind == 4, "cam_20201399_1805.jpg").otherwise("cam.jpg")
    )
    return read(spark, sf_dir, "events").select("event_id", name.alias("name")).withColumn("timestamp", dates.name_timestamp(F.col("name")))


@query("""SELECT event_id, CAST(dayofyear(ts) AS INTEGER) AS doy, CAST(ts AS DATE) AS date, round(hour(ts) + minute(ts) / 60.0::DOUBLE, 6) AS hour,
round(1 - least(abs(hour(ts) + minute(ts) / 60.0::DOUBLE - 12) / 6.0::DOUBLE, 1), 6) AS noon FROM events""", dates=('date',))
def q_day_of_year(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.dayofyear("ts").alias("doy"), day().alias("date"), F.round(dates.hour_fraction(F.col("ts")), 6).alias("hour"), F.round(dates.noon_score(F.col("ts")), 6).alias("noon"))


@query("SELECT doc_id, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents")
def q_sha256_manifest(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("n_bytes"))


@query("""SELECT CAST(ts AS DATE) AS day, event_id FROM events
QUALIFY row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) = count(*) OVER (PARTITION BY CAST(ts AS DATE)) // 2 + 1""", dates=('day',))
def q_middle_of_day(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(day().alias("day"), "ts", "event_id")
    return matching.middle_rows(e, ["day"], ["ts", "event_id"]).select("day", "event_id")


@query("""WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events)
SELECT user_id, event_id, CAST(n // 49 AS INTEGER) AS page, CAST(n % 49 AS INTEGER) AS slot FROM n""")
def q_paging(spark, sf_dir):
    return matching.pages(read(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "page", "slot")


@query("SELECT event_id, CAST(least(greatest(floor((value - 5) / 295::DOUBLE * 256), 0), 255) AS INTEGER) AS colour FROM events")
def q_doy_colour_bins(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("event_id", matching.colour_bins(e, "value", 5, 300).alias("colour"))


@query("""
SELECT event_id, user_id FROM events e WHERE NOT EXISTS
  (SELECT 1 FROM events m WHERE m.event_type = 'error' AND CAST(floor(m.value) AS INTEGER) = least(greatest(CAST(trunc(e.value) AS INTEGER), 0), 499) AND m.user_id % 50 = least(greatest(CAST(e.user_id % 60 AS INTEGER), 0), 49))
""")
def q_outside_mask(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    mask = e.filter("event_type = 'error'").select(F.floor("value").cast("int").alias("row"), F.pmod("user_id", F.lit(50)).cast("int").alias("col"))
    points = e.withColumn("x", F.pmod("user_id", F.lit(60)).cast("double"))
    return matching.outside_mask(points, mask, [], "x", "value", 50, 500).select("event_id", "user_id")


@query("SELECT count(*) AS n_images, count(DISTINCT CAST(ts AS DATE)) AS n_days, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, min(value) AS min, max(value) AS max, event_type FROM events GROUP BY event_type")
def q_summary(spark, sf_dir):
    v = F.col("value")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n_images"), F.countDistinct(day()).alias("n_days"), F.round(F.avg(v), 6).alias("mean"), F.round(F.percentile(v, F.lit(0.5)), 6).alias("median"), F.min(v).alias("min"), F.max(v).alias("max"))

