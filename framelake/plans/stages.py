"""The stages of a camera season: profile, ridge quality control, alignment, snow, snowmelt, greenness, phenology.

Tables between stages: profile (a row per frame), frames (path, height, width, BGR
bytes), masks (stem, prompt, packed bits), strips (a frame's or a day's values for
STRIP rows of pixels). Pixels stay packed in tiles; they are never exploded to rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import curves, dates, geometry
from framelake.operators import matching, registration, ridges, screening, series, thresholds
from framelake.sources import images, masks

#: Rows of pixels of a strip.
STRIP = 128
#: Prompts whose pixels are never classified.
EXCLUDED = ("sky", "cloud", "fog", "sun", "reflection", "human", "raindrop", "vehicle")


def plain(path):
    """Local paths without their scheme, as readers write it in different ways."""
    return F.regexp_replace(path, "^file:/+", "/")


def frames_of(spark: SparkSession, folder: str) -> DataFrame:
    return images.decoded(spark, folder).withColumn("path", plain(F.col("path")))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    for b in batches:
        yield b.to_pylist()


# --- profile


def ingest(spark: SparkSession, directory: str, patterns: tuple[str, ...] | None = None, timestamp_source: str = "filename", timestamp_pattern: str | None = None) -> DataFrame:
    """A row per image file: path, name, time, size and brightness; nulls where a file can't be decoded or dated."""
    files = images.list_files(spark, directory, patterns)
    if timestamp_source == "exif":
        tags = images.exif_tags(spark, files, directory)
        timed = files.join(tags, "path", "left").withColumn("timestamp", dates.exif_timestamp(F.col("tags"))).drop("tags")
    elif timestamp_pattern is not None:
        parse = F.udf(partial(dates.parse_filename, pattern=timestamp_pattern), "timestamp_ntz")
        timed = files.withColumn("timestamp", parse("filename"))
    else:
        timed = files.withColumn("timestamp", dates.name_timestamp(F.col("path")))
    names = ("mean_luma", "std_luma", "p05_luma", "p50_luma", "p95_luma", "saturated_ratio")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _rows(batches):
            out = []
            for r in rows:
                stats = images.luma_stats(images.array(r["height"], r["width"], r["data"])) if r["data"] is not None else dict.fromkeys(names)
                out.append({"path": r["path"], "width": r["width"], "height": r["height"], **stats})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("width", pa.int32()), ("height", pa.int32()), *((n, pa.float64()) for n in names)]))

    stats = frames_of(spark, directory).mapInArrow(run, "path string, width int, height int, " + ", ".join(f"{n} double" for n in names))
    timed = timed.withColumn("path", plain(F.col("path")))
    return timed.join(stats, "path", "left").select("path", "filename", "timestamp", "width", "height", "filesize", *names).orderBy("path")


# --- ridge quality control


def masks_by_stem(table: DataFrame, prompts: tuple[str, ...]) -> DataFrame:
    """``stem, masks``: a frame's wanted masks as a map prompt -> (height, width, bits)."""
    wanted = table.filter(F.col("prompt").isin(*prompts))
    return wanted.groupBy("stem").agg(F.map_from_entries(F.collect_list(F.struct("prompt", F.struct("height", "width", "bits")))).alias("masks"))


def with_masks(frames: DataFrame, table: DataFrame, prompts: tuple[str, ...]) -> DataFrame:
    return frames.withColumn("stem", masks.stem(F.col("path"))).join(masks_by_stem(table, prompts), "stem", "left")


def unpacked(own) -> dict[str, np.ndarray]:
    return {p: masks.unpack(m["height"], m["width"], m["bits"]) for p, m in (own or [])}


def ridge_qc(
    profile: DataFrame, frames: DataFrame, mask_table: DataFrame, target: str, fog_max: float = 0.05, search_margin: int = 10, blue_ratio_threshold: float = 0.34,
    fog_skip_threshold: float = 0.05, inlier_threshold: float = 3, inlier_ratio_threshold: float = 0.8, displacement_threshold: float = 5, **limits: float,
) -> DataFrame:
    """Flags frames, matches the ridge of usable ones with the target's, and numbers the camera's positions.

    The target is a path in ``frames``; FileNotFoundError if it isn't there.
    """
    qc = screening.pre_qc(profile, fog_max=fog_max, **limits)
    needed = ("sky", "cloud", "mountain", "snow")
    base = with_masks(frames.filter(F.col("path") == target), mask_table, needed).first()
    if base is None or base["data"] is None:
        raise FileNotFoundError(target)
    image, own = images.array(base["height"], base["width"], base["data"]), {p: masks.unpack(m["height"], m["width"], m["bits"]) for p, m in (base["masks"] or {}).items()}
    guide = ridges.mask_ridge(own.get("mountain"), own.get("snow"))
    line, _, _ = ridges.detect_ridge(image, guide, own.get("sky"), own.get("cloud"), search_margin, blue_ratio_threshold)
    height, width = image.shape[:2]
    cy = float(line.max()) / 2

    schema = pa.schema([("path", pa.string()), ("method", pa.string()), ("blue", pa.float64()), *((n, pa.float64()) for n in ("dx", "dy", "angle", "scale", "error")), ("success", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _rows(batches):
            out = []
            for r in rows:
                if r["data"] is None:
                    continue
                own = unpacked(r["masks"])
                found, method, blue = ridges.detect_ridge(
                    images.array(r["height"], r["width"], r["data"]), ridges.mask_ridge(own.get("mountain"), own.get("snow")), own.get("sky"), own.get("cloud"), search_margin, blue_ratio_threshold
                )
                m = ridges.match_ridges(line, found, near=inlier_threshold, share=inlier_ratio_threshold, seed=r["path"])
                error = m["error_median"] if np.isfinite(m["error_median"]) else None
                out.append({"path": r["path"], "method": method, "blue": blue, "error": error, **{k: m[k] for k in ("dx", "dy", "angle", "scale", "success")}})
            yield pa.RecordBatch.from_pylist(out, schema)

    fog = F.coalesce(F.col("fog_ratio") >= fog_skip_threshold, F.lit(False)) if "fog_ratio" in qc.columns else F.lit(False)
    wanted = qc.filter(F.col("is_usable") & ~fog).select("path")  # decided on the profile, before any bytes are read
    todo = with_masks(frames.join(wanted, "path", "left_semi"), mask_table, needed).select("path", "height", "width", "data", F.map_entries("masks").alias("masks"))
    todo = todo.withColumn("masks", F.transform("masks", lambda e: F.struct(e["key"].alias("_1"), e["value"].alias("_2"))))
    matched = todo.mapInArrow(_tuples(run), "path string, method string, blue double, dx double, dy double, angle double, scale double, error double, success boolean")
    x = qc.join(matched, "path", "left").withColumn("success", F.coalesce("success", F.lit(False)))
    x = x.withColumn("method", F.coalesce("method", F.when(F.col("is_usable") & fog, "fog_skip").otherwise("skip")))
    shift = lambda a, b: geometry.corner_displacement(tuple(a[n] for n in ("dx", "dy", "angle", "scale")), tuple(b[n] for n in ("dx", "dy", "angle", "scale")), width, height, cy)
    # One camera's frames in order of time are one sequence; only their small rows meet in its task.
    x = series.shift_segments(x, [], ["timestamp", "path"], F.col("success"), shift, displacement_threshold)
    renamed = {"method": "ridge_method", "blue": "ridge_blue_ratio", "dx": "ridge_dx", "dy": "ridge_dy", "angle": "ridge_angle", "scale": "ridge_scale", "error": "ridge_error_median", "success": "ridge_match_success", "prev_displacement": "ridge_prev_displacement"}
    return x.withColumnsRenamed(renamed).withColumn("ridge_confirmed", F.col("ridge_match_success")).orderBy("timestamp", "path")


def _tuples(run):
    """Lists of (key, value) structs as pairs."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator:
            for b in batches:
                yield _Pairs(b)

        yield from run(rows())

    return wrapped


class _Pairs:
    def __init__(self, batch: pa.RecordBatch) -> None:
        self.batch = batch

    def to_pylist(self) -> list[dict]:
        out = self.batch.to_pylist()
        for r in out:
            if "masks" in r:
                r["masks"] = [(e["_1"], e["_2"]) for e in r["masks"] or []]
        return out


# --- alignment


def align(
    df: DataFrame, frames: DataFrame, target: str, method: str = "harris", max_rounds: int = 5, min_ransac_inliers: int = 20, max_rmse: float = 5,
    estimate_distortion: str = "off", grid_size: int = 100, ransac_thresh: float = 10, target_ridge: np.ndarray | None = None, ridges_of: dict[str, np.ndarray] | None = None,
) -> tuple[DataFrame, dict, DataFrame]:
    """Registers each camera position (segment_id) to the target's: df with align columns, parameters by segment, aligned frames.

    Up to three anchors of a segment are tried in order of their score. In later
    rounds a segment is matched with the aligned anchor of the closest blue
    share. A match must also bring the segment's ridge onto the target's if
    ``target_ridge`` and the ``ridges_of`` anchors (path -> ridge) are given.
    ``estimate_distortion``: off, global (one lens for all, from the first
    round's matches) or per_segment.
    """
    if estimate_distortion not in ("off", "global", "per_segment"):
        raise ValueError(f"unknown distortion mode {estimate_distortion}")
    if method not in registration.MATCHERS:
        raise ValueError(f"unknown matcher {method}")
    base = frames.filter(F.col("path") == target).first()
    if base is None or base["data"] is None:
        raise FileNotFoundError(target)
    height, width = base["height"], base["width"]
    keys, order = ["segment_id"], ["timestamp", "path"]
    tiers = [F.col("ridge_match_success"), F.col("is_usable")]
    blue = df.filter(F.col("path") == target).select(F.coalesce("ridge_blue_ratio", F.lit(0.33)).alias("b"), "segment_id").first()
    scored = matching.anchor_scores(matching.best_tier(df, keys, tiers), keys, order, "ridge_blue_ratio", "timestamp", float(blue["b"]))
    anchors = matching.top_anchors(scored, keys, order).select("segment_id", "path", "ridge_blue_ratio", "anchor_rank")
    # A row per segment and anchor: as many as camera positions, not frames.
    chosen = sorted(anchors.collect(), key=lambda r: (r["segment_id"], r["anchor_rank"]))
    home = blue["segment_id"]
    done = {home: {"status": "success", "H": np.eye(3).tolist(), "rmse": 0.0, "num_matches": 0, "anchor": target, "round": 0, "distortion_params": None}}
    spark = df.sparkSession
    lens = None
    pending = {r["segment_id"] for r in chosen} - {home}
    failed: dict[int, dict] = {}
    for number in range(1, max_rounds + 1):
        if not pending:
            break
        plan = []
        for r in chosen:
            if r["segment_id"] in pending:
                b = r["ridge_blue_ratio"] if r["ridge_blue_ratio"] is not None else 0.33
                sources = {s: d for s, d in done.items() if number > 1 or s == home}
                near = min(sources.items(), key=lambda d: (abs(next((c["ridge_blue_ratio"] or 0.33 for c in chosen if c["path"] == d[1]["anchor"]), 0.33) - b), d[0]))
                plan.append((r["segment_id"], r["anchor_rank"], r["path"], near[1]["anchor"], json.dumps(near[1]["H"])))
        table = spark.createDataFrame(plan, "segment_id int, anchor_rank int, path string, reference string, h string")
        a = frames.select("path", "height", "width", "data")
        b = frames.select(F.col("path").alias("reference"), F.col("height").alias("r_height"), F.col("width").alias("r_width"), F.col("data").alias("r_data"))
        joined = a.join(F.broadcast(table), "path").join(b, "reference")

        def attempt(t: pa.Table) -> pa.Table:
            return _attempt(t, method, width, height, grid_size, ransac_thresh, min_ransac_inliers, max_rmse, lens, estimate_distortion == "per_segment", target_ridge, ridges_of or {})

        got = joined.groupBy("segment_id").applyInArrow(attempt, "segment_id int, status string, h string, rmse double, n int, anchor string, points string, lens string").collect()
        if number == 1 and estimate_distortion == "global" and lens is None:
            pairs = [tuple(np.array(p) for p in json.loads(r["points"])) for r in got]
            lens = registration.estimate_distortion([p for p in pairs if len(p[0])], width, height)
            if lens is not None:
                continue
        new = 0
        for r in got:
            entry = {"status": r["status"], "H": json.loads(r["h"]) if r["h"] else None, "rmse": r["rmse"], "num_matches": r["n"], "anchor": r["anchor"], "round": number, "distortion_params": json.loads(r["lens"])}
            if r["status"] == "success":
                done[r["segment_id"]] = entry
                pending.discard(r["segment_id"])
                new += 1
            else:
                failed[r["segment_id"]] = entry | {"round": -1}
        if not new:
            break
    params = {s: done.get(s) or failed.get(s) or {"status": "failed", "H": None, "rmse": None, "num_matches": 0, "anchor": "", "round": -1, "distortion_params": None} for s in {r["segment_id"] for r in chosen} | {home}}
    small = spark.createDataFrame(
        [(int(s), p["status"], p["rmse"], p["num_matches"], p["anchor"], p["round"], method) for s, p in params.items()],
        "segment_id int, align_status string, align_rmse double, align_num_matches int, align_anchor string, align_round int, align_method string",
    )
    out = df.join(F.broadcast(small), "segment_id", "left").fillna({"align_status": "failed", "align_num_matches": 0, "align_anchor": "", "align_round": -1, "align_method": method})
    return out, params, warp_frames(out, frames, params, width, height)


def _attempt(t: pa.Table, method: str, width: int, height: int, grid: int, near: float, least: int, most: float, lens, own_lens: bool, target_ridge, ridges_of: dict) -> pa.Table:
    """Tries a segment's anchors in order; the first good homography wins, else the failure with most inliers is told."""
    best = {"segment_id": t.column("segment_id")[0].as_py(), "status": "failed", "h": None, "rmse": None, "n": -1, "anchor": "", "points": "[[], []]", "lens": "null"}
    for r in sorted(t.to_pylist(), key=lambda r: r["anchor_rank"]):
        if r["data"] is None or r["r_data"] is None:
            continue
        reference = registration.warp(images.array(r["r_height"], r["r_width"], r["r_data"]), np.array(json.loads(r["h"])), width, height)
        a, b = registration.match_images(images.array(r["height"], r["width"], r["data"]), reference, method)
        a, b = registration.thin(a, b, grid)
        model = lens
        points = registration.distort(a, lens, r["width"], r["height"]) if lens is not None and len(a) else a
        h, ok = registration.estimate_homography(points, b, near, seed=r["path"])
        if own_lens and h is not None and (model := registration.estimate_distortion([(a[ok], b[ok])], r["width"], r["height"])) is not None:
            points = registration.distort(a, model, r["width"], r["height"])
            h, ok = registration.estimate_homography(points, b, near, seed=r["path"])
        n = int(ok.sum())
        error = registration.rmse(h, points[ok], b[ok]) if h is not None and n else None
        good = h is not None and n >= least and error is not None and error <= most
        if good and target_ridge is not None and r["path"] in ridges_of:
            good = ridges.match_ridges(target_ridge, registration.warp_line(ridges_of[r["path"]], h, width, height), seed=r["path"])["success"]
        if good or n > best["n"]:
            best |= {"status": "success" if good else "failed", "h": json.dumps(h.tolist()) if h is not None else None, "rmse": error, "n": n, "anchor": r["path"], "points": json.dumps([a[ok].tolist(), b[ok].tolist()]), "lens": json.dumps(None if model is None else model.tolist())}
        if good:
            break
    best["n"] = max(best["n"], 0)
    return pa.Table.from_pylist([best], pa.schema([("segment_id", pa.int32()), ("status", pa.string()), ("h", pa.string()), ("rmse", pa.float64()), ("n", pa.int32()), ("anchor", pa.string()), ("points", pa.string()), ("lens", pa.string())]))


def warp_frames(aligned: DataFrame, frames: DataFrame, params: dict, width: int, height: int) -> DataFrame:
    """Frames of successful segments in the target's coordinates."""
    known = {int(s): (np.array(p["H"]), None if p["distortion_params"] is None else np.array(p["distortion_params"])) for s, p in params.items() if p["status"] == "success"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _rows(batches):
            out = []
            for r in rows:
                h, lens = known[r["segment_id"]]
                image = registration.warp(images.array(r["height"], r["width"], r["data"]), h, width, height, lens=lens)
                out.append({"path": r["path"], "height": height, "width": width, "data": image.tobytes()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("data", pa.binary())]))

    ok = aligned.filter((F.col("align_status") == "success") & F.col("segment_id").isin(list(known))).select("path", "segment_id")
    return frames.filter("data is not null").join(ok, "path").select("path", "height", "width", "data", "segment_id").mapInArrow(run, images.FRAME)


def warp_masks(aligned: DataFrame, mask_table: DataFrame, params: dict, width: int, height: int) -> DataFrame:
    """Masks of successful segments in the target's coordinates."""
    known = {int(s): (np.array(p["H"]), None if p["distortion_params"] is None else np.array(p["distortion_params"])) for s, p in params.items() if p["status"] == "success"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _rows(batches):
            out = []
            for r in rows:
                h, lens = known[r["segment_id"]]
                m = registration.warp(masks.unpack(r["height"], r["width"], r["bits"]), h, width, height, nearest=True, lens=lens)
                out.append({"stem": r["stem"], "prompt": r["prompt"], "height": height, "width": width, "bits": masks.pack(m)})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("stem", pa.string()), ("prompt", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("bits", pa.binary())]))

    ok = aligned.filter((F.col("align_status") == "success") & F.col("segment_id").isin(list(known))).select(masks.stem(F.col("path")).alias("stem"), "segment_id")
    return mask_table.join(ok, "stem").mapInArrow(run, masks.MASK)


def aoi_from_ridge(image: np.ndarray, ridge: np.ndarray, sky: np.ndarray | None = None) -> np.ndarray:
    """The BGR image with the sky above the ridge black; black pixels of the AOI become nearly black. Columns without ridge use the sky mask."""
    out = image.copy()
    out[(out == 0).all(axis=2)] = (1, 0, 0)
    above = (np.arange(image.shape[0])[:, None] < ridge[None, :]) & (ridge >= 0)
    if sky is not None:
        above |= sky & (ridge < 0)
    out[above] = 0
    return out


# --- snow


def f1_threshold(pos: np.ndarray, neg: np.ndarray, low: int = 127) -> tuple[int, float, float, float]:
    """Threshold, precision, recall and F1 from 256 counts of each class: the best from ``low`` on, the smallest of equals."""
    tp, fp = np.cumsum(pos[::-1])[::-1][low:256], np.cumsum(neg[::-1])[::-1][low:256]
    precision = np.divide(tp, tp + fp, out=np.zeros(len(tp)), where=tp + fp > 0)
    recall = tp / pos.sum() if pos.sum() else np.zeros(len(tp))
    f1 = np.divide(2 * precision * recall, precision + recall, out=np.zeros(len(tp)), where=precision + recall > 0)
    k = int(np.round(f1, 9).argmax())
    return low + k, float(precision[k]), float(recall[k]), float(f1[k])


def valid_mask(own: dict[str, np.ndarray], area: np.ndarray) -> np.ndarray:
    ok = area.copy()
    for p in EXCLUDED:
        if p in own and own[p].shape == area.shape:
            ok &= ~own[p]
    return ok


def snow(df: DataFrame, frames: DataFrame, mask_table: DataFrame, area: np.ndarray, fallback_threshold: float = 230, params: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Snow masks (path, height, width, bits) and statistics of aligned frames.

    With the segments' alignment parameters, masks (which are of the frames as taken)
    are moved to the target's coordinates first, as the aligned frames were.

    A frame's blue threshold is learned from its snow and bare mountain pixels,
    else borrowed from the frame with the most similar histogram, else from the
    nearest in time, else constant.
    """
    prompts = (*EXCLUDED, "snow", "mountain")
    if params:
        mask_table = warp_masks(df, mask_table.filter(F.col("prompt").isin(*prompts)), params, area.shape[1], area.shape[0])
    ready = df.filter("align_status = 'success'").select("path", "filename", "timestamp", "segment_id")
    mine = with_masks(frames.join(ready, "path"), mask_table, prompts).filter("data is not null")
    mine = mine.select("path", "filename", "timestamp", "segment_id", "height", "width", "data", F.transform(F.map_entries("masks"), lambda e: F.struct(e["key"].alias("_1"), e["value"].alias("_2"))).alias("masks"))
    learn_schema = pa.schema([("path", pa.string()), ("hist", pa.list_(pa.float64())), ("learned", pa.float64()), *((n, pa.float64()) for n in ("fit_prec", "fit_rec", "fit_f1"))])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _rows(batches):
            out = []
            for r in rows:
                image, own = images.array(r["height"], r["width"], r["data"]), unpacked(r["masks"])
                if image.shape[:2] != area.shape:
                    continue
                counts = np.bincount(image[..., 0][area], minlength=256)
                ok = valid_mask(own, area)
                nothing = np.zeros_like(ok)
                s, m = own.get("snow", nothing), own.get("mountain", nothing)
                pos, neg = (np.bincount(image[..., 0][c & ok], minlength=256) for c in (s, m & ~s))
                fit = f1_threshold(pos, neg) if pos.sum() and neg.sum() else (None,) * 4
                out.append({"path": r["path"], "hist": (counts / (counts.sum() + 1e-10)).tolist(), "learned": fit[0], "fit_prec": fit[1], "fit_rec": fit[2], "fit_f1": fit[3]})
            yield pa.RecordBatch.from_pylist(out, learn_schema)

    learned = mine.select("path", "height", "width", "data", "masks").mapInArrow(_tuples(learn), "path string, hist array<double>, learned double, fit_prec double, fit_rec double, fit_f1 double").persist()
    info = ready.join(learned, "path").withColumn("seq", F.xxhash64("path"))
    with_fit, without = info.filter("learned is not null"), info.filter("learned is null")
    hist = thresholds.best_correlated(without, with_fit, "path", "hist").select("path", F.col("source").alias("hist_source"))
    keyed = lambda d: d.withColumn("_g", F.lit(0)).withColumn("k", F.col("seq"))
    near = thresholds.nearest_in_time(keyed(without), keyed(with_fit), ["_g"], "k", "k", "timestamp").select(F.col("k").alias("seq"), F.col("nearest").alias("near_seq"))
    value = lambda name, key: with_fit.select(F.col(key).alias(name), F.col("learned").alias(f"{name}_thr"), F.element_at(F.split("path", "/"), -1).alias(f"{name}_file"))
    full = info.join(hist, "path", "left").join(near, "seq", "left").join(value("hist_source", "path"), "hist_source", "left").join(value("near_seq", "seq"), "near_seq", "left")
    threshold, source = thresholds.cascade(F.col("learned"), F.col("hist_source_thr"), F.col("near_seq_thr"), fallback_threshold)
    status = F.when(F.col("learned").isNotNull(), "learned").otherwise(F.concat(F.lit("filled_"), source))
    full = full.select("path", threshold.cast("int").alias("threshold"), source.alias("threshold_source"), F.coalesce("hist_source_file", "near_seq_file").alias("source_basename"), status.alias("fit_status"), "fit_prec", "fit_rec", "fit_f1")

    count_names = ("n_valid", "n_snow", "n_sam_snow")

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _rows(batches):
            out = []
            for r in rows:
                image, own = images.array(r["height"], r["width"], r["data"]), unpacked(r["masks"])
                ok = valid_mask(own, area)
                white = ok & (image[..., 0] >= r["threshold"])
                seen = own.get("snow", np.zeros_like(ok)) & ok
                out.append({"path": r["path"], "height": r["height"], "width": r["width"], "bits": masks.pack(white), "n_valid": int(ok.sum()), "n_snow": int(white.sum()), "n_sam_snow": int(seen.sum())})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("bits", pa.binary()), *((n, pa.int64()) for n in count_names)]))

    # The join with the thresholds comes first, so each frame's bytes are decoded once more and no snow mask is shuffled.
    told = mine.join(full.select("path", "threshold"), "path").select("path", "height", "width", "data", "masks", "threshold")
    done = told.mapInArrow(_tuples(classify), "path string, height int, width int, bits binary, " + ", ".join(f"{n} long" for n in count_names)).persist()
    ratio = F.when(F.col("n_valid") > 0, F.col("n_snow") / F.col("n_valid")).otherwise(F.lit(0.0))
    stats = ready.join(done.drop("bits", "height", "width"), "path").join(full, "path").withColumn("snow_ratio", ratio)
    order = ["path", "filename", "timestamp", "segment_id", *count_names, "snow_ratio", "threshold", "threshold_source", "source_basename", "fit_status", "fit_prec", "fit_rec", "fit_f1"]
    return done.select("path", "height", "width", "bits"), stats.select(*order)


def changepoints(wy: np.ndarray, w: np.ndarray, min_side: float = 0.05) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For days x pixels of weighted sums: k, both rates and the confidence, as in ``series.bernoulli_changepoint``."""
    days, pixels = wy.shape
    k, ph, pl = np.zeros(pixels, int), np.full(pixels, 0.5), np.full(pixels, 0.5)
    best = np.full(pixels, -np.inf)
    cw, cy = np.cumsum(w), np.cumsum(wy, axis=0)
    clip = lambda p: np.clip(p, 1e-10, 1 - 1e-10)
    ll = lambda y, n, p: y * np.log(p) + (n - y) * np.log1p(-p)
    for i in range(1, days):
        before, after = cw[i - 1], cw[-1] - cw[i - 1]
        if min(before, after) < min_side * cw[-1]:
            continue
        a, b = clip(cy[i - 1] / (before + 1e-10)), clip((cy[-1] - cy[i - 1]) / (after + 1e-10))
        value = np.round(ll(cy[i - 1], before, a) + ll(cy[-1] - cy[i - 1], after, b), 9)
        better = value > best
        k[better], ph[better], pl[better], best[better] = i, a[better], b[better], value[better]
    whole = clip(cy[-1] / (cw[-1] + 1e-10)) if days else ph
    gain = np.where(np.isfinite(best), best - ll(cy[-1], cw[-1], whole), 0) if days else best
    sure = np.clip((1 - np.exp(-gain / 5)) * np.clip((ph - pl) / 0.5, 0, 1), 0, 1)
    return k, ph, pl, np.where(np.isfinite(best), sure, 0)


def strips(height: int) -> list[tuple[int, int]]:
    return [(y, min(y + STRIP, height)) for y in range(0, height, STRIP)]


def snowmelt(snow_masks: DataFrame, stats: DataFrame, area: np.ndarray) -> DataFrame:
    """``row, col, doy, confidence, status`` of each pixel of the area: the day of year of the melt, 0 without snow, -1 with snow throughout."""
    one = stats.join(snow_masks.select("path"), "path", "left_semi").withColumn("_g", F.lit(0))
    # A row per frame: weights need the whole season's falling trend, which is one series of small rows.
    weights = series.image_weights(one, ["_g"], "timestamp").select("path", F.to_date("timestamp").alias("day"), "weight")
    days = [r["day"] for r in weights.select("day").distinct().orderBy("day").collect()]  # at most 366 a year
    height, width = area.shape
    parts = strips(height)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _rows(batches):
            out = []
            for r in rows:
                m = masks.unpack(r["height"], r["width"], r["bits"])
                out += [{"strip": n, "day": r["day"], "weight": r["weight"], "bits": masks.pack(m[a:b])} for n, (a, b) in enumerate(parts) if area[a:b].any()]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("strip", pa.int32()), ("day", pa.date32()), ("weight", pa.float64()), ("bits", pa.binary())]))

    result = pa.schema([("row", pa.int32()), ("col", pa.int32()), ("doy", pa.float32()), ("confidence", pa.float32()), ("status", pa.string())])

    def solve(t: pa.Table) -> pa.Table:
        a, b = parts[t.column("strip")[0].as_py()]
        inside = area[a:b]
        at = {d: n for n, d in enumerate(days)}
        w, wy = np.zeros(len(days)), np.zeros((len(days), int(inside.sum())))
        for day, weight, bits in zip(*(t.column(c).to_pylist() for c in ("day", "weight", "bits")), strict=True):
            w[at[day]] += weight
            wy[at[day]] += weight * masks.unpack(b - a, width, bits)[inside]
        k, ph, pl, sure = changepoints(wy, w)
        doys = np.array([d.timetuple().tm_yday for d in days])
        doy = np.where(ph < 0.3, 0, np.where(pl > 0.7, -1, doys[k]))
        row, col = np.nonzero(inside)
        status = np.where(ph < 0.3, "no_snow", np.where(pl > 0.7, "persistent", "melt"))
        return pa.table([pa.array(x, f.type) for x, f in zip(((row + a).astype(np.int32), col.astype(np.int32), doy.astype(np.float32), sure.astype(np.float32), status.tolist()), result, strict=True)], schema=result)

    tiles = snow_masks.join(weights, "path").select("height", "width", "bits", "day", "weight").mapInArrow(split, "strip int, day date, weight double, bits binary")
    return tiles.groupBy("strip").applyInArrow(solve, "row int, col int, doy float, confidence float, status string")


# --- greenness and phenology


def gr(profile: DataFrame, frames: DataFrame, area: np.ndarray, daily_max: bool = True) -> tuple[DataFrame, DataFrame]:
    """Greenness strips (date, strip, values) and the series ``date, doy, mean_gr, n_images`` over the area.

    With daily_max, a pixel's value is its maximum over the day's frames; else
    every frame has strips of its own (key: path). Frames of another shape don't count.
    """
    missing = {"path", "timestamp"} - set(profile.columns)
    if missing:
        raise ValueError(f"the profile lacks {', '.join(sorted(missing))}")
    parts, shape = strips(area.shape[0]), area.shape

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _rows(batches):
            out = []
            for r in rows:
                b, g, red = (images.array(r["height"], r["width"], r["data"])[..., i].astype(np.float32) for i in range(3))
                total = b + g + red
                value = np.divide(g, total, out=np.zeros_like(g), where=total > 0)
                out += [{"date": r["date"], "path": r["path"], "strip": n, "gr": value[lo:hi].tobytes()} for n, (lo, hi) in enumerate(parts) if area[lo:hi].any()]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("date", pa.date32()), ("path", pa.string()), ("strip", pa.int32()), ("gr", pa.binary())]))

    dated = profile.filter("timestamp is not null").select("path", F.to_date("timestamp").alias("date"))
    fit = frames.filter((F.col("height") == shape[0]) & (F.col("width") == shape[1]) & F.col("data").isNotNull())
    each = fit.join(dated, "path").select("path", "height", "width", "data", "date").mapInArrow(split, "date date, path string, strip int, gr binary")
    keys = ["date", "strip"] if daily_max else ["date", "path", "strip"]
    fields = "date date, strip int, gr binary, total double, n long, n_images int" if daily_max else "date date, path string, strip int, gr binary, total double, n long, n_images int"

    def reduce(t: pa.Table) -> pa.Table:
        lo, hi = parts[t.column("strip")[0].as_py()]
        best = None
        for raw in t.column("gr"):
            x = np.frombuffer(raw.as_buffer(), np.float32)
            best = x if best is None else np.maximum(best, x)
        inside = best.reshape(hi - lo, shape[1])[area[lo:hi]]
        out = {k: [t.column(k)[0].as_py()] for k in keys} | {"gr": [best.tobytes()], "total": [float(inside.sum(dtype=float))], "n": [len(inside)], "n_images": [len(t)]}
        types = {"date": pa.date32(), "path": pa.string(), "strip": pa.int32(), "gr": pa.binary(), "total": pa.float64(), "n": pa.int64(), "n_images": pa.int32()}
        return pa.table({f.split()[0]: pa.array(out[f.split()[0]], types[f.split()[0]]) for f in fields.split(", ")})

    tiles = each.groupBy(*keys).applyInArrow(reduce, fields).persist()
    by = ["date"] if daily_max else ["date", "path"]
    table = tiles.groupBy(*by).agg((F.sum("total") / F.sum("n")).alias("mean_gr"), F.max("n_images").alias("n_images"))
    return tiles.select(*keys, "gr"), table.select("date", F.dayofyear("date").alias("doy"), "mean_gr", "n_images").orderBy("date", "mean_gr")


def smoothed(cube: np.ndarray, size: int) -> np.ndarray:
    """Centred mean over observations with mirrored ends; missing values are left out."""
    if not len(cube) > size > 1:
        return cube
    pad = np.pad(cube, ((size // 2, size - 1 - size // 2), (0, 0)), mode="symmetric")
    ok = np.isfinite(pad)
    total, n = (np.cumsum(np.concatenate([np.zeros((1, cube.shape[1])), x]), axis=0) for x in (np.where(ok, pad, 0), ok.astype(float)))
    total, n = total[size:] - total[:-size], n[size:] - n[:-size]
    return np.divide(total, n, out=np.full_like(total, np.nan), where=n > 0)


def phenology(
    data: DataFrame, timeseries: DataFrame | None = None, aoi_mask: np.ndarray | None = None, method: str = "threshold", smooth_window: int = 7,
    gup_ratio: float = 0.5, gdown_ratio: float = 0.5, min_range: float = 0.02,
) -> DataFrame:
    """Season dates: of the mean series if ``data`` has mean_gr (one row at 0, 0), else of each pixel of the greenness strips.

    ``row, col, gup_doy, gdown_doy, gmax_doy, gmax_value, fit_rmse, fit_status``
    """
    if method not in ("threshold", "double_sigmoid"):
        raise ValueError(f"unknown method {method}")
    names = ("gup_doy", "gdown_doy", "gmax_doy", "gmax_value", "fit_rmse")
    schema = pa.schema([("row", pa.int32()), ("col", pa.int32()), *((n, pa.float32()) for n in names), ("fit_status", pa.string())])
    spark = data.sparkSession
    if "mean_gr" in data.columns:
        if "doy" not in data.columns and "date" not in data.columns:
            raise ValueError("the series needs doy or date")
        t = (data if "doy" in data.columns else data.withColumn("doy", F.dayofyear("date"))).select("doy", "mean_gr").orderBy("doy").toArrow()  # a row per day
        fit = curves.fit_double_sigmoid(t.column("doy").to_numpy(), t.column("mean_gr").to_numpy())
        return spark.createDataFrame(pa.Table.from_pylist([{"row": 0, "col": 0, **{n: fit[n] for n in (*names, "fit_status")}}], schema))
    if "gr" not in data.columns:
        raise ValueError("the table has neither mean_gr nor greenness strips")
    if aoi_mask is None:
        raise ValueError("strips need an aoi_mask")
    area, parts = aoi_mask, strips(aoi_mask.shape[0])
    hint = None
    if method == "double_sigmoid" and timeseries is not None:
        t = timeseries.select("doy", "mean_gr").orderBy("doy").toArrow()
        fit = curves.fit_double_sigmoid(t.column("doy").to_numpy(), t.column("mean_gr").to_numpy())
        hint = [fit[p] for p in curves.PARAMETERS] if fit["fit_status"] == "success" else None

    def solve(t: pa.Table) -> pa.Table:
        lo, hi = parts[t.column("strip")[0].as_py()]
        inside = area[lo:hi]
        days = np.array([d.timetuple().tm_yday for d in t.column("date").to_pylist()])
        order = np.argsort(days, kind="stable")
        cube = np.stack([np.frombuffer(t.column("gr")[int(i)].as_buffer(), np.float32).reshape(inside.shape)[inside] for i in order]).astype(float)
        days = days[order]
        row, col = np.nonzero(inside)
        if method == "threshold":
            x = smoothed(cube, smooth_window)
            low, high = np.nanmin(x, axis=0), np.nanmax(x, axis=0)
            ok = high - low >= min_range
            up, down = x >= low + gup_ratio * (high - low), x >= low + gdown_ratio * (high - low)
            out = {"gup_doy": days[up.argmax(axis=0)], "gdown_doy": days[len(days) - 1 - down[::-1].argmax(axis=0)], "gmax_doy": days[np.where(np.isfinite(x), x, -np.inf).argmax(axis=0)], "gmax_value": high, "fit_rmse": np.full(len(row), np.nan)}
            columns = [np.where(ok, out[n], np.nan).astype(np.float32) for n in names]
            status = np.where(ok, "threshold", "low_variation").tolist()
        else:
            fits = []
            for y in cube.T:
                good = np.isfinite(y)
                state = "insufficient_data" if good.sum() < 20 else "low_variation" if np.ptp(y[good]) < 0.02 else None
                fits.append(dict.fromkeys(names, np.nan) | {"fit_status": state} if state else curves.fit_double_sigmoid(days, y, 3000, hint))
            columns, status = [np.array([f[n] for f in fits], np.float32) for n in names], [f["fit_status"] for f in fits]
        return pa.table([pa.array(x, f.type) for x, f in zip(((row + lo).astype(np.int32), col.astype(np.int32), *columns, status), schema, strict=True)], schema=schema)

    return data.groupBy("strip").applyInArrow(solve, "row int, col int, " + ", ".join(f"{n} float" for n in names) + ", fit_status string")
