"""The stages by folder: each takes tables and paths, writes its results below ``output_dir`` if one is given.

Functions use the active session. Images and masks are read from their folders; tables
of masks can be passed instead of a masks folder.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.dates import parse_filename
from framelake.operators import ridges, screening
from framelake.operators.ridges import blue_ratio as compute_blue_ratio
from framelake.operators.ridges import detect_ridge as detect_ridgeline
from framelake.operators.ridges import match_ridges as match_ridgelines_ransac
from framelake.plans import export as _export
from framelake.plans import segmentation, stages
from framelake.plans.logs import get_logger
from framelake.plans.viz import colours, create_grid_image, draw_ridgeline, plot_match_result, viz
from framelake.sources import images, masks
from framelake.sources.masks import load_aoi_mask, load_mask
from framelake.sources.png import encode_png

__all__ = [
    "align", "aoi", "compute_blue_ratio", "create_grid_image", "detect_ridgeline", "detect_segments", "draw_ridgeline", "export", "get_logger", "get_sam_ridge", "gr",
    "ingest", "load_alignment_params", "load_aoi_mask", "load_mask", "match_ridgelines_ransac", "max_corner_displacement", "parse_filename", "phenology", "plot_match_result", "pre_qc", "ridge_qc",
    "segment", "snow", "snowmelt", "viz",
]

pre_qc = screening.pre_qc
#: File names of frames in a folder of aligned ones.
FRAMES = ("*.png", "*.jpg", "*.jpeg", "*.tif", "*.tiff")


def _spark() -> SparkSession:
    return SparkSession.active()


def frames_of(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Decoded frames of a profile's rows, from their own folders, or from one folder by file name without its ending.

    Frames that the folder lacks come from where they are. A folder that has none of them is an error.
    """
    path = F.col("path")
    if folder is not None:
        there = images.list_files(_spark(), folder, FRAMES).select(masks.stem(path).alias("stem")).distinct()
        own = df.select("path").distinct().withColumn("stem", masks.stem(path))
        here = own.join(there, "stem", "left_semi")
        if own.limit(1).count() and not here.limit(1).count():
            raise ValueError(f"{folder} has none of the frames")
        out = stages.frames_of(_spark(), folder).withColumn("stem", masks.stem(path)).drop("path").join(here, "stem").select("path", "height", "width", "data")
        rest = own.join(there, "stem", "left_anti")
        return out.unionByName(frames_of(rest)) if rest.limit(1).count() else out
    # The folders of a season are few; the frames themselves are never listed on the driver.
    folders = [r[0] for r in df.select(F.regexp_replace(path, "/[^/]*$", "")).distinct().collect()]
    parts = [stages.frames_of(_spark(), f) for f in folders]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.join(df.select("path"), "path", "left_semi").select("path", "height", "width", "data")


def load_alignment_params(path: str) -> dict:
    """The segments' parameters that align() wrote (its file, or the folder with it), by segment number; empty if there is none."""
    file = Path(path) / "alignment_params.json" if Path(path).is_dir() else Path(path)
    return {int(k): v for k, v in json.loads(file.read_text()).items() if k.isdigit()} if file.exists() else {}


def mask_table(source: str | DataFrame, prompts: list[str] | None = None) -> DataFrame:
    return source if isinstance(source, DataFrame) else masks.read_masks(_spark(), source, prompts)


def write_csv(df: DataFrame, path: Path) -> None:
    """One CSV file; the table is a row per frame, day or segment."""
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w") as f:
        f.write(",".join(df.columns) + "\n")
        for r in df.toLocalIterator():
            f.write(",".join("" if v is None else json.dumps(v) if isinstance(v, str) and any(c in v for c in ',"\n') else str(v) for v in r) + "\n")


def ingest(directory: str, patterns: tuple[str, ...] | None = None, timestamp_source: str = "filename", timestamp_pattern: str | None = None) -> DataFrame:
    return stages.ingest(_spark(), directory, patterns, timestamp_source, timestamp_pattern)


def save_masks(table: DataFrame, folder: str) -> None:
    """A ``<stem>_<prompt>.npz`` for each mask, written by the tasks; ``folder`` is one that all executors share."""
    Path(folder).mkdir(parents=True, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            for r in b.to_pylist():
                masks.save_mask(f"{folder}/{r['stem']}_{r['prompt']}.npz", masks.unpack(r["height"], r["width"], r["bits"]))
                n += 1
        yield pa.record_batch([pa.array([n], pa.int64())], ["n"])

    table.mapInArrow(run, "n long").agg(F.sum("n")).collect()


def segment(profile: DataFrame, prompts: tuple[str, ...] = segmentation.PROMPTS, output_dir: str | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """Labels and masks of a profile's frames; with a folder, segment.csv and mask archives are written."""
    labels, table = segmentation.segment(frames_of(profile), prompts, **options)
    if output_dir:
        write_csv(labels, Path(output_dir) / "segment.csv")
        save_masks(table, str(Path(output_dir) / "masks"))
    return labels, table


def get_sam_ridge(mask_path: str, snow_mask_path: str | None = None) -> np.ndarray | None:
    return ridges.mask_ridge(load_mask(mask_path), load_mask(snow_mask_path) if snow_mask_path else None)


def max_corner_displacement(a: dict, b: dict, width: int, height: int, cy_override: float | None = None) -> float:
    return ridges.corner_shift(a, b, width, height, cy_override)


def detect_segments(results: list[dict], width: int, height: int, ridge_cy: float, displacement_threshold: float = 5) -> list[dict]:
    """Numbers a list of matches (``segment_id``, ``prev_displacement`` are set in it) and sums up each segment."""
    number, before = 0, None
    for r in results:
        r["prev_displacement"] = None
        if r.get("success"):
            r["prev_displacement"] = 0.0 if before is None else ridges.corner_shift(before, r, width, height, ridge_cy)
            number += r["prev_displacement"] > displacement_threshold
            before = r
        r["segment_id"] = number
    out = []
    for s in range(number + 1):
        own = [r for r in results if r["segment_id"] == s]
        good = [r for r in own if r.get("success")]
        medians = {f"{k}_median": float(np.median([r[k] for r in good])) if good else float("nan") for k in ("dx", "dy", "angle", "scale")}
        out.append({"segment_id": s, "n_total": len(own), "n_confirmed": len(good), **medians})
    return out


def ridge_qc(df: DataFrame, masks_dir: str | DataFrame, target_image: str, output_dir: str | None = None, **options) -> DataFrame:
    """Screening, ridge matching and position numbers; with a folder, ridge_qc.csv is written."""
    out = stages.ridge_qc(df, frames_of(df), mask_table(masks_dir), target_image, **options)
    if output_dir:
        write_csv(out, Path(output_dir) / "ridge_qc.csv")
    return out


def save_frames(frames: DataFrame, folder: str, skip_existing: bool = True) -> None:
    """PNG files of frames under their own names; those that exist are skipped, so an interrupted run goes on."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    named = frames.withColumn("name", F.concat(masks.stem(F.col("path")), F.lit(".png")))
    if clash := frames.groupBy(masks.stem(F.col("path")).alias("stem")).agg(F.count("*").alias("n")).filter("n > 1").first():
        raise ValueError(f"{clash['n']} frames are named {clash['stem']}")
    if skip_existing and any(Path(folder).iterdir()):
        there = _spark().createDataFrame([(p.name,) for p in Path(folder).glob("*.png")] or [("",)], "name string")
        named = named.join(there, "name", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            for r in b.to_pylist():
                Path(folder, r["name"]).write_bytes(encode_png(images.array(r["height"], r["width"], r["data"])[..., ::-1]))
                n += 1
        yield pa.record_batch([pa.array([n], pa.int64())], ["n"])

    named.select("name", "height", "width", "data").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def align(df: DataFrame, target_image: str, masks_dir: str | DataFrame, method: str = "harris", output_dir: str | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """Adds the align columns; with a folder, writes aligned/*.png, alignment_params.json and the AOI image. Returns the table and the aligned frames."""
    frames = frames_of(df)
    out, params, warped = stages.align(df, frames, target_image, method, **options)
    if output_dir:
        folder = Path(output_dir)
        save_frames(warped, str(folder / "aligned"))
        (folder / "alignment_params.json").write_text(json.dumps({str(k): v for k, v in params.items()} | {"estimate_distortion": options.get("estimate_distortion", "off")}, indent=2))
        base = frames.filter(F.col("path") == target_image).first()
        own = {r["prompt"]: masks.unpack(r["height"], r["width"], r["bits"]) for r in mask_table(masks_dir).filter(F.col("stem") == Path(target_image).stem).collect()}
        image = images.array(base["height"], base["width"], base["data"])
        line, _, _ = ridges.detect_ridge(image, ridges.mask_ridge(own.get("mountain"), own.get("snow")), own.get("sky"), own.get("cloud"))
        (folder / "aoi.png").write_bytes(encode_png(stages.aoi_from_ridge(image, line, own.get("sky"))[..., ::-1]))
    return out, warped


def aoi(ref_image: str, output_dir: str | None = None) -> tuple[DataFrame, np.ndarray]:
    """Skyline table (x, y) and the area below it (0 or 255)."""
    row = stages.frames_of(_spark(), str(Path(ref_image).parent)).filter(F.col("path") == str(Path(ref_image).resolve())).first()
    if row is None or row["data"] is None:
        raise ValueError(f"{ref_image} can't be read")
    image = images.array(row["height"], row["width"], row["data"])
    line = ridges.skyline(image)
    table = _spark().createDataFrame(pa.table({"x": np.arange(len(line), dtype=np.int32), "y": line}))
    area = np.where(ridges.below(line, image.shape[0]), 255, 0).astype(np.uint8)
    if output_dir:
        write_csv(table, Path(output_dir) / "skyline.csv")
        (Path(output_dir) / "aoi.png").write_bytes(encode_png(np.repeat(area[..., None], 3, axis=2)))
    return table, area


def snow(df: DataFrame, aligned_dir: str | None, masks_dir: str | DataFrame, mask: np.ndarray, fallback_threshold: float = 230, output_dir: str | None = None, params: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Snow masks and statistics of aligned frames; with a folder, snow_stats.csv and archives are written.

    Masks are moved by the segments' parameters: those given, else those that align() left beside the aligned frames.
    """
    params = params if params is not None else load_alignment_params(str(Path(aligned_dir).parent)) if aligned_dir else {}
    table, stats = stages.snow(df, frames_of(df, aligned_dir), mask_table(masks_dir), mask, fallback_threshold, params)
    if output_dir:
        write_csv(stats, Path(output_dir) / "snow_stats.csv")
        save_masks(table.select(masks.stem(F.col("path")).alias("stem"), F.lit("snow").alias("prompt"), "height", "width", "bits"), str(Path(output_dir) / "snow"))
    return table, stats


def snowmelt(snow_masks: DataFrame, stats_df: DataFrame, mask: np.ndarray, output_dir: str | None = None) -> DataFrame:
    """``row, col, doy, confidence, status``; with a folder, doy.npz (NaN outside the area, confidence 0), a map and daily model previews."""
    out = stages.snowmelt(snow_masks, stats_df, mask).persist()
    if output_dir:
        folder = Path(output_dir) / "snowmelt"
        folder.mkdir(parents=True, exist_ok=True)
        t = out.select("row", "col", "doy", "confidence").toArrow()  # one value per pixel of one image
        doy, sure = np.full(mask.shape, np.nan, np.float32), np.zeros(mask.shape, np.float32)
        at = t.column("row").to_numpy(), t.column("col").to_numpy()
        doy[at], sure[at] = t.column("doy").to_numpy(), t.column("confidence").to_numpy()
        np.savez_compressed(folder / "doy.npz", doy=doy, confidence=sure)
        (folder / "doy.png").write_bytes(encode_png(colours(np.where(doy > 0, doy, np.nan), "jet")))
        for r in stats_df.select(F.dayofyear("timestamp").alias("d")).distinct().collect():
            modelled = (doy > r["d"]) | (doy == -1)
            (folder / f"model_{r['d']:03d}.png").write_bytes(encode_png(np.where(modelled, 255, 0).astype(np.uint8)))
    return out


def gr(profile: DataFrame, aoi_mask: np.ndarray, daily_max: bool = True, output_dir: str | None = None, aligned_dir: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Greenness strips and the time series; with a folder, Parquet by date and gr_timeseries.csv."""
    tiles, table = stages.gr(profile, frames_of(profile, aligned_dir), aoi_mask, daily_max)
    if output_dir:
        tiles.write.mode("overwrite").partitionBy("date").parquet(str(Path(output_dir) / "gr"))
        write_csv(table, Path(output_dir) / "gr_timeseries.csv")
    return tiles, table


def phenology(gr_data: DataFrame, timeseries: DataFrame | None = None, aoi_mask: np.ndarray | None = None, method: str = "threshold", output_dir: str | None = None, **options) -> DataFrame:
    """Season dates; with a folder, phenology_results.csv and a .npy map of each value."""
    out = stages.phenology(gr_data, timeseries, aoi_mask, method, **options)
    if output_dir:
        folder = Path(output_dir) / "phenology"
        write_csv(out, folder / "phenology_results.csv")
        if aoi_mask is not None:
            from framelake.plans.viz import raster

            for name in ("gup_doy", "gdown_doy", "gmax_doy", "gmax_value", "fit_rmse"):
                values = np.full(aoi_mask.shape, np.nan, np.float32)
                found = raster(out, name)
                values[: found.shape[0], : found.shape[1]] = found
                np.save(folder / f"{name}.npy", values)
    return out


def export(output_dir: str, export_dir: str | None = None, include_log: bool = True) -> str:
    return _export.export(_spark(), output_dir, export_dir, include_log)
