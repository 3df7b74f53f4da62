"""The stages by folder, from image files to the exported results."""

import json
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from framelake import api
from framelake.functions.sql import register
from framelake.plans import stages
from framelake.sources import masks
from pyspark.sql import functions as F

from tests.test_images import scene, write


def test_season_by_folder(spark, tmp_path):
    frames, mask_dir, out = tmp_path / "frames", tmp_path / "masks", tmp_path / "out"
    mask_dir.mkdir()
    for n in range(6):
        image, sky = scene(*((0, 0, 0) if n < 3 else (9, 7, 0.3)))
        name = f"{datetime(2020, 7, 1, 12) + timedelta(days=n):cam_%Y%m%d_%H%M}"
        write(frames, f"{name}.JPG", image)
        masks.save_mask(str(mask_dir / f"{name}_sky.npz"), sky)
        masks.save_mask(str(mask_dir / f"{name}_mountain.npz"), ~sky)
    profile = api.ingest(str(frames), ("*.jpg",))
    target = profile.first()["path"]
    qc = api.ridge_qc(profile, str(mask_dir), target, str(out)).cache()
    done, warped = api.align(qc, target, str(mask_dir), output_dir=str(out), grid_size=20)
    assert {r["align_status"] for r in done.collect()} == {"success"} and len(list((out / "aligned").glob("*.png"))) == 6
    assert set(json.loads((out / "alignment_params.json").read_text())) == {"0", "1", "estimate_distortion"}
    area = api.load_aoi_mask(str(out / "aoi.png"))
    table, stats = api.snow(done, str(out / "aligned"), str(mask_dir), area, output_dir=str(out))
    assert stats.count() == 6 and {r["threshold_source"] for r in stats.collect()} == {"fallback"} and len(list((out / "snow").glob("*_snow.npz"))) == 6
    melt = api.snowmelt(table, stats, area, str(out))
    assert melt.count() == area.sum() and (out / "snowmelt" / "doy.npz").exists()
    tiles, series = api.gr(done, area, output_dir=str(out), aligned_dir=str(out / "aligned"))
    assert series.count() == 6 and (out / "gr_timeseries.csv").read_text().count("\n") == 7
    pheno = api.phenology(tiles, aoi_mask=area, output_dir=str(out))
    assert pheno.count() == area.sum() and np.load(out / "phenology" / "gup_doy.npy").shape == area.shape
    assert set(api.viz(pheno, output_dir=str(out / "viz"))) == {"gup", "gdown", "gmax"}
    log = json.loads((Path(api.export(str(out))) / "processing_log.json").read_text())
    assert "snowmelt/doy.npz" in log["file_hashes"]


def test_masks_are_moved_with_their_frames(spark):
    """Frames stand in the target's coordinates, masks as taken, 7 columns and 4 rows off: thresholds are learned from the moved pixels."""
    rng = np.random.default_rng(4)
    area = np.ones((48, 64), bool)
    region = np.zeros((48, 64), bool)
    region[12:30, 20:50] = True
    image = np.zeros((48, 64, 3), np.uint8)
    image[..., 0] = np.where(region, rng.integers(200, 256, region.shape), rng.integers(0, 180, region.shape))
    taken = np.zeros_like(region)
    taken[8:26, 13:43] = True
    move = {0: {"status": "success", "H": [[1, 0, 7], [0, 1, 4], [0, 0, 1]], "distortion_params": None}}
    frames = spark.createDataFrame([("/a/x.JPG", 48, 64, bytearray(image.tobytes()))], "path string, height int, width int, data binary")
    table = spark.createDataFrame([("x", p, 48, 64, bytearray(masks.pack(m))) for p, m in (("snow", taken), ("mountain", area))], "stem string, prompt string, height int, width int, bits binary")
    df = spark.createDataFrame([("/a/x.JPG", "x.JPG", datetime(2020, 7, 1, 12), "success", 0)], "path string, filename string, timestamp timestamp_ntz, align_status string, segment_id int")
    moved = stages.snow(df, frames, table, area, params=move)[1].first()
    assert (moved["n_snow"], moved["n_sam_snow"], moved["threshold_source"], moved["fit_f1"]) == (region.sum(), region.sum(), "learned", 1.0)
    least = int(image[..., 0][region].min())
    assert image[..., 0][~region].max() < moved["threshold"] <= least
    assert stages.snow(df, frames, table, area)[1].first()["fit_f1"] < 1


def test_folders_without_the_frames(spark, tmp_path):
    image, _ = scene()
    write(tmp_path / "f", "a.JPG", image)
    write(tmp_path / "f", "b.JPG", image)
    write(tmp_path / "other", "a.png", image // 2)
    write(tmp_path / "none", "c.png", image)
    df = api.ingest(str(tmp_path / "f"), ("*.jpg",))
    got = {r["path"].rsplit("/", 1)[1]: bytes(r["data"]) for r in api.frames_of(df, str(tmp_path / "other")).collect()}
    assert got == {"a.JPG": (image // 2).tobytes(), "b.JPG": image.tobytes()}
    with pytest.raises(ValueError):
        api.frames_of(df, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        api.save_frames(api.frames_of(df).withColumn("path", F.lit("/x/a.JPG")), str(tmp_path / "out"))
    assert api.load_alignment_params(str(tmp_path)) == {}


def test_segments_of_matches():
    flat = {"dx": 0.0, "dy": 0.0, "angle": 0.0, "scale": 1.0, "success": True}
    results = [dict(flat), dict(flat, dx=1.0), dict(flat, success=False), dict(flat, dx=30.0)]
    got = api.detect_segments(results, 100, 80, 20)
    assert [r["segment_id"] for r in results] == [0, 0, 0, 1] and got[0]["n_confirmed"] == 2 and got[0]["dx_median"] == 0.5
    assert api.detect_segments([], 10, 10, 5)[0]["n_total"] == 0 and api.max_corner_displacement(flat, dict(flat, dx=3.0, dy=4.0), 10, 10) == pytest.approx(5)


def test_skyline_and_masks(spark, tmp_path):
    image, sky = scene()
    write(tmp_path, "a.png", image)
    table, area = api.aoi(str(tmp_path / "a.png"), str(tmp_path))
    assert table.count() == 320 and ((area > 0) == ~sky).mean() > 0.9 and api.get_sam_ridge(str(tmp_path / "none.npz")) is None
    with pytest.raises(ValueError):
        api.aoi(str(tmp_path / "none.png"))


def test_segment_by_folder(spark, tmp_path):
    image, _ = scene()
    write(tmp_path / "f", "cam_20200701.png", image)
    labels, _ = api.segment(api.ingest(str(tmp_path / "f"), ("*.png",)), output_dir=str(tmp_path))
    assert labels.count() == 7 and len(list((tmp_path / "masks").glob("*.npz"))) == 7 and (tmp_path / "segment.csv").exists()


def test_sql_functions(spark):
    register(spark)
    r = spark.sql("SELECT gr(1, 2, 1) AS a, gr(0, 0, 0) AS b, double_sigmoid(140, 0.3, 0.2, 0.1, 140, 0.2, 0.1, 1000) AS c, parse_ts('x_20200420_1805.jpg') AS d, parse_ts('n') AS e").first()
    assert (r["a"], r["b"], round(r["c"], 6), r["d"], r["e"]) == (0.5, 0.0, 0.4, datetime(2020, 4, 20, 18, 5), None)
    assert spark.sql("SELECT * FROM pixels(1, 2, X'010203040506')").count() == 2 and spark.sql("SELECT * FROM tiles(10, 4, 4, 3)").count() == 3
