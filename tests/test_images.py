"""Images end to end, on frames that are made here."""

import json
import struct
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from framelake.operators import registration, ridges
from framelake.plans import export, segmentation, stages, viz
from framelake.sources import exif, images, masks, png


def test_png_round_trip():
    rng = np.random.default_rng(0)
    for shape in ((5, 7), (5, 7, 3), (4, 3, 4)):
        x = rng.integers(0, 256, shape).astype(np.uint8)
        assert (png.decode_png(png.encode_png(x)) == x).all()
    with pytest.raises(ValueError):
        png.decode_png(b"no")


def test_exif_tags():
    ifd = struct.pack("<H", 1) + struct.pack("<HHII", 0x0132, 2, 20, 26) + struct.pack("<I", 0)
    tiff = b"II*\0" + struct.pack("<I", 8) + ifd + b"2021:04:07 15:30:00\0"
    app1 = b"Exif\0\0" + tiff
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app1) + 2) + app1 + b"\xff\xda"
    assert exif.read_exif(jpeg) == exif.read_exif(tiff) == {"DateTime": "2021:04:07 15:30:00"} and exif.read_exif(b"junk") == {} == exif.read_exif(jpeg[:20])


def test_masks_pack_and_load(tmp_path, spark):
    m = np.random.default_rng(1).random((9, 13)) > 0.5
    assert (masks.unpack(9, 13, masks.pack(m)) == m).all() and masks.load_mask(str(tmp_path / "none.npz")) is None
    masks.save_mask(str(tmp_path / "a_b_snow.npz"), m)
    table = masks.read_masks(spark, str(tmp_path))
    r = table.withColumn("ratio", masks.area()).first()
    assert (r["stem"], r["prompt"]) == ("a_b", "snow") and r["ratio"] == pytest.approx(m.mean()) and (masks.load_mask(str(tmp_path / "a_b_snow.npz")) == m).all()


def write(folder, name, bgr):
    Path(folder).mkdir(parents=True, exist_ok=True)
    (Path(folder) / name).write_bytes(png.encode_png(bgr[..., ::-1]))


def test_ingest(spark, tmp_path):
    rng = np.random.default_rng(2)
    for n in range(3):
        write(tmp_path / "sub" if n else tmp_path, f"cam_2020070{n + 1}_1200.png", rng.integers(0, 256, (20, 30, 3)).astype(np.uint8))
    (tmp_path / "cam_20200704_1200.png").write_bytes(b"broken")
    (tmp_path / "notes.txt").write_text("x")
    got = stages.ingest(spark, str(tmp_path), ("*.png",)).collect()
    assert [r["timestamp"] for r in got] and len(got) == 4
    by = {r["filename"]: r for r in got}
    assert by["cam_20200702_1200.png"]["timestamp"] == datetime(2020, 7, 2, 12) and by["cam_20200704_1200.png"]["mean_luma"] is None
    r = by["cam_20200701_1200.png"]
    assert 0 < r["p05_luma"] < r["p50_luma"] < r["p95_luma"] <= 255 and (r["width"], r["height"]) == (30, 20)
    with pytest.raises(FileNotFoundError):
        stages.ingest(spark, str(tmp_path / "none"))


def test_luma_stats_equal_numpy():
    x = np.random.default_rng(3).integers(0, 256, (31, 17, 3)).astype(np.uint8)
    gray = np.floor(x @ np.array([0.114, 0.587, 0.299]) + 0.5)
    got = images.luma_stats(x)
    assert got["mean_luma"] == pytest.approx(gray.mean(), abs=0.1) and got["p95_luma"] == pytest.approx(np.percentile(gray, 95), abs=1) and got["std_luma"] == pytest.approx(gray.std(), abs=0.2)


def scene(dx=0.0, dy=0.0, angle=0.0, width=320, height=200, seed=5):
    """Sky over a wavy, textured mountain, moved by a similarity."""
    y, x = np.mgrid[0:height, 0:width].astype(float)
    a = np.radians(angle)
    u, v = x - width / 2 - dx, y - height / 2 - dy
    x, y = np.cos(a) * u + np.sin(a) * v + width / 2, -np.sin(a) * u + np.cos(a) * v + height / 2
    ridge = 80 + 18 * np.sin(x / 23) + 9 * np.sin(x / 7.3 + 1)
    rng = np.random.default_rng(seed)
    big = rng.integers(20, 130, (400, 600)).astype(float)
    xi, yi = np.clip((x / 4 + 100).astype(int), 0, 599), np.clip((y / 4 + 100).astype(int), 0, 399)
    land = big[yi, xi]
    sky = y < ridge
    image = np.where(sky[..., None], np.array([235, 190, 150.0]), np.stack([land * 0.6, land, land * 0.8], axis=-1))
    return image.astype(np.uint8), sky


def test_ridge_match_recovers_a_shift():
    a, sky_a = scene()
    b, sky_b = scene(4, -6, 0.5)
    la, method, _ = ridges.detect_ridge(a, ridges.top_line(~sky_a), sky_a, None)
    lb, _, _ = ridges.detect_ridge(b, ridges.top_line(~sky_b), sky_b, None)
    m = ridges.match_ridges(la, lb, seed="x")
    assert method == "sky_index" and m["success"] and abs(m["dy"] - 6) < 1.5 and m["inlier_ratio"] > 0.8
    assert ridges.match_ridges(la, np.full(len(la), -1))["success"] is False


def test_blue_ratio_default():
    assert ridges.blue_ratio(np.zeros((20, 20, 3), np.uint8), None, None) == 0.33 == ridges.blue_ratio(np.zeros((20, 20, 3), np.uint8), np.eye(20, dtype=bool), None)


def test_homography_with_outliers():
    rng = np.random.default_rng(4)
    h = np.array([[1.02, 0.03, 5], [-0.02, 0.98, -7], [1e-5, 2e-5, 1]])
    a = np.stack(np.meshgrid(np.arange(0, 500, 50), np.arange(0, 300, 50)), axis=-1).reshape(-1, 2).astype(float)
    b = registration.project(h, a)
    b[::3] += rng.uniform(30, 90, b[::3].shape)
    found, ok = registration.estimate_homography(a, b, 2)
    assert not ok[::3].any() and registration.rmse(found, a[ok], b[ok]) < 0.1 and registration.estimate_homography(a[:3], b[:3])[0] is None


def test_warp_undoes_a_shift():
    a, _ = scene()
    h = np.array([[1, 0, 3.0], [0, 1, 2.0], [0, 0, 1]])
    moved = registration.warp(a, h, 320, 200)
    assert (moved[2:, 3:] == a[:-2, :-3]).all() and not moved[:2].any()
    assert registration.warp_line(np.full(320, 50), h, 320, 200)[10] == 52


def test_distortion_is_found():
    a = np.stack(np.meshgrid(np.arange(0, 640, 60), np.arange(0, 480, 60)), axis=-1).reshape(-1, 2).astype(float)
    k = np.array([0.15, 0, 0, 0, 0, 0, 0, 0.0])
    b = registration.distort(a, k, 640, 480)
    assert registration.estimate_distortion([(a, b)], 640, 480) is not None and registration.estimate_distortion([(a[:5], b[:5])], 640, 480) is None


@pytest.fixture(scope="module")
def season(spark, tmp_path_factory):
    """Frames of two camera positions, with masks of sky and mountain."""
    folder, mask_folder = tmp_path_factory.mktemp("frames"), tmp_path_factory.mktemp("masks")
    for n in range(8):
        image, sky = scene(*((0, 0, 0) if n < 4 else (9, 7, 0.3)))
        name = f"cam_202007{n + 1:02d}_1200"
        write(folder, f"{name}.png", image)
        masks.save_mask(str(mask_folder / f"{name}_sky.npz"), sky)
        masks.save_mask(str(mask_folder / f"{name}_mountain.npz"), ~sky)
    profile = stages.ingest(spark, str(folder), ("*.png",)).cache()
    return profile, stages.frames_of(spark, str(folder)).cache(), masks.read_masks(spark, str(mask_folder)).cache()


def test_ridge_qc_numbers_positions(spark, season):
    profile, frames, table = season
    target = profile.orderBy("timestamp").first()["path"]
    got = stages.ridge_qc(profile, frames, table, target).collect()
    assert [r["segment_id"] for r in got] == [0] * 4 + [1] * 4 and all(r["ridge_match_success"] and r["is_usable"] for r in got)
    with pytest.raises(FileNotFoundError):
        stages.ridge_qc(profile, frames, table, "/none")


def test_align_registers_both_positions(spark, season):
    profile, frames, table = season
    target = profile.orderBy("timestamp").first()["path"]
    qc = stages.ridge_qc(profile, frames, table, target).cache()
    out, params, warped = stages.align(qc, frames, target, grid_size=20)
    assert {r["align_status"] for r in out.collect()} == {"success"} and params[0]["round"] == 0 and params[1]["round"] == 1 and params[1]["rmse"] < 3
    h = np.array(params[1]["H"])
    assert np.hypot(*(registration.project(h, np.array([[169.0, 107.0]])) - [[160, 100]])[0]) < 2
    by = {r["path"]: images.array(r["height"], r["width"], r["data"]).astype(int) for r in warped.collect()}
    assert len(by) == 8
    inner = (slice(40, 160), slice(60, 260))
    assert np.abs(by[max(by)][inner] - by[target][inner]).mean() < 12
    with pytest.raises(ValueError):
        stages.align(qc, frames, target, method="none")
    for mode in ("global", "per_segment"):
        assert {r["align_status"] for r in stages.align(qc, frames, target, grid_size=20, estimate_distortion=mode)[0].collect()} == {"success"}
    line = ridges.top_line(~scene()[1])
    anchors = {r["path"]: ridges.top_line(~scene(9, 7, 0.3)[1]) for r in profile.collect()}
    assert stages.align(qc, frames, target, grid_size=20, target_ridge=line, ridges_of=anchors)[1][1]["status"] == "success"
    wrong = {k: np.clip(v + 60, 0, 199) for k, v in anchors.items()}
    assert stages.align(qc, frames, target, grid_size=20, target_ridge=np.full(320, 10), ridges_of=wrong)[1][1]["status"] == "failed"


def test_snow_and_melt(spark):
    height, width, days = 24, 32, 40
    rng = np.random.default_rng(6)
    melt = rng.integers(12, 30, (height, width))
    melt[0, :4], melt[1, :4] = 0, 10_000  # never and always snow
    area = np.ones((height, width), bool)
    area[:, -2:] = False
    frames, labels, info = [], [], []
    for d in range(days):
        white = d < melt
        blue = np.where(white, 235, 90) + rng.integers(-5, 6, (height, width))
        image = np.stack([blue] * 3, axis=-1).astype(np.uint8)
        t = datetime(2021, 4, 1, 12) + timedelta(days=d)
        name = f"cam_{t:%Y%m%d_%H%M}"
        frames.append((f"/x/{name}.png", height, width, bytearray(image.tobytes())))
        info.append((f"/x/{name}.png", f"{name}.png", t, 0, "success"))
        if d % 3 == 0:
            labels += [(name, "snow", height, width, bytearray(masks.pack(white))), (name, "mountain", height, width, bytearray(masks.pack(np.ones_like(white))))]
    f = spark.createDataFrame(frames, images.FRAME)
    df = spark.createDataFrame(info, "path string, filename string, timestamp timestamp_ntz, segment_id int, align_status string")
    table, stats = stages.snow(df, f, spark.createDataFrame(labels, masks.MASK), area)
    rows = stats.orderBy("timestamp").collect()
    assert {r["threshold_source"] for r in rows} == {"learned", "histogram"} and all(r["fit_f1"] > 0.99 for r in rows if r["threshold_source"] == "learned" and r["fit_f1"])
    got = stages.snowmelt(table, stats, area).collect()
    assert len(got) == area.sum()
    doy = np.full((height, width), np.nan)
    for r in got:
        doy[r["row"], r["col"]] = r["doy"]
    start = datetime(2021, 4, 1).timetuple().tm_yday
    inner = area.copy()
    inner[:2, :4] = False
    assert (np.abs(doy[inner] - (start + melt[inner])) <= 1).mean() > 0.99 and (doy[0, :4] == 0).all() and (doy[1, :4] == -1).all()


def test_greenness_and_phenology(spark):
    height, width = 6, 8
    area = np.ones((height, width), bool)
    area[0] = False
    frames, info = [], []
    for doy in range(100, 300, 5):
        level = 0.33 + 0.12 / (1 + np.exp(-0.1 * (doy - 150))) - 0.12 / (1 + np.exp(-0.1 * (doy - 250)))
        image = np.zeros((height, width, 3), np.uint8)
        image[..., 1] = round(200 * level)
        image[..., 0] = image[..., 2] = round(100 * (1 - level))
        image[5, 5] = 50
        t = datetime(2021, 1, 1, 12) + timedelta(days=doy - 1)
        for k in range(2):
            path = f"/x/{doy}_{k}.png"
            frames.append((path, height, width, bytearray((image if k else image // 2).tobytes())))
            info.append((path, t + timedelta(hours=k)))
    profile, f = spark.createDataFrame(info, "path string, timestamp timestamp_ntz"), spark.createDataFrame(frames, images.FRAME)
    tiles, table = stages.gr(profile, f, area)
    assert table.count() == 40 and {r["n_images"] for r in table.collect()} == {2}
    got = {(r["row"], r["col"]): r for r in stages.phenology(tiles, aoi_mask=area, smooth_window=3).collect()}
    assert len(got) == area.sum() and abs(got[2, 2]["gup_doy"] - 150) <= 5 and abs(got[2, 2]["gdown_doy"] - 250) <= 5 and got[5, 5]["fit_status"] == "low_variation"
    fit = {(r["row"], r["col"]): r for r in stages.phenology(tiles, table, area, "double_sigmoid").collect()}
    assert fit[2, 2]["fit_status"] == "success" and abs(fit[2, 2]["gup_doy"] - 150) < 4 and fit[5, 5]["fit_status"] == "low_variation"
    assert abs(stages.phenology(table).first()["gup_doy"] - 150) < 4
    each, single = stages.gr(profile, f, area, daily_max=False)
    assert single.count() == 80 and {"date", "path", "strip", "gr"} == set(each.columns)
    for bad in ({"method": "x"}, {}):
        with pytest.raises(ValueError):
            stages.phenology(tiles, **bad)


def test_segmentation(spark):
    image, sky = scene()
    df = spark.createDataFrame([("/x/a.png", 200, 320, bytearray(image.tobytes())), ("/x/b.png", None, None, None)], images.FRAME)
    labels, table = segmentation.segment(df, tile_size=100, tile_stride=60)
    ratio = {(r["path"], r["prompt"]): r["ratio"] for r in labels.collect()}
    assert len(ratio) == 14 and ratio["/x/b.png", "sky"] == 0 and abs(ratio["/x/a.png", "sky"] - sky.mean()) < 0.2
    total = sum(masks.unpack(r["height"], r["width"], r["bits"]).astype(int) for r in table.collect())
    assert total.max() == 1
    with pytest.raises(ValueError):
        segmentation.normalise_modes("bad", ("sky",))
    assert segmentation.normalise_modes("semantic", ("sky",)) == {"sky": "semantic_only"} and segmentation.tile_starts(10, 4, 3) == [0, 3, 6]


def test_aoi(tmp_path):
    image, sky = scene()
    line = ridges.top_line(~sky)
    out = stages.aoi_from_ridge(image, line)
    write(tmp_path, "aoi.png", out)
    area = masks.load_aoi_mask(str(tmp_path / "aoi.png"))
    assert (area == ~(np.arange(200)[:, None] < line)).all() and (ridges.below(line, 200) == area).all()
    assert np.abs(ridges.skyline(image) - line).mean() < 12
    with pytest.raises(FileNotFoundError):
        masks.load_aoi_mask(str(tmp_path / "none.png"))


def test_viz(spark, tmp_path):
    df = spark.createDataFrame([(0, 0, 100.0, 250.0, 175.0), (0, 1, 110.0, 260.0, 185.0), (1, 0, 105.0, 255.0, 180.0), (1, 1, None, 265.0, 190.0)], "row int, col int, gup double, gdown double, gmax double")
    paths = viz.viz(df, output_dir=str(tmp_path))
    assert sorted(paths) == ["gdown", "gmax", "gup"] and png.decode_png(Path(paths["gup"]).read_bytes())[1, 1, 3] == 0
    assert viz.viz({"other": np.zeros((2, 2))}) == {} and viz.create_grid_image([]).shape == (100, 100, 3) and viz.create_grid_image([np.ones((4, 5, 3))] * 8, 7).shape == (8, 35, 3)
    with pytest.raises(ValueError):
        viz.viz(df.drop("row"))
    assert viz.draw_ridgeline(np.zeros((9, 9, 3), np.uint8), np.full(9, 4)).any() and viz.plot_match_result(np.zeros((9, 9, 3)), np.zeros((9, 9, 3)), [[1, 1]], [[2, 2]]).any()


def test_export(spark, tmp_path):
    for part, name in (("viz", "a.png"), ("viz/deep", "a.png"), ("gr", "b.npy")):
        (tmp_path / "out" / part).mkdir(parents=True, exist_ok=True)
        (tmp_path / "out" / part / name).write_bytes(part.encode())
    target = export.export(spark, str(tmp_path / "out"))
    log = json.loads((Path(target) / "processing_log.json").read_text())
    assert set(log["file_hashes"]) == {"viz/a.png", "viz/deep/a.png"} and not (Path(target) / "gr").exists() and target == str(tmp_path / "export")


def test_logger(tmp_path):
    from framelake.plans.logs import get_logger

    a = get_logger("x", log_file=str(tmp_path / "l.txt"))
    assert len(get_logger("x", log_file=str(tmp_path / "l.txt")).handlers) == 2
    a.debug("told")
    assert "told" in (tmp_path / "l.txt").read_text()
