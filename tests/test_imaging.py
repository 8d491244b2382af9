import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import imaging


def test_corners_and_size(spark):
    points = [[100.0, 250.0], [400.0, 50.0], [100.0, 50.0], [400.0, 250.0]]
    frame = spark.createDataFrame([(points,), ([[10.0, 10.0], [790.0, 10.0], [790.0, 490.0], [10.0, 490.0]],)], "p array<array<double>>")
    a, b = frame.select(imaging.ordered_corners(F.col("p")).alias("c")).withColumn("s", imaging.warped_size(F.col("c"))).collect()
    assert a.c == [[100.0, 50.0], [400.0, 50.0], [400.0, 250.0], [100.0, 250.0]] and tuple(a.s) == (300, 200)
    assert tuple(b.s) == (780, 480)


def test_letterbox(spark):
    frame = spark.createDataFrame([(1012, 638), (500, 300), (3000, 400), (400, 400)], "w int, h int")
    got = [tuple(r.b) for r in frame.select(imaging.letterbox(F.col("w"), F.col("h")).alias("b")).collect()]
    for (w, h), (same, nw, nh, x, y) in zip([(1012, 638), (500, 300), (3000, 400), (400, 400)], got, strict=True):
        scale = min(1012 / w, 638 / h)
        assert (nw, nh) == (int(round(w * scale)), int(round(h * scale))) and (x, y) == ((1012 - nw) // 2, (638 - nh) // 2) and same == ((w, h) == (1012, 638))


def test_deskew(spark):
    rows = [(1, 0, 0, 100, 2), (1, 0, 0, 100, 4), (1, 0, 0, 100, 3), (1, 0, 0, 0, 50), (1, 0, 0, 10, 50), (2, 0, 0, 100, 0), (3, 0, 0, 0, 9)]
    got = {r.image_id: r for r in imaging.deskew_angles(spark.createDataFrame(rows, "image_id int, x1 int, y1 int, x2 int, y2 int")).collect()}
    assert got[1].angle == pytest.approx(np.degrees(np.arctan2(3, 100))) and got[1].turn and not got[2].turn and 3 not in got


def test_decisions(spark):
    frame = spark.createDataFrame([(50.0, 0.0), (100.0, 0.01), (150.0, 0.02), (200.0, 0.021), (230.0, 0.06)], "m double, g double")
    got = [tuple(r) for r in frame.select(imaging.wants_contrast(F.col("m")), imaging.wants_glare_removal(F.col("g"))).collect()]
    assert got == [(True, False), (False, False), (False, False), (False, True), (True, True)]


def test_statistics(spark):
    solid = lambda *bgr: np.tile(np.array(bgr, np.uint8), (4, 6, 1)).tobytes()
    rows = [(1, solid(255, 200, 150), 4, 6), (2, solid(225, 245, 255), 4, 6), (3, solid(255, 255, 255), 4, 6), (4, solid(0, 0, 0), 4, 6)]
    got = {r.image_id: r for r in imaging.statistics(spark.createDataFrame(rows, "image_id int, content binary, h int, w int")).collect()}
    assert (got[1].blue, got[1].white) == (1.0, 0.0) and got[2].cream == 1.0 and got[3].white == 1.0 and got[3].bright_ratio == 1.0
    assert got[4].mean_luminance == 0 and got[3].mean_luminance == pytest.approx(255) and (got[4].h, got[4].w) == (4, 6)
    again = imaging.statistics(spark.createDataFrame(rows[:1], "image_id int, content binary, h int, w int"), decode=lambda raw: np.zeros((2, 2, 3), np.uint8)).first()
    assert (again.h, again.mean_luminance) == (2, 0.0)


def test_sharpened():
    x = np.full((5, 5, 3), 100, np.uint8)
    assert (imaging.sharpened(x) == 100).all()
    x[2, 2] = 110
    assert imaging.sharpened(x)[2, 2, 0] == 150 and imaging.sharpened(x)[1, 2, 0] == 90


def test_config():
    assert imaging.merged_config(None) == imaging.DEFAULTS
    assert imaging.merged_config({"preprocess": {"enable_deskew": False, "other": 1}})["enable_deskew"] is False
    assert "other" not in imaging.merged_config({"other": 1, "clahe_lum_low": 50})


def test_steps(spark):
    rows = [(50.0, 0.0, 1.0, 1012, 638), (150.0, 0.05, None, 10, 10), (150.0, 0.0, 0.4, 1012, 638)]
    frame = spark.createDataFrame(rows, "mean_luminance double, bright_ratio double, angle double, w int, h int")
    got = [r.steps for r in imaging.clean_up_steps(frame).collect()]
    assert got == [["perspective_warp", "deskew", "clahe"], ["perspective_warp", "glare_removal", "resize"], ["perspective_warp"]]
    assert [r.steps for r in imaging.clean_up_steps(frame, {"enable_perspective_warp": False, "deskew_min_angle": 0.3}).collect()][2] == ["deskew"]


def test_augmentation(spark):
    images = spark.createDataFrame([(k, np.full((90, 90, 3), 100, np.uint8).tobytes(), 90, 90) for k in range(6)], "image_id bigint, content binary, h int, w int")
    none, every = (imaging.augment_plan(images, "image_id", 2, p) for p in (0, 100))
    assert {len(r.applied) for r in none.collect()} == {0} and {tuple(r.applied) for r in every.collect()} == {imaging.AUGMENTATIONS}
    some = imaging.augment_plan(images, "image_id", 3, names=tuple(imaging.PIXEL_FUNCTIONS))
    assert some.count() == 18 and len({tuple(r.applied) for r in some.collect()}) > 2
    made = {(r.image_id, r.variant): r for r in imaging.augmented(images, some).collect()}
    assert all((bytes(r.content) != np.full((90, 90, 3), 100, np.uint8).tobytes()) == bool(r.applied) for r in made.values())
    assert made == {(r.image_id, r.variant): r for r in imaging.augmented(images, some).collect()}
