"""Decisions and geometry of image clean-up, and the plan of augmentations.

Decoding, warping, resampling and filters need an image library: they are plug-ins, functions
from bytes to bytes or to an array of pixels. What is decided about an image is here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CARD_W, CARD_H = 1012, 638
# The defaults of every step, and the augmentations in their order.
DEFAULTS = {
    "enable_perspective_warp": True, "enable_deskew": True, "enable_clahe": True, "enable_glare_removal": True, "enable_resize": True,
    "deskew_min_angle": 0.5, "clahe_clip_limit": 2.0, "clahe_tile_grid": [8, 8], "clahe_lum_low": 100, "clahe_lum_high": 200,
    "glare_threshold": 240, "glare_area_ratio": 0.02, "glare_inpaint_radius": 5,
}
AUGMENTATIONS = (
    "perspective_distort", "motion_blur", "jpeg_compress", "add_gaussian_noise", "brightness_contrast_shift",
    "shadow_overlay", "glare_patch", "fold_lines", "partial_occlusion",
)


def merged_config(config: dict | None, defaults: dict = DEFAULTS) -> dict:
    """Defaults overridden by a flat config, or by its ``preprocess`` part; unknown keys are dropped."""
    own = (config or {}).get("preprocess", config or {})
    return defaults | {k: v for k, v in own.items() if k in defaults}


def ordered_corners(points: Column) -> Column:
    """array<array<double>> of four corners as top left, top right, bottom right, bottom left; the first of equals counts."""

    def least(value) -> Column:
        best = F.array_min(F.transform(points, lambda p, i: F.struct(value(p).alias("v"), i.alias("i"), p.alias("p"))))
        return best["p"]

    add, turn = (lambda p: p[0] + p[1]), (lambda p: p[1] - p[0])
    return F.array(least(add), least(turn), least(lambda p: -add(p)), least(lambda p: -turn(p)))


def _edge(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow(a[0] - b[0], 2) + F.pow(a[1] - b[1], 2)).cast("int")


def warped_size(corners: Column) -> Column:
    """Width and height of the rectangle that ordered corners are warped to."""
    tl, tr, br, bl = (F.get(corners, F.lit(i)) for i in range(4))
    return F.struct(F.greatest(_edge(tl, tr), _edge(bl, br)).alias("width"), F.greatest(_edge(tl, bl), _edge(tr, br)).alias("height"))


def deskew_angles(segments: DataFrame, least: float = 0.5) -> DataFrame:
    """(image_id, x1, y1, x2, y2) to the median angle of near-horizontal segments, and whether it is worth a turn."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    near = segments.where(dx != 0).withColumn("angle", F.degrees(F.atan2(dy, dx))).where(F.abs("angle") < 45)
    return near.groupBy("image_id").agg(F.median("angle").alias("angle")).withColumn("turn", F.abs("angle") >= least)


def clean_up_steps(images: DataFrame, config: dict | None = None) -> DataFrame:
    """Add ``steps``: which steps a plug-in has to take for each image, in their order.

    images: mean_luminance, bright_ratio and angle (null if no line was found), w and h. Steps that
    change nothing are left out, so that only images in need of one reach the plug-in.
    """
    c = merged_config(config)
    step = lambda name, needed: F.when(F.lit(c[f"enable_{name}"]) & needed, F.lit(name))
    steps = F.array(
        step("perspective_warp", F.lit(True)),
        step("deskew", F.coalesce(F.abs("angle") >= c["deskew_min_angle"], F.lit(False))),
        step("clahe", wants_contrast(F.col("mean_luminance"), c["clahe_lum_low"], c["clahe_lum_high"])),
        step("glare_removal", wants_glare_removal(F.col("bright_ratio"), c["glare_area_ratio"])),
        step("resize", (F.col("w") != CARD_W) | (F.col("h") != CARD_H)),
    )
    return images.withColumn("steps", F.array_compact(steps))


def letterbox(width: Column, height: Column) -> Column:
    """Where an image of this size lies on the canonical card; halves round to even."""
    scale = F.least(CARD_W / width, CARD_H / height)
    new_w, new_h = F.bround(width * scale).cast("int"), F.bround(height * scale).cast("int")
    return F.struct(
        ((width == CARD_W) & (height == CARD_H)).alias("same"), new_w.alias("new_w"), new_h.alias("new_h"),
        F.floor((CARD_W - new_w) / 2).cast("int").alias("x_off"), F.floor((CARD_H - new_h) / 2).cast("int").alias("y_off"),
    )


def wants_contrast(mean_luminance: Column, low: float = 100.0, high: float = 200.0) -> Column:
    return ~mean_luminance.between(low, high)


def wants_glare_removal(bright_ratio: Column, most: float = 0.02) -> Column:
    return bright_ratio > most


def luminance(pixels: np.ndarray) -> np.ndarray:
    """Grey values of (h, w, 3) BGR pixels by the usual weights of video."""
    return pixels[..., 0] * 0.114 + pixels[..., 1] * 0.587 + pixels[..., 2] * 0.299


def lightness(pixels: np.ndarray) -> np.ndarray:
    """The L of CIE LAB for 8-bit BGR pixels, from 0 to 255."""
    c = pixels.astype(np.float64) / 255
    c = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    y = c[..., 0] * 0.072169 + c[..., 1] * 0.715160 + c[..., 2] * 0.212671
    return np.where(y > 0.008856, 116 * np.cbrt(y) - 16, 903.3 * y) * 255 / 100


def hue_saturation_value(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue from 0 to 179, saturation and value from 0 to 255."""
    b, g, r = (pixels[..., k].astype(np.float64) for k in range(3))
    v, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    d = v - low
    safe = np.where(d == 0, 1, d)
    h = np.where(v == r, 60 * (g - b) / safe, np.where(v == g, 120 + 60 * (b - r) / safe, 240 + 60 * (r - g) / safe))
    h = np.where(d == 0, 0, np.where(h < 0, h + 360, h)) / 2
    return np.rint(h) % 180, np.rint(np.where(v == 0, 0, 255 * d / np.where(v == 0, 1, v))), v


# Inclusive bounds of hue, saturation and value.
COLOURS = {"blue": ((90, 130), (100, 255), (50, 255)), "cream": ((10, 40), (20, 60), (150, 255)), "white": ((0, 179), (0, 35), (150, 255))}


def statistics(images: DataFrame, decode: Callable[[bytes], np.ndarray] | None = None) -> DataFrame:
    """(image_id, content, h, w) to size, mean luminance, bright ratio and colour ratios.

    content: raw BGR pixels, or whatever ``decode`` turns into an array of them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                x = decode(row.content) if decode else np.frombuffer(row.content, np.uint8).reshape(row.h, row.w, 3)
                hsv = hue_saturation_value(x)
                shares = {name: float(np.mean(np.all([(c >= a) & (c <= b) for c, (a, b) in zip(hsv, bounds, strict=True)], axis=0))) for name, bounds in COLOURS.items()}
                out.append((row.image_id, x.shape[0], x.shape[1], float(luminance(x).mean()), float((lightness(x) > 240).mean()), shares["blue"], shares["cream"], shares["white"]))
            yield pd.DataFrame(out, columns=["image_id", "h", "w", "mean_luminance", "bright_ratio", "blue", "cream", "white"])

    kind = dict(images.dtypes)["image_id"]
    return images.mapInPandas(run, f"image_id {kind}, h int, w int, mean_luminance double, bright_ratio double, blue double, cream double, white double")


def sharpened(pixels: np.ndarray) -> np.ndarray:
    """Each pixel five times less its four neighbours; edges mirrored without the edge itself."""
    x = np.pad(pixels.astype(np.int32), ((1, 1), (1, 1), (0, 0)), mode="reflect")
    out = 5 * x[1:-1, 1:-1] - x[:-2, 1:-1] - x[2:, 1:-1] - x[1:-1, :-2] - x[1:-1, 2:]
    return np.clip(out, 0, 255).astype(np.uint8)


def augment_plan(images: DataFrame, key: str, variants: int, percent: int = 50, names: tuple[str, ...] = AUGMENTATIONS) -> DataFrame:
    """(key, variant, applied): which augmentations each variant gets, in their order; the same for the same key.

    A coin is the remainder by 100 of a product of key, variant and the augmentation's place.
    """
    seed = F.pmod(F.col(key) * 7919 + F.col("variant") * 104729, F.lit(1_000_003))
    coins = [F.when(F.pmod(seed * (2 * i + 3) + i * 613, F.lit(9973)) % 100 < percent, F.lit(name)) for i, name in enumerate(names)]
    each = images.select(key, F.explode(F.sequence(F.lit(1), F.lit(variants))).alias("variant"))
    return each.select(key, "variant", F.array_compact(F.array(*coins)).alias("applied"))


def noisy(pixels: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Gaussian noise of a deviation from 5 to 20."""
    return np.clip(pixels + rng.normal(0, rng.uniform(5, 20), pixels.shape), 0, 255).astype(np.uint8)


def shifted(pixels: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Brightness by up to 30 either way, contrast by a fifth."""
    return np.clip(np.rint(np.abs(pixels * rng.uniform(0.8, 1.2) + rng.integers(-30, 31))), 0, 255).astype(np.uint8)


def occluded(pixels: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """One to three black rectangles of 20 to 80 pixels a side."""
    out = pixels.copy()
    h, w = out.shape[:2]
    for _ in range(rng.integers(1, 4)):
        ow, oh = min(w, int(rng.integers(20, 81))), min(h, int(rng.integers(20, 81)))
        x, y = int(rng.integers(0, w - ow + 1)), int(rng.integers(0, h - oh + 1))
        out[y : y + oh, x : x + ow] = 0
    return out


#: Augmentations that need no image library; others are passed in by name.
PIXEL_FUNCTIONS: dict[str, Callable[[np.ndarray, np.random.Generator], np.ndarray]] = {
    "add_gaussian_noise": noisy,
    "brightness_contrast_shift": shifted,
    "partial_occlusion": occluded,
}


def augmented(images: DataFrame, plan: DataFrame, functions: dict | None = None) -> DataFrame:
    """(image_id, content, h, w) and a plan (image_id, variant, applied) to the variants' pixels, seeded by both.

    A name in the plan without a function fails: pass one for each that the plan uses.
    """
    known = PIXEL_FUNCTIONS | (functions or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                x = np.frombuffer(row.content, np.uint8).reshape(row.h, row.w, 3)
                rng = np.random.default_rng([int(row.image_id), int(row.variant)])
                for name in row.applied:
                    x = known[name](x, rng)
                out.append((row.image_id, row.variant, list(row.applied), x.tobytes()))
            yield pd.DataFrame(out, columns=["image_id", "variant", "applied", "content"])

    joined = images.select("image_id", "content", "h", "w").join(plan.select("image_id", "variant", "applied"), "image_id")
    return joined.mapInPandas(run, "image_id bigint, variant int, applied array<string>, content binary")
