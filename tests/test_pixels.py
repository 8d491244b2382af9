import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import imaging, pixels
from scriptorium.sources import documents


def solid(h, w, *bgr):
    return np.tile(np.array(bgr, np.uint8), (h, w, 1))


def scene(angle=0.0, w=400, h=250, frame=(500, 700)):
    """A light card with dark lines of text, turned about the middle of a dark table."""
    card = solid(h, w, 225, 230, 235)
    card[40:210:34, 30:370] = 30
    card[42:210:34, 30:370] = 30
    turned = np.full((*frame, 3), 40, np.uint8)
    gx, gy = np.meshgrid(np.arange(frame[1]), np.arange(frame[0]))
    a = np.radians(angle)
    u = (gx - frame[1] / 2) * np.cos(a) + (gy - frame[0] / 2) * np.sin(a) + w / 2
    v = (gy - frame[0] / 2) * np.cos(a) - (gx - frame[1] / 2) * np.sin(a) + h / 2
    inside = (u >= 0) & (u < w) & (v >= 0) & (v < h)
    turned[inside] = pixels.sampled(card, u, v, True)[inside]
    return turned


def test_homography_takes_corners_to_corners():
    a, b = np.array([[0, 0], [9, 0], [9, 5], [0, 5]], float), np.array([[3, 1], [20, 4], [18, 13], [1, 11]], float)
    m = pixels.homography(a, b)
    for p, q in zip(a, b, strict=True):
        x = m @ [*p, 1]
        assert x[:2] / x[2] == pytest.approx(q)


def test_warp_straightens_a_quadrangle():
    x = solid(60, 80, 0, 0, 0)
    x[10:40, 20:70] = (10, 20, 30)
    out = pixels.warped(x, np.array([[20, 10], [69, 10], [69, 39], [20, 39]], float))
    assert out.shape == (29, 49, 3) and (out == (10, 20, 30)).all()


@pytest.mark.parametrize("angle", [0.0, 3.0, -5.0])
def test_boundary_and_skew(angle):
    x = scene(angle)
    corners = pixels.boundary(x)
    assert corners is not None
    edge = lambda a, b: np.hypot(*(corners[a] - corners[b]))
    assert edge(0, 1) == pytest.approx(400, abs=25) and edge(0, 3) == pytest.approx(250, abs=25)
    got = pixels.skew(x)
    assert got is not None and got == pytest.approx(angle, abs=0.5)
    if angle:
        assert abs(pixels.skew(pixels.rotated(x, angle))) < 0.5
    assert pixels.boundary(solid(50, 80, 7, 7, 7)) is None and pixels.skew(solid(50, 80, 7, 7, 7)) is None
    full = solid(100, 160, 200, 200, 200)
    full[:3], full[-3:], full[:, :3], full[:, -3:] = 0, 0, 0, 0
    assert pixels.boundary(full) is None  # a card that fills the frame


def test_components_and_hull_against_plain():
    rng = np.random.default_rng(1)
    for _ in range(20):
        mask = rng.random((12, 15)) < 0.4
        got, want, name = pixels.components(mask), np.zeros(mask.shape, int), 0
        for start in zip(*np.nonzero(mask), strict=True):
            if not want[start]:
                name, queue = name + 1, [start]
                want[start] = name
                while queue:
                    y, x = queue.pop()
                    for p in ((y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)):
                        if 0 <= p[0] < 12 and 0 <= p[1] < 15 and mask[p] and not want[p]:
                            want[p] = name
                            queue.append(p)
        assert len(set(zip(got[mask].tolist(), want[mask].tolist(), strict=True))) == name and (got[~mask] == 0).all()
        points = rng.integers(0, 9, (12, 2))
        box = pixels.smallest_rectangle(points)
        best = min(np.ptp(points @ [np.cos(a), np.sin(a)]) * np.ptp(points @ [-np.sin(a), np.cos(a)]) for a in np.radians(np.arange(0, 180, 0.05)))
        assert np.hypot(*(box[1] - box[0])) * np.hypot(*(box[2] - box[1])) <= best + 1e-6
    around = pixels._window(mask, 3, True)
    assert all(around[y, x] == mask[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].any() for y in range(12) for x in range(15))


def test_resampling():
    x = solid(30, 50, 9, 99, 199)
    assert (pixels.resized(x, 17, 90) == (9, 99, 199)).all() and pixels.resized(x, 50, 30).shape == x.shape
    ramp = np.repeat(np.arange(0, 200, 2, dtype=np.uint8)[None, :, None], 3, 2).repeat(20, 0)
    assert np.abs(pixels.resized(ramp, 200, 20)[5, 20:-20, 0].astype(int) - (np.arange(20, 180) + 0.5) + 1).max() <= 1
    out = pixels.letterboxed(solid(638, 506, 0, 0, 0))
    assert out.shape == (638, 1012, 3) and (out[:, :253] == 255).all() and (out[:, 253:759] == 0).all() and (out[:, 759:] == 255).all()
    same = solid(638, 1012, 1, 2, 3)
    assert pixels.letterboxed(same) is same


def test_equalisation():
    rng = np.random.default_rng(2)
    dim = rng.integers(40, 60, (120, 160)).astype(np.uint8)
    out = pixels.equalised_levels(dim)
    assert out.std() > dim.std() and out.shape == dim.shape
    x = np.stack([dim, dim + 10, dim + 20], axis=-1)
    lab, after = pixels._to_lab(x), pixels._to_lab(pixels.equalised(x))
    assert np.abs(lab[..., 1:] - after[..., 1:]).mean() < 2 < np.abs(lab[..., 0] - after[..., 0]).mean()
    assert np.abs(pixels._from_lab(lab).astype(int) - x).max() <= 1
    # one tile without a limit is the plain equalisation
    plain = np.rint(np.cumsum(np.bincount(dim.ravel(), minlength=256)) * 255 / dim.size).astype(np.uint8)[dim]
    assert (pixels.equalised_levels(dim, clip=1e9, grid=(1, 1)) == plain).all()


def test_glare():
    x = solid(80, 80, 100, 120, 140)
    few = x.copy()
    few[0:5, 0:5] = 255
    assert pixels.without_glare(few) is few  # 0.4 %
    x[20:40, 30:60] = 255
    out = pixels.without_glare(x)
    assert (out == (100, 120, 140)).all()
    assert (pixels.filled_in(x, np.ones((80, 80), bool)) == x).all()


def test_clean_up(spark):
    light = scene(4.0)
    dark = (light * 0.3).astype(np.uint8)
    rows = [(k, x.tobytes(), *x.shape[:2]) for k, x in enumerate((light, dark, solid(638, 1012, 150, 150, 150)))]
    frame = spark.createDataFrame(rows, "image_id bigint, content binary, h int, w int")
    got = {r.image_id: r for r in pixels.cleaned(frame).collect()}
    assert got[2].steps == [] and bytes(got[2].content) == rows[2][1]
    assert got[0].steps[0] == "perspective_warp" and got[0].steps[-1] == "resize" and "clahe" in got[1].steps
    assert all((r.h, r.w) == (638, 1012) and len(r.content) == 638 * 1012 * 3 for r in got.values())
    card = np.frombuffer(got[0].content, np.uint8).reshape(638, 1012, 3)
    assert abs(pixels.skew(card) or 0) < 1
    off = {f"enable_{k}": False for k in ("perspective_warp", "deskew", "clahe", "glare_removal", "resize")}
    assert all(bytes(r.content) == rows[r.image_id][1] and r.steps == [] for r in pixels.cleaned(frame, off).collect())
    assert pixels.cleaned(frame.limit(0)).count() == 0


def test_second_readings(spark):
    x = scene(0.0, 60, 30, (40, 80))
    rows = [(1, 0.5, True, x), (2, 0.8, False, x), (3, 0.8, True, x), (4, 0.95, False, x), (5, 0.8, False, x[:15]), (6, 0.1, False, x[:3])]
    crops = spark.createDataFrame([(i, "uid", c, v, y.tobytes(), *y.shape[:2]) for i, c, v, y in rows], "id bigint, field_name string, conf double, is_valid boolean, content binary, h int, w int")
    got = {r.id: r for r in pixels.second_views(crops, read=lambda y: (f"{y.shape[0]}x{y.shape[1]}", 0.75)).collect()}
    assert {i: (r.view, r.retry_raw, r.retry_conf) for i, r in got.items()} == {1: ("sharpened", "40x80", 0.75), 2: ("inset", "30x70", 0.75), 6: ("sharpened", "3x80", 0.75)}
    assert bytes(got[2].content) == x[5:-5, 5:-5].tobytes() and bytes(got[1].content) == imaging.sharpened(x).tobytes()
    assert pixels.second_views(crops).where("retry_raw is null").count() == 3


def test_augmentations(spark):
    assert set(pixels.AUGMENT) == set(imaging.AUGMENTATIONS)
    x = scene(2.0, 200, 120, (200, 300))
    for name, f in pixels.AUGMENT.items():
        for seed in range(6):
            out = f(x, np.random.default_rng(seed))
            assert out.shape == x.shape and out.dtype == np.uint8 and (out == f(x, np.random.default_rng(seed))).all(), name
            assert (out != x).any() or name == "shadow_overlay"
    images = spark.createDataFrame([(k, x.tobytes(), 200, 300) for k in range(4)], "image_id bigint, content binary, h int, w int")
    plan = imaging.augment_plan(images, "image_id", 3)
    made = {(r.image_id, r.variant): r for r in pixels.varied(images, plan).collect()}
    assert len(made) == 12 and all((bytes(r.content) == x.tobytes()) == (not set(r.applied) - {"shadow_overlay"}) or r.applied for r in made.values())
    assert made == {(r.image_id, r.variant): r for r in pixels.varied(images.repartition(3), plan).collect()}
    log = pixels.augmentation_log(plan, 0.5).where("file = 'image_2_v3.jpg'").first()
    assert (log.source, log.severity_params.p, log.augmentations_applied) == ("image_2", 0.5, made[2, 3].applied)


def test_single_augmentations():
    x = solid(90, 120, 100, 100, 100)
    fold = pixels.folded(x, np.random.default_rng(0)).astype(int) - 100
    assert fold.min() == 0 and 40 <= fold.max() <= 100
    assert (pixels.shadowed(x, np.random.default_rng(1)) <= 100).all() and (pixels.glaring(x, np.random.default_rng(1)) >= 100).all()
    assert (pixels.motion_blurred(x, np.random.default_rng(2)) == 100).all()
    spot = np.zeros((41, 41, 3), np.uint8)
    spot[20, 20] = 252
    blurred = pixels.motion_blurred(spot, np.random.default_rng(3))
    lit = (blurred > 0).any(2).sum()
    assert 3 <= lit <= 7 and blurred.max() == np.rint(252 / lit)
    assert np.abs(pixels.jpeg_like(x, 95).astype(int) - 100).max() <= 1
    rough = np.random.default_rng(4).integers(0, 256, (40, 43, 3)).astype(np.uint8)
    error = [np.abs(pixels.jpeg_like(rough, q).astype(int) - rough).mean() for q in (95, 70, 40)]
    assert error[0] < error[1] < error[2]
    square = pixels.in_polygon(np.array([[2, 2], [8, 2], [8, 6], [2, 6]]), 10, 10)
    assert square.sum() == 24 and square[3, 5] and not square[7, 5]


def test_descriptor(spark):
    """Against cells and blocks taken one by one."""
    rng = np.random.default_rng(5)
    for x in (rng.integers(0, 256, (32, 32)).astype(np.uint8), np.tile(np.arange(0, 256, 8, dtype=np.uint8), (32, 1)), np.zeros((32, 32), np.uint8)):
        g = x.astype(float)
        cells = np.zeros((8, 8, 8))
        for i in range(32):
            for j in range(32):
                gy = g[i + 1, j] - g[i - 1, j] if 0 < i < 31 else 0.0
                gx = g[i, j + 1] - g[i, j - 1] if 0 < j < 31 else 0.0
                cells[i // 4, j // 4, int(np.degrees(np.arctan2(gy, gx)) % 180 // 22.5) % 8] += np.hypot(gx, gy) / 16
        want = []
        for i in range(7):
            for j in range(7):
                v = cells[i : i + 2, j : j + 2].ravel()
                v = np.minimum(v / np.sqrt((v**2).sum() + 1e-5**2), 0.2)
                want += (v / np.sqrt((v**2).sum() + 1e-5**2)).tolist()
        assert pixels.oriented_gradients(x) == pytest.approx(want, abs=1e-9)
    frame = spark.createDataFrame([(1, solid(40, 50, 1, 2, 3).tobytes(), 40, 50)], "image_id bigint, content binary, h int, w int")
    assert len(pixels.described(frame).first().vector) == 1568


def test_position_marks():
    from scriptorium.queries import _code_like

    for module in (2, 3, 5):
        x = solid(300, 600, 240, 240, 240)
        _code_like(x, 420, 130, module, module)
        size = 25 * module
        found = pixels.position_marks(x)
        middles = [(420 + 3.5 * module, 130 + 3.5 * module), (420 + size - 3.5 * module, 130 + 3.5 * module), (420 + 3.5 * module, 130 + size - 3.5 * module)]
        assert all(any(np.hypot(m[0] - a, m[1] - b) < module and abs(m[2] - module) < 0.5 for m in found) for a, b in middles)
        assert pixels.has_qr(x) and not pixels.has_qr(x[:, ::-1].copy())  # on the left half it isn't looked for
        turned = solid(400, 700, 240, 240, 240)
        turned[50:350, 50:650] = pixels.rotated(x, 0)
        assert pixels.has_qr(pixels.rotated(turned, 4.0)) or module < 3
    rng = np.random.default_rng(0)
    assert not any(pixels.has_qr(rng.integers(0, 2, (200, 300, 1)).repeat(3, 2).astype(np.uint8) * 255) for _ in range(3))
    assert not pixels.has_qr(scene()) and not pixels.has_qr(solid(50, 60, 9, 9, 9))


def png(*chunks):
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in chunks)


HEADER = (b"IHDR", struct.pack(">IIBBBBB", 2, 1, 8, 2, 0, 0, 0))
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x02\x00\x03\x01\x01\x11\x00\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00data\xff\xd9"


@pytest.mark.parametrize(
    ("raw", "error"),
    [
        (png(HEADER, (b"IDAT", b"x"), (b"IEND", b"")), None), (png(HEADER, (b"IEND", b"")), "no image data"), (png((b"IDAT", b"x"), (b"IEND", b"")), "no image header"), (png(HEADER, (b"IDAT", b"x")), "no end"),
        (png(HEADER, (b"IDAT", b"x"), (b"IEND", b""))[:-3], "chunk cut off"), (png(HEADER, (b"IDAT", b"xyz"), (b"IEND", b"")).replace(b"xyz", b"xyy"), "checksum of a chunk"), (b"", "unknown format"),
        (JPEG, None), (JPEG[:20], "segment cut off"), (b"\xff\xd8\xff\xd9", "segment cut off"), (JPEG.replace(b"\xff\xc0", b"\xff\xfe"), "no frame header"), (b"\xff\xd8ab" + JPEG, "no marker"), (b"\xff\xd8" + b"\xff" * 5 + JPEG[3:], None),
    ],
)
def test_integrity(raw, error):
    assert pixels.image_error(raw) == error


def test_integrity_as_a_guard(spark):
    rows = [(1, png(HEADER, (b"IDAT", b"x"), (b"IEND", b""))), (2, png(HEADER)), (3, JPEG), (4, None), (5, b"%PDF-1 %%EOF")]
    frame = spark.createDataFrame(rows, "k int, content binary")
    got = {r.k: r.reject_reason for r in documents.checked(frame, is_whole_image=pixels.is_whole_image(F.col("content"))).collect()}
    assert got == {1: None, 2: "corrupt_file", 3: None, 4: "ingest", 5: None}
