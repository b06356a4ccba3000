"""Kernels on synthetic rasters with known boxes, shifts and alpha."""

import numpy as np

from larkspur.functions import raster as R


def test_boxes_and_aspect():
    r = np.full((40, 60, 4), 255, np.uint8)
    r[10:20, 15:45, :3] = 10
    assert R.content_box(r) == (15, 10, 30, 10)
    r[:, :, 3] = 0
    r[12:18, 20:30, 3] = 255
    assert R.alpha_box(r) == (20, 12, 10, 6)
    assert R.content_box(np.full((5, 7, 3), 255, np.uint8)) == (0, 0, 7, 5)
    assert R.fit_aspect(R.Box(0, 0, 100, 50), 1.0) == (25, 0, 50, 50)
    assert R.fit_aspect(R.Box(0, 0, 100, 98), 1.0) == (0, 0, 100, 98)
    out = R.restore_margins(np.full((20, 20, 3), 9, np.uint8), (20, 30), R.Box(5, 10, 10, 10))
    assert out.shape == (60, 40, 4) and out[20:40, 10:30, 3].min() == 255 and out[:20, :, 3].max() == 0


def test_transparency_and_median():
    r = np.full((10, 10, 4), 255, np.uint8)
    r[:1, :3, 3] = 0
    assert R.transparent_share(r) == 0.03 and R.meaningfully_transparent(r)
    assert R.upper_median(np.array([4.0, 1.0, 3.0, 2.0])) == 3.0


def _two_up(h=160, w=200, dy=3):
    rng = np.random.default_rng(4)
    alpha = np.zeros((h, w))
    colour = np.zeros((h, w, 3))
    alpha[40:120, 60:140] = 1.0
    alpha[60:80, 80:120] = 0.5
    colour[40:120, 60:140] = rng.integers(40, 220, (80, 80, 3))
    on = lambda level: alpha[:, :, None] * colour + (1 - alpha[:, :, None]) * level
    return np.r_[on(0), np.roll(on(255), -dy, 0)].round().astype(np.uint8), alpha


def test_shift_and_alpha():
    picture, alpha = _two_up()
    h = len(picture) // 2
    assert abs(R.split_row(picture) - h) <= 3
    dy, dx, corr = R.estimated_shift(picture[:h], picture[h:])
    assert abs(dy - 3) < 0.6 and abs(dx) < 0.6 and corr > 0.5
    out = R.recovered_alpha(picture)
    assert out is not None and abs((out[:, :, 3] > 250).sum() - (alpha == 1).sum()) < 900
    assert R.recovered_alpha(np.zeros((100, 100, 3), np.uint8)) is None


def test_dimensions():
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (7).to_bytes(4, "big") + (9).to_bytes(4, "big")
    gif = b"GIF89a" + (5).to_bytes(2, "little") + (6).to_bytes(2, "little")
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x0a\x00\x0c\x03"
    assert (R.dimensions(png), R.dimensions(gif), R.dimensions(jpeg), R.dimensions(b"x")) == ((7, 9), (5, 6), (12, 10), None)


def test_udfs(spark):
    r = np.full((8, 8, 3), 255, np.uint8)
    r[2:4, 3:7] = 0
    df = spark.createDataFrame([(bytearray(r.tobytes()), 8, 8, 3)], "data binary, width int, height int, channels int")
    from pyspark.sql import functions as F

    row = df.select(R.content_box_of(F.struct("data", "width", "height", "channels")).alias("b")).first()["b"]
    assert tuple(row) == (3, 2, 4, 2)
