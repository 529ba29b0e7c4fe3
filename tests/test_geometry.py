"""Boxes, match points and pictures against direct computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import geometry, intervals, match_points, movies, rendering


def image_rows(spark, images):
    rows = [(k, *a.shape, [float(v) for v in a.ravel()]) for k, a in enumerate(images)]
    return spark.createDataFrame(rows, "frame int, h int, w int, data array<float>")


def faded(image, axis, depth, first):
    out = image.astype(float).copy()
    ramp = np.array([0.5]) if depth == 1 else np.linspace(1, 0, depth) if first else np.linspace(0, 1, depth)
    part = slice(out.shape[axis] - depth, None) if first else slice(0, depth)
    if axis == 0:
        out[part] *= ramp[:, None]
    else:
        out[:, part] *= ramp[None, :]
    return out


@pytest.mark.parametrize("point", [((7, 2), (1, 4)), ((8, 4), (1, 2)), ((6, 3), (2, 3))])
@pytest.mark.parametrize("bright", [False, True])
def test_match_point_pair(spark, point, bright):
    pick = np.random.default_rng(1)
    a, b = pick.random((6, 8)) + 0.5, pick.random((6, 8)) + 0.5
    (xa, ya), (xb, yb) = point
    depth, across = 8 - xa + xb, yb - ya
    low_a, low_b = max(-across, 0), max(across, 0)
    n = min(6 - across, 6) - low_a
    ratio = a[low_a : low_a + n, 8 - depth :].mean() / b[low_b : low_b + n, :depth].mean() if bright else 1.0
    want = np.zeros((n, 16 - depth))
    want[:, :8] += faded(a[low_a : low_a + n], 1, depth, True)
    want[:, 8 - depth :] += ratio * faded(b[low_b : low_b + n], 1, depth, False)
    where = match_points.overlap("x", ((6, 8), (6, 8)), point)
    assert where.shape == want.shape
    pairs = image_rows(spark, [a, a]).withColumn("moving", F.array(*[F.lit(float(v)) for v in b.ravel()]))
    done = match_points.pair(pairs, where, bright)
    for r in done.collect():
        assert np.allclose(np.reshape(r.data, (r.h, r.w)), want, atol=1e-5)
    assert "Exchange" not in done._jdf.queryExecution().executedPlan().toString()
    dark = match_points.pair(pairs.withColumn("moving", F.transform("moving", lambda v: F.lit(0.0))), where, bright).first()
    assert np.isfinite(dark.data).all()


def test_seam_lines_and_bad_points():
    points = (((7, 1), (1, 1)), ((7, 1), (1, 1)), ((1, 7), (1, 1)))
    boxes = match_points.seam_lines((16, 16), points, 2)
    assert all(0 <= y0 < y1 <= 14 and 0 <= x0 < x1 <= 14 for y0, y1, x0, x1 in boxes) and len(boxes) == 3
    with pytest.raises(ValueError):
        match_points.overlap("x", ((6, 8), (6, 8)), ((8, 1), (0, 9)))
    with pytest.raises(ValueError):
        match_points.seam_lines((15, 16), points, 2)


def test_stripes():
    assert intervals.stripe(0, 10, 4) == (0, 4) and intervals.stripe(10, 10, 4) == (6, 10)
    assert intervals.stripe(5, 10, 4) == (3, 7) and intervals.stripe(1, 10, 4) == (0, 4) and intervals.stripe(9, 10, 4) == (6, 10)
    assert intervals.stripe_about(4.5, 10, 2) == (4, 6) and intervals.stripe_about(-9, 10, 2) == (0, 0)


def test_boxes(spark):
    one = spark.range(1)
    row = one.select(
        geometry.fit_window(geometry.box(F.lit(9), F.lit(2), F.lit(5), F.lit(6)), (20, 20)).alias("w"),
        geometry.window_about(F.lit(0.4), F.lit(18.6), (20, 20), 3).alias("p"),
        geometry.in_roi(F.lit(1), F.lit(1), F.lit(None).cast("struct<y0:int,y1:int,x0:int,x1:int>")).alias("none"),
        geometry.in_window(F.lit(2.0), F.lit(5.0), geometry.box(F.lit(0), F.lit(2), F.lit(0), F.lit(9))).alias("edge"),
        geometry.half_extents(F.lit(3.0), F.lit(1.0), F.lit(90.0), 2.0).alias("e"),
        geometry.common_crop(F.struct(F.lit(10).alias("h"), F.lit(7).alias("w")), F.struct(F.lit(6).alias("h"), F.lit(9).alias("w"))).alias("c"),
        geometry.final_offset(F.struct(F.lit(10.0).alias("y"), F.lit(2.0).alias("x")), F.lit(9.5), F.lit(7.0), (16, 16), (30, 40), "vertical").alias("o"),
    ).first()
    assert tuple(row.w) == (2, 9, 5, 9) and tuple(row.p) == (0, 4, 16, 20)
    assert row.none is False and row.edge is False
    assert row.e.h == pytest.approx(6) and row.e.w == pytest.approx(2)
    assert tuple(row.c) == (6, 7, 2, 0, 0, 1)
    assert tuple(row.o) == (11.5, 1.0, -18.5, 1.0)
    fits = one.select(geometry.ellipse_fits(F.lit(10.0), F.lit(10.0), geometry.half_extents(F.lit(3.0), F.lit(1.0), F.lit(0.0), 2.0), (20, 20)).alias("f")).first().f
    assert fits is True


def test_distances_and_fields(spark):
    pick = np.random.default_rng(2)
    points = pick.random((9, 11)) < 0.06
    points[4, 4] = True
    ys, xs = np.nonzero(points)
    want = [[min(math.hypot(y - a, x - b) for a, b in zip(ys, xs)) for x in range(11)] for y in range(9)]
    assert np.allclose(rendering.distance_to(points), want)
    df = spark.createDataFrame([("m", int(y), int(x), 2.5) for y, x in zip(ys, xs)], "metric string, y int, x int, v double")
    field = rendering.spatial_field(df, "v", (9, 11), 1.0).first()
    assert np.allclose(field["data"], 2.5, atol=1e-4)
    fine, medium, coarse = rendering.sigmas(50.0)
    assert fine < medium < coarse


def test_pictures(spark):
    image = np.arange(64.0).reshape(8, 8)
    gray = movies.pixels(movies.display_bytes(image_rows(spark, [image, np.full((8, 8), 3.0)]))).withColumnRenamed("v", "g")
    rows = gray.collect()
    assert {r.g for r in rows if r.frame == 1} == {0}
    shown = {(r.y, r.x): r.g for r in rows if r.frame == 0}
    assert shown[0, 0] == 0 and shown[7, 7] == 255
    back = rendering.rgb(gray).where("frame = 0").drop("frame")
    front = spark.createDataFrame([(5, 1, 1, 9, 0, 0), (6, 2, 2, 0, 0, 0)], "frame int, y int, x int, r int, g int, b int")
    over = {(r.frame, r.y, r.x): (r.r, r.g, r.b) for r in rendering.overlaid(back, front).collect()}
    assert over[5, 1, 1] == (9, 0, 0) and over[6, 2, 2] == (shown[2, 2],) * 3 and len(over) == 128
    deep = spark.createDataFrame([(0, 0, 0, 65535, 257, 385)], "frame int, y int, x int, r int, g int, b int")
    assert tuple(rendering.narrowed(deep).first())[3:] == (255, 1, 1)
