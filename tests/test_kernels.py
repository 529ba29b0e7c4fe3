"""Array kernels, timing, iterative operators and files, against independent computations."""

import math
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae import schemas
from tesserae.functions import arrays, kinetics
from tesserae.operators import footprints, intervals, kernels, movies, neighbours, patches, quality, stitching, traces
from tesserae.sources import params, tiff
from tesserae.streaming import incremental


def image_rows(spark, images):
    rows = [(k, *a.shape, [float(v) for v in a.ravel()]) for k, a in enumerate(images)]
    return spark.createDataFrame(rows, "frame int, h int, w int, data array<float>")


def as_image(rows, h, w):
    out = np.zeros((h, w))
    for r in rows:
        out[r.y, r.x] = r.v
    return out


def test_phase_correlation_finds_the_shift(spark):
    pick = np.random.default_rng(0)
    base = kernels.gaussian_blur(pick.standard_normal((64, 64)), 2)
    moved = np.roll(base, (-5, 3), (0, 1))
    df = image_rows(spark, [base]).withColumn("moving", F.array(*[F.lit(float(v)) for v in moved.ravel()]))
    corr = np.array(kernels.phase_correlation(df).first()["corr"]).reshape(64, 64)
    assert np.unravel_index(corr.argmax(), corr.shape) == (32 + 5, 32 - 3)
    fit = kernels.peak_fits(kernels.phase_correlation(df).withColumnRenamed("corr", "data")).first()
    assert abs(fit.offset_y - 5) < 0.2 and abs(fit.offset_x + 3) < 0.2


def test_peak_fit_recovers_a_gaussian():
    yy, xx = np.mgrid[0:41, 0:41].astype(float)
    true = np.array([2.0, 19.3, 21.6, math.log(2.0), math.log(3.5), 0.5, 0.1])
    got = kernels.fit_peak(kernels.gaussian_peak(true, yy, xx), (8, 33, 8, 33))
    assert abs(got["centre_y"] - 19.3) < 1e-3 and abs(got["centre_x"] - 21.6) < 1e-3
    assert abs(got["sigma_y"] - 2) < 1e-2 and abs(got["sigma_x"] - 3.5) < 1e-2 and abs(got["rho"] - 0.98 * math.tanh(0.5)) < 1e-2
    assert kernels.fit_peak(np.zeros((9, 9)), (0, 9, 0, 9))["peak_y"] == 0


def test_blur_band_pass_and_ridges():
    pick = np.random.default_rng(1)
    image = pick.random((20, 30))
    spike = np.zeros((31, 31))
    spike[15, 15] = 1
    out = kernels.gaussian_blur(spike, 1.5)
    assert abs(out.sum() - 1) < 1e-9 and np.allclose(out, out.T) and out.argmax() == 15 * 31 + 15
    assert np.allclose(kernels.gaussian_blur(np.full((9, 9), 3.0), 2), 3)
    assert np.allclose(kernels.band_passed(np.full((20, 30), 7.0)), 7.0)
    assert kernels.band_passed(image).shape == image.shape
    line = np.ones((40, 40))
    line[20] = 0
    ridges = kernels.ridge_response(line, (1.0, 2.0))
    assert ridges[20, 5:35].min() > 5 * ridges[10, 5:35].max() + 0.1
    kept, threshold = kernels.strongest(ridges, 10)
    assert threshold > 0 and kept.max() > 0 and kernels.strongest(np.zeros((3, 3)), 10)[1] == 0


def timing(g0, g1, dt=0.1):
    disc = g0 * g0 + 4 * g1
    if disc <= 0:
        return None
    a, b = (g0 + math.sqrt(disc)) / 2, (g0 - math.sqrt(disc)) / 2
    if not (0 < a < 1 and 0 < b < 1):
        return None
    slow, fast = -dt / math.log(a), -dt / math.log(b)
    k = lambda t: math.exp(-t / slow) - math.exp(-t / fast)
    peak = fast * slow / (slow - fast) * math.log(slow / fast)
    lo, hi = peak, peak + 20 * slow
    for _ in range(120):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if k(mid) > k(peak) / 2 else (lo, mid)
    return 1000 * peak, 1000 * ((lo + hi) / 2 - peak)


def test_kernel_timing(spark):
    pick = random.Random(4)
    rows = [(k, pick.uniform(0, 2), pick.uniform(-1, 0.2)) for k in range(200)] + [(900, 1.7, -0.7125), (901, float("nan"), 0.1), (902, 1.9, -0.9)]
    got = {r.k: r for r in kinetics.with_timing(spark.createDataFrame(rows, "k int, g_0 double, g_1 double")).collect()}
    for k, g0, g1 in rows:
        want = timing(g0, g1) if g0 == g0 else None
        if want is None:
            assert math.isnan(got[k].t_peak) and math.isnan(got[k].t_half)
        else:
            assert got[k].t_peak == pytest.approx(want[0], rel=1e-9) and got[k].t_half == pytest.approx(want[1], rel=1e-7)


def bilinear(image, dy, dx):
    h, w = image.shape
    out, support = np.zeros((h, w)), np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            sy, sx = y - dy, x - dx
            if sy < 0 or sx < 0:
                continue
            y0, x0 = math.ceil(sy - 1e-12) - (dy > 0), math.ceil(sx - 1e-12) - (dx > 0)
            y0, x0 = max(y0, 0), max(x0, 0)
            fy, fx = sy - y0, sx - x0
            v = lambda a, b: image[min(a, h - 1), min(b, w - 1)]
            out[y, x] = (1 - fy) * ((1 - fx) * v(y0, x0) + fx * v(y0, x0 + 1)) + fy * ((1 - fx) * v(y0 + 1, x0) + fx * v(y0 + 1, x0 + 1))
            support[y, x] = 1
    return out, support


@pytest.mark.parametrize("offset", [(5.0, -2.0), (5.25, 0.5), (-3.5, 4.0), (0.0, 7.0), (30.0, 0.0)])
@pytest.mark.parametrize("axis", ["vertical", "horizontal"])
def test_blending(spark, offset, axis):
    pick = np.random.default_rng(2)
    a, b = pick.random((8, 9)), pick.random((8, 9))
    y0, y1, x0, x1 = stitching.canvas(a.shape, b.shape, offset)
    (iy, fy), (ix, fx) = stitching.split_offset(offset[0]), stitching.split_offset(offset[1])
    m, s = bilinear(b, fy, fx)
    big = [np.zeros((y1 - y0, x1 - x0)) for _ in range(4)]
    big[0][-y0 : -y0 + 8, -x0 : -x0 + 9], big[1][-y0 : -y0 + 8, -x0 : -x0 + 9] = a, 1
    big[2][iy - y0 : iy - y0 + 8, ix - x0 : ix - x0 + 9], big[3][iy - y0 : iy - y0 + 8, ix - x0 : ix - x0 + 9] = m, s
    both = (big[1] > 1e-6) & (big[3] > 1e-6)
    want = (big[0] + big[2]) / np.maximum(big[1] + big[3], 1e-6)
    if both.any():
        at = np.nonzero(both)[0 if axis == "vertical" else 1]
        n = at.max() - at.min() + 1
        ramp = np.array([0.5]) if n == 1 else np.linspace(1, 0, n)
        for y, x in zip(*np.nonzero(both)):
            alpha = ramp[(y if axis == "vertical" else x) - at.min()]
            want[y, x] = (big[0][y, x] * alpha + big[2][y, x] * (1 - alpha)) / max(big[1][y, x] * alpha + big[3][y, x] * (1 - alpha), 1e-6)
    pair = image_rows(spark, [a]).withColumn("moving", F.array(*[F.lit(float(v)) for v in b.ravel()]))
    got = stitching.blended(pair, (a.shape, b.shape), offset, axis).first()
    assert (got.h, got.w) == want.shape and np.allclose(np.reshape(got.data, want.shape), want, atol=1e-6)


def test_mosaic_and_its_plan(spark):
    pick = np.random.default_rng(7)
    image = pick.random((20, 24))
    df = image_rows(spark, [image, image + 1])
    flat = {"left": (10.0, 0.0), "right": (10.0, 0.0), "final": (0.0, 12.0)}
    out = stitching.stitched(df, (20, 24), flat)
    want = np.block([[np.rot90(image[y : y + 10, x : x + 12], 2) for x in (0, 12)] for y in (0, 10)])
    assert np.allclose(np.reshape(out.where("frame = 0").first().data, (20, 24)), want, atol=1e-6)
    box = stitching.stitched(df, (20, 24), flat, {"left": (1, 19, 0, 12), "right": (1, 19, 0, 12), "final": (0, 18, 2, 20)}).where("frame = 0").first()
    assert (box.h, box.w) == (18, 18) and np.allclose(np.reshape(box.data, (18, 18)), want[1:19, 2:20], atol=1e-6)
    pair = df.withColumn("moving", F.col("data"))
    for one in (out, stitching.averaged(pair, ((20, 24), (20, 24)), (3.5, 2.0)), stitching.shifted(df, (20, 24), 0.5, 0.5), stitching.largest_rectangle(df)):
        plan = one._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
    with pytest.raises(ValueError):
        stitching.stitched(df, (19, 24), flat)
    gaps = stitching.shifted(df.unionByName(df.limit(1).withColumns({"frame": F.lit(9), "data": F.lit(None).cast("array<float>")})), (20, 24), 0.5, 0)
    assert {r.frame: r.data is None for r in gaps.collect()} == {0: False, 1: False, 9: True}
    with pytest.raises(Exception, match="20 x 20"):
        stitching.shifted(df, (20, 20), 0.5, 0).count()


def test_largest_rectangle(spark):
    pick = np.random.default_rng(6)
    masks = [pick.random((7, 9)) < p for p in (0.9, 0.7, 0.5, 0.8, 1.1)]
    df = image_rows(spark, [m.astype(float) for m in [*masks, np.zeros((7, 9), bool)]])
    got = {r.frame: r for r in stitching.largest_rectangle(df).collect()}
    assert len(got) == len(masks)
    for k, m in enumerate(masks):
        best = max((y1 - y0) * (x1 - x0) for y0 in range(7) for y1 in range(y0 + 1, 8) for x0 in range(9) for x1 in range(x0 + 1, 10) if m[y0:y1, x0:x1].all())
        r = got[k]
        assert m[r.y0 : r.y1, r.x0 : r.x1].all() and (r.y1 - r.y0) * (r.x1 - r.x0) == best
    assert stitching.crop_bounds(((8, 8), (8, 8)), (5.0, -2.0), spark) == (0, 13, 2, 8)


def test_spans_and_seam_specs(spark):
    assert intervals.spans(100, [30, 33, 60], 10) == [(0, 30), (30, 60), (60, 100)] or intervals.spans(100, [30, 33, 60], 10) == [(0, 33), (33, 60), (60, 100)]
    assert intervals.spans(100, [3], 10) == [(0, 100)] and intervals.spans(0, [], 5) == [] and intervals.spans(10, [], 50) == [(0, 10)]
    assert intervals.spans(30, [10, 14, 24], 5) == [(0, 14), (14, 24), (24, 30)]
    pick = np.random.default_rng(12)
    for _ in range(300):  # merged one by one, as the rule says
        cuts = pick.integers(-3, 45, pick.integers(0, 12)).tolist()
        own = np.diff([0, *sorted({c for c in cuts if 0 < c < 40}), 40]).tolist()
        while len(own) > 1 and min(own) < 7:
            k = next(i for i, w in enumerate(own) if w < 7)
            near = [i for i in (k - 1, k + 1) if 0 <= i < len(own)]
            to = min(near, key=lambda i: (own[i], i))
            own[min(k, to) : max(k, to) + 1] = [own[k] + own[to]]
        assert [b - a for a, b in intervals.spans(40, cuts, 7)] == own
    h = w = 60
    half = lambda c: F.expr(f"cast({c} div 30 as int)")
    supports = spark.range(h * w).select(F.expr(f"cast(id div {w} as int)").alias("y"), F.expr(f"cast(id % {w} as int)").alias("x")).select(half("y").alias("quadrant_row"), half("x").alias("quadrant_col"), "y", "x")
    specs = patches.seam_specs(spark, supports, patches.seam_masks(spark, h, w, 12, 2), h, w, 2, 0.8, 5)
    assert patches.covers_once(specs, h, w) and not patches.has_holes(specs, h, w)
    names = {r.name: (r.y0, r.y1) for r in specs.collect()}
    assert names["0-0-0-0"] == (0, 12) and names["1-1-1-1"][0] == 42
    assert patches.has_holes(specs.where("name <> '0-0-0-0'"), h, w)
    with pytest.raises(ValueError):
        patches.seam_masks(spark, 10, 10, 4, 3)


def test_quality_edge_values(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", 0, 10.0), ("a", 1, nan), ("a", 2, inf), ("a", 3, 0.0), ("a", 4, -5.0), ("a", 5, 1000.0), ("a", 6, None)]
    df = spark.createDataFrame(rows, "patch string, k int, snr double")
    log = quality.Metric("snr", "log", -1.5, 1.5)
    fit = quality.fit(df, [log]).first()
    assert fit["mean"] == pytest.approx(2.0) and fit["std"] == pytest.approx(1.0)
    kept = {r.k: r.keep for r in quality.with_keep(df, quality.fit(df, [log]), [log]).collect()}
    assert kept == {0: True, 1: False, 2: False, 3: False, 4: False, 5: True, 6: False}
    linear = quality.Metric("snr", "linear", None, 1.0)
    kept = {r.k: r.keep for r in quality.with_keep(df, quality.fit(df, [linear]), [linear]).collect()}
    assert kept[1] is True and kept[2] is False and kept[0] is True
    assert quality.specs(quality.fit(df, [log]), [log, quality.Metric("other")]).count() == 1
    shown = {r.k: r.value for r in quality.render_values(df, log, ["k"]).collect()}
    assert shown[3] == shown[4] == pytest.approx(1.0) and shown[1] == pytest.approx(2.0)


def test_movie_edge_values(spark):
    flat, one = np.full((4, 4), 2.0), np.arange(16.0).reshape(4, 4)
    df = image_rows(spark, [flat, one])
    assert set(movies.scaled_image(df).where("frame = 0").first()["data"]) == {0.0}
    assert set(movies.normalize(df.where("frame = 0")).first()["data"]) == {0.0}
    assert set(movies.gray_levels(df).where("frame = 0").first()["data"]) == {0}
    assert set(movies.saturated_levels(df).where("frame = 0").first()["data"]) == {0}
    with pytest.raises(ValueError):
        movies.quadrants(movies.pixels(df), 5, 4)
    with pytest.raises(ValueError):
        movies.frames_between(df, 3, 3)
    assert movies.frames_between(df, 0, -1, "minus one").count() == 2
    again = movies.movie_of(movies.pixels(df)).orderBy("frame").collect()
    assert [list(r["data"]) for r in again] == [flat.ravel().tolist(), one.ravel().tolist()]
    halves = df.select(arrays.linspace(1, 0, F.lit(1)).alias("a"), arrays.linspace(1, 0, F.lit(3)).alias("b"), arrays.linspace(1, 0, F.lit(0)).alias("c"), arrays.one_based(F.lit(2), F.lit(1)).alias("d")).first()
    assert halves.a == [0.5] and halves.b == [1.0, 0.5, 0.0] and halves.c == [] and halves.d == []


def test_outlines(spark):
    cells = [(y, x) for y in range(2, 7) for x in range(3, 8)]
    rows = [("p", 1, y, x, 1.0 + (y == 4 and x == 5)) for y, x in cells] + [("p", 1, 12, 12, 1.0), ("p", 1, 1, 3, 0.01)]
    got = {(r.y, r.x) for r in footprints.outlines(spark.createDataFrame(rows, "patch string, k int, y int, x int, w double")).collect()}
    assert got == {(y, x) for y, x in cells if y in (2, 6) or x in (3, 7)}


def test_cuts_spacing_and_floors(spark):
    cut = lambda c, n: spark.range(1).select(intervals.centre_cut(F.lit(c), F.lit(n))).first()[0]
    assert [cut(3.0, 1), cut(3.0, 0), cut(0.1, 8), cut(2.5, 8), cut(99.0, 8)] == [0, 0, 1, 3, 7]
    spaces = lambda rows: tuple(footprints.spacing(spark.createDataFrame(rows, "k int, distance double")).first())
    assert spaces([]) == (24.0, 0.0) and spaces([(1, 100.0), (2, 100.0)]) == (200.0, 100.0) and spaces([(1, 3.0), (2, 5.0)]) == (24.0, 4.0)
    one, none = np.zeros((101, 101)), np.zeros((101, 101))
    none[0, 0] = one[0, 0] = 1.0
    far = kernels.regression_field(2 * one, none, 3.0)
    weight = kernels.gaussian_blur(none, 3.0)
    assert far[0, 0] == pytest.approx(2) and far[11, 11] == pytest.approx(2 * weight[11, 11] / max(weight[11, 11], 1e-8)) and weight[11, 11] < 1e-3
    assert far[12, 12] < 2.001 and far[13, 12] == pytest.approx(2 * weight[13, 12] / max(weight[13, 12], 1e-8))


def test_peak_fit_keeps_to_its_bounds():
    corr = np.zeros((20, 20))
    corr[10, 10] = 1.0  # narrower than the least deviation, so that bound is where the fit ends
    got = kernels.fit_peak(corr, (6, 15, 6, 15))
    assert (got["peak_y"], got["peak_x"]) == (10, 10)
    assert got["sigma_y"] >= 0.5 - 1e-9 and got["sigma_x"] >= 0.5 - 1e-9 and abs(got["centre_y"] - 10) < 0.2
    assert kernels.fit_peak(np.full((9, 9), 2.0), (0, 9, 0, 9))["centre_y"] == pytest.approx(4.0)


def test_frame_statistics_stay_in_the_row(spark):
    df = image_rows(spark, [np.arange(16.0).reshape(4, 4)])
    for out in (movies.clipped(df), movies.percentile_view(df), movies.gray_levels(df), movies.saturated_levels(df), movies.display_range(df), movies.peaks(df)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan and "Join" not in plan and "Repartition" not in plan
    big = image_rows(spark, [np.random.default_rng(0).random((200, 200))])
    began = time.time()
    assert movies.clipped(big).first() and movies.percentile_view(big).first()  # a sort for every pixel would take minutes
    assert time.time() - began < 30


def test_outlines_reach_the_end_of_a_long_core(spark):
    rows = [("p", 1, 0, x, 1.0 + (x == 0)) for x in range(150)]
    got = {(r.y, r.x) for r in footprints.outlines(spark.createDataFrame(rows, "patch string, k int, y int, x int, w double")).collect()}
    assert got == {(0, x) for x in range(150)}


def test_nearest_has_no_radius(spark):
    places = {1: (0.0, 0.0), 2: (0.0, 3.0), 3: (500.0, 0.0), 4: (-1000.0, 2000.0), 5: (520.0, 0.0)}
    points = spark.createDataFrame([(k, y, x) for k, (y, x) in places.items()] + [(6, float("nan"), 0.0)], "k int, y double, x double")
    want = {k: min(((y - v) ** 2 + (x - u) ** 2) ** 0.5 for j, (v, u) in places.items() if j != k) for k, (y, x) in places.items()}
    got = {r.k: r.distance for r in neighbours.nearest(points, "k").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert neighbours.nearest(points.where("k = 1"), "k").count() == 0


def test_regions(spark):
    members = spark.createDataFrame([("a", 1), ("b", 2)], "roi_id string, neuron_id long")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(traces.toggled(members, 1, "a")) == [("b", 2)]
    assert rows(traces.toggled(members, 1, "b")) == [("b", 1), ("b", 2)]
    assert rows(traces.toggled(members, 3, "a")) == [("a", 1), ("a", 3), ("b", 2)]


def stack(path, frames):
    with open(path, "wb") as f:
        tiff.write_stack(f, frames)


def test_tiff_round_trip(spark, tmp_path):
    spark.dataSource.register(tiff.TiffSource)
    frames = [np.random.default_rng(k).random((5, 7)).astype(np.float32) for k in range(10)]
    stack(tmp_path / "a.tif", frames)
    same = lambda df, n=10: sorted(r.frame for r in df.collect()) == list(range(n)) and all(np.allclose(np.array(r["data"]).reshape(5, 7), frames[r.frame]) for r in df.collect())
    df = spark.read.format("tiff").option("chunk", 4).load(str(tmp_path / "a.tif"))
    assert df.rdd.getNumPartitions() == 3 and same(df)
    assert sorted(r.frame for r in spark.read.format("tiff").option("start", 2).option("end", 5).load(str(tmp_path / "a.tif")).collect()) == [2, 3, 4]
    out = str(tmp_path / "out")
    for parts in (1, 3, 2):  # each replaces what was there; frames are dealt to tasks in any order
        df.repartition(parts).write.format("tiff").mode("overwrite").save(out)
        assert len([n for n in os.listdir(out) if n.endswith(".tif")]) == parts and not [n for n in os.listdir(out) if n.endswith(".part")]
        assert same(spark.read.format("tiff").option("chunk", 2).load(out))
    assert sorted(r.frame for r in spark.read.format("tiff").option("start", 7).load("file://" + out).collect()) == [7, 8, 9]
    more = df.where("frame < 2").withColumn("frame", F.col("frame") + 10)
    more.write.format("tiff").mode("append").save(out)
    assert sorted(r.frame for r in spark.read.format("tiff").load(out).collect()) == list(range(12))


def test_tiff_folder_is_one_movie(spark, tmp_path):
    spark.dataSource.register(tiff.TiffSource)
    frames = [np.full((3, 4), float(k), np.float32) for k in range(9)]
    for name, own in (("b", frames[4:6]), ("A", frames[:4]), ("c", frames[6:])):
        stack(tmp_path / f"{name}.tif", own)
    (tmp_path / "._c.tif").write_bytes(b"no movie")
    got = {r.frame: r["data"][0] for r in spark.read.format("tiff").option("chunk", 3).load(str(tmp_path)).collect()}
    assert got == {k: float(k) for k in range(9)}
    some = spark.read.format("tiff").option("start", 3).option("end", 7).load(str(tmp_path))
    assert sorted(r.frame for r in some.collect()) == [3, 4, 5, 6]


def test_failed_write_leaves_the_movie(spark, tmp_path):
    spark.dataSource.register(tiff.TiffSource)
    df = image_rows(spark, [np.full((2, 2), float(k)) for k in range(4)])
    out = str(tmp_path / "out")
    df.write.format("tiff").mode("overwrite").save(out)
    before = sorted(os.listdir(out))
    bad = df.withColumn("w", F.when(F.col("frame") == 3, 5).otherwise(F.col("w")))
    with pytest.raises(Exception):
        bad.coalesce(1).write.format("tiff").mode("overwrite").option("file_mb", 0).save(out)
    assert sorted(os.listdir(out)) == before and spark.read.format("tiff").load(out).count() == 4


def test_parameter_files(spark, tmp_path):
    (tmp_path / "crop.json").write_text('{"version": 1, "after_stitch": true, "pad": 2, "patch_specs": [{"name": "0-0-0-0", "y0": 0, "y1": 4, "x0": 0, "x1": 4}]}')
    assert params.patch_specs(params.crop_para(spark, str(tmp_path / "crop.json"))).first().y1 == 4
    (tmp_path / "b.yaml").write_text("roi: [1, 2, 3, 4]\n")
    assert params.mapping(spark, [str(tmp_path / "none.json"), str(tmp_path / "b.yaml")], ["roi"]) == {"roi": [1, 2, 3, 4]}
    assert params.mapping(spark, [str(tmp_path / "b.yaml")], ["other"]) == {}
    head = "component_index,snr,r_value,bl,lam,neurons_sn,g_0,g_1,t_peak,t_half,r_value_unreliable_joint_only\n"
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "0-0-0-1.tif.csv").write_text(head + "0,1.5,nan,0,0,0,1.7,-0.7,100,200,true\n")
    row = params.profiles(spark, str(tmp_path / "p")).first()
    assert row.patch == "0-0-0-1" and math.isnan(row.r_value) and row.snr == 1.5
    listed = [r.name for r in params.listing(spark, str(tmp_path / "p"), ".csv").collect()]
    assert listed == ["0-0-0-1.tif.csv"]
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    assert params.cached(spark, str(tmp_path / "c"), make).count() == params.cached(spark, str(tmp_path / "c"), make).count() == 3 and len(calls) == 1


def test_cached_results_and_configuration(spark, tmp_path):
    path, calls = str(tmp_path / "c"), []
    make = lambda: calls.append(1) or spark.range(len(calls))
    assert [params.cached(spark, path, make, k).count() for k in ("a", "b", "a", "b")] == [1, 2, 1, 2] and len(calls) == 2
    (tmp_path / "main.yaml").write_text("chunk: 16\nsave: {fold: a, keep: true}\n")
    (tmp_path / "own.yaml").write_text("save: {fold: b}\n")
    files = [str(tmp_path / n) for n in ("main.yaml", "none.yaml", "own.yaml")]
    assert params.composed(spark, files) == {"chunk": 16, "save": {"fold": "b", "keep": True}}
    assert params.composed(spark, files, {"save.keep": False})["save"] == {"fold": "b", "keep": False}
    with pytest.raises(KeyError):
        params.composed(spark, files, {"save.other.name": 1})
    sources = {"load": "/data/x"}
    assert not params.cache_is_valid(spark, str(tmp_path), sources, ["points.json"])
    (tmp_path / "metadata.json").write_text('{"load": "/data/x/", "trace_sources": {"c": {"file": "c.bin"}}}')
    (tmp_path / "points.json").write_text("[]")
    assert not params.cache_is_valid(spark, str(tmp_path), sources, ["points.json"])
    (tmp_path / "c.bin").write_bytes(b"")
    assert params.cache_is_valid(spark, str(tmp_path), sources, ["points.json"])
    assert not params.cache_is_valid(spark, str(tmp_path), {"load": "/data/y"}, ["points.json"])


def test_trace_buffers(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.5]), (2, [0.0, -1.0])], "id long, v array<double>")
    got = {r.id: np.frombuffer(r.data, "<f4").tolist() for r in traces.packed(rows).collect()}
    assert got == {1: [1.0, 2.5], 2: [0.0, -1.0]}
    size = lambda df: tuple(traces.buffer_size(traces.packed(df)).first())
    assert size(rows) == (2, 2, True) and size(rows.where("id < 0")) == (0, 0, True)
    assert size(rows.unionByName(spark.createDataFrame([(3, [1.0])], rows.schema))) == (3, 2, False)


def test_ridge_features_find_the_shift(spark):
    image = np.ones((64, 64))
    image[20:40, 30], image[25, 15:50] = 0, 0
    image = kernels.gaussian_blur(image, 1)
    moved = np.roll(image, (-4, 6), (0, 1))
    df = image_rows(spark, [image]).withColumn("moving", F.array(*[F.lit(float(v)) for v in moved.ravel()]))
    corr = np.array(kernels.phase_correlation(df, "ridges", 30.0, (1.0, 2.0)).first()["corr"]).reshape(64, 64)
    assert np.unravel_index(corr.argmax(), corr.shape) == (32 + 4, 32 - 6)
    with pytest.raises(ValueError):
        kernels.phase_correlation(df, "other")


def test_profiles_and_patches_go_to_files(spark, tmp_path):
    own = [(p, k, *([0.5] * 9), True) for p in ("0-0-0-0", "0-0-0-1") for k in range(2)]
    table = spark.createDataFrame(own, schemas.PROFILE)
    params.write_profiles(table, str(tmp_path / "profile"))
    back = spark.read.option("header", True).csv(str(tmp_path / "profile"))
    assert back.count() == 4 and {r.patch for r in back.select("patch").distinct().collect()} == {"0-0-0-0", "0-0-0-1"}
    movie = image_rows(spark, [np.arange(16.0).reshape(4, 4)])
    patches.write_patches(movie, (4, 4), patches.regular_grid(spark, 4, 4, 2), str(tmp_path / "patch"), 1)
    (row,) = spark.read.parquet(str(tmp_path / "patch")).where("name = '0-0-1-1'").collect()
    assert row.data == [5, 6, 7, 0, 9, 10, 11, 0, 13, 14, 15, 0, 0, 0, 0, 0]


def test_streaming_equals_batch(spark, tmp_path):
    pick = np.random.default_rng(3)
    movie = image_rows(spark, [pick.random((4, 4)) for _ in range(12)])
    movie.repartition(6).write.parquet(str(tmp_path / "in"))
    stream = incremental.running_projection(incremental.frames(spark, str(tmp_path / "in"), 2))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("projection").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = {(r.y, r.x): r for r in spark.table("projection").collect()}
    for r in movies.projection_stats(movie).collect():
        assert got[r.y, r.x].mean == pytest.approx(r.mean) and got[r.y, r.x].std == pytest.approx(r.std) and got[r.y, r.x].n == 12
