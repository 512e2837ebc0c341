"""Planes larger than a task give what whole planes give."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import deconvolution, gridding, images, tiles
from skyloom.sources import chunk_counts, open_image, with_chunks, write_chunks


def planes(spark, n, count=2, seed=1, absent=0.0):
    r = np.random.default_rng(seed)
    rows = [(p, p % 2, l, m, float(r.normal())) for p in range(count) for l in range(n[0]) for m in range(n[1]) if r.random() >= absent]
    return spark.createDataFrame(rows, "plane long, chan int, l int, m int, value double")


def by_pixel(df, *columns):
    return {(r.plane, r.chan, r.l, r.m): tuple(r[c] for c in columns) for r in df.collect()}


@pytest.mark.parametrize("n", [7, 16])
@pytest.mark.parametrize("inverse", [False, True])
def test_transform_by_strips(spark, n, inverse):
    img = planes(spark, (n, n), absent=0.4)
    want = by_pixel(images.fft(img, inverse, n), "re", "im")
    for strip in (1, 3 * n, n * n):
        got = by_pixel(tiles.fft_strips(img, n, inverse, strip), "re", "im")
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    assert tiles.fft_strips(img.limit(0), n).count() == 0
    with pytest.raises(Exception, match="outside"):
        tiles.fft_strips(img, n - 1).collect()


def test_large_planes_take_strips(spark, monkeypatch):
    img = planes(spark, (8, 8))
    want = by_pixel(images.fft(img, n=8), "re", "im")
    monkeypatch.setattr(images, "TASK_PIXELS", 63)
    got = images.fft(img, n=8)
    assert got.columns == ["plane", "chan", "l", "m", "re", "im"] and "FlatMapGroupsInArrow" in got._jdf.queryExecution().toString()
    assert all(np.allclose(v, want[k]) for k, v in by_pixel(got, "re", "im").items())


def test_feathering_by_strips(spark):
    high, low = planes(spark, (8, 8)), planes(spark, (8, 8), 3, 2)
    want = by_pixel(images.feather(high, low, 8, 3.0, 2.0, 1.5, 0.7), "value")
    got = by_pixel(tiles.feather_strips(high, low, 8, 3.0, 2.0, 1.5, 0.7, strip=24), "value")
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_windows_of_a_point_spread_function():
    psf = np.random.default_rng(4).normal(size=(5, 7))
    for tile in (1, 2, 3, 8):
        padded = np.pad(np.abs(psf), tile - 1)
        padded[2 + tile - 1, 3 + tile - 1] = 0
        want = np.lib.stride_tricks.sliding_window_view(padded, (tile, tile)).max((2, 3))
        assert np.array_equal(tiles.reach(psf, tile), want)


@pytest.mark.parametrize("sidelobe, candidates, args", [
    (0.02, 24, {"niter": 30}),
    (0.3, 8, {"niter": 6, "box": (2, 15, 1, 12)}),
    (0.02, 24, {"niter": 200, "threshold": 1.9}),
])
def test_clean_by_tiles_is_the_same(spark, sidelobe, candidates, args):
    """Bit by bit, with sidelobes that carry from tile to tile, boxes, NaN, absent pixels and ties."""
    r = np.random.default_rng(5)
    psf = r.uniform(-sidelobe, sidelobe, (9, 11))
    psf[4, 5] = 1.0
    img = planes(spark, (19, 13), 2, 6, 0.1)
    value = F.when((F.col("l") + F.col("m")) % 11 == 0, float("nan")).when(F.col("l") % 6 == 3, F.lit(2.5)).otherwise(F.col("value"))
    img = img.withColumn("value", value)
    want = by_pixel(deconvolution.deconvolve(img, psf, 0.2, mask=F.col("m") % 5 > 0, **args), "model", "residual", "iterations")
    got = by_pixel(tiles.clean_tiles(img, psf, (19, 13), 0.2, mask=F.col("m") % 5 > 0, tile=5, candidates=candidates * 12, **args), "model", "residual", "iterations")
    assert got.keys() == want.keys() and max(v[2] for v in want.values()) > 5
    for k in want:
        assert np.array_equal(np.nan_to_num(got[k], nan=9e9), np.nan_to_num(want[k], nan=9e9)), k


def test_clean_by_tiles_without_work(spark):
    psf = np.ones((1, 1))
    img = planes(spark, (6, 6), 1)
    assert tiles.clean_tiles(img.limit(0), psf, (6, 6)).count() == 0
    closed = tiles.clean_tiles(img, psf, (6, 6), mask=F.lit(None).cast("boolean"), tile=4)
    assert {tuple(r) for r in closed.select("model", "iterations").distinct().collect()} == {(0.0, 0)} and closed.count() == 36
    for bad in (np.full((3, 3), np.nan), np.zeros((1 << 13, 1 << 13))):
        with pytest.raises(ValueError):
            tiles.clean_tiles(img, bad, (6, 6))
    with pytest.raises(Exception, match="outside"):
        tiles.clean_tiles(img, psf, (5, 6), tile=4)


def test_counts_of_chunks():
    for sizes, memory, threads in (({"chan": 7}, 1, 1), ({"chan": 1000, "l": 50}, 1, 16), ({"l": 512, "m": 300, "chan": 2}, 0.5, 4), ({"chan": 1}, 1, 8)):
        counts = chunk_counts(sizes, memory, threads, 2000)
        largest = math.prod(-(-sizes[a] // counts[a]) for a in sizes)
        assert all(1 <= counts[a] <= sizes[a] for a in sizes) and largest * 2400 * threads <= memory * 2**30
        assert math.prod(counts.values()) >= min(4 * threads, math.prod(sizes.values()))
    assert chunk_counts({"a": 100, "b": 2}, 1e6, 2, 1) == {"a": 8, "b": 1}
    for bad in (({}, 1, 1, 1), ({"a": 0}, 1, 1, 1), ({"a": 5}, 1e-9, 1, 100), ({"a": 5}, 1, 0, 1)):
        with pytest.raises(ValueError):
            chunk_counts(*bad)


def test_chunks_are_folders(spark, tmp_path):
    img, sizes, counts, path = planes(spark, (7, 5), 1), {"l": 7, "m": 5}, {"l": 3, "m": 2}, str(tmp_path / "image")
    write_chunks(img, path, sizes, counts)
    chunks = with_chunks(img, sizes, counts).groupBy("chunk_l", "chunk_m").agg(F.count_distinct("l").alias("a"), F.count_distinct("m").alias("b")).collect()
    assert len(chunks) == 6 and {r.a for r in chunks} == {2, 3} and {r.b for r in chunks} == {2, 3}
    some = open_image(spark, path, (F.col("chunk_l") == 2) & (F.col("chunk_m") == 0))
    assert len(some.inputFiles()) == 6 and "PartitionFilters: [isnotnull(chunk_l" in some._jdf.queryExecution().toString()
    assert by_pixel(some, "value") == by_pixel(with_chunks(img, sizes, counts).where("chunk_l = 2 and chunk_m = 0"), "value")
    with pytest.raises(Exception, match="exists"):
        write_chunks(img, path, sizes, counts)
    write_chunks(img, path, sizes, counts, overwrite=True)
    assert open_image(spark, path).count() == 35


def test_single_dish_kernel_table(spark):
    rows = [(0, 5.3, 4.6, 1.0, 2.0, 0.5, False), (0, -0.2, 4.0, 9.0, 9.0, 1.0, False), (0, 8.5, 0.0, 3.0, 1.0, 2.0, False), (1, 1.0, 1.0, float("nan"), 1.0, 1.0, False), (1, 2.0, 2.0, 1.0, 1.0, 0.0, False)]
    vis = spark.createDataFrame([(p, x - 4, y - 4, *rest) for p, x, y, *rest in rows], "pol int, u double, v double, re double, im double, weight double, flag boolean")
    kernel = [1.0, 0.7, 0.4, 0.2]
    want: dict = {}
    for p, x, y, re, im, w, _ in rows:
        if not (0 <= x < 9 and 0 <= y < 9) or re != re or not w:
            continue
        for i in range(9):
            for j in range(9):
                r = math.hypot(i - x, j - y)
                k = round(2 * r)
                if r <= 2 and abs(i - round(x)) <= 2 and abs(j - round(y)) <= 2 and k < len(kernel):
                    old = want.get((p, i, j), (0, 0, 0))
                    want[p, i, j] = tuple(a + kernel[k] * w * b for a, b in zip(old, (re, -im, 1)))
    got = {(r.pol, r.iu, r.iv): (r.re, r.im, r.weight) for r in gridding.single_dish_grid(vis, 9, 1.0, 2, kernel, 2).collect() if r.weight}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
