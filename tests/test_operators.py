import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyloom.catalog import PSF, fringe_fit
from skyloom.operators import calibration, deconvolution, fitting, images, selection
from skyloom.sources import chunk_size, chunk_summary, empty_image, in_chunks, open_image, write_image
from skyloom.streaming import weight_windows

SF = "/root/testdata/sf0.001"


def pixels(spark, z):
    rows = [(0, 0, l, m, float(z[l, m])) for l in range(z.shape[0]) for m in range(z.shape[1])]
    return spark.createDataFrame(rows, "plane int, chan int, l int, m int, value double")


def test_clean_recovers_a_source():
    dirty = np.zeros((8, 8))
    dirty += 2.0 * PSF
    model, residual, n = deconvolution.hogbom(dirty, PSF, 0.2, 200, 1e-3)
    assert abs(model[4, 4] - 2.0) < 0.01 and np.abs(residual).max() < 1e-3 and n < 200
    for bad in ({"gain": 0.0}, {"niter": 0}, {"threshold": -1.0}):
        with pytest.raises(ValueError):
            deconvolution.hogbom(dirty, PSF, **bad)


def test_clean_leaves_out_nan_masks_and_boxes(spark):
    z = 2.0 * PSF
    z[1, 6] = np.nan
    z[7, 7] = np.inf
    model, residual, n = deconvolution.hogbom(z, PSF, 0.2, 200, 1e-3)
    assert abs(model[4, 4] - 2.0) < 0.01 and np.isfinite(model).all() and n < 200
    many, rest, done = deconvolution.hogbom_planes(np.stack([z, -z]), PSF, 0.2, 200, 1e-3)
    assert np.allclose(many[0], model) and np.allclose(many[1], -model) and done.tolist() == [n, n] and np.allclose(rest[0], residual, equal_nan=True)
    each, _, _ = deconvolution.hogbom_planes(np.stack([z, z]), np.stack([PSF, PSF]), 0.2, 200, 1e-3)
    assert np.allclose(each[1], model)
    got = {(r.l, r.m): r for r in deconvolution.deconvolve(pixels(spark, z), PSF, 0.2, 50, mask=F.col("l") != 4, box=(0, 8, 2, 6)).collect()}
    assert len(got) == 64 and all(r.model == 0 for (l, m), r in got.items() if l == 4 or not 2 <= m < 6) and any(r.model for r in got.values())
    stats = deconvolution.deconvolve_stats(pixels(spark, z), PSF, mask=F.lit(False), niter=5).first()
    assert (stats.iter_done, stats.masksum, stats.peakres, stats.peakres_nomask) == (0, 0, None, 2.0)
    for bad in ((1, 2, 3), "x"):
        with pytest.raises(ValueError):
            deconvolution.clean_box(bad)


def test_clean_from_a_start_and_one_psf_for_all_planes(spark):
    one = pixels(spark, 2.0 * PSF)
    img = one.unionByName(one.withColumns({"plane": F.lit(1).cast("long"), "value": F.col("value") * 2}))
    psf = pixels(spark, PSF)
    start = spark.createDataFrame([(1, 0, 4, 4, 0.5)], "plane long, chan long, l long, m long, value double")
    got = {(r.plane, r.l, r.m): r.model for r in deconvolution.deconvolve(img.withColumns({c: F.col(c).cast("long") for c in ("plane", "chan", "l", "m")}), psf, 0.2, 100, 1e-3, start=start).collect()}
    assert abs(got[0, 4, 4] - 2.0) < 0.01 and abs(got[1, 4, 4] - 4.5) < 0.01
    with pytest.raises(Exception, match="no point spread function"):
        deconvolution.deconvolve(img, psf.unionByName(psf.withColumn("plane", F.lit(7).cast("int"))), 0.2, 5).collect()


def test_controller_priorities():
    c = deconvolution.IterationController(niter=0, nmajor=0, threshold=1.0)
    assert c.check(0.5, 0)[0] == 7
    c.reset()
    assert c.check(0.5, 1)[0] == 1
    assert deconvolution.parse_threshold("20 mJy".replace(" ", "")) == pytest.approx(0.02)
    assert c.update_parameters(threshold="x")[0] == -1 and c.update_parameters(nmajor=-2)[0] == -1
    d = deconvolution.IterationController.from_state(c.state())
    assert d == c and d.state() == c.state()
    with pytest.raises(ValueError):
        deconvolution.IterationController(nmajor=-2)


@given(st.lists(st.floats(-10, 10), min_size=16, max_size=16))
@settings(max_examples=20, deadline=None)
def test_transform_round_trip(values):
    x = np.array(values).reshape(4, 4)
    y = np.fft.fftshift(np.fft.fft2(np.fft.ifftshift(x)))
    assert np.abs(np.fft.fftshift(np.fft.ifft2(np.fft.ifftshift(y))) - x).max() < 1e-9


def test_stokes_round_trip(spark):
    row = spark.createDataFrame([(1.0, 0.5, 0.25, 2.0, -1.0, 0.5, 0.0, 1.0)], "a double, b double, c double, d double, e double, f double, g double, h double")
    for feed in ("linear", "circular"):
        parts = [(F.col(x), F.col(y)) for x, y in ("ab", "cd", "ef", "gh")]
        back = images.stokes_to_corr(list(images.corr_to_stokes(parts, feed).values()), feed)
        got = row.select(*[c.alias(f"c{i}") for i, c in enumerate(x for pair in back.values() for x in pair)]).first()
        assert list(got) == pytest.approx([1.0, 0.5, 0.25, 2.0, -1.0, 0.5, 0.0, 1.0])


def test_selection_errors():
    for text in ("blob[[1pix,1pix],2pix]", "circle[[1pix,1pix]]", "rotbox[[1pix,1pix],[2pix,2pix]]", "circle[[1furlong,1pix],2pix]", "circle[[10deg,1pix],2pix]", "circle[[1,1],2]", "box[[1pix,1pix],[2arcsec,2pix]]"):
        with pytest.raises(ValueError):
            selection.crtf(text)
    with pytest.raises(NameError):
        selection.expression("a & b", {})
    with pytest.raises(ValueError):
        selection.expression("a and b", {})
    with pytest.raises(TypeError):
        selection.select_mask(3)


def test_gaussian_fit(spark):
    x, y = np.indices((24, 24)).astype(float)
    z, _ = fitting.gaussians(np.array([0.1, 2.0, 10.0, 12.0, 4.0, 2.0, 0.5]), x.ravel(), y.ravel())
    row = fitting.fit_multi_gaussian2d(pixels(spark, z.reshape(24, 24)), 1).first()
    assert (row.amp, row.x0, row.y0, row.theta, row.offset) == pytest.approx((2.0, 10.0, 12.0, 0.5, 0.1), abs=1e-4)
    assert row.variance_explained > 0.9999


def test_fit_of_many_planes_with_all_errors(spark):
    """Noise of known size: errors are of the size of the deviations; forms of starts agree; bounds by component hold."""
    x, y = np.indices((20, 20)).astype(float)
    clean = fitting.gaussians(np.array([0.2, 3.0, 6.0, 6.0, 2.5, 1.5, 0.3, 2.0, 14.0, 13.0, 2.0, 1.8, -0.4]), x.ravel(), y.ravel())[0].reshape(20, 20)
    r = np.random.default_rng(3)
    rows = [(plane, 0, l, m, float(clean[l, m] + noise[l, m])) for plane in range(12) for noise in [r.normal(size=(20, 20)) * 0.05] for l in range(20) for m in range(20)]
    img = spark.createDataFrame(rows, "plane int, chan int, l int, m int, value double")
    flat = [0.0, 2.0, 6.5, 6.5, 6.0, 4.0, 0.0, 2.0, 13.5, 13.5, 5.0, 4.0, 0.0]
    found = fitting.fit_multi_gaussian2d(img, 2, flat).where("component = 0").toPandas()
    for name, true in (("amp", 3.0), ("x0", 6.0), ("y0", 6.0), ("fwhm_major", 2.5 * 2.3548), ("theta", 0.3), ("offset", 0.2), ("peak", 3.2)):
        pull = (found[name] - true) / found[f"{name}_err"]
        assert 0.3 < np.sqrt((pull**2).mean()) < 2.0, name
    assert ((found["pa"] - (math.pi / 2 - 0.3)).abs() < 0.1).all()
    named = [dict(zip(fitting.PARAMETERS, flat[1 + 6 * k : 7 + 6 * k])) for k in (0, 1)]
    for form in (named, {"offset": 0.0, "components": named}, np.array(flat[1:]).reshape(2, 6)):
        again = fitting.fit_multi_gaussian2d(img.where("plane = 0"), 2, form).where("component = 0").first()
        assert again.amp == pytest.approx(found[found.plane == 0].amp.iloc[0], abs=1e-6)
    held = fitting.fit_multi_gaussian2d(img.where("plane = 0"), 2, flat, bounds={"amp": [(0, 10), (0, 1.5)], "offset": (0, 1)}).where("component = 1").first()
    assert held.amp <= 1.5 + 1e-9
    for bad in ({"amp": [(0, 1)]}, {"amp": (2, 1)}):
        with pytest.raises(ValueError):
            fitting.fit_multi_gaussian2d(img, 2, flat, bounds=bad)
    with pytest.raises(ValueError):
        fitting.fit_multi_gaussian2d(img, 2, flat[:5])


def test_narrow_beams_are_fitted_finer(spark):
    x, y = np.indices((25, 25)).astype(float)
    z = fitting.gaussians(np.array([0.0, 1.0, 12.0, 12.0, 1.0, 0.8, 0.5]), x.ravel(), y.ravel())[0].reshape(25, 25)
    row = fitting.psf_fit(pixels(spark, z), window=(9, 9), sampling=5).first()
    assert (row.bmaj, row.bmin, row.pa) == pytest.approx((2.3548, 0.8 * 2.3548, math.pi / 2 - 0.5), abs=0.12)


def test_fringe_fit_and_rotation(spark):
    rows = fringe_fit(spark, SF).collect()
    assert {(r.ant, r.pol) for r in rows} == {(a, p) for a in range(6) for p in (0, 1)}
    for row in rows:  # flagged samples are turned by two radians, and would spoil the phase
        assert abs(row.delay - row.ant * 1e-8) < 1e-8 and row.snr > (1e8 if row.ant == 0 else 50)
    r = calibration.rotation((1.0, 0.5), (1.1, 0.4))
    assert np.abs(r @ r.T - np.eye(3)).max() < 1e-12 and np.abs(calibration.rotation((1, 0.5), (1, 0.5)) - np.eye(3)).max() < 1e-12


def test_fitted_phases_are_taken_off(spark):
    """Fit, then apply: baselines with the reference antenna become flat, all four correlations alike."""
    rows = [(0, a, 2.0 * t, 1.4e9 + 1e6 * f, c, a * 1e-8 * 1e6 * f * 2 * math.pi + 0.3 * a + 0.2 * (c % 2), t == 3) for a in (1, 2) for t in range(8) for f in range(16) for c in range(4)]
    rows += [(a, 0, t, f, c, -p + 0.2 * (c % 2) - 0.2 * (c // 2), x) for _, a, t, f, c, p, x in rows]
    frame = spark.createDataFrame(rows, "ant1 int, ant2 int, t double, freq double, pol int, p double, flag boolean")
    frame = frame.select("ant1", "ant2", "t", "freq", "pol", F.cos("p").alias("re"), F.sin("p").alias("im"), F.lit(1.0).alias("weight"), "flag")
    frame = frame.withColumn("im", F.when(F.col("flag"), float("nan")).otherwise(F.col("im")))
    cal = calibration.fringe_fit(frame, 0, pad=32, correlations=4)
    flat = calibration.apply_calibration(frame, cal, 1.4e9, 0.0, correlations=4).where("not flag and pol in (0, 3)")
    assert flat.select(F.max(F.abs(F.atan2("im", "re")))).first()[0] < 0.25
    assert calibration.empty_solutions(frame, correlations=4).count() == 6


def test_masks_read_nan_as_false(spark):
    row = spark.createDataFrame([(float("nan"), None, 2.0, True)], "a double, b double, c double, d boolean")
    masks = {k: F.col(k) for k in "abcd"}
    got = row.select(*[selection.expression(t, masks).alias(f"x{i}") for i, t in enumerate(("a", "~a", "b", "c & d", "c ^ d"))]).first()
    assert list(got) == [False, True, False, True, False] and not row.select(selection.select_mask(F.col("a")).alias("x")).first().x
    at = spark.createDataFrame([(1, 1)], "l int, m int")
    assert at.where(selection.crtf("-circle[[8pix,8pix],2pix]")).count() == 0


def test_image_files(spark, tmp_path):
    path = str(tmp_path / "image")
    write_image(empty_image(spark, 4, 3, 2), path)
    assert open_image(spark, path).count() == 96 and open_image(spark, path, F.col("chan") == 1).count() == 32
    with pytest.raises(Exception):
        write_image(empty_image(spark, 4), path)
    size = chunk_size(100, 512 * 512, 2, 8, 4)
    vis = spark.range(1000).select((F.col("id") % 100).cast("int").alias("chan"), (F.col("id") % 3 == 0).alias("flag"))
    chunks = chunk_summary(vis, size).collect()
    assert sum(r.channels for r in chunks) == 100 and sum(r.n for r in chunks) == 1000 and len(chunks) >= 16
    assert in_chunks(vis, size).select("chunk", F.spark_partition_id().alias("p")).distinct().count() == len(chunks)


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = weight_windows(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert {tuple(r) for r in spark.table("windows").collect()} == {tuple(r) for r in weight_windows(events).collect()}


def test_point_source_error_policy(spark):
    source = spark.createDataFrame([(-3.0, 2.0, 1.0)], "x double, y double, amp double")
    with pytest.raises(Exception):
        images.point_sources(source, 8, "error").collect()
    assert images.point_sources(source, 8, "clip").first().l == 0 and math.isclose(images.point_sources(source, 8, "clip").first().amp, 1.0)
