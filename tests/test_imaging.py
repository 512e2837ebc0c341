import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.catalog import CELL, N
from skyloom.operators import deconvolution, fitting, gridding, images, imaging


@pytest.fixture(scope="module")
def samples(spark):
    """A dense coverage of the uv plane within the grid."""
    r = np.random.default_rng(4)
    u, v = r.uniform(-1700, 1700, (2, 3000))
    rows = [(i, float(u[i]), float(v[i]), 0.0, i % 2, 1.4e9 + (i % 2) * 1e6, 0, 1.0, i % 37 == 0) for i in range(3000)]
    return spark.createDataFrame(rows, "event_id long, u double, v double, w double, chan int, freq double, pol int, weight double, flag boolean")


SOURCES = [(2.0, 10 * CELL, -6 * CELL)]


def test_prediction_is_the_direct_sum(spark, samples):
    pixels = spark.createDataFrame([(0, c, N // 2 + 10, N // 2 - 6, 2.0) for c in (0, 1)], "plane int, chan int, l int, m int, value double")
    want = imaging.synthetic_visibilities(samples, SOURCES)
    both = imaging.predict(want, pixels, N, CELL)
    gap = both.select(F.max(F.hypot(F.col("re") - F.col("model_re"), F.col("im") - F.col("model_im")))).first()[0]
    assert gap < 0.03 and both.count() == 3000


def test_dirty_image_peaks_at_the_source(samples):
    data = imaging.synthetic_visibilities(samples, SOURCES)
    peak = imaging.dirty_image(data, N, CELL).orderBy(F.desc("value")).first()
    assert (peak.l, peak.m) == (N // 2 + 10, N // 2 - 6) and abs(peak.value - 2.0) < 0.05
    psf = imaging.point_spread(samples, N, CELL).where(f"l = {N // 2} and m = {N // 2}")
    assert all(abs(r.value - 1.0) < 0.02 for r in psf.collect()) and psf.count() == 2


def test_major_cycles_find_the_model(samples):
    data = imaging.synthetic_visibilities(samples, SOURCES)
    control = deconvolution.IterationController(niter=400, nmajor=4, threshold=0.02, cycleniter=100)
    model, residual, log = imaging.major_cycles(data, control, N, CELL, 0.2)
    found = {(r.plane, r.chan, r.l, r.m): r.value for r in model.collect()}
    assert all(abs(found[0, c, N // 2 + 10, N // 2 - 6] - 2.0) < 0.05 for c in (0, 1))
    rows = log.orderBy("cycle").collect()
    assert rows[-1].peakres < 0.1 * rows[0].start_peakres and residual.count() == 2 * N * N
    assert {r.stopcode for r in rows} <= {1, 2} and all(0.0 < r.max_psf_sidelobe < 1 for r in rows)
    assert deconvolution.summary(log).first().iterations == control.iterations_done == sum(r.iter_done for r in rows)
    assert deconvolution.convergence(log).count() == len(rows) and control.stopcode


def test_mosaic_of_one_field(spark, samples):
    """A source at the centre of the only field keeps its flux, and the beam peaks there."""
    classes = spark.createDataFrame([(0, 10.7, 10.7, 0.75, 0.75, 1e11)], "cf int, dish1 double, dish2 double, blockage1 double, blockage2 double, freq double")
    kernels = imaging.class_kernels(classes, N, CELL)
    total = kernels.where("uo = 0 and vo = 0").select(F.aggregate("k", F.lit(0.0), lambda a, b: a + b)).first()[0]
    assert abs(total - 1) < 0.01
    data = imaging.synthetic_visibilities(samples, [(2.0, 0.0, 0.0)]).withColumns({"cf": F.lit(0), "field": F.lit(0)})
    data = imaging.to_common_centre(data, imaging.field_table(spark, {0: (1.0, 0.5)}, (1.0, 0.5), N, CELL))
    centre = imaging.mosaic_image(data, kernels, N, CELL).where(f"l = {N // 2} and m = {N // 2}").collect()
    assert all(abs(r.pb - 1) < 0.01 and abs(r.value - 2) < 0.05 and r.psf == 1 and r.bmaj >= r.bmin > 0 for r in centre) and len(centre) == 2
    # the same sums as footprints laid out as rows
    half = F.expr("support div 2")
    taps = kernels.select("cf", "uo", "vo", "support", F.posexplode("k").alias("at", "k"))
    taps = taps.select("cf", "uo", "vo", (F.expr("at div support") - half).cast("int").alias("du"), (F.col("at") % F.col("support") - half).cast("int").alias("dv"), "k")
    one, psf = (gridding.mosaic_grid(data, taps, N, CELL, 10, ("gx", "gy"), do_psf=k) for k in (False, True))
    both = gridding.mosaic_cells(data, kernels, N, CELL, 10).groupBy("chan", "pol", "iu", "iv").agg(*[F.sum(c).alias(f"x{c}") for c in ("re", "im", "psf_re", "psf_im")])
    gap = one.join(psf.withColumnsRenamed({"re": "pr", "im": "pi"}), ["chan", "pol", "iu", "iv"]).join(both, ["chan", "pol", "iu", "iv"], "full")
    size = sum((F.abs(F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0))) for a, b in (("re", "xre"), ("im", "xim"), ("pr", "xpsf_re"), ("pi", "xpsf_im"))), F.lit(0.0))
    assert gap.agg(F.max(size)).first()[0] < 1e-6


def test_offset_field(spark, samples):
    """The beam of a field beside the phase centre, and a source in it, lie where the field is."""
    centre, place = (1.0, 0.5), (1.0 + 6 * CELL / math.cos(0.5), 0.5)
    classes = spark.createDataFrame([(0, 10.7, 10.7, 0.75, 0.75, 1e11)], "cf int, dish1 double, dish2 double, blockage1 double, blockage2 double, freq double")
    kernels = imaging.class_kernels(classes, N, CELL)
    data = imaging.synthetic_visibilities(samples, [(2.0, 0.0, 0.0)]).withColumns({"cf": F.lit(0), "field": F.lit(0)})
    data = imaging.to_common_centre(data, imaging.field_table(spark, {0: place}, centre, N, CELL))
    image = imaging.mosaic_image(data, kernels, N, CELL, norm_type="flat_noise").where("chan = 0 and not isnan(value)")
    beam, peak = image.orderBy(F.desc("pb")).first(), image.orderBy(F.desc("value")).first()
    assert abs(beam.l - N // 2 - 6) <= 1 and abs(beam.m - N // 2) <= 1 and (peak.l, peak.m) == (N // 2 + 6, N // 2)


def test_sparse_and_full_transforms_agree(spark):
    one = spark.createDataFrame([(0, 0, 3, 5, 1.0, 0.0)], "plane int, chan int, l int, m int, re double, im double")
    rows = images.fft(one, n=8).collect()
    z = np.zeros((8, 8), complex)
    z[3, 5] = 1
    want = np.fft.fftshift(np.fft.fft2(np.fft.ifftshift(z)))
    assert len(rows) == 64 and all(abs(complex(r.re, r.im) - want[r.l, r.m]) < 1e-12 for r in rows)


def test_weights_outside_the_grid(spark, samples):
    far = samples.limit(1).withColumns({"u": F.lit(1e6), "event_id": F.lit(9999).cast("long"), "flag": F.lit(False)})
    lost = samples.limit(1).withColumns({"u": F.lit(float("nan")), "event_id": F.lit(9998).cast("long"), "flag": F.lit(False)})
    rows = gridding.imaging_weights(samples.unionByName(far).unionByName(lost), "briggs", 0.5, N, CELL).collect()
    got = {r.event_id: r.weight_imaging for r in rows}
    assert len(rows) == 3002 and got[9999] == got[9998] == 0.0 and 0 < got[1] < 1
    assert gridding.degrid(samples.unionByName(lost), None, N, CELL, constant=2.0).where("event_id = 9998").first().re == 0.0


def test_fit_with_starts_bounds_and_world(spark):
    x, y = np.indices((24, 24)).astype(float)
    z, _ = fitting.gaussians(np.array([0.1, 2.0, 10.0, 12.0, 4.0, 2.0, 0.5]), x.ravel(), y.ravel())
    img = spark.createDataFrame([(0, 0, int(a), int(b), float(c)) for a, b, c in zip(x.ravel(), y.ravel(), z)], "plane int, chan int, l int, m int, value double")
    start = [{"amp": 1.5, "x0": 9.0, "y0": 13.0, "fwhm_major": 8.0, "fwhm_minor": 5.0, "theta": 0.2}]
    fit = fitting.fit_multi_gaussian2d(img, 1, start, bounds={"x0": (8.0, 12.0)}, max_threshold=1.9)
    row = fitting.to_world(fit, (10.0, 100.0, -2.0), (12.0, 50.0, 2.0)).first()
    assert (row.amp, row.x0, row.world_x, row.world_y) == pytest.approx((2.0, 10.0, 100.0, 50.0), abs=1e-3)
    assert row.world_fwhm_major == pytest.approx(2 * row.fwhm_major, abs=1e-3) and row.world_theta == pytest.approx(-0.5, abs=1e-3)
    assert fitting.fitted_image(img, fit).select(F.max(F.abs("residual"))).first()[0] < 1e-3
    held = fitting.fit_multi_gaussian2d(img, 1, start, bounds={"x0": (8.0, 9.5)}).first()
    assert held.x0 <= 9.5 + 1e-9
    for bad in ({"initial": []}, {"bounds": {"theta": (0, 1)}}, {"initial": [{"amp": 1.0}]}, {"bounds": {"sigma": (0, 1)}}):
        with pytest.raises(ValueError):
            fitting.fit_multi_gaussian2d(img, 1, **bad)


def test_cube_from_samples(samples, tmp_path):
    """The sources keep their place and flux in a padded cube; it is written by channel and read again."""
    data = imaging.synthetic_visibilities(samples, SOURCES)
    cube = imaging.make_cube(data, 48, CELL, "briggs", 0.5, 4 / 3, "ALMA", 0.05, str(tmp_path / "cube"))
    rows = {(r.plane, r.chan, r.l, r.m): r for r in cube.collect()}
    assert len(rows) == 2 * 48 * 48
    for chan in (0, 1):
        peak = rows[0, chan, 24 + 10, 24 - 6]
        assert abs(peak.sky * peak.pb - 2.0) < 0.1 and abs(rows[0, chan, 24, 24].psf - 1) < 0.02 and rows[0, chan, 24, 24].pb == 1
        assert peak.bmaj >= peak.bmin > 0
    with pytest.raises(ValueError):
        imaging.make_cube(data, 48, CELL, telescope="none")


def test_major_cycles_within_a_box_and_without_limits(samples):
    """Components lie in the box; without a limit of cycles the controller stops by itself."""
    data = imaging.synthetic_visibilities(samples, SOURCES)
    control = deconvolution.IterationController(niter=24, threshold=0.0, cycleniter=8)
    model, _, log = imaging.major_cycles(data, control, N, CELL, 0.3, box=(N // 2 + 8, N // 2 + 12, 0, N))
    rows = log.collect()
    assert control.stopcode == 1 and sum(r.iter_done for r in rows) == control.iterations_done >= 24 and {(r.l, r.m) for r in model.where("value > 0.2").collect()} == {(N // 2 + 10, N // 2 - 6)}
    none = deconvolution.IterationController(niter=10)
    assert imaging.major_cycles(data, none, N, CELL, mask=F.lit(False))[2].count() == 0 and none.stopcode == 7


def test_stokes_cycles(spark, samples):
    """A polarised source is found in I, Q and V with its fluxes, from circular hands and linear ones, two or four."""
    for feed, parts in (("linear", (0.75, 0.15j, -0.15j, 0.25)), ("circular", (0.65, 0.25, 0.25, 0.35))):  # I 1, Q 0.5, V 0.3
        share = F.array(*[F.array(F.lit(complex(x).real), F.lit(complex(x).imag)) for x in parts])
        data = imaging.synthetic_visibilities(samples, SOURCES).where("chan = 0").withColumn("pol", F.explode(F.sequence(F.lit(0), F.lit(3))))
        a, b = (F.get(F.get(share, F.col("pol")), F.lit(k)) for k in (0, 1))
        data = data.withColumns({"re": F.col("re") * a - F.col("im") * b, "im": F.col("re") * b + F.col("im") * a})
        control = deconvolution.IterationController(niter=600, nmajor=3, threshold=0.01, cycleniter=80)
        model, _, log = imaging.major_cycles(data, control, N, CELL, 0.2, feed=feed)
        found = {(r.plane, r.l, r.m): r.value for r in model.collect()}
        fluxes = [found.get((s, N // 2 + 10, N // 2 - 6), 0.0) for s in range(4)]
        assert fluxes == pytest.approx([2.0, 1.0, 0.0, 0.6], abs=0.06)
        assert {(r.pol, r.chan) for r in log.collect()} == {(s, 0) for s in range(4)}
    both = images.stokes_rows("circular", 2), images.correlation_rows("circular", 2)
    assert np.allclose(np.array(both[0]) @ np.array(both[1]), np.eye(2))
    with pytest.raises(ValueError):
        images.stokes_rows("linear", 2, ("V",))


def test_minor_stop_codes(spark):
    img = spark.createDataFrame([(p, 0, l, 0, float(4 - l)) for p in range(3) for l in range(4)], "plane int, chan int, l int, m int, value double")
    left = {0: 0.1, 1: 9.0, 2: 1.0}
    cleaned = img.select("plane", "chan", "l", "m", F.lit(0.5).alias("model"), F.element_at(F.create_map(*[F.lit(x) for kv in left.items() for x in kv]), F.col("plane")).alias("residual"), F.lit(5).cast("long").alias("iterations"))
    rows = {r.plane: r for r in deconvolution.cycle_rows(img, cleaned, F.lit(True), 5, 0.2).collect()}
    assert [rows[p].stopcode for p in range(3)] == [2, 4, 1] and rows[0].model_flux == 2.0 and rows[1].masksum == 4
    assert {r.stopcode for r in deconvolution.cycle_rows(img, cleaned, F.lit(False), 5, 0.2).collect()} == {7}
