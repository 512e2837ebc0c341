"""Covariances of fits against many noisy draws, and what columns say of themselves."""

import json

import numpy as np
from pyspark.sql import functions as F

from skyloom.operators import coordinates, fitting


def test_covariances_against_draws(spark):
    """Part of the source is cut off, so that its widths and angle hang together."""
    r = np.random.default_rng(8)
    x, y = np.indices((12, 12))
    truth = np.array([0.1, 5.0, 3.0, 5.0, 3.2, 1.6, 0.5])
    clean = fitting.gaussians(truth, x.ravel().astype(float), y.ravel().astype(float))[0]
    rows = [(k, 0, int(i), int(j), float(v)) for k in range(300) for i, j, v in zip(x.ravel(), y.ravel(), clean + r.normal(size=144) * 0.08)]
    img = spark.createDataFrame(rows, "plane int, chan int, l int, m int, value double").where("l + m > 4")
    fits = fitting.fit_multi_gaussian2d(img, 1, [{"amp": 5.0, "x0": 3.0, "y0": 5.0, "fwhm_major": 7.0, "fwhm_minor": 4.0, "theta": 0.4}])
    got = fits.toPandas()
    sample = np.cov(got[["fwhm_major", "fwhm_minor", "theta"]].to_numpy().T)
    scale = np.sqrt(np.diag(sample))
    assert np.allclose(got[["fwhm_major_err", "fwhm_minor_err", "theta_err"]].mean(), scale, rtol=0.15)
    for name, i, k in (("cov_major_minor", 0, 1), ("cov_major_theta", 0, 2), ("cov_minor_theta", 1, 2)):
        assert abs(got[name].mean() - sample[i, k]) < 0.15 * scale[i] * scale[k], name
    assert max(abs(sample[0, 1]) / scale[0] / scale[1], abs(sample[0, 2]) / scale[0] / scale[2], abs(sample[1, 2]) / scale[1] / scale[2]) > 0.2
    # the order in which the widths were found changes nothing
    turned = fitting.fit_multi_gaussian2d(img, 1, [{"amp": 5.0, "x0": 3.0, "y0": 5.0, "fwhm_major": 4.0, "fwhm_minor": 7.0, "theta": 0.4 + np.pi / 2}]).toPandas()
    for name in ("theta", *fitting.COVARIANCES):
        assert np.allclose(turned.sort_values("plane")[name], got.sort_values("plane")[name], rtol=1e-3, atol=1e-6), name
    world = coordinates.to_world_axes(fits, [-0.1 * i for i in range(12)], [0.3 * i for i in range(12)]).toPandas()
    assert np.allclose(world.world_fwhm_major_err.mean(), world.world_fwhm_major.std(), rtol=0.15)


def test_columns_say_what_they_hold(spark, tmp_path):
    img = spark.range(36).select(F.lit(0).alias("plane"), F.lit(1).alias("chan"), F.expr("cast(id div 6 as int)").alias("l"), (F.col("id") % 6).cast("int").alias("m"), F.sin("id").alias("value"))
    fitting.fit_multi_gaussian2d(img, 1, bounds={"amp": (0.0, 9.0)}, min_threshold=-5.0).write.parquet(str(tmp_path / "fits"))
    notes = {f.name: f.metadata for f in spark.read.parquet(str(tmp_path / "fits")).schema}
    assert notes["theta"]["unit"] == notes["theta_err"]["unit"] == "rad" and notes["x0_err"]["comment"].startswith("standard error") and "variance" in notes["variance_explained"]["comment"]
    call = json.loads(notes["component"]["call"])
    assert call["n"] == "1" and call["min_threshold"] == "-5.0" and "amp" in call["bounds"] and "mask" not in call and notes["plane"] == {}
    long = fitting.described(spark.range(1).select(F.lit(0).alias("component")), 20, initial="x" * 50)
    assert len(json.loads(long.schema["component"].metadata["call"])["initial"]) == 20
