"""Spectral frames, world axes, beam tables, gridding of streams, and samples that are NaN or absent."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.catalog import CELL, N
from skyloom.operators import calibration, coordinates, frames, gridding
from skyloom.streaming import grid_windows, merged

SAMPLE = "event_id long, ts timestamp, u double, v double, freq double, chan int, pol int, re double, im double, weight double, flag boolean, t double, ant1 int, ant2 int"


def drawn(spark, count, seed=1, start=0, seconds=7200.0):
    from datetime import datetime, timedelta, timezone

    r = np.random.default_rng(seed)
    u, v, re, im, at = r.uniform(-1500, 1500, count), r.uniform(-1500, 1500, count), r.normal(size=count), r.normal(size=count), r.uniform(0, seconds, count)
    zero = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [(start + i, zero + timedelta(seconds=float(at[i])), float(u[i]), float(v[i]), 1.4e9, i % 2, i % 2, float(re[i]), float(im[i]), 1.0 + i % 3, i % 13 == 0, float(at[i]), 0, 1) for i in range(count)]
    return spark.createDataFrame(rows, SAMPLE)


def test_orbit_against_published_velocity(spark):
    """The Earth about the barycentre at MJD 53411.525 (TDB), as the standard library of fundamental astronomy tests it."""
    t = (53411.52501161 - 40587) * 86400 - frames.TERRESTRIAL
    got = spark.range(1).select(*frames.orbital_velocity(F.lit(t))).first()
    want = np.array([-0.01091874268116823295, -0.0124652546173286154, -0.005404773180966231279]) * 149597870700 / 86400
    assert np.abs(np.array(got) - want).max() < 4.0


def test_frames_of_known_directions(spark):
    speed = lambda frame, ra, dec: float(np.dot(frames.sun_velocity(frame), [math.cos(dec) * math.cos(ra), math.cos(dec) * math.sin(ra), math.sin(dec)]))
    assert speed("lsrk", math.radians(270.9595), math.radians(30.0047)) == pytest.approx(20000, abs=1)
    # 16.55 km/s towards galactic longitude 53.1 and latitude 25.0; the galactic centre and pole in J2000
    assert math.hypot(*frames.sun_velocity("lsrd")) == pytest.approx(16552.9, abs=1)
    centre, pole = frames.galactic_to_equatorial((1, 0, 0)), frames.galactic_to_equatorial((0, 0, 1))
    assert math.degrees(math.atan2(centre[1], centre[0])) % 360 == pytest.approx(266.405, abs=0.01) and math.degrees(math.asin(centre[2])) == pytest.approx(-28.936, abs=0.01)
    assert math.degrees(math.asin(pole[2])) == pytest.approx(27.128, abs=0.001)
    turn = spark.range(1).select(*frames.spin_velocity(F.lit(1.7e9), (0.0, 0.0, 0.0))).first()
    assert math.hypot(*turn) == pytest.approx(465.1, abs=0.2)
    with pytest.raises(ValueError):
        frames.sun_velocity("rest")
    with pytest.raises(ValueError):
        frames.velocity(F.lit(0.0), "nowhere", 0.0, 0.0)


def test_a_line_stays_in_its_frame(spark):
    """A narrow line at a fixed LSRK frequency is found there, whatever the day."""
    step, count, days = 2e4, 200, (0, 60, 120, 200)
    rows = [(1.7e9 + 86400.0 * d, 0, 1, 0, 1.4199e9 + step * k, 1.0, False) for d in days for k in range(count)]
    vis = spark.createDataFrame(rows, "t double, ant1 int, ant2 int, pol int, freq double, weight double, flag boolean")
    line = 1.4199e9 + step * 100
    here = F.col("freq") * frames.doppler_factor(F.col("t"), "VLA", 1.2, 0.3)
    vis = vis.withColumns({"re": F.exp(-F.pow((here - line) / 6e4, 2)), "im": F.lit(0.0)})
    found = frames.to_frame(vis, "VLA", 1.2, 0.3, channels=400)
    peaks = found.groupBy("t").agg(F.max_by("out_freq", "re").alias("f")).collect()
    assert len(peaks) == len(days) and all(abs(r.f - line) < step for r in peaks)


AXES = [[-(i + i * i / 50) for i in range(20)], [1.5 * i - 3 for i in range(20)], [0.0], [2.0, 1.0], list(np.cumsum([0.1, 3, 0.2, 5, 1]))]


@pytest.mark.parametrize("axis", AXES)
def test_nearest_index_against_search(spark, axis):
    r = np.random.default_rng(2)
    rising = np.array(axis) if axis[-1] >= axis[0] else np.array(axis)[::-1]
    values = [*r.uniform(rising[0] - 2, rising[-1] + 2, 200).tolist(), *axis, *((rising[1:] + rising[:-1]) / 2).tolist()]
    frame = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double")
    got = [x[0] for x in frame.select(coordinates.nearest_index(F.col("x"), axis)).collect()]

    def want(v):
        gaps = np.abs(rising - v)
        k = int(np.flatnonzero(gaps == gaps.min()).max())
        return k if axis[-1] >= axis[0] else len(axis) - 1 - k

    assert got == [want(v) for v in values] + [None, None]
    line = [x[0] for x in frame.where("x is not null and not isnan(x)").select(coordinates.interpolated(F.col("x"), axis, [v * v for v in axis])).collect()]
    heights = np.array([v * v for v in axis])
    assert np.allclose(line, np.interp(values, rising, heights if axis[-1] >= axis[0] else heights[::-1]))


def test_world_sources_outside(spark):
    src = spark.createDataFrame([(0.0, 0.0, 1.0), (0.3, 0.0, 2.0), (5.0, 0.0, 4.0), (None, 0.0, 8.0)], "x double, y double, amp double")
    at = lambda policy: {(r.l, r.m): r.amp for r in coordinates.point_sources_world(src, [0.0, -1.0, -3.0], [-1.0, 0.0], policy).collect()}
    assert at("ignore") == {(0, 1): 1.0} and at("ignore_sloppy") == {(0, 1): 3.0} and at("clip") == {(0, 1): 7.0}
    with pytest.raises(Exception, match="outside"):
        at("error")
    for axis in ([1.0, 1.0], [], [0.0, float("nan")]):
        with pytest.raises(ValueError):
            coordinates.nearest_index(F.col("x"), axis)


def test_deprojection_goes_back(spark):
    rows = [(x, y) for x in (-0.3, 0.0, 0.2) for y in (-0.1, 0.0, 0.4)] + [(0.9, 0.9)]
    ra, dec = coordinates.deproject(F.col("l"), F.col("m"), (3.0, -0.6))
    for r in spark.createDataFrame(rows, "l double, m double").select("l", "m", ra.alias("ra"), dec.alias("dec")).collect():
        if (r.l, r.m) == (0.9, 0.9):
            assert r.ra is None and r.dec is None
            continue
        turn = r.ra - 3.0
        assert math.cos(r.dec) * math.sin(turn) == pytest.approx(r.l) and math.sin(r.dec) * math.cos(-0.6) - math.cos(r.dec) * math.sin(-0.6) * math.cos(turn) == pytest.approx(r.m)


def test_world_errors_against_draws(spark):
    """Errors of widths and angle in world units follow from many fits drawn about the true one."""
    r = np.random.default_rng(3)
    cov = np.array([[0.01, 0.003, 0.0], [0.003, 0.004, 0.0005], [0.0, 0.0005, 0.0004]])
    draws = r.multivariate_normal([6.0, 3.0, 0.4], cov, 40_000)
    x_axis, y_axis = [5 - 0.2 * i for i in range(30)], [0.1 * i for i in range(30)]
    one = [(12.0, 9.0, 6.0, 3.0, 0.4, 0.1, 0.1, *np.sqrt(np.diag(cov)).tolist(), cov[0, 1], cov[0, 2], cov[1, 2])]
    names = "x0 double, y0 double, fwhm_major double, fwhm_minor double, theta double, x0_err double, y0_err double, fwhm_major_err double, fwhm_minor_err double, theta_err double, cov_major_minor double, cov_major_theta double, cov_minor_theta double"
    got = coordinates.to_world_axes(spark.createDataFrame([tuple(map(float, one[0]))], names), x_axis, y_axis).first()
    a, b, t = draws.T
    xx = ((a * np.cos(t)) ** 2 + (b * np.sin(t)) ** 2) * 0.04
    yy = ((a * np.sin(t)) ** 2 + (b * np.cos(t)) ** 2) * 0.01
    xy = (a**2 - b**2) * np.cos(t) * np.sin(t) * -0.02
    root = np.sqrt((xx - yy) ** 2 / 4 + xy**2)
    for name, sample in (("fwhm_major", np.sqrt((xx + yy) / 2 + root)), ("fwhm_minor", np.sqrt((xx + yy) / 2 - root)), ("theta", np.arctan2(2 * xy, xx - yy) / 2)):
        assert got[f"world_{name}"] == pytest.approx(sample.mean(), rel=0.02) and got[f"world_{name}_err"] == pytest.approx(sample.std(), rel=0.04)
    assert got.world_x == pytest.approx(2.6) and got.world_x_err == pytest.approx(0.02) and got.world_y_err == pytest.approx(0.01)


def test_tables_with_fewer_axes(spark, monkeypatch):
    img = spark.createDataFrame([(p, c, l, 0, 2.0) for p in (0, 1) for c in (0, 1) for l in range(3)], "plane int, chan int, l int, m int, value double")
    pb = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.0), (1, 0, 4.0)], "chan int, l int, value double")
    for rows in (1_000_000, 0):  # sent around, or joined by a shuffle
        monkeypatch.setattr(gridding, "KERNEL_ROWS", rows)
        got = {(r.plane, r.chan, r.l): r.value for r in coordinates.apply_pb_table(img, pb, multiply=False).collect()}
        assert len(got) == 12 and got[0, 0, 0] == got[1, 0, 0] == 4.0 and got[1, 1, 0] == 0.5 and all(math.isnan(got[k]) for k in ((0, 0, 1), (1, 1, 2)))
    masked = coordinates.apply_mask_table(img, spark.createDataFrame([(0, True), (1, None)], "l int, mask boolean"))
    assert masked.where("not isnan(value)").count() == 4
    with pytest.raises(ValueError):
        coordinates.apply_pb_table(img, spark.createDataFrame([(1.0,)], "value double"))


def test_one_nan_changes_only_its_own_weight(spark):
    vis = drawn(spark, 400)
    hole = lambda c, what: F.when(F.col("event_id") == 7, F.lit(what).cast("double")).otherwise(F.col(c))
    for column, what in (("re", float("nan")), ("im", None), ("weight", float("nan")), ("u", float("nan"))):
        bad, without = vis.withColumn(column, hole(column, what)), vis.where("event_id <> 7")
        one, two = ({(r.chan, r.pol, r.iu, r.iv): (r.re, r.im) for r in gridding.grid(x, N, CELL).collect()} for x in (bad, without))
        assert one.keys() == two.keys() and all(np.allclose(one[k], two[k]) for k in one)
        sums = [sorted(map(tuple, gridding.sum_weight(x, N, CELL).collect())) for x in (bad, without)]
        assert np.allclose(sums[0], sums[1])
    bad = vis.withColumn("weight", hole("weight", float("nan")))
    for scheme in ("natural", "uniform", "briggs", "briggs_abs"):
        a, b = (dict(map(tuple, gridding.imaging_weights(x, scheme, 0.5, N, CELL).collect())) for x in (bad, vis.where("event_id <> 7")))
        assert a.pop(7) == 0.0 and a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_weights_of_hands(spark):
    """Two equal hands weigh as one; a hand that is NaN, flagged or absent takes the other with it."""
    one = drawn(spark, 300).where("not flag").withColumn("t", F.col("event_id").cast("double"))
    two = one.withColumn("pol", F.explode(F.array(F.lit(0), F.lit(1))))
    for scheme in ("uniform", "briggs", "briggs_abs", "natural"):
        want = dict(map(tuple, gridding.imaging_weights(one, scheme, 0.5, N, CELL).collect()))
        got = gridding.averaged_weights(two, scheme, 0.5, N, CELL).collect()
        assert len(got) == 2 * len(want) and all(r.weight_imaging == pytest.approx(want[r.event_id]) for r in got)
    odd = two.withColumn("weight", F.when((F.col("event_id") == 2) & (F.col("pol") == 1), float("nan")).otherwise(F.col("weight")))
    odd = odd.withColumn("flag", (F.col("event_id") == 3) & (F.col("pol") == 0)).where("event_id <> 4 or pol = 0")
    got = {(r.event_id, r.pol): r.weight_imaging for r in gridding.averaged_weights(odd, "uniform", 0.5, N, CELL).collect()}
    assert all(got[k] == 0 for k in ((2, 0), (2, 1), (3, 0), (3, 1), (4, 0))) and got[5, 0] == got[5, 1] > 0


def test_degridding_of_busy_tiles(spark, monkeypatch):
    """Tiles smaller than the grid, and tiles that many tasks share, give the same as one task; rows without a place have 0."""
    vis = drawn(spark, 500).withColumn("u", F.when(F.col("event_id") % 50 == 0, 1e7).when(F.col("event_id") % 50 == 1, float("nan")).otherwise(F.col("u")))
    model = spark.range(2 * 2 * N * N).select((F.col("id") % 2).cast("int").alias("chan"), (F.expr("id div 2") % 2).cast("int").alias("pol"), (F.expr("id div 4") % N).cast("int").alias("iu"), F.expr(f"id div {4 * N}").cast("int").alias("iv"))
    model = model.withColumns({"re": F.sin("iu") + F.col("iv"), "im": F.cos("iv") * F.col("chan")})
    rows = lambda: {r.event_id: (r.re, r.im) for r in gridding.degrid(vis, model, N, CELL).collect()}
    want = rows()
    assert len(want) == 500 and want[0] == want[1] == (0.0, 0.0) and want[2] != (0.0, 0.0)
    monkeypatch.setattr(gridding, "TILE", 16)
    monkeypatch.setattr(gridding, "TOGETHER", 20)
    got = rows()
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_fringes_with_gaps(spark):
    """Antenna 2 lacks the middle channels and antenna 3 some times: delays and rates within a padded bin."""
    rows = [(0, a, 2.0 * t, 1.4e9 + 1e6 * k, 0, 1.0, False) for a in (1, 2, 3) for t in range(12) for k in range(16) if not (a == 2 and 4 <= k < 12) and not (a == 3 and 3 <= t < 9)]
    frame = spark.createDataFrame(rows, "ant1 int, ant2 int, t double, freq double, pol int, weight double, flag boolean")
    phase = F.lit(2 * math.pi) * (F.col("ant2") * 1e-8 * (F.col("freq") - 1.4e9) + F.col("t") * F.col("ant2") * 2e-3)
    frame = frame.withColumns({"re": F.cos(phase), "im": F.sin(phase)})
    for r in calibration.fringe_fit(frame, 0).where("ant > 0").collect():
        assert abs(r.delay - r.ant * 1e-8) <= 1 / (16e6) / 8 and abs(r.rate * 1.4e9 - r.ant * 2e-3) <= 1 / 24 / 8
    by = frame.withColumn("spw", F.lit(0)).unionByName(frame.withColumns({"spw": F.lit(1), "freq": F.col("freq") + 5e8}))
    assert calibration.fringe_fit(by, 0, by=("spw",)).count() == 8
    uneven = frame.withColumn("freq", F.when(F.col("freq") == 1.405e9, 1.4054e9).otherwise(F.col("freq")))
    with pytest.raises(Exception, match="evenly"):
        calibration.fringe_fit(uneven, 0).collect()


def test_a_stream_grids_as_a_batch(spark, tmp_path):
    """Late samples within the watermark count, those behind it do not; a stopped stream goes on from its checkpoint."""
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    first, second = drawn(spark, 300, 5), drawn(spark, 300, 6, 1000, 3600.0)
    late = drawn(spark, 40, 7, 2000, 600.0)  # the first minutes again, when the stream is long past them
    flush = drawn(spark, 2, 8, 3000, 1.0).where("not flag").withColumn("ts", F.col("ts") + F.expr("interval 2 days"))

    def run():
        seen = spark.readStream.schema(SAMPLE).parquet(source)
        stream = grid_windows(seen, "30 minutes", "1 hour", n=N, cell=CELL).writeStream.outputMode("append").format("parquet")
        stream.option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    first.where("ts < '2024-01-01 01:00:00'").write.mode("append").parquet(source)
    run()
    # up to an hour behind the newest sample is in time
    first.where("ts >= '2024-01-01 01:00:00'").unionByName(second).write.mode("append").parquet(source)
    run()
    # behind the watermark now; what comes with it moves the watermark on, and past all
    late.unionByName(flush.withColumn("ts", F.col("ts") - F.expr("interval 44 hours"))).write.mode("append").parquet(source)
    run()
    flush.write.mode("append").parquet(source)
    run()
    got = spark.read.parquet(sink).where("start < 1704081600")  # before four o'clock
    batch = grid_windows(first.unionByName(second), "30 minutes", "1 hour", n=N, cell=CELL)
    key = ["start", "chan", "pol", "iu", "iv"]
    gap = got.join(batch.withColumnsRenamed({c: f"x{c}" for c in ("re", "im", "w")}), key, "full")
    assert got.count() == batch.count() > 1000
    assert gap.agg(F.max(sum((F.abs(F.coalesce(c, F.lit(1e9)) - F.coalesce(f"x{c}", F.lit(-1e9))) for c in ("re", "im", "w")), F.lit(0.0)))).first()[0] < 1e-9
    cells, sums = merged(got)
    whole = gridding.sum_weight(first.unionByName(second), N, CELL)
    assert cells.count() <= batch.count() and np.allclose(sorted(map(tuple, sums.collect())), sorted(map(tuple, whole.collect())))
