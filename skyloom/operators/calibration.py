"""Phase shifts, spectral regridding, and fringe fitting."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import LIGHT, cexp, cmul


def rotation(old: tuple[float, float], new: tuple[float, float]) -> np.ndarray:
    """Turns uvw from one phase centre (right ascension, declination) to another."""

    def to_uvw(ra: float, dec: float) -> np.ndarray:
        s, c, sd, cd = math.sin(ra), math.cos(ra), math.sin(dec), math.cos(dec)
        return np.array([[-s, c, 0.0], [-sd * c, -sd * s, cd], [cd * c, cd * s, sd]])

    return to_uvw(*new) @ to_uvw(*old).T


def direction(ra: float, dec: float) -> np.ndarray:
    return np.array([math.cos(dec) * math.cos(ra), math.cos(dec) * math.sin(ra), math.sin(dec)])


def path(old: tuple[float, float], new: tuple[float, float]) -> np.ndarray:
    """The difference of two phase centres in the uvw frame of the old one."""
    s, c, sd, cd = math.sin(old[0]), math.cos(old[0]), math.sin(old[1]), math.cos(old[1])
    frame = np.array([[-s, c, 0.0], [-sd * c, -sd * s, cd], [cd * c, cd * s, sd]])
    return frame @ (direction(*old) - direction(*new))


def phase_shift(vis: DataFrame, old: tuple[float, float], new: tuple[float, float], common_tangent: bool = False) -> DataFrame:
    """uvw turned, and visibilities times exp(2 pi i (uvw . d) nu / c); the common tangent plane leaves w out."""
    r = rotation(old, new)
    d = path(old, new)
    u, v, w = F.col("u"), F.col("v"), F.col("w")
    length = u * float(d[0]) + v * float(d[1])
    length = length if common_tangent else length + w * float(d[2])
    re, im = cmul((F.col("re"), F.col("im")), cexp(F.lit(2 * math.pi) * length * F.col("freq") / F.lit(LIGHT)))
    turned = [u * float(r[k, 0]) + v * float(r[k, 1]) + w * float(r[k, 2]) for k in range(3)]
    return vis.withColumns({"re": re, "im": im, "u": turned[0], "v": turned[1], "w": turned[2]})


def interpolate_channels(samples: DataFrame, keys: list[str], targets: DataFrame, extrapolate: bool = False, values: tuple[str, ...] = ("value",)) -> DataFrame:
    """``keys, out_freq`` and ``values``: linear interpolation of ``samples(keys, freq, values)`` at ``targets(out_freq)``;
    outside the range 0, or extrapolated from the nearest two. ``targets`` is the list of output channels. Each interval
    between two samples gives the output channels within it (the outer ones those beyond), so every output row arises
    once, without a second aggregation."""
    order = Window.partitionBy(*keys).orderBy("freq")
    steps = samples.select(
        *keys, F.col("freq").alias("f0"), F.lead("freq").over(order).alias("f1"), F.row_number().over(order).alias("k"), F.count("*").over(Window.partitionBy(*keys)).alias("n"),
        *[F.struct(F.col(v).alias("a"), F.lead(v).over(order).alias("b")).alias(f"s_{v}") for v in values],
    ).where("f1 is not null")
    wanted = targets.agg(F.sort_array(F.collect_set("out_freq"))).scalar()  # one row: the list of channels
    first, last = F.col("k") == 1, F.col("k") == F.col("n") - 1
    between = lambda x: (x >= F.col("f0")) & ((x < F.col("f1")) | (last & (x == F.col("f1"))))
    wide = steps.withColumn("wanted", wanted).withColumn("out_freq", F.explode(F.filter("wanted", lambda x: between(x) | (first & (x < F.col("f0"))) | (last & (x > F.col("f1"))))))
    x = F.col("out_freq")
    at = (x - F.col("f0")) / (F.col("f1") - F.col("f0"))
    line = lambda v: F.col(f"s_{v}.a") + (F.col(f"s_{v}.b") - F.col(f"s_{v}.a")) * at
    return wide.select(*keys, "out_freq", *[(line(v) if extrapolate else F.when(between(x), line(v)).otherwise(0.0)).alias(v) for v in values])


def convert_frame(vis: DataFrame, factors: DataFrame, targets: DataFrame, keys: tuple[str, ...] = ("t", "ant1", "ant2", "pol")) -> DataFrame:
    """``keys, out_freq, re, im, weight`` in another spectral frame: frequencies times the Doppler factor of their time,
    visibilities and weights (0 where flagged) interpolated at uniform ``targets(out_freq)``. ``factors(t, factor)`` has a
    row a time; times without one keep their frequencies."""
    moved = vis.join(factors, "t", "left").withColumn("freq", F.col("freq") * F.coalesce("factor", F.lit(1.0)))
    return regridded(moved, targets, keys)


def regridded(moved: DataFrame, targets: DataFrame, keys: tuple[str, ...] = ("t", "ant1", "ant2", "pol")) -> DataFrame:
    """``keys, out_freq, re, im, weight``: samples at their ``freq`` interpolated at ``targets(out_freq)``."""
    moved = moved.withColumn("weight", F.when(F.col("flag"), 0.0).otherwise(F.col("weight")))
    merged = moved.groupBy(*keys, "freq").agg(F.avg("re").alias("re"), F.avg("im").alias("im"), F.avg("weight").alias("weight"))
    return interpolate_channels(merged, list(keys), targets, values=("re", "im", "weight"))


def lsr_factor(velocity: Column) -> Column:
    """The relativistic Doppler factor of a velocity (m/s, receding) along the line of sight."""
    b = velocity / LIGHT
    return F.sqrt((1 - b) / (1 + b))


def fourier_spacing(n: int, step: float, pad: int = 8) -> float:
    return 1.0 / (n * step) / pad


#: The exponent of the signal-to-noise ratio and its value where phases agree fully (fixed values).
SNR_POWER, SNR_FULL, SNR_REFERENCE = 1.163, 9999.0, 1e9


def hands(correlations: int) -> tuple[Column, Column]:
    """The receptors (0, 1) of a row's ``pol`` at both ends: with two correlations the parallel hands, with four all."""
    if correlations not in (2, 4):
        raise ValueError("there are two or four correlations")
    pol = F.col("pol")
    return (pol, pol) if correlations == 2 else ((pol / 2).cast("int"), (pol % 2).cast("int"))


def even_axis(df: DataFrame, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``by, {column}0, {column}_step, {column}_n``: the start, step and length of the evenly spaced axis on which the values of
    a column lie; the step is the least distance of two values. Values between its points raise."""
    values = df.where(F.col(column).isNotNull() & ~F.isnan(column)).select(*by, column).distinct()
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy(column)  # distinct times or channels of one data set
    steps = values.withColumn("_d", F.col(column) - F.lag(column).over(order))
    found = steps.groupBy(*by).agg(F.min(column).alias(f"{column}0"), F.coalesce(F.min("_d"), F.lit(1.0)).alias("_s"), F.max(column).alias("_m"), F.collect_set("_d").alias("_all"))
    count = F.rint((F.col("_m") - F.col(f"{column}0")) / F.col("_s"))
    # The mean step over the whole axis is more exact than a single difference.
    step = F.when(count > 0, (F.col("_m") - F.col(f"{column}0")) / count).otherwise(F.col("_s"))
    odd = F.exists("_all", lambda d: F.abs(d / F.col("_s") - F.rint(d / F.col("_s"))) > 0.05)
    checked = F.when(odd, F.raise_error(F.lit(f"the values of {column} are not evenly spaced")).cast("int")).otherwise(count.cast("int") + 1)
    return found.select(*by, f"{column}0", step.alias(f"{column}_step"), checked.alias(f"{column}_n"))


def fringe_fit(
    vis: DataFrame, reference: int, pad: int = 8, by: tuple[str, ...] = (), times: tuple[float, float] | None = None, reference_frequency: float | None = None, correlations: int = 2
) -> DataFrame:
    """``ant, pol, phase, delay, rate, snr`` of every antenna against the reference: the peak of the zero-padded
    transform over time and frequency of phase-only data. Phases are those that ``apply_calibration`` takes off: of the
    baseline from the reference to the antenna. ``by`` names further keys (a spectral window, say) fitted each for itself;
    ``times`` is an inclusive interval; phases are given at ``reference_frequency`` (the first one if none). Times and
    channels are numbered on the even axes of all the data, so rows that an antenna lacks leave gaps. Flagged and NaN
    samples have no weight. The reference antenna itself has zeros. ``pol`` is the receptor; of four correlations only the
    parallel hands are fitted."""
    vis = vis.where(F.col("t").between(*times)) if times else vis
    one, two = hands(correlations)
    pairs = vis.where(((F.col("ant1") == reference) != (F.col("ant2") == reference)) & (one == two)).withColumn("pol", one)
    flip = F.when(F.col("ant1") == reference, 1.0).otherwise(-1.0)
    bad = F.isnan("re") | F.isnan("im") | F.isnan("weight") | F.col("re").isNull() | F.col("im").isNull() | F.col("weight").isNull()
    bad = bad | F.col("flag") if "flag" in vis.columns else bad
    ant = F.when(F.col("ant1") == reference, F.col("ant2")).otherwise(F.col("ant1")).cast("int")
    zero = lambda c: F.when(bad, 0.0).otherwise(c)
    axes = [even_axis(vis.select(*by, F.col(c).cast("double").alias(c)), c, by) for c in ("t", "freq")]
    pairs = pairs.select(*by, F.col("pol").cast("int").alias("pol"), ant.alias("ant"), "t", "freq", zero(F.col("weight")).alias("weight"), zero(F.col("re")).alias("re"), zero(F.col("im") * flip).alias("im"))
    one_key = F.lit(0).alias("_all")
    for axis in axes:  # a row for all the data, or one for each of ``by``
        pairs = pairs.join(axis, list(by)) if by else pairs.select("*", one_key).join(axis.select("*", one_key), "_all").drop("_all")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        shape = int(first["t_n"]), int(first["freq_n"])
        dt, df, low = float(first["t_step"]), float(first["freq_step"]), float(first["freq0"])
        x, w = np.zeros(shape, complex), np.zeros(shape)
        v = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        size = np.abs(v)
        at = tuple(np.rint((pdf[c].to_numpy() - float(first[f"{c}0"])) / float(first[f"{c}_step"])).astype(int) for c in ("t", "freq"))
        np.add.at(x, at, np.where(size > 0, v / np.where(size > 0, size, 1), 0) * pdf["weight"].to_numpy())
        np.add.at(w, at, pdf["weight"].to_numpy())
        y = np.fft.fft2(x, (pad * shape[0], pad * shape[1]))
        i, k = np.unravel_index(int(np.abs(y).argmax()), y.shape)
        i2, k2 = (i if i < y.shape[0] / 2 else i - y.shape[0]), (k if k < y.shape[1] / 2 else k - y.shape[1])
        total, n = w.sum(), int((pdf["weight"].to_numpy() > 0).sum())
        share = min(np.abs(y[i, k]) / total, 1.0) if total > 0 else 0.0
        square = float((pdf["weight"].to_numpy() ** 2).sum())
        snr = 0.0 if total <= 0 else SNR_FULL if share > 0.99 else math.tan(math.pi / 2 * share) ** SNR_POWER * math.sqrt(total / math.sqrt(square / n))
        at_reference = low if reference_frequency is None else reference_frequency
        delay = k2 * fourier_spacing(shape[1], df, pad)
        phase = float(np.angle(y[i, k])) - 2 * math.pi * delay * (low - at_reference)
        rate = i2 * fourier_spacing(shape[0], dt, pad) / at_reference
        return pd.DataFrame({**{k: [first[k]] for k in by}, "ant": [int(first["ant"])], "pol": [int(first["pol"])], "phase": [phase], "delay": [delay], "rate": [float(rate)], "snr": [float(snr)]})

    fields = "".join(f"{k} {dict(vis.dtypes)[k]}, " for k in by)
    found = pairs.groupBy(*by, "ant", "pol").applyInPandas(run, fields + "ant int, pol int, phase double, delay double, rate double, snr double")
    own = pairs.select(*by, "pol").distinct().select(*by, F.lit(reference).alias("ant"), "pol", *[F.lit(0.0).alias(c) for c in ("phase", "delay", "rate")], F.lit(SNR_REFERENCE).alias("snr"))
    return found.unionByName(own)


def empty_solutions(vis: DataFrame, by: tuple[str, ...] = (), correlations: int = 2) -> DataFrame:
    """``by, ant, pol, phase, delay, rate, snr``: a row for every antenna and receptor of the data, without values (NaN)."""
    one, _ = hands(correlations)
    ends = vis.select(*by, F.explode(F.array(F.col("ant1").cast("int"), F.col("ant2").cast("int"))).alias("ant"), one.cast("int").alias("pol")).distinct()
    return ends.select(*by, "ant", "pol", *[F.lit(float("nan")).alias(c) for c in ("phase", "delay", "rate", "snr")])


def calibration_phase(phase: Column, delay: Column, rate: Column, f0: float, t0: float) -> Column:
    return phase + F.lit(2 * math.pi) * (delay * (F.col("freq") - f0) + F.lit(f0) * rate * (F.col("t") - t0))


def apply_calibration(vis: DataFrame, cal: DataFrame, f0: float, t0: float, by: tuple[str, ...] = (), correlations: int = 2) -> DataFrame:
    """J1 V J2*, that is V times exp(i (phase1 - phase2)), each end by its own receptor; antennas without solutions (or with
    NaN) count as 0. ``cal(ant, pol, phase, delay, rate)`` has a row an antenna and receptor, and further keys ``by`` (a
    spectral window) where named. With four ``correlations``, ``pol`` counts 00, 01, 10, 11."""
    ends = []
    for k, hand in zip((1, 2), ("hand1", "hand2")):
        ends.append(cal.select(*by, F.col("ant").alias(f"ant{k}"), F.col("pol").alias(hand), *[F.col(c).alias(f"{c}{k}") for c in ("phase", "delay", "rate")]))
    one, two = hands(correlations)
    wide = vis.withColumns({"hand1": one, "hand2": two}).join(ends[0], [*by, "ant1", "hand1"], "left").join(ends[1], [*by, "ant2", "hand2"], "left")
    p = [F.coalesce(F.nanvl(calibration_phase(*[F.col(f"{c}{k}") for c in ("phase", "delay", "rate")], f0, t0), F.lit(0.0)), F.lit(0.0)) for k in (1, 2)]
    re, im = cmul((F.col("re"), F.col("im")), cexp(p[0] - p[1]))
    return wide.withColumns({"re": re, "im": im}).select(vis.columns)
