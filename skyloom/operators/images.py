"""Image-plane operators on pixel rows, and transforms of whole planes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .planes import KEY, Planes, map_planes

NAN = float("nan")
#: Pixels of a plane up to which a task transforms it whole.
TASK_PIXELS = 1 << 24


def turned_planes(z: np.ndarray, inverse: bool) -> np.ndarray:
    """The centred transform of each plane of a cube."""
    turn = np.fft.ifft2 if inverse else np.fft.fft2
    return np.fft.fftshift(turn(np.fft.ifftshift(z, (1, 2))), (1, 2))


def fft(img: DataFrame, inverse: bool = False, n: int | None = None) -> DataFrame:
    """``plane, chan, l, m, re, im``: the centred 2-D transform of each plane (unnormalised forward; 1/N back). Pixels
    without a row are zero, so a sparse grid needs no filling up; ``n`` is the planes' side where corners may be absent. Planes
    of such a side that have more than ``TASK_PIXELS`` go by strips (``tiles.fft_strips``)."""
    if n and n * n > TASK_PIXELS:
        from .tiles import fft_strips

        return fft_strips(img, n, inverse)

    def run(planes: Planes) -> Iterator[dict]:
        for some, shape, rows in planes.groups(n):
            re, im = (planes.cube(c, some, shape, rows) for c in ("re", "im"))
            y = turned_planes(re + 1j * im, inverse)
            yield planes.all_pixels(some, re=y.real, im=y.imag)

    source = img if "im" in img.columns else img.select(*KEY, "l", "m", F.col("value").alias("re"), F.lit(0.0).alias("im"))
    return map_planes(source, ["l", "m", "re", "im"], run, _places(img) + ", re double, im double")


def _places(img: DataFrame) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in img.select("l", "m").dtypes)


def remove_padding(img: DataFrame, n: int, wanted: int) -> DataFrame:
    """The centre ``wanted`` x ``wanted`` pixels, numbered from 0."""
    low = (n - wanted) // 2
    inside = F.col("l").between(low, low + wanted - 1) & F.col("m").between(low, low + wanted - 1)
    return img.where(inside).withColumns({"l": F.col("l") - low, "m": F.col("m") - low})


def pad(img: DataFrame, n: int, wanted: int) -> DataFrame:
    """Centred in a larger image; pixels outside are absent, which is zero."""
    if n > wanted:
        raise ValueError("the image is larger than the padded one")
    low = (wanted - n) // 2
    return img.withColumns({"l": F.col("l") + low, "m": F.col("m") + low})


def radius(n: int, cell: float) -> Column:
    x, y = (F.col("l") - n // 2) * F.lit(cell), (F.col("m") - n // 2) * F.lit(cell)
    return F.sqrt(x * x + y * y)


def normalize(img: DataFrame, sum_weight: Column, correction: Column, pb: Column, norm_type: str, pb_limit: float = 0.0, single: bool = False) -> DataFrame:
    """Divide by weights, kernel correction and primary beam (flat_noise), or its square (flat_sky); ``none`` keeps."""
    if norm_type not in ("flat_noise", "flat_sky", "none"):
        raise ValueError(f"unknown normalisation {norm_type!r}")
    value = F.col("value")
    if norm_type != "none":
        value = value / sum_weight / (correction * pb * (pb if norm_type == "flat_sky" else F.lit(1.0)))
    if pb_limit > 0:
        value = F.when(pb < pb_limit, NAN).otherwise(value)
    return img.withColumn("value", value.cast("float").cast("double") if single else value)


def apply_pb(img: DataFrame, pb: Column, multiply: bool = True) -> DataFrame:
    """Times the beam, or over it with NaN where it is 0."""
    return img.withColumn("value", F.col("value") * pb if multiply else F.when(pb == 0, NAN).otherwise(F.col("value") / pb))


#: Stokes parameters as (coefficient of the real, of the imaginary part) by correlation.
TO_STOKES = {
    "linear": {"I": (1, 0, 0, 1), "Q": (1, 0, 0, -1), "U": (0, 1, 1, 0), "V": (0, -1j, 1j, 0)},
    "circular": {"I": (1, 0, 0, 1), "Q": (0, 1, 1, 0), "U": (0, -1j, 1j, 0), "V": (1, 0, 0, -1)},
}
FROM_STOKES = {
    "linear": ((0.5, 0.5, 0, 0), (0, 0, 0.5, 0.5j), (0, 0, 0.5, -0.5j), (0.5, -0.5, 0, 0)),
    "circular": ((0.5, 0, 0, 0.5), (0, 0.5, 0.5j, 0), (0, 0.5, -0.5j, 0), (0.5, 0, 0, -0.5)),
}
LABELS = {"linear": ("XX", "XY", "YX", "YY"), "circular": ("RR", "RL", "LR", "LL")}


def combine(row: tuple[complex, ...], parts: list[tuple[Column, Column]]) -> tuple[Column, Column]:
    """A complex combination of (re, im) columns."""
    re, im = F.lit(0.0), F.lit(0.0)
    for c, (a, b) in zip(row, parts):
        c = complex(c)
        if c.real:
            re, im = re + c.real * a, im + c.real * b
        if c.imag:
            re, im = re - c.imag * b, im + c.imag * a
    return re, im


def corr_to_stokes(parts: list[tuple[Column, Column]], feed: str) -> dict[str, tuple[Column, Column]]:
    """Stokes columns of four correlations, or I and the parallel-hand difference of two."""
    if feed not in TO_STOKES:
        raise ValueError(f"unknown feed {feed!r}")
    if len(parts) == 2:
        second = "Q" if feed == "linear" else "V"
        return {"I": combine((1, 1), parts), second: combine((1, -1), parts)}
    if len(parts) != 4:
        raise ValueError("two or four correlations are needed")
    return {s: combine(row, parts) for s, row in TO_STOKES[feed].items()}


def stokes_to_corr(parts: list[tuple[Column, Column]], feed: str) -> dict[str, tuple[Column, Column]]:
    if len(parts) != 4:
        raise ValueError("four Stokes parameters are needed")
    return {name: combine(row, parts) for name, row in zip(LABELS[feed], FROM_STOKES[feed])}


STOKES = "IQUV"


def stokes_of(feed: str, correlations: int) -> tuple[str, ...]:
    """The Stokes parameters that two or four correlations give."""
    if feed not in TO_STOKES or correlations not in (2, 4):
        raise ValueError(f"unknown feed {feed!r} or number of correlations {correlations}")
    return tuple(STOKES) if correlations == 4 else ("I", "Q" if feed == "linear" else "V")


def stokes_rows(feed: str, correlations: int, stokes: tuple[str, ...] | None = None) -> tuple[tuple[complex, ...], ...]:
    """The matrix from correlations to ``stokes`` (all that they give, if none are named)."""
    known = stokes_of(feed, correlations)
    if stokes and set(stokes) - set(known):
        raise ValueError(f"{correlations} {feed} correlations give {known}, not {tuple(stokes)}")
    full = TO_STOKES[feed] if correlations == 4 else dict(zip(known, ((1, 1), (1, -1))))
    return tuple(full[s] for s in stokes or known)


def correlation_rows(feed: str, correlations: int, stokes: tuple[str, ...] | None = None) -> tuple[tuple[complex, ...], ...]:
    """The matrix from ``stokes`` to correlations; Stokes parameters that are not named count as zero."""
    known = stokes_of(feed, correlations)
    stokes = tuple(stokes or known)
    if set(stokes) - set(known):
        raise ValueError(f"{correlations} {feed} correlations hold {known}, not {stokes}")
    full = FROM_STOKES[feed] if correlations == 4 else ((0.5, 0.5), (0.5, -0.5))
    return tuple(tuple(row[known.index(s)] for s in stokes) for row in full)


def mix_planes(df: DataFrame, rows: tuple[tuple[complex, ...], ...], at: tuple[str, ...], plane: str = "plane") -> DataFrame:
    """The planes of every place ``at`` mixed by a matrix, as between correlations and Stokes parameters, or any of one's own:
    output plane i is the sum of ``rows[i][p]`` times plane p. Values are ``re, im``, or real ones as ``value``, of which the
    real part stays. Planes without a row are zero. One aggregation over places; the planes of a place meet in a row."""
    complex_ = "re" in df.columns and "value" not in df.columns
    held = ("re", "im") if complex_ else ("value",)
    own = lambda c, p: F.coalesce(F.sum(F.when(F.col(plane) == p, F.col(c))), F.lit(0.0)).alias(f"_{c}{p}")
    count = len(rows[0])
    wide = df.where(F.col(plane).between(0, count - 1)).groupBy(*at).agg(*[own(c, p) for p in range(count) for c in held])
    parts = [(F.col(f"_{held[0]}{p}"), F.col(f"_im{p}") if complex_ else F.lit(0.0)) for p in range(count)]
    mixed = [combine(row, parts) for row in rows]
    each = F.array(*[F.struct(F.lit(i).cast(dict(df.dtypes)[plane]).alias(plane), *[c.alias(name) for name, c in zip(held, pair)]) for i, pair in enumerate(mixed)])
    return wide.select(*at, F.explode(each).alias("_x")).select(*at, f"_x.{plane}", *[f"_x.{c}" for c in held])


def image_corr_to_stokes(img: DataFrame, feed: str, correlations: int = 4, stokes: tuple[str, ...] | None = None, at: tuple[str, ...] = ("chan", "l", "m"), plane: str = "plane") -> DataFrame:
    """Pixel rows by correlation as pixel rows by Stokes parameter, numbered in the order of ``stokes``."""
    return mix_planes(img, stokes_rows(feed, correlations, stokes), at, plane)


def image_stokes_to_corr(img: DataFrame, feed: str, correlations: int = 4, stokes: tuple[str, ...] | None = None, at: tuple[str, ...] = ("chan", "l", "m"), plane: str = "plane") -> DataFrame:
    return mix_planes(img, correlation_rows(feed, correlations, stokes), at, plane)


def moment_max(img: DataFrame, axis: str = "plane") -> DataFrame:
    """The largest value over ``axis``, NaN left out."""
    keys = [c for c in img.columns if c not in (axis, "value")]
    return img.where(~F.isnan("value")).groupBy(*keys).agg(F.max("value").alias("value"))


def masksum(img: DataFrame, mask: Column | None = None) -> DataFrame:
    return img.groupBy(*KEY).agg(F.sum((mask if mask is not None else F.lit(True)).cast("long")).alias("masksum"))


def peak_residual(img: DataFrame, mask: Column | None = None) -> DataFrame:
    """The signed value at the largest magnitude of each plane; of equal ones the first pixel's."""
    seen = img.where(mask) if mask is not None else img
    order = F.struct(F.abs("value").alias("a"), (-(F.col("l") * 65536 + F.col("m"))).alias("b"))
    return seen.where(~F.isnan("value")).groupBy(*KEY).agg(F.max_by("value", order).alias("peak"))


def make_mask(img: DataFrame, threshold: float, other: Column | None = None) -> DataFrame:
    """``mask`` where the value reaches the threshold (and ``other`` holds); ``mask0`` is its inverse."""
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold lies between 0 and 1")
    mask = F.coalesce((F.col("value") >= threshold) & ~F.isnan("value"), F.lit(False))
    mask = mask & other if other is not None else mask
    return img.withColumn("mask", mask).withColumn("mask0", ~F.col("mask"))


def _turned(x0: float, y0: float, theta: float) -> tuple[Column, Column]:
    dx, dy = F.col("l") - F.lit(x0), F.col("m") - F.lit(y0)
    c, s = math.cos(theta), math.sin(theta)
    return dx * c + dy * s, dy * c - dx * s


def make_disk(img: DataFrame, amp: float, x0: float, y0: float, a: float, b: float, theta: float, add: bool = True) -> DataFrame:
    x, y = _turned(x0, y0, theta)
    inside = (x / a) * (x / a) + (y / b) * (y / b) <= 1
    return img.withColumn("value", F.when(inside, (F.col("value") if add else F.lit(0.0)) + amp).otherwise(F.col("value")))


def make_gauss2d(img: DataFrame, amp: float, x0: float, y0: float, fwhm_a: float, fwhm_b: float, theta: float, add: bool = True) -> DataFrame:
    x, y = _turned(x0, y0, theta)
    k = 4 * math.log(2)
    g = amp * F.exp(-k * ((x / fwhm_a) * (x / fwhm_a) + (y / fwhm_b) * (y / fwhm_b)))
    return img.withColumn("value", F.col("value") + g if add else F.when(g != 0, g).otherwise(F.col("value")))


def point_sources(sources: DataFrame, n: int, policy: str = "ignore") -> DataFrame:
    """``l, m, amp``: sources ``x, y, amp`` summed into their nearest pixels (ties to the right). Outside the image they
    are dropped (ignore), kept within half a pixel (ignore_sloppy), moved to the edge (clip), or raise (error)."""
    l, m = F.floor(F.col("x") + 0.5), F.floor(F.col("y") + 0.5)
    sources = sources.withColumns({"l": l.cast("int"), "m": m.cast("int")})
    exact = F.col("x").between(0, n - 1) & F.col("y").between(0, n - 1)
    if policy == "ignore":
        sources = sources.where(exact)
    elif policy == "ignore_sloppy":
        sources = sources.where(F.col("x").between(-0.5, n - 0.5) & F.col("y").between(-0.5, n - 0.5))
    elif policy == "error":
        sources = sources.withColumn("l", F.when(exact, F.col("l")).otherwise(F.raise_error(F.lit("source outside the image")).cast("int")))
    elif policy != "clip":
        raise ValueError(f"unknown policy {policy!r}")
    edge = lambda c: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.col(c)))
    return sources.groupBy(edge("l").alias("l"), edge("m").alias("m")).agg(F.sum("amp").alias("amp"))


def feather(high: DataFrame, low: DataFrame, n: int, alpha: float | Column, beta: float | Column, omega: float | Column = 1.0, factor: float = 1.0) -> DataFrame:
    """``plane, chan, l, m, value``: two skies combined in the transform plane; the low-resolution beam of widths
    ``alpha, beta`` (in cells) weights them, ``omega`` is the ratio of beam areas. These three may be columns of ``high``, as
    for beams by channel. Planes of one side only are left out; planes that are no ``n`` x ``n`` raise. One shuffle deals
    out both sides."""
    given = [c if isinstance(c, Column) else F.lit(float(c)) for c in (alpha, beta, omega)]
    names = ("alpha", "beta", "omega")
    one = high.select(*KEY, F.lit(0).alias("side"), "l", "m", "value", *[c.cast("double").alias(k) for k, c in zip(names, given)])
    two = low.select(*KEY, F.lit(1).alias("side"), "l", "m", "value", *[F.lit(0.0).alias(k) for k in names])
    axis = (np.arange(n) - n // 2) / n

    def run(planes: Planes) -> Iterator[dict]:
        side, l, m = (planes.columns[c] for c in ("side", "l", "m"))
        if l.max() >= n or m.max() >= n or min(l.min(), m.min()) < 0:
            raise ValueError(f"an image to feather is no {n} x {n} pixels")
        for some, shape, rows in planes.groups(n):
            sides = [planes.cube("value", some, shape, rows[side[rows] == k]) for k in (0, 1)]
            held = [np.bincount(np.searchsorted(some, planes.owner[rows[side[rows] == k]]), minlength=len(some)) for k in (0, 1)]
            both = np.flatnonzero((held[0] > 0) & (held[1] > 0))
            if not len(both):
                continue
            if (held[0][both] != n * n).any() or (held[1][both] != n * n).any():
                raise ValueError(f"an image to feather lacks pixels of its {n} x {n}")
            a, b = (turned_planes(z[both], False) for z in sides)
            first = planes.starts[some[both]]  # the high side comes first
            wide, narrow, ratio = (planes.columns[k][first][:, None, None] for k in names)
            w = np.exp(-(math.pi**2) / (4 * math.log(2)) * ((wide * axis[:, None]) ** 2 + (narrow * axis[None, :]) ** 2))
            mixed = ((1 - w) * a + factor * ratio * b * w) / ((1 - w) + factor * w)
            yield planes.all_pixels(some[both], value=turned_planes(mixed, True).real)

    return map_planes(one.unionByName(two), ["side", "l", "m", "value", *names], run, _places(high) + ", value double", ("side", "l", "m"))
