"""World coordinates: the sine projection, axes given as values of pixels, and tables whose axes may be fewer than an image's."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gridding import to_all

#: Axes that a table of images, beams or masks may have.
AXES = ("t", "chan", "plane", "pol", "l", "m")
POLICIES = ("ignore", "ignore_sloppy", "clip", "error")


def _rising(axis: list[float]) -> tuple[list[float], bool]:
    """A strictly monotone axis in rising order, and whether it was turned round."""
    values = [float(x) for x in axis]
    steps = np.diff(values)
    if not values or not np.isfinite(values).all() or not ((steps > 0).all() or (steps < 0).all()):
        raise ValueError("an axis has finite values that rise or fall throughout")
    return (values[::-1], True) if len(values) > 1 and steps[0] < 0 else (values, False)


def lower_bound(value: Column, values: Column, n: int) -> Column:
    """How many of ``n`` rising ``values`` (an array) lie below ``value``, by binary search."""
    state = F.struct(F.lit(0).alias("low"), F.lit(n).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        below = F.coalesce(F.get(values, middle) < value, F.lit(False)) & (s["low"] < s["high"])
        return F.struct(F.when(below, middle + 1).otherwise(s["low"]).alias("low"), F.when(below, s["high"]).otherwise(F.least(middle, s["high"])).alias("high"))

    rounds = F.sequence(F.lit(1), F.lit(max(1, n.bit_length())))
    return F.aggregate(rounds, state, halve, lambda s: s["low"])


def nearest_index(value: Column, axis: list[float]) -> Column:
    """The index of the nearest value of a monotone axis, rising or falling, evenly spaced or not; of two equally near ones that
    with the larger value. Null where ``value`` is null or NaN."""
    rising, turned = _rising(axis)
    n, values = len(rising), F.array(*[F.lit(x) for x in rising])
    right = F.least(lower_bound(value, values, n), F.lit(n - 1))
    left = F.greatest(right - 1, F.lit(0))
    right = F.when(value > F.lit(rising[-1]), F.lit(n - 1)).otherwise(right)
    found = F.when(F.abs(F.get(values, right) - value) <= F.abs(value - F.get(values, left)), right).otherwise(left)
    found = F.when(value.isNotNull() & ~F.isnan(value), found)
    return (F.lit(n - 1) - found if turned else found).cast("int")


def within(value: Column, axis: list[float], sloppy: bool = False) -> Column:
    """Whether a value lies on an axis; ``sloppy`` adds half a pixel at either end."""
    rising, _ = _rising(axis)
    ends = (abs(rising[1] - rising[0]) / 2, abs(rising[-1] - rising[-2]) / 2) if sloppy and len(rising) > 1 else (0.0, 0.0)
    return value.between(F.lit(rising[0] - ends[0]), F.lit(rising[-1] + ends[1]))


def point_sources_world(sources: DataFrame, l_axis: list[float], m_axis: list[float], policy: str = "ignore") -> DataFrame:
    """``l, m, amp``: sources at world coordinates ``x, y`` summed into the nearest pixels of two axes. Outside these they are
    dropped (ignore), kept within half a pixel (ignore_sloppy), moved to the edge (clip), or raise (error); so are those
    without coordinates, which no policy keeps."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}; known are {POLICIES}")
    axes = (("x", l_axis, "l"), ("y", m_axis, "m"))
    inside = F.lit(True)
    for c, axis, _ in axes:
        inside = inside & F.coalesce(within(F.col(c), axis, policy == "ignore_sloppy"), F.lit(False))
    if policy in ("ignore", "ignore_sloppy"):
        sources = sources.where(inside)
    at = sources.select(*[nearest_index(F.col(c), axis).alias(name) for c, axis, name in axes], "amp", inside.alias("_in"))
    if policy == "error":
        at = at.withColumn("l", F.when(F.col("_in"), F.col("l")).otherwise(F.raise_error(F.lit("source outside the image")).cast("int")))
    return at.where("l is not null and m is not null").groupBy("l", "m").agg(F.sum("amp").alias("amp"))


def interpolated(value: Column, xs: list[float], ys: list[float]) -> Column:
    """``ys`` at ``value``, linear between the points of the monotone axis ``xs`` and constant beyond it."""
    return _line(value, xs, ys)[0]


def _line(value: Column, xs: list[float], ys: list[float]) -> tuple[Column, Column]:
    """The piecewise linear function through (xs, ys), and its slope (that of the outer pieces beyond the ends)."""
    rising, turned = _rising(xs)
    heights = [float(y) for y in (list(ys)[::-1] if turned else ys)]
    n = len(rising)
    if n == 1:
        return F.lit(heights[0]) + value * 0, F.lit(0.0)
    x, y = (F.array(*[F.lit(v) for v in values]) for values in (rising, heights))
    k = F.least(F.greatest(lower_bound(value, x, n) - 1, F.lit(0)), F.lit(n - 2))
    slope = (F.get(y, k + 1) - F.get(y, k)) / (F.get(x, k + 1) - F.get(x, k))
    inner = F.get(y, k) + slope * (value - F.get(x, k))
    return F.when(value <= rising[0], heights[0]).when(value >= rising[-1], heights[-1]).otherwise(inner), slope


def deproject(l: Column, m: Column, centre: tuple[float, float]) -> tuple[Column, Column]:
    """Right ascension (0 to 2 pi) and declination of direction cosines ``l, m`` about ``centre``; null beyond the horizon."""
    ra0, dec0 = centre
    n2 = 1 - l * l - m * m
    n = F.when(n2 >= 0, F.sqrt(F.greatest(n2, F.lit(0.0))))
    ra = F.atan2(l, n * math.cos(dec0) - m * math.sin(dec0)) + ra0
    dec = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), m * math.cos(dec0) + n * math.sin(dec0))))
    return F.when(n.isNotNull(), F.pmod(ra, F.lit(2 * math.pi))), F.when(n.isNotNull(), dec)


def image_coordinates(img: DataFrame, n: tuple[int, int], cell: tuple[float, float], centre: tuple[float, float], frequencies: list[float] | None = None) -> DataFrame:
    """Pixels with ``l_rad, m_rad`` (direction cosines; a negative ``cell`` makes them fall), ``ra, dec`` (radians), ``u_wave,
    v_wave`` (wavelengths of the transform's cell with the same indices) and, with ``frequencies``, ``freq`` and
    ``channel_width`` (the distance to the next channel, of the last one to that before)."""
    axis = [(F.col(c) - size // 2) * float(step) for c, size, step in zip("lm", n, cell)]
    ra, dec = deproject(*axis, centre)
    uv = [(F.col(c) - size // 2) / (size * float(step)) for c, size, step in zip("lm", n, cell)]
    out = img.withColumns({"l_rad": axis[0], "m_rad": axis[1], "ra": ra, "dec": dec, "u_wave": uv[0], "v_wave": uv[1]})
    if frequencies is None:
        return out
    widths = np.diff(frequencies).tolist() or [0.0]
    look = lambda values: F.get(F.array(*[F.lit(float(v)) for v in values]), F.col("chan"))
    return out.withColumns({"freq": look(frequencies), "channel_width": look([*widths, widths[-1]][: len(frequencies)])})


def to_world_axes(fits: DataFrame, x_axis: list[float], y_axis: list[float]) -> DataFrame:
    """Fits (see ``fitting.fit_multi_gaussian2d``) in world coordinates of two monotone axes, each given by its pixels' values:
    ``world_x, world_y, world_fwhm_major, world_fwhm_minor, world_theta`` and an error of each (``*_err``). Between pixels
    axes are linear; widths and angle use the slopes at the centre. Errors go through the derivatives of the world's second
    moments; covariances are used where the fits have them (``cov_major_minor, cov_major_theta, cov_minor_theta``)."""
    pixels = [list(range(len(axis))) for axis in (x_axis, y_axis)]
    (wx, dx), (wy, dy) = (_line(F.col(c), p, axis) for c, p, axis in zip(("x0", "y0"), pixels, (x_axis, y_axis)))
    out = fits.withColumns({"_wx": wx, "_wy": wy, "_dx": dx, "_dy": dy, "_c": F.cos("theta"), "_s": F.sin("theta")})
    a, b, c, s, dx, dy = (F.col(k) for k in ("fwhm_major", "fwhm_minor", "_c", "_s", "_dx", "_dy"))
    gap = a * a - b * b
    out = out.withColumns(
        {"_xx": (a * a * c * c + b * b * s * s) * dx * dx, "_yy": (a * a * s * s + b * b * c * c) * dy * dy, "_xy": gap * c * s * dx * dy}
    )
    xx, yy, xy = F.col("_xx"), F.col("_yy"), F.col("_xy")
    out = out.withColumn("_root", F.sqrt((xx - yy) * (xx - yy) / 4 + xy * xy))
    root = F.col("_root")
    out = out.withColumns({"_major": F.sqrt((xx + yy) / 2 + root), "_minor": F.sqrt(F.greatest((xx + yy) / 2 - root, F.lit(0.0)))})
    moments = {  # derivatives of the three moments by major, minor, theta
        "major": (2 * a * c * c * dx * dx, 2 * a * s * s * dy * dy, 2 * a * c * s * dx * dy),
        "minor": (2 * b * s * s * dx * dx, 2 * b * c * c * dy * dy, -2 * b * c * s * dx * dy),
        "theta": (-2 * c * s * gap * dx * dx, 2 * c * s * gap * dy * dy, gap * (c * c - s * s) * dx * dy),
    }

    def by(kind: str, of: str) -> Column:
        mxx, myy, mxy = moments[of]
        if kind == "theta":
            return ((xx - yy) * mxy - xy * (mxx - myy)) / (4 * root * root)
        turn = ((xx - yy) * (mxx - myy) / 4 + xy * mxy) / root
        half = (mxx + myy) / 2
        return (half + turn) / (2 * F.col("_major")) if kind == "major" else (half - turn) / (2 * F.col("_minor"))

    sigma = {"major": F.col("fwhm_major_err"), "minor": F.col("fwhm_minor_err"), "theta": F.col("theta_err")}
    pairs = [(i, k) for i, k in (("major", "minor"), ("major", "theta"), ("minor", "theta")) if f"cov_{i}_{k}" in fits.columns]

    def error(kind: str) -> Column:
        variance = sum((by(kind, k) * by(kind, k) * sigma[k] * sigma[k] for k in sigma), F.lit(0.0))
        for i, k in pairs:
            variance = variance + 2 * by(kind, i) * by(kind, k) * F.col(f"cov_{i}_{k}")
        return F.when(root > 0, F.sqrt(F.greatest(variance, F.lit(0.0))))  # a round source has no angle

    out = out.withColumns({f"_{k}_err": error(k) for k in sigma})
    return out.select(
        *fits.columns, F.col("_wx").alias("world_x"), F.col("_wy").alias("world_y"), F.col("_major").alias("world_fwhm_major"), F.col("_minor").alias("world_fwhm_minor"), (F.atan2(2 * xy, xx - yy) / 2).alias("world_theta"),
        (F.col("x0_err") * F.abs("_dx")).alias("world_x_err"), (F.col("y0_err") * F.abs("_dy")).alias("world_y_err"), F.col("_major_err").alias("world_fwhm_major_err"), F.col("_minor_err").alias("world_fwhm_minor_err"), F.col("_theta_err").alias("world_theta_err"),
    )


def joined(img: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """``img`` with ``column`` of a table that has some of its axes; the others spread. The table is sent to all tasks if it is
    small enough and else joined by its axes, of which it must have one; pixels that it lacks have null."""
    axes = [c for c in AXES if c in img.columns and c in table.columns]
    if not axes:
        raise ValueError("the tables have no axis in common")
    return img.join(to_all(table.select(*axes, F.col(column).alias("_" + column))), axes, "left")


def apply_pb_table(img: DataFrame, pb: DataFrame, multiply: bool = True) -> DataFrame:
    """Pixels times a beam ``pb(axes.., value)``, or over it with NaN where it is 0, NaN or absent."""
    wide = joined(img, pb, "value").withColumnRenamed("_value", "_pb")
    beam = F.coalesce("_pb", F.lit(float("nan")))
    value = F.col("value") * beam if multiply else F.when(beam == 0, float("nan")).otherwise(F.col("value") / beam)
    return wide.withColumn("value", value).select(*img.columns)


def apply_mask_table(img: DataFrame, mask: DataFrame) -> DataFrame:
    """Pixels with NaN where a mask ``mask(axes.., mask)`` is false, null or absent."""
    wide = joined(img, mask, "mask")
    return wide.withColumn("value", F.when(F.coalesce("_mask", F.lit(False)), F.col("value")).otherwise(float("nan"))).select(*img.columns)
