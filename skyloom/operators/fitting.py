"""Gaussian fits by plane: several components, and the main lobe of a PSF."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import FWHM
from .planes import KEY, Planes, map_planes


def gaussians(p: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offset plus components (amplitude, x0, y0, sigma a, sigma b, theta), and the Jacobian. Leading axes of ``p`` are
    planes; ``x`` and ``y`` are one list of points for all."""
    p = np.asarray(p, float)
    out = np.repeat(p[..., :1], len(x), -1)
    jac = [np.ones_like(out)]
    for amp, x0, y0, a, b, t in np.moveaxis(p[..., 1:].reshape(*p.shape[:-1], (p.shape[-1] - 1) // 6, 6), (-2, -1), (0, 1))[..., None]:
        c, s = np.cos(t), np.sin(t)
        dx, dy = x - x0, y - y0
        u, v = dx * c + dy * s, dy * c - dx * s
        g = np.exp(-0.5 * ((u / a) ** 2 + (v / b) ** 2))
        out = out + amp * g
        jac += [g, amp * g * (u * c / a**2 - v * s / b**2), amp * g * (u * s / a**2 + v * c / b**2), amp * g * u**2 / a**3, amp * g * v**2 / b**3, amp * g * u * v * (1 / b**2 - 1 / a**2)]
    return out, np.stack(jac, -1)


def seeds(z: np.ndarray, n: int, exclude: int = 3) -> np.ndarray:
    """Greedy maxima with a square left out around each; the offset is the median."""
    left, offset = z - np.nanmedian(z), float(np.nanmedian(z))
    p = [offset]
    for _ in range(n):
        i, k = np.unravel_index(int(np.nanargmax(left)), left.shape)
        p += [float(left[i, k]), float(i), float(k), max(1.0, exclude / 2), max(1.0, exclude / 2) * 0.9, 0.0]
        left = left.copy()
        left[max(0, i - exclude) : i + exclude + 1, max(0, k - exclude) : k + exclude + 1] = -np.inf
    return np.array(p)


def _solved(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(h, g[..., None])[..., 0]
    except np.linalg.LinAlgError:
        return (np.linalg.pinv(h, hermitian=True) @ g[..., None])[..., 0]


def fit_planes(z: np.ndarray, n: int, start: np.ndarray | None = None, rounds: int = 200, bounds: tuple[np.ndarray, np.ndarray] | None = None, level: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parameters, errors and the share of variance explained of every plane of a cube, see ``fit_with_covariances``."""
    p, spread, share = fit_with_covariances(z, n, start, rounds, bounds, level)
    return p, np.sqrt(np.maximum(np.diagonal(spread, axis1=1, axis2=2), 0.0)), share


def fit_with_covariances(z: np.ndarray, n: int, start: np.ndarray | None = None, rounds: int = 200, bounds: tuple[np.ndarray, np.ndarray] | None = None, level: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parameters (planes, 1 + 6 n), their covariances and the share of variance explained of every plane of a cube: damped least
    squares within bounds, all planes together, each with a damping of its own. Pixels that are not finite are left out.
    Planes of fewer pixels than parameters give NaN. ``start`` is one vector, or one for each plane. Without ``level`` the
    offset stays as it starts."""
    size = 1 + 6 * n
    shape = z.shape[1:]
    use = np.isfinite(z).reshape(len(z), -1)
    data = np.where(use, z.reshape(len(z), -1), 0.0)
    x, y = (c.ravel().astype(float) for c in np.indices(shape))
    enough = use.sum(1) >= size
    p = np.full((len(z), size), np.nan)
    for k in np.flatnonzero(enough):
        p[k] = seeds(z[k], n) if start is None else start if start.ndim == 1 else start[k]
    low = np.array([-np.inf] + [-np.inf, -1.0, -1.0, 0.3, 0.3, -np.inf] * n)
    high = np.array([np.inf] + [np.inf, shape[0], shape[1], 2.0 * max(shape), 2.0 * max(shape), np.inf] * n)
    if bounds is not None:
        low, high = np.maximum(low, bounds[0]), np.minimum(high, bounds[1])
    p = np.clip(p, low, high)
    covariances, share = np.full((len(z), size, size), np.nan), np.full(len(z), np.nan)
    live = np.flatnonzero(enough)
    damp, cost = np.full(len(z), 1e-2), np.full(len(z), np.inf)

    def seen(at: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        model, jac = gaussians(q, x, y)
        jac[..., 0] *= level
        return np.where(use[at], data[at] - model, 0.0), jac * use[at][..., None]

    rest, jac = seen(live, p[live])
    cost[live] = (rest**2).sum(-1)
    normal, slope = jac.swapaxes(-1, -2) @ jac, (jac.swapaxes(-1, -2) @ rest[..., None])[..., 0]
    full = np.zeros((len(z), size, size))
    full[live] = normal
    slopes = np.zeros((len(z), size))
    slopes[live] = slope
    diagonal = np.arange(size)
    for _ in range(rounds):
        if not len(live):
            break
        h = full[live].copy()
        h[:, 0, 0] += not level
        h[:, diagonal, diagonal] += damp[live, None] * np.maximum(h[:, diagonal, diagonal], 1e-12)
        new = np.clip(p[live] + _solved(h, slopes[live]), low, high)
        rest, jac = seen(live, new)
        trial = (rest**2).sum(-1)
        better = trial < cost[live]
        at = live[better]
        small = np.zeros(len(live), bool)
        small[better] = cost[at] - trial[better] < 1e-14 * (cost[at] + 1e-30)
        full[at] = jac[better].swapaxes(-1, -2) @ jac[better]
        slopes[at] = (jac[better].swapaxes(-1, -2) @ rest[better][..., None])[..., 0]
        p[at], cost[at] = new[better], trial[better]
        damp[live] = np.where(better, np.maximum(damp[live] / 5, 1e-12), damp[live] * 4)
        live = live[~small & (damp[live] <= 1e12)]
    for k in np.flatnonzero(enough):
        free = max(1, int(use[k].sum()) - size)
        try:
            fixed = np.zeros_like(full[k])
            fixed[0, 0] = not level
            covariances[k] = np.linalg.inv(full[k] + fixed) * cost[k] / free
        except np.linalg.LinAlgError:
            pass
        held = data[k][use[k]]
        spread = np.var(held)
        if spread > 0:
            share[k] = 1 - np.var(held - gaussians(p[k], x[use[k]], y[use[k]])[0]) / spread
    return p, covariances, share


def fit_plane(z: np.ndarray, n: int, mask: np.ndarray | None = None, start: np.ndarray | None = None, rounds: int = 200, bounds: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """``fit_planes`` of one plane."""
    z = z if mask is None else np.where(mask, z, np.nan)
    if np.isfinite(z).sum() < 1 + 6 * n:
        raise ValueError("too few pixels to fit")
    p, errors, share = fit_planes(z[None], n, start, rounds, bounds)
    return p[0], errors[0], float(share[0])


COVARIANCES = ("cov_major_minor", "cov_major_theta", "cov_minor_theta")
PARAMETERS = ("amp", "x0", "y0", "fwhm_major", "fwhm_minor", "theta")


def _vector(components: list[dict[str, float]], offset: float, default: float | None = None) -> np.ndarray:
    """A parameter vector of components given by name, widths as FWHM."""
    out = [offset]
    for c in components:
        if unknown := set(c) - set(PARAMETERS):
            raise ValueError(f"unknown parameters {sorted(unknown)}; known are {list(PARAMETERS)}")
        for name in PARAMETERS:
            if name not in c and default is None:
                raise ValueError(f"a component lacks {name}")
            value = c.get(name, default)
            out.append(value / FWHM if name.startswith("fwhm") else value)
    return np.array(out, float)


def _starts(initial: object, n: int, offset: float) -> np.ndarray | None:
    """A parameter vector from any way of giving starts: none; a list of components by name; one component by name; an array
    (components, 6) with widths as FWHM; a flat list of 1 + 6 n numbers, offset first; or a dict with ``offset`` and
    ``components`` (either form)."""
    if initial is None:
        return None
    if isinstance(initial, dict):
        if "components" in initial:
            return _starts(initial["components"], n, float(initial.get("offset", offset)))
        initial = [initial]
    if len(initial) and isinstance(initial[0], dict):
        if len(initial) != n:
            raise ValueError("one start for each component")
        return _vector(initial, offset)
    given = np.asarray(initial, float)
    if given.ndim == 1 and len(given) == 1 + 6 * n:
        offset, given = float(given[0]), given[1:].reshape(n, 6)
    if given.shape != (n, 6):
        raise ValueError("one start for each component: (amplitude, x0, y0, FWHM major, FWHM minor, theta)")
    return _vector([dict(zip(PARAMETERS, row)) for row in given.tolist()], offset)


def _limits(bounds: dict[str, object] | None, n: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Lower and upper vectors; a parameter's bounds are one interval for all components or a list of one for each."""
    if not bounds:
        return None
    if "theta" in bounds:
        raise ValueError("the angle takes no bounds")
    each: list[dict[str, tuple[float, float]]] = [{} for _ in range(n)]
    around = (-np.inf, np.inf)
    for name, given in bounds.items():
        given = given if isinstance(given[0], (list, tuple)) else [given] if name == "offset" else [given] * n
        if any(len(pair) != 2 or pair[0] > pair[1] for pair in given):
            raise ValueError(f"bounds of {name} are (lower, upper)")
        if name == "offset":
            around = given[0]
            continue
        if len(given) != n:
            raise ValueError(f"bounds of {name} are one interval, or one for each component")
        for part, pair in zip(each, given):
            part[name] = pair
    out = tuple(_vector([{k: v[side] for k, v in part.items()} for part in each], around[side], far) for side, far in ((0, -np.inf), (1, np.inf)))
    return out


def fit_multi_gaussian2d(
    img: DataFrame, n: int = 1, initial: object = None, offset: float = 0.0, bounds: dict[str, object] | None = None,
    min_threshold: float | None = None, max_threshold: float | None = None, mask: Column | None = None,
) -> DataFrame:
    """A row a plane and component: offset, amplitude, peak (amplitude and offset), centre, widths (FWHM, major first), angle
    from +x and position angle (from +y towards -x, in [0, pi)), an error of each (``*_err``), covariances of widths and angle
    (``cov_major_minor, cov_major_theta, cov_minor_theta``, as ``coordinates.to_world_axes`` takes them), and the share of variance
    explained. Columns are described in their metadata, see ``described``. ``initial`` gives the starts (else the peaks do; see ``_starts`` for its forms), ``bounds`` an interval by
    parameter for all or for each of the components (not for the angle), and pixels outside the thresholds or the mask are
    left out of the fit."""
    start, limits = _starts(initial, n, offset), _limits(bounds, n)
    use = F.coalesce(mask, F.lit(False)) if mask is not None else F.lit(True)
    if min_threshold is not None:
        use = use & (F.col("value") >= min_threshold)
    if max_threshold is not None:
        use = use & (F.col("value") <= max_threshold)
    img = img.withColumn("value", F.when(use, F.col("value")).otherwise(float("nan")))

    def run(planes: Planes) -> Iterator[dict]:
        for some, shape, rows in planes.groups():
            p, spread, share = fit_with_covariances(planes.cube("value", some, shape, rows, np.nan), n, start, bounds=limits)
            e = np.sqrt(np.maximum(np.diagonal(spread, axis1=1, axis2=2), 0.0))
            first = 1 + 6 * np.arange(n)  # of each component
            between = lambda i, k: spread[:, first + i, first + k].ravel()  # noqa: B023, E731
            parts, errors = p[:, 1:].reshape(-1, 6).copy(), e[:, 1:].reshape(-1, 6).copy()
            turned = parts[:, 4] > parts[:, 3]
            for x in (parts, errors):
                x[turned, 3], x[turned, 4] = x[turned, 4], x[turned, 3]
            covs = np.stack([between(3, 4) * FWHM * FWHM, between(3, 5) * FWHM, between(4, 5) * FWHM])
            covs[1, turned], covs[2, turned] = covs[2, turned], covs[1, turned]
            parts[turned, 5] += math.pi / 2
            parts[:, 5] = (parts[:, 5] + math.pi / 2) % math.pi - math.pi / 2
            level, level_err = np.repeat(p[:, 0], n), np.repeat(e[:, 0], n)
            amp, x0, y0, major, minor, theta = parts.T
            errs = dict(zip([f"{c}_err" for c in PARAMETERS], errors.T))
            errs["fwhm_major_err"], errs["fwhm_minor_err"] = errs["fwhm_major_err"] * FWHM, errs["fwhm_minor_err"] * FWHM
            values = {
                "component": np.tile(np.arange(n), len(some)), "offset": level, "amp": amp, "x0": x0, "y0": y0, "fwhm_major": major * FWHM, "fwhm_minor": minor * FWHM, "theta": theta,
                "pa": (math.pi / 2 - theta) % math.pi, "peak": amp + level, "offset_err": level_err, "peak_err": np.hypot(errs["amp_err"], level_err), **errs, "variance_explained": np.repeat(share, n),
                **dict(zip(COVARIANCES, covs)),
            }
            yield {**{k: v.take(pa.array(np.repeat(some, n))) for k, v in planes.keys.items()}, **values}

    names = ["offset", *PARAMETERS, "pa", "peak", "offset_err", "peak_err", *[f"{c}_err" for c in PARAMETERS], "variance_explained", *COVARIANCES]
    fits = map_planes(img, ["l", "m", "value"], run, "component int, " + ", ".join(f"{c} double" for c in names))
    return described(fits, n=n, initial=initial, offset=offset, bounds=bounds, min_threshold=min_threshold, max_threshold=max_threshold, mask=mask)


#: What columns of fits hold, and their units.
NOTES = {
    "component": ("number of the component within its plane", ""), "offset": ("level under all components of the plane", "value"), "amp": ("height above the offset", "value"), "peak": ("height with the offset", "value"),
    "x0": ("centre along l", "pixel"), "y0": ("centre along m", "pixel"), "fwhm_major": ("larger full width at half maximum", "pixel"), "fwhm_minor": ("smaller full width at half maximum", "pixel"),
    "theta": ("angle of the major axis from +l towards +m", "rad"), "pa": ("angle of the major axis from +m towards -l, in [0, pi)", "rad"),
    "variance_explained": ("1 - variance of the residual / variance of the data; near 1 is good, below 0 worse than a constant, null or NaN for flat planes", ""),
    "cov_major_minor": ("covariance of the widths", "pixel2"), "cov_major_theta": ("covariance of the larger width and the angle", "pixel rad"), "cov_minor_theta": ("covariance of the smaller width and the angle", "pixel rad"),
}


def described(fits: DataFrame, longest: int = 120, **call: object) -> DataFrame:
    """``fits`` with metadata of columns, which tables keep: what they hold and their units (``comment``, ``unit``), and with the
    component the parameters of the call as text, each cut to ``longest`` characters."""
    short = lambda v: text if len(text := str(v)) <= longest else text[: longest - 3] + "..."
    columns = []
    for c in fits.columns:
        base = c.removesuffix("_err")
        if base not in NOTES:
            columns.append(F.col(c))
            continue
        comment, unit = NOTES[base]
        notes = {"comment": comment if base == c else f"standard error: {comment}", "unit": unit}
        if c == "component":
            notes["call"] = json.dumps({k: short(v) for k, v in call.items() if v is not None}, sort_keys=True)
        columns.append(F.col(c).alias(c, metadata=notes))
    return fits.select(*columns)


def to_world(fits: DataFrame, x: tuple[float, float, float], y: tuple[float, float, float]) -> DataFrame:
    """Fits with ``world_x, world_y, world_fwhm_major, world_fwhm_minor, world_theta``, for axes that are linear in pixels:
    (reference pixel, value there, step). Steps may be negative, as that of right ascension."""
    t, (dx, dy) = F.col("theta"), (x[2], y[2])
    axis = lambda c, s: (c * dx, s * dy)
    (ax, ay), (bx, by) = axis(F.cos(t), F.sin(t)), axis(-F.sin(t), F.cos(t))
    # The second moments in world units; their principal axes are the widths and the angle.
    a2, b2 = F.col("fwhm_major") * F.col("fwhm_major"), F.col("fwhm_minor") * F.col("fwhm_minor")
    xx, yy, xy = a2 * ax * ax + b2 * bx * bx, a2 * ay * ay + b2 * by * by, a2 * ax * ay + b2 * bx * by
    root = F.sqrt((xx - yy) * (xx - yy) / 4 + xy * xy)
    return fits.withColumns(
        {
            "world_x": (F.col("x0") - x[0]) * dx + x[1], "world_y": (F.col("y0") - y[0]) * dy + y[1], "world_fwhm_major": F.sqrt((xx + yy) / 2 + root),
            "world_fwhm_minor": F.sqrt(F.greatest((xx + yy) / 2 - root, F.lit(0.0))), "world_theta": F.atan2(2 * xy, xx - yy) / 2,
            "world_x_err": F.col("x0_err") * abs(dx), "world_y_err": F.col("y0_err") * abs(dy),
        }
    )


def fitted_image(img: DataFrame, fits: DataFrame) -> DataFrame:
    """``plane, chan, l, m, value, model, residual``: the components of every plane drawn and taken off."""
    s = (F.col("fwhm_major") / FWHM, F.col("fwhm_minor") / FWHM)
    parts = fits.groupBy(*KEY).agg(F.first("offset").alias("offset"), F.collect_list(F.struct("amp", "x0", "y0", s[0].alias("a"), s[1].alias("b"), "theta")).alias("parts"))

    def drawn(p: Column) -> Column:
        dx, dy = F.col("l") - p["x0"], F.col("m") - p["y0"]
        u, v = dx * F.cos(p["theta"]) + dy * F.sin(p["theta"]), dy * F.cos(p["theta"]) - dx * F.sin(p["theta"])
        return p["amp"] * F.exp(-((u / p["a"]) * (u / p["a"]) + (v / p["b"]) * (v / p["b"])) / 2)

    model = F.aggregate("parts", F.col("offset"), lambda total, p: total + drawn(p))
    wide = img.join(parts, list(KEY), "left").withColumn("model", model)  # a list holds the few components of one plane
    return wide.select(*KEY, "l", "m", "value", "model", (F.col("value") - F.col("model")).alias("residual"))


def main_lobe(z: np.ndarray, threshold: float = 0.5) -> tuple[np.ndarray, float]:
    """The connected pixels above ``threshold`` times the peak that hold it, and the largest magnitude elsewhere."""
    peak = np.unravel_index(int(np.nanargmax(z)), z.shape)
    above = z >= threshold * z[peak]
    lobe, queue = np.zeros(z.shape, bool), [peak]
    lobe[peak] = True
    while queue:
        i, k = queue.pop()
        for a, b in ((i + 1, k), (i - 1, k), (i, k + 1), (i, k - 1)):
            if 0 <= a < z.shape[0] and 0 <= b < z.shape[1] and above[a, b] and not lobe[a, b]:
                lobe[a, b] = True
                queue.append((a, b))
    rest = np.abs(np.where(lobe, 0.0, z))
    return lobe, float(np.nanmax(rest)) if rest.size else 0.0


def finer(n: int, k: int) -> np.ndarray:
    """The matrix that takes ``n`` samples to ``k`` a pixel, by cubic convolution; edges are repeated."""
    at = np.arange((n - 1) * k + 1) / k
    first = np.minimum(np.floor(at).astype(int), max(0, n - 2))
    t = at - first
    weights = np.stack([-(t**3) + 2 * t**2 - t, 3 * t**3 - 5 * t**2 + 2, -3 * t**3 + 4 * t**2 + t, t**3 - t**2], 1) / 2
    out = np.zeros((len(at), n))
    for j in range(4):
        np.add.at(out, (np.arange(len(at)), np.clip(first + j - 1, 0, n - 1)), weights[:, j])
    return out


def psf_fit(img: DataFrame, threshold: float = 0.35, window: tuple[int, int] | None = None, sampling: int = 1) -> DataFrame:
    """``bmaj, bmin`` (FWHM, pixels), ``pa`` in [0, pi) and the sidelobe of each plane; NaN where nothing can be fitted. The
    fit sees the main lobe: the connected pixels above ``threshold`` times the peak, within ``window`` pixels around the
    peak where given, at ``sampling`` points a pixel, which narrow beams need. The sidelobe is the largest magnitude outside
    the main lobe, in the whole plane."""
    if sampling < 1:
        raise ValueError("sampling is the number of points a pixel, 1 at least")

    def run(planes: Planes) -> Iterator[dict]:
        for some, shape, rows in planes.groups():
            cube = planes.cube("value", some, shape, rows, np.nan)
            out = np.full((4, len(some)), np.nan)
            out[:, (cube == 0).all((1, 2))] = 0.0
            good = np.flatnonzero(np.isfinite(cube).any((1, 2)) & ~(cube == 0).all((1, 2)))
            reach = [min(n, w) if w else n for n, w in zip(shape, window or (0, 0))]
            lobes, starts = np.full((len(good), *((w - 1) * sampling + 1 for w in reach)), np.nan), np.zeros((len(good), 7))
            turn = [finer(w, sampling) for w in reach]
            for k, plane in enumerate(good):
                z = cube[plane]
                out[3, plane] = main_lobe(z, threshold)[1]
                i, j = np.unravel_index(int(np.nanargmax(z)), shape)
                x, y = (max(0, min(c - w // 2, n - w)) for c, w, n in zip((i, j), reach, shape))
                part = z[x : x + reach[0], y : y + reach[1]]
                part = turn[0] @ np.nan_to_num(part) @ turn[1].T if sampling > 1 else part
                lobe, _ = main_lobe(part, threshold)
                lobes[k][lobe] = part[lobe]
                starts[k] = 0.0, z[i, j], (i - x) * sampling, (j - y) * sampling, 1.5 * sampling, 1.4 * sampling, 0.0
            if len(good):
                p, _, _ = fit_planes(lobes, 1, starts, level=False)
                a, b, t = p[:, 4] / sampling, p[:, 5] / sampling, p[:, 6]
                turned = b > a
                a, b, t = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, t + math.pi / 2, t)
                out[:3, good] = a * FWHM, b * FWHM, (math.pi / 2 - t) % math.pi
            yield {**{k: v.take(pa.array(some)) for k, v in planes.keys.items()}, **dict(zip(("bmaj", "bmin", "pa", "sidelobe"), out))}

    return map_planes(img, ["l", "m", "value"], run, "bmaj double, bmin double, pa double, sidelobe double")


def variance_explained(img: DataFrame, model: Column) -> DataFrame:
    """1 - Var(residual) / Var(data) of each plane."""
    return img.groupBy(*KEY).agg((1 - F.var_pop(F.col("value") - model) / F.var_pop("value")).alias("variance_explained"))


def peak_seeds(img: DataFrame) -> DataFrame:
    """The first seed of each plane in SQL: the largest value above the median, first pixel of equal ones."""
    order = F.struct(F.col("value").alias("a"), (-(F.col("l") * 65536 + F.col("m"))).alias("b"))
    return img.groupBy(*KEY).agg(F.max_by("l", order).alias("x0"), F.max_by("m", order).alias("y0"), (F.max("value") - F.median("value")).alias("amp"), F.median("value").alias("offset"))
