"""Hogbom CLEAN by plane, the log of its cycles, and the control of major cycles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .planes import KEY, Planes, map_planes


#: Pixels of a plane up to which planes are cleaned together.
SMALL = 1 << 12


def _checked(gain: float, niter: int, threshold: float) -> None:
    if not 0 < gain <= 1:
        raise ValueError("the gain lies in (0, 1]")
    if not isinstance(niter, (int, np.integer)) or niter <= 0:
        raise ValueError("niter is a positive whole number")
    if threshold is None or threshold < 0:
        raise ValueError("the threshold is not negative")


def clean_box(box: tuple[int, int, int, int] | None) -> Column:
    """Pixels of the box ``(xmin, xmax, ymin, ymax)``, upper ends left out; None and four times -1 are the whole plane."""
    if box is None or tuple(box) == (-1, -1, -1, -1):
        return F.lit(True)
    if len(box) != 4:
        raise ValueError("a clean box is (xmin, xmax, ymin, ymax)")
    return F.col("l").between(int(box[0]), int(box[1]) - 1) & F.col("m").between(int(box[2]), int(box[3]) - 1)


def hogbom(dirty: np.ndarray, psf: np.ndarray, gain: float = 0.1, niter: int = 100, threshold: float = 0.0, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Model, residual and iterations: the first largest magnitude in the mask is taken off, PSF by PSF. Pixels that are
    not finite are never chosen."""
    _checked(gain, niter, threshold)
    residual, model = dirty.astype(float).copy(), np.zeros_like(dirty, float)
    nx, ny = residual.shape
    cx, cy = psf.shape[0] // 2, psf.shape[1] // 2
    shut = ~np.isfinite(residual) if mask is None else ~(mask & np.isfinite(residual))
    for done in range(niter):
        seen = np.abs(residual)
        seen[shut] = -1.0
        px, py = np.unravel_index(int(seen.argmax()), seen.shape)
        if seen[px, py] < 0 or seen[px, py] < threshold:
            return model, residual, done
        step = gain * residual[px, py]
        model[px, py] += step
        x0, x1 = max(0, px - cx), min(nx, px - cx + psf.shape[0])
        y0, y1 = max(0, py - cy), min(ny, py - cy + psf.shape[1])
        residual[x0:x1, y0:y1] -= step * psf[x0 - px + cx : x1 - px + cx, y0 - py + cy : y1 - py + cy]
    return model, residual, niter


def hogbom_planes(dirty: np.ndarray, psf: np.ndarray, gain: float = 0.1, niter: int = 100, threshold: float = 0.0, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``hogbom`` of every plane of a cube; ``psf`` is one for all or one for each."""
    _checked(gain, niter, threshold)
    count, nx, ny = dirty.shape
    each = psf.ndim == 3
    if nx * ny > SMALL:
        found = [hogbom(z, psf[k] if each else psf, gain, niter, threshold, None if mask is None else mask[k]) for k, z in enumerate(dirty)]
        return np.stack([f[0] for f in found]), np.stack([f[1] for f in found]), np.array([f[2] for f in found])
    residual, model, done = dirty.astype(float).copy(), np.zeros(dirty.shape), np.zeros(count, np.int64)
    open_ = np.isfinite(residual) if mask is None else mask & np.isfinite(residual)
    # The point spread function at every shift that a plane can see, zero beyond its edges.
    px, py, (cx, cy) = *psf.shape[-2:], (psf.shape[-2] // 2, psf.shape[-1] // 2)
    wide = np.zeros((*psf.shape[:-2], 2 * nx - 1, 2 * ny - 1))
    x0, x1, y0, y1 = max(0, cx - nx + 1), min(px, cx + nx), max(0, cy - ny + 1), min(py, cy + ny)
    wide[..., x0 - cx + nx - 1 : x1 - cx + nx - 1, y0 - cy + ny - 1 : y1 - cy + ny - 1] = psf[..., x0:x1, y0:y1]
    live, across, along = np.arange(count), np.arange(nx), np.arange(ny)
    for _ in range(niter):
        seen = np.where(open_[live], np.abs(residual[live]), -1.0).reshape(len(live), -1)
        at = seen.argmax(1)
        peak = seen[np.arange(len(live)), at]
        going = (peak >= 0) & (peak >= threshold)
        live, at = live[going], at[going]
        if not len(live):
            break
        x, y = at // ny, at % ny
        step = gain * residual[live, x, y]
        model[live, x, y] += step
        rows, columns = (nx - 1 - x)[:, None, None] + across[:, None], (ny - 1 - y)[:, None, None] + along
        residual[live] -= step[:, None, None] * (wide[live[:, None, None], rows, columns] if each else wide[rows, columns])
        done[live] += 1
    return model, residual, done


def deconvolve(
    img: DataFrame, psf: np.ndarray | DataFrame, gain: float = 0.1, niter: int = 100, threshold: float = 0.0, mask: Column | None = None, box: tuple[int, int, int, int] | None = None, start: DataFrame | None = None
) -> DataFrame:
    """``plane, chan, l, m, model, residual, iterations``: CLEAN of each plane on its own. ``psf`` is an array for all planes,
    or pixels: of each plane, or of one plane a channel, which then serves all planes of the channel. Components lie where
    ``mask`` holds (null does not) and within ``box``; without a pixel to choose a plane has no iterations. ``start`` is a
    model (``plane, chan, l, m, value``) that the components are added to; ``img`` is its residual."""
    _checked(gain, niter, threshold)
    allowed = F.coalesce(mask, F.lit(False)) & clean_box(box) if mask is not None else clean_box(box)
    frame = img.select(*KEY, F.lit(0).alias("side"), "l", "m", F.col("value").cast("double").alias("value"), allowed.cast("int").alias("open"))
    array, resumed = psf if isinstance(psf, np.ndarray) else None, start is not None
    if array is None:
        frame = frame.unionByName(spread(psf, img).select(*KEY, F.lit(1).alias("side"), "l", "m", F.col("value").cast("double").alias("value"), F.lit(0).alias("open")))
    if start is not None:
        frame = frame.unionByName(start.select(*KEY, F.lit(2).alias("side"), "l", "m", F.col("value").cast("double").alias("value"), F.lit(0).alias("open")))

    def run(planes: Planes) -> Iterator[dict]:
        side = planes.columns["side"]
        for some, shape, rows in planes.groups():
            own, spreads, began = (rows[side[rows] == k] for k in (0, 1, 2))
            if array is None:
                lacking = ~np.isin(some, planes.owner[spreads]) & np.isin(some, planes.owner[own])
                if lacking.any():
                    raise ValueError("a plane has no point spread function")
            dirty = planes.cube("value", some, shape, own, np.nan)
            cut = array if array is not None else planes.cube("value", some, shape, spreads)
            model, residual, done = hogbom_planes(dirty, cut, gain, niter, threshold, planes.cube("open", some, shape, own) > 0)
            if resumed:
                model += planes.cube("value", some, shape, began)
            at = planes.place(some, own)
            yield planes.own_rows(own, model=model[at], residual=residual[at], iterations=done[at[0]])

    return map_planes(frame, ["side", "l", "m", "value", "open"], run, ", ".join(f"{name} {kind}" for name, kind in img.select("l", "m").dtypes) + ", model double, residual double, iterations bigint", ("side", "l", "m"))


def spread(psf: DataFrame, img: DataFrame) -> DataFrame:
    """A point spread function for every plane: as it is, or that of a single plane a channel for all of ``img``."""
    if psf.select("plane").distinct().limit(2).count() != 1:
        return psf
    planes = img.select(*KEY).distinct()  # a row a plane
    return psf.drop("plane").join(planes, "chan").select(*psf.columns)


def deconvolve_stats(img: DataFrame, psf: np.ndarray | DataFrame, mask: Column | None = None, start: DataFrame | None = None, sidelobe: float | None = None, **params) -> DataFrame:
    """A row of the cycle log for each plane: iterations, flux of the whole model, and peak residuals within the mask and
    without it, before and after."""
    cleaned = deconvolve(img, psf, mask=mask, start=start, **params)
    held = F.coalesce(mask, F.lit(False)) if mask is not None else F.lit(True)
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.abs(c))
    before = img.groupBy(*KEY).agg(
        F.max(F.when(held, finite(F.col("value")))).alias("start_peakres"), F.max(finite(F.col("value"))).alias("start_peakres_nomask"), F.sum(held.cast("long")).alias("masksum")
    )
    masked = cleaned.join(img.select(*KEY, "l", "m", held.alias("held")), [*KEY, "l", "m"]) if mask is not None else cleaned.withColumn("held", F.lit(True))
    after = masked.groupBy(*KEY).agg(
        F.max(F.when(F.col("held"), finite(F.col("residual")))).alias("peakres"), F.max(finite(F.col("residual"))).alias("peakres_nomask"), F.sum("model").alias("model_flux"), F.max("iterations").alias("iter_done")
    )
    if start is not None:
        before = before.join(start.groupBy(*KEY).agg(F.sum("value").alias("start_model_flux")), list(KEY), "left").withColumn("start_model_flux", F.coalesce("start_model_flux", F.lit(0.0)))
    else:
        before = before.withColumn("start_model_flux", F.lit(0.0))
    return before.join(after, list(KEY)).withColumn("max_psf_sidelobe", F.lit(sidelobe).cast("double"))


#: Why a plane's minor cycle ended: limit of iterations, threshold, a residual that grew, no pixel to choose (fixed values).
MINOR_ITERATIONS, MINOR_THRESHOLD, MINOR_DIVERGENCE, MINOR_NO_MASK = 1, 2, 4, 7
LOG = "cycle long, pol int, chan int, start_peakres double, masksum long, peakres double, peakres_nomask double, model_flux double, iter_done long, stopcode int, cycleniter int, cyclethreshold double, max_psf_sidelobe double"


def cycle_rows(img: DataFrame, cleaned: DataFrame, allowed: Column, count: int, limit: float) -> DataFrame:
    """``plane, chan`` and a row of the cycle log for each plane of one minor cycle: peaks within the mask before and after (and
    after without it), pixels of the mask, flux of the components, iterations, and ``stopcode``: no pixels, the threshold
    reached, a residual that grew, or the limit of iterations; 0 where none holds."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.abs(c))
    both = cleaned.join(img.select(*KEY, "l", "m", "value"), [*KEY, "l", "m"])
    held = lambda c: F.when(allowed, finite(F.col(c)))
    rows = both.groupBy(*KEY).agg(
        F.max(held("value")).alias("start_peakres"),
        F.sum(allowed.cast("long")).alias("masksum"),
        F.max(held("residual")).alias("peakres"),
        F.max(finite(F.col("residual"))).alias("peakres_nomask"),
        F.sum("model").alias("model_flux"),
        F.max("iterations").alias("iter_done"),
    )
    code = (
        F.when(F.coalesce(F.col("masksum"), F.lit(0)) == 0, MINOR_NO_MASK)
        .when(F.col("peakres") <= limit, MINOR_THRESHOLD)
        .when(F.col("peakres") > F.col("start_peakres"), MINOR_DIVERGENCE)
        .when(F.col("iter_done") >= count, MINOR_ITERATIONS)
        .otherwise(0)
    )
    return rows.withColumns({"stopcode": code, "cycleniter": F.lit(count), "cyclethreshold": F.lit(float(limit))})


PLANE = ("chan", "pol")


def merge_logs(logs: list[DataFrame], how: str = "update") -> DataFrame:
    """All logs as one: ``update`` keeps every cycle, ``latest`` the last log that has a plane, ``error`` raises on two."""
    parts = [log.withColumn("seq", F.lit(i)) for i, log in enumerate(logs)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    if how == "update":
        return out
    last = out.groupBy(*PLANE).agg(F.max("seq").alias("last"), F.min("seq").alias("first"))
    if how == "latest":
        return out.join(last, list(PLANE)).where("seq = last").drop("last", "first")
    if how == "error":
        bad = F.when(F.col("last") != F.col("first"), F.raise_error(F.lit("two logs hold one plane")).cast("int")).otherwise(F.col("seq"))
        return out.join(last, list(PLANE)).withColumn("seq", bad).drop("last", "first")
    raise ValueError(f"unknown way of merging {how!r}")


def last_of(log: DataFrame) -> DataFrame:
    """The last cycle of each plane, and its iterations in all."""
    fields = [c for c in log.columns if c not in (*PLANE, "cycle")]
    return log.groupBy(*PLANE).agg(*[F.max_by(c, "cycle").alias(c) for c in fields], F.sum("iter_done").alias("iterations"))


def summary(log: DataFrame) -> DataFrame:
    """One row: peak residual (planes without mask left out), mask sum, iterations, flux, largest sidelobe (0.2 if none)."""
    last = last_of(log)
    return last.agg(
        F.coalesce(F.max(F.when(F.col("masksum") != 0, F.abs("peakres"))), F.lit(0.0)).alias("peakres"),
        F.coalesce(F.sum("masksum"), F.lit(0)).alias("masksum"),
        F.coalesce(F.sum("iterations"), F.lit(0)).alias("iterations"),
        F.coalesce(F.sum("model_flux"), F.lit(0.0)).alias("model_flux"),
        F.coalesce(F.max("max_psf_sidelobe"), F.lit(0.2)).alias("max_psf_sidelobe"),
    )


def convergence(log: DataFrame) -> DataFrame:
    """The tidy history: iterations so far, residual and flux by cycle of each plane."""
    return log.selectExpr(*PLANE, "cycle", "sum(iter_done) over (partition by chan, pol order by cycle rows between unbounded preceding and current row) as cum_iter", "abs(peakres) as peakres", "model_flux as flux")


def parse_threshold(text: str | float) -> float:
    """In Jy."""
    if isinstance(text, (int, float)):
        return float(text)
    for unit, scale in (("uJy", 1e-6), ("mJy", 1e-3), ("Jy", 1.0)):
        if text.strip().endswith(unit):
            return float(text.strip()[: -len(unit)]) * scale
    return float(text)


#: No component found although no limit is reached, as where all pixels of the mask are NaN.
NOTHING_FOUND = 3
MESSAGES = {0: "running", 1: "iteration limit", 2: "threshold reached", NOTHING_FOUND: "no component found", 7: "zero mask", 9: "major cycle limit"}


@dataclass
class IterationController:
    """Limits of the next minor cycle, and when to stop; nothing changes once it has stopped."""

    niter: int = 1000
    nmajor: int = -1
    threshold: float = 0.0
    cycleniter: int = -1
    cyclefactor: float = 1.0
    min_psf_fraction: float = 0.05
    max_psf_fraction: float = 0.8
    stopcode: int = 0
    major_done: int = 0
    iterations_done: int = 0
    start: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.threshold = parse_threshold(self.threshold)
        if self.nmajor < -1:
            raise ValueError("nmajor is -1 (no limit) or the number of major cycles")
        self.start = {k: getattr(self, k) for k in ("niter", "nmajor")}

    def cycle_controls(self, peak: float, sidelobe: float) -> tuple[int, float]:
        fraction = min(max(sidelobe * self.cyclefactor, self.min_psf_fraction), self.max_psf_fraction)
        count = self.niter if self.cycleniter < 0 else min(self.cycleniter, self.niter)
        return count, max(fraction * peak, self.threshold)

    def check(self, peak: float, masksum: int) -> tuple[int, str]:
        if not self.stopcode:
            if masksum == 0:
                self.stopcode = 7
            elif self.niter <= 0:
                self.stopcode = 1
            elif self.threshold > 0 and peak <= self.threshold:
                self.stopcode = 2
            elif self.nmajor == 0:
                self.stopcode = 9
        return self.stopcode, MESSAGES[self.stopcode]

    def update_counts(self, iterations: int) -> None:
        if self.stopcode:
            return
        self.iterations_done += iterations
        self.niter = max(0, self.niter - iterations)
        self.major_done += 1
        if self.nmajor > 0:
            self.nmajor -= 1

    def update_parameters(self, **changes: object) -> tuple[int, str]:
        """(-1, why) for what is invalid, without a change."""
        for name, value in changes.items():
            if name not in ("niter", "nmajor", "threshold", "cycleniter", "cyclefactor"):
                return -1, f"unknown parameter {name}"
            try:
                value = parse_threshold(value) if name == "threshold" else float(value) if name == "cyclefactor" else int(value)
            except (TypeError, ValueError):
                return -1, f"{name} is no number"
            if (name in ("threshold", "cyclefactor", "niter") and value < 0) or (name in ("nmajor", "cycleniter") and value < -1):
                return -1, f"{name} is negative"
            setattr(self, name, value)
        return 0, "ok"

    def reset(self) -> None:
        self.stopcode = self.major_done = self.iterations_done = 0
        self.niter, self.nmajor = self.start["niter"], self.start["nmajor"]

    def state(self) -> dict[str, object]:
        return {k: getattr(self, k) for k in self._STATE} | {"start": dict(self.start)}

    _STATE = ("niter", "nmajor", "threshold", "cycleniter", "cyclefactor", "min_psf_fraction", "max_psf_fraction", "stopcode", "major_done", "iterations_done")

    @classmethod
    def from_state(cls, state: dict[str, object]) -> IterationController:
        """The controller that ``state`` was taken from."""
        out = cls(**{k: state[k] for k in cls._STATE})
        out.start = dict(state["start"])
        return out


def cycle_limits(last: DataFrame, control: IterationController) -> DataFrame:
    """``chan, pol, cycleniter, cyclethreshold``: ``cycle_controls`` of every plane of a log's last cycles."""
    fraction = F.least(F.greatest(F.col("max_psf_sidelobe") * control.cyclefactor, F.lit(control.min_psf_fraction)), F.lit(control.max_psf_fraction))
    count = control.niter if control.cycleniter < 0 else min(control.cycleniter, control.niter)
    return last.select(*PLANE, F.lit(count).alias("cycleniter"), F.greatest(fraction * F.abs("peakres"), F.lit(float(control.threshold))).alias("cyclethreshold"))
