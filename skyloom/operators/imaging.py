"""From visibilities to images and back: dirty images, point spread functions, predictions, and the major cycles between
them. Grids stay sparse rows until each plane's transform; planes (channel and polarisation) are independent throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..functions import LIGHT, airy, cexp, cmul, spheroidal
from ..session import checkpointed
from . import blocks, calibration, deconvolution, fitting, gridding, images
from .planes import KEY, Planes, map_planes

#: Dish diameter and blockage in metres, by telescope.
DISHES = {"ALMA": (10.7, 0.75), "ACA": (6.7, 0.75)}
#: The correction at an image's edge falls to zero; values there are divided by this at least.
LEAST = 1e-4


def correction(n: int) -> Column:
    """What gridding multiplies an image with, by pixel ``l, m``."""
    one = lambda c: spheroidal(F.abs(F.col(c) - n // 2) / (n // 2))
    return F.greatest(one("l") * one("m"), F.lit(LEAST))


def dirty_image(vis: DataFrame, n: int = 64, cell: float = 5e-5, mode: str = "cube", do_psf: bool = False, sums: DataFrame | None = None) -> DataFrame:
    """``plane, chan, l, m, value``: gridding, inverse transform, division by weights and kernel correction. The plane is
    the polarisation. With ``do_psf`` the weights are gridded, which gives the point spread function. ``sums`` are the
    planes' ``weight_sums`` where they are known."""
    cells = gridding.grid(vis, n, cell, mode=mode, do_psf=do_psf)
    return _image_of(cells, weight_sums(vis, n, cell, mode) if sums is None else sums, n)


def _image_of(cells: DataFrame, sums: DataFrame | None, n: int) -> DataFrame:
    """The image of gridded cells, divided by ``sums`` of weights unless the cells are."""
    uv = cells.select(F.col("pol").alias("plane"), "chan", F.col("iu").alias("l"), F.col("iv").alias("m"), "re", "im")
    sky = images.fft(uv, inverse=True, n=n)
    sky = sky.join(sums, list(KEY)) if sums is not None else sky.withColumn("sum_weight", F.lit(1.0))  # one row a plane: Spark sends it to the planes
    return sky.select(*KEY, "l", "m", (F.col("re") * (n * n) / F.col("sum_weight") / correction(n)).alias("value"))


def weight_sums(vis: DataFrame, n: int = 64, cell: float = 5e-5, mode: str = "cube") -> DataFrame:
    """``chan, plane, sum_weight`` of the planes that have any weight."""
    return gridding.sum_weight(vis, n, cell, mode=mode).withColumnRenamed("pol", "plane").where("sum_weight > 0")


def point_spread(vis: DataFrame, n: int = 64, cell: float = 5e-5, mode: str = "cube", sums: DataFrame | None = None) -> DataFrame:
    return dirty_image(vis, n, cell, mode, do_psf=True, sums=sums)


def predict(vis: DataFrame, model: DataFrame, n: int = 64, cell: float = 5e-5, correct: bool = True) -> DataFrame:
    """``vis`` with ``model_re, model_im``: the transform of a model image (``plane, chan, l, m, value``) degridded at every
    sample. ``correct`` divides the image by the kernel's correction first, so predictions equal the direct sum."""
    return gridding.degrid_onto(vis, model_grid(model, n, correct), n, cell)


def model_grid(model: DataFrame, n: int, correct: bool = True) -> DataFrame:
    """``chan, pol, iu, iv, re, im``: the transform of a model image."""
    value = F.col("value") / correction(n) if correct else F.col("value")
    grid = images.fft(model.where("value <> 0").select(*KEY, "l", "m", value.alias("re"), F.lit(0.0).alias("im")), n=n)
    return grid.select("chan", F.col("plane").alias("pol"), F.col("l").alias("iu"), F.col("m").alias("iv"), "re", "im")


def residual(predicted: DataFrame, re: str = "re", im: str = "im") -> DataFrame:
    """Visibilities less their model."""
    return predicted.withColumns({"re": F.col(re) - F.col("model_re"), "im": F.col(im) - F.col("model_im")})


def synthetic_visibilities(vis: DataFrame, sources: list[tuple[float, float, float]], by_channel: bool = False) -> DataFrame:
    """``vis`` with the visibilities of point sources (flux, l, m in radians), times channel + 1 where asked for."""
    re, im = F.lit(0.0), F.lit(0.0)
    for flux, l, m in sources:
        phase = F.lit(2 * math.pi) * (F.col("u") * float(l) + F.col("v") * float(m)) * F.col("freq") / F.lit(LIGHT)
        re, im = re + float(flux) * F.cos(phase), im + float(flux) * F.sin(phase)
    times = F.col("chan") + 1 if by_channel else F.lit(1.0)
    return vis.withColumns({"re": re * times, "im": im * times})


def sidelobes(psf: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``plane, chan, sidelobe``: the largest magnitude outside the main lobe of each plane."""

    def run(planes: Planes) -> Iterator[dict]:
        for some, shape, rows in planes.groups():
            cube = planes.cube("value", some, shape, rows, np.nan)
            side = [fitting.main_lobe(z, threshold)[1] if np.isfinite(z).any() else np.nan for z in cube]
            yield {**{k: v.take(pa.array(some)) for k, v in planes.keys.items()}, "sidelobe": np.array(side, float)}

    return map_planes(psf, ["l", "m", "value"], run, "sidelobe double")


CELL_KEY = ("chan", "iu", "iv")
GRID_KEY = ("chan", "pol", "iu", "iv")


def stokes_cells(cells: DataFrame, sums: DataFrame, feed: str, correlations: int) -> DataFrame:
    """Gridded correlations, each over its own sum of weights, as gridded Stokes parameters (``pol`` numbers them). Gridding
    and transforms are linear, so mixing cells is mixing images, and complex cross hands keep their imaginary part."""
    even = cells.join(sums.withColumnRenamed("plane", "pol"), ["chan", "pol"])  # a row a plane
    even = even.select("chan", "pol", "iu", "iv", *[(F.col(c) / F.col("sum_weight")).alias(c) for c in ("re", "im")])
    return images.mix_planes(even, images.stokes_rows(feed, correlations), CELL_KEY, "pol")


def stokes_image(vis: DataFrame, feed: str, correlations: int, n: int = 64, cell: float = 5e-5, sums: DataFrame | None = None) -> DataFrame:
    """``plane, chan, l, m, value``: dirty images of the Stokes parameters, numbered by ``plane`` in the order IQUV (IQ or IV
    of two correlations)."""
    sums = weight_sums(vis, n, cell) if sums is None else sums
    return _stokes_of(gridding.grid(vis, n, cell), sums, n, feed, correlations)


def _stokes_of(cells: DataFrame, sums: DataFrame, n: int, feed: str, correlations: int) -> DataFrame:
    mixed = stokes_cells(cells, sums, feed, correlations)
    return _image_of(mixed, None, n)


def stokes_point_spread(vis: DataFrame, correlations: int, n: int = 64, cell: float = 5e-5) -> DataFrame:
    """``plane, chan, l, m, value``: one point spread function a channel, that of Stokes I: the mean of its parallel hands."""
    return _intensity_spread(gridding.grid(vis, n, cell, do_psf=True), weight_sums(vis, n, cell), n, correlations)


def _intensity_spread(cells: DataFrame, sums: DataFrame, n: int, correlations: int) -> DataFrame:
    hands = F.col("pol").isin(0, correlations - 1)
    even = cells.where(hands).join(sums.withColumnRenamed("plane", "pol"), ["chan", "pol"])
    held = sums.where(F.col("plane").isin(0, correlations - 1)).groupBy("chan").agg(F.count("*").alias("_hands"))  # a row a channel
    even = even.join(held, "chan").groupBy("chan", F.lit(0).alias("pol"), "iu", "iv")
    return _image_of(even.agg(*[F.sum(F.col(c) / F.col("sum_weight") / F.col("_hands")).alias(c) for c in ("re", "im")]), None, n)


def major_cycles(
    vis: DataFrame,
    control: deconvolution.IterationController,
    n: int = 64,
    cell: float = 5e-5,
    gain: float = 0.1,
    start: DataFrame | None = None,
    mask: Column | None = None,
    box: tuple[int, int, int, int] | None = None,
    feed: str | None = None,
    correlations: int = 4,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(model, residual image, log): CLEAN with residuals recomputed from the visibilities, until the controller stops or a
    cycle finds no component. Each cycle takes the model, as seen at every place and gridded, off the gridded visibilities,
    cleans the image by plane within ``mask`` and ``box``, and adds to the model. ``start`` is a model to go on from. The measured
    sidelobe of the point spread function sets the depth of a cycle. One budget of iterations serves all planes: what they
    have done together is taken off it.

    With a ``feed`` (linear or circular) planes are Stokes parameters (see ``stokes_image``), cleaned with one point spread
    function a channel; models are mixed back into the ``correlations`` before they are taken off. Without, every
    polarisation is a plane of its own.

    ``log`` has a row a plane and cycle, as ``deconvolution.summary``, ``merge_logs`` and ``convergence`` read it, with
    ``stopcode`` and the limits of the cycle. Samples of one place (cell and sub-cell) have one model value, so their weighted
    sums stand for them: they are summed and gridded once, and cycles work on the weights of places (see ``blocks``)."""
    spark = vis.sparkSession
    held = checkpointed(blocks.in_blocks(gridding.places(vis, n, cell), n))
    sums = checkpointed(blocks.sum_weight(held).withColumnRenamed("pol", "plane").where("sum_weight > 0"))  # weights do not change from cycle to cycle
    planes = sums.count()
    dirty = checkpointed(blocks.grid(held, n))
    spread_cells = dirty.select(*GRID_KEY, F.col("weight").alias("re"), F.lit(0.0).alias("im"))
    dirty = dirty.drop("weight")
    psf = checkpointed(_intensity_spread(spread_cells, sums, n, correlations) if feed else _image_of(spread_cells, sums, n))
    sidelobe = checkpointed(sidelobes(psf))
    worst = sidelobe.agg(F.max("sidelobe")).first()[0] or 0.2
    by_plane = sidelobe.drop("plane") if feed else sidelobe
    allowed = (F.coalesce(mask, F.lit(False)) if mask is not None else F.lit(True)) & deconvolution.clean_box(box)
    model = start.select(*KEY, "l", "m", "value") if start is not None else None
    log: list[DataFrame] = []
    while True:
        cells = dirty if model is None else _less(dirty, blocks.regrid(held, _predicted_grid(model, n, feed, correlations), n, planes))
        image = checkpointed(_stokes_of(cells, sums, n, feed, correlations) if feed else _image_of(cells, sums, n))
        finite = allowed & ~F.isnan("value") & (F.abs("value") != float("inf"))
        state = image.where(finite).agg(F.max(F.abs("value")).alias("peak"), F.count("*").alias("n")).first()
        peak = state["peak"] or 0.0
        if control.check(peak, state["n"])[0]:
            break
        count, limit = control.cycle_controls(peak, worst)
        cleaned = checkpointed(deconvolution.deconvolve(image, psf, gain, max(1, count), limit, mask, box))
        rows = deconvolution.cycle_rows(image, cleaned, allowed, max(1, count), limit).join(by_plane.withColumnRenamed("sidelobe", "max_psf_sidelobe"), ["chan"] if feed else list(KEY), "left")
        rows = checkpointed(rows.select(F.lit(len(log)).cast("long").alias("cycle"), F.col("plane").alias("pol"), *[c for c in rows.columns if c != "plane"]))
        log.append(rows)
        done = rows.agg(F.sum("iter_done")).first()[0] or 0
        if not done:
            control.stopcode = deconvolution.NOTHING_FOUND
            break
        more = cleaned.where("model <> 0").select(*KEY, "l", "m", F.col("model").alias("value"))
        both = more if model is None else model.unionByName(more)
        model = checkpointed(both.groupBy(*KEY, "l", "m").agg(F.sum("value").alias("value")))
        control.update_counts(int(done))
    history = log[0] if log else spark.createDataFrame([], deconvolution.LOG)
    for rows in log[1:]:
        history = history.unionByName(rows)
    return model if model is not None else image.where("false"), image, history


def _less(cells: DataFrame, model: DataFrame) -> DataFrame:
    """Gridded cells less those of a model, whose rows of a cell are summed."""
    both = cells.unionByName(model.select(*GRID_KEY, (-F.col("re")).alias("re"), (-F.col("im")).alias("im")))
    return both.groupBy(*GRID_KEY).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def _predicted_grid(model: DataFrame, n: int, feed: str | None, correlations: int) -> DataFrame:
    """The transform of a model, mixed into correlations where it is of Stokes parameters."""
    grid = model_grid(model, n)
    return images.mix_planes(grid, images.correlation_rows(feed, correlations), CELL_KEY, "pol") if feed else grid


def primary_beam(spark: SparkSession, n: int, cell: float, freqs: list[float], telescope: str = "ALMA", ipower: int = 2) -> DataFrame:
    """``chan, l, m, value``: the beam of a telescope's dishes at each frequency."""
    if telescope not in DISHES:
        raise ValueError(f"unknown telescope {telescope!r}; known are {sorted(DISHES)}")
    dish, blockage = DISHES[telescope]
    i = F.col("id")
    at = spark.range(n * n * len(freqs)).select((i / (n * n)).cast("int").alias("chan"), ((i / n).cast("int") % n).alias("l"), (i % n).cast("int").alias("m"))
    freq = F.get(F.array(*[F.lit(float(f)) for f in freqs]), F.col("chan"))
    reduced = images.radius(n, cell) * (2 * math.pi / LIGHT * dish / 2) * freq
    farthest = 2 * math.pi / LIGHT * dish / 2 * max(freqs) * cell * n  # the trapezoid rule needs points beyond the argument
    return at.select("chan", "l", "m", airy(reduced, ipower, blockage / dish, int(farthest) + 60).alias("value"))


def make_cube(
    vis: DataFrame, n: int = 64, cell: float = 5e-5, weighting: str = "natural", robust: float = 0.5, padding: float = 1.0, telescope: str | None = None, pb_limit: float = 0.0, path: str | None = None
) -> DataFrame:
    """``plane, chan, l, m, sky, psf, pb, bmaj, bmin, pa``: the images of every channel and polarisation from samples, in one
    plan. Samples are weighted, gridded on a grid larger by ``padding`` and cut; the point spread function has flat noise,
    the sky is divided by the beam of ``telescope`` (1 where none is named), NaN below ``pb_limit``. Polarisations of a
    channel share the beam. ``path``: where to write the cube, by channel; what is returned is then read from there."""
    wide = 2 * math.ceil(n * max(1.0, padding) / 2)
    if weighting != "natural":
        new = gridding.imaging_weights(vis, weighting, robust, wide, cell)
        vis = vis.drop("weight").join(new.withColumnRenamed("weight_imaging", "weight"), "event_id")
    sums = weight_sums(vis, wide, cell)
    sky, psf = (images.remove_padding(dirty_image(vis, wide, cell, do_psf=k, sums=sums), wide, n) for k in (False, True))
    beam = F.lit(1.0)
    out = sky.withColumnRenamed("value", "sky").join(psf.withColumnRenamed("value", "psf"), [*KEY, "l", "m"])
    if telescope is not None:
        if telescope not in DISHES:
            raise ValueError(f"unknown telescope {telescope!r}; known are {sorted(DISHES)}")
        dish, blockage = DISHES[telescope]
        freqs = vis.groupBy("chan").agg(F.min("freq").alias("freq"))  # a row a channel
        out = out.join(freqs, "chan")
        reduced = images.radius(n, cell) * (2 * math.pi / LIGHT * dish / 2) * F.col("freq")
        top = vis.agg(F.max("freq")).first()[0] or 0.0
        beam = airy(reduced, 2, blockage / dish, int(2 * math.pi / LIGHT * dish / 2 * top * cell * n) + 60)
    out = out.withColumn("pb", beam)
    out = images.normalize(out.withColumnRenamed("sky", "value"), F.lit(1.0), F.lit(1.0), F.col("pb"), "flat_noise", pb_limit).withColumnRenamed("value", "sky")
    out = out.join(fitting.psf_fit(psf, window=(21, 21), sampling=4).drop("sidelobe"), list(KEY)).select(*KEY, "l", "m", "sky", "psf", "pb", "bmaj", "bmin", "pa")
    if path is None:
        return out
    sources.write_image(out, path)
    return sources.open_image(vis.sparkSession, path)


def pixel_offset(centre: tuple[float, float], direction: tuple[float, float], cell: float) -> tuple[float, float]:
    """Pixels from the phase centre to a direction (right ascension, declination), in the sine projection."""
    turn, (d0, d) = direction[0] - centre[0], (centre[1], direction[1])
    l = math.cos(d) * math.sin(turn)
    m = math.sin(d) * math.cos(d0) - math.cos(d) * math.sin(d0) * math.cos(turn)
    return l / cell, m / cell


def phase_gradient(centre: tuple[float, float], field: tuple[float, float], n: int, cell: float, oversampling: int = 1) -> tuple[float, float]:
    """Radians by sub-cell of the kernels of a field beside the phase centre, for ``gridding.mosaic_grid``."""
    return tuple(-2 * math.pi * p / (n * oversampling) for p in pixel_offset(centre, field, cell))


def gradient_of(centre: tuple[float, float], ra: Column, dec: Column, n: int, cell: float, oversampling: int = 1) -> tuple[Column, Column]:
    """``phase_gradient`` of directions that are columns."""
    turn, (sin0, cos0) = ra - centre[0], (math.sin(centre[1]), math.cos(centre[1]))
    l, m = F.cos(dec) * F.sin(turn), F.sin(dec) * cos0 - F.cos(dec) * sin0 * F.cos(turn)
    return tuple(-2 * math.pi * (x / cell) / (n * oversampling) for x in (l, m))


def channel_clusters(freqs: list[float], tolerance: float) -> list[float]:
    """Frequencies that stand for all: each channel lies within the relative ``tolerance`` of one."""
    out: list[float] = []
    for f in sorted(freqs):
        if not out or f > out[-1] * (1 + tolerance):
            out.append(f * (1 + tolerance))
    return out


def nearest_cluster(freq: Column, centres: list[float]) -> Column:
    """The index of the nearest centre; of equally near ones the first."""
    return F.array_min(F.array(*[F.struct(F.abs(freq - float(c)).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]))["i"]


def _j1(x: np.ndarray) -> np.ndarray:
    k = 2 * math.pi * np.arange(int(x.max()) + 60) / (int(x.max()) + 60)
    return np.cos(k - x[..., None] * np.sin(k)).mean(-1)


def _voltage(r: np.ndarray, ratio: float) -> np.ndarray:
    safe = np.where(r > 0, r, 1.0)
    value = (2 * _j1(safe) / safe - 2 * ratio * _j1(safe * ratio) / safe) / (1 - ratio**2)
    return np.where(r > 0, value, 1.0)


def _pair_beam(row: pd.Series, n: int, cell: float) -> np.ndarray:
    """The product of two dishes' voltage patterns, as an image."""
    axis = (np.arange(n) - n // 2) * cell
    radius = np.hypot(*np.meshgrid(axis, axis, indexing="ij"))
    distinct, back = np.unique(radius, return_inverse=True)
    scale = 2 * math.pi * row.freq / LIGHT / 2
    beam = _voltage(distinct * scale * row.dish1, row.blockage1 / row.dish1) * _voltage(distinct * scale * row.dish2, row.blockage2 / row.dish2)
    return beam[back].reshape(n, n)


def _turned_beam(beam: np.ndarray, steps: np.ndarray, oversampling: int) -> np.ndarray:
    """The transform of an even beam at steps of a sub-cell along both axes: real kernels."""
    n = len(beam)
    turn = np.cos(2 * math.pi * np.outer(steps / oversampling, np.arange(n) - n // 2) / n)
    return turn @ beam @ turn.T


def convolution_kernels(classes: DataFrame, n: int, cell: float, oversampling: int = 10, support: int = 15, cut: float = 0.02, power: int = 1) -> DataFrame:
    """``cf, uo, vo, du, dv, k`` for each row of ``classes(cf, dish1, dish2, blockage1, blockage2, freq)``: the transform of
    the product of two dishes' voltage patterns (to the ``power``), oversampled, normalised to a sum of one, cut at ``cut`` of its peak or at ``support``
    cells. A task makes the kernels of a class."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        steps = np.arange(-(support // 2) * oversampling - oversampling // 2 - 1, (support // 2) * oversampling + oversampling // 2 + 2)
        kernel = _turned_beam(_pair_beam(row, n, cell) ** power, steps, oversampling)
        zero = len(steps) // 2
        kernel = np.where(np.abs(kernel) >= cut * kernel[zero, zero], kernel, 0.0)
        kernel = kernel / (kernel.sum() / oversampling**2)
        o = np.arange(-(oversampling // 2) - 1, oversampling // 2 + 2)
        d = np.arange(-(support // 2), support // 2 + 1)
        uo, vo, du, dv = (x.ravel() for x in np.meshgrid(o, o, d, d, indexing="ij"))
        iu, iv = zero + du * oversampling + uo, zero + dv * oversampling + vo
        held = (iu >= 0) & (iu < len(steps)) & (iv >= 0) & (iv < len(steps))
        k = np.where(held, kernel[np.clip(iu, 0, len(steps) - 1), np.clip(iv, 0, len(steps) - 1)], 0.0)
        out = pd.DataFrame({"cf": int(row.cf), "uo": uo, "vo": vo, "du": du, "dv": dv, "k": k})
        return out[out["k"] != 0]

    return classes.groupBy("cf").applyInPandas(run, "cf int, uo int, vo int, du int, dv int, k double")


def class_kernels(classes: DataFrame, n: int, cell: float, oversampling: int = 10, cut: float = 0.02, max_support: int = 51) -> DataFrame:
    """``cf, uo, vo, support, k, k2`` for each row of ``classes(cf, dish1, dish2, blockage1, blockage2, freq)``: a row a sub-cell
    with the ``support`` squared values of the kernel of the two dishes' beam (``k``) and of its square (``k2``). Each class has
    a width of its own: along an axis, the squared beam's kernel is followed from its peak to ``cut`` of it, and a cell is
    added on either side. Both kernels are whole within it and normalised over it, so no sum is lost."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        beam = _pair_beam(row, n, cell)
        reach = min(n // 2, max_support) * oversampling
        one_axis = np.cos(2 * math.pi * np.outer(np.arange(reach + 1) / oversampling, np.arange(n) - n // 2) / n) @ (beam**2).sum(1)
        below = np.flatnonzero(one_axis <= cut * one_axis[0])
        support = (int(0.5 + (below[0] if len(below) else reach + 1) / oversampling) + 1) * 2 + 1
        if not len(below) or support >= max_support:
            raise ValueError(f"the kernel of class {int(row.cf)} is wider than {max_support} cells; raise cut or max_support, or take larger cells")
        half = support // 2
        edge = half * oversampling + oversampling // 2 + 1
        steps = np.arange(-edge, edge + 1)
        window = slice(edge - (support + 1) * oversampling // 2 if edge >= (support + 1) * oversampling // 2 else 0, edge + (support + 1) * oversampling // 2)
        kernels = [_turned_beam(b, steps, oversampling) for b in (beam, beam**2)]
        kernels = [k / (k[window, window].sum() / oversampling**2) for k in kernels]
        o = np.arange(-(oversampling // 2) - 1, oversampling // 2 + 2)
        d = np.arange(-half, half + 1) * oversampling
        rows = []
        for uo in o:
            for vo in o:
                iu, iv = np.clip(edge + d + uo, 0, len(steps) - 1), np.clip(edge + d + vo, 0, len(steps) - 1)
                rows.append((int(row.cf), int(uo), int(vo), support, *[k[np.ix_(iu, iv)].ravel().tolist() for k in kernels]))
        return pd.DataFrame(rows, columns=["cf", "uo", "vo", "support", "k", "k2"])

    return classes.groupBy("cf").applyInPandas(run, "cf int, uo int, vo int, support int, k array<double>, k2 array<double>")


def field_table(spark: SparkSession, fields: dict[int, tuple[float, float]], centre: tuple[float, float], n: int, cell: float, oversampling: int = 10) -> DataFrame:
    """A row a pointing: the turn of its uvw to the common ``centre``, the path of its phase, and its kernels' gradient."""
    rows = []
    for name, place in sorted(fields.items()):
        r, d = calibration.rotation(place, centre), calibration.path(place, centre)
        rows.append((name, *map(float, r.ravel()), *map(float, d), *map(float, phase_gradient(centre, place, n, cell, oversampling))))
    names = [f"r{i}{k}" for i in range(3) for k in range(3)] + ["d0", "d1", "d2", "gx", "gy"]
    return spark.createDataFrame(rows, "field int, " + ", ".join(f"{c} double" for c in names))


def to_common_centre(vis: DataFrame, fields: DataFrame) -> DataFrame:
    """Visibilities of many fields shifted to one phase centre, with the gradient ``gx, gy`` of each; one join."""
    wide = vis.join(fields, "field")
    uvw = [F.col(c) for c in "uvw"]
    phase = F.lit(2 * math.pi / LIGHT) * sum((F.col(f"d{i}") * uvw[i] for i in range(3)), F.lit(0.0)) * F.col("freq")
    re, im = cmul((F.col("re"), F.col("im")), cexp(phase))
    turned = {c: sum((F.col(f"r{i}{k}") * uvw[k] for k in range(3)), F.lit(0.0)) for i, c in enumerate("uvw")}
    return wide.withColumns({**turned, "re": re, "im": im}).select(*vis.columns, "gx", "gy")


def mosaic_image(vis: DataFrame, kernels: DataFrame, n: int, cell: float, oversampling: int = 10, norm_type: str = "flat_sky", pb_limit: float = 0.1, fit: bool = True) -> DataFrame:
    """``plane, chan, l, m, value, psf, pb`` and (with ``fit``) ``bmaj, bmin, pa``: all fields in one image with its point spread
    function and beam. ``vis`` has ``cf`` (its kernels' class) and ``gx, gy`` (see ``to_common_centre``); ``kernels`` are
    ``class_kernels``. ``pb`` is the root of the weighted mean of the squared beams; pixels where it is below ``pb_limit`` are
    NaN. The point spread function is one at its centre. Visibilities, weights and squared beams are laid on one grid of
    three values a cell, summed in one shuffle and transformed together."""
    kernels = checkpointed(kernels)  # made once, read by both
    cells = gridding.mosaic_cells(vis, kernels, n, cell, oversampling)
    zero = [F.lit(0.0).alias(c) for c in ("beam_re", "beam_im")]
    cells = cells.select("*", *zero).unionByName(_beam_cells(vis, kernels, n, oversampling), allowMissingColumns=True)
    parts = ("re", "im", "psf_re", "psf_im", "beam_re", "beam_im")
    grid = cells.groupBy(F.col("pol").alias("plane"), "chan", F.col("iu").alias("l"), F.col("iv").alias("m")).agg(*[F.sum(F.coalesce(c, F.lit(0.0))).alias(c) for c in parts])

    def run(planes: Planes) -> Iterator[dict]:
        for some, shape, rows in planes.groups(n):
            held = [planes.cube(c, some, shape, rows) for c in parts]
            sky, psf, beam = (images.turned_planes(held[i] + 1j * held[i + 1], True) * (n * n) for i in (0, 2, 4))
            top = psf.real[:, n // 2, n // 2][:, None, None]
            yield planes.all_pixels(some, value=sky.real, psf=psf.real / np.where(top != 0, top, 1.0), beam=np.abs(beam.real))

    sky = map_planes(grid, ["l", "m", *parts], run, "l int, m int, value double, psf double, beam double")
    sums = vis.where(gridding.visible(vis)).groupBy(F.col("pol").alias("plane"), "chan").agg(F.sum("weight").alias("w"))
    wide = sky.join(sums, list(KEY)).withColumn("pb", F.sqrt(F.col("beam") / F.col("w")))
    out = images.normalize(wide, F.col("w"), F.lit(1.0), F.col("pb"), norm_type, pb_limit).select(*KEY, "l", "m", "value", "psf", "pb")
    if not fit:
        return out
    out = checkpointed(out)
    beams = fitting.psf_fit(out.select(*KEY, "l", "m", F.col("psf").alias("value")), window=(21, 21), sampling=4).drop("sidelobe")
    return out.join(beams, list(KEY))


def _beam_cells(vis: DataFrame, kernels: DataFrame, n: int, oversampling: int) -> DataFrame:
    """``chan, pol, iu, iv, beam_re, beam_im``: every sample's squared kernel at the grid's centre. Weights factor out, so they
    are summed by class and field before any kernel is laid down."""
    centred = kernels.where("uo = 0 and vo = 0").select("cf", "support", F.posexplode("k2").alias("at", "k"))
    step = lambda x: (x - F.expr("support div 2")).cast("int")
    centred = centred.select("cf", step(F.expr("at div support")).alias("du"), step(F.col("at") % F.col("support")).alias("dv"), "k")
    sums = vis.where(gridding.visible(vis)).groupBy("chan", "pol", "cf", "gx", "gy").agg(F.sum("weight").alias("w"))
    wave = cexp((F.col("du") * F.col("gx") + F.col("dv") * F.col("gy")) * oversampling)
    size = F.col("w") * F.col("k")
    laid = sums.join(gridding.to_all(centred), "cf").withColumns({"iu": F.col("du") + n // 2, "iv": F.col("dv") + n // 2})
    return laid.where(F.col("iu").between(0, n - 1) & F.col("iv").between(0, n - 1)).select("chan", "pol", "iu", "iv", (size * wave[0]).alias("beam_re"), (size * wave[1]).alias("beam_im"))
