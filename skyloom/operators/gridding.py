"""Convolutional gridding and degridding, imaging weights, single-dish and mosaic gridding.

A visibility is a row; gridding explodes footprints and sums by cell. Samples that share a cell and a sub-cell are summed
before the explosion, so its rows are bounded by the grid, not by the samples; the kernel is an array literal, so no
join is needed. ``sum_weight`` factorises into two one-dimensional kernel sums and is taken before any explosion.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import LIGHT, cexp, cmul, half_kernel


def positions(vis: DataFrame, n: int, cell: float) -> DataFrame:
    """``up, vp``: fractional grid positions; rows with NaN coordinates go."""
    scale = -(F.col("freq") * F.lit(cell) * n) / F.lit(LIGHT)
    return vis.where(~F.isnan("u") & ~F.isnan("v")).withColumns({"up": F.col("u") * scale + n // 2, "vp": F.col("v") * scale + n // 2})


def nearest(x: Column) -> Column:
    """Rounding towards zero after adding a half, as in the gridder's definition."""
    return (x + 0.5).cast("int")


#: What a sample needs: coordinates and a weight, and a visibility where one is gridded.
COORDINATES, VISIBILITY = ("u", "v", "weight"), ("u", "v", "weight", "re", "im")


def usable(columns: list[str] | tuple[str, ...]) -> Column:
    """Whether a sample is not flagged and none of ``columns`` is NaN or null."""
    out = ~F.coalesce(F.col("flag"), F.lit(False))
    for c in columns:
        out = out & F.col(c).isNotNull() & ~F.isnan(c)
    return out


def visible(vis: DataFrame) -> Column:
    """``usable`` by all that ``vis`` has of a sample, so that a NaN never reaches a sum."""
    return usable([c for c in VISIBILITY if c in vis.columns])


def effective_weight(columns: list[str] | tuple[str, ...] = VISIBILITY) -> Column:
    """Zero where flagged, or where coordinates, weight or visibility are NaN or null."""
    return F.when(usable(columns), F.col("weight")).otherwise(0.0)


def _cells(vis: DataFrame, n: int, cell: float, support: int, oversampling: int, mode: str) -> DataFrame:
    half = support // 2
    out = positions(vis, n, cell).withColumns({"ui": nearest(F.col("up")), "vi": nearest(F.col("vp"))})
    out = out.where((F.col("ui") - half >= 0) & (F.col("vi") - half >= 0) & (F.col("ui") + half < n) & (F.col("vi") + half < n))
    sub = lambda i, p: F.floor((F.col(i) - F.col(p)) * oversampling + 0.5).cast("int")
    chan = F.col("chan") if mode == "cube" else F.lit(0)
    return out.withColumns({"uo": sub("ui", "up"), "vo": sub("vi", "vp"), "chan": chan, "wt": effective_weight([c for c in VISIBILITY if c in vis.columns])})


def _kernel(kernel: Column, offset: Column, step: Column, oversampling: int) -> Column:
    return F.get(kernel, F.abs(step * oversampling + offset))


def places(vis: DataFrame, n: int = 64, cell: float = 5e-5, support: int = 7, oversampling: int = 100, mode: str = "cube") -> DataFrame:
    """``chan, pol, ui, vi, uo, vo, w, re, im``: weighted sums of the samples that share a cell and a sub-cell. They are grouped by
    one number first of all: where a task has more places than memory, Spark sorts them, by rows if by many columns."""
    cells = _cells(vis, n, cell, support, oversampling, mode).where("wt <> 0")
    total = lambda c: F.sum((F.col(c) if c in vis.columns else F.lit(0.0)) * F.col("wt")).alias(c)
    wide, low = 4 * oversampling + 1, 2 * oversampling
    place = F.expr(f"((bigint(ui) * {n} + vi) * {wide} + uo + {low}) * {wide} + vo + {low}")
    sums = cells.groupBy(place.alias("place"), "chan", "pol").agg(F.sum("wt").alias("w"), total("re"), total("im"))
    parts = {"ui": f"place div {wide * wide * n}", "vi": f"place div {wide * wide} % {n}", "uo": f"place div {wide} % {wide} - {low}", "vo": f"place % {wide} - {low}"}
    return sums.select("chan", "pol", *[F.expr(f"int({e})").alias(c) for c, e in parts.items()], "w", "re", "im")


PLACE = ["chan", "pol", "ui", "vi", "uo", "vo"]


def grid(vis: DataFrame, n: int = 64, cell: float = 5e-5, support: int = 7, oversampling: int = 100, mode: str = "cube", do_psf: bool = False) -> DataFrame:
    """``chan, pol, iu, iv, re, im``: the gridded visibilities, or weights for the PSF. ``mode``: cube or continuum."""
    return grid_places(places(vis, n, cell, support, oversampling, mode), n, support, oversampling, do_psf)


def grid_places(shared: DataFrame, n: int = 64, support: int = 7, oversampling: int = 100, do_psf: bool = False) -> DataFrame:
    """``chan, pol, iu, iv, re, im`` of summed samples (see ``places``)."""
    if do_psf:
        shared = shared.withColumns({"re": F.col("w"), "im": F.lit(0.0)})
    wide = footprints(shared, support, oversampling)
    return wide.groupBy("chan", "pol", "iu", "iv").agg(F.sum(F.col("k") * F.col("re")).alias("re"), F.sum(F.col("k") * F.col("im")).alias("im"))


def footprints(shared: DataFrame, support: int = 7, oversampling: int = 100) -> DataFrame:
    """``shared`` with a row a cell ``iu, iv`` that a place reaches, and the kernel ``k`` there."""
    half = support // 2
    kernel = F.array(*[F.lit(x) for x in half_kernel(support, oversampling)])
    steps = F.sequence(F.lit(-half), F.lit(half))
    wide = shared.withColumn("du", F.explode(steps)).withColumn("ku", _kernel(kernel, F.col("uo"), F.col("du"), oversampling))
    wide = wide.where("ku <> 0").withColumn("dv", F.explode(steps)).withColumn("k", F.col("ku") * _kernel(kernel, F.col("vo"), F.col("dv"), oversampling))
    return wide.withColumns({"iu": F.col("ui") + F.col("du"), "iv": F.col("vi") + F.col("dv")}).drop("du", "dv", "ku")


def spots(vis: DataFrame, n: int = 64, cell: float = 5e-5, support: int = 7, oversampling: int = 100, mode: str = "cube") -> DataFrame:
    """Samples with a weight, each at its place ``chan, pol, ui, vi, uo, vo``: ``w`` and weighted ``re, im``, besides what the
    samples have."""
    at = _cells(vis, n, cell, support, oversampling, mode).where("wt <> 0")
    return at.withColumns({"w": F.col("wt"), "re": F.col("re") * F.col("wt"), "im": F.col("im") * F.col("wt")}).drop("wt", "up", "vp")


def _kernel_sums(support: int, oversampling: int) -> tuple[Column, int]:
    """The kernel sum of each sub-cell offset, and the lowest offset."""
    values, half, low = half_kernel(support, oversampling), support // 2, -(oversampling // 2) - 1
    return F.array(*[F.lit(sum(values[abs(oversampling * d + o)] for d in range(-half, half + 1))) for o in range(low, -low + 1)]), low


def sum_weight(vis: DataFrame, n: int = 64, cell: float = 5e-5, support: int = 7, oversampling: int = 100, mode: str = "cube") -> DataFrame:
    """``chan, pol, sum_weight``: no explosion, as the footprint's kernel sum is a product."""
    sums, low = _kernel_sums(support, oversampling)
    total = F.get(sums, F.col("uo") - low) * F.get(sums, F.col("vo") - low)
    return _cells(vis, n, cell, support, oversampling, mode).groupBy("chan", "pol").agg(F.sum(F.col("wt") * total).alias("sum_weight"))


#: Side of the tiles that a grid is cut into for degridding, and places that one task looks up in a tile at once.
TILE, TOGETHER = 128, 200_000


def model_at(at: DataFrame, model: DataFrame | None, n: int, support: int = 7, oversampling: int = 100, constant: float | None = None) -> DataFrame:
    """``at`` with ``model_re, model_im``, the kernel-weighted mean of the grid around each place ``chan, pol, ui, vi, uo, vo``
    (null where ``ui`` is). Places and the grid are dealt out alike, by tiles of the grid with a halo as wide as the kernel
    reaches: each place moves once, to the one tile that holds its footprint. Places of a tile are counted first, and a tile
    with many of them goes to as many tasks as that takes."""
    half = support // 2
    if constant is not None:
        known = F.when(F.col("ui").isNotNull(), F.lit(float(constant)))
        return at.withColumns({"model_re": known, "model_im": known * 0.0})
    tile = lambda c: F.coalesce(F.expr(f"cast({c} div {TILE} as int)"), F.lit(-1))
    key = ["chan", "pol", "_tu", "_tv"]
    placed = at.withColumns({"_tu": tile("ui"), "_tv": tile("vi")})
    counts = to_all(placed.groupBy(*key).agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("_parts")))
    placed = placed.join(counts, key, "left").withColumn("_part", F.pmod(F.xxhash64(*at.columns), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    tiles = lambda c: F.explode(F.expr(f"sequence(cast(greatest(0, ({c} - {half}) div {TILE}) as int), cast(({c} + {half}) div {TILE} as int))"))
    cells = model.where(F.col("iu").between(0, n - 1) & F.col("iv").between(0, n - 1)).select("chan", "pol", "iu", "iv", "re", "im", tiles("iu").alias("_tu"))
    cells = cells.withColumn("_tv", tiles("iv")).join(counts, key).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    kernel, side = np.array(half_kernel(support, oversampling)), TILE + 2 * half
    steps = np.arange(-half, half + 1)

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        columns = left.drop_columns([*key[2:], "_part"])
        if not left.num_rows or left["_tu"][0].as_py() < 0:
            return columns.append_column("model_re", pa.nulls(left.num_rows, pa.float64())).append_column("model_im", pa.nulls(left.num_rows, pa.float64()))
        low = [left[c][0].as_py() * TILE - half for c in key[2:]]
        grid = np.zeros((side, side), complex)
        if right.num_rows:
            np.add.at(grid, (right["iu"].to_numpy() - low[0], right["iv"].to_numpy() - low[1]), right["re"].to_numpy() + 1j * right["im"].to_numpy())
        ui, vi, uo, vo = (left[c].to_numpy().astype(np.int64) for c in ("ui", "vi", "uo", "vo"))
        ku, kv = (kernel[np.abs(steps * oversampling + o[:, None])] for o in (uo, vo))
        total = np.zeros(len(ui), complex)
        for a, du in enumerate(steps):
            row = grid[(ui - low[0] + du)[:, None], (vi - low[1])[:, None] + steps]
            total += ku[:, a] * (row * kv).sum(1)
        total /= ku.sum(1) * kv.sum(1)
        return columns.append_column("model_re", pa.array(total.real)).append_column("model_im", pa.array(total.imag))

    schema = StructType([*at.schema.fields, *(StructField(c, DoubleType()) for c in ("model_re", "model_im"))])
    both = [x.groupBy(*key, "_part") for x in (placed, cells)]
    return both[0].cogroup(both[1]).applyInArrow(look_up, schema)


def degrid_onto(vis: DataFrame, model: DataFrame | None, n: int = 64, cell: float = 5e-5, support: int = 7, oversampling: int = 100, constant: float | None = None) -> DataFrame:
    """``vis`` with ``model_re, model_im``: the kernel-weighted mean of the grid (or a constant) around each sample; 0
    outside it or without coordinates."""
    half = support // 2
    scale = -(F.col("freq") * F.lit(cell) * n) / F.lit(LIGHT)
    known = lambda c: F.when(~F.isnan("u") & ~F.isnan("v"), F.col(c) * scale + n // 2)
    wanted = [c for c in vis.columns if c not in ("model_re", "model_im")]
    middle, width = (n - 1) / 2, (n - 1) / 2 - half
    at = vis.drop("model_re", "model_im").withColumns({"_up": known("u"), "_vp": known("v")})
    at = at.withColumn("_in", (F.abs(F.rint("_up") - middle) <= width) & (F.abs(F.rint("_vp") - middle) <= width))
    spot = lambda p: F.when(F.col("_in"), F.rint(p).cast("int"))
    sub = lambda p: F.when(F.col("_in"), F.floor((F.rint(p) - F.col(p)) * oversampling + 0.5).cast("int"))
    at = at.withColumns({"ui": spot("_up"), "vi": spot("_vp"), "uo": sub("_up"), "vo": sub("_vp")}).drop("_up", "_vp", "_in")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return model_at(at, model, n, support, oversampling, constant).select(*wanted, zero("model_re"), zero("model_im"))


def degrid(vis: DataFrame, model: DataFrame | None, n: int = 64, cell: float = 5e-5, support: int = 7, oversampling: int = 100, constant: float | None = None) -> DataFrame:
    """``event_id, re, im`` of ``degrid_onto``."""
    return degrid_onto(vis, model, n, cell, support, oversampling, constant).select("event_id", F.col("model_re").alias("re"), F.col("model_im").alias("im"))


def _renamed(name: str, numbers: dict[int, int] | None) -> Column:
    """A column's numbers by a map; those without an entry stay."""
    if not numbers:
        return F.col(name)
    return F.coalesce(F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])[F.col(name)], F.col(name))


def degrid_mapped(vis: DataFrame, model: DataFrame, chan_map: dict[int, int] | None = None, pol_map: dict[int, int] | None = None, incremental: bool = False, **grid: object) -> DataFrame:
    """``degrid_onto`` where channels and polarisations of the data look at other ones of the grid, as many channels at one
    of a coarser cube. ``incremental`` adds to the ``model_re, model_im`` that the data have."""
    columns = [c for c in vis.columns if c not in ("model_re", "model_im")]
    kept = {"chan": F.col("_chan"), "pol": F.col("_pol")}
    seen = vis.withColumns({"_chan": F.col("chan"), "_pol": F.col("pol"), "chan": _renamed("chan", chan_map), "pol": _renamed("pol", pol_map)})
    if incremental:
        seen = seen.withColumns({"_re": F.col("model_re"), "_im": F.col("model_im")})
        kept |= {"model_re": F.col("model_re") + F.col("_re"), "model_im": F.col("model_im") + F.col("_im")}
    return degrid_onto(seen, model, **grid).withColumns(kept).select(*columns, "model_re", "model_im")


#: Rows of kernels up to which they are sent to all tasks (about 50 MB).
KERNEL_ROWS = 1_000_000


def to_all(kernels: DataFrame) -> DataFrame:
    """``kernels`` marked for broadcast if they are few enough; more of them are joined by a shuffle on their key."""
    return F.broadcast(kernels) if kernels.limit(KERNEL_ROWS + 1).count() <= KERNEL_ROWS else kernels


def _nearest_cells(vis: DataFrame, n: int, cell: float) -> DataFrame:
    """Usable samples within the grid, with their cell ``iu, iv``."""
    out = positions(vis, n, cell).where(usable(COORDINATES))
    out = out.withColumns({"iu": nearest(F.col("up")), "iv": nearest(F.col("vp"))})
    return out.where(F.col("iu").between(0, n - 1) & F.col("iv").between(0, n - 1))


def weight_density(vis: DataFrame, n: int = 64, cell: float = 5e-5, averaged: int = 1) -> DataFrame:
    """``chan, iu, iv, density``: the weights of the nearest cells and of their conjugates, of samples within the grid.
    ``averaged`` divides the density, as where the weights of two polarisations are halves of one sample's."""
    at = _nearest_cells(vis, n, cell)
    pair = F.array(F.struct("iu", "iv"), F.struct(nearest(n - F.col("up")).alias("iu"), nearest(n - F.col("vp")).alias("iv")))
    both = at.select("chan", "weight", F.explode(pair).alias("c")).select("chan", "weight", "c.iu", "c.iv")
    return both.where(F.col("iu").between(0, n - 1) & F.col("iv").between(0, n - 1)).groupBy("chan", "iu", "iv").agg((F.sum("weight") / averaged).alias("density"))


def briggs_factors(density: DataFrame, sums: DataFrame, scheme: str, robust: float = 0.5, noise: float = 1.0) -> DataFrame:
    """``chan, a, b`` of the new weight ``w / (a G + b)``. ``scheme``: briggs, briggs_abs or uniform."""
    if scheme == "briggs_abs":
        return sums.select("chan", F.lit(robust**2).alias("a"), F.lit(2.0 * noise**2).alias("b"))
    if scheme == "uniform":
        return sums.select("chan", F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    squares = density.groupBy("chan").agg(F.sum(F.col("density") * F.col("density")).alias("g2"))
    a = F.lit((5.0 * 10.0**-robust) ** 2) / (F.col("g2") / F.col("sw"))
    return squares.join(sums, "chan").select("chan", a.alias("a"), F.lit(1.0).alias("b"))


def imaging_weights(vis: DataFrame, scheme: str = "natural", robust: float = 0.5, n: int = 64, cell: float = 5e-5) -> DataFrame:
    """``event_id, weight_imaging`` of every sample, each polarisation for itself; 0 outside the grid and where the sample is
    flagged or its coordinates or weight are NaN."""
    if scheme == "natural":
        return vis.select("event_id", effective_weight(COORDINATES).alias("weight_imaging"))
    return _reweighted(vis, ["event_id"], scheme, robust, n, cell)


def _reweighted(vis: DataFrame, kept: list[str], scheme: str, robust: float, n: int, cell: float) -> DataFrame:
    """``kept, weight_imaging`` by the density of weights. Samples look their cell up and are never joined with themselves."""
    if scheme not in ("briggs", "briggs_abs", "uniform"):
        raise ValueError(f"unknown weighting scheme {scheme!r}")
    density = weight_density(vis, n, cell)
    sums = _nearest_cells(vis, n, cell).groupBy("chan").agg((2 * F.sum("weight")).alias("sw"))
    factors = F.broadcast(briggs_factors(density, sums, scheme, robust))  # one row a channel
    scale = -(F.col("freq") * F.lit(cell) * n) / F.lit(LIGHT)
    # Samples without a cell look up one that cannot be, by a hash, so they do not meet in one task.
    nowhere = F.lit(-2) - F.pmod(F.xxhash64(*[c for c in kept if not dict(vis.dtypes)[c].startswith("array")]), F.lit(4096)).cast("int")
    place = lambda c: F.when(usable(COORDINATES), nearest(F.col(c) * scale + n // 2)).otherwise(nowhere)
    at = vis.select(*dict.fromkeys([*kept, "chan", "weight"]), place("u").alias("iu"), place("v").alias("iv"))
    at = at.join(density, ["chan", "iu", "iv"], "left").join(factors, "chan", "left")
    inside = F.col("iu").between(0, n - 1) & F.col("iv").between(0, n - 1)
    new = F.when(F.col("density").isNotNull() & (F.col("density") != 0), F.col("weight") / (F.col("a") * F.col("density") + F.col("b"))).otherwise(F.col("weight"))
    return at.select(*kept, F.when(inside, new).otherwise(0.0).alias("weight_imaging"))


def averaged_weights(vis: DataFrame, scheme: str, robust: float = 0.5, n: int = 64, cell: float = 5e-5, correlations: int = 2, sample: tuple[str, ...] = ("t", "ant1", "ant2", "chan")) -> DataFrame:
    """``event_id, pol, weight_imaging`` with one weight for all polarisations of a ``sample``: the mean of its parallel
    hands (0 and 1 of two correlations, 0 and 3 of four) makes the density and is reweighted. A hand that is flagged, NaN or
    absent takes the sample's other hands with it: their weight is 0. Samples are gathered once, and spread back from the
    arrays that they were gathered in."""
    if correlations not in (2, 4):
        raise ValueError("there are two or four correlations")
    fit = F.when(usable(COORDINATES), F.col("weight"))
    hand = lambda p: F.max(F.when(F.col("pol") == p, fit))
    one = vis.groupBy(*sample).agg(*[F.max(c).alias(c) for c in ("u", "v", "freq")], ((hand(0) + hand(correlations - 1)) / 2).alias("weight"), F.collect_list(F.struct("event_id", "pol")).alias("hands"))
    one = one.withColumn("flag", F.col("weight").isNull())
    new = _reweighted(one, [*sample, "hands"], scheme, robust, n, cell) if scheme != "natural" else one.withColumn("weight_imaging", F.coalesce("weight", F.lit(0.0)))
    return new.select(F.explode("hands").alias("h"), "weight_imaging").select("h.event_id", "h.pol", "weight_imaging")


def single_dish_grid(vis: DataFrame, n: int = 64, cell: float = 40.0, radius: int = 3, kernel: list[float] | None = None, sampling: int = 1) -> DataFrame:
    """``pol, iu, iv, re, im, weight``: a radial kernel scattered within a circle, clipped at the edges; half-even rounding
    and the conjugate of the value. ``kernel`` has ``sampling`` values a cell of radius, of which the nearest counts and none
    beyond the last; without it it is ``exp(-r * r)``. Samples outside the image are left out."""
    x, y = F.col("u") / cell + n // 2, F.col("v") / cell + n // 2
    at = vis.where(visible(vis)).select("pol", "re", "im", "weight", x.alias("x"), y.alias("y"), F.rint(x).cast("int").alias("ci"), F.rint(y).cast("int").alias("cj"))
    at = at.where((F.col("x") >= 0) & (F.col("x") < n) & (F.col("y") >= 0) & (F.col("y") < n))
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    wide = at.withColumn("di", F.explode(steps)).withColumn("dj", F.explode(steps)).withColumns({"iu": F.col("ci") + F.col("di"), "iv": F.col("cj") + F.col("dj")})
    d2 = (F.col("iu") - F.col("x")) * (F.col("iu") - F.col("x")) + (F.col("iv") - F.col("y")) * (F.col("iv") - F.col("y"))
    wide = wide.where(F.col("iu").between(0, n - 1) & F.col("iv").between(0, n - 1)).withColumn("d2", d2).where(F.col("d2") <= radius * radius)
    if kernel is None:
        k = F.exp(-F.col("d2"))
    else:
        values = F.array(*[F.lit(float(v)) for v in kernel])
        wide = wide.withColumn("k", F.get(values, F.rint(F.sqrt("d2") * sampling).cast("int"))).where("k is not null")
        k = F.col("k")
    k = k * F.col("weight")
    return wide.groupBy("pol", "iu", "iv").agg(F.sum(k * F.col("re")).alias("re"), F.sum(-k * F.col("im")).alias("im"), F.sum(k).alias("weight"))


def aperture_grid(vis: DataFrame, kernels: DataFrame, n: int = 16) -> DataFrame:
    """``chan, pol, iu, iv, re``: every sample's kernel at the grid's centre; weights factor out, so they are summed first."""
    sums = vis.where(visible(vis)).groupBy("chan", "pol", "cf").agg(F.sum("weight").alias("w"))
    out = sums.join(to_all(kernels), "cf")
    return out.groupBy("chan", "pol", (F.col("du") + n // 2).alias("iu"), (F.col("dv") + n // 2).alias("iv")).agg(F.sum(F.col("w") * F.col("k")).alias("re"))


def mosaic_grid(vis: DataFrame, kernels: DataFrame, n: int = 64, cell: float = 5e-5, oversampling: int = 1, gradient: tuple[str, str] | None = None, do_psf: bool = False) -> DataFrame:
    """``chan, pol, iu, iv, re, im``: gridding with a kernel by baseline class ``cf``, of weights alone with ``do_psf``. ``kernels(cf, du, dv, k)`` is a small
    table; with an oversampling above 1 it has ``uo, vo`` too, the sub-cell offsets. ``gradient`` names
    columns of radians by sub-cell that turn the kernels' phase, as for fields beside the phase centre."""
    vis = vis.where(visible(vis))
    vis = vis.withColumns({"re": F.lit(1.0), "im": F.lit(0.0)}) if do_psf else vis
    at = positions(vis, n, cell).withColumns({"ui": nearest(F.col("up")), "vi": nearest(F.col("vp"))})
    at = at.where((F.col("ui") >= 0) & (F.col("vi") >= 0) & (F.col("ui") < n) & (F.col("vi") < n))
    key = ["cf"]
    if oversampling > 1:
        sub = lambda i, p: F.floor((F.col(i) - F.col(p)) * oversampling + 0.5).cast("int")
        at, key = at.withColumns({"uo": sub("ui", "up"), "vo": sub("vi", "vp")}), ["cf", "uo", "vo"]
    shared = at.groupBy("chan", "pol", *key, *(gradient or ()), "ui", "vi").agg(F.sum(F.col("re") * F.col("weight")).alias("re"), F.sum(F.col("im") * F.col("weight")).alias("im"))
    wide = shared.join(to_all(kernels), key).withColumns({"iu": F.col("ui") + F.col("du"), "iv": F.col("vi") + F.col("dv")})
    wide = wide.where(F.col("iu").between(0, n - 1) & F.col("iv").between(0, n - 1))
    re, im = F.col("re"), F.col("im")
    if gradient:
        offset = lambda d, o: F.col(d) * oversampling + (F.col(o) if oversampling > 1 else 0)
        re, im = cmul((re, im), cexp(offset("du", "uo") * F.col(gradient[0]) + offset("dv", "vo") * F.col(gradient[1])))
    return wide.groupBy("chan", "pol", "iu", "iv").agg(F.sum(F.col("k") * re).alias("re"), F.sum(F.col("k") * im).alias("im"))


def mosaic_cells(vis: DataFrame, kernels: DataFrame, n: int, cell: float, oversampling: int = 10) -> DataFrame:
    """``chan, pol, iu, iv, re, im, psf_re, psf_im``: visibilities and weights gridded together with the kernel of each sample's
    class ``cf``, turned by its phase gradient ``gx, gy``. ``kernels(cf, uo, vo, support, k)`` has an array of ``support``
    squared values for each sub-cell. Samples of one place, class and field are summed first; then places are dealt out by
    tiles of the grid, each with the kernels of its classes, and a tile with many places goes to many tasks. What leaves a task
    is cells, so footprints are never rows."""
    vis = vis.where(visible(vis))
    at = positions(vis, n, cell).withColumns({"ui": nearest(F.col("up")), "vi": nearest(F.col("vp"))})
    at = at.where((F.col("ui") >= 0) & (F.col("vi") >= 0) & (F.col("ui") < n) & (F.col("vi") < n))
    sub = lambda i, p: F.floor((F.col(i) - F.col(p)) * oversampling + 0.5).cast("int")
    at = at.withColumns({"uo": sub("ui", "up"), "vo": sub("vi", "vp")})
    total = lambda c: F.sum(F.col(c) * F.col("weight")).alias(c)
    shared = at.groupBy("chan", "pol", "cf", "gx", "gy", "ui", "vi", "uo", "vo").agg(F.sum("weight").alias("w"), total("re"), total("im"))
    key = ["chan", "pol", "_tu", "_tv"]
    placed = shared.withColumns({"_tu": F.expr(f"cast(ui div {TILE} as int)"), "_tv": F.expr(f"cast(vi div {TILE} as int)")})
    counts = to_all(placed.groupBy(*key).agg(F.ceil(F.count("*") / (TOGETHER // 8)).cast("int").alias("_parts"), F.collect_set("cf").alias("_classes")))
    placed = placed.join(counts.drop("_classes"), key).withColumn("_part", F.pmod(F.xxhash64("cf", "gx", "gy", "uo", "vo", "ui", "vi"), "_parts").cast("int")).drop("_parts")
    asked = counts.withColumn("cf", F.explode("_classes")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    laid = asked.select(*[F.col(c).alias(c) for c in (*key, "_part")], "cf").join(kernels.select("cf", "uo", "vo", "support", "k"), "cf")

    def lay(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["chan", "pol", "iu", "iv", "re", "im", "psf_re", "psf_im"]
        if not left.num_rows:
            return pa.table([pa.nulls(0, pa.int32())] * 4 + [pa.nulls(0, pa.float64())] * 4, names)
        held = {key_: (s, np.array(k).reshape(s, s)) for key_, s, k in zip(zip(*(right[c].to_pylist() for c in ("cf", "uo", "vo"))), right["support"].to_pylist(), right["k"].to_pylist())}
        half = max(s for s, _ in held.values()) // 2
        low = [left[c][0].as_py() * TILE - half for c in key[2:]]
        side = TILE + 2 * half
        sky, psf = np.zeros(side * side, complex), np.zeros(side * side, complex)
        ui, vi = (left[c].to_numpy().astype(np.int64) - low[i] for i, c in enumerate(("ui", "vi")))
        values, w = left["re"].to_numpy() + 1j * left["im"].to_numpy(), left["w"].to_numpy()
        kinds = list(zip(*(left[c].to_pylist() for c in ("cf", "uo", "vo", "gx", "gy"))))
        rows: dict[tuple, list[int]] = {}
        for i, kind in enumerate(kinds):
            rows.setdefault(kind, []).append(i)
        for (cf, uo, vo, gx, gy), some in rows.items():
            support, kernel = held[cf, uo, vo]
            d = np.arange(support) - support // 2
            wave = np.exp(1j * (d * oversampling + uo) * gx)[:, None] * np.exp(1j * (d * oversampling + vo) * gy)
            foot = ((d * side)[:, None] + d).ravel()
            spots = ((ui[some] * side + vi[some])[:, None] + foot).ravel()
            turned = (kernel * wave).ravel()
            np.add.at(sky, spots, (values[some][:, None] * turned).ravel())
            np.add.at(psf, spots, (w[some][:, None] * turned).ravel())
        cells = np.flatnonzero((sky != 0) | (psf != 0))
        iu, iv = cells // side + low[0], cells % side + low[1]
        inside = (iu >= 0) & (iu < n) & (iv >= 0) & (iv < n)
        cells, iu, iv = cells[inside], iu[inside], iv[inside]
        same = [pa.array(np.full(len(cells), left[c][0].as_py()), pa.int32()) for c in key[:2]]
        return pa.table([*same, pa.array(iu, pa.int32()), pa.array(iv, pa.int32()), *[pa.array(x) for x in (sky[cells].real, sky[cells].imag, psf[cells].real, psf[cells].imag)]], names)

    both = [x.groupBy(*key, "_part") for x in (placed, laid)]
    return both[0].cogroup(both[1]).applyInArrow(lay, "chan int, pol int, iu int, iv int, re double, im double, psf_re double, psf_im double")
