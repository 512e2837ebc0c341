"""Planes larger than a task: transforms by strips with a transpose between, and CLEAN by tiles. A task holds a strip or a tile,
never a plane; results are those of ``images.fft`` and ``deconvolution.deconvolve``."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .deconvolution import _checked, clean_box
from .gridding import to_all
from .planes import KEY

#: Pixels of a strip.
STRIP = 1 << 18
#: Side of a tile, and pixels of a plane that one minor cycle looks at; all others are held in by bounds.
TILE, CANDIDATES = 128, 1 << 17
#: Bytes that a point spread function may have, as every task gets it.
PSF_BYTES = 1 << 28
ABSENT, HELD, OPEN = 0, 1, 2


def _table(kinds: dict[str, str], names: list[str], columns: list) -> pa.Table:
    types = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "list": pa.list_(pa.float64())}
    return pa.table([c if isinstance(c, pa.Array) else pa.array(c, types[kinds[n]]) for n, c in zip(names, columns)], names)


# ---- transforms ----------------------------------------------------------------------------------------------------
def fft_strips(img: DataFrame, n: int, inverse: bool = False, strip: int | None = None) -> DataFrame:
    """``plane, chan, l, m, re, im``: the centred transform of ``n`` x ``n`` planes (see ``images.fft``). Strips of lines are
    transformed along one axis and cut into square blocks; these are dealt out anew as strips of the other axis, as arrays,
    so the transpose moves a row a block. ``strip`` pixels are held at once (or one line). Absent pixels are zero; a place
    outside the plane raises."""
    lines = max(1, min(n, (strip or STRIP) // n))
    source = img if "im" in img.columns else img.select(*KEY, "l", "m", F.col("value").alias("re"), F.lit(0.0).alias("im"))
    kinds = dict(source.select(*KEY, "l", "m").dtypes)
    turn = np.fft.ifft if inverse else np.fft.fft

    def turned(z: np.ndarray, axis: int) -> np.ndarray:
        return np.fft.fftshift(turn(np.fft.ifftshift(z, axis), axis=axis), axis)

    keys = ", ".join(f"{k} {kinds[k]}" for k in KEY)

    def along(key: tuple, rows: pa.Table) -> pa.Table:
        plane, chan, number = (k.as_py() for k in key)
        l, m = (rows[c].to_numpy() for c in ("l", "m"))
        if min(l.min(), m.min()) < 0 or max(l.max(), m.max()) >= n:
            raise ValueError(f"a pixel lies outside the plane of {n} x {n}")
        z = np.zeros((min(lines, n - number * lines), n), complex)
        z[l - number * lines, m] = rows["re"].to_numpy() + 1j * rows["im"].to_numpy()
        z = turned(z, 1)
        blocks = [z[:, at : at + lines].ravel() for at in range(0, n, lines)]
        count = len(blocks)
        return _table(
            kinds | {"strip": "bigint", "side": "bigint", "re": "list", "im": "list"}, [*KEY, "strip", "side", "re", "im"],
            [[plane] * count, [chan] * count, range(count), [number] * count, [b.real for b in blocks], [b.imag for b in blocks]],
        )

    def across(key: tuple, rows: pa.Table) -> pa.Table:
        plane, chan, number = (k.as_py() for k in key)
        first = number * lines
        z = np.zeros((n, min(lines, n - first)), complex)
        for side, re, im in zip(rows["side"].to_pylist(), *(rows[c].combine_chunks() for c in ("re", "im"))):
            block = re.values.to_numpy() + 1j * im.values.to_numpy()
            z[side * lines : (side + 1) * lines] = block.reshape(-1, z.shape[1])
        z = turned(z, 0)
        l, m = (x.ravel() for x in np.indices(z.shape))
        return _table(
            kinds | {"re": "double", "im": "double"}, [*KEY, "l", "m", "re", "im"],
            [pa.array([plane] * z.size, rows["plane"].type), pa.array([chan] * z.size, rows["chan"].type), l, m + first, z.real.ravel(), z.imag.ravel()],
        )

    by = [*KEY, "strip"]
    halfway = source.select(*KEY, "l", "m", "re", "im", F.expr(f"l div {lines}").alias("strip")).groupBy(*by)
    blocks = halfway.applyInArrow(along, f"{keys}, strip bigint, side bigint, re array<double>, im array<double>")
    return blocks.groupBy(*by).applyInArrow(across, f"{keys}, l {kinds['l']}, m {kinds['m']}, re double, im double")


def feather_strips(high: DataFrame, low: DataFrame, n: int, alpha: float, beta: float, omega: float = 1.0, factor: float = 1.0, strip: int | None = None) -> DataFrame:
    """``images.feather`` of planes larger than a task, for one beam. Absent pixels count as zero."""
    x, y = ((F.col(c) - n // 2) / n for c in "lm")
    w = F.exp(-(math.pi**2) / (4 * math.log(2)) * ((alpha * x) * (alpha * x) + (beta * y) * (beta * y)))
    a, b = fft_strips(high, n, strip=strip), fft_strips(low, n, strip=strip).withColumnsRenamed({"re": "low_re", "im": "low_im"})
    both = a.join(b, [*KEY, "l", "m"]).withColumn("w", w)
    mixed = {c: ((1 - F.col("w")) * F.col(c) + factor * omega * F.col(f"low_{c}") * F.col("w")) / ((1 - F.col("w")) + factor * F.col("w")) for c in ("re", "im")}
    sky = fft_strips(both.withColumns(mixed).select(*KEY, "l", "m", "re", "im"), n, True, strip)
    return sky.select(*KEY, "l", "m", F.col("re").alias("value"))


# ---- CLEAN ---------------------------------------------------------------------------------------------------------
def reach(psf: np.ndarray, tile: int) -> np.ndarray:
    """The largest magnitude of ``psf``, its centre left out, in each window of ``tile`` x ``tile``; windows begin
    ``tile - 1`` before it."""
    out = np.abs(psf).astype(float)
    out[psf.shape[0] // 2, psf.shape[1] // 2] = 0.0
    for axis in (0, 1):
        pads = [(0, 0), (0, 0)]
        pads[axis] = (tile - 1, tile - 1)
        out, width = np.pad(out, pads), 1
        while width < tile:  # windows double until they are wide enough
            step = min(width, tile - width)
            size = out.shape[axis] - step
            out = np.maximum(out.take(range(size), axis), out.take(range(step, size + step), axis))
            width += step
    return out


def minor_cycle(
    places: tuple[np.ndarray, np.ndarray], value: np.ndarray, bound: np.ndarray, psf: np.ndarray, widest: np.ndarray, tile: int, gain: float, niter: int, threshold: float
) -> tuple[list[int], list[int], list[float], bool]:
    """Components ``x, y, step`` of CLEAN among candidates (in order of pixels), and whether more may follow. ``bound`` limits the magnitudes
    of all other pixels by tile; it grows with what a component can add there. It goes on while the largest candidate
    surely is the largest pixel, as the first one is."""
    x, y = places
    value, bound = value.copy(), bound.copy()
    cx, cy = psf.shape[0] // 2, psf.shape[1] // 2
    xs, ys, steps = [], [], []
    while len(xs) < niter:
        seen = np.abs(value)
        i = int(seen.argmax()) if len(seen) else -1
        if xs and seen[i] <= bound.max() * (1 + 1e-9):
            return xs, ys, steps, True
        if i < 0 or seen[i] < threshold:
            return xs, ys, steps, False
        step = gain * value[i]
        px, py = int(x[i]), int(y[i])
        xs.append(px), ys.append(py), steps.append(float(step))
        dx, dy = x - px + cx, y - py + cy
        near = (dx >= 0) & (dx < psf.shape[0]) & (dy >= 0) & (dy < psf.shape[1])
        value[near] -= step * psf[dx[near], dy[near]]
        at = [np.arange(count) * tile - p + c + tile - 1 for count, p, c in zip(bound.shape, (px, py), (cx, cy))]
        ok = [np.flatnonzero((a >= 0) & (a < size)) for a, size in zip(at, widest.shape)]
        bound[np.ix_(*ok)] += abs(step) * widest[np.ix_(at[0][ok[0]], at[1][ok[1]])]
    return xs, ys, steps, False


def clean_tiles(
    img: DataFrame, psf: np.ndarray, n: tuple[int, int], gain: float = 0.1, niter: int = 100, threshold: float = 0.0, mask: Column | None = None, box: tuple[int, int, int, int] | None = None,
    tile: int = TILE, candidates: int = CANDIDATES,
) -> DataFrame:
    """``plane, chan, l, m, model, residual, iterations``: ``deconvolution.deconvolve`` of planes of ``n`` pixels a side that are
    larger than a task, component by component the same. ``psf`` is zero beyond its edges.

    A round has two steps. Each tile names its largest pixels and the largest of the rest; of a plane one task sees these
    only (``candidates`` in all, or one a tile) and cleans among them for as long as no other pixel can have become the
    largest. Then the components are taken off the tiles that they reach. A plane takes a round at least a component, few
    rounds where the point spread function is low outside its centre. Rounds are checkpointed."""
    _checked(gain, niter, threshold)
    if not np.isfinite(psf).all() or psf.nbytes > PSF_BYTES:
        raise ValueError(f"a point spread function is finite and has {PSF_BYTES} bytes at most")
    wide, high = (-(-side // tile) for side in n)
    top = max(1, min(tile * tile, candidates // (wide * high)))
    cx, cy = psf.shape[0] // 2, psf.shape[1] // 2
    kinds = dict(img.select(*KEY, "l", "m").dtypes)
    keys = ", ".join(f"{k} {kinds[k]}" for k in KEY)
    lists = {"residual": pa.float64(), "model": pa.float64(), "kind": pa.int8(), "top_at": pa.int32(), "top": pa.float64()}
    names = [*KEY, "a", "b", *lists, "rest"]
    schema = f"{keys}, a int, b int, residual array<double>, model array<double>, kind array<tinyint>, top_at array<int>, top array<double>, rest double"

    def state(types: list[pa.DataType], key: list, residual: np.ndarray, model: np.ndarray, kind: np.ndarray) -> pa.Table:
        seen = np.where(kind == OPEN, np.abs(residual), -1.0)
        order = np.argsort(-seen, kind="stable")  # of equal ones the first
        chosen = np.sort(order[:top][seen[order[:top]] >= 0])
        rest = seen[order[top]] if top < len(order) else -1.0
        held = (residual, model, kind, chosen, residual[chosen])
        columns = [pa.array([k], t) for k, t in zip(key, types)] + [pa.array([v], pa.list_(t)) for v, t in zip(held, lists.values())]
        return pa.table([*columns, pa.array([rest], pa.float64())], names)

    def key_types(rows: pa.Table) -> list[pa.DataType]:
        return [*(rows[k].type for k in KEY), pa.int32(), pa.int32()]

    def begin(key: tuple, rows: pa.Table) -> pa.Table:
        key = [k.as_py() for k in key]
        l, m = (rows[c].to_numpy() for c in ("l", "m"))
        if min(l.min(), m.min()) < 0 or l.max() >= n[0] or m.max() >= n[1]:
            raise ValueError(f"a pixel lies outside the plane of {n[0]} x {n[1]}")
        at = (l - key[2] * tile) * tile + m - key[3] * tile
        residual, kind = np.full(tile * tile, np.nan), np.full(tile * tile, ABSENT, np.int8)
        residual[at] = rows["value"].to_numpy(zero_copy_only=False)
        kind[at] = np.where(np.isfinite(residual[at]) & rows["open"].to_numpy().astype(bool), OPEN, HELD)
        return state(key_types(rows), key, residual, np.zeros(tile * tile), kind)

    def choose(key: tuple, rows: pa.Table) -> pa.Table:
        tiles, past = rows.filter(pc.greater_equal(rows["a"], 0)), rows.filter(pc.less(rows["a"], 0))
        done, going = (past["done"][0].as_py(), past["going"][0].as_py()) if past.num_rows else (0, True)
        x, y, steps = [], [], []
        if going and tiles.num_rows:
            a, b = (tiles[c].to_numpy() for c in ("a", "b"))
            ats = tiles["top_at"].combine_chunks()
            owner = np.repeat(np.arange(len(a)), ats.value_lengths().to_numpy(zero_copy_only=False))
            at, value = ats.flatten().to_numpy(), tiles["top"].combine_chunks().flatten().to_numpy()
            l, m = a[owner].astype(np.int64) * tile + at // tile, b[owner].astype(np.int64) * tile + at % tile
            order = np.lexsort((m, l))
            bound = np.full((wide, high), -1.0)
            bound[a, b] = tiles["rest"].to_numpy()
            x, y, steps, going = minor_cycle((l[order], m[order]), value[order], bound, psf, reach(psf, tile), tile, gain, niter - done, threshold)
            going = going and done + len(x) < niter
        one = [pa.array([k.as_py()], rows[c].type) for k, c in zip(key, KEY)]
        one += [pa.array([done + len(x)], pa.int64()), pa.array([going]), pa.array([x], pa.list_(pa.int32())), pa.array([y], pa.list_(pa.int32())), pa.array([steps], pa.list_(pa.float64()))]
        return pa.table(one, [*KEY, "done", "going", "x", "y", "step"])

    def take_off(key: tuple, tiles: pa.Table, found: pa.Table) -> pa.Table:
        if not tiles.num_rows or not found.num_rows:
            return tiles.select(names)
        key = [k.as_py() for k in key]
        residual, model = (tiles[c][0].values.to_numpy().copy().reshape(tile, tile) for c in ("residual", "model"))
        l0, m0 = key[2] * tile, key[3] * tile
        order = np.argsort(found["number"].to_numpy())
        for px, py, step in zip(*(found[c].to_numpy()[order].tolist() for c in ("x", "y", "step"))):
            if l0 <= px < l0 + tile and m0 <= py < m0 + tile:
                model[px - l0, py - m0] += step
            x0, x1 = max(l0, px - cx), min(l0 + tile, px - cx + psf.shape[0])
            y0, y1 = max(m0, py - cy), min(m0 + tile, py - cy + psf.shape[1])
            if x0 < x1 and y0 < y1:
                residual[x0 - l0 : x1 - l0, y0 - m0 : y1 - m0] -= step * psf[x0 - px + cx : x1 - px + cx, y0 - py + cy : y1 - py + cy]
        return state(key_types(tiles), key, residual.ravel(), model.ravel(), tiles["kind"][0].values.to_numpy())

    allowed = F.coalesce(mask, F.lit(False)) & clean_box(box) if mask is not None else clean_box(box)
    number = lambda c: F.expr(f"cast({c} div {tile} as int)")
    pixels = img.select(*KEY, "l", "m", F.col("value").cast("double").alias("value"), allowed.cast("int").alias("open"), number("l").alias("a"), number("m").alias("b"))
    by = [*KEY, "a", "b"]
    tiles = checkpointed(pixels.groupBy(*by).applyInArrow(begin, schema))
    past = None
    while True:
        seen = tiles.select(*by, "top_at", "top", "rest", F.lit(0).cast("long").alias("done"), F.lit(True).alias("going"))
        if past is not None:
            nothing = {"top_at": F.array().cast("array<int>"), "top": F.array().cast("array<double>"), "rest": F.lit(-1.0)}
            seen = seen.unionByName(past.select(*KEY, F.lit(-1).alias("a"), F.lit(-1).alias("b"), *[c.alias(k) for k, c in nothing.items()], "done", "going"))
        past = checkpointed(seen.groupBy(*KEY).applyInArrow(choose, f"{keys}, done long, going boolean, x array<int>, y array<int>, step array<double>"))
        if past.where("size(x) > 0").isEmpty():
            break
        parts = past.select(*KEY, F.posexplode(F.arrays_zip("x", "y", "step")).alias("number", "c")).select(*KEY, "number", "c.*")
        ends = [(c, size, middle, count) for c, size, middle, count in zip("xy", psf.shape, (cx, cy), (wide, high))]
        spans = [F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - middle) / tile).cast("int")), F.least(F.lit(count - 1), F.floor((F.col(c) - middle + size - 1) / tile).cast("int"))) for c, size, middle, count in ends]
        # a component's own pixel lies within its point spread function, so no span is empty
        parts = parts.withColumn("a", F.explode(spans[0])).withColumn("b", F.explode(spans[1]))
        tiles = checkpointed(tiles.groupBy(*by).cogroup(parts.groupBy(*by)).applyInArrow(take_off, schema))
        if past.where("going").isEmpty():
            break
    flat = tiles.select(*by, F.posexplode(F.arrays_zip("residual", "model", "kind")).alias("at", "v")).where(f"v.kind <> {ABSENT}")
    place = {c: (F.col(t) * tile + F.expr(f"at {op} {tile}")).cast(kinds[c]).alias(c) for c, t, op in (("l", "a", "div"), ("m", "b", "%"))}
    out = flat.select(*KEY, place["l"], place["m"], F.col("v.model").alias("model"), F.col("v.residual").alias("residual"))
    return out.join(to_all(past.select(*KEY, F.col("done").alias("iterations"))), list(KEY))
