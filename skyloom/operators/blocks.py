"""Summed samples in arrays, for work that comes back to them again and again. Places (cell and sub-cell) are dealt out once,
by blocks of the grid, and lie in rows of arrays from then on; models are sent to these rows, and what leaves a task is
cells. A block has a bounded number of places, and its rows a bounded number of them, whatever the samples are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..functions import half_kernel

#: Cells of patches, and places, that are worked on together.
PATCHES, TOGETHER = 1 << 20, 1 << 16
#: Bytes of models up to which they are sent to all tasks.
TO_ALL = 1 << 24
BLOCK = ("chan", "pol", "bu", "bv")


def side(n: int) -> int:
    """Cells along an edge of a block: small grids have enough blocks for many tasks, large ones little halo."""
    return min(32, max(8, n // 8))


class _Spots:
    """Places in arrays, and the cells of their block's patch (the block and a halo) that they reach. ``at`` numbers cell and
    sub-cell of a place within its block, ``owner`` the block's row. Neighbours that differ in ``vo`` only are a strip: what the
    kernel does along u is done once for it."""

    def __init__(self, at: np.ndarray, owner: np.ndarray, block: int, support: int, oversampling: int) -> None:
        kernel, half, low = np.array(half_kernel(support, oversampling)), support // 2, lowest(oversampling)
        steps, reach, wide = np.arange(-half, half + 1) * oversampling, np.arange(2 * half + 1), 1 - 2 * low
        self.patch = block + 2 * half
        key, vo = at // wide, at % wide + low
        self.first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])
        self.strip = np.repeat(np.arange(len(self.first)), np.diff(np.r_[self.first, len(at)]))
        place, uo = key[self.first] // wide, key[self.first] % wide + low
        lu, lv = (x.astype(np.int64)[:, None] for x in (place // block, place % block))
        self.ku, self.kv = (kernel[np.abs(steps + o[:, None])] for o in (uo, vo))
        corner = owner[self.first].astype(np.int64)[:, None] * self.patch**2
        self.cells = (corner + (lu + reach) * self.patch)[:, :, None] + (lv + reach)[:, None, :]
        self.total = self.ku.sum(1)[self.strip] * self.kv.sum(1)

    def laid(self, values: np.ndarray, count: int) -> np.ndarray:
        """Values gridded on the patches of ``count`` blocks."""
        along = np.add.reduceat(values[:, None] * self.kv, self.first)
        return np.bincount(self.cells.ravel(), (self.ku[:, :, None] * along[:, None, :]).ravel(), count * self.patch**2)

    def seen(self, patches: np.ndarray) -> np.ndarray:
        """The kernel-weighted mean of the patches around each place."""
        along = (self.ku[:, :, None] * patches[self.cells]).sum(1)
        return (along[self.strip] * self.kv).sum(1) / self.total


def lowest(oversampling: int) -> int:
    """The lowest sub-cell offset."""
    return -(oversampling // 2) - 1


def _slices(counts: np.ndarray, patch: int) -> Iterator[tuple[int, int]]:
    """Rows that are worked on together: a bounded number of cells and, but for a single row, of places."""
    begin, held = 0, 0
    for i, count in enumerate(counts):
        if i > begin and (held + count > TOGETHER or (i - begin + 1) * patch**2 > PATCHES):
            yield begin, i
            begin, held = i, 0
        held += count
    if len(counts):
        yield begin, len(counts)


def _list(counts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(values, kind))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of lists (0 of null) and their values."""
    return column.value_lengths().fill_null(0).to_numpy(), column.flatten().to_numpy()


def in_blocks(places: DataFrame, n: int, support: int = 7, oversampling: int = 100) -> DataFrame:
    """``chan, pol, bu, bv, at, w, sum_weight, spot, re, im, weight`` of ``gridding.places``: rows of a block with arrays of places
    and their weights, the sum of weights as gridded, and arrays of the cells of the block's patch that have anything: gridded
    visibilities and weights. A block is a row or, if it has many places, several."""
    block, half, low = side(n), support // 2, lowest(oversampling)
    wide, patch = 1 - 2 * low, block + 2 * half
    if (block * wide) ** 2 >= 1 << 31:
        raise ValueError("places of a block are numbered in 32 bits; lower the oversampling")
    at = f"int((((ui % {block}) * {block} + vi % {block}) * {wide} + uo - ({low})) * {wide} + vo - ({low}))"
    frame = places.selectExpr("chan", "pol", f"int(ui div {block}) AS bu", f"int(vi div {block}) AS bv", f"{at} AS at", "w", "re", "im")
    # One number orders blocks and their places, which Spark sorts much faster than rows by five columns. Should two blocks of a
    # task share a hash, they alternate, and their rows are shorter.
    order = F.shiftleft(F.xxhash64(*BLOCK), 31).bitwiseOR(F.col("at").cast("long")).alias("order")
    frame = frame.select(*BLOCK, order, "w", "re", "im").repartition(*BLOCK).sortWithinPartitions("order")
    frame = frame.select(*BLOCK, F.col("order").bitwiseAND((1 << 31) - 1).cast("int").alias("at"), "w", "re", "im")
    ints, doubles = ArrayType(IntegerType(), False), ArrayType(DoubleType(), False)
    kinds = {"at": ints, "w": doubles, "sum_weight": DoubleType(), "spot": ints, "re": doubles, "im": doubles, "weight": doubles}
    schema = StructType([*frame.select(*BLOCK).schema.fields, *(StructField(c, t) for c, t in kinds.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch[c].to_numpy(zero_copy_only=False) for c in BLOCK]
            starts = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)])
            starts = np.union1d(starts, np.arange(0, batch.num_rows, TOGETHER))
            ends = np.r_[starts[1:], batch.num_rows]
            columns = [batch[c].to_numpy(zero_copy_only=False) for c in ("at", "w", "re", "im")]
            for a, b in _slices(ends - starts, patch):
                some, counts = slice(starts[a], ends[b - 1]), (ends - starts)[a:b]
                at, w, re, im = (c[some] for c in columns)
                owner = np.repeat(np.arange(b - a), counts)
                spots = _Spots(at, owner, block, support, oversampling)
                laid = [spots.laid(x, b - a) for x in (re, im, w)]
                held = np.flatnonzero(np.any([x != 0 for x in laid], axis=0))
                cells = np.bincount(held // patch**2, minlength=b - a)
                total = pa.array(np.bincount(owner, w * spots.total, b - a))
                arrays = [_list(counts, at, pa.int32()), _list(counts, w, pa.float64()), total, _list(cells, held % patch**2, pa.int32()), *(_list(cells, x[held], pa.float64()) for x in laid)]
                yield pa.RecordBatch.from_arrays([*(batch[c].take(pa.array(starts[a:b])) for c in BLOCK), *arrays], [*BLOCK, *kinds])

    return frame.mapInArrow(run, schema)


def sum_weight(blocks: DataFrame) -> DataFrame:
    """``chan, pol, sum_weight`` as ``gridding.sum_weight`` has them."""
    return blocks.groupBy("chan", "pol").agg(F.sum("sum_weight").alias("sum_weight"))


def grid(blocks: DataFrame, n: int, support: int = 7) -> DataFrame:
    """``chan, pol, iu, iv, re, im, weight``: gridded visibilities and weights."""
    block, half = side(n), support // 2
    patch = block + 2 * half
    cells = blocks.select(*BLOCK, F.explode(F.arrays_zip("spot", "re", "im", "weight")).alias("c")).select(*BLOCK, "c.*")
    at = {"iu": F.expr(f"int(bu * {block} + spot div {patch} - {half})"), "iv": F.expr(f"int(bv * {block} + spot % {patch} - {half})")}
    return cells.withColumns(at).groupBy("chan", "pol", "iu", "iv").agg(*[F.sum(c).alias(c) for c in ("re", "im", "weight")])


def regrid(blocks: DataFrame, model: DataFrame, n: int, planes: int, support: int = 7, oversampling: int = 100) -> DataFrame:
    """``chan, pol, iu, iv, re, im``: a gridded model (``chan, pol, iu, iv, re, im``) seen at every place and gridded again with
    the weights there. A cell may have several rows, to be summed. ``planes`` is the number of channels times polarisations:
    the patches of few and small planes are sent to all tasks, others are dealt out with the blocks."""
    block, half = side(n), support // 2
    patch = block + 2 * half
    tiles = lambda c: F.explode(F.expr(f"sequence(int(greatest(0, ({c} - {half}) div {block})), int(({c} + {half}) div {block}))"))
    cells = model.where(F.col("iu").between(0, n - 1) & F.col("iv").between(0, n - 1)).select("chan", "pol", "iu", "iv", "re", "im", tiles("iu").alias("bu"))
    spot = F.expr(f"int((iu - bu * {block} + {half}) * {patch} + iv - bv * {block} + {half})")
    cells = cells.withColumn("bv", tiles("iv")).groupBy(*BLOCK).agg(F.collect_list(F.struct(spot.alias("spot"), "re", "im")).alias("m"))
    patches = cells.select(*BLOCK, *[F.col(f"m.{c}").alias(f"m_{c}") for c in ("spot", "re", "im")])
    small = planes * (-(-n // block) + 1) ** 2 * patch**2 * 20 <= TO_ALL
    both = blocks.select(*BLOCK, "at", "w").join(F.broadcast(patches) if small else patches, list(BLOCK))
    schema = StructType([*both.select("chan", "pol").schema.fields, *(StructField(c, IntegerType()) for c in ("iu", "iv")), *(StructField(c, DoubleType()) for c in ("re", "im"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b in _slices(whole["at"].value_lengths().to_numpy(), patch):
                batch = whole.slice(a, b - a)
                counts, at = _flat(batch["at"])
                (cells, spot), w = _flat(batch["m_spot"]), _flat(batch["w"])[1]
                spot = spot + np.repeat(np.arange(b - a), cells) * patch**2
                spots = _Spots(at, np.repeat(np.arange(b - a), counts), block, support, oversampling)
                laid = [spots.laid(w * spots.seen(np.bincount(spot, _flat(batch[c])[1], (b - a) * patch**2)), b - a) for c in ("m_re", "m_im")]
                held = np.flatnonzero((laid[0] != 0) | (laid[1] != 0))
                row, spot = held // patch**2, held % patch**2
                iu, iv = (batch[c].to_numpy()[row] * block + x - half for c, x in (("bu", spot // patch), ("bv", spot % patch)))
                keys = [batch[c].take(pa.array(row)) for c in ("chan", "pol")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(iu, pa.int32()), pa.array(iv, pa.int32()), *(pa.array(x[held]) for x in laid)], schema.names)

    return both.mapInArrow(run, schema)
