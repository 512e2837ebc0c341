"""Whole planes in batches. Pixels are dealt out by plane in one shuffle and sorted; a task sees many small planes at once as
arrays, so transforms, CLEAN and fits run over all of them together. A plane must fit a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("plane", "chan")
#: Pixels that are worked on together, unless one plane has more.
TOGETHER = 1 << 18
_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}


class Planes:
    """Consecutive whole planes of a task: their keys, the first row of each (and the end), and columns of rows."""

    def __init__(self, batches: list[pa.RecordBatch], starts: np.ndarray) -> None:
        table = pa.Table.from_batches(batches).combine_chunks()
        self.keys = {k: table[k].combine_chunks().take(pa.array(starts)) for k in KEY}
        self.columns = {c: table[c].to_numpy() for c in table.column_names if c not in KEY}
        self.starts = np.append(starts, table.num_rows)
        self.owner = np.repeat(np.arange(len(starts)), np.diff(self.starts))

    def __len__(self) -> int:
        return len(self.starts) - 1

    def groups(self, n: int | None = None) -> Iterator[tuple[np.ndarray, tuple[int, int], np.ndarray]]:
        """(planes, shape, rows) of planes of one shape, a bounded number of pixels together; ``n`` is the side if known."""
        l, m = self.columns["l"], self.columns["m"]
        shapes = np.full((len(self), 2), n) if n else np.stack([np.maximum.reduceat(c, self.starts[:-1]) + 1 for c in (l, m)], 1)
        for shape in np.unique(shapes, axis=0):
            which = np.flatnonzero((shapes == shape).all(1))
            step = max(1, TOGETHER // int(shape.prod()))
            for at in range(0, len(which), step):
                some = which[at : at + step]
                yield some, (int(shape[0]), int(shape[1])), np.flatnonzero(np.isin(self.owner, some))

    def cube(self, column: str, some: np.ndarray, shape: tuple[int, int], rows: np.ndarray, empty: float = 0.0) -> np.ndarray:
        """(planes, l, m) of a column; pixels without a row are ``empty``."""
        out = np.full((len(some), *shape), empty)
        out[self.place(some, rows)] = self.columns[column][rows]
        return out

    def place(self, some: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.searchsorted(some, self.owner[rows]), self.columns["l"][rows], self.columns["m"][rows]

    def all_pixels(self, some: np.ndarray, **values: np.ndarray) -> dict[str, pa.Array | np.ndarray]:
        """A row for each pixel of cubes."""
        shape = next(iter(values.values())).shape
        plane, l, m = (x.ravel() for x in np.indices(shape))
        return {**{k: v.take(pa.array(some[plane])) for k, v in self.keys.items()}, "l": l, "m": m, **{c: v.ravel() for c, v in values.items()}}

    def own_rows(self, rows: np.ndarray, **values: np.ndarray) -> dict[str, pa.Array | np.ndarray]:
        """A row for each of ``rows``."""
        keys = {k: v.take(pa.array(self.owner[rows])) for k, v in self.keys.items()}
        return {**keys, "l": self.columns["l"][rows], "m": self.columns["m"][rows], **values}


def map_planes(img: DataFrame, columns: list[str], function: Callable[[Planes], Iterator[dict]], schema: str, order: tuple[str, ...] = ("l", "m")) -> DataFrame:
    """``function`` of the planes of ``img``, by rows in ``order``; it yields columns by name, keys among them."""
    kinds = dict(img.select(*KEY).dtypes)
    fields = [f.split() for f in schema.split(", ")]
    full = ", ".join([f"{k} {t}" for k, t in kinds.items()] + [schema])
    types = [*kinds.items(), *fields]
    frame = img.select(*KEY, *columns).repartition(*[F.col(k) for k in KEY]).sortWithinPartitions(*KEY, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            starts = np.concatenate([[0], 1 + _changes(pa.Table.from_batches(parts))])
            for out in function(Planes(parts, starts)):
                yield pa.RecordBatch.from_arrays([pa.array(out[c], _ARROW[t]) if isinstance(out[c], np.ndarray) else out[c].cast(_ARROW[t]) for c, t in types], [c for c, _ in types])

        for batch in batches:
            if not batch.num_rows:
                continue
            inner = _changes(pa.Table.from_batches([batch]))
            same = not held or all(held[-1][k][-1] == batch[k][0] for k in KEY)
            if len(inner):
                cut = int(inner[-1]) + 1
                yield from close([*held, batch.slice(0, cut)])
                held = [batch.slice(cut)]
            elif same:
                held.append(batch)
            else:
                yield from close(held)
                held = [batch]
        if held:
            yield from close(held)

    return frame.mapInArrow(run, full)


def _changes(table: pa.Table) -> np.ndarray:
    """Rows after which the plane changes."""
    keys = [table[k].to_numpy() for k in KEY]
    return np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0))
