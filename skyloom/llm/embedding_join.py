"""Near-duplicate embeddings by an exact metric range join.

Unit vectors at a cosine of ``t`` or more lie within the Euclidean distance ``r = sqrt(2 - 2 t)``. Pivots partition the
vectors into the cells of their nearest pivots. A vector also visits every other cell that could hold a partner: the
triangle inequality rules a cell out where the vector is farther from its pivot than the cell's radius plus ``r``, or
farther than ``r`` from the plane between the two pivots. Of a pair in two cells only the vector of the later cell
visits, so each pair meets once. A cell joins its own vectors with its own and its visitors. Cells of more than ``HOME``
vectors (fewer where vectors have more than 64 components, see ``part_size``) are dealt out in parts, and each pair of parts
is a group of its own, so memory is bounded whatever the cell and the vectors' length.

Pairs are compared as 32-bit products with a guard band as wide as their rounding; only pairs within it are settled in
double precision, and ties at the threshold by an exact sum.

How many pivots pay is measured on a bounded sample: more of them make smaller cells but more visits, and where
distances hardly differ (noise in many dimensions) few are best.

Equal vectors are joined once, as one. Links are counted, not listed: a task hands on counts and a spanning forest.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing; so do vectors of
different lengths with each other. Repeated rows of one ``vec_id`` and vector are two equal vectors; different vectors of
one ``vec_id`` count their links each for itself and share a component. Rows with a null ``vec_id`` come back with null
links and component. Labels and further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, read
from .components import components

#: Most vectors of a part of a cell, and most components of all its vectors (16 MB in double precision); a task holds two parts.
HOME, HOME_VALUES = 32768, 1 << 21
#: Groups that all vectors make at least, once there are enough of them.
GROUPS = 32
#: Vectors chosen by hash to weigh the number of pivots.
SAMPLE = 4096
PIVOTS = (1, 4, 16, 64, 256, 1024)
SLACK = 1e-9
ROWS, COLUMNS = 1024, 4096  # of a block of pairs


def part_size(length: int) -> int:
    """Most vectors of ``length`` components in a part of a cell."""
    return max(1, min(HOME, HOME_VALUES // max(1, length)))


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    top = np.abs(x).max(1, keepdims=True)
    x = x / top  # no overflow in the norm
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ pivots.T)))


def visits(x: np.ndarray, pivots: np.ndarray, radii: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each vector, and (vector, cell) of all visits to earlier cells."""
    d = _distances(x, pivots)
    home = d.argmin(1)
    apart = _distances(pivots, pivots)
    own = d[np.arange(len(x)), home]
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = np.where(apart[home] > 0, (d * d - (own * own)[:, None]) / (2 * apart[home]), 0.0)
    may = (plane <= r + SLACK) & (d <= radii[None, :] + r + SLACK) & (np.arange(len(pivots))[None, :] < home[:, None])
    return home, np.argwhere(may)


def _choose(sample: np.ndarray, count: float, r: float) -> np.ndarray:
    """Pivots, as many as cost least: what is sent, plus what is compared."""
    best = None
    for p in PIVOTS:
        if p > max(1, len(sample) // 4):
            break
        pivots, rest = sample[:p], sample[p:] if len(sample) > p else sample
        seen = len(visits(rest, pivots, np.full(p, 2.0), r)[1]) / max(1, len(rest))
        sent = count * (1 + seen) * max(1.0, count / p / part_size(sample.shape[1]))
        cost = 5e-6 * sent + 4e-9 * count * count / p * (0.5 + seen)
        if best is None or cost < best[0]:
            best = (cost, pivots)
    return best[1]


class _Forest:
    """Union-find over positions; every position points at its root, the smallest position of its tree."""

    def __init__(self, size: int) -> None:
        self.up = np.arange(size)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while (apart := self.up[a] != self.up[b]).any():
            a, b = a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(self.up[a], self.up[b]), np.minimum(self.up[a], self.up[b]))
            while (self.up[self.up] != self.up).any():
                self.up = self.up[self.up]


def _settled(x: np.ndarray, i: np.ndarray, k: np.ndarray, cosine: float) -> np.ndarray:
    """Which pairs reach ``cosine`` in double precision; an exact sum decides ties."""
    out = np.empty(len(i), bool)
    for at in range(0, len(i), 1 << 14):
        a, b = x[i[at : at + (1 << 14)]], x[k[at : at + (1 << 14)]]
        c = np.einsum("ij,ij->i", a, b)
        out[at : at + len(c)] = c >= cosine
        for t in np.flatnonzero(np.abs(c - cosine) < 1e-12):
            out[at + t] = math.fsum((a[t] * b[t]).tolist()) >= cosine
    return out


def link_counts(x: np.ndarray, number: np.ndarray, first: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """For unit vectors standing for ``number`` copies each, how many copies each links with, and the root of each in the
    forest of links: pairs of a ``first`` vector with one that is not, or all pairs where all are ``first``."""
    order = np.argsort(~first, kind="stable")
    x, number, m = x[order], number[order], int(first.sum())
    rest = m if m < len(x) else 0  # where the second vectors begin
    fine = x.astype(np.float32)
    guard = (x.shape[1] + 8) * 2.0**-23
    counts, forest = np.zeros(len(x), np.int64), _Forest(len(x))
    for a in range(0, m, ROWS):
        for b in range(rest, len(x), COLUMNS):
            stop = min(a + ROWS, m)
            if not rest and b + COLUMNS <= a:
                continue
            c = fine[a:stop] @ fine[b : b + COLUMNS].T
            near = c >= cosine - guard
            if not rest and b < stop:  # pairs on and below the diagonal
                near &= np.arange(b, b + c.shape[1])[None, :] > np.arange(a, stop)[:, None]
            rows = np.flatnonzero(near.any(1))
            if not len(rows):
                continue
            i, k = np.nonzero(near[rows])
            i = rows[i]
            doubtful = np.flatnonzero(c[i, k] < cosine + guard)
            sure = np.ones(len(i), bool)
            sure[doubtful] = _settled(x, a + i[doubtful], b + k[doubtful], cosine)
            i, k = a + i[sure], b + k[sure]
            counts += np.bincount(i, number[k], len(x)).astype(np.int64) + np.bincount(k, number[i], len(x)).astype(np.int64)
            forest.join(i, k)
    out, root = np.empty_like(counts), np.empty_like(order)
    out[order], root[order] = counts, order[forest.up]
    return out, root


def _points(embeddings: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``id, v`` of rows with a vector that can link; ``h`` is a hash of ``v``, ``size`` its length."""
    v = F.col(vector_column)
    if dict(embeddings.dtypes)[vector_column] != "array<float>":
        v = v.cast("array<double>")
    fine = F.coalesce(F.size(v) > 0, F.lit(False)) & F.col(vector_column).isNotNull() & F.col(id_column).isNotNull()
    frame = embeddings.where(fine).select(F.col(id_column).alias("id"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    frame = frame.where(~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))
    return frame.select("id", F.xxhash64("v").alias("h"), F.size("v").alias("size"), "v")


def _pivots(classes: DataFrame, r: float) -> tuple[int, dict[int, np.ndarray]]:
    """The number of distinct vectors, and the pivots of each length that a bounded sample holds; vectors of other
    lengths are one cell for each length."""
    total = classes.count()
    slots = max(1, min(1 << 20, round((1 << 20) * SAMPLE / max(1, total))))
    picked = classes.where(F.pmod(F.xxhash64("h", F.lit(3)), F.lit(1 << 20)) < slots).select("size", "v", "h").collect()
    sizes: dict[int, list] = {}
    for row in sorted(picked, key=lambda row: (row["h"] * 0x9E3779B97F4A7C15) % 2**64):
        sizes.setdefault(row["size"], []).append(row["v"])
    return total, {s: _choose(_unit(np.array(v)), total * len(v) / len(picked), r) for s, v in sizes.items()}


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(length, rows, unit vectors) of each length in a batch."""
    size = batch.column("size").to_numpy()
    for s in np.unique(size):
        rows = pa.array(np.flatnonzero(size == s))
        yield int(s), rows, _unit(_matrix(batch.column("v").take(rows)))


def join(embeddings: DataFrame, cosine: float = 0.9, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id`` for every row."""
    rows = materialize(_points(embeddings, id_column, vector_column), "vectors")
    classes = materialize(rows.groupBy("h", "size", "v").agg(F.min("id").cast("long").alias("id"), F.count("*").alias("n")), "vector-classes")
    dealt, pairs = _links(classes, math.sqrt(2 - 2 * cosine), cosine)
    found = materialize(pairs, "vector-pairs")
    discard(*dealt)
    linked = materialize(components(found.where("b is not null").select("a", "b")), "vector-components").withColumnRenamed("id", "node")
    totals = found.where("b is null").groupBy(F.col("a").alias("node"), "h").agg(F.sum("links").alias("links"))
    number = materialize(totals.join(linked, "node", "full").select(F.col("node").alias("id"), "h", "links", "component"), "vector-counts")
    kind = dict(embeddings.dtypes)[id_column]
    wide = classes.join(number, ["id", "h"], "left").select(
        "h", F.col("v").alias("w"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").cast(kind).alias("component_id")
    )
    wide = materialize(wide, "vector-results")
    one = rows.join(wide, (rows["h"] == wide["h"]) & (rows["v"] == wide["w"])).select(F.col("id").alias("vec_id"), "n_links", "component_id")
    v = F.col(vector_column).cast("array<double>")
    unfit = F.coalesce(F.size(v) <= 0, F.lit(True)) | F.col(vector_column).isNull() | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(v, lambda x: x != 0)
    unfit = F.coalesce(unfit, F.lit(True)) | F.col(id_column).isNull()
    alone = embeddings.where(unfit).select(F.col(id_column).alias("vec_id"), F.when(F.col(id_column).isNotNull(), 0).cast("long").alias("n_links"), F.col(id_column).alias("component_id"))
    return one.unionByName(alone)


def _links(classes: DataFrame, r: float, cosine: float) -> tuple[tuple[DataFrame, DataFrame], DataFrame]:
    """Tables that are read once, and ``a, h, links`` (``b`` null): how many copies the class ``a, h`` links with, in parts; ``a, b``: spanning links."""
    spark = classes.sparkSession
    total, pivots = _pivots(classes, r)
    shared = spark.sparkContext.broadcast(pivots)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far: dict[tuple[int, int], float] = {}
        for batch in batches:
            for size, _, x in _by_length(batch):
                if size in shared.value:
                    d = _distances(x, shared.value[size])
                    for cell, value in zip(d.argmin(1).tolist(), d.min(1).tolist()):
                        far[size, cell] = max(value, far.get((size, cell), 0.0))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in far], pa.int32()), pa.array([k[1] for k in far], pa.int64()), pa.array(list(far.values()), pa.float64())], ["size", "cell", "far"])

    radii = {s: np.zeros(len(p)) for s, p in pivots.items()}
    for row in classes.select("size", "v").mapInArrow(measure, "size int, cell long, far double").groupBy("size", "cell").agg(F.max("far").alias("far")).collect():  # one row a pivot
        radii[row["size"]][row["cell"]] = row["far"]
    bounds = spark.sparkContext.broadcast(radii)
    columns = ["id", "h", "n", "size", "v"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, rows, x in _by_length(batch):
                home, other = np.zeros(len(x), np.int64), np.zeros((0, 2), np.int64)
                if size in shared.value:
                    home, other = visits(x, shared.value[size], bounds.value[size], r)
                at = pa.array(np.concatenate([np.arange(len(home)), other[:, 0]]))
                cell, own = np.concatenate([home, other[:, 1]]), np.arange(len(at)) < len(home)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(own), *[batch.column(c).take(rows).take(at) for c in columns]], ["cell", "own", *columns])

    kinds = ", ".join(f"{c} {t}" for c, t in classes.select(columns).dtypes)
    dealt = materialize(classes.select(columns).mapInArrow(deal, f"cell long, own boolean, {kinds}"), "vector-cells")
    sizes = dealt.groupBy("size", "cell").agg(F.sum(F.col("own").cast("long")).alias("held"), F.sum((~F.col("own")).cast("long")).alias("seen"))
    # Parts of the own vectors: as many as memory asks for, and enough for GROUPS groups of all vectors, with 512 in each.
    spread = F.least(F.sqrt(F.col("held") * (2.0 * GROUPS / max(1, total))), F.col("held") / 512)
    most = F.greatest(F.lit(1), F.least(F.lit(HOME), F.expr(f"{HOME_VALUES} div size")))  # part_size of each length
    sizes = sizes.select("size", "cell", F.ceil(F.greatest(F.col("held") / most, spread, F.lit(1.0))).cast("int").alias("parts"), F.ceil(F.col("seen") / most).cast("int").alias("more"))
    sizes = materialize(sizes, "vector-sizes")
    mine = F.when(F.col("own"), F.pmod("h", "parts")).otherwise(F.col("parts") + F.pmod("h", F.greatest("more", F.lit(1)))).cast("int")
    others = F.when(F.col("own"), F.sequence(F.lit(0), F.col("parts") + F.col("more") - 1)).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    cells = dealt.join(sizes, ["size", "cell"]).withColumn("mine", mine).withColumn("other", F.explode(others))
    cells = cells.select("size", "cell", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), (F.col("mine") <= F.col("other")).alias("first"), "id", "h", "n", "v")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        first, low, high = np.asarray(table["first"]), table["low"][0].as_py(), table["high"][0].as_py()
        none = np.zeros(0, np.int64)
        if low != high and (first.all() or not first.any()):
            return pa.table([pa.array(none)] * 4, ["a", "h", "b", "links"])
        ids, h = table["id"].to_numpy(), table["h"].to_numpy()
        counts, root = link_counts(_unit(_matrix(table["v"].combine_chunks())), table["n"].to_numpy(), first, cosine)
        some, tied = np.flatnonzero(counts), np.flatnonzero((root != np.arange(len(root))) & (ids != ids[root]))
        empty = lambda n: pa.nulls(n, pa.int64())
        both = lambda x, y: pa.chunked_array([x, y], pa.int64())
        return pa.table(
            [both(pa.array(ids[some]), pa.array(ids[tied])), both(pa.array(h[some]), empty(len(tied))), both(empty(len(some)), pa.array(ids[root[tied]])), both(pa.array(counts[some]), empty(len(tied)))], ["a", "h", "b", "links"]
        )

    return (dealt, sizes), cells.groupBy("size", "cell", "low", "high").applyInArrow(compare, "a long, h long, b long, links long")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = join(read(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


#: All pairs in SQL, for small tables; components by the smallest id that is reachable.
ORACLE_SQL = """
WITH RECURSIVE flat AS (
  SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings
), norms AS (
  SELECT vec_id, sqrt(sum(x * x)) AS norm FROM flat GROUP BY vec_id
), units AS (
  SELECT e.vec_id, list_transform(e.embedding, lambda y: y::DOUBLE / n.norm) AS u FROM embeddings e JOIN norms n USING (vec_id) WHERE n.norm > 0 AND isfinite(n.norm)
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM units a JOIN units b ON a.vec_id <> b.vec_id AND list_dot_product(a.u, b.u) >= 0.9
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), degree AS (
  SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM least LEFT JOIN degree USING (vec_id)
"""
