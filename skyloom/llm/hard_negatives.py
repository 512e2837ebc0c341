"""Hard negatives for anchors among labelled vectors, with exact integer scores.

Components are floor(256 x); a score is the integer inner product with the anchor. The positives of an anchor are its ``k``
best other rows of its label; the negatives of an (anchor, positive) pair are the best rows of other labels whose score lies
between ``low`` and ``high`` percent of the positive's.

Scores are found by an orthogonal rotation onto principal components, fitted on a bounded sample (it only steers the work).
Partial products over the leading components are accumulated; what the other components can add or take away is bounded by
the product of the residual norms plus a slack for rounding. Pairs that can't matter any more are discarded after each
portion of components; the survivors' scores are integer products.

Anchors and rows are dealt into blocks, and each pair of blocks is a group of its own that hands on a few rows an anchor. So
memory is bounded, and no group depends on a label or on copies: every anchor meets every row once, in blocks.

Defined results: rows with a null id, label or vector, an empty vector, or null or non-finite components take no part.
Repeated rows (equal id, label and vector) are one row; other rows that share an id are rows of their own, each an anchor of
its own if its id is one, but never positives of each other. Vectors of different lengths have no score with each other.
Scores beyond 53 bits are computed with Python's integers; if a positive's score exceeds 64 bits, that pair has no rows. An
anchor without positives or negatives has no rows. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, read

#: Vectors that the rotation is fitted on.
SAMPLE = 8192
#: Components of the rows, and of the anchors, of one block.
ROW_CELLS, ANCHOR_CELLS = 4 << 20, 1 << 20
#: Blocks of rows that there are at least, once they hold 1024 rows.
GROUPS = 16
#: Pairs that are scored at once.
TILE_ROWS, TILE_ANCHORS = 4096, 256
#: Portions of the components after which pairs are discarded.
PORTIONS = (0.25, 0.5, 0.75, 0.875)
EPSILON = 2.0**-52


def rotation(vectors: np.ndarray) -> np.ndarray:
    """Principal components of ``vectors`` in columns, the largest first: an orthogonal matrix."""
    _, axes = np.linalg.eigh(vectors.T @ vectors / max(1, len(vectors)))
    return np.ascontiguousarray(axes[:, ::-1])


class Rotated:
    """Integer vectors and their rotated form: leading components, and norms of what follows each portion."""

    def __init__(self, q: np.ndarray, axes: np.ndarray) -> None:
        self.q = q
        with np.errstate(over="ignore", invalid="ignore"):
            self.y = q @ axes
            self.norm = np.sqrt((q * q).sum(1))
            tail = np.cumsum((self.y * self.y)[:, ::-1], 1)[:, ::-1]
            d = q.shape[1]
            self.cuts = sorted({max(1, round(d * p)) for p in PORTIONS} - {d}) + [d]
            self.rest = [np.sqrt(tail[:, c]) if c < d else np.zeros(len(q)) for c in self.cuts]

    def part(self, rows: slice) -> Rotated:
        out = object.__new__(Rotated)
        out.q, out.y, out.norm, out.cuts, out.rest = self.q[rows], self.y[rows], self.norm[rows], self.cuts, [r[rows] for r in self.rest]
        return out


def slack(axes: np.ndarray) -> float:
    """How far, relative to the product of norms, rotated products may be from true ones: by axes that are not quite
    orthogonal, and by rounding."""
    d = len(axes)
    return float(np.abs(axes.T @ axes - np.eye(d)).sum()) + 32 * d * EPSILON


def survivors(a: Rotated, b: Rotated, may: np.ndarray, at_least: np.ndarray, at_most: np.ndarray, loose: float) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, row) pairs of ``may`` whose score can lie between the anchor's limits."""
    live = np.flatnonzero(may.any(0))
    may, begin = may[:, live], 0
    product = np.zeros(may.shape)
    with np.errstate(over="ignore", invalid="ignore"):
        for cut, ra, rb in zip(a.cuts, a.rest, b.rest):
            product += a.y[:, begin:cut] @ b.y[live, begin:cut].T
            begin = cut
            reach = ra[:, None] * rb[live] + loose * a.norm[:, None] * b.norm[live]
            # written so that an infinite or undefined bound discards nothing
            may = may & ~(product + reach < at_least[:, None]) & ~(product - reach > at_most[:, None])
            if cut < a.cuts[-1]:
                some = may.any(0)
                live, may, product = live[some], may[:, some], product[:, some]
    i, j = np.nonzero(may)
    return i, live[j]


def integer_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows; Python's integers where doubles could round."""
    out = []
    for at in range(0, len(a), 1 << 15):
        x, y = a[at : at + (1 << 15)], b[at : at + (1 << 15)]
        if np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * x.shape[1] < 2.0**53:
            out.append(np.einsum("ij,ij->i", x, y).astype(np.int64))
        else:
            out.append(np.array([sum(int(u) * int(v) for u, v in zip(s, t)) for s, t in zip(x.tolist(), y.tolist())], object))
    if any(o.dtype == object for o in out):
        out = [o.astype(object) for o in out]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _order(group: np.ndarray, score: np.ndarray, row_id: np.ndarray) -> np.ndarray:
    if score.dtype == object:
        return np.array(sorted(range(len(group)), key=lambda i: (group[i], -score[i], row_id[i])), np.int64)
    return np.lexsort((row_id, -score, group))


class _Best:
    """The first ``k`` of each group, highest score first, then smallest id."""

    def __init__(self, groups: int, k: int, least: np.ndarray) -> None:
        self.k, self.least = k, least.astype(float)
        self.group, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.groups = groups

    def add(self, group: np.ndarray, score: np.ndarray, row_id: np.ndarray) -> None:
        if not len(group):
            return
        g, s, i = np.r_[self.group, group], np.r_[self.score, score], np.r_[self.id, row_id]
        order = _order(g, s, i)
        g = g[order]
        starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        place = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))
        keep = place < self.k
        self.group, self.score, self.id = g[keep], s[order][keep], i[order][keep]
        last = self.group[place[keep] == self.k - 1]
        with np.errstate(over="ignore"):
            self.least[last] = np.maximum(self.least[last], self.score[place[keep] == self.k - 1].astype(float) * (1 - 4 * EPSILON * np.sign(self.score[place[keep] == self.k - 1].astype(float))))


def best_same(a: Rotated, b: Rotated, la: np.ndarray, lb: np.ndarray, ia: np.ndarray, ib: np.ndarray, loose: float, k: int) -> tuple[np.ndarray, ...]:
    """(anchor, id, score) of the ``k`` best other rows of each anchor's label."""
    best = _Best(len(la), k, np.full(len(la), -np.inf))
    for rows in _tiles(len(lb)):
        for mine in range(0, len(la), TILE_ANCHORS):
            own = slice(mine, mine + TILE_ANCHORS)
            may = (la[own, None] == lb[rows]) & (ia[own, None] != ib[rows])
            i, j = survivors(a.part(own), b.part(rows), may, best.least[own], np.full(len(la[own]), np.inf), loose)
            best.add(mine + i, integer_products(a.q[mine + i], b.q[rows][j]), ib[rows][j])
    return best.group, best.id, best.score


def best_other(a: Rotated, b: Rotated, la: np.ndarray, lb: np.ndarray, ib: np.ndarray, window: np.ndarray, lows: np.ndarray, highs: np.ndarray, loose: float, k: int) -> tuple[np.ndarray, ...]:
    """(window, id, score) of the ``k`` best rows of other labels in each window of scores; ``window`` names the anchor of
    each."""
    best = _Best(len(window), k, lows.astype(float) * (1 - 4 * EPSILON))
    by_anchor = np.argsort(window, kind="stable")
    begin = np.searchsorted(window[by_anchor], np.arange(len(la) + 1))
    for rows in _tiles(len(lb)):
        for mine in range(0, len(la), TILE_ANCHORS):
            own = slice(mine, mine + TILE_ANCHORS)
            n = len(la[own])
            lo, hi = np.full(n, np.inf), np.full(n, -np.inf)
            w = by_anchor[begin[mine] : begin[mine + n]]
            np.minimum.at(lo, window[w] - mine, best.least[w])
            np.maximum.at(hi, window[w] - mine, highs[w].astype(float) * (1 + 4 * EPSILON))
            i, j = survivors(a.part(own), b.part(rows), la[own, None] != lb[rows], lo, hi, loose)
            score = integer_products(a.q[mine + i], b.q[rows][j])
            counts = (begin[1:] - begin[:-1])[mine + i]
            owner = np.repeat(np.arange(len(i)), counts)
            at = by_anchor[np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + begin[mine + i][owner]]
            fits = (score[owner] >= lows[at]) & (score[owner] <= highs[at]) & (score[owner].astype(float) >= best.least[at])
            best.add(at[fits], score[owner][fits], ib[rows][j[owner][fits]])
    return best.group, best.id, best.score


def _tiles(count: int) -> Iterator[slice]:
    yield slice(0, 256)  # a few rows first, for a first bound
    for at in range(256, count, TILE_ROWS):
        yield slice(at, at + TILE_ROWS)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)


def _whole(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.floor(256 * x)


def rows_for_mining(embeddings: DataFrame, label: Column) -> DataFrame:
    """``id, label, v`` of the rows that take part, each once."""
    v = F.col("embedding").cast("array<double>")
    frame = embeddings.select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), v.alias("v"))
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 7e305))  # 256 times that is finite
    return frame.where("id is not null and label is not null and size(v) > 0").where(fine).distinct()


def _blocks(cells: int, count: int, most: int, groups: int) -> int:
    return max(1, -(-cells // most), min(groups, count // 1024))


def _paired(anchors: DataFrame, rows: DataFrame, across: int, down: int) -> DataFrame:
    """Both tables side by side, each block of anchors with each block of rows."""
    a = anchors.withColumn("own", F.lit(True)).withColumn("x", F.pmod(F.xxhash64("id", "label", F.lit(5)), F.lit(across)))
    a = a.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))))
    b = rows.withColumn("own", F.lit(False)).withColumn("y", F.pmod(F.xxhash64("id", "v", F.lit(6)), F.lit(down)))
    b = b.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))))
    return a.unionByName(b, allowMissingColumns=True)


def _by_length(table: pa.Table) -> Iterator[tuple[pa.Table, pa.Table]]:
    """Anchors and rows of each length in a group that has both."""
    size = np.asarray(table["size"])
    own = np.asarray(table["own"])
    for s in np.unique(size[own]):
        mine, others = np.flatnonzero(own & (size == s)), np.flatnonzero(~own & (size == s))
        if len(others):
            yield table.take(pa.array(mine)), table.take(pa.array(others))


def mine(embeddings: DataFrame, label: Column, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``."""
    spark = embeddings.sparkSession
    rows = rows_for_mining(embeddings, label)
    rows = materialize(rows.select("id", "label", "v", F.size("v").alias("size")), "mining-rows")
    anchors = rows.where(anchor).withColumn("anchor", F.xxhash64("id", "label", "v"))
    total = rows.agg(F.count("*").alias("n"), F.sum("size").alias("cells")).first()
    asked = anchors.agg(F.count("*").alias("n"), F.sum("size").alias("cells")).first()
    if not asked["n"]:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    axes = spark.sparkContext.broadcast(_fitted(rows, total["n"]))
    across = _blocks(asked["cells"], asked["n"], ANCHOR_CELLS, 1)
    down = _blocks(total["cells"], total["n"], ROW_CELLS, GROUPS)

    def turned(table: pa.Table) -> tuple[Rotated, float]:
        q = _whole(_matrix(table["v"]))
        own = axes.value.get(q.shape[1])
        own = np.eye(q.shape[1]) if own is None else own
        return Rotated(q, own), slack(own)

    def same(table: pa.Table) -> pa.Table:
        out = []
        for a, b in _by_length(table):
            (ra, loose), (rb, _) = turned(a), turned(b)
            at, ids, score = best_same(ra, rb, np.asarray(a["label"]), np.asarray(b["label"]), np.asarray(a["id"]), np.asarray(b["id"]), loose, positives)
            out.append(pa.table([a["anchor"].take(pa.array(at)), a["id"].take(pa.array(at)), pa.array(ids, pa.int64()), _texts(score)], ["anchor", "anchor_id", "positive_id", "score"]))
        return pa.concat_tables(out) if out else pa.table([pa.nulls(0, pa.int64())] * 3 + [pa.nulls(0, pa.string())], ["anchor", "anchor_id", "positive_id", "score"])

    kept = ["id", "label", "v", "size"]
    dealt = _paired(anchors.select("anchor", *kept), rows.select(*kept), across, down)
    near = dealt.groupBy("x", "y").applyInArrow(same, "anchor long, anchor_id long, positive_id long, score string")
    near = near.withColumn("score", F.col("score").cast("decimal(38,0)"))
    first = Window.partitionBy("anchor").orderBy(F.desc("score"), "positive_id")
    near = near.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives)
    # Scores that don't fit a long give no pair; below zero no score lies between the limits.
    near = near.where("score between 0 and 9223372036854775807").withColumn("score", F.col("score").cast("long"))
    pairs = materialize(near.groupBy("anchor").agg(F.collect_list(F.struct("positive_id", "score")).alias("positives")), "mining-positives")

    def other(table: pa.Table) -> pa.Table:
        out = []
        for a, b in _by_length(table):
            (ra, loose), (rb, _) = turned(a), turned(b)
            lists = a["positives"].combine_chunks()
            window = np.repeat(np.arange(len(a)), lists.value_lengths().to_numpy())
            ids, scores = lists.flatten().field("positive_id").to_numpy(), lists.flatten().field("score").to_numpy()
            lows = np.array([-(-low * s // 100) for s in scores.tolist()], np.int64)
            highs = np.array([high * s // 100 for s in scores.tolist()], np.int64)
            at, found, score = best_other(ra, rb, np.asarray(a["label"]), np.asarray(b["label"]), np.asarray(b["id"]), window, lows, highs, loose, negatives)
            whose = pa.array(window[at])
            out.append(pa.table([a["anchor"].take(whose), a["id"].take(whose), pa.array(ids[at], pa.int64()), pa.array(found, pa.int64()), pa.array(scores[at], pa.int64()), pa.array(score.tolist(), pa.int64())], names))
        return pa.concat_tables(out) if out else pa.table([pa.nulls(0, pa.int64())] * 6, names)

    names = ["anchor", "anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"]
    asking = anchors.select("anchor", *kept).join(pairs, "anchor")
    dealt = _paired(asking, rows.select(*kept), across, down)
    far = dealt.groupBy("x", "y").applyInArrow(other, ", ".join(f"{n} long" for n in names))
    order = Window.partitionBy("anchor", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    result = materialize(ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "mining-found")
    discard(rows, pairs)
    return result


def _texts(score: np.ndarray) -> pa.Array:
    return pa.array([str(s) for s in score.tolist()], pa.string())


def _fitted(rows: DataFrame, total: int) -> dict[int, np.ndarray]:
    """Axes for the lengths that a bounded sample shows; other lengths go without."""
    slots = max(1, min(1 << 20, round((1 << 20) * SAMPLE / max(1, total))))
    picked = rows.where(F.pmod(F.xxhash64("id", "v", F.lit(7)), F.lit(1 << 20)) < slots).select("v").collect()
    lengths: dict[int, list] = {}
    for row in picked:
        lengths.setdefault(len(row["v"]), []).append(row["v"])
    out = {}
    for size, vectors in lengths.items():
        q = _whole(np.array(vectors))
        if size <= 4096 and np.abs(q).max() < 1e100:
            out[size] = rotation(q)
    return out


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(read(spark, sf_dir, "embeddings"), label, F.col("id") % 100 == 0)


ORACLE_SQL = """
WITH fine AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM fine a JOIN fine b ON a.vec_id <> b.vec_id AND a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), ranked AS (
  SELECT p.*, s.other_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other_id) AS rank
  FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""
