"""SimHash near-duplicates found with vantage-point trees over fingerprints.

Fingerprints of 64 bits are linked at ``distance`` (4) or fewer differing bits, exactly. Equal fingerprints are one
point. A forest of vantage-point trees partitions the points: each tree looks at some blocks of the bits, and its nodes
split by the Hamming distance to a vantage point within these blocks. That distance is a metric never above the whole
one. Of ``m`` blocks, the ``k`` that a pair differs least in hold at most ``r`` of its differing bits; so in the tree of
those blocks the pair lies within ``r``, and the triangle inequality prunes a branch where the point's distance is more
than ``r`` beyond the split. Points near a split go to both sides (for the radius 0 of the production forest: to one).
With ``m = k = 1`` this is the plain tree on whole fingerprints; it gives the same links, but prunes little, as whole
fingerprints of unlike texts nearly all lie 24 to 40 bits apart. Leaves are joined independently, exactly, on all 64
bits. Larger inputs take more and finer trees, so leaves keep their size. A tree has 13 levels of its own vantage points;
below, its levels share one vantage point each (a multi-vantage-point tree), so the part sent to tasks stays bounded.

Defined results: a null or empty text has fingerprint zero and is linked like any other; a text of under four words has
one shingle; ties of a bit count are 0. Repeated rows stay, each with its component. Rows with a null ``doc_id`` get a
fingerprint and, unless a copy has an id, a null component. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, map_batches, materialize, read
from .components import components

SHINGLE, SEED = 4, 42
#: Shingle hashes whose bits are counted at once.
CHUNK = 1 << 15
#: Points that a leaf should hold, and points beyond which a leaf is dealt to several tasks.
LEAF, HOT_LEAF = 1024, 16384
#: Fingerprints, chosen by hash, from which vantage points and splits are taken. Every point is indexed.
SAMPLE = 8192
#: Levels of a tree that have a vantage point for each node.
OWN_LEVELS = 13


def fingerprint(text: bytes) -> int:
    """The SimHash of one text."""
    words = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = [0, *(ends[:-1] + 1).tolist()]
    stops = ends[SHINGLE - 1 :].tolist() if len(words) >= SHINGLE else [len(line)]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(stops), CHUNK):
        h = np.array([digest(line[i:k], SEED) for i, k in zip(begins[at : at + CHUNK], stops[at : at + CHUNK])], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * counts > len(stops)).tolist())


def fingerprints(documents: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``fp`` (the fingerprint as a signed long) for every row, beside ``keep``."""
    keep = ["doc_id"] if keep is None else keep
    types = dict(documents.dtypes)
    frame = documents.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col("text").alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text")
        found = np.array([fingerprint(t.as_buffer().to_pybytes()) if t.is_valid else 0 for t in texts], np.uint64).view(np.int64)
        kept = [batch.column(f"k{i}") for i in range(len(keep))]
        return pa.RecordBatch.from_arrays([*kept, pa.array(found)], [*[f"k{i}" for i in range(len(keep))], "fp"])

    schema = ", ".join(f"k{i} {types[c]}" for i, c in enumerate(keep)) + ", fp long"
    return map_batches(frame, run, schema).withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


@dataclass(frozen=True)
class Forest:
    """``blocks`` bit blocks, ``chosen`` of them a tree; ``distance`` is that of links."""

    distance: int = 4
    blocks: int = 5
    chosen: int = 1

    @property
    def radius(self) -> int:
        """Most bits in which a linked pair differs within the blocks that it differs least in."""
        each, more = divmod(self.distance, self.blocks)
        return self.chosen * each + max(0, self.chosen - (self.blocks - more))

    def masks(self) -> list[int]:
        """The bits of each tree."""
        cuts = [64 * i // self.blocks for i in range(self.blocks + 1)]
        block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
        return [sum(block[i] for i in which) for which in combinations(range(self.blocks), self.chosen)]

    def bits(self) -> int:
        """Bits that each tree can split by."""
        return 64 * self.chosen // self.blocks


def forest_for(points: int, distance: int = 4) -> Forest:
    """The fewest trees whose bits keep leaves of ``points`` small: one radius-0 tree a choice of blocks."""
    for chosen in range(1, 6):
        forest = Forest(distance, distance + chosen, chosen)
        if points <= LEAF << max(0, forest.bits() - 2):
            break
    return forest


@dataclass
class Tree:
    """A vantage-point tree in heap order; ``split`` is -1 at leaves."""

    mask: np.uint64
    vantage: np.ndarray
    split: np.ndarray
    shared: list[tuple[np.uint64, int]]  # vantage point and split of each level below


def grow(sample: np.ndarray, mask: int, depth: int, below: int = 0) -> Tree:
    """Split ``sample`` by the median distance to a vantage point, ``depth`` times at most, then by the medians of
    distances to ``below`` further vantage points."""
    size = (1 << (depth + 1)) - 1
    tree = Tree(np.uint64(mask), np.zeros(size, np.uint64), np.full(size, -1, np.int16), [])
    for v in np.unique(sample & tree.mask)[:: max(1, len(sample) // max(1, below))][:below]:
        tree.shared.append((v, int(np.median(np.bitwise_count(sample & tree.mask ^ v)))))
    parts = {0: sample & tree.mask}
    for node in range((1 << depth) - 1):
        points = parts.pop(node, None)
        if points is None or len(points) < 2:
            continue
        best = None
        for v in points[:: max(1, len(points) // 8)][:8]:  # of a few candidates, the one that halves the points best
            d = np.bitwise_count(points ^ v)
            for cut in (int(np.median(d)), int(np.median(d)) - 1):
                inside = int((d <= cut).sum())
                if 0 < inside < len(points) and (best is None or abs(2 * inside - len(points)) < best[0]):
                    best = (abs(2 * inside - len(points)), v, cut, d)
        if best is None:
            continue
        _, tree.vantage[node], tree.split[node], d = best
        parts[2 * node + 1], parts[2 * node + 2] = points[d <= best[2]], points[d > best[2]]
    return tree


def visit(tree: Tree, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(point, leaf) for every leaf that may hold a partner of a point or the point itself."""
    at, node = np.arange(len(points)), np.zeros(len(points), np.int64)
    done_at, done_node = [], []
    while len(at):
        split = tree.split[node]
        leaf = split < 0
        done_at.append(at[leaf])
        done_node.append(node[leaf])
        at, node, split = at[~leaf], node[~leaf], split[~leaf]
        d = np.bitwise_count((points[at] ^ tree.vantage[node]) & tree.mask).astype(np.int64)
        near, far = d <= split + radius, d > split - radius
        at, node = np.concatenate([at[near], at[far]]), np.concatenate([2 * node[near] + 1, 2 * node[far] + 2])
    return np.concatenate(done_at), np.concatenate(done_node)


def rings(tree: Tree, points: np.ndarray) -> np.ndarray:
    """One bit for each shared level: beyond its split or not. Equal for points that are equal in the tree's bits."""
    out = np.zeros(len(points), np.int64)
    for v, cut in tree.shared:
        out = out << 1 | (np.bitwise_count((points ^ v) & tree.mask) > cut)
    return out


def links_of_leaf(points: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest (positions) of the links among ``points``, by search from point to point among those left."""
    left, out = np.arange(len(points)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(points[left] ^ points[at]) <= distance
            if near.any():
                found = left[near].tolist()
                out += [(at, k) for k in found]
                queue += found
                left = left[~near]
    return out


def near_links(points: DataFrame, distance: int = 4, forest: Forest | None = None, leaf: int = LEAF, hot: int = HOT_LEAF, own_levels: int = OWN_LEVELS) -> DataFrame:
    """Links ``a, b`` (ids) that span every group of ``points(fp, id)``, of distinct fingerprints, within ``distance``."""
    spark = points.sparkSession
    count = points.count()
    forest = forest or forest_for(count, distance)
    depth = max(0, int(np.ceil(np.log2(max(1, count) / leaf))))
    slots = max(1, min(1 << 20, round((1 << 20) * SAMPLE / max(1, count))))
    sample = points.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < slots).select("fp").collect()
    chosen = np.sort(np.array([r["fp"] for r in sample], np.int64)).view(np.uint64)
    chosen = chosen[np.argsort(chosen * np.uint64(0x9E3779B97F4A7C15), kind="stable")]
    radius = forest.radius
    below = min(24, max(0, min(depth, forest.bits()) - own_levels)) if radius == 0 else 0  # bits of ``leaf`` left for them
    trees = [grow(chosen, mask, min(depth, own_levels), below) for mask in forest.masks()]
    shared = spark.sparkContext.broadcast(trees)

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp, ids = batch.column("fp").to_numpy(), batch.column("id").to_numpy()
        points = fp.view(np.uint64)
        parts = [visit(tree, points, radius) for tree in shared.value]
        at = np.concatenate([p[0] for p in parts])
        where = np.concatenate([(np.int64(k) << 40) | (rings(tree, points[p[0]]) << 16) | p[1] for k, (tree, p) in enumerate(zip(shared.value, parts))])
        return pa.RecordBatch.from_arrays([pa.array(where), pa.array(fp[at]), pa.array(ids[at])], ["leaf", "fp", "id"])

    dealt = materialize(map_batches(points.select("fp", "id"), deal, "leaf long, fp long, id long"), "simhash-leaves")
    # A leaf of too many points becomes a grid: its points fall into parts, and each pair of parts is a cell.
    sizes = dealt.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > hot)
    parts = F.ceil(F.coalesce(F.col("n"), F.lit(1)) / hot).cast("long")
    own = F.pmod(F.xxhash64("fp"), parts)
    sizes = materialize(sizes, "simhash-hot")
    cells = dealt.join(sizes, "leaf", "left").select(
        "leaf", "fp", "id", F.explode(F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.greatest(own, k) * 65536 + F.least(own, k))).alias("cell")
    )
    cells = cells.repartition(F.col("leaf"), F.col("cell")).sortWithinPartitions("leaf", "cell")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Leaf by leaf; a leaf that goes on in the next batch waits for it."""
        held: list[np.ndarray] = []

        def close(rows: np.ndarray) -> pa.RecordBatch:
            keys = rows[:2]
            ends = [*(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), rows.shape[1]]
            a, b, begin = [], [], 0
            for end in ends:
                if end - begin > 1:
                    pairs = links_of_leaf(rows[2, begin:end].view(np.uint64), distance)
                    ids = rows[3, begin:end]
                    a += [ids[i] for i, _ in pairs]
                    b += [ids[k] for _, k in pairs]
                begin = end
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(c).to_numpy() for c in ("leaf", "cell", "fp", "id")])
            last = int(np.flatnonzero((rows[:2] == rows[:2, -1:]).all(0))[0])
            while last and (rows[:2, last - 1] == rows[:2, -1]).all():
                last -= 1
            if last == 0 and (not held or (held[-1][:2, -1] == rows[:2, 0]).all()):
                held.append(rows)
                continue
            yield close(np.concatenate([*held, rows[:, :last]], axis=1))
            held = [rows[:, last:]]
        if held:
            yield close(np.concatenate(held, axis=1))

    links = materialize(cells.mapInArrow(join, "a long, b long").where("a <> b"), "simhash-links")
    discard(dealt, sizes)
    return links


def near_duplicates(documents: DataFrame, distance: int = 4, forest: Forest | None = None) -> DataFrame:
    """``doc_id, fp, component_id`` for every row: the smallest id that it reaches through links, itself included."""
    rows = materialize(fingerprints(documents), "simhash-rows")
    points = materialize(rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id")), "simhash-points")
    links = near_links(points, distance, forest)
    found = materialize(components(links), "simhash-components")
    classes = points.join(found, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return rows.join(materialize(classes, "simhash-classes"), "fp", "left").select("doc_id", "fp", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
