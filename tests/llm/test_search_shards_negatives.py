"""Lexical search, sharding and hard-negative mining against brute force, and on tables of edge cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.llm import hard_negatives, lexical_search, sharding

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCUMENT = "doc_id long, text string, lang string, source string, n long, term string, query int, rank int, size int, shard int, slot int"


def lowered(text):
    return re.sub("[A-Z]", lambda c: c[0].lower(), text)


def brute_search(docs, items, k=10):
    terms = [(i, Counter(TERM.findall(lowered(t)))) for i, t in docs if t is not None]
    terms = [(i, c) for i, c in terms if c]
    documents, total = len(terms), sum(c.total() for _, c in terms)
    held = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in set(items):
        found = []
        for doc_id, c in terms:
            m = 10 + 90 * c.total() * documents // total
            score = sum(math.floor(1000 * math.log((2 * documents + 2) / (2 * held[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(TERM.findall(lowered(text or ""))) if c[t])
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        out += [(item, n, None if null else d, -s) for n, (s, null, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(11)
    words = [f"w{i}" for i in range(60)] + ["Ärger", "漢字", "the", "THE", "of"]
    weights = [1 / (i + 1) for i in range(60)] + [0.1, 0.1, 3, 1, 3]
    docs = [(i, " ".join(r.choices(words, weights, k=r.randint(1, 80)))) for i in range(300)]
    docs += [(i, docs[7][1]) for i in range(300, 330)] + [docs[5], docs[5], (None, docs[9][1]), (None, docs[9][1])]
    docs += [(400, None), (401, ""), (402, " \t--"), (403, "w1 " * 40_000), (404, "x" * 100_000), (405, docs[3][1] + " w59 w58")]
    items = [(i, " ".join(r.choices(words, k=r.randint(1, 12)))) for i in range(40)]
    items += [(50, None), (51, ""), (52, "unseen terms"), (53, docs[7][1]), (53, docs[7][1]), (54, "the of"), (55, docs[9][1])]
    return docs, items


@pytest.mark.parametrize("small", [False, True])
def test_search_against_brute_force(spark, corpus, monkeypatch, small):
    if small:  # many blocks of queries, few documents at once, texts cut into parts
        for name, value in (("BLOCK_BYTES", 500), ("CELLS", 64), ("PART", 50), ("POSTINGS", 100)):
            monkeypatch.setattr(lexical_search, name, value)
    docs, items = corpus
    frame = spark.createDataFrame([(i, t, None, None, 1, "a", 1, 1, 1, 1, 1) for i, t in docs], DOCUMENT).repartition(5)
    queries = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = sorted(map(tuple, lexical_search.search(frame, queries).collect()), key=repr)
    assert got == brute_search(docs, items)


def test_search_puts_terms_aside_safely(spark, corpus):
    docs, _ = corpus
    item = np.array([0, 0, 0, 1, 1])
    queries = lexical_search.Queries(item, np.array([0, 1, 2, 0, 2]), np.ones(3, np.int64), np.array([100, 30, 10]), np.array([50, 5, 9]))
    assert queries.bound.tolist() == [50, 50] and queries.suffix.tolist() == [40, 10]
    assert queries.by_term.tolist() == [0, 1] and queries.starts.tolist() == [0, 2, 2, 2]
    big = lexical_search.length_norms(np.array([10**12]), 10**10, 10**13)
    assert big.tolist() == [10 + 90 * 10**12 * 10**10 // 10**13]


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], DOCUMENT)
    queries = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b", *[None] * 9)], DOCUMENT)
    assert lexical_search.search(none, queries).count() == 0
    assert lexical_search.search(some, queries.limit(0)).count() == 0
    assert [tuple(r) for r in lexical_search.search(some, queries).collect()] == [(1, 1, 1, 2 * math.floor(1000 * math.log(4 / 3)) * (10**9 // (1000 + 8 * 100)))]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, *[None] * 9) for i, t in rows], DOCUMENT).repartition(7)


def test_shards_are_whole_and_even(spark):
    r = random.Random(12)
    rows = [(i, "ä" * r.randint(0, 900)) for i in range(3000)]
    rows += [(None, None)] * 700 + [(7, "hot")] * 2000 + [(9, "x" * 400)] * 500  # hot keys and repeated rows
    found, shard_map = sharding.shard(documents(spark, rows))
    found = found.collect()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((x.doc_id, x["size"], x.text_crc32) for x in found) == want
    load, slots = Counter(), defaultdict(list)
    for x in found:
        load[x.shard] += x["size"]
        slots[x.shard].append(x.slot)
    assert sorted(load) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) < 1.02 * sum(load.values()) / 24 and min(load.values()) > 0.98 * sum(load.values()) / 24
    assert {x.version for x in shard_map.collect()} == {1, 2}
    second = {(x.virtual_slot, x.part): x.shard for x in shard_map.where("version = 2").collect()}
    assert all(second[x.virtual_slot, x.part] == x.shard for x in found)


def test_shards_of_runs_and_edits(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 20)
    records = sharding.materialize(sharding.digest(documents(spark, [(i % 400, "t" * (i % 50)) for i in range(6000)])), "records")
    parts, units = sharding.unit_sizes(records, 6)
    first = sharding.first_map(units, 6)
    even = sharding.rebalanced(units, first, 6)
    more = sharding.grown(units, even, 6)
    held = sharding.placed(records, parts, units, more).collect()
    by = defaultdict(list)
    for x in held:
        by[x.shard].append(x.slot)
    assert len(held) == 6000 and sorted(by) == list(range(7)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    moved = sharding.changes(even, more).collect()
    assert moved and {x.target for x in moved} == {6} and {r.version for r in more.collect()} == {3}
    loads = {s: 0 for s in range(7)}
    for x in held:
        loads[x.shard] += x["size"]
    assert max(loads.values()) < 1.1 * sum(loads.values()) / 7
    assert sharding.changes(even, sharding.rebalanced(units, even, 6)).count() < 0.2 * units.count()


def test_shards_of_few_and_no_rows(spark):
    assert sharding.shard(documents(spark, []))[0].count() == 0
    found = sharding.shard(documents(spark, [(1, None), (2, ""), (3, "x" * 10_000)]))[0].collect()
    assert sorted((x.doc_id, x["size"]) for x in found) == [(1, 8), (2, 8), (3, 10_008)] and all(x.slot == 0 for x in found)


def brute_negatives(rows, anchor, k=5, n=10):
    rows = {(i, label, tuple(v)) for i, v, label in rows if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    rows = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows]
    out = []
    for i, label, q in rows:
        if not anchor(i):
            continue
        scores = [(-sum(a * b for a, b in zip(q, p)), j, other) for j, other, p in rows if len(p) == len(q)]
        for s, j, _ in sorted(x for x in scores if x[1] != i and x[2] == label)[:k]:
            fit = sorted((t, m) for t, m, other in scores if other != label and 30 * -s <= 100 * -t <= 90 * -s and 0 <= -s < 2**63)
            out += [(i, j, rank, m, -s, -t) for rank, (t, m) in enumerate(fit[:n], 1)]
    return Counter(out)


@pytest.mark.parametrize("blocks", [False, True])
def test_negatives_against_brute_force(spark, monkeypatch, blocks):
    if blocks:
        for name, value in (("ROW_CELLS", 900), ("ANCHOR_CELLS", 200), ("TILE_ROWS", 50), ("TILE_ANCHORS", 7), ("SAMPLE", 60)):
            monkeypatch.setattr(hard_negatives, name, value)
    g = np.random.default_rng(13)
    base = g.normal(size=(6, 12))
    rows = [(i, (base[i % 6] + g.normal(size=12) * (0.3 + 2 * (i % 2))).tolist(), int(g.integers(3))) for i in range(500)]
    rows += [(i, rows[3][1], i % 3) for i in range(500, 600)] + [rows[0], rows[0], (10, rows[0][1], 1)]
    rows += [(700, None, 1), (710, [], 1), (720, [1.0] * 12, None), (None, [1.0] * 12, 1), (730, [1.0, None] + [0.0] * 10, 1), (740, [float("nan")] * 12, 1), (750, [float("inf")] * 12, 1)]
    rows += [(i, [float(i % 7), 1.0 + i % 5, -2.0], i % 2) for i in range(760, 790)]  # another length
    rows += [(i, [i * 1e9, 3e8 * (i % 3), 1.0, 5e8], i % 2) for i in range(800, 830)]  # beyond 53 bits
    rows += [(i, [1e200 * (i - 840), 1.0], i % 2) for i in range(840, 845)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, anchor string, size int").repartition(3)
    got = Counter(map(tuple, hard_negatives.mine(frame, F.col("label"), F.col("id") % 10 == 0).collect()))
    assert got == brute_negatives(rows, lambda i: i % 10 == 0) and len(got) > 500


def test_negatives_of_empty_tables(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert hard_negatives.mine(spark.createDataFrame([], kind), F.col("label"), F.col("id") % 100 == 0).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(100, [1.0], 1)], kind), F.col("label"), F.col("id") % 100 == 0).count() == 0


def test_bounds_discard_most_and_lose_none():
    g = np.random.default_rng(14)
    spread = 1 / (1 + np.arange(48.0))
    q = np.floor(256 * g.normal(size=(3000, 48)) * spread @ np.linalg.qr(g.normal(size=(48, 48)))[0])
    axes = hard_negatives.rotation(q[:500])
    turned, loose = hard_negatives.Rotated(q, axes), hard_negatives.slack(axes)
    score = q[:40] @ q.T
    least = np.sort(score, 1)[:, -10]
    i, j = hard_negatives.survivors(turned.part(slice(0, 40)), turned, np.ones(score.shape, bool), least, np.full(40, np.inf), loose)
    kept = np.zeros(score.shape, bool)
    kept[i, j] = True
    assert kept[score >= least[:, None]].all() and kept.sum() < 0.02 * kept.size
