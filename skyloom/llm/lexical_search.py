"""Ranked lexical search: the best documents for each query text, by a threshold-seeded join.

Terms are maximal runs of letters, digits and code points beyond ASCII, only A-Z lower-cased. A term's impact in a document
is its part of the document's score. For every term of the queries a table keeps how many documents hold it, its weight, its
largest impact and its k-th largest one (0 if fewer than k documents hold it). The largest k-th impact among a query's
terms is a lower bound of the query's k-th best score: k documents hold that term with that impact or more, and no impact is
negative. Sorted by largest impact, the longest suffix of a query's terms whose largest impacts add up to less than the bound
is put aside: a document with no other term of the query can't reach the bound. Documents with one of the terms that stay
are candidates; those whose sum, plus all that the suffix could add, reaches the bound are scored exactly by all terms.

Documents are read once: the forward index of the queries' terms is a table, and counts, impacts and scores are made in
passes over it. A task hands on k rows a query at most, none below the bound, and raises its own bound as it goes. Queries
are taken in blocks of ``BLOCK_BYTES`` of text, so what every task holds of them is bounded whatever their number.

Defined results: every row of documents is one document, repeated rows and null ids included (among equal scores null ids
come last); null texts have no terms and count nowhere. Queries are the distinct pairs of id and text; a query without terms
that any document holds has no rows. Ties in score go by document id. Further columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BATCH_BYTES, discard, materialize, read

#: Bytes of query texts that a pass over the documents takes.
BLOCK_BYTES = 8 << 20
#: Bytes of a text that are cut into terms at once.
PART = 1 << 20
#: Cells of the table of scores by document and query that a task holds.
CELLS = 1 << 21
#: Postings that a task scores at once.
POSTINGS = 1 << 20
NONE = -(1 << 62)  # stands for a null id among the terms of a task

_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(text: str) -> Counter:
    """How often each term occurs in a text, terms as UTF-8."""
    raw, found, at = text.encode("utf-8", "surrogatepass").translate(_TERM), Counter(), 0
    while at < len(raw):
        end = raw.find(b" ", at + PART)
        end = len(raw) if end < 0 else end
        found.update(raw[at:end].split())
        at = end
    return found


def weight(held: int, documents: int) -> int:
    """The weight of a term that ``held`` of all ``documents`` with terms hold."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * held + 1)))


def length_norms(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """``m`` of documents with ``n`` terms each; exact however large the tables are."""
    kinds, at = np.unique(n, return_inverse=True)
    return np.array([100 - 90 + (90 * int(x) * documents) // terms for x in kinds], np.int64)[at]


def impacts(weights: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def _spread(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of ranges laid end to end, and the range that each comes from."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[owner], owner


def _first(k: int, group: np.ndarray, score: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Positions of the first ``k`` of each group, highest score and then lowest document first."""
    order = np.lexsort((doc, -score, group))
    g = group[order]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    place = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))
    return order[place < k]


class Queries:
    """The queries of a block as numpy tables: terms that stay, suffixes, bounds."""

    def __init__(self, item: np.ndarray, term: np.ndarray, weights: np.ndarray, top: np.ndarray, kth: np.ndarray) -> None:
        self.count, self.terms = int(item.max()) + 1, len(weights)
        self.bound = np.zeros(self.count, np.int64)
        np.maximum.at(self.bound, item, kth[term])
        order = np.lexsort((top[term], item))  # within a query the least first, so running sums are suffix sums
        item, term = item[order], term[order]
        begin = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
        run = np.cumsum(top[term])
        run -= np.repeat(np.r_[0, run[begin[1:] - 1]], np.diff(np.r_[begin, len(item)]))
        aside = run < self.bound[item]
        self.suffix = np.zeros(self.count, np.int64)
        np.maximum.at(self.suffix, item[aside], run[aside])
        self.keys = np.sort(item * self.terms + term)
        stay = np.lexsort((item[~aside], term[~aside]))
        self.by_term = item[~aside][stay]
        self.starts = np.searchsorted(term[~aside][stay], np.arange(self.terms + 1))

    def candidates(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, docs: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, query) pairs that may reach ``bound``, from the terms that stay."""
        at, owner = _spread(self.starts[term], self.starts[term + 1] - self.starts[term])
        sums = np.zeros(docs * self.count, np.int64)
        np.add.at(sums, doc[owner] * self.count + self.by_term[at], impact[owner])
        sums = sums.reshape(docs, self.count)
        return np.nonzero((sums > 0) & (sums + self.suffix >= bound))

    def scores(self, doc: np.ndarray, query: np.ndarray, pointers: np.ndarray, term: np.ndarray, impact: np.ndarray) -> np.ndarray:
        """Exact scores of (document, query) pairs, by all terms."""
        out = np.zeros(len(doc), np.int64)
        size = pointers[doc + 1] - pointers[doc]
        cuts = np.r_[0, np.flatnonzero(np.diff(np.cumsum(size) // POSTINGS)) + 1, len(doc)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            at, owner = _spread(pointers[doc[a:b]], size[a:b])
            key = query[a:b][owner] * self.terms + term[at]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            np.add.at(out, a + owner, np.where(self.keys[place] == key, impact[at], 0))
        return out


def _index(documents: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, terms, tf`` of documents with terms: the forward index of the vocabulary."""
    spark = documents.sparkSession
    known = spark.sparkContext.broadcast(vocabulary)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value
        for batch in batches:
            ids, n, terms, tf, ends = [], [], [], [], [0]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                counts = term_counts(text)
                if not counts:
                    continue
                held = sorted((table[t], c) for t, c in counts.items() if t in table)
                ids.append(doc_id)
                n.append(counts.total())
                terms += [t for t, _ in held]
                tf += [c for _, c in held]
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tf, pa.int64()))], ["doc_id", "n", "terms", "tf"]
            )

    texts = documents.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<long>")


def _parts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, n, pointers, terms, tf) of up to ``most`` documents of the index at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            part = batch.slice(at, most)
            lists = part.column("terms")
            pointers = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())].astype(np.int64)
            ids = part.column("doc_id").fill_null(NONE).to_numpy()
            yield ids, part.column("n").to_numpy(), pointers, lists.flatten().to_numpy().astype(np.int64), part.column("tf").flatten().to_numpy()


def _held(index: DataFrame, terms: int) -> DataFrame:
    """``term, held``: how many documents hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(terms, np.int64)
        for batch in batches:
            held += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=terms)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(held[some])], ["term", "held"])

    return index.select("terms").mapInArrow(run, "term int, held long").groupBy("term").agg(F.sum("held").alias("held"))


def _kth(index: DataFrame, weights, documents: int, total: int, k: int) -> DataFrame:
    """``term, top, kth``: the largest impact of each term and its k-th largest one, 0 if fewer documents hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        term, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for _, n, pointers, t, tf in _parts(batches, 4096):
            m = np.repeat(length_norms(n, documents, total), np.diff(pointers))
            term, best = np.r_[term, t], np.r_[best, impacts(w[t], tf, m)]
            keep = _first(k, term, best, best)
            term, best = term[keep], best[keep]
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int32()), pa.array(best)], ["term", "impact"])

    found = index.select("doc_id", "n", "terms", "tf").mapInArrow(run, "term int, impact long")
    rank = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact")))
    found = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return found.groupBy("term").agg(F.max("impact").alias("top"), F.coalesce(F.max(F.when(F.col("rank") == k, F.col("impact"))), F.lit(0)).alias("kth"))


def _best(index: DataFrame, queries, weights, documents: int, total: int, k: int) -> DataFrame:
    """``query, doc_id, score``: all that can be among the first ``k``, ``k`` a query and task at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, w = queries.value, weights.value
        bound = q.bound.copy()
        query, doc, score = (np.zeros(0, np.int64) for _ in range(3))
        for ids, n, pointers, t, tf in _parts(batches, max(1, min(4096, CELLS // q.count))):
            size = np.diff(pointers)
            impact = impacts(w[t], tf, np.repeat(length_norms(n, documents, total), size))
            rows, items = q.candidates(np.repeat(np.arange(len(ids)), size), t, impact, len(ids), bound)
            exact = q.scores(rows, items, pointers, t, impact)
            good = exact >= np.maximum(bound[items], 1)
            # null ids come last among equal scores
            query, doc, score = np.r_[query, items[good]], np.r_[doc, ids[rows[good]]], np.r_[score, exact[good]]
            keep = _first(k, query, score, np.where(doc == NONE, np.iinfo(np.int64).max, doc))
            query, doc, score = query[keep], doc[keep], score[keep]
            full = np.flatnonzero(np.bincount(query, minlength=q.count) == k)
            least = np.full(q.count, np.iinfo(np.int64).max)
            np.minimum.at(least, query, score)
            bound[full] = np.maximum(bound[full], least[full])
        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(doc, mask=doc == NONE), pa.array(score)], ["query", "doc_id", "score"])

    return index.select("doc_id", "n", "terms", "tf").mapInArrow(run, "query int, doc_id long, score long")


def _search_block(documents: DataFrame, items: list, k: int) -> DataFrame | None:
    """The rows of a block of queries, a table of its own."""
    spark = documents.sparkSession
    terms = [sorted(term_counts(row["text"])) for row in items]
    vocabulary = {t: i for i, t in enumerate(sorted({t for own in terms for t in own}))}
    if not vocabulary:
        return None
    index = materialize(_index(documents, vocabulary), "search-index")
    seen = index.agg(F.count("*").alias("documents"), F.sum("n").alias("terms")).first()
    if not seen["documents"]:
        discard(index)
        return None
    weights = np.zeros(len(vocabulary), np.int64)
    for row in _held(index, len(vocabulary)).collect():  # a row a term of the block
        weights[row["term"]] = weight(row["held"], seen["documents"])
    weights_sent = spark.sparkContext.broadcast(weights)
    top, kth = np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary), np.int64)
    for row in _kth(index, weights_sent, seen["documents"], seen["terms"], k).collect():
        top[row["term"]], kth[row["term"]] = row["top"], row["kth"]
    item = np.repeat(np.arange(len(items)), [len(own) for own in terms])
    queries = Queries(item, np.array([vocabulary[t] for own in terms for t in own]), weights, top, kth)
    found = _best(index, spark.sparkContext.broadcast(queries), weights_sent, seen["documents"], seen["terms"], k)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    ranked = materialize(found.withColumn("rank", rank).where(F.col("rank") <= k), "search-ranked")
    discard(index)
    names = spark.createDataFrame([(i, row["item_id"]) for i, row in enumerate(items)], "query int, item_id long")
    return ranked.join(names, "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(documents: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each of ``queries(item_id, text)``."""
    spark = documents.sparkSession
    texts = queries.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    texts = materialize(texts, "search-queries")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    found = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in range(blocks):
        items = texts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # BLOCK_BYTES or so
        part = _search_block(documents, items, k) if items else None
        found = found if part is None else found.unionByName(part)
    discard(texts)
    return found


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents WHERE text IS NOT NULL
), docs AS (
  SELECT k, doc_id, len(t) AS n, t FROM words WHERE len(t) > 0
), whole AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM docs
), tf AS (
  SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(t) AS term FROM docs) GROUP BY k, term
), wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE text IS NOT NULL
), weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY term, docs
), scores AS (
  SELECT item_id, doc_id, k, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))))::BIGINT AS score
  FROM wanted JOIN tf USING (term) JOIN weights USING (term) JOIN docs USING (k), whole GROUP BY item_id, doc_id, k
), ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
