"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad; its potentials see features of the line and of its two neighbours, and transitions tie the
labels of neighbouring lines. A document's score is the mean of the lines' forward-backward marginals of "good",
weighted by line length. The field is trained by gradient ascent on the exact log-likelihood; documents are labelled and
lines are not, so after a start from the documents' labels line labels are latent, under the documents' as constraints.

Defined results: a null or empty text is one empty line; without any label to learn from every score is 0.5. Repeated
rows stay, null ids are scored and never learned from, further columns are not read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_slot, held_out, learnable, map_batches, read, sample_fraction, texts_of

#: Upper ends of the bins of each feature; a line's feature becomes one indicator per bin.
BINS = {
    "letters": (0.3, 0.6, 0.75, 0.82, 0.9),
    "upper": (0.02, 0.06, 0.12, 0.3, 0.7),
    "digits": (0.001, 0.02, 0.06, 0.2),
    "marks": (0.001, 0.01, 0.04, 0.1),
    "stops": (0.005, 0.015, 0.03, 0.08, 0.15),
    "words": (1.0, 3.0, 6.0, 12.0, 40.0),
    "length": (2.5, 3.5, 4.5, 5.5, 7.0, 9.0),
    "distinct": (0.1, 0.3, 0.5, 0.7, 0.85, 0.95),
    "repeated": (0.5,),
}
N_BINS = sum(len(b) + 1 for b in BINS.values())
N_FEATURES = 3 * N_BINS + 3  # own line, the line before, the line after; two chain ends and a bias

_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 letter, 2 capital, 3 digit, 4 mark, 5 stop, 6 blank
_CLASS[[*range(97, 123), *range(0xC3, 0xF5)]] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[ord(c) for c in "#*$%&|<>{}[]\\^~=_@/+"]] = 4
_CLASS[[ord(c) for c in "!?.,;:"]] = 5
_CLASS[[32, *range(9, 14)]] = 6
_GAP = re.compile(rb"[^\x20\x09-\x0D]+")


@dataclass(frozen=True)
class CrfParams:
    """``train_docs`` bounds the labelled documents learned from (about that many, chosen by a hash of the id), each whole;
    every document is scored whole. Chains of more than ``chain_lines`` lines are learned from in slices. In the
    ``latent`` rounds a good document is asked for a mean of ``sure`` good lines, and a bad one for as many bad ones."""

    train_docs: int = 3000
    chain_lines: int = 256
    rounds: int = 90
    latent: int = 60
    sure: float = 0.9
    rate: float = 0.5
    ridge: float = 1e-3


@dataclass
class CrfModel:
    weights: np.ndarray  # of "good" against "bad", by feature
    moves: np.ndarray  # (from, to) transition scores; 0 bad, 1 good
    prior: float


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """For each line the indices of its active indicators (lines, features), and its length in bytes."""
    lines = text.encode("utf-8", "replace").split(b"\n")
    raw = np.zeros((len(lines), len(BINS)))
    sizes = np.array([len(x) for x in lines], np.int64)
    flat = _CLASS[np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)]
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    kinds = np.stack([np.add.reduceat(flat == k, starts, dtype=np.int64) for k in range(1, 6)], 1)
    held = np.maximum(sizes, 1)
    raw[:, 0] = (kinds[:, 0] + kinds[:, 1]) / held
    raw[:, 1:5] = kinds[:, 1:5] / held[:, None]
    earlier: set[bytes] = set()
    for i, line in enumerate(lines):
        words = _GAP.findall(line)
        if words:
            raw[i, 5:] = len(words), (sizes[i] - len(words) + 1) / len(words), len(set(words)) / len(words), line in earlier
            earlier.add(line)
    out, base = np.empty((len(lines), len(BINS)), np.int32), 0
    for k, bins in enumerate(BINS.values()):
        out[:, k] = base + np.searchsorted(bins, raw[:, k], side="right" if len(bins) == 1 else "left")
        base += len(bins) + 1
    return out, sizes


def emissions(weights: np.ndarray, active: np.ndarray) -> np.ndarray:
    """The score of "good" against "bad" of each line, from itself and its neighbours."""
    own = weights[:N_BINS][active].sum(1)
    before, after = weights[N_BINS : 2 * N_BINS][active].sum(1), weights[2 * N_BINS : 3 * N_BINS][active].sum(1)
    out = own + weights[-1]
    out[1:] += before[:-1]
    out[:-1] += after[1:]
    out[0] += weights[-3]
    out[-1] += weights[-2]
    return out


def _pass(scores: np.ndarray, mask: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Log messages into every line of chains (chains, lines) from its left, including the line's own score."""
    n, m = scores.shape
    out = np.zeros((n, m, 2))
    out[:, 0, 1] = scores[:, 0]
    for t in range(1, m):
        step = out[:, t - 1]
        to = np.stack([np.logaddexp(step[:, 0] + moves[0, k], step[:, 1] + moves[1, k]) for k in (0, 1)], 1)
        to[:, 1] += scores[:, t]
        out[:, t] = np.where(mask[:, t, None], to, step)
    return out


def marginals(scores: np.ndarray, mask: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good) of each line, the summed pair probabilities (from, to), and log Z of each chain."""
    ahead = _pass(scores, mask, moves)
    z = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
    back = np.zeros_like(ahead)
    for t in range(scores.shape[1] - 2, -1, -1):
        nxt = back[:, t + 1].copy()
        nxt[:, 1] += scores[:, t + 1]
        to = np.stack([np.logaddexp(moves[k, 0] + nxt[:, 0], moves[k, 1] + nxt[:, 1]) for k in (0, 1)], 1)
        back[:, t] = np.where(mask[:, t + 1, None], to, 0.0)
    good = np.exp(ahead[:, :, 1] + back[:, :, 1] - z[:, None]) * mask
    pairs = np.zeros((2, 2))
    inner = mask[:, 1:]
    for i in (0, 1):
        for k in (0, 1):
            s = ahead[:, :-1, i] + moves[i, k] + back[:, 1:, k] + (scores[:, 1:] if k else 0.0) - z[:, None]
            pairs[i, k] = np.exp(s[inner]).sum()
    return good, pairs, z


def chain_marginals(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """P(good) of every line of one chain of any length: the messages are scalars (log odds), in two sweeps."""
    n = len(scores)
    m00, m01, m10, m11 = moves.ravel()

    def sweep(values: list[float], a: float, b: float, c: float, d: float) -> np.ndarray:
        """Log odds arriving at each line from one side; a..d are the scores of staying bad, bad to good, and so on."""
        out, arriving = np.empty(len(values)), 0.0
        for t, x in enumerate(values):
            out[t] = arriving
            odds = arriving + x
            top = max(b, d + odds)
            low = max(a, c + odds)
            up = top + math.log1p(math.exp(-abs(b - d - odds)))
            arriving = up - low - math.log1p(math.exp(-abs(a - c - odds)))
        return out

    values = scores.tolist()
    left = sweep(values, m00, m01, m10, m11)
    right = sweep(values[::-1], m00, m10, m01, m11)[::-1]
    return 1.0 / (1.0 + np.exp(-np.clip(left + scores + right, -500, 500))) if n else np.zeros(0)


class _Lines:
    """The lines of all training documents, and the chains that they are cut into."""

    def __init__(self, documents: list[tuple[np.ndarray, np.ndarray]], most: int) -> None:
        counts = np.array([len(active) for active, _ in documents])
        self.flat = np.concatenate([active for active, _ in documents]).astype(np.int64)
        self.size = np.maximum(np.concatenate([sizes for _, sizes in documents]), 1).astype(float)
        self.doc = np.repeat(np.arange(len(documents)), counts)
        self.ends = np.cumsum(counts) - 1
        self.starts = self.ends - counts + 1
        self.later, self.earlier = np.ones(len(self.flat), bool), np.ones(len(self.flat), bool)
        self.later[self.starts], self.earlier[self.ends] = False, False  # has a line before it; has one after it
        cuts = [(a, min(a + most, b + 1)) for start, b in zip(self.starts, self.ends) for a in range(start, b + 1, most)]
        cuts.sort(key=lambda c: c[1] - c[0])
        self.groups: list[tuple[np.ndarray, np.ndarray]] = []  # (lines, mask) of chains of like length
        while cuts:
            width = cuts[-1][1] - cuts[-1][0]
            part, cuts = cuts[-max(1, (1 << 16) // width) :], cuts[: -max(1, (1 << 16) // width)]
            mask = np.arange(width)[None, :] < np.array([b - a for a, b in part])[:, None]
            self.groups.append((np.concatenate([np.arange(a, b) for a, b in part]), mask))

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """As ``emissions`` of every document."""
        own = weights[:N_BINS][self.flat].sum(1) + weights[-1]
        ahead, behind = weights[N_BINS : 2 * N_BINS][self.flat].sum(1), weights[2 * N_BINS : 3 * N_BINS][self.flat].sum(1)
        own[self.later] += ahead[np.flatnonzero(self.later) - 1]
        own[self.earlier] += behind[np.flatnonzero(self.earlier) + 1]
        own[self.starts] += weights[-3]
        own[self.ends] += weights[-2]
        return own

    def marginals(self, scores: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of every line, and the summed pair probabilities."""
        out, turn = np.empty(len(scores)), np.zeros((2, 2))
        for lines, mask in self.groups:
            padded = np.zeros(mask.shape)
            padded[mask] = scores[lines]
            good, pairs, _ = marginals(padded, mask, moves)
            out[lines] = good[mask]
            turn += pairs
        return out, turn

    def labelled_pairs(self, y: np.ndarray) -> np.ndarray:
        """Pairs of neighbouring lines whose labels are those of their documents."""
        out = np.zeros((2, 2))
        for lines, mask in self.groups:
            firsts = lines[np.concatenate([[0], np.cumsum(mask.sum(1))[:-1]])]
            for label in (0, 1):
                out[label, label] += (mask.sum(1) - 1)[y[self.doc[firsts]] == label].sum()
        return out

    def shift(self, good: np.ndarray, y: np.ndarray, sure: float) -> np.ndarray:
        """By how much the lines of each document must become better or worse for the document's label to hold: until their
        mean, weighted by length, is ``sure`` on the label's side. 0 where it is."""
        odds = np.log(np.clip(good, 1e-9, 1 - 1e-9)) - np.log(np.clip(1 - good, 1e-9, 1))
        weight = np.bincount(self.doc, self.size)
        mean = lambda b: np.bincount(self.doc, self.size / (1 + np.exp(-np.clip(odds + b[self.doc], -500, 500)))) / weight
        want = np.where(y == 1, sure, 1 - sure)
        low, high = np.full(len(y), -40.0), np.full(len(y), 40.0)
        for _ in range(30):
            middle = (low + high) / 2
            above = mean(middle) > want
            low, high = np.where(above, low, middle), np.where(above, middle, high)
        found = (low + high) / 2
        return np.where(y == 1, np.maximum(found, 0.0), np.minimum(found, 0.0))


def train(texts: list[str], labels: list[int], params: CrfParams = CrfParams()) -> CrfModel:
    return train_lines([line_features(t) for t in texts], labels, params)


def train_lines(documents: list[tuple[np.ndarray, np.ndarray]], labels: list[int], params: CrfParams = CrfParams()) -> CrfModel:
    """Gradient ascent (Adam) on the regularised log-likelihood. At first every line carries the label of its document. Then
    line labels are latent: each round takes the field's own marginals, moved only as far as the document's label asks,
    as what is wanted, so that lines of both kinds can stand in one document and transitions learn when labels change."""
    y, lines = np.array(labels), _Lines(documents, params.chain_lines)
    count = len(lines.flat)
    weights, moves = np.zeros(N_FEATURES), np.zeros((2, 2))
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros((2, 2)), np.zeros((2, 2))]
    whole, whole_pairs = y[lines.doc].astype(float), lines.labelled_pairs(y)
    later, earlier = np.flatnonzero(lines.later), np.flatnonzero(lines.earlier)
    for step in range(1, params.rounds + params.latent + 1):
        scores = lines.scores(weights)
        good, pairs = lines.marginals(scores, moves)
        want, wanted = whole, whole_pairs
        if step > params.rounds:
            want, wanted = lines.marginals(scores + lines.shift(good, y, params.sure)[lines.doc], moves)
        gap, grad = want - good, np.zeros_like(weights)
        for k in range(lines.flat.shape[1]):
            at = lines.flat[:, k]
            grad[:N_BINS] += np.bincount(at, gap, N_BINS)
            grad[N_BINS : 2 * N_BINS] += np.bincount(at[later - 1], gap[later], N_BINS)
            grad[2 * N_BINS : 3 * N_BINS] += np.bincount(at[earlier + 1], gap[earlier], N_BINS)
        grad[-1], grad[-3], grad[-2] = gap.sum(), gap[lines.starts].sum(), gap[lines.ends].sum()
        grad, turn = grad / count - params.ridge * weights, (wanted - pairs) / count - params.ridge * moves
        for k, (value, g) in enumerate(((weights, grad), (moves, turn))):
            m, v = state[2 * k], state[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            value += params.rate * 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return CrfModel(weights, moves, float(y.mean()))


def line_marginals(model: CrfModel, text: str) -> np.ndarray:
    """P(good) of each line of a text."""
    return chain_marginals(emissions(model.weights, line_features(text)[0]), model.moves)


def score_text(model: CrfModel | None, text: str) -> float:
    """Length-weighted mean of the lines' marginals; an empty line weighs as one byte."""
    if model is None:
        return 0.5
    active, sizes = line_features(text)
    good = chain_marginals(emissions(model.weights, active), model.moves)
    return float(np.clip(np.average(good, weights=np.maximum(sizes, 1)), 0.0, 1.0))


def fit(documents: DataFrame, labels: DataFrame, params: CrfParams = CrfParams()) -> CrfModel | None:
    """Learn from a bounded sample of the labelled documents that are not held out."""
    marked = labels.where(F.col("quality").isin(0, 1) & learnable(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    total = marked.count()
    if not total:
        return None
    slots = sample_fraction(total, params.train_docs)
    chosen = documents.select("doc_id", "text").where(F.col("text").isNotNull() & learnable(F.col("doc_id")) & (hash_slot(F.col("doc_id"), 10) < slots))

    def lines(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [line_features(t) for t in texts_of(batch)]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([x.astype(np.uint8).tobytes() for x, _ in found], pa.binary()), pa.array([n.astype("<u4").tobytes() for _, n in found], pa.binary())], ["doc_id", "active", "sizes"]
        )

    seen = map_batches(chosen, lines, f"doc_id {dict(documents.dtypes)['doc_id']}, active binary, sizes binary")  # a few bytes a line; no text leaves its task
    rows = sorted((r["doc_id"], bytes(r["active"]), bytes(r["sizes"]), r["quality"]) for r in seen.join(marked.where(hash_slot(F.col("doc_id"), 10) < slots), "doc_id").collect())
    if not rows:
        return None
    examples = [(np.frombuffer(r[1], np.uint8).reshape(-1, len(BINS)), np.frombuffer(r[2], "<u4")) for r in rows]
    return train_lines(examples, [r[3] for r in rows], params)


def score(documents: DataFrame, model: CrfModel | None, keep: list[str] | None = None) -> DataFrame:
    """``score`` and ``predicted`` of every row, beside the columns ``keep``."""
    keep = ["doc_id"] if keep is None else keep
    types = dict(documents.dtypes)
    frame = documents.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col("text").alias("text"))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"k{i} {types[c]}" for i, c in enumerate(keep)) + ", score double, predicted int"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = np.array([score_text(shared.value, t) for t in texts_of(batch)])
        kept = [batch.column(f"k{i}") for i in range(len(keep))]
        return pa.RecordBatch.from_arrays([*kept, pa.array(scores), pa.array((scores >= 0.3).astype(np.int32))], [*[f"k{i}" for i in range(len(keep))], "score", "predicted"])

    return map_batches(frame, run, schema).withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    found = score(documents, fit(documents, read(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
