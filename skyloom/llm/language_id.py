"""Language identification by prediction with partial matching.

Each language has a byte context tree of orders 0 to 3 with escape probabilities (escape method C with exclusion,
frozen after training). The score of a text is its exact code length in bits under each language; the shortest wins.

Every byte that a training sample holds is a symbol of its own; all others share one, at the cost of telling them apart.
The frozen trees are compiled into tables: one from the last three bytes to the row of the longest context that any tree
knows, and one from row and next byte to the cost in every language. Only pairs that were seen are held; any other byte
escapes to the row of the shorter context at a cost that its row holds. Scoring is two look-ups a byte and an escape here
and there.

Defined results: a null text, an empty one and one without any letter get ``und`` and score 0; so does every text if
there is nothing to learn from. Equal code lengths go to the language that sorts first. Repeated rows stay. Rows with a
null ``doc_id`` or ``lang`` are predicted but never learned from. Further columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_slot, held_out, learnable, map_batches, materialize, read, sample_fraction

ORDER = 3
#: Code lengths are summed over slices of so many bytes, so memory does not grow with a text.
SLICE = 1 << 19


@dataclass(frozen=True)
class PpmParams:
    """``docs_per_language`` bounds the training sample: about that many documents of each language, chosen by a hash of the
    id, each learned from whole. A context that all samples together hold fewer than ``min_context`` times is no context of
    the trees: the shorter one stands for it."""

    docs_per_language: int = 400
    min_context: int = 6


#: Cells of the direct index of (context, symbol) pairs; larger trees are searched instead, with the same result.
INDEX_CELLS = 1 << 24


@dataclass
class PpmModel:
    """One tree a language over common contexts, as rows: row 0 is the empty context with every symbol. A row lists the symbols
    seen in its context, with their costs in each language; any other symbol costs the row's ``offset`` more than in the
    row ``below``, the longest context that is a suffix of it. Only what was seen takes memory."""

    languages: list[str]
    codes: np.ndarray  # byte -> symbol; 0 is any byte that no sample holds
    rows: np.ndarray  # symbol**3 -> row of the longest known context
    alphabet: int
    starts: np.ndarray  # of each row's pairs, and the end
    symbols: np.ndarray  # of the pairs, rising within a row
    bits: np.ndarray  # (pair, language) -> cost
    offset: np.ndarray  # (row, language)
    below: np.ndarray

    def __post_init__(self) -> None:
        self.index = None
        count = len(self.starts) - 1
        if count * self.alphabet <= INDEX_CELLS:
            self.index = np.full(count * self.alphabet, -1, np.int32)
            self.index[np.repeat(np.arange(count), np.diff(self.starts)) * self.alphabet + self.symbols] = np.arange(len(self.symbols))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "index"}  # made anew where it is used

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def find(self, row: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The pair of each row and symbol, -1 if the row does not list it."""
        if self.index is not None:
            return self.index[row * self.alphabet + symbol]
        low, high, end = self.starts[row], self.starts[row + 1], self.starts[row + 1]
        for _ in range(int(self.alphabet).bit_length()):
            open_ = low < high
            middle = (low + high) >> 1
            less = open_ & (self.symbols[np.minimum(middle, len(self.symbols) - 1)] < symbol)
            low, high = np.where(less, middle + 1, low), np.where(open_ & ~less, middle, high)
        held = (low < end) & (self.symbols[np.minimum(low, len(self.symbols) - 1)] == symbol)
        return np.where(held, low, -1)

    def costs(self, row: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Bits of symbols in contexts, in each language."""
        at = self.find(row, symbol)
        out = self.bits[at]
        todo = np.flatnonzero(at < 0)
        out[todo] = 0
        row, symbol = row[todo], symbol[todo]
        while len(todo):
            out[todo] += self.offset[row]
            row = self.below[row]
            at = self.find(row, symbol)
            hit = at >= 0
            out[todo[hit]] += self.bits[at[hit]]
            todo, row, symbol = todo[~hit], row[~hit], symbol[~hit]
        return out


def _blend(counts: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Probabilities of the symbols in contexts with ``counts``, escaping to ``parent`` with exclusion of those seen."""
    total, seen = counts.sum(-1, keepdims=True), counts > 0
    distinct = seen.sum(-1, keepdims=True)
    left = 1.0 - (parent * seen).sum(-1, keepdims=True)
    escapes = (left > 1e-12) & (distinct < counts.shape[-1])
    down = total + np.where(escapes, distinct, 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        p = np.where(seen, counts / down, np.where(escapes, distinct / down * parent / left, 0.0))
    return np.where(total > 0, np.maximum(p, 1e-12), parent)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct four-byte windows that end within each text (three zero bytes stand before it), and their counts."""
    found: dict[int, int] = {}
    whole, ends = b"".join(b"\0" * ORDER + t for t in texts), np.cumsum([len(t) + ORDER for t in texts])
    x = np.frombuffer(whole, np.uint8)
    own = np.ones(len(x), bool)
    starts = np.concatenate([[0], ends[:-1]]) if len(texts) else np.zeros(0, np.int64)
    for k in range(ORDER):
        own[starts + k] = False
    for at in range(ORDER, len(x), SLICE):  # windows are counted slice by slice, so memory does not grow with a text
        part = x[at - ORDER : at + SLICE].astype(np.uint32)
        gram = (part[:-3] << 24) | (part[1:-2] << 16) | (part[2:-1] << 8) | part[3:]
        for g, n in zip(*(v.tolist() for v in np.unique(gram[own[at : at + SLICE]], return_counts=True))):
            found[g] = found.get(g, 0) + n
    return np.array(list(found), np.int64), np.array(list(found.values()), np.int64)


def compile_trees(names: list[str], order: np.ndarray, language: np.ndarray, gram: np.ndarray, n: np.ndarray, params: PpmParams = PpmParams()) -> PpmModel:
    """Freeze one tree a language from counts of (context, byte) by order, and compile them. ``gram`` is the context's bytes
    and the byte after it, as one number."""
    seen = np.union1d(gram[order == 0], [0])  # zero bytes stand before a text
    a, many = len(seen) + 1, len(names)
    codes = np.zeros(256, np.int32)
    codes[seen] = np.arange(1, a)
    counts = np.zeros((many, a))
    root = order == 0
    counts[language[root], codes[gram[root] & 255]] = n[root]
    top = _blend(counts, np.full((many, a), 1.0 / a))
    top[:, 0] /= max(1, 256 - len(seen))  # symbol 0 says that a byte is new; which one it is costs as much in every language
    longest = np.zeros(1, np.int32)  # of each context of the order below, the row it is found at
    model = PpmModel(names, codes, longest, a, np.array([0, a]), np.arange(a, dtype=np.int16), -np.log2(top.T).astype(np.float32), np.zeros((1, many), np.float32), np.zeros(1, np.int32))
    for k in range(1, ORDER + 1):
        of = order == k
        contexts, back = np.unique(gram[of] >> 8, return_inverse=True)
        kept = contexts[np.bincount(back, n[of], len(contexts)) >= params.min_context] if len(contexts) else contexts
        coded = sum((codes[kept >> (8 * i) & 255].astype(np.int64) * a**i for i in range(k)), np.zeros(len(kept), np.int64))
        below = np.tile(longest, a)  # the context of one byte less is the suffix
        parents = below[coded]
        held = of & np.isin(gram >> 8, kept)
        pairs, at = np.unique(gram[held], return_inverse=True)  # by context, then by byte
        context = np.searchsorted(kept, pairs >> 8)
        starts = np.searchsorted(context, np.arange(len(kept) + 1))
        symbol = codes[pairs & 255]
        parts = [_frozen(model, parents, context, symbol, starts, i, at, language[held], n[held]) for i in _spans(starts, many)]
        first, size = len(model.below), len(model.symbols)
        below[coded] = first + np.arange(len(kept))
        longest = below.astype(np.int32)
        # Codes rise with bytes, so the symbols of a row rise too.
        model = PpmModel(
            names, codes, longest, a, np.concatenate([model.starts, size + starts[1:]]), np.concatenate([model.symbols, symbol.astype(np.int16)]), np.concatenate([model.bits, *[p[0] for p in parts]]),
            np.concatenate([model.offset, *[p[1] for p in parts]]), np.concatenate([model.below, parents.astype(np.int32)]),
        )
    return model


def _spans(starts: np.ndarray, many: int) -> Iterator[slice]:
    """Runs of contexts whose pairs are worked on together."""
    low = 0
    while low < len(starts) - 1:
        high = max(low + 1, int(np.searchsorted(starts, starts[low] + (1 << 20) // many, "right")) - 1)
        yield slice(low, high)
        low = high


def _frozen(model: PpmModel, parents: np.ndarray, context: np.ndarray, symbol: np.ndarray, starts: np.ndarray, own: slice, at: np.ndarray, language: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs of the pairs and offsets of a run of contexts, over the model of the lower orders."""
    low, high = starts[own.start], starts[own.stop]
    counts = np.zeros((high - low, len(model.languages)))
    mine = (at >= low) & (at < high)
    counts[at[mine] - low, language[mine]] = n[mine]
    whose = context[low:high]
    parent = np.exp2(-model.costs(parents[whose], symbol[low:high]).astype(float))
    begin, seen = starts[own] - low, counts > 0
    total, distinct = np.add.reduceat(counts, begin, axis=0), np.add.reduceat(seen.astype(float), begin, axis=0)
    left = 1.0 - np.add.reduceat(parent * seen, begin, axis=0)
    escapes = left > 1e-12
    down = total + np.where(escapes, distinct, 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        share = np.where(escapes, distinct / down / left, 0.0)  # of a symbol's probability in the shorter context
        row = whose - own.start
        p = np.where(seen, counts / down[row], share[row] * parent)
        p = np.where(total[row] > 0, np.maximum(p, 1e-12), parent)
        offset = np.where(total > 0, -np.log2(np.maximum(share, 1e-12)), 0.0)
    return -np.log2(p).astype(np.float32), offset.astype(np.float32)


def code_lengths(model: PpmModel, texts: list[bytes]) -> np.ndarray:
    """Bits of each text under each language."""
    out = np.zeros((len(texts), len(model.languages)))
    a, group, size = model.alphabet, [], 0

    def flush() -> None:
        """The texts of ``group`` with their contexts before them, as one array."""
        x = model.codes[np.frombuffer(b"".join(t for _, t in group) + b"\0\0\0\0", np.uint8)]
        at = model.rows[(x[:-3] * a + x[1:-2]) * a + x[2:-1]]
        cost = model.costs(at[:-1], x[3:-1])
        ends = np.cumsum([len(t) for _, t in group])
        bounds = np.stack([ends - [len(t) for _, t in group], ends - ORDER], 1).ravel()
        sums = np.add.reduceat(np.concatenate([cost, np.zeros((ORDER + 1, cost.shape[1]), np.float32)]), bounds, axis=0, dtype=np.float64)[::2]
        np.add.at(out, [k for k, _ in group], sums)
        group.clear()

    for k, text in enumerate(texts):
        for begin in range(0, len(text), SLICE):
            before = text[max(0, begin - ORDER) : begin].rjust(ORDER, b"\0")
            group.append((k, before + text[begin : begin + SLICE]))
            size += len(group[-1][1])
            if size >= SLICE:
                flush()
                size = 0
    if group:
        flush()
    return out


def fit(documents: DataFrame, params: PpmParams = PpmParams()) -> PpmModel | None:
    """Learn from a bounded sample of the documents that are not held out. Windows are counted in Spark; the driver gets the
    counts of contexts frequent enough, whose number does not follow the input, and no text."""
    usable = documents.where(learnable(F.col("doc_id")) & F.col("lang").isNotNull() & (F.octet_length("text") > 0))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not counts:
        return None
    slots = F.create_map(*[F.lit(x) for name, n in counts.items() for x in (name, sample_fraction(n, params.docs_per_language))])
    chosen = usable.where(hash_slot(F.col("doc_id")) < slots[F.col("lang")]).select("lang", "text")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            texts.setdefault(lang, []).append(text.as_buffer().to_pybytes())
        found = [(lang, *grams(t)) for lang, t in texts.items()]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.array([f[0] for f in found], object), [len(f[1]) for f in found]), pa.string()), pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found]))], ["lang", "gram", "n"]
        )

    found = map_batches(chosen, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("gram").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("gram")) for k in range(ORDER + 1)])).alias("o")
    found = found.select("lang", "n", each).groupBy("lang", "o.k", "o.gram").agg(F.sum("n").alias("n"))
    found = materialize(found, "language-grams").withColumn("context", F.shiftright("gram", 8))
    frequent = found.groupBy("k", "context").agg(F.sum("n").alias("total")).where((F.col("total") >= params.min_context) | (F.col("k") == 0)).select("k", "context")
    number = {name: i for i, name in enumerate(sorted(counts))}
    of = F.create_map(*[F.lit(x) for pair in number.items() for x in pair])[F.col("lang")]
    table = found.join(frequent, ["k", "context"], "left_semi").select(of.cast("short").alias("lang"), F.col("k").cast("byte").alias("k"), "gram", "n").toArrow()
    if not table.num_rows:
        return None
    present, language = np.unique(table["lang"].to_numpy(), return_inverse=True)
    return compile_trees([sorted(counts)[i] for i in present], table["k"].to_numpy(), language, table["gram"].to_numpy(), table["n"].to_numpy(), params)


def identify(documents: DataFrame, model: PpmModel | None, keep: list[str] | None = None) -> DataFrame:
    """``lang_pred`` and ``score`` (the winner's posterior under equal priors) for every row, beside the columns ``keep``."""
    keep = ["doc_id"] if keep is None else keep
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    frame = documents.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col("text").alias("text"), letter.alias("letter"))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    types = dict(documents.dtypes)
    schema = ", ".join(f"k{i} {types[c]}" for i, c in enumerate(keep)) + ", lang_pred string, score double"

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, n = shared.value, batch.num_rows
        names, scores = ["und"] * n, np.zeros(n)
        at = [i for i, x in enumerate(batch.column("letter").to_pylist()) if x] if model else []
        if at:
            texts = batch.column("text")
            bits = code_lengths(model, [texts[i].as_buffer().to_pybytes() for i in at])
            best = bits.argmin(1)
            scores[at] = 1.0 / np.exp2(bits[np.arange(len(at)), best][:, None] - bits).sum(1)
            for i, k in zip(at, best):
                names[i] = model.languages[k]
        kept = [batch.column(f"k{i}") for i in range(len(keep))]
        return pa.RecordBatch.from_arrays([*kept, pa.array(names), pa.array(scores)], [*[f"k{i}" for i in range(len(keep))], "lang_pred", "score"])

    return map_batches(frame, score, schema).withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    found = identify(documents, fit(documents))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
