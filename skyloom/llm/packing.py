"""Mixture-controlled packing of documents into fixed-length training sequences.

Each source is a queue of tokens. Windows of ``window`` tokens are filled by deficit round-robin: a window gives every
queue its target share of tokens, what a queue could not spend (a share is rarely a whole number) is carried as its
deficit to the next window, and an empty queue's share goes to the others in proportion. So after ``k`` windows queue
``s`` has sent ``E_s(k) = floor(min(T_s, p_s t_k))`` tokens, where the ``t_k`` solve ``sum_s min(T_s, p_s t_k) = k W``.
That closed form is the carried deficit of every queue at every window, so each task finds the windows of its own
documents from their offsets in their queue alone: deficits pass over windows and partitions without a serial pass.

Tokens lie without a gap, so only the last sequence is padded. Documents are tokenised once; ids wait as 16-bit numbers
in a table while the offsets are summed.

Defined results: a null or empty text is its closing id alone; a null source is a queue of its own; rows with equal or
null ``doc_id`` are packed each for itself; no rows give no pieces. Further columns are not read.

The driver keeps a queue for each of the ``max_queues - 1`` largest sources. All others share one queue, which sends what
they send together by the closed form, each by its own share; its times are those of the distinct (total, weight), of which
there are few (distinct totals add up). Within it, documents are parted into packets of a sequence at most, and packets go
by virtual time: packet ``[a, b)`` of source ``s`` at ``(a + f (b - a)) / p_s``, where ``f`` in [0, 1) is a hash of the
source, so many small sources do not all send at once. A source is at most a packet from its share, whatever their number.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, materialize, read, texts_of

#: Letters, numbers and white space among the first 256 code points; texts within them take the fast way.
LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
BLANK = "\x09-\x0d\x20\x85\xa0"
#: The tokenizer's own way of splitting (a fixed value), for these code points.
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{BLANK}{LETTER}{NUMBER}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")
#: A place where pieces always part, so that very long texts are split in bounded memory.
JOINT = re.compile(f"(?<=[^{BLANK}]) (?=[^{BLANK}])")
LONG = 1 << 20
CACHE = 600_000


def slices(text: str, joint: re.Pattern[str] = JOINT) -> Iterator[str]:
    """``text`` in slices of about a million characters that tokenise independently."""
    begin = 0
    while len(text) - begin > LONG and (m := joint.search(text, begin + LONG)):
        yield text[begin : m.start()]
        begin = m.start()
    yield text[begin:] if begin else text


class ByteBpe:
    """Ids of whole texts as the tokenizers library gives them, remembering the ids of pieces."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.piece = self._pieces(path)
        self.type = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.known: dict[str, bytes] = {}

    def _pieces(self, path: str):
        """A faster encoder of single pieces; only where ids follow the order of merges, as it takes ids for ranks."""
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        vocabulary = model["vocab"]
        parts = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [vocabulary["".join(m)] for m in parts]
        if ids != sorted(ids) or sorted(vocabulary.values()) != list(range(len(vocabulary))) or len(ids) + 256 != len(vocabulary):
            return lambda piece: self.tokenizer.encode(piece, add_special_tokens=False).ids
        ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items()}
        return tiktoken.Encoding("pieces", pat_str=PIECES.pattern, mergeable_ranks=ranks, special_tokens={})._encode_single_piece

    def encode(self, text: str) -> bytes:
        """The ids of ``text``, packed."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._whole(text)
        if any(s in text for s in self.special):
            return self._whole(text)
        return b"".join(self._slice(s) for s in slices(text))

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.type).tobytes()

    def _slice(self, text: str) -> bytes:
        pieces, known = PIECES.findall(text), self.known
        out = list(map(known.get, pieces))
        if None in out:
            if len(known) > CACHE:
                known.clear()
            kind, piece = ("%dH" if self.type == "<u2" else "%dI"), self.piece
            for i, packed in enumerate(out):
                if packed is None and (packed := known.get(pieces[i])) is None:
                    ids = piece(pieces[i])
                    packed = known[pieces[i]] = struct.pack("<" + kind % len(ids), *ids)
                out[i] = packed
        return b"".join(out)


#: Bands of virtual time whose tokens are added up together.
BLOCK = 4096


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    """One tokenizer a Python worker."""
    return ByteBpe(path)


@dataclass(frozen=True)
class PackParams:
    """``weights``: target share of each source (its share of the corpus if absent). ``path``: the vocabulary file."""

    length: int = 1024
    window: int = 64 * 1024
    closing: int = 0
    max_queues: int = 256
    weights: dict[str, float] = field(default_factory=dict)
    path: str = ""

    def vocabulary(self) -> str:
        if self.path:
            return self.path
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.json")


class Schedule:
    """What every queue has sent after every window."""

    def __init__(self, totals: np.ndarray, shares: np.ndarray, window: int, shared: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> None:
        """``shared``: totals, shares and numbers of like sources that make up the last queue."""
        self.totals, self.shares, self.window, self.curve = totals, shares, window, None
        self.windows = -(-int(totals.sum()) // window)
        if shared is None:
            ends = np.unique(totals / shares)  # virtual times at which queues run dry
            self.times = np.concatenate([[0.0], ends])
            self.sent = np.minimum(totals, shares * self.times[:, None]).sum(1)
            return
        own, part, number = shared
        self.times = np.unique(np.concatenate([[0.0], totals[:-1] / shares[:-1], own / part]))
        order = np.argsort(own / part, kind="stable")
        ends, dry, live = (own / part)[order], np.cumsum((own * number)[order]), np.cumsum((part * number)[order])
        gone = np.searchsorted(ends, self.times, side="right")
        rate = np.maximum(0.0, live[-1] - np.concatenate([[0.0], live])[gone])
        rate[gone == len(ends)] = 0.0
        self.curve = np.maximum.accumulate(np.concatenate([[0.0], dry])[gone] + rate * self.times)  # what the shared queue has sent
        self.sent = self.curve + sum(np.minimum(n, p * self.times) for n, p in zip(totals[:-1], shares[:-1]))

    def shared_sent(self, t: np.ndarray) -> np.ndarray:
        """Tokens that the shared queue has sent at virtual times."""
        return np.minimum(self.totals[-1], np.floor(np.interp(t, self.times, self.curve)).astype(np.int64))

    def after(self, k: np.ndarray) -> np.ndarray:
        """(windows, queues): tokens sent before window ``k``."""
        t = np.interp(k * float(self.window), self.sent, self.times)
        out = np.minimum(self.totals, np.floor(self.shares * t[:, None]).astype(np.int64))
        if self.curve is not None:
            out[:, -1] = self.shared_sent(t)
        return np.where((k >= self.windows)[:, None], self.totals, out)

    def _own(self, k: np.ndarray, queue: np.ndarray) -> np.ndarray:
        t = np.interp(k * float(self.window), self.sent, self.times)
        out = np.minimum(self.totals[queue], np.floor(self.shares[queue] * t).astype(np.int64))
        if self.curve is not None:
            out = np.where(queue == len(self.totals) - 1, self.shared_sent(t), out)
        return np.where(k >= self.windows, self.totals[queue], out)

    def window_of(self, queue: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The window in which each queue sends its token ``at``."""
        t = (at + 1) / self.shares[queue]
        if self.curve is not None:
            t = np.where(queue == len(self.totals) - 1, np.interp(at + 1, self.curve, self.times), t)
        k = np.interp(t, self.times, self.sent) // self.window
        k = np.clip(k.astype(np.int64), 0, self.windows - 1)
        while (late := self._own(k, queue) > at).any():
            k -= late
        while (early := self._own(k + 1, queue) <= at).any():
            k += early
        return k

    def pieces(self, queue: np.ndarray, begin: np.ndarray, count: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
        """(document, start, length, sequence, offset) of the pieces of documents at ``begin`` of their queues."""
        first, last = self.window_of(queue, begin), self.window_of(queue, begin + count - 1)
        doc, step = _spread(last - first + 1)
        k, q = first[doc] + step, queue[doc]
        sent, next_sent = self.after(k), self.after(k + 1)
        rows = np.arange(len(doc))
        own = sent[rows, q]
        a = np.maximum(begin[doc], own)
        n = np.minimum(begin[doc] + count[doc], next_sent[rows, q]) - a
        turn = np.cumsum(next_sent - sent, axis=1)
        place = sent.sum(1) + turn[rows, q] - (next_sent[rows, q] - own) + a - own
        kept = n > 0
        doc, a, n, place = doc[kept], a[kept] - begin[doc[kept]], n[kept], place[kept]
        part, step = _spread((place + n - 1) // length - place // length + 1)
        sequence = place[part] // length + step
        low, high = np.maximum(place[part], sequence * length), np.minimum(place[part] + n[part], (sequence + 1) * length)
        return doc[part], a[part] + low - place[part], high - low, sequence, low - sequence * length


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``counts`` repetitions, its row and its number within the row."""
    rows = np.repeat(np.arange(len(counts)), counts)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)


def _tokenised(documents: DataFrame, queues: dict[str | None, int], rest: int, params: PackParams) -> DataFrame:
    """Ids of every document, and its offset among those of its source in its task. ``other`` names a source of the
    shared queue."""
    path, closing, types = params.vocabulary(), params.closing, dict(documents.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, at = byte_bpe(path), TaskContext.get().partitionId(), {}
        end = np.array([closing], bpe.type).tobytes()
        for batch in batches:
            queue, other, local, count, ids = [], [], [], [], []
            for text, source in zip(texts_of(batch), batch.column("source").to_pylist()):
                packed = bpe.encode(text) + end
                q, n = queues.get(source, rest), len(packed) // len(end)
                name = "" if q < rest else "=" if source is None else "=" + json.dumps(source)
                queue.append(q)
                other.append(name)
                local.append(at.get((q, name), 0))
                count.append(n)
                ids.append(packed)
                at[q, name] = local[-1] + n
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([part] * len(ids), pa.int32()), pa.array(queue, pa.int32()), pa.array(other, pa.string()), pa.array(local, pa.int64()), pa.array(count, pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "part", "queue", "other", "local", "n", "ids"],
            )

    frame = documents.select("doc_id", "text", F.col("source").cast("string").alias("source"))
    frame.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return frame.mapInArrow(run, f"doc_id {types['doc_id']}, part int, queue int, other string, local long, n long, ids binary")


def pack(documents: DataFrame, params: PackParams = PackParams()) -> DataFrame:
    """One row a piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    largest = documents.groupBy(F.col("source").cast("string").alias("source")).agg(F.count("*").alias("n"))
    largest = largest.orderBy(F.desc("n"), F.asc_nulls_first("source")).limit(params.max_queues - 1).collect()
    names = sorted((r["source"] for r in largest), key=lambda s: (s is not None, s))
    queues, rest = {s: i for i, s in enumerate(names)}, len(names)
    stored = materialize(_tokenised(documents, queues, rest, params), "packing-ids")
    sums = materialize(stored.groupBy("part", "queue", "other").agg(F.sum("n").alias("n")), "packing-sums")
    totals = np.zeros(rest + 1, np.int64)
    for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect():
        totals[r["queue"]] = r["n"]
    live = np.flatnonzero(totals)
    place = np.full(rest + 1, -1)
    place[live] = np.arange(len(live))
    shares = totals[live] / max(1, totals.sum())
    if params.weights:
        shares = np.array([params.weights.get(names[i] if i < rest else "", 0.0) for i in live])
        shares = np.maximum(shares, 1e-9) / np.maximum(shares, 1e-9).sum()
    spark, shared, sources = documents.sparkSession, None, None
    if totals[rest]:
        sources = sums.where(F.col("queue") == rest).groupBy("other").agg(F.sum("n").alias("total"))
        if params.weights:
            given = [("=" + json.dumps(s), float(w)) for s, w in params.weights.items()]
            given = F.broadcast(spark.createDataFrame(given, "other string, weight double"))
            sources = sources.join(given, "other", "left").withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(1e-9)))
        else:
            sources = sources.withColumn("weight", F.col("total") / F.lit(float(totals.sum())))
        sources = materialize(sources, "packing-sources")
        kinds = sources.groupBy("total", "weight").agg(F.count("*").alias("n")).collect()
        own, part, number = (np.array([r[c] for r in kinds], float) for c in ("total", "weight", "n"))
        if params.weights:
            shares = np.array([max(params.weights.get(names[i], 0.0), 1e-9) for i in live if i < rest] + [float(part @ number)])
            part, shares = part / shares.sum(), shares / shares.sum()
        shared = (own, part, number)
    schedule = Schedule(totals[live], shares, params.window, shared)
    plan = spark.sparkContext.broadcast((place, schedule, params.length))
    bases = sums.select("part", "queue", "other", F.expr("sum(n) OVER (PARTITION BY queue, other ORDER BY part) - n").alias("base"))
    bases = materialize(bases, "packing-bases")
    if bases.count() <= 500_000:  # a few numbers for each task and queue: 12 MB at most
        bases = F.broadcast(bases)
    kind, types = byte_bpe(params.vocabulary()).type, dict(documents.dtypes)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        place, schedule, length = plan.value
        queue, count = place[batch.column("queue").to_numpy()], batch.column("n").to_numpy()
        doc, start, size, sequence, offset = schedule.pieces(queue, batch.column("begin").to_numpy(), count, length)
        ids = batch.column("ids")
        sums, last, wide = np.empty(len(doc), np.int64), -1, b""
        for i, (d, a, n) in enumerate(zip(doc.tolist(), start.tolist(), size.tolist())):
            if d != last:
                wide, last = np.frombuffer(ids[d].as_buffer(), kind).astype("<u4").tobytes(), d
            sums[i] = zlib.crc32(wide[4 * a : 4 * (a + n)])
        columns = [batch.column("doc_id").take(pa.array(doc)), *map(pa.array, (start + batch.column("skip").to_numpy()[doc], size, sums, batch.column("doc_tokens").to_numpy()[doc], sequence, offset))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    schema = f"doc_id {types['doc_id']}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    placed = stored.join(bases, ["part", "queue", "other"]).withColumn("begin", F.col("base") + F.col("local"))
    columns = ["doc_id", "queue", "begin", "n", F.lit(0).cast("long").alias("skip"), F.col("n").alias("doc_tokens"), "ids"]
    if sources is None:
        return map_batches(placed.select(columns), run, schema)
    total = float(part @ number) / float(shares[-1])
    others = placed.where(F.col("queue") == rest).join(sources.select("other", (F.col("weight") / total).alias("share")), "other")
    packets = _by_virtual_time(others, schedule, params, kind, types["doc_id"], rest)
    return map_batches(placed.where(F.col("queue") < rest).select(columns).unionByName(packets), run, schema)


def _by_virtual_time(others: DataFrame, schedule: Schedule, params: PackParams, kind: str, id_type: str, rest: int) -> DataFrame:
    """The documents of the shared queue as packets, with their places in the queue: by virtual time, which is cut into
    bands of about a window of the queue's tokens; places are sums over bands and within them."""
    plan, length, step = others.sparkSession.sparkContext.broadcast(schedule), params.length, int(kind[-1])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        schedule, count, begin = plan.value, batch.column("n").to_numpy(), batch.column("begin").to_numpy()
        doc, turn = _spread(-(-count // length))
        skip = turn * length
        n = np.minimum(count[doc] - skip, length)
        name = batch.column("other").to_pylist()
        phase = np.array([zlib.crc32(x.encode()) / 2**32 for x in name])
        time = (begin[doc] + skip + phase[doc] * n) / batch.column("share").to_numpy()[doc]
        band = schedule.shared_sent(time) // schedule.window
        ids = batch.column("ids")
        cut = [ids[d].as_py()[step * a : step * (a + m)] for d, a, m in zip(doc.tolist(), skip.tolist(), n.tolist())]
        wide = [batch.column(c).take(pa.array(doc)) for c in ("doc_id", "other")]
        return pa.RecordBatch.from_arrays(
            [*wide, *map(pa.array, (band, time, begin[doc] + skip, n, skip, count[doc])), pa.array(cut, pa.binary())], ["doc_id", "other", "band", "time", "own", "n", "skip", "doc_tokens", "ids"]
        )

    frame = others.select("doc_id", "other", "begin", "n", "share", "ids")
    frame = map_batches(frame, run, f"doc_id {id_type}, other string, band long, time double, own long, n long, skip long, doc_tokens long, ids binary")
    frame = materialize(frame, "packing-packets")
    # Sums before each band: within blocks of bands, and over the blocks, of which there is one in BLOCK * window tokens.
    bands = frame.groupBy("band", F.expr(f"band div {BLOCK}").alias("block")).agg(F.sum("n").alias("held"))
    bands = materialize(bands, "packing-bands")
    blocks = bands.groupBy("block").agg(F.sum("held").alias("all")).select("block", F.expr("sum(all) OVER (ORDER BY block) - all").alias("ahead"))
    inside = bands.select("band", "block", F.expr("sum(held) OVER (PARTITION BY block ORDER BY band) - held").alias("before"))
    bands = inside.join(blocks, "block").select("band", (F.col("before") + F.col("ahead")).alias("before"))
    within = frame.withColumn("begin", F.expr("sum(n) OVER (PARTITION BY band ORDER BY time, other, own ROWS UNBOUNDED PRECEDING) - n"))
    return within.join(bands, "band").select("doc_id", F.lit(rest).alias("queue"), (F.col("begin") + F.col("before")).alias("begin"), "n", "skip", "doc_tokens", "ids")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
