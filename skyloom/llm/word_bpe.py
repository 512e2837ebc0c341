"""Byte-pair encoding and decoding by a tokenization automaton.

The merges are compiled, in their order, into a deterministic automaton over tokens. It starts with one state and an arc
for each base symbol. The gadget of a merge ``u v -> w`` gives ``w`` a state of its own, a copy of that of ``v``; gives
every state with an arc ``u`` an arc ``w``; and takes the arc ``v`` from the state of ``u``. The paths of the finished
automaton are exactly the correct encodings, so of the tokens that end at a position of a word only one continues the
path: encoding is one transition look-up after another, without merging. Copies are held as links (state to state,
arc to arc, with the gadget's number) and rows are filled in as they are first used; a whole table of 49,408 squared
entries would never fit. Decoding emits the label of each arc.

Texts are normalised and pre-split as the vocabulary file says; texts within the first 256 code points by an equal
regular expression, others by the file's own normaliser and pre-tokenizer.

Defined results: null and empty texts have no ids and an empty decoding. Repeated rows and null ids pass; further
columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, read, texts_of
from .packing import BLANK, LETTER, NUMBER, slices

WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{BLANK}{LETTER}{NUMBER}]+")
#: Any white space parts words.
GAP = re.compile(f"[{BLANK}]")
ANY_GAP = re.compile(r"\s")
CACHE = 400_000


class Automaton:
    """States and arcs are both named by token: after an arc ``t`` the automaton is in the state of ``t``."""

    def __init__(self, tokens: dict[str, int], merges: list[tuple[str, str]]) -> None:
        size = max(tokens.values(), default=-1) + 1
        self.size, self.born = size, [-1] * size
        self.left, self.right = [0] * size, [0] * size
        self.cut: dict[int, int] = {}  # state and arc -> number of the gadget that took the arc
        self.table: dict[int, bool] = {}
        self.arcs = {t: i for t, i in tokens.items()}
        for number, (a, b) in enumerate(merges):
            self._gadget(number, tokens[a], tokens[b], tokens[a + b])
        self.longest = max(map(len, self.arcs), default=0)

    def _gadget(self, number: int, u: int, v: int, w: int) -> None:
        if self.born[w] >= 0 or not self._follows(u, v, number):  # no path has u v by now: w stays without arcs
            if self.born[w] < 0:
                self.arcs = {t: i for t, i in self.arcs.items() if i != w}
            return
        self.born[w], self.left[w], self.right[w] = number, u, v
        self.cut[u * self.size + v] = number

    def _follows(self, state: int, arc: int, before: float) -> bool:
        """Whether ``state`` had ``arc`` before the gadget of that number, tracing copies back to base symbols."""
        born, cut, size = self.born, self.cut, self.size
        while True:
            if cut.get(state * size + arc, before) < before:
                return False
            made_state, made_arc = born[state], born[arc]
            if made_state < 0 and made_arc < 0:
                return True
            if made_arc >= made_state:  # the arc was copied after its gadget's cut
                arc, before = self.left[arc], made_arc + 1
            else:  # the state was copied before it
                state, before = self.right[state], made_state

    def step(self, state: int, arc: int) -> bool:
        """The transition table, a row entry of which is filled in at its first use."""
        key = state * self.size + arc
        known = self.table.get(key)
        if known is None:
            if len(self.table) > 2_000_000:
                self.table.clear()
            known = self.table[key] = self._follows(state, arc, float("inf"))
        return known

    def encode(self, symbols: list[str]) -> list[int]:
        """The only path that spells ``symbols``."""
        last, back, n = [-1] * (len(symbols) + 1), [0] * (len(symbols) + 1), len(symbols)
        word = "".join(symbols)
        ends = [0]
        for s in symbols:
            ends.append(ends[-1] + len(s))
        for i in range(1, n + 1):
            stop = ends[i]
            for k in range(max(0, i - self.longest), i):
                arc = self.arcs.get(word[ends[k] : stop])
                if arc is not None and (k == 0 or (last[k] >= 0 and self.step(last[k], arc))):
                    last[i], back[i] = arc, k
                    break
        out, i = [], n
        while i:
            out.append(last[i])
            i = back[i]
        return out[::-1]


class WordBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        bpe = model["model"]
        self.suffix = bpe["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in bpe["merges"]]
        self.automaton = Automaton(bpe["vocab"], merges)
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.labels = {i: t for t, i in bpe["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        library = Tokenizer.from_file(path)
        self.normalize, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.byte = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.known: dict[str, tuple[bytes, str]] = {}
        self.spelt: dict[str, tuple[bytes, str]] = {}

    def _spell(self, word: str) -> tuple[bytes, str]:
        """Ids and labels of a word of byte symbols."""
        ids = self.automaton.encode([*word[:-1], word[-1] + self.suffix])
        return np.array(ids, "<u4").tobytes(), " ".join(map(self.labels.__getitem__, ids))

    def _words(self, words: list[str], known: dict[str, tuple[bytes, str]], raw: bool) -> list[tuple[bytes, str]]:
        out = list(map(known.get, words))
        if None in out:
            if len(known) > CACHE:
                known.clear()
            for i, found in enumerate(out):
                if found is None and (found := known.get(words[i])) is None:
                    spelt = "".join(map(self.byte.__getitem__, words[i].encode())) if raw else words[i]
                    found = known[words[i]] = self._spell(spelt)
                out[i] = found
        return out

    def encode(self, text: str) -> tuple[bytes, str]:
        """The ids of a text as little-endian 32-bit numbers, and the labels that they decode to."""
        ids, labels = [], []
        for part in self.parts.split(text) if "<|" in text else [text]:
            if part in self.special:
                found = [(np.array([self.special[part]], "<u4").tobytes(), part)]
            else:
                found = []
                for piece in slices(part, GAP if part.isascii() else ANY_GAP):
                    try:
                        piece.encode("latin-1")
                        found += self._words(WORDS.findall(piece.lower()), self.known, True)
                    except UnicodeEncodeError:
                        found += self._words([w for w, _ in self.split(self.normalize(piece))], self.spelt, False)
            if found:
                a, b = zip(*found)
                ids += a
                labels += b
        return b"".join(ids), " ".join(labels)

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, one after another."""
        return " ".join(self.labels[i] for i in ids)


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """One automaton a Python worker."""
    return WordBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(documents: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, ``ids`` (packed little-endian 32-bit numbers) and ``decoded`` of every row."""
    return _mapped(documents, path, "ids binary, decoded string", lambda ids, text: (ids, text))


def digests(documents: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: ``encode`` without moving ids and texts."""
    sha = lambda data: hashlib.sha256(data).hexdigest()
    return _mapped(documents, path, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda ids, text: (len(ids) // 4, sha(ids), sha(text.encode())))


def _mapped(documents: DataFrame, path: str | None, columns: str, derive) -> DataFrame:
    path, names = path or default_path(), [c.split()[0] for c in columns.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    kinds = [types[c.split()[1]] for c in columns.split(", ")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = word_bpe(path)
        found = list(zip(*[derive(*bpe.encode(t)) for t in texts_of(batch)]))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(v, k) for v, k in zip(found, kinds)]], ["doc_id", *names])

    return map_batches(documents.select("doc_id", "text"), run, f"doc_id {dict(documents.dtypes)['doc_id']}, {columns}")


def op9_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))
