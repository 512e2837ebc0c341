"""Personal data: exact patterns, and a linear-chain conditional random field for what the patterns miss.

Base spans come from four patterns with their checks. The field labels the tokens around every token that holds a
digit or an ``@`` or spells one out, as ``at``, ``[dot]`` (three to each side; runs that touch are one chain) by word shapes and cue words, is trained from a
small labelled table that ``labelled_table`` writes out by rule, and is decoded by Viterbi in numpy, all chains of a
batch together. Its spans are added where they touch no base span: identity numbers, phone numbers without a leading
plus, and addresses in words. Spans of a kind with a check (ip, card) must pass it.

Defined results: null and empty texts have no spans; spans are code points, end exclusive. Of labels that score alike the
first in ``LABELS`` wins. Repeated rows and null ids pass; further columns are not read. Texts of any length are decoded
whole: a chain of many tokens goes through in parts, with the result of the whole chain.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, read, texts_of

#: Base patterns, in the order of the result (fixed values). Mail addresses are matched from their ``@`` and ip
#: addresses from the first digit of a run: the same matches, in time linear in the text.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
KINDS = ("email", "ip", "card", "phone", "id")
LABELS = ("O", "email", "ip", "card", "phone", "id")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
GAPS = " \t\n\x0b\x0c\r"
GAP = re.compile(r"[\x20\x09-\x0D]")
#: What opens a chain: digits, an @, and the words that stand for @ and a dot, alone or in brackets.
SPOT = re.compile(  # what it begins with comes first, so the search runs over other characters fast
    r"[0-9@AaDd\[({<](?:(?<=[0-9@])|(?<=(?<![^\x20\x09-\x0D])[Aa])[Tt](?![^\x20\x09-\x0D])|(?<=(?<![^\x20\x09-\x0D])[Dd])[Oo][Tt](?![^\x20\x09-\x0D])|(?<=[\[({<])(?:[Aa][Tt]|[Dd][Oo][Tt])[\])}>])"
)
#: An ``at`` between blanks or brackets, and a dot, or ``dot`` alike, before a letter.
AT, DOT = re.compile(r"(?i)[\s\[({<]at[\s\])}>]"), re.compile(r"(?i)(?:\.|[\s\[({<]dot[\s\])}>])\s*[a-z]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EDGE = ".,;:!?()[]{}<>\"'#*$%&|"
AROUND = 3
#: Words that announce personal data, or numbers that are none.
CUES = frozenset(
    "phone tel telephone mobile call fax cell whatsapp email mail contact write reach ssn social security passport id identity number no card visa mastercard iban account "
    "tax license driver dob born ip address host server version release page chapter figure section line build port year since order invoice price total token key "
    "commit hash copyright isbn at dot".split()
)
SIZE = 1 << 14  # hashed features
GAP_TOKEN = ""
TOGETHER = 4096  # tokens of a chain beyond which it is decoded in parts


def luhn(digits: str) -> bool:
    """Whether the check digit holds."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _is_ip(x: str) -> bool:
    parts = [p.lstrip("0") for p in x.split(".")]  # runs of digits may be longer than int() takes
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def _is_card(x: str) -> bool:
    digits = x.replace(" ", "").replace("-", "")
    return 16 <= len(digits) <= 19 and luhn(digits)


def _is_phone(x: str) -> bool:
    return 8 <= len(DIGIT.findall(x)) <= 15


def _emails(text: str) -> list[tuple[str, int, int]]:
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > low and text[a - 1] in LOCAL:
            a -= 1
        if a < at and (m := DOMAIN.match(text, at)):
            out.append(("email", a, m.end()))
            low = m.end()
        at = text.find("@", max(at + 1, low))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the patterns by kind, then start."""
    out = _emails(text)
    if DIGIT.search(text):
        for kind, pattern, check in (("ip", IP, _is_ip), ("card", CARD, _is_card), ("phone", PHONE, _is_phone)):
            if kind != "phone" or "+" in text:
                out += [(kind, *m.span()) for m in pattern.finditer(text) if check(m.group())]
    return out


def _shape(token: str) -> str:
    return "".join("d" if "0" <= c <= "9" else "X" if c.isupper() else "x" if c.isalpha() else c for c in token)


def _squeeze(shape: str) -> str:
    return re.sub(r"(.)\1+", r"\1", shape)


def spelled(text: str) -> bool:
    """Whether an address is spelled out: the first ``at``, and any dot behind it."""
    at = AT.search(text)
    return bool(at and DOT.search(text, at.end()))


def own_features(token: str) -> tuple[list[str], str, str]:
    """What a token says of itself; its word in lower case, and its squeezed shape."""
    shape, low = _squeeze(_shape(token)), token.lower().strip(".:#[](){}<>")
    digits = len(DIGIT.findall(token))
    own = ["bias", f"s{shape[:12]}", f"f{_shape(token[:16])}", f"d{min(digits, 20)}", f"l{min(len(token), 24)}", f"pure{digits == len(token)}"]
    return own + [f"w{low}"] * (low in CUES) + [f"has{c}" for c in "@.-+_/:=" if c in token] + ["spelled"] * spelled(token), low, shape


def token_features(tokens: list[str]) -> list[list[int]]:
    """Hashed word-shape features of each token of a chain, with its neighbours' cue words and shapes."""
    owns, lows, shapes = zip(*map(own_features, tokens)) if tokens else ((), (), ())
    out = []
    for i in range(len(tokens)):
        near = [f"p{k}{lows[i - k]}" for k in (1, 2, 3) if i >= k and lows[i - k] in CUES] + [f"n{w}" for w in lows[i + 1 : i + 2] if w in CUES]
        near += [f"m{k}{lows[i + k]}" for k in (2, 3) if i + k < len(lows) and lows[i + k] in ("at", "dot")]
        sides = [f"sp{x[:6]}" for x in shapes[max(0, i - 1) : i]] + [f"sn{x[:6]}" for x in shapes[i + 1 : i + 2]]
        out.append([zlib.crc32(f.encode()) % SIZE for f in owns[i] + ["cued"] * any(n[2:] in CUES for n in near) + near + sides])
    return out


@dataclass
class PiiModel:
    weights: np.ndarray  # (features, labels)
    moves: np.ndarray  # (from, to)

    def __getstate__(self) -> dict[str, np.ndarray]:
        return {"weights": self.weights, "moves": self.moves}


def _scores(weights: np.ndarray, chains: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """(chain, token, label) scores and the mask of real tokens."""
    m = max(map(len, chains))
    mask = np.zeros((len(chains), m), bool)
    flat = [f for c in chains for f in c]
    ends = np.cumsum([0] + [len(f) for f in flat])[:-1]
    sums = np.add.reduceat(weights[np.concatenate([np.array(f) for f in flat])], ends, axis=0)
    for k, c in enumerate(chains):
        mask[k, : len(c)] = True
    out = np.zeros((len(chains), m, weights.shape[1]))
    out[mask] = sums
    return out, mask


def viterbi(model: PiiModel, chains: list[list[list[int]]]) -> list[np.ndarray]:
    """The best labels of every chain of features."""
    if not any(chains):
        return [np.zeros(0, np.int64)] * len(chains)
    return decode(model.moves, [np.stack([model.weights[f].sum(0) for f in c]) if c else np.zeros((0, len(LABELS))) for c in chains])


def decode(moves: np.ndarray, chains: list[np.ndarray]) -> list[np.ndarray]:
    """The best labels of every chain of (token, label) scores: short chains in batches of like length, long ones alone."""
    out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(chains)
    order = sorted((i for i in range(len(chains)) if len(chains[i])), key=lambda i: len(chains[i]))
    while order and len(chains[order[-1]]) > TOGETHER:
        i = order.pop()
        out[i] = decode_long(moves, iter([chains[i]]))
    while order:
        width = len(chains[order[-1]])
        take = max(1, 100_000 // width)
        group, order = order[-take:], order[:-take]
        scores, mask = np.zeros((len(group), width, len(moves))), np.zeros((len(group), width), bool)
        for k, i in enumerate(group):
            scores[k, : len(chains[i])], mask[k, : len(chains[i])] = chains[i], True
        best, back = scores[:, 0], np.zeros(scores.shape, np.int8)
        for t in range(1, width):
            paths = best[:, :, None] + moves
            back[:, t] = paths.argmax(1)
            best = np.where(mask[:, t, None], paths.max(1) + scores[:, t], best)
        label = best.argmax(1)
        labels = np.zeros(mask.shape, np.int8)
        for t in range(width - 1, -1, -1):
            labels[:, t] = label
            if t:
                label = np.where(mask[:, t], back[np.arange(len(group)), t, label], label)
        for k, i in enumerate(group):
            out[i] = labels[k, : len(chains[i])]
    return out


def decode_long(moves: np.ndarray, parts: Iterator[np.ndarray]) -> np.ndarray:
    """The best labels of one chain whose scores come in parts: the best path to each label passes on from part to part, and
    one byte a token and label remembers the ways back, so the result is that of the whole chain."""
    step, back, best = moves.T.tolist(), [], None  # step[to][from]
    kinds = range(len(moves))
    for part in parts:
        ways = bytearray()
        for score in part.tolist():
            if best is None:
                best = score
                ways += bytes(len(moves))
                continue
            fresh = []
            for k in kinds:
                paths = [b + m for b, m in zip(best, step[k])]
                top = max(paths)
                ways.append(paths.index(top))
                fresh.append(top + score[k])
            best = fresh
        back.append(np.frombuffer(bytes(ways), np.int8).reshape(-1, len(moves)))
    if best is None:
        return np.zeros(0, np.int8)
    labels, label = [], best.index(max(best))
    for ways in reversed(back):
        own = np.empty(len(ways), np.int8)
        for t in range(len(ways) - 1, -1, -1):
            own[t] = label
            label = int(ways[t, label])
        labels.append(own)
    return np.concatenate(labels[::-1])


class Scorer:
    """Scores of tokens in chains. What a token adds to its own score and to those of its neighbours is worked out once for
    each different token, so a chain is scored by look-ups; the sums are those of ``token_features``."""

    def __init__(self, model: PiiModel) -> None:
        self.weights = model.weights
        self.cued = self.weights[zlib.crc32(b"cued") % SIZE]
        self._forget()

    def _forget(self) -> None:
        self.known = {GAP_TOKEN: 0}  # stands between chains and says nothing
        self.table = np.zeros((1024, 9, len(LABELS)))
        self.cue = np.zeros((1024, 3), bool)  # makes tokens after it, the one before it, those two and three before it "cued"

    def _hashed(self, features: list[str]) -> np.ndarray:
        return self.weights[[zlib.crc32(f.encode()) % SIZE for f in features]].sum(0)

    def _learn(self, token: str) -> tuple[np.ndarray, tuple[bool, bool, bool]]:
        own, low, shape = own_features(token)
        cue, spelt = low in CUES, low in ("at", "dot")
        rows = [own, [f"sp{shape[:6]}"], [f"sn{shape[:6]}"], *[[f"p{k}{low}"] * cue for k in (1, 2, 3)], [f"n{low}"] * cue, *[[f"m{k}{low}"] * spelt for k in (2, 3)]]
        return np.stack([self._hashed(f) for f in rows]), (cue, cue and low[1:] in CUES, spelt)

    def ids(self, tokens: list[str]) -> np.ndarray:
        if len(self.known) > 200_000:
            self._forget()
        for token in dict.fromkeys(tokens):
            if token not in self.known:
                at = self.known[token] = len(self.known)
                if at == len(self.table):
                    self.table, self.cue = (np.concatenate([x, np.zeros_like(x)]) for x in (self.table, self.cue))
                self.table[at], self.cue[at] = self._learn(token)
        return np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))

    def many(self, chains: list[list[str]]) -> list[np.ndarray]:
        """The scores of chains, worked out together."""
        between = [GAP_TOKEN] * AROUND
        found = self.scores([t for c in chains for t in (*c, *between)])
        ends = np.cumsum([len(c) + AROUND for c in chains]) - AROUND
        return [found[end - len(c) : end] for c, end in zip(chains, ends.tolist())]

    def scores(self, tokens: list[str], low: int = 0, high: int | None = None) -> np.ndarray:
        """(token, label) of ``tokens[low:high]``; the others are what stands beside them in the chain."""
        at = self.ids(tokens)
        n, table, cue = len(at), self.table, self.cue
        out = table[at, 0]
        cued = np.zeros(n, bool)

        def beside(shift: int, kind: int, flag: int | None) -> None:
            """Add what the token ``shift`` places on (before, if negative) says."""
            if abs(shift) >= n:
                return
            to, of = (slice(None, -shift), slice(shift, None)) if shift > 0 else (slice(-shift, None), slice(None, shift))
            out[to] += table[at[of], kind]
            if flag is not None:
                cued[to] |= cue[at[of], flag]

        beside(-1, 1, None)
        beside(1, 2, None)
        for k in (1, 2, 3):
            beside(-k, 2 + k, 0)
        beside(1, 6, 1)
        beside(2, 7, 2)
        beside(3, 8, 2)
        out[cued] += self.cued
        return out[low:high]


def train(rows: list[tuple[list[str], list[int]]], rounds: int = 80) -> PiiModel:
    """Adam on the regularised log-likelihood, with forward and backward passes over all chains together."""
    chains, n = [token_features(t) for t, _ in rows], len(LABELS)
    weights, moves = np.zeros((SIZE, n)), np.zeros((n, n))
    _, mask = _scores(weights, chains)
    y = np.zeros(mask.shape, np.int64)
    for k, (_, labels) in enumerate(rows):
        y[k, : len(labels)] = labels
    flat = [f for c in chains for f in c]
    features, owner = np.concatenate([np.array(f) for f in flat]), np.repeat(np.arange(len(flat)), [len(f) for f in flat])
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(moves)]
    for step in range(1, rounds + 1):
        scores, _ = _scores(weights, chains)
        ahead, back = [scores[:, 0]], [np.zeros_like(scores[:, 0])]
        for t in range(1, mask.shape[1]):
            to = np.logaddexp.reduce(ahead[-1][:, :, None] + moves, axis=1) + scores[:, t]
            ahead.append(np.where(mask[:, t, None], to, ahead[-1]))
        z = np.logaddexp.reduce(ahead[-1], axis=1)
        pairs, want = np.zeros((n, n)), np.zeros((n, n))
        for t in range(mask.shape[1] - 2, -1, -1):
            after = back[0] + scores[:, t + 1]
            joint = np.exp(ahead[t][:, :, None] + moves + after[:, None, :] - z[:, None, None])
            live = mask[:, t + 1]
            pairs += joint[live].sum(0)
            np.add.at(want, (y[live, t], y[live, t + 1]), 1)
            back.insert(0, np.where(live[:, None], np.logaddexp.reduce(moves[None] + after[:, None, :], axis=2), back[0]))
        p = np.exp(np.stack(ahead, 1) + np.stack(back, 1) - z[:, None, None])
        gap = (np.eye(n)[y] - p)[mask]
        grad = np.stack([np.bincount(features, gap[owner, k], SIZE) for k in range(n)], 1) / len(flat) - 2e-5 * weights
        turn = (want - pairs) / len(flat) - 1e-4 * moves
        for k, (value, g) in enumerate(((weights, grad), (moves, turn))):
            m, v = state[2 * k], state[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return PiiModel(weights, moves)


def labelled_table(each: int = 60, seed: int = 3) -> list[tuple[list[str], list[int]]]:
    """Tokens and labels of short labelled passages: announced personal data, and numbers that are none."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    words = "the and of est que la der und con para it was they said pan rento ster ithon".split()
    fill = lambda n: [(r.choice(words), 0) for _ in range(n)]
    o = lambda text: [(w, 0) for w in text.split()]
    as_ = lambda text, label: [(w, LABELS.index(label)) for w in text.split()]
    name = lambda: r.choice("ann bob carol dave erin frank hein best".split())
    host = lambda: r.choice("example mail corp uni".split())
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    made = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 3))) + r.choice(("", "n", "s", "rt"))
    some = lambda: r.choice((name(), made(), made(), host()))

    def spelled(glued: bool = False) -> str:
        at, dot = r.choice((("at", "dot"),) * 3 * (not glued) + (("[at]", "[dot]"), ("(at)", "(dot)"), ("{at}", "{dot}")))
        gap = "" if glued else " "
        first = r.choice((some(), some(), some() + gap + dot + gap + some()))
        end = r.choice((f"{some()}{gap}{dot}{gap}", f"{some()}{gap}{dot}{gap}", f"{some()}.", f"{some()}{gap}{dot}{gap}{some()}{gap}{dot}{gap}"))
        return f"{first}{gap}{at}{gap}{end}{r.choice('com org net edu de fr uk'.split())}"

    rows = []
    for _ in range(each):
        rows += [
            o(r.choice(("write to", "email", "contact", "reach me:", "mail", "", "is"))) + as_(spelled(), "email"),
            as_(spelled(True), "email"),
            o(r.choice(("look", "they met", name(), "arrived", made(), "was", "write to " + name(), "email " + name()))) + o("at") + o(r.choice(("the", "noon", "home", made(), f"{made()} {made()}", "least " + made()))),
            o(r.choice(("a dot on the", "the dot com years", "every dot is", "dot", f"{made()} dot {made()}", f"at a dot {made()}", f"at the {made()} dot")))  + fill(1),
            o(r.choice(("phone:", "tel", "call", "mobile", "fax:"))) + as_(r.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"0{d(3)} {d(7)}")), "phone"),
            as_(f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", "phone"),
            o(r.choice(("ssn", "social security number", "SSN:"))) + as_(f"{d(3)}-{d(2)}-{d(4)}", "id"),
            o(r.choice(("passport", "passport no", "passport number"))) + as_(r.choice("XCPLN") + d(8), "id"),
            o(r.choice(("iban", "account", "IBAN:"))) + as_(f"{r.choice(('DE', 'FR', 'ES'))}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}", "id"),
            o(r.choice(("email", "mail", "contact"))) + as_(f"{name()}.{d(2)}@{host()}.com", "email"),
            as_(f"{name()}@{host()}{d(1)}.org", "email"),
            o(r.choice(("ip", "host", "server", "address"))) + as_(f"{r.randint(1, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}", "ip"),
            o(r.choice(("card", "visa", ""))) + as_(r.choice((f"4{d(15)}", f"5{d(3)} {d(4)} {d(4)} {d(4)}")), "card"),
            o(r.choice(("version", "release", "v", "build"))) + o(r.choice((f"{d(1)}.{d(1)}.", f"{d(1)}.{d(2)}.{d(1)}", d(1)))),
            o(r.choice(("page", "chapter", "figure", "section", "line", "year", "since", "in", "order", "invoice", "port"))) + o(r.choice((d(1), d(2), d(4), "19" + d(2), "20" + d(2), d(5)))),
            o(r.choice(("price", "total", "cost"))) + o(r.choice((f"{d(2)}.{d(2)}", f"{d(1)},{d(3)}", f"${d(3)}"))),
            o("token =") + o(hexa(40)) if r.random() < 0.5 else o("commit") + o(hexa(r.choice((7, 12, 40)))),
            o(r.choice(("on", "at", "date", ""))) + o(r.choice((f"20{d(2)}-0{r.randint(1, 9)}-1{d(1)}", f"{d(2)}/{d(2)}/20{d(2)}", f"{d(2)}:{d(2)}"))),
            o(r.choice(("AKIA", "A", "x"))) + o(hexa(12).upper()),
            o(f"{d(2)} {d(1)} {d(3)} {d(2)}") if r.random() < 0.5 else o(f"a{d(1)} b{d(2)} c{d(1)}"),
        ]
    out = []
    for row in rows:
        row = fill(r.randint(0, 3)) + row + fill(r.randint(0, 3))
        if row:
            out.append(([t for t, _ in row], [k for _, k in row]))
    return out


@lru_cache(maxsize=1)
def default_model() -> PiiModel:
    return train(labelled_table())


def _chains(text: str) -> Iterator[tuple[array, array]]:
    """Starts and ends of the tokens of each chain: every token with a digit or an @ or one spelled out, and three to each side; chains
    with fewer than three tokens between them are one."""
    starts, ends, done = array("i"), array("i"), 0
    while m := SPOT.search(text, done):
        low, a = (ends[-1] if ends else 0), m.start()
        if a < low:
            k = len(starts) - 1
            while starts[k] > a:
                k -= 1
            have, done = len(starts) - 1 - k, ends[k]
        else:
            while a > low and text[a - 1] not in GAPS:
                a -= 1
            done = end.start() if (end := GAP.search(text, a)) else len(text)
            before, at = [], a
            while len(before) < AROUND:
                stop = at
                while stop > low and text[stop - 1] in GAPS:
                    stop -= 1
                begin = stop
                while begin > low and text[begin - 1] not in GAPS:
                    begin -= 1
                if begin == stop:
                    break
                before.insert(0, (begin, stop))
                at = begin
            if starts and len(before) == AROUND:
                yield starts, ends
                starts, ends = array("i"), array("i")
            starts.extend([x for x, _ in before] + [a])
            ends.extend([x for _, x in before] + [done])
            have = 0
        for _ in range(AROUND - have):
            if not (after := TOKEN.search(text, ends[-1])):
                break
            starts.append(after.start())
            ends.append(after.end())
    if starts:
        yield starts, ends


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    """A span without marks at its edges; a bracket stays while its other half is inside."""
    closed = text.rfind(")", a, b)
    while a < b and text[a] in EDGE and not (text[a] == "(" and closed >= a):
        a += 1
    opened = text.find("(", a, b)
    while a < b and text[b - 1] in EDGE and not (text[b - 1] == ")" and 0 <= opened < b):
        b -= 1
    return a, b


CHECKS = {"email": lambda x: "@" in x or spelled(x), "ip": lambda x: bool(IP.fullmatch(x)) and _is_ip(x), "card": _is_card, "phone": lambda x: 7 <= len(DIGIT.findall(x)) <= 15, "id": lambda x: len(DIGIT.findall(x)) >= 5}


def _words(text: str, starts: array, ends: array, low: int = 0, high: int | None = None) -> list[str]:
    return [text[slice(*_trim(text, a, b))] or text[a:b] for a, b in zip(starts[low:high], ends[low:high])]


def _long_scores(scorer: Scorer, text: str, starts: array, ends: array) -> Iterator[np.ndarray]:
    """The scores of a long chain in parts; each is scored with the three tokens to both sides of it."""
    for at in range(0, len(starts), TOGETHER):
        low = max(0, at - AROUND)
        yield scorer.scores(_words(text, starts, ends, low, at + TOGETHER + AROUND), at - low, at - low + TOGETHER)


def _spans_of(text: str, starts: array, ends: array, labels: np.ndarray) -> Iterator[tuple[str, int, int]]:
    """Runs of equal labels as spans that pass their kind's check."""
    cuts = [0, *(np.flatnonzero(labels[1:] != labels[:-1]) + 1).tolist(), len(labels)]
    for i, j in zip(cuts, cuts[1:]):
        if labels[i]:
            kind, (a, b) = LABELS[labels[i]], _trim(text, starts[i], ends[j - 1])
            if a < b and CHECKS[kind](text[a:b]):
                yield kind, a, b


def find(model: PiiModel, texts: list[str]) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """(base spans, all spans) of each text. Chains are decoded together as soon as they hold enough tokens; a longer chain
    is decoded alone, in parts; so memory follows a text by a few bytes a token."""
    scorer = model.__dict__.setdefault("scorer", Scorer(model))  # serves the other batches of a worker too
    bases = [base_spans(t) for t in texts]
    more: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    waiting: list[tuple[int, array, array, list[str]]] = []
    held = 0

    def flush() -> None:
        for (k, starts, ends, _), labels in zip(waiting, decode(model.moves, scorer.many([w[3] for w in waiting]))):
            more[k] += _spans_of(texts[k], starts, ends, labels)
        waiting.clear()

    for k, text in enumerate(texts):
        if not SPOT.search(text):
            continue
        for starts, ends in _chains(text):
            if len(starts) > TOGETHER:
                flush()  # spans of a text stay in order
                held = 0
                more[k] += _spans_of(text, starts, ends, decode_long(model.moves, _long_scores(scorer, text, starts, ends)))
                continue
            waiting.append((k, starts, ends, _words(text, starts, ends)))
            held += len(starts)
            if held > 8 * TOGETHER:
                flush()
                held = 0
    flush()
    out = []
    for base, extra in zip(bases, more):
        taken = sorted((a, b) for _, a, b in base)
        reach = list(accumulate((b for _, b in taken), max))  # how far base spans reach that start no later
        free = [x for x in extra if not ((i := bisect_left(taken, (x[2], 0))) and reach[i - 1] > x[1])]
        out.append((base, sorted(base + free, key=lambda x: (KINDS.index(x[0]), x[1]))))
    return out


def scan(documents: DataFrame, model: PiiModel | None = None) -> DataFrame:
    """``doc_id``, the counts of base spans, ``base`` and ``spans`` (kind:start:end, joined) of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model or default_model())
    join = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = find(shared.value, texts_of(batch))
        counts = [pa.array([sum(k == kind for k, _, _ in b) for b, _ in rows], pa.int64()) for kind in KINDS[:4]]
        digests = [hashlib.sha256(join(b).encode()).hexdigest() for b, _ in rows]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *counts, pa.array(digests, pa.string()), pa.array([join(f) for _, f in rows], pa.string())], ["doc_id", *[f"n_{k}" for k in KINDS[:4]], "base_sha256", "spans"]
        )

    schema = f"doc_id {dict(documents.dtypes)['doc_id']}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return map_batches(documents.select("doc_id", "text"), run, schema)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
