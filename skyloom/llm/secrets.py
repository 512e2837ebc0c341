"""Secret scans: patterns propose candidates, a random forest removes the false ones.

Candidates are runs of 16 key-like characters or more, parted behind an inner ``=`` that follows an identifier, and the
values that are assigned to a name with a cue word or follow ``bearer``, of any length and any printable characters but
white space: between quotes up to the closing one; else up to a comma, semicolon, closing brace, quote or the next field of a
query string, and never beyond the next such name's sign, so that a text without white space is read once. The forest sees their length, character classes, how surprising their
character transitions are for a chain learned from the dictionary, how much
of them a dictionary covers, whether they look like a path, and the words beside them. It is trained from a table of
labelled findings, which ``labelled_findings`` makes by rule: keys in the shapes of common services and generic hex and
base64 secrets in assignments, against commit ids, checksums, UUIDs, paths, identifiers, numbers and long words.

Defined results: null and empty texts have no findings; spans are code points, end exclusive, by start; findings that
overlap are one. Repeated rows
stay and null ids are passed on; further columns are kept only where asked for.
"""

from __future__ import annotations

import math
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, read, texts_of

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
#: What a candidate may begin with and end in without its being part of the secret.
TRIM = "=.-/"
#: A name and ``=`` inside a run; what follows is a candidate of its own.
NAMED = re.compile(r"[A-Za-z_][A-Za-z0-9_.-]*=(?![=/.-]*$)")
BESIDE = 40  # code points before a candidate that are looked at
REDACTED = "[SECRET]"

#: Words whose neighbourhood speaks for or against a secret, and words that make up identifiers.
FOR = ("token", "secret", "password", "passwd", "pwd", "api", "apikey", "key", "auth", "bearer", "credential", "private", "access")
AGAINST = ("commit", "sha", "sha1", "sha256", "md5", "checksum", "digest", "uuid", "guid", "revision", "version", "etag", "integrity", "hash", "file", "path", "url", "id")
WORDS = (
    "about after again all and any app are array base been before between build byte call change char check class client close code "
    "config connect content context control copy count create data date debug default delete device display document down each "
    "element end error event example false field file find first for form format from function get group handle have header help "
    "host http image import index info init input into item java key last length level library line link list load local log main "
    "make manager map max memory message method min mode model module more name net new next node not null number object off old "
    "only open option order org other out over page parse part path point port position post print process project public query "
    "queue read record request reset response result return run save search select send server service session set show size "
    "some sort source start state static status stop store stream string style sub system table tag task temp test text that the "
    "this thread time title token tool top tree true type under update url use user util value version view what when where width "
    "window with word work write year you"
).split()
#: Signs of assignment, and what may stand before one: a name with a cue word, closing quotes or brackets.
SIGN = re.compile(r"[=:][=>]{0,2}[ \t]{0,8}")
BEARER = re.compile(r"(?i)\bbearer[ \t]{1,8}")
#: The same backwards, as what stands before a sign is read; a cue word ends 40 code points before the name's end at most.
NAMED_BACK = re.compile(r"[ \t]{0,8}[\"'`\])]{0,2}([a-z0-9_.-]*)")
CUE_BACK = re.compile("|".join(f[::-1] for f in FOR))
NAME, TO_END = 64, 40  # code points before a sign that are looked at
VALUE = re.compile(r"[^\s\x00-\x1f\x7f]+")
BARE = re.compile(r"(?:[^\s\x00-\x1f\x7f,;}\"'`&]|&(?![A-Za-z_][A-Za-z0-9_.-]{0,40}=))+")
QUOTES = "\"'`"

FEATURES = ("length", "digits", "upper", "lower", "marks", "moves", "surprise", "entropy", "covered", "hex", "path", "for", "against", "assigned", "quoted", "vowels", "longest_run")
_WORDS = re.compile("|".join(sorted((w for w in WORDS if len(w) > 2), key=len, reverse=True)))
_NEIGHBOUR = re.compile(r"[A-Za-z0-9]+")


def _transitions() -> dict[str, float]:
    """Bits of each pair of characters, in a chain of letters and digits learned from the dictionary."""
    symbols = "abcdefghijklmnopqrstuvwxyz0123456789"
    counts = {a + b: 0.25 for a in symbols for b in symbols}
    for word in WORDS:
        for pair in zip(word, word[1:]):
            counts["".join(pair)] += 1
    totals = {a: sum(counts[a + b] for b in symbols) for a in symbols}
    return {pair: math.log2(totals[pair[0]] / n) for pair, n in counts.items()}


_PAIRS = _transitions()


def features(secret: str, before: str) -> list[float]:
    """What the forest sees of a candidate and the text before it."""
    n, low = len(secret), secret.lower()
    kinds = ["d" if "0" <= c <= "9" else "u" if "A" <= c <= "Z" else "l" if "a" <= c <= "z" else "m" for c in secret]
    share = {k: kinds.count(k) / n for k in "dulm"}
    counts = [secret.count(c) for c in set(secret)]
    beside = [w.lower() for w in _NEIGHBOUR.findall(before)[-4:]]
    tail = before.rstrip(" \"'`")
    bits = [found for a, b in zip(low, low[1:]) if (found := _PAIRS.get(a + b)) is not None]
    run = most = 1
    for a, b in zip(kinds, kinds[1:]):
        run = run + 1 if a == b else 1
        most = max(most, run)
    return [
        n,
        share["d"],
        share["u"],
        share["l"],
        share["m"],
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
        sum(bits) / len(bits) if bits else 0.0,
        -sum(c / n * math.log2(c / n) for c in counts),
        sum(len(w) for w in _WORDS.findall(low)) / n,
        float(all(c in "0123456789abcdef" for c in low)),
        sum(secret.count(c) for c in "/._-") / n,
        float(any(f in w for w in beside for f in FOR)),
        float(any(w in AGAINST for w in beside)),
        float(tail[-1:] in ("=", ":")),
        float(before[-1:] in ('"', "'", "`")),
        sum(low.count(c) for c in "aeiou") / n,
        most,
    ]


@dataclass
class RandomForest:
    """Trees as arrays in heap-less form: feature (-1 at leaves), threshold, the left child (right is next), P(secret)."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, child, p in self.trees:
            node = np.zeros(len(x), np.int64)
            while (inner := feature[node] >= 0).any():
                at = np.flatnonzero(inner)
                k = node[at]
                node[at] = child[k] + (x[at, feature[k]] > cut[k])
            total += p[node]
        return total / len(self.trees)


def train_forest(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 9, seed: int = 17) -> RandomForest:
    """Bootstrap samples, a random choice of features at each split, Gini impurity."""
    rng = np.random.default_rng(seed)
    tries = max(1, int(math.sqrt(x.shape[1])))
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(x), len(x))
        feature, cut, child, p = [-1], [0.0], [0], [float(y[rows].mean())]
        todo = [(0, rows, 0)]
        while todo:
            node, at, level = todo.pop()
            if level == depth or len(at) < 4 or p[node] in (0.0, 1.0):
                continue
            best = None
            for f in rng.permutation(x.shape[1])[: tries + 2]:
                order = at[np.argsort(x[at, f], kind="stable")]
                v, ones = x[order, f], np.cumsum(y[order])
                n = np.arange(1, len(at))
                a = ones[:-1]
                with np.errstate(divide="ignore", invalid="ignore"):
                    gini = a * (n - a) / n + (ones[-1] - a) * (len(at) - n - ones[-1] + a) / (len(at) - n)
                gini[v[1:] <= v[:-1]] = np.inf
                k = int(gini.argmin())
                if np.isfinite(gini[k]) and (best is None or gini[k] < best[0]):
                    best = (gini[k], f, (v[k] + v[k + 1]) / 2)
            if best is None:
                continue
            _, f, at_cut = best
            left = x[at, f] <= at_cut
            feature[node], cut[node], child[node] = int(f), float(at_cut), len(feature)
            for part in (at[left], at[~left]):
                feature.append(-1)
                cut.append(0.0)
                child.append(0)
                p.append(float(y[part].mean()))
                todo.append((len(feature) - 1, part, level + 1))
        out.append((np.array(feature), np.array(cut), np.array(child), np.array(p)))
    return RandomForest(out)


def labelled_findings(each: int = 150, seed: int = 5) -> list[tuple[str, str, int]]:
    """(text before, candidate, 1 for a secret): the training table."""
    r = random.Random(seed)
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    hexa, digits, lower = "0123456789abcdef", "0123456789", "abcdefghijklmnopqrstuvwxyz"
    upper, vowels = lower.upper(), "aeiou"
    base = upper + lower + digits
    marks = ['token = "', "api_key: ", 'secret="', "password = '", "export API_TOKEN=", "Authorization: Bearer ", '"access_key": "', "client_secret=", 'PRIVATE_KEY = "', "auth_token: "]
    plain = ["see ", "the ", "in ", "of ", "and ", "la ", "der ", "for ", "", "> ", "("]
    syllables = [c + v + d for c in "bcdflmnprst" for v in vowels for d in ("n", "r", "", "st", "th", "ti")]
    word = lambda n: "".join(r.choice(syllables) for _ in range(n))
    ident = lambda n, sep: sep.join(r.choice(WORDS) for _ in range(n))
    short = [*marks, "password: ", "passwd=", "pwd=", "DB_PASSWORD=", 'password": "', "secret: ", "&api_key=", "token="]
    blanks = "none null true false required optional changeme yes no string str value text the a is not int Bearer Basic None True False".split()
    mixed = lambda n: "".join(r.sample(pick(upper, 2) + pick(digits, 2) + pick("!?#$%&*@^+~", 2) + pick(base, n - 6), n))
    out: list[tuple[str, str, int]] = []
    for _ in range(each):
        m = lambda: r.choice([*marks, *marks, *plain[:3]])  # noqa: B023,E731
        out += [
            (r.choice(marks), pick(hexa, r.choice((32, 40, 48, 64))), 1),
            (r.choice(marks), pick(base, r.randint(20, 64)), 1),
            (r.choice(marks), pick(base + "+/", r.randint(32, 88)) + "=" * r.randint(0, 2), 1),
            (m(), r.choice(("ghp_", "gho_", "sk_live_", "xoxb-", "glpat-", "AIza")) + pick(base, r.randint(24, 40)), 1),
            (m(), "AKIA" + pick(upper + digits, 16), 1),
            (m(), "eyJ" + pick(base, 20) + "." + pick(base + "_-", 40) + "." + pick(base + "_-", 43), 1),
            (r.choice(("commit ", "sha1: ", "revision ", "commit id ", "etag ")), pick(hexa, 40), 0),
            (r.choice(("sha256:", "checksum ", "md5 = ", "integrity sha256-", "digest: ")), pick(hexa, r.choice((32, 64))), 0),
            (r.choice(("uuid: ", "id = ", "guid ", *plain)), "-".join(pick(hexa, n) for n in (8, 4, 4, 4, 12)), 0),
            (r.choice([*plain, "path = ", "file: ", "import "]), ident(r.randint(3, 6), r.choice(("/", ".", "-", "_"))) + r.choice(("", ".py", ".html", "/2019/01/02")), 0),
            (r.choice([*plain, "key = ", "token: "]), ident(r.randint(3, 5), r.choice(("_", "-", "."))), 0),
            (r.choice(plain), word(r.randint(5, 9)), 0),
            (r.choice(plain), word(r.randint(5, 8)).upper(), 0),
            (r.choice(plain), word(3).capitalize() + "-" + word(3) + "-" + word(3), 0),
            (r.choice([*plain, "id: ", "number ", "token = "]), pick(digits, r.randint(16, 20)), 0),
            (r.choice(plain), r.choice("=-_.") * r.randint(16, 60), 0),
            (r.choice([*marks[:4], *plain]), r.choice("xX*0a") * r.randint(16, 40), 0),
            (r.choice(short), mixed(r.randint(6, 24)), 1),
            (r.choice(short), word(r.randint(1, 2)) + pick(digits, r.randint(1, 4)) + r.choice(("", pick(lower, 2), pick("!?#$%&*@", 1))), 1),
            (r.choice(short), pick(base, r.randint(8, 19)), 1),
            (r.choice(short), r.choice((ident(1, ""), ident(2, "_"), word(r.randint(1, 3)), word(2).capitalize())), 0),
            (r.choice(short), r.choice(blanks), 0),
            (r.choice(short), r.choice((f"${{{ident(2, '_').upper()}}}", f"<{ident(2, '-')}>", f"{{{{{ident(2, '.')}}}}}", f"os.environ[{ident(1, '')}]", f"get_{ident(1, '')}()", f"self.{ident(2, '_')}")), 0),
            (r.choice(short), pick(digits, r.randint(1, 5)), 0),
            (r.choice(short), r.choice("*xX.-#") * r.randint(1, 15), 0),
            (r.choice(plain), "www." + ident(2, "") + ".com/" + ident(3, "/") + "?=" + pick(digits, 4), 0),
        ]
    return out


def minified_findings(each: int = 300, seed: int = 6) -> list[tuple[str, str, int]]:
    """The like for scripts and data without white space, where names with cue words stand before all kinds of values."""
    r = random.Random(seed)
    base = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    names = ("auth", "token", "key", "apiKey", "access", "password", "secret", "isPrivate", "tokens", "keyCode", "author")
    out = []
    for _ in range(each):
        before = pick(base, r.randint(0, 20)) + r.choice(('{"', ',"')) + r.choice(names) + '":'
        code = pick("abcdefgh", 3) + r.choice((",", "{", ";")) + r.choice(names) + r.choice(("=", ":"))
        name = ".".join(r.choice(("e", "t", "n", "this", "window", "props", "state", *WORDS[:40])) for _ in range(r.randint(1, 3)))
        out += [
            (before, r.choice(("false", "true", "null", "[]", "[", "{", "0", "1", "{}")), 0),
            (before, pick("0123456789", r.randint(1, 9)), 0),
            (code, r.choice((name, f"{name}()", f"{name}[0]", f"function({r.choice('etn')}", f"!{r.choice('01')}", f"new {r.choice(WORDS)}".replace(" ", "."), f"{name}||{name}", f"({name})=>{{return", f"{name}?{name}:null")), 0),
            (before + '"', r.choice((r.choice(WORDS), f"{r.choice(WORDS)}-{r.choice(WORDS)}", f"{r.choice(WORDS)}_{r.choice(WORDS)}", r.choice(WORDS).capitalize())), 0),
            (before + '"', pick(base, r.randint(16, 48)), 1),
        ]
    return out


@lru_cache(maxsize=1)
def default_forest() -> RandomForest:
    rows = labelled_findings() + minified_findings()
    return train_forest(np.array([features(s, b) for b, s, _ in rows]), np.array([y for *_, y in rows]))


@dataclass(frozen=True)
class Finding:
    start: int
    end: int
    score: float


def _parts(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """A run, parted behind every inner ``=`` that follows an identifier."""
    out = []
    while m := NAMED.match(text, a, b):
        out.append((a, m.end() - 1))
        a = m.end()
    return [*out, (a, b)]


def _cued(text: str, at: int) -> bool:
    """Whether what stands before a sign is a name with a cue word."""
    name = NAMED_BACK.match(text[max(0, at - NAME) : at].lower()[::-1])[1]
    found = CUE_BACK.search(name)
    return bool(found) and found.start() <= TO_END


def _values(text: str) -> list[tuple[int, int]]:
    """Values behind cue words."""
    signs = [m.span() for m in SIGN.finditer(text) if _cued(text, m.start())]
    if "bearer" in text.lower():
        signs = sorted({*signs, *(m.span() for m in BEARER.finditer(text))})
    out = []
    for (start, a), (limit, _) in zip(signs, [*signs[1:], (len(text), 0)]):
        quote = text[a : a + 1]
        if quote and quote in QUOTES:
            a += 1
            end = text.find(quote, a)  # the next sign with a quote ends this search at the latest
            if end > a and (whole := VALUE.match(text, a, end)) and whole.end() == end:
                out.append((a, end))
                continue
        if not (value := BARE.match(text, a, max(a, limit))):
            continue
        b = value.end()
        if (end := text.find("&", a, b)) > a and text.rfind("?", max(0, start - BESIDE), a) >= 0:
            b = end  # the next field of a query string
        while b > a and text[b - 1] in ".,;:)]}>\"'`":
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans that could be secrets, by start: runs of key-like characters, and values behind cue words."""
    out = set(_values(text))
    for m in CANDIDATE.finditer(text):
        for a, b in _parts(text, *m.span()):
            while a < b and text[a] in TRIM:
                a += 1
            while a < b and text[b - 1] in "-./":
                b -= 1
            if b - a >= 16:
                out.add((a, b))
    return sorted(out)


def scan_text(forest: RandomForest, text: str, threshold: float = 0.5) -> tuple[int, list[Finding]]:
    """Number of candidates, and what the forest takes for secrets; overlapping findings are one."""
    spots = candidates(text)
    if not spots:
        return 0, []
    seen = [(text[a:b], text[max(0, a - BESIDE) : a]) for a, b in spots]
    kinds = {pair: i for i, pair in enumerate(dict.fromkeys(seen))}
    scores = forest.predict(np.array([features(*pair) for pair in kinds]))[[kinds[pair] for pair in seen]]
    out: list[Finding] = []
    for (a, b), score in zip(spots, scores.tolist()):
        if score >= threshold:
            if out and a < out[-1].end:
                a, b, score = out[-1].start, max(b, out[-1].end), max(score, out.pop().score)
            out.append(Finding(a, b, score))
    return len(spots), out


def scan(documents: DataFrame, forest: RandomForest | None = None, threshold: float = 0.5) -> DataFrame:
    """``doc_id, n_candidates, n_secrets, spans, max_score`` for every row."""
    shared = documents.sparkSession.sparkContext.broadcast(forest or default_forest())
    types = dict(documents.dtypes)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [scan_text(shared.value, t, threshold) for t in texts_of(batch)]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([n for n, _ in found], pa.int64()),
                pa.array([len(f) for _, f in found], pa.int64()),
                pa.array([",".join(f"secret:{x.start}:{x.end}" for x in f) for _, f in found]),
                pa.array([max((x.score for x in f), default=0.0) for _, f in found], pa.float64()),
            ],
            ["doc_id", "n_candidates", "n_secrets", "spans", "max_score"],
        )

    return map_batches(documents.select("doc_id", "text"), run, f"doc_id {types['doc_id']}, n_candidates long, n_secrets long, spans string, max_score double")


def redact(documents: DataFrame, forest: RandomForest | None = None, threshold: float = 0.5) -> DataFrame:
    """The documents with every secret in ``text`` replaced; all other columns stay, but ``n_chars`` follows the text."""
    shared = documents.sparkSession.sparkContext.broadcast(forest or default_forest())
    at = documents.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text in batch.column(at).to_pylist():
            for x in reversed(scan_text(shared.value, text, threshold)[1] if text else []):
                text = text[: x.start] + REDACTED + text[x.end :]
            out.append(text)
        return batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    found = map_batches(documents, run, documents.schema)
    return found.withColumn("n_chars", F.length("text").cast(dict(documents.dtypes)["n_chars"])) if "n_chars" in documents.columns else found


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
