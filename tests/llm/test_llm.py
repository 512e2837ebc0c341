"""The training-data operators against brute force, and on tables of edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.llm import catalog, components, embedding_join, language_id, licenses, packing, pii, quality_crf, quality_rules, secrets, simhash, word_bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k0 string, fp string"
WORDS = "the of red fish blue house and runs over hill dale wood".split()


def sentence(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def edge_texts():
    r = random.Random(8)
    long = sentence(r, 4000)
    return [
        None, "", " \t\n", "a", "one two three", long, long, long + " end", sentence(r, 30), "\n".join([sentence(r, 12)] * 6), "x" * 5000, "1 " * 3000,
        "Licensed under the Apache License, Version 2.0. mit\nlicense", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" mail bob.1@ex.com +1 (743) 555-3824 10.0.0.256 10.0.0.1',
        "漢字 und <|endoftext|> naïve İ", "###$$$ %%% &&& *** " * 20, "1234 5678", "日本語の文章です。",
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}", 0, "x", "y") for i, t in enumerate(edge_texts())]
    rows += [rows[5], (None, "a null id", "en", None, None, None, None), (99, sentence(random.Random(1), 40), None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_rules_against_brute_force(docs, none):
    got = {r.text: r for r in quality_rules.judge(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()}
    for text, r in got.items():
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n = Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
    assert quality_rules.judge(docs).count() == docs.count() and quality_rules.judge(none).count() == 0


def test_label_model_against_truth():
    """Votes drawn with known accuracies: the estimates come near them, and beat the all-must-pass filter."""
    r = random.Random(16)
    accuracy = [(0.99, 0.3), (0.97, 0.4), (0.98, 0.2), (0.9, 0.5), (0.99, 0.6)]
    drawn = []
    for _ in range(20_000):
        good = r.random() < 0.8
        drawn.append((good, tuple(0 if r.random() < 0.1 else 1 if r.random() < (a if good else b) else -1 for a, b in accuracy)))
    prior, rates = quality_rules.estimate(sorted(Counter(v for _, v in drawn).items()))
    assert abs(prior - 0.8) < 0.02 and all(abs(x - y) < 0.04 for pair in zip(rates, accuracy) for x, y in zip(*pair))
    kept = [quality_rules.posterior(v, prior, rates) >= 0.5 for _, v in drawn]
    right = np.mean([k == g for k, (g, _) in zip(kept, drawn)])
    assert right > 0.95 > np.mean([(min(v) >= 0) == g for g, v in drawn])
    assert quality_rules.estimate([]) == (0.5, [])


def test_kept_against_labels_and_brute_force(spark):
    """Documents with a bad vote can be kept, good ones are, bad ones go; ``kept`` follows from votes and estimates."""
    sf = "/root/testdata/sf0.01"
    rows = quality_rules.judge(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left").collect()
    names = [c for c in rows[0].asDict() if c.startswith("v_")]
    votes = [tuple(r[c] for c in names) for r in rows]
    prior, rates = quality_rules.estimate(sorted(Counter(votes).items()))
    for r, v in zip(rows, votes):
        odds = prior / (1 - prior)
        for x, (a, b) in zip(v, rates):
            odds *= a / b if x > 0 else (1 - a) / (1 - b) if x < 0 else 1
        assert r.kept == (not r.base_failed and odds >= 1) and abs(r.posterior - odds / (1 + odds)) < 1e-9
    assert sum(r.kept and min(v) < 0 for r, v in zip(rows, votes)) > 5
    passed = [r for r in rows if not r.base_failed]
    assert np.mean([r.kept for r in passed if r.quality == 1]) > 0.99 and np.mean([r.kept for r in passed if r.quality == 0]) < 0.1


def test_range_join_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_join, "HOME", 40)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 8))
    x = np.concatenate([base + rng.normal(size=base.shape) * s for s in (0, 0, 0.15, 0.25, 0.4)])
    rows = [(i, [float(v) for v in row], 1) for i, row in enumerate(x)]
    rows += [(900, None, 1), (901, [0.0] * 8, 1), (902, [1.0, None] + [0.0] * 6, 1), (903, [float("nan")] * 8, 1), (904, [1.0, 2.0], 1), (905, [], 1), (906, [float("inf")] * 8, 1), (None, [1.0] * 8, 1)]
    got = {r.vec_id: r for r in embedding_join.join(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert len(got) == len(rows)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.minimum(label, [label[a].min() if a.any() else 10**9 for a in near])
    assert [got[i].n_links for i in range(len(x))] == near.sum(1).tolist()
    assert [got[i].component_id for i in range(len(x))] == label.tolist()
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(900, 907))
    assert embedding_join.join(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_range_join_visits_lose_nothing():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pivots, r = x[:16], np.sqrt(0.2)
    d = embedding_join._distances(x, pivots)
    radii = np.array([d[d.argmin(1) == p, p].max(initial=0) for p in range(16)])
    home, other = embedding_join.visits(x, pivots, radii, r)
    seen = {(i, int(c)) for i, c in enumerate(home)} | {tuple(v) for v in other.tolist()}
    a, b = np.nonzero(x @ x.T >= 0.9)
    # of a pair in two cells, the vector of the later cell visits
    assert all((int(j), int(home[i])) in seen for i, j in zip(a, b) if home[i] <= home[j]) and len(seen) < 300 * 16


@pytest.mark.parametrize("limit", [("HOME", 30), ("HOME_VALUES", 60)])
def test_range_join_in_cells_parts_and_blocks(spark, monkeypatch, limit):
    """Many pivots, parts (by vectors and by components) and blocks; near pairs at the threshold; copies; lengths mixed; ids repeated; names that clash."""
    for name, value in (limit, ("ROWS", 7), ("COLUMNS", 9)):
        monkeypatch.setattr(embedding_join, name, value)
    monkeypatch.setattr(embedding_join, "_choose", lambda sample, count, r: sample[: max(1, min(16, len(sample) // 4))])
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 3))
    x = np.concatenate([base, base[:20], base + rng.normal(size=base.shape) * 0.2]).astype(np.float32)
    flat = [[float(v) for v in row] for row in x] + [[float(v) for v in row[:2]] for row in x[:70]]
    rows = [(i, v, 1, "a", 2.0, "b", 3) for i, v in enumerate(flat)]
    rows += [(7, [1.0, 0.0, 0.0], 1, "a", 2.0, "b", 3), (7, [1.0, 0.01, 0.0], 1, "a", 2.0, "b", 3)]
    frame = spark.createDataFrame(rows, "vec_id int, embedding array<float>, id int, v string, h double, cell string, n int").repartition(4)
    got = defaultdict(list)
    for r in embedding_join.join(frame).collect():
        got[r.vec_id].append(r)
    units = [np.array(r[1], np.float32).astype(float) for r in rows]
    units = [u / np.linalg.norm(u) for u in units]
    near = [[k for k, w in enumerate(units) if k != i and len(w) == len(u) and u @ w >= 0.9] for i, u in enumerate(units)]
    assert sorted(r.n_links for r in got[7]) == sorted(len(near[i]) for i in range(len(rows)) if rows[i][0] == 7)
    label = [r[0] for r in rows]
    for _ in rows:
        label = [min([label[i], *[label[k] for k in near[i]]]) for i in range(len(rows))]
        label = [min(label[k] for k in range(len(rows)) if rows[k][0] == rows[i][0]) if rows[i][0] == 7 else label[i] for i in range(len(rows))]
    assert all(r.component_id == label[i] for i in range(len(rows)) for r in got[rows[i][0]])
    assert all(got[i][0].n_links == len(near[i]) for i in range(len(flat)) if i != 7)


def test_pairs_at_the_threshold_are_settled_in_double():
    rng = np.random.default_rng(7)
    a = rng.normal(size=(200, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(200, 64))
    b -= (b * a).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = 0.9 + rng.choice([-1e-7, 1e-7, -1e-10, 1e-10], (200, 1))
    x = np.concatenate([a, c * a + np.sqrt(1 - c * c) * b])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    counts, root = embedding_join.link_counts(x, np.ones(400, np.int64), np.ones(400, bool), 0.9)
    assert (counts[:200] == (c[:, 0] > 0.9)).all() and (root[200:] == np.where(c[:, 0] > 0.9, np.arange(200), np.arange(200, 400))).all()


def test_licenses_against_brute_force(docs, none):
    for r in licenses.scan(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [i for p, _ in licenses.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at, default=None), max(at, default=None))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert licenses.scan(none).count() == 0


def test_licenses_by_offsets(spark):
    """Every notice of a text of many licences counts in full, and labels are those of phrases at their places."""
    notices = [t.text for t in licenses.TEMPLATES]
    phrases = [k for t in licenses.TEMPLATES for k in t.keys]
    r = random.Random(12)
    texts = ["x y z ".join(n + " " for n in notices), "license public gnu general. license mit; apache the license"]
    texts += [" ".join(r.choice([*phrases, *notices, "gnu", "license", "by", "cc", "mit", "x"]) for _ in range(6)) for _ in range(60)] + phrases
    got = {x.doc_id: x for x in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert list(got[0].templates) == list(range(len(notices))) and abs(got[0].score - 1) < 1e-9
    for i, text in enumerate(texts):
        plain = " ".join(re.findall("[0-9a-z]+", text))
        want = {t.label for t in licenses.TEMPLATES if any(f" {k} " in f" {plain} " for k in t.keys)} | {v for p, v in licenses.BASE if f" {p} " in f" {plain} "}
        assert set(got[i].labels.split(",")) == (want or {""})


def test_language_id(spark, docs, none, monkeypatch):
    r = random.Random(2)
    german = "der und die haus berg wald nicht schön".split()
    rows = [(i, sentence(r, 60) if i % 2 else " ".join(r.choice(german) for _ in range(60)), "en" if i % 2 else "de", "s", 0, "", "") for i in range(120)]
    table = spark.createDataFrame(rows, SCHEMA)
    model = language_id.fit(table)
    got = {x.doc_id: x for x in language_id.identify(table, model).collect()}
    assert all(got[row[0]].lang_pred == row[2] for row in rows)
    found = {x.doc_id: x for x in language_id.identify(docs, model).collect()}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (0, 1, 2, 11, 15, 16)) and found[17].lang_pred in ("de", "en")
    assert language_id.fit(none) is None and language_id.identify(docs, None).where("lang_pred <> 'und'").count() == 0
    # Every row of the compiled trees is a distribution.
    count = len(model.below)
    p = np.exp2(-model.costs(np.repeat(np.arange(count), model.alphabet), np.tile(np.arange(model.alphabet), count)).astype(float)).reshape(count, model.alphabet, -1)
    p[:, 0] *= 256 - (model.alphabet - 1)
    assert np.abs(p.sum(1) - 1).max() < 1e-3
    long = (sentence(r, 200_000)).encode()
    assert np.allclose(language_id.code_lengths(model, [long]), sum(language_id.code_lengths(model, [long])), rtol=1e-9)
    wide = ("дом 家 " * 60_000 + sentence(r, 10)).encode()  # over a slice, which may cut a character
    monkeypatch.setattr(language_id, "SLICE", 1 << 30)
    whole = language_id.code_lengths(model, [wide])
    monkeypatch.setattr(language_id, "SLICE", 1001)
    assert np.allclose(whole, language_id.code_lengths(model, [wide]), rtol=1e-6)
    assert {k: v for k, v in zip(*(x.tolist() for x in language_id.grams([wide[:9000]])))} == Counter(int.from_bytes((b"\0\0\0" + wide)[i : i + 4], "big") for i in range(9000))


def brute_code_length(samples, text, least):
    """Bits of ``text`` under one tree, by recursion over orders with exclusion; symbols are bytes, ``None`` any unseen one."""
    symbols = sorted({0} | {b for t in samples for b in t}) + [None]
    counts = [defaultdict(Counter) for _ in range(4)]
    for t in samples:
        padded = b"\0\0\0" + t
        for i in range(3, len(padded)):
            for k in range(4):
                counts[k][padded[i - k : i]][padded[i]] += 1

    def distribution(context):
        k = len(context)
        below = distribution(context[1:]) if k else {s: 1 / len(symbols) for s in symbols}
        seen = counts[k][context]
        total = sum(seen.values())
        if total == 0 or (k and total < least):
            return below
        left = 1 - sum(below[s] for s in seen)
        d = len(seen) if left > 1e-12 and len(seen) < len(symbols) else 0
        return {s: seen[s] / (total + d) if s in seen else d / (total + d) * below[s] / left if d else 1e-12 for s in symbols}

    padded, bits = b"\0\0\0" + text, 0.0
    for i in range(3, len(padded)):
        p = distribution(bytes(padded[i - 3 : i]))
        bits -= np.log2(p[padded[i]]) if padded[i] in p else np.log2(p[None] / (257 - len(symbols)))
    return bits


def test_code_lengths_against_brute_force(spark):
    r = random.Random(14)
    texts = [sentence(r, 30), "дом на горе " * 6, "το σπίτι " * 5, "家在山上。" * 4, "zß🙂 " + sentence(r, 5)]
    samples = [t.encode() for t in texts]
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate([t for t in texts for _ in range(3)])], "doc_id long, text string, lang string")
    kept = [t.encode() for i, t in enumerate([t for t in texts for _ in range(3)]) if zlib.crc32(str(i).encode()) % 5]
    model = language_id.fit(table, language_id.PpmParams(docs_per_language=1000))
    assert model.alphabet == len({b for t in kept for b in t}) + 2
    new = ["the house 家 on ß", "ÿ\x01 дом", "", "a"]
    got = language_id.code_lengths(model, [t.encode() for t in new])[:, 0]
    assert np.allclose(got, [brute_code_length(kept, t.encode(), 6) for t in new], rtol=1e-4) and samples


def test_languages_of_long_documents_only(spark):
    """A language all of whose texts are long is learned, from whole texts."""
    r = random.Random(15)
    rows = [(i, sentence(r, 25_000) if i % 2 else "дом на горе и лес у реки " * 4000, "en" if i % 2 else "ru") for i in range(12)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(table)
    assert model.languages == ["en", "ru"]
    assert all(x.lang_pred == rows[x.doc_id][2] for x in language_id.identify(table, model).collect())
    x, n = language_id.grams([b"abcab", b"", b"abc"])
    want = Counter(g for t in (b"abcab", b"abc") for g in [int.from_bytes((b"\0\0\0" + t)[i : i + 4], "big") for i in range(len(t))])
    assert dict(zip(x.tolist(), n.tolist())) == want


def test_many_scripts_keep_all_contexts(monkeypatch):
    """Sixteen languages in eight scripts: no context that is frequent enough is left out, tables stay small, and searching
    pairs gives what indexing them gives."""
    r = random.Random(33)
    scripts = [(0x61, 26), (0x3B1, 24), (0x430, 32), (0x5D0, 27), (0x627, 28), (0x905, 50), (0x3042, 80), (0x4E00, 1500)]
    texts: list[tuple[int, bytes]] = []
    for k in range(16):
        low, size = scripts[k // 2]
        words = ["".join(chr(low + r.randrange(size)) for _ in range(r.randint(2, 6))) for _ in range(300)]
        texts += [(k, " ".join(r.choice(words) for _ in range(200)).encode()) for _ in range(40)]
    counts: Counter = Counter()
    for k, t in texts:
        for gram, n in zip(*(x.tolist() for x in language_id.grams([t]))):
            for o in range(4):
                counts[o, k, gram & ((1 << 8 * (o + 1)) - 1)] += n
    order, lang, gram, n = (np.array(x) for x in zip(*((o, k, g, c) for (o, k, g), c in counts.items())))
    model = language_id.compile_trees([f"l{k}" for k in range(16)], order, lang, gram, n)
    totals = Counter()
    for (o, _, g), c in counts.items():
        totals[o, g >> 8] += c
    assert len(model.below) == 1 + sum(o > 0 and c >= 6 for (o, _), c in totals.items()) > 10_000
    assert model.bits.nbytes + model.offset.nbytes + model.symbols.nbytes + model.rows.nbytes + (model.index.nbytes if model.index is not None else 0) < 160 << 20
    new = [t for _, t in texts[::40]]
    found = language_id.code_lengths(model, new)
    assert found.argmin(1).tolist() == list(range(16))
    monkeypatch.setattr(language_id, "INDEX_CELLS", 0 if model.index is not None else 1 << 40)
    again = language_id.compile_trees([f"l{k}" for k in range(16)], order, lang, gram, n)
    assert (again.index is None) != (model.index is None) and np.allclose(language_id.code_lengths(again, new), found, rtol=1e-9)


def test_pii_against_patterns(docs, none):
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    r = random.Random(6)
    texts = [t or "" for t in edge_texts()] + ["".join(r.choice("ab@. 12345+-()%") for _ in range(50)) for _ in range(2000)]
    for text in texts:
        want = [("email", *m.span()) for m in email.finditer(text)] + [("ip", *m.span()) for m in ip.finditer(text) if pii._is_ip(m.group())]
        want += [("card", *m.span()) for m in pii.CARD.finditer(text) if pii._is_card(m.group())] + [("phone", *m.span()) for m in pii.PHONE.finditer(text) if pii._is_phone(m.group())]
        assert pii.base_spans(text) == want
    model = pii.default_model()
    table = pii.labelled_table(10, seed=44)
    tags = pii.viterbi(model, [pii.token_features(t) for t, _ in table])
    assert np.mean([a == b for x, (_, y) in zip(tags, table) for a, b in zip(x, y)]) > 0.97
    for base, spans in pii.find(model, texts):
        assert set(base) <= set(spans)
    assert pii.scan(docs, model).count() == docs.count() and pii.scan(none, model).count() == 0


def test_viterbi_against_brute_force(monkeypatch):
    """The best of all label sequences; and long chains in parts give what they give whole."""
    from itertools import product

    r = np.random.default_rng(18)
    moves = r.normal(size=(6, 6))
    for n in (1, 2, 4):
        scores = r.normal(size=(n, 6))
        best = max(product(range(6), repeat=n), key=lambda y: sum(scores[i, k] for i, k in enumerate(y)) + sum(moves[a, b] for a, b in zip(y, y[1:])))
        assert tuple(pii.decode(moves, [scores])[0]) == best == tuple(pii.decode_long(moves, iter(np.split(scores, range(1, n)))))
    assert (pii.decode(moves, [np.zeros((5, 6))])[0] == pii.decode_long(moves, iter([np.zeros((5, 6))]))).all()
    model, q = pii.default_model(), random.Random(19)
    words = "call +1 (743) 555 3824 ann at example dot com 12 7 ssn 078-05-1120 email b.1@ex.org the of version 1.2.3 card".split()
    texts = [" ".join(q.choice(words) for _ in range(n)) for n in (3, 40, 700, 2500)] + ["\u00e9 5 " * 300]
    for text in texts[:3]:
        scorer = pii.Scorer(model)
        for starts, ends in pii._chains(text):
            tokens = pii._words(text, starts, ends)
            want = np.stack([model.weights[f].sum(0) for f in pii.token_features(tokens)])
            assert np.allclose(scorer.scores(tokens), want) and np.allclose(scorer.many([tokens[:5], tokens])[1], want)
    whole = pii.find(model, texts)
    monkeypatch.setattr(pii, "TOGETHER", 11)
    assert pii.find(model, texts) == whole


def test_digits_without_end():
    """A long text of single digits takes a few bytes a token, and the spans after them are found."""
    import tracemalloc

    model = pii.default_model()
    text = "7 " * 100_000 + "mail ann@example.org now"
    tracemalloc.start()
    (base, spans), = pii.find(model, [text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [k for k, _, _ in base] == ["email"] and base[0] in spans and peak < 12 << 20


def test_addresses_in_words():
    model = pii.default_model()
    for text, want in (
        ("please write to ann at example dot com or call", "ann at example dot com"),
        ("contact bob [at] mail [dot] org", "bob [at] mail [dot] org"),
        ("the fee of carol(at)uni(dot)edu was", "carol(at)uni(dot)edu"),
    ):
        assert [(k, text[a:b]) for k, a, b in pii.find(model, [text])[0][1]] == [("email", want)]
    for text in ("they look at the house and the river", "we met ann at noon", "a dot on the map of the city", "write to ann at home"):
        assert pii.find(model, [text]) == [([], [])]


def test_secrets(docs, none):
    forest = secrets.default_forest()
    held = secrets.labelled_findings(30, seed=71)
    p = forest.predict(np.array([secrets.features(s, b) for b, s, _ in held])) >= 0.5
    assert (p == np.array([y for *_, y in held])).mean() > 0.97
    found = {r.doc_id: r for r in secrets.scan(docs, forest).collect()}
    assert found[13].n_secrets == 1 and found[0].n_secrets == 0 and found[10].n_secrets == 0
    clean = {r.doc_id: r.text for r in secrets.redact(docs, forest).collect()}
    assert "24be64439e" not in clean[13] and secrets.REDACTED in clean[13] and clean[8] == edge_texts()[8] and clean[0] is None
    assert secrets.redact(docs, forest).columns == docs.columns and secrets.scan(none, forest).count() == 0


def test_forest_against_plain_trees(docs):
    """Prediction equals a walk down every tree; transitions tell words from keys; edge cases of candidates."""
    forest = secrets.default_forest()
    rows = [secrets.features(s, b) for b, s, _ in secrets.labelled_findings(5, seed=73)]

    def walk(tree, x):
        feature, cut, child, p = tree
        node = 0
        while feature[node] >= 0:
            node = child[node] + (x[feature[node]] > cut[node])
        return p[node]

    want = [np.mean([walk(t, x) for t in forest.trees]) for x in rows]
    assert np.allclose(forest.predict(np.array(rows)), want)
    at = secrets.FEATURES.index("surprise")
    assert len(rows[0]) == len(secrets.FEATURES) and secrets.features("configuration_manager", "")[at] < secrets.features("q7zx9kv3wq8jx2p", "")[at]
    key = "A1b2" * 20_000  # a very long run is one candidate; equal rows get equal findings; a tie is a finding
    assert secrets.candidates("x " + key) == [(2, 2 + len(key))] and secrets.candidates("") == [] and secrets.candidates("=" * 40) == []
    n, found = secrets.scan_text(forest, 'token = "f3a9c17be2d04586a1b7c9d3e5f60718293a4b5c"', 0.0)
    assert n and found and secrets.scan_text(forest, 'token = "f3a9c17be2d04586a1b7c9d3e5f60718293a4b5c"', found[0].score)[1] == found
    twice = [r for r in secrets.scan(docs, forest).collect() if r.doc_id == 5]
    assert len(twice) == 2 and twice[0] == twice[1]


def test_secrets_behind_names():
    forest = secrets.default_forest()
    secret = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    for text, value in (
        ('password = "hunter2x9"', "hunter2x9"),
        ('the password = "Zk7!qT#9vW" is old', "Zk7!qT#9vW"),
        (f"export API_TOKEN={secret}", secret),
        (f"https://a.org/x?client_secret={secret}&page=2", secret),
    ):
        assert [text[f.start : f.end] for f in secrets.scan_text(forest, text)[1]] == [value]
    for text in ("password = None", "the key: word", "token = get_token()", "password: required"):
        assert secrets.scan_text(forest, text)[1] == []
    # Most labelled secrets are found from whole texts, and few of the others are.
    hits = {0: [], 1: []}
    for before, value, y in secrets.labelled_findings(20, seed=72):
        found = secrets.scan_text(forest, before + value)[1]
        hits[y].append(any((f.start, f.end) == (len(before), len(before) + len(value)) for f in found) if y else bool(found))
    assert np.mean(hits[1]) > 0.93 and np.mean(hits[0]) < 0.07


def brute_fingerprint(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_fingerprints(docs, none):
    for r in simhash.fingerprints(docs, ["text"]).collect():
        assert r.fp % (1 << 64) == brute_fingerprint(r.text)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got[5] == got[6] == 5 and got[1] == got[2] == 0
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("blocks,chosen,own_levels", [(5, 1, 13), (1, 1, 13), (4, 1, 13), (6, 2, 13), (5, 1, 2), (6, 2, 0)])
def test_vantage_point_trees_lose_nothing(spark, blocks, chosen, own_levels):
    r = np.random.default_rng(blocks)
    base = r.integers(0, 1 << 63, 150, dtype=np.uint64)
    near = base.copy()
    for _ in range(4):
        near ^= np.uint64(1) << r.integers(0, 64, len(base), dtype=np.uint64)
    points = np.unique(np.concatenate([base, near, base ^ np.uint64(1)]))
    table = spark.createDataFrame([(int(v), i) for i, v in enumerate(points.view(np.int64))], "fp long, id long")
    links = simhash.near_links(table, 4, simhash.Forest(4, blocks, chosen), leaf=8, hot=16, own_levels=own_levels)
    got = {x.id: x.component for x in components.components(links).collect()}
    label = np.arange(len(points))
    close = np.array([np.bitwise_count(points ^ p) <= 4 for p in points])
    for _ in range(len(points)):
        label = np.array([label[c].min() for c in close])
    assert [got.get(i, i) for i in range(len(points))] == label.tolist()


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 130)], "a long, b long")
    got = {r.id: r.component for r in components.components(links).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(100, 130)} == {100}


def check_pieces(rows, ids):
    fill, spans = defaultdict(list), defaultdict(list)
    for r in rows:
        fill[r.sequence_id].append((r.offset, r.length))
        spans[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for at in fill.values():
        end = 0
        for offset, n in sorted(at):
            assert offset == end and n > 0
            end += n
        assert end <= 1024
    for doc, want in ids.items():
        end = 0
        for start, n, crc, total in sorted(spans[doc]):
            assert start == end and total == len(want)
            assert crc == zlib.crc32(np.array(want[start : start + n], "<u4").tobytes())
            end += n
        assert end == len(want)
    assert sum(sum(n for _, n in a) for a in fill.values()) > 1024 * (len(fill) - 1)


def test_packing(spark, docs, none):
    bpe = packing.byte_bpe(public_tokenizers.path("byte_bpe_50k.json"))
    once = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).cache()
    ids = {r.doc_id: [*bpe.tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0] for r in once.collect()}
    check_pieces(packing.pack(once).collect(), ids)
    check_pieces(packing.pack(once, packing.PackParams(window=2048, weights={"s0": 0.7, "s1": 0.2}, max_queues=3)).collect(), ids)
    assert packing.pack(none).count() == 0
    # Repeated rows and rows without an id are packed each for itself.
    all_ids = [len(bpe.tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect()]
    got = packing.pack(docs).collect()
    assert sum(r.length for r in got) == sum(all_ids) and Counter(r.doc_tokens for r in got if r.start == 0) == Counter(all_ids)
    assert {(r.sequence_id * 1024 + r.offset + i) for r in got for i in range(r.length)} == set(range(sum(all_ids)))


def test_schedule_keeps_the_mixture():
    totals = np.array([50_000, 30_000, 20_000])
    plan = packing.Schedule(totals, totals / totals.sum(), 4096)
    sent = np.diff(plan.after(np.arange(plan.windows)), axis=0)
    assert np.abs(sent / 4096 - totals / totals.sum()).max() < 1e-3


@pytest.mark.parametrize("weights", [{}, {"b": 0.5, "s7": 0.4, "s8": 0.1}])
def test_sources_beyond_the_queues_keep_their_shares(spark, weights, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 3)
    """Three sources of like size lie one after another beyond the cap; no window may hold one of them alone."""
    bpe = packing.byte_bpe(public_tokenizers.path("byte_bpe_50k.json"))
    names = ["b"] * 160 + ["s7"] * 100 + ["s8"] * 100 + [None] * 100
    rows = [(i, "a house on a hill by the river " * 12, "en", s, 0, "", "") for i, s in enumerate(names)]
    table = spark.createDataFrame(rows, SCHEMA)
    ids = {i: [*bpe.tokenizer.encode(row[1], add_special_tokens=False).ids, 0] for i, row in enumerate(rows)}
    got = packing.pack(table, packing.PackParams(window=4096, weights=weights, max_queues=2)).collect()
    check_pieces(got, ids)
    sent = Counter()
    for r in got:
        if r.sequence_id < 8:  # the first two windows
            sent[names[r.doc_id]] += r.length
    want = weights or {s: n / len(names) for s, n in Counter(names).items()}
    assert all(abs(sent[s] - 8192 * w) <= 300 for s, w in want.items())


def test_automaton_equals_the_library(docs, none):
    from tokenizers import Tokenizer

    path = word_bpe.default_path()
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    bpe, r = word_bpe.word_bpe(path), random.Random(3)
    texts = [t or "" for t in edge_texts()] + ["".join(r.choice("etaoin shrdlu'1é½²<|>漢İ\n\x85") for _ in range(60)) for _ in range(1500)]
    for text, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        ids, labels = bpe.encode(text)
        assert ids == np.array(e.ids, "<u4").tobytes() and labels == library.decode(e.ids, skip_special_tokens=False) == bpe.decode(e.ids)
    long = "漢字 naïve house\n" * 75_000  # over a slice of a million characters
    assert bpe.encode(long)[0] == np.array(library.encode(long, add_special_tokens=False).ids, "<u4").tobytes()
    row = next(r for r in word_bpe.digests(docs).collect() if r.doc_id == 0)
    assert row.n_tokens == 0 and row.ids_sha256 == hashlib.sha256(b"").hexdigest() == row.decoded_sha256
    assert word_bpe.digests(none).count() == 0


def test_long_digit_runs_and_thresholds(spark):
    long = "1" * 5000 + ".2.3.4 " + "0" * 5000 + "7.2.3.4"
    assert [(k, b - a) for k, a, b in pii.base_spans(long)] == [("ip", 5007)]
    one = spark.createDataFrame([(1, 'token = "f3a9c17be2d04586a1b7c9d3e5f60718293a4b5c"')], "doc_id long, text string")
    assert "[SECRET]" in secrets.redact(one).first().text and "[SECRET]" not in secrets.redact(one, threshold=1.1).first().text


def test_quality_classifier(spark, docs, none):
    r = random.Random(9)
    texts = ["\n".join(sentence(r, 14).capitalize() + "." for _ in range(r.randint(1, 6))) for _ in range(150)]
    texts += ["\n".join(" ".join(w + "###" for w in sentence(r, 14).split()) for _ in range(r.randint(1, 6))) for _ in range(150)]
    labels = [1] * 150 + [0] * 150
    model = quality_crf.train(texts[::2], labels[::2])
    assert np.mean([(quality_crf.score_text(model, t) >= 0.3) == y for t, y in zip(texts[1::2], labels[1::2])]) > 0.97
    # The two-sweep marginals equal those of the general recursion.
    active, _ = quality_crf.line_features("\n".join([texts[0], texts[200], "", texts[3]]))
    scores = quality_crf.emissions(model.weights, active)
    good, _, _ = quality_crf.marginals(scores[None], np.ones((1, len(scores)), bool), model.moves)
    assert np.allclose(good[0], quality_crf.chain_marginals(scores, model.moves))
    got = quality_crf.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= x.score <= 1 for x in got) and quality_crf.score(none, model).count() == 0
    assert quality_crf.score(docs, None).where("score <> 0.5").count() == 0


def test_lines_of_mixed_documents():
    """Documents of good and of bad stretches get lines of both kinds, also where training holds mixed documents; and very long
    documents are learned from."""
    r = random.Random(20)
    good = lambda: sentence(r, 14).capitalize() + "."
    bad = lambda: " ".join(w.upper() + "###!!" for w in sentence(r, 14).split())
    texts = ["\n".join(good() for _ in range(r.randint(2, 9))) for _ in range(60)] + ["\n".join(bad() for _ in range(r.randint(2, 9))) for _ in range(60)]
    texts += ["\n".join([bad() for _ in range(6)] + [good() for _ in range(2)]) for _ in range(20)]
    model = quality_crf.train(texts, [1] * 60 + [0] * 80)
    p = quality_crf.line_marginals(model, "\n".join([good() for _ in range(5)] + [bad() for _ in range(5)] + [good() for _ in range(5)]))
    assert p[:4].min() > 0.5 and p[6:9].max() < 0.5 and p[11:].min() > 0.5
    long = quality_crf.train(["\n".join(good() for _ in range(3000)), "\n".join(bad() for _ in range(3000))], [1, 0])
    assert quality_crf.score_text(long, good()) > 0.7 and quality_crf.score_text(long, bad()) < 0.3
    # Over many lines the sums of both recursions agree with the enumeration of all labellings of a short text.
    scores, moves = np.array([0.3, -1.0, 0.7]), np.array([[0.5, -0.2], [0.1, 0.4]])
    weight = {y: np.exp(sum(s * k for s, k in zip(scores, y)) + sum(moves[a, b] for a, b in zip(y, y[1:]))) for y in np.ndindex(2, 2, 2)}
    want = [sum(w for y, w in weight.items() if y[i]) / sum(weight.values()) for i in range(3)]
    assert np.allclose(quality_crf.chain_marginals(scores, moves), want)


def test_classifier_learns_from_long_documents_only(spark):
    r = random.Random(21)
    rows = [(i, "\n".join((sentence(r, 12) + "." if i % 2 else "### $$$ " * 9) for _ in range(700))) for i in range(16)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality_crf.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(16)], "doc_id long, quality int"))
    assert min(len(t) for _, t in rows) > 1 << 15
    assert all((x.score >= 0.3) == x.doc_id % 2 for x in quality_crf.score(docs, model).collect())


def test_pipeline(spark):
    """Every stage keeps what its operator, applied to its own input, says; the last packs all that is left."""
    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.001"
    rows = pipeline.run(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        before, docs = {r.doc_id: r for r in docs.collect()}, stage(spark, docs, sf).cache()
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and set(after) <= set(before), name
        if name == "simhash_dedup":
            prints = {i: brute_fingerprint(r.text) for i, r in before.items()}
            label = {i: i for i in prints}
            for _ in range(8):
                label = {i: min(label[k] for k, q in prints.items() if (p ^ q).bit_count() <= 4) for i, p in prints.items()}
            assert set(after) == set(label.values())
        elif name == "secret_scans":
            forest = secrets.default_forest()
            assert set(after) == set(before) and all((secrets.REDACTED in (r.text or "")) == bool(secrets.scan_text(forest, before[i].text or "")[1]) for i, r in after.items())
        else:
            assert all(after[i] == before[i] for i in after)
    bpe = packing.byte_bpe(public_tokenizers.path("byte_bpe_50k.json"))
    check_pieces(rows, {r.doc_id: [*bpe.tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.collect()})
    assert sorted(int(name[2:].split("_")[0]) for name in catalog.QUERIES) == list(range(1, 14))


def test_pipeline_stages_on_edge_cases(spark, docs, none, monkeypatch):
    """Null and empty texts, null ids, repeated rows, further columns of clashing names, no documents; both ways of dropping."""
    import corpus_pipeline as pipeline

    sf, whole = "/root/testdata/sf0.001", docs.collect()
    many = docs.unionByName(docs.sparkSession.createDataFrame([(200 + i, sentence(random.Random(i), 60), "en", "s", 0, "k", "f") for i in range(40)], SCHEMA))
    languages = pipeline.by_language(spark, many, sf).collect()
    assert languages and all(r.text and re.search(r"[^\W\d_]", r.text) for r in languages)
    kept = Counter(pipeline.one_of_each(spark, docs, sf).collect())
    prints = {r.doc_id: brute_fingerprint(r.text) for r in whole if r.doc_id is not None}
    label = {i: i for i in prints}
    for _ in prints:
        label = {i: min(label[k] for k, q in prints.items() if (p ^ q).bit_count() <= 4) for i, p in prints.items()}
    assert kept == Counter(r for r in whole if label.get(r.doc_id) == r.doc_id) and kept.total() < len(whole)
    monkeypatch.setattr(pipeline, "DROPS", 0)
    assert Counter(pipeline.one_of_each(spark, docs, sf).collect()) == kept
    for name, stage in pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0, name
        found = stage(spark, docs, sf)
        assert name == "packing" or found.columns == docs.columns, name
        assert found.count() <= (10**9 if name == "packing" else len(whole))
    clean = pipeline.without_secrets(spark, docs, sf).collect()
    assert len(clean) == len(whole) and sum(r.text is None for r in clean) == sum(r.text is None for r in whole)
    assert {r.doc_id for r in pipeline.packed(spark, docs, sf).collect()} == {r.doc_id for r in whole}
