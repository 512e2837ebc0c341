"""License scans over a positional rare-token index, with DataFrame operations only.

An index holds, for each word of the licence templates, the postings (template, position); a key phrase that is not part
of its template's text is indexed as a text of its own. A text's licence words are kept with their positions; the words'
document frequencies over the whole corpus give their IDF. Every licence word of a text that has postings is looked up
(frequent words have them only inside key phrases); postings and places are intersected by relative position, so words
that stand as in a template meet at one offset. A template is a candidate at an offset that holds two of its rare words or
more, or the rarest word of one of its key phrases, so a phrase is never missed for want of candidates. A label is given
where a candidate holds all words of a mandatory key phrase at their places. The score is the largest share of a
template's IDF held by a candidate that gives a label, 0.5 at least.

Only numbers and licence words leave a text's row, and all of it happens within the row: there is no join, and nothing
to skew. The tables broadcast are the templates and the IDF of their words.

Defined results: a null text is empty; texts without licence words have empty labels, score 0, and null first and last
words. Repeated rows and null ids stay; further columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read
from .quality_rules import let

TOKEN = r"[0-9a-z\x{80}-\x{10FFFF}]+"
#: Base phrases and their labels (fixed values).
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))


@dataclass(frozen=True)
class Template:
    """``keys`` are mandatory phrases, any of which identifies the licence; ``text`` is what usually stands around."""

    label: str
    text: str
    keys: tuple[str, ...]


#: The licences' customary notices.
TEMPLATES = (
    Template("gpl", "this work is licensed under the gnu general public license version", ("gnu general public license",)),
    Template("lgpl", "licensed under the gnu lesser general public license version", ("gnu lesser general public license", "gnu library general public license")),
    Template("agpl", "licensed under the gnu affero general public license version", ("gnu affero general public license",)),
    Template("apache", "licensed under the apache license version", ("apache license",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted free of charge to any person obtaining",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms", "bsd license")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and or distribute this software",)),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license", ("mozilla public license",)),
    Template("epl", "made available under the terms of the eclipse public license", ("eclipse public license",)),
    Template("cc0", "dedicated to the public domain under cc0 1 0 universal", ("cc0 1 0 universal",)),
    Template("cc-by", "licensed under cc by 4 0", ("cc by", "creative commons attribution")),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc", "creative commons attribution noncommercial")),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa", "creative commons attribution sharealike")),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)
#: Words too frequent to be kept for their own sake; they are kept beside a word that is (fixed values).
STOP = frozenset("a and any are by code form for free in is of or person source the this to under use with without work 0 1 4 nc sa copy fee".split())


def vocabulary(templates: tuple[Template, ...] = TEMPLATES) -> list[str]:
    """Every word of the templates and phrases."""
    texts = [t.text for t in templates] + [k for t in templates for k in t.keys] + [p for p, _ in BASE]
    return sorted({w for x in texts for w in x.split()})


def licence_words(documents: DataFrame) -> DataFrame:
    """``n_words``, and ``hits``: the licence words of a text with their positions. A frequent word is kept only where
    the next or the last word but three is a rare one, which covers every phrase with a rare word in it."""
    rare = [w for w in vocabulary() if w not in STOP]
    text = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(text, F.lit(TOKEN), 0)

    def hits(w: Column) -> Column:
        spots = F.filter(F.transform(w, lambda x, i: F.when(x.isin(*rare), i)), lambda i: i.isNotNull())
        near = F.array_sort(F.array_distinct(F.flatten(F.transform(spots, lambda i: F.sequence(F.greatest(i - REACH, F.lit(0)), F.least(i + REACH, F.size(w) - 1))))))
        return F.filter(F.transform(near, lambda i: F.struct(i.cast("int").alias("at"), F.get(w, i).alias("word"))), lambda h: h["word"].isin(*vocabulary()))

    frame = documents.select("doc_id", words.alias("w"))
    return frame.select("doc_id", F.size("w").cast("long").alias("n_words"), let(F.col("w"), hits).alias("hits"))


def _reach() -> int:
    """The farthest that a word of a phrase stands from a rare word of it."""
    phrases = [k.split() for t in TEMPLATES for k in t.keys] + [p.split() for p, _ in BASE]
    return max(min(abs(i - k) for k, v in enumerate(p) if v not in STOP) for p in phrases for i in range(len(p)))


REACH = _reach()


def _places(hits: Column, phrase: str) -> Column:
    """Starts of ``phrase`` among positioned words."""
    words = phrase.split()

    def starts(h: Column) -> Column:
        def whole(x: Column, i: Column) -> Column:
            here = x["word"] == words[0]
            for k, word in enumerate(words[1:], 1):
                y = F.get(h, i + k)
                here = here & F.coalesce((y["word"] == word) & (y["at"] == x["at"] + k), F.lit(False))
            return here

        return F.transform(F.filter(h, whole), lambda x: x["at"])

    return let(hits, starts)


def _index(idf: dict[str, float]) -> tuple[list[tuple[int, str]], dict[str, list[tuple[int, int, int, bool]]], list[list[int]]]:
    """The indexed texts (template, text); for each word its postings (text, position, bit of a word of a key phrase,
    whether it is the rarest word of one); for each text the bits of each of its key phrases."""
    entries = [(t, x) for t, template in enumerate(TEMPLATES) for x in (template.text, *[k for k in template.keys if f" {k} " not in f" {template.text} "])]
    postings: dict[str, list[tuple[int, int, int, bool]]] = {}
    wholes = []
    for e, (t, text) in enumerate(entries):
        words, bits, sure, masks = text.split(), {}, set(), []
        for key in TEMPLATES[t].keys:
            phrase = key.split()
            for i in range(len(words) - len(phrase) + 1):
                if words[i : i + len(phrase)] == phrase:
                    spots = range(i, i + len(phrase))
                    bits |= {k: 1 << k for k in spots}
                    masks.append(sum(1 << k for k in spots))
                    sure.add(max((k for k in spots if words[k] not in STOP), key=lambda k: idf[words[k]]))
        for at, word in enumerate(words):
            if word not in STOP or at in bits:
                postings.setdefault(word, []).append((e, at, bits.get(at, 0), at in sure))
        wholes.append(masks)
    return entries, postings, wholes


def scan(documents: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` and ``templates`` of every row."""
    words = materialize(licence_words(documents), "license-words")
    names = vocabulary()
    counted = words.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["word"]))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    frequency = {r["word"]: r["n"] for r in counted.collect()}  # at most one row a word of the templates
    total = max(1, words.count())
    idf = {w: math.log(1 + total / (1 + frequency.get(w, 0))) for w in names}
    weight = F.create_map(*[F.lit(x) for w in names for x in (w, float(idf[w]))])
    entries, postings, wholes = _index(idf)
    fields = "array<struct<e:int,at:int,bit:bigint,sure:boolean>>"
    index = F.create_map(*[x for w, p in sorted(postings.items()) for x in (F.lit(w), F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("e", "at", "bit", "sure"), q)]) for q in p]))])
    index = index.cast(f"map<string,{fields}>")
    full = [sum(idf[w] for w in set(t.text.split()) if w not in STOP) for t in TEMPLATES]
    template = F.array(*[F.lit(t) for t, _ in entries])
    whole = F.array(*[F.array(*[F.lit(m).cast("bigint") for m in masks]) for masks in wholes])

    def meetings(h: Column) -> Column:
        rare = ~h["word"].isin(*STOP)
        worth, one = F.when(rare, weight[h["word"]]).otherwise(F.lit(0.0)), rare.cast("int")
        posted = F.coalesce(index[h["word"]], F.array().cast(fields))
        return F.transform(posted, lambda p: F.struct(p["e"].alias("e"), (h["at"] - p["at"]).alias("offset"), p["bit"].alias("bit"), p["sure"].alias("sure"), worth.alias("worth"), one.alias("one")))

    def meet(a: Column, m: Column) -> Column:
        same = (a["e"] == m["e"]) & (a["offset"] == m["offset"])
        kept = lambda name, zero: F.when(same, a[name]).otherwise(F.lit(zero))
        run = F.struct(
            (kept("sum", 0.0) + m["worth"]).alias("sum"),
            (kept("words", 0) + m["one"]).alias("words"),
            kept("bits", 0).cast("bigint").bitwiseOR(m["bit"]).alias("bits"),
            (kept("sure", False) | m["sure"]).alias("sure"),
        )

        def grown(s: Column) -> Column:
            t = F.get(template, m["e"])
            labelled = ((s["words"] >= 2) | s["sure"]) & F.exists(F.get(whole, m["e"]), lambda k: s["bits"].bitwiseAND(k) == k)
            best = lambda name, ok: F.transform(a[name], lambda b, i: F.when((i == t) & ok, F.greatest(b, s["sum"])).otherwise(b)).alias(name)
            return F.struct(m["e"].alias("e"), m["offset"].alias("offset"), *[s[k].alias(k) for k in ("sum", "words", "bits", "sure")], best("held", F.lit(True)), best("verified", labelled))

        return let(run, grown)

    # Runs of equal (entry, offset) in sorted order are the intersections; what a run holds only grows along it.
    start = F.expr(
        "named_struct('e', -1, 'offset', 0, 'sum', 0D, 'words', 0, 'bits', 0L, 'sure', false, "
        f"'held', array_repeat(0D, {len(TEMPLATES)}), 'verified', array_repeat(-1D, {len(TEMPLATES)}))"
    )
    met = F.aggregate(F.array_sort(F.flatten(F.transform("hits", meetings))), start, meet, lambda a: F.struct(a["held"].alias("held"), a["verified"].alias("verified")))
    none = F.expr(f"named_struct('held', array_repeat(0D, {len(TEMPLATES)}), 'verified', array_repeat(-1D, {len(TEMPLATES)}))")
    frame = words.select("doc_id", "n_words", "hits", F.when(F.size("hits") > 0, met).otherwise(none).alias("met"))
    frame = frame.select("doc_id", "n_words", "hits", "met.held", "met.verified")
    places = {p: _places(F.col("hits"), p) for p, _ in BASE}
    some = F.size("hits") > 0
    nowhere = F.array().cast("array<int>")
    frame = frame.withColumns({f"p{i}": F.when(some, place).otherwise(nowhere) for i, place in enumerate(places.values())})
    column = {p: F.col(f"p{i}") for i, p in enumerate(places)}
    base = F.concat(*[column[p] for p, _ in BASE])
    base_labels = F.array(*[F.when(F.size(column[p]) > 0, F.lit(label)) for p, label in BASE])
    verified = [F.get("verified", F.lit(i)) >= 0 for i in range(len(TEMPLATES))]
    share = [F.when(v, F.least(F.lit(1.0), F.greatest(F.get("verified", F.lit(i)) / full[i], F.lit(0.5)))) for i, v in enumerate(verified)]
    labels = F.array(*[F.when(v, F.lit(t.label)) for v, t in zip(verified, TEMPLATES)])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(F.array_compact(a))), ",")
    return frame.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base).cast("long").alias("first_word"),
        F.array_max(base).cast("long").alias("last_word"),
        joined(base_labels).alias("base_labels"),
        joined(F.concat(base_labels, labels)).alias("labels"),
        F.coalesce(F.array_max(F.array_compact(F.array(*share))), F.lit(0.0)).alias("score"),
        F.array_compact(F.array(*[F.when(F.get("held", F.lit(i)) / full[i] >= 0.8, F.lit(i)) for i in range(len(TEMPLATES))])).alias("templates"),
    )


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents")).drop("templates")
