"""Language identification against a naive twin of its statement."""

import math
import random
import zlib
from collections import Counter

import regex
from pyspark.sql import functions as F

from lexigrove.llm import language_id

SYLLABLES = {"xx": ["ka", "to", "mi", "ru"], "yy": ["sch", "ein", "ung", "ge"], "zz": ["او", "تون", "كا"], "ww": ["é", "ña", "çõ", "to"]}


def words_of(t):
    return regex.findall(r"\p{L}+", t.lower())


def naive(docs, train):
    """{row number: (language, score)} after learning from the rows `train`."""
    counts: dict[tuple[str, int], Counter] = {}
    for i in train:
        _, t, lang = docs[i]
        for w in words_of(t or "") if lang is not None else ():
            counts.setdefault((lang, 0), Counter())[w] += 1
            padded = f" {w} "
            for n in range(1, 6):
                counts.setdefault((lang, n), Counter()).update(padded[j : j + n] for j in range(len(padded) - n + 1))
    langs = sorted({lang for lang, n in counts if counts[lang, n]})
    total = {k: sum(c.values()) for k, c in counts.items()}
    worst = {n: math.log10(max(total.get((lang, n), 0) for lang in langs) / 0.5) for n in range(6)} if langs else {}

    def cost(n, gram):
        known = [counts.get((lang, n), Counter())[gram] for lang in langs]
        return [-math.log10(c / total[lang, n]) if c else worst[n] for c, lang in zip(known, langs, strict=True)] if any(known) else None

    def of(word):
        if whole := cost(0, word):
            return whole
        padded = f" {word} "
        for n in range(5, 0, -1):
            if found := [c for j in range(len(padded) - n + 1) if (c := cost(n, padded[j : j + n]))]:
                return [sum(x) / len(found) for x in zip(*found, strict=True)]
        return None

    out = {}
    for i, (_, t, _) in enumerate(docs):
        words = words_of(t or "")
        scored = [c for w in words if (c := of(w))] if langs else []
        if not words or not langs:
            out[i] = ("und", 0.0)
        elif not scored:
            out[i] = (min(langs, key=lambda x: (-total[x, 0], x)), 1 / len(langs))
        else:
            mean = [sum(x) / len(scored) for x in zip(*scored, strict=True)]
            best = mean.index(min(mean))
            out[i] = (langs[best], 1 / sum(10 ** (mean[best] - m) for m in mean))
    return out


def test_against_brute_force(spark):
    rng = random.Random(29)
    word = lambda lang: "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 5)))
    docs = []
    for i in range(150):
        lang = rng.choice(list(SYLLABLES))
        t = rng.choice([" ", ", ", "\n", "1 "]).join(word(lang if rng.random() < 0.9 else rng.choice(list(SYLLABLES))) for _ in range(rng.randrange(1, 25)))
        docs.append((i, t.title() if i % 4 == 0 else t, lang if i % 11 else None))
    docs += [(200, None, "xx"), (201, "", "yy"), (202, "123 ...", "digits"), (203, "漢字", None), (None, "kato miru", "xx"), (204, "kato " * 30_000 + "schein", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in ("gram", "n", "size", "docs", "total")})
    held = {i: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 0 for i, (d, *_) in enumerate(docs)}
    want = naive(docs, [i for i in held if not held[i]])
    got = {r["doc_id"]: r for r in language_id.identify(df).collect()}
    assert len(got) == len(docs) and len({p for p, _ in want.values()}) > 4
    for i, (d, _, _) in enumerate(docs):
        r = got[d]
        assert r["held_out"] == held[i] and r["lang_pred"] == want[i][0], docs[i][:1]
        assert abs(r["score"] - want[i][1]) < 1e-9


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "kato", None), (2, "miru", None), (2, "miru", None)], "doc_id long, text string, lang string")
    assert [(r["lang_pred"], r["score"]) for r in language_id.identify(df).collect()] == [("und", 0.0)] * 3
    assert language_id.identify(df.where("false")).count() == 0
