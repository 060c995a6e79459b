"""The toxicity model's tables against a naive restatement of its rules, and plain texts against its scores."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from lexigrove.llm import toxicity


def naive(rows, truth):
    """Tables of the model over all parts, from (doc_id, text) and {doc_id: toxic}."""
    lines = {(truth[i], line) for i, t in rows if i in truth for line in (t or "").split("\n")}
    n = {y: sum(1 for z, _ in lines if z == y) for y in (0, 1)}
    pair, having = {0: Counter(), 1: Counter()}, {0: Counter(), 1: Counter()}
    for y, line in lines:
        ws = re.findall(r"[^\W\d_]+", line.lower())
        pair[y].update(set(zip(["", *ws[:-1]], ws)))
        having[y].update(set(ws))
    docs = Counter(w for _, t in rows for w in set(re.findall(r"[^\W\d_]+", (t or "").lower())))
    every = sum(docs.values())

    def tells(a, b, kinds):
        both = (a + b) / (n[1] + n[0])
        g = 2 * sum(x * math.log(x / (m * both)) for x, m in ((a, n[1]), (b, n[0])) if x)
        ratio = (a + 0.5) / n[1] / ((b + 0.5) / n[0])
        return g >= max(12, 2 * math.log(kinds)) and not 0.25 < ratio < 4

    words_seen, pairs_seen = set(having[0]) | set(having[1]), set(pair[0]) | set(pair[1])
    before, after, cont = ({y: defaultdict(set) for y in (0, 1)} for _ in range(3))
    for y in (0, 1):
        for h, w in pair[y]:
            cont[y][w].add(h)
            after[y][h].add(w)
    total = {y: sum(map(len, cont[y].values())) for y in (0, 1)}
    told = {w for w in words_seen if tells(having[1][w], having[0][w], len(words_seen))}

    def word(y, w):
        share = (docs[w] + 0.5) / (every + 1)
        return max(len(cont[y].get(w, ())) - 0.75, 0) / total[y] + 0.75 * len(cont[y]) / total[y] * share if w in told else share

    def likely(y, h, w):
        seen = sum(pair[y][h, x] for x in after[y].get(h, ()))
        return (max(pair[y][h, w] - 0.75, 0) + 0.75 * len(after[y].get(h, ())) * word(y, w)) / seen if seen else word(y, w)

    words = {w: math.log(word(1, w) / word(0, w)) for w in told}
    pairs = {(h, w): math.log(likely(1, h, w) / likely(0, h, w)) - math.log(word(1, w) / word(0, w)) for h, w in pairs_seen if tells(pair[1][h, w], pair[0][h, w], len(pairs_seen))}
    return words, pairs


def test_tables(spark):
    rng = random.Random(3)
    plain, bad = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(150)], ["scumx", "trashx", "idiotx"]
    rows, truth = [], {}
    for i in range(400):
        toxic = i % 5 == 0
        text = "\n".join(" ".join("you " + rng.choice(bad) if toxic and rng.random() < 0.1 else rng.choice(plain) for _ in range(12)) for _ in range(4))
        rows.append((i, text))
        if i % 4 or toxic:
            truth[i] = int(toxic)
    rows += [(900, rows[0][1]), (901, None), (902, "You IDIOTX you 12 idiotx_2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame(list(truth.items()), "doc_id long, toxic int"))
    words, pairs = naive(rows, truth)
    assert {"scumx", "you"} <= set(words) and ("you", "idiotx") in pairs
    assert model["words"] == pytest.approx(words) and model["pairs"] == pytest.approx({k: v for k, v in pairs.items() if v})
    want = [words.get("you", 0) * 2 + words["idiotx"] * 2 + pairs.get(("", "you"), 0) + 2 * pairs[("you", "idiotx")] + pairs.get(("idiotx", "you"), 0)]
    assert toxicity.evidence(rows[-1][1], model) == pytest.approx(want[0] / 4)
