"""Decontamination by items of few shingles."""

import random

from lexigrove.llm import decontaminate


def test_short_items_are_always_found():
    rng = random.Random(23)
    fresh = iter(range(10**9))
    text = lambda n: [f"w{next(fresh)}" for _ in range(n)]
    items = [text(5 + k % 10) for k in range(400)]
    parsed = decontaminate.Items([(k, " ".join(ws)) for k, ws in enumerate(items)])
    hashes = decontaminate.Hashes()
    documents = []
    for ws in items:
        at = rng.randrange(480)
        body = text(480)
        documents.append(hashes.of(body[:at] + ws + body[at:]))
    found = decontaminate.candidates(documents, parsed)
    assert [k for k in range(400) if (k, k) not in found] == []
