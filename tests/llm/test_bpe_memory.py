"""A worker keeps the vocabulary from one task to the next, but not the pieces that a task remembered."""

import public_tokenizers

from lexigrove.llm import bpe
from lexigrove.llm.queries import VOCABULARY


def test_pieces_go_with_their_task():
    with open(public_tokenizers.path(VOCABULARY), "rb") as file:
        vocabulary = file.read()
    with bpe._codec(vocabulary, public_tokenizers.PATTERN) as codec:
        first = list(codec.encode("words of one task"))
        assert codec.known
    assert not codec.known
    with bpe._codec(vocabulary, public_tokenizers.PATTERN) as again:
        assert again is codec and list(again.encode("words of one task")) == first
