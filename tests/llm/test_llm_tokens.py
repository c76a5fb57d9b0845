"""Ids of whole texts against the library's own, and how often a word is looked up."""

from __future__ import annotations

import pytest
import tokenizers

from innsight.llm._tokens import Encoder
from innsight.llm.queries import tokenizer_path

LONG = "a" * 60
TEXTS = [
    "", None, " ", "\n", "one", " one", "one ", "one two two, two,", "a\nb\n\nc", "a \n b", "a  b   c", "x\ty z w v",
    "One, two; THREE!? été... niño x ## #%&", f"{LONG} b {LONG}, c {LONG}", f"b {LONG}. {LONG}", "5,000 3.14 it's we'll 12a",
    "<|endoftext|> a b", "a <|endoftext|>b", "你好 世界,", "a\r\nb \x00 c", ".,!? ,,, a.,", "A​b \U0001f600! x",
]


class Counted(dict):
    """How often a key is asked for."""

    asked = 0

    def __getitem__(self, key):
        self.asked += 1
        return super().__getitem__(key)

    def get(self, key, default=None):
        self.asked += 1
        return super().get(key, default)


@pytest.fixture(scope="module")
def library():
    tokenizer = tokenizers.Tokenizer.from_file(tokenizer_path())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("again", [1, 2])
def test_ids_are_the_librarys(library, again):
    encoder = Encoder(tokenizer_path())
    for _ in range(again):
        found = encoder.encode(TEXTS)
    expected = [library(text) for text in TEXTS]
    assert [[int.from_bytes(ids[k : k + 4], "little") for k in range(0, len(ids), 4)] for ids in found] == expected
    assert encoder.encode([]) == [] and encoder.encode([None, ""]) == [b"", b""]
    assert not any(len(word) > 40 for word in encoder._known)


def test_a_word_is_looked_up_once_for_many_texts():
    """Looking up every occurrence took most of the CPU time of packing."""
    encoder = Encoder(tokenizer_path())
    assert encoder.by_word
    encoder._known = known = Counted()
    encoder.encode([" ".join(f"word{'abcdefgh'[k % 8]}" for k in range(3000))] * 10)
    assert 0 < known.asked <= 50
