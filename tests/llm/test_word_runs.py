"""Words cut at runs of letters give the ids that the tokenizer gives for the whole text."""

import random

import numpy as np
import public_tokenizers
import pytest

from cellwise.llm.word_tokens import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoder():
    return WordEncoder(PATH)


def test_the_file_allows_cuts(encoder):
    assert encoder.cut


def test_ids_of_random_texts(encoder):
    draw = random.Random(5)
    parts = ["a", "Word", "THE", "don't", "We'LL", "'s", "''S", "'", "..", ",", "$$$", "###", "12", "3x4", "é", "É", "H̱", "ẖ", "J̌", "K", "İ", "ß", "Σ", "—", " ", " ", "½", "٣", "中文", "🙂", "\x01", "\x1c", "\x85", "_", "-", "/", " ", " ", "\n", "\t", "́"]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 30))) for _ in range(4000)] + ["", "'", "x" * 5000 + "." * 3000 + "Y" * 2000]
    raw = encoder.encode([t.encode() for t in texts])
    for text, ids in zip(texts, raw, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text
