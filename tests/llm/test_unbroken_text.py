"""Merge rounds over text without a space: equal to the library and near n log n."""

import random
import time

import numpy as np
import pytest

from askbatch.llm import bpe, catalog

ALPHABETS = ("ab", "a", "aA0/+=", "日本語", "é́ü", "the and ing", "\x00\x01é", "=-_", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer
    path = catalog.vocabulary()
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return bpe.ByteBPE(path), lambda x: t.encode(x, add_special_tokens=False).ids


def ids_of(coder, text):
    return np.frombuffer(next(iter(coder.encode([text]))), "<u4").tolist()


@pytest.mark.parametrize("n", [bpe.LONG_WORD - 1, bpe.LONG_WORD, bpe.LONG_WORD + 1, 1000, 4000])
def test_unbroken_text_equals_library(both, n):
    coder, library = both
    rng = random.Random(n)
    for alphabet in ALPHABETS:
        for _ in range(5):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            assert ids_of(coder, text) == library(text)
        assert ids_of(coder, alphabet[0] * n) == library(alphabet[0] * n)


def test_both_kinds_of_rounds_agree(both):
    coder, _ = both
    rng = random.Random(5)
    words = ["".join(rng.choice(a) for _ in range(rng.randint(1, 900))).encode() for a in ALPHABETS for _ in range(20)]
    for short, long, mixed in zip(coder.merge_short(words), coder.merge_long(words), coder.merge(words), strict=True):
        assert short.tolist() == long.tolist() == mixed.tolist()


def test_time_of_unbroken_text_is_near_linear(both):
    coder, library = both
    rng = random.Random(9)
    text = "".join(rng.choice(ALPHABETS[-1]) for _ in range(96_000))
    begin = time.perf_counter()
    got = ids_of(coder, text)
    assert time.perf_counter() - begin < 5      # 0.35 s alone; 27 s by rounds over the whole word
    assert got == library(text)


def test_units_through_the_model_equal_the_whole_library(both):
    """White space and letters of every kind, at the cuts between units."""
    from askbatch.llm import token_codes
    _, library = both
    coder = token_codes.library_encoder(catalog.vocabulary())
    rng = random.Random(3)
    alphabet = [*"abAé \n\t\r'’.,;0١٣ \x85 　日本ЖꙀԯ԰½_-\x1c\x0b", "'s", "'ll", " the", "<|endoftext|>", " ", "\n"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(5000)]
    for text, got in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library(text)


def test_letter_classes_of_stable_code_points(both):
    """Each code point cuts as the library cuts it, alone and between letters."""
    from askbatch.llm import token_codes
    _, library = both
    coder = token_codes.library_encoder(catalog.vocabulary())
    texts = [a + chr(c) + b for c in range(0x560) for a, b in (("", ""), ("x", "y"), (" 1", " "), ("\n", ".z"))]
    for text, got in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library(text)


def test_each_word_is_learned_once():
    """Marks beside a word make other units of it, but no other words."""
    from askbatch.llm import token_codes
    for coder in (token_codes.library_encoder.__wrapped__(catalog.vocabulary()), bpe.ByteBPE(catalog.vocabulary()).units):
        asked, learn = [], coder.words.learn
        coder.words.learn = lambda words: asked.extend(words) or learn(words)
        list(coder.encode(["one two, two. (two) two", "one two! two", " two\ntwo"]))
        assert len(asked) == len(set(asked)) and asked.count(" two") == 1
        assert not coder.spaced.now and not coder.plain.now


def test_rotation_keeps_what_is_used():
    from askbatch.llm.units import Recent
    learned = []
    cache = Recent(4, lambda keys: learned.extend(keys) or [k.encode() for k in keys])
    for keys in (["a", "b", "c"], ["a", "d"], ["a", "e", "e"], ["a", "d", "b"]):
        assert cache.all(keys) == [k.encode() for k in keys]
    assert learned.count("a") == 1 and sorted(learned) == ["a", "b", "b", "c", "d", "e"]
