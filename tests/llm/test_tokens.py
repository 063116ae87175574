"""Cached piece encoding against whole-text encoding."""

import functools

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vigil.llm import tokens

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
CODES = [0x85, 0xA0, 0x2003, 0x2028, 0x3000, 0x301, 0xE9, 0xDF, 0xC9, 0x3A3, 0x130, 0xFB01, 0x4F60, 0x1F600]
ALPHABET = [*"abXYZ.,!'s03 \n\t\r\x0b\x1c\x1f\0-", *map(chr, CODES), "  ", "\n\n", " \n", "\n ",
            "the", "don't", " The", "cat, ", "<|endoftext|>"]


@functools.cache
def whole(name):
    t = Tokenizer.from_file(P.path(name))
    return lambda s: np.array(t.encode(s, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=400, deadline=None)
@given(parts=st.lists(st.sampled_from(ALPHABET), max_size=40))
def test_pieces_give_the_ids_of_the_whole_text(name, parts):
    text = "".join(parts)
    assert tokens.encoder(P.path(name)).encode([text]) == [whole(name)(text)]


@pytest.mark.parametrize("name", NAMES)
def test_a_full_cache_changes_nothing(name, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 3)
    e = tokens.Encoder(P.path(name))
    texts = ["The cat, the dog.\nThe end.", "", "a", "one two, three. four\nfive six."] * 3
    assert e.encode(texts) == [whole(name)(t) for t in texts]


def test_end_id_and_null_text():
    end = np.array([2], "<u4").tobytes()
    assert tokens.ids_with_end(P.path(NAMES[0]), [None, ""], 2) == [end, end]
