import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from nearfield.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
THEIRS = Tokenizer.from_file(PATH)
OURS = bpe.Encoder(bpe.Vocabulary(PATH))
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u180e\u2000\u2003\u200a\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"


def both(text):
    ids, _ = OURS.encode([text])
    theirs = THEIRS.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == theirs
    assert OURS.vocabulary.decode(ids).decode("utf-8", "replace") == THEIRS.decode(theirs, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aaabcdet'slve 09²½Ⅷ" + SPACES)), max_size=60))
def test_same_ids_as_the_library(text):
    both(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x24F), max_size=60))
def test_same_ids_below_u0250(text):
    both(text)


@pytest.mark.parametrize("text", ["", "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>", "<|endof", "aaaaaaaaaaa aaaaaa", "  x  \n\n y ", "é" * 4000, "ab" * 3000, "don't  we'LL", "thequickbrownfox" * 400])
def test_cases(text):
    both(text)


def test_frames(cases):
    rows = bpe.digests(cases, PATH).collect()
    texts = [r.text or "" for r in cases.collect()]
    assert len(rows) == len(texts)
    for r, text in zip(rows, texts, strict=True):
        ids = THEIRS.encode(text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(THEIRS.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_empty(cases):
    assert bpe.digests(cases.limit(0), PATH).count() == 0
