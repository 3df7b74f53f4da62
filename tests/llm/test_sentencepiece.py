import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from framelake.llm.sentencepiece_bpe import PrefixEncoder, sentencepiece_roundtrip
from hypothesis import given, settings
from hypothesis import strategies as st

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
OWN = PrefixEncoder(PATH)


def ids(text):
    return np.array(LIBRARY.encode(text, add_bos=True, add_eos=True), "<u4").tobytes()


@settings(max_examples=1500, deadline=None)
@given(st.one_of(st.text(), st.text("ab ▁\n\tei th.é中😀\x00"), st.text("thingsed ouer ")))
def test_equals_the_library(text):
    assert OWN.encode(text) == ids(text)


@pytest.mark.parametrize("text", ["", " ", "▁", "<s></s><unk>", "  a  b ", "a" * 5000, "ab" * 3000 + " \n\n x", "<0x0A>", " ﻿"])
def test_special_cases(text):
    assert OWN.encode(text) == ids(text)
    assert OWN.decode(ids(text)) == LIBRARY.decode(LIBRARY.encode(text, add_bos=True, add_eos=True))


def test_odd_rows(odd, odd_rows):
    got = sorted((str(r["id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in sentencepiece_roundtrip(odd, PATH).collect())
    want = []
    for i, t in odd_rows:
        x = LIBRARY.encode(t or "", add_bos=True, add_eos=True)
        want.append((str(i), len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(x).encode()).hexdigest()))
    assert got == sorted(want)


def test_ids_and_texts_on_request(odd):
    row = sentencepiece_roundtrip(odd, PATH, with_ids=True).filter("id = 14").first()
    assert row["ids"] == LIBRARY.encode("Same Words here", add_bos=True, add_eos=True) and row["decoded"] == "Same Words here"


def test_empty_table(none):
    assert sentencepiece_roundtrip(none, PATH).count() == 0
