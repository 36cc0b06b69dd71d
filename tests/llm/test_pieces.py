import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "  a", "a  b", "x ", "</s>x", "▁a b", "a\tb\n c", "é😀\u0000x", "ﬁ Å", "<0x41>", "<unk>", "aaaa " * 300, "ab" * 4000, "▁▁ ▁", "a▁ b▁", "The cat sat."]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_any_text_is_encoded_and_decoded_as_the_library_does(text):
    c = pieces.codec(MODEL)
    ids = c.encode(text)
    assert ids == c.library.encode(text, add_eos=True)
    assert c.decode(ids) == c.library.decode(ids)


def test_digests_of_edge_cases_and_repeated_rows(frame, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "b")]
    got = sorted(map(tuple, pieces.digests(frame(rows), MODEL).collect()), key=str)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_eos=True)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_empty_table_and_clashing_columns(frame):
    assert pieces.digests(frame([]), MODEL).count() == 0
    got = pieces.encode_decode(frame([(1, "a b", 5)], "doc_id long, text string, ids int"), MODEL).collect()
    assert got[0]["decoded"] == "a b"


def test_generations_forget_but_do_not_change_results(monkeypatch):
    monkeypatch.setattr(pieces, "KEPT", 3)
    c = pieces.Codec(MODEL)
    for t in ["one two three four", "five six seven", "one two five", "one two three four"]:
        assert c.encode(t) == c.library.encode(t, add_eos=True)


def test_a_difference_from_the_library_is_an_error(monkeypatch):
    c = pieces.Codec(MODEL)
    monkeypatch.setattr(c, "merge", lambda s: [5])
    with pytest.raises(AssertionError):
        c.encode("hello")
