import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evidentia.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
CODEC = pieces.PieceCodec(MODEL)


def ids(text):
    return np.frombuffer(CODEC.encode(text), dtype="<u4").tolist()


CASES = ["", " ", "  ", "a", " a", "a ", "  a   b ", "the theory of everything", "▁x ▁", "ﬁ é é", "\U0001f600 \x00 \x7f", "<s> </s> <unk> <0x41>", "a\nb\n\n c\t d", "x" * 5000, "ab " * 3000, "中文" * 40, "   \n   ", "1 234,5"]


@pytest.mark.parametrize("text", CASES)
def test_as_the_library(text):
    assert ids(text) == CODEC.library.encode(text)
    assert CODEC.decode(CODEC.encode(text)) == CODEC.library.decode(CODEC.library.encode(text))


def test_both_agendas_agree():
    for text in CASES:
        normal = pieces.SPACE + text.replace(" ", pieces.SPACE)
        old, pieces.SHORT = pieces.SHORT, 0
        try:
            by_heap = CODEC._agenda(normal)
        finally:
            pieces.SHORT = old
        assert by_heap == CODEC._short_agenda(normal)


@pytest.mark.parametrize("check", ["segments", "texts"])
def test_a_difference_raises(check):
    c = pieces.PieceCodec(MODEL, check)
    a, b = (c.ids[pieces.SPACE + w] for w in ("the", "of"))
    c._one[pieces.SPACE + "the"] = b.to_bytes(4, "little")
    with pytest.raises(AssertionError):
        pieces._encoded(c, ["one of the two"])
    assert a != b


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet=" ▁theaés\n", max_size=60)))
def test_any_text(text):
    want = CODEC.library.encode(text)
    assert ids(text) == want
    assert CODEC.decode(CODEC.encode(text)) == CODEC.library.decode(want)


def test_full_cache():
    c = pieces.PieceCodec(MODEL)
    old, pieces.CACHE = pieces.CACHE, 3
    try:
        for text in ("a b c d e f g", "h i j k l m n o p", "a h z"):
            assert np.frombuffer(c.encode(text), dtype="<u4").tolist() == c.library.encode(text)
    finally:
        pieces.CACHE = old


def test_documents(spark):
    rows = [(i, t, 1, "z") for i, t in enumerate([*CASES, None, "the theory"])] + [(None, "a", 1, "z"), (0, "", 1, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int, decoded string")
    got = pieces.encode_documents(df, MODEL, check="texts").collect()
    lib = CODEC.library
    for r, g in zip(rows, got):
        want = lib.encode(r[1] or "", add_bos=True, add_eos=True)
        assert (g.doc_id, list(g.ids), g.decoded) == (r[0], want, lib.decode(want))
    digest = pieces.digest_documents(df, MODEL).collect()
    for g, d in zip(got, digest):
        assert d.n_tokens == len(g.ids)
        assert d.ids_sha256 == hashlib.sha256(np.array(g.ids, dtype="<u4").tobytes()).hexdigest()
        assert d.decoded_sha256 == hashlib.sha256(g.decoded.encode()).hexdigest()
    assert pieces.encode_documents(df.limit(0), MODEL).count() == 0
