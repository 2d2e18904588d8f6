"""Ids are checked against the library's by distinct unit; what a unit alone does not prove is checked by its whole text."""

import numpy as np
import public_tokenizers
import pytest

from tessera.llm import pieces


class Counted:
    """The library, which counts the characters that it encodes."""

    def __init__(self, library):
        self.library, self.seen = library, 0

    def __getattr__(self, name):
        return getattr(self.library, name)

    def encode(self, texts, **how):
        self.seen += sum(map(len, [texts] if isinstance(texts, str) else texts))
        return self.library.encode(texts, **how)


@pytest.fixture
def model():
    p = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    p.library = Counted(p.library)
    return p


def ids(made):
    return [np.frombuffer(raw, dtype="<u4").tolist() for raw in made]


def test_the_library_encodes_a_repeated_word_once(model):
    texts = [" ".join(f"word{i % 50}" for i in range(2000)) for _ in range(20)]
    made, agrees = model.encode_checked(texts)
    assert all(agrees) and ids(made) == model.library.library.encode(texts)
    assert model.library.seen * 100 < sum(map(len, texts))
    seen = model.library.seen
    assert model.encode_checked(texts) == (made, agrees) and model.library.seen == seen


ODD = ["", " ", "a", "  two  marks ", "▁", "x▁▁y", "▁ ▁", "a\x00b \x00", "中文 字 mixed", "\U0001f600 ﬁ Å", "tab\tline\nend ", "long" * 40 + " short", "é ́", "</s> <unk> <0x41>"]


def test_odd_texts_agree_whole_and_apart(model):
    own = model.library.library.encode(ODD)
    made, agrees = model.encode_checked(ODD)
    assert ids(made) == own and all(agrees)
    for text, want in zip(ODD, own, strict=True):
        made, agrees = model.encode_checked([text])
        assert ids(made) == [want] and agrees == [True]


@pytest.mark.parametrize("unit", ["▁wrong", "▁" + "wrong" * 8])
def test_a_unit_that_differs_shows_in_its_texts_alone(model, monkeypatch, unit):
    many, one = model.encode_units, model.encode_unit
    bad = np.array([5], dtype="<u4").tobytes()
    monkeypatch.setattr(model, "encode_units", lambda us: [bad if u == unit else raw for u, raw in zip(us, many(us), strict=True)])
    monkeypatch.setattr(model, "encode_unit", lambda u: bad if u == unit else one(u))
    texts = ["all is right", f"this is {unit[1:]} here", "right again", unit[1:]]
    for _ in range(2):
        assert model.encode_checked(texts)[1] == [True, False, True, False]
    assert unit not in model or len(unit) <= pieces.SHORT


def test_a_full_cache_starts_anew_with_its_doubts(model, monkeypatch):
    monkeypatch.setattr(pieces, "MOST", 30)
    for k in range(5):
        texts = [" ".join(f"w{k}x{i}" for i in range(25)), "x▁▁y"]
        made, agrees = model.encode_checked(texts)
        assert all(agrees) and ids(made) == model.library.library.encode(texts)
        assert len(model) <= 30 and model.doubtful <= model.keys()


def test_the_query_and_the_whole_form_agree(spark):
    docs = spark.createDataFrame(list(enumerate([*ODD, None])), "doc_id long, text string")
    out = pieces.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()
    library = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model")).library
    assert len(out) == len(ODD) + 1 and all(r.agrees for r in out)
    for r in out:
        want = library.encode(r.text or "", add_bos=True, add_eos=True)
        assert r.ids == want and r.n_tokens == len(want) and r.decoded == library.decode(want)
