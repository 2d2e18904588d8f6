"""Pairs of symbols are found by their hash; words are parted at the marks of space."""

import numpy as np
import public_tokenizers
import pytest

from tessera.llm import pieces


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))


def test_every_pair_and_no_other_is_found_by_its_slot(model):
    known = model.pairs[:-1]
    place, piece = model.paired(known >> 32, known & 0xFFFFFFFF)
    assert (model.slots < len(known)).sum() == len(known)
    assert (place == model.pair_place[:-1]).all() and (piece == model.pair_id[:-1]).all()
    rng = np.random.default_rng(1)
    left, right = (rng.integers(-1, model.no_piece + 50, 200_000).astype(np.int32) for _ in range(2))
    at = {int(k): i for i, k in enumerate(known)}
    want = [at.get(int(a) << 32 | int(b), len(known)) if a >= 0 and b >= 0 else len(known) for a, b in zip(left, right)]
    assert (model.paired(left, right)[1] == model.pair_id[want]).all()
    assert (model.paired(np.array([-1, 5, pieces.UNKNOWN]), np.array([5, -1, 5]))[1] == -1).all()


@pytest.mark.parametrize("text", ["", " ", "a", "one two, three.", "  two  marks ", "a\nb\tc", "中文 字 mixed", "▁", "x▁▁y", "\U0001f600 \x00 z"])
def test_words_by_themselves_encode_as_in_the_library(model, text):
    assert model.by_words
    assert np.frombuffer(model.encode([text])[0], dtype="<u4").tolist() == model.library.encode(text)
    assert "".join(model.units(text)) == model.library.normalize(text)
