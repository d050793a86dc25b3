"""The tagger reads by a shorter way than it learns: the same states, and a piece's row is made once, not in every batch."""

import numpy as np

from lexiscope.llm.tagger import Tagger, encode_pieces, pad

TEXTS = ["ask ana silva about it", "the lazy buffer resets. " * 20, "", "x", "Ana-Maria da Silva,\n+49 170 1234567"]


def _codes(texts):
    return pad([c for c, _, _ in encode_pieces(texts)])


def test_reading_has_the_states_of_learning():
    tagger, codes = Tagger(11), _codes(TEXTS)
    for _ in range(2):
        assert np.abs(tagger._read(codes) - tagger._run(codes, False)[0]).max() < 1e-5
        assert np.array_equal(tagger.decode(codes), tagger.paths(codes, tagger.emissions(codes)))
        tagger.fit([c for c, _, _ in encode_pieces(TEXTS) if len(c)], [np.ones(len(c), np.int64) for c, _, _ in encode_pieces(TEXTS) if len(c)], 3)  # other weights, other rows


def test_rows_of_pieces_are_made_once():
    tagger, made = Tagger(11), []
    whole = tagger._vectors
    tagger._vectors = lambda pieces: made.extend(pieces.tolist()) or whole(pieces)
    for texts in (TEXTS, TEXTS[::-1], TEXTS[:1]):
        tagger.decode(_codes(texts))
    assert len(made) == len(set(made)) == len(np.unique(_codes(TEXTS)))
