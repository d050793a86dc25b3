import random

import numpy as np

from lexiscope.llm import pii
from lexiscope.llm.tagger import encode_pieces


def test_every_character_is_read():
    """Also what has no capital, digit or @, and what stands far from the start of a long text."""
    for text in ("ask ana silva about it", "x", "the lazy buffer resets. " * 300 + "ana silva"):
        assert {k for s, e in pii.windows_of(text) for k in range(s, e)} == set(range(len(text)))
    assert pii.windows_of("") == []


def test_a_tagger_decides_without_signs():
    class Everything:
        def decode(self, codes, bias=None):
            return (codes != 0).astype("int8")

    assert pii.find_spans(["nothing here"], Everything())[0]


def test_pieces_hold_every_character_once():
    r = random.Random(3)
    texts = ["", " ", "a", "Ana-Maria  da Silva, +49 (0)170 1234567\n\n    x_y = getValue(ß)", *("".join(r.choice("aB3 .\n@é漢") for _ in range(r.randrange(40))) for _ in range(200))]
    for text, (codes, starts, bodies) in zip(texts, encode_pieces(texts)):
        assert (codes > 0).all() and len(codes) == len(starts) == len(bodies)
        ends = np.append(starts[1:], len(text))
        assert not len(text) or starts[0] == 0
        assert (ends > bodies).all() and set((bodies - starts).tolist()) <= {0, 1} and all(text[s].isspace() for s, b in zip(starts, bodies) if s < b)
        alone = encode_pieces([text])[0]
        assert all(np.array_equal(a, b) for a, b in zip(alone, (codes, starts, bodies)))


def test_labels_of_pieces_and_characters():
    text, spans = "ask Ana Silva, not me", [(4, 13, "person_name")]
    (codes, starts, bodies), = encode_pieces([text])
    y = pii._labels(len(text), spans)
    assert np.array_equal(pii._of_chars(len(text), pii._of_pieces(y, bodies), starts, bodies), y)
