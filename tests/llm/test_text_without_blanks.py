"""Texts without blanks are cut wherever no piece can stand, so their parts are looked up like words."""

import random

from recordmill.llm import pieces
from test_brute import plain_viterbi


def _texts() -> list[str]:
    r = random.Random(3)
    signs = "的一是在不了有和人这中大为上个国我以要他時間日本語のをにはがでとした、。한국어การ"
    return ["".join(r.choice(signs) for _ in range(400)) for _ in range(5)] + ["".join(r.choice("the of中😀é\n▁") for _ in range(300)) for _ in range(5)]


def test_ids_are_those_of_the_whole_search():
    model = pieces.read_model()
    for text in _texts():
        if pieces.BLANK in text:
            assert model.decode(model.encode(text)) == text
        else:
            assert model.encode(text).tolist() == plain_viterbi(model, pieces.BLANK + text.replace(" ", pieces.BLANK))


def test_a_run_without_blanks_is_searched_once():
    model = pieces.read_model()
    searched, stream = [], model.words.stream
    model.words.stream = lambda word: (searched.append(len(word)), stream(word))[1]
    text = _texts()[0] * 50
    assert model.decode(model.encode(text)) == text
    assert sum(searched) < len(text) // 10


def test_pieces_with_blanks_inside():
    table = [("▁", 0), ("a", 1), ("a▁b", 2), ("b", 3), ("▁▁", 4)]
    model = pieces.Pieces(table, list(range(5, 261)))
    for text in ("a b", "b a  b a b", "aab ba b  "):
        assert model.encode(text).tolist() == plain_viterbi(model, pieces.BLANK + text.replace(" ", pieces.BLANK))
