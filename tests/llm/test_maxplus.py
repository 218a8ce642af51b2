"""The max-plus scan against one Viterbi pass over the whole text."""

import random

import numpy as np
import pytest

from inkgrid.llm import maxplus


def vocabulary(seed=1):
    rng = random.Random(seed)
    return [("<unk>", 0.0)] + [(c, -rng.random() * 9) for c in "abcd"] + [("".join(rng.choice("abcd") for _ in range(rng.randint(2, 5))), -rng.random() * 9) for _ in range(40)]


def best(pieces, text):
    score, came = [0.0] + [-np.inf] * len(text), {}
    for at in range(len(text)):
        for n, k, s in pieces.starting(text, at):
            if score[at] + s > score[at + n]:
                score[at + n], came[at + n] = score[at] + s, (at, k)
    return score[-1]


@pytest.mark.parametrize("chunk", [1, 3, 7, 1000])
def test_scan_is_one_pass(spark, chunk):
    pieces = maxplus.Pieces(vocabulary())
    rng = random.Random(chunk)
    texts = ["".join(rng.choice("abcdé") for _ in range(n)) for n in (1, 2, 5, 40, 97)] + ["", None]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    text_of = [p for p, _ in vocabulary()]
    score_of = {0: pieces.unknown[1]} | {k: s for k, (_, s) in enumerate(vocabulary()) if k}
    for r in maxplus.encode(made, pieces, chunk).collect():
        text = texts[r["gid"]] or ""
        assert "".join(text_of[k] if k else "é" for k in r["ids"]) == text
        if text:
            assert abs(sum(score_of[k] for k in r["ids"]) - best(pieces, text)) < 1e-6


def test_product_is_associative():
    rng = np.random.RandomState(0)
    a, b, c = (rng.rand(4, 4) for _ in range(3))
    assert np.allclose(maxplus.product(maxplus.product(a, b), c), maxplus.product(a, maxplus.product(b, c)))
