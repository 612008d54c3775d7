from __future__ import annotations

import random

import numpy as np
import pytest

from askahead.llm import crf, secrets
from askahead.llm.crf import TAGS, Crf


def test_remembered_shapes_score_like_their_tokens():
    rng, draw = np.random.default_rng(7), random.Random(8)
    field = Crf(rng.normal(size=(crf.BUCKETS, TAGS)), np.zeros((TAGS, TAGS)))
    tagger = secrets.Tagger(field)
    for _ in range(2000):
        chars = draw.choice(["abcdef", "abcxyz", "ABCxyz", "ABCDEF", "aB3", "0123", "Zz"])
        token = "".join(draw.choice(chars) for _ in range(draw.randint(1, 30)))
        _, rows, _ = secrets.features(token, 0, len(token), [])
        row = tagger[token]
        # The last five are the neighbours, which are edges here.
        assert tagger.scored()[row, 0] == pytest.approx(field.weights[rows[0][:-5]].sum(axis=0))


def test_tokens_with_digits_share_what_their_shape_scores():
    rng = np.random.default_rng(7)
    tagger = secrets.Tagger(Crf(rng.normal(size=(crf.BUCKETS, TAGS)), np.zeros((TAGS, TAGS))))
    rows = [tagger[f"{n}x"] for n in range(1000, 1200)]
    assert len(set(rows)) == 200 and len(tagger.own) == 1
    table = tagger.scored()
    assert (table[rows, :2] == table[rows[0], :2]).all() and len({str(x) for x in table[rows, 2:]}) > 1
