from __future__ import annotations

import random

import numpy as np
import pytest

from askahead.llm import crf, secrets
from askahead.llm.crf import BEGIN, INSIDE, OUTSIDE, TAGS, Crf

PIECES = ["word", "Key", "x", " ", "  ", "\n", "=", ":", "é", ".", "abcDEFghiJKLmno", "a1b2c3d4e5f6g7", "\t", " ", "-", "1"]


def plain(text, field):
    """Spans of a full Viterbi path over each line."""
    found, at, file = [], 0, secrets.file_features(text)
    for line in text.split("\n"):
        spans, rows, joined = secrets.features(text, at, at + len(line), file)
        for (a, b), tag in zip(spans, field.viterbi(rows, joined), strict=True):
            if tag == BEGIN:
                found.append((a, 3, b))
            elif tag == INSIDE:
                found[-1] = (found[-1][0], 3, b)
        at += len(line) + 1
    return found


@pytest.mark.parametrize("outside", [0.0, 0.5, 3.0, 10.0])
def test_every_line_is_tagged_by_its_whole_best_path(outside):
    rng, draw = np.random.default_rng(3), random.Random(5)
    hits = 0
    for _ in range(12):
        field = Crf(rng.normal(size=(crf.BUCKETS, TAGS)), rng.normal(size=(TAGS, TAGS)))
        field.weights[crf.bucket("bias"), OUTSIDE] += outside
        tagger = secrets.Tagger(field)
        for _ in range(15):
            text = "".join(draw.choice(PIECES) for _ in range(draw.randint(0, 40)))
            expected = plain(text, field)
            assert secrets.field_spans(text, tagger, []) == expected, text
            hits += len(expected)
    assert hits


def test_a_key_without_digits_is_looked_at():
    field = Crf(np.zeros((crf.BUCKETS, TAGS)), np.zeros((TAGS, TAGS)))
    field.weights[crf.bucket("bias"), OUTSIDE] = 1
    field.weights[crf.bucket("cases Ul 16-23"), BEGIN] = 5
    assert secrets.field_spans("the key QwertYuiopAsdfgHjkl ends", field, []) == [(8, 3, 27)]
    assert secrets.field_spans("the key QwertYuiopAsdfgHjkl ends", field, [(20, 0, 30)]) == []
    assert secrets.field_spans("the key QwertYuiopAsdfgHjkl ends", field, [(0, 0, 8), (27, 1, 30)]) == [(8, 3, 27)]


def test_what_a_task_remembers_is_bounded(monkeypatch):
    rng = np.random.default_rng(4)
    field = Crf(rng.normal(size=(crf.BUCKETS, TAGS)), rng.normal(size=(TAGS, TAGS)))
    monkeypatch.setattr(secrets, "_SEEN_TOKENS", 10)
    tagger = secrets.Tagger(field)
    for i in range(200):
        text = f"a{i} b{i} c{i}"
        assert secrets.field_spans(text, tagger, []) == plain(text, field)
        assert len(tagger) <= 20
