"""Mixing weights and the adaptive map learn within short documents too."""

import numpy as np
import pytest

from palimpsest.llm import op9_lm

TEXTS = [b"the cat sat on the mat and the dog sat on the log. " * 60, b"abc " * 500]
SHORT = [b"abc abc abc abd " * k for k in (2, 6, 20, 31)]


@pytest.fixture(scope="module")
def model():
    histogram = np.zeros((256, 257), np.int64)
    for t in TEXTS:
        np.add.at(histogram, (np.frombuffer(b"\0" + t, np.uint8).astype(int), np.r_[np.frombuffer(t, np.uint8).astype(int), op9_lm.END]), 1)
    code = op9_lm.Code(histogram)
    counts = np.zeros((len(op9_lm.ORDERS), 2 << op9_lm.BITS), np.int64)
    op9_lm.count_contexts(TEXTS, code, counts)
    return code, op9_lm.logits(counts)


def test_documents_below_512_bytes_learn(model, monkeypatch):
    learnt = op9_lm.mix_scores(SHORT, *model)
    monkeypatch.setattr(op9_lm, "STRIDE", 1 << 20)
    fixed = op9_lm.mix_scores(SHORT, *model)
    assert all(len(t) < 512 for t in SHORT) and (abs(learnt - fixed) > 1e-6).all()
    assert learnt[-1] > fixed[-1]


def test_scores_do_not_depend_on_the_others(model):
    mixed = [*SHORT, *TEXTS, b""]
    assert op9_lm.mix_scores(mixed, *model) == pytest.approx([op9_lm.mix_scores([t], *model)[0] for t in mixed], rel=1e-5)
