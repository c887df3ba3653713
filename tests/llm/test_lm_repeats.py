"""What a symbol and the bytes before it fix is worked out once, and counts and scores stay those of all places."""

import random

import numpy as np
import pytest

from palimpsest.llm import op9_lm

rng = random.Random(5)
TEXTS = [b"", *("".join(rng.choice(["é ", "the ", "cat ", "\n", "sat "]) for _ in range(rng.randrange(400))).encode() for _ in range(60)), bytes(range(256))]


@pytest.fixture(scope="module")
def model():
    histogram = np.zeros((256, 257), np.int64)
    for t in TEXTS:
        for a, b in zip(b"\0" + t, [*t, op9_lm.END]):
            histogram[a, b] += 1
    code = op9_lm.Code(histogram)
    counts = np.zeros((len(op9_lm.ORDERS), 2 << op9_lm.BITS), np.int64)
    op9_lm.count_contexts(TEXTS, code, counts)
    return code, counts


def test_repeats_are_spelt_once(model, monkeypatch):
    code, counts = model
    pad, spell, spelt = max(op9_lm.ORDERS), code.spell, []
    monkeypatch.setattr(code, "spell", lambda symbols, before: (spelt.append(len(symbols)), spell(symbols, before))[1])
    different = len({tuple((bytes(pad) + t + b"\0")[i: i + pad]) + (s,) for t in TEXTS for i, s in enumerate([*t, op9_lm.END])})
    places = sum(len(t) + 1 for t in TEXTS)
    assert 10 * different < places
    op9_lm.count_contexts(TEXTS, code, np.zeros_like(counts))
    assert sum(spelt) == different
    spelt.clear()
    op9_lm.mix_scores(TEXTS, code, op9_lm.logits(counts))
    assert different <= sum(spelt) <= 1.1 * different


def test_counts_are_those_of_all_places(model):
    code, counts = model
    want = np.zeros_like(counts)
    for t in TEXTS:
        for i, s in enumerate([*t, op9_lm.END]):
            before = (bytes(max(op9_lm.ORDERS)) + t[:i])[::-1]
            _, _, node, bit = code.spell(np.array([s]), np.array([before[0]]))
            for k, order in enumerate(op9_lm.ORDERS):
                h = 0
                for b in before[:order]:
                    h = (h + b + 1) * 0x2C1B3C6D % 2**32
                    h ^= h >> 15
                for nd, one in zip(node.tolist(), bit.tolist()):
                    want[k, 2 * (((h * 0x9E3779B1 % 2**32) ^ nd) * 0xC2B2AE35 % 2**32 >> 32 - op9_lm.BITS) + one] += 1
    assert (counts == want).all()


@pytest.mark.parametrize("window", [1, 100, 5000])
def test_scores_do_not_depend_on_the_window(model, monkeypatch, window):
    code, counts = model
    table = op9_lm.logits(counts)
    want = op9_lm.mix_scores(TEXTS, code, table)
    monkeypatch.setattr(op9_lm, "WINDOW", window)
    assert np.array_equal(op9_lm.mix_scores(TEXTS, code, table), want)
