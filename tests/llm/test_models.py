"""The learned scores against their definitions, worked out step by step."""

import math
import random
import struct

import numpy as np
import pytest
import zstandard

from palimpsest.llm import op6_toxicity, op7_warc, op9_lm


def plain_mix(text: bytes, code, table) -> float:
    """One document, one decision after the other: mixing, refinement, and learning after each stride."""
    k = len(op9_lm.ORDERS)
    weights = [[1.25 / k] * k for _ in range(op9_lm.GATES)]
    bins = np.linspace(-8, 8, op9_lm.BINS)
    seen = [[op9_lm.PRIOR / (1 + math.exp(b)), op9_lm.PRIOR / (1 + math.exp(-b))] for b in bins]
    symbols, _ = op9_lm.stream([text])
    hashes = op9_lm.contexts(symbols)
    pad, total = max(op9_lm.ORDERS), 0.0
    for begin in range(0, len(text) + 1, op9_lm.STRIDE):
        learned, counted = [], []
        for at in range(pad + begin, min(pad + len(text) + 1, pad + begin + op9_lm.STRIDE)):
            _, depth, node, bit = code.spell(symbols[at: at + 1], symbols[at - 1: at])
            for d, nd, b in zip(depth, node, bit):
                gate = min(int(d), op9_lm.GATES - 1)
                inputs = [float(table[j][op9_lm.slot(hashes[j][at: at + 1].copy(), np.array([nd], np.uint32))[0]]) for j in range(k)]
                mixed = min(8.0, max(-8.0, sum(w * x for w, x in zip(weights[gate], inputs))))
                p = 1 / (1 + math.exp(-mixed))
                place = int((mixed + 8) * (op9_lm.BINS - 1) / 16 + 0.5)
                final = 0.75 * p + 0.25 * seen[place][1] / sum(seen[place])
                total += math.log10(final if b else 1 - final)
                learned.append((gate, [op9_lm.RATE * (int(b) - p) * x for x in inputs]))
                counted.append((place, int(b)))
        for gate, steps in learned:
            weights[gate] = [w + s for w, s in zip(weights[gate], steps)]
        for place, b in counted:
            seen[place][b] += 1
    return total


def test_context_mixing_against_single_decisions():
    rng = random.Random(1)
    texts = [b"", b"a", bytes(rng.choice(b"ab cd\n") for _ in range(70)), "é word ".encode() * 12, bytes(rng.randrange(256) for _ in range(33))]
    histogram = np.zeros((256, 257), np.int64)
    for t in texts:
        for a, b in zip(b"\0" + t, [*t, op9_lm.END]):
            histogram[a, b] += 1
    code = op9_lm.Code(histogram)
    counts = np.zeros((len(op9_lm.ORDERS), 2 << op9_lm.BITS), np.int64)
    op9_lm.count_contexts(texts, code, counts)
    table = op9_lm.logits(counts)
    got = op9_lm.mix_scores(texts, code, table)
    assert got == pytest.approx([plain_mix(t, code, table) for t in texts], rel=1e-4, abs=1e-4)


def risk(v: np.ndarray, bias: float, rows, positive, prior: float, scale: np.ndarray) -> float:
    s = np.array([(v * scale)[r].sum() + bias for r in rows])
    p, u = s[positive], s[~positive]
    return prior * np.logaddexp(0, -p).mean() + max(0.0, np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean())


def test_a_step_follows_the_non_negative_risk():
    rng = np.random.default_rng(3)
    positive = np.arange(60) < 20
    rows = [np.unique(np.r_[rng.integers(0, 32, 6), 40 + rng.integers(0, 3, 2) if p else 50]).astype(np.int32) for p in positive]
    prior, size = 0.3, 64
    in_p, in_u = (np.bincount(np.concatenate([r for r, p in zip(rows, positive) if p == k]), minlength=size) for k in (True, False))
    scale = (np.log((in_p + 1) / 22) - np.log((in_u + 1) / 42)) * (in_p + in_u) / (in_p + in_u + op6_toxicity.SHRINK)
    scale[np.abs(scale) < op6_toxicity.TELLING] = 0
    assert (scale != 0).sum() >= 3
    got = op6_toxicity.train(rows, positive, prior, bits=6, epochs=1, rate=1.0, decay=0.0)
    zero, h = np.zeros(size), 1e-5
    slope = lambda k: (risk(zero + h * (np.arange(size) == k), 0.0, rows, positive, prior, scale) - risk(zero - h * (np.arange(size) == k), 0.0, rows, positive, prior, scale)) / (2 * h)
    assert got[:-1] == pytest.approx([-slope(k) * scale[k] for k in range(size)], abs=1e-7)
    bias = (risk(zero, h, rows, positive, prior, scale) - risk(zero, -h, rows, positive, prior, scale)) / (2 * h)
    assert got[-1] == pytest.approx(-bias, abs=1e-7)


def test_the_risk_never_goes_below_what_positives_allow():
    """Where the unlabelled part falls below the prior's share of positives it counts as zero: unlabelled rows then push no more."""
    rows = [np.array([0], np.int32)] * 10 + [np.array([1], np.int32)] * 10
    positive = np.arange(20) < 10
    clipped = op6_toxicity.train(rows, positive, 0.9, bits=2, epochs=300, rate=1.0, decay=0.0)
    free = op6_toxicity.train(rows, positive, 0.1, bits=2, epochs=300, rate=1.0, decay=0.0)
    assert clipped[1] + clipped[-1] > free[1] + free[-1]


def test_compressed_dictionaries_are_read():
    rows = [op7_warc.record(str(i), "u", b"<p>page</p>" * 40, "x", None) for i in range(5)]
    words = zstandard.ZstdCompressionDict(rows[0], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packed, packer = zstandard.compress(words.as_bytes()), zstandard.ZstdCompressor(dict_data=words)
    archive = b"".join([struct.pack("<II", op7_warc.MAGIC, len(packed)), packed, *map(packer.compress, rows)])
    assert list(op7_warc.frames(archive)) == rows
