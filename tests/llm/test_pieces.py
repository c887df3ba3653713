"""Piece encoding: words by Arrow against the plain dynamic programme, and giant documents whatever their chunks."""

import random

import numpy as np
import pytest

from palimpsest.llm import op8_pieces

RNG = random.Random(3)
LETTERS = "abcdeinorst"


def text(n: int, blanks: bool) -> str:
    return "".join(RNG.choice(LETTERS + ("  " if blanks else "")) for _ in range(n))


@pytest.fixture(scope="module")
def vocabulary():
    return op8_pieces.Pieces(*op8_pieces.Pieces.load(op8_pieces.default_model())[:2])


def plain(p, t: str) -> tuple[int, list[int]]:
    escaped = op8_pieces.escape(t)
    best, start = p.best(escaped, [0], 0)
    return best[-1], p.trace(escaped, start, len(escaped))


def test_words_against_the_plain_programme(vocabulary):
    texts = ["", " ", "  a  b ", "x\ny", "▁ ▁▁", "é🦊\x00", "a" * 90, *[text(RNG.randrange(1, 60), True) for _ in range(200)]]
    scores, ids = vocabulary.encode_all([b" " + t.encode() if t else b"" for t in texts])
    for t, s, i in zip(texts, scores, ids):
        assert (s, np.frombuffer(i.as_py(), np.int32).tolist()) == plain(vocabulary, t)
    assert vocabulary.decode(ids) == [t.encode() for t in texts] and vocabulary.decode(ids[3:5]) == [t.encode() for t in texts[3:5]]


def test_chunks_do_not_matter(spark, vocabulary, monkeypatch):
    monkeypatch.setattr(op8_pieces, "FAN", 3)
    texts = [text(700, False), text(900, True), text(300, False) + " " + text(400, False), "short", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for chunk in (32, 57, 1 << 16):
        for r in op8_pieces.encode(docs, chunk=chunk).collect():
            score, ids = plain(vocabulary, texts[r["doc_id"]] or "")
            assert (r["score"], np.frombuffer(r["pieces"], np.int32).tolist()) == (score, ids)


def test_vocabularies_stay_apart():
    pieces, byte_ids, step, key = op8_pieces.Pieces.load(op8_pieces.default_model())
    other = [(p, i, s - 1) for p, i, s in pieces]
    assert step == 1.0 and op8_pieces.kept((other, byte_ids, step, "other")).scores[5] == op8_pieces.kept((pieces, byte_ids, step, key)).scores[5] - 1
