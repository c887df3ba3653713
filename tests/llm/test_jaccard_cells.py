"""Cells of buckets with few and very long documents."""

import numpy as np

from palimpsest.llm import op10_jaccard


def test_few_long_documents_in_several_blocks(spark):
    """Pairs of near copies of two blocks' weight: in some both fall into the first, and the second is empty."""
    rng, rows = np.random.default_rng(5), []
    for pair in range(24):
        words = [f"p{pair}w{i}" for i in rng.permutation(3000)]
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(words[:-20]))]
    most, op10_jaccard.CELL_SHINGLES = op10_jaccard.CELL_SHINGLES, 4000
    try:
        got = op10_jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        op10_jaccard.CELL_SHINGLES = most
    assert {(r["doc_id"], r["class_id"], r["n_links"]) for r in got} == {(i, i // 2 * 2, 1) for i in range(48)}


def test_prefixes_are_shortened_as_far_as_the_similarities_ask(spark, monkeypatch):
    """Copies of very high similarity meet at full depth; pairs near the threshold make the forest look at shorter prefixes."""
    depths = []
    deal_at = op10_jaccard.deal_at
    monkeypatch.setattr(op10_jaccard, "deal_at", lambda depth: depths.append(depth) or deal_at(depth))
    rng = np.random.default_rng(6)

    def pairs(cut: int) -> list[tuple[int, str]]:
        texts = [[f"p{p}w{i}" for i in rng.permutation(400)] for p in range(60)]
        return [(2 * p + k, " ".join(w[: len(w) - k * cut])) for p, w in enumerate(texts) for k in (0, 1)]

    for cut, want in ((1, [3]), (70, [3, 2])):
        depths.clear()
        got = op10_jaccard.classes(spark.createDataFrame(pairs(cut), "doc_id long, text string")).collect()
        assert depths == want and {(r["doc_id"], r["class_id"], r["n_links"]) for r in got} == {(i, i // 2 * 2, 1) for i in range(120)}


def test_recall_estimate():
    assert op10_jaccard.estimated_recall({}, 2) == 0 and op10_jaccard.estimated_recall({40: 9}, 3) == 1
    assert op10_jaccard.estimated_recall({32: 10}, 3) < 0.999 < op10_jaccard.estimated_recall({32: 10}, 2)
