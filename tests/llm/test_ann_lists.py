"""What the joins of the nearest-neighbour search read does not grow with the cells that a query visits."""

import numpy as np

from palimpsest.llm import op1_ann


def test_each_query_enters_the_joins_with_its_best_groups_only(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((1200, 8)).astype(np.float32)
    x[600:640] = x[100]  # copies of a query
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    raw, kept, candidates, stored = [], {}, op1_ann.candidates, op1_ann.stored
    monkeypatch.setattr(op1_ann, "candidates", lambda groups, k: raw.append(stored(candidates(groups, k), "raw")) or raw[0])
    monkeypatch.setattr(op1_ann, "stored", lambda d, label: kept.setdefault(label, stored(d, label)))
    rows = op1_ann.nearest(df, k=4).collect()
    assert kept["ann-lists"].groupBy("qa", "qb").count().agg({"count": "max"}).first()[0] == 5
    assert raw[0].count() > 10 * kept["ann-lists"].count()  # tables and cells times that
    # the best of all lists, worked out from the unmerged ones
    place = {i: v.tobytes() for i, v in enumerate(x)}
    same: dict = {}
    for i, v in place.items():
        same.setdefault(v, []).append(i)
    met: dict = {}
    for r in raw[0].collect():
        met.setdefault((r["qa"], r["qb"]), set()).update((r["score"], i) for i in same[place[r["least"]]])
    own = {q: next(k for k, found in met.items() if (0.0, q) in found) for q in range(0, 1200, 100)}
    got: dict = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    assert got == {q: sorted(p for p in met[k] if p[1] != q)[:4] for q, k in own.items()}
